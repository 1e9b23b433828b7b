"""Boosted trees for a yes/no target over a bounded table of numbers, in NumPy."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Node:
    """A split (rows with x[feature] <= threshold go left) or, without one, a leaf."""

    value: float = 0.0
    feature: int = -1
    threshold: float = 0.0
    left: Node | None = None
    right: Node | None = None

    def scores(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(len(x))
        self._put(np.ascontiguousarray(x.T), np.arange(len(x)), out)
        return out

    def _put(self, columns: np.ndarray, rows: np.ndarray, out: np.ndarray) -> None:
        if self.left is None:
            out[rows] = self.value
        elif len(rows):
            low = columns[self.feature][rows] <= self.threshold
            self.left._put(columns, rows[low], out)
            self.right._put(columns, rows[~low], out)

    def paths(self, so_far: tuple = ()) -> list[tuple]:
        """The conjunction that leads to every node below this one: (feature, is_low, threshold) each."""
        if self.left is None:
            return []
        found = []
        for low, child in ((True, self.left), (False, self.right)):
            own = (*so_far, (self.feature, low, self.threshold))
            found += [own, *child.paths(own)]
        return found


@dataclass
class Boosted:
    base: float = 0.0
    trees: list[Node] = field(default_factory=list)

    def scores(self, x: np.ndarray) -> np.ndarray:
        columns, rows, out, one = np.ascontiguousarray(x.T), np.arange(len(x)), np.full(len(x), self.base), np.empty(len(x))
        for t in self.trees:
            t._put(columns, rows, one)
            out += one
        return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def _grow(x: np.ndarray, bins: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray, depth: int, least: int, l2: float) -> Node:
    total_g, total_h = g.sum(), h.sum()
    node = Node(value=float(total_g / (total_h + l2)))
    if depth == 0 or len(g) < 2 * least:
        return node
    best = 1e-6
    for f, cuts in enumerate(edges):
        if not len(cuts):
            continue
        n = len(cuts) + 1
        cg, ch, cn = (np.cumsum(np.bincount(bins[:, f], w, n))[:-1] for w in (g, h, None))
        fit = (cn >= least) & (len(g) - cn >= least)
        gain = np.where(fit, cg**2 / (ch + l2) + (total_g - cg) ** 2 / (total_h - ch + l2) - total_g**2 / (total_h + l2), 0)
        k = int(gain.argmax())
        if gain[k] > best:
            best, node.feature, node.threshold = gain[k], f, float(cuts[k])
    if node.feature < 0:
        return node
    low = x[:, node.feature] <= node.threshold
    node.left, node.right = (_grow(x[m], bins[m], edges, g[m], h[m], depth - 1, least, l2) for m in (low, ~low))
    return node


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.3, least: int = 20, l2: float = 1.0, bins: int = 32) -> Boosted:
    """Second-order boosting of the logistic loss; thresholds are quantiles of each feature."""
    if not len(y) or y.min() == y.max():
        p = float(y.mean()) if len(y) else 0.5
        return Boosted(float(np.log((p + 1e-6) / (1 - p + 1e-6))))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for f in range(x.shape[1])]
    edges = [e[e < x[:, f].max()] for f, e in enumerate(edges)]
    coded = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1)
    model = Boosted(float(np.log(y.mean() / (1 - y.mean()))))
    z = np.full(len(y), model.base)
    for _ in range(rounds):
        p = sigmoid(z)
        tree = _grow(x, coded, edges, y - p, p * (1 - p), depth, least, l2)
        for leaf in _leaves(tree):
            leaf.value *= rate
        model.trees.append(tree)
        z += tree.scores(x)
    return model


def _leaves(node: Node) -> list[Node]:
    return [node] if node.left is None else _leaves(node.left) + _leaves(node.right)
