"""Benchmark decontamination by template canonicalisation.

Words become template tokens: numbers, names (capitalised words) and units turn into typed placeholders,
other words lose case and outer punctuation. Windows of four tokens are hashed, in three forms: names at
sentence starts as words, as names, and all tokens as words. A document and an item that share one are
aligned at every displacement where they do: tokens are equal by word or by type, runs of three or more
count, and at one displacement every slot value of the item must stand for one value of the document.
An item is found if a passage holds at least half of its tokens (and eight, or all but one, of a short one),
most of them as the same words, or one run of 13 tokens, or of eight that are a quarter of the item; or if it
holds nearly all of its template, with a third of that as the same words (three at least): a re-parameterised
question. Items that have no seed window of mostly words (dense in numbers and names) are sought by windows of
eight tokens, or the whole of a shorter one, with two words; items without words are found word for word.

The benchmark's index goes to the tasks when its checked number of windows is at most `in_memory`; past that,
all windows are joined by a shuffle and the texts to the pairs found. Both give the same rows.

Defined cases: null or empty texts match nothing; items with fewer than `shortest` template tokens match where
a document holds exactly their words in a row, items shorter than `window` where all their tokens are held;
items without tokens match nothing (`unsearchable` lists them); rows without doc_id or item_id take no part; rows of one doc_id, or of one item_id, are texts of their own and
give one row together; a character of a script without spaces is a word; other columns are carried untouched.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, table, without

WINDOW, SHORTEST, LITERALS, COVERAGE, CONSISTENT, IN_MEMORY = 8, 5, 0.6, 0.5, 0.75, 2_000_000
#: Tokens of a seed window; fewest tokens of a run that count; a run that is enough by itself, always or as this share of the item.
SEED, BLOCK, RUN, RUN_SHARE = 4, 3, 13, 0.25
#: Seed windows of items dense in slots: tokens and least words. A whole template: its share of the item, share and number of same words, least tokens.
WIDE, WIDE_WORDS, WHOLE, WHOLE_SHARE, WHOLE_WORDS, WHOLE_LEAST = 8, 2, 0.9, 0.3, 3, 6
#: Template tokens that a worker keeps.
TOKENS_HELD = 500_000
#: Units that stand after or inside a number.
UNITS = frozenset("mm cm m km in ft yd mi g kg mg lb oz t l ml gal s sec min h hr hour hours minute minutes day days week weeks month months year years usd eur gbp dollar dollars euro euros cent cents percent pct metre metres meter meters kilometre kilometres kilometer kilometers gram grams kilogram kilograms pound pounds litre litres liter liters mph kmh kph hz khz mhz ghz kb mb gb tb px w kw v".split())
NUMBER = re.compile(r"[-+]?[$€£]?\d[\d.,:/]*%?")
NUMBER_UNIT = re.compile(r"([-+]?[$€£]?\d[\d.,]*)([A-Za-z]{1,4})")
#: Scripts written without spaces: every character is a word.
UNSPACED = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
EDGE = re.compile(r"^[\W_]+|[\W_]+$")
PLAIN, NUM, NAME, UNIT = 0, 1, 2, 3
FOUND = "doc_id long, item_id long, n_tokens long, n_item_tokens long, longest_run long, coverage double"
MASK = (1 << 64) - 1


class How(NamedTuple):
    window: int = WINDOW
    shortest: int = SHORTEST
    literals: float = LITERALS
    coverage: float = COVERAGE
    consistent: float = CONSISTENT
    seed: int = SEED


class Tokens(dict):
    """chunk -> number; per number the hash of the word and of its type, the type, and whether it ends a sentence."""

    def __init__(self):
        self.exact, self.typed, self.kind, self.stops = [], [], [], []

    def _kind(self, core: str) -> int:
        if NUMBER.fullmatch(core) or NUMBER_UNIT.fullmatch(core):
            return NUM
        if core.lower() in UNITS:
            return UNIT
        return NAME if core[:1].isupper() and core[1:].islower() else PLAIN

    def __missing__(self, chunk: bytes) -> int:
        whole = chunk.decode()
        core = EDGE.sub("", whole)
        kind = self._kind(core) if core else -1
        exact = xxhash.xxh3_64_intdigest(core.lower().encode())
        n = self[chunk] = len(self.kind)
        self.exact.append(exact)
        self.typed.append((kind + 1) * 0x9E3779B97F4A7C15 & MASK if kind > PLAIN else exact)
        self.kind.append(kind)
        self.stops.append(whole[-1:] in ".!?:" or whole[-2:-1] in (".", "!", "?"))
        return n

    def arrays(self) -> tuple[np.ndarray, ...]:
        return np.array(self.exact, np.uint64), np.array(self.typed, np.uint64), np.array(self.kind, np.int8), np.array(self.stops, bool)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class Templates:
    """The template tokens of all texts together: hash of the word, hash of the type, name at a sentence start; each text's token count."""

    def __init__(self, texts: list[str], tokens: Tokens):
        numbers, starts, sizes = [], [], []
        for t in texts:
            before = len(numbers)
            if not t.isascii():
                t = UNSPACED.sub(r" \g<0> ", t)
            for line in t.encode().split(b"\n"):
                words = line.split()
                if words:
                    starts.append(len(numbers))
                    numbers.extend(map(tokens.__getitem__, words))
            sizes.append(len(numbers) - before)
        n = np.array(numbers, np.int64)
        exact, typed, kind, stops = tokens.arrays()
        begin = np.zeros(len(n), bool)
        if len(n):
            begin[1:] = stops[n[:-1]]
            begin[starts] = True
            real = kind[n] >= 0
            of_text = np.repeat(np.arange(len(texts)), sizes)[real]
            n, begin, sizes = n[real], begin[real], np.bincount(of_text, minlength=len(texts))
        self.exact, self.typed, self.sizes = exact[n], typed[n], np.array(sizes, np.int64)
        self.leading = begin & (kind[n] == NAME)
        self.before = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)
        self.of_text = np.repeat(np.arange(len(texts)), self.sizes)

    def forms(self, width: int, literals: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Hash of the window at each token, and whether it counts: names at sentence starts as words, as names, and all tokens as words."""
        yield from self.typed_forms(width, literals * width)
        if len(self.exact) >= width:
            yield hashes(self.exact, width), self.inside(width)

    def typed_forms(self, width: int, words: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The first two forms; windows with fewer than `words` words do not count."""
        if len(self.exact) < width:
            return
        inside = self.inside(width)
        for codes in (np.where(self.leading, self.exact, self.typed), self.typed):
            known = np.concatenate([[0], np.cumsum(codes == self.exact)])
            yield hashes(codes, width), inside & (known[width:] - known[:-width] >= words)

    def inside(self, width: int) -> np.ndarray:
        return self.of_text[: len(self.exact) - width + 1] == self.of_text[width - 1 :]

    def part(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        at = slice(self.before[i], self.before[i + 1])
        return self.exact[at], self.typed[at]


def hashes(codes: np.ndarray, width: int) -> np.ndarray:
    n = len(codes) - width + 1
    h = np.full(n, width, np.uint64)
    for k in range(width):
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + n])
    return h


def seeds_of(t: Templates, how: How) -> Iterator[tuple[int, int, int, int]]:
    """(text, hash, place, kind) of the seed windows of items. Kind 0: `how.seed` tokens; above: the whole of an item
    with fewer than `how.shortest` tokens, as words; below: minus the width of a wide window, for items without
    a typed window of the first kind."""
    long = t.sizes >= how.shortest
    dense = long.copy()
    for k, (h, ok) in enumerate(t.forms(how.seed, how.literals)):
        at = np.flatnonzero(ok)
        at = at[long[t.of_text[at]]]
        if k < 2:
            dense[t.of_text[at]] = False
        yield from ((i, x, place, 0) for i, x, place in zip(t.of_text[at].tolist(), h[at].tolist(), (at - t.before[t.of_text[at]]).tolist(), strict=True))
    for width in sorted({min(WIDE, int(x)) for x in t.sizes[dense]}):
        own = dense & (np.minimum(t.sizes, WIDE) == width)
        for h, ok in t.typed_forms(width, WIDE_WORDS):
            at = np.flatnonzero(ok)
            at = at[own[t.of_text[at]]]
            yield from ((i, x, place, -width) for i, x, place in zip(t.of_text[at].tolist(), h[at].tolist(), (at - t.before[t.of_text[at]]).tolist(), strict=True))
    for i in np.flatnonzero((t.sizes > 0) & ~long).tolist():
        yield i, int(hashes(t.part(i)[0], int(t.sizes[i]))[0]), 0, int(t.sizes[i])


class Index:
    """Items by their seed windows."""

    def __init__(self, ids: list, texts: list[str], how: How):
        t = Templates(texts, Tokens())
        seeds = list(seeds_of(t, how))
        found = sorted({(h, i, at) for i, h, at, _ in seeds})
        self.ids, self.items = ids, [t.part(i) for i in range(len(texts))]
        every = np.array([f[0] for f in found], np.uint64)
        self.hashes, begin = np.unique(every, return_index=True)
        self.begin = np.concatenate([begin, [len(every)]]).astype(np.int64)
        self.item, self.place = np.array([f[1] for f in found], np.int64), np.array([f[2] for f in found], np.int64)
        self.widths = sorted({kind for *_, kind in seeds} - {0})
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.hashes >> np.uint64(44)).astype(np.int64)] = True

    def candidates(self, t: Templates, how: How) -> dict[tuple[int, int], set[int]]:
        """(text, item) -> the displacements at which they share a seed window."""
        out: dict[tuple[int, int], set[int]] = {}
        if not len(self.hashes):
            return out
        for h, ok in windows(t, self.widths, how):
            at = np.flatnonzero(ok & self.bits[(h >> np.uint64(44)).astype(np.int64)])
            spot = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
            at, spot = at[self.hashes[spot] == h[at]], spot[self.hashes[spot] == h[at]]
            of = t.of_text[at]
            for i, place, s in zip(of.tolist(), (at - t.before[of]).tolist(), spot.tolist(), strict=True):
                for k in range(self.begin[s], self.begin[s + 1]):
                    out.setdefault((i, int(self.item[k])), set()).add(place - int(self.place[k]))
        return out


def windows(t: Templates, widths: list[int], how: How) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Windows of documents: the seeds in all forms, and those of the other kinds that items have."""
    yield from t.forms(how.seed, how.literals)
    for width in widths:
        if width < 0:
            yield from t.typed_forms(-width, WIDE_WORDS)
        elif len(t.exact) >= width:
            yield hashes(t.exact, width), t.inside(width)


def runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], x.astype(np.int8), [0]])))
    return edge[::2], edge[1::2]


def judged(item: tuple[np.ndarray, np.ndarray], doc: tuple[np.ndarray, np.ndarray], shifts: set[int], how: How) -> tuple[int, int] | None:
    """Tokens of the item that an aligned passage of the document holds, and the longest run of them; None if not enough."""
    (word, typed), (doc_word, doc_typed) = item, doc
    n, lined, longest, most = len(word), [], 0, 0
    if n < how.shortest:
        whole = any(0 <= s <= len(doc_word) - n and np.array_equal(word, doc_word[s : s + n]) for s in shifts)
        return (n, n) if whole else None
    for s in sorted(shifts):
        lo, hi = max(0, -s), min(n, len(doc_word) - s)
        same = word[lo:hi] == doc_word[s + lo : s + hi]
        equal = same | (typed[lo:hi] == doc_typed[s + lo : s + hi])
        begin, end = runs(equal)
        for a, b in zip(begin.tolist(), end.tolist(), strict=True):
            if b - a < BLOCK:
                equal[a:b] = False
        slot = np.flatnonzero(equal & (typed[lo:hi] != word[lo:hi]))
        pairs = set(zip(word[lo:hi][slot].tolist(), doc_word[s + lo : s + hi][slot].tolist(), strict=True))
        if len(pairs) * how.consistent > len({a for a, _ in pairs}):
            continue
        for a, b in zip(begin.tolist(), end.tolist(), strict=True):
            if b - a >= how.window and (b - a >= RUN or b - a >= RUN_SHARE * n):
                known = np.concatenate([[0], np.cumsum(same[a:b])])
                if (known[how.window :] - known[: -how.window]).max() >= how.literals * how.window:
                    longest, most = max(longest, b - a), max(most, b - a)
        lined.append((s, lo, hi, equal, same & equal))
    least = max(how.coverage * n, min(n if n < how.window else n - 1, how.window))
    first = 0
    for k, (s, *_) in enumerate(lined):
        while lined[first][0] < s - n // 2 - how.seed:
            first += 1
        held, exact = np.zeros(n, bool), np.zeros(n, bool)
        for _, lo, hi, equal, same in lined[first : k + 1]:
            held[lo:hi] |= equal
            exact[lo:hi] |= same
        whole = n >= WHOLE_LEAST and held.sum() >= WHOLE * n and exact.sum() >= max(WHOLE_WORDS, WHOLE_SHARE * held.sum())
        if whole or held.sum() >= least and exact.sum() >= how.literals * held.sum():
            begin, end = runs(held)
            most, longest = max(most, int(held.sum())), max(longest, int((end - begin).max()))
        if most == n:
            break
    return (most, longest) if most else None


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shortest: int = SHORTEST, literals: float = LITERALS, coverage: float = COVERAGE, consistent: float = CONSISTENT, in_memory: int = IN_MEMORY, seed: int = SEED) -> DataFrame:
    """doc_id, item_id, n_tokens (of the item, in a passage of the document), n_item_tokens, longest_run, coverage."""
    how = How(window, shortest, literals, coverage, consistent, seed)
    docs = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    items = benchmark.select("item_id", "text").where("item_id is not null and text is not null").distinct()

    def item_rows(tokens: Tokens, ids: list, texts: list) -> dict[str, list]:
        t = Templates(texts, renewed(tokens))
        found = list(seeds_of(t, how))
        return {"item_id": [ids[f[0]] for f in found], "seed": [int(np.uint64(f[1]).astype(np.int64)) for f in found], "kind": [f[3] for f in found]}

    def row(doc_id: int, item_id: int, n: int, got: tuple[int, int]) -> tuple:
        return doc_id, item_id, got[0], n, got[1], got[0] / n

    seeds = arrow_map(items, item_rows, "item_id long, seed long, kind long", lambda: (Tokens(),))
    if seeds.limit(in_memory + 1).count() <= in_memory:
        held = items.toArrow()
        index = Index(held["item_id"].to_pylist(), held["text"].to_pylist(), how)

        def rows(tokens: Tokens, ids: list, texts: list) -> dict[str, list]:
            t = Templates(texts, renewed(tokens))
            pairs = index.candidates(t, how).items()
            return columns(row(ids[i], index.ids[k], len(index.items[k][0]), got) for (i, k), shifts in pairs if (got := judged(index.items[k], t.part(i), shifts, how)))

        found = arrow_map(docs, rows, FOUND, lambda: (Tokens(),))
    else:
        widths = sorted(r["kind"] for r in seeds.where("kind <> 0").select("kind").distinct().collect())

        def doc_rows(tokens: Tokens, ids: list, texts: list) -> dict[str, list]:
            t = Templates(texts, renewed(tokens))
            out: dict[str, list] = {"doc_id": [], "seed": []}
            for h, ok in windows(t, widths, how):
                at = np.flatnonzero(ok)
                out["doc_id"] += [ids[i] for i in t.of_text[at].tolist()]
                out["seed"] += h[at].astype(np.int64).tolist()
            return out

        def pair_rows(tokens: Tokens, ids: list, texts: list, item_ids: list, item_texts: list) -> dict[str, list]:
            out, tokens = [], renewed(tokens)
            for i, text, k, item in zip(ids, texts, item_ids, item_texts, strict=True):
                t, index = Templates([text], tokens), Index([k], [item], how)
                for shifts in index.candidates(t, how).values():
                    if got := judged(index.items[0], t.part(0), shifts, how):
                        out.append(row(i, k, len(index.items[0][0]), got))
            return columns(out)

        pairs = arrow_map(docs, doc_rows, "doc_id long, seed long", lambda: (Tokens(),)).distinct().join(seeds.select("item_id", "seed").distinct(), "seed").select("doc_id", "item_id").distinct()
        texts = pairs.join(docs, "doc_id").join(items.withColumnRenamed("text", "item_text"), "item_id").select("doc_id", "text", "item_id", "item_text")
        found = arrow_map(texts, pair_rows, FOUND, lambda: (Tokens(),))
    best = F.max(F.struct("coverage", "n_tokens", "n_item_tokens", "longest_run")).alias("x")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "x.n_tokens", "x.n_item_tokens", "x.longest_run", "x.coverage")


def unsearchable(benchmark: DataFrame) -> DataFrame:
    """item_id of the items that nothing can match: null or blank texts, or marks alone."""

    def rows(ids: list, texts: list) -> dict[str, list]:
        sizes = Templates([t or "" for t in texts], Tokens()).sizes
        return {"item_id": [i for i, n in zip(ids, sizes.tolist(), strict=True) if not n]}

    return arrow_map(benchmark.select("item_id", "text"), rows, "item_id long")


def renewed(tokens: Tokens) -> Tokens:
    if len(tokens) > TOKENS_HELD:
        tokens.clear()
        tokens.__init__()
    return tokens


def columns(rows: Iterable[tuple]) -> dict[str, list]:
    names, rows = [f.split()[0] for f in FOUND.split(", ")], list(rows)
    return {name: [r[k] for r in rows] for k, name in enumerate(names)}


def clean(docs: DataFrame, benchmark: DataFrame, **how: float) -> DataFrame:
    """The rows of `docs` without a contaminated doc_id, with their columns."""
    return without(docs, contaminated(docs, benchmark, **how))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
