"""Quality classifier: a sparse rule ensemble compiled into Spark column expressions.

Statistics of a text are column expressions. Shallow boosted trees over a bounded sample of labelled rows
propose conjunctive rules (every path from a root), a lasso logistic fit gives most rules no weight, and
the rest become `when` columns whose weighted sum is the logit. Scoring is one JVM expression of the text.

Defined cases: a null or empty text has all statistics 0 and is scored like any other; labels that are
null are skipped; with no labels, labels of one kind, or no statistic that tells them apart, every score is their mean (0.5 without any);
repeated rows are scored each; rows without doc_id are not held out; statistics use `text` alone; a doc_id
with several labels or rows is an example for each pair of them, and at most 2 * `sample_rows` such pairs, in
order of doc_id, are learned from; an empty table gives no rows; other columns are carried untouched.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import trees
from .common import table

#: At most so many labelled rows are learned from, by order of a hash of their id.
SAMPLE_ROWS = 20_000
THRESHOLD = 0.7
HELD_OUT = 2


def statistics(text: Column) -> Column:
    """A struct of the statistics of a text, as doubles; shares are of code points or words.

    Text and words are bound as elements of one-element arrays: however often the struct is used, and wherever
    the optimizer moves it, the text is split once and each pattern is applied once.
    """

    def count(t: Column, words: Column) -> Column:
        without = lambda pattern: F.length(t) - F.length(F.regexp_replace(t, pattern, ""))
        literal = lambda c: F.length(t) - F.length(F.replace(t, F.lit(c), F.lit("")))
        found = {
            "n_chars": F.length(t),
            "n_words": F.size(words),
            "n_distinct": F.size(F.array_distinct(words)),
            "n_upper": without("\\p{Lu}"),
            "n_digit": without("[0-9]"),
            "n_mark": without("[#$%&*@<>{}\\\\^~=_+]"),
            "n_bang": literal("!"),
            "n_pipe": literal("|"),
            "n_stop": literal("."),
            "n_comma": literal(","),
            "n_line": literal("\n"),
        }
        return F.struct(*(c.cast("double").alias(n) for n, c in found.items()))

    words_of = lambda t: F.filter(F.split(t, "[ \\x09-\\x0D]+"), lambda w: w != "")
    return bound(F.coalesce(text, F.lit("")), lambda t: bound(words_of(t), lambda words: count(t, words)))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


#: The inputs of rules: the statistics, and ratios of two of them (0 where the second is 0).
RATIOS = {
    "word_length": ("n_chars", "n_words"),
    "distinct_share": ("n_distinct", "n_words"),
    "upper_share": ("n_upper", "n_chars"),
    "digit_share": ("n_digit", "n_chars"),
    "mark_share": ("n_mark", "n_words"),
    "bang_share": ("n_bang", "n_words"),
    "pipe_share": ("n_pipe", "n_words"),
    "stop_share": ("n_stop", "n_words"),
    "comma_share": ("n_comma", "n_words"),
    "line_share": ("n_line", "n_words"),
}
INPUTS = ["n_chars", "n_words", *RATIOS]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == HELD_OUT, F.lit(False))


def inputs(text: Column) -> Column:
    """A struct of the inputs of rules; the statistics below it are computed once."""
    ratio = lambda q, a, b: F.when(q[b] > 0, q[a] / q[b]).otherwise(F.lit(0.0))
    return bound(statistics(text), lambda q: F.struct(*((ratio(q, *RATIOS[n]) if n in RATIOS else q[n]).alias(n) for n in INPUTS)))


@dataclass
class Rules:
    """intercept + weight of every conjunction that holds."""

    intercept: float
    rules: list[tuple[float, tuple]]

    def column(self, text: Column) -> Column:
        """The score of a text."""

        def logit(q: Column) -> Column:
            z = F.lit(self.intercept)
            for weight, conjunction in self.rules:
                holds = F.lit(True)
                for f, low, cut in conjunction:
                    x = q[INPUTS[f]]
                    holds = holds & ((x <= cut) if low else (x > cut))
                z = z + F.when(holds, weight).otherwise(0.0)
            return z

        return 1.0 / (1.0 + F.exp(-bound(inputs(text), logit)))

    def scores(self, x: np.ndarray) -> np.ndarray:
        return trees.sigmoid(self.intercept + sum((w * _holds(c, x) for w, c in self.rules), np.zeros(len(x))))


def _holds(conjunction: tuple, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, low, cut in conjunction:
        out &= (x[:, f] <= cut) if low else (x[:, f] > cut)
    return out


def _simplified(path: tuple) -> tuple:
    """One bound a side for each feature, in order of feature."""
    bounds: dict[tuple[int, bool], float] = {}
    for f, low, cut in path:
        bounds[f, low] = (min if low else max)(bounds.get((f, low), cut), cut)
    return tuple((f, low, cut) for (f, low), cut in sorted(bounds.items()))


def lasso_logistic(m: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Accelerated proximal gradient of the mean logistic loss plus `penalty` times the weights' sum of sizes."""
    w, v, b, c, t = np.zeros(m.shape[1]), np.zeros(m.shape[1]), 0.0, 0.0, 1.0
    u = np.random.default_rng(0).normal(size=m.shape[1])
    for _ in range(20):
        u = m.T @ (m @ u)
        u /= np.linalg.norm(u)
    step = 4 * len(y) / (np.linalg.norm(m @ u) ** 2 + len(y))
    for _ in range(steps):
        error = trees.sigmoid(m @ v + c) - y
        w_new, b_new = v - step * (m.T @ error) / len(y), c - step * error.mean()
        w_new = np.sign(w_new) * np.maximum(np.abs(w_new) - step * penalty, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = w_new + (t - 1) / t_new * (w_new - w), b_new + (t - 1) / t_new * (b_new - b)
        w, b, t = w_new, b_new, t_new
    return b, w


def fit_rules(x: np.ndarray, y: np.ndarray, rounds: int = 30, depth: int = 3, penalty: float = 5e-4) -> Rules:
    boosted = trees.fit(x, y, rounds, depth) if len(y) and y.min() < y.max() else trees.Boosted()
    rules = list(dict.fromkeys(_simplified(p) for t in boosted.trees for p in t.paths()))
    if not rules:
        p = float(y.mean()) if len(y) else 0.5
        return Rules(float(np.log((p + 1e-6) / (1 - p + 1e-6))), [])
    m = np.stack([_holds(r, x) for r in rules], 1).astype(np.float64)
    share = m.mean(0)
    scale = np.sqrt(np.maximum(share * (1 - share), 1e-4))
    b, w = lasso_logistic((m - share) / scale, y, penalty)
    w = w / scale
    kept = np.flatnonzero(np.abs(w) > 1e-8)
    return Rules(float(b - (w * share).sum()), [(float(w[k]), rules[k]) for k in kept])


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Rules:
    """Rules from labelled rows that are not held out; the sample (its bound is the parameter) is broadcast."""
    usable = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    some = usable.select(F.col("doc_id").alias("__label_id"), F.col("quality").cast("double").alias("__label")).orderBy(F.xxhash64("__label_id"), "__label_id").limit(sample_rows)
    rows = docs.select(F.col("doc_id").alias("__id"), F.col("text").alias("__text")).join(F.broadcast(some), F.col("__id") == F.col("__label_id"))
    got = rows.select("__id", "__label", inputs(F.col("__text")).alias("q")).orderBy("__id", "__label", "q").limit(2 * sample_rows).select("__label", "q.*").toPandas()
    return fit_rules(got[INPUTS].to_numpy(np.float64), got["__label"].to_numpy(np.float64))


def score(docs: DataFrame, rules: Rules, threshold: float = THRESHOLD) -> DataFrame:
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), rules.column(F.col("text")).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` that the rules accept, with their columns."""
    return docs.where(learn(docs, labels).column(F.col("text")) >= threshold)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, learn(docs, table(spark, sf_dir, "labels")))
