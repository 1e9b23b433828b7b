"""Column detection: interval merging, gaps, splits, assignment. All are expressions over a page's arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binding import bound
from ..functions.geometry import FULL_WIDTH, clear_of_margins, d, middle, side_by_side, width

#: Merge slack, label size and margins, gap sizes, least blocks.
SLACK, LABEL, OUTER, LEAST_GAP, GAP_SHARE, LEAST_BLOCKS, TITLE_SIZE = 3.0, 40.0, 30.0, 8.0, 0.55, 4, 14.0
INTERVALS = "array<struct<a:double,b:double>>"


def without_margins(blocks: Column, page_height: Column) -> Column:
    return F.filter(blocks, lambda b: clear_of_margins(b, page_height))


def intervals(blocks: Column, page_width: Column) -> Column:
    """Merged x-intervals of the narrow blocks, left to right, without labels in the outer margins."""
    def merge(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["a"].alias("a"), F.greatest(last["b"], x["b"]).alias("b"))))
        return F.when(F.size(done) == 0, F.array(x)).when(x["a"] <= last["b"] + SLACK, joined).otherwise(F.concat(done, F.array(x)))

    def merged(narrow: Column) -> Column:
        found = F.aggregate(F.array_sort(F.transform(narrow, lambda b: F.struct(b["x0"].alias("a"), b["x1"].alias("b")))), F.array().cast(INTERVALS), merge)
        label = lambda m: ((m["b"] - m["a"]) < LABEL) & ((m["a"] < OUTER) | (m["b"] > page_width - OUTER))
        return F.when(F.size(narrow) >= LEAST_BLOCKS, F.filter(found, lambda m: ~label(m))).otherwise(F.array().cast(INTERVALS))

    return bound(F.filter(blocks, lambda b: width(b) < d(FULL_WIDTH) * page_width), merged)


def _gaps(merged: Column) -> Column:
    return bound(merged, _pairs)


def _pairs(found: Column) -> Column:
    pairs = F.zip_with(F.slice(found, 1, F.greatest(F.size(found) - 1, F.lit(0))), F.slice(found, 2, F.greatest(F.size(found) - 1, F.lit(0))), lambda x, y: F.struct((y["a"] - x["b"]).alias("gap"), ((x["b"] + y["a"]) / 2).alias("mid")))
    return F.when(F.size(found) > 1, pairs).otherwise(F.array().cast("array<struct<gap:double,mid:double>>"))


def splits_of(found: Column) -> Column:
    """Column borders: midpoints of every gap that is wide enough and comparable to the widest."""
    def wide(gaps: Column) -> Column:
        widest = F.array_max(F.transform(gaps, lambda g: g["gap"]))
        return bound(widest, lambda w: F.transform(F.filter(gaps, lambda g: (g["gap"] >= LEAST_GAP) & (g["gap"] >= d(GAP_SHARE) * w)), lambda g: g["mid"]))

    return bound(_gaps(found), wide)


def widest_split(found: Column) -> Column:
    """The leftmost widest gap's midpoint, or null below the least gap."""
    ranked = F.array_sort(F.transform(_gaps(found), lambda g, i: F.struct((-g["gap"]).alias("gap"), i.alias("i"), g["mid"].alias("mid"))))
    return bound(F.try_element_at(ranked, F.lit(1)), lambda first: F.when(-first["gap"] >= LEAST_GAP, first["mid"]))


def splits(blocks: Column, page_width: Column) -> Column:
    return splits_of(intervals(blocks, page_width))


def column_of(x: Column, borders: Column) -> Column:
    return F.size(F.filter(borders, lambda s: x > s))


def band_of(y: Column, separators: Column) -> Column:
    return F.size(F.filter(separators, lambda s: y >= s))


def columns_overlap(blocks: Column, borders: Column) -> Column:
    """Whether blocks of the first and the last non-empty column stand side by side."""
    def beside(placed: Column) -> Column:
        side = lambda end: bound(end(F.transform(placed, lambda p: p["c"])), lambda c: F.filter(placed, lambda p: p["c"] == c))
        several = F.array_min(F.transform(placed, lambda p: p["c"])) < F.array_max(F.transform(placed, lambda p: p["c"]))
        both = F.struct(side(F.array_min).alias("first"), side(F.array_max).alias("last"))
        return several & bound(both, lambda s: F.exists(s["first"], lambda a: F.exists(s["last"], lambda b: side_by_side(a, b))))

    placed = F.transform(blocks, lambda b: F.struct(column_of(middle(b), borders).alias("c"), b["y0"].alias("y0"), b["y1"].alias("y1")))
    return F.coalesce((F.size(borders) > 0) & bound(placed, beside), F.lit(False))


def with_needs_reorder(pages: DataFrame, name: str = "needs") -> DataFrame:
    """Whether two filled columns stand side by side left and right of the first border, under `name`.

    Each step is a column of its own: inside a lambda the borders would be found again for every block.
    """
    pw = F.col("width")
    p = pages.withColumn("__clear", without_margins(F.filter("blocks", lambda b: (width(b) < d(FULL_WIDTH) * pw) & (width(b) >= 25)), F.col("height")))
    p = p.withColumn("__merged", intervals(F.col("__clear"), pw)).withColumn("__first", F.try_element_at(splits_of(F.col("__merged")), F.lit(1)))
    p = p.withColumn("__left", F.filter("__clear", lambda b: b["x1"] <= F.col("__first"))).withColumn("__right", F.filter("__clear", lambda b: b["x0"] >= F.col("__first")))
    beside = F.exists("__left", lambda a: F.exists("__right", lambda b: side_by_side(a, b)))
    return p.withColumn(name, F.coalesce((F.size("__left") >= 2) & (F.size("__right") >= 2) & beside, F.lit(False))).drop("__clear", "__merged", "__first", "__left", "__right")
