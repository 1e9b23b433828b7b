"""Reading order: bands between full-width elements, columns inside bands; zones; the page text."""

from __future__ import annotations

import bisect
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.binding import bound
from ..functions.geometry import FULL_WIDTH, LEAST_WIDTH, covered_by, d, excluded, inside_any, middle, width
from ..functions.text import collapsed, reading_key
from ..plans import planner
from ..sources.layout import LINE, block_from_lines
from . import columns
from .markdown import BOXES, block_md, boxes, dedup_boxes, legend, table_md
from .profile import FLOOR, block_text, data_tables, visible_blocks, with_profile

GAP = "\n\n"
LEAST_WORDS, LEAST_SIDE = 8, 3


def _titled(b: Column) -> Column:
    return F.when(F.coalesce(b["title"], F.lit("")) != "", F.concat(F.lit("**"), b["title"], F.lit("**\n\n"), b["md"])).otherwise(b["md"])


def with_reading_order(pages: DataFrame, name: str = "reading", move_title: bool = False) -> DataFrame:
    """The pages with their markdown in reading order, under `name`. One row in, one row out, no shuffle."""
    col, pw = F.col, F.col("width")
    keep = list(pages.columns)
    p = pages.withColumn("__t", data_tables(col("tables"), col("exclude")))
    p = p.withColumn("__vis", visible_blocks(col("blocks"), col("exclude")))
    p = p.withColumn("__made", boxes(col("drawings"), col("__vis"), col("__t"), col("exclude"), pw, col("height"))).withColumn("__boxes", dedup_boxes(col("__made"), BOXES))
    p = p.withColumn("__blocks", F.filter(F.filter(col("__vis"), lambda b: (b["max_size"] >= FLOOR) | legend(b, col("__t"))), lambda b: ~inside_any(b, col("__t"))))
    p = p.withColumn("__splits", columns.splits(columns.without_margins(col("__blocks"), col("height")), pw))
    titles = F.filter(F.transform(col("__boxes"), lambda b: b["title"]), lambda t: t != "")
    named = lambda b, ts: bound(collapsed(block_text(b)), lambda own: F.array_contains(ts, own))
    p = p.withColumn("__out", bound(titles, lambda ts: F.filter(col("__blocks"), lambda b: ~inside_any(b, col("__boxes")) & ~((F.size(ts) > 0) & F.coalesce(named(b, ts), F.lit(False))))))
    wide = lambda r: width(r) >= d(FULL_WIDTH) * pw
    p = p.withColumn("__body", F.filter(col("__out"), lambda b: ~wide(b) & (width(b) >= LEAST_WIDTH)))
    if move_title:
        first = F.coalesce(F.try_element_at(col("__splits"), F.lit(1)), pw + 1)
        is_title = lambda b: (b["max_size"] >= columns.TITLE_SIZE) & (b["x0"] < first)
        moved = F.array_sort(F.transform(F.filter(col("__body"), is_title), lambda b, i: F.struct(b["max_size"].alias("s"), i.alias("i"), block_md(b, True).alias("md"))))
        p = p.withColumn("__moved", F.transform(moved, lambda x: x["md"])).withColumn("__body", F.filter(col("__body"), lambda b: ~is_title(b)))
    tables = F.filter(F.transform(col("__t"), lambda t: F.struct(*(t[k].alias(k) for k in ("x0", "y0", "x1")), table_md(t).alias("md"))), lambda t: t["md"] != "")
    p = p.withColumn("__tables", tables)

    def mark(kind: int, md):
        return lambda b, i: F.struct(b["y0"].alias("y0"), F.lit(kind).alias("kind"), i.alias("i"), md(b).alias("md"))

    separators = F.concat(
        F.filter(F.transform(F.filter(col("__out"), wide), mark(0, lambda b: block_md(b, False))), lambda s: s["md"] != ""),
        F.transform(F.filter(col("__tables"), wide), mark(1, lambda t: t["md"])), F.transform(F.filter(col("__boxes"), wide), mark(2, _titled)))
    p = p.withColumn("__sep", F.array_sort(separators)).withColumn("__marks", F.transform("__sep", lambda s: s["y0"]))

    def item(kind: int, md):
        return lambda b, i: F.struct(columns.band_of(b["y0"], col("__marks")).alias("band"), F.lit(0).alias("sep"), columns.column_of(middle(b), col("__splits")).alias("col"), b["y0"].alias("y0"), b["x0"].alias("x0"), F.lit(kind).alias("kind"), i.alias("i"), md(b).alias("md"))

    rest = F.concat(
        F.transform(col("__body"), item(0, lambda b: block_md(b, True))), F.transform(F.filter(col("__tables"), lambda t: ~wide(t)), item(1, lambda t: t["md"])),
        F.transform(F.filter(col("__boxes"), lambda b: ~wide(b)), item(2, _titled)),
        F.transform(col("__sep"), lambda s, k: F.struct(k.cast("int").alias("band"), F.lit(1).alias("sep"), F.lit(0).alias("col"), s["y0"].alias("y0"), d(0).alias("x0"), F.lit(0).alias("kind"), k.alias("i"), s["md"].alias("md"))))
    ordered = F.transform(F.array_sort(F.filter(rest, lambda x: x["md"] != "")), lambda x: x["md"])
    return p.select(*keep, F.array_join(F.concat(col("__moved"), ordered) if move_title else ordered, GAP).alias(name))


def lines_of(blocks: Column) -> Column:
    """Lines for decoders that give none: the lines of each block, with equal shares of its height."""
    def share(b: Column) -> Column:
        n = F.size(b["lines"])
        at = lambda k: b["y0"] + (b["y1"] - b["y0"]) * k / n
        size = lambda line: F.coalesce(F.array_max(F.transform(line, lambda s: s["size"])), b["max_size"])
        return F.transform(b["lines"], lambda line, k: F.struct(b["block_id"].alias("blk"), b["x0"].alias("x0"), at(k).alias("y0"), b["x1"].alias("x1"), F.when(k + 1 == n, b["y1"]).otherwise(at(k + 1)).alias("y1"), size(line).alias("max_size"), line.alias("spans")))

    return F.transform(F.flatten(F.transform(blocks, share)), lambda x, i: F.struct(i.cast("int").alias("line_id"), *(x[k].alias(k) for k in ("blk", "x0", "y0", "x1", "y1", "max_size", "spans"))))


def first_zone(r: Column, zones: Column) -> Column:
    """Place (from 1) of the first zone that covers r; 0 without one."""
    return F.coalesce(F.array_position(F.transform(zones, lambda z: covered_by(r, z)), True), F.lit(0))


def inclusion_order(lines: Column, include: Column, exclude: Column) -> Column:
    """Markdown of the lines inside inclusion zones, zone by zone; lines of a block that follow each other stay together."""
    placed = F.transform(F.filter(lines, lambda x: ~excluded(x, exclude)), lambda x: F.struct(first_zone(x, include).alias("zone"), x["y0"].alias("y0"), x["x0"].alias("x0"), x["line_id"].alias("i"), x.alias("line")))
    ordered = F.array_sort(F.filter(placed, lambda p: p["zone"] > 0))
    kind = f"array<struct<zone:bigint,blk:int,lines:array<{LINE}>>>"

    def step(done: Column, p: Column) -> Column:
        last, line = F.element_at(done, -1), F.array(p["line"])
        grown = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["zone"].alias("zone"), last["blk"].alias("blk"), F.concat(last["lines"], line).alias("lines"))))
        return F.when((F.size(done) > 0) & (last["zone"] == p["zone"]) & (last["blk"] == p["line"]["blk"]), grown).otherwise(F.concat(done, F.array(F.struct(p["zone"].alias("zone"), p["line"]["blk"].alias("blk"), line.alias("lines")))))

    groups = F.aggregate(ordered, F.array().cast(kind), step)
    return F.array_join(F.filter(F.transform(groups, lambda g: block_md(block_from_lines(g["lines"], g["blk"]), True)), lambda t: t != ""), GAP)


def _cut_glued(text: str, left: str, right: str) -> str:
    """Containment of prefixes and suffixes is monotone in their length, so word borders are bisected."""
    out = []
    for para in text.split(GAP):
        own = para.strip()
        words, norm = own.split(), " ".join(re.sub(r"-\s*\n\s*", "", own).split()).lower()
        borders = [i for i, c in enumerate(norm) if c == " "]
        if len(words) >= LEAST_WORDS:
            ends = [*borders, len(norm)]
            n = bisect.bisect_left(ends, True, key=lambda i: norm[:i] not in left)
            p = ends[n - 1] if n else 0
            starts = [0, *(i + 1 for i in borders)]
            m = bisect.bisect_left(starts, True, key=lambda i: norm[i:] in right)
            s = len(norm) - starts[m] if m < len(starts) else 0
            k = len(norm[:p].split())
            if p and s and len(norm) - 1 <= p + s and p < len(norm) - s and LEAST_SIDE <= k <= len(words) - LEAST_SIDE:
                out += [" ".join(words[:k]), " ".join(words[k:])]
                continue
        out.append(own)
    return GAP.join(x for x in out if x)


@F.pandas_udf(StringType())
def split_glued(text: pd.Series, left: pd.Series, right: pd.Series) -> pd.Series:
    """Paragraphs whose head stands in the left column and whose tail in the right one are cut there.
    Null stays null: rows that need no cut cost nothing."""
    return pd.Series([None if t is None else _cut_glued(t, a or "", b or "") for t, a, b in zip(text, left, right, strict=True)], dtype=object)


def page_lines() -> Column:
    """The decoder's lines of a page, or one line a block where it gives none."""
    return F.when(F.size("lines") > 0, F.col("lines")).otherwise(lines_of(F.col("blocks")))


def clip_text(lines: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Text of the lines whose middle lies in a rectangle (its left and upper edge not included), a line each."""
    down = lambda r: (r["y0"] + r["y1"]) / 2
    held = F.filter(lines, lambda r: (middle(r) > x0) & (middle(r) <= x1) & (down(r) > y0) & (down(r) <= y1))
    return F.array_join(F.transform(held, lambda r: F.array_join(F.transform(r["spans"], lambda s: s["text"]), " ")), "\n")


def column_texts(split: Column) -> tuple[Column, Column]:
    """Normalised texts of a page left and right of a border, by the middle of each line; heights do not matter."""
    rows = lambda lines, of: F.transform(lines, lambda x: F.struct(of(x)["x0"].alias("x0"), of(x)["x1"].alias("x1"), (x["spans"] if of(x) is x else x).alias("spans")))
    own = F.flatten(F.transform("blocks", lambda b: rows(b["lines"], lambda x: b)))
    lines = F.when(F.size("lines") > 0, rows(F.col("lines"), lambda x: x)).otherwise(own)
    side = lambda test: reading_key(F.array_join(F.transform(F.filter(lines, test), lambda r: F.array_join(F.transform(r["spans"], lambda s: s["text"]), " ")), "\n"))
    return side(lambda r: middle(r) <= split), side(lambda r: middle(r) > split)


def with_split_glued(pages: DataFrame, text: str, name: str, needed: Column | None = None) -> DataFrame:
    """The pages with glued paragraphs of `text` cut; unchanged without a clear border or where not needed."""
    border = columns.widest_split(columns.intervals(columns.without_margins(F.col("blocks"), F.col("height")), F.col("width")))
    p = pages.withColumn("__border", border if needed is None else F.when(needed, border))
    left, right = column_texts(F.col("__border"))
    p = p.withColumn("__left", F.when(F.col("__border").isNotNull(), left)).withColumn("__right", F.when(F.col("__border").isNotNull(), right))
    # Both sides stand twice, so that the optimizer keeps them as columns: it does not find a Python function again
    # whose arguments hold nested lambdas.
    cut = split_glued(F.when(F.col("__left").isNotNull() & F.col("__right").isNotNull(), F.col(text)), F.col("__left"), F.col("__right"))
    return p.withColumn("__cut", cut).withColumn(name, F.coalesce("__cut", text)).drop("__border", "__left", "__right", "__cut")


def page_text(pages: DataFrame, backend: str = planner.TEXT_BACKEND, mode: str = "auto", overrides: planner.Overrides | None = None) -> DataFrame:
    """The pages with `profile`, `plan`, `text` and `label` (auto or manual).

    Inclusion zones decide alone; exclusion zones rebuild the reading order and then take the plan without
    its reordering; else the plan is applied to the raw text. A fix with an empty result changes nothing.
    """
    col = F.col
    has_in, has_out = F.size("include") > 0, F.size("exclude") > 0
    p = with_profile(pages)
    planned = planner.plan(col("profile"), backend, mode, overrides)
    p = p.withColumn("plan", F.when(has_in, F.array().cast("array<string>")).when(has_out, F.array_remove(planned, "reorder_columns")).otherwise(planned))
    p = with_reading_order(p, "__reading")
    p = p.withColumn("__included", F.when(has_in, inclusion_order(page_lines(), col("include"), col("exclude"))))
    p = p.withColumn("__now", F.when(has_out & ~has_in & (col("__reading") != ""), col("__reading")).otherwise(F.coalesce("raw", F.lit(""))))
    dynamic = mode != "auto" or overrides is not None or backend == planner.LAYOUT_BACKEND
    for fix in sorted(planner.FIXES, key=lambda f: f.order):
        planned = F.array_contains("plan", fix.id)
        if fix.id == "split_glued":
            if not dynamic:
                continue
            p = with_split_glued(p, "__now", "__done", planned)
        elif fix.id == "reorder_columns_title":
            if not dynamic:
                continue
            p = with_reading_order(p, "__done", move_title=True)
        else:
            p = p.withColumn("__done", col("__reading") if fix.id == "reorder_columns" else fix.apply(col("__now"), {}))
        p = p.withColumn("__now", F.when(planned & (F.coalesce("__done", F.lit("")) != ""), col("__done")).otherwise(col("__now"))).drop("__done")
    text = F.when(has_in & (F.coalesce("__included", F.lit("")) != ""), col("__included")).otherwise(col("__now"))
    return p.withColumn("text", text).withColumn("label", F.when(has_in | has_out, "manual").otherwise("auto")).drop("__reading", "__included", "__now")
