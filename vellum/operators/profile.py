"""The page profile: nine features, computed from the page's arrays without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import FULL_WIDTH, LEAST_WIDTH, d, excluded, inside_any, width
from ..functions.text import INDEX_ENTRY, NUMBERED
from . import columns

#: Font floors and shares.
FLOOR, SMALL_TEXT, HALF = 6.5, 7.5, 0.5
FEATURES = ("columns", "splits", "columns_overlap", "has_tables", "full_width_tables", "has_small_text", "has_references", "has_index", "body_blocks")


def block_text(b: Column) -> Column:
    return F.array_join(F.transform(F.flatten(b["lines"]), lambda s: s["text"]), " ")


def data_tables(tables: Column, zones: Column) -> Column:
    """Tables that are more than a title, outside excluded zones."""
    return F.filter(tables, lambda t: ~((t["row_count"] <= 1) & (t["col_count"] <= 2)) & ~excluded(t, zones))


def visible_blocks(blocks: Column, zones: Column) -> Column:
    return F.filter(blocks, lambda b: ~excluded(b, zones))


def body_blocks(blocks: Column, tables: Column, page_width: Column) -> Column:
    return F.filter(blocks, lambda b: (b["max_size"] >= FLOOR) & ~inside_any(b, tables) & (width(b) >= LEAST_WIDTH) & (width(b) < d(FULL_WIDTH) * page_width))


def with_profile(pages: DataFrame) -> DataFrame:
    """The pages with a struct column `profile`."""
    staged = pages.withColumn("__tables", data_tables(F.col("tables"), F.col("exclude")))
    staged = staged.withColumn("__body", body_blocks(visible_blocks(F.col("blocks"), F.col("exclude")), F.col("__tables"), F.col("width")))
    staged = staged.withColumn("__splits", columns.splits(columns.without_margins(F.col("__body"), F.col("height")), F.col("width")))
    body, tables, borders, n = F.col("__body"), F.col("__tables"), F.col("__splits"), F.size("__splits") + 1
    count = lambda test: F.size(F.filter(body, test))
    small = F.exists(body, lambda b: b["max_size"] < SMALL_TEXT)
    numbered, entries = count(lambda b: block_text(b).rlike(NUMBERED)), count(lambda b: block_text(b).rlike(INDEX_ENTRY))
    profile = F.struct(
        n.alias("columns"), borders.alias("splits"), columns.columns_overlap(body, borders).alias("columns_overlap"), (F.size(tables) > 0).alias("has_tables"),
        F.size(F.filter(tables, lambda t: width(t) >= d(FULL_WIDTH) * F.col("width"))).alias("full_width_tables"), small.alias("has_small_text"),
        ((n >= 2) & small & (F.size(body) > 0) & (numbered >= HALF * F.size(body))).alias("has_references"),
        ((n >= 3) & (F.size(body) > 0) & (entries >= HALF * F.size(body))).alias("has_index"), F.size(body).alias("body_blocks"),
    )
    return staged.withColumn("profile", profile).drop("__tables", "__body", "__splits")
