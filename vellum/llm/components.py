"""Connected components by alternating large-star and small-star over DataFrames of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, spent_shuffles


def large_star(edges: DataFrame) -> DataFrame:
    """Connect each node's larger neighbours to the least of its neighbourhood. Edges are (u, v), u > v."""
    both = edges.select("u", "v").union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Connect each node and its smaller neighbours to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least reachable node) of every node that is not the least of its component.

    Only minima are aggregated, so no task gathers a neighbourhood. Each round is written to the shared
    folder; it ends when a round changes nothing, after a number of rounds logarithmic in the nodes.
    """
    now = checkpointed(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct())
    seen = None
    while True:
        with spent_shuffles(now.sparkSession):
            got = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(got) == seen or not got[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen = tuple(got)
        now = checkpointed(small_star(large_star(now)))
