"""Raw and final results of pages as two tables, so that a drawn zone computes layout again but never decodes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import relations

RAW_KEYS = ["doc_id", "fingerprint", "page_num"]
FINAL_KEYS = [*RAW_KEYS, "zones_key"]


def to_decode(asked: DataFrame, raw: DataFrame) -> DataFrame:
    """The pages of `asked` (RAW_KEYS) that the raw table does not hold for this fingerprint."""
    return relations.missing(asked, raw, RAW_KEYS)


def to_finish(raw: DataFrame, zones: DataFrame, final: DataFrame) -> DataFrame:
    """Raw pages with their present zones and `zones_key`, where the final table has no result for them.

    `zones` holds doc_id, page_num, exclude and include of pages that were drawn on; others have none.
    """
    drawn = zones.select("doc_id", "page_num", F.col("exclude").alias("__out"), F.col("include").alias("__in"))
    none = F.expr("cast(array() as array<struct<x0:double,y0:double,x1:double,y1:double>>)")
    now = raw.join(drawn, ["doc_id", "page_num"], "left").withColumn("exclude", F.coalesce("__out", none)).withColumn("include", F.coalesce("__in", none)).drop("__out", "__in")
    return relations.missing(now.withColumn("zones_key", relations.zones_key(F.col("exclude"), F.col("include"))), final, FINAL_KEYS)


def finished(raw: DataFrame, zones: DataFrame, final: DataFrame, pipeline: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows to add to the final table: `pipeline` (it adds text and label) over the pages that lack a result."""
    return pipeline(to_finish(raw, zones, final)).select(*FINAL_KEYS, "text", "label")
