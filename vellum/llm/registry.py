"""The queries of this subpackage and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import op1_pii, op2_near_dedup, op3_line_dedup, op4_quality, op5_packing, op6_decontamination, op7_secrets, op8_topk_search, op9_warc, op10_token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii.query,
    "op2_near_dedup": op2_near_dedup.query,
    "op3_line_dedup": op3_line_dedup.query,
    "op4_quality": op4_quality.query,
    "op5_packing": op5_packing.query,
    "op6_decontamination": op6_decontamination.query,
    "op7_secrets": op7_secrets.query,
    "op8_topk_search": op8_topk_search.query,
    "op9_warc": op9_warc.query,
    "op10_token_counts": op10_token_counts.query,
}

ORACLE_SQL: dict[str, str] = {
    "op3_line_dedup": op3_line_dedup.ORACLE_SQL,
    "op8_topk_search": op8_topk_search.ORACLE_SQL,
    "op9_warc": op9_warc.ORACLE_SQL,
}
