"""A training-data pipeline over `documents`: quality, lines, near copies, benchmark passages, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
`docs`. `run` writes each stage's result to the shared folder and reads it back for the next, so that a
lost executor costs at most the stage that runs; a stage's folder is deleted when the next one is written.

Defined cases, in every stage: null and empty texts, rows without doc_id and repeated rows are handled as the
operator's docstring says, an empty table gives an empty table, and other columns are carried untouched. The order
is given: lines are cut before near copies are sought, so that an exact copy has lost its lines by then. What
lines emptied goes in that stage (see there); near copies are sought on what the texts still hold.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vellum.llm import op2_near_dedup, op3_line_dedup, op4_quality, op5_packing, op6_decontamination
from vellum.llm.common import removed, shared_dir, table
from vellum.runtime import ship

VOCABULARY = "word_bpe_49k.json"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble accepts; null and empty texts are scored like any other."""
    ship(spark)
    return op4_quality.keep_good(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that another document has first are cut out of the texts. Documents that lost lines and hold only white
    space now are copies line by line, and go; texts that were null or blank before stay as they are."""
    ship(spark)
    return op3_line_dedup.dedup_lines(docs, keep_emptied=False)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies; texts without words and rows without doc_id stay."""
    ship(spark)
    return op2_near_dedup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item; null texts and rows without doc_id stay."""
    ship(spark)
    return op6_decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every row with their sequence and offset; a null or empty text is the end id alone."""
    import public_tokenizers

    ship(spark)
    return op5_packing.pack(docs, public_tokenizers.path(VOCABULARY))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("lines", lines),
    ("near_copies", near_copies),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Stages 1, 3 and 5 learn, hash or tokenize; SQL cannot express them.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    top = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    before = None
    for k, (name, stage) in enumerate(STAGES):
        at = f"{top}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
        if before:
            removed(spark, before)
        before = at
    return docs
