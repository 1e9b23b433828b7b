"""File arrival as a stream: new layouts go through the page pipeline, results keep the latest generation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import relations
from ..operators.reading import page_text
from ..sources.layout import PAGE_DDL, complete


def arrivals(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of page relations from Parquet files that arrive in a folder."""
    return spark.readStream.schema(PAGE_DDL).parquet(folder)


def run_pages(stream: DataFrame, out: str, checkpoint: str, pipeline: Callable[[DataFrame], DataFrame] = page_text) -> StreamingQuery:
    """Every batch is computed by the same pipeline as a table; the batch number is the rows' generation.

    A batch that is run again overwrites its own folder, so that results are written once.
    """
    def each(batch: DataFrame, number: int) -> None:
        done = pipeline(complete(batch)).select("doc_id", "page_num", "text", "label", F.lit(number).cast("long").alias("generation"))
        done.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, out: str) -> DataFrame:
    """The latest text of every page over all batches."""
    rows = spark.read.option("recursiveFileLookup", "true").parquet(out)
    return relations.latest(rows, ["doc_id", "page_num"], ["generation"])


def debounced_stream(events: DataFrame, key: str, at: str, gap: str, late: str) -> DataFrame:
    """The last event time and the count of every burst of a key, by session windows with a watermark."""
    return events.withWatermark(at, late).groupBy(F.session_window(F.col(at), gap), F.col(key)).agg(F.max(at).alias("last_at"), F.count("*").alias("n")).select(key, "last_at", "n")
