"""What the operators of this subpackage share: table access, Arrow mapping, the shared folder."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import ship

#: Rows handled together inside one Arrow batch; it bounds what a Python worker holds.
SLICE_ROWS = 1000
#: Spark's setting for the shuffle files of a query that has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: What a Python worker keeps between tasks of one operator, and the keys that the present task asked for.
_kept: dict[tuple, Any] = {}
_used: set[tuple] = set()


def kept(key: tuple, make: Callable[[], Any]) -> Any:
    """What `make` made for this worker; it goes when a task of another operator begins."""
    _used.add(key)
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def begun(once: Callable[[], tuple] | None) -> tuple:
    """What a task needs, made or kept; what other operators left in this worker is dropped."""
    _used.clear()
    own = once() if once else ()
    for key in [k for k in _kept if k not in _used]:
        del _kept[key]
    return own


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_map(df: DataFrame, rows: Callable[..., dict[str, list]], schema: str, once: Callable[[], tuple] | None = None) -> DataFrame:
    """Map slices of column lists to column lists in Python workers.

    `rows` gets what `once()` made for the task, then one list per column of `df`; it returns lists
    named as in `schema`. Nothing but one slice is held at a time.
    """
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = begun(once)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                got = rows(*own, *(c.to_pylist() for c in batch.slice(at, SLICE_ROWS).columns))
                yield pa.RecordBatch.from_arrays([pa.array(got[f.name], f.type) for f in out], schema=out)

    return df.mapInArrow(run, schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from `spark.checkpoint.dir`.

    Where it is not set, a local master (tests) gets a folder of its own; on a cluster that is an error, since
    executors do not see each other's disks.
    """
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="vellum-shared-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(at)
    return at


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate results, on whatever file system it lies."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def without(docs: DataFrame, gone: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of `docs` whose key is not in `gone` (a key column of that name); null keys stay."""
    own, other = docs.alias("__docs"), gone.select(F.col(key).alias("__key")).distinct().alias("__gone")
    return own.join(other, F.col(f"__docs.{key}") == F.col("__gone.__key"), "left_anti")


@contextmanager
def spent_shuffles(spark: SparkSession) -> Iterator[None]:
    """A query that is built and run inside deletes its shuffle files when it ends, instead of when the driver collects garbage."""
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder; the shuffle files that led to it are deleted."""
    shared_dir(df.sparkSession)
    with spent_shuffles(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


def salt(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")
