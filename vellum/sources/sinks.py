"""Sinks: keyed Parquet stores, exported texts, captured images."""

from __future__ import annotations

import base64
import json
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.text import without_header


def write_store(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A keyed store, partitioned by a hash of the document so that one document's rows are pruned to one folder."""
    rows.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(64)).cast("int")).write.mode(mode).partitionBy("part").parquet(path)


def upserted(store: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The store with `rows` in place of those of the same keys."""
    return store.join(rows.select(*keys).distinct(), keys, "left_anti").unionByName(rows)


def export_text(pages: DataFrame, path: str, text: str = "text") -> None:
    """Page bodies without their display header, as text files."""
    pages.select(without_header(F.col(text)).alias("value")).write.mode("overwrite").text(path)


def image_names(images: DataFrame, taken: DataFrame) -> DataFrame:
    """Adds idx and name: numbers go on after the largest one taken for the page."""
    from pyspark.sql import Window

    top = taken.groupBy("doc_id", "page_num").agg(F.max("idx").alias("__top"))
    place = F.row_number().over(Window.partitionBy("doc_id", "page_num").orderBy("seq"))
    out = images.withColumn("__place", place).join(top, ["doc_id", "page_num"], "left").withColumn("idx", F.coalesce(F.col("__top"), F.lit(-1)) + F.col("__place"))
    return out.withColumn("name", F.format_string("page_%04d_region_%d.%s", "page_num", "idx", "ext")).drop("__top", "__place")


def to_json_cache(rows: DataFrame) -> DataFrame:
    """doc_id, fingerprint and the JSON text of an extraction cache (current version) per document."""
    def run(group: pd.DataFrame) -> pd.DataFrame:
        pages: dict[str, dict] = {}
        for r in group.itertuples(index=False):
            pages.setdefault(str(r.page_num), {})[r.ocr_lang] = {"raw": r.raw, "final": None if r.text is None else [r.text, r.label, r.elapsed]}
        return pd.DataFrame([{"doc_id": group.doc_id.iloc[0], "fingerprint": group.fingerprint.iloc[0], "json": json.dumps({"fingerprint": group.fingerprint.iloc[0], "pages": pages}, ensure_ascii=False)}])

    return rows.groupBy("doc_id", "fingerprint").applyInPandas(run, "doc_id long, fingerprint string, json string")


def to_json_translations(rows: DataFrame) -> DataFrame:
    """doc_id, fingerprint and the JSON text of a translation cache: pages, and in them engine:target to text."""
    entry = F.struct(F.concat_ws(":", "engine", "target").alias("key"), F.col("text").alias("value"))
    pages = rows.groupBy("doc_id", "fingerprint", "page_num").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("by"))
    whole = pages.groupBy("doc_id", "fingerprint").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("page_num").cast("string").alias("key"), F.to_json("by").alias("value"))))).alias("ps"))
    body = F.array_join(F.transform(F.map_entries("ps"), lambda e: F.concat(F.lit('"'), e["key"], F.lit('":'), e["value"])), ",")
    return whole.select("doc_id", "fingerprint", F.concat(F.lit('{"fingerprint":'), _quoted(F.col("fingerprint")), F.lit(',"pages":{'), body, F.lit("}}")).alias("json"))


def to_json_edits(edits: DataFrame) -> DataFrame:
    """doc_id, win and the JSON text of an edits file: keys of the texts to what was made of them."""
    entry = F.struct(F.col("key"), F.col("edited").alias("value"))
    return edits.groupBy("doc_id", "win").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(entry)))).alias("json"))


def _quoted(t: Column) -> Column:
    return F.regexp_replace(F.to_json(F.struct(t.alias("x"))), r'(?s)^\{"x":(.*)\}$', "$1")


def save_images(images: DataFrame, folder: str) -> DataFrame:
    """Write the bytes of `images` (name, data) below a folder URI, once; path and size of each.

    A file is written under a name of its attempt and then moved, so that a task that runs again, or another attempt
    beside it, never leaves half an image under a final name. The manifest is written too, and what is returned
    reads it: later actions write nothing.
    """
    top = folder.rstrip("/")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow.fs import FileSystem

        files, at = FileSystem.from_uri(top)
        files.create_dir(at, recursive=True)
        own = TaskContext.get().taskAttemptId()
        for b in batches:
            for name, data in zip(b["name"], b["data"], strict=True):
                with files.open_output_stream(f"{at}/.{name}.{own}") as out:
                    out.write(data)
                files.move(f"{at}/.{name}.{own}", f"{at}/{name}")
            yield pd.DataFrame({"path": [f"{top}/{n}" for n in b["name"]], "bytes": [len(d) for d in b["data"]]})

    manifest = f"{top}/_manifest-{uuid.uuid4().hex}"
    images.select("name", "data").mapInPandas(run, "path string, bytes long").write.parquet(manifest)
    return images.sparkSession.read.parquet(manifest)


def to_html(text: Column, render: Callable[[str], str]) -> Column:
    """Markdown as HTML by a renderer that is given; null stays null."""
    return F.pandas_udf(lambda ts: ts.map(render, na_action="ignore"), StringType())(text)


def data_uri(data: bytes, ext: str) -> str:
    return f"data:image/{ext};base64,{base64.b64encode(data).decode()}"
