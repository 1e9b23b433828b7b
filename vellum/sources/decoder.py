"""Decoders: document bytes to the page relation. PDF decoding itself is pluggable; no library is assumed."""

from __future__ import annotations

import base64
import itertools
import json
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .layout import PAGE, PAGE_DDL, cleaned_blocks

#: bytes and wanted page numbers (None: all) to dicts shaped like the page relation, without doc_id.
Decoder = Callable[[bytes, "set[int] | None"], Iterable[dict[str, Any]]]
EXTRA = "path string, fingerprint string, error string"
PAGES_HELD = 16
#: (document bytes, page, OCR language) to the page's markdown; it raises for a language it lacks.
Extract = Callable[[bytes, int, str], str]
#: Document bytes to outline entries (level, title, page from 1).
Outline = Callable[[bytes], Iterable[tuple[Any, Any, Any]]]
#: The language tried last, and what stands for a blank title.
OCR_LAST, NO_TITLE = "eng", "(untitled)"


def json_decoder(raw: bytes, wanted: set[int] | None) -> Iterator[dict[str, Any]]:
    """Layouts stored as JSON: an object with `pages`, or a list of pages."""
    whole = json.loads(raw)
    for p in whole["pages"] if isinstance(whole, dict) else whole:
        if wanted is None or p.get("page_num", 0) in wanted:
            yield p


def documents(spark: SparkSession, glob: str) -> DataFrame:
    """path, doc_id, stem, fingerprint and content of files; the id comes from the whole path, not its name."""
    files = spark.read.format("binaryFile").load(glob)
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    fingerprint = F.concat_ws("-", F.col("length").cast("string"), F.unix_micros("modificationTime").cast("string"))
    return files.select("path", F.xxhash64("path").alias("doc_id"), stem.alias("stem"), fingerprint.alias("fingerprint"), "content")


def decoded(docs: DataFrame, decoder: Decoder, wanted: set[int] | None = None) -> DataFrame:
    """The page relation of `docs` with path, fingerprint and error.

    Pages go on as they are decoded, `PAGES_HELD` at a time; where a document fails, the pages before stay and one
    row holds its error. Images' data may be bytes (or their base64 form).
    """
    names = list(PAGE)

    def shown(x: Any) -> Any:
        return base64.b64encode(x).decode() if isinstance(x, (bytes, bytearray)) else str(x)

    def rows_of(row: Any) -> Iterator[dict[str, Any]]:
        base = {"path": row.path, "fingerprint": row.fingerprint, "error": None}
        try:
            for p in decoder(row.content, wanted):
                yield {**base, **{k: p.get(k) for k in names}, "doc_id": row.doc_id}
        except Exception as e:  # noqa: BLE001  one damaged file must not end the job
            yield {**base, **dict.fromkeys(names), "doc_id": row.doc_id, "error": f"{type(e).__name__}: {e}"}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                rows = (json.dumps(r, default=shown) for r in rows_of(row))
                while some := list(itertools.islice(rows, PAGES_HELD)):
                    yield pd.DataFrame({"row": some})

    schema = f"{PAGE_DDL}, {EXTRA}"
    rows = docs.select("doc_id", "path", "fingerprint", "content").mapInPandas(run, "row string").select(F.from_json("row", schema).alias("r")).select("r.*")
    empty = {k: F.array().cast(v) for k, v in PAGE.items() if v.startswith("array")}
    whole = rows.select(*(F.coalesce(k, empty[k]).alias(k) if k in empty else F.col(k) for k in [*names, "path", "fingerprint", "error"]))
    return whole.withColumn("blocks", cleaned_blocks(F.col("blocks")))


def page_markdown(docs: DataFrame, extract: Extract, pages: DataFrame, ocr_language: str | None = None) -> DataFrame:
    """doc_id, page_num, raw, ocr_lang, error of the pages asked for (doc_id, page_num).

    The wanted language is tried first, then `OCR_LAST`. A page without text has an empty raw; a page for which
    every language failed has a null raw and the last error.
    """
    tried = list(dict.fromkeys([ocr_language or OCR_LAST, OCR_LAST]))

    def one(content: bytes, page: int) -> tuple[str | None, str | None, str | None]:
        error = None
        for lang in tried:
            try:
                return extract(content, page, lang).strip(), lang, None
            except Exception as e:  # noqa: BLE001  the next language may do
                error = f"{type(e).__name__}: {e}"
        return None, None, error

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [one(bytes(c), int(p)) for c, p in zip(b["content"], b["page_num"], strict=True)]
            yield pd.DataFrame({"doc_id": b["doc_id"], "page_num": b["page_num"], **{k: pd.Series([g[i] for g in got], dtype=object) for i, k in enumerate(("raw", "ocr_lang", "error"))}})

    wanted = pages.select("doc_id", "page_num").distinct().join(docs.select("doc_id", "content"), "doc_id")
    return wanted.select("doc_id", "page_num", "content").mapInPandas(run, "doc_id long, page_num int, raw string, ocr_lang string, error string")


def outlines(docs: DataFrame, outline: Outline, no_title: str = NO_TITLE) -> DataFrame:
    """doc_id, seq, level, title, page_idx (from 0) of the documents' outlines, as `operators.relations` takes them.

    A document whose outline can not be read has none; entries that point before the first page go; levels under
    0 count as 0; blank titles get a placeholder.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for doc_id, content in zip(b["doc_id"], b["content"], strict=True):
                try:
                    entries = [(int(level), str(title or "").strip(), int(page)) for level, title, page in outline(bytes(content))]
                except Exception:  # noqa: BLE001  no outline
                    entries = []
                kept = [(max(0, level), title or no_title, page - 1) for level, title, page in entries if page >= 1]
                if kept:
                    yield pd.DataFrame([(doc_id, k, *e) for k, e in enumerate(kept)], columns=["doc_id", "seq", "level", "title", "page_idx"])

    return docs.select("doc_id", "content").mapInPandas(run, "doc_id long, seq long, level int, title string, page_idx long")
