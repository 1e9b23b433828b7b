"""Line dedup: range-partitioned hashes, secondary sort by document and position, keep bitmaps.

1. Each batch of documents hashes its line keys (128 bits). A key met in several documents of a batch is
   already lost to all but the smallest of them, so that a batch sends at most one document per key: a
   line that a third of all rows hold is no hot key.
2. The hash space is cut into equal ranges (hashes are uniform: no sampling pass), rows are sorted by
   hash, document and position, and the first document of each key is streamed past the others.
3. What comes back is one zlib-compressed bitmap per document, not text; it is joined to the documents.

Defined cases: a null or empty text is one empty line, which stays; keys under `least` code points always
stay; rows without doc_id count for nothing and keep all their lines; rows of one doc_id are one document;
a key repeated inside its smallest document stays there each time; an empty table gives no rows; other columns
are carried untouched.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import arrow_map, table

LEAST = 10
STRIP = b" \t\n\x0b\x0c\r"
HASHED = "slot int, hi long, lo long, doc_id long, text_key long, places binary, decided boolean"
DROPS = "doc_id long, text_key long, dropped binary"


def key_of(line: bytes, least: int) -> bytes | None:
    key = line.strip(STRIP)
    if len(key) < least or len(key) < 4 * least and not key.isascii() and len(key.decode("utf-8", "replace")) < least:
        return None
    return key.lower()


def squeezed(places: list[int]) -> bytes:
    bits = np.zeros(max(places) + 1, bool)
    bits[places] = True
    return zlib.compress(np.packbits(bits, bitorder="little").tobytes(), 1)


def opened(bitmaps: list[bytes]) -> np.ndarray:
    """The union of compressed bitmaps."""
    each = [np.unpackbits(np.frombuffer(zlib.decompress(b), np.uint8), bitorder="little").astype(bool) for b in bitmaps]
    out = np.zeros(max((len(e) for e in each), default=0), bool)
    for e in each:
        out[: len(e)] |= e
    return out


def _hashed(docs: DataFrame, least: int, parts: int) -> DataFrame:
    def rows(ids: list, text_keys: list, texts: list) -> dict[str, list]:
        first: dict[tuple[int, int], int] = {}
        lines: list[dict[tuple[int, int], list[int]]] = []
        for i, text in zip(ids, texts, strict=True):
            own = defaultdict(list)
            if i is not None and text:
                for at, line in enumerate(text.encode().split(b"\n")):
                    if (key := key_of(line, least)) is not None:
                        own[xxhash.xxh3_128_intdigest(key)].append(at)
                for h in own:
                    if i < first.get(h, i + 1):
                        first[h] = i
            lines.append(own)
        out: dict[str, list] = {k.split()[0]: [] for k in HASHED.split(", ")}

        def put(*row: object) -> None:
            for k, v in zip(out, row, strict=True):
                out[k].append(v)

        for i, text_key, own in zip(ids, text_keys, lines, strict=True):
            lost: list[int] = []
            for h, places in own.items():
                if first[h] < i:
                    lost += places
                else:
                    hi, lo = h >> 64, h & (1 << 64) - 1
                    put(hi * parts >> 64, hi - (1 << 63), lo - (1 << 63), i, text_key, np.array(places, "<i4").tobytes(), False)
            if lost:
                put(i % parts, 0, 0, i, text_key, np.array(lost, "<i4").tobytes(), True)
        return out

    return arrow_map(docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text"), rows, HASHED)


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted; the first document of a key keeps its lines, later ones lose theirs."""
    key, keeper = None, None
    for batch in batches:
        _, hi, lo, doc, text_key, places, decided = (c.to_pylist() for c in batch.columns)
        lost: dict[tuple[int, int], list[int]] = defaultdict(list)
        for k, l, i, t, p, d in zip(hi, lo, doc, text_key, places, decided, strict=True):
            if not d:
                if key != (k, l):
                    key, keeper = (k, l), i
                if i == keeper:
                    continue
            lost[i, t] += np.frombuffer(p, "<i4").tolist()
        if lost:
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in lost], pa.int64()), pa.array([t for _, t in lost], pa.int64()), pa.array([squeezed(p) for p in lost.values()], pa.binary())], names=["doc_id", "text_key", "dropped"])


def drop_bitmaps(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, text_key (of the row's text) and the bitmaps of dropped lines, for documents that lose any."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hashed = _hashed(docs, least, parts)
    ranged = hashed.repartitionById(parts, F.col("slot")).sortWithinPartitions("decided", "hi", "lo", "doc_id", "places")
    return ranged.mapInArrow(_streamed, DROPS).groupBy("doc_id", "text_key").agg(F.collect_list("dropped").alias("dropped"))


def keep_bitmaps(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, text_key, keep: one compressed bitmap a document; lines beyond its end stay."""

    def rows(ids: list, text_keys: list, dropped: list) -> dict[str, list]:
        return {"doc_id": ids, "text_key": text_keys, "keep": [zlib.compress(np.packbits(~opened(d), bitorder="little").tobytes(), 1) for d in dropped]}

    return arrow_map(drop_bitmaps(docs, least), rows, "doc_id long, text_key long, keep binary")


def _joined(docs: DataFrame, least: int) -> DataFrame:
    """Every row of `docs` as a struct `row`, with its bitmaps (null: nothing is dropped)."""
    names = [f"`{c.replace('`', '``')}`" for c in docs.columns]
    rows = docs.select(F.struct(*names).alias("row"), F.col("doc_id").alias("own_id"), F.xxhash64("text").alias("own_key"))
    lost = drop_bitmaps(docs, least)
    return rows.join(lost, (rows.own_id == lost.doc_id) & (rows.own_key == lost.text_key), "left").select("row", "dropped")


def _kept(text: str | None, dropped: list[bytes] | None) -> tuple[list[bytes], int]:
    lines = (text or "").encode().split(b"\n")
    if not dropped:
        return lines, len(lines)
    lost = opened(dropped)
    return [x for at, x in enumerate(lines) if at >= len(lost) or not lost[at]], len(lines)


def dedup_report(docs: DataFrame, least: int = LEAST) -> DataFrame:
    def rows(ids: list, texts: list, dropped: list) -> dict[str, list]:
        got = [_kept(t, d) for t, d in zip(texts, dropped, strict=True)]
        return {"doc_id": ids, "n_lines": [n for _, n in got], "n_dropped": [n - len(k) for k, n in got], "kept_sha256": [hashlib.sha256(b"\n".join(k)).hexdigest() for k, _ in got]}

    return arrow_map(_joined(docs, least).select("row.doc_id", "row.text", "dropped"), rows, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def dedup_lines(docs: DataFrame, least: int = LEAST, keep_emptied: bool = True) -> DataFrame:
    """`docs` with its lines dropped: the same columns and rows. A text that keeps no line becomes empty, a null stays null.

    Without `keep_emptied`, rows that lost lines and hold only white space now are left out: other documents hold
    all that they said. Texts that were blank before stay.
    """

    def cut(texts: pd.Series, dropped: pd.Series) -> pd.Series:
        return texts.combine(dropped, lambda t, d: t if t is None or d is None else b"\n".join(_kept(t, list(d))[0]).decode())

    joined = _joined(docs, least)
    once = F.pandas_udf(cut, StringType()).asNondeterministic()  # else a filter on the result would cut twice
    text = F.when(F.col("dropped").isNull(), F.col("row.text")).otherwise(once("row.text", "dropped"))
    marked = joined.select("row", text.alias("text"), F.col("dropped").isNotNull().alias("cut"))
    if not keep_emptied:
        marked = marked.where(~F.col("cut") | F.col("text").rlike("[^\\x20\\x09-\\x0D]"))
    quoted = {c: f"`{c.replace('`', '``')}`" for c in docs.columns}
    return marked.select(*((F.col("text") if c == "text" else F.col(f"row.{q}")).alias(c) for c, q in quoted.items()))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_report(table(spark, sf_dir, "documents"))


ORACLE_SQL = """
with lines as (
  select doc_id, pos, line, translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from documents) q),
keys as (
  select key, min(doc_id) as first_id from lines
  where length(key) >= 10 group by key having count(distinct doc_id) >= 2),
marked as (
  select l.doc_id, l.pos, l.line, coalesce(l.doc_id > k.first_id, false) as gone
  from lines l left join keys k on l.key = k.key)
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from marked group by doc_id
"""
