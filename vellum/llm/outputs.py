"""Real outputs of operators whose queries return digests: redacted texts and token sequences."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import op1_pii, op5_packing, op7_secrets
from .common import arrow_map

#: (start, end, name) of what is to go.
Scan = Callable[[str], list[tuple[int, int, str]]]


def redacted(docs: DataFrame, scan: Callable[[], Scan]) -> DataFrame:
    """`docs` with every found span replaced by its name in brackets; overlapping spans go as one, under the
    name of the first. Null texts stay null; other columns and rows are untouched. `scan` is made per batch."""

    def cut(texts: pd.Series) -> pd.Series:
        find = scan()

        def one(t: str | None) -> str | None:
            if not t:
                return t
            out, at = [], 0
            end = -1
            for a, b, name in sorted(find(t)):
                if a >= end:
                    out += [t[at:a], f"[{name}]"]
                end = at = max(end, b)
            return "".join([*out, t[at:]])

        return texts.map(one, na_action="ignore")

    return docs.withColumn("text", F.pandas_udf(cut, StringType())("text"))


def pii_scan(model: op1_pii.Model | None = None) -> Callable[[], Scan]:
    own = model or op1_pii.train()

    def make() -> Scan:
        def find(t: str) -> list[tuple[int, int, str]]:
            base = op1_pii.base_spans(t)
            return [(a, b, op1_pii.KINDS[k]) for k, a, b in [*base, *op1_pii.added_spans(t, base, own)]]

        return find

    return make


def secret_scan(vocab: str) -> Callable[[], Scan]:
    def make() -> Scan:
        words = op7_secrets.word_costs(vocab)

        def find(t: str) -> list[tuple[int, int, str]]:
            base, more = op7_secrets.spans_of(t, words)
            return [(a, b, op7_secrets.KINDS[k]) for a, k, b in [*base, *more]]

        return find

    return make


def sequences(docs: DataFrame, vocab: str, depth: int = op5_packing.DEPTH, end_id: int = op5_packing.END_ID) -> DataFrame:
    """sequence_id, ids (at most `depth`), doc_ids: the packed sequences themselves."""
    placed = op5_packing.pack(docs, vocab, depth, end_id)
    end = np.array([end_id], "<u4").tobytes()

    def rows(words: op5_packing.Words, own: list, texts: list) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in ("doc_id", "start", "ids_crc32", "ids")}
        for i, t in zip(own, texts, strict=True):
            raw = words.encode([(t or "").encode()])[0] + end
            for at in range(0, len(raw) // 4, depth):
                part = raw[at * 4 : (at + depth) * 4]
                for k, v in zip(out, (i, at, zlib.crc32(part), np.frombuffer(part, "<u4").astype(np.int32)), strict=True):
                    out[k].append(v)
        return out

    encoded = arrow_map(docs.select("doc_id", "text"), rows, "doc_id long, start long, ids_crc32 long, ids array<int>", lambda: (op5_packing.loaded(vocab),))
    texts = encoded.dropDuplicates(["doc_id", "start", "ids_crc32"])
    same = placed.alias("p").join(texts.alias("t"), F.col("p.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("p.start") == F.col("t.start")) & (F.col("p.ids_crc32") == F.col("t.ids_crc32")))
    parts = same.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids", F.col("p.doc_id").alias("doc_id")))).alias("ps"))
    return parts.select("sequence_id", F.flatten(F.transform("ps", lambda p: p["ids"])).alias("ids"), F.transform("ps", lambda p: p["doc_id"]).alias("doc_ids"))
