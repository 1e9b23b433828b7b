"""Every registered layout query against its SQL, value by value."""

from __future__ import annotations

import hashlib
import re

import duckdb
import pandas as pd
import pytest

from vellum.oracles import ORACLES
from vellum.queries import QUERIES


def canonical(df: pd.DataFrame) -> list[tuple]:
    names = sorted(df.columns)
    show = lambda v: "" if not isinstance(v, (list, tuple)) and pd.isna(v) else repr(round(float(v), 9)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(show(v) for v in row) for row in df[names].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    if name not in ORACLES:
        assert len(got)
        return
    con = duckdb.connect()
    for t in ("documents", "events"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    want = con.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_translate_chunks_cut_long_prose(spark, sf_dir):
    """Against a plain version; the table holds paragraphs over 1500 characters."""

    def plain(para: str) -> str:
        if not re.search(r"[^\W\d_]", para):
            return para
        chunks, held = [], []
        for s in re.split(r"(?<=[.!?])\s+", para) if len(para) > 1500 else [para]:
            if held and sum(map(len, held)) + len(s) > 1500:
                chunks.append(" ".join(held))
                held = []
            held.append(s)
        return " ".join(f"[{c}]" for c in [*chunks, " ".join(held)])

    docs = [r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect() if r.text is not None]
    assert any(len(p) > 1500 for r in docs for p in r.text.split("\n"))
    want = {(r.doc_id, hashlib.sha1("\n\n".join(map(plain, r.text.split("\n"))).encode()).hexdigest()) for r in docs}
    assert {tuple(r) for r in QUERIES["translate_chunks"](spark, sf_dir).collect()} == want


@pytest.mark.parametrize("name", ["column_assign", "column_intervals", "column_splits", "column_widest", "page_profile", "reading_order"])
def test_equal_boxes(spark, tmp_path, name):
    """Blocks of one page with equal x0 and x1: two windows of the SQL leave their order open. Decided alike in both, by
    block_id either way, the SQL gives the query's rows; decided differently it gives others."""
    lines = lambda i: "\n".join("x" * (20 + (i + j * j) % 5) for j in range(150))
    pd.DataFrame({"doc_id": range(24), "text": [lines(i) for i in range(24)]}).to_parquet(tmp_path / "documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet'")
    first, second = "preceding and 1 preceding", "preceding and current row"

    def rows(a: str, b: str) -> list[tuple]:
        sql = re.sub(r"select page_id, x0, x1, max\(x1\)", "select page_id, block_id, x0, x1, max(x1)", ORACLES[name])
        for end, way in ((first, a), (second, b)):
            sql, n = re.subn(rf"order by x0, x1 (rows between unbounded {end})", rf"order by x0, x1, block_id {way} \1", sql)
            assert n == 1
        return canonical(con.execute(sql).df())

    got = canonical(QUERIES[name](spark, str(tmp_path)).toPandas())
    assert got == rows("asc", "asc") == rows("desc", "desc")
    assert got != rows("asc", "desc")


@pytest.mark.parametrize("name", ["fix_plan_override", "glued_split", "page_texts", "title_reading"])
def test_equal_boxes_in_longer_queries(spark, tmp_path, name):
    """The same for queries that use the columns of a page: plans, the glued-paragraph cut, whole pages."""
    lines = lambda i: "\n".join(f"w{j % 7} {'x' * 30}"[: 20 + (i + j * j) % 5] for j in range(150))
    pd.DataFrame({"doc_id": range(24), "text": [lines(i) for i in range(24)]}).to_parquet(tmp_path / "documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet'")
    first, second = "preceding and 1 preceding", "preceding and current row"

    def rows(a: str, b: str) -> list[tuple]:
        sql, n = re.subn(r"select page_id, x0, x1, max\(x1\)", "select page_id, block_id, x0, x1, max(x1)", ORACLES[name])
        for end, way in ((first, a), (second, b)):
            sql, k = re.subn(rf"order by x0, x1 (rows between unbounded {end})", rf"order by x0, x1, block_id {way} \1", sql)
            assert k == n > 0
        return canonical(con.execute(sql).df())

    got = canonical(QUERIES[name](spark, str(tmp_path)).toPandas())
    assert got == rows("asc", "asc") == rows("desc", "desc")
    assert got != rows("asc", "desc")
