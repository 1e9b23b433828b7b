"""The pipeline's stages: columns, decisions and their effect."""

from __future__ import annotations

import pytest

import corpus_pipeline
from vellum.llm import op2_near_dedup, op6_decontamination


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        at = str(tmp_path / f"{k}-{name}")
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        sizes.append(docs.count())
        if name == "near_copies":
            assert op2_near_dedup.near_duplicates(docs).where("not kept").count() == 0
        if name == "decontamination":
            assert op6_decontamination.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).count() == 0
            kept = docs
        if name == "lines":
            assert docs.where("text rlike '^\\\\s+$'").count() == 0
    assert sizes[1] < sizes[0] and sizes[2] <= sizes[1] and sizes[4] < sizes[3]
    assert docs.select("doc_id").distinct().count() == kept.count()
    run = corpus_pipeline.run(spark, sf_dir)
    assert sorted(map(tuple, run.collect())) == sorted(map(tuple, docs.collect()))


EDGES = [
    (1, None), (2, ""), (3, "  \n "), (4, "one line that is long enough\nand another such line here"), (5, "one line that is long enough\nand another such line here"),
    (5, "one line that is long enough\nand another such line here"), (None, "no id at all in this row, but words enough to be kept"), (None, None), (6, "word " * 30_000), (7, "x" * 60_000),
]


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_stages_take_edge_rows_and_clashing_names(spark, sf_dir, stage):
    kind = "doc_id long, text string, lang string, source string, n_chars long, __row string, __gone string, __hit string, id string, dropped string, salt string, row string"
    docs = spark.createDataFrame([(*r, "en", "web", 1, *"abcdefg") for r in EDGES], kind)
    name, run = stage
    got = run(spark, docs, sf_dir)
    if name == "packing":
        assert {r.doc_id for r in got.select("doc_id").collect()} == {r[0] for r in EDGES}
        assert got.count() >= len(EDGES) and run(spark, docs.limit(0), sf_dir).count() == 0
        return
    rows = got.collect()
    assert got.columns == docs.columns and all(r.lang == "en" and r.row == "g" and r["__gone"] == "b" for r in rows)
    assert run(spark, docs.limit(0), sf_dir).count() == 0
    kept = sorted(str(r.doc_id) for r in rows)
    every = sorted(str(i) for i, _ in EDGES)
    if name == "lines":
        assert kept == sorted([*(set(every) - {"5", "None"}), "None", "None"])
    elif name == "near_copies":
        assert kept == sorted([*(set(every) - {"5", "None"}), "None", "None"])
    elif name == "decontamination":
        assert kept == every


@pytest.mark.parametrize("name", ["op1_", "op2_", "op3_", "op4_", "op5_", "op6_", "op7_", "op8_", "op9_", "op10_", "pipeline"])
def test_registered(name):
    import __spark_entry__

    assert any(q.startswith(name) for q in __spark_entry__.queries())
