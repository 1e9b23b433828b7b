"""Decoders, side files, sinks and the file-arrival stream."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from vellum.operators import relations
from vellum.sources import caches, decoder, sinks
from vellum.sources.layout import project
from vellum.streaming import arrival


def test_decoder_keeps_going_after_a_damaged_file(spark, tmp_path):
    block = {"block_id": 0, "x0": 1, "y0": 1, "x1": 9, "y1": 9, "max_size": 9, "lines": [[{"text": "Hi", "size": 9, "bold": False, "italic": False}]]}
    (tmp_path / "a.json").write_text(json.dumps({"pages": [{"page_num": 0, "width": 10, "height": 10, "blocks": [block]}, {"page_num": 1}]}))
    (tmp_path / "b.json").write_text("{")
    rows = decoder.decoded(decoder.documents(spark, str(tmp_path)), decoder.json_decoder).select("path", "page_num", "error", F.size("blocks").alias("n")).collect()
    assert sorted((r.path[-6:], r.page_num, r.n, r.error is None) for r in rows if r.error is None) == [("a.json", 0, 1, True), ("a.json", 1, 0, True)]
    assert [r.path[-6:] for r in rows if r.error] == ["b.json"]
    assert decoder.decoded(decoder.documents(spark, str(tmp_path / "a.json")), decoder.json_decoder, {1}).count() == 1


def test_cache_migrations(spark, tmp_path):
    pages = {"0": "ciao", "1": {"cleaned": "c", "origin": "o"}, "2": {"de": "hallo", "auto": "x"}, "3": {"microsoft:fr": "salut", "odd:fr": "x"}, "x": "no"}
    (tmp_path / "t.json").write_text(json.dumps({"fingerprint": "f", "pages": pages}))
    (tmp_path / "bad.json").write_text("nope")
    got = {(r.page_num, r.engine, r.target): r.text for r in caches.translations(spark, str(tmp_path)).collect()}
    assert got == {(0, "google", "it"): "ciao", (1, "google", "it"): "c", (2, "google", "de"): "hallo", (3, "microsoft", "fr"): "salut"}
    assert caches.translations(spark, str(tmp_path), F.lit("g")).count() == 0
    (tmp_path / "t.json").write_text(json.dumps({"fingerprint": "f", "pages": {"0": {"eng": "raw text"}, "1": {"eng": {"raw": "r", "final": ["t", "auto", 1.5]}}, "2": "no"}}))
    got = {(r.page_num, r.raw, r.text, r.label, r.elapsed) for r in caches.extractions(spark, str(tmp_path / "t.json")).collect()}
    assert got == {(0, "raw text", None, None, None), (1, "r", "t", "auto", 1.5)}


def test_incremental_tables(spark):
    asked = spark.createDataFrame([(1, "f", 0, "()"), (1, "f", 1, "()"), (2, "g", 0, "()")], "doc_id long, fingerprint string, page_num int, zones_key string")
    cache = spark.createDataFrame([(1, "f", 0, "()", "a"), (2, "old", 0, "()", "b")], "doc_id long, fingerprint string, page_num int, zones_key string, text string")
    keys = ["doc_id", "fingerprint", "page_num", "zones_key"]
    assert sorted((r.doc_id, r.page_num) for r in relations.missing(asked, cache, keys).collect()) == [(1, 1), (2, 0)]
    stale = spark.createDataFrame([(1, 0)], "doc_id long, page_num int")
    assert [r.doc_id for r in relations.invalidated(cache, stale, ["doc_id", "page_num"]).collect()] == [2]
    new = spark.createDataFrame([(1, "f", 0, "()", "z")], cache.schema)
    assert sorted(r.text for r in sinks.upserted(cache, new, keys).collect()) == ["b", "z"]


def test_image_names_and_export(spark, tmp_path):
    images = spark.createDataFrame([(1, 3, 0, "png", b"x"), (1, 3, 1, "png", b"yy")], "doc_id long, page_num int, seq int, ext string, data binary")
    taken = spark.createDataFrame([(1, 3, 4)], "doc_id long, page_num int, idx int")
    named = sinks.image_names(images, taken)
    assert sorted(r.name for r in named.collect()) == ["page_0003_region_5.png", "page_0003_region_6.png"]
    assert sorted(r.bytes for r in sinks.save_images(named, f"file://{tmp_path}/img").collect()) == [1, 2]
    assert (tmp_path / "img" / "page_0003_region_6.png").read_bytes() == b"yy"
    sinks.write_store(taken, str(tmp_path / "store"))
    assert spark.read.parquet(str(tmp_path / "store")).count() == 1


def test_file_arrival(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 6")
    source, out, at = (str(tmp_path / k) for k in ("in", "out", "at"))
    project(docs).write.parquet(source)
    arrival.run_pages(arrival.arrivals(spark, source), out, at).awaitTermination()
    first = arrival.current(spark, out)
    assert first.count() == 6 and first.agg(F.max("generation")).first()[0] == 0
    project(docs.where("doc_id < 2").withColumn("text", F.lit("new"))).write.mode("append").parquet(source)
    arrival.run_pages(arrival.arrivals(spark, source), out, at).awaitTermination()
    got = {r.doc_id: (r.generation, r.text) for r in arrival.current(spark, out).collect()}
    assert len(got) == 6 and got[1] == (1, "new") and got[5][0] == 0
