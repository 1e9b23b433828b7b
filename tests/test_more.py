"""Images, options, services, outlines, incremental tables, sinks: the rules that no supplied table exercises."""

from __future__ import annotations

import json
import urllib.parse

import pytest
from pyspark.sql import functions as F

from vellum.functions import geometry as g
from vellum.functions import text as tx
from vellum.operators import images, incremental, reading, relations
from vellum.sources import decoder, services, sinks
from vellum.sources.layout import IMAGE, LINE, PAGE_DDL, ZONE, complete
from vellum.sources.options import Options
from vellum.sources.translation import units_of
from vellum.streaming import arrival

RECT = ("x0", "y0", "x1", "y1")


def rect(*r):
    return dict(zip(RECT, map(float, r), strict=True))


def one(df, c):
    return df.select(c).first()[0]


# --- images and zones -------------------------------------------------------------------------------


def pictures(spark):
    rows = [(1, 0, [{"seq": 0, **rect(10, 10, 60, 60), "ext": "jpx", "data": b"bad"}, {"seq": 1, **rect(100, 10, 150, 60), "ext": "PNG", "data": b"two"}, {"seq": 2, **rect(0, 300, 100, 400), "ext": "jpg", "data": b"three"}]), (2, 0, [])]
    return spark.createDataFrame(rows, f"doc_id long, page_num int, images array<{IMAGE}>")


@pytest.mark.parametrize(
    ("zone", "captures", "action", "data"),
    [
        ((0, 0, 200, 100), False, "image", b"bad"),  # the first of two; it does not convert: raw bytes
        ((90, 5, 160, 70), False, "image", b"png:two"),
        ((15, 15, 40, 40), False, "image", b"drawn"),  # none inside: the zone is drawn
        ((0, 340, 120, 420), True, "render", b"drawn"),  # 60 % of the third lies inside
        ((0, 360, 120, 420), True, "none", None),  # 40 %
        ((0, 100, 0.5, 200), False, "none", None),  # under a point
    ],
)
def test_regions(spark, zone, captures, action, data):
    def to_png(raw, ext):
        if raw == b"bad":
            raise ValueError("no")
        return b"png:" + raw

    zones = spark.createDataFrame([(1, 0, 7, rect(*zone), captures)], f"doc_id long, page_num int, seq int, zone {ZONE}, captures boolean")
    wanted = images.regions(zones, pictures(spark))
    assert one(wanted, "action") == action
    documents = spark.createDataFrame([(1, b"pdf"), (2, b"pdf")], "doc_id long, content binary")
    got = images.captured(wanted, documents, to_png, lambda content, page, r, zoom: b"drawn" if content == b"pdf" and zoom == 2.0 else None).collect()
    assert [bytes(r.data) for r in got] == ([data] if data else [])
    if data == b"bad":
        assert got[0].ext == "jpx"


def test_a_damaged_document_gives_an_error(spark):
    zones = spark.createDataFrame([(2, 0, 7, rect(0, 0, 9, 9), False), (3, 0, 7, rect(0, 0, 9, 9), False)], f"doc_id long, page_num int, seq int, zone {ZONE}, captures boolean")
    documents = spark.createDataFrame([(2, b"x"), (3, b"y")], "doc_id long, content binary")
    got = {r.doc_id: (r.data, r.ext, r.error) for r in images.captured(images.regions(zones, pictures(spark)), documents, lambda raw, ext: None, lambda *a: 1 / 0).collect()}
    assert got[2][:2] == (None, None) and got[2][2].startswith("ZeroDivisionError") and set(got) == {2, 3}


def test_drawn_zones(spark):
    rows = [(rect(60, 80, 20, 40),), (rect(0, 0, 3, 90),), (rect(0, 0, 5, 5),)]
    df = spark.createDataFrame(rows, f"r {ZONE}")
    got = [r[0] and tuple(r[0]) for r in df.select(images.drawn_zone(F.col("r"), 2.0)).collect()]
    assert got == [(10.0, 20.0, 30.0, 40.0), None, (0.0, 0.0, 2.5, 2.5)]
    got = [r[0] and tuple(r[0]) for r in df.select(images.drawn_zone(F.col("r"), 8.0)).collect()]
    assert got == [(2.5, 5.0, 7.5, 10.0), None, None]
    assert tuple(one(df, images.drawn_zone(F.col("r"), 0.0))) == (20.0, 40.0, 60.0, 80.0)
    assert [r[0] for r in df.select(g.clamp(F.col("r.x1"), 4.0, 10.0)).collect()] == [10.0, 4.0, 5.0]


def test_gallery(spark):
    captures = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (1, 3, "c"), (2, 1, "z")], "doc_id long, seq int, uri string")
    removed = spark.createDataFrame([(1, "b"), (2, "b")], "doc_id long, uri string")
    assert {r.doc_id: r.uris for r in images.gallery(captures, removed).collect()} == {1: ["a", "c"], 2: ["z"]}


def test_clip_text(spark):
    line = lambda k, x0, y0, x1, y1, t: {"line_id": k, "blk": 0, **rect(x0, y0, x1, y1), "max_size": 9.0, "spans": [{"text": x, "size": 9.0, "bold": False, "italic": False} for x in t.split()]}
    lines = [line(0, 0, 0, 10, 10, "in here"), line(1, 8, 0, 30, 10, "out"), line(2, 0, 90, 10, 99, "low"), line(3, 2, 12, 9, 20, "too")]
    df = complete(spark.createDataFrame([(lines,)], f"lines array<{LINE}>"))
    assert one(df, reading.clip_text(F.col("lines"), *(F.lit(float(x)) for x in (0, 0, 15, 50)))) == "in here\ntoo"
    assert one(df, reading.column_texts(F.lit(15.0))[1]) == "out"


# --- options and services ---------------------------------------------------------------------------


def test_options(tmp_path):
    raw = {"lang": "xx", "src_lang": "zh", "dst_lang": "auto", "engine": 3, "zoom": 99, "font_size": "9", "render_md": "off", "show_header": 0, "remember_tab": "maybe", "last_tab": "images", "odd": 1, "last_pages": {str(k): k for k in range(30)} | {"bad": "x"}}
    o = Options.checked(raw)
    assert (o.lang, o.src_lang, o.dst_lang, o.engine, o.zoom, o.font_size) == ("it", "zh", "it", "google", 4.0, 10)
    assert (o.render_md, o.show_header, o.remember_tab, o.save_edits, o.last_tab) == (False, False, True, True, "images")
    assert list(o.last_pages) == [str(k) for k in range(10, 30)]
    assert Options.checked({"zoom": None, "font_size": float("inf"), "last_pages": 3}) == Options() == Options.checked([1])
    at = tmp_path / "deep" / "options.json"
    o.save(at)
    assert Options.load(at) == o and [p.name for p in at.parent.iterdir()] == ["options.json"]
    at.write_text("{")
    assert Options.load(at) == Options() == Options.load(tmp_path / "none")


def test_services(spark):
    rows = [("google", "Hi & bye", "auto", "zh"), ("microsoft", 'a "b"', "auto", "zh"), ("microsoft", "x", "it", "en"), ("other", "x", "it", "en")]
    got = spark.createDataFrame(rows, "engine string, text string, source string, target string").select(services.request(*(F.col(c) for c in ("engine", "text", "source", "target"))).alias("r")).select("r.*").collect()
    asked = [dict(urllib.parse.parse_qsl(urllib.parse.urlsplit(r.url).query)) for r in got]
    assert [r.method for r in got] == ["GET", "POST", "POST", "GET"] and asked[0] == {"client": "gtx", "sl": "auto", "tl": "zh", "dt": "t", "q": "Hi & bye"}
    assert asked[1] == {"isEnterpriseClient": "False", "to": "zh-Hans"} and asked[2]["from"] == "it" and json.loads(got[1].body) == ['a "b"'] and got[0].body is None
    bodies = [("google", '[[["Ciao ","Hi",1],["mondo",null],[null,"x"]],null,"en"]', "Hi"), ("google", "[null]", "same"), ("google", "no json", "same"), ("microsoft", '[{"translations":[{"text":"Ciao"}]}]', "Hi"), ("microsoft", "[]", "same")]
    df = spark.createDataFrame(bodies, "engine string, body string, text string")
    assert [r[0] for r in df.select(services.response(*(F.col(c) for c in ("engine", "body", "text")))).collect()] == ["Ciao mondo", "same", "same", "Ciao", "same"]


# --- translation ------------------------------------------------------------------------------------


def test_images_in_cells_are_protected():
    text = "| ![x](http://u/p.png) | see ![y](http://u/q.png) here |\n| --- | --- |\n| ![z](http://u/r.png) | 7 |"
    units = units_of(text, 1500)
    assert "".join(b + u for b, u, _ in units) == text
    assert [u for _, u, needed in units if needed] == ["see", "here"]


def test_tables_are_recognised_by_lines():
    text = "before\n| a | b |\n|:---|---:|\n| c | d |\n  | e | f |  \nafter\n| no | rule |\n| x | y |\n\n| lone | head |\n| --- | --- |"
    units = [u for _, u, needed in units_of(text, 1500) if needed]
    assert units == ["before\n", "a", "b", "c", "d", "e", "f", "after\n| no | rule |\n| x | y |", "| lone | head |\n| --- | --- |"]


def test_one_bad_unit_does_not_lose_its_batch(spark):
    def picky(units):
        if any("bad" in u for u in units):
            raise ValueError("refused")
        return [u.upper() for u in units]

    df = spark.createDataFrame([(1, "good one\n\nbad one\n\nanother"), (2, "good one"), (3, None), (4, ""), (5, "42")], "k int, text string")
    got = {r.k: (r.translated, r.failed, r.error) for r in relations.translated(df, ["k"], picky).collect()}
    assert got == {1: ("GOOD ONE\n\nbad one\n\nANOTHER", 1, "ValueError: refused"), 2: ("GOOD ONE", 0, None), 3: (None, 0, None), 4: ("", 0, None), 5: ("42", 0, None)}
    short = relations.translated(df, ["k"], lambda us: [u.lower() for u in us][:1])
    assert {r.k: r.translated for r in short.collect()}[1] == "good one\n\nbad one\n\nanother"


def test_debounce_over_slices(spark):
    import random

    r = random.Random(6)
    rows = [(r.choice((1, 2, None)), r.choice((0, r.randint(0, 3_000), 3_000 + r.randint(0, 40))), k) for k in range(400)]
    df = spark.createDataFrame(rows, "k int, s int, id int").selectExpr("k", "timestamp_seconds(s) as at", "id").union(spark.sql("select 1, cast(null as timestamp), 999"))
    want = set()
    for key in {k for k, *_ in rows}:
        own = sorted((s, i) for k, s, i in rows if k == key)
        want |= {i for (s, i), nxt in zip(own, [*own[1:], None], strict=True) if nxt is None or nxt[0] - s > 5}
    assert {x.id for x in relations.debounced(df, ["k"], "at", "id", 5).collect()} == want


# --- sources and sinks ------------------------------------------------------------------------------


def test_outlines(spark):
    docs = spark.createDataFrame([(1, b"[[1, \" Intro \", 1], [-2, null, 3], [2, \"gone\", 0]]"), (2, b"{")], "doc_id long, content binary")
    rows = decoder.outlines(docs, json.loads).collect()
    assert [(r.doc_id, r.seq, r.level, r.title, r.page_idx) for r in rows] == [(1, 0, 1, "Intro", 0), (1, 1, 0, decoder.NO_TITLE, 2)]
    assert relations.outline_parents(decoder.outlines(docs, json.loads), ["doc_id"]).count() == 2


def test_page_markdown_falls_back(spark):
    def extract(content, page, lang):
        if lang not in content.decode().split():
            raise LookupError(lang)
        return f"  page {page} in {lang}\n" if page else "  "

    docs = spark.createDataFrame([(1, b"deu eng"), (2, b"eng"), (3, b"none")], "doc_id long, content binary")
    pages = spark.createDataFrame([(d, p) for d in (1, 2, 3) for p in (0, 1)], "doc_id long, page_num int")
    got = {(r.doc_id, r.page_num): (r.raw, r.ocr_lang, r.error) for r in decoder.page_markdown(docs, extract, pages, "deu").collect()}
    assert got[1, 1] == ("page 1 in deu", "deu", None) and got[2, 1] == ("page 1 in eng", "eng", None) and got[1, 0] == ("", "deu", None)
    assert got[3, 1][:2] == (None, None) and got[3, 1][2].startswith("LookupError")


def test_decoder_keeps_the_pages_before_an_error(spark):
    def broken(raw, wanted):
        yield {"page_num": 0, "width": 10.0, "height": 10.0, "images": [{"seq": 0, "x0": 1.0, "y0": 1.0, "x1": 5.0, "y1": 5.0, "ext": "png", "data": b"\x89PNG"}]}
        raise ValueError("page 1")

    docs = spark.createDataFrame([("p", 1, "f", b"x")], "path string, doc_id long, fingerprint string, content binary")
    got = decoder.decoded(docs, broken).collect()
    assert [(r.page_num, r.error) for r in got] == [(0, None), (None, "ValueError: page 1")] and bytes(got[0].images[0].data) == b"\x89PNG"


def test_zones_recompute_layout_only(spark):
    raw = spark.createDataFrame([(1, "f", 0, "a"), (1, "f", 1, "b"), (2, "g", 0, "c")], "doc_id long, fingerprint string, page_num int, raw string")
    none = spark.createDataFrame([], f"doc_id long, page_num int, exclude array<{ZONE}>, include array<{ZONE}>")
    asked = spark.createDataFrame([(1, "f", 0), (1, "f", 2), (2, "new", 0)], "doc_id long, fingerprint string, page_num int")
    assert sorted((r.doc_id, r.page_num) for r in incremental.to_decode(asked, raw).collect()) == [(1, 2), (2, 0)]
    final = spark.createDataFrame([], "doc_id long, fingerprint string, page_num int, zones_key string, text string, label string")
    pipeline = lambda p: p.withColumn("text", F.upper("raw")).withColumn("label", F.when(F.size("include") + F.size("exclude") > 0, "manual").otherwise("auto"))
    first = incremental.finished(raw, none, final, pipeline)
    assert sorted((r.text, r.label, r.zones_key) for r in first.collect()) == [("A", "auto", "()"), ("B", "auto", "()"), ("C", "auto", "()")]
    zones = spark.createDataFrame([(1, 1, [rect(0, 0, 9, 9)], [])], none.schema)
    again = incremental.finished(raw, zones, first, pipeline).collect()
    assert [(r.doc_id, r.page_num, r.label) for r in again] == [(1, 1, "manual")] and again[0].zones_key != "()"
    assert incremental.finished(raw, none, first, pipeline).count() == 0


def test_json_files(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'f"1', 0, "eng", "r", "t", "auto", 1.5), (1, 'f"1', 1, "eng", "r2", None, None, None)], "doc_id long, fingerprint string, page_num int, ocr_lang string, raw string, text string, label string, elapsed double")
    got = json.loads(sinks.to_json_cache(rows).first().json)
    assert got == {"fingerprint": 'f"1', "pages": {"0": {"eng": {"raw": "r", "final": ["t", "auto", 1.5]}}, "1": {"eng": {"raw": "r2", "final": None}}}}
    done = spark.createDataFrame([(1, 'f"1', 0, "google", "it", 'cia"o'), (1, 'f"1', 0, "microsoft", "de", "hallo"), (1, 'f"1', 12, "google", "it", "x\ny")], "doc_id long, fingerprint string, page_num int, engine string, target string, text string")
    whole = sinks.to_json_translations(done).first()
    assert json.loads(whole.json) == {"fingerprint": 'f"1', "pages": {"0": {"google:it": 'cia"o', "microsoft:de": "hallo"}, "12": {"google:it": "x\ny"}}}
    from vellum.sources import caches

    (tmp_path / "t.json").write_text(whole.json)
    assert {(r.page_num, r.engine, r.target, r.text) for r in caches.translations(spark, str(tmp_path)).collect()} == {(0, "google", "it", 'cia"o'), (0, "microsoft", "de", "hallo"), (12, "google", "it", "x\ny")}
    edits = spark.createDataFrame([(1, "original", "k1", "e1"), (1, "original", "k2", "e2"), (1, "translated", "k1", "e3")], "doc_id long, win string, key string, edited string")
    assert {r.win: json.loads(r.json) for r in sinks.to_json_edits(edits).collect()} == {"original": {"k1": "e1", "k2": "e2"}, "translated": {"k1": "e3"}}


def test_exports_and_html(spark, tmp_path):
    df = spark.createDataFrame([(1, "── 1.0 ms │ x ──\n\nbody"), (2, None)], "k int, text string")
    sinks.export_text(df.where("k = 1"), str(tmp_path / "out"))
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ["body"]
    assert [r[0] for r in df.orderBy("k").select(sinks.to_html(tx.without_header(F.col("text")), lambda t: f"<p>{t}</p>")).collect()] == ["<p>body</p>", None]
    assert sinks.data_uri(b"\x00", "png") == "data:image/png;base64,AA=="
    images_ = spark.createDataFrame([("a.png", b"x"), ("b.png", b"yy")], "name string, data binary")
    saved = sinks.save_images(images_, f"file://{tmp_path}/img")
    before = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "img").iterdir()}
    assert saved.count() == 2 == saved.count() and before == {p.name: p.stat().st_mtime_ns for p in (tmp_path / "img").iterdir()}


def test_pipe_rows_and_tokens(spark):
    df = spark.createDataFrame([("| a |  | --- |",), ("|:---:|---|",)], "t string")
    assert [r[0] for r in df.select(tx.cells(F.col("t"))).collect()] == [["a", "", "---"], [":---:", "---"]]
    assert [r[0] for r in df.select(tx.is_separator(tx.cells(F.col("t")))).collect()] == [False, True]
    assert one(spark.sql("select '@@ IMG 3 @@ x' as t"), tx.tidy_tokens(F.col("t"))) == "@@IMG3@@ x"
    assert [r[0] for r in spark.sql("select explode(array('zh', 'it')) as c").select(tx.service_language(F.col("c"))).collect()] == ["zh-Hans", "it"]


def test_debounced_stream(spark, tmp_path):
    rows = spark.sql("select * from values (1, timestamp'2024-01-01 00:00:00'), (1, timestamp'2024-01-01 00:00:03'), (1, timestamp'2024-01-01 00:10:00'), (2, timestamp'2024-01-01 02:00:00') as t(k, at)")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    out = arrival.debounced_stream(stream, "k", "at", "5 seconds", "1 second")
    out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).outputMode("append").start().awaitTermination()
    got = {(r.k, str(r.last_at), r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert {(1, "2024-01-01 00:00:03", 2), (1, "2024-01-01 00:10:00", 1)} <= got


def test_zones_key(spark):
    z = spark.createDataFrame([([], []), ([rect(0, 0, 1, 1)], []), ([], [rect(0, 0, 1, 1)]), ([rect(0, 0, 1, 1)], [])], f"a array<{ZONE}>, b array<{ZONE}>")
    keys = [r[0] for r in z.select(relations.zones_key(F.col("a"), F.col("b"))).collect()]
    assert keys[0] == "()" and keys[1] == keys[3] and len(set(keys)) == 3
    assert "images" in complete(spark.sql("select 7L as doc_id")).columns and "images" in PAGE_DDL
