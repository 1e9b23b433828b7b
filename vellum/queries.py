"""Registered queries over the supplied tables, and the SQL that gives the same rows.

The layout ones run over the made layout of `documents` (`sources.layout.project`) and made companions:
two zones, up to one table and boxes a page, an outline, edits. All of them read whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import geometry as g
from .functions import text as tx
from .operators import columns, images, markdown, profile, reading, relations
from .plans import planner
from .runtime import ship
from .sources import sinks
from .sources.layout import cleaned_blocks, complete, project


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return ship(spark).read.parquet(f"{d}/documents.parquet").select("doc_id", "text")


def zone(k: int) -> Column:
    """The k-th made zone of a page."""
    i = F.col("doc_id")
    x0 = g.d(50) + F.pmod(i, F.lit(5)) * 20 + k * g.d(240)
    y1 = g.d(160) + F.pmod(i, F.lit(7)) * 60 + k * g.d(40)
    return F.struct(x0.alias("x0"), g.d(80 + 40 * k).alias("y0"), (x0 + 200).alias("x1"), y1.alias("y1"))


def table() -> Column:
    """The made table of a page: a wide 3 x 3 one, a title-like 1 x 2 one, or a narrow 2 x 2 one."""
    kind = F.pmod(F.col("doc_id"), F.lit(3))
    return F.struct(
        F.lit(0).alias("table_id"), g.d(50).alias("x0"), g.d(300).alias("y0"), F.when(kind == 0, g.d(545)).otherwise(g.d(210)).alias("x1"), g.d(420).alias("y1"),
        F.when(kind == 1, 1).otherwise(F.lit(3) - kind).alias("row_count"), F.when(kind == 0, 3).otherwise(2).alias("col_count"))


def pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages with two zones in `zones` and one table."""
    p = project(_docs(spark, d)).withColumn("zones", F.array(zone(0), zone(1)))
    t = table()
    cells = F.transform(F.filter("blocks", lambda b: g.inside(b, t)), lambda b: F.struct(*(b[k].alias(k) for k in ("x0", "y0", "x1", "y1")), profile.block_text(b).alias("text")))
    return p.withColumn("made_table", F.struct(t["table_id"].alias("table_id"), *(t[k].alias(k) for k in ("x0", "y0", "x1", "y1", "row_count", "col_count")), cells.alias("cells")))


def _blocks(p: DataFrame, *more: Column | str) -> DataFrame:
    return p.select("doc_id", "width", "height", *more, F.explode("blocks").alias("b"))


def layout_blocks(spark: SparkSession, d: str) -> DataFrame:
    text = profile.block_text(F.col("b"))
    return _blocks(project(_docs(spark, d))).select(F.col("doc_id").alias("page_id"), "b.block_id", text.alias("text"), "b.x0", "b.y0", "b.x1", "b.y1", "b.max_size")


def zone_overlap(spark: SparkSession, d: str) -> DataFrame:
    rows = pages(spark, d).select("doc_id", F.explode("blocks").alias("b"), "zones").select("doc_id", "b", F.posexplode("zones").alias("seq", "z"))
    return rows.select(F.col("doc_id").alias("page_id"), "b.block_id", "seq", g.overlap_area(F.col("b"), F.col("z")).alias("overlap")).where("overlap > 0")


def zone_exclusion(spark: SparkSession, d: str) -> DataFrame:
    return _blocks(pages(spark, d), "zones").where(~g.excluded(F.col("b"), F.col("zones"))).select(F.col("doc_id").alias("page_id"), "b.block_id")


def zone_inclusion_first(spark: SparkSession, d: str) -> DataFrame:
    found = reading.first_zone(F.col("b"), F.col("zones")).cast("int")
    return _blocks(pages(spark, d), "zones").select(F.col("doc_id").alias("page_id"), "b.block_id", (found - 1).alias("zone")).where("zone >= 0")


def margin_strip(spark: SparkSession, d: str) -> DataFrame:
    return _blocks(pages(spark, d)).where(g.clear_of_margins(F.col("b"), F.col("height"))).select(F.col("doc_id").alias("page_id"), "b.block_id")


def width_class(spark: SparkSession, d: str) -> DataFrame:
    w = g.width(F.col("b"))
    kind = F.when(w >= g.d(0.6) * F.col("width"), "full").when(w >= 25, "body").otherwise("dropped")
    return _blocks(pages(spark, d)).select(F.col("doc_id").alias("page_id"), kind.alias("kind")).groupBy("page_id", "kind").agg(F.count("*").alias("n"))


def _clear(p: DataFrame) -> DataFrame:
    return p.withColumn("clear", columns.without_margins(F.col("blocks"), F.col("height"))).withColumn("merged", columns.intervals(F.col("clear"), F.col("width")))


def column_intervals(spark: SparkSession, d: str) -> DataFrame:
    return _clear(pages(spark, d)).select(F.col("doc_id").alias("page_id"), F.posexplode("merged").alias("seq", "m")).select("page_id", "seq", "m.a", "m.b")


def column_splits(spark: SparkSession, d: str) -> DataFrame:
    return _clear(pages(spark, d)).select(F.col("doc_id").alias("page_id"), F.posexplode(columns.splits_of(F.col("merged"))).alias("seq", "split"))


def column_widest(spark: SparkSession, d: str) -> DataFrame:
    return _clear(pages(spark, d)).select(F.col("doc_id").alias("page_id"), columns.widest_split(F.col("merged")).alias("split")).where("split is not null")


def column_assign(spark: SparkSession, d: str) -> DataFrame:
    p = _clear(pages(spark, d)).withColumn("borders", columns.splits_of(F.col("merged")))
    return _blocks(p, "borders").select(F.col("doc_id").alias("page_id"), "b.block_id", columns.column_of(g.middle(F.col("b")), F.col("borders")).alias("col"))


def column_reorder(spark: SparkSession, d: str) -> DataFrame:
    kept = F.filter("blocks", lambda b: b["max_size"] >= profile.FLOOR)
    return columns.with_needs_reorder(pages(spark, d).withColumn("blocks", kept)).select(F.col("doc_id").alias("page_id"), "needs")


def _profiled(spark: SparkSession, d: str) -> DataFrame:
    return profile.with_profile(pages(spark, d).withColumn("tables", F.array(F.col("made_table"))))


def page_profile(spark: SparkSession, d: str) -> DataFrame:
    f = "profile."
    names = [n for n in profile.FEATURES if n != "splits"]
    return _profiled(spark, d).select(F.col("doc_id").alias("page_id"), *(F.col(f + n).alias(n) for n in names), F.size(f + "splits").alias("n_splits"))


OVERRIDES = '{"disable": ["spacing"], "rules": [{"when": {"columns": {"gte": 4}}, "apply": ["spacing", "dehyphenate"]}, {"when": {"has_tables": true, "columns": 1}, "apply": ["reorder_columns"]}, {"when": {"pages": 3}, "apply": ["split_glued"]}]}'


def fix_plan(spark: SparkSession, d: str) -> DataFrame:
    both = [planner.plan(F.col("profile"), b) for b in (planner.TEXT_BACKEND, planner.LAYOUT_BACKEND)]
    return _profiled(spark, d).select(F.col("doc_id").alias("page_id"), *(F.array_join(p, ",").alias(n) for p, n in zip(both, ("text_plan", "layout_plan"), strict=True)))


def fix_plan_override(spark: SparkSession, d: str) -> DataFrame:
    p = planner.plan(F.col("profile"), planner.TEXT_BACKEND, overrides=planner.Overrides.parse(OVERRIDES))
    return _profiled(spark, d).select(F.col("doc_id").alias("page_id"), F.array_join(p, ",").alias("plan"))


def block_markdown(spark: SparkSession, d: str) -> DataFrame:
    return _blocks(pages(spark, d)).select(F.col("doc_id").alias("page_id"), "b.block_id", markdown.block_md(F.col("b"), True).alias("column_md"), markdown.block_md(F.col("b"), False).alias("plain_md"))


def reading_order(spark: SparkSession, d: str) -> DataFrame:
    return reading.with_reading_order(project(_docs(spark, d))).select(F.col("doc_id").alias("page_id"), F.col("reading").alias("md"))


def table_grid(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the page's blocks taken as cells of one table: anchor rule, place in the row."""
    cells = F.transform("blocks", lambda b: F.struct(*(b[k].alias(k) for k in ("x0", "y0", "x1", "y1")), profile.block_text(b).alias("text")))
    rows = pages(spark, d).select(F.col("doc_id").alias("page_id"), F.posexplode(markdown.table_rows(cells)).alias("row", "r"))
    return rows.select("page_id", "row", F.size("r").alias("n_cells"), F.sha1(F.array_join(F.transform("r", lambda c: c["t"]), "|").cast("binary")).alias("row_key"))


def table_markdown(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark, d).select(F.col("doc_id").alias("page_id"), markdown.table_md(F.col("made_table")).alias("md"))


def legend_blocks(spark: SparkSession, d: str) -> DataFrame:
    rows = _blocks(pages(spark, d), F.array("made_table").alias("ts"))
    return rows.where((F.col("b.max_size") < 6.5) & markdown.legend(F.col("b"), F.col("ts"))).select(F.col("doc_id").alias("page_id"), "b.block_id")


def box_titles(spark: SparkSession, d: str) -> DataFrame:
    p = pages(spark, d).select("doc_id", "blocks", F.posexplode("zones").alias("seq", "z"))
    return p.select(F.col("doc_id").alias("page_id"), "seq", markdown.box_title(F.col("z"), F.col("blocks")).alias("title"))


def box_dedup(spark: SparkSession, d: str) -> DataFrame:
    kind = "array<struct<seq:int,x0:double,y0:double,x1:double,y1:double>>"
    rects = F.transform("blocks", lambda b: F.struct(b["block_id"].alias("seq"), b["x0"].alias("x0"), b["y0"].alias("y0"), (b["x1"] + b["max_size"] * 8).alias("x1"), (b["y1"] + b["max_size"] * 4).alias("y1")))
    return pages(spark, d).select(F.col("doc_id").alias("page_id"), F.explode(markdown.dedup_boxes(rects, kind)).alias("k")).select("page_id", F.col("k.seq").alias("block_id"))


def _drawn() -> Column:
    """Made drawings: the zones, with the text of the blocks in them."""
    text = lambda z: F.array_join(F.transform(F.filter("blocks", lambda b: g.inside(b, z)), profile.block_text), "\n")
    return F.transform("zones", lambda z, i: F.struct(i.cast("int").alias("seq"), F.lit("s").alias("kind"), *(z[k].alias(k) for k in ("x0", "y0", "x1", "y1")), text(z).alias("text")))


def box_pages(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of a page from made drawings."""
    p = pages(spark, d).withColumn("drawings", _drawn())
    found = markdown.boxes(F.col("drawings"), F.col("blocks"), F.array("made_table"), F.col("exclude"), F.col("width"), F.col("height"))
    return p.select(F.col("doc_id").alias("page_id"), F.explode(markdown.dedup_boxes(found, markdown.BOXES)).alias("x")).select("page_id", "x.seq", F.coalesce("x.title", F.lit("")).alias("title"), "x.md")


def _whole(spark: SparkSession, d: str) -> DataFrame:
    """Pages with tables, drawings and exclusion zones, in all combinations."""
    k = F.pmod(F.col("doc_id"), F.lit(8))
    p = pages(spark, d).withColumn("drawings", F.when(k % 2 == 1, _drawn()))
    return complete(p.withColumn("exclude", F.when(k == 2, F.col("zones")).when(k == 5, F.slice("zones", 2, 1))).withColumn("tables", F.when(k != 3, F.array("made_table"))))


def page_reading(spark: SparkSession, d: str) -> DataFrame:
    """Whole pages in reading order: tables, boxes with titles, exclusion zones and legends."""
    return reading.with_reading_order(_whole(spark, d)).select(F.col("doc_id").alias("page_id"), F.col("reading").alias("md"))


def title_reading(spark: SparkSession, d: str) -> DataFrame:
    """The same, with the titles of the first column put first."""
    return reading.with_reading_order(_whole(spark, d), move_title=True).select(F.col("doc_id").alias("page_id"), F.col("reading").alias("md"))


def block_lines_markdown(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of two lines, in bold and italics by turns: headings are cut behind their first line."""
    def halves(b: Column) -> Column:
        t, i = profile.block_text(b), b["block_id"]
        half = F.floor(F.length(t) / 2).cast("int")
        span = lambda x, bold, italic: F.array(F.struct(x.alias("text"), b["max_size"].alias("size"), bold.alias("bold"), italic.alias("italic")))
        lines = F.array(span(F.substr(t, F.lit(1), half), i % 5 == 0, i % 3 == 0), span(F.substr(t, half + 1), F.lit(False), i % 2 == 0))
        return F.struct(i.alias("block_id"), *(b[k].alias(k) for k in ("x0", "y0", "x1", "y1", "max_size")), lines.alias("lines"))

    p = pages(spark, d).withColumn("blocks", F.transform("blocks", halves))
    return _blocks(p).select(F.col("doc_id").alias("page_id"), "b.block_id", markdown.block_md(F.col("b"), True).alias("column_md"), markdown.block_md(F.col("b"), False).alias("plain_md"))


def inclusion_reading(spark: SparkSession, d: str) -> DataFrame:
    lines = reading.lines_of(F.col("blocks"))
    return pages(spark, d).select(F.col("doc_id").alias("page_id"), reading.inclusion_order(lines, F.col("zones"), F.col("exclude")).alias("md"))


def _zoned(spark: SparkSession, d: str) -> DataFrame:
    k, none = F.pmod(F.col("doc_id"), F.lit(8)), F.array().cast("array<struct<x0:double,y0:double,x1:double,y1:double>>")
    p = pages(spark, d).withColumn("include", F.when(k == 1, F.col("zones")).otherwise(none)).withColumn("exclude", F.when(k == 2, F.col("zones")).otherwise(none))
    return complete(p.withColumn("tables", F.when(k >= 4, F.array("made_table")).otherwise(F.array().cast("array<struct<table_id:int,x0:double,y0:double,x1:double,y1:double,row_count:int,col_count:int,cells:array<struct<x0:double,y0:double,x1:double,y1:double,text:string>>>>"))))


def page_texts(spark: SparkSession, d: str) -> DataFrame:
    """The whole page pipeline, with zones on some pages and tables on others."""
    return reading.page_text(_zoned(spark, d)).select(F.col("doc_id").alias("page_id"), "label", F.array_join("plan", ",").alias("plan"), F.sha1(F.col("text").cast("binary")).alias("text_key"), F.length("text").alias("n_chars"))


def glued_split(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs made of a left and a right block of the page, cut apart again."""
    p = pages(spark, d)
    border = columns.widest_split(columns.intervals(columns.without_margins(F.col("blocks"), F.col("height")), F.col("width")))
    p = p.withColumn("border", border)
    first = lambda test: F.try_element_at(F.filter("blocks", test), F.lit(1))
    glued = F.concat(profile.block_text(first(lambda b: g.middle(b) <= F.col("border"))), F.lit(" "), profile.block_text(first(lambda b: g.middle(b) > F.col("border"))))
    p = p.withColumn("glued", F.coalesce(glued, F.lit("")))
    return reading.with_split_glued(p, "glued", "cut").select(F.col("doc_id").alias("page_id"), F.col("glued") .alias("glued"), F.col("cut").alias("cut"))


def text_normal_forms(spark: SparkSession, d: str) -> DataFrame:
    t = F.concat(F.replace(F.col("text"), F.lit("er "), F.lit("e-\n r")), F.lit(" **12**end _a_,_b_ In­-Hos—p|x"))
    out = {"dehyphenated": tx.dehyphenated(t), "strip_key": tx.strip_key(t), "reading_key": tx.reading_key(t), "spaced": tx.spaced(t)}
    return _docs(spark, d).select(F.col("doc_id").alias("page_id"), *(F.sha1(c.cast("binary")).alias(n) for n, c in out.items()))


def header_keys(spark: SparkSession, d: str) -> DataFrame:
    shown = F.when(F.col("doc_id") % 2 == 0, F.concat(tx.header(F.lit(12.5), F.col("text"), F.lit("auto"), F.lit("eng")), F.col("text"))).otherwise(F.col("text"))
    return _docs(spark, d).select(F.col("doc_id").alias("page_id"), tx.text_key(tx.without_header(shown)).alias("key"), F.length(shown).alias("n_shown"))


def _paragraphed(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))


def paragraph_units(spark: SparkSession, d: str) -> DataFrame:
    u = relations.paragraph_units(_paragraphed(spark, d), ["doc_id"])
    return u.select(F.col("doc_id").alias("page_id"), "para", F.sha1(F.col("unit").cast("binary")).alias("unit_key"), tx.needs_translation(F.col("unit")).alias("needed"))


def sentence_chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = _docs(spark, d).select(F.col("doc_id").alias("page_id"), F.posexplode(relations.chunked(F.col("text"), 300)).alias("seq", "chunk"))
    return rows.select("page_id", "seq", F.sha1(F.col("chunk").cast("binary")).alias("chunk_key"))


def translate_units(spark: SparkSession, d: str) -> DataFrame:
    from .sources.fakes import bracketed

    out = relations.translated(_paragraphed(spark, d), ["doc_id"], bracketed, size=1_000_000)
    return out.select(F.col("doc_id").alias("page_id"), F.sha1(F.col("translated").cast("binary")).alias("text_key"))


def translate_chunks(spark: SparkSession, d: str) -> DataFrame:
    """translate_units at the operator's own size, where long prose is cut at sentence ends (which its SQL does not do)."""
    from .sources.fakes import bracketed

    out = relations.translated(_paragraphed(spark, d), ["doc_id"], bracketed)
    return out.select(F.col("doc_id").alias("page_id"), F.sha1(F.col("translated").cast("binary")).alias("text_key"))


def _toc(spark: SparkSession, d: str) -> DataFrame:
    b = _blocks(project(_docs(spark, d)))
    t = profile.block_text(F.col("b"))
    return b.select(F.col("doc_id").alias("page_id"), F.col("b.block_id").cast("bigint").alias("seq"), (F.lit(1) + F.length(t) % 3).cast("int").alias("level"), (F.col("b.block_id") + F.length(t) % 5).cast("bigint").alias("page_idx"))


def toc_parent(spark: SparkSession, d: str) -> DataFrame:
    return relations.outline_parents(_toc(spark, d), ["page_id"]).select("page_id", "seq", "level", "parent_seq")


def toc_asof(spark: SparkSession, d: str) -> DataFrame:
    at = _docs(spark, d).select(F.col("doc_id").alias("page_id"), F.explode(F.array(*map(F.lit, (0, 3, 9, 27)))).alias("page_num"))
    return relations.outline_position(at, _toc(spark, d), ["page_id"]).select("page_id", "page_num", "toc_seq")


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return _blocks(project(_docs(spark, d))).select(F.col("doc_id").alias("page_id"), "b.block_id", profile.block_text(F.col("b")).alias("text"))


def edit_overlay(spark: SparkSession, d: str) -> DataFrame:
    t = _texts(spark, d)
    edits = t.where("block_id % 3 = 0").groupBy("page_id", tx.text_key(F.col("text")).alias("key")).agg(F.concat(F.lit("edit "), F.min("block_id").cast("string")).alias("edited"))
    return relations.with_edits(t, edits, ["page_id"]).select("page_id", "block_id", F.sha1(F.col("shown").cast("binary")).alias("shown_key"))


def _events(spark: SparkSession, d: str) -> DataFrame:
    return ship(spark).read.parquet(f"{d}/events.parquet")


def latest_generation(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).select("user_id", "event_type", "event_id", "ts", "value")
    return relations.latest(e, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


def debounce_last(spark: SparkSession, d: str) -> DataFrame:
    return relations.debounced(_events(spark, d), ["user_id"], "ts", "event_id", 3600.0).select("user_id", "event_id")


def cache_missing(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d)
    cached = e.where("event_type = 'click'").select("user_id", F.get_json_object("props", "$.k").alias("k"))
    asked = e.select("user_id", F.get_json_object("props", "$.k").alias("k")).distinct()
    return relations.missing(asked, cached, ["user_id", "k"])


def clean_spans(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of several spans and lines, cleaned: blank spans go, broken words are joined."""
    span = lambda t: F.struct(t.alias("text"), F.length(t).cast("double").alias("size"), F.lit(False).alias("bold"), F.lit(False).alias("italic"))
    rows = F.transform(F.split("text", "\\n", -1), lambda x, i: F.struct(F.when(i % 2 == 0, F.concat(x, F.lit("-"))).otherwise(F.lower(x)).alias("x")))
    lines = F.transform(rows, lambda r: F.array(span(r["x"]), span(F.lit(" "))))
    block = F.struct(F.lit(0).alias("block_id"), *(g.d(0).alias(k) for k in ("x0", "y0", "x1", "y1", "max_size")), lines.alias("lines"))
    b = _docs(spark, d).select("doc_id", F.explode(cleaned_blocks(F.array(block))).alias("b"))
    return b.select(F.col("doc_id").alias("page_id"), "b.max_size", F.size("b.lines").alias("n_lines"), F.sha1(profile.block_text(F.col("b")).cast("binary")).alias("text_key"))


def table_cells(spark: SparkSession, d: str) -> DataFrame:
    """Lines with bars as pipe-table rows: their cells, and whether they are a rule."""
    rows = _docs(spark, d).select(F.col("doc_id").alias("page_id"), F.posexplode(F.split("text", "\n", -1)).alias("idx", "line")).where(F.col("line").contains("|"))
    rows = rows.withColumn("line", F.when(F.col("idx") % 7 == 0, F.lit("|:---|  ----: |---|")).otherwise(F.col("line"))).withColumn("cs", tx.cells(F.col("line")))
    return rows.select("page_id", "idx", F.size("cs").alias("n_cells"), tx.is_separator(F.col("cs")).alias("is_rule"), F.sha1(F.array_join("cs", "|").cast("binary")).alias("cells_key"))


def language_codes(spark: SparkSession, d: str) -> DataFrame:
    code = F.when(F.col("doc_id") % 5 == 0, "auto").when(F.col("doc_id") % 5 == 1, "zh").when(F.col("doc_id") % 5 == 2, F.lit(None)).otherwise(F.col("lang"))
    rows = ship(spark).read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("page_id"), code.alias("code"))
    token = F.concat(F.lit("x @@ IMG"), F.col("page_id").cast("string"), F.lit(" @@ y @@TBL 7@@"))
    return rows.select("page_id", "code", tx.ocr_language(F.col("code")).alias("ocr"), tx.service_language(F.col("code")).alias("service"), tx.tidy_tokens(token).alias("tidy"))


def drawn_zones(spark: SparkSession, d: str) -> DataFrame:
    """Rectangles drawn from any corner at different scales: normalised, in points, large enough."""
    i = F.col("doc_id")
    at = lambda a, b, c: (F.pmod(i * a, F.lit(b)) + c).cast("double")
    corners = F.struct(at(3, 50, 0).alias("x0"), at(7, 60, 0).alias("y0"), at(5, 50, 0).alias("x1"), at(11, 60, 0).alias("y1"))
    zone_ = images.drawn_zone(corners, F.pmod(i, F.lit(9)).cast("double"))
    return _docs(spark, d).select(i.alias("page_id"), zone_.alias("z")).where("z is not null").select("page_id", "z.x0", "z.y0", "z.x1", "z.y1", g.clamp(F.col("z.x1"), 2.0, 20.0).alias("shown"))


def region_images(spark: SparkSession, d: str) -> DataFrame:
    """Which image a zone means: the blocks of a page taken as images, the two zones, drawn to take or to capture."""
    rect = lambda b: [b[k].alias(k) for k in ("x0", "y0", "x1", "y1")]
    made = F.transform("blocks", lambda b: F.struct(b["block_id"].alias("seq"), *rect(b), F.lit("png").alias("ext"), F.lit(None).cast("binary").alias("data")))
    p = pages(spark, d).withColumn("images", made)
    zones = p.select("doc_id", "page_num", F.posexplode("zones").alias("seq", "zone")).withColumn("captures", (F.col("doc_id") + F.col("seq")) % 2 == 0)
    found = images.regions(zones, p)
    return found.select(F.col("doc_id").alias("page_id"), "seq", "action", F.size("found").alias("n_inside"), F.get("found", F.lit(0))["seq"].alias("first_image"))


def image_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Names of new captures; numbers go on after those taken."""
    e = _events(spark, d).select(F.col("user_id").alias("doc_id"), (F.col("event_id") % 3).cast("int").alias("page_num"), F.col("event_id").alias("seq"), "event_type", F.lit("png").alias("ext"))
    taken = e.where("event_type = 'click'").groupBy("doc_id", "page_num").agg(F.count("*").cast("int").alias("idx"))
    return sinks.image_names(e.where("event_type <> 'click'").drop("event_type"), taken).select("doc_id", "page_num", "seq", F.col("idx").cast("int").alias("idx"), "name")


def gallery_uris(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("seq"), F.concat(F.lit("u"), (F.col("event_id") % 50).cast("string")).alias("uri"), "event_type")
    kept = images.gallery(e.where("event_type <> 'view'").drop("event_type"), e.where("event_type = 'view'").select("doc_id", "uri"))
    return kept.select("doc_id", F.size("uris").alias("n"), F.array_join("uris", ",").alias("uris"))


def cache_invalidated(spark: SparkSession, d: str) -> DataFrame:
    """Cached results without those of pages that were drawn on; the rest renewed by later rows of the same key."""
    e = _events(spark, d).select(F.col("user_id").alias("doc_id"), (F.col("event_id") % 7).alias("page_num"), "event_type", "event_id")
    cache = e.where("event_type = 'view'").groupBy("doc_id", "page_num").agg(F.max("event_id").alias("result"))
    stale, fresh = e.where("event_type = 'click'").select("doc_id", "page_num"), e.where("event_id % 11 = 0").groupBy("doc_id", "page_num").agg((-F.max("event_id")).alias("result"))
    return sinks.upserted(relations.invalidated(cache, stale, ["doc_id", "page_num"]), fresh, ["doc_id", "page_num"]).select("doc_id", "page_num", "result")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        layout_blocks, zone_overlap, zone_exclusion, zone_inclusion_first, margin_strip, width_class, column_intervals, column_splits, column_widest, column_assign, column_reorder,
        page_profile, fix_plan, fix_plan_override, block_markdown, reading_order, table_grid, table_markdown, legend_blocks, box_titles, box_dedup, box_pages, page_reading, title_reading, block_lines_markdown, inclusion_reading, page_texts, glued_split,
        text_normal_forms, header_keys, paragraph_units, sentence_chunks, translate_units, translate_chunks, toc_parent, toc_asof, edit_overlay, latest_generation, debounce_last, cache_missing, clean_spans, table_cells, language_codes, drawn_zones, region_images, image_numbers, gallery_uris, cache_invalidated,
    )
}
