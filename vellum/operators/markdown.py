"""Markdown of blocks, tables and boxes, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.binding import bound
from ..functions.geometry import area, d, excluded, height, overlap_area, width
from ..functions.text import CAPTION, collapsed, strip_key, stripped
from .profile import block_text

#: Heading sizes, row distance, caption share, legend and box geometry.
H1, H2, H3, ROW, CAPTION_SHARE = 14.0, 12.0, 9.8, 5.0, 0.9
LEGEND_SIZE, LEGEND_UP, LEGEND_DOWN, LEGEND_SIDE = 5.0, 4.0, 45.0, 30.0
BOX_KINDS, BOX_WIDTH, BOX_HEIGHT, FRAME, EDGE, BAR_SHARE, BAR = ("fs", "s", "f"), 60.0, 30.0, 0.97, 2.0, 0.9, 60.0
BOX_TEXT, TITLE_UP, TITLE_SIDE, IN_TABLE, DUPLICATE = 30, 30.0, 40.0, 0.5, 0.6
STRIP_SHAPE, STRIP_TEXT, STRIP_TITLE, STRIP_UP, STRIP_DOWN, STRIP_WIDTH = 0.5, 8, 12, 2.0, 6.0, 0.6


def span_md(s: Column) -> Column:
    mark = F.when(s["bold"] & s["italic"], "***").when(s["bold"], "**").when(s["italic"], "*").otherwise("")
    return F.concat(mark, s["text"], mark)


def block_md(b: Column, as_column: bool) -> Column:
    def whole(lines: Column) -> Column:
        return F.array_join(lines, " ")

    def headed(lines: Column) -> Column:
        bold = F.exists(F.flatten(b["lines"]), lambda s: s["bold"])
        mark = F.when(b["max_size"] >= H2, "## ").when((b["max_size"] >= H3) & bold, "### ")
        body = F.array_join(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), " ")
        split = bound(body, lambda t: F.concat(mark, F.element_at(lines, 1), F.when(t != "", F.concat(F.lit("\n\n"), t)).otherwise("")))
        return F.when(b["max_size"] >= H1, F.concat(F.lit("# "), whole(lines))).when(mark.isNotNull(), split).otherwise(whole(lines))

    return bound(F.transform(b["lines"], lambda line: stripped(F.array_join(F.transform(line, span_md), ""))), headed if as_column else whole)


ROWS = "array<struct<y0:double,cells:array<struct<x0:double,k:int,x1:double,t:string>>>>"


def table_rows(cells: Column) -> Column:
    """Rows of cells by the distance of their tops to the row's first cell (not to the last: no drift)."""
    kept = F.filter(F.transform(cells, lambda c, i: F.struct(c["y0"].alias("y0"), c["x0"].alias("x0"), i.alias("k"), c["x1"].alias("x1"), collapsed(F.coalesce(c["text"], F.lit(""))).alias("t"))), lambda c: c["t"] != "")

    def step(done: Column, c: Column) -> Column:
        last = F.element_at(done, -1)
        cell = F.array(F.struct(c["x0"].alias("x0"), c["k"].cast("int").alias("k"), c["x1"].alias("x1"), c["t"].alias("t")))
        grown = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["y0"].alias("y0"), F.concat(last["cells"], cell).alias("cells"))))
        return F.when((F.size(done) > 0) & (F.abs(last["y0"] - c["y0"]) < ROW), grown).otherwise(F.concat(done, F.array(F.struct(c["y0"].alias("y0"), cell.alias("cells")))))

    rows = F.aggregate(F.array_sort(kept), F.array().cast(ROWS), step)
    return F.transform(rows, lambda r: F.array_sort(r["cells"]))


def rows_md(rows: Column, table_width: Column) -> Column:
    """A pipe table; a caption row becomes a bold line above it."""
    texts = lambda r: F.transform(r, lambda c: c["t"])
    rest = lambda xs: F.slice(xs, 2, F.greatest(F.size(xs) - 1, F.lit(0)))

    def captioned(own: Column) -> Column:
        """struct(rows, is_caption, caption)"""
        first = F.try_element_at(own, F.lit(1))
        widest = F.array_max(F.transform(own, lambda r: F.size(r)))
        across = F.array_max(F.transform(first, lambda c: c["x1"])) - F.array_min(F.transform(first, lambda c: c["x0"]))
        caption = F.array_join(texts(first), " ")
        is_caption = (F.size(first) == 1) | (F.size(first) < widest) & (across >= d(CAPTION_SHARE) * table_width) & caption.rlike(CAPTION)
        return F.struct(own.alias("rows"), is_caption.alias("is_caption"), caption.alias("caption"))

    def drawn(s: Column) -> Column:
        """struct(lines, rule, is_caption, caption)"""
        def lines(body: Column) -> Column:
            n = F.array_max(F.transform(body, lambda r: F.size(r)))
            line = lambda n: F.transform(body, lambda r: F.concat(F.lit("| "), F.array_join(F.slice(F.concat(texts(r), F.array_repeat(F.lit(""), n)), 1, n), " | "), F.lit(" |")))
            rule = lambda n: F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), n), " | "), F.lit(" |"))
            return bound(n, lambda n: F.struct(line(n).alias("lines"), rule(n).alias("rule"), s["is_caption"].alias("is_caption"), s["caption"].alias("caption")))

        return bound(F.when(s["is_caption"], rest(s["rows"])).otherwise(s["rows"]), lines)

    def joined(s: Column) -> Column:
        table = F.array_join(F.concat(F.slice(s["lines"], 1, 1), F.array(s["rule"]), rest(s["lines"])), "\n")
        head = F.when(s["is_caption"], F.concat(F.lit("**"), s["caption"], F.lit("**\n"))).otherwise("")
        return F.when(F.size(s["lines"]) == 0, head).otherwise(F.concat(head, F.when(s["is_caption"], "\n").otherwise(""), table))

    return bound(rows, lambda own: F.when(F.size(own) == 0, "").otherwise(bound(bound(captioned(own), drawn), joined)))


def table_md(t: Column) -> Column:
    return rows_md(table_rows(t["cells"]), width(t))


def text_lines(t: Column) -> Column:
    """Lines of a text with white space collapsed, blank ones dropped."""
    return F.filter(F.transform(F.split(t, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]", -1), lambda x: collapsed(F.regexp_replace(x, r"[\x07\t]+", " "))), lambda x: x != "")


def box_md(t: Column) -> Column:
    def drawn(lines: Column) -> Column:
        rest = F.transform(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: F.concat(F.lit("\n| "), x, F.lit(" |")))
        return F.when(F.size(lines) == 0, "").otherwise(F.concat(F.lit("| "), F.element_at(lines, 1), F.lit(" |\n| --- |"), F.array_join(rest, "")))

    return bound(text_lines(t), drawn)


def legend(b: Column, tables: Column) -> Column:
    """Small text right below a table."""
    below = lambda t: (b["y0"] >= t["y1"] - LEGEND_UP) & (b["y0"] - t["y1"] <= LEGEND_DOWN) & (b["x0"] >= t["x0"] - LEGEND_SIDE) & (b["x1"] <= t["x1"] + LEGEND_SIDE)
    return (b["max_size"] >= LEGEND_SIZE) & F.exists(tables, below)


def box_title(r: Column, blocks: Column) -> Column:
    """Text of the first block in document order that stands right above the box; null without one."""
    above = F.filter(blocks, lambda b: (b["y1"] <= r["y0"]) & (b["y1"] >= r["y0"] - TITLE_UP) & (b["x0"] >= r["x0"] - TITLE_SIDE) & (b["x1"] <= r["x1"] + TITLE_SIDE))
    return F.try_element_at(F.filter(F.transform(above, lambda b: collapsed(block_text(b))), lambda t: t != ""), F.lit(1))


def _strip(bx: Column, other: Column) -> Column:
    text, title = strip_key(bx["md"]), strip_key(F.coalesce(other["title"], F.lit("")))
    shaped = (height(bx) <= d(STRIP_SHAPE) * width(bx)) & (F.length(text) >= STRIP_TEXT)
    under = (bx["y1"] - STRIP_UP <= other["y0"]) & (other["y0"] <= bx["y1"] + STRIP_DOWN)
    across = F.least(bx["x1"], other["x1"]) - F.greatest(bx["x0"], other["x0"]) >= d(STRIP_WIDTH) * width(bx)
    return (bx["seq"] != other["seq"]) & shaped & under & across & (F.length(title) >= STRIP_TITLE) & title.startswith(text)


def dedup_boxes(boxes: Column, kind: str) -> Column:
    """Largest first, a box is kept unless one kept before covers most of it."""
    ordered = F.transform(F.array_sort(F.transform(F.filter(boxes, lambda b: area(b) > 0), lambda b, i: F.struct((-area(b)).alias("a"), i.alias("i"), b.alias("b")))), lambda x: x["b"])
    keep = lambda done, b: F.when(F.exists(done, lambda k: overlap_area(b, k) / area(b) >= d(DUPLICATE)), done).otherwise(F.concat(done, F.array(b)))
    return F.aggregate(ordered, F.array().cast(kind), keep)


BOXES = "array<struct<seq:int,x0:double,y0:double,x1:double,y1:double,title:string,md:string>>"


def boxes(drawings: Column, blocks: Column, tables: Column, zones: Column, page_width: Column, page_height: Column) -> Column:
    """Bordered boxes with their title and markdown."""
    def real(r: Column) -> Column:
        w, h = width(r), height(r)
        frame = (w > d(FRAME) * page_width) | (h > d(FRAME) * page_height)
        off = (r["y0"] < -EDGE) | (r["y1"] > page_height + EDGE)
        bar = (w >= d(BAR_SHARE) * page_width) & ((r["y0"] < BAR) | (r["y1"] > page_height - BAR))
        in_table = F.exists(tables, lambda t: overlap_area(r, t) / area(r) >= d(IN_TABLE))
        text = stripped(F.coalesce(r["text"], F.lit("")))
        lines = F.size(F.filter(F.split(text, "\\n", -1), lambda x: x.rlike(r"[^\s\p{Z}]")))
        return r["kind"].isin(*BOX_KINDS) & (w >= BOX_WIDTH) & (h >= BOX_HEIGHT) & ~frame & ~off & ~bar & ~excluded(r, zones) & ~in_table & (text != "") & ((lines >= 2) | (F.length(text) >= BOX_TEXT))

    made = F.transform(F.filter(drawings, real), lambda r: F.struct(r["seq"].alias("seq"), *(r[k].alias(k) for k in ("x0", "y0", "x1", "y1")), box_title(r, blocks).alias("title"), box_md(stripped(r["text"])).alias("md")))
    return bound(made, lambda own: F.filter(own, lambda b: ~F.exists(own, lambda o: _strip(b, o))))
