"""The page relation: one row per page, its parts as arrays, so that page operators need no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import d

SPAN = "struct<text:string,size:double,bold:boolean,italic:boolean>"
RECT = "x0:double,y0:double,x1:double,y1:double"
BLOCK = f"struct<block_id:int,{RECT},max_size:double,lines:array<array<{SPAN}>>>"
LINE = f"struct<line_id:int,blk:int,{RECT},max_size:double,spans:array<{SPAN}>>"
CELL = f"struct<{RECT},text:string>"
TABLE = f"struct<table_id:int,{RECT},row_count:int,col_count:int,cells:array<{CELL}>>"
DRAWING = f"struct<seq:int,kind:string,{RECT},text:string>"
ZONE = f"struct<{RECT}>"
IMAGE = f"struct<seq:int,{RECT},ext:string,data:binary>"
#: Every column of the page relation; a decoder makes it, missing parts are empty arrays.
PAGE = {
    "doc_id": "bigint", "page_num": "int", "width": "double", "height": "double", "blocks": f"array<{BLOCK}>", "lines": f"array<{LINE}>",
    "tables": f"array<{TABLE}>", "drawings": f"array<{DRAWING}>", "exclude": f"array<{ZONE}>", "include": f"array<{ZONE}>", "raw": "string",
    "images": f"array<{IMAGE}>",
}
PAGE_DDL = ", ".join(f"{k} {v}" for k, v in PAGE.items())
WIDTH, HEIGHT = 595.0, 842.0


def complete(pages: DataFrame) -> DataFrame:
    """Adds what a decoder left out: empty arrays, and the null raw text."""
    have = set(pages.columns)
    fill = {k: (F.array() if v.startswith("array") else F.lit(None)).cast(v) for k, v in PAGE.items()}
    return pages.select(*((F.coalesce(F.col(k).cast(v), fill[k]) if v.startswith("array") else F.col(k).cast(v)) .alias(k) if k in have else fill[k].alias(k) for k, v in PAGE.items()))


def block_from_lines(lines: Column, block_id: Column) -> Column:
    """A block from consecutive lines: the union of boxes, the largest size, the lines' spans."""
    least = lambda k: F.array_min(F.transform(lines, lambda x: x[k]))
    most = lambda k: F.array_max(F.transform(lines, lambda x: x[k]))
    return F.struct(block_id.alias("block_id"), least("x0").alias("x0"), least("y0").alias("y0"), most("x1").alias("x1"), most("y1").alias("y1"), most("max_size").alias("max_size"), F.transform(lines, lambda x: x["spans"]).alias("lines"))


def fused_hyphens(lines: Column) -> Column:
    """Words broken over lines are joined: a span ending in "-" takes a lower-case span that starts the next line."""
    empty = F.array().cast(f"array<array<{SPAN}>>")

    def step(done: Column, line: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        end = F.try_element_at(last, F.lit(-1))
        head = F.try_element_at(line, F.lit(1))
        joins = F.coalesce(end["text"].endswith("-") & (F.length(end["text"]) > 1) & head["text"].rlike(r"^\p{Ll}"), F.lit(False))
        grown = F.struct(F.concat(F.substr(end["text"], F.lit(1), F.length(end["text"]) - 1), head["text"]).alias("text"), end["size"].alias("size"), end["bold"].alias("bold"), end["italic"].alias("italic"))
        before = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
        merged = F.concat(before, F.array(F.concat(F.slice(last, 1, F.greatest(F.size(last) - 1, F.lit(0))), F.array(grown))))
        rest = F.slice(line, 2, F.greatest(F.size(line) - 1, F.lit(0)))
        return F.when(joins, F.when(F.size(rest) > 0, F.concat(merged, F.array(rest))).otherwise(merged)).otherwise(F.concat(done, F.array(line)))

    return F.aggregate(lines, empty, step)


def cleaned_blocks(blocks: Column) -> Column:
    """Blank spans, empty lines and empty blocks go; sizes are taken over what stays; hyphens are fused."""
    def clean(b: Column) -> Column:
        lines = F.filter(F.transform(b["lines"], lambda line: F.filter(line, lambda s: s["text"].rlike(r"[^\s\p{Z}]"))), lambda line: F.size(line) > 0)
        return F.struct(b["block_id"].alias("block_id"), *(b[k].alias(k) for k in ("x0", "y0", "x1", "y1")), F.coalesce(F.array_max(F.transform(F.flatten(lines), lambda s: s["size"])), d(0)).alias("max_size"), fused_hyphens(lines).alias("lines"))

    return F.filter(F.transform(blocks, clean), lambda b: F.size(b["lines"]) > 0)


def project(docs: DataFrame) -> DataFrame:
    """A made layout of `documents` (doc_id, text): one page a document, one block a non-blank line, 1 to 4
    columns by doc_id. It exercises the operators and says nothing about real pages."""
    ncols = F.lit(1) + F.pmod(F.col("doc_id"), F.lit(4))

    def block(x: Column) -> Column:
        i, line = x["i"], x["line"]
        n, size = F.length(line), F.length(line) % 12
        full, col = (i % 11) == 10, i % ncols
        step, top = d(495) / ncols, d(60) + ((i - i % ncols) / ncols) * d(24)
        left = F.when(full, d(50)).otherwise(d(50) + col * step + (n % 5))
        right = F.when(full, d(545)).otherwise(d(50) + col * step + step - d(20) - (i % 7))
        font = d(5) + size
        span = F.struct(line.alias("text"), font.alias("size"), ((i % 5) == 0).alias("bold"), F.lit(False).alias("italic"))
        return F.struct(i.cast("int").alias("block_id"), left.alias("x0"), top.alias("y0"), right.alias("x1"), (top + d(8) + size).alias("y1"), font.alias("max_size"), F.array(F.array(span)).alias("lines"))

    numbered = F.transform(F.split(F.coalesce("text", F.lit("")), "\\n", -1), lambda line, i: F.struct(i.alias("i"), line.alias("line")))
    blocks = F.transform(F.filter(numbered, lambda x: F.length(F.trim(x["line"])) > 0), block)
    return complete(docs.select("doc_id", F.lit(0).alias("page_num"), d(WIDTH).alias("width"), d(HEIGHT).alias("height"), blocks.alias("blocks"), F.col("text").alias("raw")))
