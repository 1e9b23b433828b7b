"""Translation units of markdown: prose, table cells; images and table furniture stay as they are."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

#: Images and the cells of a table's rule.
IMAGE = re.compile(r"!\[[^\]]*\]\([^)]*\)")
RULE = re.compile(r":?-{3,}:?")
RULE_MARKS = frozenset(" \t:|-")
SENTENCE = re.compile(r"(?<=[.!?])\s+")
LETTER, PLAIN_LETTER = re.compile(r"[^\W\d_]"), re.compile("[A-Za-z]")
UNITS = ArrayType(StructType([StructField("before", StringType()), StructField("unit", StringType()), StructField("needed", BooleanType())]))


def _barred(line: str) -> bool:
    own = line.strip()
    return len(own) > 1 and own[0] == own[-1] == "|"


def stretches(lines: list[str]) -> Iterator[tuple[bool, list[str]]]:
    """The lines in stretches of tables and of anything else. A table is a barred line, a rule below it (bars, dashes
    and colons), and all the barred lines that follow, one at least."""
    at = begin = 0
    while at + 2 < len(lines):
        rule = lines[at + 1].strip()
        if not (_barred(lines[at]) and _barred(rule) and len(rule) > 2 and RULE_MARKS.issuperset(rule) and _barred(lines[at + 2])):
            at += 1
            continue
        end = at + 2
        while end < len(lines) and _barred(lines[end]):
            end += 1
        if at > begin:
            yield False, lines[begin:at]
        yield True, lines[at:end]
        at = begin = end
    if begin < len(lines):
        yield False, lines[begin:]


def _table(lines: list[str]) -> list[tuple[str, str, bool]]:
    """Cells as units; images in them, and the rule, stay as they are."""
    out, gap = [], ""
    for line in map(str.strip, lines):
        cells = [c.strip() for c in line.strip("|").split("|")]
        if all(RULE.fullmatch(c) for c in cells):
            out.append((gap, line, False))
        else:
            for k, c in enumerate(cells):
                head, *rest = _around_images(c)
                out += [((f"{gap}| " if k == 0 else " | ") + head[0], *head[1:]), *rest]
            out.append((" |", "", False))
        gap = "\n"
    return out


def _around_images(cell: str) -> list[tuple[str, str, bool]]:
    out, at = [], 0
    for m in [*IMAGE.finditer(cell), None]:
        part = cell[at : m.start()] if m else cell[at:]
        if part or not (out or m):
            own = part.strip()
            lead = part[: len(part) - len(part.lstrip())]
            out.append((lead, own, bool(PLAIN_LETTER.search(own))))
            if tail := part[len(lead) + len(own) :]:
                out.append((tail, "", False))
        if m:
            out.append(("", m[0], False))
            at = m.end()
    return out


def _prose(text: str, size: int, gap: str = "") -> list[tuple[str, str, bool]]:
    """Images stay; the text around them is cut into chunks at sentence ends."""
    out, at = [], 0
    for m in [*IMAGE.finditer(text), None]:
        part = text[at : m.start()] if m else text[at:]
        if LETTER.search(part):
            held: list[str] = []
            chunks = [part]
            if len(part) > size:
                chunks = []
                for s in SENTENCE.split(part):
                    if held and sum(map(len, held)) + len(s) > size:
                        chunks.append(" ".join(held))
                        held = []
                    held.append(s)
                chunks.append(" ".join(held))
            out += [("" if k == 0 else " ", c, True) for k, c in enumerate(chunks)]
        elif part:
            out.append(("", part, False))
        if m:
            out.append(("", m[0], False))
            at = m.end()
    return [(gap + out[0][0], *out[0][1:]), *out[1:]] if out else [(gap, "", False)]


def units_of(text: str | None, size: int) -> list[tuple[str, str, bool]] | None:
    """(what stands before, unit, is it to be translated), in order; they join to the text again."""
    if text is None:
        return None
    out: list[tuple[str, str, bool]] = []
    for k, para in enumerate(text.split("\n\n")):
        gap = "\n\n" if k else ""
        if not para.strip():
            out.append((gap, para, False))
            continue
        parts = list(stretches(para.split("\n")))
        for i, (is_table, lines) in enumerate(parts):
            before = gap if i == 0 else ""
            if is_table:
                head, *rest = _table(lines)
                out += [(before + head[0], *head[1:]), *rest]
            else:
                own = "\n".join(lines) + ("\n" if i + 1 < len(parts) else "")
                out += _prose(own, size, before)
    return out


def protected_units(texts: DataFrame, keys: list[str], text: str, size: int) -> DataFrame:
    """keys, para, part, piece, before, unit, needed."""

    @F.pandas_udf(UNITS)
    def cut(t: pd.Series) -> pd.Series:
        return pd.Series([None if (u := units_of(x, size)) is None else [{"before": a, "unit": b, "needed": c} for a, b, c in u] for x in t], dtype=object)

    rows = texts.select(*keys, F.posexplode(cut(F.col(text))).alias("part", "u"))
    return rows.select(*keys, F.lit(0).alias("para"), "part", F.lit(0).alias("piece"), F.col("u.before").alias("before"), F.col("u.unit").alias("unit"), F.col("u.needed").alias("needed"))
