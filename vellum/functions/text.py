"""Text functions as column expressions; patterns spell out Unicode classes (Java's short ones are ASCII)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space, word characters and the marks of the text model.
SPACE = r"[\s\p{Z}\x0b\x1c-\x1f\x85]"
WORD = r"[\p{L}\p{N}_]"
CAPTION = r"(?i)^[\s\p{Z}]*(table|fig(ure)?|box|exhibit|chart)(?![\p{L}\p{N}_])"
INDEX_ENTRY = r",[\s\p{Z}]*\p{Nd}{1,4}([–\-]\p{Nd}{1,4})?[a-z]?(?![\p{L}\p{N}_])"
NUMBERED = r"^[\s\p{Z}]*\p{Nd}+\."
LETTER = r"[\p{L}\p{Nl}\p{No}]"
TOKEN = r"@@[A-Z]+[0-9]+@@"
SEPARATOR_CELL = r"^:?-{3,}:?$"
HEADER_MARK, HEADER_BAR = "──", "│"


def collapsed(t: Column) -> Column:
    """Runs of white space become one blank, none at the ends."""
    return F.trim(F.regexp_replace(t, f"{SPACE}+", " "))


def stripped(t: Column) -> Column:
    return F.regexp_replace(t, f"^{SPACE}+|{SPACE}+$", "")


def dehyphenated(t: Column) -> Column:
    """A word broken by a hyphen and a line end is joined."""
    return F.regexp_replace(t, f"({WORD})-{SPACE}*\\n{SPACE}*({WORD})", "$1$2")


def strip_key(t: Column) -> Column:
    """Title matching: no soft hyphens, table bars and dashes as blanks, lower case."""
    return F.lower(collapsed(F.regexp_replace(F.replace(t, F.lit("­"), F.lit("")), "[|—-]", " ")))


def reading_key(t: Column) -> Column:
    """Alignment of two extractions: line-end hyphens closed, white space collapsed, lower case."""
    return F.trim(F.lower(F.regexp_replace(F.regexp_replace(t, f"-{SPACE}*\\n{SPACE}*", ""), f"{SPACE}+", " ")))


def spaced(t: Column) -> Column:
    """A bold number gets a blank before what follows it; so does a comma after an underscored word."""
    return F.regexp_replace(F.regexp_replace(t, r"\*\*(\p{Nd}+)\*\*(?=[^\s\p{Z}])", r"**$1** "), r"(_[^_]+_),", "$1, ")


def text_key(t: Column) -> Column:
    return F.sha1(t.cast("binary"))


def without_header(t: Column) -> Column:
    """The body below an extraction header line, else the text itself."""
    first = F.substring_index(t, "\n", 1)
    is_header = t.contains("\n") & first.startswith(HEADER_MARK) & first.contains(HEADER_BAR)
    return F.when(is_header, F.regexp_replace(F.substr(t, F.length(first) + 2), "^\\n+", "")).otherwise(t)


def header(elapsed_ms: Column, text: Column, label: Column, language: Column) -> Column:
    """The line that precedes an extracted text in the display."""
    return F.format_string("── %.1f ms │ %d chars │ %s │ %s ──\n\n", elapsed_ms, F.length(text), label, language)


def paragraphs(t: Column) -> Column:
    return F.split(t, "\\n\\n", -1)


def sentences(t: Column) -> Column:
    return F.split(t, f"(?<=[.!?]){SPACE}+", -1)


def cells(row: Column) -> Column:
    """Cells of a pipe-table row."""
    return F.transform(F.split(F.regexp_replace(stripped(row), r"^\|+|\|+$", ""), r"\|", -1), stripped)


def is_separator(row_cells: Column) -> Column:
    return F.forall(row_cells, lambda c: c.rlike(SEPARATOR_CELL))


def needs_translation(t: Column) -> Column:
    """Whether a letter stands outside protected tokens."""
    return F.regexp_replace(t, TOKEN, "").rlike(LETTER)


def tidy_tokens(t: Column) -> Column:
    return F.regexp_replace(t, r"@@\s*([A-Z]+)\s*(\d+)\s*@@", "@@$1$2@@")


def ocr_language(code: Column) -> Column:
    """The OCR engine's code: the usual set for none or "auto", English for unknown ones."""
    known = F.create_map(*(F.lit(x) for kv in OCR_CODES.items() for x in kv))
    return F.when(code.isNull() | code.isin("", "auto"), OCR_AUTO).otherwise(F.coalesce(known[code], F.lit("eng")))


def service_language(code: Column) -> Column:
    return F.when(code == "zh", "zh-Hans").otherwise(code)


#: Language codes of the OCR engine, and its set for unknown languages.
OCR_CODES = {
    "en": "eng", "it": "ita", "fr": "fra", "de": "deu", "es": "spa",
    "pt": "por", "nl": "nld", "pl": "pol", "ru": "rus", "zh": "chi_sim",
    "ja": "jpn", "ko": "kor", "ar": "ara", "tr": "tur",
}
OCR_AUTO = "eng+deu+fra+ita+spa+por+nld+pol+rus+tur+ara"
