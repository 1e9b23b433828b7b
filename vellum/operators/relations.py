"""Keyed operators: outlines, edits, caches, latest results, debouncing, translation units."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import paragraphs, sentences, text_key, without_header

#: Units in one call of a translator.
UNITS_A_CALL = 500
#: Gaps in a slice of time.
SLICE_GAPS = 64


def _parents(levels: list[int]) -> list[int | None]:
    """Place of each entry's parent: the last one before it of a smaller level, kept on a stack of open entries."""
    out: list[int | None] = []
    held: list[int] = []
    for k, level in enumerate(levels):
        while held and levels[held[-1]] >= level:
            held.pop()
        out.append(held[-1] if held else None)
        held.append(k)
    return out


def outline_parents(toc: DataFrame, keys: list[str]) -> DataFrame:
    """Adds parent_seq: the last earlier entry of a smaller level (null: top). toc: keys, seq, level.

    A document's outline is one array, in order of seq; one pass over it with a stack finds all parents, so that
    time is linear in the outline. Levels under 0, and none, count as 0.
    """

    @F.pandas_udf("array<bigint>")
    def parents(seqs: pd.Series, levels: pd.Series) -> pd.Series:
        return pd.Series([[None if p is None else own[p] for p in _parents(list(x))] for own, x in zip(seqs, levels, strict=True)], dtype=object)

    entry = F.struct("seq", F.greatest(F.coalesce("level", F.lit(0)), F.lit(0)).cast("int").alias("level"))
    ordered = toc.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("es"))
    placed = ordered.withColumn("ps", parents(F.col("es.seq"), F.col("es.level")))
    found = placed.select(*keys, F.explode(F.arrays_zip(F.col("es.seq").alias("seq"), F.col("ps").alias("parent"))).alias("p"))
    return toc.join(found.select(*keys, "p.seq", F.col("p.parent").alias("parent_seq")), [*keys, "seq"])


def outline_position(pages: DataFrame, toc: DataFrame, keys: list[str]) -> DataFrame:
    """Adds toc_seq: the last entry, in outline order, before the first entry past the page (null: none).

    The running maximum of page_idx rises with seq, so the last entry whose running maximum is at most the
    page is found by counting inside one sorted array per document.
    """
    top = F.max("page_idx").over(Window.partitionBy(*keys).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    arrays = toc.withColumn("__top", top).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("seq", "__top"))).alias("__es"))
    before = F.filter("__es", lambda e: e["__top"] <= F.col("page_num"))
    return pages.join(arrays, keys, "left").withColumn("toc_seq", F.try_element_at(before, F.lit(-1))["seq"]).drop("__es")


def with_edits(texts: DataFrame, edits: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Adds shown: the saved edit of the text's body (by its key, header apart), else the text."""
    named = edits.select(*keys, F.col("key").alias("__key"), F.col("edited").alias("__edited"))
    return texts.withColumn("__key", text_key(without_header(F.col(text)))).join(named, [*keys, "__key"], "left").withColumn("shown", F.coalesce("__edited", text)).drop("__key", "__edited")


def missing(requests: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """Requests without a cached result of the same key (document, fingerprint, page, language, zones, ...)."""
    return requests.join(cache.select(*keys).distinct(), keys, "left_anti")


def invalidated(cache: DataFrame, stale: DataFrame, keys: list[str]) -> DataFrame:
    """The cache without the entries of the pages that were drawn on, or of another fingerprint."""
    return cache.join(stale.select(*keys).distinct(), keys, "left_anti")


def zones_key(exclude: Column, include: Column) -> Column:
    """Key of a page's zones, in drawn order; "()" without any."""
    return F.when((F.size(exclude) == 0) & (F.size(include) == 0), "()").otherwise(F.sha2(F.to_json(F.struct(exclude.alias("exclude"), include.alias("include"))), 256))


def latest(results: DataFrame, keys: list[str], generation: list[str]) -> DataFrame:
    """The row of the greatest generation for each key; partial aggregation, no window over a hot key."""
    rest = [c for c in results.columns if c not in keys]
    row = F.max_by(F.struct(*rest), F.struct(*generation))
    return results.groupBy(*keys).agg(row.alias("__row")).select(*keys, *(F.col(f"__row.{c}").alias(c) for c in rest))


def debounced(events: DataFrame, keys: list[str], at: str, tie: str, gap_seconds: float) -> DataFrame:
    """The last event of every burst: no other of its key follows within the gap. Events without a time go.

    Time is cut into slices of `SLICE_GAPS` gaps; an event is compared with the next one of its slice, and the last
    one of a slice with the first of the next slice that could follow within the gap. A key with very many events
    is so dealt to many tasks.
    """
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    gap = int(gap_seconds * 1_000_000)
    length = max(1, gap * SLICE_GAPS)
    cut = events.withColumn("__at", micros).where("__at is not null").withColumn("__slice", F.floor(F.col("__at") / length).cast("bigint"))
    following = F.lead("__at").over(Window.partitionBy(*keys, "__slice").orderBy(at, tie))
    heads = cut.groupBy(*keys, "__slice").agg(F.min("__at").alias("__head"))
    heads = heads.withColumn("__slice", F.col("__slice") - 1).alias("h")
    own = cut.withColumn("__next", following).alias("e")
    same = [F.col(f"e.{k}").eqNullSafe(F.col(f"h.{k}")) for k in [*keys, "__slice"]]
    joined = own.join(heads, same, "left")
    next_at = F.coalesce("e.__next", "h.__head")
    return joined.where(next_at.isNull() | (next_at - F.col("e.__at") > gap)).select(*(F.col(f"e.{c}") for c in events.columns))


def paragraph_units(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, para, unit: the paragraphs, from 0, in order."""
    return texts.select(*keys, F.posexplode(paragraphs(F.col(text))).alias("para", "unit"))


def chunked(unit: Column, size: int = 1500) -> Column:
    """Sentences packed into chunks: a chunk closes when the next one would pass the size (blanks not counted).
    One pass over the sentences of the units that are longer than a chunk."""

    @F.pandas_udf("array<string>")
    def packed(units: pd.Series) -> pd.Series:
        def one(parts: Iterable[str] | None) -> list[str] | None:
            if parts is None:
                return None
            out, held, n = [], [], 0
            for s in parts:
                if held and n + len(s) > size:
                    out.append(" ".join(held))
                    held, n = [], 0
                held.append(s)
                n += len(s)
            return [*out, " ".join(held)]

        return pd.Series([one(u) for u in units], dtype=object)

    long = F.length(unit) > size
    return F.when(F.length(unit) <= size, F.array(unit)).otherwise(packed(F.when(long, sentences(unit))))


def translated(texts: DataFrame, keys: list[str], translate: Callable[[list[str]], list[str | None]], text: str = "text", size: int = 1500, parts: int = 64) -> DataFrame:
    """keys, translated, failed (number of units), error (of one of them). Null texts stay null.

    Paragraphs are cut into units, equal units are translated once, and put back in order. `translate` gets a batch
    of units; if it fails for a batch, or gives another number of results, every unit is tried alone. A unit that
    fails, or for which it gives null, stays as it is. Tables and images inside a paragraph are protected (see
    `sources.translation`).

    Units meet by a 128-bit hash and a salt: neither long texts nor a paragraph that many documents share is the key.
    """
    from ..sources.translation import protected_units

    units = protected_units(texts, keys, text, size).withColumn("key", F.when(F.col("needed"), F.unhex(F.md5("unit")))).withColumn("salt", F.pmod(F.xxhash64(*keys, "part"), F.lit(parts)).cast("int"))

    def alone(unit: str) -> tuple[str, str | None]:
        try:
            got = translate([unit])[0]
        except Exception as e:  # noqa: BLE001  the translator is outside: this unit stays as it is
            return unit, f"{type(e).__name__}: {e}"
        return unit if got is None else got, None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), UNITS_A_CALL):
                some = b.iloc[at : at + UNITS_A_CALL]
                own = some["unit"].tolist()
                try:
                    got = [(o if g is None else g, None) for o, g in zip(own, translate(own), strict=True)]
                except Exception:  # noqa: BLE001  one bad unit must not lose the others
                    got = [alone(o) for o in own]
                yield pd.DataFrame({"key": some["key"].tolist(), "done": [g for g, _ in got], "error": pd.Series([e for _, e in got], dtype=object)})

    wanted = units.where("needed").groupBy("key").agg(F.first("unit").alias("unit")).mapInPandas(run, "key binary, done string, error string")
    known = units.where("needed").select("key", "salt").distinct().join(wanted, "key")
    joined = units.withColumn("unit", F.when(~F.col("needed"), F.col("unit"))).join(known, ["key", "salt"], "left").withColumn("done", F.coalesce("done", "unit"))
    out = joined.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("part", "done", "before"))).alias("us"), F.count("error").alias("failed"), F.max("error").alias("error"))
    whole = F.when(F.size("us") > 0, F.array_join(F.transform("us", lambda u: F.concat(u["before"], u["done"])), ""))
    empty = texts.where(F.col(text).isNull()).select(*keys, F.lit(None).cast("string").alias("translated"), F.lit(0).cast("long").alias("failed"), F.lit(None).cast("string").alias("error"))
    return out.select(*keys, whole.alias("translated"), "failed", "error").unionByName(empty)
