"""Side files of older versions, read tolerantly and migrated to keyed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Engines and languages that keys may name.
ENGINES = ("google", "microsoft")
LANGUAGES = ("it", "en", "fr", "de", "es", "pt", "nl", "pl", "ru", "zh", "ja", "ko", "ar", "tr")
RAW_MAP = "map<string,string>"


def _file(spark: SparkSession, path: str, fingerprint: Column | None = None) -> DataFrame:
    """path and a map of pages to their JSON; files that are damaged, or of another fingerprint, give nothing."""
    raw = spark.read.format("binaryFile").load(path).select("path", F.col("content").cast("string").alias("t"))
    rows = raw.select("path", F.from_json("t", "fingerprint string, pages map<string,string>").alias("j")).where("j.pages is not null")
    rows = rows.select("path", F.col("j.fingerprint").alias("fingerprint"), F.explode("j.pages").alias("page", "value")).where(F.col("page").rlike(r"^\s*[-+]?\d+\s*$"))
    return rows if fingerprint is None else rows.where(F.col("fingerprint") == fingerprint)


def _is_object(v: Column) -> Column:
    return F.coalesce(F.trim(v).startswith("{"), F.lit(False))


def translations(spark: SparkSession, path: str, fingerprint: Column | None = None) -> DataFrame:
    """path, fingerprint, page_num, engine, target, text of all known versions of a translation cache.

    A plain text, and an object with cleaned or origin, are Italian by the first engine; an object of
    targets is by the first engine; keys of the form engine:target are taken where both are known.
    """
    rows = _file(spark, path, fingerprint).withColumn("page_num", F.trim("page").cast("int"))
    by = F.from_json("value", RAW_MAP)
    old = F.col("m").isNotNull() & (F.array_contains(F.map_keys("m"), "origin") | F.array_contains(F.map_keys("m"), "cleaned"))
    rows = rows.withColumn("m", F.when(_is_object(F.col("value")), by))
    entry = lambda k, v: F.struct(k.alias("key"), v.alias("text"))
    first = F.coalesce(F.when(F.col("m.cleaned") != "", F.col("m.cleaned")), F.col("m.origin"))
    entries = F.when(F.col("m").isNull(), F.array(entry(F.lit("google:it"), F.col("value")))).when(old, F.array(entry(F.lit("google:it"), first))).otherwise(F.transform(F.map_entries("m"), lambda e: entry(F.when(e["key"].contains(":"), e["key"]).otherwise(F.concat(F.lit("google:"), e["key"])), e["value"])))
    out = rows.select("path", "fingerprint", "page_num", F.explode(entries).alias("e"))
    engine, target = F.substring_index("e.key", ":", 1), F.regexp_replace("e.key", "^[^:]*:", "")
    return out.select("path", "fingerprint", "page_num", engine.alias("engine"), target.alias("target"), F.col("e.text").alias("text")).where(F.col("engine").isin(*ENGINES) & F.col("target").isin(*LANGUAGES) & F.col("text").isNotNull())


def extractions(spark: SparkSession, path: str, fingerprint: Column | None = None) -> DataFrame:
    """path, fingerprint, page_num, ocr_lang, raw, text, label, elapsed of both versions of an extraction cache."""
    rows = _file(spark, path, fingerprint).where(_is_object(F.col("value"))).select("path", "fingerprint", F.trim("page").cast("int").alias("page_num"), F.explode(F.from_json("value", RAW_MAP)).alias("ocr_lang", "v"))
    j = F.from_json("v", "raw string, final array<string>")
    is_new = _is_object(F.col("v"))
    final = F.when(is_new & (F.size(j["final"]) == 3), j["final"])
    raw = F.when(is_new, j["raw"]).otherwise(F.col("v"))
    return rows.select("path", "fingerprint", "page_num", "ocr_lang", raw.alias("raw"), final[0].alias("text"), final[1].alias("label"), final[2].try_cast("double").alias("elapsed")).where("raw is not null or text is not null")
