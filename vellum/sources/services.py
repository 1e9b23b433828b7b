"""Requests to and responses of translation services as columns; sending them is left to a pluggable function."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import service_language

#: Addresses of the services and the parameters they ask for.
FIRST_URL, SECOND_URL = "https://translate.googleapis.com/translate_a/single", "https://edge.microsoft.com/translate/translatetext"
SECOND_ENGINE = "microsoft"


def _query(url: str, pairs: list[tuple[str, Column]]) -> Column:
    """The address with its parameters; a null value leaves its parameter out."""
    parts = F.array_compact(F.array(*(F.when(v.isNotNull(), F.concat(F.lit(f"{k}="), F.url_encode(v))) for k, v in pairs)))
    return F.concat(F.lit(f"{url}?"), F.array_join(parts, "&"))


def request(engine: Column, text: Column, source: Column, target: Column) -> Column:
    """struct(method, url, body) of one unit; an engine that is not the second is the first."""
    first = F.struct(F.lit("GET").alias("method"), _query(FIRST_URL, [("client", F.lit("gtx")), ("sl", source), ("tl", target), ("dt", F.lit("t")), ("q", text)]).alias("url"), F.lit(None).cast("string").alias("body"))
    known = F.when((source != "") & (source != "auto"), service_language(source))
    second = F.struct(F.lit("POST").alias("method"), _query(SECOND_URL, [("isEnterpriseClient", F.lit("False")), ("to", service_language(target)), ("from", known)]).alias("url"), F.to_json(F.array(text)).alias("body"))
    return F.when(engine == SECOND_ENGINE, second).otherwise(first)


def response(engine: Column, body: Column, text: Column) -> Column:
    """The translation in a response body; the unit itself where the body holds none."""
    parts = F.from_json(F.get_json_object(body, "$[0]"), "array<array<string>>")
    first = F.array_join(F.filter(F.transform(parts, lambda p: F.try_element_at(p, F.lit(1))), lambda t: t.isNotNull() & (t != "")), "")
    second = F.get_json_object(body, "$[0].translations[0].text")
    return F.coalesce(F.when(engine == SECOND_ENGINE, second).otherwise(F.when(F.size(parts) > 0, first)), text)
