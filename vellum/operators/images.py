"""Drawn zones and the images under them: which image a zone means, what is captured, and a document's gallery."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import area, covered_by, height, normalised, scaled, width

#: Least size of a drawn zone in scene pixels and in points.
LEAST_PIXELS, LEAST_POINTS = 4.0, 1.0
CAPTURED = "data binary, ext string, error string"
#: (bytes, ext) of an image to PNG bytes, or None if it can not be converted.
ToPng = Callable[[bytes, str], "bytes | None"]
#: (document bytes, page, (x0, y0, x1, y1), zoom) to PNG bytes.
Render = Callable[[bytes, int, tuple[float, float, float, float], float], "bytes | None"]


def large_enough(r: Column, least: float) -> Column:
    return (width(r) >= least) & (height(r) >= least)


def drawn_zone(corners: Column, scale: Column | float) -> Column:
    """The zone in points of a rectangle drawn in scene pixels from any corner; null where it is too small."""
    own = normalised(corners)
    factor = F.when(F.lit(scale) != 0, F.lit(scale)).otherwise(1.0) if isinstance(scale, (int, float)) else F.when(scale != 0, scale).otherwise(1.0)
    points = scaled(own, 1 / factor)
    return F.when(large_enough(own, LEAST_PIXELS) & large_enough(points, LEAST_POINTS), points)


def holds(zone: Column, r: Column) -> Column:
    return (r["x0"] >= zone["x0"]) & (r["y0"] >= zone["y0"]) & (r["x1"] <= zone["x1"]) & (r["y1"] <= zone["y1"])


def inside_images(images: Column, zone: Column) -> Column:
    """Places (from 0) of the images that a zone holds whole, in image order."""
    return F.filter(F.transform(images, lambda r, i: F.when(holds(zone, r), i)), lambda i: i.isNotNull())


def targets_image(images: Column, zone: Column) -> Column:
    """Whether at least half of any image lies in the zone."""
    return F.coalesce(F.exists(images, lambda r: covered_by(r, zone)), F.lit(False))


def regions(zones: DataFrame, pages: DataFrame) -> DataFrame:
    """`zones` (doc_id, page_num, seq, zone, captures) with `action` and `found`.

    A zone that captures (drawn to exclude) renders itself whole if it targets an image, and else takes nothing;
    any other zone takes the first image it holds whole that has bytes (`found`, in order), and renders itself
    without one. Zones under a point in a direction take nothing. `pages` has one row a page with `images`.
    """
    own = pages.select("doc_id", "page_num", "images")
    joined = zones.join(own, ["doc_id", "page_num"], "left")
    images = F.coalesce("images", F.expr("cast(array() as array<struct<seq:int,x0:double,y0:double,x1:double,y1:double,ext:string,data:binary>>)"))
    zone = F.col("zone")
    action = F.when(~large_enough(zone, LEAST_POINTS), "none").when(F.col("captures"), F.when(targets_image(images, zone), "render").otherwise("none")).otherwise("image")
    places = F.when(action == "image", inside_images(images, zone)).otherwise(F.expr("cast(array() as array<int>)"))
    return joined.select(*(F.col(c) for c in zones.columns), action.alias("action"), F.transform(places, lambda i: F.get(images, i)).alias("found"))


def captured(wanted: DataFrame, documents: DataFrame, to_png: ToPng, render: Render, zoom: float = 2.0) -> DataFrame:
    """The result of `regions` with data, ext and error: image bytes as PNG, the raw bytes where conversion gives
    nothing, or the rendered zone. `documents` has doc_id and content; rows without action go."""
    names = [c for c in wanted.columns if c != "found"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for row in b.itertuples(index=False):
                data, ext, error = None, None, None
                try:
                    for r in row.found if row.action == "image" else ():
                        raw, kind = r["data"], (r["ext"] or "png").lower()
                        done = _tried(to_png, bytes(raw), kind) if raw else None
                        data, ext = (done, "png") if done else (bytes(raw), kind) if raw else (None, None)
                        if data:
                            break
                    if data is None:
                        z = row.zone
                        data, ext = render(bytes(row.content), row.page_num, (z["x0"], z["y0"], z["x1"], z["y1"]), zoom), "png"
                except Exception as e:  # noqa: BLE001  one damaged document must not end the job
                    data, ext, error = None, None, f"{type(e).__name__}: {e}"
                out.append((*(getattr(row, n) for n in names), data, ext if data else None, error))
            yield pd.DataFrame(out, columns=[*names, "data", "ext", "error"])

    rows = wanted.where("action <> 'none'").join(documents.select("doc_id", "content"), "doc_id").select(*names, "found", "content")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wanted.schema if f.name != "found")
    return rows.mapInPandas(run, f"{schema}, {CAPTURED}")


def _tried(to_png: ToPng, raw: bytes, kind: str) -> bytes | None:
    try:
        return to_png(raw, kind)
    except Exception:  # noqa: BLE001  the raw bytes are used then
        return None


def gallery(captures: DataFrame, removed: DataFrame) -> DataFrame:
    """doc_id and uris: a document's captures in order of `seq`, without those removed (doc_id, uri)."""
    left = captures.join(removed.select("doc_id", "uri").distinct(), ["doc_id", "uri"], "left_anti")
    ordered = left.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "uri"))).alias("us"))
    return ordered.select("doc_id", F.transform("us", lambda u: u["uri"]).alias("uris"))
