"""Rectangle functions over struct columns with x0, y0, x1, y1 (doubles, origin at the top left)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The thresholds of the layout model, in points or as shares.
COVERAGE, TOLERANCE, FULL_WIDTH, LEAST_WIDTH, MARGIN_SHARE, MARGIN_MOST = 0.5, 2.0, 0.6, 25.0, 0.07, 70.0


def d(x: float) -> Column:
    """A double literal: thresholds are compared as doubles, never as decimals."""
    return F.lit(float(x))


def width(r: Column) -> Column:
    return r["x1"] - r["x0"]


def height(r: Column) -> Column:
    return r["y1"] - r["y0"]


def area(r: Column) -> Column:
    return width(r) * height(r)


def middle(r: Column) -> Column:
    return (r["x0"] + r["x1"]) / 2


def overlap_area(a: Column, b: Column) -> Column:
    across = F.greatest(d(0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
    down = F.greatest(d(0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))
    return across * down


def covered_by(r: Column, zone: Column, share: float = COVERAGE) -> Column:
    """Whether one zone holds the share of r's own area; a rectangle without area is never covered."""
    return F.when(area(r) > 0, overlap_area(r, zone) / area(r) >= share).otherwise(False)


def excluded(r: Column, zones: Column) -> Column:
    """Whether any single zone covers r; zones are never united."""
    return F.coalesce(F.exists(zones, lambda z: covered_by(r, z)), F.lit(False))


def inside(b: Column, r: Column, slack: float = TOLERANCE) -> Column:
    return (b["x0"] >= r["x0"] - slack) & (b["x1"] <= r["x1"] + slack) & (b["y0"] >= r["y0"] - slack) & (b["y1"] <= r["y1"] + slack)


def inside_any(b: Column, rects: Column) -> Column:
    return F.coalesce(F.exists(rects, lambda r: inside(b, r)), F.lit(False))


def side_by_side(a: Column, b: Column) -> Column:
    return (a["y0"] <= b["y1"]) & (b["y0"] <= a["y1"])


def margin_band(page_height: Column) -> Column:
    return F.least(d(MARGIN_SHARE) * page_height, d(MARGIN_MOST))


def clear_of_margins(b: Column, page_height: Column) -> Column:
    band = margin_band(page_height)
    return (band <= 0) | (b["y1"] > band) & (b["y0"] < page_height - band)


def normalised(r: Column) -> Column:
    """A rectangle drawn from any corner."""
    return F.struct(F.least(r["x0"], r["x1"]).alias("x0"), F.least(r["y0"], r["y1"]).alias("y0"), F.greatest(r["x0"], r["x1"]).alias("x1"), F.greatest(r["y0"], r["y1"]).alias("y1"))


def scaled(r: Column, factor: Column | float) -> Column:
    """Points to scene pixels (factor), or back (1 / factor)."""
    return F.struct(*((r[k] * factor).alias(k) for k in ("x0", "y0", "x1", "y1")))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))
