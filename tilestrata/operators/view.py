"""Looking at a document: screen coordinates, visible regions, grid lines and small previews."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilestrata.operators.resample import resample
from tilestrata.operators.tiles import Rect, bounds_of

#: The longest side of a visible region (fixed value).
LONGEST = 65_536


def to_screen(c: Column, pan: float, zoom: float, origin: float = 0.0) -> Column:
    return origin + (c - pan) * zoom


def to_document(c: Column, pan: float, zoom: float, origin: float = 0.0) -> Column:
    return pan + (c - origin) / zoom


def visible_region(views: DataFrame) -> DataFrame:
    """views (pan_x, pan_y, zoom, w, h) with x, y, vw and vh: the region seen, rounded outwards; longer sides than LONGEST are cut about their middle."""

    def side(pan: str, size: str) -> tuple[Column, Column]:
        lo, hi = F.floor(pan), F.ceil(F.col(pan) + F.col(size) / F.col("zoom"))
        return lo + F.floor(F.greatest(hi - lo - LONGEST, F.lit(0)) / 2), F.least(F.greatest(hi - lo, F.lit(0)), F.lit(LONGEST))

    (x, w), (y, h) = side("pan_x", "w"), side("pan_y", "h")
    return views.select("*", x.alias("x"), y.alias("y"), w.alias("vw"), h.alias("vh"))


def grid_lines(ranges: DataFrame, step: int) -> DataFrame:
    """ranges (lo, hi) with the places of the grid lines in them, one row a line; no step, no lines."""
    if step <= 0:
        return ranges.withColumn("at", F.lit(0).cast("long")).limit(0)
    first, last = F.floor(F.floor("lo") / step) * step, F.floor(F.ceil("hi") / step) * step
    return ranges.filter("lo <= hi").withColumn("at", F.explode(F.sequence(first, last, F.lit(step).cast("long"))))


def preview(px: DataFrame, change: Callable[[DataFrame, Rect, float], DataFrame], longest: int) -> DataFrame:
    """A filter on a copy of at most `longest` places a side, anchored at (0, 0); change gets the copy, its window and the scale, by which it shrinks radii.

    The scale is longest / the longer side, where that is longer; sides are rounded up (in whole numbers), and places sample bilinearly what lies at them / the scale.
    """
    b = bounds_of(px)
    if b is None or longest <= 0:
        return px.limit(0)
    scale = min(1.0, longest / max(b.w, b.h))
    proxy = resample(px, (scale, 0.0, 0.0, scale, -b.x * scale, -b.y * scale), b, "bilinear")
    side = lambda n: n if scale == 1.0 else -(-n * longest // max(b.w, b.h))
    return change(proxy, Rect(0, 0, side(b.w), side(b.h)), scale)
