"""Vector paths: shapes to vertices, vertices to pixels.

A path is a row (layer_id, path, vertices, closed, fill, stroke, width): vertices are an array of (x, y) in whole places, fill and
stroke are (r, g, b, a). Pixels are the fill with the stroke over it; of several paths on a place the last one counts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilestrata.operators.brush import bresenham, scanline_fill
from tilestrata.operators.raster import RGBA

COLOUR = "struct<r:double,g:double,b:double,a:double>"
SCHEMA = f"layer_id int, path int, vertices array<struct<x:int,y:int>>, closed boolean, fill {COLOUR}, stroke {COLOUR}, width double"


def edges_of(paths: DataFrame, closing: Column) -> DataFrame:
    """(all columns but vertices, k, ax, ay, bx, by) of the edges of each path; the closing edge where asked."""
    n = F.size("vertices")
    last = F.when(closing, n).otherwise(n - 1)
    rows = paths.filter(n >= 2).withColumn("k", F.explode(F.sequence(F.lit(0), last - 1)))
    a, b = F.get("vertices", F.col("k")), F.get("vertices", (F.col("k") + 1) % F.size("vertices"))
    return rows.withColumns({"ax": a["x"], "ay": a["y"], "bx": b["x"], "by": b["y"]}).drop("vertices")


def filled(paths: DataFrame) -> DataFrame:
    """(layer_id, path, x, y) inside each path of three vertices and more, clipped to its own columns."""
    some = paths.filter((F.col("fill.a") > 0) & (F.size("vertices") >= 3))
    key = F.struct("layer_id", "path")
    inside = scanline_fill(edges_of(some.select(key.alias("path"), "vertices"), F.lit(True)).select("path", "ax", "ay", "bx", "by"))
    xs = F.transform("vertices", lambda v: v["x"])
    span = some.select(key.alias("path"), F.array_min(xs).alias("lo"), F.array_max(xs).alias("hi"))
    return inside.join(span, "path").filter("x between lo and hi").select("path.layer_id", "path.path", "x", "y").distinct()


def stroked(paths: DataFrame) -> DataFrame:
    """(layer_id, path, k, x, y) on the outline: parallel lines at 0, +1, -1, +2, ... steps across each edge, as many as the width in whole places."""
    some = paths.filter((F.col("stroke.a") > 0) & (F.col("width") > 0) & (F.floor(F.col("width") + 0.5) >= 1))
    e = edges_of(some.select("layer_id", "path", "vertices", "closed", "width"), F.col("closed"))
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    long = F.greatest(F.sqrt((dx * dx + dy * dy).cast("double")), F.lit(1.0))
    e = e.withColumns({"ux": F.round(-dy / long).cast("int"), "uy": F.round(dx / long).cast("int"), "o": F.explode(F.sequence(F.lit(0), F.floor(F.col("width") + 0.5).cast("int") - 1))})
    side = (F.floor((F.col("o") + 1) / 2) * F.when(F.col("o") % 2 == 1, 1).otherwise(-1)).cast("int")
    at = lambda c, u: (F.col(c) + F.col(u) * side)
    lines = e.select("layer_id", "path", "k", at("ax", "ux").alias("x0"), at("ay", "uy").alias("y0"), at("bx", "ux").alias("x1"), at("by", "uy").alias("y1"))
    return bresenham(lines).select("layer_id", "path", "k", "x", "y").distinct()


def rasterize(paths: DataFrame) -> DataFrame:
    """(layer_id, x, y, r, g, b, a) of paths: a later path covers an earlier one, a stroke covers its fill."""
    both = filled(paths).select("layer_id", "path", F.lit(0).alias("top"), "x", "y").unionByName(stroked(paths).select("layer_id", "path", F.lit(1).alias("top"), "x", "y").distinct())
    last = both.groupBy("layer_id", "x", "y").agg(F.max(F.struct("path", "top")).alias("l"))
    ink = paths.select("layer_id", F.col("path").alias("_path"), "fill", "stroke")
    out = last.withColumnsRenamed({"layer_id": "_layer"}).join(ink, (F.col("_layer") == F.col("layer_id")) & (F.col("l.path") == F.col("_path")))
    return out.select("layer_id", "x", "y", *[F.when(F.col("l.top") == 1, F.col(f"stroke.{c}")).otherwise(F.col(f"fill.{c}")).alias(c) for c in RGBA])


def moved(paths: DataFrame, dx: int, dy: int) -> DataFrame:
    """Whole paths moved."""
    return paths.withColumn("vertices", F.transform("vertices", lambda v: F.struct((v["x"] + dx).alias("x"), (v["y"] + dy).alias("y"))))


def rectangle(x: int, y: int, w: int, h: int) -> list[tuple[int, int]]:
    return [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]


def ellipse(cx: float, cy: float, rx: float, ry: float, tolerance: float = 0.5) -> list[tuple[int, int]]:
    """An ellipse as a polygon that stays within tolerance of it."""
    r = max(rx, ry, tolerance)
    n = max(8, math.ceil(math.pi / math.acos(max(-1.0, 1.0 - tolerance / r))))
    return _whole([(cx + rx * math.cos(2 * math.pi * k / n), cy + ry * math.sin(2 * math.pi * k / n)) for k in range(n)])


def rounded_rectangle(x: float, y: float, w: float, h: float, radius: float, steps: int = 6) -> list[tuple[int, int]]:
    """A rectangle with quarter circles at its corners; the radius is at most half the shorter side."""
    r = max(0.0, min(radius, w / 2, h / 2))
    corners = [(x + w - r, y + r, -90), (x + w - r, y + h - r, 0), (x + r, y + h - r, 90), (x + r, y + r, 180)]
    return _whole([(cx + r * math.cos(math.radians(a + 90 * k / steps)), cy + r * math.sin(math.radians(a + 90 * k / steps))) for cx, cy, a in corners for k in range(steps + 1)])


def regular_polygon(cx: float, cy: float, radius: float, sides: int) -> list[tuple[int, int]]:
    """The first vertex points up."""
    return _whole([(cx + radius * math.sin(2 * math.pi * k / sides), cy - radius * math.cos(2 * math.pi * k / sides)) for k in range(max(3, sides))])


def cubic(p: list[tuple[float, float]], tolerance: float = 0.5) -> list[tuple[float, float]]:
    """Points on a cubic curve of four control points, so close together that chords stay within tolerance."""
    bend = max(math.hypot(a[0] - 2 * b[0] + c[0], a[1] - 2 * b[1] + c[1]) for a, b, c in (p[:3], p[1:]))
    n = max(1, math.ceil(math.sqrt(0.75 * bend / max(tolerance, 1e-3))))
    weigh = lambda t: ((1 - t) ** 3, 3 * t * (1 - t) ** 2, 3 * t * t * (1 - t), t**3)
    return [(sum(w * q[0] for w, q in zip(weigh(k / n), p, strict=True)), sum(w * q[1] for w, q in zip(weigh(k / n), p, strict=True))) for k in range(n + 1)]


def _whole(points: list[tuple[float, float]]) -> list[tuple[int, int]]:
    """Rounded, without repeats in a row."""
    out: list[tuple[int, int]] = []
    for x, y in points:
        q = (math.floor(x + 0.5), math.floor(y + 0.5))
        if not out or q != out[-1]:
            out.append(q)
    return out[:-1] if len(out) > 1 and out[0] == out[-1] else out
