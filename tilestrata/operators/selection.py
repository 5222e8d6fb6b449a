"""Selections as (x, y, cov) relations, and their algebra."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tilestrata.functions.color import limit, smoothstep
from tilestrata.operators.tiles import Rect, grid

MAX_FEATHER, MAX_MORPH = 1000.0, 10_000


def rect(spark: SparkSession, r: Rect) -> DataFrame:
    return grid(spark, r).withColumn("cov", F.lit(1.0))


def ellipse(spark: SparkSession, r: Rect) -> DataFrame:
    """Anti-aliased ellipse in r."""
    if r.empty:
        return rect(spark, r)
    rx, ry = r.w / 2.0, r.h / 2.0
    aa = 0.5 / max(rx, ry)
    dx, dy = (F.col("x") + 0.5 - (r.x + rx)) / rx, (F.col("y") + 0.5 - (r.y + ry)) / ry
    return grid(spark, r).withColumn("cov", smoothstep(1.0 + aa, 1.0 - aa, dx * dx + dy * dy)).filter("cov > 0")


def ellipses(rects: DataFrame) -> DataFrame:
    """(id, x, y, cov) of the anti-aliased ellipses in many rectangles (id, x, y, w, h); empty ones have none."""
    rows = rects.filter("w > 0 AND h > 0").select("id", F.col("x").alias("x0"), F.col("y").alias("y0"), "w", "h")
    rows = rows.withColumn("y", F.explode(F.sequence("y0", F.col("y0") + F.col("h") - 1))).withColumn("x", F.explode(F.sequence("x0", F.col("x0") + F.col("w") - 1)))
    rx, ry = F.col("w") / 2.0, F.col("h") / 2.0
    aa = 0.5 / F.greatest(rx, ry)
    dx, dy = (F.col("x") + 0.5 - (F.col("x0") + rx)) / rx, (F.col("y") + 0.5 - (F.col("y0") + ry)) / ry
    t = limit((dx * dx + dy * dy - (1.0 + aa)) / (-2.0 * aa))
    return rows.select("id", "x", "y", (t * t * (3.0 - 2.0 * t)).alias("cov")).filter("cov > 0")


def polygons(edges: DataFrame) -> DataFrame:
    """(path, x, y, cov) inside many closed outlines given as edges (path, ax, ay, bx, by), by the rule of polygon()."""
    e = edges.filter("ay <> by").withColumn("y", F.explode(F.sequence(F.least("ay", "by"), F.greatest("ay", "by") - 1)))
    cross = e.select("path", "y", (F.col("ax") + (F.col("y") + 0.5 - F.col("ay")) / (F.col("by") - F.col("ay")) * (F.col("bx") - F.col("ax"))).alias("cx"))
    row = Window.partitionBy("path", "y").orderBy("cx")
    pair = cross.withColumns({"k": F.row_number().over(row), "end": F.lead("cx").over(row)}).filter("k % 2 = 1 and end is not null")
    size = edges.groupBy("path").agg(F.min("ax").alias("lo"), F.max("ax").alias("hi"))
    keep = lambda c: F.least(F.greatest(c, F.col("lo")), F.col("hi")).cast("int")
    span = pair.join(size, "path").select("path", "y", keep(F.ceil("cx")).alias("s"), keep(F.floor("end") + 1).alias("e")).filter("s < e")
    return span.select("path", F.explode(F.sequence("s", F.col("e") - 1)).alias("x"), "y").distinct().withColumn("cov", F.lit(1.0))


def polygon(spark: SparkSession, points: Sequence[tuple[int, int]]) -> DataFrame:
    """Even-odd scanline fill: edges meet rows, crossings of a row pair up in order."""
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    b = Rect(min(xs), min(ys), max(xs) - min(xs), max(ys) - min(ys)) if len(points) >= 3 else Rect(0, 0, 0, 0)
    edges = [(*p, *q) for p, q in zip(points, [*points[1:], points[0]], strict=True) if p[1] != q[1]] if not b.empty else []
    e = spark.createDataFrame(edges or [], "ax int, ay int, bx int, by int")
    e = e.select("*", F.explode(F.sequence(F.least("ay", "by"), F.greatest("ay", "by") - 1)).alias("y"))
    cross = e.select("y", (F.col("ax") + (F.col("y") + 0.5 - F.col("ay")) / (F.col("by") - F.col("ay")) * (F.col("bx") - F.col("ax"))).alias("cx"))
    row = Window.partitionBy("y").orderBy("cx")
    pair = cross.withColumns({"k": F.row_number().over(row), "end": F.lead("cx").over(row)}).filter("k % 2 = 1 and end is not null")
    keep = lambda c: F.least(F.greatest(c, F.lit(b.x)), F.lit(b.right)).cast("int")
    span = pair.select("y", keep(F.ceil("cx")).alias("s"), keep(F.floor("end") + 1).alias("e")).filter("s < e")
    return span.select(F.explode(F.sequence("s", F.col("e") - 1)).alias("x"), "y").distinct().withColumn("cov", F.lit(1.0))


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("x", "y").agg(F.max("cov").alias("cov"))


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.withColumnRenamed("cov", "c2"), ["x", "y"]).select("x", "y", F.least("cov", "c2").alias("cov")).filter("cov > 0")


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    out = a.join(b.withColumnRenamed("cov", "c2"), ["x", "y"], "left")
    return out.select("x", "y", F.greatest(F.col("cov") - F.coalesce("c2", F.lit(0.0)), F.lit(0.0)).alias("cov")).filter("cov > 0")


def invert(a: DataFrame, canvas: Rect) -> DataFrame:
    out = grid(a.sparkSession, canvas).join(a, ["x", "y"], "left")
    return out.select("x", "y", (1.0 - F.coalesce("cov", F.lit(0.0))).alias("cov")).filter("cov > 0")


def combine(mode: str, a: DataFrame, b: DataFrame) -> DataFrame:
    return {"replace": lambda: b, "add": lambda: union(a, b), "subtract": lambda: subtract(a, b), "intersect": lambda: intersect(a, b)}[mode]()


def _spread(sel: DataFrame, axis: str, n: int) -> DataFrame:
    """Each row repeated at every place within n along an axis, with its distance d."""
    return sel.withColumn("d", F.explode(F.sequence(F.lit(-n), F.lit(n)))).withColumn(axis, F.col(axis) + F.col("d"))


def feather(a: DataFrame, radius: float) -> DataFrame:
    """Separable Gaussian, zero outside; two passes of partial sums."""
    radius = min(radius, MAX_FEATHER)
    if radius <= 0:
        return a
    k = math.ceil(3 * radius)
    weights = [math.exp(-(i * i) / (2 * radius * radius)) for i in range(-k, k + 1)]
    kernel = F.array(*[F.lit(w / sum(weights)) for w in weights])
    for axis in "xy":
        a = _spread(a, axis, k).groupBy("x", "y").agg(F.sum(F.col("cov") * F.element_at(kernel, F.col("d") + k + 1)).alias("cov"))
    return a.filter("cov > 0")


def grow(a: DataFrame, n: int) -> DataFrame:
    """Square maximum filter, one axis after the other."""
    for axis in "xy":
        a = _spread(a, axis, min(n, MAX_MORPH)).groupBy("x", "y").agg(F.max("cov").alias("cov"))
    return a


def shrink(a: DataFrame, n: int) -> DataFrame:
    """Square minimum filter: places whose whole window is selected keep its least coverage."""
    n = min(n, MAX_MORPH)
    for axis in "xy":
        a = _spread(a, axis, n).groupBy("x", "y").agg(F.min("cov").alias("cov"), F.count(F.lit(1)).alias("k")).filter(F.col("k") == 2 * n + 1).select("x", "y", "cov")
    return a


def outline_edges(a: DataFrame) -> DataFrame:
    """Unit edges (x0, y0, x1, y1) between places with coverage of at least one half and others."""
    on = a.filter("cov >= 0.5").select("x", "y")
    sides = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("nx", "ny", "x0", "y0", "x1", "y1"), s, strict=True)]) for s in ((-1, 0, 0, 0, 0, 1), (1, 0, 1, 0, 1, 1), (0, -1, 0, 0, 1, 0), (0, 1, 0, 1, 1, 1))])
    near = on.withColumn("s", F.explode(sides)).select((F.col("x") + F.col("s.nx")).alias("ox"), (F.col("y") + F.col("s.ny")).alias("oy"), *[(F.col(c[0]) + F.col(f"s.{c}")).alias(c) for c in ("x0", "y0", "x1", "y1")])
    return near.join(on.select(F.col("x").alias("ox"), F.col("y").alias("oy")), ["ox", "oy"], "left_anti").select("x0", "y0", "x1", "y1")


def clamped(a: DataFrame) -> DataFrame:
    return a.withColumn("cov", limit(F.col("cov")))


def selected_tiles(a: DataFrame, dx: int = 0, dy: int = 0) -> DataFrame:
    """(tx, ty) of the tiles of a layer at an offset that the selection touches."""
    at = lambda c, d: F.shiftright(F.col(c) - d, 8)
    return a.filter("cov > 0").select(at("x", dx).alias("tx"), at("y", dy).alias("ty")).distinct()


def coverage_at(a: DataFrame, x: int, y: int) -> DataFrame:
    """One row: the coverage of a place, 0 where there is none."""
    return a.filter((F.col("x") == x) & (F.col("y") == y)).agg(F.coalesce(F.max("cov"), F.lit(0.0)).alias("cov"))


def fingerprint(a: DataFrame) -> DataFrame:
    """One row: an order-free key of a selection's places and coverages."""
    return a.filter("cov > 0").agg(F.coalesce(F.bit_xor(F.xxhash64("x", "y", "cov")), F.lit(0).cast("long")).alias("key"), F.count(F.lit(1)).alias("n"))
