"""Strokes sampled by arc length: lengths of cubics by quadrature, lengths along polylines by a running sum.

Samples are (stroke_id, seq, px, py, pressure), any number of strokes in one job. A smoothed stroke is one cubic for each pair of samples (Catmull-Rom
tangents, mirrored at the ends); nothing is kept in order on a driver or in Python.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Nodes and weights on 0..1: lengths of cubics are good to about 1e-3 of a place for curves without cusps.
NODES, WEIGHTS = (v.tolist() for v in (lambda x, w: ((x + 1) / 2, w / 2))(*np.polynomial.legendre.leggauss(24)))


def curves(samples: DataFrame) -> DataFrame:
    """(stroke_id, seq, x0 .. y3, p0, p1): the cubic from each sample to the next, and the pressures at its ends."""
    order = Window.partitionBy("stroke_id").orderBy("seq")
    rows = samples.select("stroke_id", "seq", F.col("px").alias("x0"), F.col("py").alias("y0"), F.lead("px").over(order).alias("x3"), F.lead("py").over(order).alias("y3"), F.lag("px").over(order).alias("bx"), F.lag("py").over(order).alias("by"), F.lead("px", 2).over(order).alias("nx"), F.lead("py", 2).over(order).alias("ny"), F.col("pressure").alias("p0"), F.lead("pressure").over(order).alias("p1"))
    rows = rows.filter("x3 IS NOT NULL AND y3 IS NOT NULL AND x0 IS NOT NULL AND y0 IS NOT NULL")
    control = {}
    for c, b, n in (("x", "bx", "nx"), ("y", "by", "ny")):
        a, z = F.col(f"{c}0"), F.col(f"{c}3")
        control[f"{c}1"] = a + (z - F.coalesce(b, 2 * a - z)) / 6.0
        control[f"{c}2"] = z - (F.coalesce(n, 2 * z - a) - a) / 6.0
    return rows.withColumns(control).drop("bx", "by", "nx", "ny")


def length() -> Column:
    """Arc length of the cubic x0 .. y3."""
    nodes = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(k).alias("k")) for t, k in zip(NODES, WEIGHTS, strict=True)])

    def speed(t: Column, c: str) -> Column:
        p = [F.col(f"{c}{k}") for k in range(4)]
        return 3 * (1 - t) * (1 - t) * (p[1] - p[0]) + 6 * (1 - t) * t * (p[2] - p[1]) + 3 * t * t * (p[3] - p[2])

    return F.aggregate(nodes, F.lit(0.0), lambda total, n: total + n["k"] * F.hypot(speed(n["t"], "x"), speed(n["t"], "y")))


def resampled(samples: DataFrame, step: float) -> DataFrame:
    """(stroke_id, seq, i, x, y, pressure): each cubic cut into the fewest equal steps of its parameter that are at most `step` long on average; cubics without length give no points."""
    rows = curves(samples).withColumn("len", length()).filter("len > 0")
    rows = rows.withColumn("n", F.greatest(F.ceil(F.col("len") / step - 1e-6), F.lit(1)).cast("int"))
    rows = rows.withColumn("lo", F.when(F.row_number().over(Window.partitionBy("stroke_id").orderBy("seq")) == 1, 0).otherwise(1))
    rows = rows.withColumn("i", F.explode(F.sequence("lo", "n")))
    t = F.col("i") / F.col("n")
    s = 1.0 - t
    place = [(s * s * s * F.col(f"{c}0") + 3.0 * s * s * t * F.col(f"{c}1") + 3.0 * s * t * t * F.col(f"{c}2") + t * t * t * F.col(f"{c}3")).alias(c) for c in "xy"]
    return rows.select("stroke_id", "seq", "i", *place, (F.col("p0") + (F.col("p1") - F.col("p0")) * t).alias("pressure"))


def even(points: DataFrame, step: float, order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """(stroke_id, n, x, y): places at distances 0, step, 2 * step, ... along each polyline (stroke_id, order, x, y).

    Each chord holds the distances between the sums of lengths before and after it, so it gives its places by itself.
    """
    line = Window.partitionBy("stroke_id").orderBy(*order)
    rows = points.withColumns({"bx": F.lead("x").over(line), "by": F.lead("y").over(line)})
    rows = rows.withColumn("len", F.coalesce(F.hypot(F.col("bx") - F.col("x"), F.col("by") - F.col("y")), F.lit(0.0)))
    rows = rows.withColumn("from", F.sum("len").over(line.rowsBetween(Window.unboundedPreceding, 0)) - F.col("len"))
    lo, hi = F.ceil(F.col("from") / step - 1e-9), F.ceil((F.col("from") + F.col("len")) / step - 1e-9) - 1
    rows = rows.filter(F.col("len") > 0).withColumns({"lo": lo, "hi": hi}).filter("hi >= lo")
    rows = rows.withColumn("n", F.explode(F.sequence("lo", "hi")))
    t = (F.col("n") * step - F.col("from")) / F.col("len")
    return rows.select("stroke_id", "n", (F.col("x") + (F.col("bx") - F.col("x")) * t).alias("x"), (F.col("y") + (F.col("by") - F.col("y")) * t).alias("y"))
