"""Exact anti-aliased coverage of curved outlines, filled and stroked: DataFrame functions, and a kernel over Arrow batches for the edges of strokes.

A path is a row with `verbs`, an array of (v, p): v is M, L, Q, C or Z and p the numbers of its points (control points first). Curves become chords within a
tolerance. Coverage needs no ordered polygon: every edge is cut at rows and columns of places, and adds to a place the area
to its right inside it and, as a step, its height to all places right of it. So edges are summed by place with map-side combining, and
one running sum along a row gives the covered area of every place; between two places that edges touch it is constant.

Strokes become edges too, each chord by itself: both sides, the join before it, and caps at the ends of open outlines.

Defined results: verbs before the first M, with too few or with not finite numbers are left out; an outline that isn't closed
is closed for filling by its chord; outlines without length have no stroke; overlapping parts count once (`nonzero`) or
cancel (`evenodd`), which within a place that two edges share goes by the sum of both; where a curve is tighter than half the width,
the inner side of its stroke folds over. Paths without verbs, and empty tables, have no places.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tilestrata.operators.raster import RGBA

VERBS = "array<struct<v:string,p:array<double>>>"
#: Numbers of a verb.
NUMBERS = {"M": 2, "L": 2, "Q": 4, "C": 6, "Z": 0}
#: Longest miter, in halves of the width (a fixed value of the format).
MITER = 4.0
LEAST = 1e-9
#: Edges of strokes made at a time.
BATCH = 1 << 17


def segments(paths: DataFrame, key: str = "path") -> DataFrame:
    """(key, sub, k, closes, x0 .. y3): the cubic of every verb that draws; lines and quadratics are raised to cubics."""
    rows = paths.select(key, F.posexplode("verbs").alias("k", "s")).select(key, "k", F.upper("s.v").alias("v"), F.coalesce("s.p", F.array().cast("array<double>")).alias("p"))
    size = F.element_at(F.create_map(*[F.lit(x) for kv in NUMBERS.items() for x in kv]), F.col("v"))
    finite = F.forall("p", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < 1e9))
    rows = rows.filter(size.isNotNull() & (F.size("p") >= size) & finite)
    order = Window.partitionBy(key).orderBy("k")
    point = F.when(F.col("v") != "Z", F.struct(F.get("p", size - 2).alias("x"), F.get("p", size - 1).alias("y")))
    rows = rows.withColumns({"sub": F.count(F.when(F.col("v") == "M", 1)).over(order), "start": F.last(F.when(F.col("v") == "M", point), ignorenulls=True).over(order)})
    rows = rows.filter("sub > 0").withColumn("end", F.when(F.col("v") == "Z", F.col("start")).otherwise(point))
    rows = rows.withColumn("from", F.lag("end").over(order)).filter("v <> 'M'")
    (ax, ay), (bx, by) = (F.col("from.x"), F.col("from.y")), (F.col("end.x"), F.col("end.y"))

    def control(i: int, a: Column, b: Column, axis: int) -> Column:
        line = a + (b - a) * (i / 3)
        near = a if i == 1 else b
        return F.when(F.col("v") == "C", F.get("p", F.lit(2 * (i - 1) + axis))).when(F.col("v") == "Q", near + (F.get("p", F.lit(axis)) - near) * (2 / 3)).otherwise(line)

    return rows.select(key, "sub", "k", (F.col("v") == "Z").alias("closes"), ax.alias("x0"), ay.alias("y0"), control(1, ax, bx, 0).alias("x1"), control(1, ay, by, 1).alias("y1"), control(2, ax, bx, 0).alias("x2"), control(2, ay, by, 1).alias("y2"), bx.alias("x3"), by.alias("y3"))


def at(t: Column, axis: str) -> Column:
    """A cubic's coordinate at t."""
    s = 1.0 - t
    return s * s * s * F.col(f"{axis}0") + 3.0 * s * s * t * F.col(f"{axis}1") + 3.0 * s * t * t * F.col(f"{axis}2") + t * t * t * F.col(f"{axis}3")


def chords(segs: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """segs' other columns with (i, ax, ay, bx, by): so many equal steps of t that chords stay within tolerance."""
    bend = lambda a, b, c: F.hypot(F.col(f"x{a}") - 2 * F.col(f"x{b}") + F.col(f"x{c}"), F.col(f"y{a}") - 2 * F.col(f"y{b}") + F.col(f"y{c}"))
    n = F.greatest(F.ceil(F.sqrt(F.greatest(bend(0, 1, 2), bend(1, 2, 3)) * (0.75 / tolerance)) - LEAST), F.lit(1))
    rows = segs.withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))))
    t, u = F.col("i") / F.col("n"), (F.col("i") + 1) / F.col("n")
    ends = {f"{p}{axis}": at(v, axis) for p, v in (("a", t), ("b", u)) for axis in "xy"}
    return rows.withColumns(ends).drop("n", *[f"{a}{k}" for a in "xy" for k in range(4)])


def fill_edges(paths: DataFrame, tolerance: float = 0.05, key: str = "path") -> DataFrame:
    """(key, ax, ay, bx, by) of all outlines, each closed."""
    segs = segments(paths, key)
    ends = segs.groupBy(key, "sub").agg(F.min_by(F.struct("x0", "y0"), "k").alias("a"), F.max_by(F.struct("x3", "y3"), "k").alias("b"))
    closing = ends.select(key, F.col("b.x3").alias("ax"), F.col("b.y3").alias("ay"), F.col("a.x0").alias("bx"), F.col("a.y0").alias("by"))
    return chords(segs, tolerance).select(key, "ax", "ay", "bx", "by").unionByName(closing)


def coverage(edges: DataFrame, rule: str = "nonzero", key: str = "path") -> DataFrame:
    """(key, x, y, cov) of the area inside edges (key, ax, ay, bx, by)."""
    if rule not in ("nonzero", "evenodd"):
        raise ValueError(f"unknown rule {rule!r}")
    top, low = F.least("ay", "by"), F.greatest("ay", "by")
    rows = edges.filter("ay <> by").withColumn("y", F.explode(F.sequence(F.floor(top).cast("int"), (F.ceil(low) - 1).cast("int"))))
    slope = (F.col("bx") - F.col("ax")) / (F.col("by") - F.col("ay"))
    from_y, to_y = F.greatest(top, F.col("y").cast("double")), F.least(low, F.col("y") + 1.0)
    x_at = lambda y: F.col("ax") + (y - F.col("ay")) * slope
    rows = rows.select(key, "y", (F.when(F.col("by") > F.col("ay"), 1.0).otherwise(-1.0) * (to_y - from_y)).alias("h"), x_at(from_y).alias("u"), x_at(to_y).alias("v"))
    rows = rows.select(key, "y", "h", F.least("u", "v").alias("lo"), F.greatest("u", "v").alias("hi"))
    first = F.floor("lo").cast("int")
    rows = rows.withColumn("x", F.explode(F.sequence(first, F.greatest((F.ceil("hi") - 1).cast("int"), first))))
    left, right, wide = F.greatest("lo", F.col("x").cast("double")), F.least(F.col("hi"), F.col("x") + 1.0), F.col("hi") - F.col("lo")
    part = F.when(wide > 0, F.col("h") * (right - left) / F.nullif(wide, F.lit(0.0))).otherwise(F.col("h"))
    rows = rows.select(key, "y", "x", part.alias("h"), ((left + right) / 2.0 - F.col("x")).alias("m"))
    step = F.array(F.struct(F.col("x").alias("x"), (F.col("h") * (1.0 - F.col("m"))).alias("d")), F.struct((F.col("x") + 1).alias("x"), (F.col("h") * F.col("m")).alias("d")))
    sums = rows.select(key, "y", F.explode(step).alias("s")).groupBy(key, "y", F.col("s.x").alias("x")).agg(F.sum("s.d").alias("d"))
    along = Window.partitionBy(key, "y").orderBy("x")
    sums = sums.withColumns({"c": F.abs(F.sum("d").over(along.rowsBetween(Window.unboundedPreceding, 0))), "next": F.lead("x").over(along)})
    c = F.col("c")
    cov = F.least(c, F.lit(1.0)) if rule == "nonzero" else 1.0 - F.abs(1.0 - (c - 2.0 * F.floor(c / 2.0)))
    spans = sums.withColumn("cov", cov).filter((F.col("cov") > LEAST) & F.col("next").isNotNull())
    return spans.select(key, F.explode(F.sequence("x", F.col("next") - 1)).alias("x"), "y", "cov")


def _angle(r: np.ndarray, tolerance: float) -> np.ndarray:
    """The turn of an arc's chord that stays within tolerance."""
    return 2.0 * np.arccos(np.maximum(1.0 - tolerance / np.maximum(r, tolerance), 0.0))


def _edges_of(c: dict[str, np.ndarray], tolerance: float) -> np.ndarray:
    """At most so many edges each chord gives, all its arcs being half turns."""
    return 8.0 + 3.0 * np.ceil(math.pi / _angle(c["r"], tolerance))


def _arc(row: np.ndarray, x: np.ndarray, y: np.ndarray, a: np.ndarray, turn: np.ndarray, r: np.ndarray, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, edges) of arcs around (x, y) from angles a by turns."""
    n = np.maximum(np.ceil(np.abs(turn) / _angle(r, tolerance)), 1).astype(np.int64)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    row, x, y, a, turn, r, n = (np.repeat(v, n) for v in (row, x, y, a, turn, r, n))
    on = lambda k: (x + r * np.cos(a + turn * k / n), y + r * np.sin(a + turn * k / n))
    return row, np.column_stack((*on(k), *on(k + 1)))


def _around(c: dict[str, np.ndarray], tolerance: float, join: str, cap: str) -> tuple[np.ndarray, np.ndarray]:
    """(row, edges) around chords (ax, ay, bx, by) of directions d, after chords of directions u and before those of v (x, y and length l; NaN: there is none)."""
    r, d, u, v = c["r"], *((c[p + "x"], c[p + "y"], c[p + "l"]) for p in "duv")
    a, b = (c["ax"], c["ay"]), (c["bx"], c["by"])
    row = np.arange(len(r))

    def side(at, u, v, own, s: float) -> tuple[np.ndarray, np.ndarray]:
        """Points of side s (1: left) at vertices between u and v, one of which is the chord's own direction."""
        dot, inner = u[0] * v[0] + u[1] * v[1], s * (u[0] * v[1] - u[1] * v[0]) > 0
        inner |= (s < 0) & (u[0] * v[1] - u[1] * v[0] == 0)
        least = np.maximum(1.0 + dot, LEAST)
        fits = (r * np.sqrt(np.maximum(1.0 - dot, 0.0) / least) <= np.minimum(u[2], v[2])) & (1.0 + dot > LEAST) & (dot <= 1.0)
        meets = (inner & fits) | (~inner & (np.sqrt(2.0 / least) <= MITER) & (join == "miter"))
        k = s * r / least
        meets &= ~np.isnan(dot)
        return np.where(meets, at[0] - k * (u[1] + v[1]), at[0] - s * r * own[1]), np.where(meets, at[1] + k * (u[0] + v[0]), at[1] + s * r * own[0])

    la, ra, lb, rb = side(a, u, d, d, 1.0), side(a, u, d, d, -1.0), side(b, d, v, d, 1.0), side(b, d, v, d, -1.0)
    lp, rp = side(a, u, d, u, 1.0), side(a, u, d, u, -1.0)
    edge = lambda on, p, q: (row[on], np.column_stack((*p, *q))[on])
    arc = lambda on, at, start, turn: _arc(row[on], at[0][on], at[1][on], start[on], turn[on], r[on], tolerance)
    every, has = np.ones(len(r), bool), ~np.isnan(u[0])
    out = [edge(every, la, lb), edge(every, rb, ra)]
    if join == "round":
        left = u[0] * d[1] - u[1] * d[0] > 0
        was, way = np.arctan2(u[1], u[0]), np.arctan2(d[1], d[0])
        turn = way - was
        turn = np.where(turn > math.pi, turn - 2 * math.pi, np.where(turn < -math.pi, turn + 2 * math.pi, turn))
        out += [edge(has & left, lp, la), arc(has & left, a, way - math.pi / 2, -turn)]  # the right side runs backwards
        out += [arc(has & ~left, a, was + math.pi / 2, turn), edge(has & ~left, ra, rp)]
    else:
        out += [edge(has, lp, la), edge(has, ra, rp)]
    starts, stops = ~c["closed"] & ~has, ~c["closed"] & np.isnan(v[0])
    if cap == "butt":
        out += [edge(starts, ra, la), edge(stops, lb, rb)]
    elif cap == "square":
        far = lambda p, s: (p[0] + s * r * d[0], p[1] + s * r * d[1])
        out += [edge(starts, ra, far(ra, -1.0)), edge(starts, far(ra, -1.0), far(la, -1.0)), edge(starts, far(la, -1.0), la)]
        out += [edge(stops, lb, far(lb, 1.0)), edge(stops, far(lb, 1.0), far(rb, 1.0)), edge(stops, far(rb, 1.0), rb)]
    else:
        way, half = np.arctan2(d[1], d[0]), np.full(len(r), -math.pi)
        out += [arc(starts, a, way - math.pi / 2, half), arc(stops, b, way + math.pi / 2, half)]
    return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])


def stroke_edges(paths: DataFrame, tolerance: float = 0.05, join: str = "miter", cap: str = "butt", key: str = "path") -> DataFrame:
    """(key, ax, ay, bx, by) around the outlines of paths (key, verbs, width). join: miter (bevelled beyond MITER), bevel or round; cap: butt, square or round."""
    if join not in ("miter", "bevel", "round") or cap not in ("butt", "square", "round"):
        raise ValueError(f"unknown join {join!r} or cap {cap!r}")
    rows = chords(segments(paths, key), tolerance)
    size = F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))
    outline = Window.partitionBy(key, "sub")
    rows = rows.withColumns({"size": size, "closed": F.max("closes").over(outline)}).filter("size > 1e-9")
    rows = rows.withColumn("d", F.struct(((F.col("bx") - F.col("ax")) / F.col("size")).alias("x"), ((F.col("by") - F.col("ay")) / F.col("size")).alias("y"), F.col("size").alias("l")))
    order, whole = outline.orderBy("k", "i"), outline.orderBy("k", "i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns({"before": F.lag("d").over(order), "after": F.lead("d").over(order), "first": F.first("d").over(whole), "last": F.last("d").over(whole)})
    rows = rows.withColumns({"before": F.coalesce("before", F.when(F.col("closed"), F.col("last"))), "after": F.coalesce("after", F.when(F.col("closed"), F.col("first")))})
    rows = rows.join(paths.select(key, (F.col("width") / 2.0).alias("r")), key).filter("r > 0 AND r < 1e9")
    part = lambda c, p: [F.col(f"{c}.{k}").alias(p + k) for k in "xyl"]
    rows = rows.select(key, "ax", "ay", "bx", "by", "closed", "r", *part("d", "d"), *part("before", "u"), *part("after", "v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = {n: b.column(n).to_numpy(zero_copy_only=False).astype(float) for n in b.schema.names if n not in (key, "closed")}
            c["closed"] = b.column("closed").to_numpy(zero_copy_only=False).astype(bool)
            upto = np.cumsum(_edges_of(c, tolerance))
            lo = 0
            while lo < len(upto):  # rows of some BATCH edges at a time
                hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + BATCH, "right")))
                row, edges = _around({n: v[lo:hi] for n, v in c.items()}, tolerance, join, cap)
                yield pa.RecordBatch.from_arrays([b.column(key).slice(lo, hi - lo).take(pa.array(row)), *(pa.array(np.ascontiguousarray(edges[:, k])) for k in range(4))], names=[key, "ax", "ay", "bx", "by"])
                lo = hi

    return rows.mapInArrow(run, T.StructType([paths.schema[key], *(T.StructField(n, T.DoubleType()) for n in ("ax", "ay", "bx", "by"))]))


def rasterize(paths: DataFrame, tolerance: float = 0.05, rule: str = "evenodd", join: str = "miter", cap: str = "butt") -> DataFrame:
    """(path, x, y, r, g, b, a) of paths (path, verbs, fill, stroke, width): fill and stroke are (r, g, b, a), each weighed by its coverage, the stroke over the fill."""
    inside = coverage(fill_edges(paths.filter("fill.a > 0"), tolerance), rule).withColumnRenamed("cov", "f")
    around = coverage(stroke_edges(paths.filter("stroke.a > 0 AND width > 0"), tolerance, join, cap)).withColumnRenamed("cov", "s")
    both = inside.join(around, ["path", "x", "y"], "full").join(paths.select("path", "fill", "stroke"), "path")
    f, s = F.coalesce("f", F.lit(0.0)), F.coalesce("s", F.lit(0.0))
    alpha = s + f * (1.0 - s)
    colour = [((F.coalesce(F.col(f"stroke.{c}"), F.lit(0.0)) * s + F.coalesce(F.col(f"fill.{c}"), F.lit(0.0)) * f * (1.0 - s)) / alpha).alias(c) for c in "rgb"]
    return both.select("path", "x", "y", *colour, alpha.alias("a")).filter("a > 0").select("path", "x", "y", *RGBA)


def selection(paths: DataFrame, tolerance: float = 0.05, rule: str = "evenodd") -> DataFrame:
    """(x, y, cov) inside the closed outlines of at least three points, of all paths together."""
    marks = F.transform("verbs", lambda v: F.upper(v["v"]))
    anchors = F.size(F.filter(marks, lambda v: v.isin("M", "L", "Q", "C")))
    closed = paths.filter(F.array_contains(marks, "Z") & (anchors >= 3))
    return coverage(fill_edges(closed, tolerance), rule).groupBy("x", "y").agg(F.max("cov").alias("cov"))
