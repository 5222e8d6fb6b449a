"""Brushes, strokes and vector rasterising."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tilestrata.functions.blend import blend_pixel
from tilestrata.operators.raster import RGBA
from tilestrata.scratch import new_path


@dataclass(frozen=True)
class Brush:
    """size in pixels; spacing as a share of size; pressure scales size and opacity where asked."""

    size: float = 20.0
    hardness: float = 1.0
    opacity: float = 1.0
    flow: float = 1.0
    spacing: float = 0.25
    size_pressure: bool = False
    opacity_pressure: bool = False

    @property
    def step(self) -> float:
        return max(self.size * self.spacing, 0.5)

    def share(self, of: str) -> Column:
        """What pressure leaves of the size or the opacity."""
        return F.least(F.greatest(F.col("pressure"), F.lit(0.0)), F.lit(1.0)) if getattr(self, of) else F.lit(1.0)


def falloff(t: Column, hardness: float) -> Column:
    """Coverage at a share t of the radius."""
    h = min(1.0, max(0.0, hardness))
    body = F.lit(1.0) if h >= 1 else 1.0 - F.pow(t, F.lit(1.0 / max(1.0 - h, 0.001)))
    return F.when(t <= 0, 1.0).when(t >= 1, 0.0).otherwise(body)


def stroke_stamps(samples: DataFrame, brush: Brush) -> DataFrame:
    """(stroke_id, n, cx, cy, pressure) of evenly spaced stamps along samples (stroke_id, seq, px, py, pressure).

    The spacing carries over from segment to segment, so a stroke is one sequential group; strokes run in parallel.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values("seq")[["px", "py", "pressure"]].to_numpy(float)
        out, acc = [], 0.0
        for a, b in zip(p[:-1], p[1:], strict=True):
            length = math.hypot(b[0] - a[0], b[1] - a[1])
            if length == 0:
                continue
            d = np.arange(acc, length, brush.step) if acc < length else np.zeros(0)
            out.append(a + (b - a) * (d / length)[:, None])
            acc = (d[-1] + brush.step if len(d) else acc) - length
        out.append(p[-1:])
        at = np.concatenate(out)
        return pd.DataFrame({"stroke_id": pdf["stroke_id"].iloc[0], "n": np.arange(len(at), dtype=np.int32), "cx": at[:, 0], "cy": at[:, 1], "pressure": at[:, 2]})

    return samples.groupBy("stroke_id").applyInPandas(run, "stroke_id long, n int, cx double, cy double, pressure double")


def stamp_cover(stamps: DataFrame, brush: Brush) -> DataFrame:
    """(…, x, y, cov) of every place under each stamp (cx, cy, pressure)."""
    radius = F.lit(brush.size / 2) * brush.share("size_pressure")
    rows = stamps.withColumn("_r", radius).filter("_r > 0")
    span = lambda c: F.explode(F.sequence(F.floor(F.col(c) - F.col("_r")).cast("int"), F.ceil(F.col(c) + F.col("_r")).cast("int")))
    rows = rows.withColumn("x", span("cx")).withColumn("y", span("cy"))
    dx, dy = F.col("x") + 0.5 - F.col("cx"), F.col("y") + 0.5 - F.col("cy")
    t = F.sqrt(dx * dx + dy * dy) / F.col("_r")
    return rows.withColumn("cov", falloff(t, brush.hardness) * (brush.opacity * brush.flow) * brush.share("opacity_pressure")).filter((t < 1) & (F.col("cov") > 0)).drop("_r")


def paint_stamps(px: DataFrame, covered: DataFrame, colour: tuple[float, ...], erase: bool = False) -> DataFrame:
    """px after the covers (x, y, cov) of one colour.

    Stamps of one colour over each other let through a product, whatever their order, so a place needs no list of its stamps: the sums
    are combined where stamps are made, and the colour is blended once by what the product leaves.
    """
    ink = F.col("cov") if erase else F.least(F.greatest(F.col("cov") * float(colour[3]), F.lit(0.0)), F.lit(1.0))
    left = covered.groupBy("x", "y").agg(F.product(1.0 - ink).alias("left"))
    px = px.select("x", "y", *RGBA)
    if erase:
        out = px.join(left, ["x", "y"], "left")
        return out.withColumn("a", F.col("a") * F.coalesce("left", F.lit(1.0))).drop("left").filter("a > 0")
    both = px.join(left, ["x", "y"], "full")
    old = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in RGBA]
    new = blend_pixel("normal", old, [*[F.lit(float(c)) for c in colour[:3]], 1.0 - F.col("left")])
    drawn = F.struct(*[n.cast("double").alias(c) for n, c in zip(new, RGBA, strict=True)])
    same = F.struct(*[F.col(c).cast("double").alias(c) for c in RGBA])
    out = both.select("x", "y", "left", F.when(F.col("left").isNull(), same).otherwise(drawn).alias("p"))
    return out.filter("left IS NULL OR p.a > 0").select("x", "y", *[F.col(f"p.{c}").alias(c) for c in RGBA])


def finger_cover(stamps: DataFrame, radius: float, hardness: float) -> DataFrame:
    """(x, y, cov): the greatest falloff (1 - t)(1 - hardness t / 2) over stamps (cx, cy)."""
    span = lambda c: F.explode(F.sequence(F.floor(F.col(c) - radius).cast("int"), F.ceil(F.col(c) + radius).cast("int")))
    rows = stamps.withColumn("x", span("cx")).withColumn("y", span("cy"))
    dx, dy = F.col("x") + 0.5 - F.col("cx"), F.col("y") + 0.5 - F.col("cy")
    t = F.sqrt(dx * dx + dy * dy) / radius
    return rows.withColumn("cov", (1.0 - t) * (1.0 - 0.5 * hardness * t)).filter((t < 1) & (F.col("cov") > 0)).groupBy("x", "y").agg(F.max("cov").alias("cov"))


def catmull_rom(samples: DataFrame, steps: int) -> DataFrame:
    """(stroke_id, seq, k, px, py) of `steps` points on each segment; ends are mirrored."""
    w = Window.partitionBy("stroke_id").orderBy("seq")
    rows = samples
    for c in ("px", "py"):
        rows = rows.withColumns({f"{c}n": F.lead(c).over(w), f"{c}p": F.lag(c).over(w), f"{c}m": F.lead(c, 2).over(w)})
    rows = rows.filter("pxn is not null").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    t = F.col("k") / float(steps)

    def at(c: str) -> Column:
        p1, p2 = F.col(c), F.col(c + "n")
        p0, p3 = F.coalesce(F.col(c + "p"), 2.0 * p1 - p2), F.coalesce(F.col(c + "m"), 2.0 * p2 - p1)
        return (0.5 * (2.0 * p1 + (p2 - p0) * t + (2.0 * p0 - 5.0 * p1 + 4.0 * p2 - p3) * t * t + (3.0 * p1 - p0 - 3.0 * p2 + p3) * t * t * t)).alias(c)

    return rows.select("stroke_id", "seq", "k", at("px"), at("py"))


def segment_stamps(samples: DataFrame, step: float) -> DataFrame:
    """(stroke_id, n, cx, cy, pressure) of stamps that start anew at each sample; a stroke of one sample is one stamp."""
    w = Window.partitionBy("stroke_id").orderBy("seq")
    rows = samples
    for c in ("px", "py", "pressure"):
        rows = rows.withColumn("_" + c, F.lead(c).over(w))
    rows = rows.withColumn("_only", F.count(F.lit(1)).over(Window.partitionBy("stroke_id")) == 1)
    long = F.sqrt((F.col("_px") - F.col("px")) * (F.col("_px") - F.col("px")) + (F.col("_py") - F.col("py")) * (F.col("_py") - F.col("py")))
    rows = rows.withColumn("_l", F.when(F.col("_only"), 0.0).otherwise(long)).filter("_only or _l > 0")
    rows = rows.withColumn("_k", F.explode(F.sequence(F.lit(0), F.floor(F.col("_l") / step).cast("int"))))
    t = F.when(F.col("_only"), 0.0).otherwise(F.col("_k") * step / F.nullif(F.col("_l"), F.lit(0.0)))
    at = lambda c: F.when(F.col("_only"), F.col(c)).otherwise(F.col(c) + (F.col("_" + c) - F.col(c)) * t)
    n = F.row_number().over(Window.partitionBy("stroke_id").orderBy("seq", "_k"))
    return rows.select("stroke_id", n.alias("n"), at("px").alias("cx"), at("py").alias("cy"), at("pressure").alias("pressure"))


def _carried(under: np.ndarray, strength: float) -> np.ndarray:
    """Colours (n, 4) carried along: the first stamp's to begin with, and each stamp takes `strength` of what is under it."""
    out, now = np.empty_like(under), under[0].tolist()
    for k, row in enumerate(under.tolist()):
        now = [c + (u - c) * strength for c, u in zip(now, row, strict=True)]
        out[k] = now
    return out


def _last_hits(at: np.ndarray, size: np.ndarray, most: np.ndarray, hardness: float, colours: np.ndarray, places: int = 1 << 18) -> tuple[np.ndarray, ...]:
    """(x, y, greatest cover, last stamp's colour) of the places that stamps in order cover; so many stamps at a time that they have `places`, or one."""
    m = int(np.ceil(size.max() + 1)) if len(size) else 0
    chunk, off = max(1, places // (2 * m + 1) ** 2), np.arange(-m, m + 1)
    held = np.empty(0, np.int64), np.empty(0), np.empty((0, 4))
    for lo in range(0, len(at), chunk):
        c, r = at[lo : lo + chunk], size[lo : lo + chunk]
        x, y = (np.floor(c[:, i]).astype(np.int64)[:, None] + off for i in (0, 1))
        dx, dy = x + 0.5 - c[:, :1], y + 0.5 - c[:, 1:]
        t = np.sqrt((dx * dx)[:, :, None] + (dy * dy)[:, None, :]) / r[:, None, None]
        k, i, j = np.nonzero(t < 1)
        t = t[k, i, j]
        cov = np.minimum((1.0 - t) * (1.0 - 0.5 * hardness * t) * most[lo + k], 1.0)
        code = (x[k, i] << 32) | (y[k, j] & 0xFFFFFFFF)
        code, cov, ink = (np.concatenate(p) for p in zip(held, (code, cov, colours[lo + k]), strict=True))
        order = np.argsort(code, kind="stable")
        code, cov, ink = code[order], cov[order], ink[order]
        first = np.flatnonzero(np.diff(code, prepend=code[:1] - 1))
        end = np.append(first[1:], len(code)) - 1
        held = (code[end], np.maximum.reduceat(cov, first), ink[end]) if len(code) else (code, cov, ink)
    code, cov, ink = held
    return code >> 32, (code & 0xFFFFFFFF).astype(np.uint32).view(np.int32), cov, ink


def smudge(px: DataFrame, samples: DataFrame, brush: Brush, strength: float) -> DataFrame:
    """Edits (stroke_id, x, y, r, g, b, a) of a finger that carries colour from the untouched pixels along.

    At each place the last stamp's colour counts, mixed in once by the greatest falloff times strength. The colour is a running fold, so a stroke
    is one group of stamps, which also gives its places; px is kept as a table first, whose size tells whether it goes to all tasks.
    """
    spark, strength = px.sparkSession, min(1.0, max(0.0, strength))
    where = new_path(spark, "smudged")
    px.select("x", "y", *RGBA).write.parquet(where)
    px = spark.read.parquet(where)
    at = segment_stamps(samples, brush.step)
    whole = lambda c: F.when(F.col(c) >= 0, F.floor(c)).otherwise(F.ceil(c)).cast("int")
    under = at.withColumns({"x": whole("cx"), "y": whole("cy")}).join(px, ["x", "y"], "left")
    radius, most = F.lit(brush.size / 2) * brush.share("size_pressure"), F.lit(brush.opacity * brush.flow) * brush.share("opacity_pressure")
    under = under.select("stroke_id", "n", "cx", "cy", radius.cast("double").alias("_r"), most.cast("double").alias("_m"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in RGBA])

    def run(key, rows):
        rows = rows.sort_by("n")
        take = lambda *names: np.column_stack([rows.column(c).to_numpy() for c in names])
        ink, size = _carried(take(*RGBA), strength), rows.column("_r").to_numpy()
        on = size > 0
        x, y, cov, ink = _last_hits(take("cx", "cy")[on], size[on], rows.column("_m").to_numpy()[on], brush.hardness, ink[on])
        on = cov > 0
        stroke = pa.array([key[0].as_py()], rows.schema.field("stroke_id").type).take(pa.array(np.zeros(on.sum(), np.int32)))
        return pa.table([stroke, x[on].astype(np.int32), y[on], cov[on], *[np.ascontiguousarray(ink[on, i]) for i in range(4)]], names=["stroke_id", "x", "y", "cov", *["s" + c for c in RGBA]])

    from pyspark.sql import types as T

    hits = T.StructType([samples.schema["stroke_id"], T.StructField("x", T.IntegerType()), T.StructField("y", T.IntegerType()), *[T.StructField(c, T.DoubleType()) for c in ("cov", *["s" + c for c in RGBA])]])
    hit = under.groupBy("stroke_id").applyInArrow(run, hits)
    out = hit.join(px, ["x", "y"], "left")
    k = F.col("cov") * strength
    return out.select("stroke_id", "x", "y", *[(F.coalesce(F.col(c), F.lit(0.0)) * (1.0 - k) + F.col("s" + c) * k).alias(c) for c in RGBA])


def simplify_path(samples: DataFrame, tolerance: float) -> DataFrame:
    """Douglas-Peucker on each stroke: the samples that stay."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        p = pdf[["px", "py"]].to_numpy(float)
        keep, todo = {0, len(p) - 1}, [(0, len(p) - 1)]
        while todo:
            lo, hi = todo.pop()
            if hi <= lo + 1:
                continue
            d = p[hi] - p[lo]
            v = p[lo + 1 : hi] - p[lo]
            n = math.hypot(*d)
            away = np.abs(d[0] * v[:, 1] - d[1] * v[:, 0]) / n if n else np.hypot(v[:, 0], v[:, 1])
            k = int(away.argmax())
            if away[k] > tolerance:
                keep.add(lo + 1 + k)
                todo += [(lo, lo + 1 + k), (lo + 1 + k, hi)]
        return pdf.iloc[sorted(keep)]

    return samples.groupBy("stroke_id").applyInPandas(run, samples.schema)


def bresenham(lines: DataFrame) -> DataFrame:
    """(…, x, y) of the places on each segment x0, y0, x1, y1, by the rounded major-axis form."""
    n = F.greatest(F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0")))
    rows = lines.withColumn("_n", n).withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_n"))))
    step = lambda a, b: (F.col(a) + F.when(F.col("_n") == 0, 0).otherwise(F.floor((F.col(b) - F.col(a)) * F.col("_k") / F.greatest(F.col("_n"), F.lit(1)) + 0.5))).cast("int")
    return rows.withColumns({"x": step("x0", "x1"), "y": step("y0", "y1")}).drop("_n", "_k")


def scanline_fill(edges: DataFrame) -> DataFrame:
    """(path, x, y) inside closed paths given as edges (path, ax, ay, bx, by): half-open rows, at least one place a span."""
    e = edges.filter("ay <> by").withColumn("y", F.explode(F.sequence(F.least("ay", "by"), F.greatest("ay", "by") - 1)))
    cross = e.select("path", "y", (F.col("ax") + (F.col("y") + 0.5 - F.col("ay")) * (F.col("bx") - F.col("ax")) / (F.col("by") - F.col("ay"))).alias("cx"))
    row = Window.partitionBy("path", "y").orderBy("cx")
    span = cross.withColumns({"k": F.row_number().over(row), "end": F.lead("cx").over(row)}).filter("k % 2 = 1 and end is not null")
    span = span.select("path", "y", F.ceil(F.col("cx")).cast("int").alias("s"), F.ceil(F.col("end") - 1.0).cast("int").alias("e"))
    return span.select("path", F.explode(F.sequence("s", F.greatest("s", "e"))).alias("x"), "y")


def nearest_vertex(vertices: DataFrame, x: float, y: float, radius: float) -> DataFrame:
    """The vertex (path, vertex, vx, vy) nearest to a place within radius; the first wins ties."""
    d2 = (F.col("vx") - x) * (F.col("vx") - x) + (F.col("vy") - y) * (F.col("vy") - y)
    best = F.min_by(F.struct("path", "vertex", "vx", "vy"), F.struct(d2, F.col("path"), F.col("vertex")))
    return vertices.filter(d2 <= radius * radius).agg(best.alias("v")).filter("v is not null").select("v.*")


def supersample(shapes: DataFrame, n: int = 32) -> DataFrame:
    """(path, x, y, cov) of polygons (path, xs, ys), by n x n samples a pixel, over Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, xs, ys in zip(pdf["path"], pdf["xs"], pdf["ys"], strict=True):
                xs, ys = np.asarray(xs, float), np.asarray(ys, float)
                x0, x1 = math.floor(xs.min()), math.ceil(xs.max())
                grid = x0 + (np.arange((x1 - x0) * n) + 0.5) / n
                for y in range(math.floor(ys.min()), math.ceil(ys.max())):
                    hits = np.zeros(len(grid))
                    for sy in y + (np.arange(n) + 0.5) / n:
                        inside = np.zeros(len(grid), bool)
                        for ax, ay, bx, by in zip(xs, ys, np.roll(xs, -1), np.roll(ys, -1), strict=True):
                            if (ay > sy) != (by > sy):
                                inside ^= grid < ax + (sy - ay) / (by - ay) * (bx - ax)
                        hits += inside
                    cov = hits.reshape(-1, n).sum(axis=1) / (n * n)
                    on = np.flatnonzero(cov)
                    yield pd.DataFrame({"path": path, "x": (x0 + on).astype(np.int32), "y": np.int32(y), "cov": cov[on]})

    return shapes.select("path", "xs", "ys").mapInPandas(run, "path long, x int, y int, cov double")
