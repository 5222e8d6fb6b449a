"""Neighbourhood operators. Every source pixel is sent to the places it contributes to, and partial sums combine before the
shuffle; wide kernels work on blocks of places as arrays."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilestrata.functions.color import limit, luma, srgb_encode
from tilestrata.operators.raster import RGBA
from tilestrata.operators.tiles import Rect, read_rect


def gaussian_weights(sigma: float) -> list[float]:
    k = math.ceil(3 * sigma)
    w = [math.exp(-(i * i) / (2 * sigma * sigma)) for i in range(-k, k + 1)]
    return [x / sum(w) for x in w]


#: Places of a block that a blur works on at a time.
BLOCK = 1 << 16


def gaussian_blur(px: DataFrame, rect: Rect, sigma: float) -> DataFrame:
    """Separable blur of the dense window, clamped at its edges, on straight channels.

    The window may have any number of places: pixels go to the blocks they reach, each of which is an array of its places and what lies around it.
    """
    if sigma <= 0:
        return read_rect(px, rect)
    if rect.empty:
        return read_rect(px, rect).select("x", "y", *RGBA)
    w = gaussian_weights(sigma)
    k = len(w) // 2
    bh = min(rect.h, max(256, k))
    bw = min(rect.w, max(BLOCK // bh, k))
    across, down = -(-rect.w // bw), -(-rect.h // bh)

    def run(key, rows):
        j, i = divmod(key[0].as_py(), across)
        x0, y0 = rect.x + i * bw, rect.y + j * bh
        x1, y1 = min(x0 + bw, rect.right), min(y0 + bh, rect.bottom)
        u0, v0, u1, v1 = max(rect.x, x0 - k), max(rect.y, y0 - k), min(rect.right, x1 + k), min(rect.bottom, y1 + k)
        out = np.zeros((4, y1 - y0, x1 - x0))
        rows = rows.filter(pc.is_valid(rows.column("x")))
        if rows.num_rows:
            src = np.zeros((4, v1 - v0, u1 - u0))
            at = rows.column("y").to_numpy() - v0, rows.column("x").to_numpy() - u0
            for n, c in enumerate(RGBA):
                np.add.at(src[n], at, rows.column(c).to_numpy())
            src = np.pad(src, ((0, 0), (k - (y0 - v0), k - (v1 - y1)), (k - (x0 - u0), k - (u1 - x1))), mode="edge")
            src = sum(v * src[:, :, n : n + x1 - x0] for n, v in enumerate(w))
            out = sum(v * src[:, n : n + y1 - y0] for n, v in enumerate(w))
        x, y = np.tile(np.arange(x0, x1, dtype=np.int32), y1 - y0), np.repeat(np.arange(y0, y1, dtype=np.int32), x1 - x0)
        return pa.table([x, y, *[c.ravel() for c in out]], names=["x", "y", *RGBA])

    place = lambda c, lo, size, last: F.sequence(*[F.greatest(F.lit(0), F.least(F.lit(last), F.floor((F.col(c).cast("long") - lo + d) / size).cast("int"))) for d in (-k, k)])
    rows = px.filter(rect.contains()).select(F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in RGBA])
    rows = rows.withColumn("_i", F.explode(place("x", rect.x, bw, across - 1))).withColumn("_j", F.explode(place("y", rect.y, bh, down - 1)))
    rows = rows.select((F.col("_j").cast("long") * across + F.col("_i")).alias("block"), "x", "y", *RGBA)
    none = px.sparkSession.range(across * down).select(F.col("id").alias("block"), *[F.lit(None).cast(t).alias(c) for c, t in zip(("x", "y", *RGBA), ("int", "int", *["double"] * 4), strict=True)])
    return rows.unionByName(none).groupBy("block").applyInArrow(run, "x int, y int, r double, g double, b double, a double")


def sharpen(px: DataFrame, rect: Rect, sigma: float, amount: float) -> DataFrame:
    """Unsharp mask; alpha is kept."""
    soft = gaussian_blur(px, rect, sigma).select("x", "y", *[F.col(c).alias("s" + c) for c in "rgb"])
    out = read_rect(px, rect).join(soft, ["x", "y"])
    return out.select("x", "y", *[limit(F.col(c) + amount * (F.col(c) - F.col("s" + c))).alias(c) for c in "rgb"], "a")


def taps(px: DataFrame, rect: Rect, offsets: list[tuple[int, int]], clamp: bool = True) -> DataFrame:
    """For each place of rect, channel arrays `r`, `g`, `b`, `a` by tap; beyond the window the edge (clamp) or transparent."""
    dense = read_rect(px, rect) if clamp else px.select("x", "y", *RGBA)
    places = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for i, (dx, dy) in enumerate(offsets)])
    if clamp:
        want = dense.select("x", "y", F.explode(places).alias("t"))
        fix = lambda c, lo, hi: F.least(F.greatest(c, F.lit(lo)), F.lit(hi))
        want = want.select(F.col("x").alias("ox"), F.col("y").alias("oy"), "t.i", fix(F.col("x") + F.col("t.dx"), rect.x, rect.right - 1).alias("x"), fix(F.col("y") + F.col("t.dy"), rect.y, rect.bottom - 1).alias("y"))
        got = want.join(dense, ["x", "y"])
    else:
        got = dense.select("*", F.explode(places).alias("t")).select((F.col("x") - F.col("t.dx")).alias("ox"), (F.col("y") - F.col("t.dy")).alias("oy"), "t.i", *RGBA).filter(rect.contains("ox", "oy"))
    return got.groupBy(F.col("ox").alias("x"), F.col("oy").alias("y")).agg(*[F.struct(*[F.coalesce(F.max(F.when(F.col("i") == i, F.col(c))), F.lit(0.0)).alias(f"t{i}") for i in range(len(offsets))]).alias(c) for c in RGBA])


NINE = [(dx, dy) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]


def _tap(channel: str, dx: int, dy: int) -> Column:
    return F.col(f"{channel}.t{NINE.index((dx, dy))}")


def emboss(px: DataFrame, rect: Rect, amount: float) -> DataFrame:
    def one(c: str) -> Column:
        t = lambda dx, dy: _tap(c, dx, dy)
        e = t(1, -1) + t(1, 0) + t(0, 1) + t(1, 1) + t(0, 0) - t(-1, -1) - t(0, -1) - t(-1, 0)
        return limit(t(0, 0) + amount * (e - t(0, 0))).alias(c)

    return taps(px, rect, NINE).select("x", "y", *[one(c) for c in "rgb"], _tap("a", 0, 0).alias("a"))


def edge_detect(px: DataFrame, rect: Rect, amount: float) -> DataFrame:
    """Gradient magnitude; the vertical kernel is the lopsided one of the specification."""

    def one(c: str) -> Column:
        t = lambda dx, dy: _tap(c, dx, dy)
        gx = (t(1, -1) - t(-1, -1)) + 2.0 * (t(1, 0) - t(-1, 0)) + (t(1, 1) - t(-1, 1))
        gy = (t(-1, 1) + 2.0 * t(0, -1) + t(-1, -1)) - (t(1, 1) + 2.0 * t(0, 1) + t(1, -1))
        return limit(t(0, 0) + amount * (F.sqrt(gx * gx + gy * gy) - t(0, 0))).alias(c)

    return taps(px, rect, NINE).select("x", "y", *[one(c) for c in "rgb"], _tap("a", 0, 0).alias("a"))


def sobel(px: DataFrame, rect: Rect) -> DataFrame:
    """(x, y, mag): Sobel magnitude of perceptual luma; absent pixels count 0. One aggregation of signed contributions."""
    level = luma(*[srgb_encode(F.col(c)) for c in "rgb"])
    kernel = [(dx, dy, dx * (2 - abs(dy)), dy * (2 - abs(dx))) for dx, dy in NINE if (dx, dy) != (0, 0)]
    hit = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("dx", "dy", "kx", "ky"), k, strict=True)]) for k in kernel])
    near = rect.expand(1)
    rows = px.filter(near.contains()).select("x", "y", level.alias("l"), F.explode(hit).alias("k")).select((F.col("x") - F.col("k.dx")).alias("x"), (F.col("y") - F.col("k.dy")).alias("y"), "l", "k.kx", "k.ky").filter(rect.contains())
    return rows.groupBy("x", "y").agg(F.sum(F.col("l") * F.col("kx")).alias("gx"), F.sum(F.col("l") * F.col("ky")).alias("gy")).select("x", "y", F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")).alias("mag"))


def snap_to_edge(field: DataFrame, cx: int, cy: int, radius: int, contrast: float) -> DataFrame:
    """The strongest edge within radius (first in scan order on ties), else the nearest place; one row."""
    dx, dy = F.col("x").cast("long") - cx, F.col("y").cast("long") - cy
    d2 = dx * dx + dy * dy
    p = F.struct("x", "y", "mag")
    ok = (d2 <= radius * radius) & (F.col("mag") >= contrast)
    best = F.max_by(F.when(ok, p), F.when(ok, F.struct("mag", -F.col("y"), -F.col("x"))))
    near = F.min_by(p, F.struct(d2, F.col("y"), F.col("x")))
    return field.agg(F.coalesce(best, near).alias("p")).select("p.x", "p.y", "p.mag")


def box_mean(px: DataFrame, rect: Rect, radius: int) -> DataFrame:
    """Mean of the (2r+1) x (2r+1) box, absent pixels as 0; one axis after the other."""
    out = px.filter(rect.expand(radius).contains()).select("x", "y", *RGBA)
    for axis in "xy":
        out = out.withColumn("_d", F.explode(F.sequence(F.lit(-radius), F.lit(radius)))).withColumn(axis, F.col(axis) + F.col("_d")).groupBy("x", "y").agg(*[F.sum(c).alias(c) for c in RGBA])
    n = float((2 * radius + 1) ** 2)
    return out.filter(rect.contains()).select("x", "y", *[(F.col(c) / n).alias(c) for c in RGBA])


def eyedropper(px: DataFrame, x: int, y: int, radius: int, canvas: Rect) -> DataFrame:
    """Mean straight-alpha colour of the places of the box inside the canvas; absent ones are transparent."""
    box = Rect(x - radius, y - radius, 2 * radius + 1, 2 * radius + 1).intersect(canvas)
    return px.filter(box.contains()).agg(*[(F.coalesce(F.sum(c), F.lit(0.0)) / max(1, box.area)).alias(c) for c in RGBA])


def thumbnail(px: DataFrame, rect: Rect, w: int, h: int) -> DataFrame:
    """Premultiplied box downsample to w x h; a cell averages all its places, absent ones as transparent."""
    sx, sy = w / rect.w, h / rect.h
    cx, cy = F.floor((F.col("x") - rect.x) * sx).cast("int"), F.floor((F.col("y") - rect.y) * sy).cast("int")
    sums = px.filter(rect.contains()).groupBy(cx.alias("x"), cy.alias("y")).agg(*[F.sum(F.col(c) * F.col("a")).alias(c) for c in "rgb"], F.sum("a").alias("a"))
    per = (rect.w / w) * (rect.h / h)
    return sums.select("x", "y", *[(F.col(c) / F.nullif(F.col("a"), F.lit(0.0))).alias(c) for c in "rgb"], (F.col("a") / per).alias("a"))
