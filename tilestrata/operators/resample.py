"""Geometric resampling: an output grid is mapped back to the source and joined with its taps."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilestrata.operators.raster import RGBA
from tilestrata.operators.tiles import Rect, grid


def transformed_bounds(rect: Rect, affine: tuple[float, ...]) -> Rect:
    a, b, c, d, tx, ty = affine
    pts = [(a * x + c * y + tx, b * x + d * y + ty) for x in (rect.x, rect.right) for y in (rect.y, rect.bottom)]
    x0, y0 = math.floor(min(p[0] for p in pts)), math.floor(min(p[1] for p in pts))
    return Rect(x0, y0, math.ceil(max(p[0] for p in pts)) - x0, math.ceil(max(p[1] for p in pts)) - y0)


def inverse(affine: tuple[float, ...]) -> tuple[float, ...]:
    """Inverse of x' = a x + c y + tx, y' = b x + d y + ty; flat maps raise."""
    a, b, c, d, tx, ty = affine
    det = a * d - b * c
    if abs(det) <= 1e-6:
        raise ValueError("the transform has no inverse")
    ia, ib, ic, id_ = d / det, -b / det, -c / det, a / det
    return ia, ib, ic, id_, -(ia * tx + ic * ty), -(ib * tx + id_ * ty)


def cubic_weight(d: Column) -> Column:
    """Catmull-Rom."""
    a = F.abs(d)
    return F.when(a <= 1, 1.5 * a * a * a - 2.5 * a * a + 1.0).when(a <= 2, -0.5 * a * a * a + 2.5 * a * a - 4.0 * a + 2.0).otherwise(0.0)


def _sampled(px: DataFrame, places: DataFrame, kind: str, src: Rect) -> DataFrame:
    """places (x, y, sx, sy) with the source sampled at (sx, sy)."""
    places = places.withColumns({"ix": F.floor("sx").cast("int"), "iy": F.floor("sy").cast("int")})
    places = places.withColumns({"fx": F.col("sx") - F.col("ix"), "fy": F.col("sy") - F.col("iy")})
    source = px.select(F.col("x").alias("qx"), F.col("y").alias("qy"), *RGBA)
    if kind == "nearest":
        near = places.filter(src.contains("ix", "iy")).withColumnsRenamed({"ix": "qx", "iy": "qy"})
        return near.join(source, ["qx", "qy"]).select("x", "y", *RGBA)
    span = range(0, 2) if kind == "bilinear" else range(-1, 3)
    at = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for j in span for i in span])
    taps = places.withColumn("t", F.explode(at))
    if kind == "bilinear":
        w = F.when(F.col("t.i") == 0, 1.0 - F.col("fx")).otherwise(F.col("fx")) * F.when(F.col("t.j") == 0, 1.0 - F.col("fy")).otherwise(F.col("fy"))
    else:
        w = cubic_weight(F.col("fx") - F.col("t.i")) * cubic_weight(F.col("fy") - F.col("t.j"))
    taps = taps.select("x", "y", (F.col("ix") + F.col("t.i")).alias("qx"), (F.col("iy") + F.col("t.j")).alias("qy"), w.alias("w")).filter("w <> 0")
    sums = taps.join(source, ["qx", "qy"]).groupBy("x", "y").agg(*[F.sum(F.col("w") * F.col(c) * F.col("a")).alias(c) for c in "rgb"], F.sum(F.col("w") * F.col("a")).alias("a"))
    flat = [F.when(F.col("a") > 0, F.col(c) / F.nullif(F.col("a"), F.lit(0.0))).otherwise(0.0).alias(c) for c in "rgb"]
    return sums.select("x", "y", *flat, F.when(F.col("a") > 0, F.col("a")).otherwise(0.0).alias("a")).filter("a <> 0")


def resample(px: DataFrame, affine: tuple[float, ...], src: Rect, kind: str = "bicubic") -> DataFrame:
    """px (bounds src) under an affine map (a, b, c, d, tx, ty)."""
    ia, ib, ic, id_, tx, ty = inverse(affine)
    out = grid(px.sparkSession, transformed_bounds(src, affine))
    out = out.withColumns({"sx": F.col("x") * ia + F.col("y") * ic + tx, "sy": F.col("x") * ib + F.col("y") * id_ + ty})
    return _sampled(px, out, kind, src)


def homography(src: list[tuple[float, float]], dst: list[tuple[float, float]]) -> np.ndarray:
    """3 x 3 map of four points onto four; degenerate quads raise."""
    rows, right = [], []
    for (x, y), (u, v) in zip(src, dst, strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        right += [u, v]
    return np.append(np.linalg.solve(np.array(rows, float), np.array(right, float)), 1.0).reshape(3, 3)


def is_convex(quad: list[tuple[float, float]]) -> bool:
    turns = [(b[0] - a[0]) * (c[1] - b[1]) - (b[1] - a[1]) * (c[0] - b[0]) for a, b, c in zip(quad, quad[1:] + quad[:1], quad[2:] + quad[:2], strict=True)]
    return all(t > 0 for t in turns) or all(t < 0 for t in turns)


def perspective(px: DataFrame, src: Rect, quad: list[tuple[float, float]], kind: str = "bilinear") -> DataFrame:
    """src's corners (clockwise from the top left) onto a convex quad."""
    if not is_convex(quad):
        raise ValueError("the quad is not convex")
    h = homography(quad, [(src.x, src.y), (src.right, src.y), (src.right, src.bottom), (src.x, src.bottom)]).tolist()
    x0, y0 = math.floor(min(p[0] for p in quad)), math.floor(min(p[1] for p in quad))
    out = grid(px.sparkSession, Rect(x0, y0, math.ceil(max(p[0] for p in quad)) - x0, math.ceil(max(p[1] for p in quad)) - y0))
    x, y = F.col("x"), F.col("y")
    den = F.nullif(x * h[2][0] + y * h[2][1] + h[2][2], F.lit(0.0))
    out = out.withColumns({"sx": (x * h[0][0] + y * h[0][1] + h[0][2]) / den, "sy": (x * h[1][0] + y * h[1][1] + h[1][2]) / den})
    edge = (F.col("sx") >= src.x) & (F.col("sx") < src.right) & (F.col("sy") >= src.y) & (F.col("sy") < src.bottom)
    return _sampled(px, out.filter(edge), kind, src)


def bezier_warp(px: DataFrame, src: Rect, rows: int, cols: int, points: list[tuple[int, int]], kind: str = "bilinear") -> DataFrame:
    """src warped by a rows x cols grid of whole control points; edges belong to their cells.

    Where cells overlap, the first column of the last row that covers a place decides. Cells are bilinear patches, inverted
    with eight Newton steps, each kept inside the cell, over Arrow batches.
    """
    pts = np.array(points, float).reshape(rows, cols, 2)
    lo, hi = pts.min(axis=(0, 1)).astype(int), pts.max(axis=(0, 1)).astype(int)
    out = grid(px.sparkSession, Rect(int(lo[0]), int(lo[1]), int(hi[0] - lo[0]) + 1, int(hi[1] - lo[1]) + 1))

    def run(batches):
        for pdf in batches:
            p = pdf[["x", "y"]].to_numpy(float)
            sx, sy = np.full(len(p), np.nan), np.full(len(p), np.nan)
            for i in range(rows - 1):
                taken = np.zeros(len(p), bool)
                for j in range(cols - 1):
                    quad = [pts[i, j], pts[i, j + 1], pts[i + 1, j + 1], pts[i + 1, j]]
                    here = inside_quad(quad, p) & ~taken
                    u, v = inverse_bilinear(quad, p[here])
                    sx[here] = src.x + (j + u) / (cols - 1) * src.w
                    sy[here] = src.y + (i + v) / (rows - 1) * src.h
                    taken |= here
            hit = ~np.isnan(sx)
            yield pdf.assign(sx=sx, sy=sy)[hit]

    return _sampled(px, out.mapInPandas(run, "x int, y int, sx double, sy double"), kind, src)


def inside_quad(quad: list[np.ndarray], p: np.ndarray) -> np.ndarray:
    """Whether points lie in a convex quad, its edges included."""
    side = np.stack([(b[0] - a[0]) * (p[:, 1] - a[1]) - (b[1] - a[1]) * (p[:, 0] - a[0]) for a, b in zip(quad, quad[1:] + quad[:1], strict=True)])
    return ~((side > 0).any(axis=0) & (side < 0).any(axis=0))


def inverse_bilinear(quad: list[np.ndarray], p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(u, v) of points in a quad given clockwise from its top left."""
    a, b, c = quad[1] - quad[0], quad[3] - quad[0], quad[2] - quad[3] - quad[1] + quad[0]
    u, v, live = np.full(len(p), 0.5), np.full(len(p), 0.5), np.ones(len(p), bool)
    for _ in range(8):
        off = p - quad[0] - u[:, None] * a - v[:, None] * b - (u * v)[:, None] * c
        du, dv = a + v[:, None] * c, b + u[:, None] * c
        det = du[:, 0] * dv[:, 1] - dv[:, 0] * du[:, 1]
        live &= np.abs(det) >= 1e-10
        safe = np.where(live, det, 1.0)
        u = np.where(live, np.clip(u + (dv[:, 1] * off[:, 0] - dv[:, 0] * off[:, 1]) / safe, 0, 1), u)
        v = np.where(live, np.clip(v + (du[:, 0] * off[:, 1] - du[:, 1] * off[:, 0]) / safe, 0, 1), v)
    return u, v


def free_transform(src: Rect, scale: tuple[float, float], degrees: float, move: tuple[float, float]) -> tuple[float, ...]:
    """Affine of scaling and turning about the centre, then moving."""
    cx, cy, t = src.x + src.w / 2, src.y + src.h / 2, math.radians(degrees)
    a, b = scale[0] * math.cos(t), scale[0] * math.sin(t)
    c, d = -scale[1] * math.sin(t), scale[1] * math.cos(t)
    return a, b, c, d, cx + move[0] - a * cx - c * cy, cy + move[1] - b * cx - d * cy


def snap_to_grid(c: Column, step: int) -> Column:
    return F.floor(c / step + 0.5) * step
