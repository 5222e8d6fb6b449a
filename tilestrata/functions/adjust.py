"""The nine adjustments as pointwise functions of (r, g, b); alpha is kept."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tilestrata.functions.color import bind, clamp01, from_hsl, hsl, lerp, let, limit, luma

KINDS = ("invert", "desaturate", "brightness_contrast", "hue_sat", "levels", "curves", "posterize", "threshold", "gradient_map")


def finite(x: float, default: float) -> float:
    """x, or the default where it is NaN or infinite."""
    return float(x) if math.isfinite(x) else default


def curve_points(points: Sequence[tuple[float, float]]) -> list[tuple[float, float]]:
    """Four points by input, the outer ones pinned to inputs 0 and 1."""
    p = sorted(((finite(i, 0.0), finite(o, 0.0)) for i, o in points), key=lambda q: q[0])
    pin = lambda v: min(1.0, max(0.0, v))
    return [(0.0, pin(p[0][1])), p[1], p[2], (1.0, pin(p[3][1]))]


def _curve(c: Column, points: list[tuple[float, float]]) -> Column:
    out = F.when(c <= points[0][0], points[0][1])
    for (i0, o0), (i1, o1) in zip(points, points[1:], strict=False):
        out = out.when(c <= i1, o0 + (o1 - o0) * limit((c - i0) / max(i1 - i0, 1e-6)))
    return out.otherwise(points[-1][1])


def adjusted(kind: str, rgb: list[Column], wrap: str = "signed", **p) -> list[Column]:
    """The adjusted (r, g, b) of clamped channels. wrap: how hue wraps, `signed` (layers) or `euclid` (filters)."""
    r, g, b = rgb
    grey = limit(luma(r, g, b))
    if kind == "invert":
        return [1.0 - c for c in rgb]
    if kind == "desaturate":
        return [grey] * 3
    if kind == "brightness_contrast":
        k, add = finite(p.get("contrast", 1.0), 1.0), finite(p.get("brightness", 0.0), 0.0)
        return [limit((c - 0.5) * k + 0.5 + add) for c in rgb]
    if kind == "hue_sat":
        turn = finite(p.get("hue", 0.0), 0.0) / 360.0
        more, add = finite(p.get("saturation", 1.0), 1.0), finite(p.get("lightness", 0.0), 0.0)

        def moved(h: Column, s: Column, l: Column) -> Column:
            h = h + turn
            whole = F.floor(h) if wrap == "euclid" else F.when(h >= 0, F.floor(h)).otherwise(F.ceil(h))
            return bind([h - whole, limit(s * more), limit(l + add)], from_hsl)

        return let([r, g, b], lambda r, g, b: bind(list(hsl(r, g, b)), moved))
    if kind == "levels":
        ib, iw = finite(p.get("input_black", 0.0), 0.0), finite(p.get("input_white", 1.0), 1.0)
        ob, ow = finite(p.get("output_black", 0.0), 0.0), finite(p.get("output_white", 1.0), 1.0)
        gamma = max(finite(p.get("gamma", 1.0), 1.0), 1e-6)
        return [limit(ob + F.pow(limit((c - ib) / max(iw - ib, 1e-6)), F.lit(1.0 / gamma)) * (ow - ob)) for c in rgb]
    if kind == "curves":
        points = curve_points(p["points"])
        return [_curve(c, points) for c in rgb]
    if kind == "posterize":
        n = max(int(p.get("levels", 2)), 2) - 1.0
        return [F.floor(c * n + 0.5) / n for c in rgb]
    if kind == "threshold":
        return [F.when(luma(r, g, b) >= limit_number(p.get("level", 0.5)), 1.0).otherwise(0.0)] * 3
    if kind == "gradient_map":
        return [lerp(F.lit(float(f)), F.lit(float(t)), grey) for f, t in zip(p["fg"][:3], p["bg"][:3], strict=True)]
    raise ValueError(f"unknown adjustment {kind!r}")


def limit_number(x: float) -> float:
    return min(1.0, max(0.0, finite(x, 0.5)))


def adjust_pixel(kind: str, px: list[Column], opacity: Column | float = 1.0, **p) -> list[Column]:
    """As a layer applies it: fully transparent pixels stay as they are, channels are clamped, the result is mixed by opacity."""
    op = clamp01(opacity if isinstance(opacity, Column) else F.lit(float(opacity)))
    a = clamp01(px[3])
    rgb = [clamp01(c) for c in px[:3]]
    out = [lerp(c, n, op) for c, n in zip(rgb, adjusted(kind, rgb, **p), strict=True)]
    still = (a == 0) | (op == 0)
    return [F.when(still, c).otherwise(o) for c, o in zip(px, [*out, a], strict=True)]
