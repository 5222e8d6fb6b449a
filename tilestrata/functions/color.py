"""Pointwise colour functions over DOUBLE columns; pixels are straight-alpha linear light."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHANNELS = ("r", "g", "b", "a")
#: Luma weights (fixed values).
WEIGHTS = (0.2126, 0.7152, 0.0722)


def lit(x: Column | float) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def limit(c: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))


def clamp01(c: Column) -> Column:
    """Into 0..1; NaN and null become 0."""
    return limit(F.coalesce(F.nanvl(c.cast("double"), F.lit(0.0)), F.lit(0.0)))


def luma(r: Column, g: Column, b: Column) -> Column:
    return WEIGHTS[0] * r + WEIGHTS[1] * g + WEIGHTS[2] * b


def srgb_encode(c: Column) -> Column:
    c = clamp01(c)
    return F.when(c <= 0.0031308, 12.92 * c).otherwise(1.055 * F.pow(c, F.lit(1 / 2.4)) - 0.055)


def srgb_decode(c: Column) -> Column:
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))


def perceptual_distance_sq(p: list[Column], q: list[Column]) -> Column:
    """Squared distance of two (r, g, b, a) in encoded colour and clamped alpha."""
    d = [srgb_encode(x) - srgb_encode(y) for x, y in zip(p[:3], q[:3], strict=True)] + [clamp01(p[3]) - clamp01(q[3])]
    return d[0] * d[0] + d[1] * d[1] + d[2] * d[2] + d[3] * d[3]


def linear_distance_sq(p: list[Column], q: list[Column]) -> Column:
    d = [x - y for x, y in zip(p, q, strict=True)]
    return d[0] * d[0] + d[1] * d[1] + d[2] * d[2] + d[3] * d[3]


def premultiply(r: Column, g: Column, b: Column, a: Column) -> list[Column]:
    return [r * a, g * a, b * a, a]


def unpremultiply(r: Column, g: Column, b: Column, a: Column) -> list[Column]:
    """Zero alpha gives transparent black."""
    return [F.when(a > 0, c / F.nullif(a, F.lit(0.0))).otherwise(0.0) for c in (r, g, b)] + [a]


def lerp(a: Column, b: Column, t: Column | float) -> Column:
    return a + (b - a) * t


def smoothstep(lo: float, hi: float, x: Column) -> Column:
    t = limit((x - lo) / (hi - lo))
    return t * t * (3.0 - 2.0 * t)


def to_u8(c: Column, srgb: bool = True) -> Column:
    return F.round((srgb_encode(c) if srgb else clamp01(c)) * 255.0).cast("int")


def from_u8(c: Column, srgb: bool = True) -> Column:
    return srgb_decode(c / 255.0) if srgb else c / 255.0


def to_u16(c: Column, srgb: bool = True) -> Column:
    return F.round((srgb_encode(c) if srgb else clamp01(c)) * 65535.0).cast("int")


def bind(values: list[Column], body) -> Column:
    """body's struct (or list of columns, as a struct of o0, o1, ...) with its arguments evaluated once, where they would else be repeated in it many times."""

    def run(e: Column) -> Column:
        out = body(*[e[f"v{i}"] for i in range(len(values))])
        return out if isinstance(out, Column) else F.struct(*[c.alias(f"o{i}") for i, c in enumerate(out)])

    return F.transform(F.array(F.struct(*[v.alias(f"v{i}") for i, v in enumerate(values)])), run)[0]


def let(values: list[Column], body, n: int = 3) -> list[Column]:
    """bind() taken apart into n columns."""
    one = bind(values, body)
    return [one[f"o{i}"] for i in range(n)]


def hsl(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue 0..1, saturation and lightness."""
    hi, lo = F.greatest(r, g, b), F.least(r, g, b)
    l, d = (hi + lo) * 0.5, hi - lo
    safe = F.when(d == 0, 1.0).otherwise(d)
    s = F.when(d == 0, 0.0).when(l > 0.5, d / F.nullif(2.0 - hi - lo, F.lit(0.0))).otherwise(d / F.nullif(hi + lo, F.lit(0.0)))
    h = F.when(d == 0, 0.0).when(hi == r, ((g - b) / safe + F.when(g < b, 6.0).otherwise(0.0)) / 6.0).when(hi == g, ((b - r) / safe + 2.0) / 6.0).otherwise(((r - g) / safe + 4.0) / 6.0)
    return h, s, l


def from_hsl(h: Column, s: Column, l: Column) -> tuple[Column, Column, Column]:
    q = F.when(l < 0.5, l * (1.0 + s)).otherwise(l + s - l * s)
    p = 2.0 * l - q

    def part(t: Column) -> Column:
        t = t + F.when(t < 0, 1.0).otherwise(0.0)
        t = t - F.when(t > 1, 1.0).otherwise(0.0)
        return F.when(t < 1 / 6, p + (q - p) * 6.0 * t).when(t < 0.5, q).when(t < 2 / 3, p + (q - p) * (2 / 3 - t) * 6.0).otherwise(p)

    return tuple(F.when(s == 0, l).otherwise(part(h + k)) for k in (1 / 3, 0.0, -1 / 3))
