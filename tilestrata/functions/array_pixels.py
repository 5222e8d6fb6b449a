"""Blending and adjustments of arrays of straight RGBA pixels (n, 4): functions/blend.py and functions/adjust.py for kernels.

Parameters of an adjustment are values in a fixed order: brightness_contrast (brightness, contrast), hue_sat (hue, saturation, lightness),
levels (input black, input white, gamma, output black, output white), curves (input and output of four points), posterize (levels),
threshold (level), gradient_map (first and last colour); missing ones have the defaults of functions/adjust.py.
"""

from __future__ import annotations

import math

import numpy as np

from tilestrata.functions.adjust import curve_points, finite, limit_number
from tilestrata.functions.color import WEIGHTS

#: Names of an adjustment's parameters in order.
ORDER = {
    "brightness_contrast": ("brightness", "contrast"),
    "hue_sat": ("hue", "saturation", "lightness"),
    "levels": ("input_black", "input_white", "gamma", "output_black", "output_white"),
    "posterize": ("levels",),
    "threshold": ("level",),
}


def listed(kind: str, params: dict) -> list[float]:
    """Parameters in order."""
    if kind == "curves":
        return [float(v) for p in params["points"] for v in p]
    if kind == "gradient_map":
        return [float(v) for k in ("fg", "bg") for v in params[k][:3]]
    names = ORDER.get(kind, ())
    return [float(params[n]) if n in params else math.nan for n in names]


def mix(mode: str, d: np.ndarray, s: np.ndarray) -> np.ndarray:
    """The separable blend of colours d (below) and s."""
    if mode == "multiply":
        return d * s
    if mode == "screen":
        return d + s - d * s
    if mode in ("overlay", "hard-light"):
        return np.where((d if mode == "overlay" else s) <= 0.5, 2 * d * s, 1 - 2 * (1 - d) * (1 - s))
    if mode == "darken":
        return np.minimum(d, s)
    if mode == "lighten":
        return np.maximum(d, s)
    if mode == "color-dodge":
        return np.where(s >= 1, 1.0, np.clip(d / np.where(s >= 1, 1.0, 1 - s), 0, 1))
    if mode == "color-burn":
        return np.where(s <= 0, 0.0, np.clip(1 - (1 - d) / np.where(s <= 0, 1.0, s), 0, 1))
    if mode == "soft-light":
        d = np.clip(d, 0, 1)
        return np.where(s <= 0.5, d - (1 - 2 * s) * d * (1 - d), d + (2 * s - 1) * (np.sqrt(d) - d))
    if mode == "difference":
        return np.abs(d - s)
    if mode == "exclusion":
        return d + s - 2 * d * s
    return d + s if mode == "add" else s


def over(mode: str, d: np.ndarray, s: np.ndarray, opacity: np.ndarray) -> np.ndarray:
    """s over d; where s covers nothing, d stays as it is."""
    sa = np.minimum(np.maximum(np.nan_to_num(s[:, 3], nan=0.0), 0) * np.clip(opacity, 0, 1), 1)
    da = np.clip(np.nan_to_num(d[:, 3], nan=0.0), 0, 1)
    oa = np.minimum(da + sa * (1 - da), 1)
    u, v = sa[:, None], da[:, None]
    out = np.empty_like(d)
    out[:, :3] = (d[:, :3] * v * (1 - u) + s[:, :3] * u * (1 - v) + u * v * mix(mode, d[:, :3], s[:, :3])) / np.where(oa > 0, oa, 1)[:, None]
    out[:, 3] = oa
    return np.where(u <= 0, d, out)


def _hsl(rgb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    r, g, b = rgb.T
    hi, lo = rgb.max(axis=1), rgb.min(axis=1)
    c, light = hi - lo, (hi + lo) / 2
    k = np.where(c > 0, c, 1)
    h = np.where(hi == r, (g - b) / k + np.where(g < b, 6, 0), np.where(hi == g, (b - r) / k + 2, (r - g) / k + 4)) / 6
    s = np.where(light > 0.5, c / np.where(2 - hi - lo > 0, 2 - hi - lo, 1), c / np.where(hi + lo > 0, hi + lo, 1))
    return np.where(c > 0, h, 0), np.where(c > 0, s, 0), light


def _rgb(h: np.ndarray, s: np.ndarray, light: np.ndarray) -> np.ndarray:
    q = np.where(light < 0.5, light * (1 + s), light + s - light * s)
    p = 2 * light - q

    def channel(t: np.ndarray) -> np.ndarray:
        t = np.where(t < 0, t + 1, np.where(t > 1, t - 1, t))
        return np.where(t < 1 / 6, p + (q - p) * 6 * t, np.where(t < 0.5, q, np.where(t < 2 / 3, p + (q - p) * (2 / 3 - t) * 6, p)))

    return np.where(s[:, None] > 0, np.column_stack([channel(h + 1 / 3), channel(h), channel(h - 1 / 3)]), light[:, None])


def adjusted(kind: str, px: np.ndarray, opacity: float, params: list[float]) -> np.ndarray:
    """px as an adjustment layer leaves it: transparent pixels stay, channels are clamped, the result is mixed in by opacity."""
    p = [x if x is not None else math.nan for x in params]
    get = lambda i, default: finite(p[i], default) if i < len(p) else default
    clip = lambda x: np.clip(x, 0.0, 1.0)
    a = clip(np.nan_to_num(px[:, 3], nan=0.0))
    c = clip(np.nan_to_num(px[:, :3], nan=0.0))
    luma = c @ np.array(WEIGHTS)
    grey = np.repeat(clip(luma)[:, None], 3, axis=1)
    if kind == "invert":
        out = 1 - c
    elif kind == "desaturate":
        out = grey
    elif kind == "brightness_contrast":
        out = clip((c - 0.5) * get(1, 1.0) + 0.5 + get(0, 0.0))
    elif kind == "hue_sat":
        h, s, light = _hsl(c)
        h = h + get(0, 0.0) / 360.0
        out = _rgb(h - np.trunc(h), clip(s * get(1, 1.0)), clip(light + get(2, 0.0)))
    elif kind == "levels":
        ib, iw, gamma, ob, ow = get(0, 0.0), get(1, 1.0), max(get(2, 1.0), 1e-6), get(3, 0.0), get(4, 1.0)
        out = clip(ob + clip((c - ib) / max(iw - ib, 1e-6)) ** (1 / gamma) * (ow - ob))
    elif kind == "curves":
        at = curve_points(list(zip(p[::2], p[1::2], strict=True)))
        out = np.full_like(c, at[-1][1])
        for (i0, o0), (i1, o1) in reversed(list(zip(at, at[1:], strict=False))):
            out = np.where(c <= i1, o0 + (o1 - o0) * clip((c - i0) / max(i1 - i0, 1e-6)), out)
        out = np.where(c <= at[0][0], at[0][1], out)
    elif kind == "posterize":
        n = max(int(get(0, 2)), 2) - 1.0
        out = np.floor(c * n + 0.5) / n
    elif kind == "threshold":
        out = np.repeat((luma >= limit_number(get(0, 0.5)))[:, None].astype(float), 3, axis=1)
    elif kind == "gradient_map":
        fg, bg = np.array(p[:3]), np.array(p[3:6])
        out = fg + (bg - fg) * grey
    else:
        raise ValueError(f"unknown adjustment {kind!r}")
    op = min(max(opacity, 0.0), 1.0)
    new = np.column_stack([c + (out - c) * op, a])
    return np.where(((a == 0) | (op == 0))[:, None], px, new)
