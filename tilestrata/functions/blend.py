"""The 13 blend modes and source-over blending of straight-alpha pixels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tilestrata.functions.color import clamp01, limit


def _hard(d: Column, s: Column, pivot: Column) -> Column:
    return F.when(pivot <= 0.5, 2.0 * d * s).otherwise(1.0 - 2.0 * (1.0 - d) * (1.0 - s))


def _soft(d: Column, s: Column) -> Column:
    d = limit(d)
    return F.when(s <= 0.5, d - (1.0 - 2.0 * s) * d * (1.0 - d)).otherwise(d + (2.0 * s - 1.0) * (F.sqrt(d) - d))


def _ratio(n: Column, d: Column) -> Column:
    return n / F.nullif(d, F.lit(0.0))


#: name -> B(backdrop, source)
MODES: dict[str, Callable[[Column, Column], Column]] = {
    "normal": lambda d, s: s,
    "multiply": lambda d, s: d * s,
    "screen": lambda d, s: d + s - d * s,
    "overlay": lambda d, s: _hard(d, s, d),
    "darken": F.least,
    "lighten": F.greatest,
    "color-dodge": lambda d, s: F.when(s >= 1, 1.0).otherwise(limit(_ratio(d, 1.0 - s))),
    "color-burn": lambda d, s: F.when(s <= 0, 0.0).otherwise(limit(1.0 - _ratio(1.0 - d, s))),
    "hard-light": lambda d, s: _hard(d, s, s),
    "soft-light": _soft,
    "difference": lambda d, s: F.abs(d - s),
    "exclusion": lambda d, s: d + s - 2.0 * d * s,
    "add": lambda d, s: d + s,
}


def mode_name(text: str) -> str:
    """Canonical mode of a name, whatever its case, with or without hyphens; unknown names raise."""
    key = text.strip().lower().replace("_", "-").replace(" ", "-")
    for name in MODES:
        if key in (name, name.replace("-", "")):
            return name
    raise ValueError(f"unknown blend mode {text!r}")


def blend_pixel(mode: str | dict[str, Column], dst: list[Column], src: list[Column], opacity: Column | float = 1.0) -> list[Column]:
    """src over dst by mode; mode may be {name: condition} where it is a column's."""
    op = clamp01(opacity if isinstance(opacity, Column) else F.lit(float(opacity)))
    sa = F.least(clamp_low(src[3]) * op, F.lit(1.0))
    da = clamp01(dst[3])
    oa = F.least(da + sa * (1.0 - da), F.lit(1.0))

    def mixed(d: Column, s: Column) -> Column:
        if isinstance(mode, str):
            return MODES[mode](d, s)
        out = None
        for name, when in mode.items():
            out = F.when(when, MODES[name](d, s)) if out is None else out.when(when, MODES[name](d, s))
        return out.otherwise(s)

    out = [(d * da * (1.0 - sa) + s * sa * (1.0 - da) + sa * da * mixed(d, s)) / F.nullif(oa, F.lit(0.0)) for d, s in zip(dst[:3], src[:3], strict=True)]
    return [F.when(sa <= 0, d).otherwise(o) for d, o in zip(dst, [*out, oa], strict=True)]


def clamp_low(c: Column) -> Column:
    """Not below 0, NaN as 0: such alpha paints nothing."""
    return F.greatest(F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0)), F.lit(0.0))
