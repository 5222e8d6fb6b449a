"""Selection-driven pixel operators: extract, erase, fill, stroke, gradient, masks, flips, crops and slices."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilestrata.functions.blend import blend_pixel
from tilestrata.functions.color import lerp, limit
from tilestrata.operators.tiles import Rect, grid, stored, upsert

RGBA = ("r", "g", "b", "a")


def pixel(prefix: str = "") -> list[Column]:
    return [F.col(prefix + c) for c in RGBA]


def named(px: list[Column]) -> list[Column]:
    return [c.alias(n) for c, n in zip(px, RGBA, strict=True)]


def extract(px: DataFrame, sel: DataFrame) -> DataFrame:
    """Selected pixels, alpha times coverage."""
    out = px.join(sel, ["x", "y"]).withColumn("a", F.coalesce(F.nanvl("a", F.lit(0.0)), F.lit(0.0)) * F.col("cov"))
    return out.filter("a <> 0").drop("cov")


def erase(px: DataFrame, sel: DataFrame) -> DataFrame:
    """Pixels with the selection taken out; what loses all alpha goes. Unselected pixels stay as they are."""
    out = px.join(sel, ["x", "y"], "left")
    a = F.when(F.col("cov").isNull(), F.col("a")).otherwise(F.col("a") * (1.0 - F.col("cov")))
    return out.withColumn("a", a).filter("cov is null or a <> 0").drop("cov")


def erase_rect(px: DataFrame, rect: Rect) -> DataFrame:
    """erase() of a symbolic rectangle: a filter, no join."""
    return px.filter(~rect.contains())


def cut(px: DataFrame, sel: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new layer, what is left)."""
    return extract(px, sel), erase(px, sel)


def painted(px: DataFrame, sel: DataFrame, colour: list[Column], opacity: float = 1.0) -> DataFrame:
    """Edits (x, y, r, g, b, a) of colour over px where sel has coverage."""
    old = sel.join(px.select("x", "y", *RGBA), ["x", "y"], "left")
    dst = [F.coalesce(c, F.lit(0.0)) for c in pixel()]
    return old.filter("cov > 0").select("x", "y", *named(blend_pixel("normal", dst, colour, F.col("cov") * opacity)))


def fill_selection(px: DataFrame, sel: DataFrame | None, colour: tuple[float, ...], canvas: Rect, opacity: float = 1.0) -> DataFrame:
    """Edits; no selection means the whole canvas."""
    sel = grid(px.sparkSession, canvas).withColumn("cov", F.lit(1.0)) if sel is None else sel.filter(canvas.contains())
    return painted(px, sel, [F.lit(float(c)) for c in colour], opacity)


def stroke_selection(px: DataFrame, rect: Rect, width: float, colour: tuple[float, ...], canvas: Rect, opacity: float = 1.0) -> DataFrame:
    """Edits of the inner border of a rectangle."""
    half = max(1, math.floor(width / 2 + 0.5))
    inner = Rect(rect.x + half, rect.y + half, rect.w - 2 * half, rect.h - 2 * half)
    border = grid(px.sparkSession, rect)
    border = border if inner.empty else border.filter(~inner.contains())
    return fill_selection(px, border.withColumn("cov", F.lit(1.0)), colour, canvas, opacity)


def gradient_t(kind: str, p0: tuple[float, float], p1: tuple[float, float], x: Column, y: Column) -> Column:
    """Position of (x, y) along a linear, radial, conical or diamond gradient."""
    dx, dy = p1[0] - p0[0], p1[1] - p0[1]
    vx, vy = x - p0[0], y - p0[1]
    if kind == "linear":
        d = dx * dx + dy * dy
        return (vx * dx + vy * dy) / d if d > 0 else F.lit(0.0)
    if kind == "radial":
        d = math.hypot(dx, dy)
        return F.sqrt(vx * vx + vy * vy) / d if d > 0 else F.lit(0.0)
    if kind == "diamond":
        d = abs(dx) + abs(dy)
        return (F.abs(vx) + F.abs(vy)) / d if d > 0 else F.lit(0.0)
    if kind == "conical":
        turn = F.atan2(dx * vy - dy * vx, dx * vx + dy * vy) / (2 * math.pi)
        return turn - F.floor(turn)
    raise ValueError(f"unknown gradient {kind!r}")


def wrapped(mode: str, t: Column) -> Column:
    if mode == "clamp":
        return limit(t)
    if mode == "repeat":
        return t - F.floor(t)
    f = t - 2.0 * F.floor(t / 2.0)
    return 1.0 - F.abs(f - 1.0)


def fill_gradient(px: DataFrame, kind: str, p0, p1, fg, bg, canvas: Rect, wrap: str = "clamp", reverse: bool = False, opacity: float = 1.0, sel: DataFrame | None = None) -> DataFrame:
    """Edits of a gradient at pixel centres over px."""
    sel = grid(px.sparkSession, canvas).withColumn("cov", F.lit(1.0)) if sel is None else sel.filter(canvas.contains())
    t = gradient_t(kind, p0, p1, F.col("x") + 0.5, F.col("y") + 0.5)
    t = t if kind == "conical" else wrapped(wrap, t)
    t = 1.0 - t if reverse else t
    return painted(px, sel, [lerp(F.lit(float(f)), F.lit(float(b)), t) for f, b in zip(fg, bg, strict=True)], opacity)


def build_mask(px: DataFrame, kind: str, sel: DataFrame | None = None) -> DataFrame:
    """(x, y, cov): reveal_all (whole tiles of px), hide_all, or reveal_selection (any coverage becomes 1)."""
    if kind == "hide_all":
        return px.select("x", "y").limit(0).withColumn("cov", F.lit(1.0))
    if kind == "reveal_selection":
        return sel.filter("cov > 0").select("x", "y", F.lit(1.0).alias("cov"))
    tiles = stored(px).select(F.shiftright("x", 8).alias("tx"), F.shiftright("y", 8).alias("ty")).distinct()
    inside = F.sequence(F.lit(0), F.lit(255))
    return tiles.withColumn("i", F.explode(inside)).withColumn("j", F.explode(inside)).select((F.col("tx") * 256 + F.col("i")).alias("x"), (F.col("ty") * 256 + F.col("j")).alias("y"), F.lit(1.0).alias("cov"))


def apply_mask(px: DataFrame, mask: DataFrame) -> DataFrame:
    """Alpha times mask coverage; no mask row means none."""
    out = px.join(mask, ["x", "y"], "left").withColumn("a", F.col("a") * F.coalesce("cov", F.lit(0.0))).drop("cov")
    return out.filter("a <> 0")


def flip(px: DataFrame, axis: str, lo: int, hi: int) -> DataFrame:
    """Mirrored inside lo..hi (inclusive bounds of that axis)."""
    return px.withColumn(axis, (F.lit(lo + hi) - F.col(axis)).cast("int"))


def crop(px: DataFrame, rect: Rect) -> DataFrame:
    return px.filter(rect.contains())


#: Shares of the size difference that go before the content, by anchor.
ANCHORS = {"nw": (0, 0), "n": (1, 0), "ne": (2, 0), "w": (0, 1), "c": (1, 1), "e": (2, 1), "sw": (0, 2), "s": (1, 2), "se": (2, 2)}


def resize_shift(canvas: Rect, w: int, h: int, anchor: str) -> tuple[int, int]:
    """Offset shift of all layers when the canvas is resized around an anchor."""
    ax, ay = ANCHORS[anchor]
    half = lambda d, k: (d * k) // 2 if d >= 0 else -((-d * k) // 2)
    return half(w - canvas.w, ax), half(h - canvas.h, ay)


def resize_shifts(sizes: DataFrame) -> DataFrame:
    """(id, anchor, dx, dy) for canvases (id, w, h, new_w, new_h) and every anchor."""
    anchors = F.explode(F.array(*[F.struct(F.lit(a).alias("anchor"), F.lit(x).alias("ax"), F.lit(y).alias("ay")) for a, (x, y) in ANCHORS.items()]))
    rows = sizes.withColumn("a", anchors)
    half = lambda new, old, k: F.expr(f"CAST((new_{new} - {old}) * a.{k} AS BIGINT) DIV 2")
    return rows.select("id", "a.anchor", half("w", "w", "ax").alias("dx"), half("h", "h", "ay").alias("dy"))


def safe_name(name: Column) -> Column:
    """File-name form: anything but letters, digits, - and _ becomes _."""
    return F.regexp_replace(name, "[^A-Za-z0-9_-]", "_")


def slice_rows(px: DataFrame, slices: DataFrame) -> DataFrame:
    """Pixels of each slice (name, sx, sy, sw, sh), relative to it, with the file stem. Slices are a small user table; Spark broadcasts them by its own threshold."""
    cond = (F.col("x") >= F.col("sx")) & (F.col("x") < F.col("sx") + F.col("sw")) & (F.col("y") >= F.col("sy")) & (F.col("y") < F.col("sy") + F.col("sh"))
    stem = F.concat_ws("_", safe_name(F.col("name")), F.col("sx").cast("string"), F.col("sy").cast("string"))
    return px.join(slices.filter("sw > 0 and sh > 0"), cond).withColumns({"file": stem, "x": F.col("x") - F.col("sx"), "y": F.col("y") - F.col("sy")})


def over_opaque(px: list[Column], backdrop: Column) -> list[Column]:
    """Flattened on an opaque grey."""
    a = limit(px[3])
    return [c * a + backdrop * (1.0 - a) for c in px[:3]]


def checker(x: Column, y: Column, cell: int = 8, light: float = 0.8, dark: float = 0.6) -> Column:
    return F.when(F.pmod(F.floor(x / cell) + F.floor(y / cell), F.lit(2)) == 0, light).otherwise(dark)


def write_back(px: DataFrame, edits: DataFrame) -> DataFrame:
    return upsert(px, edits)
