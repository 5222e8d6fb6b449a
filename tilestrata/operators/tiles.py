"""The sparse tile store: pixels keyed by (x, y), tiles of 256 x 256 by floored division."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TILE_SHIFT = 8
TILE = 1 << TILE_SHIFT
#: Most positions that a dense grid may have.
GRID_BUDGET = 1 << 28


@dataclass(frozen=True)
class Rect:
    """Half-open rectangle."""

    x: int
    y: int
    w: int
    h: int

    @property
    def right(self) -> int:
        return self.x + self.w

    @property
    def bottom(self) -> int:
        return self.y + self.h

    @property
    def area(self) -> int:
        return self.w * self.h

    @property
    def empty(self) -> bool:
        return self.w <= 0 or self.h <= 0

    @staticmethod
    def corners(x0: int, y0: int, x1: int, y1: int) -> "Rect":
        return Rect(min(x0, x1), min(y0, y1), abs(x1 - x0), abs(y1 - y0))

    def intersect(self, o: "Rect") -> "Rect":
        x, y = max(self.x, o.x), max(self.y, o.y)
        return Rect(x, y, max(0, min(self.right, o.right) - x), max(0, min(self.bottom, o.bottom) - y))

    def union(self, o: "Rect") -> "Rect":
        if self.empty or o.empty:
            return o if self.empty else self
        x, y = min(self.x, o.x), min(self.y, o.y)
        return Rect(x, y, max(self.right, o.right) - x, max(self.bottom, o.bottom) - y)

    def expand(self, n: int) -> "Rect":
        return Rect(self.x - n, self.y - n, max(0, self.w + 2 * n), max(0, self.h + 2 * n))

    def shrink(self, n: int) -> "Rect":
        return self.expand(-n)

    def contains(self, x: Column | str = "x", y: Column | str = "y") -> Column:
        """Predicate that reaches the scan as ranges of x and y."""
        x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
        return (x >= self.x) & (x < self.right) & (y >= self.y) & (y < self.bottom)


def tile_of(c: Column) -> Column:
    return F.shiftright(c, TILE_SHIFT)


def within_tile(c: Column) -> Column:
    return c.bitwiseAND(F.lit(TILE - 1))


def tile_index(px: DataFrame) -> DataFrame:
    return px.withColumns({"tx": tile_of(F.col("x")), "ty": tile_of(F.col("y")), "lx": within_tile(F.col("x")), "ly": within_tile(F.col("y"))})


def stored(px: DataFrame) -> DataFrame:
    """Without empty pixels; colour under zero alpha is stored."""
    return px.filter("r <> 0 or g <> 0 or b <> 0 or a <> 0")


def tile_counts(px: DataFrame, *keys: str) -> DataFrame:
    """Non-empty pixels of each tile."""
    return stored(px).groupBy(*keys, tile_of(F.col("x")).alias("tx"), tile_of(F.col("y")).alias("ty")).agg(F.count(F.lit(1)).alias("nnz"))


def tile_bounds(px: DataFrame, *keys: str) -> DataFrame:
    """Bounding rectangle in whole tiles."""
    tx, ty = tile_of(F.col("x")), tile_of(F.col("y"))
    return stored(px).groupBy(*keys).agg((F.min(tx) * TILE).alias("x"), (F.min(ty) * TILE).alias("y"), ((F.max(tx) - F.min(tx) + 1) * TILE).cast("long").alias("w"), ((F.max(ty) - F.min(ty) + 1) * TILE).cast("long").alias("h"))


def exact_bounds(px: DataFrame, *keys: str) -> DataFrame:
    """Bounding rectangle of non-empty pixels."""
    return stored(px).groupBy(*keys).agg(F.min("x").alias("x"), F.min("y").alias("y"), (F.max("x") - F.min("x") + 1).cast("long").alias("w"), (F.max("y") - F.min("y") + 1).cast("long").alias("h"))


def bounds_of(px: DataFrame) -> Rect | None:
    """Exact bounds on the driver (one row)."""
    r = exact_bounds(px).first()
    return None if r is None or r["x"] is None else Rect(r["x"], r["y"], int(r["w"]), int(r["h"]))


def grid(spark: SparkSession, rect: Rect) -> DataFrame:
    """Every position of rect, generated on the executors."""
    if rect.area > GRID_BUDGET:
        raise ValueError(f"a grid of {rect.area} positions is over the budget")
    if rect.empty:
        return spark.createDataFrame([], "x int, y int")
    return spark.range(rect.area).select((F.pmod("id", F.lit(rect.w)) + rect.x).cast("int").alias("x"), (F.floor(F.col("id") / rect.w) + rect.y).cast("int").alias("y"))


def read_rect(px: DataFrame, rect: Rect) -> DataFrame:
    """Dense window; gaps are transparent."""
    inside = px.filter(rect.contains()).select("x", "y", "r", "g", "b", "a")
    out = grid(px.sparkSession, rect).join(inside, ["x", "y"], "left")
    return out.select("x", "y", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in "rgba"])


def blit_rect(px: DataFrame, rect: Rect, window: DataFrame) -> DataFrame:
    """rect replaced by window, transparent pixels included."""
    return stored(px.filter(~rect.contains()).unionByName(window.filter(rect.contains())))


def clear_rect(px: DataFrame, rect: Rect) -> DataFrame:
    return px.filter(~rect.contains())


def copy_region(px: DataFrame, rect: Rect, dx: int, dy: int) -> DataFrame:
    """Non-empty pixels of rect moved over the rest."""
    moved = stored(px.filter(rect.contains())).withColumns({"x": F.col("x") + dx, "y": F.col("y") + dy})
    return px.join(moved.select("x", "y"), ["x", "y"], "left_anti").unionByName(moved)


def upsert(px: DataFrame, edits: DataFrame) -> DataFrame:
    """Pixels with edits in their place; edits to transparent remove."""
    return px.join(edits.select("x", "y"), ["x", "y"], "left_anti").unionByName(stored(edits.select(px.columns)))


def tiles_covered(rects: DataFrame) -> DataFrame:
    """(tx, ty) touched by each row's rect x, y, w, h; empty ones touch none."""
    some = rects.filter("w > 0 and h > 0")
    span = lambda a, n: F.explode(F.sequence(tile_of(F.col(a)), tile_of(F.col(a) + F.col(n) - 1)))
    return some.withColumn("tx", span("x", "w")).withColumn("ty", span("y", "h"))


def shifted(px: DataFrame, dx: int, dy: int) -> DataFrame:
    """Moved by an offset; positions beyond 32 bits vanish, never wrap."""
    x, y = F.col("x").cast("long") + dx, F.col("y").cast("long") + dy
    ok = x.between(-(2**31), 2**31 - 1) & y.between(-(2**31), 2**31 - 1)
    return px.filter(ok).withColumns({"x": x.cast("int"), "y": y.cast("int")})
