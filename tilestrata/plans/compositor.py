"""The ordered-fold compositor.

Leaves of a group are united, grouped by place, sorted by an explicit order and folded; a
folded group is one leaf of its parent. Layers that cannot show are pruned from metadata
before any pixel is read, and the region filter is applied in layer coordinates so that it reaches
the scan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilestrata.functions.adjust import adjust_pixel
from tilestrata.functions.blend import blend_pixel
from tilestrata.operators.raster import RGBA, apply_mask
from tilestrata.operators.tiles import Rect, shifted
from tilestrata.plans.tree import Layer, LayerTree

CLEAR = tuple(0.0 for _ in RGBA)


def _fields(s: Column) -> list[Column]:
    return [s[c] for c in RGBA]


def _struct(px: list[Column]) -> Column:
    return F.struct(*[c.cast("double").alias(n) for c, n in zip(px, RGBA, strict=True)])


def fold(leaves: DataFrame, layers: list[Layer]) -> DataFrame:
    """Leaf rows (x, y, z, r, g, b, a) of the layers in order (z is the place in the list), folded to one pixel a place."""
    extra = [(z, x) for z, x in enumerate(layers) if x.kind == "adjustment"]
    entry = F.struct("z", *RGBA)
    entries = F.collect_list(entry)
    if extra:
        entries = F.concat(entries, F.array(*[F.struct(F.lit(z).alias("z"), *[F.lit(0.0).alias(c) for c in RGBA]) for z, _ in extra]))
    modes: dict[str, list[int]] = {}
    for z, x in enumerate(layers):
        if x.kind != "adjustment":
            modes.setdefault(x.blend, []).append(z)

    def step(acc: Column, e: Column) -> Column:
        z = e["z"]
        opacity = reduce(lambda o, k: F.when(z == k[0], k[1].opacity).otherwise(o), [p for p in enumerate(layers) if p[1].opacity != 1.0], F.lit(1.0))
        out = _struct(blend_pixel({m: z.isin(zs) for m, zs in modes.items()}, _fields(acc), _fields(e), opacity)) if modes else acc
        for k, x in extra:
            out = F.when(z == k, _struct(adjust_pixel(x.adjust, _fields(acc), x.opacity, **x.params))).otherwise(out)
        return out

    rows = leaves.groupBy("x", "y").agg(F.array_sort(entries).alias("e"))
    start = F.struct(*[F.lit(0.0).alias(c) for c in RGBA])
    return rows.select("x", "y", F.aggregate("e", start, step).alias("p")).select("x", "y", *[F.col(f"p.{c}").alias(c) for c in RGBA])


def composite(px: DataFrame, tree: LayerTree, masks: DataFrame | None = None, region: Rect | None = None, parent: int | None = None, dx: int = 0, dy: int = 0, masked: frozenset[int] | None = None) -> DataFrame | None:
    """Sparse composite (x, y, r, g, b, a) of px (layer_id, x, y, r, g, b, a); masks are (layer_id, x, y, cov) for the layers that have one.

    masked: the layers that have a mask, an empty one included; those with rows in masks by default. None where nothing can show.
    """
    if masked is None:
        masked = frozenset(r["layer_id"] for r in masks.select("layer_id").distinct().collect()) if masks is not None else frozenset()
    shown = [x for x in tree.children(parent) if x.visible and x.opacity > 0]
    parts = []
    plain: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for z, x in enumerate(shown):
        ox, oy = dx + x.dx, dy + x.dy
        if x.kind == "group":
            inner = composite(px, tree, masks, region, x.id, ox, oy, masked)
            if inner is not None:
                parts.append(inner.withColumn("z", F.lit(z)))
        elif x.kind == "raster" and x.id not in masked:
            plain.setdefault((ox, oy), []).append((z, x.id))
        elif x.kind == "raster":
            own = apply_mask(px.filter(F.col("layer_id") == x.id).drop("layer_id"), masks.filter(F.col("layer_id") == x.id).drop("layer_id"))
            parts.append(_placed(own, ox, oy, region).withColumn("z", F.lit(z)))
    for (ox, oy), ids in plain.items():  # layers with one offset share a scan
        own = px.filter(F.col("layer_id").isin([i for _, i in ids]))
        z = reduce(lambda o, p: F.when(F.col("layer_id") == p[1], p[0]).otherwise(o), ids, F.lit(-1))
        parts.append(_placed(own.withColumn("z", z), ox, oy, region).drop("layer_id"))
    if not parts:
        return None
    cols = ["x", "y", "z", *RGBA]
    leaves = reduce(DataFrame.unionByName, [p.select(cols) for p in parts])
    return fold(leaves, shown)


def _placed(px: DataFrame, dx: int, dy: int, region: Rect | None) -> DataFrame:
    if region is not None:
        px = px.filter(Rect(region.x - dx, region.y - dy, region.w, region.h).contains())
    return shifted(px, dx, dy) if dx or dy else px


def sample(px: DataFrame, tree: LayerTree, x: int, y: int, masks: DataFrame | None = None) -> DataFrame | None:
    """The composite of one place: the filter comes before the fold."""
    return composite(px, tree, masks, Rect(x, y, 1, 1))


def merge_down(px: DataFrame, upper: Layer, lower: Layer) -> DataFrame:
    """Pixels of both as one layer at offset 0; the lower one must be normal, both unlocked."""
    if upper.locked or lower.locked or lower.blend != "normal":
        raise ValueError("only unlocked layers merge, onto a normal one")
    tree = LayerTree([Layer(lower.id, index=0, opacity=lower.opacity, dx=lower.dx, dy=lower.dy), Layer(upper.id, index=1, blend=upper.blend, opacity=upper.opacity, dx=upper.dx, dy=upper.dy)])
    return composite(px, tree)
