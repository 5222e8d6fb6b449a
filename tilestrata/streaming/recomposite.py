"""Incremental recomposition: only the places whose layers changed are composited again."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilestrata.plans.tile_compositor import composite, offsets
from tilestrata.plans.tree import LayerTree


def touched(changed: DataFrame, tree: LayerTree) -> DataFrame:
    """(tx, ty) of the composite that changed tiles (layer_id, tx, ty) reach: up to four each, by their layer's offset."""
    parts = []
    for layer, (dx, dy) in offsets(tree).items():
        xs, ys = ({d >> 8, -(-d >> 8)} for d in (dx, dy))
        steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in sorted(xs) for j in sorted(ys)])
        own = changed.filter(F.col("layer_id") == layer).select("tx", "ty", F.explode(steps).alias("s"))
        parts.append(own.select((F.col("tx") + F.col("s.i")).alias("tx"), (F.col("ty") + F.col("s.j")).alias("ty")))
    return reduce(DataFrame.unionByName, parts).distinct() if parts else changed.select("tx", "ty").limit(0)


def recomposite(before: DataFrame, tiles: DataFrame, tree: LayerTree, changed: DataFrame) -> DataFrame:
    """The composite (tx, ty, px) of tiles, given the one before and the changed tiles (layer_id, tx, ty) of a tree that is the same."""
    places = touched(changed, tree)
    needed = reduce(DataFrame.unionByName, [_sources(places, layer, dx, dy) for layer, (dx, dy) in offsets(tree).items()])
    new = composite(tiles.join(needed, ["layer_id", "tx", "ty"], "left_semi"), tree).join(places, ["tx", "ty"], "left_semi")
    return before.join(places, ["tx", "ty"], "left_anti").unionByName(new)


def _sources(places: DataFrame, layer: int, dx: int, dy: int) -> DataFrame:
    """(layer_id, tx, ty) of a layer's tiles that lie on places of the composite."""
    xs, ys = ({d >> 8, -(-d >> 8)} for d in (dx, dy))
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in sorted(xs) for j in sorted(ys)])
    return places.select("tx", "ty", F.explode(steps).alias("s")).select(F.lit(layer).alias("layer_id"), (F.col("tx") - F.col("s.i")).alias("tx"), (F.col("ty") - F.col("s.j")).alias("ty")).distinct()
