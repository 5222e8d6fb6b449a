"""The operators on rasters that grow with the table: a place for each order, eight rows of them, so that layers overlap at any scale."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilestrata import fixtures as fx
from tilestrata import oracles as sql
from tilestrata import queries as base
from tilestrata.functions import adjust, blend, color
from tilestrata.operators import raster, region, selection, stencil, tiles
from tilestrata.operators.raster import RGBA, named, pixel
from tilestrata.oracles import PX, L, R, rgba, w
from tilestrata.plans.compositor import composite, merge_down

Query = Callable[[SparkSession, str], DataFrame]
WIDE = """px AS (SELECT CAST(l_linenumber AS INT) AS layer_id, CAST(l_orderkey AS INT) AS x, CAST(CAST(l_partkey AS BIGINT) % 8 AS INT) AS y,
max(l_quantity) / 50.0 + 0.0 AS r, max(l_discount) * 10.0 + 0.0 AS g, max(l_tax) * 12.5 + 0.0 AS b, max(l_extendedprice) / 105000.0 AS a
FROM lineitem GROUP BY 1, 2, 3)"""
ALL = "x, y, " + rgba()


def pixels(s: SparkSession, d: str) -> DataFrame:
    """(layer_id, x, y, r, g, b, a) at (order, part modulo 8)."""
    top = s.read.parquet(f"{d}/lineitem.parquet").groupBy(F.col("l_linenumber").cast("int").alias("layer_id"), F.col("l_orderkey").cast("int").alias("x"), (F.col("l_partkey").cast("long") % 8).cast("int").alias("y")).agg(*[F.max(c).alias(c) for c in ("l_quantity", "l_discount", "l_tax", "l_extendedprice")])
    return top.select("layer_id", "x", "y", (F.col("l_quantity") / 50.0 + 0.0).alias("r"), (F.col("l_discount") * 10.0 + 0.0).alias("g"), (F.col("l_tax") * 12.5 + 0.0).alias("b"), (F.col("l_extendedprice") / 105000.0).alias("a"))


def layer(s: SparkSession, d: str, i: int) -> DataFrame:
    return pixels(s, d).filter(F.col("layer_id") == i).drop("layer_id")


def _mask(s: SparkSession, d: str) -> DataFrame:
    return layer(s, d, 7).select("x", "y", F.col("r").alias("cov"))


def _pair(s: SparkSession, d: str) -> DataFrame:
    return layer(s, d, 1).join(layer(s, d, 2).select("x", "y", *[F.col(c).alias("s" + c) for c in RGBA]), ["x", "y"])


def _blurred(s: SparkSession, d: str) -> DataFrame:
    px = layer(s, d, 1)
    return base.show(stencil.gaussian_blur(px, tiles.bounds_of(px), 1.0))


def queries() -> dict[str, Query]:
    q: dict[str, Query] = {}
    q["wide_tile_index"] = lambda s, d: tiles.tile_index(pixels(s, d)).select("layer_id", "x", "y", "tx", "ty", "lx", "ly")
    q["wide_tile_nnz"] = lambda s, d: tiles.tile_counts(pixels(s, d), "layer_id")
    q["wide_exact_bounds"] = lambda s, d: tiles.exact_bounds(pixels(s, d).filter("a > 0.5"), "layer_id")
    q["wide_upsert"] = lambda s, d: base.show(tiles.upsert(layer(s, d, 1), layer(s, d, 2)))
    q["wide_blend"] = lambda s, d: base.show(_pair(s, d).select("x", "y", *named(blend.blend_pixel("soft-light", pixel(), pixel("s"), 0.8))))
    q["wide_adjust"] = lambda s, d: base.show(pixels(s, d).select("layer_id", "x", "y", *named(adjust.adjust_pixel("hue_sat", pixel(), 0.75, **base.ADJUST["hue_sat"]))), "layer_id")
    q["wide_composite"] = lambda s, d: base.show(composite(pixels(s, d), fx.tree()))
    q["wide_composite_nested"] = lambda s, d: base.show(composite(pixels(s, d), base._group(nested=True)))
    q["wide_composite_mask"] = lambda s, d: base.show(composite(pixels(s, d), fx.tree(), _mask(s, d).select(F.lit(2).alias("layer_id"), "x", "y", "cov")))
    q["wide_merge_down"] = lambda s, d: base.show(merge_down(pixels(s, d), fx.LAYERS[1], fx.LAYERS[0]))
    q["wide_mask_apply"] = lambda s, d: base.show(raster.apply_mask(layer(s, d, 1), _mask(s, d)))
    q["wide_extract"] = lambda s, d: base.show(raster.extract(layer(s, d, 1), _mask(s, d)))
    q["wide_erase"] = lambda s, d: base.show(raster.erase(layer(s, d, 1), _mask(s, d)))
    q["wide_sel_union"] = lambda s, d: base.cov(selection.union(_mask(s, d), layer(s, d, 6).select("x", "y", F.col("g").alias("cov")).filter("cov > 0")))
    q["wide_outline"] = lambda s, d: selection.outline_edges(_mask(s, d))
    q["wide_distance"] = lambda s, d: _pair(s, d).select("x", "y", base.rounded(color.perceptual_distance_sq(pixel(), pixel("s"))).alias("d"))
    q["wide_unmix"] = lambda s, d: base.show(layer(s, d, 1).select("x", "y", *named(region.unmix(pixel(), (0.5, 0.4, 0.6), 0.1, 0.5))))
    q["wide_gaussian"] = _blurred
    return q


def oracle_sql() -> dict[str, str]:
    b = sql.oracle_sql()
    same = {"tile_index": "tile_index", "tile_nnz": "tile_nnz", "exact_bounds": "exact_bounds", "blend": "blend_soft_light", "adjust": "adj_hue_sat", "composite": "composite_flat", "composite_nested": "composite_nested", "composite_mask": "composite_mask", "merge_down": "merge_down", "mask_apply": "mask_apply", "outline": "sel_outline", "distance": "perceptual_distance", "unmix": "matte_unmix"}
    q = {f"wide_{k}": b[v].replace(PX, WIDE) for k, v in same.items()}
    two = w(WIDE, L[1], L[2], L[6], L[7])
    q["wide_upsert"] = two + f"SELECT {ALL} FROM (SELECT * FROM l2 UNION ALL SELECT * FROM l1 p WHERE NOT EXISTS (SELECT 1 FROM l2 WHERE l2.x = p.x AND l2.y = p.y))"
    q["wide_extract"] = two + f"SELECT l1.x, l1.y, {', '.join(R(f'l1.{c}', c) for c in 'rgb')}, {R('l1.a * l7.r', 'a')} FROM l1 JOIN l7 USING (x, y) WHERE l1.a * l7.r <> 0"
    q["wide_erase"] = two + f"SELECT l1.x, l1.y, {', '.join(R(f'l1.{c}', c) for c in 'rgb')}, {R('l1.a * (1 - coalesce(l7.r, 0.0))', 'a')} FROM l1 LEFT JOIN l7 USING (x, y) WHERE l7.r IS NULL OR l1.a * (1 - l7.r) <> 0"
    q["wide_sel_union"] = two + f"SELECT x, y, {R('max(cov)', 'cov')} FROM (SELECT x, y, r AS cov FROM l7 UNION ALL SELECT x, y, g FROM l6 WHERE g > 0) GROUP BY x, y"
    gr = "bd AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM l1), gr AS (SELECT CAST(unnest(range(x0, x1 + 1)) AS INT) AS x, y, x0, x1, y0, y1 FROM (SELECT *, CAST(unnest(range(y0, y1 + 1)) AS INT) AS y FROM bd))"
    dn = "dn AS (SELECT x, y, coalesce(r, 0.0) AS r, coalesce(g, 0.0) AS g, coalesce(b, 0.0) AS b, coalesce(a, 0.0) AS a FROM gr LEFT JOIN l1 USING (x, y))"
    wt = "wt AS (SELECT i AS d, exp(-(i * i) / 2.0::DOUBLE) / (SELECT sum(exp(-(j * j) / 2.0::DOUBLE)) FROM range(-3, 4) t(j)) AS w FROM range(-3, 4) t(i))"
    acc = ", ".join(f"sum(s.{c} * p.w) AS {c}" for c in "rgba")
    passes = ["p1 AS (SELECT gr.*, d, w, least(greatest(x + d, x0), x1) AS qx FROM gr, wt)", f"h1 AS (SELECT p.x, p.y, p.x0, p.x1, p.y0, p.y1, {acc} FROM p1 p JOIN dn s ON s.x = p.qx AND s.y = p.y GROUP BY ALL)", "p2 AS (SELECT gr.*, d, w, least(greatest(y + d, y0), y1) AS qy FROM gr, wt)", f"h2 AS (SELECT p.x, p.y, {acc} FROM p2 p JOIN h1 s ON s.x = p.x AND s.y = p.qy GROUP BY ALL)"]
    q["wide_gaussian"] = w(WIDE, L[1], gr, dn, wt, *passes) + f"SELECT {ALL} FROM h2"
    return q
