"""One query per operator over the supplied tables; tilestrata/oracles.py has the SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tilestrata import fixtures as fx
from tilestrata.fixtures import CANVAS, layer, pixels
from tilestrata.functions import adjust, blend, color
from tilestrata.operators import brush, raster, region, resample, retouch, selection, stencil, tiles
from tilestrata.operators.raster import RGBA, named, pixel
from tilestrata.operators.tiles import Rect
from tilestrata.plans import tree_tables
from tilestrata.plans.compositor import composite, merge_down, sample
from tilestrata.plans.tree import Layer, LayerTree

Query = Callable[[SparkSession, str], DataFrame]
#: Parameters of the nine adjustments and filters.
ADJUST = {
    "invert": {}, "desaturate": {}, "brightness_contrast": {"brightness": 0.1, "contrast": 1.3}, "hue_sat": {"hue": 40.0, "saturation": 1.2, "lightness": 0.05},
    "levels": {"input_black": 0.1, "input_white": 0.9, "output_black": 0.05, "output_white": 0.95, "gamma": 1.5}, "curves": {"points": [(0.0, 0.1), (0.3, 0.2), (0.7, 0.9), (1.0, 0.95)]},
    "posterize": {"levels": 5}, "threshold": {"level": 0.4}, "gradient_map": {"fg": (0.1, 0.2, 0.3, 1.0), "bg": (0.9, 0.7, 0.5, 1.0)},
}
SEL_A, SEL_B = Rect(-20, -20, 30, 24), Rect(-4, -8, 28, 30)
POLYGON = [(-20, -18), (22, -10), (10, 20), (-6, 2), (-24, 14)]
BOX = Rect(-12, -10, 20, 18)
QUAD = [(-34.0, -30.0), (28.0, -27.0), (30.0, 31.0), (-29.0, 26.0)]


def rounded(c: Column) -> Column:
    return F.floor(c * 10000.0 + 0.5001) / 10000.0


def show(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, "x", "y", *[rounded(F.col(c)).alias(c) for c in RGBA])


def cov(df: DataFrame) -> DataFrame:
    return df.select("x", "y", rounded(F.col("cov")).alias("cov"))


def _pair(s: SparkSession, d: str) -> DataFrame:
    return layer(s, d, 1).join(layer(s, d, 2).select("x", "y", *[F.col(c).alias("s" + c) for c in RGBA]), ["x", "y"])


def _mask(s: SparkSession, d: str) -> DataFrame:
    return layer(s, d, 7).select("x", "y", F.col("r").alias("cov"))


def _grey(s: SparkSession, d: str) -> DataFrame:
    e = s.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.posexplode("embedding").alias("x", "e"))
    v = color.limit(F.col("e").cast("double") + 0.5)
    return e.select("x", F.col("vec_id").cast("int").alias("y"), *[v.alias(c) for c in "rgb"], F.lit(1.0).alias("a"))


def _extent(s: SparkSession, d: str) -> Rect:
    """Window of the whole grey image: a row of places for each vector (one-row aggregate)."""
    r = s.read.parquet(f"{d}/embeddings.parquet").agg(F.max("vec_id").alias("y"), F.max(F.size("embedding")).alias("w")).first()
    return Rect(0, 0, int(r["w"] or 0), int(-1 if r["y"] is None else r["y"]) + 1)


def _nodes(s: SparkSession, d: str) -> DataFrame:
    """One tree as a table: regions are groups, nations their layers."""
    r = s.read.parquet(f"{d}/region.parquet").select(F.lit(0).alias("doc_id"), (F.col("r_regionkey") + 1000).cast("long").alias("id"), F.lit(None).cast("long").alias("parent"), F.col("r_regionkey").cast("long").alias("idx"), (F.col("r_regionkey") != 2).alias("visible"), F.lit(1.0).alias("opacity"))
    n = s.read.parquet(f"{d}/nation.parquet").select(F.lit(0).alias("doc_id"), F.col("n_nationkey").cast("long").alias("id"), (F.col("n_regionkey") + 1000).cast("long").alias("parent"), F.col("n_nationkey").cast("long").alias("idx"), F.lit(True).alias("visible"), F.when(F.col("n_nationkey") == 3, 0.0).otherwise(1.0).alias("opacity"))
    return r.unionByName(n)


def _top(s: SparkSession, d: str) -> DataFrame:
    return _nodes(s, d).filter("parent IS NULL")


def _corners(s: SparkSession, d: str) -> DataFrame:
    """Closed outlines through all samples of each stroke, as edges (path, ax, ay, bx, by) in whole places."""
    order = Window.partitionBy("stroke_id").orderBy("seq")
    v = fx.strokes(s, d).select("stroke_id", "seq", F.floor(F.col("px") / 4.0).cast("int").alias("ax"), F.floor(F.col("py") / 4.0).cast("int").alias("ay"))
    end = lambda c: F.coalesce(F.lead(c).over(order), F.first(c).over(order))
    return v.select(F.col("stroke_id").alias("path"), "ax", "ay", end("ax").alias("bx"), end("ay").alias("by"))


def _wide_mask(s: SparkSession, d: str) -> DataFrame:
    """Quantities of the seventh lines at (order, part modulo 8)."""
    rows = s.read.parquet(f"{d}/lineitem.parquet").filter("l_linenumber = 7")
    return rows.groupBy(F.col("l_orderkey").cast("int").alias("x"), (F.col("l_partkey").cast("long") % 8).cast("int").alias("y")).agg((F.max("l_quantity") / 50.0).alias("cov"))


def _full(s: SparkSession, d: str) -> DataFrame:
    """Places of all layers, selected by their largest quantity."""
    return pixels(s, d).groupBy("x", "y").agg(F.max("r").alias("cov"))


def _boxes(s: SparkSession, d: str) -> DataFrame:
    o = s.read.parquet(f"{d}/orders.parquet")
    return o.select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 3000 - 1500).cast("int").alias("x"), (F.col("o_custkey") * 7 % 2000 - 1000).cast("int").alias("y"), (F.col("o_orderkey") % 11).cast("int").alias("w"), (F.col("o_custkey") % 9).cast("int").alias("h"))


def _sampled(s: SparkSession, d: str) -> DataFrame:
    """Coverage of all strokes' outlines by 8 x 8 samples a place."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", "px", "py")))
    shapes = fx.strokes(s, d).groupBy(F.col("stroke_id").alias("path")).agg(ordered.alias("v"))
    shapes = shapes.select("path", F.transform("v", lambda e: e["px"] / 16.0).alias("xs"), F.transform("v", lambda e: e["py"] / 16.0).alias("ys"))
    return brush.supersample(shapes, 8).select("path", "x", "y", rounded(F.col("cov")).alias("cov"))


def _strokes(s: SparkSession, d: str) -> DataFrame:
    return fx.strokes(s, d)


def _stamps(s: SparkSession, d: str) -> DataFrame:
    return fx.strokes(s, d).select("stroke_id", F.col("seq").alias("n"), (F.col("px") * 0.5 - 30.0).alias("cx"), (F.col("py") * 0.5 - 32.0).alias("cy"), "pressure")


def _middle(s: SparkSession, d: str) -> DataFrame:
    """One stamp in the middle of all samples."""
    mid = lambda c: (F.min(c) + F.max(c)) * 0.5
    return _stamps(s, d).agg(F.lit(0).cast("long").alias("stroke_id"), F.lit(1).alias("n"), mid("cx").alias("cx"), mid("cy").alias("cy"), F.lit(1.0).alias("pressure"))


def _cover(s: SparkSession, d: str) -> DataFrame:
    return brush.finger_cover(_stamps(s, d), 9.0, 0.5)


def _slices(s: SparkSession) -> DataFrame:
    return s.createDataFrame([("top left", -32, -32, 10, 12), ("mid/é", -4, -4, 9, 7), ("none", 0, 0, 0, 5)], "name string, sx int, sy int, sw int, sh int")


def _rects(s: SparkSession, d: str) -> DataFrame:
    o = s.read.parquet(f"{d}/orders.parquet")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return o.select(k.alias("id"), (k % 3000 - 1500).cast("int").alias("x"), (c * 7 % 2000 - 1000).cast("int").alias("y"), (k % 700).cast("int").alias("w"), (c % 600).cast("int").alias("h"))


def _rect_algebra(s: SparkSession, d: str) -> DataFrame:
    r = _rects(s, d)
    x, y = F.greatest("x", F.lit(SEL_A.x)), F.greatest("y", F.lit(SEL_A.y))
    iw, ih = F.greatest(F.least(F.col("x") + F.col("w"), F.lit(SEL_A.right)) - x, F.lit(0)), F.greatest(F.least(F.col("y") + F.col("h"), F.lit(SEL_A.bottom)) - y, F.lit(0))
    return r.select("id", (F.col("w").cast("long") * F.col("h")).alias("area"), (iw.cast("long") * ih).alias("common"), F.least("x", F.lit(SEL_A.x)).alias("ux"), (F.greatest(F.col("x") + F.col("w"), F.lit(SEL_A.right)) - F.least("x", F.lit(SEL_A.x))).cast("long").alias("uw"))


def _with(kind: str, **p) -> LayerTree:
    return LayerTree([*fx.LAYERS, Layer(20, index=3, kind="adjustment", adjust=kind, opacity=0.7, params=p)])


def _group(inner_opacity: float = 0.7, nested: bool = False) -> LayerTree:
    g = [Layer(1, index=0), Layer(30, index=1, kind="group", blend="multiply", opacity=inner_opacity, dx=2, dy=1), Layer(2, parent=30, index=0), Layer(3, parent=30, index=1, blend="screen", opacity=0.5)]
    if nested:
        g += [Layer(31, parent=30, index=2, kind="group", opacity=0.8, dx=-1), Layer(6, parent=31, index=0, blend="difference"), Layer(7, parent=31, index=1, opacity=0.6)]
    return LayerTree(g)


def _masks(s: SparkSession, d: str) -> DataFrame:
    return _mask(s, d).select(F.lit(2).alias("layer_id"), "x", "y", "cov")


def _filter(kind: str) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        dense = tiles.read_rect(layer(s, d, 3), CANVAS)
        new = adjust.adjusted(kind, [color.clamp01(F.col(c)) for c in "rgb"], "euclid", **ADJUST[kind])
        return show(dense.select("x", "y", *[n.alias(c) for n, c in zip(new, "rgb", strict=True)], "a"))

    return run


def _adjusted(kind: str) -> Query:
    return lambda s, d: show(pixels(s, d).select("layer_id", "x", "y", *named(adjust.adjust_pixel(kind, pixel(), 0.75, **ADJUST[kind]))), "layer_id")


def _blended(mode: str) -> Query:
    return lambda s, d: show(_pair(s, d).select("x", "y", *named(blend.blend_pixel(mode, pixel(), pixel("s"), 0.8))))


def _gradient(kind: str, wrap: str = "clamp") -> Query:
    return lambda s, d: show(raster.fill_gradient(layer(s, d, 1), kind, (-10.0, -6.0), (14.0, 9.0), (0.1, 0.2, 0.3, 1.0), (0.9, 0.8, 0.4, 0.5), CANVAS, wrap, wrap == "reflect", 0.9))


def _retouch(target: Callable[[], list[Column]]) -> Query:
    return lambda s, d: show(retouch.mixed(layer(s, d, 1), _cover(s, d), target()))


def _codec(s: SparkSession, d: str) -> DataFrame:
    p = pixels(s, d)
    return p.select("layer_id", "x", "y", color.to_u8(F.col("r")).alias("r8"), color.to_u8(F.col("g"), False).alias("g8"), color.to_u16(F.col("b")).alias("b16"), rounded(color.from_u8(color.to_u8(F.col("r")))).alias("back"))


def _thumb(s: SparkSession, d: str) -> DataFrame:
    return show(stencil.thumbnail(layer(s, d, 1), CANVAS, 16, 16))


def _flat(s: SparkSession, d: str) -> DataFrame:
    out = composite(pixels(s, d), fx.tree())
    return out.withColumn("v", raster.checker(F.col("x"), F.col("y"))).select("x", "y", *[rounded(c).alias(n) for c, n in zip(raster.over_opaque(pixel(), F.col("v")), "rgb", strict=True)])


def per_tile(df: DataFrame, shift: int = 4) -> DataFrame:
    """Mean colour and coverage by small tiles."""
    return df.groupBy(F.shiftright("x", shift).alias("tx"), F.shiftright("y", shift).alias("ty")).agg(*[rounded(F.avg(c)).alias(c) for c in RGBA], F.count(F.lit(1)).alias("n"))


def flagship(s: SparkSession, d: str) -> DataFrame:
    """Seven layers composited, then mean colour and coverage by tile."""
    return per_tile(composite(pixels(s, d), fx.tree()))


def _trimmed(s: SparkSession, d: str) -> DataFrame:
    return stencil_bounds(composite(pixels(s, d), fx.tree()).filter("a > 0.9"))


def stencil_bounds(df: DataFrame) -> DataFrame:
    return tiles.exact_bounds(df)


def _catmull(s: SparkSession, d: str) -> DataFrame:
    return brush.catmull_rom(_strokes(s, d), 4).select("stroke_id", "seq", "k", rounded(F.col("px")).alias("px"), rounded(F.col("py")).alias("py"))


def _lines(s: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("stroke_id").orderBy("seq")
    i = lambda c: F.floor(c).cast("int")
    return _strokes(s, d).select("stroke_id", "seq", i("px").alias("x0"), i("py").alias("y0"), i(F.lead("px").over(w)).alias("x1"), i(F.lead("py").over(w)).alias("y1")).filter("x1 is not null")


def _mode(s: SparkSession, d: str) -> DataFrame:
    k = pixels(s, d).groupBy("layer_id", rounded(F.col("g")).alias("v")).count()
    return k.groupBy("layer_id").agg(F.max_by("v", F.struct("count", -F.col("v"))).alias("v"))


def queries() -> dict[str, Query]:
    q: dict[str, Query] = {"composite_tiles": flagship}
    # store
    q["tile_index"] = lambda s, d: tiles.tile_index(pixels(s, d)).select("layer_id", "x", "y", "tx", "ty", "lx", "ly")
    q["tile_nnz"] = lambda s, d: tiles.tile_counts(pixels(s, d), "layer_id")
    q["tile_bounds"] = lambda s, d: tiles.tile_bounds(pixels(s, d), "layer_id")
    q["exact_bounds"] = lambda s, d: tiles.exact_bounds(pixels(s, d).filter("a > 0.5"), "layer_id")
    q["prune_empty"] = lambda s, d: show(tiles.stored(pixels(s, d).withColumns({c: F.when(F.col("g") > 0.3, 0.0).otherwise(F.col(c)) for c in "rab"} | {"g": F.when(F.col("g") > 0.3, 0.0).otherwise(F.col("g"))})), "layer_id")
    q["get_pixel"] = lambda s, d: show(pixels(s, d).filter("x = 3 and y = -4"), "layer_id")
    q["set_pixel"] = lambda s, d: show(tiles.upsert(layer(s, d, 1), s.createDataFrame([(3, -4, 0.1, 0.2, 0.3, 1.0), (0, 0, 0.0, 0.0, 0.0, 0.0)], "x int, y int, r double, g double, b double, a double")))
    q["read_rect"] = lambda s, d: show(tiles.read_rect(layer(s, d, 1), SEL_A))
    q["blit_rect"] = lambda s, d: show(tiles.blit_rect(layer(s, d, 1), SEL_A, layer(s, d, 2)))
    q["clear_rect"] = lambda s, d: show(tiles.clear_rect(layer(s, d, 1), SEL_A))
    q["copy_region"] = lambda s, d: show(tiles.copy_region(layer(s, d, 1), SEL_A, 7, -3))
    q["tiles_covered"] = lambda s, d: tiles.tiles_covered(_rects(s, d)).select("id", "tx", "ty")
    q["rect_algebra"] = _rect_algebra
    # pointwise
    q |= {f"blend_{m.replace('-', '_')}": _blended(m) for m in blend.MODES}
    q |= {f"adj_{k}": _adjusted(k) for k in ADJUST} | {f"filter_{k}": _filter(k) for k in ADJUST}
    q["srgb_roundtrip"] = lambda s, d: pixels(s, d).select("layer_id", "x", "y", rounded(color.srgb_encode(F.col("r"))).alias("e"), rounded(color.srgb_decode(color.srgb_encode(F.col("r")))).alias("r"))
    q["premultiply"] = lambda s, d: show(pixels(s, d).select("layer_id", "x", "y", *named(color.premultiply(*pixel()))), "layer_id")
    q["perceptual_distance"] = lambda s, d: _pair(s, d).select("x", "y", rounded(color.perceptual_distance_sq(pixel(), pixel("s"))).alias("d"))
    q["luma"] = lambda s, d: pixels(s, d).select("layer_id", "x", "y", rounded(color.luma(*pixel()[:3])).alias("l"))
    q["u8_codec"] = _codec
    # composite
    q["composite_flat"] = lambda s, d: show(composite(pixels(s, d), fx.tree()))
    q["composite_mask"] = lambda s, d: show(composite(pixels(s, d), fx.tree(), _masks(s, d)))
    q["composite_group"] = lambda s, d: show(composite(pixels(s, d), _group()))
    q["composite_nested"] = lambda s, d: show(composite(pixels(s, d), _group(nested=True)))
    q["composite_adjustment"] = lambda s, d: show(composite(pixels(s, d), _with("levels", **ADJUST["levels"])))
    q["sample_pixel"] = lambda s, d: show(sample(pixels(s, d), fx.tree(), 5, 6))
    q["composite_region"] = lambda s, d: show(composite(pixels(s, d), fx.tree(), region=SEL_A))
    q["merge_down"] = lambda s, d: show(merge_down(pixels(s, d), fx.LAYERS[1], fx.LAYERS[0]))
    q["flatten_checker"] = _flat
    # tree
    q["render_order"] = lambda s, d: tree_tables.render_order(_nodes(s, d)).select(F.col("pos").cast("long").alias("pos"), "id", F.col("depth").cast("long").alias("depth"))
    q["descendants"] = lambda s, d: tree_tables.descendants(_nodes(s, d), _top(s, d)).select(F.col("root").alias("grp"), "id")
    q["reorder_layer"] = lambda s, d: tree_tables.reordered(_top(s, d), _top(s, d).filter("id = 1003").select("doc_id", "id", F.lit(1).alias("to"))).select("id", F.col("idx").cast("long").alias("idx"))
    q["visible_leaves"] = lambda s, d: tree_tables.visible_leaves(_nodes(s, d)).select("id")
    q["soft_delete"] = lambda s, d: tree_tables.without(_nodes(s, d), _top(s, d).filter("id = 1001")).select("id")
    # selection
    q["sel_union"] = lambda s, d: cov(selection.union(selection.ellipse(s, SEL_A), _mask(s, d)))
    q["sel_intersect"] = lambda s, d: cov(selection.intersect(selection.ellipse(s, SEL_A), _mask(s, d)))
    q["sel_subtract"] = lambda s, d: cov(selection.subtract(selection.ellipse(s, SEL_A), _mask(s, d)))
    q["sel_invert"] = lambda s, d: cov(selection.invert(_mask(s, d), CANVAS))
    q["sel_ellipse"] = lambda s, d: selection.ellipses(_boxes(s, d)).select("id", "x", "y", rounded(F.col("cov")).alias("cov"))
    q["sel_polygon"] = lambda s, d: selection.polygons(_corners(s, d))
    q["sel_grow"] = lambda s, d: cov(selection.grow(_wide_mask(s, d), 2))
    q["sel_shrink"] = lambda s, d: cov(selection.shrink(_full(s, d), 1))
    q["sel_feather"] = lambda s, d: cov(selection.feather(_wide_mask(s, d), 1.5))
    q["sel_outline"] = lambda s, d: selection.outline_edges(_mask(s, d))
    q["select_by_color"] = lambda s, d: cov(region.select_by_color(layer(s, d, 1), [0.6, 0.5, 0.5, 0.6], 0.4, CANVAS))
    # selection-driven
    q["extract"] = lambda s, d: show(raster.extract(layer(s, d, 1), selection.ellipse(s, SEL_A)))
    q["erase"] = lambda s, d: show(raster.erase(layer(s, d, 1), selection.ellipse(s, SEL_A)))
    q["cut_layer"] = lambda s, d: show(raster.extract(layer(s, d, 1), selection.rect(s, SEL_A)).withColumn("part", F.lit("new")).unionByName(raster.erase_rect(layer(s, d, 1), SEL_A).withColumn("part", F.lit("old"))), "part")
    q["fill_selection"] = lambda s, d: show(raster.fill_selection(layer(s, d, 1), selection.ellipse(s, SEL_A), (0.2, 0.4, 0.6, 0.9), CANVAS, 0.8))
    q["stroke_selection"] = lambda s, d: show(raster.stroke_selection(layer(s, d, 1), BOX, 5.0, (0.9, 0.1, 0.1, 1.0), CANVAS, 0.7))
    q |= {"gradient_linear": _gradient("linear"), "gradient_radial": _gradient("radial", "repeat"), "gradient_conical": _gradient("conical"), "gradient_diamond": _gradient("diamond", "reflect")}
    q["mask_apply"] = lambda s, d: show(raster.apply_mask(layer(s, d, 1), _mask(s, d)))
    q["flip_h"] = lambda s, d: show(raster.flip(layer(s, d, 1), "x", -32, 31))
    q["flip_v"] = lambda s, d: show(raster.flip(layer(s, d, 1), "y", -32, 31))
    q["trim"] = _trimmed
    q["crop"] = lambda s, d: show(raster.crop(composite(pixels(s, d), fx.tree()), BOX))
    q["resize_canvas"] = lambda s, d: raster.resize_shifts(s.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("id"), (1 + F.col("o_orderkey") % 640).alias("w"), (1 + F.col("o_custkey") % 480).alias("h"), (1 + F.col("o_custkey") % 700).alias("new_w"), (1 + F.col("o_orderkey") % 500).alias("new_h")))
    q["slice_export_rows"] = lambda s, d: show(raster.slice_rows(layer(s, d, 1), _slices(s)), "file")
    q["slice_names"] = lambda s, d: s.read.parquet(f"{d}/pages.parquet").select("page_id", raster.safe_name(F.col("url")).alias("name"))
    # stencils
    q["gaussian"] = lambda s, d: show(stencil.gaussian_blur(layer(s, d, 1), CANVAS, 1.2))
    q["sharpen"] = lambda s, d: show(stencil.sharpen(layer(s, d, 1), CANVAS, 1.0, 0.8))
    q["emboss"] = lambda s, d: show(stencil.emboss(layer(s, d, 1), CANVAS, 0.6))
    q["edge_detect"] = lambda s, d: show(stencil.edge_detect(layer(s, d, 1), CANVAS, 0.9))
    q["sobel"] = lambda s, d: stencil.sobel(_grey(s, d), _extent(s, d)).select("x", "y", rounded(F.col("mag")).alias("mag"))
    q["box_mean"] = lambda s, d: show(stencil.box_mean(layer(s, d, 1), CANVAS, 2))
    q["eyedropper"] = lambda s, d: stencil.eyedropper(layer(s, d, 1), -31, 4, 2, CANVAS).select(*[rounded(F.col(c)).alias(c) for c in RGBA])
    q["thumbnail"] = _thumb
    q["snap_edge"] = lambda s, d: stencil.snap_to_edge(stencil.sobel(_grey(s, d), _extent(s, d)), 30, 30, 8, 0.2).select("x", "y", rounded(F.col("mag")).alias("mag"))
    # geometry
    q["resample_nearest"] = lambda s, d: show(resample.resample(layer(s, d, 1), (1.25, 0.25, -0.5, 0.75, 3.0, -2.0), CANVAS, "nearest"))
    q["resample_bilinear"] = lambda s, d: show(resample.resample(layer(s, d, 1), (1.25, 0.25, -0.5, 0.75, 3.0, -2.0), CANVAS, "bilinear"))
    q["resample_bicubic"] = lambda s, d: show(resample.resample(layer(s, d, 1), (1.25, 0.25, -0.5, 0.75, 3.0, -2.0), CANVAS, "bicubic"))
    q["perspective"] = lambda s, d: show(resample.perspective(layer(s, d, 1), CANVAS, QUAD))
    q["bezier_warp"] = lambda s, d: show(resample.bezier_warp(layer(s, d, 1), CANVAS, 2, 3, [(-34, -30), (-3, -38), (33, -29), (-30, 28), (-2, 35), (31, 27)]))
    q["snap_grid"] = lambda s, d: pixels(s, d).select("layer_id", "x", "y", resample.snap_to_grid(F.col("x"), 5).cast("int").alias("gx"), resample.snap_to_grid(F.col("y"), 5).cast("int").alias("gy"))
    # regions
    q["magic_wand"] = lambda s, d: cov(region.magic_wand(_grey(s, d), 20, 20, 0.12, _extent(s, d)))
    q["region_grow"] = lambda s, d: cov(region.region_grow(_grey(s, d), 20, 20, 0.2, _extent(s, d), 9))
    q["quick_select"] = lambda s, d: cov(region.quick_select(_grey(s, d), [(20, 20), (40, 31)], 0.15, _extent(s, d), 12))
    q["bucket_fill"] = lambda s, d: show(region.bucket_fill(_grey(s, d), 20, 20, (0.9, 0.2, 0.1, 1.0), 0.25, _extent(s, d)))
    q["matte_detect_solid"] = lambda s, d: region.detect_solid(_grey(s, d), _extent(s, d), 0.3, 0.5).select(*[rounded(F.col(c)).alias(c) for c in "rgb"], rounded(F.col("covered")).alias("covered"), "solid")
    q["matte_unmix"] = lambda s, d: show(layer(s, d, 1).select("x", "y", *named(region.unmix(pixel(), (0.5, 0.4, 0.6), 0.1, 0.5))))
    q["palette_two_means"] = lambda s, d: region.two_means(fx.palette(s, d).select("r", "g", "b")).select("k", *[rounded(F.col(c)).alias(c) for c in "rgb"], "n")
    q["palette_mode"] = _mode
    q["despeckle"] = lambda s, d: region.specks(_mask(s, d).filter("cov > 0.93"), _mask(s, d).filter("cov < 0.5"), 3)
    q["remove_matte"] = lambda s, d: show(region.remove_matte(_grey(s, d).withColumns({c: F.when(BOX.expand(-2).contains(F.col("x") - 40, F.col("y") - 30), F.col(c)).otherwise(0.25) for c in "rgb"}), _extent(s, d)))
    # brushes and retouching
    q["stamp_single"] = lambda s, d: show(brush.paint_stamps(layer(s, d, 1), brush.stamp_cover(_middle(s, d), brush.Brush(14.0, 0.4, 0.8)), (0.9, 0.2, 0.1, 1.0)))
    q["stamp_order"] = lambda s, d: show(brush.paint_stamps(layer(s, d, 1), brush.stamp_cover(_stamps(s, d), brush.Brush(16.0, 0.2, 0.6)), (0.9, 0.2, 0.1, 1.0)))
    q["brush_stroke"] = lambda s, d: show(brush.paint_stamps(layer(s, d, 1), brush.stamp_cover(brush.stroke_stamps(_strokes(s, d), brush.Brush(8.0)), brush.Brush(8.0)), (0.1, 0.3, 0.9, 0.5)))
    q["finger_coverage"] = lambda s, d: cov(_cover(s, d))
    q["dodge"] = _retouch(lambda: retouch.dodge(pixel(), retouch.range_mask(color.luma(*pixel()[:3]), "midtones") * 0.5))
    q["burn"] = _retouch(lambda: retouch.burn(pixel(), retouch.range_mask(color.luma(*pixel()[:3]), "shadows") * 0.5))
    q["sponge"] = _retouch(lambda: retouch.sponge(pixel(), 0.4, True))
    q["recolor"] = _retouch(lambda: retouch.recolor(pixel(), (0.2, 0.6, 0.4)))
    q["heal"] = lambda s, d: show(retouch.healing(layer(s, d, 1), _cover(s, d), _stamps(s, d).select(F.col("cx").alias("px"), F.col("cy").alias("py")), 6, -4))
    q["clone_stamp"] = lambda s, d: show(retouch.clone_stamp(layer(s, d, 1), _cover(s, d), 6, -4))
    q["catmull_rom"] = _catmull
    q["smudge"] = lambda s, d: show(brush.smudge(layer(s, d, 1), _stamps(s, d).select("stroke_id", F.col("n").alias("seq"), F.col("cx").alias("px"), F.col("cy").alias("py"), "pressure"), brush.Brush(6.0, 0.5, spacing=1.0), 0.6), "stroke_id")
    q["simplify_path"] = lambda s, d: brush.simplify_path(_strokes(s, d), 25.0).select("stroke_id", "seq")
    q["bresenham"] = lambda s, d: brush.bresenham(_lines(s, d)).select("stroke_id", "seq", "x", "y").distinct()
    q["scanline_fill"] = lambda s, d: brush.scanline_fill(_corners(s, d)).distinct()
    q["nearest_vertex"] = lambda s, d: brush.nearest_vertex(_strokes(s, d).select(F.col("stroke_id").alias("path"), F.col("seq").alias("vertex"), F.col("px").alias("vx"), F.col("py").alias("vy")), 60.0, 60.0, 40.0)
    q["supersample"] = _sampled
    q["last_write_wins"] = lambda s, d: show(retouch.last_write(pixels(s, d), "layer_id"))
    return q
