"""A query for each command of the op-log, for vectors, files, streams and plug-ins, with their SQL beside them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tilestrata import fixtures as fx
from tilestrata import oracles as sql
from tilestrata import queries as base
from tilestrata.fixtures import CANVAS, layer, pixels
from tilestrata.functions import adjust, color
from tilestrata.operators import brush, raster, retouch, selection, stencil, tiles, vector, view
from tilestrata.operators.tiles import Rect
from tilestrata.oracles import FLAT, PX, SEL_A, L, R, inside, moved, rgba, stack, w
from tilestrata.plans import history as h
from tilestrata.plans import tree_tables
from tilestrata.plans.tree import Layer, LayerTree
from tilestrata.scratch import new_path
from tilestrata.sources import native
from tilestrata.streaming import strokes

Query = Callable[[SparkSession, str], DataFrame]
BOX, POLYGON = base.BOX, base.POLYGON
ALL = "x, y, " + rgba()
LEVELS = base.ADJUST["levels"]
RED = (0.9, 0.1, 0.1, 1.0)
TABLES = "layer_id int, x int, y int, cov double"
#: The longest side of a previewed copy.
LONGEST_PREVIEW = 100_000


def document(s: SparkSession, d: str, px: DataFrame | None = None, tree: LayerTree | None = None, sel: DataFrame | None = None) -> h.Document:
    """The seven layers of the fixtures, with a mask on layer 2 where asked for by the query itself."""
    return h.Document(CANVAS, tree or fx.tree(), pixels(s, d) if px is None else px, s.createDataFrame([], TABLES), sel)


def applied(doc: h.Document, *commands: h.Command) -> h.Document:
    log = h.History(doc)
    for c in commands:
        log.do(c)
    return log.document


def shown(doc: h.Document, region: Rect | None = None) -> DataFrame:
    return base.show(doc.composite(region))


def _composite(*commands: h.Command) -> Query:
    return lambda s, d: shown(applied(document(s, d), *commands))


def _layer(i: int, make: Callable[[SparkSession, str], tuple[h.Document, list[h.Command]]]) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        doc, commands = make(s, d)
        return base.show(applied(doc, *commands).of(i))

    return run


def flat_sql(layers: list[tuple[str, str, str]], *ctes: str, tail: str = "", columns: str = ALL) -> str:
    return w(PX, *L.values(), moved(3, 3, -5, "m3"), *ctes, *stack(layers)) + f"SELECT {columns} FROM f{len(layers)} {tail}"


def upserted(edits: str, old: str = "l1", ctes: tuple[str, ...] = (PX, L[1])) -> str:
    """A layer with the rows of an SQL of rounded edits in their place."""
    return w(*ctes, f"e AS ({edits})") + f"SELECT x, y, r, g, b, a FROM e WHERE r <> 0 OR g <> 0 OR b <> 0 OR a <> 0 UNION ALL SELECT {ALL} FROM {old} p WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.x = p.x AND e.y = p.y)"


def _other(s: SparkSession, d: str) -> h.Document:
    tree = LayerTree([Layer(50, kind="group", blend="screen", opacity=0.5), Layer(51, parent=50, index=0), Layer(52, parent=50, index=1, blend="multiply", opacity=0.5)])
    px = pixels(s, d).filter("layer_id in (4, 5)").withColumn("layer_id", (F.lit(56) - F.col("layer_id")).cast("int"))
    return h.Document(CANVAS, tree, px, s.createDataFrame([], TABLES))


def _paths(s: SparkSession, d: str) -> DataFrame:
    """Closed paths of a stroke's samples: a triangle fan for each user, by events' places."""
    v = F.transform(F.slice(F.array_sort(F.collect_list(F.struct("seq", F.floor("px").cast("int").alias("x"), F.floor("py").cast("int").alias("y")))), 1, 5), lambda e: F.struct(e["x"].alias("x"), e["y"].alias("y")))
    rows = fx.strokes(s, d).groupBy("stroke_id").agg(v.alias("vertices"))
    ink = lambda r, g, b: F.struct(F.lit(r).alias("r"), F.lit(g).alias("g"), F.lit(b).alias("b"), F.lit(1.0).alias("a"))
    return rows.select((F.col("stroke_id") % 4).cast("int").alias("layer_id"), F.col("stroke_id").cast("int").alias("path"), "vertices", (F.col("stroke_id") % 2 == 0).alias("closed"), ink(0.2, 0.4, 0.6).alias("fill"), ink(0.9, 0.1, 0.3).alias("stroke"), (F.col("stroke_id") % 4).cast("double").alias("width"))


def _forest(s: SparkSession, d: str) -> DataFrame:
    """(doc_id, id, parent, idx, visible, opacity): documents are nations, groups market segments (ids below 0), leaves customers."""
    c = s.read.parquet(f"{d}/customer.parquet").select(F.col("c_nationkey").cast("long").alias("doc_id"), F.col("c_custkey").cast("long").alias("id"), "c_mktsegment", F.col("c_acctbal").cast("double").alias("bal"))
    group = F.dense_rank().over(Window.partitionBy("doc_id").orderBy("c_mktsegment"))
    c = c.withColumn("parent", -group.cast("long"))
    leaves = c.select("doc_id", "id", "parent", (F.col("id") % 7).cast("long").alias("idx"), (F.col("id") % 5 > 0).alias("visible"), F.when(F.col("bal") < 0, 0.0).otherwise(1.0).alias("opacity"))
    groups = c.select("doc_id", F.col("parent").alias("id")).distinct().select("doc_id", "id", F.lit(None).cast("long").alias("parent"), F.col("id").alias("idx"), (F.col("id") % 3 != 0).alias("visible"), F.lit(1.0).alias("opacity"))
    return groups.unionByName(leaves)


FOREST_SQL = [
    "fc AS (SELECT CAST(c_nationkey AS BIGINT) AS doc_id, CAST(c_custkey AS BIGINT) AS id, -dense_rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS parent, c_acctbal AS bal FROM customer)",
    "fg AS (SELECT DISTINCT doc_id, parent AS id FROM fc)",
]
VECTOR_SQL = [
    f"st AS ({fx.STROKES_SQL})",
    "pv AS (SELECT stroke_id AS path, list({'x': CAST(floor(px) AS INT), 'y': CAST(floor(py) AS INT)} ORDER BY seq) AS v FROM st WHERE seq <= 5 GROUP BY 1)",
    "ed AS (SELECT path, k, len(v) AS n, v[k + 1].x AS ax, v[k + 1].y AS ay, v[(k + 1) % len(v) + 1].x AS bx, v[(k + 1) % len(v) + 1].y AS by2 FROM pv, range(5) t(k) WHERE k < len(v) AND len(v) >= 2)",
    "lim AS (SELECT path, min(ax) AS lo, max(ax) AS hi FROM ed GROUP BY 1)",
    "cr AS (SELECT path, y, ax + (y + 0.5 - ay) / (by2 - ay)::DOUBLE * (bx - ax) AS cx FROM ed, range(0, 128) t(y) WHERE n >= 3 AND (ay <= y + 0.5) <> (by2 <= y + 0.5))",
    "sp AS (SELECT path, y, cx, lead(cx) OVER q AS nx, row_number() OVER q AS i FROM cr WINDOW q AS (PARTITION BY path, y ORDER BY cx))",
    "fl AS (SELECT DISTINCT sp.path, x, y FROM sp JOIN lim USING (path), range(-10, 200) t(x) WHERE i % 2 = 1 AND nx IS NOT NULL AND x BETWEEN ceil(cx) AND greatest(ceil(nx - 1), ceil(cx)) AND x BETWEEN lo AND hi)",
    "so AS (SELECT *, greatest(sqrt((bx - ax) * (bx - ax) + (by2 - ay) * (by2 - ay)), 1.0) AS ln FROM ed WHERE path % 4 > 0 AND (path % 2 = 0 OR k < n - 1))",
    "off AS (SELECT path, k, ax, ay, bx, by2, CAST(round(-(by2 - ay) / ln) AS INT) AS ux, CAST(round((bx - ax) / ln) AS INT) AS uy, CASE WHEN o % 2 = 1 THEN (o + 1) // 2 ELSE -(o // 2) END AS sd FROM so, range(0, 3) t(o) WHERE o < path % 4)",
    "ln AS (SELECT path, ax + ux * sd AS x0, ay + uy * sd AS y0, bx + ux * sd AS x1, by2 + uy * sd AS y1 FROM off)",
    "sk AS (SELECT DISTINCT path, CAST(x0 + CASE WHEN m = 0 THEN 0 ELSE floor((x1 - x0) * i / m::DOUBLE + 0.5) END AS INT) AS x, CAST(y0 + CASE WHEN m = 0 THEN 0 ELSE floor((y1 - y0) * i / m::DOUBLE + 0.5) END AS INT) AS y FROM (SELECT *, greatest(abs(x1 - x0), abs(y1 - y0)) AS m, unnest(range(0, greatest(abs(x1 - x0), abs(y1 - y0)) + 1)) AS i FROM ln))",
    "va AS (SELECT path, 0 AS top, x, y FROM fl UNION ALL SELECT path, 1, x, y FROM sk)",
    "vr AS (SELECT CAST(path % 4 AS INT) AS layer_id, CAST(x AS INT) AS x, CAST(y AS INT) AS y, arg_max(top, path * 2 + top) AS top FROM va GROUP BY 1, 2, 3)",
]
INK = "CAST(CASE WHEN top = 1 THEN {} ELSE {} END AS DOUBLE) AS {}"
INKS = ", ".join(INK.format(a, b, c) for a, b, c in ((0.9, 0.2, "r"), (0.1, 0.4, "g"), (0.3, 0.6, "b"))) + ", 1.0::DOUBLE AS a"


def _box_means(s: SparkSession, d: str) -> DataFrame:
    return stencil.box_mean(layer(s, d, 1), CANVAS, 2)


def _saved(s: SparkSession, d: str) -> DataFrame:
    """A document written and read again."""
    path = new_path(s, "document")
    native.save(document(s, d), path)
    return base.show(native.load(s, path).pixels, "layer_id")


def queries() -> dict[str, Query]:
    q: dict[str, Query] = {}
    at2 = lambda **v: h.layer_update("set", 2, True, **v)
    q["cmd_set_visible"] = _composite(h.layer_update("visible", 4, visible=True))
    q["cmd_set_opacity"] = _composite(at2(opacity=0.9), at2(opacity=0.3))
    q["cmd_set_blend"] = _composite(h.layer_update("blend", 6, blend="exclusion"))
    q["cmd_reorder"] = _composite(h.reorder(7, 0))
    q["cmd_move_layer"] = _composite(h.move_by(3, -3, 5))
    q["cmd_delete_layer"] = _composite(h.delete(2))
    q["cmd_duplicate_layer"] = _composite(h.duplicate(7))
    q["cmd_add_raster_layer"] = _composite(h.add_layer(Layer(8, blend="add"), 7))
    q["cmd_paste_image_layer"] = lambda s, d: shown(applied(document(s, d), h.add_layer(Layer(8, blend="lighten", opacity=0.5), 7, layer(s, d, 4))))
    q["cmd_add_adjustment_layer"] = _composite(h.add_layer(Layer(20, kind="adjustment", adjust="levels", opacity=0.7, params=LEVELS), 4))
    q["cmd_set_adjustment"] = _composite(h.add_layer(Layer(20, kind="adjustment", adjust="invert", opacity=0.7), 4), h.layer_update("adjust", 20, adjust="levels", params=LEVELS))
    q["cmd_insert_layer_subtree"] = lambda s, d: shown(applied(document(s, d), h.insert_subtree(_other(s, d), 50)))
    q["cmd_crop"] = lambda s, d: shown((doc := applied(document(s, d), h.crop(BOX))), doc.canvas)
    q["cmd_resize_canvas"] = _composite(h.resize(101, 31, "c"))
    q["cmd_batch"] = _composite(h.batch("both", [h.layer_update("opacity", 2, opacity=0.3), h.layer_update("blend", 6, blend="exclusion")]))

    def renamed(s: SparkSession, d: str) -> DataFrame:
        doc = applied(document(s, d), h.layer_update("rename", 2, name="tint"), h.duplicate(2))
        names = F.create_map(*[F.lit(v) for x in doc.tree.by_id.values() for v in (x.id, x.name)])
        return doc.pixels.groupBy("layer_id").agg(F.count(F.lit(1)).alias("n")).select("layer_id", names[F.col("layer_id")].alias("name"), "n")

    q["cmd_rename"] = renamed

    def locked(s: SparkSession, d: str) -> DataFrame:
        log = h.History(document(s, d))
        log.do(h.layer_update("lock", 1, locked=True))
        refused = []
        for c in (h.set_buffer(1, layer(s, d, 2)), h.move_by(1, 1, 1), h.flip(1, "x"), h.merge(2, 1)):
            try:
                log.do(c)
            except h.CommandError:
                refused.append(c.name)
        return shown(log.document).withColumn("refused", F.lit(len(refused)))

    q["cmd_set_layer_locked"] = locked
    edits = lambda s: s.createDataFrame([(3, -4, 0.1, 0.2, 0.3, 1.0), (0, 0, 0.0, 0.0, 0.0, 0.0)], "x int, y int, r double, g double, b double, a double")
    q["cmd_paint"] = _layer(1, lambda s, d: (document(s, d), [h.paint(1, edits(s))]))
    q["cmd_brush_stroke"] = _layer(1, lambda s, d: (document(s, d), [h.paint(1, layer(s, d, 2).filter(SEL_A_RECT.contains()))]))
    one = lambda s, d: base._middle(s, d).select("stroke_id", F.lit(1).alias("seq"), F.col("cx").alias("px"), F.col("cy").alias("py"), "pressure")
    q["cmd_paint_stroke"] = _layer(1, lambda s, d: (document(s, d), [h.paint_stroke(1, one(s, d), brush.Brush(14.0, 0.4, 0.8), (0.9, 0.2, 0.1, 1.0))]))
    q["cmd_erase_stroke"] = _layer(1, lambda s, d: (document(s, d), [h.paint_stroke(1, one(s, d), brush.Brush(14.0, 0.4, 0.8), erase=True)]))
    sel = lambda s: selection.ellipse(s, SEL_A_RECT)
    q["cmd_copy_to_new_layer"] = _layer(8, lambda s, d: (document(s, d, sel=sel(s)), [h.copy_to_layer(1)]))

    def cut(s: SparkSession, d: str) -> DataFrame:
        doc = applied(document(s, d, sel=sel(s)), h.copy_to_layer(1, True))
        return base.show(doc.pixels.filter("layer_id in (1, 8)"), "layer_id")

    q["cmd_cut_to_new_layer"] = cut
    q["cmd_set_selection"] = lambda s, d: base.cov(applied(document(s, d), h.select("replace", sel(s)), h.select("subtract", base._mask(s, d))).selection)
    q["cmd_combine_selection"] = lambda s, d: base.cov(applied(document(s, d), h.select("replace", sel(s)), h.select("add", base._mask(s, d))).selection)
    q["cmd_invert_selection"] = lambda s, d: base.cov(applied(document(s, d, sel=base._mask(s, d)), h.change_selection("invert", selection.invert)).selection)
    q["cmd_feather_selection"] = lambda s, d: base.cov(applied(document(s, d, sel=base._mask(s, d)), h.change_selection("feather", lambda x, c: selection.feather(x, 1.5))).selection)
    q["cmd_grow_selection"] = lambda s, d: base.cov(applied(document(s, d, sel=base._mask(s, d)), h.change_selection("grow", lambda x, c: selection.grow(x, 2))).selection)
    q["cmd_shrink_selection"] = lambda s, d: base.cov(applied(document(s, d, sel=base._full(s, d)), h.change_selection("shrink", lambda x, c: selection.shrink(x, 1))).selection)
    grey = lambda s, d: document(s, d, base._grey(s, d).withColumn("layer_id", F.lit(1)), LayerTree([Layer(1)]))
    q["cmd_magic_wand"] = lambda s, d: base.cov(applied(grey(s, d), h.wand(1, 20, 20, 0.12)).selection)

    def bucket(s: SparkSession, d: str) -> DataFrame:
        doc = h.replace(grey(s, d), canvas=base._extent(s, d))
        return base.show(applied(doc, h.bucket(1, 20, 20, (0.9, 0.2, 0.1, 1.0), 0.25)).of(1))

    q["cmd_paint_bucket"] = bucket
    q["cmd_fill_selection"] = _layer(1, lambda s, d: (document(s, d, sel=sel(s)), [h.fill(1, (0.2, 0.4, 0.6, 0.9), 0.8)]))
    q["cmd_stroke_selection"] = _layer(1, lambda s, d: (document(s, d), [h.stroke_selection(1, BOX, 5.0, RED, 0.7)]))
    q["cmd_gradient_fill"] = _layer(1, lambda s, d: (document(s, d), [h.gradient(1, "linear", (-10.0, -6.0), (14.0, 9.0), (0.1, 0.2, 0.3, 1.0), (0.9, 0.8, 0.4, 0.5), opacity=0.9)]))
    q["cmd_merge_down"] = _layer(1, lambda s, d: (document(s, d), [h.merge(2, 1)]))
    q["cmd_flip_layer"] = _layer(1, lambda s, d: (document(s, d), [h.flip(1, "x")]))
    q["cmd_transform_layer"] = lambda s, d: base.show(applied(grey(s, d), h.transform(1, (0.0, 1.0, -1.0, 0.0, 5.0, 7.0))).of(1))
    q["cmd_set_layer_buffer"] = _layer(1, lambda s, d: (document(s, d), [h.set_buffer(1, layer(s, d, 2))]))
    q["cmd_replace_layer_buffer"] = _layer(1, lambda s, d: (document(s, d), [h.set_buffer(1, layer(s, d, 3)), h.set_buffer(1, layer(s, d, 2))]))
    invert = lambda px, b: tiles.read_rect(px, b).select("x", "y", *[n.alias(c) for n, c in zip(adjust.adjusted("invert", [color.clamp01(F.col(c)) for c in "rgb"], "euclid"), "rgb", strict=True)], "a")
    q["cmd_apply_filter"] = _layer(3, lambda s, d: (document(s, d), [h.apply_filter(3, invert)]))

    def masked(*commands: h.Command) -> Query:
        def run(s: SparkSession, d: str) -> DataFrame:
            doc = document(s, d, sel=base._mask(s, d))
            return shown(applied(h.replace(doc, masks=base._masks(s, d)), *commands))

        return run

    q["cmd_set_layer_mask"] = masked()
    q["cmd_delete_layer_mask"] = masked(h.set_mask(2, "delete"))
    q["cmd_apply_layer_mask"] = masked(h.set_mask(2, "apply"))
    q["cmd_add_layer_mask"] = masked(h.set_mask(2, "delete"), h.set_mask(2, "reveal_selection"))
    q["cmd_hide_all_mask"] = masked(h.set_mask(2, "hide_all"))

    def reveal(s: SparkSession, d: str) -> DataFrame:
        mask = applied(document(s, d), h.set_mask(1, "reveal_all")).masks
        return mask.groupBy(tiles.tile_of(F.col("x")).alias("tx"), tiles.tile_of(F.col("y")).alias("ty")).agg(F.count(F.lit(1)).alias("n"), F.sum("cov").alias("cov"))

    q["cmd_reveal_all_mask"] = reveal

    def slices(s: SparkSession, d: str) -> DataFrame:
        doc = applied(document(s, d), *[h.add_slice(n, Rect(x, y, a, b)) for n, x, y, a, b in (("top left", -32, -32, 10, 12), ("mid/é", -4, -4, 9, 7), ("none", 0, 0, 0, 5))])
        table = s.createDataFrame([(n, r.x, r.y, r.w, r.h) for n, r in doc.slices], "name string, sx int, sy int, sw int, sh int")
        return base.show(raster.slice_rows(doc.of(1), table), "file")

    q["cmd_add_slice"] = slices

    def undone(s: SparkSession, d: str) -> DataFrame:
        """Cut, move, invert, merge, all undone: the document as it was; then all done again but the last."""
        log = h.History(document(s, d, sel=sel(s)))
        steps = [h.copy_to_layer(1, True), h.move_by(8, 8, 4), h.flip(3, "y"), h.delete(6), h.merge(2, 1)]
        for c in steps:
            log.do(c)
        while log.undo():
            pass
        before = shown(log.document).withColumn("part", F.lit("undone"))
        log.redo(), log.redo(), log.undo()
        return before.unionByName(base.show(log.document.pixels.filter("layer_id in (1, 8)")).withColumn("part", F.lit("redone")))

    q["cmd_undo_redo"] = undone
    # vectors
    q["vector_rasterize"] = lambda s, d: vector.rasterize(_paths(s, d)).select("layer_id", "x", "y", "r", "g", "b", "a")
    add = lambda s, d: h.add_vector(Layer(8, kind="raster", name="shape"), _paths(s, d).filter("layer_id = 1"), 7)
    q["cmd_add_vector_layer"] = lambda s, d: applied(document(s, d), add(s, d)).of(8).select("x", "y", "r", "g", "b", "a")
    q["cmd_edit_vector"] = lambda s, d: applied(document(s, d), add(s, d), h.edit_vector(8, lambda p: vector.moved(p, 5, -3))).of(8).select("x", "y", "r", "g", "b", "a")
    q["cmd_edit_svg_vector"] = lambda s, d: applied(document(s, d), add(s, d), h.edit_vector(8, lambda p: _paths(s, d).filter("layer_id = 2").withColumn("layer_id", F.lit(8)))).of(8).select("x", "y", "r", "g", "b", "a")
    # retouching beyond queries.py
    q["blur_brush"] = lambda s, d: base.show(retouch.toward_neighbourhood(layer(s, d, 1), base._cover(s, d), _box_means(s, d)))
    q["spot_heal"] = lambda s, d: base.show(retouch.toward_neighbourhood(layer(s, d, 1), base._cover(s, d), stencil.box_mean(layer(s, d, 1), CANVAS, 4)))
    q["sharpen_brush"] = lambda s, d: base.show(retouch.toward_neighbourhood(layer(s, d, 1), base._cover(s, d), _box_means(s, d), 0.8))
    q["unpremultiply"] = lambda s, d: base.show(pixels(s, d).select("layer_id", "x", "y", *raster.named(color.unpremultiply(*color.premultiply(*raster.pixel())))), "layer_id")
    q["sel_point"] = lambda s, d: selection.coverage_at(base._mask(s, d), 3, -4).select(base.rounded(F.col("cov")).alias("cov"))
    q["sel_tiles"] = lambda s, d: selection.selected_tiles(base._mask(s, d), 250, -7)
    # views
    views = lambda s, d: s.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("id"), ((F.col("o_orderkey") % 5000) * 0.75 - 1000.0).alias("pan_x"), (F.col("o_custkey") * -1.25).alias("pan_y"), ((F.col("o_orderkey") % 8 + 1) / 64.0).alias("zoom"), F.lit(1920).alias("w"), F.lit(1080).alias("h"))
    q["visible_region"] = lambda s, d: view.visible_region(views(s, d).withColumn("zoom", F.col("zoom") / 8.0)).select("id", "x", "y", "vw", "vh")
    there = lambda s, d: views(s, d).select("id", *[base.rounded(view.to_screen(F.col(c), 12.5, 0.25, 40.0)).alias(n) for c, n in (("pan_x", "sx"), ("pan_y", "sy"))], *[base.rounded(view.to_document(view.to_screen(F.col(c), 12.5, 0.25, 40.0), 12.5, 0.25, 40.0)).alias(n) for c, n in (("pan_x", "bx"), ("pan_y", "back_y"))])
    q["screen_transform"] = there
    q["grid_lines"] = lambda s, d: view.grid_lines(views(s, d).select("id", F.col("pan_x").alias("lo"), (F.col("pan_x") + 90.5).alias("hi")), 16).select("id", "at")
    half = lambda px, r, k: tiles.stored(tiles.read_rect(px, r).select("x", "y", *[(1.0 - F.col(c)).alias(c) for c in "rgb"], "a"))
    q["filter_preview"] = lambda s, d: base.show(view.preview(base._grey(s, d), half, LONGEST_PREVIEW))
    # trees of many documents: a nation's customers in groups by market segment
    q["render_order_many"] = lambda s, d: tree_tables.render_order(_forest(s, d)).select("doc_id", "pos", "id", "depth")
    q["visible_leaves_many"] = lambda s, d: tree_tables.visible_leaves(_forest(s, d))
    q["descendants_many"] = lambda s, d: tree_tables.descendants(_forest(s, d), _forest(s, d).filter("parent is null"))
    # streams and plug-ins
    q["latest_requests"] = lambda s, d: strokes.latest_requests(s.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("kind"), F.col("event_id").alias("id"), F.col("value").alias("payload")))
    q["changed_tiles"] = lambda s, d: strokes.changed_tiles(strokes.tile_signatures(pixels(s, d)), strokes.tile_signatures(pixels(s, d).filter("not (layer_id = 1 and x < 0 and y < 0)")))
    q["save_load_native"] = _saved
    return q


SEL_A_RECT = Rect(SEL_A.x, SEL_A.y, SEL_A.w, SEL_A.h)


def preview_sql(longest: int) -> str:
    """The inverted copy of the grey image, bilinear at places / scale; places of the window that nothing reaches are transparent black before."""
    ctes = [
        "bd AS (SELECT min(x) AS x0, min(y) AS y0, max(x) - min(x) + 1 AS bw, max(y) - min(y) + 1 AS bh, greatest(max(x) - min(x), max(y) - min(y)) + 1 AS m FROM grey WHERE r <> 0 OR g <> 0 OR b <> 0 OR a <> 0)",
        f"sc AS (SELECT *, least(1.0::DOUBLE, {longest}::DOUBLE / m) AS s, CASE WHEN m <= {longest} THEN bw ELSE (bw * {longest}::BIGINT + m - 1) // m END AS sw, CASE WHEN m <= {longest} THEN bh ELSE (bh * {longest}::BIGINT + m - 1) // m END AS sh FROM bd)",
        "gr AS (SELECT x, CAST(unnest(range(sh)) AS INT) AS y, s / (s * s) AS k, s, x0, y0 FROM (SELECT *, CAST(unnest(range(sw)) AS INT) AS x FROM sc))",
        "fl AS (SELECT x, y, CAST(floor(sx) AS INT) AS ix, CAST(floor(sy) AS INT) AS iy, sx - floor(sx) AS fx, sy - floor(sy) AS fy FROM (SELECT *, x * k + k * (x0 * s) AS sx, y * k + k * (y0 * s) AS sy FROM gr))",
        "tp AS (SELECT x, y, ix + i AS qx, iy + j AS qy, (CASE WHEN i = 0 THEN 1 - fx ELSE fx END) * (CASE WHEN j = 0 THEN 1 - fy ELSE fy END) AS wv FROM fl, range(0, 2) u(i), range(0, 2) v(j))",
        "sm AS (SELECT tp.x, tp.y, " + ", ".join(f"sum(wv * p.{c} * p.a) AS {c}" for c in "rgb") + ", sum(wv * p.a) AS a FROM tp JOIN grey p ON p.x = qx AND p.y = qy WHERE wv <> 0 GROUP BY 1, 2)",
        "iv AS (SELECT gr.x, gr.y, " + ", ".join(f"1 - coalesce(CASE WHEN a > 0 THEN {c} / a END, 0.0) AS {c}" for c in "rgb") + ", coalesce(CASE WHEN a > 0 THEN a END, 0.0) AS a FROM gr LEFT JOIN sm ON sm.x = gr.x AND sm.y = gr.y)",
    ]
    return w(sql.GREY, *ctes) + f"SELECT {ALL} FROM iv WHERE r <> 0 OR g <> 0 OR b <> 0 OR a <> 0"


def oracle_sql() -> dict[str, str]:
    b = sql.oracle_sql()
    q: dict[str, str] = {}
    with_ = lambda i, entry: [entry if k == i else x for k, x in enumerate(FLAT)]
    q["cmd_set_visible"] = flat_sql([*FLAT[:3], ("l4", "overlay", "1.0"), *FLAT[3:]])
    q["cmd_set_opacity"] = flat_sql(with_(1, ("l2", "multiply", "0.3")))
    q["cmd_set_blend"] = flat_sql(with_(3, ("l6", "exclusion", "0.5")))
    q["cmd_reorder"] = flat_sql([FLAT[4], *FLAT[:4]])
    q["cmd_move_layer"] = flat_sql(with_(2, ("l3", "screen", "0.6")))
    q["cmd_delete_layer"] = flat_sql([FLAT[0], *FLAT[2:]])
    q["cmd_duplicate_layer"] = flat_sql([*FLAT, FLAT[4]])
    q["cmd_add_raster_layer"] = q["cmd_set_layer_locked_"] = b["composite_flat"]
    q["cmd_paste_image_layer"] = flat_sql([*FLAT, ("l4", "lighten", "0.5")])
    q["cmd_add_adjustment_layer"] = q["cmd_set_adjustment"] = b["composite_adjustment"]
    q["cmd_insert_layer_subtree"] = flat_sql([*FLAT, ("g2", "screen", "0.5")], *stack([("l5", "normal", "1.0"), ("l4", "multiply", "0.5")], "g"))
    q["cmd_crop"] = flat_sql(FLAT, tail=f"WHERE {inside(BOX)}")
    q["cmd_resize_canvas"] = flat_sql(FLAT, columns="x + 18 AS x, y - 16 AS y, " + rgba())
    q["cmd_batch"] = flat_sql([FLAT[0], ("l2", "multiply", "0.3"), FLAT[2], ("l6", "exclusion", "0.5"), FLAT[4]])
    q["cmd_rename"] = w(PX) + "SELECT layer_id, CASE layer_id WHEN 1 THEN 'base' WHEN 2 THEN 'tint' ELSE '' END AS name, count(*) AS n FROM px GROUP BY 1, 2 UNION ALL SELECT 8, 'tint copy', count(*) FROM px WHERE layer_id = 2"
    q["cmd_set_layer_locked"] = f"SELECT *, 4 AS refused FROM ({q.pop('cmd_set_layer_locked_')})"
    q["cmd_paint"] = b["set_pixel"]
    q["cmd_brush_stroke"] = w(PX, L[1], L[2]) + f"SELECT {ALL} FROM (SELECT * FROM l2 WHERE {inside(SEL_A)} UNION ALL SELECT * FROM l1 p WHERE NOT ({inside(SEL_A)} AND EXISTS (SELECT 1 FROM l2 WHERE l2.x = p.x AND l2.y = p.y)))"
    q["cmd_paint_stroke"] = b["stamp_single"]
    k = "mid AS (SELECT (min(cx) + max(cx)) * 0.5 AS cx, (min(cy) + max(cy)) * 0.5 AS cy FROM k)"
    t = "least(sqrt(pow(x + 0.5 - cx, 2) + pow(y + 0.5 - cy, 2)) / 7.0, 1.0)"
    left = f"a * (1 - CASE WHEN {t} >= 1 THEN 0.0 WHEN {t} <= 0 THEN 0.8 ELSE 0.8 * (1 - pow({t}, 1.0::DOUBLE / 0.6)) END)"
    q["cmd_erase_stroke"] = w(PX, L[1], sql.STAMPS, k) + f"SELECT x, y, {', '.join(R(c, c) for c in 'rgb')}, {R(left, 'a')} FROM l1, mid"
    q["cmd_copy_to_new_layer"] = b["extract"]
    q["cmd_cut_to_new_layer"] = f"SELECT 8 AS layer_id, * FROM ({b['extract']}) UNION ALL SELECT 1, * FROM ({b['erase']})"
    q["cmd_set_selection"], q["cmd_combine_selection"], q["cmd_invert_selection"] = b["sel_subtract"], b["sel_union"], b["sel_invert"]
    q["cmd_feather_selection"], q["cmd_grow_selection"], q["cmd_shrink_selection"] = sql.feathered(*sql.MASKED), sql.grown(*sql.MASKED), b["sel_shrink"]
    q["cmd_magic_wand"] = b["magic_wand"]
    q["cmd_paint_bucket"] = upserted(b["bucket_fill"], "grey", (sql.GREY,))
    q["cmd_fill_selection"], q["cmd_stroke_selection"], q["cmd_gradient_fill"] = (upserted(b[x]) for x in ("fill_selection", "stroke_selection", "gradient_linear"))
    q["cmd_merge_down"] = b["merge_down"]
    q["cmd_flip_layer"] = w(PX, L[1]) + f"SELECT (SELECT min(x) + max(x) FROM l1) - x AS x, y, {rgba()} FROM l1"
    q["cmd_transform_layer"] = w(sql.GREY) + f"SELECT 5 - y AS x, x + 7 AS y, {rgba()} FROM grey WHERE y > 0"
    q["cmd_set_layer_buffer"] = q["cmd_replace_layer_buffer"] = w(PX, L[2]) + f"SELECT {ALL} FROM l2"
    bound = "gr AS (SELECT CAST(i AS INT) AS x, CAST(j AS INT) AS y FROM (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM l3), range(-32, 32) p(i), range(-32, 32) q(j) WHERE i BETWEEN x0 AND x1 AND j BETWEEN y0 AND y1)"
    q["cmd_apply_filter"] = w(PX, L[3], bound) + f"SELECT x, y, {', '.join(R(f'1 - {sql.clamp(f'coalesce({c}, 0.0)')}', c) for c in 'rgb')}, {R('coalesce(a, 0.0)', 'a')} FROM gr LEFT JOIN l3 USING (x, y)"
    q["cmd_set_layer_mask"] = q["cmd_apply_layer_mask"] = b["composite_mask"]
    q["cmd_delete_layer_mask"] = b["composite_flat"]
    q["cmd_add_layer_mask"] = flat_sql(with_(1, ("mk", "multiply", "0.8")), "mk AS (SELECT * FROM l2 WHERE EXISTS (SELECT 1 FROM l7 WHERE l7.x = l2.x AND l7.y = l2.y AND l7.r > 0))")
    q["cmd_hide_all_mask"] = flat_sql([FLAT[0], *FLAT[2:]])
    q["cmd_reveal_all_mask"] = w(PX, L[1]) + "SELECT CAST(floor(x / 256.0) AS INT) AS tx, CAST(floor(y / 256.0) AS INT) AS ty, 65536 AS n, 65536.0 AS cov FROM l1 GROUP BY 1, 2"
    q["cmd_add_slice"] = b["slice_export_rows"]
    q["cmd_undo_redo"] = f"SELECT *, 'undone' AS part FROM ({b['composite_flat']}) UNION ALL SELECT *, 'redone' FROM ({b['extract']}) UNION ALL SELECT *, 'redone' FROM ({b['erase']})"
    q["vector_rasterize"] = w(*VECTOR_SQL) + f"SELECT layer_id, x, y, {INKS} FROM vr"
    q["cmd_add_vector_layer"] = w(*VECTOR_SQL) + f"SELECT x, y, {INKS} FROM vr WHERE layer_id = 1"
    q["cmd_edit_vector"] = w(*VECTOR_SQL) + f"SELECT x + 5 AS x, y - 3 AS y, {INKS} FROM vr WHERE layer_id = 1"
    q["cmd_edit_svg_vector"] = w(*VECTOR_SQL) + f"SELECT x, y, {INKS} FROM vr WHERE layer_id = 2"
    mean = lambda r: f"bm AS (SELECT x, y, {', '.join(f'sum({c}) / {(2 * r + 1) ** 2}.0::DOUBLE AS {c}' for c in 'rgba')} FROM (SELECT CAST(l1.x + i AS INT) AS x, CAST(l1.y + j AS INT) AS y, r, g, b, a FROM l1, range(-{r}, {r + 1}) p(i), range(-{r}, {r + 1}) q(j)) WHERE {inside(CANVAS)} GROUP BY x, y)"

    def toward(r: int, target: dict[str, str]) -> str:
        both = ", ".join(f"coalesce(l1.{c}, 0.0) AS {c}, coalesce(bm.{c}, 0.0) AS s{c}" for c in "rgba")
        mix = {c: f"{c} + ({target[c]} - {c}) * cov" for c in "rgba"}
        moved_ = " + ".join(f"abs({mix[c]} - {c})" for c in "rgba")
        return w(*sql.RETOUCH, mean(r), f"j AS (SELECT cover.x, cover.y, cov, {both} FROM cover LEFT JOIN l1 USING (x, y) LEFT JOIN bm USING (x, y))", f"o AS (SELECT x, y, {', '.join(f'{e} AS {c}' for c, e in mix.items())}, {moved_} AS moved FROM j)") + f"SELECT CAST(x AS INT) AS x, CAST(y AS INT) AS y, {rgba()} FROM o WHERE moved > 1e-4"

    soft = {c: f"s{c}" for c in "rgba"}
    q["blur_brush"], q["spot_heal"] = toward(2, soft), toward(4, soft)
    q["sharpen_brush"] = toward(2, {c: sql.clamp(f"({c} + 0.8 * ({c} - s{c}))") for c in "rgb"} | {"a": "a"})
    q["unpremultiply"] = w(PX) + f"SELECT layer_id, {ALL} FROM px"
    q["sel_point"] = w(PX) + f"SELECT {R('coalesce(max(r), 0.0)', 'cov')} FROM px WHERE layer_id = 7 AND x = 3 AND y = -4"
    q["sel_tiles"] = w(PX) + "SELECT DISTINCT CAST(floor((x - 250) / 256.0) AS INT) AS tx, CAST(floor((y + 7) / 256.0) AS INT) AS ty FROM px WHERE layer_id = 7 AND r > 0"
    view_sql = "vw AS (SELECT o_orderkey AS id, (o_orderkey % 5000) * 0.75::DOUBLE - 1000 AS px, o_custkey * -1.25::DOUBLE AS py, (o_orderkey % 8 + 1) / 64.0::DOUBLE AS zm FROM orders)"
    span = lambda p, n: f"ceil({p} + {n} / (zm / 8)) - floor({p})"
    cut_ = lambda p, n: f"CAST(floor({p}) + floor(greatest({span(p, n)} - 65536, 0) / 2) AS BIGINT)"
    q["visible_region"] = w(view_sql) + f"SELECT id, {cut_('px', 1920)} AS x, {cut_('py', 1080)} AS y, CAST(least({span('px', 1920)}, 65536) AS BIGINT) AS vw, CAST(least({span('py', 1080)}, 65536) AS BIGINT) AS vh FROM vw"
    q["screen_transform"] = w(view_sql) + f"SELECT id, {R('40 + (px - 12.5) * 0.25::DOUBLE', 'sx')}, {R('40 + (py - 12.5) * 0.25::DOUBLE', 'sy')}, {R('px', 'bx')}, {R('py', 'back_y')} FROM vw"
    q["grid_lines"] = w(view_sql) + "SELECT id, unnest(range(CAST(floor(floor(px) / 16) * 16 AS BIGINT), CAST(floor(ceil(px + 90.5) / 16) * 16 AS BIGINT) + 1, 16)) AS at FROM vw"
    q["filter_preview"] = preview_sql(LONGEST_PREVIEW)
    q["render_order_many"] = w(*FOREST_SQL, "fo AS (SELECT doc_id, id, 0 AS depth, id AS g, -1 AS i, 0 AS k FROM fg UNION ALL SELECT doc_id, id, 1, parent, id % 7, id FROM fc)") + "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY g, depth, i, k) - 1 AS pos, id, depth FROM fo"
    q["visible_leaves_many"] = w(*FOREST_SQL) + "SELECT doc_id, id FROM fc WHERE id % 5 > 0 AND bal >= 0 AND parent % 3 <> 0"
    q["descendants_many"] = w(*FOREST_SQL) + "SELECT doc_id, parent AS root, id FROM fc"
    q["latest_requests"] = "SELECT event_type AS kind, max(event_id) AS id, arg_max(value, event_id) AS payload FROM events GROUP BY 1"
    q["changed_tiles"] = w(PX) + "SELECT DISTINCT CAST(floor(x / 256.0) AS INT) AS tx, CAST(floor(y / 256.0) AS INT) AS ty FROM px WHERE layer_id = 1 AND x < 0 AND y < 0"
    q["save_load_native"] = w(PX) + f"SELECT layer_id, {ALL} FROM px"
    return q
