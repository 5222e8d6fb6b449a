"""Queries over many documents in one job: op-logs as a table and forests of layers. Documents are users, log rows their events."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tilestrata import fixtures as fx
from tilestrata import queries as base
from tilestrata import wide_queries as wide
from tilestrata.operators.tiles import Rect
from tilestrata.oracles import FLAT_CTES, R, rgba, w
from tilestrata.plans import forest, oplog
from tilestrata.plans.history import Document
from tilestrata.scratch import new_path
from tilestrata.sources import icc, large_raster, native
from tilestrata.streaming import live

Query = Callable[[SparkSession, str], DataFrame]
LIMIT, VERSION = 12, 30
SIDE = 24


def _long(c: Column) -> Column:
    return c.cast("long")


def log(s: SparkSession, d: str) -> DataFrame:
    """An op-log for each user: views undo and redo, clicks paint, errors fill and clear, sign-ups set opacities (which coalesce), purchases change layers."""
    e = s.read.parquet(f"{d}/events.parquet")
    k, kind = F.col("event_id"), F.col("event_type")
    e = e.withColumns({"seq": _long(F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))), "k": k})
    change = F.element_at(F.array(*[F.lit(x) for x in ("add_layer", "delete_layer", "rename", "set_blend", "move", "set_locked")]), (k % 6 + 1).cast("int"))
    view = F.when(k % 3 == 0, "undo").when(k % 3 == 1, "redo").otherwise("set_visible")
    op = F.when(kind == "view", view).when(kind == "signup", "set_opacity").when(kind == "click", "paint").when(kind == "error", F.when(k % 2 == 0, "clear").otherwise("fill")).otherwise(change)
    e = e.withColumn("op", op)
    layer = F.when(F.col("op") == "add_layer", 100 + k).when((F.col("op") == "delete_layer") & (k % 12 == 1), 10).otherwise(1 + k % 4)
    mode = F.element_at(F.array(F.lit("normal"), F.lit("multiply"), F.lit("screen")), (F.floor(k / 6) % 3 + 1).cast("int"))
    name = F.when(F.col("op") == "set_blend", mode).otherwise(F.concat(F.lit("n"), k.cast("string")))
    at = {"x": F.when(F.col("op") == "move", k % 7 - 3).otherwise(k % 20), "y": F.when(F.col("op") == "move", k % 5 - 2).otherwise(F.floor("value") % 20), "w": F.when(F.col("op") == "paint", 1 + k % 2).otherwise(2 + k % 5), "h": 1 + k % 4}
    ink = {"r": (k % 7) / 6, "g": (k % 5) / 4, "b": (k % 3) / 2, "a": (k % 9) / 8}
    e = e.withColumns({"layer_id": layer.cast("long"), "name": name, "flag": k % 2 == 0} | {c: v.cast("int") for c, v in at.items()} | {c: v.cast("double") for c, v in ink.items()})
    key = F.when(F.col("op") == "set_opacity", F.concat(F.lit("opacity:"), F.col("layer_id").cast("string")))
    return e.select(F.col("user_id").cast("long").alias("doc_id"), "seq", "op", key.alias("key"), "layer_id", "flag", (F.col("value") / 100.0).alias("value"), "name", "x", "y", "w", "h", "r", "g", "b", "a")


LOG_SQL = f"""lg AS (SELECT *, CASE WHEN op = 'set_opacity' THEN 'opacity:' || layer_id END AS key FROM (
SELECT user_id::BIGINT AS doc_id, seq, op, k, CASE WHEN op = 'add_layer' THEN 100 + k WHEN op = 'delete_layer' AND k % 12 = 1 THEN 10 ELSE 1 + k % 4 END AS layer_id,
  k % 2 = 0 AS flag, value / 100.0 AS value, CASE WHEN op = 'set_blend' THEN ['normal', 'multiply', 'screen'][(k // 6) % 3 + 1] ELSE 'n' || k END AS name,
  CASE WHEN op = 'move' THEN k % 7 - 3 ELSE k % 20 END AS x, CASE WHEN op = 'move' THEN k % 5 - 2 ELSE CAST(floor(value) AS BIGINT) % 20 END AS y,
  CASE WHEN op = 'paint' THEN 1 + k % 2 ELSE 2 + k % 5 END AS w, 1 + k % 4 AS h, (k % 7) / 6.0::DOUBLE AS r, (k % 5) / 4.0::DOUBLE AS g, (k % 3) / 2.0::DOUBLE AS b, (k % 9) / 8.0::DOUBLE AS a
FROM (SELECT *, event_id AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq,
  CASE event_type WHEN 'view' THEN ['undo', 'redo', 'set_visible'][event_id % 3 + 1] WHEN 'signup' THEN 'set_opacity' WHEN 'click' THEN 'paint' WHEN 'error' THEN CASE WHEN event_id % 2 = 0 THEN 'clear' ELSE 'fill' END
  ELSE ['add_layer', 'delete_layer', 'rename', 'set_blend', 'move', 'set_locked'][event_id % 6 + 1] END AS op FROM events)))"""
#: The two stacks, a version at a time for all documents; `kept` are steps beyond the limit.
STACKS_SQL = f"""mc AS (SELECT DISTINCT doc_id, 0::BIGINT AS seq, []::BIGINT[] AS done, []::VARCHAR[] AS dk, []::BIGINT[] AS undone, []::VARCHAR[] AS uk, []::BIGINT[] AS kept, NULL::BIGINT AS step FROM lg
UNION ALL SELECT doc_id, seq, CASE WHEN len(done) > {LIMIT} THEN done[2:] ELSE done END, CASE WHEN len(done) > {LIMIT} THEN dk[2:] ELSE dk END, undone, uk, CASE WHEN len(done) > {LIMIT} THEN kept || done[1:1] ELSE kept END, step FROM (
  SELECT m.doc_id, l.seq,
    CASE WHEN l.op = 'undo' THEN m.done[:len(m.done) - 1] WHEN l.op = 'redo' THEN m.done || m.undone[len(m.undone):] WHEN joins THEN m.done ELSE m.done || [l.seq] END AS done,
    CASE WHEN l.op = 'undo' THEN m.dk[:len(m.dk) - 1] WHEN l.op = 'redo' THEN m.dk || m.uk[len(m.uk):] WHEN joins THEN m.dk ELSE m.dk || [l.key] END AS dk,
    CASE WHEN l.op = 'undo' THEN m.undone || m.done[len(m.done):] WHEN l.op = 'redo' THEN m.undone[:len(m.undone) - 1] ELSE [] END AS undone,
    CASE WHEN l.op = 'undo' THEN m.uk || m.dk[len(m.dk):] WHEN l.op = 'redo' THEN m.uk[:len(m.uk) - 1] ELSE [] END AS uk, m.kept,
    CASE WHEN l.op IN ('undo', 'redo') THEN NULL WHEN joins THEN m.done[len(m.done)] ELSE l.seq END AS step
  FROM mc m JOIN lg l ON l.doc_id = m.doc_id AND l.seq = m.seq + 1, LATERAL (SELECT coalesce(len(m.done) > 0 AND l.key = m.dk[len(m.dk)], false) AS joins) j))"""


def _held_sql(version: str, name: str) -> str:
    last = f"SELECT doc_id, max(seq) AS seq FROM mc WHERE seq <= {version} GROUP BY 1"
    return f"{name} AS (SELECT lg.*, c.step FROM lg JOIN mc c USING (doc_id, seq) JOIN (SELECT m.doc_id, m.seq AS until, m.kept || m.done AS held FROM mc m JOIN ({last}) t USING (doc_id, seq)) v ON v.doc_id = lg.doc_id AND lg.seq <= v.until AND list_contains(v.held, c.step) WHERE c.step IS NOT NULL)"


def trees(s: SparkSession, d: str) -> DataFrame:
    """Each document's tree before its log: layers 1 and 2, a group 10 of layers 3 and 4, and an adjustment 11 on top."""
    docs = s.read.parquet(f"{d}/events.parquet").select(F.col("user_id").cast("long").alias("doc_id")).distinct()
    rows = [(1, None, 0, "raster", "normal", 1.0, 0), (2, None, 1, "raster", "multiply", 0.8, 2), (10, None, 2, "group", "screen", 0.7, 1), (3, 10, 0, "raster", "normal", 1.0, 0), (4, 10, 1, "raster", "multiply", 0.9, -1), (11, None, 3, "adjustment", "normal", 0.5, 0)]
    one = F.array(*[F.struct(F.lit(i).cast("long").alias("id"), F.lit(p).cast("long").alias("parent"), F.lit(n).cast("long").alias("idx"), F.lit(k).alias("kind"), F.lit(m).alias("blend"), F.lit(o).alias("opacity"), F.lit(x).alias("dx")) for i, p, n, k, m, o, x in rows])
    out = docs.select("doc_id", F.explode(one).alias("l")).select("doc_id", "l.*")
    return out.select("doc_id", "id", "parent", "idx", "kind", F.concat(F.lit("layer "), F.col("id").cast("string")).alias("name"), F.lit(True).alias("visible"), F.lit(False).alias("locked"), "opacity", "blend", F.col("dx").cast("int").alias("dx"), F.lit(0).alias("dy"))


TREES_SQL = "tr AS (SELECT doc_id, id, parent, idx, kind, 'layer ' || id AS name, true AS visible, false AS locked, opacity, blend, dx, 0 AS dy FROM (SELECT DISTINCT user_id::BIGINT AS doc_id FROM events), (VALUES (1, NULL, 0, 'raster', 'normal', 1.0::DOUBLE, 0), (2, NULL, 1, 'raster', 'multiply', 0.8, 2), (10, NULL, 2, 'group', 'screen', 0.7, 1), (3, 10, 0, 'raster', 'normal', 1.0, 0), (4, 10, 1, 'raster', 'multiply', 0.9, -1), (11, NULL, 3, 'adjustment', 'normal', 0.5, 0)) t(id, parent, idx, kind, blend, opacity, dx))"


def painted(s: SparkSession, d: str) -> DataFrame:
    """Pixels of the layers before the log."""
    e = s.read.parquet(f"{d}/events.parquet")
    k = F.col("event_id")
    top = e.groupBy(F.col("user_id").cast("long").alias("doc_id"), (1 + k % 4).alias("layer_id"), (k * 7 % SIDE).cast("int").alias("x"), (F.floor("value") % SIDE).cast("int").alias("y")).agg(F.max("event_id").alias("k"))
    k = F.col("k")
    return top.select("doc_id", "layer_id", "x", "y", ((k % 11) / 10).alias("r"), ((k % 4) / 3).alias("g"), ((k % 6) / 5).alias("b"), ((1 + k % 3) / 3).alias("a"))


PAINTED_SQL = f"p0 AS (SELECT doc_id, layer_id, x, y, (k % 11) / 10.0::DOUBLE AS r, (k % 4) / 3.0::DOUBLE AS g, (k % 6) / 5.0::DOUBLE AS b, (1 + k % 3) / 3.0::DOUBLE AS a FROM (SELECT user_id::BIGINT AS doc_id, 1 + event_id % 4 AS layer_id, event_id * 7 % {SIDE} AS x, CAST(floor(value) AS BIGINT) % {SIDE} AS y, max(event_id) AS k FROM events GROUP BY ALL))"
MASK_SQL = "mk AS (SELECT doc_id, layer_id, x, y, ((x + y) % 5) / 4.0::DOUBLE AS cov FROM p0 WHERE layer_id = 2 AND doc_id % 2 = 0)"


def masks(s: SparkSession, d: str) -> DataFrame:
    """Masks of layer 2, in every other document."""
    return painted(s, d).filter("layer_id = 2 AND doc_id % 2 = 0").select("doc_id", "layer_id", "x", "y", (((F.col("x") + F.col("y")) % 5) / 4).alias("cov"))


def active(s: SparkSession, d: str) -> DataFrame:
    return oplog.at(oplog.resolved(log(s, d), LIMIT))


def with_adjustment(tree: DataFrame) -> DataFrame:
    return tree.withColumn("adjust", F.when(F.col("kind") == "adjustment", "invert"))


def _over(acc: str, s: str, mode: str, op: str) -> dict[str, str]:
    """SQL of s over acc."""
    sa = f"least({s}.a * {op}, 1.0)"
    oa = f"({acc}.a + {sa} * (1 - {acc}.a))"
    out = {}
    for c in "rgb":
        d, v = f"{acc}.{c}", f"{s}.{c}"
        m = f"CASE {mode} WHEN 'multiply' THEN {d} * {v} WHEN 'screen' THEN {d} + {v} - {d} * {v} ELSE {v} END"
        out[c] = f"CASE WHEN {sa} <= 0 THEN {d} ELSE ({d} * {acc}.a * (1 - {sa}) + {v} * {sa} * (1 - {acc}.a) + {sa} * {acc}.a * ({m})) / {oa} END"
    return out | {"a": f"CASE WHEN {sa} <= 0 THEN {acc}.a ELSE {oa} END"}


def _folded(rows: str, group: str, order: str) -> str:
    """Rows (r, g, b, a, mode, op, adj) of a group in order, folded by SQL to a column p."""
    o = _over("acc", "e", "e.mode", "e.op")
    inv = {c: f"CASE WHEN acc.a = 0 THEN acc.{c} ELSE acc.{c} + (1 - 2 * acc.{c}) * e.op END" for c in "rgb"} | {"a": "acc.a"}
    fields = ", ".join(f"'{c}': CASE WHEN e.adj THEN {inv[c]} ELSE {o[c]} END" for c in "rgba")
    one = "{'r': r, 'g': g, 'b': b, 'a': a, 'mode': mode, 'op': op, 'adj': adj}"
    zero = "{'r': 0.0::DOUBLE, 'g': 0.0::DOUBLE, 'b': 0.0::DOUBLE, 'a': 0.0::DOUBLE, 'mode': 'normal', 'op': 1.0::DOUBLE, 'adj': false}"
    return f"SELECT {group}, list_reduce([{zero}] || list({one} ORDER BY {order}), lambda acc, e: {{{fields}, 'mode': 'normal', 'op': 1.0::DOUBLE, 'adj': false}}) AS p FROM ({rows}) GROUP BY ALL"


def _saved(s: SparkSession, d: str) -> DataFrame:
    """A document with masks, a selection and vector paths of all strokes, saved as the second version and loaded: every row of its tables."""
    px = wide.pixels(s, d)
    vertices = F.transform(F.array_sort(F.collect_list(F.struct("seq", F.floor("px").cast("int").alias("x"), F.floor("py").cast("int").alias("y")))), lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y")))
    ink = F.struct(*[F.lit(0.5).alias(c) for c in "rgba"])
    paths = fx.strokes(s, d).groupBy("stroke_id").agg(vertices.alias("vertices")).select((1 + F.col("stroke_id") % 7).cast("int").alias("layer_id"), F.col("stroke_id").cast("int").alias("path"), "vertices", F.lit(True).alias("closed"), ink.alias("fill"), ink.alias("stroke"), F.lit(1.0).alias("width"))
    masks = px.filter("layer_id IN (2, 5)").select("layer_id", "x", "y", F.col("g").alias("cov"))
    chosen = px.filter("layer_id = 7").select("x", "y", F.col("b").alias("cov"))
    canvas = Rect(0, 0, native.MAX_SIDE, 8)
    where = new_path(s, "document")
    native.save(Document(canvas, fx.tree(), px.limit(0), masks.limit(0)), where)
    native.save(Document(canvas, fx.tree(), px, masks, chosen, paths=paths, masked=frozenset({2, 5})), where)
    back = native.load(s, where)
    part = lambda df, name, layer, v: df.select(F.lit(name).alias("part"), layer.cast("int").alias("layer_id"), "x", "y", base.rounded(v).alias("v"))
    corners = back.paths.select("layer_id", "path", F.posexplode("vertices").alias("k", "c")).select("layer_id", F.col("c.x").alias("x"), F.col("c.y").alias("y"), (F.col("path") * 1000 + F.col("k")).alias("v"))
    rows = [part(back.pixels, c, F.col("layer_id"), F.col(c)) for c in "rgba"] + [part(back.masks, "mask", F.col("layer_id"), F.col("cov")), part(back.selection, "selection", F.lit(0), F.col("cov")), part(corners, "path", F.col("layer_id"), F.col("v"))]
    return reduce(DataFrame.unionByName, rows)


SAVED_SQL = (
    w(wide.WIDE, f"st AS ({fx.STROKES_SQL})")
    + " UNION ALL ".join(f"SELECT '{c}' AS part, layer_id, x, y, {R(c, 'v')} FROM px" for c in "rgba")
    + f" UNION ALL SELECT 'mask', layer_id, x, y, {R('g', 'v')} FROM px WHERE layer_id IN (2, 5) UNION ALL SELECT 'selection', 0, x, y, {R('b', 'v')} FROM px WHERE layer_id = 7 AND x < 8192"
    + f" UNION ALL SELECT 'path', CAST(1 + stroke_id % 7 AS INT), CAST(floor(px) AS INT), CAST(floor(py) AS INT), {R('stroke_id * 1000 + seq - 1', 'v')} FROM st"
)


def _tiffs(s: SparkSession, d: str) -> DataFrame:
    """Each layer written as an image of strips and read again by its strips."""
    px = wide.pixels(s, d)
    size = s.read.parquet(f"{d}/lineitem.parquet").agg(F.max(F.col("l_orderkey").cast("int"))).first()[0] or 0
    where = new_path(s, "images")
    large_raster.write_tiffs(px, where, "layer_id", Rect(0, 0, size + 1, 8)).count()
    back = large_raster.read(large_raster.blocks(s, where), covered=True)
    return base.show(back.withColumn("layer_id", F.regexp_extract("file", r"(\d+)\.tif$", 1).cast("int")), "layer_id")


#: A profile of wider primaries and the power 2.2 (as profiles round it), and the way back to a narrower power.
WIDE_GAMUT = icc.matrix_profile(((0.64, 0.33), (0.21, 0.71), (0.15, 0.06)), icc.D65, icc.power_curve(2.2))
NARROW = icc.matrix_profile(icc.PRIMARIES, icc.D65, icc.power_curve(1.8))


def _profiled(s: SparkSession, d: str) -> DataFrame:
    """All pixels from one colour profile to another, over the working space."""
    return base.show(icc.convert(wide.pixels(s, d), WIDE_GAMUT, NARROW), "layer_id")


def _profiled_sql() -> str:
    m, n = icc.parse(WIDE_GAMUT).matrix, icc.parse(NARROW).matrix
    to = np.linalg.inv(n) @ m
    lin = [f"pow(least(greatest({c}, 0.0), 1.0), {round(2.2 * 256) / 256}::DOUBLE)" for c in "rgb"]
    out = [f"pow(least(greatest({' + '.join(f'{float(to[i, j])!r}::DOUBLE * {lin[j]}' for j in range(3))}, 0.0), 1.0), {256 / round(1.8 * 256)}::DOUBLE)" for i in range(3)]
    return w(wide.WIDE) + f"SELECT layer_id, x, y, {', '.join(R(e, c) for e, c in zip(out, 'rgb', strict=True))}, {R('a', 'a')} FROM px"


def _edits(s: SparkSession, d: str, px: DataFrame | None = None) -> DataFrame:
    """An edit of a place for each event, with what was there before (px, if it is there already)."""
    k = F.col("event_id")
    e = s.read.parquet(f"{d}/events.parquet").select(k.alias("edit_id"), (1 + k % 7).cast("int").alias("layer_id"), F.floor(F.col("value") * 10).cast("int").alias("x"), (k % 8).cast("int").alias("y"), F.when(k % 5 > 0, F.struct(*[v.alias(c) for c, v in zip("rgba", ((k % 11) / 10, (k % 4) / 3, (k % 6) / 5, (1 + k % 3) / 3), strict=True)])).alias("new"))
    place = ["layer_id", "x", "y"]
    order = Window.partitionBy(*place).orderBy("edit_id")
    first = (wide.pixels(s, d) if px is None else px).select(*place, F.struct(*[F.col(c).cast("double").alias(c) for c in "rgba"]).alias("base"))
    e = e.withColumns({"n": F.row_number().over(order), "before": F.lag("new").over(order)}).join(first, place, "left")
    return e.select("edit_id", *place, F.when(F.col("n") == 1, F.col("base")).otherwise(F.col("before")).alias("old"), "new")


def _streamed(s: SparkSession, d: str) -> DataFrame:
    """The composite after a stream of edits, in three batches."""
    where = new_path(s, "live")
    live.open_document(wide.pixels(s, d), fx.tree(), f"{where}/document")
    _edits(s, d, live.opened(s, f"{where}/document")).write.parquet(f"{where}/all")
    edits = s.read.schema(live.EDIT).parquet(f"{where}/all")
    last = edits.agg(F.max("edit_id")).first()[0] or 0
    for k in range(3):  # the stream takes what has come and goes on where it ended
        edits.filter((F.col("edit_id") * 3 >= k * (last + 1)) & (F.col("edit_id") * 3 < (k + 1) * (last + 1))).write.mode("append").parquet(f"{where}/edits")
        stream = s.readStream.schema(live.EDIT).parquet(f"{where}/edits")
        live.start(stream, fx.tree(), f"{where}/document", once=True).awaitTermination()
    return base.show(live.view(s, f"{where}/document"))


def _prints(s: SparkSession, d: str) -> DataFrame:
    """Fingerprints of tiles after all edits: carried on by the edits alone, against those of the pixels as they are then."""
    place = ["layer_id", "x", "y"]
    old = wide.pixels(s, d).select(*place, *[F.col(c).cast("double").alias(c) for c in "rgba"])
    last = _edits(s, d).groupBy(*place).agg(F.max_by(F.struct("new"), "edit_id").alias("l")).select(*place, F.col("l.new").alias("new"))
    gone = old.join(last.select(*place), place, "left_semi")
    come = last.filter("new IS NOT NULL").select(*place, *[F.col(f"new.{c}").alias(c) for c in "rgba"])
    before = live.fingerprint(old, "layer_id")
    now = live.fingerprint(old.join(last.select(*place), place, "left_anti").unionByName(come), "layer_id")
    keys = ["layer_id", "tx", "ty"]
    carried = live.edited(before, gone, come, "layer_id").select(*keys, F.col("sig").alias("s1"), F.col("n").alias("n1"))
    rows = now.join(carried, keys, "full").join(before.select(*keys, F.col("sig").alias("s0"), F.col("n").alias("n0")), keys, "left")
    return rows.select(*keys, "n", (F.col("sig").eqNullSafe(F.col("s1")) & F.col("n").eqNullSafe(F.col("n1"))).alias("same"), (~(F.col("sig").eqNullSafe(F.col("s0")) & F.col("n").eqNullSafe(F.col("n0")))).alias("changed"))


EDITED_SQL = [
    wide.WIDE.replace("px AS", "px0 AS", 1),
    "ev AS (SELECT event_id AS id, CAST(1 + event_id % 7 AS INT) AS layer_id, CAST(floor(value * 10) AS INT) AS x, CAST(event_id % 8 AS INT) AS y FROM events)",
    "la AS (SELECT layer_id, x, y, max(id) AS k FROM ev GROUP BY 1, 2, 3)",
    "px AS (SELECT * FROM px0 WHERE NOT EXISTS (SELECT 1 FROM la WHERE la.layer_id = px0.layer_id AND la.x = px0.x AND la.y = px0.y) UNION ALL SELECT layer_id, x, y, (k % 11) / 10.0::DOUBLE, (k % 4) / 3.0::DOUBLE, (k % 6) / 5.0::DOUBLE, (1 + k % 3) / 3.0::DOUBLE FROM la WHERE k % 5 > 0)",
]
TILE = "CAST(floor(x / 256.0) AS INT) AS tx, CAST(floor(y / 256.0) AS INT) AS ty"
PRINTS_SQL = (
    w(*EDITED_SQL)
    + f"""SELECT n.layer_id, n.tx, n.ty, n.n, true AS same, c.tx IS NOT NULL AS changed
FROM (SELECT layer_id, {TILE}, count(*) AS n FROM px GROUP BY 1, 2, 3) n
LEFT JOIN (SELECT DISTINCT layer_id, {TILE} FROM ((SELECT * FROM px EXCEPT SELECT * FROM px0) UNION ALL (SELECT * FROM px0 EXCEPT SELECT * FROM px))) c USING (layer_id, tx, ty)"""
)


def queries() -> dict[str, Query]:
    q: dict[str, Query] = {"stream_recomposite": _streamed, "fingerprint_tiles": _prints, "save_load_document": _saved, "tiff_strips": _tiffs, "icc_convert": _profiled}
    q["oplog_active"] = lambda s, d: active(s, d).select("doc_id", "seq", "step", "op")
    q["oplog_as_of"] = lambda s, d: oplog.at(oplog.resolved(log(s, d), LIMIT), VERSION).select("doc_id", "seq", "step", "op")
    q["oplog_layers"] = lambda s, d: oplog.layers(active(s, d), trees(s, d))
    q["oplog_pixels"] = lambda s, d: oplog.pixels(active(s, d), painted(s, d)).transform(lambda x: base.show(x, "doc_id", "layer_id"))
    q["composite_many"] = lambda s, d: forest.composite_many(painted(s, d), with_adjustment(trees(s, d)), masks(s, d)).transform(lambda x: base.show(x, "doc_id"))
    q["oplog_composite"] = _replayed
    return q


def _replayed(s: SparkSession, d: str) -> DataFrame:
    """All documents as their logs leave them."""
    now = active(s, d)
    return forest.composite_many(oplog.pixels(now, painted(s, d)), with_adjustment(oplog.layers(now, trees(s, d)))).transform(lambda x: base.show(x, "doc_id"))


def _composite_sql(layers: str, pixels: str, mask: str | None) -> list[str]:
    """CTEs of a two-level composite; the last is fin (doc_id, x, y, p)."""
    masked = f"SELECT p.doc_id, p.layer_id, p.x, p.y, p.r, p.g, p.b, CASE WHEN h.doc_id IS NULL THEN p.a ELSE p.a * coalesce(m.cov, 0.0) END AS a, h.doc_id IS NULL OR p.a * coalesce(m.cov, 0.0) <> 0 AS ok FROM {pixels} p LEFT JOIN {mask} m USING (doc_id, layer_id, x, y) LEFT JOIN (SELECT DISTINCT doc_id, layer_id FROM {mask}) h ON h.doc_id = p.doc_id AND h.layer_id = p.layer_id" if mask else f"SELECT *, true AS ok FROM {pixels}"
    own = "l.blend AS mode, l.opacity AS op, l.kind = 'adjustment' AS adj, l.idx, l.id"
    return [
        f"pm AS ({masked})",
        f"sh AS (SELECT l.* FROM {layers} l LEFT JOIN {layers} g ON g.doc_id = l.doc_id AND g.id = l.parent WHERE l.visible AND l.opacity > 0 AND (l.parent IS NULL OR (g.visible AND g.opacity > 0)))",
        "gi AS (" + _folded(f"SELECT p.doc_id, l.parent, p.x + l.dx + g.dx AS x, p.y + l.dy + g.dy AS y, p.r, p.g, p.b, p.a, {own} FROM pm p JOIN sh l ON l.doc_id = p.doc_id AND l.id = p.layer_id JOIN sh g ON g.doc_id = l.doc_id AND g.id = l.parent WHERE p.ok", "doc_id, parent, x, y", "idx, id") + ")",
        f"tp AS (SELECT p.doc_id, p.x + l.dx AS x, p.y + l.dy AS y, p.r, p.g, p.b, p.a, {own} FROM pm p JOIN sh l ON l.doc_id = p.doc_id AND l.id = p.layer_id WHERE l.parent IS NULL AND p.ok UNION ALL SELECT i.doc_id, i.x, i.y, p.r, p.g, p.b, p.a, {own} FROM gi i JOIN sh l ON l.doc_id = i.doc_id AND l.id = i.parent)",
        f"ad AS (SELECT t.doc_id, t.x, t.y, 0.0::DOUBLE AS r, 0.0::DOUBLE AS g, 0.0::DOUBLE AS b, 0.0::DOUBLE AS a, {own} FROM (SELECT DISTINCT doc_id, x, y FROM tp) t JOIN sh l ON l.doc_id = t.doc_id AND l.kind = 'adjustment')",
        "fin AS (" + _folded("SELECT * FROM tp UNION ALL SELECT * FROM ad", "doc_id, x, y", "idx, id") + ")",
    ]


FIN = f"SELECT doc_id, x, y, {', '.join(R(f'p.{c}', c) for c in 'rgba')} FROM fin"
NOW = _held_sql("9999999999", "now")
SETS_SQL = [
    "ch AS (SELECT doc_id, layer_id AS id, "
    + ", ".join(f"arg_max({c}, seq) FILTER (op = '{op}') AS n_{to}" for op, (to, c) in oplog.SETS.items())
    + ", sum(x) FILTER (op = 'move') AS mx, sum(y) FILTER (op = 'move') AS my, bool_or(op = 'delete_layer') AS gone FROM now GROUP BY 1, 2)",
    "al AS (SELECT * FROM tr UNION ALL SELECT n.doc_id, n.layer_id, NULL, t.top + 1 + n.seq, 'raster', n.name, true, false, 1.0, 'normal', 0, 0 FROM now n JOIN (SELECT doc_id, max(idx) AS top FROM tr WHERE parent IS NULL GROUP BY 1) t USING (doc_id) WHERE op = 'add_layer')",
    "nl AS (SELECT doc_id, id, parent, idx, kind, coalesce(n_name, name) AS name, coalesce(n_visible, visible) AS visible, coalesce(n_locked, locked) AS locked, least(greatest(coalesce(n_opacity, opacity), 0.0), 1.0) AS opacity, coalesce(n_blend, blend) AS blend, CAST(dx + coalesce(mx, 0) AS INT) AS dx, CAST(dy + coalesce(my, 0) AS INT) AS dy, coalesce(gone, false) AS gone FROM al LEFT JOIN ch USING (doc_id, id))",
    "ly AS (SELECT l.* EXCLUDE (gone) FROM nl l LEFT JOIN nl g ON g.doc_id = l.doc_id AND g.id = l.parent WHERE NOT l.gone AND NOT coalesce(g.gone, false))",
]
PIXELS_SQL = [
    "pc AS (SELECT doc_id, layer_id, seq, op, px AS x, py AS y, r, g, b, a FROM (SELECT *, unnest(range(CASE WHEN op = 'paint' THEN x - w ELSE x END, CASE WHEN op = 'paint' THEN x + w + 1 ELSE x + w END)) AS px FROM now WHERE op IN ('fill', 'clear', 'paint')), LATERAL (SELECT unnest(range(CASE WHEN op = 'paint' THEN y - w ELSE y END, CASE WHEN op = 'paint' THEN y + w + 1 ELSE y + h END)) AS py) WHERE op <> 'paint' OR (px - x) * (px - x) + (py - y) * (py - y) <= w * w)",
    "ps AS (SELECT doc_id, layer_id, x, y, seq, CASE WHEN op = 'clear' THEN 0.0 ELSE r END AS r, CASE WHEN op = 'clear' THEN 0.0 ELSE g END AS g, CASE WHEN op = 'clear' THEN 0.0 ELSE b END AS b, CASE WHEN op = 'clear' THEN 0.0 ELSE a END AS a, op <> 'paint' AS put FROM pc UNION ALL SELECT doc_id, layer_id, x, y, -1, r, g, b, a, true FROM p0)",
    "pf AS (SELECT doc_id, layer_id, x, y, list_reduce([{'r': 0.0::DOUBLE, 'g': 0.0::DOUBLE, 'b': 0.0::DOUBLE, 'a': 0.0::DOUBLE, 'put': false}] || list({'r': r, 'g': g, 'b': b, 'a': a, 'put': put} ORDER BY seq), lambda acc, e: {"
    + ", ".join(f"'{c}': CASE WHEN e.put THEN e.{c} ELSE {v} END" for c, v in _over("acc", "e", "'normal'", "1.0").items())
    + ", 'put': false}) AS p FROM ps GROUP BY 1, 2, 3, 4)",
    "px AS (SELECT doc_id, layer_id, x, y, p.r AS r, p.g AS g, p.b AS b, p.a AS a FROM pf WHERE p.a > 0)",
]


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {"stream_recomposite": w(*EDITED_SQL, *FLAT_CTES[1:]) + f"SELECT x, y, {rgba()} FROM f5", "fingerprint_tiles": PRINTS_SQL, "save_load_document": SAVED_SQL, "icc_convert": _profiled_sql(), "tiff_strips": w(wide.WIDE) + f"SELECT layer_id, x, y, {rgba()} FROM px WHERE a > 0"}
    machine = [LOG_SQL, STACKS_SQL]
    q["oplog_active"] = w(*machine, NOW) + "SELECT doc_id, seq, step, op FROM now"
    q["oplog_as_of"] = w(*machine, _held_sql(str(VERSION), "held")) + "SELECT doc_id, seq, step, op FROM held"
    q["oplog_layers"] = w(*machine, NOW, TREES_SQL, *SETS_SQL) + "SELECT * FROM ly"
    q["oplog_pixels"] = w(*machine, NOW, PAINTED_SQL, *PIXELS_SQL) + f"SELECT doc_id, layer_id, x, y, {rgba()} FROM px"
    q["composite_many"] = w(TREES_SQL, PAINTED_SQL, MASK_SQL, *_composite_sql("tr", "p0", "mk")) + FIN
    q["oplog_composite"] = w(*machine, NOW, TREES_SQL, *SETS_SQL, PAINTED_SQL, *PIXELS_SQL, *_composite_sql("ly", "px", None)) + FIN
    return q
