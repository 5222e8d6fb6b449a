"""Compositing of many documents at once: trees, masks and adjustments are tables, nothing is a Python object on the driver.

1. The trees are walked down by one join a level; a layer gets its path (places among siblings), the blend modes and opacities
   of all groups above, and its offset in the document.
2. Pixels meet their layers; adjustments get a row at each place where their group has something.
3. One shuffle by (document, place) serves all levels: rows sorted by path pass a kernel that folds the deepest level
   of all places in a batch at a time, siblings in order, and puts each folded group in its place among its own siblings.

A place is one key, so a task holds the layers of a place and one batch; hot documents are dealt over all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tilestrata.functions.adjust import KINDS
from tilestrata.functions.array_pixels import adjusted, over
from tilestrata.functions.blend import MODES
from tilestrata.operators.raster import RGBA
from tilestrata.plans.tree import MAX_DEPTH
from tilestrata.scratch import settled

NAMES = list(MODES)
LAYER = ["doc_id", "id", "parent", "idx", "kind", "visible", "opacity", "blend", "dx", "dy", "adjust", "params"]


def walked(layers: DataFrame) -> DataFrame:
    """Layers that can show, with path, modes, opacities and groups (ids of the groups above, 0 for the top) from the top down, and their offset (ox, oy).

    layers: LAYER; adjust and params (operators' order of values, functions/array_pixels.py) may be missing.
    """
    have = {"adjust": "string", "params": "array<double>", "dx": "int", "dy": "int"}
    layers = layers.withColumns({c: F.lit(None).cast(t) for c, t in have.items() if c not in layers.columns}).select(LAYER)
    place = F.row_number().over(Window.partitionBy("doc_id", "parent").orderBy("idx", "id"))
    opacity = F.least(F.coalesce(F.nanvl(F.col("opacity").cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    mode = F.coalesce(F.array_position(F.array(*[F.lit(n) for n in NAMES]), F.lower("blend")), F.lit(1)).cast("int") - 1
    rows = layers.withColumns({"place": place, "opacity": opacity, "mode": mode, "dx": F.coalesce("dx", F.lit(0)), "dy": F.coalesce("dy", F.lit(0))})
    rows = settled(rows.filter("visible AND opacity > 0"))
    top = {"path": F.array("place"), "modes": F.array("mode"), "opacities": F.array("opacity"), "groups": F.array(F.lit(0).cast("long")), "ox": F.col("dx"), "oy": F.col("dy")}
    level = rows.filter("parent IS NULL").select("*", *[e.alias(c) for c, e in top.items()])
    out = level
    for _ in range(MAX_DEPTH):
        above = level.filter("kind = 'group'").select(F.col("doc_id").alias("u_doc"), F.col("id").alias("u_id"), *[F.col(c).alias(f"u_{c}") for c in top])
        level = rows.join(above, (F.col("doc_id") == F.col("u_doc")) & (F.col("parent") == F.col("u_id")))
        own = [F.concat("u_path", F.array("place")).alias("path"), F.concat("u_modes", F.array("mode")).alias("modes"), F.concat("u_opacities", F.array("opacity")).alias("opacities")]
        level = settled(level.select(*rows.columns, *own, F.concat("u_groups", F.array(F.col("u_id").cast("long"))).alias("groups"), (F.col("u_ox") + F.col("dx")).alias("ox"), (F.col("u_oy") + F.col("dy")).alias("oy")))
        if level.isEmpty():
            return out
        out = out.unionByName(level)
    raise ValueError("a layer tree has a cycle or is too deep")


def _fold(place: np.ndarray, depth: np.ndarray, path: np.ndarray, mode: np.ndarray, opacity: np.ndarray, colour: np.ndarray, change: list) -> tuple[np.ndarray, np.ndarray]:
    """(place, colour) of all places; rows come in order of place and path, which is padded with -1. change: None, or an adjustment (kind, params)."""
    changed = np.array([c is not None for c in change], bool)
    change = np.array([*change, None], object)[:-1]
    for d in range(int(depth.max(initial=-1)), -1, -1):
        rows = np.flatnonzero(depth == d)
        keys = np.column_stack((place[rows], path[rows, :d]))
        new = np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1)))
        first = np.flatnonzero(new)
        group, rank = np.cumsum(new) - 1, np.arange(len(rows)) - np.repeat(first, np.diff(np.append(first, len(rows))))
        acc = np.zeros((len(first), 4))
        by_rank = np.argsort(rank, kind="stable")
        for lo, hi in zip(*(lambda e: (e[:-1], e[1:]))(np.searchsorted(rank[by_rank], np.arange(rank.max() + 2))), strict=True):
            some = by_rank[lo:hi]
            at, of = rows[some], group[some]
            for m in np.unique(mode[at, d][~changed[at]]):
                k = (mode[at, d] == m) & ~changed[at]
                acc[of[k]] = over(NAMES[m], acc[of[k]], colour[at[k]], opacity[at[k], d])
            for i in np.flatnonzero(changed[at]):
                kind, params = change[at[i]]
                acc[of[i] : of[i] + 1] = adjusted(kind, acc[of[i] : of[i] + 1], opacity[at[i], d], params)
        keep = rows[first]  # a folded group stands where its first row stood
        colour[keep], depth[keep], changed[keep] = acc, d - 1, False
        stay = np.ones(len(depth), bool)
        stay[rows] = False
        stay[keep] = True
        place, depth, path, mode, opacity, colour, change, changed = (x[stay] for x in (place, depth, path, mode, opacity, colour, change, changed))
    return place, colour


def composite_many(px: DataFrame, layers: DataFrame, masks: DataFrame | None = None) -> DataFrame:
    """(doc_id, x, y, r, g, b, a): the composite of every document.

    px: (doc_id, layer_id, x, y, r, g, b, a); layers: LAYER by document; masks: (doc_id, layer_id, x, y, cov) for the layers that have one.
    Rows whose layer is unknown or can't show are left out; unknown blend modes count as normal; a document without
    pixels has no rows.
    """
    tree = settled(walked(layers))
    keys = ["doc_id", "layer_id", "x", "y"]
    if masks is not None:
        masked = masks.select("doc_id", "layer_id").distinct().withColumn("masked", F.lit(True))
        px = px.join(masked, ["doc_id", "layer_id"], "left").join(masks.select(*keys, "cov"), keys, "left")
        px = px.withColumn("a", F.when(F.col("masked"), F.col("a") * F.coalesce("cov", F.lit(0.0))).otherwise(F.col("a"))).filter("masked IS NULL OR a <> 0")
    leaves = tree.filter("kind NOT IN ('group', 'adjustment')").select("doc_id", F.col("id").alias("layer_id"), "path", "modes", "opacities", "groups", "ox", "oy")
    none = [F.lit(None).cast("string").alias("adjust"), F.lit(None).cast("array<double>").alias("params")]
    rows = px.join(leaves, ["doc_id", "layer_id"]).select("doc_id", (F.col("x") + F.col("ox")).cast("int").alias("x"), (F.col("y") + F.col("oy")).cast("int").alias("y"), "path", "modes", "opacities", *RGBA, *none, "groups")
    changes = tree.filter(F.col("adjust").isin(*KINDS)).filter("kind = 'adjustment'").select("doc_id", F.element_at("groups", -1).alias("g"), "path", "modes", "opacities", "adjust", "params")
    touched = rows.join(changes.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "x", "y", F.explode("groups").alias("g")).distinct()
    nothing = [F.lit(0.0).alias(c) for c in RGBA]
    rows = rows.drop("groups").unionByName(touched.join(changes, ["doc_id", "g"]).select("doc_id", "x", "y", "path", "modes", "opacities", *nothing, "adjust", "params"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def folded(t: pa.Table) -> pa.RecordBatch:
            t = t.combine_chunks()
            lists = {c: t.column(c).combine_chunks() for c in ("path", "modes", "opacities")}
            size = lists["path"].value_lengths().to_numpy().astype(np.int64)
            n, wide = t.num_rows, int(size.max())
            at = np.repeat(np.arange(n), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            tables = {}
            for c, kind in (("path", np.int64), ("modes", np.int64), ("opacities", float)):
                tables[c] = np.full((n, wide), -1, kind)
                tables[c][at] = lists[c].flatten().to_numpy()
            docs = t.column("doc_id").combine_chunks().dictionary_encode().indices.to_numpy()
            x, y = t.column("x").to_numpy(), t.column("y").to_numpy()
            place = np.cumsum(np.concatenate(([0], (docs[1:] != docs[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1]))))
            change = [None if k is None else (k, p or []) for k, p in zip(t.column("adjust").to_pylist(), t.column("params").to_pylist(), strict=True)]
            colour = np.column_stack([t.column(c).to_numpy().astype(float) for c in RGBA])
            _, colour = _fold(place, size - 1, tables["path"], tables["modes"], tables["opacities"], colour, change)
            first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
            keys = t.select(["doc_id", "x", "y"]).take(pa.array(first)).combine_chunks().to_batches()[0]
            return pa.RecordBatch.from_arrays([*keys.columns, *(pa.array(colour[:, i]) for i in range(4))], names=["doc_id", "x", "y", *RGBA])

        for b in batches:
            if not b.num_rows:
                continue
            docs = b.column("doc_id")
            x, y = b.column("x").to_numpy(), b.column("y").to_numpy()
            codes = docs.dictionary_encode().indices.to_numpy()
            last = (codes == codes[-1]) & (x == x[-1]) & (y == y[-1])
            cut = len(x) - int(np.argmin(last[::-1])) if not last.all() else 0
            if held and (docs[0].as_py(), int(x[0]), int(y[0])) != (held[-1].column("doc_id")[-1].as_py(), int(held[-1].column("x")[-1].as_py()), int(held[-1].column("y")[-1].as_py())):
                yield folded(pa.Table.from_batches(held))
                held = []
            if cut:
                yield folded(pa.Table.from_batches([*held, b.slice(0, cut)]))
                held = []
            held.append(b.slice(cut))
        if held:
            yield folded(pa.Table.from_batches(held))

    kind = px.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("x", T.IntegerType()), T.StructField("y", T.IntegerType()), *(T.StructField(c, T.DoubleType()) for c in RGBA)])
    return rows.repartition("doc_id", "x", "y").sortWithinPartitions("doc_id", "x", "y", "path").mapInArrow(run, schema)
