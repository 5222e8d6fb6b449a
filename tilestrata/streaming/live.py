"""A document that is edited by a stream: only what changed is composited again, into a table of versions.

Edits are (edit_id, layer_id, x, y, old, new), old and new being (r, g, b, a) or null for an empty place. The stream's state is the
fingerprint of each layer's tile, an exclusive or of its places' hashes: an edit takes the old place's hash out and puts the
new one's in. Tiles whose fingerprint ends as it began, because edits were taken back, go no further. For all others the
batch writes the last value of each edited place, composites the tiles that they reach, and records which tiles of the
composite it replaced. Everything a batch writes goes to the folder of its own number, so a batch that is run again after a
failure replaces its half-done files: each edit counts exactly once.

Defined results: edits of one place are taken in order of edit_id; edits without a place or layer are left out; edits of layers that
the tree lacks are kept but not shown; a batch that changes nothing writes nothing; before the first batch the composite is that of
the pixels the document was opened with.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tilestrata.operators.raster import RGBA
from tilestrata.operators.tiles import tile_of
from tilestrata.plans.compositor import composite
from tilestrata.plans.tree import LayerTree

PIXEL = "struct<r:double,g:double,b:double,a:double>"
EDIT = f"edit_id long, layer_id int, x int, y int, old {PIXEL}, new {PIXEL}"
CHANGED = "layer_id int, x int, y int, r double, g double, b double, a double, sig long"
PLACE = "layer_id int, x int, y int, r double, g double, b double, a double"


def place_hash(x: Column, y: Column, px: Column) -> Column:
    """Hash of a place's value; 0 for an empty one."""
    return F.when(px.isNull(), F.lit(0)).otherwise(F.xxhash64(x, y, *[px[c] for c in RGBA]))


def fingerprint(px: DataFrame, *keys: str) -> DataFrame:
    """(keys, tx, ty, sig, n) of relations of places (keys, x, y, values): equal for equal tiles, in whatever order rows come; parts merge by merged()."""
    values = [c for c in px.columns if c not in keys]
    return px.groupBy(*keys, tile_of(F.col("x")).alias("tx"), tile_of(F.col("y")).alias("ty")).agg(F.bit_xor(F.xxhash64(*sorted(values))).alias("sig"), F.count(F.lit(1)).alias("n"))


def merged(*parts: DataFrame) -> DataFrame:
    """Fingerprints of disjoint parts of a relation, or of a relation and of its places that came (n > 0) or went (n < 0): a place's hash goes in and out alike. Tiles without places go."""
    rows = reduce(DataFrame.unionByName, parts)
    keys = [c for c in rows.columns if c not in ("sig", "n")]
    return rows.groupBy(*keys).agg(F.bit_xor("sig").alias("sig"), F.sum("n").alias("n")).filter("n <> 0 OR sig <> 0")


def edited(prints: DataFrame, gone: DataFrame, come: DataFrame, *keys: str) -> DataFrame:
    """Fingerprints after places went and came; the work is that of the edits, not of the relation."""
    return merged(prints, fingerprint(gone, *keys).withColumn("n", -F.col("n")), fingerprint(come, *keys))


def changes(edits: DataFrame) -> DataFrame:
    """CHANGED: the last value of each edited place of the tiles whose fingerprint a batch of the stream changed; an empty place has alpha null."""
    rows = edits.filter("layer_id IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL")
    rows = rows.select("layer_id", tile_of(F.col("x")).alias("tx"), tile_of(F.col("y")).alias("ty"), "edit_id", "x", "y", *[F.col(f"new.{c}").alias(c) for c in RGBA], place_hash(F.col("x"), F.col("y"), F.col("old")).alias("h0"), place_hash(F.col("x"), F.col("y"), F.col("new")).alias("h1"))

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last: list[pd.DataFrame] = []
        before = sig = state.get[0] if state.exists else 0
        for b in batches:
            sig ^= int(np.bitwise_xor.reduce(b["h0"].to_numpy(np.int64) ^ b["h1"].to_numpy(np.int64)))
            rows = pd.concat([*last, b[["edit_id", "x", "y", *RGBA]]], ignore_index=True)
            last = [rows.sort_values("edit_id", kind="stable").drop_duplicates(["x", "y"], keep="last")]
        if sig != before:
            state.update((sig,))
            yield last[0].assign(layer_id=key[0], sig=sig)[[c.split()[0] for c in CHANGED.split(", ")]]

    return rows.groupBy("layer_id", "tx", "ty").applyInPandasWithState(run, CHANGED, "sig long", "append", GroupStateTimeout.NoTimeout)


def _versions(spark: SparkSession, folder: str, part: str, schema: str) -> DataFrame:
    return spark.read.schema(f"{schema}, v long").parquet(f"{folder}/{part}")


def open_document(px: DataFrame, tree: LayerTree, folder: str) -> None:
    """Writes version -1 of a document (layer_id, x, y, r, g, b, a) and of its composite to folder, which must be new."""
    spark = px.sparkSession
    px.select("layer_id", "x", "y", *RGBA).write.parquet(f"{folder}/pixels/v=-1")
    whole = composite(spark.read.parquet(f"{folder}/pixels/v=-1"), tree)
    whole = spark.createDataFrame([], PLACE).drop("layer_id") if whole is None else whole.select("x", "y", *RGBA)
    whole.write.parquet(f"{folder}/composite/v=-1")
    spark.read.parquet(f"{folder}/composite/v=-1").select(tile_of(F.col("x")).alias("tx"), tile_of(F.col("y")).alias("ty")).distinct().write.parquet(f"{folder}/tiles/v=-1")


def pixels(spark: SparkSession, folder: str, upto: int | None = None, tree: LayerTree | None = None, tiles: DataFrame | None = None) -> DataFrame:
    """The document's pixels as the newest version, or `upto`, has them; with a tree, only those that show in tiles (tx, ty) of the composite."""
    rows = _versions(spark, folder, "pixels", PLACE)
    if upto is not None:
        rows = rows.filter(F.col("v") <= upto)
    if tree is not None:
        rows = _shown(rows, tree).join(tiles, ["tx", "ty"], "left_semi")
    last = rows.groupBy("layer_id", "x", "y").agg(F.max_by(F.struct(*RGBA), "v").alias("p"))
    return last.select("layer_id", "x", "y", *[F.col(f"p.{c}").alias(c) for c in RGBA]).filter("a IS NOT NULL")


def view(spark: SparkSession, folder: str) -> DataFrame:
    """The composite (x, y, r, g, b, a): each tile from the last version that replaced it."""
    last = _versions(spark, folder, "tiles", "tx int, ty int").groupBy("tx", "ty").agg(F.max("v").alias("v"))
    rows = _versions(spark, folder, "composite", "x int, y int, r double, g double, b double, a double")
    rows = rows.withColumns({"tx": tile_of(F.col("x")), "ty": tile_of(F.col("y"))})
    return rows.join(last, ["tx", "ty", "v"], "left_semi").select("x", "y", *RGBA)


def opened(spark: SparkSession, folder: str) -> DataFrame:
    """The pixels the document was opened with."""
    return spark.read.schema(PLACE).parquet(f"{folder}/pixels/v=-1")


def _shown(places: DataFrame, tree: LayerTree) -> DataFrame:
    """places (layer_id, x, y, ...) of layers that can show, with the tile (tx, ty) of the composite that each lies in."""
    offsets = []

    def walk(parent: int | None, dx: int, dy: int) -> None:
        for x in tree.children(parent):
            if x.visible and x.opacity > 0:
                if x.kind == "group":
                    walk(x.id, dx + x.dx, dy + x.dy)
                else:
                    offsets.append((x.id, dx + x.dx, dy + x.dy))

    walk(None, 0, 0)
    at = places.sparkSession.createDataFrame(offsets, "layer_id int, dx int, dy int")
    moved = places.join(F.broadcast(at), "layer_id")
    return moved.withColumns({"tx": tile_of(F.col("x") + F.col("dx")), "ty": tile_of(F.col("y") + F.col("dy"))}).drop("dx", "dy")


def reached(places: DataFrame, tree: LayerTree) -> DataFrame:
    """(tx, ty) of the composite that places (layer_id, x, y) of layers that can show lie in."""
    return _shown(places, tree).select("tx", "ty").distinct()


def start(edits: DataFrame, tree: LayerTree, folder: str, once: bool = False) -> StreamingQuery:
    """Follows a stream of edits of the document in folder; once: what is there now, then the query ends."""
    spark = edits.sparkSession

    def write(batch: DataFrame, v: int) -> None:
        batch.select("layer_id", "x", "y", *RGBA).write.mode("overwrite").parquet(f"{folder}/pixels/v={v}")
        fresh = spark.read.schema(PLACE).parquet(f"{folder}/pixels/v={v}")
        reached(fresh, tree).write.mode("overwrite").parquet(f"{folder}/half/v={v}")
        tiles = spark.read.schema("tx int, ty int").parquet(f"{folder}/half/v={v}")
        now = composite(pixels(spark, folder, v, tree, tiles), tree)
        here = [tile_of(F.col("x")) == F.col("tx"), tile_of(F.col("y")) == F.col("ty")]
        if now is not None:
            now.join(tiles, here, "left_semi").select("x", "y", *RGBA).write.mode("overwrite").parquet(f"{folder}/composite/v={v}")
        tiles.write.mode("overwrite").parquet(f"{folder}/tiles/v={v}")  # last: from now on readers see the version

    stream = changes(edits).writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/progress")
    return (stream.trigger(availableNow=True) if once else stream).start()
