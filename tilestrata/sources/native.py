"""Documents in a folder of versions: Parquet tables of tiles, and one manifest for each version, written last.

Saving writes tables under a name of their own and then the manifest, under the next number, by a rename that fails if
the name is taken. So readers see whole versions only: a save that dies leaves the versions before it as they were, and of two savers at
once one gets an error. Pixels and masks are sorted by layer and tile, so that a layer and a rectangle reach the scan as
filters on row groups. Layers, canvas and slices are in the manifest; pixels, masks, selection and vector paths are tables.

Loading refuses: manifests that are no JSON, too long or of an unknown version; canvases that are empty, too wide, high or
large; layer ids that repeat, groups that don't exist or close a cycle; rows of unknown layers; vector layers with too many vertices or too wide strokes.
"""

from __future__ import annotations

import json
import uuid
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilestrata.operators.tiles import Rect, tile_of
from tilestrata.plans.history import Document
from tilestrata.plans.tree import Layer, LayerTree

VERSION = 2
#: Limits of a document (fixed values of the format), and of a manifest in bytes.
MAX_SIDE, MAX_PLACES, MAX_VERTICES = 8192, 8192 * 8192, 100_000
MAX_MANIFEST = 64 << 20
LAYER = ("id", "parent", "index", "kind", "name", "blend", "opacity", "dx", "dy", "visible", "locked", "adjust", "params")


def _at(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _names(spark: SparkSession, folder: str) -> list[str]:
    where, fs = _at(spark, folder)
    return sorted(x.getPath().getName() for x in fs.listStatus(where)) if fs.exists(where) else []


def _manifest(folder: str, n: int) -> str:
    return f"{folder}/manifest-{n:012d}.json"


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the whole versions, oldest first."""
    return [int(n[9:-5]) for n in _names(spark, path) if n.startswith("manifest-") and n.endswith(".json")]


def save(d: Document, path: str) -> int:
    """Adds a version; returns its number. The tables are written at the same time, the manifest after all of them."""
    spark = d.pixels.sparkSession
    n, name = max(versions(spark, path), default=0) + 1, f"data-{uuid.uuid4().hex}"
    tables = {"pixels": d.pixels, "masks": d.masks, "selection": d.selection, "paths": d.paths}
    tables = {k: df for k, df in tables.items() if df is not None}

    def write(item: tuple[str, DataFrame]) -> None:
        part, df = item
        if part in ("pixels", "masks"):
            df = df.withColumns({"tx": tile_of(F.col("x")), "ty": tile_of(F.col("y"))}).repartition("layer_id", "tx", "ty").sortWithinPartitions("layer_id", "tx", "ty")
        df.write.option("compression", "zstd").parquet(f"{path}/{name}/{part}")

    with ThreadPoolExecutor(len(tables)) as pool:
        list(pool.map(write, tables.items()))
    layers = [{k: getattr(x, k) for k in LAYER} for x in d.tree.by_id.values() if x.id not in d.removed]
    kept = {x["id"] for x in layers}
    masked = None if d.masked is None else sorted(d.masked & kept)
    meta = {"version": VERSION, "data": name, "tables": sorted(tables), "canvas": [d.canvas.x, d.canvas.y, d.canvas.w, d.canvas.h], "layers": layers, "slices": [[s, r.x, r.y, r.w, r.h] for s, r in d.slices], "masked": masked, "removed": sorted(d.removed)}
    _commit(spark, path, n, json.dumps(meta).encode())
    return n


def _commit(spark: SparkSession, path: str, n: int, data: bytes) -> None:
    half, fs = _at(spark, f"{path}/half-{uuid.uuid4().hex}")
    out = fs.create(half, False)
    out.write(data)
    out.close()
    whole, _ = _at(spark, _manifest(path, n))
    if fs.exists(whole) or not fs.rename(half, whole):
        fs.delete(half, False)
        raise FileExistsError(f"version {n} was written meanwhile")


def _read(spark: SparkSession, path: str, version: int | None) -> dict:
    found = versions(spark, path)
    if not found or (version is not None and version not in found):
        raise FileNotFoundError(f"no version {version or ''} of a document in {path}")
    where, fs = _at(spark, _manifest(path, found[-1] if version is None else version))
    if fs.getFileStatus(where).getLen() > MAX_MANIFEST:
        raise ValueError("the manifest is too long")
    stream = fs.open(where)
    try:
        text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    try:
        meta = json.loads(text)
        number = meta["version"]
    except (ValueError, TypeError, KeyError):
        raise ValueError("the manifest can't be read") from None
    if number != VERSION:
        raise ValueError(f"unknown version {number}")
    return meta


def _canvas(numbers: list[int]) -> Rect:
    canvas = Rect(*numbers)
    if canvas.empty or max(canvas.w, canvas.h) > MAX_SIDE or canvas.w * canvas.h > MAX_PLACES:
        raise ValueError("the canvas is empty or too large")
    return canvas


def _check_paths(paths: DataFrame) -> None:
    bad = F.coalesce(F.size("vertices"), F.lit(0)) > MAX_VERTICES
    if not paths.filter(bad | (F.col("width") > MAX_SIDE) | F.isnan("width")).isEmpty():
        raise ValueError("a vector path has too many vertices, or its stroke is too wide")


def load(spark: SparkSession, path: str, version: int | None = None) -> Document:
    """A version of a document, the newest by default."""
    meta = _read(spark, path, version)
    canvas = _canvas(meta["canvas"])
    tree = LayerTree([Layer(**{k: x[k] for k in LAYER}) for x in meta["layers"]])
    read = lambda n: spark.read.parquet(f"{path}/{meta['data']}/{n}") if n in meta["tables"] else None
    pixels, masks, paths, selection = read("pixels"), read("masks"), read("paths"), read("selection")
    ids = reduce(DataFrame.union, [x.select("layer_id") for x in (pixels, masks, paths) if x is not None])
    known = [*tree.by_id, *meta["removed"]]
    if not ids.filter(~F.col("layer_id").isin(known)).isEmpty():
        raise ValueError("rows of an unknown layer")
    if paths is not None:
        _check_paths(paths)
    live = ~F.col("layer_id").isin(meta["removed"]) if meta["removed"] else F.lit(True)
    masked = frozenset(meta["masked"]) if meta["masked"] is not None else None
    return Document(canvas, tree, pixels.filter(live).drop("tx", "ty"), masks.filter(live).drop("tx", "ty"), None if selection is None else selection.filter(canvas.contains()), tuple((n, Rect(*r)) for n, *r in meta["slices"]), paths, masked=masked)


def window(spark: SparkSession, path: str, layer: int, rect: Rect, version: int | None = None) -> DataFrame:
    """One layer's pixels in a rectangle; layer and tiles prune row groups."""
    meta = _read(spark, path, version)
    near = F.col("tx").between(rect.x >> 8, (rect.right - 1) >> 8) & F.col("ty").between(rect.y >> 8, (rect.bottom - 1) >> 8)
    return spark.read.parquet(f"{path}/{meta['data']}/pixels").filter((F.col("layer_id") == layer) & near & rect.contains()).drop("tx", "ty")


def expire(spark: SparkSession, path: str, keep: int = 1) -> None:
    """Deletes all but the newest versions, and what saves that died have left. No save must run meanwhile."""
    found = versions(spark, path)
    for n in found[:-keep] if keep else found:
        where, fs = _at(spark, _manifest(path, n))
        fs.delete(where, False)
    used = {_read(spark, path, n)["data"] for n in versions(spark, path)}
    for name in _names(spark, path):
        if (name.startswith("data-") and name not in used) or name.startswith("half-"):
            where, fs = _at(spark, f"{path}/{name}")
            fs.delete(where, True)


def autosave(d: Document, folder: str, stamp: int, keep: int = 5) -> str:
    """A snapshot under folder, under its stamp; older ones than the `keep` newest go."""
    path = f"{folder}/v{stamp:020d}"
    save(d, path)
    spark = d.pixels.sparkSession
    for old in snapshots(spark, folder)[keep:]:
        where, fs = _at(spark, old)
        fs.delete(where, True)
    return path


def snapshots(spark: SparkSession, folder: str) -> list[str]:
    """Whole snapshots under folder, newest first."""
    names = [n for n in _names(spark, folder)[::-1] if n.startswith("v")]
    return [f"{folder}/{n}" for n in names if versions(spark, f"{folder}/{n}")]


def recover(spark: SparkSession, folder: str) -> Document | None:
    """The newest whole snapshot."""
    found = snapshots(spark, folder)
    return load(spark, found[0]) if found else None
