"""One way to open any file: the format goes by the extension, and files are decoded on the executors."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilestrata.operators import vector
from tilestrata.operators.tiles import Rect
from tilestrata.plans.history import Document
from tilestrata.plans.tree import Layer, LayerTree
from tilestrata.sources import native, png, psd, svg
from tilestrata.sources.openraster import MODES

PIXELS = "file string, layer_id int, x int, y int, r double, g double, b double, a double"
LAYERS = "file string, w int, h int, layer_id int, name string, blend string, opacity double, visible boolean, dx int, dy int"
PATHS = f"file string, {vector.SCHEMA}"
#: One decoded layer: its metadata and RGBA bytes.
Parts = list[tuple[dict, np.ndarray]]


def format_of(path: str) -> str:
    """native, ora, psd, svg or raster, by the lower-cased extension."""
    name = path.rstrip("/").rpartition("/")[2].lower()
    ext = name.rpartition(".")[2] if "." in name else ""
    return {"ts": "native", "ora": "ora", "psd": "psd", "svg": "svg", "svgz": "svg"}.get(ext, "raster")


def _ora(data: bytes) -> tuple[tuple[int, int], Parts]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("stack.xml"))
        out = []
        for e in list(root.iter("layer"))[::-1]:
            meta = {"name": e.get("name", ""), "blend": MODES.get(e.get("composite-op", ""), "normal"), "opacity": float(e.get("opacity", 1)), "visible": e.get("visibility", "visible") == "visible", "x": int(e.get("x", 0)), "y": int(e.get("y", 0))}
            out.append((meta, png.decode(z.read(e.get("src")))))
        return (int(root.get("w")), int(root.get("h"))), out


PARSERS: dict[str, Callable[[bytes], tuple[tuple[int, int], Parts]]] = {"ora": _ora, "psd": psd.parse}


def layered(spark: SparkSession, path: str, kind: str) -> tuple[DataFrame, DataFrame]:
    """(pixels, layers) of every layered file under path; a file is decoded by one task, files in parallel."""
    parse = PARSERS[kind]

    def pixels(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, data in zip(pdf["path"], pdf["content"], strict=True):
                for i, (meta, px) in enumerate(parse(bytes(data))[1]):
                    v = px / 255.0
                    y, x = np.nonzero(px[..., 3] if kind == "psd" else (px != 0).any(axis=2))
                    c = np.where(v <= 0.04045, v / 12.92, ((v + 0.055) / 1.055) ** 2.4)[y, x]
                    yield pd.DataFrame({"file": name, "layer_id": np.int32(i + 1), "x": x.astype(np.int32), "y": y.astype(np.int32), "r": c[:, 0], "g": c[:, 1], "b": c[:, 2], "a": v[y, x, 3]})

    def layers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, data in zip(pdf["path"], pdf["content"], strict=True):
                (w, h), parts = parse(bytes(data))
                rows = [(name, w, h, i + 1, m["name"], m["blend"], m["opacity"], m["visible"], m["x"], m["y"]) for i, (m, _) in enumerate(parts)]
                yield pd.DataFrame(rows or [(name, w, h, 0, "", "normal", 1.0, False, 0, 0)], columns=[c.split()[0] for c in LAYERS.split(", ")])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(pixels, PIXELS), files.mapInPandas(layers, LAYERS)


def drawings(spark: SparkSession, path: str, dpi: float = 96.0) -> tuple[DataFrame, DataFrame]:
    """(paths, sizes) of every drawing under path."""

    def paths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ink = lambda c: dict(zip("rgba", c, strict=True))
        for pdf in batches:
            for name, data in zip(pdf["path"], pdf["content"], strict=True):
                found = svg.parse(bytes(data), dpi)[1]
                rows = [(name, 1, k, [{"x": x, "y": y} for x, y in p["vertices"]], p["closed"], ink(p["fill"]), ink(p["stroke"]), float(p["width"])) for k, p in enumerate(found)]
                yield pd.DataFrame(rows, columns=["file", "layer_id", "path", "vertices", "closed", "fill", "stroke", "width"])

    def sizes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(n, *svg.parse(bytes(d), dpi)[0]) for n, d in zip(pdf["path"], pdf["content"], strict=True)], columns=["file", "w", "h"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(paths, PATHS), files.mapInPandas(sizes, "file string, w int, h int")


def open_document(spark: SparkSession, path: str, dpi: float = 96.0) -> Document:
    """A document of one file of any format. Only its metadata (a row for each layer) reaches the driver."""
    kind = format_of(path)
    if kind == "native":
        return native.load(spark, path)
    masks = spark.createDataFrame([], "layer_id int, x int, y int, cov double")
    if kind in PARSERS:
        px, layers = layered(spark, path, kind)
        rows = layers.collect()
        tree = LayerTree([Layer(r["layer_id"], index=r["layer_id"], name=r["name"], blend=r["blend"], opacity=r["opacity"], visible=r["visible"], dx=r["dx"], dy=r["dy"]) for r in rows if r["layer_id"]])
        return Document(Rect(0, 0, rows[0]["w"], rows[0]["h"]), tree, px.drop("file"), masks, masked=frozenset())
    if kind == "svg":
        paths, sizes = drawings(spark, path, dpi)
        size, own = sizes.first(), paths.drop("file")
        return Document(Rect(0, 0, size["w"], size["h"]), LayerTree([Layer(1, name="SVG")]), vector.rasterize(own), masks, paths=own, masked=frozenset())
    px = png.read_images(spark, path)
    b = px.agg(F.max("x").alias("x"), F.max("y").alias("y"), F.first("name").alias("n")).first()
    if b["x"] is None:
        raise ValueError(f"no image at {path}")
    return Document(Rect(0, 0, b["x"] + 1, b["y"] + 1), LayerTree([Layer(1, name=b["n"])]), px.drop("name").withColumn("layer_id", F.lit(1)), masks, masked=frozenset())
