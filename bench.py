"""Headline queries on local[$BENCH_CPUS]; prints one JSON line.

baseline's images are in memory; the others read $BENCH_SF_DIR. Every result is computed in full. Times are of the second run.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tilestrata import fixtures, queries  # noqa: E402
from tilestrata.operators import brush, raster, selection  # noqa: E402
from tilestrata.operators.tiles import Rect  # noqa: E402
from tilestrata.plans import tile_compositor as tc  # noqa: E402
from tilestrata.plans.compositor import composite  # noqa: E402
from tilestrata.plans.history import Document  # noqa: E402
from tilestrata.plans.tree import Layer, LayerTree  # noqa: E402
from tilestrata.sources import native  # noqa: E402

W, H, LAYERS = 1920, 1080, 20
SIDE = 512
CANVAS = Rect(-SIDE // 2, -SIDE // 2, SIDE, SIDE)


def image(spark: SparkSession, w: int, h: int, layers: list[int], colour) -> DataFrame:
    """Cached tiles of a w x h image on each layer; colour(layer, x, y) gives (r, g, b, a) arrays or numbers."""
    nx, ny = -(-w // 256), -(-h // 256)

    def run(batches):
        for b in batches:
            for k in b.column("id").to_pylist():
                layer, tx, ty = layers[k // (nx * ny)], k % nx, k // nx % ny
                out = np.zeros(tc.SHAPE, np.float32)
                y, x = np.mgrid[ty * 256 : min(h, ty * 256 + 256), tx * 256 : min(w, tx * 256 + 256)]
                for i, c in enumerate(colour(layer, x, y)):
                    out[: len(y), : len(y[0]), i] = c
                yield from tc.table([layer], [tx], [ty], [out]).to_batches()

    tiles = tc.dealt(spark.range(len(layers) * nx * ny).mapInArrow(run, tc.SCHEMA)).cache()
    tiles.count()
    return tiles


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(2 * int(cpus)))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "8")
        .config("spark.sql.inMemoryColumnarStorage.batchSize", "8")
        .config("spark.sql.inMemoryColumnarStorage.compressed", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    scratch = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    px = fixtures.pixels(spark, sf, SIDE).cache()
    px.count()
    stack = image(spark, W, H, list(range(LAYERS)), lambda k, x, y: (k / LAYERS, 0.5, 1 - k / LAYERS, 0.9))
    ramp = image(spark, W, H, [1], lambda k, x, y: (x / W, y / H, 0.5, 0.9))
    large = image(spark, 2048, 2048, [1], lambda k, x, y: (x / 2048, y / 2048, 0.5, 1.0))
    small = image(spark, 512, 512, [1], lambda k, x, y: (x / 512, y / 512, 0.5, 1.0))
    tree = LayerTree([Layer(k, index=k) for k in range(LAYERS)])
    base = tc.to_rows(small).select("x", "y", *[F.col(c).cast("double").alias(c) for c in "rgba"]).cache()
    base.count()
    samples = spark.createDataFrame([(1, k, 100.0 + 40 * k, 512.0, 1.0) for k in range(20)], "stroke_id long, seq int, px double, py double, pressure double").cache()
    samples.count()
    tip = brush.Brush(20.0, 1.0)
    empty = base.limit(0)
    dots = spark.createDataFrame([(k, 256 * i, 256 * j, 1.0, 0.0, 0.0, 1.0) for k in range(4) for i in range(4) for j in range(4)], "layer_id int, x int, y int, r double, g double, b double, a double").cache()
    doc = Document(Rect(0, 0, 1024, 1024), LayerTree([Layer(k, index=k) for k in range(4)]), dots, spark.createDataFrame([], "layer_id int, x int, y int, cov double"))
    saved: list[str] = []

    def save() -> None:
        saved.append(f"file://{scratch}/doc{len(saved)}")
        native.save(doc, saved[-1])

    def rgb(change):
        return lambda a: np.concatenate((np.clip(change(a[..., :3]), 0, 1), a[..., 3:]), axis=2)

    work = {
        "composite_20_layers_1920x1080": lambda: tc.composite(stack, tree),
        "gaussian_sigma_5_1920x1080": lambda: tc.gaussian(ramp, Rect(0, 0, W, H), 5.0),
        "invert_1920x1080": lambda: tc.pointwise(ramp, rgb(lambda c: 1 - c)),
        "brightness_contrast_1920x1080": lambda: tc.pointwise(ramp, rgb(lambda c: (c - 0.5) * 1.2 + 0.6)),
        "copy_selection_2048x2048": lambda: tc.window(large, Rect(0, 0, 2048, 2048)),
        "cut_selection_512x512": lambda: raster.extract(base, selection.rect(spark, Rect(0, 0, 512, 512))).unionByName(raster.erase_rect(base, Rect(0, 0, 512, 512))),
        "paint_stroke_20_samples": lambda: brush.paint_stamps(empty, brush.stamp_cover(brush.stroke_stamps(samples, tip), tip), (0.9, 0.1, 0.1, 1.0)),
        "native_save": save,
        "native_load": lambda: native.load(spark, saved[0]).pixels,
        "tiles_from_lineitem": lambda: queries.flagship(spark, sf),
        "composite_rows_sparse": lambda: composite(px, fixtures.tree()),
    }
    took = {}
    for name, run in work.items():
        for _ in range(2):
            began = time.time()
            out = run()
            if out is not None:
                out.write.format("noop").mode("overwrite").save()
            took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
