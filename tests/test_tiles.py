"""Tile kernels against the row operators."""

import pytest
from pyspark.sql import functions as F

from tilestrata import fixtures as fx
from tilestrata.functions.blend import MODES
from tilestrata.operators import stencil
from tilestrata.operators.tiles import Rect
from tilestrata.plans import tile_compositor as tc
from tilestrata.plans.compositor import composite
from tilestrata.plans.tree import Layer, LayerTree

SF = "/root/testdata/sf0.001"


def image(df):
    return {(r["x"], r["y"]): [r[c] for c in "rgba"] for r in df.collect()}


def near(got, want):
    want = {k: v for k, v in want.items() if any(v)}
    assert set(got) == set(want)
    assert all(got[k] == pytest.approx(want[k], abs=1e-4) for k in want)


@pytest.fixture(scope="module")
def px(spark):
    return fx.pixels(spark, SF, 400).cache()


def test_tiles_hold_all_pixels(spark, px):
    one = px.filter("layer_id = 2")
    near(image(tc.to_rows(tc.to_tiles(one))), image(one))


@pytest.mark.parametrize("modes", [list(MODES)[:7], list(MODES)[7:]])
def test_composite_of_tiles(spark, px, modes):
    layers = [Layer(1), Layer(20, index=1, kind="group", blend=modes[0], opacity=0.8, dx=130, dy=-3)]
    layers += [Layer(i, parent=20 if i in (3, 4) else None, index=i, blend=m, opacity=0.4 + i / 20, dx=i - 3, visible=i != 6) for i, m in zip(range(2, 8), modes[1:], strict=False)]
    tree = LayerTree(layers)
    near(image(tc.to_rows(tc.composite(tc.dealt(tc.to_tiles(px)), tree))), image(composite(px, tree)))


def test_adjustments_take_rows():
    assert not tc.can_composite(LayerTree([Layer(1, kind="adjustment", adjust="invert")]))


@pytest.mark.parametrize("rect", [Rect(-200, -200, 400, 400), Rect(-10, -261, 280, 70)])
def test_gaussian_of_tiles(spark, px, rect):
    one = px.filter("layer_id = 1")
    near(image(tc.to_rows(tc.gaussian(tc.to_tiles(one), rect, 1.5))), image(stencil.gaussian_blur(one.drop("layer_id"), rect, 1.5)))


def test_pointwise_and_window(spark, px):
    one, rect = px.filter("layer_id = 1"), Rect(-180, -90, 300, 270)
    tiles = tc.to_tiles(one)
    near(image(tc.to_rows(tc.window(tiles, rect))), image(one.filter(rect.contains())))
    half = tc.pointwise(tiles, lambda a: a * 0.5)
    near(image(tc.to_rows(half)), image(one.select("x", "y", *[(F.col(c) * 0.5).alias(c) for c in "rgba"])))


def test_recomposite_of_changed_tiles(spark, px):
    from tilestrata.streaming.recomposite import recomposite

    tree = LayerTree([Layer(1), Layer(2, index=1, blend="screen", opacity=0.7, dx=130, dy=-3), Layer(3, index=2, opacity=0.5, dx=256)])
    tiles = tc.to_tiles(px.filter("layer_id < 4"))
    old = tc.composite(tiles, tree)
    edited = px.filter("layer_id < 4").withColumn("r", F.when((F.col("layer_id") == 2) & (F.col("x") < 0) & (F.col("y") < 0), 0.0).otherwise(F.col("r")))
    changed = spark.createDataFrame([(2, -1, -1)], "layer_id int, tx int, ty int")
    new = tc.to_tiles(edited)
    got = recomposite(old.withColumn("px", F.col("px")), new, tree, changed)
    near(image(tc.to_rows(got)), image(tc.to_rows(tc.composite(new, tree))))
