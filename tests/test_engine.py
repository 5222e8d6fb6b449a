"""Plans, history, sources and streaming forms."""

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tilestrata.operators.tiles import Rect, shifted
from tilestrata.plans import history as h
from tilestrata.plans.tree import Layer, LayerTree
from tilestrata.plugins import apply_tile_filter, discover, register
from tilestrata.sources import native, openraster, png
from tilestrata.streaming.strokes import changed_tiles, finalized_segments, tile_signatures

SCHEMA = "layer_id int, x int, y int, r double, g double, b double, a double"


def document(spark):
    px = spark.createDataFrame([(1, 0, 0, 0.5, 0.25, 0.75, 1.0), (1, 3, -2, 0.1, 0.2, 0.3, 0.5), (2, 0, 0, 1.0, 0.0, 0.0, 0.5)], SCHEMA)
    masks = spark.createDataFrame([], "layer_id int, x int, y int, cov double")
    return h.Document(Rect(-8, -8, 16, 16), LayerTree([Layer(1, name="a"), Layer(2, index=1, name="b")]), px, masks)


def pixels(df):
    return sorted(tuple(r) for r in df.collect())


def test_undo_redo_and_rollback(spark):
    d = document(spark)
    log = h.History(d)
    before = pixels(d.pixels)
    log.do(h.flip(1, "x"))
    after = pixels(log.document.pixels)
    assert after != before
    assert log.undo() and pixels(log.document.pixels) == before
    assert log.redo() and pixels(log.document.pixels) == after
    with pytest.raises(h.CommandError):
        log.do(h.batch("script", [h.layer_update("lock", 1, locked=True), h.flip(1, "x")]))
    assert not log.document.tree.by_id[1].locked and log.log(spark).count() == 1


def test_coalescing_and_limit(spark):
    log = h.History(document(spark), limit=3)
    for v in (0.2, 0.4, 0.6):
        log.do(h.layer_update("opacity", 1, True, opacity=v))
    assert len(log.done) == 1
    for k in range(5):
        log.do(h.layer_update("name", 1, name=str(k)))
    assert len(log.done) == 3


def test_cut_then_place_is_exact(spark):
    d = document(spark)
    sel = spark.createDataFrame([(3, -2, 1.0)], "x int, y int, cov double")
    log = h.History(d)
    log.do(h.select("replace", sel))
    log.do(h.copy_to_layer(1, cut=True))
    assert pixels(log.document.of(3)) == [(3, -2, 0.1, 0.2, 0.3, 0.5)]
    assert pixels(log.document.of(1)) == [(0, 0, 0.5, 0.25, 0.75, 1.0)]


def test_subtree_merge_delete(spark):
    d = document(spark)
    log = h.History(d)
    log.do(h.insert_subtree(document(spark), 2))
    assert pixels(log.document.of(3)) == pixels(d.of(2))
    log.do(h.delete(3))
    with pytest.raises(h.CommandError):
        log.do(h.move_by(3, 1, 1))
    log.do(h.merge(2, 1))
    assert [x.id for x in log.document.tree.children(None) if x.id not in log.document.removed] == [1]


def test_cycles_and_groups():
    with pytest.raises(ValueError):
        LayerTree([Layer(1, parent=2, kind="group"), Layer(2, parent=1, kind="group")])
    t = LayerTree([Layer(1, kind="group"), Layer(2, index=1)])
    assert t.move_into(2, 1).children(1)[0].id == 2
    with pytest.raises(ValueError):
        t.move_into(1, 1)


def test_native_round_trip(spark, tmp_path):
    d = document(spark)
    native.save(d, f"file://{tmp_path}/d")
    back = native.load(spark, f"file://{tmp_path}/d")
    assert pixels(back.pixels) == pixels(d.pixels) and back.tree.by_id == d.tree.by_id and back.canvas == d.canvas
    assert pixels(native.window(spark, f"file://{tmp_path}/d", 1, Rect(0, 0, 2, 2)).select(d.pixels.columns)) == [(1, 0, 0, 0.5, 0.25, 0.75, 1.0)]


@pytest.mark.parametrize("dtype", [np.uint8, np.uint16])
def test_png_round_trip(dtype):
    px = np.random.default_rng(0).integers(0, np.iinfo(dtype).max, (5, 7, 4)).astype(dtype)
    assert (png.decode(png.encode(px)) == px).all()
    with pytest.raises(ValueError):
        png.decode(b"no image")


def test_images_and_openraster(spark, tmp_path):
    d = document(spark)
    image = bytes(png.to_png(d.of(1), d.canvas).first()["png"])
    (tmp_path / "one.png").write_bytes(image)
    got = png.read_images(spark, f"file://{tmp_path}").filter("a > 0").collect()
    assert {(r["x"] - 8, r["y"] - 8) for r in got} == {(0, 0), (3, -2)} and got[0]["name"] == "one"
    px, tree, canvas = openraster.read(spark, openraster.write(d.pixels, d.tree.children(None), d.canvas))
    assert [x.name for x in tree.children(None)] == ["a", "b"] and px.count() == 3
    assert png.to_svg(image, d.canvas).startswith("<svg")


def test_plugins(spark, tmp_path):
    register("half", lambda tile, p: tile * p["k"])
    out = apply_tile_filter(document(spark).of(1), "half", {"k": 0.5})
    assert pixels(out.select("x", "y", "r"))[0] == (0, 0, 0.25)
    (tmp_path / "ok").mkdir()
    (tmp_path / "ok/plugin.toml").write_text('name="n"\nversion="1"\nkind="filter"\nentry="f.py"')
    (tmp_path / "ok/f.py").write_text("")
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad/plugin.toml").write_text('name="n"\nversion="1"\nkind="filter"\nentry="../x"')
    found = discover(str(tmp_path))
    assert found[0].error and found[1].name == "n" and not found[1].error


def test_signatures(spark):
    d = document(spark)
    later = d.with_pixels(2, d.of(2).withColumn("a", F.lit(0.75)))
    assert changed_tiles(tile_signatures(d.pixels), tile_signatures(later.pixels)).count() == 1
    assert changed_tiles(tile_signatures(d.pixels), tile_signatures(d.pixels)).count() == 0


def test_stroke_stream(spark, tmp_path):
    rows = [(s, i, float(i), float(s)) for s in (1, 2) for i in range(5)]
    spark.createDataFrame(rows, "stroke_id long, seq int, px double, py double").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("stroke_id long, seq int, px double, py double").parquet(f"{tmp_path}/in")
    q = finalized_segments(stream).writeStream.format("memory").queryName("segments").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["stroke_id"], r["seq"]) for r in spark.table("segments").collect()) == [(s, i) for s in (1, 2) for i in range(3)]


@given(st.integers(-(2**31), 2**31 - 1))
def test_tile_arithmetic(x):
    assert (x >> 8) * 256 + (x & 255) == x


def test_overflowing_offsets_vanish(spark):
    px = spark.createDataFrame([(2**31 - 1, 0), (0, 0)], "x int, y int")
    assert [r["x"] for r in shifted(px, 5, 0).collect()] == [5]
