"""Findings of the fourth round: rasters beyond 46,340 places from a seed, wide images, previews that shrink, strokes and streams at size."""

import json
import zlib

import duckdb
import numpy as np
import pytest

from tilestrata import command_queries
from tilestrata import queries as raster_queries
from tilestrata.operators import brush, coverage, region, stencil, tiles, view
from tilestrata.operators.tiles import Rect
from tilestrata.plans.tree import Layer, LayerTree
from tilestrata.sources import large_raster
from tilestrata.streaming import live

PX = "x int, y int, r double, g double, b double, a double"
SF = "/root/testdata/sf0.001"
FAR = 100_000  # its square is beyond 32 bits


def grey(spark, places):
    return spark.createDataFrame([(x, y, v, v, v, 1.0) for x, y, v in places], PX)


def test_quick_select_with_places_far_from_its_seeds(spark):
    px = grey(spark, [(0, 0, 0.5), (0, 1, 0.5), (0, FAR, 0.5), (0, FAR + 1, 0.5), (0, FAR + 3, 0.5)])
    got = region.quick_select(px, [(0, 0), (0, FAR)], 0.1, Rect(0, 0, 1, FAR + 4), 2)
    assert sorted((r.x, r.y) for r in got.collect()) == [(0, 0), (0, 1), (0, FAR), (0, FAR + 1)]


def test_region_grow_with_places_far_from_its_seed(spark):
    px = grey(spark, [(x, y, 0.5) for x in range(4) for y in (0, 1, FAR, FAR + 1)])
    got = region.region_grow(px, 1, FAR, 0.1, Rect(0, 0, 4, FAR + 2), 1)
    assert sorted((r.x, r.y) for r in got.collect()) == [(0, FAR), (1, FAR), (1, FAR + 1), (2, FAR)]


def test_snap_edge_with_places_far_from_the_cursor(spark):
    field = spark.createDataFrame([(0, 0, 0.1), (3, 4, 0.7), (0, FAR, 0.9), (-FAR, FAR, 0.9)], "x int, y int, mag double")
    assert [tuple(r) for r in stencil.snap_to_edge(field, 0, 0, 5, 0.2).collect()] == [(3, 4, 0.7)]
    assert [tuple(r) for r in stencil.snap_to_edge(field, 2, FAR - 1, 1, 0.2).collect()] == [(0, FAR, 0.9)]


def test_wide_images_are_packed_and_read_by_pieces(spark, tmp_path, monkeypatch):
    w = large_raster.PIECE * 2 + 77
    rows = [(k, x, y, (x % 7) / 7, y / 3, 0.25, 1.0) for k in (1, 2) for x in (0, 5, large_raster.PIECE - 1, large_raster.PIECE, w - 1) for y in (0, 2)]
    px = spark.createDataFrame(rows, "layer int, x int, y int, r double, g double, b double, a double")
    assert large_raster.write_tiffs(px, f"file://{tmp_path}/t", "layer", Rect(0, 0, w, 3)).count() == 2
    blocks = large_raster.blocks(spark, f"file://{tmp_path}/t")
    assert [r.h for r in blocks.collect()] == [1] * 6 or max(r.h for r in blocks.collect()) * w * 32 <= 8 << 20
    with (tmp_path / "t/1.tif").open("rb") as f:  # a zlib stream that others can check
        row = blocks.filter("file like '%1.tif'").orderBy("block").first()
        f.seek(row.offsets[0])
        assert len(zlib.decompress(f.read(row.lengths[0]))) == row.w * row.h * 32
    for covered in (True, False):
        got = large_raster.read(blocks, covered=covered).filter("a > 0")
        assert sorted((int(r.file[-5]), *r[2:]) for r in got.collect()) == sorted(rows)
    assert large_raster.read(blocks).count() == 2 * 3 * w


def test_large_strips_are_read_by_pieces(tmp_path, monkeypatch):
    monkeypatch.setattr(large_raster, "LARGE_STRIP", 64)
    monkeypatch.setattr(large_raster, "PIECE", 50)
    monkeypatch.setattr(large_raster, "MAX_BLOCK", 4 << 10)
    px = np.random.default_rng(3).random((7, 33, 4))
    (tmp_path / "a.tif").write_bytes(large_raster.encode_tiff(px, 7))
    f = large_raster._File(str(tmp_path / "a.tif"))
    ((_, _, offsets, lengths, _, _, w, h, how),) = large_raster._tiff(f)
    row = {"offsets": offsets, "lengths": lengths, "w": w, "h": h}
    got = list(large_raster._pieces(f, json.loads(how), row))
    assert [a for a, _ in got] == list(range(0, 231, 50)) and np.allclose(np.concatenate([p for _, p in got]).reshape(px.shape), px)
    with pytest.raises(ValueError):
        list(large_raster._pieces(f, json.loads(how), row | {"lengths": [lengths[0] // 2]}))


@pytest.mark.parametrize("longest", [1000, 499, 333, 77, 5])
def test_previews_that_shrink_equal_their_sql(spark, longest):
    inverted = lambda px, r, k: tiles.stored(tiles.read_rect(px, r).selectExpr("x", "y", "1 - r AS r", "1 - g AS g", "1 - b AS b", "a"))
    got = raster_queries.show(view.preview(raster_queries._grey(spark, SF), inverted, longest)).collect()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = con.sql(command_queries.preview_sql(longest)).fetchall()
    assert max(r.y for r in got) == min(longest, 500) - 1
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_the_side_of_a_preview_is_rounded_up_in_whole_numbers(spark):
    px, seen = grey(spark, [(0, 0, 0.5), (0, 24, 0.5)]), []
    assert 25 * (7 / 25) > 7
    view.preview(px, lambda copy, rect, scale: seen.append(rect) or copy, 7)
    assert seen == [Rect(0, 0, 1, 7)]


@pytest.mark.parametrize("rect", [Rect(-3, 2, 1000, 5), Rect(0, 0, 2, 1), Rect(-40, -7, 60, 300)])
def test_blur_in_blocks_equals_plain_sums(spark, monkeypatch, rect):
    monkeypatch.setattr(stencil, "BLOCK", 256)
    rng, image = np.random.default_rng(5), np.zeros((rect.h, rect.w, 4))
    held = {(int(x), int(y)) for x, y in zip(rng.integers(rect.x - 9, rect.right + 9, 400), rng.integers(rect.y - 9, rect.bottom + 9, 400), strict=True)} | {(rect.x, rect.y)}
    rows = [(x, y, *rng.random(4).tolist()) for x, y in sorted(held)]
    for x, y, *v in rows:
        if rect.x <= x < rect.right and rect.y <= y < rect.bottom:
            image[y - rect.y, x - rect.x] = v
    w = stencil.gaussian_weights(1.5)
    k = len(w) // 2
    for axis in (1, 0):
        n = image.shape[axis]
        image = sum(v * image.take(np.clip(np.arange(n) + d - k, 0, n - 1), axis) for d, v in enumerate(w))
    got = stencil.gaussian_blur(spark.createDataFrame(rows, PX), rect, 1.5).collect()
    assert len({(r.x, r.y) for r in got}) == len(got) == rect.area
    assert all(np.allclose([r.r, r.g, r.b, r.a], image[r.y - rect.y, r.x - rect.x]) for r in got)


def test_blur_of_windows_beyond_the_budget_of_grids(spark):
    px = spark.createDataFrame([(5, 0, 1.0, 1.0, 1.0, 1.0)], PX)
    assert stencil.gaussian_blur(px, Rect(0, 0, tiles.GRID_BUDGET + 1, 1), 1.0).select("x", "y").limit(3).count() == 3


def test_a_batch_composites_the_tiles_it_reaches_only(spark, tmp_path, monkeypatch):
    folder, source = f"file://{tmp_path}/doc", f"file://{tmp_path}/edits"
    tree = LayerTree([Layer(1), Layer(2, index=1, blend="screen", dx=250), Layer(3, index=2, visible=False)])
    px = [(i, 256 * k, y, 0.5, 0.25, 0.75, 1.0) for i in (1, 2, 3) for k in range(6) for y in (0, 9)]
    live.open_document(spark.createDataFrame(px, live.PLACE), tree, folder)
    seen, whole = [], live.composite
    monkeypatch.setattr(live, "composite", lambda p, t: seen.append({(r.layer_id, r.x >> 8) for r in p.collect()}) or whole(p, t))
    edits = [(7, 2, 512, 0, (0.5, 0.25, 0.75, 1.0), (0.1, 0.2, 0.3, 1.0)), (5, 2, 512, 0, None, (0.9, 0.9, 0.9, 1.0)), (6, 2, 512, 0, (0.9, 0.9, 0.9, 1.0), (0.5, 0.25, 0.75, 1.0))]
    spark.createDataFrame(edits, live.EDIT).write.parquet(source)
    live.start(spark.readStream.schema(live.EDIT).parquet(source), tree, folder, once=True).awaitTermination()
    assert seen == [{(1, 2), (2, 2)}]  # layer 2 lies 250 places to the right, so its tile's first places show in tile 2
    now = spark.createDataFrame([(*r[:3], 0.1, 0.2, 0.3, 1.0) if r[:3] == (2, 512, 0) else r for r in px], live.PLACE)
    assert sorted(map(tuple, live.view(spark, folder).collect())) == sorted(map(tuple, whole(now, tree).select("x", "y", "r", "g", "b", "a").collect()))


@pytest.mark.parametrize("places", [1, 700, 1 << 18])
def test_places_of_a_stroke_in_chunks_of_stamps(places):
    rng = np.random.default_rng(8)
    at, size, most, ink = rng.uniform(-9, 9, (40, 2)), rng.uniform(0.2, 4, 40), rng.uniform(0, 1.5, 40), rng.random((40, 4))
    want = {}
    for (cx, cy), r, o, c in zip(at, size, most, ink, strict=True):
        for x in range(-20, 20):
            for y in range(-20, 20):
                t = np.hypot(x + 0.5 - cx, y + 0.5 - cy) / r
                if t < 1:
                    want[x, y] = (max(want.get((x, y), (0,))[0], min((1 - t) * (1 - 0.15 * t) * o, 1.0)), *c)
    got = {(x, y): (v, *c) for x, y, v, c in zip(*brush._last_hits(at, size, most, 0.3, ink, places), strict=True)}
    assert got.keys() == want.keys() and all(np.allclose(got[k], v) for k, v in want.items())


def test_smudge_sends_no_places_through_a_shuffle(spark):
    px = grey(spark, [(0, 0, 0.5), (3, 1, 0.25)])
    samples = spark.createDataFrame([(1, 1, 0.0, 0.0, 1.0), (1, 2, 9.0, 2.0, 1.0), (2, 1, -3.0, 0.0, 1.0)], "stroke_id long, seq int, px double, py double, pressure double")
    out = brush.smudge(px, samples, brush.Brush(6.0, 0.5, spacing=1.0), 0.6)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(x" not in plan and "hashpartitioning(stroke_id" in plan
    assert {r.stroke_id for r in out.collect()} == {1, 2}


@pytest.mark.parametrize("join", ["miter", "bevel", "round"])
@pytest.mark.parametrize("cap", ["butt", "square", "round"])
def test_edges_around_chords_close_and_stay_within_their_bound(join, cap):
    turn = np.random.default_rng(2).uniform(-2.5, 2.5, 30).cumsum()
    p = np.vstack(([[0.0, 0.0]], np.column_stack((np.cos(turn), np.sin(turn))).cumsum(axis=0)))
    d, none = p[1:] - p[:-1], np.full((1, 2), np.nan)
    u, v = np.vstack((none, d[:-1])), np.vstack((d[1:], none))
    c = {"ax": p[:-1, 0], "ay": p[:-1, 1], "bx": p[1:, 0], "by": p[1:, 1], "r": np.full(30, 0.3), "closed": np.zeros(30, bool)}
    c |= {n + k: q[:, i] for n, q in (("d", d), ("u", u), ("v", v)) for i, k in enumerate("xy")} | {n + "l": np.hypot(*q.T) for n, q in (("d", d), ("u", u), ("v", v))}
    row, edges = coverage._around(c, 0.01, join, cap)
    assert (np.bincount(row, minlength=30) <= coverage._edges_of(c, 0.01)).all()
    ends = np.vstack((edges[:, :2], edges[:, 2:])).round(6) + 0.0
    sign = np.repeat([1, -1], len(edges))
    at, inverse = np.unique(ends, axis=0, return_inverse=True)
    assert not np.bincount(inverse.ravel(), sign, len(at)).any()  # as many edges leave each point as come to it


def test_edges_of_strokes_are_made_by_batches(spark):
    paths = spark.createDataFrame([(1, [("M", [0.0, 0.0]), ("L", [9.0, 3.0])], 2.0)], "path long, verbs array<struct<v:string,p:array<double>>>, width double")
    assert "MapInArrow" in coverage.stroke_edges(paths)._jdf.queryExecution().executedPlan().toString()
