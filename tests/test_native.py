"""Saved documents: whole round trips, versions, saves that die, and what loading refuses."""

import json
from pathlib import Path

import pytest

from tilestrata.operators import vector
from tilestrata.operators.tiles import Rect
from tilestrata.plans import history as h
from tilestrata.plans.tree import Layer, LayerTree
from tilestrata.sources import native

PX = "layer_id int, x int, y int, r double, g double, b double, a double"
INK = {"r": 0.1, "g": 0.2, "b": 0.3, "a": 1.0}


def document(spark, value=0.5):
    tree = LayerTree([Layer(1, name="näme", blend="multiply", opacity=0.25, dx=-3), Layer(2, kind="group", index=1), Layer(3, parent=2, locked=True), Layer(4, index=2, kind="adjustment", adjust="curves", params={"points": [(0.0, 0.1), (0.2, 0.3), (0.5, 0.5), (1.0, 1.0)]}), Layer(5, index=3), Layer(6, index=4, kind="vector")])
    px = spark.createDataFrame([(1, x, y, value, 0.1, 1 / 3, 1.0) for x in (-300, 0, 700) for y in (-5, 900)] + [(5, 0, 0, 1.0, 1.0, 1.0, 1.0)], PX)
    masks = spark.createDataFrame([(1, 0, 0, 0.5)], "layer_id int, x int, y int, cov double")
    paths = spark.createDataFrame([(6, 1, [(0, 0), (9, 0), (4, 7)], True, tuple(INK.values()), tuple(INK.values()), 1.0)], vector.SCHEMA)
    selection = spark.createDataFrame([(1, 1, 0.5), (9000, 1, 1.0)], "x int, y int, cov double")
    return h.Document(Rect(-512, -16, 2048, 1024), tree, px, masks, selection, (("cut", Rect(1, 2, 3, 4)),), paths, frozenset({5}), frozenset({1, 3}))


def contents(d):
    rows = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect())) if df is not None else None
    return rows(d.pixels), rows(d.masks), rows(d.selection), rows(d.paths), {i: vars(x) | {"params": json.loads(json.dumps(x.params))} for i, x in d.tree.by_id.items()}, d.canvas, d.slices, d.masked


def test_whole_round_trip(spark, tmp_path):
    path, d = f"file://{tmp_path}/d", document(spark)
    assert native.save(d, path) == 1
    back = native.load(spark, path)
    want = contents(h.Document(d.canvas, d.tree.without(5), d.pixels.filter("layer_id <> 5"), d.masks, d.selection.filter("x < 9000"), d.slices, d.paths, masked=frozenset({1, 3})))
    assert contents(back) == want
    log = h.History(back)
    log.do(h.edit_vector(6, lambda own: vector.moved(own, 2, 3)))
    assert log.document.of(6).count() > 0
    assert [tuple(r)[:3] for r in native.window(spark, path, 1, Rect(600, 800, 200, 200)).collect()] == [(1, 700, 900)]
    plan = native.window(spark, path, 1, Rect(600, 800, 200, 200))._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull" in plan and "EqualTo(layer_id," in plan


def test_versions_and_a_save_that_dies(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/d"
    assert [native.save(document(spark, v), path) for v in (0.25, 0.75)] == [1, 2]
    commit = native._commit
    monkeypatch.setattr(native, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        native.save(document(spark, 0.1), path)
    monkeypatch.setattr(native, "_commit", commit)
    first = lambda v=None: native.load(spark, path, v).pixels.first()["r"]
    assert (first(), first(1), first(2)) == (0.75, 0.25, 0.75) and native.versions(spark, path) == [1, 2]
    with pytest.raises(FileExistsError):
        native._commit(spark, path, 2, b"{}")
    assert native.versions(spark, path) == [1, 2]
    native.expire(spark, path, keep=1)
    assert native.versions(spark, path) == [2] and first() == 0.75
    assert sum(p.name.startswith(("data-", "half-")) for p in (tmp_path / "d").iterdir()) == 1
    with pytest.raises(FileNotFoundError):
        native.load(spark, path, 1)
    with pytest.raises(FileNotFoundError):
        native.load(spark, f"file://{tmp_path}/none")


@pytest.mark.parametrize(
    ("change", "match"),
    [
        ({"version": 3}, "unknown version"), ({"canvas": [0, 0, 0, 5]}, "canvas"), ({"canvas": [0, 0, 8193, 1]}, "canvas"), ("{not json", "can't be read"), ("[]", "can't be read"),
        ({"layers": []}, "unknown layer"), ({"layers": "twice"}, "repeat"), ({"layers": "dangling"}, "no group"), ({"layers": "cycle"}, "cycle"),
    ],
)
def test_refusals(spark, tmp_path, change, match):
    path = f"file://{tmp_path}/d"
    native.save(document(spark), path)
    file = Path(next((tmp_path / "d").glob("manifest-*.json")))
    (file.parent / f".{file.name}.crc").unlink(missing_ok=True)
    if isinstance(change, str):
        file.write_text(change)
    else:
        meta = json.loads(file.read_text())
        layers = meta["layers"]
        odd = {"twice": [*layers, layers[0]], "dangling": [x | {"parent": 77} for x in layers], "cycle": [x | {"parent": 2} if x["id"] == 2 else x for x in layers]}
        meta |= {k: odd[v] if isinstance(v, str) else v for k, v in change.items()}
        file.write_text(json.dumps(meta))
    with pytest.raises(ValueError, match=match):
        native.load(spark, path)


def test_vector_limits(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/d"
    native.save(document(spark), path)
    monkeypatch.setattr(native, "MAX_VERTICES", 2)
    with pytest.raises(ValueError, match="vertices"):
        native.load(spark, path)
    monkeypatch.setattr(native, "MAX_VERTICES", 3)
    monkeypatch.setattr(native, "MAX_MANIFEST", 10)
    with pytest.raises(ValueError, match="too long"):
        native.load(spark, path)
