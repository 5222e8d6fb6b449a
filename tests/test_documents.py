"""Op-logs and forests of many documents against the single-document forms."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tilestrata.functions import array_pixels
from tilestrata.functions.blend import MODES
from tilestrata.operators.tiles import Rect
from tilestrata.plans import forest, history, oplog, tree_tables
from tilestrata.plans.compositor import composite
from tilestrata.plans.tree import Layer, LayerTree

LOG = "doc_id long, seq long, op string, key string, layer_id long, flag boolean, value double, name string, x int, y int, w int, h int, r double, g double, b double, a double"
BLANK = (None,) * 12
CURVES = {"points": [(0.0, 0.1), (0.3, 0.2), (0.6, 0.9), (1.0, 1.0)]}
ADJUST = [("invert", {}), ("desaturate", {}), ("brightness_contrast", {"brightness": 0.1, "contrast": 1.4}), ("hue_sat", {"hue": 200.0, "saturation": 0.7, "lightness": 0.05}), ("levels", {"input_black": 0.1, "gamma": 1.7}), ("curves", CURVES), ("posterize", {"levels": 4}), ("threshold", {"level": 0.4}), ("gradient_map", {"fg": (0.1, 0.2, 0.9), "bg": (0.9, 0.8, 0.0)})]


def stacks(ops, limit):
    """Held commands after the last row, by the plain rules."""
    done, undone, kept = [], [], []
    for seq, op, key in ops:
        if op == "undo":
            if done:
                undone.append(done.pop())
        elif op == "redo":
            if undone:
                done.append(undone.pop())
        else:
            undone = []
            if done and key is not None and done[-1][0] == key:
                done[-1][1].append(seq)
            else:
                done.append((key, [seq]))
                if limit and len(done) > limit:
                    kept.append(done.pop(0))
    return sorted(s for _, members in kept + done for s in members)


@pytest.mark.parametrize("limit", [0, 1, 4])
def test_every_version_of_random_logs(spark, limit):
    r = random.Random(limit)
    logs = {d: [(i, r.choice(["undo", "undo", "redo", "a", "b", "c"]), r.choice([None, "k", "m"])) for i in range(r.choice([0, 1, 40]))] for d in range(12)}
    rows = [(d, s, op, None if op in ("undo", "redo") else key, *BLANK) for d, x in logs.items() for s, op, key in x]
    said = oplog.resolved(spark.createDataFrame([*rows, (None, 3, "a", None, *BLANK), (5, None, "a", None, *BLANK)], LOG).repartition(3), limit)
    for v in (None, 0, 7, 25, 39):
        got = Counter((x["doc_id"], x["seq"]) for x in oplog.at(said, v).select("doc_id", "seq").collect())
        assert got == Counter((d, s) for d, x in logs.items() for s in stacks([o for o in x if v is None or o[0] <= v], limit))


def test_the_log_table_holds_what_the_history_does(spark):
    """Undo, redo and coalescing of opacities, as plans/history.py has them."""
    r, commands = random.Random(8), []
    doc = history.Document(Rect(0, 0, 8, 8), LayerTree([Layer(1), Layer(2, index=1)]), spark.createDataFrame([], "layer_id int, x int, y int, r double, g double, b double, a double"), spark.createDataFrame([], "layer_id int, x int, y int, cov double"))
    log = history.History(doc, 5)
    for seq in range(60):
        op = r.choice(["undo", "redo", "set_opacity", "set_opacity", "set_visible", "rename"])
        layer = r.choice([1, 2])
        if op == "undo":
            log.undo()
        elif op == "redo":
            log.redo()
        elif op == "set_opacity":
            log.do(history.layer_update("opacity", layer, coalesce=True, opacity=seq / 60))
        elif op == "set_visible":
            log.do(history.layer_update("visible", layer, visible=seq % 2 == 0))
        else:
            log.do(history.layer_update("name", layer, name=f"n{seq}"))
        key = history.layer_update("opacity", layer, coalesce=True, opacity=0.0).key if op == "set_opacity" else None
        commands.append((1, seq, op, key, layer, seq % 2 == 0, seq / 60, f"n{seq}", *(None,) * 8))
    base = spark.createDataFrame([(1, i, None, i, "raster", "", True, False, 1.0, "normal", 0, 0) for i in (1, 2)], "doc_id long, id long, parent long, idx long, kind string, name string, visible boolean, locked boolean, opacity double, blend string, dx int, dy int")
    got = {x["id"]: (x["name"], x["visible"], x["opacity"]) for x in oplog.layers(oplog.at(oplog.resolved(spark.createDataFrame(commands, LOG), 5)), base).collect()}
    assert got == {i: (x.name, x.visible, x.opacity) for i, x in log.document.tree.by_id.items()}


def test_odd_commands(spark):
    base = spark.createDataFrame([(1, 1, None, 0, "group", "g", True, False, 1.0, "normal", 0, 0), (1, 2, 1, 0, "group", "h", True, False, 1.0, "normal", 0, 0), (1, 3, 2, 0, "raster", "x", True, False, 1.0, "normal", 0, 0), (2, 9, None, 0, "raster", "y", True, False, 0.5, "normal", 0, 0)], "doc_id long, id long, parent long, idx long, kind string, name string, visible boolean, locked boolean, opacity double, blend string, dx int, dy int")
    rows = [(1, 0, "delete_layer", None, 1, *(None,) * 11), (1, 1, "add_layer", None, 7, None, None, None, *(None,) * 8), (1, 2, "set_opacity", None, 7, None, float("nan"), None, *(None,) * 8), (1, 3, "no such command", None, 7, *(None,) * 11), (1, 4, "paint", None, 7, None, None, None, 1, 1, None, None, 0.5, None, float("nan"), 0.5), (1, 5, "paint", None, 7, None, None, None, None, 1, 2, 2, 1.0, 1.0, 1.0, 1.0), (1, 6, "fill", None, 7, None, None, None, 0, 0, 0, 5, 1.0, 1.0, 1.0, 1.0)]
    now = oplog.at(oplog.resolved(spark.createDataFrame(rows, LOG)))
    assert sorted((x["doc_id"], x["id"], x["opacity"]) for x in oplog.layers(now, base).collect()) == [(1, 7, 1.0), (2, 9, 0.5)]
    empty = spark.createDataFrame([], "doc_id long, layer_id long, x int, y int, r double, g double, b double, a double")
    assert [tuple(x)[1:] for x in oplog.pixels(now, empty).collect()] == [(7, 1, 1, 0.5, 0.0, 0.0, 0.5)]
    none = oplog.at(oplog.resolved(spark.createDataFrame([], LOG)))
    assert oplog.layers(none, base).count() == 4 and oplog.pixels(none, empty).count() == 0


def forest_of(r, n):
    """Random trees with groups three deep, adjustments, offsets, hidden layers and masks."""
    out = {}
    for d in range(n):
        layers, groups = [], [None]
        for i in range(1, 14):
            parent = r.choice(groups)
            depth = 0 if parent is None else next(x for x in layers if x.id == parent).params["depth"] + 1
            kind = r.choices(["raster", "group", "adjustment"], [6, 3, 1])[0] if depth < 3 else "raster"
            name, params = r.choice(ADJUST)
            layers.append(Layer(i, parent=parent, index=r.randrange(5), kind=kind, blend=r.choice(list(MODES)), opacity=r.choice([0.0, 0.4, 1.0, 1.0, 0.8]), dx=r.randrange(-2, 3), dy=r.randrange(-2, 3), visible=r.random() < 0.9, adjust=name if kind == "adjustment" else None, params=params | {"depth": depth}))
            if kind == "group":
                groups.append(i)
        out[d] = layers
    return out


def test_forest_equals_single_documents(spark):
    r = random.Random(11)
    docs = forest_of(r, 4)
    px = [(d, x.id, i, j, *(r.choice([0.0, 0.25, 0.5, 1.0, r.random()]) for _ in range(4))) for d, layers in docs.items() for x in layers if x.kind == "raster" for i in range(5) for j in range(5) if r.random() < 0.6]
    masks = [(d, x.id, i, j, r.choice([0.0, 0.5, 1.0])) for d, layers in docs.items() for x in layers if x.kind == "raster" and x.id % 4 == 0 for i in range(5) for j in range(3)]
    rows = [(d, x.id, x.parent, x.index, x.kind, x.visible, x.opacity, x.blend, x.dx, x.dy, x.adjust, array_pixels.listed(x.adjust, x.params) if x.adjust else None) for d, layers in docs.items() for x in layers]
    layers = spark.createDataFrame(rows, "doc_id long, id long, parent long, idx long, kind string, visible boolean, opacity double, blend string, dx int, dy int, adjust string, params array<double>")
    pxs = spark.createDataFrame(px, "doc_id long, layer_id long, x int, y int, r double, g double, b double, a double").cache()
    mks = spark.createDataFrame(masks, "doc_id long, layer_id long, x int, y int, cov double").cache()
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = {}
    for size in ("7", before):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        got[size] = sorted(map(tuple, forest.composite_many(pxs, layers, mks).collect()))
    assert got["7"] == got[before]
    for d, tree in docs.items():
        own = pxs.filter(F.col("doc_id") == d).drop("doc_id")
        one = composite(own, LayerTree(tree), mks.filter(F.col("doc_id") == d).drop("doc_id"))
        want = {(x["x"], x["y"]): tuple(x[c] for c in "rgba") for x in one.collect()} if one is not None else {}
        mine = {x[1:3]: x[3:] for x in got[before] if x[0] == d}
        assert set(mine) == set(want)
        assert all(mine[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_forest_of_nothing(spark):
    layers = spark.createDataFrame([(1, 1, None, 0, "raster", True, 1.0, "no such mode"), (1, 2, 5, 0, "raster", True, 1.0, None), (2, 1, None, 0, "raster", None, float("nan"), "normal")], "doc_id long, id long, parent long, idx long, kind string, visible boolean, opacity double, blend string")
    px = spark.createDataFrame([(1, 1, 0, 0, 0.5, 0.5, 0.5, float("nan")), (1, 1, 1, 0, 0.5, 0.2, 0.1, 2.0), (1, 2, 0, 0, 1.0, 1.0, 1.0, 1.0), (2, 1, 0, 0, 1.0, 1.0, 1.0, 1.0), (3, 1, 0, 0, 1.0, 1.0, 1.0, 1.0)], "doc_id long, layer_id long, x int, y int, r double, g double, b double, a double")
    got = {tuple(x[:3]): tuple(x[3:]) for x in forest.composite_many(px, layers).collect()}
    assert got == {(1, 0, 0): (0.0, 0.0, 0.0, 0.0), (1, 1, 0): (0.5, 0.2, 0.1, 1.0)}
    assert forest.composite_many(px.limit(0), layers).count() == 0 and forest.composite_many(px, layers.limit(0)).count() == 0


def test_reordering_and_removing_as_tables(spark):
    """As the single tree does, for every layer and place."""
    r = random.Random(6)
    tree = LayerTree([Layer(i, parent=p, index=r.randrange(3), kind="group" if i < 4 else "raster") for i, p in [(1, None), (2, 1), (3, 1), (4, 1), (5, 2), (6, 2), (7, None), (8, 3), (9, 3), (10, 3)]])
    rows = [(i, x.id, x.parent, x.index, True, 1.0) for i in range(len(tree.by_id) * 5) for x in tree.by_id.values()]
    layers = spark.createDataFrame(rows, "doc_id long, id long, parent long, idx long, visible boolean, opacity double")
    cases = [(i, k, to) for i, (k, to) in enumerate((k, to) for k in tree.by_id for to in (-1, 0, 1, 2, 9))]
    moves = spark.createDataFrame(cases, "doc_id long, id long, to long")
    got = {}
    for x in tree_tables.reordered(layers, moves).collect():
        got.setdefault(x["doc_id"], {})[x["id"]] = x["idx"]
    left = {}
    for x in tree_tables.without(layers, moves).collect():
        left.setdefault(x["doc_id"], set()).add(x["id"])
    for i, k, to in cases:
        siblings = [c.id for c in tree.reorder(k, to).children(tree.by_id[k].parent)]
        assert sorted(siblings, key=got[i].get) == siblings
        assert left.get(i, set()) == set(tree.without(k).by_id)
