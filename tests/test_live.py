"""A document edited by a stream: against compositing it whole, after restarts, and fingerprints in any order."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tilestrata.plans.compositor import composite
from tilestrata.plans.tree import Layer, LayerTree
from tilestrata.streaming import live

TREE = LayerTree([Layer(1), Layer(2, index=1, blend="screen", opacity=0.5, dx=250), Layer(3, kind="group", index=2, dy=-7), Layer(4, parent=3, dx=5), Layer(5, index=3, visible=False)])


def history(seed, n):
    """(first pixels, edits): each edit knows what was there."""
    r = random.Random(seed)
    colour = lambda: tuple(r.choice([0.0, 0.25, 0.5, 1.0]) for _ in range(4))
    now = {(layer, r.randrange(-300, 300), r.randrange(20)): colour() for layer in (1, 2, 4, 5) for _ in range(40)}
    first, edits = dict(now), []
    for i in range(n):
        k = r.choice([*now, (r.choice([1, 2, 4, 5]), r.randrange(-300, 300), r.randrange(20))])
        new = None if r.random() < 0.3 else colour()
        edits.append((i, *k, now.get(k), new))
        if new is None:
            now.pop(k, None)
        else:
            now[k] = new
    return first, edits, now


def relation(spark, px):
    return spark.createDataFrame([(*k, *v) for k, v in px.items()], live.PLACE)


def shown(df):
    return sorted((r["x"], r["y"], *(round(r[c], 9) for c in "rgba")) for r in df.collect())


@pytest.mark.parametrize("again", [False, True])
def test_stream_equals_whole_composite(spark, tmp_path, again):
    first, edits, now = history(3, 90)
    folder, source = f"file://{tmp_path}/doc", tmp_path / "edits"
    live.open_document(relation(spark, first), TREE, folder)
    assert shown(live.view(spark, folder)) == shown(composite(relation(spark, first), TREE))
    stream = lambda: spark.readStream.schema(live.EDIT).option("maxFilesPerTrigger", 1).parquet(f"file://{source}")
    for k in range(3):
        spark.createDataFrame(edits[30 * k : 30 * k + 30], live.EDIT).coalesce(1).write.mode("append").parquet(f"file://{source}")
        query = live.start(stream(), TREE, folder, once=True)
        query.awaitTermination()
        if again and k == 1:  # the batch's commit is lost: it runs again, over what it wrote
            done = sorted((tmp_path / "doc/progress/commits").glob("[0-9]*"), key=lambda p: int(p.name))[-1]
            Path(done.parent / f".{done.name}.crc").unlink(missing_ok=True)
            done.unlink()
            next((tmp_path / f"doc/pixels/v={done.name}").glob("part-*")).unlink()
    assert shown(live.view(spark, folder)) == shown(composite(relation(spark, now), TREE))
    assert sorted(map(tuple, live.pixels(spark, folder).collect())) == sorted((*k, *v) for k, v in now.items())
    assert sorted(map(tuple, live.pixels(spark, folder, -1).collect())) == sorted((*k, *v) for k, v in first.items())
    written = {(r["v"], r["tx"]) for r in spark.read.parquet(f"{folder}/tiles").collect()}
    assert len({v for v, _ in written}) == 4


def test_edits_that_were_taken_back_go_no_further(spark, tmp_path):
    red, blue = (1.0, 0.0, 0.0, 1.0), (0.0, 0.0, 1.0, 1.0)
    px = {(1, 0, 0): red}
    folder, source = f"file://{tmp_path}/doc", f"file://{tmp_path}/edits"
    live.open_document(relation(spark, px), TREE, folder)
    edits = [(0, 1, 0, 0, red, blue), (1, 1, 0, 0, blue, red), (2, 1, 5, 5, None, red), (3, 1, 5, 5, red, None), (4, None, 1, 1, None, red), (5, 1, None, 1, None, red)]
    spark.createDataFrame(edits, live.EDIT).write.parquet(source)
    live.start(spark.readStream.schema(live.EDIT).parquet(source), TREE, folder, once=True).awaitTermination()
    assert live._versions(spark, folder, "tiles", "tx int, ty int").filter("v >= 0").count() == 0
    assert shown(live.view(spark, folder)) == shown(composite(relation(spark, px), TREE))


def test_fingerprints_in_any_order(spark):
    first, edits, now = history(9, 200)
    old, new = relation(spark, first), relation(spark, now)
    prints = lambda df: sorted(map(tuple, df.select("layer_id", "tx", "ty", "sig", "n").collect()))
    want = prints(live.fingerprint(new, "layer_id"))
    assert prints(live.fingerprint(new.repartition(7).orderBy(F.rand(1)), "layer_id")) == want
    gone = relation(spark, {k: v for k, v in first.items() if now.get(k) != v})
    come = relation(spark, {k: v for k, v in now.items() if first.get(k) != v})
    assert prints(live.edited(live.fingerprint(old, "layer_id"), gone, come, "layer_id")) == want
    halves = [live.fingerprint(new.filter(f"x % 2 = 0 = {b}"), "layer_id") for b in ("true", "false")]
    assert prints(live.merged(*halves)) == want
    k, v = next(iter(now.items()))
    other = relation(spark, now | {k: (v[0] + 0.125, *v[1:])})
    assert len(set(prints(live.fingerprint(other, "layer_id"))) ^ set(want)) == 2
    assert live.fingerprint(new.limit(0), "layer_id").count() == 0
