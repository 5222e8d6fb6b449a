"""Op-logs of many documents as one table, replayed in one job.

A log row is a command, an undo or a redo: (doc_id, seq, op, key, layer_id, flag, value, name, x, y, w, h, r, g, b, a). Undo and redo
are a machine over slim rows (doc, seq, op, key) in order, whose state is the two stacks of a document, so at most `limit` steps each;
it says which step a command belongs to and in which versions a step holds. What a version looks like is then plain
relational work: last values by attribute, sums of moves, and an ordered blend of pixel commands, which needs no list of
a place's commands: what is left of one is its alpha times what all later ones let through, a running sum of logarithms.

Defined results: rows without a document or number are left out; a command whose key equals that of the step on top
joins it; a new command drops what was undone; undo and redo without a step do nothing; steps beyond the limit stay for
good; other commands than the known ones change nothing; NaN and null values count as not given; documents without
rows, and an empty log, look as the base does. limit 0 keeps every step, then the state grows with a document's steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tilestrata.operators.raster import RGBA
from tilestrata.plans.history import LIMIT
from tilestrata.scratch import settled

UNDO, REDO = "undo", "redo"
#: Commands that set an attribute of a layer, and the column with its value.
SETS = {"set_visible": ("visible", "flag"), "set_locked": ("locked", "flag"), "set_opacity": ("opacity", "value"), "set_blend": ("blend", "name"), "rename": ("name", "name")}
#: Commands that write pixels: `fill` and `clear` a rectangle, `paint` a disc of radius w around (x, y) over what is there.
PIXELS = ("fill", "clear", "paint")


class _Stacks:
    """Undo and redo of one document; entries are [step, key, since]."""

    def __init__(self, limit: int) -> None:
        self.limit, self.done, self.undone = limit, [], []

    def add(self, seq: int, op: str, key: str | None) -> tuple[int | None, list[tuple[int, int, int | None]]]:
        """(step of a command, spans that end now)."""
        if op == UNDO:
            if not self.done:
                return None, []
            step, key, since = self.done.pop()
            self.undone.append((step, key))
            return None, [(step, since, seq)]
        if op == REDO:
            if self.undone:
                self.done.append((*self.undone.pop(), seq))
            return None, []
        self.undone.clear()
        if self.done and key is not None and self.done[-1][1] == key:
            return self.done[-1][0], []
        self.done.append((seq, key, seq))
        if self.limit and len(self.done) > self.limit:
            step, _, since = self.done.pop(0)
            return seq, [(step, since, None)]
        return seq, []

    def rest(self) -> list[tuple[int, int, None]]:
        return [(step, since, None) for step, _, since in self.done]


def resolved(log: DataFrame, limit: int = LIMIT) -> DataFrame:
    """log's commands with step, since and until: each holds in versions since <= version < until (null: to the end), once for each time its step was done."""
    kind = log.schema["doc_id"].dataType
    slim = log.select("doc_id", F.col("seq").cast("long").alias("seq"), "op", "key").filter("doc_id IS NOT NULL AND seq IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, stacks = None, None
        types = [pa.int64()] * 4
        for b in batches:
            docs, rows = [], []
            for d, seq, op, key in zip(*(b.column(c).to_pylist() for c in ("doc_id", "seq", "op", "key")), strict=True):
                if stacks is None or d != doc:
                    if stacks:
                        rest = stacks.rest()
                        rows += [(None, *s) for s in rest]
                        docs += [doc] * len(rest)
                    doc, stacks = d, _Stacks(limit)
                step, spans = stacks.add(seq, op, key)
                rows += [(None, *s) for s in spans]
                docs += [d] * len(spans)
                if step is not None:
                    rows.append((seq, step, None, None))
                    docs.append(d)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(docs, b.schema.field("doc_id").type), *map(pa.array, zip(*rows, strict=True), types)], names=["doc_id", "seq", "step", "since", "until"])
            schema = b.schema
        if stacks and (rest := stacks.rest()):
            columns = [pa.nulls(len(rest), pa.int64()), *map(pa.array, zip(*rest, strict=True), types[1:])]
            yield pa.RecordBatch.from_arrays([pa.array([doc] * len(rest), schema.field("doc_id").type), *columns], names=["doc_id", "seq", "step", "since", "until"])

    schema = T.StructType([T.StructField("doc_id", kind), *(T.StructField(c, T.LongType()) for c in ("seq", "step", "since", "until"))])
    said = settled(slim.repartition("doc_id").sortWithinPartitions("doc_id", "seq").mapInArrow(run, schema))
    steps = said.filter("seq IS NOT NULL").select("doc_id", "seq", "step")
    spans = said.filter("seq IS NULL").select("doc_id", "step", "since", "until")
    held = steps.join(spans, ["doc_id", "step"])
    rows = log.drop("step", "since", "until").withColumn("seq", F.col("seq").cast("long"))
    return rows.join(held, ["doc_id", "seq"])


def at(commands: DataFrame, version: Column | int | None = None) -> DataFrame:
    """The commands of resolved() that hold in a version (the last by default); version may be a column."""
    if version is None:
        return commands.filter("until IS NULL").drop("since", "until")
    v = version if isinstance(version, Column) else F.lit(version)
    return commands.filter((F.col("seq") <= v) & (F.col("since") <= v) & (F.col("until").isNull() | (F.col("until") > v))).drop("since", "until")


def layers(active: DataFrame, base: DataFrame) -> DataFrame:
    """base (doc_id, id, parent, idx, kind, name, visible, locked, opacity, blend, dx, dy) as the active commands leave it.

    add_layer puts a raster layer on top, delete_layer takes a layer (and what hangs below it) away.
    """
    added = active.filter("op = 'add_layer'").groupBy("doc_id", F.col("layer_id").alias("id")).agg(F.min("seq").alias("seq"), F.min_by("name", "seq").alias("name"))
    top = base.filter("parent IS NULL").groupBy("doc_id").agg(F.max("idx").alias("top"))
    added = added.join(top, "doc_id", "left").join(base.select("doc_id", "id"), ["doc_id", "id"], "left_anti")
    none = F.lit(None).cast(base.schema["parent"].dataType)
    added = added.select("doc_id", "id", none.alias("parent"), (F.coalesce("top", F.lit(0)) + 1 + F.col("seq")).alias("idx"), F.lit("raster").alias("kind"), F.coalesce("name", F.lit("")).alias("name"), F.lit(True).alias("visible"), F.lit(False).alias("locked"), F.lit(1.0).alias("opacity"), F.lit("normal").alias("blend"), F.lit(0).alias("dx"), F.lit(0).alias("dy"))
    value = {"flag": F.col("flag"), "value": F.nanvl(F.col("value"), F.lit(None).cast("double")), "name": F.col("name")}
    last = [F.max_by(value[c], F.when((F.col("op") == op) & value[c].isNotNull(), F.col("seq"))).alias(f"new_{to}") for op, (to, c) in SETS.items()]
    moved = [F.sum(F.when(F.col("op") == "move", F.col(c))).alias(f"by_{c}") for c in ("x", "y")]
    changes = active.groupBy("doc_id", F.col("layer_id").alias("id")).agg(*last, *moved, F.max(F.col("op") == "delete_layer").alias("gone"))
    now = base.unionByName(added).join(changes, ["doc_id", "id"], "left")
    now = now.withColumns({to: F.coalesce(f"new_{to}", to) for to, _ in SETS.values()} | {"dx": (F.col("dx") + F.coalesce("by_x", F.lit(0))).cast("int"), "dy": (F.col("dy") + F.coalesce("by_y", F.lit(0))).cast("int"), "opacity": F.least(F.greatest(F.coalesce("new_opacity", "opacity"), F.lit(0.0)), F.lit(1.0))})
    now = now.withColumn("gone", F.coalesce("gone", F.lit(False))).select(*base.columns, "gone")
    return _without(now)


def _without(layers: DataFrame) -> DataFrame:
    """Layers that aren't gone and have no group above that is; a join for each level that loses some."""
    layers = settled(layers)
    while True:
        lost = layers.filter("gone").select("doc_id", F.col("id").alias("parent"))
        rest = settled(layers.filter("NOT gone").join(lost.withColumn("lost", F.lit(True)), ["doc_id", "parent"], "left").withColumn("gone", F.coalesce("lost", F.lit(False))).select(*layers.columns))
        if rest.filter("gone").isEmpty():
            return rest.drop("gone")
        layers = rest


def places(commands: DataFrame) -> DataFrame:
    """(doc_id, layer_id, x, y, seq, reset, r, g, b, a): the places that pixel commands write."""
    rows = commands.filter(F.col("op").isin(*PIXELS) & F.col("x").isNotNull() & F.col("y").isNotNull())
    disc = F.col("op") == "paint"
    wide, high = F.coalesce("w", F.lit(0)), F.coalesce("h", F.lit(0))
    x0, x1 = F.when(disc, F.col("x") - wide).otherwise(F.col("x")), F.when(disc, F.col("x") + wide).otherwise(F.col("x") + wide - 1)
    y0, y1 = F.when(disc, F.col("y") - wide).otherwise(F.col("y")), F.when(disc, F.col("y") + wide).otherwise(F.col("y") + high - 1)
    span = lambda lo, hi: F.when(hi >= lo, F.sequence(lo, hi))
    rows = rows.select("*", F.explode(span(y0, y1)).alias("py")).select("*", F.explode(span(x0, x1)).alias("px"))
    dx, dy = F.col("px") - F.col("x"), F.col("py") - F.col("y")
    rows = rows.filter(~disc | (dx * dx + dy * dy <= wide * wide))
    colour = [F.when(F.col("op") == "clear", 0.0).otherwise(F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0))).alias(c) for c in RGBA]
    out = rows.select("doc_id", "layer_id", F.col("px").cast("int").alias("x"), F.col("py").cast("int").alias("y"), "seq", disc.alias("disc"), *colour)
    out = out.withColumn("a", F.when(F.col("disc"), F.least(F.greatest("a", F.lit(0.0)), F.lit(1.0))).otherwise(F.col("a")))
    return out.select("doc_id", "layer_id", "x", "y", "seq", (~F.col("disc") | (F.col("a") >= 1)).alias("reset"), *RGBA)


def pixels(active: DataFrame, base: DataFrame) -> DataFrame:
    """Pixels (doc_id, layer_id, x, y, r, g, b, a) of base as the active commands leave them; empty places have no row."""
    place = ["doc_id", "layer_id", "x", "y"]
    old = base.select(*place, F.lit(-1).cast("long").alias("seq"), F.lit(True).alias("reset"), *RGBA)
    rows = old.unionByName(places(active))
    last = F.max(F.when(F.col("reset"), F.col("seq"))).over(Window.partitionBy(*place))
    rows = rows.withColumn("last", last).filter("last IS NULL OR seq >= last")
    later = Window.partitionBy(*place).orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)
    through = F.exp(F.coalesce(F.sum(F.when(~F.col("reset"), F.log1p(-F.col("a")))).over(later), F.lit(0.0)))
    rows = rows.withColumn("left", F.col("a") * through)
    out = rows.groupBy(*place).agg(F.sum("left").alias("alpha"), *[F.sum(F.col(c) * F.col("left")).alias(c) for c in "rgb"])
    return out.filter("alpha > 0").select(*place, *[(F.col(c) / F.col("alpha")).alias(c) for c in "rgb"], F.col("alpha").alias("a"))
