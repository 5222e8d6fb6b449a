"""Layer trees of many documents as a table (doc_id, id, parent, idx, visible, opacity): joins and windows, nothing on the driver but the depth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tilestrata.plans.tree import MAX_DEPTH
from tilestrata.scratch import settled


def walked(layers: DataFrame) -> DataFrame:
    """layers with depth, path (places among siblings from the top, then ids) and shown (all above and itself can show).

    One join a level; deeper trees than MAX_DEPTH, and rows whose parent is missing or a cycle, raise.
    """
    place = F.row_number().over(Window.partitionBy("doc_id", "parent").orderBy("idx", "id"))
    rows = layers.withColumns({"place": place, "own": F.col("visible") & (F.col("opacity") > 0)})
    rows = settled(rows)
    level = rows.filter("parent is null").select("*", F.lit(0).alias("depth"), F.array("place").alias("path"), F.col("own").alias("shown"))
    out = level
    for _ in range(MAX_DEPTH):
        above = level.select(F.col("doc_id").alias("_doc"), F.col("id").alias("_id"), F.col("depth").alias("_depth"), F.col("path").alias("_path"), F.col("shown").alias("_shown"))
        level = rows.join(above, (F.col("doc_id") == F.col("_doc")) & (F.col("parent") == F.col("_id")))
        level = level.select(*rows.columns, (F.col("_depth") + 1).alias("depth"), F.concat("_path", F.array("place")).alias("path"), (F.col("_shown") & F.col("own")).alias("shown"))
        level = settled(level)
        if level.isEmpty():
            break
        out = out.unionByName(level)
    if out.count() != rows.count():
        raise ValueError("a layer has no way to the top")
    return out.drop("place", "own")


def render_order(layers: DataFrame) -> DataFrame:
    """(doc_id, pos, id, depth): every document's layers in pre-order, from 0."""
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("path")) - 1
    return walked(layers).select("doc_id", order.alias("pos"), "id", "depth")


def visible_leaves(layers: DataFrame) -> DataFrame:
    """(doc_id, id) of layers without children that can show."""
    groups = layers.filter("parent is not null").select("doc_id", F.col("parent").alias("id")).distinct()
    return walked(layers).filter("shown").join(groups, ["doc_id", "id"], "left_anti").select("doc_id", "id")


def reordered(layers: DataFrame, moves: DataFrame) -> DataFrame:
    """layers with idx as the places among siblings after moves (doc_id, id, to), at most one among the children of a group."""
    siblings = ["doc_id", "parent"]
    order = Window.partitionBy(*siblings).orderBy("idx", "id")
    rows = layers.withColumn("at", F.row_number().over(order) - 1).join(moves.select("doc_id", "id", "to"), ["doc_id", "id"], "left")
    whole = Window.partitionBy(*siblings)
    rows = rows.withColumns({"to": F.when(F.col("to").isNotNull(), F.least(F.greatest("to", F.lit(0)), F.count(F.lit(1)).over(whole) - 1)), "from": F.max(F.when(F.col("to").isNotNull(), F.col("at"))).over(whole)})
    rows = rows.withColumn("goal", F.max("to").over(whole))
    rest = F.when(F.col("at") > F.col("from"), F.col("at") - 1).otherwise(F.col("at"))
    place = F.when(F.col("from").isNull(), F.col("at")).when(F.col("to").isNotNull(), F.col("to")).otherwise(rest + F.when(rest >= F.col("goal"), 1).otherwise(0))
    return rows.withColumn("idx", place).select(*layers.columns)


def without(layers: DataFrame, gone: DataFrame) -> DataFrame:
    """layers less those of gone (doc_id, id) and all that is below them."""
    below = descendants(layers, gone).select("doc_id", "id")
    return layers.join(below.unionByName(gone.select("doc_id", "id")), ["doc_id", "id"], "left_anti")


def descendants(layers: DataFrame, roots: DataFrame) -> DataFrame:
    """(doc_id, root, id) of all layers below the roots (doc_id, id): the paths that start with a root's."""
    rows = walked(layers).select("doc_id", "id", "path", "depth")
    tops = rows.join(roots.select("doc_id", "id"), ["doc_id", "id"], "left_semi").select("doc_id", F.col("id").alias("root"), F.col("path").alias("top"), F.col("depth").alias("level"))
    below = rows.join(tops, "doc_id").filter((F.col("depth") > F.col("level")) & (F.slice("path", 1, F.col("level") + 1) == F.col("top")))
    return below.select("doc_id", "root", "id")
