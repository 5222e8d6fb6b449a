"""Pixel relations derived from the supplied tables; the same SQL runs in Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilestrata.operators.tiles import Rect
from tilestrata.plans.tree import Layer, LayerTree

CANVAS = Rect(-32, -32, 64, 64)

PX_SQL = """SELECT CAST(l_linenumber AS INT) AS layer_id, CAST(CAST(l_orderkey AS BIGINT) % {n} AS INT) - {h} AS x, CAST(CAST(l_partkey AS BIGINT) % {n} AS INT) - {h} AS y,
max(l_quantity) / 50.0 + 0.0 AS r, max(l_discount) * 10.0 + 0.0 AS g, max(l_tax) * 12.5 + 0.0 AS b, max(l_extendedprice) / 105000.0 AS a
FROM lineitem GROUP BY 1, 2, 3"""
#: A grey image: place = (position, vec_id), value = embedding + 0.5 clamped.
GREY_SQL = "SELECT CAST(i AS INT) AS x, CAST(vec_id AS INT) AS y, v AS r, v AS g, v AS b, CAST(1.0 AS DOUBLE) AS a FROM (SELECT vec_id, i, least(greatest(CAST(e AS DOUBLE) + 0.5, CAST(0.0 AS DOUBLE)), CAST(1.0 AS DOUBLE)) AS v FROM grey_raw) t"

#: Seven layers of distinct modes: one invisible, one of opacity 0, one moved.
LAYERS = [
    Layer(1, index=0, name="base"),
    Layer(2, index=1, blend="multiply", opacity=0.8),
    Layer(3, index=2, blend="screen", opacity=0.6, dx=3, dy=-5),
    Layer(4, index=3, blend="overlay", visible=False),
    Layer(5, index=4, blend="soft-light", opacity=0.0),
    Layer(6, index=5, blend="difference", opacity=0.5),
    Layer(7, index=6, blend="color-dodge", opacity=0.4),
]


def pixels(spark: SparkSession, sf_dir: str, n: int = 64) -> DataFrame:
    """(layer_id, x, y, r, g, b, a) from lineitem on an n x n canvas around the origin."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    place = lambda c: (F.col(c).cast("long") % n).cast("int") - n // 2
    top = rows.groupBy(F.col("l_linenumber").cast("int").alias("layer_id"), place("l_orderkey").alias("x"), place("l_partkey").alias("y")).agg(*[F.max(c).alias(c) for c in ("l_quantity", "l_discount", "l_tax", "l_extendedprice")])
    return top.select("layer_id", "x", "y", (F.col("l_quantity") / 50.0 + 0.0).alias("r"), (F.col("l_discount") * 10.0 + 0.0).alias("g"), (F.col("l_tax") * 12.5 + 0.0).alias("b"), (F.col("l_extendedprice") / 105000.0).alias("a"))


def layer(spark: SparkSession, sf_dir: str, i: int) -> DataFrame:
    return pixels(spark, sf_dir).filter(F.col("layer_id") == i).drop("layer_id")


def layer_sql(i: int) -> str:
    return f"SELECT x, y, r, g, b, a FROM px WHERE layer_id = {i}"


def tree(*layers: Layer) -> LayerTree:
    return LayerTree(list(layers) or LAYERS)


def strokes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stroke_id, seq, px, py, pressure) from events: a stroke for each user."""
    from pyspark.sql.window import Window

    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    k = F.coalesce(F.regexp_extract("props", r"(\d+)", 1).cast("double"), F.lit(0.0)) / 100.0
    return e.select(F.col("user_id").cast("long").alias("stroke_id"), seq.alias("seq"), (F.col("value") / 4.0).alias("px"), (F.col("event_id") % 128).cast("double").alias("py"), k.alias("pressure"))


STROKES_SQL = "SELECT CAST(user_id AS BIGINT) AS stroke_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, value / 4.0 AS px, CAST(event_id % 128 AS DOUBLE) AS py, coalesce(TRY_CAST(regexp_extract(props, '(\\d+)', 1) AS DOUBLE), 0.0) / 100.0 AS pressure FROM events"


def palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(r, g, b, a) colours from part."""
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"), (F.col("p_size") / 50.0).alias("r"), ((F.col("p_retailprice") - 900.0) / 100.0).alias("g"), ((F.col("p_partkey") % 26) / 25.0).alias("b"))


PALETTE_SQL = "SELECT p_partkey AS id, p_size / 50.0 AS r, (p_retailprice - 900.0) / 100.0 AS g, (p_partkey % 26) / 25.0 AS b FROM part"
