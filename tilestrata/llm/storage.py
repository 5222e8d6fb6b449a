"""Where operators cut lineage and keep intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir.

    Only where that is unset and everything runs on one machine (tests) a temporary folder is taken.
    """
    context = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not where:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="tilestrata-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(where)
    return where


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame, what: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: columns stay prunable, lost executors cost nothing."""
    spark = df.sparkSession
    path = scratch(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most: int = 500_000) -> DataFrame:
    """df, written and read again, to be broadcast where it has at most so many rows (of a few dozen bytes each), and shuffled otherwise."""
    df = cut(df, "keys")
    return F.broadcast(df) if df.count() <= most else df


def fresh(name: str, taken: list[str]) -> str:
    """name, or name with underscores after it, so that no column has it (names are told apart without case)."""
    held = {c.lower() for c in taken}
    while name.lower() in held:
        name += "_"
    return name


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs started inside send at most so many rows in an Arrow batch, which bounds a worker's memory where rows are wide."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)
