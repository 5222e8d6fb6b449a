"""Contiguous shards of nearly equal bytes.

Rows get a global order by (MD5 of the text, id), so that equal texts are neighbours. A
range exchange of slim rows deals that order to partitions; each partition's total of
bytes and rows goes to the driver (a few numbers a partition), and their prefix sums turn
local running sums into global positions. Cuts stand at equal targets total * k / n, moved
to the nearest edge of a group of equal texts, so that groups stay whole. A
group larger than a shard's target, which no cut can keep whole and balanced, is cut between rows, so that a group with a
third of all rows still balances.

Defined results: a null text has no bytes and counts 1 like an empty one; ties in the
order are rows equal in text and id, whose places are interchangeable; an empty table
gives no rows; with fewer rows (or bytes) than shards some shards stay empty. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilestrata.llm.storage import fresh, shared_dir


def _positions(rows: DataFrame, before: dict[int, tuple[int, int]]) -> DataFrame:
    """rows with _start (bytes before the row) and _index (rows before it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        for b in batches:
            if not b.num_rows:
                continue
            pid, size = b.column("_pid").to_numpy(), b.column("size").to_numpy()
            if at is None:
                at = before[int(pid[0])]
            ends = np.cumsum(size) + at[0]
            index = np.arange(at[1], at[1] + len(size))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ends - size), pa.array(index)], names=[*b.schema.names, "_start", "_index"])
            at = int(ends[-1]), at[1] + len(size)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", _start long, _index long"
    return rows.mapInArrow(run, schema)


def byte_shards(df: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text", whole_group_share: float = 1.0) -> DataFrame:
    """One row per input row: id, size, text_crc32, shard, slot (place in the shard, gapless from 0).

    whole_group_share: groups of equal texts up to this share of a shard's target stay whole.
    """
    spark = df.sparkSession
    shared_dir(spark)
    text = F.col(text_col).cast("string")
    slim = df.select(F.col(id_col).alias("_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), F.unhex(F.md5(F.coalesce(text, F.lit("")))).alias("_h"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = slim.repartitionByRange(parts, "_h", "_id").sortWithinPartitions("_h", "_id").withColumn("_pid", F.spark_partition_id())
    rows = rows.checkpoint()  # keeps partitions and their order as they are
    totals = sorted(tuple(r) for r in rows.groupBy("_pid").agg(F.sum("size"), F.count(F.lit(1))).collect())
    before, total, count = {}, 0, 0
    for pid, size, n in totals:
        before[pid] = (total, count)
        total, count = total + size, count + n
    placed = _positions(rows, before)
    edges = _cuts(placed, rows, total, n_shards, whole_group_share) if total else []
    shard = F.lit(0)
    if edges:
        at = F.array(*[F.lit(e).cast("long") for e in edges])
        shard = F.size(F.filter(at, lambda e: e <= F.col("_start")))
    out = placed.withColumn("shard", shard.cast("int"))
    first = {r[0]: r[1] for r in out.groupBy("shard").agg(F.min("_index")).collect()}
    slot = F.col("_index") - F.element_at(F.create_map(*[F.lit(x) for kv in first.items() for x in kv]), F.col("shard")) if first else F.col("_index")
    return out.select(F.col("_id").alias(id_col), "size", "text_crc32", "shard", slot.cast("long").alias("slot"))


def _cuts(placed: DataFrame, rows: DataFrame, total: int, n: int, share: float) -> list[int]:
    """Bytes before each shard but the first; one row of the data is looked up for each cut."""
    targets = np.array([total * k // n for k in range(1, n)], dtype=np.int64)
    if not len(targets):
        return []

    def holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            start, size = b.column("_start").to_numpy(), b.column("size").to_numpy()
            lo, hi = np.searchsorted(targets, start, "right"), np.searchsorted(targets, start + size, "right")
            yield b.filter(pa.array(hi > lo))

    held = placed.mapInArrow(holders, placed.schema).select("_h", "_start", "size").collect()
    hashes = list({bytes(r["_h"]) for r in held})
    inside = placed.filter(F.col("_h").isin(hashes)) if hashes else placed.limit(0)
    group = {bytes(r["_h"]): (r["lo"], r["bytes"]) for r in inside.groupBy("_h").agg(F.min("_start").alias("lo"), F.sum("size").alias("bytes")).collect()}
    out = []
    for t in targets.tolist():
        if not t:  # fewer bytes than shards
            out.append(0)
            continue
        r = next(r for r in held if r["_start"] < t <= r["_start"] + r["size"])
        lo, size = group[bytes(r["_h"])]
        if size > share * total / n:
            lo, size = r["_start"], r["size"]
        out.append(lo if t - lo <= lo + size - t else lo + size)
    return out


def write_shards(df: DataFrame, path: str, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with _shard and _slot (with more underscores after them where df has such columns), written under path by shard, each file sorted by slot; returns what was written."""
    own, shard, slot = (fresh(c, df.columns) for c in ("_id", "_shard", "_slot"))
    plan = byte_shards(df, n_shards, id_col, text_col).select(F.col(id_col).alias(own), F.col("shard").alias(shard), F.col("slot").alias(slot))
    out = df.join(plan, df[id_col].eqNullSafe(plan[own])).drop(plan[own])
    out.repartitionByRange(shard, slot).sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)
    return df.sparkSession.read.parquet(path)
