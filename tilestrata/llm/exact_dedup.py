"""Exact deduplication by 128-bit content hash, with bytes compared inside groups.

Rows are grouped by the MD5 of their text (128 bits) in a slim table of hash and id. Texts
of groups of two and more then meet by hash, and the least and the greatest text of a
group are compared byte by byte. A bitmap of the hashes of such groups keeps all other texts where they are, and
each map task sends a text of a group once however many copies it reads (two of a collision), to one of `SALTS` places for each
hash first, so a group of any size is never in one task. A group whose two differ is a collision and
is grouped anew by the texts themselves.

Defined results: a null text counts as empty, empty texts equal each other; rows with a
null id belong to their group but never are its representative unless all ids are null;
rows that repeat the id of the representative are the same document and stay; an empty table gives an
empty table. Columns of the input never clash: only id and text are read, under names of
the operator's own, and exact_dedup() returns the input's columns alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilestrata.llm.merge import bitmap, has, slot
from tilestrata.llm.storage import arrow_rows, cut, small
from tilestrata.llm.workers import lean

#: Bits of the bitmap of hashes as powers of two, least and most, and how many for each hash.
BITMAP_BITS, BITMAP_EACH = (16, 27), 16
#: Places where the texts of one hash meet at first.
SALTS = 32
#: Rows of an Arrow batch of texts.
BATCH_ROWS = 1000


def content_hash(text: Column) -> Column:
    return F.unhex(F.md5(text))


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", hash_of=content_hash) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    keep: "min" or "max", the id of a group that stays. hash_of: text column -> hash column.
    """
    pick = {"min": F.min, "max": F.max}[keep]
    texts = df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_t"))
    rows = texts.select("_id", hash_of(F.col("_t")).alias("_h"), F.unhex(F.sha2("_t", 256)).alias("_s"))
    groups = cut(rows.groupBy("_h").agg(F.count(F.lit(1)).alias("_n"), pick("_id").alias("_keep")), "hash-groups")
    many = groups.filter("_n > 1").select("_h")
    hashed = texts.withColumn("_h", hash_of(F.col("_t")))
    with arrow_rows(df.sparkSession, BATCH_ROWS):
        members = _distinct_members(hashed, many).withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
        ends = members.groupBy("_h", "_salt").agg(F.min("_t").alias("_lo"), F.max("_t").alias("_hi")).groupBy("_h").agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
        mixed = cut(ends.join(many, "_h", "left_semi").filter("_lo != _hi").select("_h"), "collisions")
    out = rows.join(groups, "_h").select("_id", "_h", "_s", "_n", "_keep")
    if not mixed.isEmpty():
        collided = hashed.join(mixed.hint("shuffle_hash"), "_h", "left_semi")
        exact = collided.groupBy("_h", "_t").agg(F.count(F.lit(1)).alias("_n"), pick("_id").alias("_keep"))
        exact = collided.join(exact, ["_h", "_t"]).select("_id", "_h", F.unhex(F.sha2("_t", 256)).alias("_s"), "_n", "_keep")
        out = out.join(mixed, "_h", "left_anti").unionByName(exact)
    return out.select(
        F.col("_id").alias(id_col),
        F.col("_keep").alias("keep_id"),
        F.col("_n").alias("group_size"),
        F.col("_id").eqNullSafe(F.col("_keep")).alias("kept"),
        F.lower(F.hex("_s")).alias("text_sha256"),
    )


def _distinct_members(hashed: DataFrame, many: DataFrame) -> DataFrame:
    """(_h, _t) of rows whose hash the bitmap of `many` holds, less what a task has sent already."""
    bits = min(BITMAP_BITS[1], max(BITMAP_BITS[0], (many.count() * BITMAP_EACH).bit_length()))
    marks = hashed.sparkSession.sparkContext.broadcast(bitmap(many, "_h", bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sent = marks.value, {}
        for b in batches:
            keep = has(held, b.column("slot").to_numpy())
            at = np.flatnonzero(keep)
            for i, h, t in zip(at.tolist(), b.column("_h").take(pa.array(at)).to_pylist(), b.column("_t").take(pa.array(at)), strict=True):
                text, before = t.as_buffer().to_pybytes(), sent.setdefault(h, [])
                keep[i] = text not in before
                if keep[i]:
                    before.append(text)
            yield pa.RecordBatch.from_arrays([b.column("_h"), b.column("_t")], names=["_h", "_t"]).filter(pa.array(keep))

    return hashed.select("_h", "_t", slot("_h", bits).alias("slot")).mapInArrow(lean(run), "_h binary, _t string")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """df without the rows whose text another row has; all columns of df. Rows go by id and text, so other texts of the same id, or without one, stay."""
    groups = exact_groups(df, id_col, text_col, keep)
    gone = small(groups.filter("not kept").select(F.col(id_col).alias("_gone"), F.unhex("text_sha256").alias("_of")))
    text = F.unhex(F.sha2(F.coalesce(df[text_col].cast("string"), F.lit("")), 256))
    return df.join(gone, df[id_col].eqNullSafe(gone["_gone"]) & (text == gone["_of"]), "left_anti")
