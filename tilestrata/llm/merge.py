"""Fixed-size summaries of all rows: counter vectors and id bitmaps, merged in levels."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pieces that one task adds up at a time; three levels serve FAN ** 3 partitions.
FAN = 128


def pack(counts: np.ndarray) -> bytes:
    return zlib.compress(counts.tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), np.uint32)


def _add(pieces: pd.DataFrame) -> pd.DataFrame:
    total = unpack(pieces["data"].iloc[0]).copy()
    for d in pieces["data"].iloc[1:]:
        x = unpack(d)
        room = np.iinfo(np.uint32).max - total
        total += np.minimum(x, room)
    return pd.DataFrame({"part": [int(pieces["part"].iloc[0])], "chunk": [int(pieces["chunk"].iloc[0])], "data": [pack(total)]})


def merged(pieces: DataFrame, width: int) -> np.ndarray:
    """Sum of the counter vectors in (part long, chunk int, data binary); a vector is `width` counters in equal chunks.

    The driver gets one vector, whatever the number of rows or partitions.
    """
    for level in range(3):
        up = pieces.withColumn("part", F.floor(F.col("part") / FAN) if level < 2 else F.lit(0).cast("long"))
        pieces = up.groupBy("part", "chunk").applyInPandas(_add, "part long, chunk int, data binary")
    rows = sorted((r["chunk"], r["data"]) for r in pieces.collect())
    return np.concatenate([unpack(d) for _, d in rows]) if rows else np.zeros(width, np.uint32)


def slot(column: str, bits: int) -> Column:
    """Place of an id in a bitmap of 2 ** bits."""
    return F.pmod(F.xxhash64(column), F.lit(1 << bits)).cast("long")


def bitmap(ids: DataFrame, column: str, bits: int, place: Column | None = None) -> np.ndarray:
    """Bitmap of the ids' slots, or of another place in 2 ** bits (no false negatives); at most 2 ** (bits - 5) words of 12 bytes go to the driver, as arrays."""
    words = ids.select((slot(column, bits) if place is None else place).alias("s")).select(F.shiftright("s", 5).alias("w"), F.expr("shiftleft(1L, cast(s & 31 as int))").alias("b"))
    got = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(1 << (bits - 5), np.uint32)
    out[got["w"].to_numpy()] = got["b"].to_numpy().astype(np.uint32)
    return out


def has(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (bits[slots >> 5] >> (slots & 31).astype(np.uint32)) & 1 == 1
