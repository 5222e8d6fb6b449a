"""Strokes as a stream: segment i is final once sample i + 2 is there."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "stroke_id long, seq int, px double, py double, nx double, ny double"
STATE = "seq array<int>, px array<double>, py array<double>"


def finalized_segments(samples: DataFrame) -> DataFrame:
    """(stroke_id, seq, px, py, nx, ny) of segments as they become final, from a stream of (stroke_id, seq, px, py).

    The state of a stroke is its last two samples. Samples of a stroke come in order.
    """

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get, strict=True)) if state.exists else []
        new = pd.concat(list(batches)).sort_values("seq")
        held += [(int(s), float(x), float(y)) for s, x, y in new[["seq", "px", "py"]].itertuples(index=False)]
        done = [(key[0], a[0], a[1], a[2], b[1], b[2]) for a, b in zip(held[:-2], held[1:-1], strict=True)]
        last = held[-2:]
        state.update(([s for s, _, _ in last], [x for _, x, _ in last], [y for _, _, y in last]))
        yield pd.DataFrame(done, columns=["stroke_id", "seq", "px", "py", "nx", "ny"])

    return samples.groupBy("stroke_id").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def latest_requests(requests: DataFrame) -> DataFrame:
    """The newest request of each kind: (kind, id, payload)."""
    return requests.groupBy("kind").agg(F.max("id").alias("id"), F.max_by("payload", "id").alias("payload"))


def tile_signatures(px: DataFrame) -> DataFrame:
    """(layer_id, tx, ty, sig): order-free fingerprints of tiles, for incremental recomposites."""
    h = F.xxhash64("x", "y", "r", "g", "b", "a")
    return px.groupBy("layer_id", F.shiftright("x", 8).alias("tx"), F.shiftright("y", 8).alias("ty")).agg(F.bit_xor(h).alias("sig"), F.count(F.lit(1)).alias("n"))


def changed_tiles(before: DataFrame, after: DataFrame) -> DataFrame:
    """(tx, ty) whose signatures differ between two tile_signatures()."""
    keys = ["layer_id", "tx", "ty", "sig", "n"]
    return after.join(before, keys, "left_anti").unionByName(before.join(after, keys, "left_anti")).select("tx", "ty").distinct()
