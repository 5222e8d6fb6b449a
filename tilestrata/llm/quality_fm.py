"""Quality classifier: a factorisation machine of second order.

Features of a whole text: hashed words (presence, scaled to unit length), structure statistics
(shares of letter classes, repetition, line shape; each put into quantile bins) and metadata (bins of the n_chars
column where there is one). Score: sigmoid(w0 + sum w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 -
sum_i v_if^2 x_i^2)), so pairwise interactions take time linear in the features.

Fit: on a bounded sample, the `sample_rows` labelled rows with the smallest hashed ids,
by AdaGrad on the logistic loss, both labels weighing alike. Prediction streams over Arrow batches with one small model broadcast.

Defined results: null and empty texts score by their structure bins alone; rows with a null label are not
learned from; several labels of one id count each; without labels of both kinds every score is the share of label 1, or 0.5; rows are scored one
by one, so ties, repeats and other columns do not matter; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilestrata.llm._text import chunks, text_buffers, word_hashes

WORDS = 1 << 13
BINS = 12
RANK = 8
#: Byte classes: upper, lower, digit, space, line end, bar, other ASCII sign, beyond ASCII.
_CLASS = np.full(256, 6, np.uint8)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = 0, 1, 2, 7
_CLASS[[32, 9, 11, 12, 13]], _CLASS[10], _CLASS[124] = 3, 4, 5
STATS = 8 + 8


def _statistics(n_bytes, shares, words, uniq_share, top_share, repeat, word_len, long_word, pairs, lines) -> list[float]:
    return [*shares, np.log1p(words), uniq_share, top_share, repeat, word_len, long_word, pairs, lines]


def features(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashed words, their offsets by row, statistics by row)."""
    data, offsets = text_buffers(column)
    ids, at, stats = [], [0], []
    for lo, hi in chunks(offsets):
        hashes, starts, ends, rng = word_hashes(data, offsets[lo : hi + 1])
        kind = _CLASS[data[offsets[lo] : offsets[hi]]]
        edge = offsets[lo : hi + 1] - offsets[lo]
        counts = np.stack([np.concatenate(([0], np.cumsum(kind == k, dtype=np.int64)))[edge] for k in range(8)])
        counts = np.diff(counts, axis=1)
        size = ends - starts
        for i in range(hi - lo):
            h = hashes[rng[i] : rng[i + 1]]
            n_bytes, n = int(edge[i + 1] - edge[i]), len(h)
            u, c = np.unique(h, return_counts=True)
            shares = counts[:, i] / max(1, n_bytes)
            if n:
                pair = np.unique(h[:-1] * np.uint64(3) + h[1:]) if n > 1 else h
                stats.append(_statistics(n_bytes, shares, n, len(u) / n, c.max() / n, float((h[1:] == h[:-1]).mean()) if n > 1 else 0.0, size[rng[i] : rng[i + 1]].mean(), float(size[rng[i] : rng[i + 1]].max()), len(pair) / max(1, n - 1), counts[4, i] / n))
            else:
                stats.append(_statistics(n_bytes, shares, 0, 0, 0, 0, 0, 0, 0, 0))
            d = np.unique(u & np.uint64(WORDS - 1)).astype(np.int32)
            ids.append(d)
            at.append(at[-1] + len(d))
    return np.concatenate(ids) if ids else np.zeros(0, np.int32), np.array(at), np.array(stats).reshape(-1, STATS)


@dataclass
class Model:
    """Bin edges, weights and factors."""

    edges: np.ndarray
    w0: float
    w: np.ndarray
    v: np.ndarray

    def rows(self, words: np.ndarray, at: np.ndarray, stats: np.ndarray, chars: np.ndarray | None):
        """Indices, values and offsets of all features."""
        n = len(at) - 1
        values = stats if chars is None else np.column_stack((stats, chars))
        bins = np.stack([np.searchsorted(e, values[:, k], "right") for k, e in enumerate(self.edges)], axis=1)
        bins = (WORDS + np.arange(values.shape[1]) * (BINS + 1) + bins).astype(np.int32)
        many = np.diff(at)
        k = bins.shape[1]
        out = np.empty(len(words) + n * k, np.int32)
        value = np.empty(len(out))
        start = at[:-1] + np.arange(n) * k
        place = np.repeat(start, many) + np.arange(len(words)) - np.repeat(at[:-1], many)
        out[place], value[place] = words, np.repeat(1 / np.sqrt(np.maximum(1, many)), many)
        place = (start + many)[:, None] + np.arange(k)
        out[place], value[place] = bins, 1 / np.sqrt(k)
        return out, value, np.append(start, len(out))

    def logits(self, index: np.ndarray, value: np.ndarray, at: np.ndarray):
        """Scores and the factor sums, in time linear in the features."""
        x = self.v[index] * value[:, None]
        sums = np.add.reduceat(x, at[:-1], axis=0)
        squares = np.add.reduceat((x * x).sum(axis=1), at[:-1])
        return self.w0 + np.add.reduceat(self.w[index] * value, at[:-1]) + 0.5 * ((sums * sums).sum(axis=1) - squares), sums

    def predict(self, column, chars: np.ndarray | None) -> np.ndarray:
        words, at, stats = features(column)
        if len(at) == 1:
            return np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.logits(*self.rows(words, at, stats, chars))[0], -30, 30)))


def train(words: np.ndarray, at: np.ndarray, stats: np.ndarray, labels: np.ndarray, chars: np.ndarray | None, epochs: int = 15, rate: float = 0.1, decay: float = 1e-4, seed: int = 7) -> Model:
    """Minibatch AdaGrad on features(), classes weighted to be even; rows are shuffled by a fixed seed."""
    rng = np.random.default_rng(seed)
    values = stats if chars is None else np.column_stack((stats, chars))
    edges = np.quantile(values, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T if len(values) else np.zeros((values.shape[1], BINS - 1))
    size = WORDS + values.shape[1] * (BINS + 1)
    share = float(np.clip(labels.mean(), 1e-3, 1 - 1e-3)) if len(labels) else 0.5
    model = Model(edges, float(np.log(share / (1 - share))), np.zeros(size), rng.normal(0, 0.05, (size, RANK)))
    if len(np.unique(labels)) < 2:
        model.v[:] = 0
        return model
    index, value, at = model.rows(words, at, stats, chars)
    model.w0 = 0.0
    weight = np.where(labels > 0, 0.5 / share, 0.5 / (1 - share))
    seen_w, seen_v, seen_0 = np.full(size, 1e-6), np.full((size, RANK), 1e-6), 1e-6
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for lo in range(0, len(order), 256):
            pick = order[lo : lo + 256]
            many = at[pick + 1] - at[pick]
            ends = np.concatenate(([0], np.cumsum(many)))
            take = np.repeat(at[pick] - ends[:-1], many) + np.arange(ends[-1])
            i, x = index[take], value[take]
            logit, sums = model.logits(i, x, ends)
            err = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels[pick]) * weight[pick] / len(pick)
            e = np.repeat(err, many) * x
            g = np.bincount(i, e, size) + decay * model.w * (np.bincount(i, minlength=size) > 0)
            gv = e[:, None] * (np.repeat(sums, many, axis=0) - model.v[i] * x[:, None])
            gv = np.stack([np.bincount(i, gv[:, f], size) for f in range(RANK)], axis=1)
            seen_w += g * g
            seen_v += gv * gv
            seen_0 += err.sum() ** 2
            model.w -= rate * g / np.sqrt(seen_w)
            model.v -= rate * gv / np.sqrt(seen_v)
            model.w0 -= rate * err.sum() / np.sqrt(seen_0)
    return model


def _chars(df: DataFrame, chars_col: str | None) -> Column:
    return F.log1p(F.greatest(F.coalesce(F.col(chars_col).cast("double"), F.lit(-0.5)), F.lit(-0.5))) if chars_col else F.lit(None).cast("double")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", chars_col: str | None = "n_chars", sample_rows: int = 6000) -> Model:
    """labels: (id, label). The features of at most sample_rows rows reach the driver: 2 ** 13 words and 16 statistics each at most, whatever the texts."""
    picked = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).filter("_y is not null and _id is not null").orderBy(F.xxhash64(F.col("_id").cast("string")), "_id", "_y").limit(sample_rows)
    chars_col = chars_col if chars_col in docs.columns else None
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text"), _chars(docs, chars_col).alias("chars")).join(F.broadcast(picked), "_id").select("_y", "text", "chars", F.xxhash64("_id").alias("k"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, at, stats = features(b.column("text"))
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(words))
            yield pa.RecordBatch.from_arrays([b.column("k"), b.column("_y"), lists, pa.array(list(stats), pa.list_(pa.float64())), b.column("chars")], names=["k", "y", "words", "stats", "chars"])

    # an id that repeats among the documents brings several rows for its label, so the bound is applied again
    got = rows.mapInArrow(run, "k long, y int, words array<int>, stats array<double>, chars double").orderBy("k", "y", "words", "stats").limit(sample_rows).toArrow().combine_chunks()
    words = got["words"].combine_chunks() if got.num_rows else pa.array([], pa.list_(pa.int32()))
    at = np.concatenate(([0], np.cumsum([len(x) for x in words]))).astype(np.int64)
    stats = np.array(got["stats"].to_pylist(), float).reshape(-1, STATS)
    return train(words.flatten().to_numpy(zero_copy_only=False).astype(np.int32), at, stats, got["y"].to_numpy().astype(float), got["chars"].to_numpy() if chars_col else None)


def predict(df: DataFrame, model: Model, text_col: str = "text", chars_col: str | None = "n_chars", columns: list[Column] | None = None) -> DataFrame:
    """columns of df (all by default) with quality_score, 0 to 1. A model that learned from chars_col takes 0 characters where df has no such column."""
    learned = len(model.edges) > STATS
    chars_col = chars_col if chars_col in df.columns else None
    shown = columns if columns is not None else [F.col(f"`{c}`") for c in df.columns if c != "quality_score"]
    shown = df.select(F.struct(*shown).alias("row"), F.col(text_col).cast("string").alias("text"), F.coalesce(_chars(df, chars_col), F.lit(0.0)).alias("chars"))
    send = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for lo in range(0, big.num_rows, 2000):
                b = big.slice(lo, 2000)
                k = b.num_columns - 2
                s = send.value.predict(b.column(k), b.column(k + 1).to_numpy(zero_copy_only=False) if learned else None)
                yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(k)], pa.array(s)], names=[*b.schema.names[:k], "quality_score"])

    return shown.mapInArrow(run, shown.drop("text", "chars").schema.add("quality_score", "double")).select("row.*", "quality_score")
