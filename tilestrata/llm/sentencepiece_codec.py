"""SentencePiece encoding and decoding with an Aho-Corasick automaton and Viterbi.

The vocabulary is read from an existing model file (a parameter; nothing is trained). Its
pieces form an Aho-Corasick automaton; one pass over the text reports, through the output links of
each state, every piece that ends at a position, and each relaxes the best score of the text
up to there. Characters that no piece covers fall back to their UTF-8 byte pieces, or to
the unknown piece.

Scores: those of the file if its type is unigram. In a merge-rank model (BPE) a file's scores are negated ranks, no
log probabilities; there piece r of the file gets the Zipf log probability -log(r + 1) -
log(sum). Ties prefer the longer last piece.

Where no piece has a space mark after another character (checked on load), segmentations
of space-led words are independent, so each distinct word is segmented once a worker, in a cache of bounded size.

Defined results: null and empty texts give no ids; text after decoding equals the input but
for U+2581, which the format writes for a space; rows are coded one by one, so ties, repeats
and other columns do not matter; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
import struct
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilestrata.llm.workers import keep, lean

MARK = "▁"
#: Kinds of pieces in a model file (fixed values of its format).
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM = 1
#: Distinct words kept by a worker.
CACHE_WORDS = 300_000


def _varint(data: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        b = data[at]
        at += 1
        out |= (b & 127) << shift
        if b < 128:
            return out, at
        shift += 7


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a protocol-buffer message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            n, at = _varint(data, at)
            value, at = data[at : at + n], at + n
        else:
            n = 8 if kind == 1 else 4
            value, at = data[at : at + n], at + n
        yield key >> 3, value


class Vocabulary:
    """Pieces, kinds and scores of a model file."""

    def __init__(self, model: bytes) -> None:
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        scores: list[float] = []
        kind_of_model, self.dummy_prefix, squeeze, normaliser = UNIGRAM, True, True, b""
        for number, value in _fields(model):
            if number == 1:
                f = dict(_fields(value))
                self.pieces.append(f[1].decode())
                scores.append(struct.unpack("<f", f[2])[0] if 2 in f else 0.0)
                self.kinds.append(f.get(3, NORMAL))
            elif number == 2:
                kind_of_model = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                f = dict(_fields(value))
                normaliser, self.dummy_prefix, squeeze = f.get(2, b""), bool(f.get(3, 1)), bool(f.get(4, 1))
        if normaliser or squeeze:
            raise ValueError("only models without text normalisation are supported")
        if kind_of_model != UNIGRAM:
            total = math.log(sum(1 / r for r in range(1, len(scores) + 1)))
            scores = [-math.log(r) - total for r in range(1, len(scores) + 1)]
        self.scores = scores
        self.usable = [i for i, k in enumerate(self.kinds) if k in (NORMAL, USER)]
        self.bytes = {int(p[1:-1], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == BYTE}
        self.unknown = self.kinds.index(UNKNOWN)
        self.by_word = not any(MARK in self.pieces[i].lstrip(MARK) for i in self.usable)


class Codec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, model: bytes) -> None:
        v = self.vocabulary = Vocabulary(model)
        self.automaton = ahocorasick.Automaton()
        for i in v.usable:
            self.automaton.add_word(v.pieces[i], (i, len(v.pieces[i]), v.scores[i]))
        self.automaton.make_automaton()
        self.single = {v.pieces[i] for i in v.usable if len(v.pieces[i]) == 1}
        self.unknown_score = min(v.scores[i] for i in v.usable) - 10.0
        self.raw = [p.replace(MARK, " ").encode() for p in v.pieces]
        for i, k in enumerate(v.kinds):
            if k == BYTE:
                self.raw[i] = bytes([int(v.pieces[i][1:-1], 16)])
            elif k not in (NORMAL, USER):
                self.raw[i] = " ⁇ ".encode() if k == UNKNOWN else b""
        self.cache: dict[str, bytes] = {}
        self.words = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")

    def viterbi(self, text: str) -> list[int]:
        """Ids of the best segmentation of text (spaces as marks)."""
        n = len(text)
        best, length, piece = [0.0] + [-math.inf] * n, [0] * (n + 1), [-1] * (n + 1)
        holes = [i for i, c in enumerate(text) if c not in self.single]
        hole = 0
        for end, (i, k, score) in self.automaton.iter(text):
            while hole < len(holes) and holes[hole] < end:  # reached before any later piece starts
                self._leap(best, length, piece, holes[hole])
                hole += 1
            s = best[end + 1 - k] + score
            if s > best[end + 1] or (s == best[end + 1] and k > length[end + 1]):
                best[end + 1], length[end + 1], piece[end + 1] = s, k, i
        for at in holes[hole:]:
            self._leap(best, length, piece, at)
        out, at = [], n
        while at > 0:
            if piece[at] >= 0:
                out.append(piece[at])
            else:
                out.extend(self._spelled(text[at - 1])[::-1])
            at -= length[at]
        return out[::-1]

    def _leap(self, best: list, length: list, piece: list, at: int) -> None:
        s = best[at] + self.unknown_score
        if s > best[at + 1]:
            best[at + 1], length[at + 1], piece[at + 1] = s, 1, -1

    def _spelled(self, char: str) -> list[int]:
        v = self.vocabulary
        return [v.bytes[b] for b in char.encode("utf-8", "surrogatepass")] if v.bytes else [v.unknown]

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        text = (" " if self.vocabulary.dummy_prefix else "") + text
        text = text.replace(" ", MARK)
        if not self.vocabulary.by_word:
            return np.array(self.viterbi(text), np.int32)
        cache, parts = self.cache, []
        for w in self.words.findall(text):
            got = cache.get(w)
            if got is None:
                if len(cache) >= CACHE_WORDS:
                    cache.clear()
                got = cache[w] = np.array(self.viterbi(w), np.int32).tobytes()
            parts.append(got)
        return np.frombuffer(b"".join(parts), np.int32)

    def decode(self, ids) -> str:
        raw = self.raw
        text = b"".join([raw[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if self.vocabulary.dummy_prefix and text[:1] == " " else text


def codec(model: bytes) -> Codec:
    """Built once in each Python worker."""
    return keep(("pieces", len(model), hash(model)), lambda: Codec(model))


def read_model(path: str) -> bytes:
    """The model file, read by the driver; it is sent to the workers."""
    with open(path, "rb") as f:
        return f.read()


def encode(df: DataFrame, model: bytes, text_col: str = "text", columns: list[Column] | None = None) -> DataFrame:
    """columns of df (all by default) with token_ids, n_tokens and round_trip (whether decoding gives the text again)."""
    shown = columns if columns is not None else [F.col(f"`{c}`") for c in df.columns if c not in ("token_ids", "n_tokens", "round_trip")]
    shown = df.select(F.struct(*shown).alias("row"), F.col(text_col).cast("string").alias("text"))
    send = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(send.value)
        for big in batches:
            for lo in range(0, big.num_rows, 1000):
                b = big.slice(lo, 1000)
                ids, same = [], []
                for t in b.column(b.num_columns - 1).to_pylist():
                    ids.append(c.encode(t))
                    same.append(c.decode(ids[-1].tolist()) == (t or "").replace(MARK, " "))
                sizes = np.array([len(x) for x in ids], np.int32)
                at = np.concatenate((np.zeros(1, np.int32), np.cumsum(sizes, dtype=np.int32)))
                flat = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(ids)))
                cols = [b.column(i) for i in range(b.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*cols, flat, pa.array(sizes), pa.array(same)], names=[*b.schema.names[:-1], "token_ids", "n_tokens", "round_trip"])

    schema = shown.drop("text").schema.add("token_ids", T.ArrayType(T.IntegerType())).add("n_tokens", "integer").add("round_trip", "boolean")
    return shown.mapInArrow(lean(run, keeps=True), schema).select("row.*", "token_ids", "n_tokens", "round_trip")


def decode(df: DataFrame, model: bytes, ids_col: str = "token_ids", name: str = "decoded") -> DataFrame:
    """df with the text of ids_col; null ids give null."""
    shown = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns if c != name]).alias("row"), F.col(ids_col).cast("array<int>").alias("ids"))
    send = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(send.value)
        for b in batches:
            texts = [None if x is None else c.decode(x) for x in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(b.num_columns - 1)], pa.array(texts, pa.string())], names=[*b.schema.names[:-1], name])

    return shown.mapInArrow(lean(run, keeps=True), shown.drop("ids").schema.add(name, "string")).select("row.*", f"`{name}`")
