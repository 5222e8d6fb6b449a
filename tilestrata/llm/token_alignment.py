"""Alignment of two tokenizers' outputs by a sweep over their end events.

1. Every text is encoded by both tokenizers. A token is an event at the byte offset where it ends; events of one side travel
   in runs of up to RUN consecutive ones, as ids with the offset where the run starts (sizes of tokens come from the two
   vocabularies' size tables), under the text's key.
2. The union of both sides' runs is repartitioned by text and sorted by offset in its partition.
3. A machine reads the stream. It holds what follows the last offset where both sides ended (a group that is still open, and
   one run) and the counters of the text; whatever ends before is turned into groups and links and forgotten. Between two
   successive events there is one link, from the token of A to the token of B that cover these bytes.
4. Links are kept per block of texts, by id pair: how many texts hold the pair, which ones and how often. The number of
   texts for each pair is summed over all blocks. Up to MOST_PAIRS pairs (counted first) the sums are sent to all tasks;
   beyond, they are joined to the blocks' pairs by shuffle and meet the blocks again by their keys.

Pieces between spaces are encoded once a worker, in a cache of bounded size: both tokenizers start a token at a space that
follows a non-space (checked for the piece model when it is loaded).

Defined results: null and empty texts, and texts that one of the tokenizers doesn't give back byte for byte, have no tokens:
zero counts and an empty digest; rows are aligned one by one, so null and repeated ids and repeated texts don't matter, and
each row counts as a document; an empty table gives an empty table; input columns keep their names and values (they travel
as one struct), but for the result columns, which replace columns of the same name.
"""

from __future__ import annotations

import hashlib
import itertools
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from tilestrata.llm import byte_bpe
from tilestrata.llm.sentencepiece_codec import MARK, Vocabulary
from tilestrata.llm.storage import cut

#: Events of a run, and events that the machine turns into groups at once.
RUN, AT_ONCE = 4096, 1 << 19
#: Pairs whose counts are sent to all tasks (17 bytes each); more are joined by shuffle.
MOST_PAIRS = 1 << 22
#: Bytes of pieces and ids that a worker keeps.
CACHE_BYTES = 1 << 26
#: Texts of one block.
BLOCK_BITS = 16
RESULTS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

_loaded: dict[int, "Pair"] = {}


class ByteBPE:
    """A tokenizer file of byte-level BPE, without its special tokens.

    The file lists merges, the encoder takes ranks of tokens. Both agree on all texts if every token, merged from its bytes by the
    file's list, gives itself: tokens that stay side by side in some text do so where they stand alone, so no two of them
    spell a third. The driver checks that (confirm), and that merges are in the order of ids and each byte has a token.
    """

    def __init__(self, data: bytes) -> None:
        self.data, spec = data, json.loads(data)
        self.merges = [x if isinstance(x, list) else x.split(" ") for x in spec["model"]["merges"]]
        pre = spec["pre_tokenizer"] or {}
        if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec["normalizer"]:
            raise ValueError("only byte-level files that split by the pattern and change nothing are supported")
        # printable stand-ins of bytes in the file: bytes that print stand for themselves, others for 256, 257, ...
        prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = [b for b in range(256) if b not in prints]
        byte = {chr(b): b for b in prints} | {chr(256 + k): b for k, b in enumerate(others)}
        self.ids = spec["model"]["vocab"]
        self.raw = [b""] * (max(self.ids.values(), default=-1) + 1)
        for token, i in self.ids.items():
            self.raw[i] = bytes(byte[c] for c in token)
        ranks = {x: i for i, x in enumerate(self.raw) if x}
        self.sizes = np.fromiter(map(len, self.raw), np.int64, len(self.raw))
        self.one = tiktoken.Encoding("file", pat_str=byte_bpe.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def confirm(self) -> None:
        model = Tokenizer.from_str(self.data.decode()).model
        order = [self.ids[x + y] for x, y in self.merges]
        if order != sorted(order) or {x for x in self.raw if len(x) == 1} != {bytes([b]) for b in range(256)}:
            raise ValueError("merges must be in the order of their ids, and every byte must have one")
        if any([t.id for t in model.tokenize(token)] != [i] for token, i in self.ids.items()):
            raise ValueError("a token's merges don't give the token")

    def encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces, number of ids of each).

        Pieces that end with another character than a space are encoded as one text: a token ends at the space that leads the next.
        """
        joined = [k for k, p in enumerate(pieces) if p and not p[-1].isspace()]
        ids = np.array(self.one("".join([" " + pieces[k] for k in joined])), np.int32)
        ends = np.cumsum(self.sizes[ids])
        wanted = np.cumsum(np.fromiter((1 + len(pieces[k].encode()) for k in joined), np.int64, len(joined)))
        upto = np.searchsorted(ends, wanted, side="right")
        if len(joined) and not np.array_equal(ends[upto - 1], wanted):
            raise ValueError("a token crosses a space that leads a piece")
        n = np.zeros(len(pieces), np.int64)
        n[joined] = np.diff(np.concatenate(([0], upto)))
        if len(joined) < len(pieces):
            parts = dict(zip(joined, np.split(ids, upto[:-1]), strict=False))
            for k, p in enumerate(pieces):
                if k not in parts:
                    parts[k] = np.array(self.one(" " + p), np.int32)
                    n[k] = len(parts[k])
            ids = np.concatenate([parts[k] for k in range(len(pieces))])
        return ids, n


class PieceBPE:
    """A piece model, which adds the space itself."""

    def __init__(self, data: bytes) -> None:
        self.model = sentencepiece.SentencePieceProcessor(model_proto=data)
        v = Vocabulary(data)
        if not (v.by_word and v.dummy_prefix):
            raise ValueError("pieces must not continue after a space, and the model must add one in front")
        self.raw = [p.replace(MARK, " ").encode() for p in v.pieces]
        for b, i in v.bytes.items():
            self.raw[i] = bytes([b])
        self.space = self.model.piece_to_id(MARK)
        self.sizes = np.fromiter(map(len, self.raw), np.int64, len(self.raw))

    def encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces, number of ids of each)."""
        got = [x or [self.space] for x in self.model.encode(pieces, num_threads=1)]
        n = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter(itertools.chain.from_iterable(got), np.int32, int(n.sum())), n

    def differing(self, pieces: list[str], ids: np.ndarray, n: np.ndarray) -> np.ndarray:
        """For each piece, whether its ids don't give it and the space in front back."""
        size = np.fromiter((1 + len(p.encode()) for p in pieces), np.int64, len(pieces))
        until = np.concatenate(([0], np.cumsum(n)))
        given = np.diff(np.concatenate(([0], np.cumsum(self.sizes[ids])))[until])
        ids = ids.tolist()
        if np.array_equal(given, size) and b"".join(map(self.raw.__getitem__, ids)) == "".join([" " + p for p in pieces]).encode():
            return np.zeros(len(pieces), bool)
        at = until.tolist()
        return np.array([b"".join([self.raw[i] for i in ids[x:y]]) != b" " + p.encode() for p, (x, y) in zip(pieces, itertools.pairwise(at), strict=True)])


class _New(dict):
    """Place of each piece, in order of first sight; pieces not met before are also in `new`."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        self[piece] = at = len(self)
        self.new.append(piece)
        return at


class Pair:
    """Both tokenizers, with a cache of pieces: the ids of all in one array a side, found by a piece's place."""

    def __init__(self, a: bytes, b: bytes) -> None:
        self.sides = ByteBPE(a), PieceBPE(b)
        self.forget()

    def forget(self) -> None:
        self.places = _New()
        self.ids = [np.zeros(0, np.int32), np.zeros(0, np.int32)]
        self.ends = [np.zeros(1, np.int64), np.zeros(1, np.int64)]
        self.differs = np.zeros(0, bool)
        self.size = 0

    def sizes(self) -> list[np.ndarray]:
        return [s.sizes for s in self.sides]

    def encode(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of both sides for each text; none where a side doesn't give the text back."""
        if self.size > CACHE_BYTES:
            self.forget()
        parts = [byte_bpe.pieces(" " + t) if t else [] for t in texts]
        for p in parts:  # a text of its own starts with an empty piece, or else with a piece that keeps its space
            if p:
                p[0] = p[0][1:]
                if len(p) > 1 and not p[0]:
                    del p[0]
        words = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)
        where = np.fromiter(map(self.places.__getitem__, itertools.chain.from_iterable(parts)), np.int64, int(words[-1]))
        self._learn()
        bad = np.concatenate(([0], np.cumsum(self.differs[where])))[words]
        flat, bounds = [], []
        for ids, ends in zip(self.ids, self.ends, strict=True):
            n = ends[where + 1] - ends[where]
            until = np.concatenate(([0], np.cumsum(n)))
            flat.append(ids[np.repeat(ends[where] - until[:-1], n) + np.arange(until[-1])])
            bounds.append(until[words].tolist())
        none = np.zeros(0, np.int32)
        for k in range(len(parts)):
            yield (none, none) if bad[k + 1] > bad[k] else tuple(f[b[k] : b[k + 1]] for f, b in zip(flat, bounds, strict=True))

    def _learn(self) -> None:
        """Encodes the pieces that are new."""
        new = self.places.new
        if not new:
            return
        got = [s.encode(new) for s in self.sides]
        self.differs = np.concatenate((self.differs, self.sides[1].differing(new, *got[1])))  # A has every byte and gives all back
        for k, (ids, n) in enumerate(got):
            self.ids[k] = np.concatenate((self.ids[k], ids))
            self.ends[k] = np.concatenate((self.ends[k], self.ends[k][-1] + np.cumsum(n)))
        self.size += 200 * len(new) + sum(map(len, new)) + 4 * sum(len(ids) for ids, _ in got)
        new.clear()


def pair(a: bytes, b: bytes) -> Pair:
    """Built once in each Python worker."""
    key = hash((a, b))
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Pair(a, b)
    return _loaded[key]


def read_file(path: str) -> bytes:
    """A tokenizer's file, read by the driver; it is sent to the workers."""
    with open(path, "rb") as f:
        return f.read()


def _pack(values: np.ndarray, kind: str) -> bytes:
    return zstandard.compress(values.astype(kind).tobytes(), 3)


def _unpack(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), kind)


def end_events(df: DataFrame, send) -> DataFrame:
    """(key, at, side, ids, row): runs of end events of both sides (1 and 2), and a head (0) for each row of df (row, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pair(*send.value)
        sizes, base, n = both.sizes(), TaskContext.get().partitionId() << 40, 0
        for big in batches:
            for lo in range(0, big.num_rows, 200):
                b = big.slice(lo, 200)
                key, at, side, ids = list(range(base + n, base + n + b.num_rows)), [-1] * b.num_rows, [0] * b.num_rows, [None] * b.num_rows
                for k, sides in enumerate(both.encode(b.column(1).to_pylist()), base + n):
                    for s, x in enumerate(sides):
                        starts = np.cumsum(sizes[s][x]) - sizes[s][x] if len(x) > RUN else [0]
                        for first in range(0, len(x), RUN):
                            key.append(k)
                            at.append(int(starts[first]))
                            side.append(s + 1)
                            ids.append(_pack(x[first : first + RUN], "<u4" if len(sizes[s]) > 1 << 16 else "<u2"))
                n += b.num_rows
                row = b.column(0).take(pa.array([*range(b.num_rows), *[None] * (len(key) - b.num_rows)], pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(at, pa.int64()), pa.array(side, pa.int8()), pa.array(ids, pa.binary()), row], names=["key", "at", "side", "ids", "row"])

    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("at", T.LongType()), T.StructField("side", T.ByteType()), T.StructField("ids", T.BinaryType()), T.StructField("row", df.schema["row"].dataType)])
    return df.mapInArrow(run, schema)


class Digits:
    """Decimal numbers followed by a separator, as padded bytes: ',', or '|' or ';' where a side of a group ends."""

    def __init__(self, most: int) -> None:
        text = np.char.add(np.array([str(i) for i in range(most)])[None, :], np.array([",", "|", ";"])[:, None]).astype(np.bytes_).ravel()
        self.most, self.bytes = most, text.view(np.uint8).reshape(len(text), -1)
        self.length = np.char.str_len(text).astype(np.int64)


def groups_and_links(a: np.ndarray, b: np.ndarray, sizes: list[np.ndarray], digits: Digits, ends: np.ndarray):
    """Whole groups of consecutive texts (or parts of texts) that end at bytes `ends`.

    For each text the numbers of A, B, groups and links and the groups' characters (each group closed by ';'); and for all
    links in order their text and id pair.
    """
    end_a, end_b = np.cumsum(sizes[0][a]), np.cumsum(sizes[1][b])
    flags = np.zeros(int(ends[-1]) + 1, np.uint8)
    flags[end_a] = 1
    flags[end_b] += 2
    at = np.flatnonzero(flags)
    in_a, in_b = (flags[at] & 1).astype(np.int64), (flags[at] >> 1).astype(np.int64)
    both = in_a & in_b
    before_a, before_b, group = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b, np.cumsum(both) - both
    upto = np.searchsorted(at, ends, side="right")
    count = np.diff(np.concatenate((np.zeros((1, 4), np.int64), np.stack([np.cumsum(x)[upto - 1] for x in (in_a, in_b, both)] + [upto], axis=1))), axis=0)
    pairs = a[before_a].astype(np.int64) * len(sizes[1]) + b[before_b]
    text = np.repeat(np.arange(len(ends)), count[:, 3])
    # characters: a group's A ids, then its B ids
    is_a, is_b = in_a == 1, in_b == 1
    of_a, of_b = group[is_a], group[is_b]
    n_b = np.bincount(of_b)
    place_a = np.arange(len(a)) + (np.cumsum(n_b) - n_b)[of_a]
    place_b = np.arange(len(b)) + np.cumsum(np.bincount(of_a))[of_b]
    order = np.empty(len(a) + len(b), np.int64)
    order[place_a] = a + digits.most * both[is_a]
    order[place_b] = b + 2 * digits.most * both[is_b]
    chars = digits.bytes[order].ravel()
    chars = chars[chars != 0].tobytes()
    until = np.concatenate((np.zeros(1, np.int64), np.cumsum(digits.length[order])[np.cumsum(count[:, 0] + count[:, 1]) - 1]))
    return count, [chars[x:y] for x, y in itertools.pairwise(until.tolist())], text, pairs


class _Sweep:
    """The machine: texts come in order of their keys, runs of a text in order of offset."""

    def __init__(self, sizes: list[np.ndarray]) -> None:
        self.sizes, self.digits = sizes, Digits(max(map(len, sizes)))
        self.texts: list[list] = []  # of the block: counts, digest
        self.links: list[tuple[np.ndarray, np.ndarray]] = []
        self.ready: list[tuple[int, np.ndarray, np.ndarray]] = []  # text, ids of whole groups
        self.n_ready, self.key, self.first = 0, None, None
        self.open, self.n_open, self.patience = ([], []), 0, AT_ONCE

    def head(self, key: int) -> None:
        self.end_text()
        self.key = key
        if not self.texts:
            self.first = key
        self.texts.append([np.zeros(4, np.int64), None])

    def run(self, side: int, ids: np.ndarray) -> None:
        self.open[side].append(ids)
        self.n_open += len(ids)
        if self.n_open >= self.patience:
            self.close_groups()

    def close_groups(self) -> None:
        """Hands over the groups that are complete; the rest of the text stays open."""
        ids = [np.concatenate(x) if x else np.zeros(0, np.int32) for x in self.open]
        ends = [np.cumsum(s[x]) for s, x in zip(self.sizes, ids, strict=True)]
        shared = np.intersect1d(*ends, assume_unique=True)
        if len(shared):
            cuts = [int(np.searchsorted(e, shared[-1], side="right")) for e in ends]
            self.hand_over(ids[0][: cuts[0]], ids[1][: cuts[1]])
            ids = [x[c:] for x, c in zip(ids, cuts, strict=True)]
        self.open, self.n_open = tuple([x] for x in ids), sum(map(len, ids))
        self.patience = max(AT_ONCE, 2 * self.n_open)

    def hand_over(self, a: np.ndarray, b: np.ndarray) -> None:
        if len(a):
            self.ready.append((len(self.texts) - 1, a, b))
            self.n_ready += len(a) + len(b)
            if self.n_ready >= AT_ONCE:
                self.work()

    def end_text(self) -> None:
        if self.n_open:
            self.hand_over(*(np.concatenate(x) if x else np.zeros(0, np.int32) for x in self.open))
        self.open, self.n_open, self.patience = ([], []), 0, AT_ONCE

    def work(self) -> None:
        if not self.ready:
            return
        which = np.array([t for t, _, _ in self.ready])
        ends = np.cumsum([int(self.sizes[0][a].sum()) for _, a, _ in self.ready])
        count, chars, text, pairs = groups_and_links(np.concatenate([a for _, a, _ in self.ready]), np.concatenate([b for _, _, b in self.ready]), self.sizes, self.digits, ends)
        for t, c, s in zip(which.tolist(), count, chars, strict=True):
            state = self.texts[t]
            state[0] = state[0] + c
            if state[1] is None:
                state[1] = hashlib.sha256(s[:-1])
            else:
                state[1].update(b";" + s[:-1])
        self.links.append(np.unique((pairs << BLOCK_BITS) | which[text], return_counts=True))
        self.ready, self.n_ready = [], 0

    def full(self) -> bool:
        return sum(len(u) for u, _ in self.links) >= AT_ONCE or len(self.texts) >= 1 << BLOCK_BITS

    def block(self) -> tuple[int, list[list], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first key, texts, pairs, texts for each pair, their places, their links) of all texts up to here; the machine is then empty."""
        self.end_text()
        self.work()
        u, c = (np.concatenate(x) for x in zip(*self.links, strict=True)) if self.links else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        if len(self.links) > 1:
            order = np.argsort(u, kind="stable")
            u, c = u[order], c[order]
            new = np.flatnonzero(np.concatenate(([True], u[1:] != u[:-1])))
            u, c = u[new], np.add.reduceat(c, new)
        of, first = np.unique(u >> BLOCK_BITS, return_index=True)
        out = self.first, self.texts, of, np.diff(np.append(first, len(u))), u & ((1 << BLOCK_BITS) - 1), c
        self.texts, self.links, self.key = [], [], None
        return out


def _results(row: T.StructField) -> T.StructType:
    counts = [T.StructField(c, T.LongType()) for c in RESULTS[:4]]
    return T.StructType([row, *counts, T.StructField("groups_sha256", T.StringType())])


def sweep(events: DataFrame, sizes: list[np.ndarray]) -> DataFrame:
    """Blocks of texts: (block, texts, pairs, n, places, times), the last four packed."""
    send = events.sparkSession.sparkContext.broadcast(sizes)
    texts = _results(events.schema["row"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, heads = _Sweep(send.value), []

        def done() -> pa.RecordBatch:
            key, states, *links = machine.block()
            rows = pa.concat_arrays(heads)
            heads[:] = [rows.slice(len(states))]
            counts = np.array([s[0] for s in states], np.int64).reshape(-1, 4)
            digests = pa.array([s[1].hexdigest() if s[1] else "" for s in states], pa.string())
            flat = pa.StructArray.from_arrays([rows.slice(0, len(states)), *(pa.array(counts[:, k]) for k in range(4)), digests], names=[f.name for f in texts])
            packed = [pa.array([_pack(x, k)], pa.binary()) for x, k in zip(links, ("<i8", "<u4", "<u2", "<u4"), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(states)], pa.int32()), flat), *packed], names=["block", "texts", "pairs", "n", "places", "times"])

        for b in batches:
            side = b.column("side").to_numpy()
            heads.append(b.column("row").filter(pa.array(side == 0)))
            for key, s, ids in zip(b.column("key").to_pylist(), side.tolist(), b.column("ids").to_pylist(), strict=True):
                if s:
                    machine.run(s - 1, _unpack(ids, "<u4" if len(send.value[s - 1]) > 1 << 16 else "<u2").astype(np.int32))
                    continue
                if machine.full():
                    yield done()
                machine.head(key)
        if machine.texts:
            yield done()

    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("texts", T.ArrayType(texts)), *(T.StructField(c, T.BinaryType()) for c in ("pairs", "n", "places", "times"))])
    return events.repartition("key").sortWithinPartitions("key", "at", "side").mapInArrow(run, schema)


def _block_pairs(blocks: DataFrame) -> DataFrame:
    """(block, pair, n) of all blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, pairs, n in zip(*(b.column(k).to_pylist() for k in ("block", "pairs", "n")), strict=True):
                pairs, n = _unpack(pairs, "<i8"), _unpack(n, "<u4").astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), key)), pa.array(pairs), pa.array(n)], names=["block", "pair", "n"])

    return blocks.select("block", "pairs", "n").mapInArrow(run, "block long, pair long, n long")


def pair_counts(blocks: DataFrame, n_ids_b: int) -> DataFrame:
    """(pair, n, best): texts that hold each linked id pair (a * n_ids_b + b), and whether no other pair of its A id has more. An A id has n_ids_b pairs at most."""
    counts = _block_pairs(blocks).groupBy("pair").agg(F.sum("n").alias("n"))
    of_a = Window.partitionBy(F.floor(F.col("pair") / n_ids_b))
    return counts.select("pair", "n", (F.col("n") == F.max("n").over(of_a)).alias("best"))


def _weighed(b: pa.RecordBatch | pa.Table, weigh: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Result rows of blocks; weigh: pairs -> their counts and whether they are best."""
    for texts, *packed in zip(b.column("texts"), *(b.column(k).to_pylist() for k in ("pairs", "n", "places", "times")), strict=True):
        pairs, n, places, times = (_unpack(x, k) for x, k in zip(packed, ("<i8", "<u4", "<u2", "<u4"), strict=True))
        count, best = weigh(pairs)
        flat, times = texts.values, times.astype(np.int64)
        sums = np.zeros((2, len(flat)), np.int64)
        np.add.at(sums[0], places, np.repeat(best.astype(np.int64), n) * times)
        np.add.at(sums[1], places, np.repeat(count, n) * times)
        fields = {f.name: x for f, x in zip(flat.type, flat.flatten(), strict=True)} | {"n_best": pa.array(sums[0]), "count_sum": pa.array(sums[1])}
        yield pa.RecordBatch.from_arrays([fields[k] for k in ("row", *RESULTS)], names=["row", *RESULTS])


def weighed(blocks: DataFrame, n_ids_b: int, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """One row per text with n_best and count_sum from the pair counts of all blocks."""
    counts = cut(pair_counts(blocks, n_ids_b), "pair-counts")
    row = blocks.schema["texts"].dataType.elementType["row"]
    kinds = {"groups_sha256": T.StringType()}
    schema = T.StructType([row, *(T.StructField(c, kinds.get(c, T.LongType())) for c in RESULTS)])
    if counts.count() <= most_pairs:
        got = counts.toArrow().sort_by("pair")
        send = blocks.sparkSession.sparkContext.broadcast(tuple(got.column(k).to_numpy() for k in ("pair", "n", "best")))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys, n, best = send.value

            def weigh(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                at = np.searchsorted(keys, pairs)
                return n[at], best[at]

            for b in batches:
                yield from _weighed(b, weigh)

        return blocks.mapInArrow(run, schema)
    known = _block_pairs(blocks).select("block", "pair").join(counts, "pair")

    def meet(block: pa.Table, found: pa.Table) -> pa.Table:
        found = found.sort_by("pair")  # as the block's pairs are
        n, best = (found.column(k).to_numpy() for k in ("n", "best"))
        return pa.Table.from_batches(_weighed(block, lambda pairs: (n, best)))

    return blocks.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(meet, schema)


def align(df: DataFrame, a: bytes, b: bytes, text_col: str = "text", columns: list[Column] | None = None, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """columns of df (all by default) with RESULTS. a: a byte-level BPE's tokenizer file, b: a piece model that adds a space in front; A encodes a space and the text."""
    shown = columns if columns is not None else [F.col(f"`{c}`") for c in df.columns if c not in RESULTS]
    texts = df.select(F.struct(*shown).alias("row"), F.col(text_col).cast("string").alias("text"))
    tokenizers = Pair(a, b)
    tokenizers.sides[0].confirm()
    sizes = tokenizers.sizes()
    blocks = cut(sweep(end_events(texts, df.sparkSession.sparkContext.broadcast((a, b))), sizes), "aligned-blocks")
    return weighed(blocks, len(sizes[1]), most_pairs).select("row.*", *RESULTS)
