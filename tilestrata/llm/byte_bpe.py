"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

1. Every task explodes its texts into pre-tokens with positions. Consecutive texts form a block of bounded size; a block
   has a list of its distinct words, frequent ones first, and a text's pre-tokens are places in that list (packed, compressed).
2. The words of all blocks are shuffled by word and sorted, so that equal words of all blocks follow each other and each
   distinct word is merged once, whatever its frequency; its ids go back to (block, place in the list), as many to a row as
   the task has of a block among 2 ** 18 words.
3. Ids and texts of a block meet by block, ids first; each text is put together by position while the block streams by.

A word is at most once in a block, so one that every text has is spread thinly: of a block's words it is a single row.
Blocks are cut by size, so no key of the last shuffle is larger than a block and a slice of texts (or one single text).

The texts are read once for the words and once for the positions. Both must see the same rows in the same order, as a scan
of files does; a block's key is a hash of its words and place, so a difference is an error, never a wrong result. With
cut_first the input is written to the shared folder before, for inputs that come from a shuffle.

Pre-tokens are those of the pattern; spaces after a non-space always start one, so texts are cut there, and the distinct
pieces of a slice of texts are split together, once. Merging a single word is left to the tiktoken library.

Defined results: null and empty texts have no ids; special tokens don't exist, their strings are plain text; rows are coded
one by one, so ties, repeats and null ids don't matter; an empty table gives an empty table; input columns keep their names
and values (they travel as one struct), but for the result columns, which replace columns of the same name. Decoding gives
bytes; null ids give null, an id beyond the vocabulary is an error.
"""

from __future__ import annotations

import base64
import itertools
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilestrata.llm.storage import cut
from tilestrata.llm.workers import lean

#: The pattern of byte-level vocabularies, which splits text before the merges (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A block ends with the slice of texts that reaches one of these: distinct words, characters.
BLOCK_WORDS, BLOCK_CHARS = 1 << 19, 1 << 25
#: Pieces between spaces that are split together, and words whose ids are sorted by block at once.
KEPT_PIECES, AT_ONCE = 1 << 19, 1 << 18
#: Ids of a batch of results.
BATCH_IDS = 1 << 20

_after_space = re.compile(r"\s ")
_breaks = re.compile(r"(?<=\S)(?= )")
_spaces = [x for x in map(chr, range(0x3001)) if x.isspace()]  # U+3000 is the last one
_encoders: dict[int, tuple[bytes, "Encoder"]] = {}


def read_ranks(path: str) -> bytes:
    """The rank file, read by the driver; it is sent to the workers."""
    with open(path, "rb") as f:
        return f.read()


def token_bytes(ranks: bytes) -> list[bytes]:
    """The token-byte table: bytes by id; ids that the file lacks have none."""
    pairs = [(base64.b64decode(a), int(b)) for a, b in map(bytes.split, ranks.splitlines())]
    out = [b""] * (max((i for _, i in pairs), default=-1) + 1)
    for token, i in pairs:
        out[i] = token
    return out


class Encoder:
    """Merges of single words."""

    def __init__(self, ranks: bytes) -> None:
        table = {t: i for i, t in enumerate(token_bytes(ranks)) if t}
        self.word = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=table, special_tokens={})._encode_single_piece


def encoder(ranks: bytes) -> Encoder:
    """Built once in each Python worker."""
    key = len(ranks), xxhash.xxh64_intdigest(ranks)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(ranks)
    return _encoders[key]


def pieces(text: str) -> list[str]:
    """text cut before spaces that follow a non-space; all but the first have lost the space that leads them."""
    if not _after_space.search(text):
        return text.split(" ")
    first, *rest = _breaks.split(text)
    return [first, *(x[1:] for x in rest)]


def pack(places: np.ndarray) -> bytes:
    """Small integers, compressed by byte planes."""
    return zstandard.compress(np.ascontiguousarray(places.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 3)


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(pieces of all texts, where each text's begin, and their number): texts are cut before spaces that follow a non-space, as by pieces(), but keep the space."""
    texts = texts.cast(pa.string()).fill_null("")
    _, offsets, data = texts.buffers()
    tops = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    data = (data or pa.py_buffer(b"")).slice(int(tops[0]), int(tops[-1] - tops[0]))
    seen, tops = np.frombuffer(data, np.uint8), tops - tops[0]
    space = np.flatnonzero(seen == ord(" "))
    before = [seen[np.maximum(space - k, 0)].astype(np.int32) for k in (1, 2, 3)]
    tails = before[0], before[0] + (before[1] << 8), before[0] + (before[1] << 8) + (before[2] << 16)  # the last bytes before each space, as numbers
    after = np.zeros(len(space), bool)
    for size, tail in enumerate(tails, 1):
        after |= np.isin(tail, [int.from_bytes(x.encode()) for x in _spaces if len(x.encode()) == size])
    begins = np.zeros(len(seen) + 1, bool)
    begins[space[~after]] = begins[tops] = True
    cuts = np.append(np.flatnonzero(begins[:-1]), len(seen)).astype(np.int32)
    return pa.StringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts), data), np.searchsorted(cuts, tops)


class _Block:
    """Words and texts of one block under construction."""

    def __init__(self, pattern: regex.Pattern) -> None:
        self.find, self.words, self.texts, self.size = pattern.findall, pa.array([], pa.large_string()), [], 0

    def _found(self, led: pa.Array, others: list[str]) -> tuple[pa.Array, np.ndarray]:
        """(words, their number in each piece).

        led begin with a space and end with none, so that they are split as one text, which has words' ends where theirs are; otherwise each is split by itself.
        """
        text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(led)], pa.int32()), led), "")[0].as_py()
        words = pa.array(self.find(text), pa.large_string())
        ends = np.concatenate((np.zeros(1, np.int64), np.cumsum(pc.utf8_length(words).to_numpy())))
        want = np.cumsum(pc.utf8_length(led).to_numpy(), dtype=np.int64)
        last = np.searchsorted(ends, want)
        if text and (last[-1] == len(ends) or not np.array_equal(ends[last], want)):  # the pattern leaves out characters, or has words over spaces
            return self._found(led[:0], led.to_pylist() + others)
        alone = list(map(self.find, others))
        words = pa.concat_arrays([words, pa.array(list(itertools.chain.from_iterable(alone)), pa.large_string())])
        return words, np.concatenate((np.diff(last, prepend=0), np.fromiter(map(len, alone), np.int64, len(alone))))

    def add(self, texts: pa.Array) -> None:
        """More texts: each distinct piece is split once."""
        parts, tops = _cut(texts)
        coded = parts.dictionary_encode()
        code, known = coded.indices.to_numpy(), coded.dictionary
        plain = pc.and_not(pc.starts_with(known, " "), pc.is_in(pc.utf8_slice_codeunits(known, -1), pa.array(_spaces))).to_numpy(zero_copy_only=False)
        led, others = np.flatnonzero(plain), np.flatnonzero(~plain)
        words, counts = self._found(known.take(led), known.take(others).to_pylist())
        at = np.empty(len(known), np.int64)
        at[np.concatenate((led, others))] = np.arange(len(known))
        both = pa.concat_arrays([self.words, words]).dictionary_encode()
        place, self.words = both.indices.to_numpy()[len(self.words) :].astype(np.uint32), both.dictionary
        start, size = (np.cumsum(counts) - counts)[at][code], counts[at][code]
        stop = np.append(0, np.cumsum(size))
        flat = place[np.arange(stop[-1]) + np.repeat(start - stop[:-1], size)]
        self.texts += [flat[x:y].tobytes() for x, y in itertools.pairwise(stop[tops].tolist())]
        self.size += pc.sum(pc.utf8_length(texts)).as_py() or 0

    def full(self) -> bool:
        return len(self.words) >= BLOCK_WORDS or self.size >= BLOCK_CHARS

    def order(self) -> np.ndarray:
        """Place of each word in the list, by frequency (the first of equally frequent ones first)."""
        counts = np.zeros(len(self.words), np.int64)
        for t in self.texts:
            np.add.at(counts, np.frombuffer(t, np.uint32), 1)
        out = np.empty(len(counts), np.int32)
        out[np.argsort(-counts, kind="stable")] = np.arange(len(counts), dtype=np.int32)
        return out

    def key(self, part: int, number: int) -> int:
        h = xxhash.xxh64(f"{part} {number} {len(self.texts)} {sum(map(len, self.texts))} ".encode())
        for x in pa.concat_arrays([self.words]).buffers()[1:]:
            h.update(x or b"")
        return h.intdigest() - (1 << 63)


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Bounds of runs of at most KEPT_PIECES pieces and a quarter of a block's characters (in bytes), or of a single text."""
    parts = pc.count_substring(texts, " ").fill_null(0).to_numpy(zero_copy_only=False) + 1
    size = pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)
    cost = np.cumsum(np.maximum(parts / KEPT_PIECES, size / (BLOCK_CHARS / 4)))
    lo = 0
    while lo < len(cost):
        hi = max(lo + 1, int(np.searchsorted(cost, 1 + (cost[lo - 1] if lo else 0), "right")))
        yield lo, hi
        lo = hi


def _blocks(batches: Iterator[pa.RecordBatch], pattern: str, carry: bool) -> Iterator[tuple[int, _Block, list[pa.RecordBatch]]]:
    """(key, block, the rows of its texts) of a task's rows, whose last column is the text."""
    part, number = TaskContext.get().partitionId(), 0
    compiled = regex.compile(pattern)
    block, rows = _Block(compiled), []
    for b in batches:
        texts = b.column(b.num_columns - 1)
        for lo, hi in _slices(texts):
            block.add(texts.slice(lo, hi - lo))
            if carry:
                rows.append(b.slice(lo, hi - lo).select(range(b.num_columns - 1)))
            if block.full():
                yield block.key(part, number), block, rows
                block, rows, number = _Block(compiled), [], number + 1
    if block.texts:
        yield block.key(part, number), block, rows


def _words(df: DataFrame, pattern: str) -> DataFrame:
    """(word, block, at): the distinct words of every block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, block, _ in _blocks(batches, pattern, carry=False):
            words = block.words.cast(pa.large_binary())
            near = pc.sort_indices(words)  # neighbours that begin alike take less room
            place = block.order()[near.to_numpy()]
            for lo in range(0, len(near), 1 << 15):
                some = near[lo : lo + (1 << 15)]
                yield pa.RecordBatch.from_arrays([words.take(some).cast(pa.binary()), pa.array(np.full(len(some), key)), pa.array(place[lo : lo + (1 << 15)])], names=["word", "block", "at"])

    return df.select("text").mapInArrow(lean(run), "word binary, block long, at int")


def _by_block(block: np.ndarray, at: np.ndarray, ids: list[bytes]) -> pa.RecordBatch:
    """One row for each block: its words' places, numbers of ids and ids, packed."""
    order = np.lexsort((at, block))
    block, at, ids = block[order], at[order], [ids[i] for i in order.tolist()]
    size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
    cuts = [*np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1]))).tolist(), len(block)]
    rows = []
    for lo, hi in itertools.pairwise(cuts):
        step = np.diff(at[lo:hi], prepend=0)
        rows.append(pack(np.concatenate(([hi - lo], step, size[lo:hi], np.frombuffer(b"".join(ids[lo:hi]), np.int32)))))
    return pa.RecordBatch.from_arrays([pa.array(block[cuts[:-1]]), pa.array(np.full(len(rows), -1, np.int32)), pa.array(rows, pa.binary())], names=["block", "at", "ids"])


def _ids(words: DataFrame, send) -> DataFrame:
    """(block, -1, ids): words in sorted order; a run of equal words is merged once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merge, last, got = encoder(send.value).word, None, b""
        held, out = [], []
        for b in batches:
            for w in b.column("word").to_pylist():
                if w != last:
                    last, got = w, array("i", merge(w)).tobytes()
                out.append(got)
            held.append((b.column("block").to_numpy(), b.column("at").to_numpy()))
            if len(out) >= AT_ONCE:
                yield _by_block(*map(np.concatenate, zip(*held, strict=True)), out)
                held, out = [], []
        if out:
            yield _by_block(*map(np.concatenate, zip(*held, strict=True)), out)

    return words.repartition("word").sortWithinPartitions("word").select("block", "at", "word").mapInArrow(lean(run), "block long, at int, ids binary")


def _positions(df: DataFrame, pattern: str) -> DataFrame:
    """(block, at, ids, n_words, row): every text as packed places in its block's list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, block, rows in _blocks(batches, pattern, carry=True):
            at, n, order = 0, len(block.words), block.order()
            for b in rows:
                for lo in range(0, b.num_rows, 256):
                    part = b.slice(lo, 256)
                    k = part.num_rows
                    packed = pa.array([pack(order[np.frombuffer(t, np.uint32)]) if t else b"" for t in block.texts[at : at + k]], pa.binary())
                    place = np.arange(at, at + k, dtype=np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(k, key)), pa.array(place), packed, pa.array(np.full(k, n, np.int32)), part.column(0)], names=["block", "at", "ids", "n_words", "row"])
                    at += k

    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("at", T.IntegerType()), T.StructField("ids", T.BinaryType()), T.StructField("n_words", T.IntegerType()), df.schema["row"]])
    return df.select("row", "text").mapInArrow(lean(run), schema)


def _listed(packed: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids of a block's words one after another, where each word's start)."""
    at, size, ids = [], [], []
    for x in map(unpack, packed):
        k = int(x[0])
        at.append(np.cumsum(x[1 : k + 1], dtype=np.int64))
        size.append(x[k + 1 : 2 * k + 1].astype(np.int64))
        ids.append(x[2 * k + 1 :].astype(np.int32))
    at, size, ids = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (at, size, ids))
    order = np.argsort(at)
    if not np.array_equal(at[order], np.arange(n)):
        raise RuntimeError("the input's rows came in another order the second time; encode with cut_first=True")
    start = (np.cumsum(size) - size)[order]
    size = size[order]
    ends = np.cumsum(size)
    return ids[np.arange(ends[-1] if n else 0) + np.repeat(start - ends + size, size)], np.concatenate((np.zeros(1, np.int64), ends))


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block and place: the ids of a block's words, then its texts."""
    block, lists, flat, start = None, [], None, None
    for b in batches:
        out: list[bytes] = []
        texts = b.column("n_words").is_valid().to_numpy(zero_copy_only=False)
        for key, packed, n in zip(b.column("block").to_pylist(), b.column("ids"), b.column("n_words").to_pylist(), strict=True):
            if key != block:
                block, lists, flat = key, [], None
            if n is None:
                lists.append(packed.as_py())
                continue
            if flat is None:
                (flat, start), lists = _listed(lists, n), []
            packed = packed.as_py()
            if not packed:
                out.append(b"")
                continue
            places = unpack(packed).astype(np.int64)
            size = start[places + 1] - start[places]
            ends = np.cumsum(size)
            out.append(flat[np.arange(ends[-1]) + np.repeat(start[places] - ends + size, size)].tobytes())
        rows = b.column("row").filter(pa.array(texts))
        lo = 0
        while lo < len(out):
            hi, size = lo, 0
            while hi < len(out) and (hi == lo or size + len(out[hi]) <= 4 * BATCH_IDS):
                size += len(out[hi])
                hi += 1
            counts = np.fromiter((len(x) // 4 for x in out[lo:hi]), np.int32, hi - lo)
            offsets = np.concatenate((np.zeros(1, np.int32), np.cumsum(counts, dtype=np.int32)))
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(out[lo:hi]), np.int32)))
            yield pa.RecordBatch.from_arrays([rows.slice(lo, hi - lo), ids, pa.array(counts.astype(np.int64))], names=["row", "token_ids", "n_tokens"])
            lo = hi


def encode(df: DataFrame, ranks: bytes, pattern: str, text_col: str = "text", columns: list[Column] | None = None, cut_first: bool = False) -> DataFrame:
    """columns of df (all by default) with token_ids (array of int) and n_tokens (long)."""
    shown = columns if columns is not None else [F.col(f"`{c}`") for c in df.columns if c not in ("token_ids", "n_tokens")]
    packed = df.select(F.struct(*shown).alias("row"), F.col(text_col).cast("string").alias("text"))
    if cut_first:
        packed = cut(packed, "texts")
    send = df.sparkSession.sparkContext.broadcast(ranks)
    both = _positions(packed, pattern).unionByName(_ids(_words(packed, pattern), send), allowMissingColumns=True).repartition("block").sortWithinPartitions("block", "at")
    row = T.StructField("row", packed.schema["row"].dataType)
    out = both.mapInArrow(lean(_assemble), T.StructType([row, T.StructField("token_ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType())]))
    return out.select("row.*", "token_ids", "n_tokens")


def decode(df: DataFrame, ranks: bytes, ids_col: str = "token_ids", name: str = "decoded") -> DataFrame:
    """df with the bytes of ids_col, each id looked up in the token-byte table (as large as the vocabulary file, so it is sent to all tasks)."""
    shown = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns if c != name]).alias("row"), F.col(ids_col).cast("array<int>").alias("ids"))
    send = df.sparkSession.sparkContext.broadcast(token_bytes(ranks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.array(send.value, pa.binary())
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                lists = part.column("ids")
                flat = table.take(lists.flatten())
                counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                ends = np.frombuffer(flat.buffers()[1], np.int32)[np.concatenate((np.zeros(1, np.int64), np.cumsum(counts)))].tolist() if len(flat) else [0] * (len(lists) + 1)
                data = flat.buffers()[2].to_pybytes() if len(flat) else b""
                known = lists.is_valid().to_pylist()
                texts = [data[x:y] if k else None for k, x, y in zip(known, ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(texts, pa.binary())], names=["row", name])

    out = shown.mapInArrow(lean(run), T.StructType([shown.schema["row"], T.StructField(name, T.BinaryType())]))
    return out.select("row.*", name)
