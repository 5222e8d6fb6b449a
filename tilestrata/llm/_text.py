"""Vectorised text primitives on Arrow buffers, shared by the Arrow-side operators.

Everything here works on whole texts, chunk by chunk, so memory is bounded by one
chunk (a few MB) plus the longest single text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

U64 = np.uint64
#: Bytes of text handled at once; a longer single text forms a chunk of its own.
CHUNK_BYTES = 1 << 20

#: ASCII-only lower-casing of single bytes.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes that separate words: space and \t \n \v \f \r.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_BASE = U64(0x9E3779B97F4A7C15)
_BASE_INV = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Sets hashes of strings of different length apart.
LENGTH_SALT = U64(0xD6E8FEB86659FD93)
_powers = {"n": 0, "up": np.ones(1, U64), "down": np.ones(1, U64)}


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, offsets


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES):
    """Row ranges [lo, hi) whose texts together take at most `most` bytes, or one row."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalising bit mixer (bijective on 64 bits)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _powers["n"] < n:
        n = max(n, CHUNK_BYTES + 1)
        with np.errstate(over="ignore"):
            for key, base in (("up", _BASE), ("down", _BASE_INV)):
                p = np.full(n, base, U64)
                p[0] = 1
                _powers[key] = np.cumprod(p, dtype=U64)
        _powers["n"] = n
    return _powers["up"], _powers["down"]


def word_spans(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE):
    """Start and end of every word, and each text's range of words.

    offsets are positions in data; words never cross texts.
    """
    base, end = int(offsets[0]), int(offsets[-1])
    gap = space[data[base:end]]
    n = len(gap)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    edge = offsets - base
    before = np.empty(n, bool)
    before[0] = True
    before[1:] = gap[:-1]
    before[edge[:-1][edge[:-1] < n]] = True
    after = np.empty(n, bool)
    after[-1] = True
    after[:-1] = gap[1:]
    after[edge[1:][edge[1:] > 0] - 1] = True
    word = ~gap
    starts = np.flatnonzero(word & before)
    ends = np.flatnonzero(word & after) + 1
    return starts + base, ends + base, np.searchsorted(starts, edge)


#: Words longer than this are hashed one by one.
LONG_WORD = 512


def word_hashes(data: np.ndarray, offsets: np.ndarray):
    """64-bit hash of every lower-cased word, with starts, ends and each text's range of words.

    Eight bytes at a time go through a bijective mixer, which no arithmetic of the letters passes, so equal hashes of
    different words are chance: about n * n / 2 ** 65 pairs among n distinct words.
    """
    starts, ends, rng = word_spans(data, offsets)
    base, end = int(offsets[0]), int(offsets[-1])
    lowered = np.concatenate((LOWER[data[base:end]], np.zeros(8, np.uint8)))
    lanes = np.lib.stride_tricks.sliding_window_view(lowered, 8)
    at, size = starts - base, ends - starts
    with np.errstate(over="ignore"):
        out = mix64(size.astype(U64) * LENGTH_SALT + _BASE)
        rows = np.flatnonzero(size <= LONG_WORD)
        k = 0
        while len(rows):
            here, left = at[rows] + k, size[rows] - k
            lane = np.ascontiguousarray(lanes[here]).view("<u8").ravel()
            short = left < 8
            lane[short] &= (U64(1) << (left[short].astype(U64) * U64(8))) - U64(1)
            out[rows] = mix64((out[rows] ^ lane) + _BASE)
            rows = rows[left > 8]
            k += 8
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        out[i] = xxhash.xxh3_64_intdigest(lowered[at[i] : at[i] + size[i]].tobytes(), seed=1)
    return out, starts, ends, rng


def substring_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of data[start:end] for each pair."""
    up, down = powers(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, U64)
        np.cumsum((data.astype(U64) + U64(1)) * up[: len(data)], out=sums[1:])
        return mix64(((sums[ends] - sums[starts]) * down[starts]) ^ ((ends - starts).astype(U64) * LENGTH_SALT))


def gather(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of data[start:end] put one after another."""
    size = ends - starts
    at = np.concatenate((np.zeros(1, np.int64), np.cumsum(size)))
    return data[np.arange(at[-1]) + np.repeat(starts - at[:-1], size)], at


_GRAM = (U64(0xA24BAED4963EE407), U64(0x9FB21C651E98DF25), U64(0xC2B2AE3D27D4EB4F), U64(0x165667B19E3779F9), U64(0x27D4EB2F165667C5))


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of one text (fewer words: the whole sequence as one)."""
    n = len(words)
    if n == 0:
        return words
    k = min(size, n)
    with np.errstate(over="ignore"):
        s = np.full(n - k + 1, U64(k), U64)
        for i in range(k):
            s = mix64(s + words[i : n - k + 1 + i] * _GRAM[i % 5] + U64(i))
    s.sort()
    return s[np.concatenate(([True], s[1:] != s[:-1]))]
