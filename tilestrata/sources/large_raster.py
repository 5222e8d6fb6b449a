"""Large TIFF and EXR images, read by strips and tiles: one file is decoded by many tasks.

1. Files are listed without their contents; a task reads the directory of each of its files and gives a row for every strip, tile or
   group of lines: where its bytes are, and which rectangle they hold.
2. That table is filtered by rectangle, page or file like any other; what is left is dealt out in runs of neighbouring blocks.
3. A task reads the bytes of its blocks, unpacks and decodes them, one block in memory at a time; of large strips without packing or with deflate, a piece at a time.
4. Images are written by tasks that pack some places of a strip each; one task an image puts their packed bytes together, a batch at a time.

TIFF: classic and big files of both byte orders, any number of pages, strips and tiles; grey, RGB and palettes of 1 to 16 bits, grey and RGB of 32
bits and floats of 16, 32 and 64; no packing, LZW, deflate and PackBits, with predictors. EXR: single parts of lines, half, float and
integer channels, no packing, RLE and ZIP. Integers are sRGB and become linear light, floats are linear already; associated alpha is taken out of colours.

Defined results: files of another kind, cut-off directories, blocks that lie outside the file, are larger than MAX_BLOCK (unless they are read by pieces) or unpack to
another size than they must raise; missing alpha is 1; empty files, and no files, give no rows.
"""

from __future__ import annotations

import json
import re
import struct
import tempfile
import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tilestrata.operators.tiles import Rect

BLOCKS = "file string, page int, block long, offsets array<long>, lengths array<long>, x int, y int, w int, h int, how string, run long"
PIXELS = "file string, page int, x int, y int, r double, g double, b double, a double"
#: Bytes of a block, packed or not, and packed bytes of a run.
MAX_BLOCK, RUN_BYTES = 1 << 28, 8 << 20
#: Bytes of a strip from which on it is read by pieces, and places of a piece.
LARGE_STRIP, PIECE = 16 << 20, 1 << 16
#: Bytes of the types of a TIFF directory's values, and their formats (fixed values of the format).
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 7: "B", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
#: EXR: lines of a block by packing, and value types.
EXR_LINES, EXR_KINDS = {0: 1, 1: 1, 2: 1, 3: 16}, {0: "<u4", 1: "<f2", 2: "<f4"}


class _File:
    """Random reads of a file anywhere Spark's tasks can open it."""

    def __init__(self, path: str) -> None:
        from pyarrow import fs

        where, name = fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", re.sub(r"^file:/+", "file:///", path)))
        self.path, self.file = path, where.open_input_file(name)
        self.size = self.file.size()

    def read(self, at: int, n: int) -> bytes:
        if at < 0 or n < 0 or n > MAX_BLOCK or at + n > self.size:
            raise ValueError(f"{self.path}: {n} bytes at {at} lie outside the file or are too many")
        return self.file.read_at(n, at)

    def close(self) -> None:
        self.file.close()


def _tiff(f: _File) -> Iterator[tuple]:
    order = {b"II": "<", b"MM": ">"}[f.read(0, 2)]
    magic, big = struct.unpack(order + "H", f.read(2, 2))[0], False
    if magic == 43:
        big = True
        at = struct.unpack(order + "Q", f.read(8, 8))[0]
    elif magic == 42:
        at = struct.unpack(order + "I", f.read(4, 4))[0]
    else:
        raise ValueError(f"{f.path}: no TIFF")
    page, seen = 0, set()
    while at:
        if at in seen:
            raise ValueError(f"{f.path}: directories run in a circle")
        seen.add(at)
        n = struct.unpack(order + ("Q" if big else "H"), f.read(at, 8 if big else 2))[0]
        head, size, room = (8, 20, 8) if big else (2, 12, 4)
        table = f.read(at + head, n * size)
        tags = {}
        for k in range(n):
            entry = table[k * size : (k + 1) * size]
            tag, kind, count = struct.unpack(order + ("HHQ" if big else "HHI"), entry[: size - room])
            if kind not in TYPES:
                continue
            form = TYPES[kind]
            length = struct.calcsize("=" + form) * count
            data = entry[size - room :][:length] if length <= room else f.read(struct.unpack(order + ("Q" if big else "I"), entry[size - room :])[0], length)
            tags[tag] = list(struct.unpack(f"{order}{count * len(form)}{form[0]}", data)) if form != "s" else []
        yield from _tiff_blocks(f, order, page, tags)
        at = struct.unpack(order + ("Q" if big else "I"), f.read(at + head + n * size, room))[0]
        page += 1


def _tiff_blocks(f: _File, order: str, page: int, tags: dict[int, list]) -> Iterator[tuple]:
    one = lambda tag, default=None: tags[tag][0] if tags.get(tag) else default
    w, h = one(256), one(257)
    samples, kind, packing = one(277, 1), one(262), one(259, NONE)
    bits = tags.get(258, [1] * samples)
    form = one(339, 1)
    planes = samples if one(284, 1) == 2 else 1
    floats, depth = form == 3, bits[0]
    if not w or not h or kind not in (0, 1, 2, 3) or packing not in (NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS) or len(set(bits)) > 1 or (depth not in ((16, 32, 64) if floats else (1, 2, 4, 8, 16, 32))) or form not in (1, 3) or (kind == 3 and 320 not in tags):
        raise ValueError(f"{f.path}: this kind of TIFF is not supported")
    tiled = 322 in tags
    bw, bh = (one(322), one(323)) if tiled else (w, min(one(278, h), h))
    offsets, lengths = (tags[324], tags[325]) if tiled else (tags[273], tags[279])
    across, down = -(-w // bw), -(-h // bh)
    if len(offsets) != across * down * planes or len(lengths) != len(offsets):
        raise ValueError(f"{f.path}: the directory is cut off")
    how = {"kind": "tiff", "order": order, "bits": depth, "floats": floats, "samples": samples, "planes": planes, "packing": packing, "predictor": one(317, 1), "photo": kind, "bw": bw, "bh": bh if tiled else 0, "alpha": one(338, 0), "map": tags.get(320) if kind == 3 else None}
    how = json.dumps(how)
    for k in range(across * down):
        x, y = k % across * bw, k // across * bh
        at = [k + p * across * down for p in range(planes)]
        yield page, k, [offsets[i] for i in at], [lengths[i] for i in at], x, y, min(bw, w - x), min(bh, h - y), how


def _text(f: _File, at: int) -> tuple[str, int]:
    data = f.read(at, min(256, f.size - at))
    end = data.index(b"\0")
    return data[:end].decode("latin-1"), at + end + 1


def _exr(f: _File) -> Iterator[tuple]:
    version = struct.unpack("<I", f.read(4, 4))[0]
    if version & ~0x4FF or version & 0xFF != 2:  # long names are all that is allowed
        raise ValueError(f"{f.path}: only single parts of lines are supported")
    at, have = 8, {}
    while True:
        name, at = _text(f, at)
        if not name:
            break
        _, at = _text(f, at)
        n = struct.unpack("<i", f.read(at, 4))[0]
        have[name], at = f.read(at + 4, n), at + 4 + n
    x0, y0, x1, y1 = struct.unpack("<4i", have["dataWindow"])
    packing = have["compression"][0]
    channels, data, k = [], have["channels"], 0
    while data[k]:
        end = data.index(b"\0", k)
        kind, _, xs, ys = struct.unpack("<iB3xii", data[end + 1 : end + 17])
        channels.append((data[k:end].decode("latin-1"), kind))
        if xs != 1 or ys != 1:
            raise ValueError(f"{f.path}: channels of fewer places are not supported")
        k = end + 17
    w, h = x1 - x0 + 1, y1 - y0 + 1
    if packing not in EXR_LINES or w < 1 or h < 1:
        raise ValueError(f"{f.path}: this kind of EXR is not supported")
    lines = EXR_LINES[packing]
    n = -(-h // lines)
    offsets = struct.unpack(f"<{n}Q", f.read(at, 8 * n))
    after = dict(zip(sorted(offsets), [*sorted(offsets)[1:], f.size], strict=True))
    how = json.dumps({"kind": "exr", "packing": packing, "channels": channels})
    for i, o in enumerate(offsets):
        yield 0, i, [o], [after[o] - o], x0, y0 + i * lines, w, min(lines, h - i * lines), how


def blocks(spark: SparkSession, path: str) -> DataFrame:
    """BLOCKS of every TIFF and EXR file under path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int64()]
        names = [c.split()[0] for c in BLOCKS.split(", ")]
        for b in batches:
            for name in b.column(0).to_pylist():
                f, rows, size = _File(name), [], 0
                try:
                    for row in (_exr if f.read(0, min(4, f.size)) == b"\x76\x2f\x31\x01" else _tiff)(f):
                        rows.append((name, *row, size // RUN_BYTES))
                        size += sum(row[3])
                        if len(rows) == 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                            rows = []
                except (KeyError, IndexError, struct.error) as e:
                    raise ValueError(f"{name}: the directory is cut off") from e
                finally:
                    f.close()
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    return files.filter(F.lower("path").rlike(r"\.(tiff?|exr)$")).mapInArrow(run, BLOCKS)


def _tasks(df: DataFrame) -> int:
    """Partitions of few rows that take long: a given number, as Spark puts small ones together otherwise."""
    return 4 * df.sparkSession.sparkContext.defaultParallelism


def inside(blocks: DataFrame, rect: Rect) -> DataFrame:
    """The blocks that meet a rectangle."""
    return blocks.filter((F.col("x") < rect.right) & (F.col("x") + F.col("w") > rect.x) & (F.col("y") < rect.bottom) & (F.col("y") + F.col("h") > rect.y))


def read(blocks: DataFrame, rect: Rect | None = None, covered: bool = False) -> DataFrame:
    """PIXELS of blocks, of a rectangle where one is given; covered: only those whose alpha is over 0."""
    if rect is not None:
        blocks = inside(blocks, rect)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = None
        for b in batches:
            for row in b.to_pylist():
                if f is None or f.path != row["file"]:
                    if f:
                        f.close()
                    f = _File(row["file"])
                how = json.loads(row["how"])
                for at, px in _pieces(f, how, row):
                    place = at + np.arange(len(px))
                    if covered:
                        shown = px[:, 3] > 0
                        place, px = place[shown], px[shown]
                    n = len(px)
                    if n:
                        keys = [pa.array([row["file"]] * n, pa.string()), pa.array(np.full(n, row["page"], np.int32)), pa.array((row["x"] + place % row["w"]).astype(np.int32)), pa.array((row["y"] + place // row["w"]).astype(np.int32))]
                        yield pa.RecordBatch.from_arrays([*keys, *(pa.array(np.ascontiguousarray(px[:, c])) for c in range(4))], names=[c.split()[0] for c in PIXELS.split(", ")])
        if f:
            f.close()

    out = blocks.repartition(_tasks(blocks), "file", "page", "run").sortWithinPartitions("file", "page", "block").mapInArrow(run, PIXELS)
    return out if rect is None else out.filter(rect.contains())


def _pieces(f: _File, how: dict, row: dict) -> Iterator[tuple[int, np.ndarray]]:
    """(first place, (n, 4) in linear light) of a block, at most PIECE places at a time; places are counted along its lines."""
    w, h = row["w"], row["h"]
    wide = how.get("samples", 0) * how.get("bits", 0) // 8
    if how["kind"] == "tiff" and not how["bh"] and how["planes"] == 1 and how["bits"] >= 8 and how["packing"] in (NONE, DEFLATE, OLD_DEFLATE) and how["predictor"] == 1 and wide * w * h > LARGE_STRIP:
        at, form = 0, f"{how['order']}{'f' if how['floats'] else 'u'}{how['bits'] // 8}"
        for raw in _unpacked(f, row["offsets"][0], row["lengths"][0], how["packing"] != NONE, wide * PIECE, wide * w * h):
            yield at, _light(how, np.frombuffer(raw, form).reshape(1, -1, how["samples"]))[0]
            at += len(raw) // wide
        return
    data = [f.read(o, n) for o, n in zip(row["offsets"], row["lengths"], strict=True)]
    px = (_decode_exr if how["kind"] == "exr" else _decode_tiff)(how, data, w, h).reshape(-1, 4)
    for at in range(0, len(px), PIECE):
        yield at, px[at : at + PIECE]


def _unpacked(f: _File, at: int, n: int, packed: bool, piece: int, size: int) -> Iterator[bytes]:
    """The first `size` unpacked bytes of n bytes of a file, a piece at a time; fewer raise."""
    if at + n > f.size:
        raise ValueError(f"{f.path}: {n} bytes at {at} lie outside the file")
    inflate, end, have, part = zlib.decompressobj(), at + n, 0, bytearray()
    while have < size:
        want = min(piece, size - have)
        while len(part) < want:
            data = inflate.unconsumed_tail
            if not data and at < end and not inflate.eof:
                data = f.read(at, min(1 << 20, MAX_BLOCK, end - at))
                at += len(data)
            more = data if not packed else inflate.decompress(data, want - len(part))
            if not more and (inflate.eof or (at >= end and not inflate.unconsumed_tail)):
                raise ValueError("the block's size isn't what it must be")
            part += more
        yield bytes(part[:want])
        have += want
        del part[:want]


def lzw(data: bytes, most: int) -> bytes:
    """LZW of TIFF: codes of 9 to 12 bits, high bits first, that widen one code early."""
    out, table, size = bytearray(), [], 0
    bits = at = 0
    width, last = 9, b""
    for byte in data:
        bits = (bits << 8) | byte
        at += 8
        if at < width:
            continue
        at -= width
        code = bits >> at
        bits &= (1 << at) - 1
        if code == 256:
            table = [bytes([i]) for i in range(256)] + [b"", b""]
            width, last = 9, b""
            continue
        if code == 257:
            break
        if code < len(table):
            word = table[code]
        elif code == len(table) and last:
            word = last + last[:1]
        else:
            raise ValueError("the LZW codes are broken")
        out += word
        if len(out) > most:
            break
        if last:
            table.append(last + word[:1])
            size = len(table)
            width = 12 if size >= 2047 else 11 if size >= 1023 else 10 if size >= 511 else 9
        last = word
    return bytes(out)


def _runs(data: bytes, most: int, literal: bool) -> bytes:
    """PackBits (literal: counts from 0 are literals) or the RLE of EXR, which has it the other way round."""
    out, at = bytearray(), 0
    while at < len(data) and len(out) < most:
        n = data[at] - 256 if data[at] > 127 else data[at]
        at += 1
        if n == -128 and literal:
            continue
        if (n >= 0) == literal:
            k = n + 1 if literal else -n
            out += data[at : at + k]
            at += k
        else:
            out += data[at : at + 1] * (1 - n if literal else n + 1)
            at += 1
    return bytes(out)


def _unzipped(data: bytes, most: int) -> bytes:
    return zlib.decompressobj().decompress(data, most)


def _plane(how: dict, data: bytes, w: int, h: int, samples: int) -> np.ndarray:
    """(h, w, samples) of one TIFF block, as stored."""
    bits = how["bits"]
    row = -(-w * samples * bits // 8)
    size = row * h
    if size > MAX_BLOCK:
        raise ValueError("the block is too large")
    unpack = {NONE: lambda d: d[:size], LZW: lambda d: lzw(d, size)[:size], PACKBITS: lambda d: _runs(d, size, True)[:size], DEFLATE: lambda d: _unzipped(d, size), OLD_DEFLATE: lambda d: _unzipped(d, size)}
    raw = unpack[how["packing"]](data)
    if len(raw) != size:
        raise ValueError("the block's size isn't what it must be")
    if how["predictor"] == 3:
        wide = bits // 8
        rows = np.frombuffer(raw, np.uint8).reshape(h, w * wide, samples) if samples > 1 else np.frombuffer(raw, np.uint8).reshape(h, w * wide, 1)
        rows = np.cumsum(rows, axis=1, dtype=np.uint8).reshape(h, wide, w * samples)
        return np.ascontiguousarray(rows.transpose(0, 2, 1)).view(f">f{wide}").reshape(h, w, samples)
    if bits < 8:
        each = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(h, row), axis=1)[:, : w * samples * bits]
        px = each.reshape(h, w, samples, bits) @ (1 << np.arange(bits)[::-1])
    else:
        px = np.frombuffer(raw, f"{how['order']}{'f' if how['floats'] else 'u'}{bits // 8}").reshape(h, w, samples)
    if how["predictor"] == 2:
        px = np.cumsum(px.astype(np.uint64), axis=1, dtype=np.uint64) & np.uint64((1 << bits) - 1)
    return px


def _decode_tiff(how: dict, data: list[bytes], w: int, h: int) -> np.ndarray:
    """(h, w, 4) in linear light."""
    bw, bh = (how["bw"], how["bh"]) if how["bh"] else (w, h)
    each = how["samples"] if how["planes"] == 1 else 1
    return _light(how, np.concatenate([_plane(how, d, bw, bh, each) for d in data], axis=2)[:h, :w])


def _light(how: dict, px: np.ndarray) -> np.ndarray:
    """(h, w, 4) in linear light of (h, w, samples) as stored."""
    colours = 3 if how["photo"] == 2 else 1
    if how["photo"] == 3:
        table = np.array(how["map"], float).reshape(3, -1).T / 65535.0
        colour, top = table[px[..., 0].astype(np.int64)], 1.0
    else:
        top = 1.0 if how["floats"] else float((1 << how["bits"]) - 1)
        colour = px[..., :colours].astype(float) / top
        if how["photo"] == 0:
            colour = 1.0 - colour
    colour = np.repeat(colour, 3, axis=2) if colour.shape[2] == 1 else colour
    alpha = px[..., colours].astype(float) / (top if how["photo"] != 3 else float((1 << how["bits"]) - 1)) if px.shape[2] > colours else np.ones(px.shape[:2])
    if how["alpha"] == 1:
        colour = colour / np.where(alpha > 0, alpha, 1.0)[..., None]
    if not how["floats"]:
        colour = np.where(colour <= 0.04045, colour / 12.92, ((colour + 0.055) / 1.055) ** 2.4)
    return np.dstack((colour, alpha))


def _decode_exr(how: dict, data: list[bytes], w: int, h: int) -> np.ndarray:
    """(h, w, 4) in linear light."""
    kinds = [np.dtype(EXR_KINDS[k]) for _, k in how["channels"]]
    line = sum(k.itemsize for k in kinds) * w
    size = line * h
    n = struct.unpack("<i", data[0][4:8].ljust(4, b"\0"))[0]
    raw = data[0][8 : 8 + max(n, 0)]
    if size > MAX_BLOCK or len(raw) != n or not n:
        raise ValueError("the block is too large or cut off")
    if how["packing"] and n < size:
        raw = _runs(raw, size, False) if how["packing"] == 1 else _unzipped(raw, size)
        if len(raw) != size:
            raise ValueError("the block's size isn't what it must be")
        d = np.frombuffer(raw, np.uint8).astype(np.int64)
        d[1:] -= 128
        d = np.cumsum(d).astype(np.uint8)
        half = (size + 1) // 2
        out = np.empty(size, np.uint8)
        out[0::2], out[1::2] = d[:half], d[half:]
        raw = out.tobytes()
    if len(raw) != size:
        raise ValueError("the block's size isn't what it must be")
    at, have = 0, {}
    rows = np.frombuffer(raw, np.uint8).reshape(h, line)
    for (name, _), kind in zip(how["channels"], kinds, strict=True):
        have[name] = np.ascontiguousarray(rows[:, at : at + kind.itemsize * w]).view(kind).astype(float)
        at += kind.itemsize * w
    grey = have.get("Y", np.zeros((h, w)))
    colour = np.dstack([have.get(c, grey) for c in "RGB"])
    alpha = have.get("A", np.ones((h, w)))
    return np.dstack((colour / np.where(alpha > 0, alpha, 1.0)[..., None], alpha))


def encode_tiff(px: np.ndarray, rows_per_strip: int = 64) -> bytes:
    """(h, w, 4) of floats as a TIFF of straight alpha, in deflated strips of doubles."""
    h, w = px.shape[:2]
    strips = [zlib.compress(np.ascontiguousarray(px[y : y + rows_per_strip], "<f8").tobytes(), 1) for y in range(0, h, rows_per_strip)]
    return _tiff_head(w, h, rows_per_strip, [len(s) for s in strips]) + b"".join(strips)


def _tiff_head(w: int, h: int, rows_per_strip: int, lengths: list[int]) -> bytes:
    """All of a TIFF of straight alpha in deflated strips of doubles that comes before its strips."""
    n = len(lengths)
    entries = 12
    after = 16 + 8 + entries * 20 + 8
    offsets_at, lengths_at = after, after + 8 * n
    first = lengths_at + 8 * n
    offsets = first + np.cumsum([0, *lengths[:-1]])
    tags = [(256, 4, 1, w), (257, 4, 1, h), (258, 3, 4, 64 | 64 << 16 | 64 << 32 | 64 << 48), (259, 3, 1, DEFLATE), (262, 3, 1, 2), (273, 16, n, int(offsets[0]) if n == 1 else offsets_at), (277, 3, 1, 4), (278, 4, 1, rows_per_strip), (279, 16, n, lengths[0] if n == 1 else lengths_at), (284, 3, 1, 1), (338, 3, 1, 2), (339, 3, 4, 3 | 3 << 16 | 3 << 32 | 3 << 48)]
    head = struct.pack("<2sHHHQ", b"II", 43, 8, 0, 16) + struct.pack("<Q", entries) + b"".join(struct.pack("<HHQQ", *t) for t in tags) + struct.pack("<Q", 0)
    return head + struct.pack(f"<{n}Q", *offsets.tolist()) + struct.pack(f"<{n}Q", *lengths)


def _adler(a: int, b: int, n: int) -> int:
    """Adler-32 of two runs of bytes after each other, the second of n bytes, by those of both."""
    low = ((a & 0xFFFF) + (b & 0xFFFF) - 1) % 65521
    return (((a >> 16) + (b >> 16) + n * ((a & 0xFFFF) - 1)) % 65521) << 16 | low


def _part(px: np.ndarray) -> tuple[bytes, int]:
    """Places (n, 4) as a part of a deflated stream, and their Adler-32."""
    raw = np.ascontiguousarray(px, "<f8").tobytes()
    deflate = zlib.compressobj(1, zlib.DEFLATED, -15)
    return deflate.compress(raw) + deflate.flush(zlib.Z_FULL_FLUSH), zlib.adler32(raw)


def write_tiffs(px: DataFrame, folder: str, key: str, rect: Rect) -> DataFrame:
    """(key, file): an image for each value of key, of px (key, x, y, r, g, b, a) inside a rectangle.

    Strips have 64 lines, or as many as fit into 8 MB, but one at least. Each group of PIECE places of a strip is packed by itself; a task puts
    an image together in a temporary file of packed bytes, as the lengths of its strips come first.
    """
    from pyspark.sql import types as T

    from tilestrata.operators.raster import RGBA

    lines = max(1, min(64, (8 << 20) // (32 * max(1, rect.w))))
    strips = -(-rect.h // lines)
    kind = px.schema[key]
    size = lambda strip: min(lines, rect.h - strip * lines) * rect.w  # noqa: E731 - places of a strip

    def pack(keys, rows):
        strip, part = keys[1].as_py(), keys[2].as_py()
        out = np.zeros((min(PIECE, size(strip) - part * PIECE), 4))
        out[rows.column("at").to_numpy()] = np.column_stack([rows.column(c).to_numpy() for c in RGBA])
        data, check = _part(out)
        return pa.table({key: pa.array([keys[0].as_py()], rows.schema.field(key).type), "strip": [strip], "part": [part], "adler": [check], "data": pa.array([data], pa.binary())})

    def image(name, parts: Iterator[tuple[int, int, int, bytes]], spool) -> None:
        """One file of the parts that hold pixels; all others are empty."""
        from pyarrow import fs

        lengths, empty, given = [], {}, next(parts, None)
        for strip in range(strips):
            start, check, left = spool.tell(), 1, size(strip)
            spool.write(b"\x78\x01")
            for part in range(-(-left // PIECE)):
                n = min(PIECE, left - part * PIECE)
                if given is not None and given[:2] == (strip, part):
                    (_, _, own, data), given = given, next(parts, None)
                else:
                    if n not in empty:
                        empty[n] = _part(np.zeros((n, 4)))
                    data, own = empty[n]
                spool.write(data)
                check = _adler(check, own, 32 * n)
            spool.write(b"\x03\x00" + struct.pack(">I", check))
            lengths.append(spool.tell() - start)
        where, path = fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", re.sub(r"^file:/+", "file:///", folder)))
        where.create_dir(path, recursive=True)
        spool.seek(0)
        with where.open_output_stream(f"{path}/{name}.tif") as f:
            f.write(_tiff_head(rect.w, rect.h, lines, lengths))
            while data := spool.read(1 << 20):
                f.write(data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((k, (s.as_py(), p.as_py(), a.as_py(), d.as_py())) for b in batches for k, s, p, a, d in zip(b.column(0).to_pylist(), *(b.column(c) for c in range(1, 5)), strict=True))
        for name, parts in groupby(rows, lambda r: r[0]):
            with tempfile.TemporaryFile() as spool:
                image(name, (r[1] for r in parts), spool)
            yield pa.RecordBatch.from_pydict({key: pa.array([name], to_arrow_type(kind.dataType)), "file": [f"{folder}/{name}.tif"]})

    place = (F.col("y") - rect.y).cast("long") % lines * rect.w + (F.col("x") - rect.x)
    inside = px.filter(rect.contains()).select(key, F.floor((F.col("y") - rect.y) / lines).cast("int").alias("strip"), F.floor(place / PIECE).cast("int").alias("part"), (place % PIECE).cast("int").alias("at"), *RGBA)
    packed = inside.groupBy(key, "strip", "part").applyInArrow(pack, T.StructType([kind, *(T.StructField(n, k) for n, k in (("strip", T.LongType()), ("part", T.LongType()), ("adler", T.LongType()), ("data", T.BinaryType())))]))
    return packed.repartition(_tasks(px), key).sortWithinPartitions(key, "strip", "part").mapInArrow(run, T.StructType([kind, T.StructField("file", T.StringType())]))
