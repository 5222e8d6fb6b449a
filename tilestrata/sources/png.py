"""PNG and SVG images, with the standard library only: grey and palettes of 1 to 8 bits, grey, RGB and RGBA of 8 and 16, without interlacing."""

from __future__ import annotations

import base64
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilestrata.functions.color import from_u8, to_u8, to_u16
from tilestrata.operators.raster import RGBA
from tilestrata.operators.tiles import Rect, read_rect
from tilestrata.sources import icc

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Channels of the colour types (fixed values of the format).
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}
PALETTE = 3
MAX_SIDE = 8192


def encode(px: np.ndarray) -> bytes:
    """(h, w, channels) of uint8 or uint16 as PNG."""
    h, w, c = px.shape
    kind = {v: k for k, v in CHANNELS.items()}[c]
    rows = px.astype(">u2" if px.dtype.itemsize == 2 else np.uint8).reshape(h, -1)
    raw = b"".join(b"\0" + r.tobytes() for r in rows)
    chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8 * px.dtype.itemsize, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def decode(data: bytes) -> np.ndarray:
    """(h, w, channels) of uint8 or uint16; palettes give RGBA."""
    if data[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, body, head, table, clear = 8, b"", None, b"", b""
    while at + 8 <= len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            body += part
        elif kind == b"PLTE":
            table = part
        elif kind == b"tRNS":
            clear = part
        elif kind == b"IEND":
            break
        at += n + 12
    if head is None or head[2] not in ((1, 2, 4, 8) if head[3] == PALETTE else (1, 2, 4, 8, 16) if head[3] == 0 else (8, 16)) or head[3] not in (*CHANNELS, PALETTE) or head[6] or max(head[:2]) > MAX_SIDE or not min(head[:2]):
        raise ValueError("this kind of PNG is not supported")
    w, h, bits, kind = head[:4]
    channels = CHANNELS.get(kind, 1)
    step = max(1, channels * bits // 8)
    size = -(-w * channels * bits // 8)
    unpacker = zlib.decompressobj()
    raw = unpacker.decompress(body, (size + 1) * h)
    if len(raw) != (size + 1) * h:
        raise ValueError("the image data are cut off")
    out, above = np.zeros((h, size), np.uint8), np.zeros(size, np.int64)
    for y in range(h):
        line = np.frombuffer(raw, np.uint8, size, y * (size + 1) + 1).astype(np.int64)
        how = raw[y * (size + 1)]
        if how == 2:
            line = line + above
        elif how == 1:
            line = line.reshape(-1, step).cumsum(axis=0).reshape(-1)
        elif how in (3, 4):
            left, corner = np.zeros(step, np.int64), np.zeros(step, np.int64)
            line = line.reshape(-1, step)
            up = above.reshape(-1, step)
            for x in range(len(line)):
                if how == 3:
                    guess = (left + up[x]) // 2
                else:
                    p = left + up[x] - corner
                    a, b, c = abs(p - left), abs(p - up[x]), abs(p - corner)
                    guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, up[x], corner))
                left = line[x] = (line[x] + guess) & 255
                corner = up[x]
            line = line.reshape(-1)
        above = line & 255
        out[y] = above
    if bits < 8:
        small = np.unpackbits(out, axis=1)[:, : w * bits].reshape(h, w, bits) @ (1 << np.arange(bits)[::-1])
        out = (small if kind == PALETTE else small * (255 // ((1 << bits) - 1))).astype(np.uint8)
    if kind == PALETTE:
        return _coloured(out.reshape(h, w), table, clear)
    px = out.reshape(h, w, channels, max(1, bits // 8))
    return px[..., 0] if bits <= 8 else (px[..., 0].astype(np.uint16) << 8 | px[..., 1])


def profile_of(data: bytes) -> bytes | None:
    """The colour profile in a PNG's iCCP chunk, which comes before the image data."""
    at = 8
    while at + 8 <= len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        if kind == b"iCCP":
            name, end, rest = data[at + 8 : at + 8 + n].partition(b"\0")
            if not end or rest[:1] != b"\0":
                raise ValueError("the iCCP chunk is broken")
            unpacker = zlib.decompressobj()
            return unpacker.decompress(rest[1:], icc.MAX_PROFILE)
        if kind in (b"IDAT", b"IEND"):
            break
        at += n + 12
    return None


def _coloured(at: np.ndarray, table: bytes, clear: bytes) -> np.ndarray:
    """RGBA of places in a palette; colours that `clear` has no alpha for are opaque."""
    colours = np.frombuffer(table[: len(table) // 3 * 3], np.uint8).reshape(-1, 3)
    if at.max(initial=0) >= len(colours):
        raise ValueError("the palette has no such colour")
    alpha = np.full(len(colours), 255, np.uint8)
    alpha[: len(clear)] = np.frombuffer(clear[: len(colours)], np.uint8)
    return np.dstack((colours[at], alpha[at]))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(name, x, y, r, g, b, a) of every PNG under path: linear light (through the image's own colour profile where it has one), missing alpha 1, named by file stem."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, data in zip(pdf["name"], pdf["content"], strict=True):
                px = decode(bytes(data))
                v = px / float(np.iinfo(px.dtype).max)
                colour = v[..., :3] if v.shape[2] >= 3 else np.repeat(v[..., :1], 3, axis=2)
                alpha = v[..., -1] if v.shape[2] in (2, 4) else np.ones(v.shape[:2])
                profile = profile_of(bytes(data))
                if profile is None:
                    linear = np.where(colour <= 0.04045, colour / 12.92, ((colour + 0.055) / 1.055) ** 2.4)
                else:
                    linear = icc.parse(profile).to_working(colour.reshape(-1, 3)).reshape(colour.shape)
                y, x = np.mgrid[: v.shape[0], : v.shape[1]].astype(np.int32)
                yield pd.DataFrame({"name": name, "x": x.ravel(), "y": y.ravel(), "r": linear[..., 0].ravel(), "g": linear[..., 1].ravel(), "b": linear[..., 2].ravel(), "a": alpha.ravel()})

    files = spark.read.format("binaryFile").load(path).filter(F.lower("path").endswith(".png"))
    stem = F.regexp_extract("path", r"([^/]*)\.[^./]*$", 1)
    return files.select(stem.alias("name"), "content").mapInPandas(run, "name string, x int, y int, r double, g double, b double, a double")


def to_png(px: DataFrame, rect: Rect, bits: int = 8) -> DataFrame:
    """One row (png BINARY) of a composite's rectangle."""
    return image_rows(read_rect(px, rect).withColumn("name", F.lit("")), {"": rect}, bits).select("png")


def image_rows(px: DataFrame, rects: dict[str, Rect], bits: int = 8) -> DataFrame:
    """(name, png) of named images (name, x, y, r, g, b, a); a group is one image."""
    code = to_u8 if bits == 8 else to_u16
    top = 255 if bits == 8 else 65535
    sizes = {k: (r.x, r.y, r.w, r.h) for k, r in rects.items()}
    rows = px.select("name", "x", "y", *[code(F.col(c)).alias(c) for c in "rgb"], F.round(F.least(F.greatest("a", F.lit(0.0)), F.lit(1.0)) * top).cast("int").alias("a"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        name = pdf["name"].iloc[0]
        x, y, w, h = sizes[name]
        out = np.zeros((h, w, 4), np.uint8 if bits == 8 else np.uint16)
        out[pdf["y"] - y, pdf["x"] - x] = pdf[list(RGBA)]
        return pd.DataFrame({"name": [name], "png": [encode(out)]})

    return rows.groupBy("name").applyInPandas(run, "name string, png binary")


def to_svg(png: bytes, rect: Rect) -> str:
    """An SVG that holds the image as a data address."""
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{rect.w}" height="{rect.h}"><image width="{rect.w}" height="{rect.h}" href="data:image/png;base64,{base64.b64encode(png).decode()}"/></svg>'


def clipboard(px: DataFrame, rect: Rect) -> DataFrame:
    """(x, y, r8, g8, b8, a8) of a copied rectangle."""
    return read_rect(px, rect).select("x", "y", *[to_u8(F.col(c)).alias(c + "8") for c in "rgb"], to_u8(F.col("a"), False).alias("a8"))


def pasted(rows: DataFrame) -> DataFrame:
    return rows.select("x", "y", *[from_u8(F.col(c + "8")).alias(c) for c in "rgb"], from_u8(F.col("a8"), False).alias("a")).filter("a > 0")
