"""Photoshop files: flat RGB layers of eight bits. Group markers are skipped, blend modes are not mapped (all normal)."""

from __future__ import annotations

import struct
import zlib

import numpy as np


class PsdError(ValueError):
    """Not a file that this reader understands."""


class _Reader:
    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise PsdError("the file is cut off")
        self.at += n
        return self.data[self.at - n : self.at]

    def get(self, kind: str):
        return struct.unpack(">" + kind, self.take(struct.calcsize(">" + kind)))[0]

    def block(self) -> "_Reader":
        return _Reader(self.take(self.get("I")))


def unpack_bits(data: bytes, size: int) -> bytes:
    """Run-length rows: a count byte n below 128 copies n + 1 bytes, above 128 repeats the next byte 257 - n times."""
    out, i = bytearray(), 0
    while i < len(data) and len(out) < size:
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        else:
            if n > 128:
                out += data[i + 1 : i + 2] * (257 - n)
            i += 2 if n > 128 else 1
    if len(out) != size:
        raise PsdError("a row of pixels has the wrong length")
    return bytes(out)


def _channel(data: _Reader, w: int, h: int) -> np.ndarray:
    kind = data.get("H")
    if kind == 0:
        raw = data.take(w * h)
    elif kind == 1:
        sizes = struct.unpack(f">{h}H", data.take(2 * h))
        raw = b"".join(unpack_bits(data.take(n), w) for n in sizes)
    elif kind == 2:
        raw = zlib.decompress(data.data[data.at :])[: w * h]
    else:
        raise PsdError(f"unknown compression {kind}")
    return np.frombuffer(raw, np.uint8).reshape(h, w)


def parse(data: bytes) -> tuple[tuple[int, int], list[tuple[dict, np.ndarray]]]:
    """((width, height), layers bottom first): a layer is its metadata and its RGBA bytes, with x and y where they go."""
    r = _Reader(data)
    if r.take(4) != b"8BPS" or r.get("H") != 1:
        raise PsdError("not a PSD file")
    r.take(6)
    _, h, w, depth, mode = r.get("H"), r.get("I"), r.get("I"), r.get("H"), r.get("H")
    if depth != 8 or mode != 3:
        raise PsdError("only RGB of eight bits is read")
    r.block(), r.block()
    info = r.block()
    if not info.data or not (size := info.get("I")):
        return (w, h), []
    info = _Reader(info.take(size))
    found = []
    for _ in range(abs(info.get("h"))):
        top, left, bottom, right = (info.get("i") for _ in range(4))
        channels = [(info.get("h"), info.get("I")) for _ in range(info.get("H"))]
        info.take(8)
        opacity, _, flags = info.get("B"), info.get("B"), info.get("B")
        info.take(1)
        extra = info.block()
        extra.block(), extra.block()
        name = extra.take(extra.get("B")).decode("utf-8", "replace")
        found.append((name, opacity, not flags & 2, (left, top, right - left, bottom - top), channels))
    out = []
    for name, opacity, visible, (x, y, lw, lh), channels in found:
        px = np.zeros((max(0, lh), max(0, lw), 4), np.uint8)
        px[..., 3] = 255
        for kind, n in channels:
            own = _Reader(info.take(n))
            place = {0: 0, 1: 1, 2: 2, -1: 3}.get(kind)
            if place is not None and px.size:
                px[..., place] = _channel(own, lw, lh)
        if not name.startswith("<"):
            out.append(({"name": name, "opacity": opacity / 255, "visible": visible, "blend": "normal", "x": x, "y": y}, px))
    return (w, h), out
