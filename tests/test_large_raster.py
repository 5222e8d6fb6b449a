"""Images of strips and tiles made here, read again by many tasks."""

import struct
import zlib

import numpy as np
import pytest

from tilestrata.operators.tiles import Rect
from tilestrata.sources import large_raster as lr
from tilestrata.sources import png


def linear(v):
    return np.where(v <= 0.04045, v / 12.92, ((v + 0.055) / 1.055) ** 2.4)


def packbits(data):
    out, at = b"", 0
    while at < len(data):
        run = 1
        while at + run < len(data) and run < 128 and data[at + run] == data[at]:
            run += 1
        if run > 1:
            out += bytes([257 - run, data[at]])
        else:
            out += bytes([0, data[at]])
        at += run
    return out


def lzw(data):
    out, bits, n = bytearray(), 0, 0

    def put(code, width):
        nonlocal bits, n
        bits, n = (bits << width) | code, n + width
        while n >= 8:
            out.append((bits >> (n - 8)) & 255)
            n -= 8
            bits &= (1 << n) - 1

    table, width = {bytes([i]): i for i in range(256)}, 9
    put(256, 9)
    word = b""
    for b in data:
        longer = word + bytes([b])
        if longer in table:
            word = longer
            continue
        put(table[word], width)
        table[longer] = len(table) + 2
        size = len(table) + 2
        width = 12 if size >= 2048 else 11 if size >= 1024 else 10 if size >= 512 else 9
        if size >= 4094:
            put(256, width)
            table, width = {bytes([i]): i for i in range(256)}, 9
        word = bytes([b])
    if word:
        put(table[word], width)
    put(257, width)
    put(0, 7)
    return bytes(out)


def tiff(px, order="<", packing=1, tile=None, strip=3, planar=False, predictor=1, photo=None, colormap=None, extra=None, bits=None, pages=1):
    """A classic TIFF of (h, w, c) values."""
    h, w, c = px.shape
    bits = bits or 8 * px.dtype.itemsize
    floats = px.dtype.kind == "f"
    pack = {1: bytes, 5: lzw, 8: zlib.compress, 32773: packbits}[packing]
    bw, bh = tile or (w, strip)

    def stored(block):
        rows = []
        for row in block:
            if predictor == 2:
                row = np.concatenate((row[:1], np.diff(row.astype(np.int64), axis=0).astype(row.dtype)))
            if predictor == 3:
                be = row.astype(row.dtype.newbyteorder(">")).tobytes()
                planes = np.frombuffer(be, np.uint8).reshape(-1, row.dtype.itemsize).T.ravel()
                step = planes.reshape(-1, row.shape[1])
                rows.append(np.concatenate((step[:1], np.diff(step.astype(np.int16), axis=0).astype(np.uint8))).tobytes())
            elif bits < 8:
                flat = row.ravel()
                rows.append(np.packbits((flat[:, None] >> np.arange(bits)[::-1] & 1).astype(np.uint8).ravel()).tobytes())
            else:
                rows.append(row.astype(row.dtype.newbyteorder(order)).tobytes())
        return pack(b"".join(rows))

    blocks = []
    for plane in range(c) if planar else [slice(None)]:
        part = px[..., plane : plane + 1] if planar else px
        for y in range(0, h, bh):
            for x in range(0, w, bw):
                b = part[y : y + bh, x : x + bw]
                if tile:
                    full = np.zeros((bh, bw, b.shape[2]), px.dtype)
                    full[: b.shape[0], : b.shape[1]] = b
                    b = full
                blocks.append(stored(b))
    photo = photo if photo is not None else 2 if c >= 3 else 1
    body, head = b"", struct.pack(order + "2sHI", b"II" if order == "<" else b"MM", 42, 8)
    tags = {256: ("I", [w]), 257: ("I", [h]), 258: ("H", [bits] * c), 259: ("H", [packing]), 262: ("H", [photo]), 277: ("H", [c]), 284: ("H", [2 if planar else 1]), 317: ("H", [predictor]), 339: ("H", [3 if floats else 1] * c)}
    if extra is not None:
        tags[338] = ("H", [extra])
    if colormap is not None:
        tags[320] = ("H", colormap.T.ravel().tolist())
    tags |= {322: ("I", [bw]), 323: ("I", [bh])} if tile else {278: ("I", [strip])}
    names = (324, 325) if tile else (273, 279)
    tags[names[1]] = ("I", [len(b) for b in blocks])
    tags[names[0]] = ("I", [0] * len(blocks))
    out, at = head, 8
    for page in range(pages):
        size = 2 + 12 * len(tags) + 4
        values, entries = b"", b""
        extra_at = at + size
        places, place = [], extra_at + sum(len(v) * (4 if k == "I" else 2) if len(v) * (4 if k == "I" else 2) > 4 else 0 for k, v in tags.values())
        for b in blocks:
            places.append(place)
            place += len(b)
        tags[names[0]] = ("I", places)
        for tag, (kind, v) in sorted(tags.items()):
            data = struct.pack(f"{order}{len(v)}{kind}", *v)
            entries += struct.pack(order + "HHI", tag, 4 if kind == "I" else 3, len(v))
            if len(data) <= 4:
                entries += data.ljust(4, b"\0")
            else:
                entries += struct.pack(order + "I", extra_at + len(values))
                values += data
        body = struct.pack(order + "H", len(tags)) + entries + struct.pack(order + "I", place if page + 1 < pages else 0) + values + b"".join(blocks)
        out, at = out + body, place
    return out


def exr(px, packing, kind):
    """(h, w, 4) as an EXR with premultiplied A, B, G, R."""
    h, w = px.shape[:2]
    attr = lambda n, t, d: n.encode() + b"\0" + t.encode() + b"\0" + struct.pack("<i", len(d)) + d
    chan = b"".join(c.encode() + b"\0" + struct.pack("<iB3xii", {"<f2": 1, "<f4": 2}[kind], 0, 1, 1) for c in "ABGR") + b"\0"
    box = struct.pack("<4i", -2, 5, w - 3, h + 4)
    head = struct.pack("<II", 20000630, 2) + attr("channels", "chlist", chan) + attr("compression", "compression", bytes([packing])) + attr("dataWindow", "box2i", box) + attr("displayWindow", "box2i", box) + b"\0"
    lines = lr.EXR_LINES[packing]
    blocks = []
    for y in range(0, h, lines):
        raw = b"".join(np.ascontiguousarray(row[:, c]).astype(kind).tobytes() for row in px[y : y + lines] for c in (3, 2, 1, 0))
        if packing:
            d = np.frombuffer(raw, np.uint8)
            d = np.concatenate((d[0::2], d[1::2])).astype(np.int64)
            d = np.concatenate((d[:1], (np.diff(d) + 128) & 255)).astype(np.uint8).tobytes()
            if packing == 1:
                small = b"".join(bytes([256 - 1, v]) for v in d)
            else:
                small = zlib.compress(d)
            raw = small if len(small) < len(raw) else raw
        blocks.append(struct.pack("<ii", y + 5, len(raw)) + raw)
    at, table = len(head) + 8 * len(blocks), []
    for b in blocks:
        table.append(at)
        at += len(b)
    return head + struct.pack(f"<{len(table)}Q", *table) + b"".join(blocks)


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault((r["file"].rpartition("/")[2], r["page"]), {})[r["x"], r["y"]] = (r["r"], r["g"], r["b"], r["a"])
    return out


def test_tiff_of_all_kinds(spark, tmp_path):
    rng = np.random.default_rng(3)
    h, w = 11, 13
    u8, u16 = rng.integers(0, 256, (h, w, 3), np.uint8), rng.integers(0, 65536, (h, w, 4), np.uint16)
    smooth = (np.add.outer(np.arange(h), np.arange(w))[..., None] // 3 * np.ones(3)).astype(np.uint8)
    f32, grey = rng.random((h, w, 3)).astype(np.float32), rng.integers(0, 256, (h, w, 1), np.uint8)
    four, one = rng.integers(0, 16, (h, w, 1), np.uint8), rng.integers(0, 2, (h, w, 1), np.uint8)
    cmap = rng.integers(0, 65536, (256, 3), np.uint16)
    rgb = lambda v: linear(np.repeat(v, 3, axis=2) if v.shape[2] == 1 else v[..., :3])
    ones = np.ones((h, w, 1))
    cases = {
        "none.tif": (tiff(u8), rgb(u8 / 255), ones), "big-endian.tiff": (tiff(u16, ">"), rgb(u16 / 65535), u16[..., 3:] / 65535), "lzw.tif": (tiff(smooth, packing=5), rgb(smooth / 255), ones),
        "lzw2.tif": (tiff(u8, packing=5, predictor=2, strip=11), rgb(u8 / 255), ones), "deflate.tif": (tiff(u16, packing=8, predictor=2, extra=2), rgb(u16 / 65535), u16[..., 3:] / 65535), "packbits.tif": (tiff(smooth, packing=32773), rgb(smooth / 255), ones),
        "tiles.TIF": (tiff(u8, packing=8, tile=(4, 8)), rgb(u8 / 255), ones), "planar.tif": (tiff(u16, ">", planar=True, packing=8), rgb(u16 / 65535), u16[..., 3:] / 65535), "float.tif": (tiff(f32, packing=8, predictor=3, tile=(8, 4)), f32, ones),
        "half.tif": (tiff(f32.astype(np.float16), ">"), f32.astype(np.float16), ones), "double.tif": (tiff(f32.astype(float)), f32, ones), "grey.tif": (tiff(grey), rgb(grey / 255), ones), "white0.tif": (tiff(grey, photo=0), rgb(1 - grey / 255), ones),
        "four.tif": (tiff(four, bits=4), rgb(four / 15), ones), "one.tif": (tiff(one, bits=1, photo=0), rgb(1 - one / 1), ones), "palette.tif": (tiff(grey, photo=3, colormap=cmap), linear(cmap[grey[..., 0]] / 65535), ones),
    }
    for name, (data, _, _) in cases.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / "pages.tif").write_bytes(tiff(u8, pages=3))
    (tmp_path / "note.txt").write_bytes(b"not read")
    own = rng.random((h, w, 4))
    (tmp_path / "own.tif").write_bytes(lr.encode_tiff(own, 4))
    cases |= {"own.tif": (None, own[..., :3], own[..., 3:])}
    table = lr.blocks(spark, f"file://{tmp_path}")
    got = found(lr.read(table))
    assert {k for k in got if k[0] == "pages.tif"} == {("pages.tif", p) for p in range(3)} and set(got) == {(n, 0) for n in cases} | {("pages.tif", p) for p in range(3)}
    for name, (_, colour, alpha) in cases.items():
        assert len(got[name, 0]) == h * w
        for (x, y), v in got[name, 0].items():
            assert v == pytest.approx((*colour[y, x], alpha[y, x, 0]), abs=1e-6), name
    part = found(lr.read(table.filter("file LIKE '%tiles.TIF'"), Rect(5, 2, 3, 4)))["tiles.TIF", 0]
    assert sorted(part) == [(x, y) for x in range(5, 8) for y in range(2, 6)]
    assert lr.inside(table.filter("file LIKE '%tiles.TIF'"), Rect(5, 2, 3, 4)).count() == 1


def test_one_file_is_read_by_many_tasks(spark, tmp_path, monkeypatch):
    (tmp_path / "wide.tif").write_bytes(lr.encode_tiff(np.random.default_rng(1).random((64, 40, 4)), 2))
    monkeypatch.setattr(lr, "RUN_BYTES", 4096)
    table = lr.blocks(spark, f"file://{tmp_path}")
    assert table.select("run").distinct().count() > 4
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        from pyspark.sql import functions as F

        assert lr.read(table).select(F.spark_partition_id()).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("kind", ["<f2", "<f4"])
def test_exr(spark, tmp_path, kind):
    px = np.random.default_rng(2).random((37, 9, 4)).astype(kind)
    px[:, :4] = np.float16(0.5)
    for packing in lr.EXR_LINES:
        (tmp_path / f"p{packing}.exr").write_bytes(exr(px, packing, kind))
    got = found(lr.read(lr.blocks(spark, f"file://{tmp_path}")))
    assert len(got) == 4
    for image in got.values():
        assert len(image) == 37 * 9
        for (x, y), v in image.items():
            r, g, b, a = px[y - 5, x + 2].astype(float)
            assert v == pytest.approx((r / a, g / a, b / a, a), rel=1e-6)


@pytest.mark.parametrize("data", [b"II", b"GIF8....", tiff(np.zeros((4, 4, 3), np.uint8))[:60], tiff(np.zeros((4, 4, 3), np.uint8))[:-9], tiff(np.zeros((4, 4, 3), np.uint8), photo=5), exr(np.ones((4, 4, 4)), 3, "<f4")[:-20], struct.pack("<2sHI", b"II", 42, 8) + struct.pack("<HI", 0, 8)])
def test_broken_files_are_refused(spark, tmp_path, data):
    (tmp_path / "x.tif").write_bytes(data)
    with pytest.raises(Exception, match="x.tif|KeyError|ValueError|size|cut off"):
        lr.read(lr.blocks(spark, f"file://{tmp_path}")).count()


def test_empty_and_no_files(spark, tmp_path):
    (tmp_path / "x.tif").write_bytes(b"")
    (tmp_path / "y.txt").write_bytes(b"other")
    assert lr.read(lr.blocks(spark, f"file://{tmp_path}")).count() == 0


def test_palette_and_small_depths_of_png():
    chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    for bits in (1, 2, 4, 8):
        at = np.random.default_rng(bits).integers(0, 2**bits, (5, 7))
        table = np.random.default_rng(9).integers(0, 256, (2**bits, 3), np.uint8)
        clear = np.arange(min(3, 2**bits), dtype=np.uint8) * 90
        packed = np.packbits((at[..., None] >> np.arange(bits)[::-1] & 1).astype(np.uint8).reshape(5, -1), axis=1)
        raw = b"".join(b"\0" + r.tobytes() for r in packed)
        file = lambda kind, extra: png.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", 7, 5, bits, kind, 0, 0, 0)) + extra + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
        alpha = np.full(2**bits, 255, np.uint8)
        alpha[: len(clear)] = clear
        assert (png.decode(file(3, chunk(b"PLTE", table.tobytes()) + chunk(b"tRNS", clear.tobytes()))) == np.dstack((table[at], alpha[at]))).all()
        assert (png.decode(file(0, b""))[..., 0] == at * (255 // (2**bits - 1))).all()
        with pytest.raises(ValueError, match="palette"):
            png.decode(file(3, b""))
