"""Files of every format, made here, opened again."""

import gzip
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilestrata.operators.tiles import Rect
from tilestrata.plans import history as h
from tilestrata.plans.tree import Layer, LayerTree
from tilestrata.sources import formats, native, openraster, png, psd, svg

PX = "layer_id int, x int, y int, r double, g double, b double, a double"


def packed(row):
    """Literal runs and one repeat, as the format has them."""
    if len(set(row)) == 1 and len(row) > 1:
        return bytes([257 - len(row), row[0]])
    return bytes([len(row) - 1]) + bytes(row)


def psd_file(layers, w, h, compression):
    records, pixels = b"", b""
    for name, (x, y), px, opacity, hidden in layers:
        lh, lw = px.shape[:2]
        channels = b""
        for kind, k in ((0, 0), (1, 1), (2, 2), (-1, 3)):
            rows = [px[i, :, k].tolist() for i in range(lh)]
            if compression == 0:
                body = struct.pack(">H", 0) + bytes(v for r in rows for v in r)
            else:
                runs = [packed(r) for r in rows]
                body = struct.pack(">H", 1) + b"".join(struct.pack(">H", len(r)) for r in runs) + b"".join(runs)
            channels += struct.pack(">hI", kind, len(body))
            pixels += body
        label = bytes([len(name)]) + name.encode()
        label += b"\0" * (-len(label) % 4)
        extra = struct.pack(">I", 0) * 2 + label
        records += struct.pack(">iiiiH", y, x, y + lh, x + lw, 4) + channels + b"8BIMmul " + bytes([opacity, 0, 2 if hidden else 0, 0]) + struct.pack(">I", len(extra)) + extra
    info = struct.pack(">h", len(layers)) + records + pixels
    info += b"\0" * (len(info) % 2)
    whole = struct.pack(">I", len(info)) + info + struct.pack(">I", 0)
    return b"8BPS" + struct.pack(">H6xHIIHH", 1, 3, h, w, 8, 3) + struct.pack(">II", 0, 0) + struct.pack(">I", len(whole)) + whole


@pytest.mark.parametrize("compression", [0, 1])
def test_psd(spark, tmp_path, compression):
    rng = np.random.default_rng(1)
    a, b = rng.integers(1, 256, (3, 4, 4), np.uint8), np.full((2, 2, 4), 128, np.uint8)
    data = psd_file([("base", (0, 0), a, 255, False), ("</Layer group>", (0, 0), b, 255, False), ("top", (-1, 2), b, 51, True)], 9, 7, compression)
    (tmp_path / "x.PSD").write_bytes(data)
    doc = formats.open_document(spark, f"file://{tmp_path}/x.PSD")
    assert doc.canvas == Rect(0, 0, 9, 7)
    base, top = doc.tree.children(None)
    assert (base.name, base.opacity, base.visible) == ("base", 1.0, True) and (top.name, top.opacity, top.visible, top.dx, top.dy, top.blend) == ("top", 0.2, False, -1, 2, "normal")
    rows = {(r["layer_id"], r["x"], r["y"]): r for r in doc.pixels.collect()}
    assert len(rows) == 16 and rows[1, 2, 1]["a"] == pytest.approx(a[1, 2, 3] / 255)
    assert rows[2, 0, 0]["r"] == pytest.approx(((128 / 255 + 0.055) / 1.055) ** 2.4)
    for bad in (data[:40], b"nothing", data.replace(b"8BPS", b"9BPS")):
        with pytest.raises(psd.PsdError):
            psd.parse(bad)


DRAWING = """<svg xmlns="http://www.w3.org/2000/svg" width="1in" height="48">
<rect x="2" y="3" width="10" height="6" fill="#f00"/><circle cx="40" cy="20" r="8" style="fill:none;stroke:blue;stroke-width:2"/>
<path d="M10 20 h5 v5 H10 z m20 0 C 30 30 45 30 45 20 S 60 10 60 20" fill="none" stroke="#00ff00" stroke-opacity="0.5"/>
<g><rect width="5" height="5"/></g><rect width="9" height="9" display="none"/><polygon points="50,30 60,30 55,40" opacity="0.5"/><line x1="0" y1="0" x2="9" y2="9"/></svg>"""


def test_svg(spark, tmp_path):
    (tmp_path / "d.svgz").write_bytes(gzip.compress(DRAWING.encode()))
    doc = formats.open_document(spark, f"file://{tmp_path}/d.svgz")
    assert doc.canvas == Rect(0, 0, 96, 48)
    size, paths = svg.parse(DRAWING.encode())
    assert size == (96, 48) and len(paths) == 7
    assert paths[0]["vertices"] == [(2, 3), (12, 3), (12, 9), (2, 9)] and paths[0]["fill"] == (1.0, 0.0, 0.0, 1.0) and paths[0]["width"] == 0
    assert paths[1]["fill"] == svg.CLEAR and paths[1]["stroke"][2] == 1.0 and paths[1]["width"] == 2
    assert paths[2]["vertices"] == [(10, 20), (15, 20), (15, 25), (10, 25)] and paths[2]["closed"] and not paths[3]["closed"]
    assert paths[3]["vertices"][0] == (30, 20) and paths[3]["vertices"][-1] == (60, 20) and paths[3]["stroke"][3] == 0.5
    red = doc.pixels.filter("r = 1 and g = 0 and b = 0").agg(F.count("*"), F.min("x"), F.max("y")).first()
    assert tuple(red) == (54, 2, 8)  # less what the later rectangle of the group covers
    for bad in ("<svg", "<svg width='0' height='0'/>", "<svg width='4' height='4'><path d='L 3 3'/></svg>"):
        with pytest.raises(svg.SvgError):
            svg.parse(bad.encode())
    with pytest.raises(svg.SvgError):
        svg.parse(DRAWING.encode(), dpi=9000)


def test_open_raster_and_png(spark, tmp_path):
    px = spark.createDataFrame([(1, 0, 0, 1.0, 0.0, 0.0, 1.0), (1, 3, 2, 0.0, 1.0, 0.0, 1.0), (2, 1, 1, 0.0, 0.0, 1.0, 1.0)], PX)
    layers = [Layer(1, name="a"), Layer(2, index=1, name="b", blend="screen", opacity=0.5, visible=False, dx=4)]
    (tmp_path / "o.Ora").write_bytes(openraster.write(px, layers, Rect(0, 0, 8, 8)))
    doc = formats.open_document(spark, f"file://{tmp_path}/o.Ora")
    a, b = doc.tree.children(None)
    assert (b.name, b.blend, b.opacity, b.visible, b.dx, b.dy) == ("b", "screen", 0.5, False, 5, 1) and a.dx == 0
    assert doc.pixels.count() == 3 and doc.canvas == Rect(0, 0, 8, 8)
    (tmp_path / "i.png").write_bytes(png.encode(np.full((2, 3, 4), 255, np.uint8)))
    image = formats.open_document(spark, f"file://{tmp_path}/i.png")
    assert image.canvas == Rect(0, 0, 3, 2) and image.tree.children(None)[0].name == "i" and image.pixels.count() == 6


def test_formats_go_by_extension():
    assert [formats.format_of(p) for p in ("/a/B.ORA", "x.psd", "x.SvgZ", "doc.ts/", "x.png", "none", "a.psd.jpg")] == ["ora", "psd", "svg", "native", "raster", "raster", "raster"]


def test_snapshots_are_pruned_and_recovered(spark, tmp_path):
    folder = f"file://{tmp_path}/auto"
    assert native.recover(spark, folder) is None
    for k in range(3):
        px = spark.createDataFrame([(1, k, 0, 1.0, 0.0, 0.0, 1.0)], PX)
        native.autosave(h.Document(Rect(0, 0, 8, 8), LayerTree([Layer(1)]), px, spark.createDataFrame([], "layer_id int, x int, y int, cov double")), folder, k, keep=2)
    assert [p.rpartition("/")[2] for p in native.snapshots(spark, folder)] == [f"v{k:020d}" for k in (2, 1)]
    assert native.recover(spark, folder).pixels.first()["x"] == 2
