"""Colour profiles made here, against formulas written out by hand."""

import struct
import zlib

import numpy as np
import pytest

from tilestrata.sources import icc, png

SRGB_CURVE = b"para\0\0\0\0" + struct.pack(">HH5i", 3, 0, *(round(v * 65536) for v in (2.4, 1 / 1.055, 0.055 / 1.055, 1 / 12.92, 0.04045)))
WIDE = ((0.64, 0.33), (0.21, 0.71), (0.15, 0.06))
PX = "id int, r double, g double, b double, a double, `x.y` string"


def decode(v):
    return np.where(v <= 0.04045, v / 12.92, ((v + 0.055) / 1.055) ** 2.4)


def colours(n=200):
    rgb = np.random.default_rng(5).random((n, 3))
    rgb[:4] = [[0, 0, 0], [1, 1, 1], [0, 1, 0], [0.5, 0.5, 0.5]]
    return rgb


def relation(spark, rgb):
    return spark.createDataFrame([(i, *map(float, c), 0.25, "kept") for i, c in enumerate(rgb)], PX)


def values(df):
    rows = sorted(df.collect(), key=lambda r: r["id"])
    assert {(r["a"], r["x.y"]) for r in rows} == {(0.25, "kept")}
    return np.array([[r[c] for c in "rgb"] for r in rows])


def test_the_working_space_matrix():
    assert icc.WORKING @ np.ones(3) == pytest.approx(icc.WHITE, abs=2e-4)
    want = [[0.4360747, 0.3850649, 0.1430804], [0.2225045, 0.7168786, 0.0606169], [0.0139322, 0.0971045, 0.7141733]]
    assert icc.WORKING == pytest.approx(np.array(want), abs=4e-4)


def test_matrix_profiles(spark):
    rgb = colours()
    own = icc.matrix_profile(icc.PRIMARIES, icc.D65, SRGB_CURVE)
    assert values(icc.to_working(relation(spark, rgb), own)) == pytest.approx(decode(rgb), abs=1e-3)
    wide = icc.matrix_profile(WIDE, icc.D65, icc.power_curve(2.2))
    to_wide = np.linalg.inv(icc.WORKING) @ icc.primaries_matrix(WIDE, icc.D65)
    want = rgb ** (563 / 256) @ to_wide.T
    got = icc.to_working(relation(spark, rgb), wide)
    assert values(got) == pytest.approx(want, abs=1e-3)
    assert icc.parse(wide).to_working(rgb) == pytest.approx(want, abs=1e-3)
    assert want[2][0] < -0.1 and values(got)[2][0] < -0.1  # out of the working space's range, and kept
    assert values(icc.from_working(got, wide)) == pytest.approx(rgb, abs=1e-3)
    assert values(icc.convert(relation(spark, rgb), own, own)).tolist() == rgb.tolist()
    assert values(icc.convert(relation(spark, rgb[:, :]), own, wide)) == pytest.approx(np.clip(decode(rgb) @ np.linalg.inv(to_wide).T, 0, 1) ** (256 / 563), abs=2e-3)
    assert values(icc.convert(relation(spark, rgb), None, None)).tolist() == rgb.tolist()


def test_table_curves_and_grey(spark):
    table = [round(65535 * (i / 1023) ** 1.8) for i in range(1024)]
    curve = b"curv\0\0\0\0" + struct.pack(">I1024H", 1024, *table)
    rgb = colours()
    got = values(icc.to_working(relation(spark, rgb), icc.matrix_profile(icc.PRIMARIES, icc.D65, curve)))
    assert got == pytest.approx(rgb**1.8, abs=1e-3)
    back = icc.from_working(icc.to_working(relation(spark, rgb), icc.matrix_profile(icc.PRIMARIES, icc.D65, curve)), icc.matrix_profile(icc.PRIMARIES, icc.D65, curve))
    assert values(back)[(rgb > 0.02).all(axis=1)] == pytest.approx(rgb[(rgb > 0.02).all(axis=1)], abs=1e-3)
    grey = struct.pack(">I4sI4s4s4s12s4s", 0, b"none", 0, b"mntr", b"GRAY", b"XYZ ", b"\0" * 12, b"acsp").ljust(128, b"\0") + struct.pack(">I4sII", 1, b"kTRC", 144, 14) + icc.power_curve(2.0)
    assert values(icc.to_working(relation(spark, rgb), grey)) == pytest.approx(np.repeat(rgb[:, :1] ** 2, 3, axis=1), abs=1e-9)


def lattice(wide, lab):
    """A lattice profile whose values are those of the working space, its curves square roots of what goes in."""
    side, top, form = 9, 65535 if wide else 255, ">u2" if wide else ">u1"
    axis = np.linspace(0, 1, side)
    grid = np.stack(np.meshgrid(axis, axis, axis, indexing="ij"), axis=-1).reshape(-1, 3)
    xyz = grid @ icc.WORKING.T
    if lab:
        f = np.where(xyz / icc.WHITE > (6 / 29) ** 3, np.cbrt(xyz / icc.WHITE), xyz / icc.WHITE / (3 * (6 / 29) ** 2) + 4 / 29)
        pcs = np.column_stack((116 * f[:, 1] - 16, 500 * (f[:, 0] - f[:, 1]), 200 * (f[:, 1] - f[:, 2])))
        pcs = np.column_stack((pcs[:, 0] / 100, (pcs[:, 1] + 128) / 255, (pcs[:, 2] + 128) / 255)) * (65280 / 65535 if wide else 1)
    else:
        pcs = xyz / (1 + 32767 / 32768)
    curve = np.linspace(0, 1, 256) ** 2
    straight = np.linspace(0, 1, 256)
    values = np.concatenate([np.tile(curve, 3), pcs.ravel(), np.tile(straight, 3)])
    data = (b"mft2" if wide else b"mft1") + b"\0" * 4 + bytes([3, 3, side, 0]) + b"\0" * 36 + (struct.pack(">HH", 256, 256) if wide else b"") + np.round(values * top).astype(form).tobytes()
    head = struct.pack(">I4sI4s4s4s12s4s", 0, b"none", 0, b"mntr", b"RGB ", b"Lab " if lab else b"XYZ ", b"\0" * 12, b"acsp").ljust(128, b"\0")
    return head + struct.pack(">I4sII", 1, b"A2B0", 144, len(data)) + data


@pytest.mark.parametrize(("wide", "lab", "near"), [(True, False, 1e-3), (True, True, 0.03), (False, False, 0.02)])
def test_lattice_profiles(spark, wide, lab, near):
    rgb = colours()
    got = values(icc.to_working(relation(spark, rgb), lattice(wide, lab)))
    assert got == pytest.approx(rgb**2, abs=near)
    with pytest.raises(ValueError, match="matrix"):
        icc.from_working(relation(spark, rgb), lattice(wide, lab))


def test_tetrahedra_are_exact_on_planes_and_corners():
    rng = np.random.default_rng(7)
    grid = rng.random((5, 5, 5, 3))
    nodes = rng.integers(0, 5, (50, 3))
    assert icc.tetrahedral(grid, nodes / 4) == pytest.approx(grid[tuple(nodes.T)])
    axis = np.linspace(0, 1, 5)
    plane = np.stack(np.meshgrid(axis, axis, axis, indexing="ij"), axis=-1) @ np.array([[1.0], [2.0], [-0.5]])
    at = rng.random((100, 3))
    assert icc.tetrahedral(plane, at)[:, 0] == pytest.approx(at @ [1.0, 2.0, -0.5])
    # in one tetrahedron r > g > b the value is the sum along its edges
    c = grid[:2, :2, :2]
    r, g, b = 0.9, 0.6, 0.2
    want = c[0, 0, 0] + r * (c[1, 0, 0] - c[0, 0, 0]) + g * (c[1, 1, 0] - c[1, 0, 0]) + b * (c[1, 1, 1] - c[1, 1, 0])
    assert icc.tetrahedral(grid, np.array([[r / 4, g / 4, b / 4]]))[0] == pytest.approx(want)


def test_odd_values_and_broken_profiles(spark):
    own = icc.matrix_profile(icc.PRIMARIES, icc.D65, icc.power_curve(2.0))
    df = spark.createDataFrame([(0, float("nan"), None, 2.0, 0.25, "kept"), (1, -1.0, 0.5, 1.0, 0.25, "kept")], PX)
    assert values(icc.to_working(df, own)) == pytest.approx(np.array([[0, 0, 1], [0, 0.25, 1]]), abs=1e-3)
    assert icc.to_working(df.limit(0), lattice(True, False)).count() == 0
    falling = b"curv\0\0\0\0" + struct.pack(">I4H", 4, 65535, 100, 50, 0)
    with pytest.raises(ValueError, match="inverted"):
        icc.from_working(df, icc.matrix_profile(icc.PRIMARIES, icc.D65, falling))
    for bad in (b"", b"x" * 200, own[:150], own[:-8], own.replace(b"RGB ", b"CMYK"), own.replace(b"curv", b"what"), own.replace(b"rTRC", b"zTRC")):
        with pytest.raises(ValueError):
            icc.parse(bad)


def test_images_with_profiles(spark, tmp_path):
    rgb = np.random.default_rng(1).integers(0, 256, (6, 5, 4), np.uint8)
    plain = png.encode(rgb)
    chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    profile = icc.matrix_profile(WIDE, icc.D65, icc.power_curve(2.2))
    (tmp_path / "plain.png").write_bytes(plain)
    (tmp_path / "wide.png").write_bytes(plain[:33] + chunk(b"iCCP", b"name\0\0" + zlib.compress(profile)) + plain[33:])
    assert png.profile_of(plain) is None and png.profile_of((tmp_path / "wide.png").read_bytes()) == profile
    got = {(r["name"], r["x"], r["y"]): (r["r"], r["g"], r["b"], r["a"]) for r in png.read_images(spark, f"file://{tmp_path}").collect()}
    want = icc.parse(profile).to_working(rgb[..., :3].reshape(-1, 3) / 255).reshape(6, 5, 3)
    for y in range(6):
        for x in range(5):
            assert got["wide", x, y] == pytest.approx((*want[y, x], rgb[y, x, 3] / 255), abs=1e-9)
            assert got["plain", x, y] == pytest.approx((*decode(rgb[y, x, :3] / 255), rgb[y, x, 3] / 255), abs=1e-9)
    with pytest.raises(ValueError, match="iCCP"):
        png.profile_of(plain[:33] + chunk(b"iCCP", b"name\0\1" + zlib.compress(profile)) + plain[33:])
    with pytest.raises(ValueError, match="iCCP"):
        png.profile_of(plain[:33] + chunk(b"iCCP", b"noend") + plain[33:])
