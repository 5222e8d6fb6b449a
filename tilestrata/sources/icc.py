"""Colour profiles: tag tables, tone curves, matrices and lattices, to and from the working space (linear light of the sRGB primaries).

Profiles of RGB and grey with a matrix or one curve become column expressions: a formula, or a sorted table with linear interpolation, for each channel and one
3 x 3 matrix. Profiles with a lattice (A2B0 of 8 or 16 bits) are interpolated in tetrahedra by a kernel over Arrow batches. Alpha is never touched.

Defined results: bytes that are no profile, cut-off tags, other colour spaces than RGB and grey, and tables that fall, where an inverse is
asked for, raise; channels are clamped to 0..1 before a curve or lattice and left as they come out of it; null and NaN count as 0; None is the working space.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilestrata.functions.color import clamp01

#: Chromaticities of the sRGB primaries and of the working space's white point (fixed values).
PRIMARIES = ((0.64, 0.33), (0.30, 0.60), (0.15, 0.06))
D65 = (0.3127, 0.3290)
#: The white of profiles (D50) as they state it, and the Bradford cone responses (fixed values).
WHITE = np.array([0.9642, 1.0, 0.8249])
BRADFORD = np.array([[0.8951, 0.2664, -0.1614], [-0.7502, 1.7135, 0.0367], [0.0389, -0.0685, 1.0296]])
MAX_PROFILE = 16 << 20
#: Numbers of a parametric curve by its type (fixed values of the format).
PARAMETERS = (1, 3, 4, 5, 7)


def _xyz(x: float, y: float) -> np.ndarray:
    return np.array([x / y, 1.0, (1 - x - y) / y])


def primaries_matrix(primaries=PRIMARIES, white=D65) -> np.ndarray:
    """Linear RGB of primaries and a white point to XYZ of the profiles' white (D50)."""
    cols = np.column_stack([_xyz(*p) for p in primaries])
    own = cols * np.linalg.solve(cols, _xyz(*white))
    cones = BRADFORD @ _xyz(*white), BRADFORD @ WHITE
    return np.linalg.inv(BRADFORD) @ np.diag(cones[1] / cones[0]) @ BRADFORD @ own


WORKING = primaries_matrix()


@dataclass(frozen=True)
class Curve:
    """A tone curve: a table (one value is a power), or numbers of a parametric form (g, a, b, c, d, e, f): (a x + b) ^ g + e from d on, c x + f below."""

    table: tuple[float, ...] = ()
    form: tuple[float, ...] = ()

    def parts(self) -> tuple[float, ...]:
        if self.form:
            return self.form
        g = self.table[0] if len(self.table) == 1 else 1.0
        return (g, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0)

    def column(self, x: Column) -> Column:
        x = clamp01(x)
        if len(self.table) > 1:
            return _looked_up(x, self.table)
        g, a, b, c, d, e, f = self.parts()
        return F.when(x >= d, F.pow(F.greatest(a * x + b, F.lit(0.0)), F.lit(g)) + e).otherwise(c * x + f)

    def apply(self, x: np.ndarray) -> np.ndarray:
        x = np.clip(np.nan_to_num(x), 0, 1)
        if len(self.table) > 1:
            return np.interp(x, np.linspace(0, 1, len(self.table)), self.table)
        g, a, b, c, d, e, f = self.parts()
        return np.where(x >= d, np.maximum(a * x + b, 0) ** g + e, c * x + f)

    def inverse(self) -> "Curve":
        """As a table of 4,096 values, exact at its nodes; powers stay powers."""
        if not self.form and len(self.table) <= 1:
            return Curve((1 / (self.table[0] if self.table else 1.0),))
        x = np.linspace(0, 1, 1 << 14)
        y = self.apply(x)
        if (np.diff(y) < 0).any() or y[-1] <= y[0]:
            raise ValueError("the tone curve can't be inverted")
        return Curve(tuple(np.interp(np.linspace(0, 1, 4096), y, x).tolist()))


def _looked_up(x: Column, table: tuple[float, ...]) -> Column:
    n = len(table) - 1
    values = F.lit([float(v) for v in table])
    at = F.least(F.floor(x * n), F.lit(n - 1)).cast("int")
    low = F.get(values, at)
    return low + (F.get(values, at + 1) - low) * (x * n - at)


@dataclass(frozen=True)
class Lattice:
    """A table over a grid: curves before it, and Lab or XYZ after it."""

    before: tuple[Curve, ...]
    grid: np.ndarray  # (n, ..., n, 3)
    after: tuple[Curve, ...]
    lab: bool
    wide: bool  # 16 bits, where Lab's whites are 0xFF00

    def xyz(self, px: np.ndarray) -> np.ndarray:
        at = np.column_stack([c.apply(px[:, i]) for i, c in enumerate(self.before)])
        out = tetrahedral(self.grid, at)
        out = np.column_stack([c.apply(out[:, i]) for i, c in enumerate(self.after)])
        if not self.lab:
            return out * (1 + 32767 / 32768)
        scale = 65535 / 65280 if self.wide else 1.0
        light, a, b = out[:, 0] * 100 * scale, *(out[:, i] * 255 * scale - 128 for i in (1, 2))
        fy = (light + 16) / 116
        f = np.column_stack((fy + a / 500, fy, fy - b / 200))
        return np.where(f > 6 / 29, f**3, 3 * (6 / 29) ** 2 * (f - 4 / 29)) * WHITE


def tetrahedral(grid: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Values of a grid (n, n, n, k) at places in 0..1: along the channels in order of their fractions, largest first."""
    n = grid.shape[0] - 1
    p = np.clip(at, 0, 1) * n
    low = np.minimum(np.floor(p).astype(np.int64), max(n - 1, 0))
    part = p - low
    order = np.argsort(-part, axis=1, kind="stable")
    rows = np.arange(len(at))
    corner, out = low.copy(), None
    before = grid[tuple(corner.T)]
    out = before.copy()
    for k in range(at.shape[1]):
        axis = order[:, k]
        corner[rows, axis] = np.minimum(corner[rows, axis] + 1, n)
        here = grid[tuple(corner.T)]
        out += (here - before) * part[rows, axis][:, None]
        before = here
    return out


@dataclass(frozen=True)
class Profile:
    """What a profile does to a colour: curves and a matrix to XYZ, or a lattice."""

    space: str
    curves: tuple[Curve, ...] = ()
    matrix: np.ndarray | None = None
    lattice: Lattice | None = None

    def to_working(self, rgb: np.ndarray) -> np.ndarray:
        """(n, 3) of device values to the working space."""
        if self.lattice is not None:
            return self.lattice.xyz(rgb[:, : len(self.lattice.before)]) @ np.linalg.inv(WORKING).T
        lin = np.column_stack([c.apply(rgb[:, i]) for i, c in enumerate(self.curves)])
        return np.repeat(lin, 3, axis=1) if self.space == "GRAY" else lin @ (np.linalg.inv(WORKING) @ self.matrix).T


def _curve(data: bytes) -> tuple[Curve, int]:
    """A curve and its length in bytes."""
    kind = data[:4]
    if kind == b"curv":
        n = struct.unpack(">I", data[8:12])[0]
        values = struct.unpack(f">{n}H", data[12 : 12 + 2 * n])
        return Curve((values[0] / 256.0,) if n == 1 else tuple(v / 65535.0 for v in values)), 12 + 2 * n
    if kind == b"para":
        form = struct.unpack(">H", data[8:10])[0]
        if form >= len(PARAMETERS):
            raise ValueError("unknown kind of tone curve")
        n = PARAMETERS[form]
        v = [x / 65536.0 for x in struct.unpack(f">{n}i", data[12 : 12 + 4 * n])]
        g, a, b, c, d, e, f = v[0], 1.0, 0.0, 0.0, 0.0, 0.0, 0.0
        if form >= 1:
            a, b = v[1:3]
            d = -b / a if a else 0.0
        if form == 2:
            e = f = v[3]
        if form >= 3:
            c, d = v[3:5]
        if form == 4:
            e, f = v[5:7]
        return Curve(form=(g, a, b, c, d, e, f)), 12 + 4 * n
    raise ValueError("unknown kind of tone curve")


def _lattice(data: bytes, pcs: str) -> Lattice:
    kind = data[:4]
    if kind not in (b"mft1", b"mft2"):
        raise ValueError("only lattices of 8 and 16 bits are supported")
    wide = kind == b"mft2"
    n_in, n_out, side = data[8], data[9], data[10]
    if n_out != 3 or n_in not in (1, 3) or side < 2:
        raise ValueError("only lattices of one or three channels are supported")
    e_in, e_out = struct.unpack(">HH", data[48:52]) if wide else (256, 256)
    counts = (n_in * e_in, side**n_in * n_out, n_out * e_out)
    form, top, at = (">u2", 65535.0, 52) if wide else (">u1", 255.0, 48)
    values = np.frombuffer(data, form, sum(counts), at) / top
    before, grid, after = np.split(values, np.cumsum(counts)[:2])
    cut = lambda v, n: tuple(Curve(tuple(x.tolist())) for x in v.reshape(n, -1))
    return Lattice(cut(before, n_in), grid.reshape(*[side] * n_in, n_out), cut(after, n_out), pcs == "Lab ", wide)


def parse(data: bytes) -> Profile:
    """A profile from its bytes."""
    try:
        return _parse(data)
    except (struct.error, IndexError, KeyError) as e:
        raise ValueError("the colour profile is cut off") from e


def _parse(data: bytes) -> Profile:
    if len(data) < 132 or len(data) > MAX_PROFILE or data[36:40] != b"acsp":
        raise ValueError("this is no colour profile")
    space, pcs = data[16:20].decode("latin-1").strip(), data[20:24].decode("latin-1")
    if space not in ("RGB", "GRAY") or pcs not in ("XYZ ", "Lab "):
        raise ValueError(f"colour profiles of {space} are not supported")
    tags = {}
    for k in range(struct.unpack(">I", data[128:132])[0]):
        name, at, n = struct.unpack(">4sII", data[132 + 12 * k : 144 + 12 * k])
        if at + n > len(data):
            raise ValueError("the colour profile is cut off")
        tags[name.decode("latin-1")] = data[at : at + n]
    if "A2B0" in tags:
        return Profile(space, lattice=_lattice(tags["A2B0"], pcs))
    if space == "GRAY":
        return Profile(space, (_curve(tags["kTRC"])[0],))
    matrix = np.column_stack([[v / 65536.0 for v in struct.unpack(">3i", tags[c + "XYZ"][8:20])] for c in "rgb"])
    return Profile(space, tuple(_curve(tags[c + "TRC"])[0] for c in "rgb"), matrix)


def matrix_profile(primaries, white, curve: bytes) -> bytes:
    """A profile's bytes from chromaticities and the bytes of one curve."""
    fixed = lambda v: struct.pack(">i", round(v * 65536))
    body = {c + "XYZ": b"XYZ \0\0\0\0" + b"".join(map(fixed, col)) for c, col in zip("rgb", primaries_matrix(primaries, white).T, strict=True)}
    body |= {c + "TRC": curve.ljust(-(-len(curve) // 4) * 4, b"\0") for c in "rgb"}
    at, table, data = 132 + 12 * len(body), b"", b""
    for name, x in body.items():
        table += struct.pack(">4sII", name.encode(), at + len(data), len(x))
        data += x
    head = struct.pack(">I4sI4s4s4s12s4s", at + len(data), b"none", 0x02100000, b"mntr", b"RGB ", b"XYZ ", b"\0" * 12, b"acsp").ljust(128, b"\0")
    return head + struct.pack(">I", len(body)) + table + data


def power_curve(gamma: float) -> bytes:
    return b"curv\0\0\0\0" + struct.pack(">IH", 1, round(gamma * 256))


def _mixed(m: np.ndarray, rgb: list[Column]) -> list[Column]:
    return [sum((float(m[i, j]) * rgb[j] for j in range(1, 3)), float(m[i, 0]) * rgb[0]) for i in range(3)]


def to_working(px: DataFrame, profile: bytes | None) -> DataFrame:
    """px (..., r, g, b, ...) of a profile's device values, in the working space."""
    if profile is None:
        return px
    p = parse(profile)
    if p.lattice is not None:
        return _kernel(px, profile)
    rgb = [F.col(c) for c in "rgb"]
    if p.space == "GRAY":
        return px.withColumns(dict.fromkeys("rgb", p.curves[0].column(rgb[0])))
    lin = [c.column(x) for c, x in zip(p.curves, rgb, strict=True)]
    return px.withColumns(dict(zip("rgb", _mixed(np.linalg.inv(WORKING) @ p.matrix, lin), strict=True)))


def from_working(px: DataFrame, profile: bytes | None) -> DataFrame:
    """px of the working space as device values of a profile with a matrix."""
    if profile is None:
        return px
    p = parse(profile)
    if p.lattice is not None or p.space != "RGB":
        raise ValueError("only profiles with a matrix can be written to")
    lin = _mixed(np.linalg.inv(p.matrix) @ WORKING, [F.coalesce(F.nanvl(F.col(c), F.lit(0.0)), F.lit(0.0)) for c in "rgb"])
    return px.withColumns({k: c.inverse().column(x) for k, c, x in zip("rgb", p.curves, lin, strict=True)})


def convert(px: DataFrame, source: bytes | None, target: bytes | None) -> DataFrame:
    """px from one profile to another."""
    return px if source == target else from_working(to_working(px, source), target)


def _kernel(px: DataFrame, profile: bytes) -> DataFrame:
    send = px.sparkSession.sparkContext.broadcast(profile)
    rows = px.select(F.struct(*[F.col(f"`{c}`") for c in px.columns]).alias("row"), *[F.col(c).cast("double") for c in "rgb"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = parse(send.value)
        for b in batches:
            rgb = np.column_stack([np.nan_to_num(b.column(c).to_numpy(zero_copy_only=False).astype(float)) for c in "rgb"])
            out = p.to_working(rgb)
            yield pa.RecordBatch.from_arrays([b.column("row"), *(pa.array(np.ascontiguousarray(out[:, i])) for i in range(3))], names=["row", *"rgb"])

    done = rows.mapInArrow(run, rows.schema)
    return done.select(*[F.col(c) if c in "rgb" else F.col(f"row.`{c}`").alias(c) for c in px.columns])
