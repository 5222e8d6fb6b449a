"""Dense documents as tiles: one row for each layer's tile, composited and filtered by array kernels.

A tile is (layer_id, tx, ty, px): 256 x 256 straight RGBA values of four bytes, row by row. Spark deals tiles out by (tx, ty); a task sees all layers
of one tile at a time, so its memory is that of one tile's stack. Where tiles are stored or cached by (tx, ty), no shuffle is
needed. Row relations (operators, plans/compositor.py) remain the general form, for sparse pixels, masks and adjustments; tests hold both against each other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilestrata.operators.raster import RGBA
from tilestrata.operators.stencil import gaussian_weights
from tilestrata.operators.tiles import TILE, Rect, tile_of
from tilestrata.plans.tree import LayerTree

SCHEMA = "layer_id int, tx int, ty int, px binary"
SHAPE = (TILE, TILE, 4)
ROWS = "x int, y int, r float, g float, b float, a float"


def to_tiles(px: DataFrame) -> DataFrame:
    """Tiles of pixels (layer_id, x, y, r, g, b, a)."""

    def run(key, rows):
        out = np.zeros(SHAPE, np.float32)
        at = rows["y"].to_numpy() & (TILE - 1), rows["x"].to_numpy() & (TILE - 1)
        for i, c in enumerate(RGBA):
            out[(*at, i)] = rows[c].to_numpy()
        layer, tx, ty = (k.as_py() for k in key)
        return table([layer], [tx], [ty], [out])

    keyed = px.select("layer_id", tile_of(F.col("x")).alias("tx"), tile_of(F.col("y")).alias("ty"), "x", "y", *RGBA)
    return keyed.groupBy("layer_id", "tx", "ty").applyInArrow(run, SCHEMA)


def to_rows(tiles: DataFrame) -> DataFrame:
    """Non-empty pixels (x, y, r, g, b, a) of tiles (tx, ty, px)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for tx, ty, px in zip(b.column("tx").to_pylist(), b.column("ty").to_pylist(), b.column("px"), strict=True):
                a = array(px)
                y, x = np.nonzero(a.any(axis=2))
                yield pa.RecordBatch.from_arrays([pa.array((tx * TILE + x).astype(np.int32)), pa.array((ty * TILE + y).astype(np.int32)), *[pa.array(a[y, x, i]) for i in range(4)]], names=["x", "y", *RGBA])

    return tiles.select("tx", "ty", "px").mapInArrow(run, ROWS)


def dealt(tiles: DataFrame) -> DataFrame:
    """Tiles of one place together and in order, as the kernels want them; store or cache this once."""
    return tiles.repartition("tx", "ty").sortWithinPartitions("tx", "ty")


def array(px: pa.Scalar) -> np.ndarray:
    return np.frombuffer(px.as_buffer(), np.float32).reshape(SHAPE)


def table(layer: list, tx: list, ty: list, px: list[np.ndarray]) -> pa.Table:
    data = pa.array([np.ascontiguousarray(p, np.float32).tobytes() for p in px], pa.binary())
    return pa.table([pa.array(layer, pa.int32()), pa.array(tx, pa.int32()), pa.array(ty, pa.int32()), data], names=["layer_id", "tx", "ty", "px"])


def pointwise(tiles: DataFrame, change: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Tiles with a function of (256, 256, 4) arrays applied; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            px = pa.array([np.ascontiguousarray(change(array(p)), np.float32).tobytes() for p in b.column("px")], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("layer_id"), b.column("tx"), b.column("ty"), px], names=["layer_id", "tx", "ty", "px"])

    return tiles.select("layer_id", "tx", "ty", "px").mapInArrow(run, SCHEMA)


def _mix(mode: str, d: np.ndarray, s: np.ndarray) -> np.ndarray:
    """The separable blend of colours d (below) and s."""
    one = np.float32(1)
    if mode == "normal":
        return s
    if mode == "multiply":
        return d * s
    if mode == "screen":
        return d + s - d * s
    if mode in ("overlay", "hard-light"):
        return np.where((d if mode == "overlay" else s) <= 0.5, 2 * d * s, one - 2 * (one - d) * (one - s))
    if mode == "darken":
        return np.minimum(d, s)
    if mode == "lighten":
        return np.maximum(d, s)
    if mode == "color-dodge":
        return np.where(s >= 1, one, np.clip(d / np.where(s >= 1, one, one - s), 0, 1))
    if mode == "color-burn":
        return np.where(s <= 0, np.float32(0), np.clip(one - (one - d) / np.where(s <= 0, one, s), 0, 1))
    if mode == "soft-light":
        d = np.clip(d, 0, 1)
        return np.where(s <= 0.5, d - (one - 2 * s) * d * (one - d), d + (2 * s - one) * (np.sqrt(d) - d))
    if mode == "difference":
        return np.abs(d - s)
    if mode == "exclusion":
        return d + s - 2 * d * s
    if mode == "add":
        return d + s
    raise ValueError(f"unknown blend mode {mode!r}")


def _over(mode: str, acc: np.ndarray, src: np.ndarray, opacity: float) -> None:
    """src (straight) over acc, whose colours carry their alpha; acc changes."""
    if np.isnan(src.sum()):
        src = np.nan_to_num(src, nan=0.0)
    sa = np.clip(src[..., 3] * np.float32(opacity), 0, 1)[..., None]
    add = src * sa
    add[..., 3] = sa[..., 0]
    if mode != "normal":
        da, s = acc[..., 3:], src[..., :3]
        add[..., :3] += sa * da * (_mix(mode, acc[..., :3] / np.where(da > 0, da, 1), s) - s)
    acc *= 1 - sa
    acc += add
    np.minimum(acc[..., 3], 1, out=acc[..., 3])


def _straight(acc: np.ndarray) -> np.ndarray:
    a = acc[..., 3:]
    acc[..., :3] /= np.where(a > 0, a, 1)
    return acc


def can_composite(tree: LayerTree) -> bool:
    """Whether all layers that can show are rasters and groups."""
    return all(x.kind == "raster" for x in tree.visible_leaves())


def composite(tiles: DataFrame, tree: LayerTree) -> DataFrame:
    """Tiles (tx, ty, px) of the composite of tiles (layer_id, tx, ty, px); masks and adjustments take plans/compositor.py."""
    if not can_composite(tree):
        raise ValueError("only raster layers and groups are composited as tiles")
    moved = offsets(tree)
    shown = tiles.filter(F.col("layer_id").isin(list(moved)))
    if any(o != (0, 0) for o in moved.values()):
        shown = _placed(shown, {i: o for i, o in moved.items() if o != (0, 0)})

    def fold(parts: dict[int, list[np.ndarray]], parent: int | None) -> np.ndarray | None:
        acc = None
        for x in tree.children(parent):
            if not x.visible or x.opacity <= 0:
                continue
            own = fold(parts, x.id) if x.kind == "group" else _joined(parts.get(x.id))
            if own is not None:
                acc = np.zeros(SHAPE, np.float32) if acc is None else acc
                _over(x.blend, acc, own, x.opacity)
        return None if acc is None else _straight(acc)

    def run(key, rows):
        parts: dict[int, list[np.ndarray]] = {}
        for i, px in zip(rows["layer_id"].to_pylist(), rows["px"], strict=True):
            parts.setdefault(i, []).append(array(px))
        out = fold(parts, None)
        tx, ty = (k.as_py() for k in key)
        return table([0], [tx], [ty], [out]).drop_columns("layer_id")

    return shown.groupBy("tx", "ty").applyInArrow(run, "tx int, ty int, px binary")


def _joined(parts: list[np.ndarray] | None) -> np.ndarray | None:
    """A layer's pieces on one tile; they don't overlap."""
    if not parts:
        return None
    return parts[0] if len(parts) == 1 else np.sum(parts, axis=0)


def offsets(tree: LayerTree, parent: int | None = None, dx: int = 0, dy: int = 0) -> dict[int, tuple[int, int]]:
    """Where the layers that can show lie, groups above included."""
    out: dict[int, tuple[int, int]] = {}
    for x in tree.children(parent):
        if x.visible and x.opacity > 0:
            at = dx + x.dx, dy + x.dy
            out |= offsets(tree, x.id, *at) if x.kind == "group" else {x.id: at}
    return out


def _placed(tiles: DataFrame, moved: dict[int, tuple[int, int]]) -> DataFrame:
    """Tiles of moved layers cut to the up to four tiles they then lie on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, tx, ty, px in zip(*(b.column(c).to_pylist() for c in ("layer_id", "tx", "ty")), b.column("px"), strict=True):
                dx, dy = moved.get(i, (0, 0))
                (qx, ox), (qy, oy) = divmod(dx, TILE), divmod(dy, TILE)
                pieces = []
                for jx in (0, 1) if ox else (0,):
                    for jy in (0, 1) if oy else (0,):
                        out = np.zeros(SHAPE, np.float32)
                        put = lambda j, o: (slice(o, TILE), slice(0, TILE - o)) if j == 0 else (slice(0, o), slice(TILE - o, TILE))
                        (ys, yt), (xs, xt) = put(jy, oy), put(jx, ox)
                        out[ys, xs] = array(px)[yt, xt]
                        if out.any():
                            pieces.append((tx + qx + jx, ty + qy + jy, out))
                if pieces:
                    t = table([i] * len(pieces), *map(list, zip(*pieces, strict=True)))
                    yield from t.to_batches()

    return tiles.select("layer_id", "tx", "ty", "px").mapInArrow(run, SCHEMA)


def gaussian(tiles: DataFrame, rect: Rect, sigma: float) -> DataFrame:
    """Separable blur of a dense window, clamped at its edges; tiles send a rim of ceil(3 sigma) to their neighbours, and nothing else is shuffled twice."""
    w = np.array(gaussian_weights(sigma), np.float32) if sigma > 0 else np.ones(1, np.float32)
    k = len(w) // 2
    if k > TILE:
        raise ValueError("the blur is wider than a tile")
    lo, hi = (rect.x >> 8, rect.y >> 8), ((rect.right - 1) >> 8, (rect.bottom - 1) >> 8)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = {0: slice(0, TILE), -1: slice(0, k), 1: slice(TILE - k, TILE)}
        for b in batches:
            tx, ty, dx, dy, px = [], [], [], [], []
            for x, y, p in zip(b.column("tx").to_pylist(), b.column("ty").to_pylist(), b.column("px"), strict=True):
                a = array(p)
                for i in (-1, 0, 1):
                    for j in (-1, 0, 1):
                        if lo[0] <= x + i <= hi[0] and lo[1] <= y + j <= hi[1]:
                            tx.append(x + i), ty.append(y + j), dx.append(-i), dy.append(-j)
                            px.append(np.ascontiguousarray(a[cut[j], cut[i]]).tobytes())
            yield pa.RecordBatch.from_arrays([*[pa.array(v, pa.int32()) for v in (tx, ty, dx, dy)], pa.array(px, pa.binary())], names=["tx", "ty", "dx", "dy", "px"])

    def run(key, rows):
        tx, ty = (v.as_py() for v in key)
        wide = np.zeros((TILE + 2 * k, TILE + 2 * k, 4), np.float32)
        put = {-1: slice(0, k), 0: slice(k, TILE + k), 1: slice(TILE + k, TILE + 2 * k)}
        for dx, dy, px in zip(rows["dx"].to_pylist(), rows["dy"].to_pylist(), rows["px"], strict=True):
            at = wide[put[dy], put[dx]]
            at[...] = np.frombuffer(px.as_buffer(), np.float32).reshape(at.shape)
        # places of the window in this frame; beyond it its edge is repeated
        clampx = np.clip(np.arange(TILE + 2 * k) + tx * TILE - k, rect.x, rect.right - 1) - (tx * TILE - k)
        clampy = np.clip(np.arange(TILE + 2 * k) + ty * TILE - k, rect.y, rect.bottom - 1) - (ty * TILE - k)
        x0, x1 = max(0, rect.x - tx * TILE), min(TILE, rect.right - tx * TILE)
        y0, y1 = max(0, rect.y - ty * TILE), min(TILE, rect.bottom - ty * TILE)
        wide = wide[np.ix_(clampy[y0 : y1 + 2 * k], clampx[x0 : x1 + 2 * k])]
        across = sum(w[i] * wide[:, i : i + x1 - x0] for i in range(2 * k + 1))
        out = np.zeros(SHAPE, np.float32)
        out[y0:y1, x0:x1] = sum(w[i] * across[i : i + y1 - y0] for i in range(2 * k + 1))
        return table([0], [tx], [ty], [out]).drop_columns("layer_id")

    inside = tiles.filter(F.col("tx").between(lo[0], hi[0]) & F.col("ty").between(lo[1], hi[1])).select("tx", "ty", "px")
    sent = inside.mapInArrow(send, "tx int, ty int, dx int, dy int, px binary")
    return sent.groupBy("tx", "ty").applyInArrow(run, "tx int, ty int, px binary")


def window(tiles: DataFrame, rect: Rect) -> DataFrame:
    """Tiles (layer_id, tx, ty, px) with what lies outside rect cleared: a rectangular selection copied without joining pixels. Tiles outside aren't read."""
    lo, hi = (rect.x >> 8, rect.y >> 8), ((rect.right - 1) >> 8, (rect.bottom - 1) >> 8)
    inside = tiles.filter(F.col("tx").between(lo[0], hi[0]) & F.col("ty").between(lo[1], hi[1]))
    whole = (F.col("tx") * TILE >= rect.x) & ((F.col("tx") + 1) * TILE <= rect.right) & (F.col("ty") * TILE >= rect.y) & ((F.col("ty") + 1) * TILE <= rect.bottom)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = []
            for tx, ty, px in zip(b.column("tx").to_pylist(), b.column("ty").to_pylist(), b.column("px"), strict=True):
                out = np.zeros(SHAPE, np.float32)
                ys, xs = (slice(max(0, p - t * TILE), max(0, min(TILE, q - t * TILE))) for t, p, q in ((ty, rect.y, rect.bottom), (tx, rect.x, rect.right)))
                out[ys, xs] = array(px)[ys, xs]
                kept.append(out.tobytes())
            yield pa.RecordBatch.from_arrays([b.column("layer_id"), b.column("tx"), b.column("ty"), pa.array(kept, pa.binary())], names=["layer_id", "tx", "ty", "px"])

    cols = ["layer_id", "tx", "ty", "px"]
    return inside.filter(whole).select(cols).unionByName(inside.filter(~whole).select(cols).mapInArrow(run, SCHEMA))
