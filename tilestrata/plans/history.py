"""The op-log: every version is an immutable document; undo and redo move between versions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilestrata.operators import brush, raster, region, resample, selection, tiles, vector
from tilestrata.operators.tiles import Rect
from tilestrata.plans.compositor import composite, merge_down
from tilestrata.plans.tree import Layer, LayerTree
from tilestrata.scratch import settled

LIMIT = 100
#: After so many commands the document is computed and kept.
CUT = 16


class CommandError(ValueError):
    """A command that doesn't apply; the document stays as it was."""


@dataclass(frozen=True)
class Document:
    """Canvas, tree, pixels (layer_id, x, y, r, g, b, a), masks (layer_id, x, y, cov), selection (x, y, cov), slices and paths (operators/vector.py).

    masked: the layers with a mask, an empty one included (those with mask rows by default).
    The pixels of a vector layer are the raster of its paths, made anew whenever they change.
    """

    canvas: Rect
    tree: LayerTree
    pixels: DataFrame
    masks: DataFrame
    selection: DataFrame | None = None
    slices: tuple[tuple[str, Rect], ...] = ()
    paths: DataFrame | None = None
    removed: frozenset[int] = field(default_factory=frozenset)
    masked: frozenset[int] | None = None

    def layer(self, i: int) -> Layer:
        if i not in self.tree.by_id or i in self.removed:
            raise CommandError(f"no layer {i}")
        return self.tree.by_id[i]

    def unlocked(self, i: int) -> Layer:
        x = self.layer(i)
        if x.locked:
            raise CommandError(f"layer {i} is locked")
        return x

    def of(self, i: int) -> DataFrame:
        return self.pixels.filter(F.col("layer_id") == i).drop("layer_id")

    def with_pixels(self, i: int, px: DataFrame) -> "Document":
        own = px.select(F.lit(i).alias("layer_id"), "x", "y", *raster.RGBA)
        return replace(self, pixels=self.pixels.filter(F.col("layer_id") != i).unionByName(own))

    def with_mask(self, i: int, mask: DataFrame | None) -> "Document":
        rest, masked = self.masks.filter(F.col("layer_id") != i), self.with_masks()
        if mask is None:
            return replace(self, masks=rest, masked=masked - {i})
        return replace(self, masks=rest.unionByName(mask.select(F.lit(i).alias("layer_id"), "x", "y", "cov")), masked=masked | {i})

    def with_masks(self) -> frozenset[int]:
        if self.masked is not None:
            return self.masked
        return frozenset(r["layer_id"] for r in self.masks.select("layer_id").distinct().collect())

    def local(self, i: int) -> Rect:
        """The canvas in a layer's own coordinates."""
        x = self.layer(i)
        return Rect(self.canvas.x - x.dx, self.canvas.y - x.dy, self.canvas.w, self.canvas.h)

    def new_id(self) -> int:
        return max(self.tree.by_id, default=0) + 1

    def selected(self, i: int) -> DataFrame:
        """The selection in a layer's own coordinates."""
        if self.selection is None:
            raise CommandError("nothing is selected")
        x = self.layer(i)
        return self.selection.withColumns({"x": F.col("x") - x.dx, "y": F.col("y") - x.dy})

    def composite(self, region: Rect | None = None) -> DataFrame | None:
        tree = self.tree
        for i in self.removed:
            tree = tree.without(i) if i in tree.by_id else tree
        return composite(self.pixels, tree, self.masks, region, masked=self.masked)


Step = Callable[[Document], Document]


@dataclass(frozen=True)
class Command:
    """A named step; commands with equal keys coalesce while they follow each other."""

    name: str
    step: Step
    key: str | None = None


def layer_update(label: str, i: int, coalesce: bool = False, **values) -> Command:
    """Set visible, opacity, blend, name, locked, adjustment or its parameters."""

    def step(d: Document) -> Document:
        d.layer(i)
        return replace(d, tree=d.tree.update(i, **values))

    return Command(label, step, f"{label}:{i}" if coalesce else None)


def add_layer(layer: Layer, above: int | None = None, px: DataFrame | None = None) -> Command:
    """A raster, vector, pasted or adjustment layer."""

    def step(d: Document) -> Document:
        out = replace(d, tree=d.tree.insert_above(layer, above))
        return out if px is None else out.with_pixels(layer.id, px)

    return Command("add layer", step)


def duplicate(i: int) -> Command:
    def step(d: Document) -> Document:
        x, new = d.layer(i), d.new_id()
        out = replace(d, tree=d.tree.insert_above(replace(x, id=new, name=f"{x.name} copy"), i))
        out = out.with_pixels(new, d.of(i))
        return out.with_mask(new, d.masks.filter(F.col("layer_id") == i).drop("layer_id")) if i in d.with_masks() else out

    return Command("duplicate", step)


def delete(i: int) -> Command:
    """Soft: the subtree stays in the document, hidden from every read."""

    def step(d: Document) -> Document:
        d.layer(i)
        return replace(d, removed=d.removed | {i, *d.tree.descendants(i)})

    return Command("delete", step)


def reorder(i: int, to: int) -> Command:
    return Command("reorder", lambda d: replace(d, tree=d.tree.reorder(i, to)))


def move_into(i: int, group: int) -> Command:
    return Command("move into group", lambda d: replace(d, tree=d.tree.move_into(i, group)))


def insert_subtree(other: Document, root: int) -> Command:
    """Another document's subtree, with new ids for its layers, pixels and masks."""

    def step(d: Document) -> Document:
        tree, new = d.tree.insert_subtree(other.tree, root)
        ids = F.create_map(*[F.lit(v) for kv in new.items() for v in kv])
        moved = lambda df: df.filter(F.col("layer_id").isin(list(new))).withColumn("layer_id", ids[F.col("layer_id")])
        return replace(d, tree=tree, pixels=d.pixels.unionByName(moved(other.pixels)), masks=d.masks.unionByName(moved(other.masks)), masked=d.with_masks() | {new[i] for i in other.with_masks() if i in new})

    return Command("insert subtree", step)


def move_by(i: int, dx: int, dy: int) -> Command:
    def step(d: Document) -> Document:
        x = d.unlocked(i)
        if not all(-(2**31) <= v < 2**31 for v in (x.dx + dx, x.dy + dy)):
            raise CommandError("the offset overflows")
        return replace(d, tree=d.tree.update(i, dx=x.dx + dx, dy=x.dy + dy))

    return Command("move", step)


def pixel_step(name: str, i: int, change: Callable[[Document, DataFrame], DataFrame]) -> Command:
    """Any command that replaces an unlocked layer's pixels: filters, strokes, fills, flips, plug-ins."""

    def step(d: Document) -> Document:
        d.unlocked(i)
        return d.with_pixels(i, change(d, d.of(i)))

    return Command(name, step)


def paint(i: int, edits: DataFrame) -> Command:
    return pixel_step("paint", i, lambda d, px: tiles.upsert(px, edits))


def set_buffer(i: int, px: DataFrame) -> Command:
    """A layer's pixels replaced as a whole: by a plug-in, a filter or another tool."""
    return pixel_step("set pixels", i, lambda d, old: px)


def apply_filter(i: int, change: Callable[[DataFrame, Rect], DataFrame]) -> Command:
    """A filter on the dense window of the layer's bounds."""

    def step(d: Document, px: DataFrame) -> DataFrame:
        b = tiles.bounds_of(px)
        return px if b is None else tiles.stored(change(px, b))

    return pixel_step("filter", i, step)


def paint_stroke(i: int, samples: DataFrame, tip: brush.Brush, colour: tuple[float, ...] = (0.0, 0.0, 0.0, 1.0), erase: bool = False) -> Command:
    """Strokes of (stroke_id, seq, px, py, pressure), with a brush or an eraser."""

    def change(d: Document, px: DataFrame) -> DataFrame:
        covered = brush.stamp_cover(brush.stroke_stamps(samples, tip), tip)
        return brush.paint_stamps(px, covered, colour, erase)

    return pixel_step("stroke", i, change)


def stroke_selection(i: int, rect: Rect, width: float, colour: tuple[float, ...], opacity: float = 1.0) -> Command:
    """The inner border of a rectangular selection."""
    return pixel_step("stroke selection", i, lambda d, px: tiles.upsert(px, raster.stroke_selection(px, rect, width, colour, d.local(i), opacity)))


def gradient(i: int, kind: str, p0: tuple[float, float], p1: tuple[float, float], fg: tuple[float, ...], bg: tuple[float, ...], wrap: str = "clamp", reverse: bool = False, opacity: float = 1.0) -> Command:
    def change(d: Document, px: DataFrame) -> DataFrame:
        sel = d.selected(i) if d.selection is not None else None
        return tiles.upsert(px, raster.fill_gradient(px, kind, p0, p1, fg, bg, d.local(i), wrap, reverse, opacity, sel))

    return pixel_step("gradient", i, change)


def bucket(i: int, x: int, y: int, colour: tuple[float, ...], tolerance: float) -> Command:
    def change(d: Document, px: DataFrame) -> DataFrame:
        sel = d.selected(i) if d.selection is not None else None
        return tiles.upsert(px, region.bucket_fill(px, x, y, colour, tolerance, d.local(i), sel))

    return pixel_step("bucket", i, change)


def remove_background(i: int, tolerance: float = 0.2, softness: float = 0.55, enclosed: bool = False) -> Command:
    """Fails where no background is found."""

    def change(d: Document, px: DataFrame) -> DataFrame:
        b = tiles.bounds_of(px)
        try:
            return px if b is None else region.remove_matte(px, b, tolerance, softness, enclosed)
        except ValueError as e:
            raise CommandError(str(e)) from e

    return pixel_step("remove background", i, change)


def wand(i: int, x: int, y: int, tolerance: float, mode: str = "replace", contiguous: bool = True) -> Command:
    """Selects what is like a layer's place; within whole tiles of the layer."""

    def step(d: Document) -> Document:
        layer, b = d.layer(i), tiles.tile_bounds(tiles.stored(d.of(i))).first()
        if b["x"] is None:
            raise CommandError("the layer is empty")
        got = region.magic_wand(d.of(i), x, y, tolerance, Rect(b["x"], b["y"], int(b["w"]), int(b["h"])), contiguous)
        got = got.withColumns({"x": F.col("x") + layer.dx, "y": F.col("y") + layer.dy})
        return select(mode, got).step(d)

    return Command("wand", step)


def add_vector(layer: Layer, paths: DataFrame, above: int | None = None) -> Command:
    def step(d: Document) -> Document:
        own = paths.withColumn("layer_id", F.lit(layer.id))
        out = replace(d, tree=d.tree.insert_above(layer, above), paths=own if d.paths is None else d.paths.unionByName(own))
        return out.with_pixels(layer.id, vector.rasterize(own).drop("layer_id"))

    return Command("add vector layer", step)


def edit_vector(i: int, change: Callable[[DataFrame], DataFrame]) -> Command:
    """A vector layer's paths changed and its pixels drawn anew."""

    def step(d: Document) -> Document:
        d.unlocked(i)
        if d.paths is None:
            raise CommandError("there are no paths")
        own = change(d.paths.filter(F.col("layer_id") == i))
        out = replace(d, paths=d.paths.filter(F.col("layer_id") != i).unionByName(own))
        return out.with_pixels(i, vector.rasterize(own).drop("layer_id"))

    return Command("edit vector", step)


def fill(i: int, colour: tuple[float, ...], opacity: float = 1.0) -> Command:
    def change(d: Document, px: DataFrame) -> DataFrame:
        return tiles.upsert(px, raster.fill_selection(px, d.selected(i) if d.selection is not None else None, colour, d.local(i), opacity))

    return pixel_step("fill", i, change)


def flip(i: int, axis: str) -> Command:
    """Pixels and mask mirrored inside the pixels' bounds."""

    def step(d: Document) -> Document:
        d.unlocked(i)
        b = tiles.bounds_of(d.of(i))
        if b is None:
            return d
        lo, hi = (b.x, b.right - 1) if axis == "x" else (b.y, b.bottom - 1)
        out = d.with_pixels(i, raster.flip(d.of(i), axis, lo, hi))
        return out.with_mask(i, raster.flip(d.masks.filter(F.col("layer_id") == i).drop("layer_id"), axis, lo, hi)) if i in d.with_masks() else out

    return Command("flip", step)


def warp(i: int, change: Callable[[DataFrame, Rect], DataFrame]) -> Command:
    """A layer's pixels mapped by resample.perspective or resample.bezier_warp, given its bounds."""

    def step(d: Document, px: DataFrame) -> DataFrame:
        b = tiles.bounds_of(px)
        return px if b is None else change(px, b)

    return pixel_step("transform", i, step)


def transform(i: int, affine: tuple[float, ...], kind: str = "bicubic") -> Command:
    """Whole-pixel moves only change the offset; maps that flatten everything fail."""
    a, b, c, e, tx, ty = affine
    if abs(a * e - b * c) <= 1e-6:
        raise CommandError("the transform has no inverse")
    if (a, b, c, e) == (1, 0, 0, 1) and tx == int(tx) and ty == int(ty):
        return move_by(i, int(tx), int(ty))

    def change(d: Document, px: DataFrame) -> DataFrame:
        bounds = tiles.bounds_of(px)
        return px if bounds is None else resample.resample(px, affine, bounds, kind)

    return pixel_step("transform", i, change)


def copy_to_layer(i: int, cut: bool = False) -> Command:
    """The selected pixels as a layer above; cutting erases them and needs an unlocked layer."""

    def step(d: Document) -> Document:
        x, sel, new = d.unlocked(i) if cut else d.layer(i), d.selected(i), d.new_id()
        taken = raster.extract(d.of(i), sel)
        out = replace(d, tree=d.tree.insert_above(replace(x, id=new, name=f"{x.name} copy", locked=False), i)).with_pixels(new, taken)
        return out.with_pixels(i, raster.erase(d.of(i), sel)) if cut else out

    return Command("cut to layer" if cut else "copy to layer", step)


def select(mode: str, sel: DataFrame) -> Command:
    return Command("select", lambda d: replace(d, selection=sel if d.selection is None and mode in ("replace", "add") else selection.combine(mode, d.selection, sel)), "select" if mode == "replace" else None)


def change_selection(name: str, change: Callable[[DataFrame, Rect], DataFrame]) -> Command:
    """Invert, feather, grow, shrink."""

    def step(d: Document) -> Document:
        if d.selection is None:
            raise CommandError("nothing is selected")
        return replace(d, selection=change(d.selection, d.canvas))

    return Command(name, step)


def set_mask(i: int, kind: str) -> Command:
    """reveal_all, hide_all, reveal_selection, delete, or apply."""

    def step(d: Document) -> Document:
        d.layer(i)
        if kind == "delete":
            return d.with_mask(i, None)
        if kind == "apply":
            mask = d.masks.filter(F.col("layer_id") == i).drop("layer_id")
            return d.with_pixels(i, raster.apply_mask(d.of(i), mask)).with_mask(i, None)
        return d.with_mask(i, raster.build_mask(d.of(i), kind, d.selected(i) if kind == "reveal_selection" else None))

    return Command(f"mask {kind}", step)


def merge(upper: int, lower: int) -> Command:
    def step(d: Document) -> Document:
        try:
            px = merge_down(d.pixels, d.layer(upper), d.layer(lower))
        except ValueError as e:
            raise CommandError(str(e)) from e
        return replace(d, tree=d.tree.update(lower, dx=0, dy=0, opacity=1.0).without(upper)).with_pixels(lower, px)

    return Command("merge down", step)


def crop(rect: Rect) -> Command:
    return Command("crop", lambda d: replace(d, canvas=rect))


def resize(w: int, h: int, anchor: str = "c") -> Command:
    """The canvas resized about an anchor; root layers shift with it."""

    def step(d: Document) -> Document:
        dx, dy = raster.resize_shift(d.canvas, w, h, anchor)
        tree = d.tree
        for x in tree.children(None):
            tree = tree.update(x.id, dx=x.dx + dx, dy=x.dy + dy)
        return replace(d, canvas=Rect(d.canvas.x, d.canvas.y, w, h), tree=tree)

    return Command("resize", step)


def add_slice(name: str, rect: Rect) -> Command:
    return Command("add slice", lambda d: replace(d, slices=(*d.slices, (name, rect))))


def batch(name: str, commands: list[Command]) -> Command:
    """All or none, one entry of the log."""

    def step(d: Document) -> Document:
        for c in commands:
            d = c.step(d)
        return d

    return Command(name, step)


class History:
    """Applied and undone versions, at most `limit` back."""

    def __init__(self, document: Document, limit: int = LIMIT) -> None:
        self.document, self.limit, self.count = document, limit, 0
        self.done: list[tuple[Command, Document]] = []
        self.undone: list[tuple[Command, Document]] = []

    def do(self, command: Command) -> Document:
        """Applies a command; what was undone is dropped. A failing command changes nothing."""
        after = command.step(self.document)
        self.count += 1
        if self.count % CUT == 0:  # plans of a long session don't grow without end
            after = replace(after, pixels=settled(after.pixels), masks=settled(after.masks))
        same = self.done and command.key is not None and self.done[-1][0].key == command.key
        if same:
            self.done[-1] = command, self.done[-1][1]
        else:
            self.done.append((command, self.document))
            del self.done[: -self.limit]
        self.undone.clear()
        self.document = after
        return after

    def undo(self) -> bool:
        if not self.done:
            return False
        command, before = self.done.pop()
        self.undone.append((command, self.document))
        self.document = before
        return True

    def redo(self) -> bool:
        if not self.undone:
            return False
        command, after = self.undone.pop()
        self.done.append((command, self.document))
        self.document = after
        return True

    def log(self, spark: SparkSession) -> DataFrame:
        """(seq, op, undone) of the log."""
        rows = [(k, c.name, False) for k, (c, _) in enumerate(self.done)]
        rows += [(len(rows) + k, c.name, True) for k, (c, _) in enumerate(reversed(self.undone))]
        return spark.createDataFrame(rows, "seq int, op string, undone boolean")
