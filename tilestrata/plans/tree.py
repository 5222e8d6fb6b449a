"""The layer tree: small metadata on the driver, in bottom-to-top order."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

MAX_DEPTH = 128


@dataclass(frozen=True)
class Layer:
    """A layer's metadata; kind is raster, group or adjustment."""

    id: int
    parent: int | None = None
    index: int = 0
    kind: str = "raster"
    name: str = ""
    blend: str = "normal"
    opacity: float = 1.0
    dx: int = 0
    dy: int = 0
    visible: bool = True
    locked: bool = False
    adjust: str | None = None
    params: dict = field(default_factory=dict)


class LayerTree:
    """Ordered forest of layers."""

    def __init__(self, layers: list[Layer]) -> None:
        self.by_id = {x.id: x for x in layers}
        if len(self.by_id) < len(layers):
            raise ValueError("layer ids repeat")
        for x in layers:
            if x.parent is not None and (x.parent not in self.by_id or self.by_id[x.parent].kind != "group"):
                raise ValueError(f"layer {x.id} has no group {x.parent}")
            self.depth(x.id)

    def depth(self, i: int) -> int:
        d, at = 0, self.by_id[i].parent
        while at is not None:
            d, at = d + 1, self.by_id[at].parent
            if d > MAX_DEPTH:
                raise ValueError("the layer tree has a cycle or is too deep")
        return d

    def children(self, parent: int | None) -> list[Layer]:
        return sorted((x for x in self.by_id.values() if x.parent == parent), key=lambda x: (x.index, x.id))

    def render_order(self, parent: int | None = None, depth: int = 0) -> list[tuple[int, int]]:
        """(id, depth) in pre-order."""
        out = []
        for x in self.children(parent):
            out.append((x.id, depth))
            out += self.render_order(x.id, depth + 1)
        return out

    def descendants(self, i: int) -> list[int]:
        return [j for c in self.children(i) for j in (c.id, *self.descendants(c.id))]

    def visible_leaves(self, parent: int | None = None) -> list[Layer]:
        """Leaves that can show: all groups above visible and not fully transparent."""
        out = []
        for x in self.children(parent):
            if x.visible and x.opacity > 0:
                out += self.visible_leaves(x.id) if x.kind == "group" else [x]
        return out

    def _with(self, *changed: Layer) -> "LayerTree":
        return LayerTree(list(({**self.by_id} | {x.id: x for x in changed}).values()))

    def update(self, i: int, **values) -> "LayerTree":
        return self._with(replace(self.by_id[i], **values))

    def reorder(self, i: int, to: int) -> "LayerTree":
        x = self.by_id[i]
        rest = [c for c in self.children(x.parent) if c.id != i]
        rest.insert(max(0, min(to, len(rest))), x)
        return self._with(*[replace(c, index=k) for k, c in enumerate(rest)])

    def move_into(self, i: int, group: int) -> "LayerTree":
        if group == i or group in self.descendants(i) or self.by_id[group].kind != "group":
            raise ValueError("a layer moves only into another group outside itself")
        return self._with(replace(self.by_id[i], parent=group, index=len(self.children(group))))

    def insert_above(self, layer: Layer, below: int | None) -> "LayerTree":
        if below is None:
            return self._with(replace(layer, index=len(self.children(layer.parent))))
        sib = self.children(self.by_id[below].parent)
        at = [c.id for c in sib].index(below) + 1
        sib.insert(at, replace(layer, parent=self.by_id[below].parent))
        return self._with(*[replace(c, index=k) for k, c in enumerate(sib)])

    def without(self, i: int) -> "LayerTree":
        gone = {i, *self.descendants(i)}
        return LayerTree([x for x in self.by_id.values() if x.id not in gone])

    def insert_subtree(self, other: "LayerTree", root: int) -> tuple["LayerTree", dict[int, int]]:
        """Another tree's subtree at the top, with new ids; also the id map."""
        ids = [root, *other.descendants(root)]
        new = {old: max(self.by_id, default=0) + 1 + k for k, old in enumerate(ids)}
        moved = [replace(other.by_id[o], id=new[o], parent=new.get(other.by_id[o].parent)) for o in ids]
        moved[0] = replace(moved[0], parent=None, index=len(self.children(None)))
        return LayerTree([*self.by_id.values(), *moved]), new
