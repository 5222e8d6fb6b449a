"""Prefix trie of conversations by Patricia construction over sorted paths.

A turn is 24 bytes: 128 bits of the SHA-256 of its role and text, and the bytes of its text. A conversation's path is its
turns one after another, so paths sort as sequences of turns do and texts are read once and never moved.

1. paths(): turns become paths; a long conversation's turns meet in chunks of turn numbers first.
2. Paths are sorted over all partitions together with their ids, so copies of one conversation are dealt over many tasks;
   each sends its sorted ids as text, and the digest of equal paths' ids is taken over these texts in order.
3. The distinct paths are sorted in parts of bounded size. A task walks its part with a stack and creates only points: where
   paths branch or end. Members, leaves and saved bytes are summed on this compressed tree; a point's edge then gives the
   nodes between it and the point above, whose saved bytes are suffix sums over the edge.
4. The nodes on the path between two neighbouring parts belong to both. There every node is a point, each part has its own
   sums, and they are added up by node: a node's own bytes and its place among its parent's children count in the first part
   that has it. All other nodes are final where they are made.

Defined results: null roles and texts count as empty; turns go by number, null first, and turns of the same number by their
hashes; rows that repeat are turns each; rows without a conversation id belong to no conversation and are left out; an
empty table gives no nodes, not even a root; other columns aren't read. A path is one value of a row, so a conversation has
2 ** 26 turns at most.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tilestrata.llm.storage import cut, small

#: Bytes of a turn in a path; those before the last eight are its hash.
UNIT = 24
#: Turn numbers that meet in one chunk of a conversation.
CHUNK_TURNS = 1 << 16
#: Distinct paths of a part, and characters of ids sent in one row.
PART_PATHS, ID_CHARS = 200_000, 1 << 20
NONE = hashlib.sha256(b"").hexdigest()
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def unit(role: Column, text: Column) -> Column:
    """A turn's bytes in a path."""
    role, text = F.coalesce(role.cast("string"), F.lit("")), F.coalesce(text.cast("string"), F.lit(""))
    name = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return F.unhex(F.concat(F.substring(F.sha2(name, 256), 1, 32), F.lpad(F.hex(F.octet_length(text).cast("long")), 16, "0")))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose first columns are equal, one after another, become one, their last column joined."""
    last, held = None, []
    for b in batches:
        keys = list(zip(*[b.column(i).to_pylist() for i in range(b.num_columns - 1)], strict=True))
        parts, rows, out = b.column(b.num_columns - 1).to_pylist(), [], []
        for key, part in zip(keys, parts, strict=True):
            if key != last:
                if held:
                    rows.append(last)
                    out.append(b"".join(held))
                last, held = key, []
            held.append(part)
        if rows:
            yield _record(rows, out, b.schema)
        schema = b.schema
    if held:
        yield _record([last], [b"".join(held)], schema)


def _record(rows: list[tuple], out: list[bytes], schema: pa.Schema) -> pa.RecordBatch:
    columns = [pa.array(c, schema.field(i).type) for i, c in enumerate(zip(*rows, strict=True))]
    return pa.RecordBatch.from_arrays([*columns, pa.array(out, pa.binary())], names=schema.names)


def paths(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, path) of every conversation that has turns."""
    turn = F.col(turn_col).cast("long")
    turns = df.select(F.col(id_col).cast("long").alias("conv_id"), F.floor(turn / CHUNK_TURNS).alias("chunk"), turn.alias("turn"), unit(F.col(role_col), F.col(text_col)).alias("path")).filter("conv_id IS NOT NULL")
    chunks = turns.repartition("conv_id", "chunk").sortWithinPartitions("conv_id", "chunk", "turn", "path").select("conv_id", "chunk", "path").mapInArrow(_joined, "conv_id long, chunk long, path binary")
    return chunks.repartition("conv_id").sortWithinPartitions("conv_id", "chunk").select("conv_id", "path").mapInArrow(_joined, "conv_id long, path binary")


def graft(convs: DataFrame, onto: Column, turns: Column) -> DataFrame:
    """(conv_id, path): the first `turns` turns of conversation `onto`, where it exists, then the conversation's own turns after as many. onto, turns: of conv_id."""
    stems = convs.select(F.col("conv_id").alias("stem"), F.col("path").alias("stem_path"))
    n = turns * UNIT
    own = F.substring("path", n + 1, F.greatest(F.octet_length("path") - n, F.lit(0)))
    grown = convs.withColumn("stem", onto).join(stems, "stem", "left")
    return grown.select("conv_id", F.concat(F.coalesce(F.substring("stem_path", F.lit(1), n), F.lit(b"")), own).alias("path"))


def _id_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, first, n, ids): rows sorted by path and id; equal paths' ids as text."""
    path, ids, size = None, [], 0
    out: list[tuple] = []

    def record() -> pa.RecordBatch:
        rows = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.binary(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["path", "first", "n", "ids"])
        out.clear()
        return rows

    for b in batches:
        for p, i in zip(b.column("path").to_pylist(), b.column("conv_id").to_pylist(), strict=True):
            if p != path or size > ID_CHARS:
                if ids:
                    out.append((path, int(ids[0]), len(ids), ",".join(ids)))
                path, ids, size = p, [], 0
            ids.append(str(i))
            size += len(ids[-1]) + 1
        if out:
            yield record()
    if ids:
        out.append((path, int(ids[0]), len(ids), ",".join(ids)))
        yield record()


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, conv_id, n, digest): one row for each path of rows sorted by path and first id."""
    names = ["path", "conv_id", "n", "digest"]
    path, first, n, h = None, None, 0, None
    for b in batches:
        out = []
        for p, f, k, text in zip(*(b.column(c).to_pylist() for c in ("path", "first", "n", "ids")), strict=True):
            if p == path:
                h.update(b"," + text.encode())
                n += k
                continue
            if h:
                out.append((path, first, n, h.digest()))
            path, first, n, h = p, f, k, hashlib.sha256(text.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=names)
    if h:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (path, first, n, h.digest())], names=names)


def common(a: bytes, b: bytes) -> int:
    """Turns that two paths share at their start."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // UNIT
    return int(np.argmax(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n))) // UNIT


def _meets(ends: DataFrame) -> dict[int, tuple[int, int]]:
    """Turns that a part's first path shares with the part before, and its last with the part after (-1: there is none); two numbers a part reach the driver."""
    order = Window.orderBy("part")
    edges = ends.groupBy("part").agg(F.min("path").alias("lo"), F.max("path").alias("hi"))
    edges = edges.select("part", "lo", "hi", F.lag("hi").over(order).alias("before"), F.lead("lo").over(order).alias("after"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lo, hi, before, after = (b.column(c).to_pylist() for c in ("lo", "hi", "before", "after"))
            left = [-1 if y is None else common(x, y) for x, y in zip(lo, before, strict=True)]
            right = [-1 if y is None else common(x, y) for x, y in zip(hi, after, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("part"), pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["part", "l", "r"])

    return {r["part"]: (r["l"], r["r"]) for r in edges.mapInArrow(run, "part int, l long, r long").collect()}


class _Point:
    __slots__ = ("at", "children", "depth", "digest", "inner", "leaves", "low", "n", "owned", "saved", "span")

    def __init__(self, at: int, depth: int, span: bytes | None = None, owned: int = 1) -> None:
        self.at, self.depth, self.span, self.owned = at, depth, span, owned
        self.n = self.children = self.leaves = self.saved = 0
        self.low, self.digest, self.inner = None, None, False


class _Part:
    """The compressed tree of one part, from its paths in order."""

    NUMBERS = ("depth", "above", "low", "n", "children", "leaves", "saved", "owned", "length")

    def __init__(self, left: int, right: int) -> None:
        self.left, self.right, self.last, self.done = left, right, None, False
        self.numbers = {k: array("q") for k in self.NUMBERS}
        self.digests: dict[int, bytes] = {}
        self.spans: dict[int, bytes] = {}
        self.edges: dict[int, bytes] = {}
        self.stack = [self._new(0, self._names(b"", 0)[0] if max(left, right) >= 0 else None, int(left < 0))]

    def _new(self, depth: int, span: bytes | None = None, owned: int = 1) -> _Point:
        at = len(self.numbers["depth"])
        for x in self.numbers.values():
            x.append(0)
        return _Point(at, depth, span, owned)

    @staticmethod
    def _names(path: bytes, most: int) -> list[bytes]:
        """Names of the nodes at depth 0 to `most` of a path."""
        h = hashlib.sha256()
        out = [h.digest()]
        for t in range(most):
            h.update(path[t * UNIT : (t + 1) * UNIT])
            out.append(h.digest())
        return out

    def add(self, path: bytes, conv_id: int, n: int, digest: bytes) -> None:
        depth = len(path) // UNIT
        if self.last is None:
            for t, name in list(enumerate(self._names(path, max(self.left, 0))))[1:]:
                self.stack.append(self._new(t, name, owned=0))
        else:
            self._close_below(common(self.last, path))
        if depth > self.stack[-1].depth:
            self.stack.append(self._new(depth))
        end = self.stack[-1]
        end.n, end.low, end.digest = end.n + n, conv_id if end.low is None else min(conv_id, end.low), digest
        self.last = path

    def _close_below(self, depth: int) -> None:
        """Closes the points deeper than that; where an edge crosses it, a point is made."""
        while self.stack[-1].depth > depth:
            point = self.stack.pop()
            if self.stack[-1].depth < depth:
                self.stack.append(self._new(depth))
            self._close(point, self.stack[-1])

    def _close(self, point: _Point, above: _Point | None) -> None:
        top = above.depth if above else -1
        sizes = self.last[top * UNIT : point.depth * UNIT] if above else b""
        edge = np.frombuffer(sizes, ">i8").reshape(-1, 3)[:, 2] if above else np.zeros(1, np.int64)
        if not point.inner and not self._goes_on(point):
            point.leaves = 1
        for k in ("depth", "n", "children", "leaves", "saved", "owned"):
            self.numbers[k][point.at] = getattr(point, k)
        self.numbers["low"][point.at], self.numbers["above"][point.at], self.numbers["length"][point.at] = point.low, above.at if above else -1, len(edge)
        self.edges[point.at] = edge.astype(np.int64).tobytes()
        if point.digest:
            self.digests[point.at] = point.digest
        if point.span:
            self.spans[point.at] = point.span
        if above:
            above.inner = True
            above.n += point.n
            above.leaves += point.leaves
            above.children += point.owned
            above.saved += point.saved + (point.n - point.owned) * int(edge.sum())
            above.low = point.low if above.low is None else min(above.low, point.low)

    def _goes_on(self, point: _Point) -> bool:
        """Whether the next part has a longer path through the last path's end."""
        return self.done and point.depth == self.right == len(self.last) // UNIT

    def nodes(self) -> Iterator[pa.RecordBatch]:
        """All nodes of the part."""
        if self.last is None:
            return
        self.done, names = True, self._names(self.last, max(self.right, 0))
        have = {p.depth: p for p in self.stack}
        self.stack = []
        for t in range(self.right + 1):  # every node that the next part has too is a point
            have.setdefault(t, None)
        for t in sorted(have):
            p = have[t] or self._new(t)
            if t <= self.right and p.span is None:
                p.span = names[t]
            self.stack.append(p)
        while self.stack:
            point = self.stack.pop()
            self._close(point, self.stack[-1] if self.stack else None)
        yield from self._expanded()

    def _expanded(self) -> Iterator[pa.RecordBatch]:
        x = {k: np.frombuffer(v, np.int64) for k, v in self.numbers.items()}
        step = 1 << 15
        for lo in range(0, len(x["n"]), step):
            at = np.arange(lo, min(lo + step, len(x["n"])))
            of = np.repeat(at, x["length"][at])
            sizes = np.frombuffer(b"".join([self.edges[i] for i in at.tolist()]), np.int64)
            ends = np.cumsum(x["length"][at])
            total = np.concatenate((np.zeros(1, np.int64), np.cumsum(sizes)))
            rest = np.repeat(total[ends], x["length"][at]) - total[:-1]  # bytes from a node down to its point
            below = np.repeat(ends, x["length"][at]) - 1 - np.arange(len(of))
            first, is_point = below == x["length"][of] - 1, below == 0
            above = x["above"][of]
            parent = np.where(first, x["low"][above], x["low"][of])
            digest = [self.digests[i].hex() if p and i in self.digests else None for i, p in zip(of.tolist(), is_point.tolist(), strict=True)]
            span = [self.spans.get(i) for i in of.tolist()]
            over = [self.spans.get(i) if f else None for i, f in zip(above.tolist(), first.tolist(), strict=True)]
            columns = [
                pa.array(x["low"][of]),
                pa.array(x["depth"][of] - below),
                pa.array(parent, mask=above < 0),
                pa.array(x["n"][of]),
                pa.array(np.where(is_point, x["children"][of], 1)),
                pa.array(x["leaves"][of]),
                pa.array(x["saved"][of] + (x["n"][of] - x["owned"][of]) * rest),
                pa.array(digest, pa.string()),
                pa.array(span, pa.binary()),
                pa.array(over, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[*[c.split()[0] for c in NODE.split(", ")], "span", "over"])


def nodes(convs: DataFrame) -> DataFrame:
    """One row per trie node of (conv_id, path): conv_id, the smallest member; depth; parent_conv_id; n_convs, members; n_children; n_leaves, saved_tokens (bytes of texts that members after the first repeat), both over the node's subtree; ends_sha256, digest of the ids that end there."""
    spark = convs.sparkSession
    convs = cut(convs.select("conv_id", "path"), "conversation-paths")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-convs.count() // PART_PATHS))
    texts = convs.repartitionByRange(parts, "path", "conv_id").sortWithinPartitions("path", "conv_id").mapInArrow(_id_texts, "path binary, first long, n long, ids string")
    ends = texts.repartitionByRange(parts, "path").sortWithinPartitions("path", "first").mapInArrow(_ends, "path binary, conv_id long, n long, digest binary")
    ends = cut(ends.withColumn("part", F.spark_partition_id()), "paths")
    meets = spark.sparkContext.broadcast(_meets(ends))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, tree = None, None
        for b in batches:
            for k, *row in zip(*(b.column(c).to_pylist() for c in ("part", "path", "conv_id", "n", "digest")), strict=True):
                if k != part:
                    if tree:
                        yield from tree.nodes()
                    part, tree = k, _Part(*meets.value[k])
                tree.add(*row)
        if tree:
            yield from tree.nodes()

    made = cut(ends.repartition("part").sortWithinPartitions("part", "path").mapInArrow(run, f"{NODE}, span binary, over binary"), "trie-nodes")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    shared = cut(made.filter("span IS NOT NULL").groupBy("span").agg(F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), *sums, F.max("ends_sha256").alias("ends_sha256"), F.max("over").alias("over")), "shared-nodes")
    names = [c.split()[0] for c in NODE.split(", ")]
    tops = small(shared.select(F.col("span").alias("over"), F.col("conv_id").alias("top")))
    hung = made.filter("span IS NULL AND over IS NOT NULL").drop("span").unionByName(shared.withColumn("parent_conv_id", F.lit(None).cast("long")).drop("span").filter("over IS NOT NULL"))
    hung = hung.join(tops, "over").withColumn("parent_conv_id", F.col("top"))
    root = shared.filter("over IS NULL").withColumn("parent_conv_id", F.lit(None).cast("long"))
    out = made.filter("span IS NULL AND over IS NULL").select(names).unionByName(hung.select(names)).unionByName(root.select(names))
    return out.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NONE)))
