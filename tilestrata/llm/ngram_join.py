"""Similarity join of documents on the Jaccard of their word n-gram sets.

Adaptive multi-match prefixes: all sets share one token order, by the estimated number of sets that
hold a token (a counter sketch of all documents) and then by hash. Two sets that reach
the threshold share at least l tokens within their first n - ceil(t * n) + l tokens, for any l; each
document takes the l of least estimated cost (posting lists to read, plus candidates to
verify, of which there can be no more than postings / l), and a pair needs as many
common prefix tokens as the smaller of its two values before it is verified. Positions bound the
overlap further: after the last of m common prefix tokens no more can be common than the shorter rest, and
before a common token no more than those of its predecessors that another class has in its prefix too.

Steps: (1) sketch; (2) per document n, a 128-bit fingerprint of the set, l and the prefix; (3)
equal sets become one class; (4) postings of tokens that two classes share, with their rank among them; (5) in each posting list, the
member whose tokens are most common in the corpus is the pivot: pairs with pivots are verified first
and united, which makes large groups of near copies one component with a number of pairs linear in
the group; (6) every other pair of a list that lies across components, and whose 512-bit parity signatures differ in no more bits
than sets of the threshold can, is counted, verified if it has enough common tokens, and united. A pair left out lies in one component already, so components are exact.
Sets for verification are recomputed from the texts of the candidates alone, found by a bitmap.

Sets are 64-bit hashes of n-grams, compared as sorted arrays. Classes have keys of their own, so ids may be of any type that
can be ordered. The sketch and the bitmap grow with the rows, up to 2^24 counters and 2^27 bits, which are the same for all larger
inputs: they then find fewer candidates unlikely, which costs time, not results.

Defined results: null texts and texts without words have an empty set, n_shingles 0 and their own id as component,
and link with nothing, not even each other; texts of fewer words than n are one shingle; rows
that repeat an id are one document with several texts, so they share a component; rows with a null id link like all others, but a
component is named by its smallest id that isn't null, and null only if it has none; an empty table gives an empty table; other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tilestrata.llm._text import chunks, shingle_set, text_buffers, word_hashes
from tilestrata.llm.components import components
from tilestrata.llm.merge import bitmap, has, merged, pack, slot
from tilestrata.llm.storage import arrow_rows, cut, small
from tilestrata.llm.workers import lean

#: Counters of the sketch and bits of the bitmap, as powers of two: least and most, and how many for each row.
SKETCH_BITS, SKETCH_EACH = (21, 24), 8
SKETCH_CHUNK = 1 << 16
BITMAP_BITS, BITMAP_EACH = (16, 27), 16
#: Bits of a set's parity signature.
SIGNATURE = 512
#: Rows of an Arrow batch that holds texts or sets.
BATCH_ROWS = 1000
#: The most matches asked for, and the price of verifying one shingle against reading one posting.
MOST_MATCHES, VERIFY_COST = 12, 0.25


def _sets(column, size: int) -> Iterator[np.ndarray]:
    data, offsets = text_buffers(column)
    for lo, hi in chunks(offsets):
        hashes, _, _, rng = word_hashes(data, offsets[lo : hi + 1])
        for i in range(hi - lo):
            yield shingle_set(hashes[rng[i] : rng[i + 1]], size)


def _bits(rows: int, bounds: tuple[int, int], each: int) -> int:
    return min(bounds[1], max(bounds[0], (rows * each).bit_length()))


def _mark(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit(""))))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, mark); mark tells rows without an id apart."""
    id_, text = F.col(id_col), F.col(text_col)
    return docs.select(id_.alias("id"), text.cast("string").alias("text"), F.when(id_.isNull(), _mark(text)).alias("mark"))


def sketch(docs: DataFrame, size: int, bits: int) -> np.ndarray:
    """2 ** bits counters of shingles by the top bits of their hash, over all documents."""
    width, shift = 1 << bits, np.uint64(64 - bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, n = np.zeros(width, np.uint32), [], 0
        for b in batches:
            for s in _sets(b.column("text"), size):
                held.append((s >> shift).astype(np.int32))
                n += len(s)
                if n > 1_000_000:
                    total += np.bincount(np.concatenate(held), minlength=width).astype(np.uint32)
                    held, n = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=width).astype(np.uint32)
        part = TaskContext.get().partitionId()
        data = [pack(x) for x in total.reshape(-1, SKETCH_CHUNK)]
        yield pa.RecordBatch.from_arrays([pa.array([part] * len(data), pa.int64()), pa.array(range(len(data)), pa.int32()), pa.array(data, pa.binary())], names=["part", "chunk", "data"])

    return merged(docs.select("text").mapInArrow(lean(count), "part long, chunk int, data binary"), width)


def telling_none(n: int, percent: int) -> bool:
    """Whether sets of n are so large that signatures hardly tell them apart: the threshold allows half of all bits to differ."""
    return n * (100 - percent) >= SIGNATURE // 2 * 100


def prefixes(docs: DataFrame, size: int, percent: int, counts, bits: int) -> DataFrame:
    """(id, mark, n, fp, cen, ell, sig, prefix) per row; counts is the broadcast sketch of 2 ** bits counters."""
    shift = np.uint64(64 - bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        est = counts.value
        for b in batches:
            n, fp, cen, ell, sig, pre = [], [], [], [], [], []
            for s in _sets(b.column("text"), size):
                k = len(s)
                n.append(k)
                sig.append(None if telling_none(k, percent) else np.packbits((np.bincount((s & np.uint64(SIGNATURE - 1)).astype(np.int64), minlength=SIGNATURE) & 1).astype(np.uint8)).view(np.int64))
                if not k:
                    fp.append(None), cen.append(0.0), ell.append(0), pre.append(np.zeros(0, np.int64))
                    continue
                fp.append(hashlib.md5(s.tobytes()).digest())
                c = est[s >> shift]
                shortest = k - -(-percent * k // 100) + 1
                most = min(MOST_MATCHES, k - shortest + 1)
                need = shortest + most - 1
                order = np.lexsort((s, c)) if need == k else None
                if order is None:  # the first `need` of the order; ties at the edge by hash
                    edge = np.partition(c, need - 1)[need - 1]
                    near = np.flatnonzero(c <= edge)
                    order = near[np.lexsort((s[near], c[near]))]
                lists = np.cumsum(c[order[:need]])[shortest - 1 : need].astype(np.float64)
                matches = np.arange(1, most + 1)
                l = int(np.argmin(lists * (1 + VERIFY_COST * k / matches))) + 1
                cen.append(float(np.log1p(c).mean())), ell.append(l), pre.append(s[order[: shortest + l - 1]].view(np.int64))
            flat = np.concatenate(pre) if pre else np.zeros(0, np.int64)
            at = np.concatenate(([0], np.cumsum([len(p) for p in pre]))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("mark"), pa.array(n, pa.int32()), pa.array(fp, pa.binary()), pa.array(cen, pa.float32()), pa.array(ell, pa.int32()), pa.array(sig, pa.list_(pa.int64())), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))],
                names=["id", "mark", "n", "fp", "cen", "ell", "sig", "prefix"],
            )

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(lean(run), f"id {kind}, mark binary, n int, fp binary, cen float, ell int, sig array<long>, prefix array<long>")


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Of pairs (a, b) of class keys, those whose sets reach the threshold."""
    spark = pairs.sparkSession
    keys = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct()
    wanted = cut(classes.select("key", "id", "fp").join(keys, "key"), "candidates")
    bits = _bits(wanted.count(), BITMAP_BITS, BITMAP_EACH)
    marks = spark.sparkContext.broadcast(bitmap(wanted, "id", bits))
    kind = docs.schema["id"].dataType.simpleString()

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = marks.value
        for b in batches:
            b = b.filter(pa.array(has(held, b.column("slot").to_numpy())))
            if b.num_rows:
                s = [x.tobytes() for x in _sets(b.column("text"), size)]
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([hashlib.md5(x).digest() for x in s], pa.binary()), pa.array(s, pa.binary())], names=["_id", "_fp", "s"])

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = np.zeros(b.num_rows, bool)
            for i, (x, y) in enumerate(zip(b.column("x"), b.column("y"), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate((x, y))
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                ok[i] = 100 * common >= percent * (len(x) + len(y) - common)
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(ok))

    # a class is found by the id and the fingerprint of its first row, so a further row of the id can't stand in for it
    have = docs.select("id", "text", slot("id", bits).alias("slot")).mapInArrow(lean(sets), f"_id {kind}, _fp binary, s binary")
    have = have.join(wanted, (F.col("_fp") == F.col("fp")) & F.col("_id").eqNullSafe(F.col("id"))).select("key", "s").dropDuplicates(["key"])
    have = cut(have, "sets")
    both = pairs.select("a", "b").join(have.select(F.col("key").alias("a"), F.col("s").alias("x")), "a").join(have.select(F.col("key").alias("b"), F.col("s").alias("y")), "b")
    return cut(both.mapInArrow(lean(reach), "a long, b long"), "links")


def near_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, percent: int = 90) -> DataFrame:
    """One row per input row: id, n_shingles, component_id; two texts link when 100 * common >= percent * union."""
    with arrow_rows(df.sparkSession, BATCH_ROWS):
        out = _near_components(df, id_col, text_col, size, percent)
    return out.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), "component_id")


def _likely(classes: DataFrame, shared: DataFrame) -> DataFrame:
    """(key, pos, tok) of prefixes, less most tokens that aren't shared: a bitmap tells, so that few of those meet the join."""
    bits = _bits(shared.count(), BITMAP_BITS, BITMAP_EACH)
    mask = (1 << bits) - 1
    marks = classes.sparkSession.sparkContext.broadcast(bitmap(shared, "tok", bits, F.col("tok").bitwiseAND(F.lit(mask).cast("long"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("prefix")
            tok, at = lists.flatten().to_numpy(), np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))
            pos = np.arange(len(tok)) - np.repeat(at[:-1], np.diff(at))
            keep = has(marks.value, tok & mask)
            key = np.repeat(b.column("key").to_numpy(), np.diff(at))
            yield pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.array(pos[keep].astype(np.int32)), pa.array(tok[keep])], names=["key", "pos", "tok"])

    return classes.mapInArrow(lean(run), "key long, pos int, tok long")


def _near_components(df: DataFrame, id_col: str, text_col: str, size: int, percent: int) -> DataFrame:
    """(id, n, mark, component, component_id) of every row."""
    spark = df.sparkSession
    docs = _rows(df, id_col, text_col)
    bits = _bits(docs.count(), SKETCH_BITS, SKETCH_EACH)
    counts = spark.sparkContext.broadcast(sketch(docs, size, bits))
    slim = cut(prefixes(docs, size, percent, counts, bits).withColumn("row", F.monotonically_increasing_id()), "prefixes")
    classes = cut(slim.filter("n > 0").groupBy("fp").agg(F.min("id").alias("id"), F.min("row").alias("key"), *[F.first(c).alias(c) for c in ("n", "cen", "ell", "sig", "prefix")]), "classes")
    # lists of one posting go first, in rows as narrow as can be; what a class is like comes to the rest by key
    posts = classes.select("key", F.posexplode("prefix").alias("pos", "tok"))
    shared = cut(posts.groupBy("tok").agg(F.count(F.lit(1)).alias("held")).filter("held > 1").select("tok"), "shared-tokens")
    shared = cut(_likely(classes.select("key", "prefix"), shared).join(shared, "tok").select("tok", "key", "pos"), "shared-postings")
    rank = F.row_number().over(Window.partitionBy("key").orderBy("pos")) - 1
    posts = shared.withColumn("rank", rank).join(classes.select("key", "n", "cen", "ell"), "key")
    heads = posts.groupBy("tok").agg(F.max(F.struct("cen", "key", "n", "ell", "pos", "rank")).alias("top"))
    posts = cut(posts.join(heads, "tok").select("tok", "key", "n", "ell", "pos", "rank", *[F.col(f"top.{x}").alias("p" + x) for x in ("key", "n", "ell", "pos", "rank")]), "postings")

    # what two sets share at most, by a common token and its places; the same for all m common prefix tokens. A token before it
    # that no other class has in its prefix isn't common: the other set holds the later token in its prefix, so it would hold this one there
    around = "(least(rank, prank) + least(n - pos, pn - ppos))"
    alike = f"100 * least(n, pn) >= {percent} * greatest(n, pn) and 100 * {around} >= {percent} * (n + pn - {around})"
    both = [F.count(F.lit(1)).alias("m"), F.min(F.least("ell", "pell")).alias("need"), F.max("pos").alias("pos"), F.max("ppos").alias("ppos"), F.first("n").alias("n"), F.first("pn").alias("pn")]
    enough = f"100 * (m + rest) >= {percent} * (n + pn - m - rest)"
    first = posts.filter(f"key != pkey and {alike}").groupBy("key", "pkey").agg(*both).withColumn("rest", F.expr("least(n - pos, pn - ppos) - 1"))
    first = cut(first.filter(f"2 * m >= need and {enough}").select(F.least("key", "pkey").alias("a"), F.greatest("key", "pkey").alias("b")).distinct(), "star-pairs")
    links = _verified(first, classes, docs, size, percent)
    named = components(links)

    group = named.select(F.col("id").alias("key"), "component")
    own = cut(posts.select("tok", "key", "n", "ell", "pos").join(group, "key", "left").withColumn("c", F.coalesce("component", "key")).drop("component"), "placed")
    main = own.groupBy("tok", "c").agg(F.count(F.lit(1)).alias("k"), F.min("ell").alias("ell")).groupBy("tok").agg(F.max_by("c", F.struct("k", "c")).alias("main"), F.count(F.lit(1)).alias("kinds"), F.min("ell").alias("lm")).filter("kinds > 1").select("tok", "main", "lm")
    # between components, only tokens that two of them hold can be common; who has fewer of those than a pair needs meets nobody.
    # Signatures come in last, where rows lie by key already
    held = F.count(F.lit(1)).over(Window.partitionBy("key"))
    rest = own.join(main, "tok").withColumns({"rank": rank, "held": held}).filter("held >= least(ell, lm)").drop("held", "lm")
    rest = cut(rest.join(classes.select("key", "sig"), "key"), "across")
    odd = rest.filter("c != main").drop("main")
    other = rest.select("tok", *[F.col(x).alias("p" + x) for x in ("key", "n", "ell", "pos", "rank", "sig", "c")], "main")
    apart = " + ".join(f"bit_count(sig[{i}] ^ psig[{i}])" for i in range(SIGNATURE // 64))
    met = odd.join(other, "tok").filter(f"c != pc and (pc = main or key < pkey) and {alike} and (sig is null or psig is null or ({apart}) * {100 + percent} <= {100 - percent} * (n + pn))")
    flip = F.col("key") > F.col("pkey")
    met = met.select(*[F.when(flip, F.col("p" + x)).otherwise(F.col(x)).alias(x) for x in ("key", "n", "pos", "ell")], *[F.when(flip, F.col(x)).otherwise(F.col("p" + x)).alias("p" + x) for x in ("key", "n", "pos", "ell")])
    second = met.groupBy("key", "pkey").agg(*both).withColumn("rest", F.expr("least(n - pos, pn - ppos) - 1")).filter(f"m >= need and {enough}").select(F.col("key").alias("a"), F.col("pkey").alias("b"))
    second = cut(second.join(first, ["a", "b"], "left_anti"), "pairs")
    return _labelled(slim, classes, named, _verified(second, classes, docs, size, percent))


def _labelled(slim: DataFrame, classes: DataFrame, named: DataFrame, links: DataFrame) -> DataFrame:
    """(id, n, mark, component, component_id) of every row; links are those of class keys not in named, and equal ids link too."""
    least = F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("least")).alias("least")
    rows = slim.select("id", "n", "fp", "mark", "row").join(classes.select("fp", "key", F.col("id").alias("least")), "fp", "left")
    rows = cut(rows.select("id", "n", "mark", F.coalesce("key", "row").alias("key"), least), "rows")
    repeated = rows.filter("id is not null").groupBy("id").agg(F.min("key").alias("b"), F.max("key").alias("most")).filter("b != most").select("id", "b")
    links = cut(links.unionByName(rows.join(repeated, "id").select(F.col("key").alias("a"), "b").filter("a != b").distinct()), "further-links")
    if not links.isEmpty():
        named = components(links.unionByName(named.select(F.col("id").alias("a"), F.col("component").alias("b"))))
    named = named.withColumnRenamed("id", "key")
    least = named.join(rows.select("key", "least").distinct(), "key").groupBy("component").agg(F.min("least").alias("component_id"))
    label = cut(named.join(least, "component").select("key", "component", "component_id"), "labels")
    own = F.when(F.col("component").isNull(), F.col("least")).otherwise(F.col("component_id"))
    return rows.join(label, "key", "left").select("id", "n", "mark", F.coalesce("component", "key").alias("component"), own.alias("component_id"))


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """df with one document of each group of near copies, the one with the smallest id; all columns of df.

    Rows that repeat that id are the same document and stay. A group without any id keeps the text of the smallest hash.
    """
    with arrow_rows(df.sparkSession, BATCH_ROWS):
        rows = cut(_near_components(df, id_col, text_col, size, percent), "near-copies")
    gone = small(rows.filter("id != component_id").select(F.col("id").alias("_gone")))
    out = df.join(gone, df[id_col] == gone["_gone"], "left_anti")
    nameless = rows.filter("id is null and n > 0")
    if nameless.isEmpty():
        return out
    stays = nameless.filter("component_id is null").groupBy("component").agg(F.min("mark").alias("mark"))
    nameless = nameless.join(stays, ["component", "mark"], "left_anti").select(F.col("mark").alias("_gone")).distinct()
    return out.join(nameless, df[id_col].isNull() & (_mark(df[text_col]) == nameless["_gone"]), "left_anti")
