"""Language-model scores by the likelihood of a subword lattice.

The pieces of an existing vocabulary span a lattice over every lower-cased word (a mark, then
its characters); characters that no piece covers take their UTF-8 byte pieces. Each
segmentation is weighted by the product of its pieces' probabilities, and a forward recursion in log space
gives the marginal probability of the word over all segmentations. A text is its words and
one end piece, so its probability is the product of theirs.

Learning: the vocabulary's own scores weight the segmentations of all training words; the
expected piece counts (forward-backward over every word type of all training texts) give the
piece probabilities, in a few rounds, each over all of them. Every word of the training texts
gets an arc of its own beside the pieces, weighted by its discounted count; what is discounted goes to the pieces.
Training texts of one labelled group (`group_col`, at most `groups` groups, and the rest) have
their own counts, and a text's probability is the mixture over groups of its products, so that
pieces and words need not be alike in every language. The group of a scored text is never read.

Every distinct word of all texts is summed up once. Frequent words (at least 1 / HEAVY of the words of all texts, so at
most HEAVY of them) are looked up in broadcast tables; the others meet their counts and log marginals by a
shuffle join, so nothing is dropped and what is broadcast has a fixed bound.

Defined results: null and empty texts are one end token; without training texts all counts are 0 and
pieces keep the vocabulary's scores; rows that repeat an id are scored each; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilestrata.llm._text import LENGTH_SALT, LOWER, U64, chunks, gather, mix64, powers, substring_hashes, text_buffers, word_hashes
from tilestrata.llm.sentencepiece_codec import MARK, Vocabulary
from tilestrata.llm.storage import arrow_rows, cut

HEAVY = 1 << 20
#: Rounds for all groups together before the last, which tells them apart.
WARM_ROUNDS = 3
#: Group of the texts that nothing is learned from, whose words are only scored.
UNSEEN = -1
#: Share of the whole in a group's piece probabilities, and what a word's arc is discounted by.
WHOLE, DISCOUNT = 0.02, 0.75
#: Rows of an Arrow batch of texts.
BATCH_ROWS = 4000
LN10 = math.log(10)

_cached: dict[str, object] = {}


class Lattice:
    """Sums over the segmentations of many words at once, in log space, for several score tables.

    Words are UTF-8; since pieces are UTF-8 too, a piece can only match between characters.
    Every substring's rolling hash is looked up among the pieces of its length.
    """

    #: Cells of the forward table at once.
    CELLS = 1 << 20
    FILTER_BITS = 20

    def __init__(self, vocabulary: Vocabulary, scores: np.ndarray) -> None:
        """scores: log probability by group and piece."""
        self.v, self.scores = vocabulary, np.ascontiguousarray(scores.T)
        mark = MARK.encode()
        pieces = [(i, p) for i in vocabulary.usable if MARK not in (p := vocabulary.pieces[i])[1:]]
        raw = [p.encode() for _, p in pieces]
        data = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum([0, *map(len, raw)])
        hashes = substring_hashes(data, ends[:-1], ends[1:])
        size, ids = np.diff(ends), np.array([i for i, _ in pieces], np.int32)
        self.known = np.zeros(1 << self.FILTER_BITS, bool)
        self.known[hashes >> U64(64 - self.FILTER_BITS)] = True
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], ids[order]
        slot = self.hashes >> U64(64 - self.FILTER_BITS)
        self.first = np.searchsorted(slot, np.arange(1 << self.FILTER_BITS, dtype=U64)).astype(np.int32)
        self.most = int(np.bincount(slot.astype(np.int64)).max())  # hashes of one slot
        self.sizes = np.unique(size)
        self.single = np.zeros(len(vocabulary.pieces), bool)
        self.single[[i for i, p in pieces if len(p) == 1]] = True
        self.mark = np.frombuffer(mark, np.uint8)
        spelled = np.full(256, vocabulary.unknown, np.int32)
        for byte, i in vocabulary.bytes.items():
            spelled[byte] = i
        self.spelled = spelled

    def _led(self, words: np.ndarray, offsets: np.ndarray):
        """Words with the mark before each."""
        size = np.diff(offsets) + len(self.mark)
        at = np.concatenate(([0], np.cumsum(size)))
        out = np.empty(at[-1], np.uint8)
        for k, byte in enumerate(self.mark):
            out[at[:-1] + k] = byte
        body = np.ones(at[-1], bool)
        for k in range(len(self.mark)):
            body[at[:-1] + k] = False
        out[body] = words[np.arange(offsets[-1] - offsets[0]) + offsets[0]] if len(offsets) > 1 else 0
        return out, at

    def _arcs(self, data: np.ndarray, at: np.ndarray):
        """(word, start, end, piece) of all arcs; starts and ends are relative to the word."""
        n = len(at) - 1
        size = np.diff(at)
        owner = np.repeat(np.arange(n, dtype=np.int32), size)
        left = at[1:][owner] - np.arange(len(data))  # bytes from here to the word's end
        up, down = powers(len(data) + 1)
        with np.errstate(over="ignore"):
            sums = np.zeros(len(data) + 1, U64)
            np.cumsum((data.astype(U64) + U64(1)) * up[: len(data)], out=sums[1:])
        starts, ends, pieces = [], [], []
        shift = U64(64 - self.FILTER_BITS)
        here = np.arange(len(data))
        for k in self.sizes.tolist():
            here = here[left[here] >= k]
            if not len(here):
                break
            with np.errstate(over="ignore"):
                h = mix64(((sums[here + k] - sums[here]) * down[here]) ^ (U64(k) * LENGTH_SALT))
            slot = (h >> shift).astype(np.int64)
            likely = np.flatnonzero(self.known[slot])
            h, p, place = h[likely], here[likely], self.first[slot[likely]]
            for _ in range(self.most - 1):
                place = np.minimum(place + (self.hashes[place] < h), len(self.hashes) - 1)
            hit = self.hashes[place] == h
            starts.append(p[hit])
            ends.append(p[hit] + k)
            pieces.append(self.ids[place[hit]])
        start, end, piece = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, ends, pieces))
        first = (data & 0xC0) != 0x80
        first[at[:-1][size > 0]] = True
        covered = np.zeros(len(data), bool)
        covered[start[self.single[piece]]] = True
        lead = np.maximum.accumulate(np.where(first, np.arange(len(data)), 0)) if len(data) else np.zeros(0, np.int64)
        bare = np.flatnonzero(~covered[lead])  # bytes of characters without a piece
        start, end, piece = np.concatenate((start, bare)), np.concatenate((end, bare + 1)), np.concatenate((piece, self.spelled[data[bare]]))
        word = owner[start]
        return word, start - at[word], end - at[word], piece

    @staticmethod
    def _order(word: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Arcs by place and word; keys of 16 bits, where they fit, are sorted by radix."""
        return np.lexsort([k.astype(np.uint16) if len(k) and k.max() < 1 << 16 else k for k in (word, at)])

    @staticmethod
    def _log_sums(x: np.ndarray, key: np.ndarray):
        """(keys, log of summed exponentials of x by runs of equal keys)."""
        edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        top = np.maximum.reduceat(x, edge, axis=0)
        run = np.repeat(np.arange(len(edge)), np.diff(np.append(edge, len(key))))
        return key[edge], top + np.log(np.add.reduceat(np.exp(x - top[run]), edge, axis=0))

    def _blocks(self, offsets: np.ndarray):
        """Words of like length, so many that the forward table stays small."""
        size = np.diff(offsets) + len(self.mark) + 1
        order = np.argsort(size, kind="stable")
        size, width, lo = size[order], self.scores.shape[1], 0
        while lo < len(order):
            most = 1 + self.CELLS // (int(size[lo]) * width)
            cells = np.arange(1, len(size[lo : lo + most]) + 1) * size[lo : lo + most] * width
            hi = lo + max(1, int(np.searchsorted(cells, self.CELLS, side="right")))
            yield order[lo:hi]
            lo = hi

    def _forward(self, word, start, end, piece, n: int, longest: int) -> np.ndarray:
        order = self._order(word, end)
        word, start, end, gain = word[order], start[order], end[order], self.scores[piece[order]]
        a = np.full((n, longest + 1, self.scores.shape[1]), -np.inf)
        a[:, 0] = 0.0
        edges = np.flatnonzero(np.concatenate(([True], end[1:] != end[:-1], [True]))) if len(end) else []
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            w, x = self._log_sums(a[word[lo:hi], start[lo:hi]] + gain[lo:hi], word[lo:hi])
            a[w, end[lo]] = x
        return a

    def forward(self, words: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Log marginal probability of each word by group; words are bytes, cut at offsets."""
        out = np.empty((len(offsets) - 1, self.scores.shape[1]))
        for pick in self._blocks(offsets):
            data, at = self._led(*gather(words, offsets[pick], offsets[pick + 1]))
            size = np.diff(at)
            a = self._forward(*self._arcs(data, at), len(pick), int(size.max()))
            out[pick] = a[np.arange(len(pick)), size]
        return out

    def expect(self, words: np.ndarray, offsets: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected pieces, each word taken `weight` times (or a row of them for each row of weights), by the first score table."""
        total = np.zeros((*weight.shape[:-1], len(self.scores)))
        for pick in self._blocks(offsets):
            data, at = self._led(*gather(words, offsets[pick], offsets[pick + 1]))
            size = np.diff(at)
            word, start, end, piece = self._arcs(data, at)
            a = self._forward(word, start, end, piece, len(pick), int(size.max()))[:, :, 0]
            gain = self.scores[piece, 0]
            b = np.full(a.shape, -np.inf)
            b[np.arange(len(pick)), size] = 0.0
            order = self._order(word, size.max() - start)
            edges = np.flatnonzero(np.concatenate(([True], np.diff(start[order]) != 0, [True])))
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                o = order[lo:hi]
                w, x = self._log_sums((b[word[o], end[o]] + gain[o])[:, None], word[o])
                b[w, start[o[0]]] = x[:, 0]
            share = np.exp(a[word, start] + gain + b[word, end] - a[word, size[word]])
            for row, times in zip(np.atleast_2d(total), np.atleast_2d(weight), strict=True):
                row += np.bincount(piece, share * times[pick][word], minlength=len(row))
        return total


def _normal(counts: np.ndarray, smooth: float = 0.01) -> np.ndarray:
    return np.log((counts + smooth) / (counts.sum() + smooth * len(counts)))


def _vocabulary(model: bytes) -> Vocabulary:
    if _cached.get("model") != model:
        _cached.clear()
        _cached.update(model=model, vocabulary=Vocabulary(model))
    return _cached["vocabulary"]


def _lattice(model: bytes, scores: np.ndarray) -> Lattice:
    v, key = _vocabulary(model), (len(scores), float(scores.sum()))
    if _cached.get("lattice_key") != key:
        _cached.update(lattice_key=key, lattice=Lattice(v, scores))
    return _cached["lattice"]


def _arc(counts: np.ndarray, tokens: float) -> np.ndarray:
    """Log weights of words' arcs in a group; none without a count."""
    with np.errstate(divide="ignore"):
        return np.log(np.where(counts > 0, counts - DISCOUNT, 0.0)) - math.log(max(tokens, 1))


class Words:
    """Hashes of all words of a batch, range of words by row, and the bytes of chosen words."""

    def __init__(self, column) -> None:
        self.data, offsets = text_buffers(column)
        parts, self.range = [], [np.zeros(1, np.int64)]
        n = 0
        for lo, hi in chunks(offsets):
            h, starts, ends, rng = word_hashes(self.data, offsets[lo : hi + 1])
            parts.append((h, starts, ends))
            self.range.append(rng[1:] + n)
            n += len(h)
        self.range = np.concatenate(self.range)
        none = np.zeros(0, np.int64)
        self.hashes, self.starts, self.ends = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (none.view(U64), none, none)

    def bytes_of(self, index: np.ndarray):
        """(lower-cased bytes, offsets) of words."""
        data, at = gather(self.data, self.starts[index], self.ends[index])
        return LOWER[data], at


def word_counts(train: DataFrame) -> DataFrame:
    """(grp, h, w, c) of the lower-cased words of (grp, text), counted over all rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, grp = Words(b.column("text")), b.column("grp").to_numpy()
            owner = np.repeat(grp, np.diff(words.range))
            for g in np.unique(owner):
                at = np.flatnonzero(owner == g)
                u, first, c = np.unique(words.hashes[at], return_index=True, return_counts=True)
                data, offsets = words.bytes_of(at[first])
                text = pa.Array.from_buffers(pa.binary(), len(u), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(u), g, np.int32)), pa.array(u.view(np.int64)), text, pa.array(c)], names=["grp", "h", "w", "c"])

    return train.mapInArrow(count, "grp int, h long, w binary, c long").groupBy("grp", "h", "w").agg(F.sum("c").alias("c"))


def fit(words: DataFrame, weights: list[Column], model: bytes) -> np.ndarray:
    """Log probabilities by group and piece, from all words (w); weights: how often each counts in a group.

    Every round reads every word.
    """
    v = _vocabulary(model)
    size = len(v.scores)
    used = [*v.usable, *v.bytes.values(), v.unknown]

    def normal(c: np.ndarray) -> np.ndarray:
        out = np.full(size, -60.0)
        out[used] = _normal(c[used])
        return out

    def expected(scores: np.ndarray, weights: list[Column]) -> np.ndarray:
        """Expected counts by weight and piece."""
        names = [f"k{g}" for g in range(len(weights))]
        send = words.sparkSession.sparkContext.broadcast((model, scores))

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model, scores = send.value
            lattice, total = Lattice(_vocabulary(model), scores[None]), np.zeros((len(names), size))
            for b in batches:
                total += lattice.expect(*text_buffers(b.column("w")), np.stack([b.column(k).to_numpy() for k in names]))
            g, p = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(g.astype(np.int32)), pa.array(p.astype(np.int32)), pa.array(total[g, p])], names=["g", "p", "e"])

        weighed = words.select("w", *[k.cast("double").alias(name) for k, name in zip(weights, names, strict=True)])
        total = np.zeros((len(names), size))
        for g, p, e in weighed.mapInArrow(sums, "g int, p int, e double").groupBy("g", "p").agg(F.sum("e").alias("e")).collect():
            total[g, p] = e
        return total

    scores = np.array(v.scores)
    for _ in range(WARM_ROUNDS):
        total = expected(scores, [sum(weights[1:], weights[0])])[0]
        if not total.any():
            return np.repeat(scores[None], len(weights), axis=0)
        scores = normal(total)
    total = expected(scores, weights)
    whole = normal(total.sum(axis=0))
    return np.stack([np.logaddexp(math.log(WHOLE) + whole, math.log(1 - WHOLE) + normal(t)) if t.sum() else whole for t in total])


def score(df: DataFrame, model: bytes, train: Column, id_col: str = "doc_id", text_col: str = "text", group_col: str | None = None, groups: int = 8) -> DataFrame:
    """One row per input row: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    train: whether a row is learned from. base_score: smoothed word unigrams; score: the lattice's log10 probability.
    """
    with arrow_rows(df.sparkSession, BATCH_ROWS):
        return _score(df, model, train, id_col, text_col, group_col, groups)


def _score(df: DataFrame, model: bytes, train: Column, id_col: str, text_col: str, group_col: str | None, groups: int) -> DataFrame:
    spark = df.sparkSession
    rows = df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), (F.col(group_col).cast("string") if group_col else F.lit(None).cast("string")).alias("_g"), train.alias("_train"))
    learn = rows.filter("_train")
    tops = learn.groupBy("_g").count().filter("_g is not null").orderBy(F.desc("count"), "_g").limit(groups).collect()
    names = sorted(r["_g"] for r in tops)
    group = F.lit(len(names))
    for i, g in enumerate(names):
        group = F.when(F.col("_g") == g, i).otherwise(group)
    rows = rows.withColumn("grp", F.when(F.col("_train"), group).otherwise(UNSEEN).cast("int"))
    ends = np.zeros(len(names) + 1)
    for g, n in rows.filter("_train").groupBy("grp").count().collect():
        ends[g] = n
    learned = {"c": F.col("grp") != UNSEEN} | {f"c{g}": F.col("grp") == g for g in range(len(ends))}
    by_group = [F.sum(F.when(where, F.col("c")).otherwise(0)).alias(name) for name, where in learned.items()]
    words = cut(word_counts(rows.select("grp", "text")).groupBy("h").agg(F.sum("c").alias("n"), F.min("w").alias("w"), *by_group), "words")
    every, total, kinds = words.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "c")], F.count(F.when(F.col("c") > 0, 1))).first()
    end = int(ends.sum())
    total, kinds = int(total) + end, int(kinds) + (end > 0)
    frequent = F.col("n") * HEAVY >= int(every)
    table = fit(words.filter("c > 0"), [F.when(F.col(f"c{g}") > 0, DISCOUNT).otherwise(0.0) for g in range(len(ends))], model)
    sums = words.agg(*[f(F.col(f"c{g}")).alias(f"{n}{g}") for g in range(len(ends)) for n, f in (("t", F.sum), ("k", lambda c: F.sum(F.when(c > 0, c - DISCOUNT))))]).first()
    tokens = np.array([float(sums[f"t{g}"] or 0) for g in range(len(ends))])
    kept = np.array([float(sums[f"k{g}"] or 0) for g in range(len(ends))])
    other = np.log(np.maximum(1e-9, 1 - kept / np.maximum(tokens, 1)))
    stop = np.log((ends + 0.5) / (tokens + ends + 1))
    word = np.log1p(-np.exp(stop))
    keep = [i for i in range(len(ends)) if ends[i]] or [0]
    weights = np.log(np.maximum(ends[keep], 1) / max(1, ends[keep].sum()))
    of_group = [f"p{i}" for i in range(len(keep))]
    least = math.log10(total + 0.1 * (kinds + 1)) if total else 0.0
    fitted = spark.sparkContext.broadcast((model, table[keep], tokens[keep], word[keep], (other + word)[keep]))

    def marginals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Log marginal of each word by group, over its pieces and its arc."""
        model, scores, tokens, word, other = fitted.value
        lattice = _lattice(model, scores)
        for b in batches:
            pieces = lattice.forward(*text_buffers(b.column("w"))) + other
            of = [np.logaddexp(pieces[:, i], _arc(b.column(f"c{g}").to_numpy().astype(float), tokens[i]) + word[i]) for i, g in enumerate(keep)]
            yield pa.RecordBatch.from_arrays([b.column("h"), b.column("c"), *map(pa.array, of)], names=["h", "c", *of_group])

    def values(words: DataFrame) -> DataFrame:
        return words.select("h", "c", "w", *[f"c{g}" for g in keep]).mapInArrow(marginals, f"h long, c long, {', '.join(f'{p} double' for p in of_group)}")

    heavy = values(words.filter(frequent)).toPandas().sort_values("h")
    send = spark.sparkContext.broadcast((heavy["h"].to_numpy(np.int64), heavy["c"].to_numpy(np.int64), [heavy[p].to_numpy(float) for p in of_group], stop[keep] + weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums over the frequent words of a text, and its other words with their counts."""
        heavy_h, heavy_c, marginal, ends = send.value
        ready = np.log10(heavy_c + 0.1)
        for b in batches:
            n = b.num_rows
            words = Words(b.column("text"))
            owner, signed = np.repeat(np.arange(n), np.diff(words.range)), words.hashes.view(np.int64)
            at = np.minimum(np.searchsorted(heavy_h, signed), max(0, len(heavy_h) - 1))
            hit = heavy_h[at] == signed if len(heavy_h) else np.zeros(len(signed), bool)
            whose, at = owner[hit], at[hit]
            per = [np.bincount(whose, x[at], n) + end for x, end in zip(marginal, ends, strict=True)]
            base = np.bincount(whose, ready[at], n).astype(float)
            known = np.bincount(whose[heavy_c[at] > 0], minlength=n)
            whose, light = owner[~hit], signed[~hit]
            order = np.lexsort((light, whose))
            whose, light = whose[order], light[order]
            first = np.flatnonzero(np.concatenate(([True], (light[1:] != light[:-1]) | (whose[1:] != whose[:-1]))) if len(light) else [])
            tf = np.diff(np.append(first, len(light))).astype(np.int32)
            rest = pa.array(np.concatenate(([0], np.cumsum(np.bincount(whose[first], minlength=n)))).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [b.column("_id"), b.column("_train"), pa.array(np.diff(words.range) + 1), pa.array(known), pa.array(base), *map(pa.array, per), pa.ListArray.from_arrays(rest, pa.array(light[first])), pa.ListArray.from_arrays(rest, pa.array(tf))],
                names=["_id", "_train", "n", "known", "base", *of_group, "hs", "ns"],
            )

    slim = rows.select("_id", "text", "_train")
    schema = slim.schema["_id"].dataType.simpleString()
    scored = slim.mapInArrow(run, f"_id {schema}, _train boolean, n long, known long, base double, {', '.join(f'{p} double' for p in of_group)}, hs array<long>, ns array<int>")
    scored = cut(scored.withColumn("_row", F.monotonically_increasing_id()), "scored")
    light = scored.select("_row", F.explode(F.arrays_zip("hs", "ns")).alias("x")).select("_row", F.col("x.hs").alias("h"), F.col("x.ns").alias("tf"))
    seen = light.join(values(words.filter(~frequent)), "h", "left")
    count = F.coalesce("c", F.raise_error(F.lit("a text differs from what it was when its words were counted")).cast("long"))
    value = F.log10(count + F.lit(0.1)) * F.col("tf")
    rest = seen.groupBy("_row").agg(F.sum(value).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("few"), *[F.sum(F.col(p) * F.col("tf")).alias(f"_{p}") for p in of_group])
    out = scored.drop("hs", "ns").join(rest, "_row", "left")
    out = out.withColumns({p: F.col(p) + F.coalesce(f"_{p}", F.lit(0.0)) for p in of_group})
    top = F.greatest(*of_group) if len(of_group) > 1 else F.col("p0")
    lm = (top + F.log(sum((F.exp(F.col(p) - top) for p in of_group), F.lit(0.0)))) / LN10
    tail = math.log10(end + 0.1)
    return out.select(
        F.col("_id").alias(id_col),
        (~F.col("_train")).alias("held_out"),
        F.col("n").alias("n_tokens"),
        (F.col("known") + F.coalesce("few", F.lit(0)) + int(end > 0)).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0)) + tail - F.col("n") * least).alias("base_score"),
        lm.alias("score"),
    )
