"""Language identification by cross-parsing entropy.

Fit: a bounded sample of labelled text per language (`sample_docs` documents with the
smallest hashed ids, `doc_symbols` symbols of each, from a hashed place of the whole text) becomes a suffix automaton; letters
are lower-cased and every run of other characters is one separator symbol.

Predict: the whole text is parsed greedily into the longest phrases that occur in a language's
sample. Phrases are normalised to bits a symbol, phrases * log2(sample length) / symbols, and the
language with the fewest wins; ties go to the alphabetically first. score is its share
of 2 ** (-SHARPNESS * bits) over all languages.

Missing transitions of the automata start a new phrase at the root. Transitions by the most frequent letters
are dense tables, those by all other letters of any sample a hash table, so that alphabets of any size are told
apart and thousands of segments are parsed in lockstep with array operations. Texts are parsed in
segments of `SEGMENT` symbols (a cut ends a phrase), which bounds memory and time for any length.

Every label is learned. Tables of more than `HELD` sample symbols are built and used by blocks of languages, over
each task's rows again, with the same results.

Defined results: null texts, and texts without a letter, get `und` and score 0; without any labelled
text all get `und`; rows are judged one by one, so ties, repeats and other columns do not matter; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tilestrata.llm.storage import fresh
from tilestrata.llm.workers import keep, lean

UNKNOWN = "und"
SEGMENT = 1024
SHARPNESS = 6.0
#: Texts judged at once, and symbols parsed in lockstep.
ROWS = 1000
BLOCK = 1 << 20
#: Most letters of the dense tables, and most cells; transitions by other letters are hashed, with the same results.
ALPHABET, CELLS = 120, 40_000_000
#: Most sample symbols of languages whose tables a worker holds at once.
HELD = 1 << 21
#: What a letter takes in an alphabet of 32.
LETTER_BITS = 5.0

_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def normalised(text: str) -> str:
    """Lower-cased letters; every other run is one space."""
    p = _points(text.lower())
    p = np.where(_is_letter()[p], p, np.uint32(32))
    keep = np.ones(len(p), bool)
    keep[1:] = (p[1:] != 32) | (p[:-1] != 32)
    return p[keep].tobytes().decode("utf-32-le", "surrogatepass")


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton; state 0 is the root."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        cur = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = cur
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = link[cur] = copy
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
        last = cur
    return step


class Hashed:
    """Values by key (not negative), in open addressing."""

    MIX = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        slot, left = self._slots(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[slot[left]] < 0]
            self.keys[slot[free]] = keys[free]
            left = left[self.keys[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) & self.mask
        self.values[slot] = values

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * self.MIX) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Value of each key, -1 where there is none."""
        slot = self._slots(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], np.int32(-1))
        left = np.flatnonzero((found != keys) & (found >= 0))
        while len(left):
            slot[left] = (slot[left] + 1) & self.mask
            found = self.keys[slot[left]]
            hit = found == keys[left]
            out[left[hit]] = self.values[slot[left[hit]]]
            left = left[~hit & (found >= 0)]
        return out


class Tables:
    """Transitions of all languages: next state * 2 + (1 if a new phrase starts).

    Codes: 0 the separator, then the letters of all samples by frequency, `width` of these codes in the dense
    table; the last code is that of letters of no sample, which never match.
    """

    def __init__(self, samples: tuple[tuple[str, str], ...]) -> None:
        self.langs = [lang for lang, _ in samples]
        letters, counts = np.unique(np.concatenate([_points(t) for _, t in samples]), return_counts=True)
        letters = letters[letters != 32][np.argsort(-counts[letters != 32], kind="stable")]
        self.other = len(letters) + 1
        self.code = np.zeros(0x110000, np.int32)
        self.code[_is_letter()] = self.other
        self.code[letters] = np.arange(1, self.other)
        most = 2 * sum(len(t) for _, t in samples)
        self.width = max(1, min(self.other, ALPHABET + 1, CELLS // max(1, most)))
        self.table = np.empty(most * self.width, np.int32)  # states never reached take no memory
        keys, values, self.root, self.bits, at = [], [], [], [], 0
        self.fresh = np.empty((len(samples), self.other + 1), np.int32)
        for k, (_, text) in enumerate(samples):
            steps = suffix_automaton(self.code[_points(text)].tolist())
            self.fresh[k] = at * 2 + 1
            for c, to in steps[0].items():
                self.fresh[k, c] = (at + to) * 2 + 1
            table = self.table[at * self.width : (at + len(steps)) * self.width].reshape(-1, self.width)
            table[:] = self.fresh[k, : self.width]
            sizes = np.fromiter(map(len, steps), np.int32, len(steps))
            many = int(sizes.sum())
            rows = np.repeat(np.arange(len(steps), dtype=np.int32), sizes)
            cols = np.fromiter((c for s in steps for c in s), np.int32, many)
            to = np.fromiter((t for s in steps for t in s.values()), np.int32, many)
            del steps
            dense = cols < self.width
            table[rows[dense], cols[dense]] = (at + to[dense]) * 2
            keys.append((at + rows[~dense]).astype(np.int64) * (self.other + 1) + cols[~dense])
            values.append((at + to[~dense]) * 2)
            self.root.append(at)
            self.bits.append(np.log2(max(2, len(text))))
            at += len(table)
        self.rare = Hashed(np.concatenate(keys), np.concatenate(values))

    def phrases(self, symbols: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Phrases of each text (rows) by language (columns)."""
        n = len(offsets) - 1
        sizes = np.diff(offsets)
        pieces = -(-sizes // SEGMENT)
        owner = np.repeat(np.arange(n), pieces)
        first = np.cumsum(pieces) - pieces
        start = offsets[:-1][owner] + (np.arange(len(owner)) - first[owner]) * SEGMENT
        length = np.minimum(SEGMENT, offsets[1:][owner] - start)
        order = np.argsort(-length, kind="stable")
        start, length = start[order], length[order]
        alive = np.searchsorted(-length, -np.arange(1, SEGMENT + 1), side="right")
        lanes, langs = len(start), len(self.langs)
        state = np.repeat(np.array(self.root, np.int32)[:, None], lanes, axis=1)
        count = np.ones((langs, lanes), np.int32)
        for t in range(int(length[0]) if lanes else 0):
            k = int(alive[t])
            now = symbols[start[:k] + t]
            rare = np.flatnonzero(now >= self.width)
            v = self.table[state[:, :k] * np.int32(self.width) + np.where(now < self.width, now, 0) if len(rare) else state[:, :k] * np.int32(self.width) + now]
            if len(rare):
                v[:, rare] = self._rare(state[:, rare], now[rare])
            count[:, :k] += v & 1
            state[:, :k] = v >> 1
        out = np.zeros((n, langs))
        for j in range(langs):
            out[:, j] = np.bincount(owner[order], weights=count[j], minlength=n)
        return out

    def _rare(self, state: np.ndarray, now: np.ndarray) -> np.ndarray:
        """Transitions by codes that the dense table lacks."""
        out = self.fresh[:, now]
        some = np.flatnonzero(now < self.other)
        keys = state[:, some].astype(np.int64) * (self.other + 1) + now[some]
        to = self.rare.find(keys.reshape(-1)).reshape(keys.shape)
        out[:, some] = np.where(to >= 0, to, out[:, some])
        return out

    def bits_per_symbol(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bits by text and language, letters of each text, symbols of each text)."""
        rates, letters, symbols = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64), np.ones(len(texts), np.int64)
        lo = 0
        while lo < len(texts):
            hi, size = lo, 0
            while hi < len(texts) and (hi == lo or size + len(texts[hi] or "") <= BLOCK):
                size += len(texts[hi] or "")
                hi += 1
            lowered = [(t or "").lower() for t in texts[lo:hi]]
            ends = np.cumsum([0, *map(len, lowered)])
            codes = self.code[_points("".join(lowered))]
            letter = codes != 0
            keep = letter.copy()
            keep[1:] |= letter[:-1]
            if len(keep):
                keep[0] = True
            inside = ends[:-1][ends[:-1] < len(keep)]
            keep[inside] = True
            before = np.concatenate(([0], np.cumsum(keep)))
            offsets = before[ends]
            letters[lo:hi] = np.diff(np.concatenate(([0], np.cumsum(letter)))[ends])
            found = self.phrases(codes[keep], offsets)
            symbols[lo:hi] = np.maximum(1, np.diff(offsets))
            rates[lo:hi] = found * np.array(self.bits) / symbols[lo:hi, None]
            lo = hi
        return rates, letters, symbols


def tables(samples: tuple[tuple[str, str], ...]) -> Tables:
    """Built once in each Python worker."""
    return keep(("languages", samples), lambda: Tables(samples))


def blocks(samples: tuple[tuple[str, str], ...]) -> list[tuple[tuple[str, str], ...]]:
    """Samples in order, so many together as HELD allows."""
    out: list[list] = []
    size = 0
    for lang, text in samples:
        if not out or size + len(text) > HELD:
            out.append([])
            size = 0
        out[-1].append((lang, text))
        size += len(text)
    return [tuple(b) for b in out]


def learn(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = 128, doc_symbols: int = 800) -> tuple[tuple[str, str], ...]:
    """(language, sample text) of every label; at most sample_docs * doc_symbols symbols a label reach the driver."""
    rows = labelled.select(F.xxhash64(F.col(id_col).cast("string")).alias("h"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).filter("lang is not null and text is not null")
    # several times the symbols wanted, since runs of other characters shrink to one
    place = F.pmod(F.col("h"), F.greatest(F.length("text") - 4 * doc_symbols, F.lit(0)) + 1).cast("int") + 1
    rows = rows.select("lang", "h", F.col("text").substr(place, F.lit(4 * doc_symbols)).alias("t"))
    by = Window.partitionBy("lang").orderBy("h", "t")
    sample = rows.withColumn("k", F.row_number().over(by)).filter(F.col("k") <= sample_docs).select("lang", "k", "t")

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = [normalised(x)[:doc_symbols].strip() for x in b.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("k"), pa.array(t, pa.string())], names=["lang", "k", "t"])

    got: dict[str, list] = {}
    for r in sample.mapInArrow(lean(short), "lang string, k int, t string").collect():
        got.setdefault(r["lang"], []).append((r["k"], r["t"]))
    out = [(lang, "".join(t + " " for _, t in sorted(got[lang]))) for lang in sorted(got)]
    return tuple((lang, t) for lang, t in out if t.strip())


class Verdict:
    """The best language of each text of a batch, over the blocks of languages so far."""

    def __init__(self, n: int) -> None:
        self.pred, self.least, self.mass, self.letters = np.full(n, UNKNOWN, object), np.full(n, np.inf), np.zeros(n), np.zeros(n, np.int64)
        self.excess = np.zeros(n)

    def add(self, known: Tables, texts: list[str | None]) -> None:
        rates, self.letters, symbols = known.bits_per_symbol(texts)
        best = rates.argmin(axis=1)
        found = rates[np.arange(len(texts)), best]
        least = np.minimum(self.least, found)
        self.mass = self.mass * np.exp2(-SHARPNESS * (self.least - least)) + np.exp2(-SHARPNESS * (rates - least[:, None])).sum(axis=1)
        self.excess = np.where(found < self.least, found - np.array(known.bits)[best] / symbols, self.excess)
        self.pred = np.where(found < self.least, np.array(known.langs, object)[best], self.pred)
        self.least = least

    def columns(self) -> list[pa.Array]:
        some = self.letters > 0
        pred = np.where(some, self.pred, UNKNOWN)
        score, bits, excess = (np.where(some, x, 0.0) for x in (1 / np.maximum(self.mass, 1e-300), self.least, self.excess))
        return [pa.array(pred, pa.string()), pa.array(score), pa.array(bits), pa.array(excess)]


def identify(df: DataFrame, samples: tuple[tuple[str, str], ...], text_col: str = "text", columns: list[Column] | None = None) -> DataFrame:
    """columns of df (all by default), with lang_pred, score, bits (bits a symbol of the winner) and excess (bits without the first phrase, which no text can save)."""
    taken = set(df.columns)
    new = {c: c if c not in taken or columns is not None else fresh(f"_{c}", df.columns) for c in ("lang_pred", "score", "bits", "excess")}
    shown = df.select(F.struct(*(columns if columns is not None else [F.col(f"`{c}`") for c in df.columns])).alias("row"), F.col(text_col).cast("string").alias("text"))
    send = df.sparkSession.sparkContext.broadcast(blocks(samples))
    names = list(new.values())

    def judged(b: pa.RecordBatch, verdict: Verdict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns - 1)), *verdict.columns()], names=[*b.schema.names[:-1], *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = send.value
        if len(parts) > 1:
            yield from spooled(batches, parts)
            return
        known = tables(parts[0]) if parts else None
        for b in batches:
            for lo in range(0, b.num_rows, ROWS):
                part = b.slice(lo, ROWS)
                verdict = Verdict(part.num_rows)
                if known:
                    verdict.add(known, part.column(part.num_columns - 1).to_pylist())
                yield judged(part, verdict)

    def spooled(batches: Iterator[pa.RecordBatch], parts: list) -> Iterator[pa.RecordBatch]:
        """The task's rows wait in a temporary file and are read once for each block of languages."""
        with tempfile.TemporaryFile() as file:
            verdicts, writer = [], None
            for b in batches:
                writer = writer or pa.ipc.new_stream(file, b.schema)
                writer.write_batch(b)
                verdicts.append(Verdict(b.num_rows))
            if writer is None:
                return
            writer.close()
            for part in parts:
                file.seek(0)
                known = tables(part)
                for verdict, b in zip(verdicts, pa.ipc.open_stream(file), strict=True):
                    if b.num_rows:
                        verdict.add(known, b.column(b.num_columns - 1).to_pylist())
            file.seek(0)
            for verdict, b in zip(verdicts, pa.ipc.open_stream(file), strict=True):
                yield judged(b, verdict)

    schema = shown.drop("text").schema
    for name, kind in zip(names, ("string", "double", "double", "double"), strict=True):
        schema = schema.add(name, kind)
    return shown.mapInArrow(lean(run, keeps=True), schema).select("row.*", *names)


def letter_bits(sample: str) -> float:
    """Entropy of the symbols of a sample."""
    _, n = np.unique(_points(sample), return_counts=True)
    return float(np.log2(n.sum()) - (n * np.log2(n)).sum() / n.sum())


def keep_known(df: DataFrame, samples: tuple[tuple[str, str], ...], text_col: str = "text", most_bits: float = 8.0) -> DataFrame:
    """df without texts of no language: `und`, or more excess bits a symbol than the language explains, so that short texts aren't held against long ones.

    most_bits holds for alphabets of up to 32 letters; it is more by what a symbol of the language's sample takes beyond
    LETTER_BITS, up to three quarters of what a letter costs that the sample lacks.
    """
    judged = identify(df, samples, text_col)
    pred, _, _, excess = judged.columns[-4:]
    limits = {lang: min(most_bits + letter_bits(text) - LETTER_BITS, 0.75 * math.log2(max(2, len(text)))) for lang, text in samples}
    wider = [F.lit(x) for lang, most in limits.items() if most > most_bits for x in (lang, most)]
    limit = F.coalesce(F.create_map(*wider)[F.col(pred)], F.lit(most_bits)) if wider else F.lit(most_bits)
    return judged.filter((F.col(pred) != UNKNOWN) & (F.col(excess) <= limit)).select(*[F.col(f"`{c}`") for c in df.columns])
