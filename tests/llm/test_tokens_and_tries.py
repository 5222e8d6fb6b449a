"""Alignment, byte-level BPE and the conversation trie against plain versions, and on awkward rows."""

import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
import regex
import sentencepiece
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tilestrata.llm import byte_bpe, prefix_trie, queries
from tilestrata.llm import token_alignment as ta

SF = "/root/testdata/sf0.001"
RANKS = byte_bpe.read_ranks(queries.RANKS_PATH)
A, B = ta.read_file(queries.TOKENIZER_PATH), ta.read_file(queries.MODEL_PATH)
ODD = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "a \n b", "\n\n  x\t y ", "it's 12 o'clock", "<|endoftext|> <s></s> <0x41>", "dash▁mark", "naïve 中文字 \U0001f600\U0001f468‍\U0001f469",
    "é \x00 \x1c \x85   　z", "x" * 3000, "中" * 2000, " " * 500, "word " * 3000, "twice the same", "twice the same",
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(None if i == 3 else i % 19, t, "struct", i, "seen") for i, t in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, row string, n_tokens int, `key.at` string").repartition(3)


def encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, RANKS.splitlines())}
    return tiktoken.Encoding("own", pat_str=byte_bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe_is_the_library_s(spark, odd):
    code = encoding()
    got = byte_bpe.decode(byte_bpe.encode(odd, RANKS, byte_bpe.PATTERN, cut_first=True), RANKS).collect()
    assert Counter((r["doc_id"], r["text"], tuple(r["token_ids"])) for r in got) == Counter((r["doc_id"], r["text"], tuple(code.encode_ordinary(r["text"] or ""))) for r in odd.collect())
    assert all(bytes(r["decoded"]) == (r["text"] or "").encode() and r["n_tokens"] == len(r["token_ids"]) and r["row"] == "struct" and r["key.at"] == "seen" for r in got)
    empty = byte_bpe.decode(byte_bpe.encode(odd.limit(0), RANKS, byte_bpe.PATTERN), RANKS)
    assert empty.count() == 0 and {"token_ids", "decoded", "key.at"} <= set(empty.columns)


def test_byte_bpe_in_many_blocks(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    monkeypatch.setattr(byte_bpe, "BLOCK_WORDS", 500)
    monkeypatch.setattr(byte_bpe, "KEPT_PIECES", 100)
    code, seen = encoding(), 0
    for r in queries.op12_byte_bpe(spark, SF).join(docs.select("doc_id", "text"), "doc_id").collect():
        ids = code.encode_ordinary(r["text"] or "")
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
        seen += 1
    assert seen == docs.count()


@pytest.mark.parametrize("pattern", [byte_bpe.PATTERN, r"\p{L}+", r"[a-z .]+|\s"])
def test_pieces_of_many_texts_are_split_together(monkeypatch, pattern):
    """One call splits all plain pieces; the words are those of whole texts, where the pattern lets a space begin one."""
    calls, real = [], regex.compile(pattern)
    counting = SimpleNamespace(findall=lambda text: calls.append(text) or real.findall(text))
    monkeypatch.setattr(byte_bpe, "regex", SimpleNamespace(compile=lambda _: counting, Pattern=regex.Pattern))
    monkeypatch.setattr(byte_bpe, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    rng = random.Random(5)
    parts = ["a", "Bc", " ", "  ", "\n", "\x0b", "\x1c", "\x85", "\u2003", "é", "中", "1", ".", "'s", "\U0001f600", "\x00"]
    texts = [*ODD, *("".join(rng.choices(parts, k=rng.randrange(12))) for _ in range(3000)), " ".join(f"w{i}." for i in range(20000))]
    for some, kind in ((texts, pa.string()), (texts[:1000], pa.large_string()), (texts[-1:], pa.string())):
        calls.clear()
        batches = (pa.RecordBatch.from_arrays([pa.array(some[i : i + 500], kind)], names=["text"]) for i in range(0, len(some), 500))
        got = []
        for _, block, _ in byte_bpe._blocks(batches, pattern, carry=False):
            words = pa.array(list(block.words)).to_pylist()
            got += [[words[i] for i in np.frombuffer(t, np.uint32)] for t in block.texts]
        # as cut by pieces(): a space after a non-space starts a word
        assert got == [[w for i, p in enumerate(byte_bpe.pieces(t)) for w in real.findall(" " * (i > 0) + p)] if t else [] for t in some]
        if pattern == byte_bpe.PATTERN:
            assert got == [real.findall(t or "") for t in some]
    assert pattern != byte_bpe.PATTERN or len(calls) < 10


def test_decoding_nulls_and_foreign_ids(spark):
    rows = spark.createDataFrame([(1, None), (2, []), (3, [0, 256])], "doc_id long, token_ids array<int>")
    got = {r["doc_id"]: r["decoded"] for r in byte_bpe.decode(rows, RANKS).collect()}
    assert got == {1: None, 2: bytearray(b""), 3: bytearray(b"! t")}
    with pytest.raises(Exception, match="out of bounds"):
        byte_bpe.decode(spark.createDataFrame([([10**6],)], "token_ids array<int>"), RANKS).collect()


def aligned(texts):
    """Results for each text, by the tokenizers themselves and one pass over each text."""
    a, b = Tokenizer.from_str(A.decode()), sentencepiece.SentencePieceProcessor(model_proto=B)
    a.encode_special_tokens = True
    raw = [s.raw for s in ta.Pair(A, B).sides]
    digests, links = [], []
    for t in texts:
        ids = [a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)] if t else [[], []]
        spelled = [[raw[s][i] for i in ids[s]] for s in (0, 1)]
        if any(b"".join(x) != (" " + (t or "")).encode() for x in spelled):
            ids = spelled = [[], []]
        spans = []
        for s in (0, 1):
            at, out = 0, []
            for i, x in zip(ids[s], spelled[s]):
                out.append((at, at + len(x), i))
                at += len(x)
            spans.append(out)
        ends = [{e for _, e, _ in x} for x in spans]
        cuts = [0, *sorted(ends[0] & ends[1])]
        text = ";".join("|".join(",".join(str(i) for x, y, i in side if lo <= x and y <= hi) for side in spans) for lo, hi in zip(cuts, cuts[1:]))
        digests.append([len(ids[0]), len(ids[1]), len(cuts) - 1, hashlib.sha256(text.encode()).hexdigest() if t and ids[0] else ""])
        links.append([(i, j) for x, y, i in spans[0] for v, w, j in spans[1] if x < w and v < y] if len(ids[0]) < 400 else None)
        if links[-1] is None:  # long texts: two pointers
            p = q = 0
            links[-1] = []
            while p < len(spans[0]) and q < len(spans[1]):
                links[-1].append((spans[0][p][2], spans[1][q][2]))
                x, y = spans[0][p][1], spans[1][q][1]
                p, q = p + (x <= y), q + (y <= x)
    count, best = Counter(x for per in links for x in set(per)), defaultdict(int)
    for (i, _), n in count.items():
        best[i] = max(best[i], n)
    return [(*d[:3], len(x), sum(count[y] == best[y[0]] for y in x), sum(count[y] for y in x), d[3]) for d, x in zip(digests, links)]


@pytest.mark.parametrize("most_pairs", [ta.MOST_PAIRS, 0])
def test_alignment_by_brute_force(spark, odd, most_pairs):
    rows = odd.collect()
    want = Counter((r["doc_id"], r["text"], *x) for r, x in zip(rows, aligned([r["text"] for r in rows])))
    got = ta.align(odd, A, B, most_pairs=most_pairs)
    assert Counter((r["doc_id"], r["text"], *(r[c] for c in ta.RESULTS)) for r in got.collect()) == want
    assert {"row", "key.at", "n_tokens"} <= set(got.columns)
    assert ta.align(odd.limit(0), A, B, most_pairs=most_pairs).count() == 0


def test_alignment_in_small_runs(spark, odd, monkeypatch):
    """Texts cut into short runs, groups and blocks give what whole ones give."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    whole = Counter(ta.align(docs, A, B).collect())
    monkeypatch.setattr(ta, "RUN", 7)
    monkeypatch.setattr(ta, "AT_ONCE", 64)
    assert Counter(ta.align(docs, A, B).collect()) == whole
    texts = [r["text"] for r in docs.orderBy("doc_id").collect()]
    assert [tuple(r[c] for c in ta.RESULTS) for r in ta.align(docs, A, B).orderBy("doc_id").collect()] == aligned(texts)


def test_machine_keeps_only_what_is_open():
    """However long a text, the machine holds its open group and one batch of events."""
    sizes = [s for s in ta.Pair(A, B).sizes()]
    space = [sizes[0].tolist().index(1), sizes[1].tolist().index(1)]
    import numpy as np

    ta_at_once, m = 1 << 12, ta._Sweep(sizes)
    m.patience = ta_at_once
    m.head(0)
    for _ in range(300):
        for s in (0, 1):
            m.run(s, np.full(5000, space[s], np.int32))
        assert m.n_open <= ta.AT_ONCE + 10_000
    assert m.block()[1][0][0].tolist() == [1_500_000] * 4


def trie(convs):
    """Node rows of {id: turns} by brute force."""
    members, ends, kids = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
            if d:
                kids[tuple(turns[: d - 1])].add(tuple(turns[:d]))
        ends[tuple(turns)].append(c)
    out = Counter()
    for node, ids in members.items():
        below = [x for x in members if x[: len(node)] == node]
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in below if x)
        digest = hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()
        out[(min(ids), len(node), min(members[node[:-1]]) if node else None, len(ids), len(kids[node]), sum(not kids[x] for x in below), saved, digest)] += 1
    return out


def turns_of(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((-1 if turn is None else turn, role or "", text or ""))
    return {c: [x[1:] for x in sorted(v)] for c, v in convs.items()}


def grafted(convs):
    out = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - c % 5, [])[:h] + turns[h:]
    return out


SCHEMA = "conv_id long, turn long, role string, text string, path string"


def test_trie_by_brute_force(spark, tmp_path):
    r = random.Random(5)
    rows = [(c, t, r.choice(["user", "assistant", None]), r.choice(["", "hi", "hi there", "café", None, "x" * 50])) for c in range(0, 140, 1 + r.randrange(1)) if c % 7 for t in range(r.randrange(12))]
    rows += [(c, t, "user", f"same {t}") for c in range(200, 260) for t in range(6)]  # copies
    rows += [(300, t, "user", f"deep {t}") for t in range(70)] + [(301, t, "user", f"deep {t}") for t in range(61)] + [(302, None, "user", "first"), (302, -5, "a", "second"), (None, 0, "user", "nobody's"), (303, 0, None, None)]
    df = spark.createDataFrame([(*x, "other") for x in rows], SCHEMA).repartition(5)
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    plain = turns_of(rows)
    for parts in ("1", "3", "40"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            assert Counter(map(tuple, prefix_trie.nodes(prefix_trie.paths(df)).collect())) == trie(plain)
            assert Counter(map(tuple, queries.op13_prefix_trie(spark, str(tmp_path)).collect())) == trie(grafted(plain))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_trie_of_long_hot_and_no_conversations(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK_TURNS", 16)
    monkeypatch.setattr(prefix_trie, "ID_CHARS", 20)
    rows = [(c, t, "user", f"t{t}") for c in range(40) for t in range(30)] + [(99, t, "user", f"t{t}") for t in range(300)]
    df = spark.createDataFrame([(*x, "other") for x in rows], SCHEMA)
    assert Counter(map(tuple, prefix_trie.nodes(prefix_trie.paths(df)).collect())) == trie(turns_of(rows))
    assert prefix_trie.nodes(prefix_trie.paths(df.limit(0))).count() == 0


def test_turns_differ_by_role_and_text(spark):
    pairs = [("a", "bc"), ("ab", "c"), (None, "abc"), ("", "abc"), ("abc", None)]
    df = spark.createDataFrame([(i, 0, x, y, "") for i, (x, y) in enumerate(pairs)], SCHEMA)
    assert df.select(prefix_trie.unit(F.col("role"), F.col("text"))).distinct().count() == 4


def test_new_pieces_are_encoded_together():
    both, calls = ta.Pair(A, B), []
    one = both.sides[0].one
    both.sides[0].one = lambda text: calls.append(text) or one(text)
    texts = [*[t for t in ODD if t and "▁" not in t], *(f"item{i} of {i * 7} is \t {i}th " for i in range(300))]
    for _ in range(2):  # then by the cache
        got = [tuple(x.tolist() for x in pair) for pair in both.encode(texts)]
        assert got == [(one(" " + t), both.sides[1].model.encode(t)) for t in texts]
    assert len(calls) < 20


@pytest.mark.parametrize("text", [" ", "a ", "  ", "x"])
def test_a_single_new_piece(text):
    both = ta.Pair(A, B)
    assert [tuple(x.tolist() for x in pair) for pair in both.encode([text])] == [(both.sides[0].one(" " + text), both.sides[1].model.encode(text))]
    assert [len(x) for pair in both.encode([None, ""]) for x in pair] == [0] * 4
