"""Each operator against brute force, a round trip or held-out labels, and on awkward rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilestrata.llm import decontaminate as dc
from tilestrata.llm import exact_dedup, language_id, lattice_lm, ngram_join, quality_fm, queries, sharding, url_filter, warc
from tilestrata.llm import sentencepiece_codec as sp

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string"
MODEL = sp.read_model(queries.MODEL_PATH)


def table(spark, texts):
    """Rows with a clashing extra column."""
    return spark.createDataFrame([(i, t, "en", None, None, "x") for i, t in enumerate(texts)], DOCS)


AWKWARD = [None, "", " \t\n", "the", "the", "A b", "a  B", "1234 %%%", "日本語 😀 ▁", "word " * 20000, "x" * 50000, "\x00\x01"]


@pytest.mark.parametrize("texts", [AWKWARD, []])
def test_awkward_and_empty_tables(spark, texts):
    df = table(spark, texts)
    n = len(texts)
    lang = language_id.learn(df)
    assert language_id.identify(df, lang).count() == n
    assert sharding.byte_shards(df).count() == n
    assert lattice_lm.score(df, MODEL, F.lit(True)).count() == n
    assert sp.encode(df, MODEL).filter("round_trip").count() == n
    assert ngram_join.near_components(df).count() == n
    model = quality_fm.fit(df, spark.createDataFrame([], "doc_id long, quality int"))
    assert quality_fm.predict(df, model).count() == n
    assert exact_dedup.exact_groups(df).count() == n
    items = spark.createDataFrame([(1, "word " * 12), (2, None), (3, "a b")], "item_id long, text string")
    assert dc.decontaminate(df, items).count() == n
    assert dc.decontaminate(df, items.limit(0)).filter("contaminated").count() == 0
    pages = df.select(F.col("doc_id").alias("page_id"), F.col("text").alias("url"), F.col("text").alias("html"))
    assert url_filter.filter_urls(pages, queries.RULES).count() == n


def test_language_id_held_out(spark):
    r = queries.op1_language_id(spark, SF).join(queries.table(spark, SF, "documents").select("doc_id", "lang"), "doc_id")
    held = r.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert held > 0.95
    und = language_id.identify(table(spark, AWKWARD), language_id.learn(queries.table(spark, SF, "documents"))).collect()
    assert {x["doc_id"] for x in und if x["lang_pred"] == "und"} == {0, 1, 2, 7, 11}


def test_suffix_automaton_parses_like_brute_force():
    rng = random.Random(3)
    text = "".join(rng.choice("ab c") for _ in range(200)).strip()
    t = language_id.Tables((("l", language_id.normalised(text)),))
    sample = language_id.normalised(text)
    for _ in range(40):
        probe = "".join(rng.choice("abcd ") for _ in range(60))
        s = re.sub(r"\s+", " ", probe)
        count, run = 1, ""
        for c in s:
            if run + c in sample:
                run += c
            else:
                count, run = count + 1, c if c in sample else ""
        rates, _, _ = t.bits_per_symbol([s])
        assert round(rates[0, 0] * len(s) / t.bits[0]) == count


def test_shards_are_contiguous_and_balanced(spark):
    rows = sharding.byte_shards(queries.table(spark, SF, "documents"), 8).collect()
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append((r["slot"], r["size"]))
    sizes = {k: sum(s for _, s in v) for k, v in by.items()}
    assert all(sorted(x for x, _ in v) == list(range(len(v))) for v in by.values())
    assert max(sizes.values()) - min(sizes.values()) <= 2 * max(r["size"] for r in rows)
    crc = {r["doc_id"]: zlib.crc32((r["text"] or "").encode()) for r in queries.table(spark, SF, "documents").collect()}
    assert all(crc[r["doc_id"]] == r["text_crc32"] for r in rows)


def test_shards_cut_a_group_of_a_third(spark):
    df = table(spark, ["same text"] * 400 + [f"text {i}" for i in range(800)])
    sizes = [r["b"] for r in sharding.byte_shards(df, 8).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(sizes) == 8 and max(sizes) - min(sizes) <= 30


def test_lattice_sums_all_segmentations():
    v = sp.Vocabulary(MODEL)
    scores = np.array([v.scores, [s * 1.1 for s in v.scores]])
    lattice = lattice_lm.Lattice(v, scores)
    index = {v.pieces[i]: i for i in v.usable}
    words = ["the", "ab", "zé", "日", "ꙮx", "thanation"]
    data = np.frombuffer("".join(words).encode(), np.uint8)
    at = np.cumsum([0, *(len(w.encode()) for w in words)])
    got = lattice.forward(data, at)

    def total(text, g):
        if not text:
            return 1.0
        out = sum(np.exp(scores[g, index[text[:k]]]) * total(text[k:], g) for k in range(1, len(text) + 1) if text[:k] in index)
        if text[0] not in index:
            out += np.exp(sum(scores[g, v.bytes[b]] for b in text[0].encode())) * total(text[1:], g)
        return out

    for i, w in enumerate(words):
        for g in (0, 1):
            assert got[i, g] == pytest.approx(np.log(total(sp.MARK + w, g)), rel=1e-9)
    expected = lattice.expect(data, at, np.ones(len(words)))
    assert expected[index[sp.MARK + "the"]] > 0


def test_lm_scores_beat_the_base(spark):
    r = queries.op3_lm_score(spark, "/root/testdata/sf0.01").toPandas()
    held = r[r.held_out]
    assert held.score.sum() > held.base_score.sum() and (r.score < 0).all()


def test_warc_round_trip_and_pushdown(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/\r\nX: y", "p" * 1500), (2, None, "p" * 1500), (3, "u", None), (4, "u", "short\r\n\r\nWARC/1.1\r\n"), (5, "u", "short")], "page_id long, url string, html string")
    path = f"file://{tmp_path}/w"
    warc.write_warc(pages, path, "page_id", "url", "html")
    rows = {int(r["record_id"]): r for r in warc.read_warc(spark, path).collect()}
    assert rows[1]["record_type"] == "revisit" and rows[1]["refers_to"] == "2" and rows[1]["payload"] is None
    assert bytes(rows[4]["payload"]) == b"short\r\n\r\nWARC/1.1\r\n" and bytes(rows[3]["payload"]) == b""
    assert rows[2]["payload_digest"] == hashlib.sha1(b"p" * 1500).hexdigest()
    only = warc.read_warc(spark, path, payload=False).filter("record_type = 'revisit'")
    assert " Filter " not in only._jdf.queryExecution().executedPlan().toString() and only.count() == 1
    assert warc.hex_digest("sha1:3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ") == "da39a3ee5e6b4b0d3255bfef95601890afd80709"


def test_viterbi_is_best():
    c = sp.Codec(MODEL)
    v = c.vocabulary
    score = {v.pieces[i]: v.scores[i] for i in v.usable}
    for text in ["▁theanation", "▁日ꙮ本", "▁▁a", "▁" + "anerst" * 5]:
        best = [0.0] + [-1e300] * len(text)
        for j in range(1, len(text) + 1):
            for i in range(j):
                if text[i:j] in score:
                    best[j] = max(best[j], best[i] + score[text[i:j]])
                elif j - i == 1:
                    best[j] = max(best[j], best[i] + c.unknown_score)
        ids = c.viterbi(text)
        got = sum(v.scores[i] for i in ids if v.kinds[i] != sp.BYTE) + c.unknown_score * sum(ch not in score for ch in text)
        assert got == pytest.approx(best[-1])


@pytest.mark.parametrize(("size", "percent"), [(3, 90), (5, 80)])
def test_near_components_equal_brute_force(spark, size, percent):
    rng = random.Random(size)
    texts = [None, "", "a b", "A  b", "x"]
    for _ in range(8):
        base = [f"w{rng.randrange(300)}" for _ in range(rng.choice([4, 20, 60, 150]))]
        for _ in range(rng.choice([1, 3, 40])):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 6])):
                t[rng.randrange(len(t))] = f"w{rng.randrange(300)}"
            texts.append(" ".join(t))
    sets, root = [], list(range(len(texts)))
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(texts)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = {r["doc_id"]: r for r in ngram_join.near_components(table(spark, texts), size=size, percent=percent).collect()}
    assert all(got[i]["component_id"] == find(i) and got[i]["n_shingles"] == len(sets[i]) for i in range(len(texts)))


def test_factorisation_machine_identity_and_accuracy(spark):
    rng = np.random.default_rng(1)
    m = quality_fm.Model(np.zeros((0, 0)), 0.3, rng.normal(size=20), rng.normal(size=(20, quality_fm.RANK)))
    i, x = np.array([1, 4, 7, 9]), rng.normal(size=4)
    slow = 0.3 + (m.w[i] * x).sum() + sum(m.v[i[a]] @ m.v[i[b]] * x[a] * x[b] for a in range(4) for b in range(a))
    assert m.logits(i, x, np.array([0, 4]))[0][0] == pytest.approx(slow)
    sf = "/root/testdata/sf0.01"
    r = queries.op7_quality_fm(spark, sf).join(queries.table(spark, sf, "labels"), "doc_id").filter("held_out")
    assert r.agg(F.avg((F.col("predicted") == F.col("quality")).cast("double"))).first()[0] > 0.9


def test_collisions_are_told_apart(spark):
    df = table(spark, ["a", "b", "a", "c", None, ""])
    one = lambda t: F.substring(F.unhex(F.md5(t)), 1, 0)  # every text collides
    exact = lambda d: sorted(tuple(r) for r in d.collect())
    assert exact(exact_dedup.exact_groups(df, hash_of=one)) == exact(exact_dedup.exact_groups(df))
    assert {r["doc_id"] for r in exact_dedup.exact_dedup(df).collect()} == {0, 1, 3, 4}


def test_decontamination_in_blocks(spark):
    docs = table(spark, ["x one two three four five six seven eight nine ten y", "one two three", "short item here", None])
    items = spark.createDataFrame([(7, "One two three four five six seven eight nine ten eleven"), (12, "short item"), (3, "!")], "item_id long, text string")
    for block in (1, 200_000):
        r = {x["doc_id"]: x for x in dc.decontaminate(docs, items, block_windows=block).collect()}
        assert (r[0]["n_hit"], r[0]["n_words"], list(r[0]["item_ids"])) == (10, 12, ["7"])
        assert r[2]["n_hit"] == 2 and not r[1]["contaminated"] and r[3]["n_words"] == 0


def test_url_rules_and_purity(spark):
    urls = ["https://A.example.com/en/1?q", "http://www.example.com/en/2", "https://x.net/es/9#f", "no scheme", None, "https://x.net", "https://t.org/keep/1", "https://y.com?x"]
    r = [tuple(x)[1:5] for x in url_filter.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), queries.RULES).orderBy("page_id").collect()]
    assert r[0] == ("a.example.com", "/en/1", "example.com/en/", "block") and r[1][2:] == ("www.example.com/en/", "allow")
    assert r[2][2:] == ("net/es/", "block") and r[3] == ("", "", None, "allow") == r[4] and r[7] == ("y.com", "", None, "allow")
    rows = [(i, f"https://h.org/{'bad' if i % 2 else 'good'}/{i}") for i in range(400)]
    rules = [("h.org", f"/bad/{k}", "block") for k in range(1, 4)] + [("h.org", f"/good/{k}", "allow") for k in range(1, 4)]
    got = url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), rules).groupBy("verdict").agg(F.min("page_id"), F.count("*")).collect()
    assert {x["verdict"]: x[2] for x in got} == {"allow": 200, "block": 200}


def test_pipeline_keeps_and_drops(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SF)
    kept = {r["doc_id"] for r in out.collect()}
    docs = {r["doc_id"]: r["text"] for r in queries.table(spark, SF, "documents").collect()}
    first = {}
    for i in sorted(docs):
        first.setdefault(docs[i], i)
    bad = {r["doc_id"] for r in dc.decontaminate(queries.table(spark, SF, "documents"), queries.table(spark, SF, "benchmark")).filter("contaminated").collect()}
    assert kept <= set(first.values()) - bad and len(kept) > 0.8 * len(set(first.values()) - bad)
    assert out.filter("not round_trip").count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "ngram_join", "decontamination", "sentencepiece"]


