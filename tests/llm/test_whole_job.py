"""What the operators must not leave out: rare letters, rare words, further languages, short texts, odd ids."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilestrata.llm import exact_dedup, language_id, lattice_lm, queries
from tilestrata.llm import sentencepiece_codec as sp


def wide(seed, letters):
    """(texts of words over thousands of letters, whose frequencies fall off as 1 / rank)."""
    rng = random.Random(seed)
    words = ["".join(rng.choice(letters) for _ in range(rng.choice([1, 2, 2, 3]))) for _ in range(3000)]
    share = [1 / (k + 1) for k in range(len(words))]
    return ["".join(rng.choices(words, share, k=120)) for _ in range(60)]


LETTERS = [chr(i) for i in range(0x4E00, 0x4E00 + 3000)]


def test_letters_beyond_the_dense_alphabet(spark):
    texts = [(t, lang) for lang, seed in (("zh", 1), ("zz", 2)) for t in wide(seed, LETTERS)]
    texts += [(" ".join(random.Random(i).choices(["the", "cat", "sat", "down", "here"], k=80)), "en") for i in range(60)]
    df = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(texts)], "doc_id long, text string, lang string")
    samples = language_id.learn(df.filter("doc_id % 4 > 0"))
    assert len(set(samples[1][1])) > 1000
    held = df.filter("doc_id % 4 = 0")
    got = language_id.identify(held, samples).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.95
    assert language_id.keep_known(held, samples).count() == held.count()
    foreign = held.select("doc_id", F.lit("ქართული ენა არის აქ და იქ ყველგან").alias("text"), "lang")
    assert language_id.keep_known(foreign, samples).count() == 0


def test_hashed_transitions_equal_dense_ones(monkeypatch):
    samples = tuple((lang, language_id.normalised(" ".join(wide(seed, LETTERS[:400])[:9]))) for lang, seed in (("a", 1), ("b", 2)))
    probes = [*wide(1, LETTERS[:400])[-3:], *wide(2, LETTERS[:500])[-3:], "", "x", LETTERS[0], "é" * 30]
    rates = []
    for alphabet in (0, 7, 10_000):
        monkeypatch.setattr(language_id, "ALPHABET", alphabet)
        rates.append(language_id.Tables(samples).bits_per_symbol(probes)[0])
    assert (rates[0] == rates[2]).all() and (rates[1] == rates[2]).all()


def test_every_label_is_learned_in_blocks(spark, monkeypatch):
    """70 languages, each of words of its own."""
    rng = random.Random(5)
    words = [["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.choice([2, 4, 6]))) for _ in range(30)] for _ in range(70)]
    rows = [(i * 6 + k, " ".join(rng.choices(w, k=60)), f"l{i:02}") for i, w in enumerate(words) for k in range(6 - (i == 69))]
    df = spark.createDataFrame([*rows, (9000, None, "l00"), (9001, "12 %", "l01")], "doc_id long, text string, lang string")
    samples = language_id.learn(df)
    assert [lang for lang, _ in samples] == [f"l{i:02}" for i in range(70)]
    whole = language_id.identify(df, samples).orderBy("doc_id").collect()
    assert all(r["lang"] == r["lang_pred"] for r in whole if r["doc_id"] < 9000) and {r["lang_pred"] for r in whole[-2:]} == {"und"}
    monkeypatch.setattr(language_id, "HELD", 30_000)
    assert 3 < len(language_id.blocks(samples)) < 70
    by_block = language_id.identify(df, samples).orderBy("doc_id").collect()
    pred, score, bits = ([r[c] for r in by_block] for c in ("lang_pred", "score", "bits"))
    assert pred == [r["lang_pred"] for r in whole] and bits == [r["bits"] for r in whole]
    assert score == pytest.approx([r["score"] for r in whole])


def test_rare_words_have_arcs(spark, monkeypatch):
    """Scores don't depend on which words are broadcast."""
    model = sp.read_model(queries.MODEL_PATH)
    docs = queries.table(spark, "/root/testdata/sf0.001", "documents").filter("length(text) < 3000").limit(60)
    docs = docs.unionByName(docs.limit(1).select(F.lit(-1).cast(docs.schema["doc_id"].dataType).alias("doc_id"), F.lit("").alias("text"), *docs.columns[2:]), allowMissingColumns=True)
    got = []
    for heavy in (1 << 20, 300, 1):
        monkeypatch.setattr(lattice_lm, "HEAVY", heavy)
        got.append(lattice_lm.score(docs, model, queries.fold("doc_id", 10) != 0, group_col="lang").orderBy("doc_id").toPandas())
    for other in got[1:]:
        assert (other[["doc_id", "n_tokens", "n_known", "train_tokens"]] == got[0][["doc_id", "n_tokens", "n_known", "train_tokens"]]).all(axis=None)
        assert other.score.to_numpy() == pytest.approx(got[0].score.to_numpy(), rel=1e-9)
        assert other.base_score.to_numpy() == pytest.approx(got[0].base_score.to_numpy(), rel=1e-9)


def test_every_round_learns_from_every_word(spark):
    """Scores equal those of rounds over all 9,500 words in plain numpy, whatever their frequency or letters."""
    rng = random.Random(8)
    words = sorted({"".join(rng.choice("abcde") for _ in range(9)) for _ in range(8600)} | {"z" + "".join(rng.choice("uvwxyz") for _ in range(9)) for _ in range(1300)})
    assert len(words) > 9500
    model = sp.read_model(queries.MODEL_PATH)
    v = sp.Vocabulary(model)
    texts = [" ".join(words[i::10]) for i in range(10)] + ["zzuzu zebra", "abc abc"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in lattice_lm.score(df, model, F.col("doc_id") < 10).collect()}

    def joined(words):
        return np.frombuffer("".join(words).encode(), np.uint8), np.cumsum([0, *map(len, words)])

    used = [*v.usable, *v.bytes.values(), v.unknown]
    scores = np.array(v.scores)
    for _ in range(lattice_lm.WARM_ROUNDS + 1):
        total = lattice_lm.Lattice(v, scores[None]).expect(*joined(words), np.full(len(words), lattice_lm.DISCOUNT))
        scores = np.full(len(v.scores), -60.0)
        scores[used] = np.log((total[used] + 0.01) / (total[used].sum() + 0.01 * len(used)))
    lattice, n = lattice_lm.Lattice(v, scores[None]), len(words)
    stop = np.log(10.5 / (n + 11))
    for i, text in enumerate(texts):
        parts = text.split()
        marginal = lattice.forward(*joined(parts))[:, 0] + np.log(lattice_lm.DISCOUNT)
        arcs = np.full(len(parts), np.log((1 - lattice_lm.DISCOUNT) / n) if i < 10 else -np.inf)
        want = (np.logaddexp(marginal, arcs) + np.log1p(-np.exp(stop))).sum() + stop
        assert got[i] == pytest.approx(want / np.log(10), rel=1e-9)


def test_blocks_of_words_keep_to_their_cells():
    """One long word does not widen the forward table of thousands of short ones."""
    v = sp.Vocabulary(sp.read_model(queries.MODEL_PATH))
    lattice = lattice_lm.Lattice(v, np.repeat(np.array(v.scores)[None], 5, axis=0))
    size = np.array([5, 9, 30] * 2000 + [20_000, 0, 400_000])
    blocks = list(lattice._blocks(np.concatenate(([0], np.cumsum(size)))))
    assert sorted(np.concatenate(blocks).tolist()) == list(range(len(size)))
    assert all(len(b) == 1 or len(b) * (size[b].max() + len(sp.MARK.encode()) + 1) * 5 <= lattice.CELLS for b in blocks)


def test_copies_go_by_id_and_text(spark):
    rows = [(1, "a"), (None, "a"), (None, "only here"), (5, "a"), (5, "also only here"), (7, None), (8, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {tuple(r) for r in exact_dedup.exact_dedup(df).collect()}
    assert kept == {(1, "a"), (None, "only here"), (5, "also only here"), (7, None)}
