"""Words that hash apart, rows judged by themselves, and column names of the operators' own."""

import hashlib
import random

import pyarrow as pa

from tilestrata.llm import _text, language_id, ngram_join, quality_fm, queries, sharding, warc
from tilestrata.llm import decontaminate as dc
from tilestrata.llm import sentencepiece_codec as sp

SF = "/root/testdata/sf0.001"
ITEM = "one two three four five six seven eight nine ten"


def twin_words():
    """Two words of 1,024 letters whose polynomial hashes modulo 2 ** 64 are equal for any base."""
    word = "a"
    for _ in range(10):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_twin_words_hash_apart_and_do_not_link(spark):
    a, b = twin_words()
    docs = spark.createDataFrame([(1, a), (2, b), (3, a.upper()), (4, a[:300]), (5, b[:300])], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.near_components(docs).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5}
    assert sorted(r["doc_id"] for r in ngram_join.drop_near_copies(docs).collect()) == [1, 2, 4, 5]


def test_word_hashes_depend_on_the_word_alone():
    r = random.Random(3)
    words = ["".join(r.choice("abcABC é") for _ in range(r.choice([1, 2, 7, 8, 9, 16, 17, 63, 64, 65, 520]))).replace(" ", "x") for _ in range(4000)]
    low = [w.translate(str.maketrans("ABC", "abc")) for w in words]
    texts, at = [], 0
    while at < len(words):
        n = r.randrange(5)
        texts.append(" " * r.randrange(3) + "  ".join(words[at : at + n]))
        at += n
    data, offsets = _text.text_buffers(pa.array(texts))
    got = []
    for lo, hi in _text.chunks(offsets, 3000):
        got += _text.word_hashes(data, offsets[lo : hi + 1])[0].tolist()
    by = dict(zip(low, got, strict=True))
    assert [by[w] for w in low] == got and len(set(by.values())) == len(by)


def test_rows_with_repeated_and_null_ids_are_judged_alone(spark):
    rows = [(5, ITEM), (5, "zero " + ITEM), (5, "clean text"), (None, ITEM), (None, "nothing here"), (None, None), (7, ITEM), (7, ITEM)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, _bad string").repartition(3)
    items = spark.createDataFrame([(1, ITEM), (2, ITEM), (None, "other words"), (3, None)], "item_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) for r in dc.decontaminate(docs, items).collect())
    want = [(5, 10, 10, 2, True), (5, 11, 10, 2, True), (5, 2, 0, 0, False), (None, 10, 10, 2, True), (None, 2, 0, 0, False), (None, 0, 0, 0, False), (7, 10, 10, 2, True), (7, 10, 10, 2, True)]
    assert got == sorted((str(a), *x) for a, *x in want)
    kept = dc.clean_documents(docs, items)
    assert kept.columns == docs.columns and sorted((str(r[0]), str(r[1])) for r in kept.collect()) == sorted((str(a), str(b)) for a, b in [(5, "clean text"), (None, "nothing here"), (None, None)])
    assert dc.decontaminate(docs, items.limit(0)).filter("contaminated").count() == 0 and dc.clean_documents(docs.limit(0), items).count() == 0


def test_own_names_do_not_clash(spark, tmp_path):
    extra = ["_stays", "_payload", "_digest", "_bytes", "_shard", "_slot", "_id", "_langid_text", "_fm_text", "_fm_chars", "_codec_text", "_codec_ids", "a.b", "lang_pred", "score"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id", "text", "lang", "n_chars", *[f"'{c}' AS `{c}`" for c in extra])
    samples = language_id.learn(docs)
    assert language_id.keep_known(docs, samples).columns == docs.columns
    assert set(docs.columns) <= set(language_id.identify(docs, samples).columns)
    coded = sp.encode(docs, sp.read_model(queries.MODEL_PATH))
    assert {r["_codec_text"] for r in sp.decode(coded, sp.read_model(queries.MODEL_PATH)).select("_codec_text", "decoded").collect()} == {"_codec_text"}
    model = quality_fm.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert quality_fm.predict(docs, model).select("_fm_text", "quality_score").count() == docs.count()
    written = sharding.write_shards(docs, str(tmp_path / "shards"))
    assert written.select("_shard", "_slot", "_shard_", "_slot_").count() == docs.count()
    pages = spark.createDataFrame([(i, f"http://h/{i}", "x" * 2000, *extra[:4]) for i in range(3)], "page_id long, url string, html string, _stays string, _payload string, _digest string, _bytes string")
    warc.write_warc(pages, str(tmp_path / "warc"), "page_id", "url", "html")
    got = {(r["record_type"], r["refers_to"]) for r in warc.read_warc(spark, str(tmp_path / "warc")).collect()}
    assert got == {("response", None), ("revisit", "2")}
    assert hashlib.sha1(b"x" * 2000).hexdigest() in {r["payload_digest"] for r in warc.read_warc(spark, str(tmp_path / "warc")).collect()}
