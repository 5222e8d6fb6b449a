"""What Python workers keep from one operator to the next."""

import gc
import weakref

import pyarrow as pa
import pytest

import corpus_pipeline
from tilestrata.llm import language_id, ngram_join, queries, sentencepiece_codec

SAMPLES = (("en", "some words of this language "), ("de", "einige worte dieser sprache "))


def test_tables_of_one_operator_at_a_time():
    known = weakref.ref(language_id.tables(SAMPLES))
    assert known() is language_id.tables(SAMPLES)
    code = weakref.ref(sentencepiece_codec.codec(sentencepiece_codec.read_model(queries.MODEL_PATH)))
    gc.collect()
    assert known() is None and code() is not None
    language_id.tables(SAMPLES)
    gc.collect()
    assert code() is None


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, f"one two three four five six {i % 40}") for i in range(200)], "doc_id long, text string").repartition(4).cache()


def count_tables(batches):
    gc.collect()
    n = sum(isinstance(x, language_id.Tables) for x in gc.get_objects())
    for _ in batches:
        pass
    yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])


def test_near_copies_are_found_without_the_languages_tables(spark, docs):
    def held():
        return sum(r["n"] for r in docs.select("doc_id").mapInArrow(count_tables, "n long").collect())

    assert {r["lang_pred"] for r in language_id.identify(docs, SAMPLES).collect()} <= {"en", "de"}
    assert held() > 0
    assert ngram_join.near_components(docs).count() == 200
    assert held() == 0


def test_whole_texts_leave_for_python_in_small_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    try:
        docs = spark.createDataFrame([(i, "one two three", "en", "web") for i in range(40)], "doc_id long, text string, lang string, source string")
        for stage in (corpus_pipeline.identify_language, corpus_pipeline.encode):
            spark.conf.set(key, "10000")
            assert stage(spark, docs, "").count() == 40
            assert max(r["n"] for r in spark.range(0, 5000, 1, 1).mapInArrow(sizes, "n long").collect()) == 1000
    finally:
        spark.conf.set(key, before)
