"""A corpus from raw documents to token ids: each stage works on all that the one before kept.

Every stage but the last returns the columns of its input, whatever their names; an empty table stays empty. Rows with a null id
take part in all stages and are told apart by their text; rows that repeat an id are judged each by
itself, but for near copies, where they are one document of several texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tilestrata.llm import decontaminate, exact_dedup, language_id, ngram_join, queries, sentencepiece_codec
from tilestrata.llm.storage import cut


#: Rows of an Arrow batch that holds whole texts, here and in what the session runs next; the default of 10,000 takes some 60 MB, several times over, in each task.
BATCH_ROWS = 1000


def narrow_batches(spark: SparkSession) -> None:
    """For stages whose rows go through Python only when their result is written, after the stage's function is over."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = int(spark.conf.get(key))
    if not 0 < rows <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a learned language; null and empty texts, those without letters, and those that no language explains go. Lengths don't matter: short texts are judged by what they need beyond one phrase."""
    narrow_batches(spark)
    return language_id.keep_known(docs, language_id.learn(docs.filter(queries.fold("doc_id", 4) != 2)))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, the one with the smallest id (ties are one document); null counts as an empty text."""
    return exact_dedup.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingle sets of Jaccard 0.8 or more, the one with the smallest id. Texts without words link with nothing and stay."""
    return ngram_join.drop_near_copies(docs, size=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of ten words of a benchmark item; an empty benchmark leaves all. Null texts have no words and stay."""
    return decontaminate.clean_documents(docs, queries.table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str, model_path: str = queries.MODEL_PATH) -> DataFrame:
    """Token ids of every document; null and empty texts have none."""
    from pyspark.sql import functions as F

    narrow_batches(spark)
    return sentencepiece_codec.encode(docs, sentencepiece_codec.read_model(model_path), columns=[F.col(c) for c in ("doc_id", "lang", "source")])


STAGES = [("language_id", identify_language), ("exact_dedup", drop_copies), ("ngram_join", drop_near_copies), ("decontamination", drop_contaminated), ("sentencepiece", encode)]

#: Language identification and the codec are no SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each result is written to the shared folder and read again."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
