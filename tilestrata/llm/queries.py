"""The registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilestrata.llm import byte_bpe, decontaminate, exact_dedup, language_id, lattice_lm, ngram_join, prefix_trie, quality_fm, sentencepiece_codec, sharding, token_alignment, url_filter, warc
from tilestrata.llm.storage import cut, scratch

#: Rank file of op12.
RANKS_PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Tokenizer file of op11's first side.
TOKENIZER_PATH = "/opt/tokenizers/byte_bpe_50k.json"
#: Vocabulary file of op3, op5 and op11.
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    samples = language_id.learn(docs.filter(fold("doc_id", 4) != 2))
    return language_id.identify(docs, samples, columns=[F.col("doc_id"), (fold("doc_id", 4) == 2).alias("held_out")])


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.byte_shards(table(spark, sf_dir, "documents"), n_shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_lm_score(spark: SparkSession, sf_dir: str, model_path: str = MODEL_PATH) -> DataFrame:
    return lattice_lm.score(table(spark, sf_dir, "documents"), sentencepiece_codec.read_model(model_path), fold("doc_id", 10) != 0, group_col="lang")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    warc.write_warc(table(spark, sf_dir, "pages"), path, "page_id", "url", "html", least_bytes=1000)
    read = warc.read_warc(spark, path).filter(F.col("record_type").isin("response", "revisit"))
    return read.select(
        F.col("record_id").cast("long").alias("page_id"),
        F.coalesce(F.octet_length("payload").cast("long"), "payload_bytes").alias("payload_bytes"),
        F.coalesce(F.sha1("payload"), "payload_digest").alias("payload_digest"),
        "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
    )


def op5_sentencepiece(spark: SparkSession, sf_dir: str, model_path: str = MODEL_PATH) -> DataFrame:
    return sentencepiece_codec.encode(table(spark, sf_dir, "documents"), sentencepiece_codec.read_model(model_path), columns=[F.col("doc_id")])


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_components(table(spark, sf_dir, "documents"), size=3, percent=90)


def op7_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality_fm.fit(docs, labels.filter(fold("doc_id", 5) != 0))
    out = quality_fm.predict(docs, model, columns=[F.col("doc_id"), (fold("doc_id", 5) == 0).alias("held_out")])
    return out.select("doc_id", "held_out", F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.3).cast("int").alias("predicted"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"), keep="max")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), "contaminated")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict")


def op11_token_alignment(spark: SparkSession, sf_dir: str, tokenizer_path: str = TOKENIZER_PATH, model_path: str = MODEL_PATH) -> DataFrame:
    a, b = token_alignment.read_file(tokenizer_path), token_alignment.read_file(model_path)
    return token_alignment.align(table(spark, sf_dir, "documents"), a, b, columns=[F.col("doc_id")])


def op12_byte_bpe(spark: SparkSession, sf_dir: str, ranks_path: str = RANKS_PATH, pattern: str = byte_bpe.PATTERN) -> DataFrame:
    ranks = byte_bpe.read_ranks(ranks_path)
    out = byte_bpe.decode(byte_bpe.encode(table(spark, sf_dir, "documents"), ranks, pattern, columns=[F.col("doc_id")]), ranks)
    ids = F.array_join(F.col("token_ids").cast("array<string>"), " ")
    return out.select("doc_id", "n_tokens", F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = cut(prefix_trie.paths(table(spark, sf_dir, "conversations")), "paths")
    return prefix_trie.nodes(prefix_trie.graft(convs, F.col("conv_id") - F.col("conv_id") % 5, fold("conv_id", 9).cast("int")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_sharding, op3_lm_score, op4_warc, op5_sentencepiece, op6_ngram_join, op7_quality_fm, op8_exact_dedup, op9_decontamination, op10_url_filter, op11_token_alignment, op12_byte_bpe, op13_prefix_trie)}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL. op1, op3, op5 and op7 are models or codecs, and DuckDB has no crc32 for op2's column; tests hold those against brute force."""
    return {
        "op4_warc": """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
k AS (SELECT *, max(page_id) OVER (PARTITION BY d) AS stays FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 1000 AND stays <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND stays <> page_id THEN stays END AS refers_to
FROM k""",
        "op6_ngram_join": rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT c.a, c.b FROM c JOIN n x ON x.doc_id = c.a JOIN n y ON y.doc_id = c.b WHERE 100 * c.c >= 90 * (x.n + y.n - c.c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) m USING (doc_id)""",
        "op8_exact_dedup": """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
        "op9_decontamination": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
x AS (SELECT DISTINCT item_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) <= 10 THEN [w] ELSE list_transform(range(1, len(w) - 8), lambda k: w[k:k + 9]) END) AS win FROM i),
s AS (SELECT DISTINCT len(win) AS n FROM x),
p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS pos FROM d),
h AS (SELECT p.doc_id, p.pos, s.n, x.item_id FROM p JOIN s ON p.pos + s.n - 1 <= len(p.w) JOIN x ON len(x.win) = s.n AND x.win = p.w[p.pos:p.pos + s.n - 1]),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS k FROM h) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)""",
        "op13_prefix_trie": """
WITH o AS (SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST, role, text) AS s FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT *, xor(list_reduce([4294967295::BIGINT] || list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i: ascii(substr(conv_id::VARCHAR, i, 1))::BIGINT),
        lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, (v & 1) * 3988292384))), 4294967295::BIGINT) % 9 AS h FROM o),
r AS (SELECT c.conv_id, coalesce(p.s[1:c.h], []) || c.s[c.h + 1:] AS s FROM h c LEFT JOIN o p ON p.conv_id = c.conv_id - c.conv_id % 5),
m AS (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS d FROM r),
k AS (SELECT conv_id, d, sha256(to_json(s[1:d])::VARCHAR) AS k, CASE WHEN d > 0 THEN sha256(to_json(s[1:d - 1])::VARCHAR) END AS up, CASE WHEN d > 0 THEN strlen(s[d].t) ELSE 0 END AS b, len(s) = d AS e FROM m),
n AS (SELECT k, any_value(d) AS d, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n, (count(*) - 1) * any_value(b) AS saved,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (e), '')) AS ends FROM k GROUP BY k),
c AS (SELECT up AS k, count(*) AS c FROM n WHERE up IS NOT NULL GROUP BY up),
x AS (SELECT n.*, coalesce(c.c, 0) AS c FROM n LEFT JOIN c USING (k)),
a AS (SELECT DISTINCT k.k AS top, l.k FROM k JOIN k l ON l.conv_id = k.conv_id AND l.d >= k.d),
t AS (SELECT a.top AS k, sum(saved)::BIGINT AS saved, count(*) FILTER (x.c = 0) AS leaves FROM a JOIN x ON x.k = a.k GROUP BY a.top)
SELECT x.conv_id, x.d AS depth, p.conv_id AS parent_conv_id, x.n AS n_convs, x.c AS n_children, t.leaves AS n_leaves, t.saved AS saved_tokens, x.ends AS ends_sha256
FROM x JOIN t USING (k) LEFT JOIN x p ON p.k = x.up""",
    }
