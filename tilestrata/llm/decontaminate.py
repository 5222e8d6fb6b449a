"""Benchmark decontamination as a prefix-filtered set join; DataFrame functions only.

An item's windows are its runs of `window` consecutive words (a shorter item is one
window). A document contains a window only if it contains every word shingle of it, so
for exact containment the necessary prefix of a window, with shingles ordered by rarity
over all documents, is its single rarest shingle. The join goes:

1. count, over all documents, the shingles (single words) that occur in windows;
2. take each distinct window's rarest word, with its place in the window (the prefix token);
3. join document words with prefix tokens; the place in the window fixes where an occurrence must
   start and end, so length and positional bounds drop those that do not fit the document;
4. verify the words of the remaining places exactly, and unite the spans of each document.

Prefix tokens are broadcast in blocks of at most `block_windows` windows (a proven bound of
block_windows * window words); a larger benchmark takes several passes over the documents
and loses nothing. A document is never joined with all windows, and the words of a
document are never shuffled: only verified spans are.

Defined results: null and empty texts have no words, are never hit, and items without
words have no windows; equal windows of several items count for each of them; every row is judged by its own text, whether
its id is repeated or null (rows go by the MD5 of id and text, 128 bits; rows equal in both have equal results); an empty
benchmark leaves all documents clean; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilestrata.llm.storage import cut, fresh, small

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words are runs of ASCII letters, digits and everything beyond ASCII.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Lower-cased words; an empty array for null. Only the first and last piece of a split can be empty."""
    lowered = F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(lowered, GAP), "")


def windows_of(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(item, win) of every window; win is an array of words."""
    w = items.select(F.col(id_col).alias("item"), words_of(F.col(text_col)).alias("w")).filter(F.size("w") > 0)
    return w.select("item", F.explode(F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0))), lambda i: F.slice("w", i + 1, window))).alias("win")).distinct()


def occurrences(docs: DataFrame, windows: DataFrame, id_col: str, text_col: str, block_windows: int = 200_000) -> DataFrame:
    """(doc, win_id, start, len) of every occurrence of a distinct window."""
    words = docs.select(F.col(id_col).alias("doc"), words_of(F.col(text_col)).alias("w"))
    n = windows.count()
    blocks = max(1, -(-n // block_windows))
    found = []
    for b in range(blocks):
        wins = windows if blocks == 1 else windows.filter(F.pmod("win_id", F.lit(blocks)) == b)
        vocab = wins.select(F.explode("win").alias("word")).distinct()
        counts = words.select(F.explode("w").alias("word")).join(F.broadcast(vocab), "word").groupBy("word").count()
        ranked = vocab.join(counts, "word", "left").select("word", F.coalesce("count", F.lit(0)).alias("df"))
        place = wins.select("win_id", "win", F.posexplode("win").alias("off", "word")).join(ranked, "word")
        prefix = place.groupBy("win_id").agg(F.min(F.struct("df", "word", "off")).alias("p"), F.first("win").alias("win"))
        prefix = cut(prefix.filter("p.df > 0").select("win_id", "p.word", "p.off", "win"), "prefix")
        at = words.select("doc", "w", F.posexplode("w").alias("pos", "word")).join(F.broadcast(prefix), "word")
        # expressions with generated code only: so rows that leave this stage don't hold a document's words
        start, size = F.col("pos") - F.col("off"), F.size("win")
        fits = (start >= 0) & (start + size <= F.size("w"))
        at = at.filter(fits & (F.slice("w", F.greatest(start, F.lit(0)) + 1, size) == F.col("win")))
        found.append(at.select("doc", "win_id", start.alias("start"), size.alias("len")))
    return reduce(DataFrame.unionByName, found)


def row_key(id: Column, text: Column) -> Column:
    """128 bits of a row's id and text, null told apart from empty."""
    name = F.coalesce(id.cast("string"), F.lit(""))
    return F.unhex(F.md5(F.concat(F.when(id.isNull(), F.lit("-")).otherwise(F.octet_length(name).cast("string")), F.lit(":"), name, F.coalesce(text.cast("string"), F.lit("")))))


def _hit(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_col: str, window: int, block_windows: int) -> DataFrame:
    """(doc, n_hit, item_ids) by the keys of rows that hold a window."""
    pairs = windows_of(items, item_col, text_col, window)
    windows = cut(pairs.select("win").distinct().withColumn("win_id", F.monotonically_increasing_id()), "windows")
    held_by = cut(pairs.join(windows, "win").select("win_id", "item"), "window-items")
    keyed = docs.select(row_key(F.col(id_col), F.col(text_col)).alias("doc"), F.col(text_col).alias("text"))
    hits = cut(occurrences(keyed, windows, "doc", "text", block_windows), "hits")
    # spans of a document in order; each adds what lies beyond the furthest end so far
    spans = hits.select("doc", "start", "len").distinct().groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("start", (F.col("start") + F.col("len")).alias("end")))).alias("s"))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    grow = lambda a, x: F.struct(F.greatest(a["end"], x["end"]).alias("end"), (a["n"] + F.greatest(x["end"] - F.greatest(x["start"], a["end"]), F.lit(0))).alias("n"))
    hit = spans.select("doc", F.aggregate("s", zero, grow)["n"].alias("n_hit"))
    named = hits.select("doc", "win_id").distinct().join(held_by, "win_id")
    named = named.select("doc", F.col("item").cast("string").alias("item")).distinct().groupBy("doc").agg(F.array_sort(F.collect_list("item")).alias("item_ids"))
    return hit.join(named, "doc")


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", window: int = 10, block_windows: int = 200_000) -> DataFrame:
    """One row per document: id, n_words, n_hit, n_items, item_ids (sorted as strings), contaminated."""
    per_doc = _hit(docs, items, id_col, text_col, item_col, window, block_windows)
    size = docs.select(F.col(id_col).alias("_id"), row_key(F.col(id_col), F.col(text_col)).alias("doc"), F.size(words_of(F.col(text_col))).cast("long").alias("n_words"))
    out = size.join(per_doc, "doc", "left")
    none = F.array().cast("array<string>")
    return out.select(
        F.col("_id").alias(id_col),
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.size(F.coalesce("item_ids", none)).cast("long").alias("n_items"),
        F.coalesce("item_ids", none).alias("item_ids"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", window: int = 10, block_windows: int = 200_000) -> DataFrame:
    """docs without the rows that hold a benchmark window; all columns of docs."""
    own = fresh("_bad", docs.columns)
    bad = small(_hit(docs, items, id_col, text_col, item_col, window, block_windows).select(F.col("doc").alias(own)))
    return docs.join(bad, row_key(docs[id_col], docs[text_col]) == bad[own], "left_anti")
