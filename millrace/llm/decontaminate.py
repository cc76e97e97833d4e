"""Operator 4: benchmark passages in training texts.

Items are cut into windows of ten normalised words (an item with fewer is one
window); the windows' hashes are broadcast once their number is known to be
within ``MOST_WINDOWS`` and their size within ``MOST_WINDOW_BYTES``, else the hit search is a shuffled join.  Every window
of every text is hashed and looked up in the same pass that counts the words,
and each hit is verified by comparing the words themselves.  Hits name their
window; the items that share a window are looked up by (text, window), so a
window of many items is not copied into its hits.  All of it is DataFrame
operations.

Defined results: a null text or item has no words; a text or item without words
has no windows, so no hits; equal items each count; a doc_id with several
different texts gives a row for each, and a repeated row gives one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import ascii_lower, free_names, staged

WINDOW = 10
#: Windows that are broadcast at most, and the bytes of their hashes and words.
MOST_WINDOWS, MOST_WINDOW_BYTES = 1_000_000, 200 << 20

#: The words of the contract, after A-Z became a-z.
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The words of a text; null has none."""
    spaced = F.trim(F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), _SEPARATORS, " "))
    return F.when(spaced == "", F.array().cast("array<string>")).otherwise(F.split(spaced, " "))


def window_hash(words: Column, start: Column, length: Column) -> Column:
    """The hash of ``length`` words from the 1-based ``start`` on."""
    return F.xxhash64(F.slice(words, start, length))


def cut_items(benchmark: DataFrame) -> DataFrame:
    """(item_id, hash, check, length, words): the windows of each item; ``check`` tells windows of an equal hash apart."""
    items = benchmark.select("item_id", words_of(F.col("text")).alias("item_words")).filter(F.size("item_words") > 0)
    items = items.withColumn("length", F.least(F.size("item_words"), F.lit(WINDOW)))
    starts = F.explode(F.sequence(F.lit(1), F.size("item_words") - F.col("length") + 1))
    cut = items.withColumn("start", starts).select("item_id", "length", F.slice("item_words", F.col("start"), F.col("length")).alias("words"))
    return cut.select("item_id", F.xxhash64("words").alias("hash"), F.xxhash64(F.lit("window"), "words").alias("check"), "length", "words")


def item_windows(benchmark: DataFrame) -> DataFrame:
    """(hash, check, length, words): each distinct window."""
    return staged(cut_items(benchmark).drop("item_id").distinct(), "item-windows")


def may_broadcast(windows: DataFrame) -> bool:
    """Whether the number and the measured bytes of the windows are within their bounds."""
    size = F.octet_length(F.array_join("words", " ")) + 8 * F.size("words") + 40
    found = windows.agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("size")).first()
    return found["n"] <= MOST_WINDOWS and found["size"] <= MOST_WINDOW_BYTES


def hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each text: doc_id, text_hash, n_words, and hits, an array of (start, length, hash, check); starts count from 1."""
    windows = item_windows(benchmark)
    lengths = sorted(r[0] for r in windows.select("length").distinct().collect())  # ten at most
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words_of(F.col("text")).alias("doc_words"))
    words = texts.select("doc_id", "text_hash", "doc_words", F.size("doc_words").cast("long").alias("n_words"), F.posexplode_outer("doc_words"))
    words = words.drop("col").withColumn("start", F.coalesce(F.col("pos"), F.lit(0)) + 1)
    if len(lengths) > 1:
        words = words.withColumn("size", F.explode(F.array(*map(F.lit, lengths))))
    else:
        words = words.withColumn("size", F.lit(lengths[0] if lengths else WINDOW))
    complete = F.col("start") + F.col("size") - 1 <= F.col("n_words")
    words = words.withColumn("window", F.when(complete, window_hash(F.col("doc_words"), F.col("start"), F.col("size"))))
    side = windows.select("hash", "check", "length", F.col("words").alias("item_window"))
    same = (F.col("window") == F.col("hash")) & (F.col("size") == F.col("length"))
    verified = F.col("item_window") == F.slice("doc_words", F.col("start"), F.col("size"))
    hit = F.when(verified, F.struct("start", F.col("size").alias("length"), "hash", "check"))
    if may_broadcast(windows):
        first = (F.col("start") == 1) & (F.col("size") == F.lit(lengths[0] if lengths else WINDOW))
        kept = words.join(F.broadcast(side), same, "left").withColumn("hit", hit).filter(first | F.col("hit").isNotNull())
    else:  # the hashes are shuffled alone, and texts with an equal hash are fetched to verify it
        found = words.select("doc_id", "text_hash", "start", "size", "window").filter("window is not null").join(side, same)
        found = found.select(F.col("doc_id").alias("of_doc"), F.col("text_hash").alias("of_text"), "start", "size", "item_window", "hash", "check")
        of = F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("text_hash") == F.col("of_text"))
        counted = texts.withColumn("n_words", F.size("doc_words").cast("long"))
        kept = counted.join(found, of, "left").withColumn("hit", hit)
    return kept.select("doc_id", "text_hash", "n_words", "hit").groupBy("doc_id", "text_hash", "n_words").agg(F.collect_set("hit").alias("hits"))


def covered(found: Column) -> Column:
    """How many words the sorted hits cover: each adds what reaches past those before it."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def add(held: Column, hit: Column) -> Column:
        end = hit["start"] + hit["length"] - 1
        return F.struct(F.greatest(held["end"], end).alias("end"), (held["n"] + F.greatest(F.lit(0), end - F.greatest(held["end"], hit["start"] - 1))).cast("long").alias("n"))

    return F.aggregate(F.sort_array(found), start, add, lambda held: held["n"])


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n_words, n_hit, n_items, items_sha256, contaminated)."""
    found = hits(docs, benchmark)
    found = staged(found.select("doc_id", "text_hash", "n_words", covered(F.col("hits")).alias("n_hit"), F.transform("hits", lambda h: F.struct(h["hash"], h["check"])).alias("windows")), "window-hits")
    keys = {"doc_id": "of_doc", "text_hash": "of_text"}
    placed = found.select("doc_id", "text_hash", F.explode(F.array_distinct("windows")).alias("window")).select("doc_id", "text_hash", "window.*")
    owners = cut_items(benchmark).select("hash", "check", "item_id").distinct()
    items = placed.join(owners, ["hash", "check"]).select(*keys, F.col("item_id").cast("string").alias("item")).distinct()
    items = items.groupBy(*keys).agg(F.array_sort(F.collect_list("item")).alias("items")).withColumnsRenamed(keys)
    joined = found.join(items, F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("text_hash") == F.col("of_text")), "left")
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return joined.select(
        "doc_id", "text_hash", "n_words", "n_hit",
        F.size(listed).cast("long").alias("n_items"),
        F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a benchmark window; all columns stay."""
    bad_id, bad_text = free_names(docs, "bad_id", "bad_text")
    bad = hits(docs, benchmark).filter(F.size("hits") > 0).select(F.col("doc_id").alias(bad_id), F.col("text_hash").alias(bad_text))
    bad = staged(bad, "contaminated")
    bad = F.broadcast(bad) if bad.count() <= MOST_WINDOWS else bad
    same = F.col("doc_id").eqNullSafe(F.col(bad_id)) & (F.xxhash64("text") == F.col(bad_text))
    return docs.join(bad, same, "left_anti")
