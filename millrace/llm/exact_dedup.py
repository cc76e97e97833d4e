"""Operator 11: exact dedup by skew-safe combining.

Rows of equal text are combined three times, and each time it is the whole text that is compared, never a digest alone:

1. locally: a task merges the rows that it reads (the partial half of the aggregation), so a text leaves a task once;
2. salted: what the tasks send of a text meets under a few salts, so a text with copies in every task is merged in several
   places;
3. globally: a text has at most one row for each salt left, and these winners are merged.

A class is then named by its text's digest.  Where different texts share a digest, they are numbered and their rows find
the number by text.  What is done after that, with ids, classes and places, is done on stored tables without texts.

Defined results: a null text counts as empty; a null doc_id is smaller than any other; of rows that share the largest
doc_id of their class one stays; an empty table gives no rows; other columns of ``docs`` are not read, and are returned
as they are by ``without_copies``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import free_names, small_side, staged

#: Places in which the copies of one text are merged before the last merge.
SALTS = 32
#: Rows up to which the table of repeated classes may be broadcast: a digest and five numbers each.
REPEATED_ROWS = 200_000
_KEY = ["digest", "variant"]

#: What names a class, of the SHA-256 of its text.
Digest = Callable[[Column], Column]


def whole(sha: Column) -> Column:
    return sha


def _sha(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _content() -> Column:
    return F.coalesce("text", F.lit(""))


def classes(docs: DataFrame, digest: Digest = whole) -> DataFrame:
    """(digest, content, keep_id, group_size), a row for each different text of ``docs`` (doc_id, text)."""
    rows = docs.select("doc_id", _content().alias("content"), F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("salt"))
    rows = rows.withColumn("digest", digest(_sha(F.col("content"))))
    winners = rows.groupBy("digest", "salt", "content").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n"))
    return winners.groupBy("digest", "content").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))


def _known(docs: DataFrame, digest: Digest) -> tuple[DataFrame, DataFrame | None]:
    """The classes that have more than one row, as (digest, variant, keep_id, group_size), and (digest, content, variant)
    of the texts that share a digest with another one, if there are such."""
    found = classes(docs, digest).groupBy("digest").agg(
        F.count("*").alias("texts"), F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size")
    )
    found = staged(found.filter("texts > 1 or group_size > 1"), "exact-classes")
    clashing = found.filter("texts > 1").select("digest")
    plain = found.filter("texts = 1").select("digest", F.lit(0).alias("variant"), "keep_id", "group_size")
    if clashing.isEmpty():
        return plain, None
    own = docs.select("doc_id", "text", digest(_sha(_content())).alias("_of")).join(clashing, F.col("_of") == F.col("digest"), "left_semi")
    number = F.row_number().over(Window.partitionBy("digest").orderBy("content"))
    variants = staged(classes(own, digest).withColumn("variant", number), "exact-variants")
    repeated = variants.filter("group_size > 1").select(*_KEY, "keep_id", "group_size")
    return plain.union(repeated), variants.select("digest", "content", "variant")


def _keyed(rows: DataFrame, variants: DataFrame | None) -> DataFrame:
    """``rows`` (digest, content, ...) with the number of their text among those of its digest instead of the text."""
    if variants is None:
        return rows.drop("content").withColumn("variant", F.lit(0))
    found = rows.join(variants, ["digest", "content"], "left").drop("content")
    return found.withColumn("variant", F.coalesce("variant", F.lit(0)))


def exact_classes(docs: DataFrame, digest: Digest = whole) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for each row of ``docs`` (doc_id, text), those that go included."""
    repeated, variants = _known(docs, digest)
    rows = docs.select("doc_id", _content().alias("content")).withColumn("sha", _sha(F.col("content")))
    rows = _keyed(rows.withColumn("digest", digest(F.col("sha"))), variants)
    keyed = staged(rows.withColumn("place", F.monotonically_increasing_id()), "exact-rows")
    first = keyed.join(small_side(repeated, REPEATED_ROWS), _KEY).filter(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    first = first.groupBy(*_KEY).agg(F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"), F.min("place").alias("kept_place"))
    judged = keyed.join(small_side(staged(first, "exact-keepers"), REPEATED_ROWS), _KEY, "left")
    copy = F.col("group_size").isNotNull()
    return judged.select(
        "doc_id", F.when(copy, F.col("keep_id")).otherwise(F.col("doc_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size"),
        (~copy | (F.col("place") == F.col("kept_place"))).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"),
    )


def without_copies(docs: DataFrame, digest: Digest = whole) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns as they were."""
    repeated, variants = _known(docs, digest)
    names = free_names(docs, "digest_of", "variant_of", "kept_id", "class_rows")
    repeated = repeated.toDF(*names)
    if variants is None:
        marked = docs.withColumns({names[0]: digest(_sha(_content())), names[1]: F.lit(0)})
    else:
        text_name = free_names(docs, "content_of")[0]
        variants = variants.toDF(names[0], text_name, names[1])
        marked = docs.withColumns({names[0]: digest(_sha(_content())), text_name: _content()}).join(variants, [names[0], text_name], "left")
        marked = marked.withColumn(names[1], F.coalesce(names[1], F.lit(0)))
    marked = marked.join(small_side(repeated, REPEATED_ROWS), names[:2], "left")
    alone = F.col(names[3]).isNull()
    keepers = marked.filter(~alone & F.col("doc_id").eqNullSafe(F.col(names[2]))).dropDuplicates(names[:2])
    return marked.filter(alone).union(keepers).select(*docs.columns)
