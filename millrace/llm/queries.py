"""The registered queries of the numbered operators, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, collocations, decontaminate, exact_dedup, language_id, line_dedup, ngram_join, oracle, quality, substring_dedup, token_counts, url_filter, warc, whitening
from .shared import fresh_path

WORD_BPE = "word_bpe_49k.json"
#: Tokens above which a text does not fit the context.
CONTEXT_TOKENS = 2048

#: The rules of the URL query.
URL_RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_classes(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache starts empty at each call."""
    path = str(public_tokenizers.path(WORD_BPE))
    counts = token_counts.token_counts(table(spark, sf_dir, "documents"), path, fresh_path(spark, "token-cache"))
    return counts.withColumn("over_limit", F.col("n_tokens") > CONTEXT_TOKENS)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.round_trip(table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = quality.measured(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return measured.drop("text", "kept_text")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    languages = language_id.fit(docs.filter(~language_id.held_out()))
    found = language_id.identify(docs.select("doc_id", "text"), languages)
    return found.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score", "margin_bytes", "accepted")


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"), ngram_join.Similarity(words=3, percent=90))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), str(public_tokenizers.path(WORD_BPE)))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), url_filter.parsed_rules(URL_RULES))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is removed of each document, with the documents that keep it."""
    spans = substring_dedup.repeated_spans(table(spark, sf_dir, "documents"), least_points=1, every_line=True)
    return spans.drop("text_hash")


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_classes(table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_token_counts": op2_token_counts,
    "op3_warc": op3_warc,
    "op4_decontaminate": op4_decontaminate,
    "op5_quality": op5_quality,
    "op6_language_id": op6_language_id,
    "op7_ngram_join": op7_ngram_join,
    "op8_bpe": op8_bpe,
    "op9_url_filter": op9_url_filter,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_collocations": op12_collocations,
    "op13_whitening": op13_whitening,
}

ORACLE_SQL: dict[str, str] = {
    "op3_warc": oracle.WARC,
    "op4_decontaminate": oracle.CONTAMINATION,
    "op5_quality": oracle.QUALITY,
    "op7_ngram_join": oracle.SIMILAR,
    "op9_url_filter": oracle.verdicts(url_filter.parsed_rules(URL_RULES), url_filter.LEAST_DISTRUST),
    "op11_exact_dedup": oracle.EXACT_CLASSES,
    "op12_collocations": oracle.COLLOCATIONS,
}
