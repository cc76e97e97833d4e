"""Operator 2: token counts through a cache of digests.

A text's digest, the digest of the tokenizer file and the version of its library
name its count in a stored table.  Distinct digests that the table lacks are encoded once, by the
tokenizer's own library in Arrow batches on the executors, and appended.  Then
every row takes its count from the table.

Normalisation takes away only what cannot change a count: a null text becomes
an empty one, and for tokenizers that drop white space, ASCII blanks at both
ends go.

Defined results: null and empty texts have 0 bytes and 0 tokens; repeated rows
and equal texts each give a row, from one encoding; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import vocabulary
from .shared import in_batches

#: Bytes of text that are given to the library at once.
ENCODE_BYTES = 4 << 20


def library_counter(spec: bytes, kind: str):
    """A function from a list of texts to their token counts."""
    if kind == "json":
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(spec.decode("utf-8"))
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return lambda texts: [len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_proto=spec)
    return lambda texts: [len(e) for e in processor.encode(texts, num_threads=1)]


def library_version(kind: str) -> str:
    from importlib.metadata import version

    return version("tokenizers" if kind == "json" else "sentencepiece")


def drops_blanks(spec: bytes, kind: str) -> bool:
    """Whether the tokenizer's pre-tokeniser is known to keep no white space."""
    if kind != "json":
        return False
    steps = (json.loads(spec).get("pre_tokenizer") or {}).get("pretokenizers", [])
    return any(s.get("type") == "Split" and s.get("behavior") == "Removed" and s.get("invert") and r"[^\s" in (s.get("pattern") or {}).get("Regex", "") for s in steps)


def normalised(text: Column, blanks_drop: bool) -> Column:
    whole = F.coalesce(text, F.lit(""))
    return F.trim(whole, F.lit(" \t\n\r")) if blanks_drop else whole


def token_counts(docs: DataFrame, path: str, cache: str) -> DataFrame:
    """``docs`` (doc_id, text) as (doc_id, n_bytes, n_tokens); ``cache`` is a folder that all executors share."""
    spark = docs.sparkSession
    spec, kind = vocabulary(path), path.rsplit(".", 1)[-1]
    version = f"{hashlib.sha256(spec).hexdigest()}-{library_version(kind)}"
    sent = spark.sparkContext.broadcast(spec)
    table = f"{cache}/tokenizer={version}"
    stored_schema = "digest binary, n_tokens long"

    content = normalised(F.col("text"), drops_blanks(spec, kind))
    keyed = docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), content.alias("content"))
    keyed = keyed.withColumn("digest", F.unhex(F.sha2("content", 256)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = library_counter(sent.value, kind)
        for batch in batches:
            counts, held, size = [], [], 0
            for text in batch.column(1):
                held.append(text.as_py())
                size += len(held[-1])
                if size >= ENCODE_BYTES:
                    counts += counter(held)
                    held, size = [], 0
            counts += counter(held) if held else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=["digest", "n_tokens"])

    distinct = keyed.select("digest", "content").dropDuplicates(["digest"])
    if stored(docs, table):
        distinct = distinct.join(spark.read.schema(stored_schema).parquet(table), "digest", "left_anti")
    in_batches(distinct, count, stored_schema).write.mode("append").option("compression", "zstd").parquet(table)
    counts = spark.read.schema(stored_schema).parquet(table).dropDuplicates(["digest"])  # two writers may have counted a text at the same time
    return keyed.select("doc_id", "n_bytes", "digest").join(counts, "digest").select("doc_id", "n_bytes", "n_tokens")


def stored(docs: DataFrame, table: str) -> bool:
    """Whether the cache has counts of this tokenizer already."""
    from pyspark.errors import AnalysisException

    try:
        docs.sparkSession.read.schema("digest binary").parquet(table)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return False
        raise
    return True
