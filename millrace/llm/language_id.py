"""Operator 6: language identification by compression.

Each language has a zstandard dictionary of raw text from labelled
documents.  A text gets the language whose dictionary makes it smallest; of
equal sizes, the language with more labelled documents.  Texts are compressed
whole, in blocks that fit the window next to the dictionary.

The margin is by how many bytes the best size is below the second, and the score
is that as a part of the second.  A text is rejected if its margin is narrow:
below ``LEAST_MARGIN`` as a part, or below a number of bytes that is learned from
labelled documents outside the dictionaries, as the one that accepts most texts
more rightly than wrongly.  One rule holds at every length, so ties are always
rejected: a byte is a larger part of a short text, and as much evidence there.

Defined results: a null text or one without letters is ``und`` with score 0 and
rejected; with no labelled document every text is ``und``; with one language
only, texts with letters have score 1 and are accepted.  Repeated rows each
give a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .shared import in_batches, staged

#: The bounded sample: of each language so many documents, those of so many bytes at most first and of longer ones a part of
#: so many code points; they fill so many bytes of a dictionary, and the others are there to learn the least margin from.
SAMPLE_DOCS, SAMPLE_BYTES, SAMPLE_POINTS, DICTIONARY_BYTES = 240, 20_000, 5_000, 100_000
#: All dictionaries together; with many languages each gets its part of it, but not less than it takes to tell languages apart.
ALL_DICTIONARIES_BYTES, LEAST_DICTIONARY_BYTES = 20_000_000, 10_000
#: A block and a dictionary fit the window of 128 kB.
BLOCK_BYTES, WINDOW_LOG = 16_000, 17
#: The least margin as a part of the second size, and the largest number of bytes that may be learned.
LEAST_MARGIN, MOST_LEAST_BYTES = 0.004, 64


class Languages(NamedTuple):
    """Names with their dictionaries, most labelled documents first, and the least margin in bytes."""

    names: list[str]
    dictionaries: list[bytes]
    least_bytes: int = 1


def fit(labelled: DataFrame) -> Languages:
    """Dictionaries and least margin from ``labelled`` (doc_id, text, lang); rows that lack text or lang are left out.

    Every language that has a text gets a dictionary, however long its texts and however many languages there are.
    """
    usable = labelled.filter("lang is not null and text <> ''").select("doc_id", "lang", "text")
    counts = usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()
    if not counts:
        return Languages([], [])
    # a share of each language's rows that holds the sample with room, so that few rows are ranked
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, (4 * SAMPLE_DOCS + 40) / r["count"]))])
    drawn = usable.withColumn("draw", F.xxhash64("doc_id", F.lit("sample"))).filter(F.pmod("draw", F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000)
    long = F.octet_length("text") > SAMPLE_BYTES
    start = F.pmod("draw", F.greatest(F.lit(1), F.length("text") - SAMPLE_POINTS + 1)).cast("int")  # where the part of a long text is taken
    part = F.when(long, F.substring(F.col("text"), start + 1, F.lit(SAMPLE_POINTS))).otherwise(F.col("text"))
    drawn = drawn.select("lang", "doc_id", "draw", long.alias("long"), part.alias("text"))
    ranked = drawn.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("long", "draw", "doc_id", "text")))
    sample = staged(ranked.filter(F.col("place") <= SAMPLE_DOCS).withColumn("text", F.lower("text")), "language-sample")
    before = F.sum(F.octet_length("text") + 1).over(Window.partitionBy("lang").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    size = max(LEAST_DICTIONARY_BYTES, min(DICTIONARY_BYTES, ALL_DICTIONARIES_BYTES // len(counts)))
    sample = sample.withColumn("inside", (before <= size) | (F.col("place") == 1))
    texts: dict[str, list[str]] = {}
    for r in sample.filter("inside").select("lang", "place", "text").orderBy("lang", "place").collect():
        texts.setdefault(r["lang"], []).append(r["text"])
    names = [r["lang"] for r in counts if r["lang"] in texts]
    languages = Languages(names, ["\n".join(texts[n]).encode("utf-8")[:size].decode("utf-8", "ignore").encode("utf-8") for n in names])
    margin = F.least("margin_bytes", F.lit(MOST_LEAST_BYTES))
    right = F.when(F.col("lang_pred") == F.col("lang"), 1).otherwise(-1)
    trial = identify(sample.filter("not inside").select("lang", "text"), languages).filter("margin_bytes > 0")
    worth = {r["margin"]: r["worth"] for r in trial.groupBy(margin.alias("margin")).agg(F.sum(right).alias("worth")).collect()}
    gained = lambda least: sum(w for m, w in worth.items() if m >= least)
    return languages._replace(least_bytes=max(range(1, MOST_LEAST_BYTES + 1), key=lambda x: (gained(x), -x)))


def compressors(languages: Languages) -> list:
    import zstandard as zs

    how = zs.ZstdCompressionParameters(
        window_log=WINDOW_LOG, chain_log=WINDOW_LOG, hash_log=WINDOW_LOG, search_log=4, min_match=4, target_length=32, strategy=zs.STRATEGY_GREEDY,
        write_content_size=False, write_checksum=False, write_dict_id=False,
    )
    made = []
    for raw in languages.dictionaries:
        dictionary = zs.ZstdCompressionDict(raw, dict_type=zs.DICT_TYPE_RAWCONTENT)
        dictionary.precompute_compress(compression_params=how)
        made.append(zs.ZstdCompressor(dict_data=dictionary, compression_params=how))
    return made


def classify(text: str | None, languages: Languages, tools: list) -> tuple[str, float, int, bool]:
    """Language, score, margin in bytes, and whether it is accepted."""
    if not text or not tools or not any(map(str.isalpha, text)):
        return "und", 0.0, 0, False
    data = text.lower().encode("utf-8")
    blocks = [data[i : i + BLOCK_BYTES] for i in range(0, len(data), BLOCK_BYTES)]
    sizes = [sum(len(t.compress(b)) for b in blocks) for t in tools]
    best = min(range(len(sizes)), key=lambda i: (sizes[i], i))
    if len(sizes) == 1:
        return languages.names[0], 1.0, sizes[0], True
    second = min(s for i, s in enumerate(sizes) if i != best)
    margin = second - sizes[best]
    return languages.names[best], margin / second, margin, margin >= max(1, languages.least_bytes, LEAST_MARGIN * second)


def identify(docs: DataFrame, languages: Languages) -> DataFrame:
    """``docs`` with the columns lang_pred, score, margin_bytes and accepted in place of any of these names; every other column stays."""
    sent = docs.sparkSession.sparkContext.broadcast(languages)
    kinds = {"lang_pred": T.StringType(), "score": T.DoubleType(), "margin_bytes": T.LongType(), "accepted": T.BooleanType()}
    docs = docs.drop(*kinds)
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, t) for n, t in kinds.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = compressors(sent.value)
        for batch in batches:
            at = batch.schema.get_field_index("text")
            found = [classify(t.as_py(), sent.value, tools) for t in batch.column(at)]
            columns = zip(*found, strict=True) if found else ((),) * len(kinds)
            types = (pa.string(), pa.float64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=schema.names)

    return in_batches(docs, run, schema)


def held_out(doc_id: str = "doc_id"):
    """The fold on which accuracy is measured and from which nothing is learned."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))
