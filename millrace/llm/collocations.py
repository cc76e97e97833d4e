"""Operator 12: phrases of words that stand together, mined on vertical positional inverted lists.

The text is cut into blocks: runs of whole pieces of about ``BLOCK_WORDS`` words of one language.  A block is a row that holds, for each phrase
in it, the list of positions of the phrase's last word.  A phrase's list is thus spread over all blocks, and no phrase is in one
place, however frequent; the lengths of its lists add up to its exact frequency.  Lists are packed as bytes, so Spark never holds their numbers one by one.

1. Words of a block are numbered along it, with a gap between pieces, and each word's list is written.
2. Lists of frequent words stay.  The lists of a block are merged by position, and where one position follows another, the list
   at the first is extended by the last word of the list at the second.  A phrase of k + 1 words is therefore only made where both
   of its phrases of k words are frequent.
3. That is repeated to ``longest`` words; between two steps only the lengths of lists are shuffled, not the lists.  Where frequent phrases are
   too many to be sent to all tasks, the place that summed a name answers each block with the name's number, and blocks are shuffled once to meet the answers.
4. Frequencies of all parts are joined to the candidates, cut by cut.

Phrases are named by numbers that are stored with them, not by hashes, so counts are exact.

Defined results: a null text is empty; a null language is ``und``; a piece without words has no phrases; rows that repeat
count each time; an empty table gives no rows; doc_id and other columns are not read.  A piece is never cut, so a text
without any separator is one block.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .hashing import mixed
from .shared import discard, in_batches, staged, stored

#: Bytes that end a piece.
SEPARATORS = b".,;:!?\x0a\x0b\x0c\x0d"
#: Words in a block, about; a block's lists are in one task.
BLOCK_WORDS = 1 << 19
#: Frequent phrases of a size, and bytes of frequent words, up to which their names are sent to all tasks; beyond that each block is answered.
FREQUENT_ROWS, FREQUENT_BYTES = 500_000, 16 << 20
#: Names, of all blocks together, that are summed in one place.
BUCKET_NAMES = 2_000_000
#: Bytes of a row group of blocks, which a reader holds at once.
GROUP_BYTES = 16 << 20
#: Parts of a language whose best phrases are found first.
PARTS = 64

_BREAK = b"."
_TO_BREAK = bytes(_BREAK[0] if c in SEPARATORS else c for c in range(256))
_WORD_BLOCKS = "lang string, block long, names long, places long, words binary, sizes binary, gaps binary"
_BLOCKS = "lang string, block long, names long, heads binary, tails binary, sizes binary, gaps binary"
_DEALT_WORDS = "bucket long, block long, lang string, words binary, sizes binary"
_DEALT_PAIRS = "bucket long, block long, heads binary, tails binary, sizes binary"
_ANSWERS = "block long, bucket long, base long, ids binary"


@dataclass(frozen=True)
class Mining:
    """``least``: occurrences of a candidate; ``longest``: its words; ``inside_percent``: a candidate goes if a longer one
    holds it and has this part of its occurrences; ``best``: rows of a language."""

    least: int = 100
    longest: int = 5
    inside_percent: int = 100
    best: int = 2_000


def _zipped(values: np.ndarray, kind: type = np.int64) -> bytes:
    """Whole numbers as bytes: first the lowest byte of each, then the next ones, so that bytes that hardly differ stand together."""
    width = np.dtype(kind).itemsize
    return zstandard.compress(np.ascontiguousarray(values, dtype=kind).view(np.uint8).reshape(-1, width).T.tobytes(), 1)


def _unzipped(data: bytes, kind: type = np.int64) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), dtype=np.uint8).reshape(width, -1).T).view(kind).ravel()


def _zipped_words(words: list[bytes]) -> bytes:
    """Words as bytes; no word holds a line break, which ends a piece."""
    return zstandard.compress(b"\n".join(words), 1)


def _unzipped_words(data: bytes, n: int) -> list[bytes]:
    return zstandard.decompress(data).split(b"\n") if n else []


def _gaps(positions: np.ndarray) -> bytes:
    """The lists, one behind the other, as the distance of each position from the one before: they take less room."""
    return _zipped(np.diff(positions, prepend=0), np.int32)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    """Rows of a schema of longs, strings and bytes."""
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = [pa.field(name, kinds[kind]) for name, kind in (f.split(" ") for f in schema.split(", "))]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(fields)], schema=pa.schema(fields))


class _Block:
    """Words of one language until they are written; number 0 stands between pieces."""

    def __init__(self) -> None:
        self.numbers: dict[bytes, int] = {_BREAK: 0}
        self.runs: list[np.ndarray] = []
        self.size = 0

    def add(self, tokens: list[bytes]) -> None:
        number = self.numbers
        run = np.fromiter((number.setdefault(t, len(number)) for t in tokens), dtype=np.int32, count=len(tokens))
        self.runs += [run, np.zeros(1, dtype=np.int32)]
        self.size += len(run) + 1

    def lists(self, lang: str, block: int) -> pa.RecordBatch:
        stream = np.concatenate(self.runs)
        order = np.argsort(stream, kind="stable").astype(np.int32)
        sizes = np.bincount(stream, minlength=len(self.numbers)).astype(np.int32)
        words, places = list(self.numbers)[1:], order[sizes[0] :]
        return _batch([(lang, block, len(words), len(places), _zipped_words(words), _zipped(sizes[1:], np.int32), _gaps(places))], _WORD_BLOCKS)


def tokens_of(text: str) -> list[bytes]:
    """The words of a text in lower case (A-Z only), with ``.`` where a piece ends."""
    return text.encode().lower().translate(_TO_BREAK).replace(_BREAK, b" . ").split()


def _parts(tokens: list[bytes], size: int) -> Iterator[list[bytes]]:
    """``tokens`` cut between pieces after ``size`` tokens or more."""
    at = 0
    while len(tokens) - at > size:
        try:
            end = tokens.index(_BREAK, at + size)
        except ValueError:
            break
        yield tokens[at:end]
        at = end + 1
    yield tokens[at:]


def word_blocks(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(lang, block, names, places, words, sizes, gaps) of ``docs`` (text, lang): the lists of a block's words one behind the other, and how many words and places there are."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, n = TaskContext.get().partitionId() << 32, 0
        held: dict[str, _Block] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                for tokens in _parts(tokens_of(text.as_py()), block_words):
                    block = held.setdefault(lang, _Block())
                    block.add(tokens)
                    if block.size >= block_words:
                        yield held.pop(lang).lists(lang, first + n)
                        n += 1
        for lang, block in held.items():
            yield block.lists(lang, first + n)
            n += 1

    rows = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("und")).alias("lang"))
    return in_batches(rows, run, _WORD_BLOCKS)


def extended(ids: np.ndarray, tails: np.ndarray, sizes: np.ndarray, positions: np.ndarray) -> tuple[np.ndarray, ...]:
    """The lists of one block, each extended by the word that follows: heads, tails, sizes and positions.

    The lists are merged by position; where the next position is the one after, the two phrases overlap in all but their
    ends, and the occurrence belongs to the list of the first phrase and the second one's last word.
    """
    owners = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    order = np.argsort(positions, kind="stable")
    positions, owners = positions[order], owners[order]
    follows = np.flatnonzero(positions[1:] == positions[:-1] + 1)
    head, after, at = ids[owners[follows]], tails[owners[follows + 1]], positions[follows + 1]
    order = np.lexsort((at, after, head))
    head, after, at = head[order], after[order], at[order]
    fresh = np.ones(len(head), dtype=bool)
    fresh[1:] = (head[1:] != head[:-1]) | (after[1:] != after[:-1])
    starts = np.flatnonzero(fresh)
    return head[starts], after[starts], np.diff(np.append(starts, len(at))).astype(np.int32), at


class _Words:
    """Numbers of frequent words by language; ``rows`` (lang, word, id)."""

    def __init__(self, rows: pa.Table) -> None:
        self.ids: dict[str, dict[bytes, int]] = {}
        for lang, word, number in zip(*(rows.column(c).to_pylist() for c in ("lang", "word", "id")), strict=True):
            self.ids.setdefault(lang, {})[word.encode()] = number

    def of(self, lang: str, words: list[bytes]) -> np.ndarray:
        known = self.ids.get(lang, {})
        return np.fromiter((known.get(w, -1) for w in words), dtype=np.int64, count=len(words))


class _Pairs:
    """Numbers of frequent phrases by head and tail, as a sorted array of the places of both among all heads and all tails; ``rows`` (head, tail, id)."""

    def __init__(self, rows: pa.Table) -> None:
        head, tail, ids = (rows.column(c).to_numpy() for c in ("head", "tail", "id"))
        self.heads, self.tails = np.unique(head), np.unique(tail)
        codes = self._codes(head, tail)
        order = np.argsort(codes)
        self.codes, self.ids = codes[order], ids[order]

    def _codes(self, head: np.ndarray, tail: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.heads, head) * np.int64(len(self.tails) + 1) + np.searchsorted(self.tails, tail)

    def of(self, head: np.ndarray, tail: np.ndarray) -> np.ndarray:
        if not len(self.codes) or not len(head):
            return np.full(len(head), -1, dtype=np.int64)
        there = np.isin(head, self.heads) & np.isin(tail, self.tails)
        codes = self._codes(head, tail)
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return np.where(there & (self.codes[at] == codes), self.ids[at], -1)


def _word_buckets(words: list[bytes], buckets: int) -> np.ndarray:
    return np.fromiter((crc32(w) % buckets for w in words), dtype=np.int64, count=len(words))


def _pair_buckets(heads: np.ndarray, tails: np.ndarray, buckets: int) -> np.ndarray:
    return (mixed(heads.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ mixed(tails.view(np.uint64))) % np.uint64(buckets)).astype(np.int64)


def _runs(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket that occurs with its places, in their order."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    for places in np.split(order, cuts) if len(order) else ():
        yield int(bucket[places[0]]), places


def _dealt_words(blocks: DataFrame, buckets: int) -> DataFrame:
    """(bucket, block, lang, words, sizes): the words of a block and the lengths of their lists, packed bucket by bucket."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, lang, n, words, sizes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words, sizes = _unzipped_words(words, n), _unzipped(sizes, np.int32)
                runs = _runs(_word_buckets(words, buckets))
                yield _batch([(b, block, lang, _zipped_words([words[i] for i in at]), _zipped(sizes[at], np.int32)) for b, at in runs], _DEALT_WORDS)

    return in_batches(blocks.select("block", "lang", "names", "words", "sizes"), run, _DEALT_WORDS)


def _dealt_pairs(blocks: DataFrame, buckets: int) -> DataFrame:
    """(bucket, block, heads, tails, sizes) in the same way; heads are sorted, and packed by their differences."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, heads, tails, sizes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                heads, tails, sizes = np.cumsum(_unzipped(heads)), _unzipped(tails), _unzipped(sizes, np.int32)
                runs = _runs(_pair_buckets(heads, tails, buckets))
                yield _batch([(b, block, _zipped(np.diff(heads[at], prepend=0)), _zipped(tails[at]), _zipped(sizes[at], np.int32)) for b, at in runs], _DEALT_PAIRS)

    return in_batches(blocks.select("block", "heads", "tails", "sizes"), run, _DEALT_PAIRS)


def _summed_words(table: pa.Table, least: int) -> pa.Table:
    counts: dict[tuple[str, bytes], int] = {}
    for lang, words, sizes in zip(*(table.column(c) for c in ("lang", "words", "sizes")), strict=True):
        of, n = lang.as_py(), _unzipped(sizes.as_py(), np.int32).tolist()
        for word, size in zip(_unzipped_words(words.as_py(), len(n)), n, strict=True):
            counts[of, word] = counts.get((of, word), 0) + size
    found = [(lang, word.decode(), n) for (lang, word), n in counts.items() if n >= least]
    return pa.Table.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["lang", "word", "f"])


def _summed_pairs(table: pa.Table, least: int) -> pa.Table:
    heads = np.concatenate([np.cumsum(_unzipped(v.as_py())) for v in table.column("heads")])
    tails = np.concatenate([_unzipped(v.as_py()) for v in table.column("tails")])
    sizes = np.concatenate([_unzipped(v.as_py(), np.int32) for v in table.column("sizes")])
    order = np.lexsort((tails, heads))
    heads, tails, sizes = heads[order], tails[order], sizes[order]
    fresh = np.flatnonzero(np.concatenate([[True], (heads[1:] != heads[:-1]) | (tails[1:] != tails[:-1])]))
    f = np.add.reduceat(sizes, fresh, dtype=np.int64)
    many = f >= least
    return pa.table({"head": heads[fresh][many], "tail": tails[fresh][many], "f": f[many]})


def _frequent(blocks: DataFrame, first: bool, least: int) -> tuple[DataFrame, int]:
    """Phrases (bucket; lang and word, or head and tail; f, id) whose lists have ``least`` positions or more in all, each with a number of its own, and the number of buckets.

    What is shuffled are names and lengths, packed by buckets of about ``BUCKET_NAMES`` of them; a bucket is summed in one place.
    """
    names = blocks.agg(F.sum("names")).first()[0] or 0
    buckets = max(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(names / BUCKET_NAMES))
    dealt, summed, schema = (_dealt_words, _summed_words, "lang string, word string, f long") if first else (_dealt_pairs, _summed_pairs, "head long, tail long, f long")

    def run(table: pa.Table) -> pa.Table:
        found = summed(table, least)
        return found.add_column(0, "bucket", pa.repeat(table.column("bucket")[0], found.num_rows))

    counts = dealt(blocks, buckets).drop("block").groupBy("bucket").applyInArrow(run, f"bucket long, {schema}")
    return staged(counts.withColumn("id", F.monotonically_increasing_id()), "phrases"), buckets


def _may_send(frequent: DataFrame, first: bool) -> bool:
    sizes = frequent.agg(F.count("*").alias("n"), (F.coalesce(F.sum(F.octet_length("word")), F.lit(0)) if first else F.lit(0)).alias("bytes")).first()
    return sizes.n <= FREQUENT_ROWS and sizes.bytes <= FREQUENT_BYTES


def _stored(blocks: DataFrame, label: str) -> tuple[DataFrame, str]:
    """The stored table and its folder.  Blocks are few and large rows, so row groups are cut by bytes at every row."""
    return stored(blocks, label, **{"parquet.block.size": str(GROUP_BYTES), "parquet.block.size.row.check.min": "1", "parquet.block.size.row.check.max": "2"})


def _named(frequent: DataFrame, first: bool) -> DataFrame:
    return frequent.select("bucket", *(("lang", "word") if first else ("head", "tail")), "id")


def _answers(blocks: DataFrame, frequent: DataFrame, first: bool, buckets: int) -> DataFrame:
    """(block, bucket, base, ids): of the names that a block has in a bucket, in their order, the number less ``base``, or 0 of a name that is not frequent."""

    def run(dealt: pa.Table, rows: pa.Table) -> pa.Table:
        found = []
        if dealt.num_rows and rows.num_rows:
            known, base = (_Words if first else _Pairs)(rows), pc.min(rows.column("id")).as_py() - 1
            for r in zip(*(dealt.column(c) for c in ("bucket", "block", *(("lang", "words") if first else ("heads", "tails")))), strict=True):
                bucket, block, a, b = (x.as_py() for x in r)
                ids = known.of(a, _unzipped_words(b, 1)) if first else known.of(np.cumsum(_unzipped(a)), _unzipped(b))
                if (ids >= 0).any():
                    found.append((block, bucket, base, _zipped(np.where(ids >= 0, ids - base, 0))))
        return pa.Table.from_batches([_batch(found, _ANSWERS)])

    dealt = (_dealt_words if first else _dealt_pairs)(blocks, buckets).drop("sizes")
    return dealt.groupBy("bucket").cogroup(_named(frequent, first).groupBy("bucket")).applyInArrow(run, _ANSWERS)


def _names_of(row: dict, first: bool) -> tuple[str | np.ndarray, list[bytes] | np.ndarray]:
    """What ``_Words.of`` or ``_Pairs.of`` takes."""
    return (row["lang"], _unzipped_words(row["words"], row["names"])) if first else (np.cumsum(_unzipped(row["heads"])), _unzipped(row["tails"]))


def _extended_row(row: dict, ids: np.ndarray, first: bool) -> list[tuple]:
    """The block of a row with its lists extended, or nothing if no list is left; -1 among ``ids`` stands for a list that is not frequent."""
    sizes, positions = _unzipped(row["sizes"], np.int32), np.cumsum(_unzipped(row["gaps"], np.int32), dtype=np.int32)
    stay = ids >= 0
    tails = ids if first else _unzipped(row["tails"])
    heads, after, n, at = extended(ids[stay], tails[stay], sizes[stay], positions[np.repeat(stay, sizes)])
    return [(row["lang"], row["block"], len(heads), _zipped(np.diff(heads, prepend=0)), _zipped(after), _zipped(n, np.int32), _gaps(at))] if len(heads) else []


def _next_blocks(blocks: DataFrame, frequent: DataFrame, first: bool, buckets: int) -> DataFrame:
    """The blocks of phrases of one word more."""
    if _may_send(frequent, first):
        sent = blocks.sparkSession.sparkContext.broadcast((_Words if first else _Pairs)(_named(frequent, first).toArrow()))

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    row = batch.slice(i, 1).to_pylist()[0]
                    yield _batch(_extended_row(row, sent.value.of(*_names_of(row, first)), first), _BLOCKS)

        return in_batches(blocks, run, _BLOCKS)

    def answered(block: pa.Table, answers: pa.Table) -> pa.Table:
        row, found = block.to_pylist()[0], []
        if answers.num_rows:
            a, b = _names_of(row, first)
            places = dict(_runs(_word_buckets(b, buckets) if first else _pair_buckets(a, b, buckets)))
            ids = np.full(row["names"], -1, dtype=np.int64)
            for bucket, base, own in zip(*(answers.column(c) for c in ("bucket", "base", "ids")), strict=True):
                own = _unzipped(own.as_py())
                ids[places[bucket.as_py()]] = np.where(own > 0, own + base.as_py(), -1)
            found = _extended_row(row, ids, first)
        return pa.Table.from_batches([_batch(found, _BLOCKS)])

    answers = _answers(blocks, frequent, first, buckets)
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(answered, _BLOCKS)


def mined(docs: DataFrame, mining: Mining, block_words: int = BLOCK_WORDS) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, f) of the frequent phrases of 1 to ``longest`` words, and (lang, n): the words of a language."""
    blocks, path = _stored(word_blocks(docs, block_words), "blocks-1")
    totals = staged(blocks.groupBy("lang").agg(F.sum("places").alias("n")), "words-by-lang")
    frequent, buckets = _frequent(blocks, True, mining.least)
    words = frequent.select(F.col("id").alias("tail"), "word")
    phrases = frequent.select("lang", "id", F.col("word").alias("phrase"), "f")
    found = phrases.select("lang", "phrase", F.lit(1).alias("size"), "f")
    for size in range(2, mining.longest + 1):
        done = path
        blocks, path = _stored(_next_blocks(blocks, frequent, size == 2, buckets), f"blocks-{size}")
        discard(docs.sparkSession, done)
        frequent, buckets = _frequent(blocks, False, mining.least)
        heads = phrases.select(F.col("id").alias("head"), "lang", "phrase")
        phrases = frequent.join(heads, "head").join(words, "tail")
        phrases = staged(phrases.select("lang", "id", F.concat_ws(" ", "phrase", "word").alias("phrase"), "f"), "phrases")
        found = found.union(phrases.select("lang", "phrase", F.lit(size).alias("size"), "f"))
    discard(docs.sparkSession, path)
    return found, totals


def _words(start: Column | int, n: Column) -> Column:
    return F.array_join(F.slice("words", F.lit(start) if isinstance(start, int) else start, n), " ")


def scored(found: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, phrase, size, a, l, r, n, score) of the phrases of two words or more, each at its lowest-scoring cut.

    The products are decimals of 38 digits.
    """
    parts = found.select("lang", F.col("phrase").alias("part"), "f")
    cuts = found.filter("size > 1").withColumn("words", F.split("phrase", " ")).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.select("lang", "phrase", "size", F.col("f").alias("a"), "k", _words(1, F.col("k")).alias("left"), _words(F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    cuts = cuts.join(parts.select("lang", F.col("part").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(parts.select("lang", F.col("part").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    cuts = cuts.join(F.broadcast(totals) if totals.count() <= FREQUENT_ROWS else totals, "lang")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    ratio = F.call_function("div", (wide("a") * wide("n")).cast("decimal(34,0)") * F.lit(1000).cast("decimal(4,0)"), wide("l") * wide("r"))
    lowest = F.min(F.struct(ratio.cast("bigint").alias("score"), "k", "l", "r", "n")).alias("cut")
    return cuts.groupBy("lang", "phrase", "size", "a").agg(lowest).select("lang", "phrase", "size", "a", "cut.l", "cut.r", "cut.n", "cut.score")


def outermost(candidates: DataFrame, inside_percent: int) -> DataFrame:
    """Candidates that no longer one holds with ``inside_percent`` of their occurrences.

    It is enough to look at candidates of one word more: whatever lies between a phrase and a longer one that holds it
    occurs as often as the longer one at least, so it is a candidate itself and passes the same test.
    """
    longer = candidates.filter("size > 2").select("lang", F.split("phrase", " ").alias("words"), F.col("size").alias("m"), F.col("a").alias("longer_a"))
    inner = longer.select("lang", F.explode(F.array(_words(1, F.col("m") - 1), _words(2, F.col("m") - 1))).alias("phrase"), "longer_a")
    inner = inner.groupBy("lang", "phrase").agg(F.max("longer_a").alias("longer_a"))
    joined = candidates.join(inner, ["lang", "phrase"], "left")
    return joined.filter(F.col("longer_a").isNull() | (100 * F.col("longer_a") < inside_percent * F.col("a"))).drop("longer_a")


def collocations(docs: DataFrame, mining: Mining = Mining(), block_words: int = BLOCK_WORDS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of ``docs`` (text, lang)."""
    found, totals = mined(docs, mining, block_words)
    candidates = staged(scored(found, totals), "candidates")
    kept = outermost(candidates, mining.inside_percent).drop("size")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    local = kept.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order)))
    best = local.filter(F.col("rank") <= mining.best).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint"))
    return best.filter(F.col("rank") <= mining.best).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
