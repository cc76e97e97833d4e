"""Operator 10: repeated lines and paragraphs.

Units are whole texts, paragraphs (between blank lines) and lines.  With
``inside_lines`` (the default) also short pieces of lines, so that a passage is found
inside a longer line: their borders depend on the words next to them only (the
end of a line or sentence, or a word whose hash says so), so a passage is cut
alike wherever it stands; such a unit is three pieces between borders, or as many more
as it takes to reach ``LEAST_WORDS`` words, and one starts at each piece.  Words
are normalised by lower-casing A-Z and dropping what separates them; in scripts
that put no blanks between words, each code point is a word.

Digests of units are grouped over all documents.  The document with the
smallest doc_id keeps a unit, at its first place.  Other places that touch are
merged, and removed where they have ``least_points`` code points or are the
whole text.  The result names the removed spans by code points of the original text.
With ``least_points`` 1 and ``every_line``, as registered, no repeated line stays
for its size; the defaults leave short lines that many texts share.

A passage inside a line keeps what stands before its first and after its last
border (half of these ends have four words or fewer).

Defined results: null and blank texts have no units; a line is a unit from
``LEAST_LINE_WORDS`` words or ``LEAST_LINE_POINTS`` code points on (with
``every_line`` from one word on), a paragraph or a whole text at any length; rows
that repeat a doc_id keep the same units, so an identical row changes nothing, and
other texts of that doc_id are told apart by ``text_hash``; rows without doc_id
keep all but their own repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hashing
from .shared import free_names, in_batches, staged

LEAST_WORDS, LEAST_LINE_WORDS, LEAST_LINE_POINTS = 8, 6, 16
#: Scripts without blanks between words: Thai, Lao, Myanmar, Khmer, kana, ideographs.
UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))
#: One word in so many ends a piece; so many pieces are a unit.
BORDER_EVERY, PIECES = 5, 3
OUT_ROWS = 256
#: Repeated spans of fewer code points (some twenty words) stay where they are not a whole text.
LEAST_POINTS = 100

_U = np.uint64
SPANS = "array<struct<start:int,end:int>>"


def _digests(hashes: np.ndarray, firsts: np.ndarray, stops: np.ndarray, salt: int) -> np.ndarray:
    """The digest of each run of words [first, stop)."""
    if not len(firsts):
        return np.empty(0, _U)
    sizes = stops - firsts
    at = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    terms = hashing.mixed(hashes[at + np.repeat(firsts, sizes)] + at.astype(_U) * _U(0x9E6C63D0876A9A47))
    return hashing.mixed(np.add.reduceat(terms, np.cumsum(sizes) - sizes) + sizes.astype(_U) + _U(salt))


def _words(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end byte of each word; code points of unspaced scripts are words of their own."""
    data = np.frombuffer(raw, np.uint8)
    heads = np.flatnonzero(data >= 0xE0)
    if not len(heads):
        return hashing.words(raw)
    four = data[heads] >= 0xF0
    parts = [(data[np.minimum(heads + k, len(data) - 1)] & 0x3F).astype(np.int64) for k in (1, 2, 3)]
    lead = data[heads].astype(np.int64)
    three = (lead & 0x0F) << 12 | parts[0] << 6 | parts[1]
    points = np.where(four, (lead & 0x07) << 18 | parts[0] << 12 | parts[1] << 6 | parts[2], three)
    alone = np.zeros(len(heads), bool)
    for low, high in UNSPACED:
        alone |= (points >= low) & (points <= high)
    if not alone.any():
        return hashing.words(raw)
    # a blank on either side; ``origin`` leads from the longer text back to the places in ``raw``
    places = np.concatenate([heads[alone], heads[alone] + 3 + four[alone]])
    origin = np.insert(np.arange(len(data)), places, 0)
    hashes, starts, ends = hashing.words(np.insert(data, places, 32).tobytes())
    return hashes, origin[starts], origin[ends - 1] + 1


def units(text: str | None, inside_lines: bool = True, every_line: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Digest, start and end (code points) of each unit."""
    raw = (text or "").encode("utf-8")
    hashes, starts, ends = _words(raw)
    n = len(hashes)
    if not n:
        return np.empty(0, _U), np.empty(0, np.int64), np.empty(0, np.int64)
    data = np.frombuffer(raw, np.uint8)
    lines = np.concatenate([[0], np.cumsum(data == 10)])
    ended = lines[starts[1:]] - lines[ends[:-1]]
    new_line, new_paragraph = np.ones(n, bool), np.ones(n, bool)  # after the word
    new_line[:-1], new_paragraph[:-1] = ended > 0, ended > 1
    border = new_line | (hashes % _U(BORDER_EVERY) == 0) | np.isin(data[ends - 1], (33, 46, 63))
    border[-1] = True
    stops = np.flatnonzero(border) + 1
    firsts = np.concatenate([[0], stops[:-1]])
    last = min(PIECES, len(stops)) - 1
    # the run from each piece on: three pieces, and further ones until it has the least number of words
    to = np.maximum(np.arange(len(firsts)) + last, np.searchsorted(stops, firsts + LEAST_WORDS))
    run_firsts, run_stops = firsts[to < len(stops)], stops[to[to < len(stops)]]
    line_stops = np.flatnonzero(new_line) + 1
    line_firsts = np.concatenate([[0], line_stops[:-1]])
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    line_points = points[ends[line_stops - 1]] - points[starts[line_firsts]]
    long_lines = (line_stops - line_firsts >= LEAST_LINE_WORDS) | (line_points >= LEAST_LINE_POINTS) | every_line
    parts = [(line_firsts[long_lines], line_stops[long_lines], 2), (np.array([0]), np.array([n]), 3)]
    paragraph_stops = np.flatnonzero(new_paragraph) + 1
    if len(paragraph_stops) > 1:
        parts.append((np.concatenate([[0], paragraph_stops[:-1]]), paragraph_stops, 4))
    if inside_lines:
        parts.append((run_firsts, run_stops, 1))
    digests = np.concatenate([_digests(hashes, a, b, salt) for a, b, salt in parts])
    return digests, np.concatenate([points[starts[a]] for a, _, _ in parts]), np.concatenate([points[ends[b - 1]] for _, b, _ in parts])


def document_units(docs: DataFrame, inside_lines: bool = True, every_line: bool = False) -> DataFrame:
    """(doc_id, text_hash, digests, starts, ends) of each text."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("digests", pa.list_(pa.int64())), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, OUT_ROWS):
                part = batch.slice(at, OUT_ROWS)
                made = [units(t.as_py(), inside_lines, every_line) for t in part.column(2)]
                columns = [pa.array([m[0].view(np.int64) for m in made], schema.field(2).type)]
                columns += [pa.array([m[k].astype(np.int32) for m in made], schema.field(k + 2).type) for k in (1, 2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], schema=schema)

    return in_batches(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text"), run, "doc_id long, text_hash long, digests array<long>, starts array<int>, ends array<int>")


def merged(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Overlapping or touching spans as one."""
    out: list[tuple[int, int]] = []
    for k in np.argsort(starts, kind="stable"):
        if out and starts[k] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], int(ends[k])))
        else:
            out.append((int(starts[k]), int(ends[k])))
    return out


def removed_spans(digests: np.ndarray, starts: np.ndarray, ends: np.ndarray, elsewhere: np.ndarray, least_points: int = LEAST_POINTS) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Which units go, and the spans: of those kept by another document, and later places of a unit, where they are long enough."""
    gone = np.ones(len(digests), bool)
    gone[np.unique(digests, return_index=True)[1]] = False
    gone |= np.isin(digests, elsewhere)
    if not gone.any():
        return gone, []
    whole = (int(starts.min()), int(ends.max()))
    spans = [x for x in merged(starts[gone], ends[gone]) if x[1] - x[0] >= least_points or x == whole]
    at = np.searchsorted([x[1] for x in spans], starts, side="right")
    inside = np.array([x[0] for x in spans] + [np.iinfo(np.int64).max])[at] <= starts
    return gone & inside, spans


def repeated_spans(docs: DataFrame, least_points: int = LEAST_POINTS, inside_lines: bool = True, every_line: bool = False) -> DataFrame:
    """(doc_id, text_hash, n_units, n_removed, removed_chars, spans, kept_in) of each row.

    The spans are what repeats earlier text; kept_in lists the documents that keep it.
    """
    made = staged(document_units(docs, inside_lines, every_line), "units")
    rows = made.filter("doc_id is not null").select("doc_id", F.explode(F.array_distinct("digests")).alias("digest"))
    owners = rows.groupBy("digest").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")).filter("owner <> last")
    owners = staged(owners.select("digest", "owner"), "unit-owners")  # about as many as repeated passages: always shuffled
    lost = rows.join(owners, "digest").filter("doc_id <> owner").groupBy(F.col("doc_id").alias("of_doc")).agg(F.collect_list(F.struct("digest", "owner")).alias("lost"))
    joined = made.join(lost, F.col("doc_id") == F.col("of_doc"), "left")
    joined = joined.select("doc_id", "text_hash", "digests", "starts", "ends", F.col("lost.digest").alias("elsewhere"), F.col("lost.owner").alias("owners"))
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_units", pa.int64()), ("n_removed", pa.int64()), ("removed_chars", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("kept_in", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, OUT_ROWS):
                out = []
                for doc_id, text_hash, *lists in zip(*batch.slice(at, OUT_ROWS).columns, strict=True):
                    digests, starts, ends, elsewhere, owned = (np.asarray(x.values) if x.is_valid else np.empty(0, np.int64) for x in lists)
                    gone, spans = removed_spans(digests, starts, ends, elsewhere, least_points)
                    kept_in = np.unique(owned[np.isin(elsewhere, digests[gone])]).tolist()
                    out.append((doc_id.as_py(), text_hash.as_py(), len(digests), int(gone.sum()), sum(b - a for a, b in spans), [{"start": a, "end": b} for a, b in spans], kept_in))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return in_batches(joined, run, f"doc_id long, text_hash long, n_units long, n_removed long, removed_chars long, spans {SPANS}, kept_in array<long>")


def cut(text: Column, spans: Column) -> Column:
    """``text`` without ``spans``."""
    start = F.struct(F.lit("").alias("kept"), F.lit(0).alias("at"))

    def add(held: Column, span: Column) -> Column:
        return F.struct(F.concat(held["kept"], F.substring(text, held["at"] + 1, span["start"] - held["at"])).alias("kept"), span["end"].alias("at"))

    return F.aggregate(spans, start, add, lambda held: F.concat(held["kept"], F.substring(text, held["at"] + 1, F.length(text))))


def deduplicated(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` with the removed spans cut out of the text that they were found in."""
    of_doc, of_text, removed = free_names(docs, "of_doc", "of_text", "removed")
    found = spans.filter("n_removed > 0").dropDuplicates(["doc_id", "text_hash"])
    found = found.select(F.col("doc_id").alias(of_doc), F.col("text_hash").alias(of_text), F.col("spans").alias(removed))
    same = F.col("doc_id").eqNullSafe(F.col(of_doc)) & (F.xxhash64("text") == F.col(of_text))
    text = F.when(F.col(removed).isNull(), F.col("text")).otherwise(cut(F.col("text"), F.col(removed)))
    return docs.join(found, same, "left").withColumn("text", text).select(*docs.columns)
