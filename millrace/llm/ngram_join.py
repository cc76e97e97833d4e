"""Operator 7: documents whose sets of word n-grams have a high Jaccard similarity.

Sets are grouped by size into bands, and each band is cut into tiles.  A tile
holds the sets of a band (and those of larger bands that are small enough to
link into it) that agree on one slice of the hash range.  A band has more
slices than the hashes by which two linked sets of it can differ, so linked
sets agree on a whole slice and meet in a tile.  A few more slices are cut
than needed, so that agreement on empty slices is not counted.  If two linked
sets agree on empty slices only, both have more empty ones than allowed for;
such sets, small ones mostly, meet on their smallest hashes too, of which
linked sets share one in the part that the threshold leaves for it.

In each tile all sets are first compared with the one that meets most others.
Members of a tile that this leaves in different components are compared with
each other, in blocks, so every pair that could link is looked at or joined
already.  A comparison bounds the overlap from above by the bits in which two
hashed bitmap signatures differ; what passes is decided by intersecting the
sorted hash arrays.

Equal sets are one node from the start (named by a 64-bit hash of the set), so
copies are never paired.  No group is held in one task: tiles are tables of
(tile, node) rows, and larger ones are compared block by block.

Defined results: null and blank texts have an empty set, which links with
nothing; a text with fewer words than the n-gram is one n-gram; repeated rows
and equal texts are one component; a row without doc_id links with nothing; an
empty table gives an empty result.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from functools import cache, reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing
from .components import components
from .shared import discard, in_batches, small_side, staged, stored

#: Sizes of the signature in 64-bit words, and of a block of a tile in rows.
SIGNATURE_WORDS, BLOCK_ROWS = 16, 2_048
#: A band's largest size is at most this times its smallest.
BAND_RATIO = 1.35
#: Below this mean number of empty slices none is allowed for.
EMPTY_SLICES_RISK = 1e-3
#: Rows with a signature up to this number are broadcast (about 40 MB).
BROADCAST_SIGNATURES = 150_000
OUT_ROWS = 256
#: The index of tiles is shuffled in so many parts, one after the other, if each then has ``PART_TILES`` rows or more; disk holds one part at a time.
PARTS, PART_TILES = 4, 4_000_000
#: A text is shorter than this.
MOST_BYTES = 1 << 31

_U = np.uint64


class Band(NamedTuple):
    least: int
    most: int
    slices: int
    allowed_empty: int


class Similarity(NamedTuple):
    """Sets of ``words``-grams link when 100 * intersection >= ``percent`` * union."""

    words: int
    percent: int


def _slices(least: int, apart: int) -> tuple[int, int]:
    """Slices for sets of ``least`` members or more that differ in ``apart`` hashes at most, and how many may be empty.

    So many may be empty as 3.3 standard deviations above the mean; about one set in a thousand has more.
    """
    allowed = 0
    for _ in range(40):
        slices = apart + 1 + allowed
        mean = slices * (1 - 1 / slices) ** least
        needed = math.ceil(mean + 3.3 * math.sqrt(mean)) if mean > EMPTY_SLICES_RISK else 0
        if needed <= allowed:
            return slices, allowed
        allowed = needed
    return apart + 1, 0  # small sets leave slices empty however many there are


@cache
def bands(percent: int) -> list[Band]:
    """The bands of set sizes; one slice stands for a band in which only equal sets link."""
    if not 1 <= percent <= 100:
        raise ValueError(f"a similarity of {percent} per cent")
    made, least = [], 1
    while least <= MOST_BYTES:  # no set has more members than its text has bytes
        most = max(least, int(least * BAND_RATIO))
        partner = most * 100 // percent  # the largest set that links with one of this band
        apart = (most + partner) * (100 - percent) // (100 + percent)  # hashes in one of two linked sets only
        slices, allowed = _slices(least, apart) if apart else (1, 0)
        made.append(Band(least, most, slices, allowed))
        least = most + 1
    return made


@cache
def _starts(percent: int) -> list[int]:
    return [b.least for b in bands(percent)]


def bands_of(n: int, percent: int) -> list[int]:
    """The band of a size, and those below that hold a size with which this one can link."""
    least = -(-n * percent // 100)
    own = bisect_right(_starts(percent), n) - 1
    return list(range(bisect_right(_starts(percent), least) - 1, own + 1))[::-1]


def tiles(members: np.ndarray, percent: int) -> list[int]:
    """The tiles of a sorted array of hashes, as signed 64-bit names."""
    out: list[int] = []
    sums = np.concatenate([np.zeros(1, _U), np.cumsum(hashing.mixed(members ^ _U(0x5851F42D4C957F2D)))])
    for index in bands_of(len(members), percent):
        band = bands(percent)[index]
        if band.slices == 1:
            continue
        slice_of = ((members >> _U(32)) * _U(band.slices)) >> _U(32)
        edges = np.searchsorted(slice_of, np.arange(band.slices + 1, dtype=_U))
        names = hashing.mixed(sums[edges[1:]] - sums[edges[:-1]] + np.arange(1, band.slices + 1, dtype=_U) * _U(0x9FB21C651E98DF25) + _U((index + 1) * 0xC13FA9A902A6328F & 0xFFFFFFFFFFFFFFFF))
        empty = edges[1:] == edges[:-1]
        out += names[~empty].view(np.int64).tolist()
        if int(empty.sum()) > band.allowed_empty:
            prefix = members[: len(members) - -(-len(members) * percent // 100) + 1]
            out += hashing.mixed(prefix + _U((index + 1) * 0xD1342543DE82EF95 & 0xFFFFFFFFFFFFFFFF)).view(np.int64).tolist()
    return out


def signature(members: np.ndarray) -> bytes:
    """A bitmap in which a bit is set if an odd number of members hash to it: two differ in no more bits than the sets in members."""
    bits = 64 * SIGNATURE_WORDS
    odd = np.bincount((hashing.mixed(members) % _U(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def node_of(members: np.ndarray) -> int:
    """The name of a set."""
    return int(hashing.mixed(np.array([hashing.mixed(members).sum(dtype=_U) + _U(len(members))], dtype=_U)).view(np.int64)[0])


def members_of(text: str | None, words: int) -> np.ndarray:
    return hashing.shingles(hashing.words((text or "").encode("utf-8"))[0], words)


def sketches(docs: DataFrame, how: Similarity) -> DataFrame:
    """(doc_id, text_hash, n, node, sig, tiles) of each text; node, sig and tiles are null for an empty set or without a doc_id."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("sig", pa.binary()), ("tiles", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, OUT_ROWS):
                part = batch.slice(at, OUT_ROWS)
                rows = []
                for doc_id, text in zip(part.column(0), part.column(2), strict=True):
                    m = members_of(text.as_py(), how.words)
                    linkable = len(m) and doc_id.is_valid
                    rows.append((len(m), node_of(m), signature(m), tiles(m, how.percent)) if linkable else (len(m), None, None, None))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), list(schema)[2:], strict=True))], schema=schema)

    return in_batches(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text"), run, "doc_id long, text_hash long, n long, node long, sig binary, tiles array<long>")


def _signatures(column: pa.Array) -> np.ndarray:
    """A matrix of 64-bit words from a column of signatures."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=_U).reshape(-1, SIGNATURE_WORDS)


def may_link(n_a: np.ndarray, n_b: np.ndarray, apart: np.ndarray, percent: int) -> np.ndarray:
    """Whether an overlap of at most half of what ``apart`` differing bits leave could link sets of these sizes."""
    overlap = (n_a + n_b - apart) // 2
    return (100 + percent) * np.minimum(overlap, np.minimum(n_a, n_b)) >= percent * (n_a + n_b)


def bounded(pairs: DataFrame, info: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose signatures leave a link possible."""
    side = small_side(info.select("node", "n", "sig"), BROADCAST_SIGNATURES)
    rows = pairs.select("a", "b")
    for name in "ab":
        rows = rows.join(side.select(F.col("node").alias(name), F.col("n").alias(f"n_{name}"), F.col("sig").alias(f"sig_{name}")), name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            column = lambda name: batch.column(batch.schema.get_field_index(name))
            apart = np.bitwise_count(_signatures(column("sig_a")) ^ _signatures(column("sig_b"))).sum(axis=1, dtype=np.int64)
            keep = may_link(column("n_a").to_numpy(), column("n_b").to_numpy(), apart, percent)
            yield pa.RecordBatch.from_arrays([column("a").filter(pa.array(keep)), column("b").filter(pa.array(keep))], names=["a", "b"])

    return in_batches(rows, run, "a long, b long")


def exact_links(pairs: DataFrame, docs: DataFrame, info: DataFrame, how: Similarity) -> DataFrame:
    """The pairs that link, by intersecting the sorted arrays of their members."""
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = small_side(staged(info.select("node", F.col("doc_id").alias("of_doc")).join(nodes, "node", "left_semi"), "pair-nodes"))
    texts = docs.select("doc_id", "text").join(wanted, F.col("doc_id") == F.col("of_doc")).select("node", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, OUT_ROWS):
                rows = []
                for node, text in zip(*(c.to_pylist() for c in batch.slice(at, OUT_ROWS).columns), strict=True):
                    m = members_of(text, how.words)
                    if len(m) and node_of(m) == node:  # a doc_id may stand for several texts
                        rows.append((node, m.tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["node", "members"])

    held, path = stored(in_batches(texts, sets, "node long, members binary").dropDuplicates(["node"]), "sets")
    rows = pairs
    for name in "ab":
        rows = rows.join(held.select(F.col("node").alias(name), F.col("members").alias(f"set_{name}")), name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, set_a, set_b = (batch.column(batch.schema.get_field_index(c)) for c in ("a", "b", "set_a", "set_b"))
            keep = []
            for x, y in zip(set_a, set_b, strict=True):
                x, y = np.frombuffer(x.as_py(), _U), np.frombuffer(y.as_py(), _U)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= how.percent * (len(x) + len(y) - common))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], names=["a", "b"])

    links = staged(in_batches(rows.select("a", "b", "set_a", "set_b"), run, "a long, b long"), "links")
    discard(docs.sparkSession, path)
    return links


def _block_pairs(rows: list[dict], percent: int, first: int, second: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of one block with another (or itself) that are in different components and may link."""
    left = [r for r in rows if r["block"] == first]
    right = left if first == second else [r for r in rows if r["block"] == second]
    take = lambda name, side: np.array([r[name] for r in side], dtype=np.int64)
    sigs = np.frombuffer(b"".join(r["sig"] for r in right), _U).reshape(-1, SIGNATURE_WORDS)
    node, component, n = take("node", right), take("component", right), take("n", right)
    found_a, found_b = [], []
    for i, r in enumerate(left):
        rest = np.arange(i + 1 if first == second else 0, len(right))
        rest = rest[component[rest] != r["component"]]
        if not len(rest):
            continue
        apart = np.bitwise_count(sigs[rest] ^ np.frombuffer(r["sig"], _U)).sum(axis=1, dtype=np.int64)
        rest = rest[may_link(n[rest], np.int64(r["n"]), apart, percent)]
        found_a += [r["node"]] * len(rest)
        found_b += node[rest].tolist()
    return np.array(found_a, dtype=np.int64), np.array(found_b, dtype=np.int64)


def block_candidates(members: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that share a tile and may link; ``members`` (tile, size, node, component, n, sig)."""
    blocks = F.greatest(F.lit(1), F.ceil(F.col("size") / BLOCK_ROWS)).cast("int")
    placed = members.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node", F.lit("block")), F.col("blocks")).cast("int"))
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    key = ["tile", "first", "second"]
    met = met.withColumn("first", F.least("block", "other")).withColumn("second", F.greatest("block", "other"))
    met = met.select(*key, "block", "node", "component", "n", "sig").repartition(*key).sortWithinPartitions(*key)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, name = [], None
        for batch in batches:
            for r in batch.to_pylist():
                if (now := (r["tile"], r["first"], r["second"])) != name:
                    if len(held) > 1:
                        yield _pair_batch(*_block_pairs(held, percent, *name[1:]))
                    held, name = [], now
                held.append(r)
        if len(held) > 1:
            yield _pair_batch(*_block_pairs(held, percent, *name[1:]))

    pairs = in_batches(met, run, "a long, b long")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _pair_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def tile_members(made: DataFrame) -> DataFrame:
    """(tile, node) of the tiles that several nodes share; ``made`` (node, tiles)."""
    rows = made.filter("node is not null").select(F.explode("tiles").alias("tile"), "node")
    parts = min(PARTS, max(1, (made.agg(F.sum(F.size("tiles").cast("bigint"))).first()[0] or 0) // PART_TILES))
    found = []
    for part in range(parts):
        own = rows.filter(F.pmod(F.col("tile"), F.lit(parts)) == part) if parts > 1 else rows
        shared = own.groupBy("tile").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low <> high")
        shared, path = stored(shared.select("tile"), "shared-tiles")
        found.append(staged(own.join(small_side(shared), "tile").distinct(), "tile-members"))
        discard(made.sparkSession, path)
    return reduce(DataFrame.union, found)


def node_links(docs: DataFrame, made: DataFrame, members: DataFrame, how: Similarity) -> DataFrame:
    """Links (a, b) between nodes that give every component of the full similarity join; ``made`` (doc_id, n, node, sig), ``members`` of tiles."""
    sizes = staged(members.groupBy("tile").agg(F.count("*").alias("size")), "tile-sizes")
    sized = members.join(small_side(sizes), "tile")
    met = small_side(staged(sized.groupBy("node").agg(F.sum("size").alias("met")), "nodes-met"))
    heads = members.join(met, "node").groupBy("tile").agg(F.max(F.struct("met", "node"))["node"].alias("head"))
    heads = small_side(staged(heads, "tile-heads"))
    first = members.join(heads, "tile").filter("node <> head")
    first = staged(first.select(F.least("node", "head").alias("a"), F.greatest("node", "head").alias("b")).distinct(), "pairs")

    nodes = small_side(staged(members.select("node").distinct(), "nodes"))
    info = made.select("node", "n", "sig", "doc_id").join(nodes, "node", "left_semi")
    info = staged(info.groupBy("node").agg(F.first("n").alias("n"), F.first("sig").alias("sig"), F.min("doc_id").alias("doc_id")), "node-info")
    links = exact_links(staged(bounded(first, info, how.percent), "pairs"), docs, info, how)

    grouped = small_side(staged(components(links), "components").withColumnRenamed("node", "of_node"))
    labelled = sized.join(grouped, F.col("node") == F.col("of_node"), "left").select("tile", "size", "node", F.coalesce("component", "node").alias("component"))
    labelled = staged(labelled, "labelled")
    open_tiles = labelled.groupBy("tile").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high and low is not null")
    open_tiles = small_side(staged(open_tiles.select("tile"), "open-tiles"))
    rest = labelled.join(open_tiles, "tile", "left_semi").join(small_side(info.select("node", "n", "sig"), BROADCAST_SIGNATURES), "node")
    second = staged(block_candidates(rest, how.percent), "pairs")
    return links.union(exact_links(second, docs, info, how))


def memberships(docs: DataFrame, how: Similarity) -> DataFrame:
    """(doc_id, text_hash, n, component) of each row of ``docs`` (doc_id, text), stored; component is null for what links with nothing."""
    docs = docs.select("doc_id", "text")
    sketched, path = stored(sketches(docs, how), "sketches")
    members = tile_members(sketched)
    made = staged(sketched.drop("tiles"), "signatures")  # the tiles, most of the table, are not read again
    discard(docs.sparkSession, path)
    groups = small_side(staged(components(node_links(docs, made, members, how)), "components").withColumnRenamed("node", "of_node"))
    rows = made.select("doc_id", "text_hash", "n", "node").join(groups, F.col("node") == F.col("of_node"), "left")
    return staged(rows.select("doc_id", "text_hash", "n", F.coalesce("component", "node").alias("component")), "memberships")


def near_duplicates(docs: DataFrame, how: Similarity) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of ``docs`` (doc_id, text)."""
    rows = memberships(docs, how)
    several = rows.filter("component is not null").groupBy("component").agg(F.min("doc_id").alias("least"), F.count("*").alias("size"))
    several = small_side(staged(several.filter("size > 1").select(F.col("component").alias("of_component"), "least"), "component-ids"))
    rows = rows.join(several, F.col("component") == F.col("of_component"), "left")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def repeated_texts(docs: DataFrame, how: Similarity) -> DataFrame:
    """(doc_id, text_hash) of the texts to drop, so that one text of each component stays: of the smallest doc_id, the one of the smallest hash."""
    rows = memberships(docs, how).filter("component is not null").select("component", F.struct("doc_id", "text_hash").alias("text"))
    several = rows.groupBy("component").agg(F.min("text").alias("first"), F.max("text").alias("last")).filter("first <> last")
    several = small_side(staged(several.select(F.col("component").alias("of_component"), "first"), "component-firsts"))
    return rows.join(several, (F.col("component") == F.col("of_component")) & (F.col("text") != F.col("first"))).select("text.*").distinct()
