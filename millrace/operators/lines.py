"""Lines of texts that arrive in chunks, cut anywhere, also inside a character."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .scan import block_of, running_sum

#: One character for each byte, so bytes can be cut and joined as text.
_BYTES = "ISO-8859-1"
#: Neighbouring chunks that are put together in one place: 256 MB of chunks of a megabyte.
CHUNKS = 256


def _text(joined: Column) -> Column:
    return F.encode(joined, _BYTES).cast("string")


def lines_of_chunks(chunks: DataFrame, key: str = "key") -> DataFrame:
    """(key, line, value) from chunks (key, seq, chunk binary); lines are numbered from 0 and end at a newline or at the last chunk.

    Neighbouring chunks are put together to blocks first, which combines before the shuffle, so that what follows has a row for each block and
    line and not for each chunk.  The number of the line in which a block begins is a running sum of newlines.  The parts of a line that spans
    blocks are joined in order; such a line is one group.  A null chunk is empty, and nothing follows the last newline unless there is a byte.
    """
    # bytes are taken for text as they are, so that a block's are joined once; they are decoded block by block
    rows = chunks.select(F.col(key).alias("_of"), block_of(F.col("seq"), CHUNKS).alias("_block"), F.struct(F.col("seq").alias("_seq"), F.coalesce("chunk", F.lit(b"")).cast("string").alias("_bytes")).alias("_chunk"))
    in_order = F.transform(F.sort_array(F.collect_list("_chunk")), lambda c: c["_bytes"])
    blocks = rows.groupBy("_of", "_block").agg(F.array_join(in_order, "").alias("_bytes"))
    # a struct as the key: nulls in it are equal
    blocks = blocks.select("_of", "_block", F.split(F.decode(F.col("_bytes").cast("binary"), _BYTES), "\n").alias("_parts"))
    upto = running_sum(blocks.select("_of", "_block", (F.size("_parts") - 1).alias("_breaks")), "_upto", F.col("_breaks"), ["_of"], {"_far": block_of(F.col("_block"))}, ["_block"])
    firsts = upto.select(F.struct("_of", "_block").alias("_place"), (F.col("_upto") - F.col("_breaks")).alias("_first"))
    numbered = blocks.select(F.struct("_of", "_block").alias("_place"), "_parts").join(firsts, "_place")
    parts = numbered.select("_place.*", "_first", (F.size("_parts") - 1).alias("_in"), F.posexplode("_parts").alias("_at", "_part"))
    pieces = F.sort_array(F.collect_list(F.struct("_block", "_part")))
    joined = parts.groupBy("_of", (F.col("_first") + F.col("_at")).alias("line")).agg(F.array_join(F.transform(pieces, lambda p: p["_part"]), "").alias("_line"), F.max(F.col("_at") < F.col("_in")).alias("_ended"))
    return joined.filter("_ended or _line <> ''").select(F.col("_of").alias(key), F.col("line").cast("bigint").alias("line"), _text(F.col("_line")).alias("value"))


def lines_as_they_end(chunks: DataFrame, key: str = "key") -> DataFrame:
    """The same on a stream of chunks (key, seq, chunk, last): a line is given out when it ends, the rest is kept for the next chunk.

    Chunks of a key come in order of ``seq`` from batch to batch; within a batch they are sorted.  After the chunk that is
    ``last`` what is left is a line, and the key is forgotten.
    """

    def step(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        line, rest = state.get if state.exists else (0, b"")
        found, over = [], False
        for row in pd.concat(list(batches)).sort_values("seq").itertuples(index=False):
            *whole, rest = (bytes(rest) + bytes(row.chunk or b"")).split(b"\n")
            over = bool(row.last)
            for part in [*whole, rest] if over and rest else whole:
                found.append((name[0], line, part.decode("utf-8", "replace")))
                line += 1
        state.remove() if over else state.update((line, bytes(rest)))
        yield pd.DataFrame(found, columns=[key, "line", "value"])

    kind = dict(chunks.dtypes)[key]
    rows = chunks.select(key, "seq", "chunk", "last")
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, line bigint, value string", "line bigint, rest binary", "append", GroupStateTimeout.NoTimeout)
