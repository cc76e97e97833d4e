"""The sequential throttle as joins: an event passes if the last one that passed is some time ago."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..stored import stored

#: Least distances that make a block of time, in which the events of a key are in one task.
BLOCK_DISTANCES = 1_000


def successors(events: DataFrame, keys: Sequence[str], at: str, tie: str, least: int, block: int | None = None) -> DataFrame:
    """(_key, id, next) of each event: the first one of its key, by ``at`` and ``tie``, that is ``least`` or more later; null if none is.

    Events and the moments from which a successor is sought are merged in order of time, block by block; where a block has
    no event after the moment, it is the first event of the next block that has one.
    """
    width = block or least * BLOCK_DISTANCES
    rows = events.select(F.struct(*keys).alias("_key"), F.col(at).cast("bigint").alias("t"), F.col(tie).alias("id"))
    own = rows.select("_key", "t", "id", F.lit(True).alias("is_event"))
    merged = own.union(rows.select("_key", F.col("t") + least, "id", F.lit(False))).withColumn("_block", F.floor(F.col("t") / width))
    event = F.when(F.col("is_event"), F.struct("t", "id"))
    firsts = merged.groupBy("_key", "_block").agg(F.min(event).alias("first"))
    later = Window.partitionBy("_key").orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    firsts = firsts.select("_key", "_block", F.last("first", ignorenulls=True).over(later)["id"].alias("after_block"))
    back = Window.partitionBy("_key", "_block").orderBy(F.desc("t"), F.desc("is_event"), F.desc("id")).rowsBetween(Window.unboundedPreceding, 0)
    inside = merged.withColumn("within_block", F.last(event, ignorenulls=True).over(back)["id"]).filter("not is_event")
    return inside.join(firsts, ["_key", "_block"]).select("_key", "id", F.coalesce("within_block", "after_block").alias("next"))


def throttled(events: DataFrame, keys: Sequence[str], at: str, tie: str, least: int, block: int | None = None) -> DataFrame:
    """The rows of ``events`` that pass, for each of ``keys`` in order of ``at`` and ``tie`` (unique within a key).

    The first passes, and after one that passes its successor.  The chain of successors is followed by doubling: after k rounds the first 2^k
    events of each chain are known, and each event's pointer leads 2^k successors on, so a chain of a million takes 20 rounds.
    """
    jump = stored(successors(events, keys, at, tie, least, block).filter("next is not null"), "successors")
    first = events.groupBy(F.struct(*keys).alias("_key")).agg(F.min(F.struct(F.col(at), F.col(tie)))[tie].alias("id"))
    passed = stored(first, "passed")
    while True:
        fresh = stored(passed.join(jump, ["_key", "id"]).select("_key", F.col("next").alias("id")), "passed-next")
        if fresh.isEmpty():
            break
        passed = stored(passed.union(fresh), "passed")
        onward = jump.select("_key", F.col("id").alias("next"), F.col("next").alias("far"))
        jump = stored(jump.join(onward, ["_key", "next"]).select("_key", "id", F.col("far").alias("next")), "successors")
    chosen = passed.withColumnsRenamed({"_key": "_of", "id": "_id"})
    return events.join(chosen, (F.struct(*keys) == F.col("_of")) & (F.col(tie) == F.col("_id")), "left_semi")
