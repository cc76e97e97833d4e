"""The stability gate in batch (streaming.polling has it on streams): a file is ready after its size was the same, and not 0, for some polls in a row."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

POLL_SECONDS, COOLDOWN_SECONDS = 10, 30


def polls_needed(cooldown: float = COOLDOWN_SECONDS, poll: float = POLL_SECONDS) -> int:
    return math.ceil(cooldown / poll)


def stable_counts(polls: DataFrame) -> DataFrame:
    """(path, poll, size, stable): for how many polls the size has been as it is. The batch twin of the gate."""
    by_path = Window.partitionBy("path").orderBy("poll")
    fresh = F.when(F.col("size") == F.lag("size").over(by_path), 0).otherwise(1)
    runs = polls.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(by_path))
    place = F.row_number().over(Window.partitionBy("path", "run").orderBy("poll"))
    return runs.select("path", "poll", "size", (place - 1).cast("bigint").alias("stable"))


def ready_files(polls: DataFrame, needed: int) -> DataFrame:
    """(path, poll, size): the first poll at which each file is ready, in batch; null sizes are files that vanished."""
    runs = stable_counts(polls.withColumn("size", F.coalesce("size", F.lit(-1))))
    return runs.filter((F.col("stable") >= needed) & (F.col("size") > 0)).groupBy("path").agg(F.min(F.struct("poll", "size")).alias("first")).select("path", "first.*")
