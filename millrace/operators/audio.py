"""Streams of a file: the best video stream, audio titles, and lists joined by place."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def best_streams(streams: DataFrame, key: str, width: str, ties: Sequence[str]) -> DataFrame:
    """The widest stream of each file, the first of equals."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(width), *ties))
    return streams.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def with_kept_titles(streams: DataFrame, key: str = "file") -> DataFrame:
    """Adds ``keep_title``: a title stays if the stream has no language or shares it with another stream."""
    same = F.count("*").over(Window.partitionBy(key, F.coalesce(F.nullif("language", F.lit("")), F.lit("und"))))
    titled = F.coalesce(F.trim("title") != "", F.lit(False))
    unknown = F.coalesce(F.col("language") == "", F.lit(True))
    return streams.withColumn("keep_title", titled & (unknown | (same > 1)))


def joined_by_place(left: DataFrame, right: DataFrame, key: str, place: str, default: float) -> DataFrame:
    """Each row of ``left`` with ``value`` from the row of ``right`` at the same place of the same key, else ``default``."""
    found = left.join(right.select(key, place, "value"), [key, place], "left")
    return found.withColumn("value", F.coalesce("value", F.lit(default)))
