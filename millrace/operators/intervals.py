"""Zones and chunks as intervals of frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from .scan import block_of, running_sum

#: The place of a chunk without a suffix: behind all others.
LAST = (1 << 63) - 1


def parsed_zones(texts: DataFrame, key: str = "video") -> DataFrame:
    """(key, start, end_incl, crf) from zone texts; parts with other than three or four fields are left out."""
    body = F.when(F.col("text").startswith("Zones : "), F.substring("text", 9, 1 << 30)).otherwise("")
    parts = F.transform(F.split(body, ";"), lambda p: F.split(F.trim(p), ","))
    rows = texts.select(key, F.explode(F.filter(parts, lambda p: F.size(p).isin(3, 4))).alias("p"))
    return rows.select(key, F.col("p")[0].try_cast("bigint").alias("start"), F.col("p")[1].try_cast("bigint").alias("end_incl"), F.col("p")[2].try_cast("double").alias("crf"))


def shifted_zones(zones: DataFrame, offset: Column) -> DataFrame:
    """Zones moved back by ``offset``; those that end at 0 or before go, and starts stay at 0 or above."""
    moved = zones.withColumn("end_incl", F.col("end_incl") - offset).filter("end_incl > 0")
    return moved.withColumn("start", F.greatest(F.lit(0).cast("bigint"), F.col("start") - offset))


def _place(suffix: str = "suffix") -> Column:
    return F.coalesce(F.col(suffix).cast("bigint"), F.lit(LAST))


def chunk_offsets(chunks: DataFrame, key: str = "video") -> DataFrame:
    """Adds ``before``: the frames of all chunks in front; the one without a suffix comes last."""
    upto = running_sum(chunks, "before", F.col("frame_count"), [key], {"_block": block_of(_place())}, [_place()])
    return upto.withColumn("before", F.col("before") - F.coalesce("frame_count", F.lit(0)))


def merged_chunks(chunk_frames: DataFrame, key: str = "video") -> DataFrame:
    """Frames (key, suffix, frame) of all chunks in order, renumbered from 0 as ``merged``; blocks are parts of chunks."""
    blocks = {"_chunk": _place(), "_block": block_of(F.col("frame"))}
    numbered = running_sum(chunk_frames, "merged", F.lit(1), [key], blocks, ["frame"])
    return numbered.withColumn("merged", F.col("merged") - 1)


def chunk_totals(chunks: DataFrame, key: str = "video") -> DataFrame:
    """The frames of the numbered chunks."""
    return chunks.filter("suffix is not null").groupBy(key).agg(F.sum("frame_count").alias("total"))


def next_suffix(chunks: DataFrame, key: str = "video") -> DataFrame:
    """The number after the largest suffix; 1 without one."""
    return chunks.groupBy(key).agg((F.coalesce(F.max("suffix"), F.lit(0)) + 1).cast("bigint").alias("next"))


def last_group_start(keyframes: DataFrame, key: str = "video") -> DataFrame:
    return keyframes.groupBy(key).agg(F.max("frame").alias("last_gop"), F.count("*").alias("n_keyframes"))


def trimmed(frames: DataFrame, starts: DataFrame, key: str = "video") -> DataFrame:
    """The frames before the last group of pictures begins; ``starts`` is (key, last_gop)."""
    return frames.join(starts.select(key, "last_gop"), key).filter("frame < last_gop").drop("last_gop")


def resume_decisions(state: DataFrame) -> DataFrame:
    """Adds ``action`` and ``offset`` to (source_frames, encoded_frames, n_keyframes, last_gop, previous)."""
    enc, src = F.col("encoded_frames"), F.col("source_frames")
    action = F.when(enc > src, "error").when(enc == src, "done").when(F.col("n_keyframes") <= 1, "restart").otherwise("resume")
    offset = F.when(action == "resume", F.col("previous") + F.col("last_gop")).when(action == "restart", F.col("previous"))
    return state.withColumn("action", action).withColumn("offset", offset)


def skipped(frames: DataFrame, offset: Column) -> DataFrame:
    """The frames from ``offset`` on."""
    return frames.filter(F.col("frame") >= offset)


def paired_frames(source: DataFrame, encoded: DataFrame, key: str = "video") -> DataFrame:
    """Frames of ``source`` and ``encoded`` (key, frame, ...) side by side; a key whose numbers of frames differ ends the job with an error.

    All keys of either side are compared before a frame is paired.
    """
    left, right = (x.groupBy(key).agg(F.count("*").alias(n)) for x, n in ((source, "n_source"), (encoded, "n_encoded")))
    sizes = left.join(right, key, "full").select(key, *(F.coalesce(n, F.lit(0)).alias(n) for n in ("n_source", "n_encoded")))
    message = F.concat(F.lit("frames of "), F.col(key).cast("string"), F.lit(": "), F.col("n_source").cast("string"), F.lit(" and "), F.col("n_encoded").cast("string"))
    equal = sizes.filter(F.when(F.col("n_source") == F.col("n_encoded"), True).otherwise(F.raise_error(message).cast("boolean"))).select(key)
    return source.join(encoded, [key, "frame"]).join(equal, key)
