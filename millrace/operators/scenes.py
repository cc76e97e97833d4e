"""Frames to scenes to rate-control zones.

A frame table has a key (the video), a 0-based ``frame``, ``is_key`` and a
``score``.  Scenes begin at key frames; frame 0 always begins one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numbers import clamped_score, crf_adjustment
from .scan import block_of, exclusive_percentile, running_sum

#: Every so many frames one is scored.
SAMPLE_STEP = 3


def keyframes(frames: DataFrame, key: str = "video") -> DataFrame:
    return frames.filter("is_key").select(key, "frame")


def with_scenes(frames: DataFrame, key: str = "video") -> DataFrame:
    """Adds ``scene``, numbered from 0: a running count of key frames, no join with the frames; a long video is in many tasks."""
    starts = F.col("is_key") | (F.col("frame") == 0)
    numbered = running_sum(frames, "scene", starts.cast("bigint"), [key], {"_block": block_of(F.col("frame"))}, ["frame"])
    return numbered.withColumn("scene", F.col("scene") - 1)


def scene_bounds(frames: DataFrame, key: str = "video") -> DataFrame:
    """(key, scene, start, stop): scenes as half-open ranges; the last stops at the number of frames."""
    starts = with_scenes(frames, key).groupBy(key, "scene").agg(F.min("frame").alias("start"), F.max("frame").alias("last"))
    following = F.lead("start").over(Window.partitionBy(key).orderBy("scene"))
    return starts.select(key, "scene", "start", F.coalesce(following, F.col("last") + 1).alias("stop"))


def scene_range_join(frames: DataFrame, bounds: DataFrame, key: str = "video", bucket: int = 64) -> DataFrame:
    """Frames with the scene whose range holds them: an equi join on buckets of the range, then the range."""
    spread = bounds.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor((F.col("stop") - 1) / bucket))))
    placed = frames.withColumn("bucket", F.floor(F.col("frame") / bucket))
    held = placed.join(spread, [key, "bucket"])
    return held.filter((F.col("frame") >= F.col("start")) & (F.col("frame") < F.col("stop"))).drop("bucket")


def score_stats(frames: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, mean, p15, least) of scores clamped at 0; p15 is the 15th percentile by the exclusive method.

    No key has its scores in one place.
    """
    clamped = frames.select(*keys, clamped_score(F.col("score")).alias("_score"))
    p15 = exclusive_percentile(clamped, keys, "_score", 15, "p15").withColumnsRenamed({k: f"_of_{k}" for k in keys})
    rest = clamped.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("_score").alias("mean"), F.min("_score").alias("least"))
    same = F.struct(*(F.col(k).alias(k) for k in keys)) == F.struct(*(F.col(f"_of_{k}").alias(k) for k in keys))
    return rest.join(p15, same).select(*keys, "n", "mean", "p15", "least")


def scene_stats(frames: DataFrame, key: str = "video") -> DataFrame:
    """(key, scene, n, mean, p15, least)."""
    return score_stats(with_scenes(frames, key), [key, "scene"])


def metrics(frames: DataFrame, key: str = "video") -> DataFrame:
    """(key, mean, p15, least) of all frames of a video."""
    return score_stats(frames, [key]).drop("n")


def high_resolution(width: Column, height: Column) -> Column:
    """More pixels than 1920 by 1080."""
    return width.cast("bigint") * height > 1920 * 1080


def worst_frames(frames: DataFrame, key: str = "video") -> DataFrame:
    """The frame with the least score, the first of equals."""
    return frames.groupBy(key).agg(F.min(F.struct("score", "frame")).alias("worst")).select(key, F.col("worst.frame").alias("frame"), F.col("worst.score").alias("score"))


def means_in_order(frames: DataFrame, key: str = "video") -> DataFrame:
    """(key, overall): the mean of the clamped scores of a video, added up frame by frame.

    A sum of doubles depends on its order, and a CRF is cut at quarters, so a mean that differs in its last digit moves zones whose
    scores lie on a quarter.  The order of the frames is the one that does not depend on how rows are dealt out.
    """
    along = Window.partitionBy(key).orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    summed = frames.select(key, "frame", F.sum(clamped_score(F.col("score"))).over(along).alias("_sum"))
    return summed.groupBy(key).agg((F.max_by("_sum", "frame") / F.count("*")).alias("overall"))


def scenes_against_mean(frames: DataFrame, key: str = "video") -> DataFrame:
    """(key, scene, start, last, p15, overall): each scene's percentile next to the mean of all frames of its video."""
    placed = with_scenes(frames, key).withColumn("_score", clamped_score(F.col("score")))
    ranges = placed.groupBy(key, "scene").agg(F.min("frame").alias("start"), F.max("frame").alias("last"))
    p15 = exclusive_percentile(placed, [key, "scene"], "_score", 15, "p15").withColumnsRenamed({key: "_of", "scene": "_scene"})
    overall = means_in_order(frames, key).withColumnRenamed(key, "_whole")
    joined = ranges.join(p15, F.col(key).eqNullSafe(F.col("_of")) & (F.col("scene") == F.col("_scene")))
    return joined.join(overall, F.col(key).eqNullSafe(F.col("_whole"))).select(key, "scene", "start", "last", "p15", "overall")


def crf_zones(frames: DataFrame, base: float, strength: float = 20.0, limit: float = 5.0, key: str = "video") -> DataFrame:
    """(key, start, end_incl, crf): a scene whose low scores lie below the mean gets a lower CRF."""
    scenes = scenes_against_mean(frames, key)
    adjustment = crf_adjustment(F.col("p15"), F.col("overall"), strength, limit)
    return scenes.select(key, "start", F.col("last").alias("end_incl"), (F.lit(base) - adjustment).alias("crf"))


def systematic_sample(frames: DataFrame, step: int = SAMPLE_STEP) -> DataFrame:
    return frames.filter(F.col("frame") % step == 0)


def upsampled(samples: DataFrame, lengths: DataFrame, step: int = SAMPLE_STEP, key: str = "video") -> DataFrame:
    """Each sample held for ``step`` frames, cut at the video's length; ``lengths`` is (key, nframe)."""
    held = samples.join(lengths, key).withColumn("frame", F.explode(F.sequence("frame", F.least(F.col("frame") + step, F.col("nframe")) - 1)))
    return held.drop("nframe")


def zones_text(zones: DataFrame, key: str = "video") -> DataFrame:
    """(key, text): ``Zones : start,end,crf;...`` in order."""
    zone = F.concat_ws(",", F.col("start").cast("string"), F.col("end_incl").cast("string"), F.col("crf").cast("string"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("start", zone.alias("zone")))), lambda z: z["zone"])
    return zones.groupBy(key).agg(F.concat(F.lit("Zones : "), F.array_join(listed, ";"), F.lit(";")).alias("text"))
