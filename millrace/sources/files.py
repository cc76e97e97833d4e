"""File listings and text formats of the pipeline, as DataFrames."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import basename, dirname, is_hidden, is_media

_LISTING = T.StructType([T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()), T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])
#: Fixed value: lines of a scene file behind the key frames: frames, width, height, and the two parts of the frame rate.
SCENE_TRAILER = 5


def _named(rows: DataFrame) -> DataFrame:
    return rows.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), basename(F.col("path")).alias("name"), dirname(F.col("path")).alias("folder"))


def listing(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """(path, size, modified, name, folder) of the files; contents are never read."""
    return _named(spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(folder))


def media_files(spark: SparkSession, folder: str, include_hidden: bool = True) -> DataFrame:
    rows = listing(spark, folder).filter(is_media(F.col("name")))
    return rows if include_hidden else rows.filter(~is_hidden(F.col("name")))


def arriving_files(spark: SparkSession, folder: str) -> DataFrame:
    """The listing as a stream: each file once, in the micro-batch that finds it."""
    return _named(spark.readStream.format("binaryFile").schema(_LISTING).option("recursiveFileLookup", True).load(folder))


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of progress events as they arrive, parsed; bad lines are kept in ``event._corrupt``."""
    from ..operators.events import parsed_lines

    return parsed_lines(spark.readStream.text(folder))


def metric_log(spark: SparkSession, path: str) -> DataFrame:
    """(frame, y, u, v) from lines ``frame: y u v`` or ``frame: score``; a line that is neither ends the read with an error."""
    number = r"(-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)"
    pattern = rf"^\s*([0-9]+): {number}(?: {number} {number})?\s*$"
    part = lambda i: F.nullif(F.regexp_extract("value", pattern, i), F.lit("")).try_cast("double")
    lines = spark.read.text(path).filter("value <> ''")
    frame = F.when(F.col("value").rlike(pattern), F.regexp_extract("value", pattern, 1).try_cast("bigint")).otherwise(F.raise_error(F.concat(F.lit("not a metric line: "), "value")).cast("bigint"))
    return lines.select(frame.alias("frame"), part(2).alias("y"), part(3).alias("u"), part(4).alias("v"))


def write_metric_log(scores: DataFrame, path: str) -> None:
    """``frame: y u v`` lines in order of the frames."""
    number = lambda c: F.format_string("%.6f", c)
    ordered = scores.repartitionByRange("frame").sortWithinPartitions("frame")
    ordered.select(F.concat_ws(" ", F.concat(F.col("frame").cast("string"), F.lit(":")), number("y"), number("u"), number("v"))).write.text(path)


def zone_texts(spark: SparkSession, path: str) -> DataFrame:
    """(video, text): each file of zones whole, by its path."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("video"), F.col("value").alias("text"))


def write_zone_texts(texts: DataFrame, path: str, key: str = "video") -> None:
    """A folder for each key with its zones; keys without zones have none."""
    texts.select(key, F.col("text").alias("value")).write.partitionBy(key).text(path)


def write_events(rows: DataFrame, path: str) -> None:
    """Each row as a line of JSON."""
    rows.select(F.to_json(F.struct(*rows.columns))).write.text(path)


def scene_file(spark: SparkSession, path: str) -> DataFrame:
    """One row for each file: high_resolution, keyframes, nframe, width, height, fps_num, fps_den."""
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.filter(F.split("value", "\n"), lambda x: x != "").alias("l"))
    n = F.size("l")
    end = lambda k: F.get("l", n - SCENE_TRAILER + k).try_cast("int")
    keys = F.transform(F.slice("l", F.lit(2), F.greatest(F.lit(0), n - SCENE_TRAILER - 1)), lambda x: x.try_cast("bigint"))
    names = ("nframe", "width", "height", "fps_num", "fps_den")
    return lines.select("file", (F.lower(F.get("l", F.lit(0))) == "true").alias("high_resolution"), keys.alias("keyframes"), *(end(k).alias(c) for k, c in enumerate(names)))


def path_listing(spark: SparkSession, path: str) -> DataFrame:
    """The listing of a folder, or of the one file that ``path`` names; a path that is missing gives no rows."""
    try:
        return listing(spark, path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return _named(spark.createDataFrame([], _LISTING))


def path_counts(spark: SparkSession, path: str, live: DataFrame, organisation: str) -> DataFrame:
    """One row (added, skipped, already_encoded) of the media below a folder, or of one file; zeros if the path is missing or holds none.

    ``live`` has the paths of jobs that are waiting or running (input_path), as full URIs.
    """
    from ..operators.library import scan_counts

    counts = scan_counts(path_listing(spark, path).select("path", F.lit(path).alias("root")), live, organisation)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return counts.agg(total("added"), total("skipped"), total("already_encoded"))


def write_offset_zones(zones: DataFrame, offset: int, path: str, key: str = "video") -> None:
    """The zones behind ``offset`` as texts; a key of which nothing is left has no file."""
    from ..operators.intervals import shifted_zones
    from ..operators.scenes import zones_text

    write_zone_texts(zones_text(shifted_zones(zones, F.lit(offset)), key), path, key)


def write_scene_files(scenes: DataFrame, path: str, key: str = "video") -> None:
    """A text for each row, as ``scene_file`` reads them: flag, key frames, and the trailer, each on a line."""
    trailer = [F.col(c).cast("string") for c in ("nframe", "width", "height", "fps_num", "fps_den")]
    flag = F.when(F.col("high_resolution"), "True").otherwise("False")
    lines = F.concat(F.array(flag), F.transform("keyframes", lambda k: k.cast("string")), F.array(*trailer))
    scenes.select(key, F.array_join(lines, "\n").alias("value")).write.partitionBy(key).text(path)


def tag_document(tags: Column) -> Column:
    """The XML document of a map of tags, in order of their names, with values escaped."""
    from ..functions.text import xml_escaped

    simple = lambda name: F.concat(F.lit("    <Simple>\n      <Name>"), xml_escaped(name), F.lit("</Name>\n      <String>"), xml_escaped(F.element_at(tags, name)), F.lit("</String>\n    </Simple>\n"))
    body = F.array_join(F.transform(F.array_sort(F.map_keys(tags)), simple), "")
    return F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<Tags>\n  <Tag>\n'), body, F.lit("  </Tag>\n</Tags>\n"))
