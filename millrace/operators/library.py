"""The library of files: classes, listings, and files that belong to a video."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import already_encoded, basename, dirname, extension, is_hidden, is_media, natural_key, stem

#: Extensions of the files that go with a video.
SIDECAR_EXTENSIONS = ("nfo", "srt", "jpg", "png")


def file_class(path: Column, organisation: str, include_hidden: bool = True) -> Column:
    """``other``, ``already_encoded`` or ``new`` by the file's name."""
    name = basename(path)
    media = is_media(name) if include_hidden else is_media(name) & ~is_hidden(name)
    return F.when(~media, "other").when(already_encoded(name, organisation), "already_encoded").otherwise("new")


def scan_counts(files: DataFrame, jobs: DataFrame, organisation: str) -> DataFrame:
    """(added, skipped, already_encoded) of a scan of ``files`` (path) against live ``jobs`` (input_path), by ``root``."""
    rows = files.withColumn("class", file_class(F.col("path"), organisation)).filter(F.col("class") != "other")
    live = jobs.select(F.col("input_path").alias("live")).distinct()
    rows = rows.join(live, F.col("path") == F.col("live"), "left")
    new, known = F.col("class") == "new", F.col("live").isNotNull()
    return rows.groupBy("root").agg(F.count_if(new & ~known).alias("added"), F.count_if(new & known).alias("skipped"), F.count_if(~new).alias("already_encoded"))


def listing_key(name: Column, is_folder: Column) -> Column:
    """Sorts folders first, then names by the Unicode collation, so that accents count less than letters, with numbers by value."""
    return F.struct((~is_folder).alias("file"), F.collate(natural_key(name), "UNICODE").alias("name"), name.alias("exact"))


def sidecars(files: DataFrame, videos: DataFrame) -> DataFrame:
    """(video, path): files of a video's folder whose stem begins with the video's stem.

    A file's stem is cut at the lengths that the folder's videos have (no name is long), and joined on folder and beginning.
    """
    near = files.filter(F.lower(extension(F.col("path"))).isin(*SIDECAR_EXTENSIONS)).select("path", dirname(F.col("path")).alias("folder"), stem(F.col("path")).alias("stem"))
    films = videos.select(F.col("path").alias("video"), dirname(F.col("path")).alias("folder"), stem(F.col("path")).alias("begins"))
    sizes = films.select("folder", F.length("begins").alias("size")).distinct()
    cut = near.join(sizes, "folder").filter(F.length("stem") >= F.col("size")).withColumn("begins", F.expr("substring(stem, 1, size)"))
    return cut.join(films, ["folder", "begins"]).select("video", "path")
