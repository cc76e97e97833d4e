"""Helpers that several operators of this subpackage use."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows up to which a table of two longs may be broadcast (24 MB at most); it is counted before it is sent.
BROADCAST_ROWS = 1_000_000
#: Rows and bytes of an Arrow batch of texts.
TEXT_ROWS, TEXT_BATCH_BYTES = 1_000, 4 << 20
_ARROW = "spark.sql.execution.arrow."
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Where a session on one machine names none (tests), a folder of this process is set; on a cluster that is an error.
    """
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if known is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        known = tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.checkpoint.dir", known)
        spark.sparkContext.setCheckpointDir(known)
    return known.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def full_uri(spark: SparkSession, path: str) -> str:
    """``path`` as Spark names it: without a scheme it is on Spark's default file system, which need not be a local one."""
    marker = f"{path}/marker"
    spark.range(1).coalesce(1).write.mode("overwrite").parquet(marker)
    return spark.read.parquet(marker).inputFiles()[0].split("/marker/")[0]


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI, as the executors reach it; a path without a scheme is a local one (``full_uri`` gives one)."""
    return fs.FileSystem.from_uri(path) if re.match(r"\w+:", path) else (fs.LocalFileSystem(), path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a stored table that nothing reads any more, on any file system that Spark reaches."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def stored(df: DataFrame, label: str, **options: str) -> tuple[DataFrame, str]:
    """``df`` written once to the shared folder and read back, and its folder: cuts the lineage and survives lost executors.

    Shuffle files of the writing go with its end.  Otherwise they stay until the driver collects its garbage, which on
    large tables is many shuffles later.
    """
    spark = df.sparkSession
    path, before = fresh_path(spark, label), spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.options(**{"compression": "zstd"} | options).parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path), path


def staged(df: DataFrame, label: str) -> DataFrame:
    """The same without its folder, for a table that stays."""
    return stored(df, label)[0]


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (staged, of a few fixed-width columns) with a broadcast hint if it has ``rows`` rows at most.

    A larger table is returned as it is, and its join shuffles.
    """
    return F.broadcast(df) if df.count() <= rows else df


Batches = Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def lean(run: Batches) -> Batches:
    """``run``, after which the worker, which may stay idle for a while, gives freed memory back to the system."""

    def wrapped(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)(0)

    return wrapped


def in_batches(df: DataFrame, run: Batches, schema: str | StructType) -> DataFrame:
    """``df.mapInArrow(run, schema)`` for rows that hold whole texts.

    Where the session leaves the size of Arrow batches as Spark sets it, batches of ``TEXT_ROWS`` rows and about
    ``TEXT_BATCH_BYTES`` are asked for, so that neither side holds many texts at once.
    """
    conf = df.sparkSession.conf
    for key, usual, ours in ((_ARROW + "maxRecordsPerBatch", "10000", TEXT_ROWS), (_ARROW + "maxBytesPerBatch", "67108864b", TEXT_BATCH_BYTES)):
        if conf.get(key) == usual:
            conf.set(key, str(ours))
    return df.mapInArrow(lean(run), schema)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores in front as it takes to differ from the columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    free = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        free.append(name)
    return free


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; ``lower`` would change other letters too."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(
        F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    )
