"""A sink that a restarted stream does not fill twice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter


def written_once(stream: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """A writer of ``stream`` to Parquet files below ``path``, a folder for each micro-batch.

    A batch that runs again, after a stop between its files and its commit, replaces its own folder, so each row is there once.  Spark keeps
    the plan of offsets in ``checkpoint`` and gives a batch that is run again the same rows.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def read_written(spark: SparkSession, path: str) -> DataFrame:
    """What the sink holds, without the number of the batch."""
    return spark.read.option("basePath", path).parquet(f"{path}/batch=*").drop("batch")
