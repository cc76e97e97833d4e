"""Prefix sums and order statistics of sequences that are too long for one task.

A sequence is cut into blocks by columns of its order.  Each block is handled on its own, the blocks' totals are summed along
(a row for each block), and what came before a block is joined back to its rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Places of a sequence that make a block.
BLOCK = 1 << 16
#: Values per unit of a score that share a task when ranks are picked out.
BANDS = 16


def block_of(place: Column, size: int = BLOCK) -> Column:
    return F.floor(place / size).cast("bigint")


def _key(columns: Sequence[str]) -> Column:
    """One column that stands for all of ``columns``: nulls in it are equal, so no row is lost in a join."""
    return F.struct(*columns) if columns else F.struct(F.lit(0).alias("all"))


def running_sum(rows: DataFrame, name: str, value: Column, keys: Sequence[str], blocks: dict[str, Column], within: Sequence[Column | str]) -> DataFrame:
    """Adds ``name``: the sum of ``value`` (whole numbers) over the rows of the same ``keys`` up to and with each row.

    The order is that of ``blocks`` (names of new columns, without nulls) and then of ``within``.  Both halves need the rows by
    key and block only, so the rows are shuffled once.
    """
    names = list(blocks)
    cut = rows.withColumns(blocks | {"_key": _key(keys), "_value": value.cast("bigint")})
    totals = cut.groupBy("_key", *names).agg(F.sum("_value").alias("_total"))
    earlier = Window.partitionBy("_key").orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("_key", *names, F.coalesce(F.sum("_total").over(earlier), F.lit(0).cast("bigint")).alias("_before"))
    along = Window.partitionBy("_key", *names).orderBy(*within).rowsBetween(Window.unboundedPreceding, 0)
    local = cut.withColumn("_local", F.sum("_value").over(along))
    return local.join(before, ["_key", *names]).select(*rows.columns, (F.col("_before") + F.coalesce("_local", F.lit(0).cast("bigint"))).alias(name))


def running_max(rows: DataFrame, name: str, value: Column, keys: Sequence[str], blocks: dict[str, Column], within: Sequence[Column | str], with_own: bool = True) -> DataFrame:
    """Adds ``name``: the largest ``value`` of the rows of the same ``keys`` up to each row, which counts itself if ``with_own``; nulls are passed over."""
    names = list(blocks)
    cut = rows.withColumns(blocks | {"_key": _key(keys), "_value": value})
    totals = cut.groupBy("_key", *names).agg(F.max("_value").alias("_total"))
    earlier = Window.partitionBy("_key").orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("_key", *names, F.max("_total").over(earlier).alias("_before"))
    along = Window.partitionBy("_key", *names).orderBy(*within).rowsBetween(Window.unboundedPreceding, 0 if with_own else -1)
    return cut.withColumn("_local", F.max("_value").over(along)).join(before, ["_key", *names]).select(*rows.columns, F.greatest("_before", "_local").alias(name))


def exclusive_percentile(rows: DataFrame, keys: Sequence[str], value: str, percent: int, name: str, bands: int = BANDS) -> DataFrame:
    """(keys, name): the percentile by the exclusive method of ``value`` (without nulls) for each of ``keys``.

    It lies between the values of two neighbouring ranks.  Equal values are counted before they are shuffled, the counts of bands of values
    are summed along, and only the bands that hold the two ranks are ranked.
    """
    counts = rows.select(_key(keys).alias("_key"), F.col(value).alias("_v")).groupBy("_key", F.floor(F.col("_v") * bands).alias("_band"), "_v").agg(F.count("*").alias("_n"))
    totals = counts.groupBy("_key", "_band").agg(F.sum("_n").alias("_in"))
    whole = Window.partitionBy("_key")
    placed = totals.withColumn("_upto", F.sum("_in").over(whole.orderBy("_band").rowsBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.sum("_in").over(whole))
    rank = F.greatest(F.lit(1), F.least(F.floor(percent * (F.col("_all") + 1) / 100).cast("bigint"), F.col("_all") - 1))
    placed = placed.withColumn("_low", rank)
    held = (F.col("_upto") >= F.col("_low")) & (F.col("_upto") - F.col("_in") < F.col("_low") + 1)
    chosen = placed.filter(held).select("_key", "_band", "_all", "_low", (F.col("_upto") - F.col("_in")).alias("_before"))
    inside = counts.join(chosen, ["_key", "_band"])
    along = Window.partitionBy("_key", "_band").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = inside.withColumn("_rank", F.col("_before") + F.sum("_n").over(along))
    at = lambda r: F.min(F.when(F.col("_rank") >= r, F.col("_v")))
    picked = ranked.groupBy("_key").agg(at(F.col("_low")).alias("_a"), at(F.col("_low") + 1).alias("_b"), F.max("_all").alias("_all"), F.max("_low").alias("_low"))
    share = percent * (F.col("_all") + 1) - 100 * F.col("_low")
    return picked.select("_key.*", F.when(F.col("_all") == 1, F.col("_a")).otherwise((F.col("_a") * (100 - share) + F.col("_b") * share) / 100.0).alias(name))
