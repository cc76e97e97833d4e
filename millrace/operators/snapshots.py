"""What changed between two states of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def table_digest(rows: DataFrame) -> DataFrame:
    """One row (n, parity, total) that does not depend on the order of the rows, and in which a row that repeats counts each time."""
    row_hash = F.xxhash64(*rows.columns)
    return rows.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(row_hash), F.lit(0)).alias("parity"), F.coalesce(F.sum(row_hash.cast("decimal(20,0)")), F.lit(0)).cast("decimal(38,0)").alias("total"))


def same(before: DataFrame, after: DataFrame) -> bool:
    """Whether two states are equal, by their digests."""
    return table_digest(before).first() == table_digest(after).first()


def _differs(names: Sequence[str]) -> Column:
    return F.filter(F.array(*(F.when(~F.col(f"_old.{c}").eqNullSafe(F.col(f"_new.{c}")), F.lit(c)) for c in names)), lambda c: c.isNotNull())


def difference(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, change, columns): rows added, removed and changed, with the names of the columns that differ; keys are unique in each state."""
    names = [c for c in before.columns if c != key]
    old = before.select(F.col(key).alias("_of"), F.struct(*names).alias("_old"))
    new = after.select(F.col(key).alias("_to"), F.struct(*names).alias("_new"))
    joined = old.join(new, F.col("_of").eqNullSafe(F.col("_to")), "full")
    added, removed = F.col("_old").isNull(), F.col("_new").isNull()
    change = F.when(added, "added").when(removed, "removed").when(~F.col("_old").eqNullSafe(F.col("_new")), "changed")
    named = F.when(added | removed, F.array().cast("array<string>")).otherwise(_differs(names))
    return joined.select(F.coalesce("_to", "_of").alias(key), change.alias("change"), named.alias("columns")).filter("change is not null")
