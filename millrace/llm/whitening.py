"""Operator 13: whitening of embeddings.

Entries c become whole numbers x = floor(64 c) + 1,000,000, whose sums S over the n vectors are exact.  With S = q n + r the
centred row x - S / n is (x - q) - r / n: the first difference is exact and small, so nothing is lost to cancellation.  MLlib's
``RowMatrix`` over these rows gives their Gramian, which divided by n is the covariance V.  V is decomposed on the driver
(dimensions by dimensions, whatever the rows), and the scaled components, dimensions by 32, are sent to the tasks that project.

Defined results: vectors that are null or empty, or hold null, NaN or an infinity, are left out; so are vectors whose length is not that of
most vectors (of equally many, the longer); x is held within 2^40 either way; components whose variance is below 10^-12 of the largest do not
exist, so vectors that are all equal give no rows; rows that repeat count each time; null ids stay null; a deviation that no long holds is null;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import staged

#: Steps of an entry in 1, and what is added to their number.
STEPS, SHIFT = 64, 1_000_000
#: Components that are returned at most.
COMPONENTS = 32
#: Bound of x, so that differences and sums of differences stay exact.
BOUND = 1 << 40
#: Least variance of a component, relative to the largest.
LEAST_VARIANCE = 1e-12
_LONG = (1 << 63) - 1


@dataclass(frozen=True)
class Fit:
    """Of ``n`` vectors: the whole part and the rest of each dimension's mean (``sums`` = whole n + rest), the scaled components as
    columns, and the share of the variance that each explains."""

    n: int
    whole: np.ndarray
    rest: np.ndarray
    scaled: np.ndarray
    explained: np.ndarray


def whole_numbers(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, x array<long>) of the usable vectors."""
    entries = F.transform(F.col(vector), lambda e: e.cast("double"))
    odd = F.exists(entries, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == F.lit(float("inf"))))
    limit = F.lit(float(BOUND))
    x = F.transform(entries, lambda e: F.floor(F.greatest(-limit, F.least(limit, e * STEPS))).cast("bigint") + SHIFT)
    usable = rows.filter(F.col(vector).isNotNull() & (F.size(vector) > 0)).select(F.col(key).alias("key"), entries.alias("entries"), F.col(vector))
    return usable.filter(~odd).select("key", x.alias("x"))


def _sums(vectors: DataFrame) -> tuple[int, int, list[int]]:
    """Length, number and exact sums of the vectors of the most frequent length."""
    most = vectors.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if most is None:
        return 0, 0, []
    entries = vectors.filter(F.size("x") == most.d).select(F.posexplode("x").alias("at", "entry"))
    sums = entries.groupBy("at").agg(F.sum(F.col("entry").cast("decimal(20,0)")).alias("s")).orderBy("at").collect()  # as many rows as dimensions
    return most.d, most.n, [int(r.s) for r in sums]


def _numbers(values: np.ndarray) -> Column:
    return F.array(*(F.lit(v.item()) for v in values))


def covariance(centred: DataFrame, column: str, n: int) -> np.ndarray:
    """The Gramian of centred rows (an array of doubles each) divided by ``n``, made by MLlib."""
    rows = MLUtils.convertVectorColumnsFromML(centred.select(array_to_vector(F.col(column)).alias("row")), "row")
    return RowMatrix(rows).computeGramianMatrix().toArray() / n


def fit(vectors: DataFrame, components: int = COMPONENTS) -> tuple[DataFrame, Fit | None]:
    """The vectors of ``whole_numbers`` that are fitted, and what they give; None without any variance."""
    d, n, sums = _sums(vectors)
    same = vectors.filter(F.size("x") == d)
    if n == 0:
        return same, None
    whole = np.array([s // n for s in sums], dtype=np.int64)
    rest = np.array([s % n for s in sums], dtype=np.int64)
    centred = F.zip_with(F.zip_with("x", _numbers(whole), lambda x, q: x - q), _numbers(rest / n), lambda y, r: y.cast("double") - r)
    v = covariance(same.select(centred.alias("centred")), "centred", n)
    values, columns = np.linalg.eigh((v + v.T) / 2)
    values, columns = values[::-1], columns[:, ::-1]
    used = min(components, int((values > max(values[0], 0) * LEAST_VARIANCE).sum()))
    if used == 0:
        return same, None
    columns = columns[:, :used]
    signs = np.sign(columns[np.abs(columns).argmax(axis=0), np.arange(used)])
    return same, Fit(n, whole, rest, columns * signs / np.sqrt(values[:used]), values[:used] / np.trace(v))


def deviations(y: np.ndarray, rest: np.ndarray, n: int) -> list[int | None]:
    """For each row of ``y`` = x - whole the exact sum of (n y - rest)^2; None if no long holds it."""
    if not len(y):
        return []
    large = n * (int(np.abs(y).max()) + 1)
    if large < 1 << 62 and large * large * y.shape[1] <= _LONG:
        z = n * y - rest
        return (z * z).sum(axis=1).tolist()
    z = n * y.astype(object) - rest.astype(object)
    return [s if s <= _LONG else None for s in (z * z).sum(axis=1)]


def projected(vectors: DataFrame, found: Fit) -> DataFrame:
    """(key, deviation, whitened array<double>) of fitted vectors."""
    sent = vectors.sparkSession.sparkContext.broadcast(found)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fitted = sent.value
        for batch in batches:
            y = np.array(batch["x"].tolist(), dtype=np.int64).reshape(len(batch), -1) - fitted.whole if len(batch) else np.empty((0, len(fitted.whole)), dtype=np.int64)
            whitened = (y - fitted.rest / fitted.n) @ fitted.scaled
            yield pd.DataFrame({"key": batch["key"], "deviation": pd.array(deviations(y, fitted.rest, fitted.n), "Int64"), "whitened": list(whitened)})

    kind = vectors.schema["key"].dataType.simpleString()
    return vectors.mapInPandas(run, f"key {kind}, deviation long, whitened array<double>")


def identity_error(rows: DataFrame, n: int, components: int) -> float:
    """The largest absolute entry of the covariance of ``whitened`` less the identity, from the rows themselves."""
    entries = rows.select(F.posexplode("whitened").alias("at", "value"))
    means = np.array([r.m for r in entries.groupBy("at").agg(F.avg("value").alias("m")).orderBy("at").collect()])  # at most 32
    centred = F.zip_with("whitened", _numbers(means), lambda w, m: w - m)
    return float(np.abs(covariance(rows.select(centred.alias("centred")), "centred", n) - np.eye(components)).max())


def whitened(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) for each usable vector and component."""
    vectors, found = fit(whole_numbers(rows, key, vector), components)
    kind = rows.schema[key].dataType.simpleString()
    if found is None:
        schema = f"`{key}` {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
        return rows.sparkSession.createDataFrame([], schema)
    made = staged(projected(vectors, found), "whitened")
    error = identity_error(made, found.n, len(found.explained))
    exploded = made.select("key", "deviation", F.posexplode("whitened").alias("at", "value"))
    return exploded.select(
        F.col("key").alias(key), (F.col("at") + 1).alias("component"), F.lit(found.n).cast("bigint").alias("n"), "deviation", F.col("value").alias("whitened"),
        F.element_at(_numbers(found.explained), F.col("at") + 1).alias("explained"), F.lit(error).alias("identity_error"),
    )
