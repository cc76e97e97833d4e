"""Connected components of a table of links, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_side, staged


def _state(edges: DataFrame) -> tuple[int, int | None]:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    return row[0], row[1]


def components(links: DataFrame) -> DataFrame:
    """(node, component) for each node of ``links`` (a, b): the smallest node that links reach.

    Alternates two steps until the edges stay as they are: larger neighbours are
    hung on the smallest node of a neighbourhood, then smaller neighbours are.
    Each step's edges are a stored table.  Without links the result is empty.
    """
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = staged(edges, "edges")
    state = _state(edges)
    while state[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lows = small_side(staged(both.groupBy("u").agg(F.least("u", F.min("v")).alias("low")), "lows"))
        hung = staged(both.join(lows, "u").filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct(), "edges")
        lows = small_side(staged(hung.groupBy("u").agg(F.min("v").alias("low")), "lows"))
        moved = hung.join(lows, "u").filter("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        edges = staged(moved.union(lows.select("u", F.col("low").alias("v"))).distinct(), "edges")
        now = _state(edges)
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
