"""Connected components of an edge table, by alternating large and small stars.

Every round moves each edge towards the smallest node around it; the number of
rounds grows with the logarithm of the longest path. Minima combine before the
shuffle, and the join that could meet a hot node reads two written tables, so
that adaptive execution can split it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def connected_components(edges: DataFrame, label: str = "components") -> DataFrame:
    """``node, component`` (the smallest node) for all nodes of ``edges(a, b)``; self-loops and repeats are allowed."""
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = materialise(edges, label)
    before = _state(edges)
    while True:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        least = materialise(least, label)
        large = both.join(least, both["a"] == least["u"]).where("b > a").select(F.col("b").alias("v"), "m").distinct()
        small = large.groupBy("v").agg(F.min("m").alias("low"))
        moved = large.join(small, "v").where("m <> low").select(F.col("m").alias("a"), F.col("low").alias("b"))
        edges = materialise(small.select(F.col("v").alias("a"), F.col("low").alias("b")).unionAll(moved).distinct(), label)
        after = _state(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots)


def _state(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
