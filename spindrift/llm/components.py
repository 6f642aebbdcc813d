"""Connected components of a graph held as a DataFrame, by alternating large and small stars.

What has few edges is settled by one union-find in one task instead: the bound is checked, and the result is the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.session import durable

#: So many edges at most go to one task, which holds them in some tens of megabytes.
SMALL = 200_000


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003)).first())


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link every node's neighbours (the larger ones, or the smaller ones and itself) to its least neighbour."""
    pairs = edges.union(edges.select("v", "u")).toDF("u", "v") if large else edges
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = pairs.join(least, "u")
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m"))
    return out.where(F.col("u") != F.col("v")).distinct()


def _settled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Every node of the edges u, v with the least node that it is connected to."""
    up: dict = {}

    def find(x):
        while (above := up.setdefault(x, x)) != x:
            up[x] = x = up.setdefault(above, above)
        return x

    for pdf in batches:
        for u, v in zip(pdf["u"].tolist(), pdf["v"].tolist(), strict=True):
            x, y = find(u), find(v)
            up[max(x, y)] = min(x, y)
    yield pd.DataFrame([(x, find(x)) for x in list(up)], columns=["node", "root"])


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node reachable) for every node that has an edge; edges has two columns of one type.

    Each round is materialised in the shared checkpoint folder; the number of rounds grows with the logarithm of
    the graph, and no part of it reaches the driver. Edges of a node to itself and null ones do not count; repeated
    edges count once; without edges there are no rows.
    """
    left, right = edges.columns
    now = edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).where(f"{left} != {right}")
    now = durable(now)
    if now.count() <= SMALL:
        kind = dict(now.dtypes)["u"]
        return durable(now.coalesce(1).mapInPandas(_settled, f"node {kind}, root {kind}"))
    now = durable(now.distinct())
    before = None
    while (state := _state(now)) != before:
        before = state
        now = durable(_star(_star(now, large=True), large=False))
    return durable(now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v")).distinct())
