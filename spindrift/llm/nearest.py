"""Nearest neighbours of a stated query set by a block matrix join.

Method: vectors are quantised to int8 and dealt into tiles. A tile of queries times a tile of candidates gives
approximate distances whose error is bounded by the quantisation residuals; pairs that cannot reach a query's
nearest k by those bounds are dropped, the others are recomputed in double precision, and the tiles' results are
merged. No pair that belongs to the answer is lost, so recall is 1.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vectors in a tile; a task holds one tile of each side.
TILE = 4096


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, the scale of each vector, and the length of what rounding left out."""
    scale = np.abs(x).max(axis=1) / 127.0
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    residual = np.sqrt(((x - codes * scale[:, None]) ** 2).sum(axis=1))
    return codes, scale, residual


def lengths(gap: np.ndarray) -> np.ndarray:
    """Euclidean length of each row; rows whose squares would leave the doubles are scaled by a power of two first."""
    largest = np.abs(gap).max(axis=1)
    far = (largest > 0) & ((largest < 1e-140) | (largest > 1e140))
    unit = np.where(far, -np.frexp(np.where(far, largest, 1.0))[1], 0)
    scaled = np.ldexp(gap, unit[:, None])
    return np.ldexp(np.sqrt(np.cumsum(scaled * scaled, axis=1)[:, -1]), -unit)


def tile_nearest(qid, qrow, q, cid, crow, c, k: int) -> list[tuple[int, int, int, float]]:
    """(query row, query id, candidate id, distance) of each query's k nearest in one tile of candidates.

    A pair whose bounds are not finite, because squares overflow, is recomputed in any case.
    """
    with np.errstate(over="ignore", invalid="ignore", under="ignore"):
        qc, qs, qe = quantise(q)
        cc, cs, ce = quantise(c)
        # products of int8 codes stay below 2**24 for up to 1040 dimensions, where float32 is exact
        kind = np.float32 if q.shape[1] <= 1040 else np.float64
        dots = (qc.astype(kind) @ cc.astype(kind).T).astype(np.float64) * qs[:, None] * cs[None, :]
        qn = (qc.astype(np.float64) ** 2).sum(axis=1) * qs**2
        cn = (cc.astype(np.float64) ** 2).sum(axis=1) * cs**2
        rough = np.sqrt(np.maximum(qn[:, None] + cn[None, :] - 2 * dots, 0.0))
        # the last term covers squares that vanish
        slack = qe[:, None] + ce[None, :] + 1e-6 * (np.sqrt(qn)[:, None] + np.sqrt(cn)[None, :]) + 1e-150
        low, high = rough - slack, rough + slack
        unknown = ~(np.isfinite(low) & np.isfinite(high))
        low[unknown], high[unknown] = 0.0, np.inf
        own = qrow[:, None] == crow[None, :]
        high[own], low[own] = np.inf, np.inf
        reach = np.partition(high, k - 1, axis=1)[:, k - 1] if high.shape[1] > k else np.full(len(q), np.inf)
        out = []
        for i in range(len(q)):
            near = np.flatnonzero((low[i] <= reach[i]) & (low[i] < np.inf))
            if len(near):
                exact = lengths(c[near] - q[i])
                best = heapq.nsmallest(k, zip(exact.tolist(), cid[near].tolist(), strict=True))
                out += [(int(qrow[i]), int(qid[i]), v, s) for s, v in best]
    return out


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 10, key: str = "vec_id", column: str = "embedding", tile: int = TILE
) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: Euclidean distance in double precision, nearest first.

    Candidates are all rows but the query's own, of the same dimension; ties go to the smaller id. Rows with a
    null id, or whose vector is null, empty, all zero or has a null or non-finite component, take no part.
    Repeated query rows are answered each, under one query_id. Vectors may be as long as they are; an empty table
    gives no rows. Columns other than key and column are only seen by is_query, so their names cannot clash.
    """
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))
    usable = (
        vectors.select(F.col(key).cast("long").alias("id"), F.col(column).cast("array<double>").alias("x"), is_query.alias("q"))
        .withColumn("row", F.monotonically_increasing_id())
        .where(F.col("id").isNotNull() & F.col("x").isNotNull() & F.forall("x", finite) & F.exists("x", lambda x: x != 0))
        .withColumn("n", F.size("x"))
    )
    total = usable.count()
    queries = usable.where("q").count()
    strips, blocks = max(1, -(-total // tile)), max(1, -(-queries // tile))
    side = lambda df, own, own_n, other, other_n: df.select(
        "id", "row", "x", "n", F.pmod(F.xxhash64("row"), F.lit(own_n)).cast("int").alias(own),
        F.explode(F.sequence(F.lit(0), F.lit(other_n - 1))).alias(other),
    )
    left = side(usable.where("q"), "b", blocks, "s", strips)
    right = side(usable, "s", strips, "b", blocks)

    def product(qs: pd.DataFrame, cs: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(qs) and len(cs):
            q, c = np.stack(qs["x"].to_numpy()), np.stack(cs["x"].to_numpy())
            step = 512  # queries at a time: bounds memory to 512 x tile doubles
            for i in range(0, len(q), step):
                part = slice(i, i + step)
                rows += tile_nearest(
                    qs["id"].to_numpy()[part], qs["row"].to_numpy()[part], q[part],
                    cs["id"].to_numpy(), cs["row"].to_numpy(), c, k,
                )
        return pd.DataFrame(rows, columns=["row", "query_id", "vec_id", "score"])

    on = ["n", "b", "s"]
    tiles = left.groupBy(*on).cogroup(right.groupBy(*on)).applyInPandas(product, "row long, query_id long, vec_id long, score double")
    order = Window.partitionBy("row").orderBy("score", "vec_id")
    best = tiles.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
