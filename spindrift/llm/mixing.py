"""Mixing sources to target weights.

Method: documents are counted by exact token length in each source. A source's target holds a number of whole
repeats; the remaining budget is fitted over the length counts alone: first in proportion, then from long to
short, then by a bounded-knapsack dynamic programme over what is left. The plan says how many documents of each
length are taken once more, and that many are chosen by a seeded hash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.llm.common import BLANK_WORD
from spindrift.session import durable

#: Cells of the dynamic programme's table. More is left only where one document at most still fits.
DP_CELLS = 1 << 18
#: Documents of one source and length are ranked in hash buckets of about this many rows.
BUCKET_ROWS = 4096


def share_targets(sizes: list[int], weights: list[float], cap: float = 3.0) -> list[float]:
    """Split sum(sizes) by weight; a target stops at cap times its size and the excess is shared again."""
    total = float(sum(sizes))
    targets = [0.0] * len(sizes)
    free = set(range(len(sizes)))
    left = total
    while free:
        weight = sum(weights[i] for i in free)
        over = [i for i in sorted(free) if left * weights[i] / weight > cap * sizes[i]]
        if not over:
            for i in free:
                targets[i] = left * weights[i] / weight
            break
        for i in over:
            targets[i] = cap * sizes[i]
            free.discard(i)
        left = total - sum(targets[i] for i in range(len(sizes)) if i not in free)
    return targets


def knapsack(lengths: list[int], counts: list[int], budget: int) -> dict[int, int]:
    """Copies of each length whose sum is the largest reachable one up to budget (at most DP_CELLS)."""
    items = []
    for length, count in sorted(zip(lengths, counts, strict=True)):
        count, step = min(count, budget // length), 1
        while count > 0:
            step = min(step, count)
            items.append((length, step))
            count, step = count - step, step * 2
    reached_by = np.full(budget + 1, -1, dtype=np.int32)
    reach = np.zeros(budget + 1, dtype=bool)
    reach[0] = True
    for i, (length, copies) in enumerate(items):
        w = length * copies
        if w > budget:
            continue
        new = np.flatnonzero(reach[:-w] & ~reach[w:]) + w
        reach[new] = True
        reached_by[new] = i
        if reach[budget]:
            break
    at, taken = int(np.flatnonzero(reach)[-1]), {}
    while at:
        length, copies = items[reached_by[at]]
        taken[length] = taken.get(length, 0) + copies
        at -= length * copies
    return taken


def fit_budget(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """How many documents of each length to take, so that their tokens come near budget without passing it."""
    total = sum(n * c for n, c in zip(lengths, counts, strict=True))
    if budget <= 0 or total == 0:
        return [0] * len(lengths)
    taken = [min(c, c * budget // total) if n else 0 for n, c in zip(lengths, counts, strict=True)]
    left = budget - sum(n * k for n, k in zip(lengths, taken, strict=True))
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        if lengths[i] and left > DP_CELLS // 2:
            more = min(counts[i] - taken[i], max(0, left - DP_CELLS // 4) // lengths[i])
            taken[i] += more
            left -= more * lengths[i]
    if left > DP_CELLS:  # documents that still fit are longer than three quarters of what is left: the longest is best
        fits = [i for i in range(len(lengths)) if 0 < lengths[i] <= left and counts[i] > taken[i]]
        if fits:
            best = max(fits, key=lambda i: lengths[i])
            taken[best] += 1
            left -= lengths[best]
    free = [i for i in range(len(lengths)) if 0 < lengths[i] <= left and counts[i] > taken[i]]
    if free:
        found = knapsack([lengths[i] for i in free], [counts[i] - taken[i] for i in free], left)
        for i in free:
            taken[i] += found.get(lengths[i], 0)
    return taken


def _plan_source(pdf: pd.DataFrame) -> pd.DataFrame:
    lengths, counts = pdf["_size"].tolist(), pdf["_count"].tolist()
    target, size = float(pdf["_target"].iloc[0]), int(pdf["_source_size"].iloc[0])
    whole = int(target // size) if size else 0
    extra = fit_budget(lengths, counts, round(target - whole * size))
    out = pdf[["_source", "_size", "_count", "_target", "_source_size"]].copy()
    out["_whole"], out["_extra"] = whole, extra
    return out


def plan_repeats(
    df: DataFrame,
    size: Column,
    key: str = "doc_id",
    source: str = "source",
    weights: tuple[float, ...] = (5, 2, 1),
    cap: float = 3.0,
    seed: int = 17,
    keep: list[str] | None = None,
) -> DataFrame:
    """Say how often the mix takes each row: columns key, keep, size, source_size, target, repeats, taken.

    Sources by code point, null last, have the weights in turn and share 100 % of all sizes. One row for each
    source reaches the driver. A source's length counts meet in one task: at most one row for each distinct
    length. Rows of size 0 are repeated as often as the whole repeats of their source. Null or equal keys are
    told apart by their place in the input. Sizes are counted over whole texts, however long. An empty table gives an
    empty result. Columns that are not kept may have any name.
    """
    slim = df.select(
        F.col(key).alias("_key"),
        *[F.col(c) for c in keep or []],
        F.when(F.col(source).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source))).alias("_source"),
        F.coalesce(size, F.lit(0)).cast("long").alias("_size"),
        F.monotonically_increasing_id().alias("_place"),
    ).withColumn("_hash", F.xxhash64(F.lit(seed), "_key", F.when(F.col("_key").isNull(), F.col("_place"))))
    slim = durable(slim)
    counts = durable(slim.groupBy("_source", "_size").agg(F.count("*").alias("_count")))
    totals = counts.groupBy("_source").agg(F.sum(F.col("_size") * F.col("_count")).alias("s")).collect()
    totals.sort(key=lambda r: r["_source"])
    shares = share_targets([r["s"] for r in totals], [weights[i % len(weights)] for i in range(len(totals))], cap)
    targets = df.sparkSession.createDataFrame(
        [(r["_source"], int(r["s"]), t) for r, t in zip(totals, shares, strict=True)],
        "_source string, _source_size long, _target double",
    )
    plan = durable(
        counts.join(targets, "_source")
        .groupBy("_source")
        .applyInPandas(
            _plan_source,
            "_source string, _size long, _count long, _target double, _source_size long, _whole long, _extra long",
        )
    )
    buckets = F.greatest(F.lit(1), F.expr(f"_count div {BUCKET_ROWS}"))
    rows = slim.join(plan, ["_source", "_size"]).withColumn("_bucket", F.pmod(F.col("_hash"), buckets))
    group = ["_source", "_size", "_bucket"]
    ahead = Window.partitionBy("_source", "_size").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    quotas = rows.groupBy(*group).agg(F.count("*").alias("_n"), F.first("_extra").alias("_x")).select(
        *group, (F.col("_x") - F.coalesce(F.sum("_n").over(ahead), F.lit(0))).alias("_quota")
    )
    rank = F.row_number().over(Window.partitionBy(*group).orderBy("_hash", "_key", "_place"))
    chosen = rows.withColumn("_rank", rank).join(quotas, group)
    repeats = F.col("_whole") + (F.col("_rank") <= F.col("_quota")).cast("long")
    return chosen.select(
        F.col("_key").alias(key),
        *(keep or []),
        F.col("_size").alias("size"),
        F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"),
        repeats.alias("repeats"),
        (repeats * F.col("_size")).alias("taken"),
    )


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(BLANK_WORD)), F.lit(0)).cast("long")


def mix_rows(df: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", **options) -> DataFrame:
    """The mixed corpus itself: each row of df as often as the mix takes it, with df's columns, whatever those are called.

    Rows are found again by two hashes of all their columns, not by a number that a repeated scan might give to another
    row; equal rows share the copies that the mix takes of them. Null and empty texts have size 0 and are taken as often
    as the whole repeats of their source. Columns of map type are not supported. An empty table gives no rows.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    placed = df.select(row.alias("row")).select("row", F.xxhash64("row").alias("_a"), F.xxhash64(F.lit(1), "row").alias("_b"))
    plan = plan_repeats(placed, word_count(F.col(f"row.{text}")), key=f"row.{key}", source=f"row.{source}", keep=["_a", "_b"], **options)
    copies = durable(plan.groupBy("_a", "_b").agg(F.sum("repeats").alias("_copies"), F.count("*").alias("n")).where("_copies > 0"))
    each = placed.join(copies.select("_a", "_b", F.expr("_copies div n").alias("_copies")), ["_a", "_b"]).where("_copies > 0")
    out = each.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select("row.*")
    odd = copies.select("_a", "_b", F.expr("_copies % n").alias("_more")).where("_more > 0")
    if odd.isEmpty():
        return out
    # of equal rows it does not matter which is taken more often: one of them stands for all, dealt in small portions
    one = placed.join(odd, ["_a", "_b"]).dropDuplicates(["_a", "_b"])
    portion = one.withColumn("_p", F.explode(F.expr(f"sequence(0, (_more - 1) div {BUCKET_ROWS})"))).repartition("_a", "_p")
    count = F.expr(f"least({BUCKET_ROWS}, _more - _p * {BUCKET_ROWS})").cast("int")
    return out.union(portion.withColumn("_copy", F.explode(F.sequence(F.lit(1), count))).select("row.*"))
