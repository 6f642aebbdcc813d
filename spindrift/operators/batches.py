"""Batch algebra and balancing by length."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions.text import stable_rank
from spindrift.operators.dataset import ranked_within


def pop_columns(df: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """The columns taken out, and the batch without them (B1)."""
    return df.select(*names), df.drop(*names)


def slice_rows(df: DataFrame, start: int, stop: int, row: str = "row_id") -> DataFrame:
    """Rows of an id range (B2)."""
    return df.where((F.col(row) >= start) & (F.col(row) < stop))


def chunk(df: DataFrame, size: int, total: int, row: str = "row_id", ragged: bool = False) -> DataFrame:
    """Adds ``chunk`` over dense row ids from 0 (B3); the rows must divide into chunks of that size.

    With ``ragged`` any number of rows will do, and the last chunk has what remains.
    """
    if total % size and not ragged:
        raise ValueError(f"{total} rows do not divide into chunks of {size}")
    return df.withColumn("chunk", F.expr(f"`{row}` div {size}"))


def pad_to_divisor(df: DataFrame, divisor: int, total: int, row: str = "row_id") -> DataFrame:
    """Rows repeated from the start until the divisor fits (B4): adds ``is_pad`` and renumbers the copies behind."""
    gap = -total % divisor
    parts = [df.withColumn("is_pad", F.lit(False))]
    copies, at = -(-gap // total) if gap else 0, total
    for _ in range(copies):
        part = df.where(F.col(row) < gap - (at - total)).withColumn(row, F.col(row) + at).withColumn("is_pad", F.lit(True))
        parts.append(part)
        at += total
    return reduce(DataFrame.unionByName, parts)


def unpad(df: DataFrame) -> DataFrame:
    return df.where("NOT is_pad").drop("is_pad")


def fold_rows(df: DataFrame, size: int, value: str, row: str = "row_id") -> DataFrame:
    """Blocks of ``size`` rows as one array each."""
    block = F.expr(f"`{row}` div {size}").alias("block")
    ordered = F.array_sort(F.collect_list(F.struct(row, value)))  # size rows a block
    return df.groupBy(block).agg(F.transform(ordered, lambda x: x[value]).alias(value))


def iterate(df: DataFrame, size: int, epochs: int, seed: int = 17, row: str = "row_id") -> DataFrame:
    """Mini-batches of several epochs, each in its own stable shuffle (B6): epoch, batch.

    The shuffle is the stable rank of a row under its epoch; places are counted by blocks, so no task holds an epoch.
    """
    many = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    shuffled = many.withColumn("_h", stable_rank(seed, F.concat(F.lit("epoch:"), F.col("epoch").cast("string")), F.col(row).cast("string")))
    place = ranked_within(shuffled, ["epoch"], ["_h", row])
    return place.withColumn("batch", F.expr(f"rank div {size}")).drop("_h", "rank")


def reorder(df: DataFrame, order: DataFrame, row: str = "row_id") -> DataFrame:
    """Rows with ``position`` from an order table of row and position."""
    return df.join(order.select(row, "position"), row)


def restore(df: DataFrame, row: str = "row_id") -> DataFrame:
    """Rows back in their first order."""
    return df.orderBy(row)


def prompt_major(df: DataFrame, prompt: str, rank: str) -> DataFrame:
    """Rank-major outputs numbered prompt by prompt (B15): adds ``position`` inside each prompt."""
    return df.withColumn("position", F.row_number().over(Window.partitionBy(prompt).orderBy(rank)) - 1)


def largest_differencing(lengths: list[int], parts: int, equal_size: bool = False, ragged: bool = False) -> list[list[int]]:
    """k-way largest differencing (B8): indices of each part.

    A state holds k bins from heavy to light; the two states of the widest spread merge heavy against light. Equal
    sizes need rows that divide into the parts; with ``ragged`` any number will do, and sizes differ by one at most.
    """
    if equal_size and len(lengths) % parts and not ragged:
        raise ValueError(f"{len(lengths)} rows do not divide into {parts} equal parts")
    by_length = sorted((n, i) for i, n in enumerate(lengths))
    step = parts if equal_size else 1
    bins = lambda group: sorted([(n, ((i, n),)) for n, i in group] + [(0, ())] * (parts - len(group)), key=weight, reverse=True)
    heap: list = []

    def push(state: list) -> None:
        heapq.heappush(heap, _Ranked((state[0][0] - state[-1][0], weight(state[0])), state))

    for at in range(0, len(by_length), step):
        push(bins(by_length[at : at + step]))
    if not heap:
        return [[] for _ in range(parts)]
    while len(heap) > 1:
        a, b = heapq.heappop(heap).state, heapq.heappop(heap).state
        merged = [(x[0] + y[0], x[1] + y[1]) for x, y in zip(a, reversed(b), strict=True)]
        push(sorted(merged, key=weight, reverse=True))
    return [[i for i, _ in items] for _, items in heap[0].state]


def weight(one: tuple) -> tuple:
    """Order of bins: by sum, then by number of items, then by the items."""
    return one[0], len(one[1]), one[1]


class _Ranked:
    """A heap entry that puts larger ranks first."""

    __slots__ = ("rank", "state")

    def __init__(self, rank: tuple, state: list):
        self.rank, self.state = rank, state

    def __lt__(self, other: _Ranked) -> bool:
        return self.rank > other.rank


def lightest_first(lengths: list[int], parts: int, equal_size: bool = False) -> list[list[int]]:
    """Each row, in input order, to the part that is lightest so far."""
    extra = sum(lengths) + 1 if equal_size else 0
    heap, out = [(0, p) for p in range(parts)], [[] for _ in range(parts)]
    for i, n in enumerate(lengths):
        load, p = heapq.heappop(heap)
        out[p].append(i)
        heapq.heappush(heap, (load + n + extra, p))
    return out


def balance(df: DataFrame, parts: int, group: str, length: str, row: str = "row_id", equal_size: bool = False, method=largest_differencing) -> DataFrame:
    """Parts of near-equal length inside every group (B8, B9, B12): group, row, part.

    A group is one training batch: its size is set by the trainer, not by the data.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(row, ignore_index=True)
        found = method(pdf[length].tolist(), parts, equal_size)
        where = {i: p for p, members in enumerate(found) for i in members}
        return pd.DataFrame({group: pdf[group], row: pdf[row], "part": [where[i] for i in range(len(pdf))]})

    kinds = dict(df.dtypes)
    return df.select(group, row, length).groupBy(group).applyInPandas(run, f"`{group}` {kinds[group]}, `{row}` {kinds[row]}, part int")


def micro_batches(df: DataFrame, budget: int, group: str, length: str, row: str = "row_id") -> DataFrame:
    """Micro-batches under a token budget (B10): heaviest sum of squared lengths first; group, row, micro."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(row, ignore_index=True)
        lengths = pdf[length].tolist()
        if max(lengths) > budget:
            raise ValueError("a sequence is longer than the budget")
        n = min(len(lengths), -(-sum(lengths) // budget))
        found = largest_differencing(lengths, n)
        found.sort(key=lambda m: (sum(lengths[i] ** 2 for i in m), min(m, default=0)), reverse=True)
        where = {i: k for k, members in enumerate(found) for i in members}
        return pd.DataFrame({group: pdf[group], row: pdf[row], "micro": [where[i] for i in range(len(pdf))]})

    kinds = dict(df.dtypes)
    return df.select(group, row, length).groupBy(group).applyInPandas(run, f"`{group}` {kinds[group]}, `{row}` {kinds[row]}, micro int")


def repeat_rows(df: DataFrame, times: int, interleave: bool = True, row: str = "row_id", total: int | None = None) -> DataFrame:
    """Every row ``times`` times (J10): adds ``copy`` and ``position``, copies side by side or batch by batch."""
    out = df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    position = F.col(row) * times + F.col("copy") if interleave else F.col("copy") * F.lit(total) + F.col(row)
    return out.withColumn("position", position)


def union_columns(left: DataFrame, right: DataFrame, row: str = "row_id") -> DataFrame:
    """Columns of both sides by row (J3); shared columns must agree, and a missing row is an error."""
    shared = [c for c in right.columns if c in left.columns and c != row]
    renamed = right.select(row, F.lit(True).alias("_there"), *[F.col(c).alias(f"_r_{c}") if c in shared else F.col(c) for c in right.columns if c != row])
    out = left.join(renamed, row, "left")
    wrong = reduce(lambda a, b: a | b, [~F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in shared], F.col("_there").isNull())
    ok = F.when(wrong, F.raise_error(F.lit("both sides must agree on shared columns and rows")).cast("boolean")).otherwise(F.lit(True))
    return out.where(ok).drop("_there", *[f"_r_{c}" for c in shared])


def concat(parts: list[DataFrame]) -> DataFrame:
    """Rows of all parts (J11); columns must be the same."""
    names = set(parts[0].columns)
    if any(set(p.columns) != names for p in parts):
        raise ValueError("parts must have the same columns")
    return reduce(DataFrame.unionByName, parts)


def append_oracles(policy: DataFrame, oracles: DataFrame, n: int | None = None, groups: int | None = None, group: str = "uid", row: str = "row_id") -> DataFrame:
    """Policy rows and one oracle row behind each group (J12): adds is_oracle_row and ``position``.

    Groups are kept whole; with ``n`` each is cut to its first n policy rows, and never loses its oracle. With
    ``groups`` the result is cut to that many full groups, in order of their ids.
    """
    if n is not None:
        order = Window.partitionBy(group).orderBy(row)
        policy = policy.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n")
    both = policy.withColumn("is_oracle_row", F.lit(False)).unionByName(oracles.withColumn("is_oracle_row", F.lit(True)))
    inside = Window.partitionBy(group).orderBy("is_oracle_row", row)
    out = both.withColumn("position", F.row_number().over(inside) - 1)
    if groups is None:
        return out
    first = policy.select(group).distinct().orderBy(group).limit(groups)
    return out.join(first, group, "left_semi")


def valid_length(mask: Column) -> Column:
    return F.aggregate(mask, F.lit(0), lambda a, m: a + m.cast("int"))


def ragged_union(parts: list[DataFrame]) -> DataFrame:
    """Rows of parts with different columns; what is missing is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def batches_of(df: DataFrame) -> Iterator[DataFrame]:
    """The chunks of a chunked batch, one after the other."""
    for r in df.select("chunk").distinct().orderBy("chunk").toLocalIterator():
        yield df.where(F.col("chunk") == r["chunk"])
