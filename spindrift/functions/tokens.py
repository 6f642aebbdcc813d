"""Array columns of token values: masked sums, folds and sequence shaping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _doubles(values: Column) -> Column:
    return values.cast("array<double>")


def total(values: Column) -> Column:
    return F.aggregate(_doubles(values), F.lit(0.0), lambda a, x: a + x)


def masked_sum(values: Column, mask: Column) -> Column:
    """Sum of value times mask over the positions of a row."""
    return total(F.zip_with(_doubles(values), _doubles(mask), lambda v, m: v * m))


def masked_row_mean(values: Column, mask: Column) -> Column:
    """Masked mean of a row (G3); a mask without any weight is an error."""
    weight = total(mask)
    return F.when(weight > 0, masked_sum(values, mask) / weight).otherwise(
        F.raise_error(F.lit("a response mask must select at least one token")).cast("double")
    )


def spread(value: Column, mask: Column) -> Column:
    """A sequence value at every masked position."""
    return F.transform(_doubles(mask), lambda m: m * value)


def mask_after_end(tokens: Column, end_ids: list[int]) -> Column:
    """1 up to and including the first end token, 0 behind it."""
    hit = F.transform(tokens, lambda t: t.isin(end_ids))
    first = F.array_position(hit, True)
    return F.transform(tokens, lambda _, i: F.when((first == 0) | (i < first), 1).otherwise(0))


def discounted_returns(rewards: Column, mask: Column, gamma: float) -> Column:
    """Returns folded from the right; a position of mask 0 cuts the carry behind it."""
    steps = F.reverse(F.zip_with(_doubles(rewards), _doubles(mask), lambda r, m: F.struct(r.alias("r"), m.alias("m"))))
    start = F.struct(F.lit(0.0).alias("run"), F.array().cast("array<double>").alias("out"))

    def fold(acc: Column, x: Column) -> Column:
        now = x["r"] + F.lit(float(gamma)) * acc["run"]
        return F.struct((now * x["m"]).alias("run"), F.array_append(acc["out"], now).alias("out"))

    return F.reverse(F.aggregate(steps, start, fold, lambda acc: acc["out"]))


def returns_to_go(rewards: Column, mask: Column) -> Column:
    """Reverse cumulative sum of masked rewards."""
    steps = F.reverse(F.zip_with(_doubles(rewards), _doubles(mask), lambda r, m: r * m))
    start = F.struct(F.lit(0.0).alias("run"), F.array().cast("array<double>").alias("out"))
    fold = lambda acc, x: F.struct((acc["run"] + x).alias("run"), F.array_append(acc["out"], acc["run"] + x).alias("out"))
    return F.reverse(F.aggregate(steps, start, fold, lambda acc: acc["out"]))


def gae(rewards: Column, values: Column, mask: Column, gamma: float, lam: float) -> Column:
    """Generalised advantage estimates by a fold from the right (G23), before whitening.

    The next value and the running estimate are carried over masked positions only, in each row by itself.
    """
    steps = F.reverse(
        F.zip_with(
            F.arrays_zip(_doubles(rewards).alias("r"), _doubles(values).alias("v")),
            _doubles(mask),
            lambda x, m: F.struct(x["r"].alias("r"), x["v"].alias("v"), m.alias("m")),
        )
    )
    start = F.struct(F.lit(0.0).alias("next"), F.lit(0.0).alias("run"), F.array().cast("array<double>").alias("out"))

    def fold(acc: Column, x: Column) -> Column:
        delta = x["r"] + F.lit(float(gamma)) * acc["next"] - x["v"]
        now = delta + F.lit(float(gamma * lam)) * acc["run"]
        live = x["m"] > 0
        return F.struct(
            F.when(live, x["v"]).otherwise(acc["next"]).alias("next"),
            F.when(live, now).otherwise(acc["run"]).alias("run"),
            F.array_append(acc["out"], F.when(live, now).otherwise(acc["run"])).alias("out"),
        )

    return F.reverse(F.aggregate(steps, start, fold, lambda acc: acc["out"]))


def shape_sequence(tokens: Column, length: int, pad: int, left: bool = False, cut: str = "error") -> Column:
    """Pad to a length on one side; longer sequences are cut on the side named, or are an error."""
    gap = F.array_repeat(F.lit(pad), F.greatest(F.lit(0), F.lit(length) - F.size(tokens)))
    filled = F.concat(gap, tokens) if left else F.concat(tokens, gap)
    if cut == "left":
        long = F.slice(tokens, F.size(tokens) - length + 1, F.lit(length))
    elif cut == "right":
        long = F.slice(tokens, F.lit(1), F.lit(length))
    else:
        long = F.raise_error(F.lit(f"a sequence is longer than {length}")).cast("array<int>")
    return F.when(F.size(tokens) > length, long).otherwise(filled)
