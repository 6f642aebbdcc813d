"""Penalties and losses over token columns (L1-L8). Values only; no gradients."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), x))


def kl_penalty(log_prob: Column, ref_log_prob: Column, kind: str = "kl") -> Column:
    """kl, abs, mse or low_var_kl of one token (L1)."""
    d = log_prob - ref_log_prob
    if kind == "kl":
        return d
    if kind == "abs":
        return F.abs(d)
    if kind == "mse":
        return F.lit(0.5) * d * d
    if kind == "low_var_kl":
        back = clip(-d, -20, 20)
        return clip(F.exp(back) - back - 1, -10, 10)
    raise ValueError(f"unknown penalty: {kind}")


def penalized_reward(score: Column, log_prob: Column, ref_log_prob: Column, beta: float) -> Column:
    """Token score less beta times the log ratio (L2)."""
    return score - F.lit(float(beta)) * (log_prob - ref_log_prob)


def adaptive_coefficients(steps: DataFrame, start: float, target: float, horizon: int) -> DataFrame:
    """The adaptive penalty coefficient before and after each step (L3): columns step, kl, n get ``beta`` and ``next``.

    The update is a product of factors that depend on their own step only, multiplied in the order of the steps as the
    sequential state is. A factor is negative or zero where n is many times the horizon. Steps are few: they share one
    window.
    """
    factor = 1 + clip(F.col("kl") / F.lit(float(target)) - 1, -0.2, 0.2) * F.col("n") / F.lit(float(horizon))
    order = Window.orderBy("step")
    first = F.row_number().over(order) == 1
    scaled = steps.withColumn("_f", F.when(first, F.lit(float(start)) * factor).otherwise(factor))
    after = F.product("_f").over(order.rowsBetween(Window.unboundedPreceding, 0))
    out = scaled.withColumn("next", after).drop("_f")
    return out.withColumn("beta", F.coalesce(F.lag("next").over(order), F.lit(float(start))))


def policy_token_loss(
    log_prob: Column,
    old_log_prob: Column,
    advantage: Column,
    low: float = 0.2,
    high: float = 0.2,
    dual: float = 3.0,
    kind: str = "default",
    sequence_shift: Column | None = None,
) -> Column:
    """One token's clipped policy loss (L5): default, gspo, gspo_token or cispo.

    The sequence kinds use ``sequence_shift``, the masked mean of the row's log ratios, in place of the token's.
    """
    shift = log_prob - old_log_prob if kind in ("default", "cispo") else sequence_shift
    ratio = F.exp(clip(shift, -20, 20))
    bounded = clip(ratio, 1 - low, 1 + high)
    if kind == "cispo":
        return -advantage * bounded * log_prob
    worst = F.greatest(-advantage * ratio, -advantage * bounded)
    return F.when(advantage < 0, F.least(worst, -advantage * F.lit(float(dual)))).otherwise(worst)


def value_token_loss(value: Column, returns: Column, old_value: Column, clip_range: float) -> Column:
    """Half the larger of the plain and the clipped squared error."""
    near = F.least(old_value + clip_range, F.greatest(old_value - clip_range, value))
    return F.lit(0.5) * F.greatest((value - returns) ** 2, (near - returns) ** 2)


def average_loss(tokens: DataFrame, loss: str = "loss", mask: str = "mask", row: str = "row_id", mode: str = "token") -> DataFrame:
    """Mean over all masked tokens, or mean of the rows' masked means (L4)."""
    value = F.sum(F.col(loss) * F.col(mask))
    if mode == "token":
        return tokens.agg((value / (F.sum(mask) + 1e-8)).alias("loss"))
    return tokens.groupBy(row).agg((value / (F.sum(mask) + 1e-8)).alias("mean")).agg(F.avg("mean").alias("loss"))


def micro_batch_weight(units: Column, world: int, all_units: Column) -> Column:
    """Share of a micro-batch in the global loss, times the number of workers."""
    return units * F.lit(float(world)) / all_units


def oracle_reward_control(reward: Column, is_oracle: Column, scale: float | None = None, cap: float | None = None) -> Column:
    """Scale and cap the reward of oracle rows."""
    out = reward * scale if scale is not None else reward
    out = F.least(out, F.lit(float(cap))) if cap is not None else out
    return F.when(is_oracle, out).otherwise(reward)
