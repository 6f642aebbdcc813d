"""Group-relative advantages as window expressions.

Input rows carry a group key, a row id, a reward and, where an oracle takes part, a flag. All windows of an
operator are partitioned by exactly the group key, so one exchange serves them all.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class GainSettings:
    """Constants of the directional gain and of the detached oracle."""

    power: float = 0.25
    cap: float = 4.0
    eps: float = 1e-6
    oracle_scale: float = 2.0
    gap_power: float = 2.0
    cap_ratio: float | None = 1.2
    cap_low: float = 0.05
    cap_high: float = 1.0


def sample_std(x: Column, w) -> Column:
    """Sample deviation over a window, 0 for fewer than two values."""
    return F.coalesce(F.stddev_samp(x).over(w), F.lit(0.0))


def grpo(df: DataFrame, group: str = "uid", reward: str = "reward", eps: float = 1e-6, normalize: bool = True) -> DataFrame:
    """Adds ``advantage``: (r - mean) / (std + eps), or only centred (G6). Groups of one row are an error."""
    w = Window.partitionBy(group)
    r = F.col(reward)
    centred = r - F.avg(r).over(w)
    scaled = centred / (sample_std(r, w) + eps) if normalize else centred
    alone = F.raise_error(F.lit("a group needs at least two rows")).cast("double")
    return df.withColumn("advantage", F.when(F.count("*").over(w) > 1, scaled).otherwise(alone))


def _parts(group: str, flag: str, reward: str):
    w = Window.partitionBy(group)
    oracle = F.col(flag)
    policy = F.when(~oracle, F.col(reward))
    return w, oracle, policy


def raw_center_on_policy(df: DataFrame, group: str = "uid", reward: str = "reward", flag: str = "is_oracle_row") -> DataFrame:
    """Adds ``centered``: a policy row's reward less the policy mean; the oracle row gets 0."""
    w, oracle, policy = _parts(group, flag, reward)
    return df.withColumn("centered", F.when(oracle, 0.0).otherwise(F.col(reward) - F.avg(policy).over(w)))


def checked_groups(df: DataFrame, group: str = "uid", flag: str = "is_oracle_row") -> DataFrame:
    """Rows as they are; a group without exactly one oracle row, or without policy rows, is an error."""
    w = Window.partitionBy(group)
    oracles = F.sum(F.col(flag).cast("int")).over(w)
    bad = (oracles != 1) | (F.count("*").over(w) < 2)
    message = F.raise_error(F.lit("each group needs one oracle row and a policy row")).cast("boolean")
    return df.withColumn("_ok", F.when(bad, message).otherwise(F.lit(True))).where("_ok").drop("_ok")


def directional_gain(all_std: Column, policy_std: Column, s: GainSettings = GainSettings()) -> Column:
    """How much the oracle widens the spread, as a power capped to [1, cap]."""
    return F.least(F.lit(s.cap), F.greatest(F.lit(1.0), F.pow(all_std / (policy_std + s.eps), F.lit(s.power))))


def reward_gap(oracle: Column, policy_mean: Column, s: GainSettings = GainSettings()) -> Column:
    """The share of the oracle's reward that policy rows miss on average, to a power."""
    share = (oracle - policy_mean) / (oracle + s.eps)
    return F.pow(F.least(F.lit(1.0), F.greatest(F.lit(0.0), share)), F.lit(s.gap_power))


def detached_oracle(gap: Column, best_positive: Column, s: GainSettings = GainSettings()) -> Column:
    """The oracle's own advantage: scaled gap, capped by the best positive policy advantage."""
    raw = F.lit(s.oracle_scale) * gap
    if s.cap_ratio is None:
        return raw
    ceiling = F.coalesce(F.lit(s.cap_ratio) * best_positive, F.lit(s.cap_low))
    ceiling = F.least(F.lit(s.cap_high), F.greatest(F.lit(s.cap_low), ceiling))
    return F.least(raw, ceiling)


def oracle_advantages(
    df: DataFrame,
    settings: GainSettings = GainSettings(),
    group: str = "uid",
    reward: str = "reward",
    flag: str = "is_oracle_row",
    oracle_reward: str | None = None,
    trainer: bool = False,
    min_std: float = 1e-3,
) -> DataFrame:
    """Adds ``gain`` and ``advantage`` for policy and oracle rows.

    Policy rows are centred on the policy mean, positive values are multiplied by the gain, and the result is
    centred again. With ``trainer`` the other variant is computed: rewards are scaled by the policy deviation
    (that of all rows where it is below ``min_std``) and the gain is 1 (G18).
    """
    w, oracle, policy = _parts(group, flag, reward)
    scale = F.lit(1.0)
    gain = directional_gain(sample_std(F.col(reward), w), sample_std(policy, w), settings)
    out = df.withColumn("gain", F.lit(1.0) if trainer else gain)
    if trainer:
        own = F.stddev_samp(policy).over(w)
        scale = F.when(own >= min_std, own).otherwise(sample_std(F.col(reward), w)) + settings.eps
    out = out.withColumn("_c", F.when(~oracle, (F.col(reward) - F.avg(policy).over(w)) / scale))
    out = out.withColumn("_t", F.when(F.col("_c") > 0, F.col("_c") * F.col("gain")).otherwise(F.col("_c")))
    out = out.withColumn("_p", F.col("_t") - F.avg("_t").over(w))
    best = F.max(F.when(F.col("_p") > 0, F.col("_p"))).over(w)
    own_reward = F.max(F.when(oracle, F.col(oracle_reward or reward))).over(w)
    gap = reward_gap(own_reward, F.avg(policy).over(w), settings)
    return out.withColumn("advantage", F.when(oracle, detached_oracle(gap, best, settings)).otherwise(F.col("_p"))).drop("_c", "_t", "_p")


def best_of_group(df: DataFrame, group: str = "uid", reward: str = "reward", row: str = "row_id", eps: float = 1e-6) -> DataFrame:
    """Adds ``advantage``: only a group's best row gets (first - second) / (std + eps) (G19); ties to the lower row."""
    w = Window.partitionBy(group)
    ranked = w.orderBy(F.col(reward).desc(), row)
    second = F.nth_value(reward, 2).over(ranked.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    lead = (F.col(reward) - second) / (sample_std(F.col(reward), w) + eps)
    return df.withColumn("advantage", F.when(F.row_number().over(ranked) == 1, lead).otherwise(0.0))


def leave_one_out(df: DataFrame, group: str = "uid", reward: str = "reward") -> DataFrame:
    """Adds ``advantage``: the reward less the mean of the group's other rows."""
    w = Window.partitionBy(group)
    others = (F.sum(reward).over(w) - F.col(reward)) / (F.count("*").over(w) - 1)
    return df.withColumn("advantage", F.col(reward) - others)


def oracle_diagnostics(
    df: DataFrame, group: str = "uid", reward: str = "reward", flag: str = "is_oracle_row", advantage: str = "advantage", min_std: float = 1e-3
) -> DataFrame:
    """One row of figures on how oracle rows move the statistics of their groups.

    Deviations are those of populations; ratios count only groups whose policy deviation reaches ``min_std``.
    Sign flips are policy rows whose advantage and plain group-relative baseline differ in sign.
    """
    w = Window.partitionBy(group)
    r, a = F.col(reward), F.col(advantage)
    plain = (r - F.avg(r).over(w)) / (sample_std(r, w) + 1e-6)
    rows = df.select(group, flag, r.alias("r"), a.alias("a"), plain.alias("plain"))
    policy = ~F.col(flag)
    groups = rows.groupBy(group).agg(
        F.avg("r").alias("mean_all"),
        F.stddev_pop("r").alias("std_all"),
        F.avg(F.when(policy, F.col("r"))).alias("mean_policy"),
        F.stddev_pop(F.when(policy, F.col("r"))).alias("std_policy"),
        F.count(F.when(policy & (F.signum("a") != F.signum("plain")), 1)).alias("flips"),
        F.count(F.when(policy, 1)).alias("policy_rows"),
        F.count(F.when(policy & (F.col("plain") > 0), 1)).alias("positive"),
        F.sum(F.when(policy, F.abs("a"))).alias("policy_abs"),
        F.sum(F.when(~policy, F.abs("a"))).alias("oracle_abs"),
        F.count(F.when(~policy, 1)).alias("oracle_rows"),
    )
    wide = F.col("std_policy") >= min_std
    ratio = F.when(wide, F.col("std_all") / F.col("std_policy"))
    shift = F.when(wide, F.abs(F.col("mean_all") - F.col("mean_policy")) / F.col("std_policy"))
    return groups.agg(
        F.count("*").alias("groups"),
        F.avg("mean_all").alias("mean_with_oracle"),
        F.avg("mean_policy").alias("mean_without_oracle"),
        F.avg("std_all").alias("std_with_oracle"),
        F.avg("std_policy").alias("std_without_oracle"),
        F.avg(ratio).alias("std_ratio"),
        F.avg(shift).alias("contamination"),
        (F.avg("std_all") / F.avg("std_policy")).alias("ratio_of_means"),
        (F.sum("flips") / F.sum("policy_rows")).alias("sign_flip_share"),
        F.count(F.when(F.col("positive") == 0, 1)).alias("groups_without_positive"),
        (F.sum("policy_abs") / F.sum("policy_rows")).alias("policy_abs_mean"),
        (F.sum("oracle_abs") / F.sum("oracle_rows")).alias("oracle_abs_mean"),
    )


def oracle_telemetry(df: DataFrame, task: str, flag: str = "is_oracle_row", advantage: str = "advantage") -> DataFrame:
    """Oracle rows and their advantages for each task (G28); groups without an oracle do not count."""
    return df.where(F.col(flag)).groupBy(task).agg(
        F.count("*").alias("oracle_rows"), F.avg(advantage).alias("oracle_mean"), F.max(advantage).alias("oracle_max")
    )
