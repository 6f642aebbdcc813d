"""Post-selection correction of advantages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pre_selection_references(
    df: DataFrame, group: str = "uid", reward: str = "reward", flag: str = "is_oracle_row", advantage: str = "advantage"
) -> DataFrame:
    """Per group: RMS of policy advantages, sample deviation of policy rewards, policy rows."""
    policy = ~F.col(flag)
    a = F.when(policy, F.col(advantage))
    return df.groupBy(group).agg(
        F.sqrt(F.avg(a * a)).alias("ref_rms"),
        F.coalesce(F.stddev_samp(F.when(policy, F.col(reward))), F.lit(0.0)).alias("ref_std"),
        F.count(F.when(policy, 1)).alias("ref_rows"),
    )


def correct_selected(
    kept: DataFrame,
    references: DataFrame,
    group: str = "uid",
    flag: str = "is_oracle_row",
    advantage: str = "advantage",
    match_rms: bool = True,
    min_std: float = 1e-3,
    eps: float = 1e-6,
    low: float = 0.25,
    skip_untouched: bool = False,
) -> DataFrame:
    """Adds ``corrected`` (G16): centred, with a non-negative oracle, and never wider than before selection.

    A negative oracle value is raised to 0 and the difference is taken from the policy rows in equal parts. Where
    the policy rewards were wide enough, all rows are scaled by clip(ref / (rms + eps), low, 1) of the policy RMS.
    A group without references is an error; with ``skip_untouched`` (the other variant) groups without an oracle
    row, or that lost no row, are left alone.
    """
    w = Window.partitionBy(group)
    joined = kept.join(references, group, "left")
    missing = F.raise_error(F.lit("a selected group has no reference")).cast("double")
    policy = ~F.col(flag)
    out = joined.withColumn("_rms", F.when(F.col("ref_rows").isNull(), missing).otherwise(F.col("ref_rms")))
    out = out.withColumn("_c", F.col(advantage) - F.avg(advantage).over(w))
    out = out.withColumn("_o", F.max(F.when(F.col(flag), F.col("_c"))).over(w))
    out = out.withColumn("_n", F.count(F.when(policy, 1)).over(w))
    deficit = F.greatest(F.lit(0.0), -F.coalesce("_o", F.lit(0.0)))
    lifted = F.when(F.col(flag), F.greatest(F.lit(0.0), F.col("_c"))).otherwise(F.col("_c") - deficit / F.col("_n"))
    out = out.withColumn("_l", lifted)
    out = out.withColumn("_now", F.sqrt(F.avg(F.when(policy, F.col("_l") * F.col("_l"))).over(w)))
    ratio = F.least(F.lit(1.0), F.greatest(F.lit(low), F.col("_rms") / (F.col("_now") + eps)))
    wide = (F.col("ref_std") >= min_std) & (F.col("_now") > eps)
    scale = F.when(wide, ratio).otherwise(1.0) if match_rms else F.lit(1.0) + 0 * F.col("_rms")
    corrected = F.col("_l") * scale
    if skip_untouched:
        whole = (F.sum(F.col(flag).cast("int")).over(w) == 0) | (F.col("_n") == F.col("ref_rows"))
        corrected = F.when(whole, F.col(advantage)).otherwise(corrected)
    return out.withColumn("corrected", corrected).drop("_rms", "_c", "_o", "_n", "_l", "_now")
