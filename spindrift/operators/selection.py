"""Sign-balanced selection of rollouts (G14) and the budgets that it keeps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def selection_budget(rollouts: int, prune: float, positives: int) -> tuple[int, int, int]:
    """(keep, positives, negatives) so that both and the oracle fill int(n * (1 - prune)) rows."""
    keep = int(rollouts * (1 - prune))
    negatives = keep - positives - 1
    if not 0 <= prune < 1 or positives < 0 or negatives < 0:
        raise ValueError("the budget must hold the oracle row and both quotas")
    return keep, positives, negatives


def select_sign_balanced(
    df: DataFrame,
    keep: int = 4,
    positives: int = 1,
    negatives: int = 2,
    group: str = "uid",
    row: str = "row_id",
    flag: str = "is_oracle_row",
    advantage: str = "advantage",
) -> DataFrame:
    """Rows kept of every group, with ``tier`` and ``pick`` (their place in the group's order).

    The oracle is first, then the strongest positive and negative rows up to their quotas, then other rows of
    either sign by strength, then zero rows. Ties go to the lower row. One exchange on the group serves both
    windows, and the final filter is planned as a group limit.
    """
    a = F.col(advantage)
    strength = F.when(F.col(flag), 0.0).otherwise(F.abs(a))
    placed = df.repartition(group).withColumn("_s", F.signum(a))
    own = Window.partitionBy(group, flag, "_s").orderBy(strength.desc(), row)
    placed = placed.withColumn("_r", F.row_number().over(own))
    first = ((F.col("_s") > 0) & (F.col("_r") <= positives)) | ((F.col("_s") < 0) & (F.col("_r") <= negatives))
    tier = F.when(F.col(flag), -1).when(first, 0).when(F.col("_s") != 0, 1).otherwise(2)
    placed = placed.withColumn("tier", tier)
    order = Window.partitionBy(group).orderBy("tier", strength.desc(), row)
    return placed.withColumn("pick", F.row_number().over(order)).where(F.col("pick") <= keep).drop("_s", "_r")


def selection_metrics(kept: DataFrame, flag: str = "is_oracle_row", advantage: str = "advantage") -> DataFrame:
    """Counts over selected rows: kept, oracle, positive, negative and zero rows, and how they were filled."""
    a, policy = F.col(advantage), ~F.col(flag)
    count = lambda c: F.count(F.when(c, 1))
    return kept.agg(
        F.count("*").alias("kept"),
        count(F.col(flag)).alias("oracle"),
        count(policy & (a > 0)).alias("positive"),
        count(policy & (a < 0)).alias("negative"),
        count(policy & (a == 0)).alias("zero"),
        count(F.col("tier") == 1).alias("cross_sign"),
        count(F.col("tier") == 2).alias("zero_fill"),
    )


def check_world(kept_rows: int, world_size: int) -> None:
    if kept_rows % world_size:
        raise ValueError(f"{kept_rows} kept rows do not divide into {world_size} workers")
