"""Group advantages, selection and correction against closed forms."""

import math
import statistics

import pytest
from pyspark.sql import functions as F

from spindrift.functions import tokens as tk
from spindrift.operators import advantages as adv
from spindrift.operators import correction, losses, metrics, selection


def group(spark, rewards, oracle=None, uid=1):
    rows = [(uid, i, float(r), False) for i, r in enumerate(rewards)]
    if oracle is not None:
        rows.append((uid, len(rows), float(oracle), True))
    return spark.createDataFrame(rows, "uid long, row_id long, reward double, is_oracle_row boolean")


def column(df, name):
    return [r[name] for r in df.orderBy("uid", "row_id").collect()]


@pytest.mark.parametrize("rewards", [[0, 0.5, 1, 0.5], [-2, -0.5, 0.25, 3], [0.3, 0.3, 0.3, 0.3]])
def test_grpo(spark, rewards):
    mean, std = statistics.mean(rewards), statistics.stdev(rewards)
    assert column(adv.grpo(group(spark, rewards)), "advantage") == pytest.approx([(r - mean) / (std + 1e-6) for r in rewards])


def test_grpo_needs_two_rows(spark):
    with pytest.raises(Exception, match="two rows"):
        adv.grpo(group(spark, [1])).collect()


def test_gain_centres_policy_and_leaves_the_oracle_at_zero(spark):
    df = group(spark, [0, 0.2, 0.4, 0.6], 1)
    assert column(adv.raw_center_on_policy(df), "centered") == pytest.approx([-0.3, -0.1, 0.1, 0.3, 0])
    out = column(adv.oracle_advantages(df), "advantage")
    assert sum(out[:4]) == pytest.approx(0, abs=1e-12)
    std_all, std_policy = statistics.stdev([0, 0.2, 0.4, 0.6, 1]), statistics.stdev([0, 0.2, 0.4, 0.6])
    assert column(adv.oracle_advantages(df), "gain") == pytest.approx([(std_all / (std_policy + 1e-6)) ** 0.25] * 5)


def test_gain_is_capped(spark):
    df = spark.range(1).select(adv.directional_gain(F.lit(0.5), F.lit(0.0)).alias("g"))
    assert df.first().g == 4.0


def test_detached_oracle_and_gap(spark):
    s = adv.GainSettings(oracle_scale=4.0)
    best = F.lit(0.2)
    gap = adv.reward_gap(F.lit(1.0), F.lit(0.4))
    assert spark.range(1).select(adv.detached_oracle(gap, best, s).alias("a")).first().a == pytest.approx(0.24)
    value = spark.range(1).select(adv.reward_gap(F.lit(1.0), F.lit(0.5)).alias("g")).first().g
    assert value == pytest.approx((0.5 / (1 + 1e-6)) ** 2)


def test_complete_fixture(spark):
    s = adv.GainSettings(power=0.0, oracle_scale=4.0)
    out = adv.oracle_advantages(group(spark, [0.2, 0.4, 0.6], 1), s)
    assert column(out, "advantage") == pytest.approx([-0.2, 0, 0.2, 0.24])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_group_without_oracle_is_an_error(spark):
    with pytest.raises(Exception, match="one oracle row"):
        adv.checked_groups(group(spark, [0, 1])).collect()


def selected(spark):
    values = {"a": [0.8, 0.4, -0.9, -0.3, 0], "b": [-0.9, -0.8, -0.7, 0, 0], "c": [0.7, 0, 0, 0, 0]}
    rows, i = [], 0
    for uid, xs in values.items():
        for k, a in enumerate([*xs, 0.5]):
            rows.append((uid, i, k == 5, float(a)))
            i += 1
    return spark.createDataFrame(rows, "uid string, row_id long, is_oracle_row boolean, advantage double")


def test_selection_fixture(spark):
    kept = selection.select_sign_balanced(selected(spark), keep=4, positives=1, negatives=2)
    assert sorted(r.row_id for r in kept.collect()) == [0, 2, 3, 5, 6, 7, 8, 11, 12, 13, 14, 17]
    m = selection.selection_metrics(kept).first()
    assert (m.kept, m.oracle, m.positive, m.negative, m.zero, m.cross_sign, m.zero_fill) == (12, 3, 2, 5, 2, 1, 2)
    assert selection.selection_budget(9, 0.5, 1) == (4, 1, 2)
    with pytest.raises(ValueError):
        selection.check_world(10, 4)


def corrected(spark, policy, oracle, rms, std, **options):
    rows = [("u", i, a, False) for i, a in enumerate(policy)] + [("u", len(policy), oracle, True)]
    kept = spark.createDataFrame(rows, "uid string, row_id long, advantage double, is_oracle_row boolean")
    refs = spark.createDataFrame([("u", rms, std, len(policy) + 2)], "uid string, ref_rms double, ref_std double, ref_rows long")
    return column(correction.correct_selected(kept, refs, **options), "corrected")


def test_correction_fixtures(spark):
    out = corrected(spark, [0.5, -0.3, -0.2], 0.4, 0.2, 0.1)
    assert sum(out) == pytest.approx(0, abs=1e-9)
    assert math.sqrt(sum(x * x for x in out[:3]) / 3) == pytest.approx(0.2, rel=1e-4)
    assert corrected(spark, [-0.1, 0.1], 0.05, 10.0, 1.0) == pytest.approx([-0.1 - 0.05 / 3, 0.1 - 0.05 / 3, 0.1 / 3])
    assert corrected(spark, [0.0, 0.0, 0.0], 0.4, 0.0, 0.0) == pytest.approx([-0.1, -0.1, -0.1, 0.3])


def test_projection_fixture(spark):
    out = corrected(spark, [0.8, 0.2, -0.1], 0.1, 0.5, 0.2, match_rms=False)
    assert out == pytest.approx([0.5, -0.1, -0.4, 0.0])


def test_missing_reference_is_an_error(spark):
    kept = selected(spark)
    refs = correction.pre_selection_references(kept.withColumn("reward", F.col("advantage"))).where("uid = 'a'")
    with pytest.raises(Exception, match="no reference"):
        correction.correct_selected(kept, refs).collect()


def test_token_folds(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0], [0.5, 0.5, 0.5, 0.5], [1, 1, 0, 1])], "r array<double>, v array<double>, m array<int>")
    row = df.select(
        tk.discounted_returns(F.col("r"), F.col("m"), 0.5).alias("d"), tk.returns_to_go(F.col("r"), F.col("m")).alias("g"),
        tk.gae(F.col("r"), F.col("v"), F.col("m"), 0.9, 0.8).alias("a"), tk.masked_row_mean(F.col("r"), F.col("m")).alias("mean"),
        tk.mask_after_end(F.array(F.lit(5), F.lit(2), F.lit(7)), [2]).alias("e"),
        tk.shape_sequence(F.array(F.lit(1), F.lit(2)), 4, 0, left=True).alias("p"),
    ).first()
    assert row.d == [2.0, 2.0, 5.0, 4.0]
    assert row.g == [7.0, 6.0, 4.0, 4.0]
    last = 4 - 0.5
    second = (2 + 0.9 * 0.5 - 0.5) + 0.72 * last
    assert row.a[3] == pytest.approx(last) and row.a[1] == pytest.approx(second)
    assert row.a[0] == pytest.approx((1 + 0.9 * 0.5 - 0.5) + 0.72 * second)
    assert row["mean"] == pytest.approx(7 / 3) and list(row.e) == [1, 1, 0] and list(row.p) == [0, 0, 1, 2]


def test_dual_clip_and_penalties(spark):
    row = spark.range(1).select(
        losses.policy_token_loss(F.lit(2.0), F.lit(0.0), F.lit(-1.0)).alias("dual"),
        losses.policy_token_loss(F.lit(2.0), F.lit(0.0), F.lit(1.0)).alias("clip"),
        losses.kl_penalty(F.lit(0.0), F.lit(50.0), "low_var_kl").alias("kl"),
        losses.oracle_reward_control(F.lit(0.8), F.lit(True), 2.0, 1.0).alias("cap"),
    ).first()
    assert (row.dual, row.clip, row.kl, row.cap) == (3.0, -1.2, 10.0, 1.0)


def test_moving_average_needs_a_full_window(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([1.0, 2.0, 3.0, 3.0, 9.0])], "step long, value double")
    out = [(r.average, r.is_best) for r in metrics.best_checkpoints(df, 2, 2).orderBy("step").collect()]
    assert out == [(None, False), (None, False), (2.5, True), (3.0, True), (6.0, True)]
