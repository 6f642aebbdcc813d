"""Registered queries on rollout groups, token columns, losses and metrics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from spindrift.functions import tokens as tk
from spindrift.operators import advantages as adv
from spindrift.operators import correction, losses, metrics, selection
from spindrift.plans.tables import ROLLOUTS, TOKENS, exploded, rollouts, token_rows

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def six(*names: str):
    return [F.round(F.col(n), 6).alias(n) for n in names]


# One statement serves the oracle of every query on oracle advantages.
ADVANTAGES = ROLLOUTS + """,
g AS (SELECT *, avg(CASE WHEN NOT is_oracle_row THEN reward END) OVER w AS mu,
  least(4.0, greatest(1.0, pow(coalesce(stddev_samp(reward) OVER w, 0) /
    (coalesce(stddev_samp(CASE WHEN NOT is_oracle_row THEN reward END) OVER w, 0) + 1e-6), 0.25))) AS gain,
  max(CASE WHEN is_oracle_row THEN reward END) OVER w AS ro FROM r WINDOW w AS (PARTITION BY uid)),
c AS (SELECT *, CASE WHEN NOT is_oracle_row THEN reward - mu END AS c FROM g),
t AS (SELECT *, CASE WHEN c > 0 THEN c * gain ELSE c END AS t FROM c),
p AS (SELECT *, t - avg(t) OVER (PARTITION BY uid) AS p FROM t),
b AS (SELECT *, max(CASE WHEN p > 0 THEN p END) OVER (PARTITION BY uid) AS best FROM p),
a AS (SELECT uid, row_id, reward, is_oracle_row, task, gain, CASE WHEN is_oracle_row THEN
  least(2.0 * pow(least(1.0, greatest(0.0, (ro - mu) / (ro + 1e-6))), 2), least(1.0, greatest(0.05, coalesce(1.2 * best, 0.05))))
  ELSE p END AS advantage FROM b)"""

PICKS = ADVANTAGES + """,
s AS (SELECT *, CASE WHEN is_oracle_row THEN 0 ELSE abs(advantage) END AS str, sign(advantage) AS sg FROM a),
o AS (SELECT *, row_number() OVER (PARTITION BY uid, is_oracle_row, sg ORDER BY str DESC, row_id) AS rr FROM s),
q AS (SELECT *, CASE WHEN is_oracle_row THEN -1 WHEN (sg > 0 AND rr <= 1) OR (sg < 0 AND rr <= 2) THEN 0
  WHEN sg <> 0 THEN 1 ELSE 2 END AS tier FROM o),
z AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY tier, str DESC, row_id) AS pick FROM q),
sel AS (SELECT * FROM z WHERE pick <= 4)"""


@query("g2_sequence_rewards", f"WITH {TOKENS} SELECT row_id, round(sum(reward * mask), 6) AS total FROM k GROUP BY row_id")
def _(spark, d):
    return token_rows(spark, d).select("row_id", F.round(tk.masked_sum(F.col("reward_tokens"), F.col("mask")), 6).alias("total"))


@query("g3_sequence_advantages", f"WITH {TOKENS} SELECT row_id, round(sum(reward * mask) / sum(mask), 6) AS mean FROM k GROUP BY row_id")
def _(spark, d):
    return token_rows(spark, d).select("row_id", F.round(tk.masked_row_mean(F.col("reward_tokens"), F.col("mask")), 6).alias("mean"))


@query(
    "g4_broadcast",
    f"WITH {TOKENS} SELECT row_id, pos, CAST(round(mask * (row_id % 7) * 0.25, 6) AS DOUBLE) AS value FROM k",
)
def _(spark, d):
    out = token_rows(spark, d).withColumn("value", tk.spread((F.col("row_id") % 7) * 0.25, F.col("mask")))
    return exploded(out, "value").select("row_id", "pos", *six("value"))


@query(
    "g6_grpo",
    f"WITH {ROLLOUTS} SELECT uid, row_id, round((reward - avg(reward) OVER w) / (coalesce(stddev_samp(reward) OVER w, 0) + 1e-6), 6) AS advantage FROM r WINDOW w AS (PARTITION BY uid)",
)
def _(spark, d):
    return adv.grpo(rollouts(spark, d)).select("uid", "row_id", *six("advantage"))


@query(
    "g6_grpo_centered",
    f"WITH {ROLLOUTS} SELECT uid, row_id, round(reward - avg(reward) OVER (PARTITION BY uid), 12) AS advantage FROM r",
)
def _(spark, d):
    return adv.grpo(rollouts(spark, d), normalize=False).select("uid", "row_id", F.round("advantage", 12).alias("advantage"))


@query(
    "g7_raw_center",
    f"WITH {ROLLOUTS} SELECT uid, row_id, round(CASE WHEN is_oracle_row THEN 0 ELSE reward - avg(CASE WHEN NOT is_oracle_row THEN reward END) OVER (PARTITION BY uid) END, 6) AS centered FROM r",
)
def _(spark, d):
    checked = adv.checked_groups(rollouts(spark, d))
    return adv.raw_center_on_policy(checked).select("uid", "row_id", *six("centered"))


@query("g8_directional_gain", f"WITH {ADVANTAGES} SELECT DISTINCT uid, round(gain, 6) AS gain FROM a")
def _(spark, d):
    return adv.oracle_advantages(rollouts(spark, d)).select("uid", *six("gain")).distinct()


@query(
    "g10_policy_advantages",
    f"WITH {ADVANTAGES} SELECT uid, row_id, round(advantage, 6) AS advantage FROM a WHERE NOT is_oracle_row",
)
def _(spark, d):
    return adv.oracle_advantages(rollouts(spark, d)).where("NOT is_oracle_row").select("uid", "row_id", *six("advantage"))


@query("g12_detached_oracle", f"WITH {ADVANTAGES} SELECT uid, round(advantage, 6) AS advantage FROM a WHERE is_oracle_row")
def _(spark, d):
    return adv.oracle_advantages(rollouts(spark, d)).where("is_oracle_row").select("uid", *six("advantage"))


@query("g13_advantages", f"WITH {ADVANTAGES} SELECT uid, row_id, is_oracle_row, round(gain, 6) AS gain, round(advantage, 6) AS advantage FROM a")
def _(spark, d):
    return adv.oracle_advantages(rollouts(spark, d)).select("uid", "row_id", "is_oracle_row", *six("gain", "advantage"))


@query(
    "g14_selection",
    f"WITH {PICKS} SELECT uid, row_id, CAST(tier AS INTEGER) AS tier, CAST(pick AS INTEGER) AS pick FROM sel",
)
def _(spark, d):
    kept = selection.select_sign_balanced(adv.oracle_advantages(rollouts(spark, d)))
    return kept.select("uid", "row_id", "tier", "pick")


@query(
    "g14_selection_metrics",
    f"""WITH {PICKS} SELECT count(*) AS kept, count(*) FILTER (is_oracle_row) AS oracle,
    count(*) FILTER (NOT is_oracle_row AND advantage > 0) AS positive, count(*) FILTER (NOT is_oracle_row AND advantage < 0) AS negative,
    count(*) FILTER (NOT is_oracle_row AND advantage = 0) AS zero, count(*) FILTER (tier = 1) AS cross_sign,
    count(*) FILTER (tier = 2) AS zero_fill FROM sel""",
)
def _(spark, d):
    return selection.selection_metrics(selection.select_sign_balanced(adv.oracle_advantages(rollouts(spark, d))))


REFERENCES = """ref AS (SELECT uid, sqrt(avg(CASE WHEN NOT is_oracle_row THEN advantage * advantage END)) AS ref_rms,
  coalesce(stddev_samp(CASE WHEN NOT is_oracle_row THEN reward END), 0) AS ref_std,
  count(*) FILTER (NOT is_oracle_row) AS ref_rows FROM a GROUP BY uid)"""


@query("g15_references", f"WITH {ADVANTAGES}, {REFERENCES} SELECT uid, round(ref_rms, 6) AS ref_rms, round(ref_std, 6) AS ref_std, ref_rows FROM ref")
def _(spark, d):
    refs = correction.pre_selection_references(adv.oracle_advantages(rollouts(spark, d)))
    return refs.select("uid", *six("ref_rms", "ref_std"), "ref_rows")


@query(
    "g16_correction",
    f"""WITH {PICKS}, {REFERENCES},
    m AS (SELECT sel.*, ref_rms, ref_std, advantage - avg(advantage) OVER (PARTITION BY sel.uid) AS cc FROM sel JOIN ref ON sel.uid = ref.uid),
    n AS (SELECT *, max(CASE WHEN is_oracle_row THEN cc END) OVER w AS oc, count(*) FILTER (NOT is_oracle_row) OVER w AS pn FROM m WINDOW w AS (PARTITION BY uid)),
    l AS (SELECT *, CASE WHEN is_oracle_row THEN greatest(0, cc) ELSE cc - greatest(0, -coalesce(oc, 0)) / pn END AS l FROM n),
    x AS (SELECT *, sqrt(avg(CASE WHEN NOT is_oracle_row THEN l * l END) OVER (PARTITION BY uid)) AS now FROM l)
    SELECT uid, row_id, round(l * CASE WHEN ref_std >= 1e-3 AND now > 1e-6 THEN least(1.0, greatest(0.25, ref_rms / (now + 1e-6))) ELSE 1 END, 6) AS corrected FROM x""",
)
def _(spark, d):
    scored = adv.oracle_advantages(rollouts(spark, d))
    kept = selection.select_sign_balanced(scored)
    fixed = correction.correct_selected(kept, correction.pre_selection_references(scored))
    return fixed.select("uid", "row_id", *six("corrected"))


@query(
    "g17_diagnostics",
    f"""WITH {ADVANTAGES}, pl AS (SELECT *, (reward - avg(reward) OVER w) / (coalesce(stddev_samp(reward) OVER w, 0) + 1e-6) AS plain FROM a WINDOW w AS (PARTITION BY uid)),
    gr AS (SELECT uid, avg(reward) AS ma, stddev_pop(reward) AS sa, avg(reward) FILTER (NOT is_oracle_row) AS mp, stddev_pop(reward) FILTER (NOT is_oracle_row) AS sp,
      count(*) FILTER (NOT is_oracle_row AND sign(advantage) <> sign(plain)) AS fl, count(*) FILTER (NOT is_oracle_row) AS np,
      count(*) FILTER (NOT is_oracle_row AND plain > 0) AS pos, sum(abs(advantage)) FILTER (NOT is_oracle_row) AS pa,
      sum(abs(advantage)) FILTER (is_oracle_row) AS oa, count(*) FILTER (is_oracle_row) AS no FROM pl GROUP BY uid)
    SELECT count(*) AS groups, round(avg(ma), 6) AS mean_with_oracle, round(avg(mp), 6) AS mean_without_oracle, round(avg(sa), 6) AS std_with_oracle,
      round(avg(sp), 6) AS std_without_oracle, round(avg(CASE WHEN sp >= 1e-3 THEN sa / sp END), 6) AS std_ratio,
      round(avg(CASE WHEN sp >= 1e-3 THEN abs(ma - mp) / sp END), 6) AS contamination, round(avg(sa) / avg(sp), 6) AS ratio_of_means,
      round(sum(fl) / sum(np), 6) AS sign_flip_share, count(*) FILTER (pos = 0) AS groups_without_positive,
      round(sum(pa) / sum(np), 6) AS policy_abs_mean, round(sum(oa) / sum(no), 6) AS oracle_abs_mean FROM gr""",
)
def _(spark, d):
    out = adv.oracle_diagnostics(adv.oracle_advantages(rollouts(spark, d)))
    return out.select(*[F.col(c) if c.startswith("groups") else F.round(c, 6).alias(c) for c in out.columns])


@query(
    "g18_trainer_advantages",
    f"""WITH {ROLLOUTS}, g AS (SELECT *, avg(reward) FILTER (NOT is_oracle_row) OVER w AS mu, stddev_samp(reward) FILTER (NOT is_oracle_row) OVER w AS sp,
      stddev_samp(reward) OVER w AS sa, max(reward) FILTER (is_oracle_row) OVER w AS ro FROM r WINDOW w AS (PARTITION BY uid)),
    c AS (SELECT *, CASE WHEN NOT is_oracle_row THEN (reward - mu) / (CASE WHEN sp >= 1e-3 THEN sp ELSE coalesce(sa, 0) END + 1e-6) END AS c FROM g),
    p AS (SELECT *, c - avg(c) OVER (PARTITION BY uid) AS p FROM c),
    b AS (SELECT *, max(CASE WHEN p > 0 THEN p END) OVER (PARTITION BY uid) AS best FROM p)
    SELECT uid, row_id, round(CASE WHEN is_oracle_row THEN least(2.0 * pow(least(1.0, greatest(0.0, (ro - mu) / (ro + 1e-6))), 2),
      least(1.0, greatest(0.05, coalesce(1.2 * best, 0.05)))) ELSE p END, 6) AS advantage FROM b""",
)
def _(spark, d):
    return adv.oracle_advantages(rollouts(spark, d), trainer=True).select("uid", "row_id", *six("advantage"))


@query(
    "g19_pass_at_k",
    f"""WITH {ROLLOUTS}, o AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY reward DESC, row_id) AS k,
      lead(reward) OVER (PARTITION BY uid ORDER BY reward DESC, row_id) AS nxt, coalesce(stddev_samp(reward) OVER (PARTITION BY uid), 0) AS s FROM r)
    SELECT uid, row_id, round(CASE WHEN k = 1 THEN (reward - nxt) / (s + 1e-6) ELSE 0 END, 6) AS advantage FROM o""",
)
def _(spark, d):
    return adv.best_of_group(rollouts(spark, d)).select("uid", "row_id", *six("advantage"))


@query(
    "g20_leave_one_out",
    f"WITH {ROLLOUTS} SELECT uid, row_id, round(reward - (sum(reward) OVER w - reward) / (count(*) OVER w - 1), 12) AS advantage FROM r WINDOW w AS (PARTITION BY uid)",
)
def _(spark, d):
    return adv.leave_one_out(rollouts(spark, d)).select("uid", "row_id", F.round("advantage", 12).alias("advantage"))


@query(
    "g21_discounted_returns",
    f"""WITH RECURSIVE {TOKENS}, f AS (SELECT row_id, pos, reward AS ret, mask, reward * mask AS run FROM k WHERE pos = 64
      UNION ALL SELECT k.row_id, k.pos, k.reward + 0.9 * f.run, k.mask, (k.reward + 0.9 * f.run) * k.mask FROM f JOIN k ON k.row_id = f.row_id AND k.pos = f.pos - 1)
    SELECT row_id, pos, round(ret, 6) AS ret FROM f""",
)
def _(spark, d):
    out = token_rows(spark, d).withColumn("ret", tk.discounted_returns(F.col("reward_tokens"), F.col("mask"), 0.9))
    return exploded(out, "ret").select("row_id", "pos", *six("ret"))


WHITE = """st AS (SELECT sum(mask) AS n, sum({v} * mask) AS s, sum({v} * {v} * mask) AS q FROM {t}),
 mo AS (SELECT n, s / (n + 1e-8) AS mu, (q - 2 * (s / (n + 1e-8)) * s + pow(s / (n + 1e-8), 2) * n) / (n + 1e-8) * n / (n - 1) AS var FROM st)"""


@query(
    "g21_reinforce_advantages",
    f"""WITH RECURSIVE {TOKENS}, f AS (SELECT row_id, pos, reward AS ret, mask, reward * mask AS run FROM k WHERE pos = 64
      UNION ALL SELECT k.row_id, k.pos, k.reward + 0.9 * f.run, k.mask, (k.reward + 0.9 * f.run) * k.mask FROM f JOIN k ON k.row_id = f.row_id AND k.pos = f.pos - 1),
    {WHITE.format(v="ret", t="f")} SELECT row_id, pos, round((ret - mu) / sqrt(var + 1e-8) * mask, 6) AS advantage FROM f, mo""",
)
def _(spark, d):
    out = token_rows(spark, d).withColumn("ret", tk.discounted_returns(F.col("reward_tokens"), F.col("mask"), 0.9))
    white = metrics.whiten(exploded(out, "ret", "mask"), "ret")
    return white.select("row_id", "pos", F.round(F.col("whitened") * F.col("mask"), 6).alias("advantage"))


@query(
    "g22_remax",
    f"""WITH {TOKENS}, s AS (SELECT *, sum(reward * mask) OVER (PARTITION BY row_id) AS total,
      sum(reward * mask) OVER (PARTITION BY row_id ORDER BY pos DESC) AS ret FROM k)
    SELECT row_id, pos, round((total - 0.01 * uid) * mask, 6) AS advantage, round(ret, 6) AS ret FROM s""",
)
def _(spark, d):
    rows = token_rows(spark, d)
    sum_ = tk.masked_sum(F.col("reward_tokens"), F.col("mask"))
    out = rows.withColumn("advantage", tk.spread(sum_ - 0.01 * F.col("uid"), F.col("mask"))).withColumn(
        "ret", tk.returns_to_go(F.col("reward_tokens"), F.col("mask"))
    )
    return exploded(out, "advantage", "ret").select("row_id", "pos", *six("advantage", "ret"))


GAE = TOKENS + """, f AS (SELECT row_id, pos, mask, CASE WHEN mask > 0 THEN value ELSE 0 END AS nv,
      CASE WHEN mask > 0 THEN reward - value ELSE 0 END AS run FROM k WHERE pos = 64
    UNION ALL SELECT k.row_id, k.pos, k.mask, CASE WHEN k.mask > 0 THEN k.value ELSE f.nv END,
      CASE WHEN k.mask > 0 THEN k.reward + 0.99 * f.nv - k.value + 0.99 * 0.95 * f.run ELSE f.run END
    FROM f JOIN k ON k.row_id = f.row_id AND k.pos = f.pos - 1)"""


@query("g23_gae", f"WITH RECURSIVE {GAE} SELECT row_id, pos, round(run, 6) AS advantage FROM f WHERE mask > 0")
def _(spark, d):
    rows = token_rows(spark, d)
    out = rows.withColumn("advantage", tk.gae(F.col("reward_tokens"), F.col("value_tokens"), F.col("mask"), 0.99, 0.95))
    return exploded(out, "advantage", "mask").where("mask > 0").select("row_id", "pos", *six("advantage"))


@query(
    "g24_whiten",
    f"WITH {TOKENS}, {WHITE.format(v='reward', t='k')} SELECT row_id, pos, round((reward - mu) / sqrt(var + 1e-8), 6) AS whitened FROM k, mo WHERE mask > 0",
)
def _(spark, d):
    rows = exploded(token_rows(spark, d), "reward_tokens", "mask")
    return metrics.whiten(rows, "reward_tokens").where("mask > 0").select("row_id", "pos", *six("whitened"))


@query(
    "g25_best_checkpoint",
    """WITH v AS (SELECT CAST(floor(epoch(ts) / 3600) AS BIGINT) AS step, avg(value) AS value FROM events GROUP BY 1),
    m AS (SELECT step, CASE WHEN count(value) OVER w = 3 AND step >= 5 THEN avg(value) OVER w END AS average FROM v WINDOW w AS (ORDER BY step ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))
    SELECT step, round(average, 6) AS average, coalesce(average > coalesce(max(average) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1e300), false) AS is_best FROM m""",
)
def _(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet")
    history = events.groupBy(F.floor(F.unix_timestamp("ts") / 3600).cast("long").alias("step")).agg(F.avg("value").alias("value"))
    return metrics.best_checkpoints(history, window=3, min_step=5).select("step", *six("average"), "is_best")


@query(
    "g26_response_mask",
    f"""WITH {TOKENS}, e AS (SELECT row_id, min(pos) FILTER (token = 2) AS first FROM k GROUP BY row_id)
    SELECT k.row_id, CAST(count(*) FILTER (first IS NULL OR pos <= first) AS BIGINT) AS live, coalesce(max(first), 0) AS first_end FROM k JOIN e ON k.row_id = e.row_id GROUP BY k.row_id""",
)
def _(spark, d):
    mask = tk.mask_after_end(F.col("tokens"), [2])
    first = F.array_position("tokens", 2)
    return token_rows(spark, d).select("row_id", tk.total(mask).cast("long").alias("live"), first.cast("long").alias("first_end"))


@query("g27_finite_metrics", "SELECT event_id, CASE WHEN value > 480 OR value < 1 THEN 0 ELSE value END AS metric FROM events")
def _(spark, d):
    raw = F.when(F.col("value") > 480, float("inf")).when(F.col("value") < 1, float("nan")).otherwise(F.col("value"))
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", metrics.finite_or_zero(raw).alias("metric"))


@query(
    "g28_oracle_by_task",
    f"WITH {ADVANTAGES} SELECT task, count(*) AS oracle_rows, round(avg(advantage), 6) AS oracle_mean, round(max(advantage), 6) AS oracle_max FROM a WHERE is_oracle_row GROUP BY task",
)
def _(spark, d):
    out = adv.oracle_telemetry(adv.oracle_advantages(rollouts(spark, d)), "task")
    return out.select("task", "oracle_rows", *six("oracle_mean", "oracle_max"))


KL = TOKENS + ", q AS (SELECT row_id, pos, mask, reward AS lp, reward * 0.8 - 0.05 AS ref FROM k)"


def _log_probs(spark, d):
    rows = exploded(token_rows(spark, d), "reward_tokens", "mask")
    lp = F.col("reward_tokens")
    return rows.select("row_id", "pos", "mask", lp.alias("lp"), (lp * 0.8 - 0.05).alias("ref"))


@query(
    "l1_kl",
    f"""WITH {KL} SELECT row_id, pos, round(lp - ref, 6) AS kl, round(abs(lp - ref), 6) AS abs, round(0.5 * (lp - ref) * (lp - ref), 6) AS mse,
    round(least(10.0, greatest(-10.0, exp(least(20.0, greatest(-20.0, ref - lp))) - least(20.0, greatest(-20.0, ref - lp)) - 1)), 6) AS low_var_kl FROM q""",
)
def _(spark, d):
    kinds = ("kl", "abs", "mse", "low_var_kl")
    return _log_probs(spark, d).select("row_id", "pos", *[F.round(losses.kl_penalty(F.col("lp"), F.col("ref"), k), 6).alias(k) for k in kinds])


@query("l2_rewards", f"WITH {KL} SELECT row_id, pos, round(mask - 0.1 * (lp - ref), 6) AS reward FROM q")
def _(spark, d):
    p = losses.penalized_reward(F.col("mask"), F.col("lp"), F.col("ref"), 0.1)
    return _log_probs(spark, d).select("row_id", "pos", F.round(p, 6).alias("reward"))


@query(
    "l3_adaptive_kl",
    """WITH RECURSIVE s AS (SELECT CAST(day(ts) AS BIGINT) AS step, avg(value) / 500 AS kl, count(*) AS n FROM events GROUP BY 1),
    o AS (SELECT *, row_number() OVER (ORDER BY step) AS i FROM s),
    f AS (SELECT step, i, CAST(0.05 AS DOUBLE) AS beta, 0.05 * (1 + least(0.2, greatest(-0.2, kl / 0.4 - 1)) * n / 10000.0) AS next FROM o WHERE i = 1
      UNION ALL SELECT o.step, o.i, f.next, f.next * (1 + least(0.2, greatest(-0.2, o.kl / 0.4 - 1)) * o.n / 10000.0) FROM f JOIN o ON o.i = f.i + 1)
    SELECT step, round(beta, 6) AS beta, round(next, 6) AS next FROM f""",
)
def _(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet")
    steps = events.groupBy(F.dayofmonth("ts").cast("long").alias("step")).agg((F.avg("value") / 500).alias("kl"), F.count("*").alias("n"))
    return losses.adaptive_coefficients(steps, 0.05, 0.4, 10_000).select("step", *six("beta", "next"))


@query("l4_average_loss", f"WITH {KL}, m AS (SELECT row_id, sum(lp * mask) / (sum(mask) + 1e-8) AS mean FROM q GROUP BY row_id) SELECT round((SELECT sum(lp * mask) / (sum(mask) + 1e-8) FROM q), 6) AS token, round(avg(mean), 6) AS seq FROM m")
def _(spark, d):
    rows = _log_probs(spark, d).withColumn("loss", F.col("lp"))
    by_token = losses.average_loss(rows).select(F.round("loss", 6).alias("token"))
    return by_token.crossJoin(losses.average_loss(rows, mode="seq").select(F.round("loss", 6).alias("seq")))  # one row each


@query(
    "l5_policy_loss",
    f"""WITH {KL}, w AS (SELECT *, exp(least(20.0, greatest(-20.0, lp - ref))) AS ratio, sum((lp - ref) * mask) OVER (PARTITION BY row_id) / sum(mask) OVER (PARTITION BY row_id) AS sh,
      row_id % 5 - 2.0 AS a FROM q), x AS (SELECT *, exp(least(20.0, greatest(-20.0, sh))) AS sr FROM w)
    SELECT row_id, pos,
      round(CASE WHEN a < 0 THEN least(greatest(-a * ratio, -a * least(1.2, greatest(0.8, ratio))), -a * 3.0) ELSE greatest(-a * ratio, -a * least(1.2, greatest(0.8, ratio))) END, 6) AS plain,
      round(CASE WHEN a < 0 THEN least(greatest(-a * sr, -a * least(1.2, greatest(0.8, sr))), -a * 3.0) ELSE greatest(-a * sr, -a * least(1.2, greatest(0.8, sr))) END, 6) AS gspo,
      round(-a * least(1.2, greatest(0.8, ratio)) * lp, 6) AS cispo FROM x""",
)
def _(spark, d):
    w = Window.partitionBy("row_id")
    rows = _log_probs(spark, d)
    shift = F.sum((F.col("lp") - F.col("ref")) * F.col("mask")).over(w) / F.sum("mask").over(w)
    rows = rows.withColumn("sh", shift).withColumn("a", F.col("row_id") % 5 - 2.0)
    loss = lambda kind: F.round(losses.policy_token_loss(F.col("lp"), F.col("ref"), F.col("a"), kind=kind, sequence_shift=F.col("sh")), 6)
    return rows.select("row_id", "pos", loss("default").alias("plain"), loss("gspo").alias("gspo"), loss("cispo").alias("cispo"))


@query(
    "l6_value_loss",
    f"""WITH {TOKENS} SELECT row_id, pos, round(0.5 * greatest(pow(value - reward, 2), pow(least(0.1 + 0.05, greatest(0.1 - 0.05, value)) - reward, 2)), 6) AS loss FROM k""",
)
def _(spark, d):
    rows = exploded(token_rows(spark, d), "reward_tokens", "value_tokens")
    loss = losses.value_token_loss(F.col("value_tokens"), F.col("reward_tokens"), F.lit(0.1), 0.05)
    return rows.select("row_id", "pos", F.round(loss, 6).alias("loss"))


@query(
    "l7_micro_batch_weight",
    f"WITH {TOKENS}, u AS (SELECT uid, sum(mask) AS units FROM k GROUP BY uid) SELECT uid, round(units * 4.0 / sum(units) OVER (), 6) AS weight FROM u",
)
def _(spark, d):
    units = token_rows(spark, d).groupBy("uid").agg(F.sum(tk.total(F.col("mask"))).alias("units"))
    all_ = units.agg(F.sum("units").alias("all"))  # one row
    return units.crossJoin(F.broadcast(all_)).select("uid", F.round(losses.micro_batch_weight(F.col("units"), 4, F.col("all")), 6).alias("weight"))


@query("l8_oracle_control", f"WITH {ROLLOUTS} SELECT uid, row_id, round(CASE WHEN is_oracle_row THEN least(reward * 1.5, 0.9) ELSE reward END, 6) AS reward FROM r")
def _(spark, d):
    r = losses.oracle_reward_control(F.col("reward"), F.col("is_oracle_row"), 1.5, 0.9)
    return rollouts(spark, d).select("uid", "row_id", F.round(r, 6).alias("reward"))


@query("a13_reduce_metrics", "SELECT metric, round(avg(value), 6) AS value FROM (SELECT 'value' AS metric, value FROM events UNION ALL SELECT 'user', user_id FROM events) GROUP BY metric")
def _(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet")
    rows = events.select(F.create_map(F.lit("value"), F.col("value"), F.lit("user"), F.col("user_id").cast("double")).alias("metrics"))
    return metrics.reduce_metrics(rows).select("metric", *six("value"))


@query("a14_length_metrics", "SELECT avg(vec_id % 16 + 8) AS mean, max(vec_id % 16 + 8) AS max, min(vec_id % 16 + 8) AS min, round(avg(CASE WHEN vec_id % 16 + 8 = 23 THEN 1.0 ELSE 0.0 END), 6) AS clip_ratio FROM embeddings")
def _(spark, d):
    out = metrics.length_metrics(token_rows(spark, d).withColumn("length", F.col("length").cast("long")), "length", 23)
    return out.select("mean", "max", "min", *six("clip_ratio"))


@query(
    "a15_value_metrics",
    f"""WITH {TOKENS} SELECT round(avg(reward), 6) AS score_mean, round(stddev_pop(reward), 6) AS score_std, round(var_pop(reward), 6) AS score_var,
    round(max(reward), 6) AS score_max, round(min(reward), 6) AS score_min FROM k WHERE mask > 0""",
)
def _(spark, d):
    rows = exploded(token_rows(spark, d), "reward_tokens", "mask").withColumnRenamed("reward_tokens", "score")
    out = metrics.value_metrics(rows, ["score"])
    return out.select(*six(*out.columns))


@query("a15_explained_variance", f"WITH {TOKENS} SELECT round(1 - var_samp(reward - value) / (var_samp(reward) + 1e-5), 6) AS explained_variance FROM k WHERE mask > 0")
def _(spark, d):
    rows = exploded(token_rows(spark, d), "reward_tokens", "value_tokens", "mask").toDF("row_id", "uid", "pos", "returns", "values", "mask")
    return metrics.explained_variance(rows).select(*six("explained_variance"))


@query("a16_timing", "SELECT round(sum(value) * 1000 / sum(user_id + 1), 6) AS ms_per_token, round(sum(user_id + 1) / (sum(value) * 8), 6) AS tokens_per_second FROM events")
def _(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet").withColumn("n", F.col("user_id") + 1)
    return metrics.timing_metrics(events, "value", "n", devices=8).select(*six("ms_per_token", "tokens_per_second"))


@query(
    "a21_token_diversity",
    f"""WITH {TOKENS}, x AS (SELECT row_id, any_value(uid) AS uid, any_value(length) AS n, string_agg(CAST(token AS VARCHAR), ',' ORDER BY pos) FILTER (mask > 0) AS txt FROM k GROUP BY row_id),
    o AS (SELECT uid, count(*) AS n, count(DISTINCT txt) AS different, stddev_pop(n) AS ls FROM x GROUP BY uid),
    p AS (SELECT a.uid, a.row_id AS i, b.row_id AS j, sum(CASE WHEN a.token = b.token THEN 1.0 ELSE 0.0 END) / count(*) AS agree FROM k a JOIN k b ON a.uid = b.uid AND a.pos = b.pos AND a.row_id < b.row_id
      WHERE a.mask > 0 AND b.mask > 0 GROUP BY ALL), g AS (SELECT uid, avg(agree) AS agree FROM p GROUP BY uid)
    SELECT count(*) AS groups, round(avg(different / n), 6) AS unique_share, round(avg(CASE WHEN different = 1 THEN 1.0 ELSE 0.0 END), 6) AS identical_share,
      round(avg(agree), 6) AS pair_agreement, round(avg(ls), 6) AS length_std FROM o JOIN g ON o.uid = g.uid WHERE n > 1""",
)
def _(spark, d):
    out = metrics.token_diversity(token_rows(spark, d))
    return out.select("groups", *six("unique_share", "identical_share", "pair_agreement", "length_std"))


@query(
    "a22_reward_diversity",
    f"""WITH {ROLLOUTS}, g AS (SELECT uid, count(*) AS n, stddev_pop(reward) AS s, count(DISTINCT round(reward, 7)) AS different FROM r WHERE NOT is_oracle_row GROUP BY uid)
    SELECT count(*) AS groups, round(avg(s), 6) AS std_mean, round(avg(CASE WHEN s <= 1e-8 THEN 1.0 ELSE 0.0 END), 6) AS flat_share, round(avg(different / n), 6) AS unique_share FROM g WHERE n > 1""",
)
def _(spark, d):
    return metrics.reward_diversity(rollouts(spark, d)).select("groups", *six("std_mean", "flat_share", "unique_share"))


@query("a24_imbalance", "WITH l AS (SELECT vec_id % 4 AS part, sum(vec_id % 16 + 8) AS load FROM embeddings GROUP BY 1) SELECT CAST(min(load) AS BIGINT) AS min, CAST(max(load) AS BIGINT) AS max, avg(load) AS mean, CAST(max(load) - min(load) AS BIGINT) AS gap FROM l")
def _(spark, d):
    rows = token_rows(spark, d).select((F.col("row_id") % 4).alias("part"), F.col("length").cast("long").alias("length"))
    return metrics.imbalance(rows, "part", "length")
