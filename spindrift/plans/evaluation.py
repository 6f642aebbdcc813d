"""Registered queries on rewards, answers and benchmark metrics."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F

from spindrift.functions import boxes as bx
from spindrift.functions import parsing as ps
from spindrift.functions import geometry as geo
from spindrift.functions.replies import balanced_object
from spindrift.operators import evaluation as ev
from spindrift.operators import rewards as rw
from spindrift.plans.tables import read

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def results(spark, d):
    """labels with their documents as scored answers."""
    docs, labels = read(spark, d, "documents"), read(spark, d, "labels")
    bucket = F.col("doc_id") % 4
    return labels.join(docs, "doc_id").select(
        F.col("doc_id").alias("id"),
        F.col("quality").alias("score"),
        F.when(bucket == 0, "short").when(bucket == 1, "medium").when(bucket == 2, "long").otherwise("endless").alias("duration"),
        "lang",
        "source",
        F.when(F.col("toxic") == 1, "").otherwise("A").alias("pred_answer"),
        F.when(F.col("doc_id") % 10 == 0, None).otherwise("B").alias("answer"),
    )


RESULTS = """s AS (SELECT d.doc_id AS id, quality AS score, CASE d.doc_id % 4 WHEN 0 THEN 'short' WHEN 1 THEN 'medium' WHEN 2 THEN 'long' ELSE 'endless' END AS duration,
  lang, source, CASE WHEN toxic = 1 THEN '' ELSE 'A' END AS pred_answer, CASE WHEN d.doc_id % 10 = 0 THEN NULL ELSE 'B' END AS answer
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""


def _group_sql(dimension: str, column: str, where: str = "true") -> str:
    return f"SELECT '{dimension}' AS dimension, {column} AS name, round(100.0 * sum(score) / count(*), 2) AS accuracy, CAST(sum(score) AS BIGINT) AS correct, count(*) AS total FROM s WHERE {where} GROUP BY {column}"


@query(
    "a4_choice_accuracy",
    f"""WITH {RESULTS} SELECT 'all' AS dimension, NULL AS name, CAST(round(100.0 * sum(score) / count(*), 2) AS DOUBLE) AS accuracy, CAST(sum(score) AS BIGINT) AS correct, count(*) AS total FROM s
    UNION ALL {_group_sql('by_duration', 'duration', "duration <> 'endless'")} UNION ALL {_group_sql('by_category', 'lang')} UNION ALL {_group_sql('by_sub_category', 'source')}""",
)
def _(spark, d):
    return ev.choice_accuracy(results(spark, d), {"duration": "duration", "category": "lang", "sub_category": "source"})


@query("a3_answer_rates", f"WITH {RESULTS} SELECT count(*) AS num_samples, CAST(round(100.0 * count(*) FILTER (pred_answer <> '') / count(*), 2) AS DOUBLE) AS parse_rate, CAST(round(100.0 * count(answer) / count(*), 2) AS DOUBLE) AS ground_truth_rate FROM s")
def _(spark, d):
    return ev.answer_rates(results(spark, d))


@query("a5_group_accuracy", f"WITH {RESULTS} SELECT source AS name, CAST(round(100.0 * sum(score) / count(*), 2) AS DOUBLE) AS accuracy, CAST(sum(score) AS BIGINT) AS correct, count(*) AS total FROM s GROUP BY source")
def _(spark, d):
    return ev.group_accuracy(results(spark, d), "source")


@query("a5_macro_accuracy", f"WITH {RESULTS}, g AS (SELECT CAST(round(100.0 * sum(score) / count(*), 2) AS DOUBLE) AS a FROM s GROUP BY source) SELECT round(avg(a), 2) AS \"M_avg\" FROM g")
def _(spark, d):
    return ev.macro_accuracy(ev.group_accuracy(results(spark, d), "source"))


KINDS = [
    "object_counting_single", "object_counting_multiple", "object_abs_distance", "object_size_estimation", "room_size_estimation_single",
    "object_rel_distance_closest", "object_rel_direction_forward_easy", "object_rel_direction_backward_hard", "route_planning", "obj_appearance_order",
]
LIST = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
PLAIN = "regexp_replace({}, '_(single|multiple|closest|farthest)$', '')"


def spatial(spark, d):
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return read(spark, d, "events").select(
        F.col("event_id").alias("id"), F.get(kinds, (F.col("event_id") % len(KINDS)).cast("int")).alias("question_type"), (F.col("value") / 500).alias("score")
    )


SPATIAL = f"s AS (SELECT event_id AS id, {LIST}[CAST(event_id % {len(KINDS)} AS INTEGER) + 1] AS question_type, value / 500 AS score FROM events)"
METRIC = "CASE WHEN key IN ('object_counting', 'object_abs_distance', 'object_size_estimation', 'room_size_estimation') THEN 'MRA' ELSE 'ACC' END"
POOLED = f"""{SPATIAL}, t AS (SELECT CASE WHEN starts_with(question_type, 'object_rel_direction') THEN 'object_rel_direction' ELSE {PLAIN.format('question_type')} END AS key,
  round(avg(score) * 100, 2) AS score, count(*) AS count FROM s GROUP BY 1)"""


def pooled(spark, d):
    return spatial(spark, d).withColumn("question_type", F.regexp_replace("question_type", "_(single|multiple|closest|farthest)$", ""))


@query("a6_spatial_tasks", f"WITH {POOLED} SELECT key, {METRIC} AS metric, score, count FROM t")
def _(spark, d):
    return ev.spatial_tasks(pooled(spark, d))


@query("a6_spatial_summary", f"WITH {POOLED}, m AS (SELECT *, {METRIC} AS metric FROM t) SELECT round(avg(score) FILTER (metric = 'MRA'), 2) AS numerical_avg, round(avg(score) FILTER (metric = 'ACC'), 2) AS mc_avg, round(avg(score), 2) AS overall_avg FROM m")
def _(spark, d):
    return ev.spatial_summary(ev.spatial_tasks(pooled(spark, d)))


MACRO = f"""{SPATIAL}, q AS (SELECT question_type, avg(score) AS mean, count(*) AS n FROM s WHERE question_type <> 'obj_appearance_order' GROUP BY 1),
t AS (SELECT CASE WHEN starts_with(question_type, 'object_rel_direction') THEN 'object_rel_direction' ELSE {PLAIN.format('question_type')} END AS key, avg(mean) AS mean, CAST(sum(n) AS BIGINT) AS count FROM q GROUP BY 1)"""


@query("a7_macro_tasks", f"WITH {MACRO} SELECT key, {METRIC} AS metric, round(mean, 6) AS mean, count FROM t")
def _(spark, d):
    return ev.macro_tasks(spatial(spark, d)).select("key", "metric", F.round("mean", 6).alias("mean"), "count")


@query("a7_macro_summary", f"WITH {MACRO}, m AS (SELECT *, {METRIC} AS metric FROM t) SELECT round(avg(mean) FILTER (metric = 'MRA') * 100, 2) AS numerical_avg, round(avg(mean) FILTER (metric = 'ACC') * 100, 2) AS mc_avg, round(avg(mean) * 100, 2) AS overall_avg FROM m")
def _(spark, d):
    return ev.macro_summary(ev.macro_tasks(spatial(spark, d)))


@query(
    "a8_spatial_grounding",
    """SELECT count(*) AS num_samples, round(avg(value / 500) * 100, 2) AS "mIoU", round(avg(CASE WHEN user_id % 9 <> 0 THEN 1.0 ELSE 0 END) * 100, 2) AS parse_rate,
    round(avg(CASE WHEN value / 500 >= 0.5 THEN 1.0 ELSE 0 END) * 100, 2) AS "acc@0.5", round(avg(CASE WHEN value / 500 >= 0.7 THEN 1.0 ELSE 0 END) * 100, 2) AS "acc@0.7",
    round(avg(CASE WHEN value / 500 >= 0.9 THEN 1.0 ELSE 0 END) * 100, 2) AS "acc@0.9" FROM events""",
)
def _(spark, d):
    rows = read(spark, d, "events").select((F.col("value") / 500).alias("iou"), (F.col("user_id") % 9 != 0).alias("parsed"))
    return ev.grounding_metrics(rows)


@query(
    "a11_temporal_grounding",
    """SELECT count(*) AS num_samples, round(avg(value / 500) * 100, 2) AS "mIoU", round(avg(CASE WHEN user_id % 9 <> 0 THEN 1.0 ELSE 0 END) * 100, 2) AS parse_rate,
    round(avg(CASE WHEN value / 500 >= 0.3 THEN 1.0 ELSE 0 END) * 100, 2) AS "R@0.3", round(avg(CASE WHEN value / 500 >= 0.5 THEN 1.0 ELSE 0 END) * 100, 2) AS "R@0.5",
    round(avg(CASE WHEN value / 500 >= 0.7 THEN 1.0 ELSE 0 END) * 100, 2) AS "R@0.7" FROM events""",
)
def _(spark, d):
    rows = read(spark, d, "events").select((F.col("value") / 500).alias("iou"), (F.col("user_id") % 9 != 0).alias("parsed"))
    return ev.grounding_metrics(rows, thresholds=(0.3, 0.5, 0.7), name="R")


@query(
    "a9_tracking",
    """WITH s AS (SELECT vec_id, list_transform(embedding[1:8], lambda x: abs(CAST(x AS DOUBLE)) * 4) AS f FROM embeddings),
    m AS (SELECT *, list_sum(f) / 8 AS miou FROM s), x AS (SELECT unnest(f) AS v FROM s)
    SELECT (SELECT count(*) FROM m) AS num_samples, count(*) AS num_frames, round(avg(v) * 100, 2) AS "AO", round(avg(CASE WHEN v >= 0.3 THEN 1.0 ELSE 0 END) * 100, 2) AS "R@0.3",
    round(avg(CASE WHEN v >= 0.5 THEN 1.0 ELSE 0 END) * 100, 2) AS "R@0.5", round(avg(CASE WHEN v >= 0.7 THEN 1.0 ELSE 0 END) * 100, 2) AS "R@0.7",
    (SELECT round(avg(miou) * 100, 2) FROM m) AS "mIoU", (SELECT round(avg(CASE WHEN miou >= 0.3 THEN 1.0 ELSE 0 END) * 100, 2) FROM m) AS "sample_R@0.3",
    (SELECT round(avg(CASE WHEN miou >= 0.5 THEN 1.0 ELSE 0 END) * 100, 2) FROM m) AS "sample_R@0.5", (SELECT round(avg(CASE WHEN miou >= 0.7 THEN 1.0 ELSE 0 END) * 100, 2) FROM m) AS "sample_R@0.7",
    (SELECT round(avg(CASE WHEN vec_id % 5 > 0 THEN 1.0 ELSE 0 END) * 100, 2) FROM m) AS parse_rate FROM x""",
)
def _(spark, d):
    frames = F.transform(F.slice("embedding", 1, 8), lambda x: F.abs(x.cast("double")) * 4)
    rows = read(spark, d, "embeddings").select(frames.alias("frame_ious"), (F.col("vec_id") % 5).alias("pred_boxes_n"))
    return ev.tracking_metrics(rows.withColumn("miou", geo.mean_or_zero(F.col("frame_ious"))))


@query(
    "a10_tubes",
    """WITH s AS (SELECT l_discount * 8 AS t, l_tax * 10 AS s, l_discount + l_tax AS m, CASE WHEN l_linenumber > 2 THEN 1 END AS pt, l_linenumber - 1 AS n FROM lineitem)
    SELECT count(*) AS num_samples, round(avg(t) * 100, 2) AS "tIoU", round(avg(s) * 100, 2) AS "sIoU", round(avg(m) * 100, 2) AS "mIoU_inter", round(avg((t + s) / 2) * 100, 2) AS mean_accuracy,
    round(avg(CASE WHEN pt IS NOT NULL OR n > 0 THEN 1.0 ELSE 0 END) * 100, 2) AS parse_rate,
    round(avg(CASE WHEN t >= 0.3 THEN 1.0 ELSE 0 END) * 100, 2) AS "tIoU@0.3", round(avg(CASE WHEN s >= 0.3 THEN 1.0 ELSE 0 END) * 100, 2) AS "sIoU@0.3",
    round(avg(CASE WHEN t >= 0.5 THEN 1.0 ELSE 0 END) * 100, 2) AS "tIoU@0.5", round(avg(CASE WHEN s >= 0.5 THEN 1.0 ELSE 0 END) * 100, 2) AS "sIoU@0.5",
    round(avg(CASE WHEN t >= 0.7 THEN 1.0 ELSE 0 END) * 100, 2) AS "tIoU@0.7", round(avg(CASE WHEN s >= 0.7 THEN 1.0 ELSE 0 END) * 100, 2) AS "sIoU@0.7" FROM s""",
)
def _(spark, d):
    t, s = F.col("l_discount") * 8, F.col("l_tax") * 10
    rows = read(spark, d, "lineitem").select(
        t.alias("tiou"), s.alias("siou"), (F.col("l_discount") + F.col("l_tax")).alias("miou_inter"), ((t + s) / 2).alias("accuracy"),
        F.when(F.col("l_linenumber") > 2, 1).alias("pred_time"), (F.col("l_linenumber") - 1).alias("pred_boxes_n"),
    )
    return ev.tube_metrics(rows)


@query(
    "a12_segmentation",
    """SELECT count(*) AS num_samples, round(avg(l_discount), 6) AS "J", round(avg(l_tax), 6) AS "F", round(avg((l_discount + l_tax) / 2), 6) AS "J&F",
    round(avg(l_discount * 5), 6) AS "gIoU", round(sum(l_quantity) / sum(l_extendedprice), 6) AS "cIoU" FROM lineitem WHERE l_returnflag <> 'R'""",
)
def _(spark, d):
    rows = read(spark, d, "lineitem").select(
        F.when(F.col("l_returnflag") == "R", "failed").otherwise("ok").alias("status"), F.col("l_discount").alias("j"), F.col("l_tax").alias("f"),
        ((F.col("l_discount") + F.col("l_tax")) / 2).alias("jf"), (F.col("l_discount") * 5).alias("iou"), F.col("l_quantity").alias("inter"),
        F.col("l_extendedprice").alias("union"),
    )
    out = ev.segmentation_metrics(rows)
    return out.select("num_samples", *[F.round(F.col(f"`{c}`"), 6).alias(c) for c in out.columns[1:]])


@query("a23_suite_status", "SELECT n_name AS task, CASE WHEN EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_custkey < 30) THEN 'completed' ELSE 'missing' END AS status FROM nation")
def _(spark, d):
    nation, customer = read(spark, d, "nation"), read(spark, d, "customer")
    done = customer.where("c_custkey < 30").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("task"))
    return ev.suite_status(nation.select(F.col("n_name").alias("task")), done)


@query(
    "j4_merge_shards",
    """WITH a AS (SELECT user_id AS id, event_id AS line, value, 0 AS sh FROM events WHERE event_id % 2 = 0 UNION ALL SELECT user_id, event_id, value, 1 FROM events WHERE event_id % 3 = 0 OR event_id % 2 = 1)
    SELECT id, line, value FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sh DESC, line DESC) AS k FROM a) WHERE k = 1""",
)
def _(spark, d):
    rows = read(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("line"), "value")
    return ev.merge_shards([rows.where("line % 2 = 0"), rows.where("line % 3 = 0 OR line % 2 = 1")])


@query("j14_resume", "SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(spark, d):
    key = F.col("doc_id").alias("id")
    return ev.remaining(read(spark, d, "documents").select(key), read(spark, d, "labels").select(key))


def spans(spark, d):
    v = F.col("value")
    return read(spark, d, "events").select(
        F.col("event_id").alias("id"), (v / 10).alias("a"), (v / 10 + 5).alias("b"), (F.col("user_id") / 3.0).alias("c"), (F.col("user_id") / 3.0 + 7).alias("e")
    )


@query(
    "r8_interval_iou",
    """WITH s AS (SELECT event_id AS id, value / 10 AS a, value / 10 + 5 AS b, user_id / 3.0 AS c, user_id / 3.0 + 7 AS e FROM events)
    SELECT id, round(greatest(0, least(b, e) - greatest(a, c)) / (greatest(b, e) - least(a, c)), 6) AS iou FROM s""",
)
def _(spark, d):
    return spans(spark, d).select("id", F.round(geo.interval_iou(F.col("b"), F.col("a"), F.col("c"), F.col("e")), 6).alias("iou"))


BOXES = """b AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_discount * 100 AS x, l_tax * 100 AS y FROM lineitem)"""


@query(
    "r9_box_iou",
    f"""WITH {BOXES}, i AS (SELECT *, greatest(0, least(x + 9, 12.5) - greatest(x, 3)) * greatest(0, least(y + 9, 12.5) - greatest(y, 3)) AS inter FROM b)
    SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, round(inter / (81 + 9.5 * 9.5 - inter), 6) AS iou FROM i""",
)
def _(spark, d):
    rows = read(spark, d, "lineitem")
    x, y = F.col("l_discount") * 100, F.col("l_tax") * 100
    box = geo.box_iou(F.array(x, y, x + 9, y + 9), F.array(F.lit(3.0), F.lit(3.0), F.lit(12.5), F.lit(12.5)))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", F.round(box, 6).alias("iou"))


@query(
    "r10_relative_accuracy",
    """SELECT event_id AS id, round(list_sum(list_transform(range(10), lambda i: CASE WHEN abs(value - user_id) / user_id <= 1.0 - (0.5 + 0.05 * CAST(i AS DOUBLE)) THEN 1.0 ELSE 0.0 END)) / 10, 6) AS mra
    FROM events WHERE user_id > 0 UNION ALL SELECT event_id, 0 FROM events WHERE user_id = 0""",
)
def _(spark, d):
    m = geo.relative_accuracy(F.col("value"), F.col("user_id").cast("double"))
    return read(spark, d, "events").select(F.col("event_id").alias("id"), F.round(m, 6).alias("mra"))


@query(
    "r11_assignment",
    """WITH p AS (SELECT vec_id, [[e[1] * 100, e[2] * 100], [e[3] * 100, e[4] * 100], [e[5] * 100, e[6] * 100]] AS a, [[e[7] * 100, e[8] * 100], [e[9] * 100, e[10] * 100], [e[11] * 100, e[12] * 100]] AS b
      FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)),
    d AS (SELECT vec_id, list_transform(a, lambda u: list_transform(b, lambda v: sqrt(pow(u[1] - v[1], 2) + pow(u[2] - v[2], 2)))) AS g FROM p),
    m AS (SELECT vec_id, least(g[1][1] + g[2][2] + g[3][3], g[1][1] + g[2][3] + g[3][2], g[1][2] + g[2][1] + g[3][3], g[1][2] + g[2][3] + g[3][1], g[1][3] + g[2][1] + g[3][2], g[1][3] + g[2][2] + g[3][1]) / 3 AS d FROM d)
    SELECT vec_id, round(exp(-d * d / 5000), 6) AS similarity FROM m""",
)
def _(spark, d):
    e = F.transform("embedding", lambda x: x.cast("double") * 100)
    points = lambda at: F.array(*[F.array(F.get(e, F.lit(at + 2 * i)), F.get(e, F.lit(at + 2 * i + 1))) for i in range(3)])
    return read(spark, d, "embeddings").select("vec_id", F.round(geo.assignment_similarity(points(0), points(6)), 6).alias("similarity"))


@query(
    "r1_temporal_reward",
    """WITH s AS (SELECT event_id AS id, round(value / 10, 1) AS a, round(value / 10, 1) + 5 AS b, CAST(user_id AS DOUBLE) AS c, user_id + 7.0 AS e, event_id % 5 = 0 AS broken FROM events)
    SELECT id, CASE WHEN broken THEN 0 ELSE round(greatest(0, least(b, e) - greatest(a, c)) / (greatest(b, e) - least(a, c)), 6) END AS iou, CAST(CASE WHEN broken THEN 0 ELSE 1 END AS DOUBLE) AS format FROM s""",
)
def _(spark, d):
    a = F.round(F.col("value") / 10, 1)
    text = F.concat(F.lit("<think>x</think> <answer>"), a.cast("string"), F.when(F.col("event_id") % 5 == 0, " until ").otherwise(" to "), (a + 5).cast("string"), F.lit("</answer>"))
    iou, ok = rw.temporal_columns(text, F.col("user_id").cast("double"), F.col("user_id") + 7.0)
    return read(spark, d, "events").select(F.col("event_id").alias("id"), F.round(iou, 6).alias("iou"), ok.alias("format"))


@query(
    "r5_number_reward",
    """SELECT event_id AS id, CASE WHEN event_id % 4 = 0 OR user_id = 0 THEN 0 ELSE round(list_sum(list_transform(range(10), lambda i: CASE WHEN abs(floor(value) - user_id) / user_id <= 1.0 - (0.5 + 0.05 * CAST(i AS DOUBLE)) THEN 1.0 ELSE 0.0 END)) / 10, 6) END AS accuracy,
    CAST(CASE WHEN event_id % 4 = 0 THEN 0 ELSE 1 END AS DOUBLE) AS format FROM events""",
)
def _(spark, d):
    number = F.floor("value").cast("string")
    text = F.concat(F.lit("<answer>"), F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("about "), number)).otherwise(number), F.lit("</answer>"))
    accuracy, ok = rw.number_columns(text, F.col("user_id").cast("double"))
    return read(spark, d, "events").select(F.col("event_id").alias("id"), F.round(accuracy, 6).alias("accuracy"), ok.alias("format"))


@query(
    "r6_choice_reward",
    """WITH s AS (SELECT event_id AS id, chr(CAST(65 + user_id % 8 AS INTEGER)) AS p, chr(CAST(65 + event_id % 8 AS INTEGER)) AS t, event_id % 6 = 0 AS broken FROM events)
    SELECT id, CAST(CASE WHEN NOT broken AND p = t THEN 1 ELSE 0 END AS DOUBLE) AS accuracy, CAST(CASE WHEN broken THEN 0 ELSE 1 END AS DOUBLE) AS format FROM s""",
)
def _(spark, d):
    p, t = F.char(65 + F.col("user_id") % 8), F.char(65 + F.col("event_id") % 8)
    text = F.when(F.col("event_id") % 6 == 0, p).otherwise(F.concat(F.lit("<answer>"), F.lower(p), F.lit("</answer>")))
    accuracy, ok = rw.choice_columns(text, t)
    return read(spark, d, "events").select(F.col("event_id").alias("id"), accuracy.alias("accuracy"), ok.alias("format"))


def samples(spark, d):
    """events as samples of all seven families: spans, boxes, points, counts and letters that vary, and broken answers."""
    h, w = F.col("user_id") % 10 + 1, F.expr("event_id div 7 % 5")
    text = lambda pattern, *values: F.format_string(pattern, *[v.cast("int") for v in values])
    letter = lambda n: F.char(65 + n % 8)
    more = F.when(w == 4, ',"2":[10,10,20,20]').otherwise("")
    points = '"negative_points":[[900,900],[700,700],[800,100]]'
    truths = [
        ("temporal grounding", text('{"time":[%d,%d]}', h, h + 4), text("<answer>%d to %d</answer>", h, h + 1 + w)),
        ("video tracking", F.lit('{"boxes":{"1":[0,0,10,10],"2":[10,10,20,20]}}'), F.concat(text('<answer>{"boxes":{"1":[0,0,10,%d]', h), more, F.lit("}}</answer>"))),
        (
            "image segmentation",
            F.lit('{"boxes":[0,0,100,100],"positive_points":[[100,100],[300,300],[500,500]],' + points + "}"),
            text('<answer>{"boxes":[0,0,100,%d],"positive_points":[[%d,100],[%d,300],[%d,500]],' + points + "}</answer>", h * 10, w + 100, w + 300, w + 500),
        ),
        ("RefCOCO", F.lit('{"bbox_2d":[10,20,40,60]}'), text('```json\n[{"bbox_2d":[10,20,40,%d]}]\n```', h * 4 + 20)),
        ("stvg", text('{"time":[%d,%d],"boxes":{"1":[0,0,10,10],"2":[0,0,10,10]}}', h, h + 1 + w), text('<answer>{"time":[%d,%d],"boxes":{"1":[0,0,10,%d]}}</answer>', h, h + 1, h)),
        ("object_counting", text('"%d"', h), text("<answer>%d.03</answer>", h + w)),
        ("video_qa_mc", F.concat(F.lit('"'), letter(h), F.lit('"')), F.concat(F.lit("<answer>"), F.lower(letter(h + w)), F.lit("</answer>"))),
    ]
    answer = lambda r: F.when(F.col("event_id") % 11 == 0, "no answer").otherwise(r)
    table = F.array(*[F.struct(F.lit(k).alias("k"), t.alias("t"), answer(r).alias("r")) for k, t, r in truths])
    rows = read(spark, d, "events").select(F.col("event_id").alias("id"), F.get(table, (F.col("event_id") % 7).cast("int")).alias("x"))
    quote = lambda c: F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\\", r"\\\\"), '"', r'\\"'), "\n", r"\\n"), F.lit('"'))
    item = F.concat(F.lit('{"problem_type":'), quote(F.col("x.k")), F.lit(',"ground_truth":'), F.col("x.t"), F.lit(',"response":'), quote(F.col("x.r")), F.lit("}"))
    return rows.select("id", F.col("x.k").alias("problem_type"), item.alias("item"))


@query(
    "r_router",
    """SELECT event_id AS id, ['temporal_grounding', 'tracking', 'segmentation', 'spatial_grounding', 'spatial_temporal_grounding', 'spatial_intelligence', 'video_qa'][CAST(event_id % 7 AS INTEGER) + 1] AS family FROM events""",
)
def _(spark, d):
    return rw.route(samples(spark, d), ["problem_type"]).select("id", "family")


@query(
    "r_scores",
    """WITH s AS (SELECT event_id AS id, event_id % 7 AS f, user_id % 10 + 1 AS h, event_id // 7 % 5 AS w, event_id % 11 = 0 AS broken FROM events)
    SELECT id, CASE WHEN broken THEN 0.0::DOUBLE ELSE round(CAST(CASE f WHEN 0 THEN least(4, 1 + w) / greatest(4, 1 + w)::DOUBLE
      WHEN 1 THEN h / 20.0::DOUBLE + CASE WHEN w = 4 THEN 0.5 ELSE 0 END WHEN 2 THEN 0.05::DOUBLE * h + 0.25 * exp(-w * w / 5000.0::DOUBLE) + 0.25 WHEN 3 THEN h / 10.0::DOUBLE
      WHEN 4 THEN 0.2::DOUBLE / (1 + w) + 0.04 * h WHEN 5 THEN list_sum(list_transform(range(10), lambda i: CASE WHEN (w + 0.03) / h <= 0.5 - 0.05 * i THEN 1.0 ELSE 0.0 END)) / 10
      ELSE CASE WHEN w = 0 THEN 1 ELSE 0 END END AS DOUBLE), 6) END AS overall FROM s""",
)
def _(spark, d):
    scored = rw.score(rw.route(samples(spark, d), ["problem_type"]))
    return scored.select("id", F.round(F.element_at("metrics", "overall"), 6).alias("overall"))


@query(
    "r16_oracle_responses",
    """WITH s AS (SELECT event_id AS id, event_id % 7 AS f, user_id % 10 + 1 AS h, event_id // 7 % 5 AS w FROM events)
    SELECT id, CASE f WHEN 0 THEN '<answer>' || h || ' to ' || h + 4 || '</answer>'
      WHEN 1 THEN '<answer>{"boxes":{"1":[0.0,0.0,10.0,10.0],"2":[10.0,10.0,20.0,20.0]}}</answer>'
      WHEN 2 THEN '<answer>{"boxes":[0,0,100,100],"positive_points":[[100,100],[300,300],[500,500]],"negative_points":[[900,900],[700,700],[800,100]]}</answer>'
      WHEN 3 THEN '```json' || chr(10) || '[{"bbox_2d":[10.0,20.0,40.0,60.0],"label":""}]' || chr(10) || '```'
      WHEN 4 THEN '<answer>{"time":[' || h || '.0,' || h + 1 + w || '.0],"boxes":{"1":[0.0,0.0,10.0,10.0],"2":[0.0,0.0,10.0,10.0]}}</answer>'
      WHEN 5 THEN '<answer>' || h || '</answer>' ELSE '<answer>' || chr(CAST(65 + h % 8 AS INTEGER)) || '</answer>' END AS response, 1.0::DOUBLE AS overall FROM s""",
)
def _(spark, d):
    built = rw.build_oracles(rw.route(samples(spark, d), ["problem_type"]))
    quoted = F.to_json(F.struct(F.col("oracle_response").alias("response")))
    swapped = F.concat(F.regexp_extract("item", r'(?s)^(.*),"response":', 1), F.lit(","), F.substr(quoted, F.lit(2)))
    return rw.score(built.withColumn("item", swapped)).select("id", F.col("oracle_response").alias("response"), F.round(F.element_at("metrics", "overall"), 6).alias("overall"))


# Ground truths of many shapes; {h} and {w} stand for numbers of the row.
TRUTHS = (
    '{{"time":[{h},{w}]}}', '{{"Start":{h},"END":{w}}}', "[{h},{w}]", '"from {h} to {w} s"', '"{h}.5 - {w}"', '{{"boxes":{{"{h}":[0,0,{w},4]}}}}', '{{"boxes":[1,2,{h},{w}]}}',
    '{{"bbox_2d":[1,2,{h},{w}]}}', '[{{"bbox":[{h},1,{w},2]}},{{"label":"x"}}]', '"({h},1),({w},2)"', '{{"time":[{h},{w}],"boxes":{{"1":[0,0,1,1]}}}}', '{{"Positive Points":[[{h},{w}]],"boxes":[1,2,3,4]}}',
    '"<answer>{h}</answer>"', "{h}", '"-{h}.25"', '"c"', '"<answer> H </answer>"', '"```json\\n[1,{h},2,{w}]\\n```"',
)
_TRUTH_SQL = ", ".join("'" + t.format(h="' || h || '", w="' || w || '") + "'" for t in TRUTHS)


@query(
    "r17_infer_family",
    f"""WITH s AS (SELECT event_id AS id, user_id % 50 + 1 AS h, user_id % 50 + 3 + event_id % 9 AS w FROM events), t AS (SELECT id, ([{_TRUTH_SQL}])[CAST(id % {len(TRUTHS)} AS INTEGER) + 1]::JSON AS j FROM s),
    u AS (SELECT id, CASE WHEN json_type(j) = 'VARCHAR' THEN trim(regexp_replace(regexp_replace(j->>'$', '</?answer>|```json|```', '', 'g'), chr(10), ' ', 'g')) END AS said, j FROM t),
    v AS (SELECT id, coalesce(said, j::VARCHAR) AS said, CASE WHEN said IS NULL THEN j WHEN said[1] IN ('[', '{{') THEN said::JSON END AS j FROM u),
    k AS (SELECT *, CASE WHEN json_type(j) = 'OBJECT' THEN list_transform(json_keys(j), lambda x: lower(replace(x, ' ', '_'))) ELSE [] END AS keys, coalesce(json_type(j), 'NONE') AS kind FROM v)
    SELECT id, CASE WHEN list_contains(keys, 'positive_points') THEN 'segmentation' WHEN list_has_all(keys, ['boxes', 'time']) THEN 'spatial_temporal_grounding' WHEN json_type(j, '$.boxes') = 'OBJECT' THEN 'tracking'
      WHEN (kind = 'ARRAY' AND json_array_length(j) = 4) OR json_array_length(j, '$.boxes') = 4 OR json_array_length(j, '$.bbox_2d') = 4 OR json_type(j, '$[0]') = 'OBJECT' THEN 'spatial_grounding'
      WHEN (kind = 'ARRAY' AND json_array_length(j) = 2) OR json_array_length(j, '$.time') = 2 OR list_has_all(keys, ['start', 'end']) THEN 'temporal_grounding'
      WHEN regexp_matches(said, '^[A-Ha-h]$') THEN 'video_qa' WHEN regexp_matches(said, '^[-+]?[0-9.]+$') THEN 'spatial_intelligence' WHEN regexp_matches(said, '[0-9]\\s*(to|and|-)\\s*[0-9]') THEN 'temporal_grounding'
      WHEN regexp_matches(said, '\\(.*\\),\\(.*\\)') THEN 'spatial_grounding' END AS family FROM k""",
)
def _(spark, d):
    e, u = F.col("event_id"), F.col("user_id")
    h, w = (u % 50 + 1).cast("string"), (u % 50 + 3 + e % 9).cast("string")
    told = [F.replace(F.replace(F.lit(t.replace("{{", "{").replace("}}", "}")), F.lit("{h}"), h), F.lit("{w}"), w) for t in TRUTHS]
    rows = read(spark, d, "events").select(e.alias("id"), F.get(F.array(*told), (e % len(TRUTHS)).cast("int")).alias("truth"))
    return rows.select("id", F.pandas_udf(_families, "string")("truth").alias("family"))


def _families(truths: pd.Series) -> pd.Series:
    return truths.map(lambda t: rw.infer_family(json.loads(t)))


@query("r18_place_scores", "SELECT vec_id, CAST(vec_id % 16 + 8 AS INTEGER) AS at, CAST(vec_id + 1 AS DOUBLE) AS score FROM embeddings")
def _(spark, d):
    from spindrift.plans.tables import token_rows

    placed = rw.place_scores((F.col("row_id") + 1).cast("double"), F.col("mask"))
    rows = token_rows(spark, d).select(F.col("row_id").alias("vec_id"), F.posexplode(placed).alias("p", "score"))
    return rows.where("score <> 0").select("vec_id", (F.col("p") + 1).alias("at"), "score")


@query(
    "x14_choice_prompt",
    "SELECT event_id AS id, event_type || chr(10) || 'A. ' || user_id || chr(10) || 'B. none' || chr(10) || 'Answer.' AS prompt FROM events",
)
def _(spark, d):
    prompt = ev.choice_prompt(F.concat(F.lit(" "), "event_type"), F.array(F.col("user_id").cast("string"), F.lit("none")), "Answer.")
    return read(spark, d, "events").select(F.col("event_id").alias("id"), prompt.alias("prompt"))


@query(
    "x15_strict_prompt",
    f"""SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN 'How far?' || chr(10) || '{ev.NUMBER_ONLY}' WHEN event_id % 3 = 1 THEN 'Which way? Please answer the question using a single word or phrase.' || chr(10) || '{ev.LETTER_ONLY}'
    ELSE 'Pick the option letter.' END AS prompt FROM events""",
)
def _(spark, d):
    n = F.col("event_id") % 3
    text = F.when(n == 0, "How far? Please answer the question using a single word or phrase.").when(n == 1, "Which way? Please answer the question using a single word or phrase.").otherwise("Pick the option letter.")
    kind = F.when(n == 0, "object_abs_distance").otherwise("object_rel_direction_hard")
    once = ev.strict_prompt(text, kind)
    return read(spark, d, "events").select(F.col("event_id").alias("id"), ev.strict_prompt(once, kind).alias("prompt"))


@query("x16_placeholders", "SELECT event_id AS id, '<video>a' || CASE WHEN event_id % 2 = 0 THEN '<video>' ELSE '' END || 'b' AS prompt FROM events")
def _(spark, d):
    count = F.when(F.col("event_id") % 2 == 0, 2).otherwise(1)
    return read(spark, d, "events").select(F.col("event_id").alias("id"), ev.align_placeholders(F.lit("<video>a<video>b"), count).alias("prompt"))


@query("x18_back_fill", "SELECT event_id AS id, coalesce(CASE WHEN event_id % 2 = 0 THEN event_type END, 'x' || user_id) AS problem FROM events")
def _(spark, d):
    rows = read(spark, d, "events").select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 2 == 0, F.col("event_type")).alias("problem"), F.concat(F.lit("x"), "user_id").alias("question"))
    return ev.back_fill(rows, {"problem": ["question", "prompt"]}).select("id", "problem")


@query("x19_flatten_metrics", "SELECT event_type || '/mean' AS metric, round(avg(value), 6) AS value FROM events GROUP BY event_type")
def _(spark, d):
    means = read(spark, d, "events").groupBy("event_type").agg(F.avg("value").alias("m"))
    nested = means.select(F.create_map("event_type", F.create_map(F.lit("mean"), "m")).alias("metrics"))
    return ev.flatten_metrics(nested).select("metric", F.round("value", 6).alias("value"))


BRACED = ('{"a": {"k": "@"}}', 'so {"a": {"k": "@"}} and {', 'x } {"k": "@"} y', '[{"k": "@"}]', '{"a": {"k": "@"}', "no @", '{k: "@"} {"k": "@"}', '{} {"k": "@"}')


@query(
    "x9_balanced_json",
    f"""WITH s AS (SELECT event_id AS id, replace(([{", ".join("'" + t + "'" for t in BRACED)}])[CAST(event_id % {len(BRACED)} AS INTEGER) + 1], '@', event_type) AS t FROM events),
    p AS (SELECT id, t, unnest(range(1, length(t) + 1)) AS i FROM s), n AS (SELECT id, t, i, sum(CASE t[i] WHEN '{{' THEN 1 WHEN '}}' THEN -1 ELSE 0 END) FILTER (WHERE i >= strpos(t, '{{')) OVER (PARTITION BY id ORDER BY i) AS depth FROM p),
    e AS (SELECT id, t, min(i) FILTER (WHERE depth = 0 AND i > strpos(t, '{{') AND strpos(t, '{{') > 0) AS stop FROM n GROUP BY id, t),
    j AS (SELECT id, CASE WHEN json_valid(t) THEN t ELSE substr(t, strpos(t, '{{'), stop - strpos(t, '{{') + 1) END AS j FROM e)
    SELECT id, CASE WHEN json_valid(j) AND j[1] = '{{' THEN coalesce(json_extract_string(j, '$.a.k'), json_extract_string(j, '$.k'), 'none') END AS kind FROM j""",
)
def _(spark, d):
    texts = F.array(*[F.replace(F.lit(t), F.lit("@"), F.col("event_type")) for t in BRACED])
    text = F.get(texts, (F.col("event_id") % len(BRACED)).cast("int"))
    return read(spark, d, "events").select(F.col("event_id").alias("id"), F.pandas_udf(_kinds, "string")(text).alias("kind"))


def _kinds(texts: pd.Series) -> pd.Series:
    found = texts.map(balanced_object)
    return found.map(lambda x: None if x is None else (x.get("a") or x).get("k", "none"))


@query(
    "x10_frame_ious",
    """WITH f AS (SELECT event_id AS id, unnest(range(1, 5)) AS k, user_id % 7 AS s FROM events),
    i AS (SELECT id, (id + k) % 3 > 0 AND id % 10 > 0 AS there, k, s FROM f),
    o AS (SELECT id, there, CASE WHEN there THEN greatest(0, 5 - s * (k % 2)) / (10.0::DOUBLE - greatest(0, 5 - s * (k % 2))) END AS iou FROM i)
    SELECT id, round(sum(coalesce(iou, 0)) / 4, 6) AS strict, round(coalesce(avg(iou), 0), 6) AS common, count(*) FILTER (WHERE there) / 4.0::DOUBLE AS coverage FROM o GROUP BY id""",
)
def _(spark, d):
    e, s = F.col("event_id"), F.col("user_id") % 7
    box = lambda shift: F.transform(F.array((F.col("event_id") % 97 + shift), F.lit(0), (F.col("event_id") % 97 + 5 + shift), F.lit(9)), lambda x: x.cast("double"))
    target = F.create_map(*[x for k in range(1, 5) for x in (F.lit(str(k)), box(F.lit(0)))])
    named = F.array(*[F.struct(F.lit(str(k)).alias("key"), box(s * (k % 2)).alias("value")) for k in range(1, 5)])
    said = F.map_from_entries(F.filter(named, lambda x: ((e + x["key"].cast("int")) % 3 > 0) & (e % 10 > 0)))
    rows = read(spark, d, "events").select(e.alias("id"), said.alias("said"), target.alias("target"))
    said, target = F.col("said"), F.col("target")
    return rows.select(
        "id", F.round(geo.mean_or_zero(geo.frame_ious(said, target)), 6).alias("strict"),
        F.round(geo.common_frame_iou(said, target), 6).alias("common"), geo.coverage(said, target).alias("coverage"),
    )


# Answers in many forms. The texts are built by SQL that both engines read, and the oracles parse those texts by rules of
# their own. L and M are option letters, U and V numbers of the row.
TEXTS = """SELECT event_id AS id, user_id % 90 AS u, user_id % 7 AS v, event_type AS kind, chr(CAST(65 + user_id % 8 AS INTEGER)) AS l, chr(CAST(65 + event_id % 5 AS INTEGER)) AS m,
CAST(event_id % 16 AS INTEGER) AS form FROM events"""
SAID = """CASE form WHEN 0 THEN 'The answer is ' || l || '.' WHEN 1 THEN '(' || l || ') because ' || kind WHEN 2 THEN l || '. a red car'
WHEN 3 THEN '<think>maybe ' || m || '</think><answer>' || l || '</answer>' WHEN 4 THEN 'we pick option ' || l WHEN 5 THEN lower(l)
WHEN 6 THEN 'perhaps (' || m || '), no, (' || l || ') it is' WHEN 7 THEN 'x ' || m || ': y ' || l || ') z' WHEN 8 THEN 'I choose ' || lower(l) || ' here, ' || m || ' never'
WHEN 9 THEN kind WHEN 10 THEN '<answer>' || m || '</answer> or <ANSWER> (' || l || ') </ANSWER> !' WHEN 11 THEN '"' || l || '",' WHEN 12 THEN 'the answer is unclear ' || m || '-' || l || '-x'
WHEN 13 THEN 'Best answer is ' || m || ' and the answer is ' || l || ' ok' WHEN 14 THEN l || 'bc ' || m || '.x ' ELSE '<think>' || l || '</think> ' END"""
#: Thought and answer tags taken off, in the oracles' dialect.
BARE = r"""trim(regexp_replace(CASE WHEN regexp_matches(said, '(?i)</think>') THEN string_split(regexp_replace(said, '(?i)</think>', chr(1), 'g'), chr(1))[-1] ELSE said END, '(?i)</?think>', '', 'g'))"""
ANSWERED = r"""trim(coalesce(regexp_extract_all(bare, '(?is)<answer>\s*(.*?)\s*</answer>', 1)[-1], bare))"""
STRIPPED = "trim(trim(trim(trim(trim(trim(trim(trim(answer, ','), '.'), '!'), '?'), ';'), ':'), chr(39)), '\"')"
LETTER = r"""coalesce(
 CASE WHEN upper(trim(t)) BETWEEN 'A' AND 'H' AND length(trim(t)) = 1 THEN upper(trim(t)) END,
 nullif(regexp_extract(trim(t), '^([A-H])([^\pL]|$)', 1), ''), nullif(regexp_extract(trim(t), '(^|[^\pL])([A-H])$', 2), ''),
 list_filter(behind, lambda x, i: list_position(behind, x) = i)[-1],
 nullif(regexp_extract(p, '(?s)^.*\(([A-H])\)', 1), ''), nullif(regexp_extract(p, '(?s)^.*([A-H])\.', 1), ''), nullif(regexp_extract(p, '(?s)^.*([A-H]):', 1), ''),
 nullif(regexp_extract(p, '(?s)^.*([A-H])\)', 1), ''), nullif(regexp_extract(p, '(?s)^.*([A-H]) ', 1), ''),
 list_filter(alone, lambda x, i: list_position(alone, x) = i)[-1], '')"""
LETTERS_SQL = f"""WITH a AS (SELECT *, {SAID} AS said FROM ({TEXTS})), b AS (SELECT *, {BARE} AS bare FROM a), c AS (SELECT *, {ANSWERED} AS answer FROM b),
d AS (SELECT *, {STRIPPED} AS t, ' ' || t || ' ' AS p FROM c),
e AS (SELECT *, list_transform(regexp_extract_all(regexp_extract(p, '(?is)^.*(?:answer is|option is|i choose|i select)(.*)$', 1), '(?i)\\b([A-H])\\b', 1), lambda x: upper(x)) AS behind,
regexp_extract_all(p, '\\b([A-H])\\b', 1) AS alone FROM d)"""


def _said(spark, d, text: str):
    read(spark, d, "events").createOrReplaceTempView("_events")
    try:
        return spark.sql(f"SELECT *, {text} AS said FROM ({TEXTS.replace('FROM events', 'FROM _events')})")
    finally:
        spark.catalog.dropTempView("_events")


@query("x1_clean_answer", f"{LETTERS_SQL} SELECT id, answer FROM c")
def _(spark, d):
    return _said(spark, d, SAID).select("id", ps.final_answer(F.col("said")).alias("answer"))


@query("x2_choice_letter", f"{LETTERS_SQL} SELECT id, CASE WHEN trim(t) = '' THEN '' ELSE {LETTER} END AS letter FROM e")
def _(spark, d):
    return _said(spark, d, SAID).select("id", ps.choice_letter(F.col("said")).alias("letter"))


@query(
    "x3_true_letter",
    f"""{LETTERS_SQL} SELECT id, CASE WHEN lower(answer) IN ('a. a red car', 'a red car') THEN 'A' WHEN lower(answer) IN (kind, 'b) ' || kind) THEN 'B'
    WHEN trim(t) = '' THEN '' ELSE {LETTER} END AS letter FROM e""",
)
def _(spark, d):
    options = F.array(F.lit("A. a  Red car"), F.concat(F.lit("b) "), "kind"))
    return _said(spark, d, SAID).select("id", ps.true_letter(F.col("said"), options).alias("letter"))


NUMBERS = """CASE form % 8 WHEN 0 THEN 'about ' || u || ' m' WHEN 1 THEN '<answer>' || u || '.00' || v || '</answer>' WHEN 2 THEN '1,' || (100 + u) || '.5 in all' WHEN 3 THEN 'none'
WHEN 4 THEN '<think>' || v || '</think>The final answer is ' || u WHEN 5 THEN 'C. ' || u || '.' || v WHEN 6 THEN 'answer: B. or ' || u ELSE '-' || u || 'e1 x' END"""
NUMBERS_SQL = f"""WITH a AS (SELECT *, {NUMBERS} AS said FROM ({TEXTS})), b AS (SELECT *, {BARE} AS bare FROM a), c AS (SELECT *, {ANSWERED} AS answer FROM b)"""
FIRST = r"TRY_CAST(replace(nullif(regexp_extract(answer, '[-+]?[0-9]+(,[0-9]{3})*(\.[0-9]+)?([eE][-+]?[0-9]+)?'), ''), ',', '') AS DOUBLE)"
PLAIN = r"TRY_CAST(nullif(regexp_extract(answer, '[-+]?[0-9]+(\.[0-9]+)?'), '') AS DOUBLE)"
ANNOUNCED = r"(?i)(?:the\s+)?(?:final\s+answer|answer)\s*(?:is|=)?\s*:?\s*([-+]?[0-9]+(?:\.[0-9]+)?|[A-Da-d])\b"


@query("x4_numeric_score", f"{NUMBERS_SQL} SELECT id, CAST(coalesce(round({FIRST}, 2) = u, false) AS DOUBLE) AS score FROM c")
def _(spark, d):
    return _said(spark, d, NUMBERS).select("id", ps.same_to_cents(F.col("said"), F.col("u").cast("string")).alias("score"))


@query(
    "x5_spatial_score",
    f"""{NUMBERS_SQL}, f AS (SELECT id, u, {PLAIN} AS x FROM c)
    SELECT id, coalesce(CAST(x AS VARCHAR), '') AS answer, CASE WHEN u = 0 OR x IS NULL THEN 0.0 ELSE
    len(list_filter({[float(t) for t in geo.even_thresholds()]} ::DOUBLE[], lambda k: abs(x - u) / u <= 1 - k)) / 10.0 END ::DOUBLE AS score FROM f""",
)
def _(spark, d):
    got = ps.spatial_score(F.lit("object_counting"), F.col("said"), F.col("u").cast("string"))
    return _said(spark, d, NUMBERS).select("id", got.alias("s")).select("id", "s.answer", "s.score")


@query(
    "x6_loose_parsers",
    f"""{NUMBERS_SQL}, f AS (SELECT *, nullif(regexp_extract(answer, '{ANNOUNCED}', 1), '') AS told FROM c),
    g AS (SELECT *, coalesce(told, regexp_replace(string_split_regex(answer, '\\s+')[1], '[.,:]+$', '')) AS token FROM f)
    SELECT id, token, CASE WHEN regexp_matches(told, '[0-9]') THEN told ELSE
    coalesce(nullif(regexp_extract(answer, '^[A-Da-d]\\s*[.):-]?\\s*([-+]?[0-9]+(\\.[0-9]+)?)\\b', 1), ''), nullif(regexp_extract(answer, '[-+]?[0-9]+(\\.[0-9]+)?'), ''), token) END AS number FROM g""",
)
def _(spark, d):
    return _said(spark, d, NUMBERS).select("id", ps.loose_token(F.col("said")).alias("token"), ps.loose_number(F.col("said")).alias("number"))


SPANS = """CASE form % 8 WHEN 0 THEN u || ' - ' || (u + 30) WHEN 1 THEN u || '.5 to ' || (u + 30) || ' seconds, 1 to ' || v WHEN 2 THEN 'from 00:0' || v || ':' || (10 + u % 50) || ' until 1:' || (10 + v) || ':00.5'
WHEN 3 THEN 'it starts at ' || u || ' and ends at ' || (u + v) || '.25' WHEN 4 THEN '9 - 12 <answer>0' || v || ':10, ' || u || ' to ' || (u + 2) || '</answer>' WHEN 5 THEN 'no idea' WHEN 6 THEN '<answer>' || u || ' ' || v || ' 7' ELSE 'only ' || u END"""


@query(
    "x7_time_spans",
    rf"""WITH a AS (SELECT *, lower({SPANS}) AS said FROM ({TEXTS})),
    b AS (SELECT *, coalesce(regexp_extract_all(said, '<answer>\s*(.*?)\s*</answer>', 1)[-1], string_split(said, '<answer>')[-1]) AS t FROM a),
    c AS (SELECT *, list_transform(regexp_extract_all(t, '\b([0-9]{{1,2}}:[0-9]{{2}}(?::[0-9]{{2}})?(?:\.[0-9]+)?)\b', 1),
        lambda k: list_reduce(list_transform(string_split(k, ':'), lambda z: CAST(z AS DOUBLE)), lambda x, y: x * 60 + y)) AS clocks,
      regexp_extract(t, '([0-9]+\.?[0-9]*)\s*-\s*([0-9]+\.?[0-9]*)', ['x', 'y']) AS dash, regexp_extract(t, '([0-9]+\.?[0-9]*)\s+to\s+([0-9]+\.?[0-9]*)', ['x', 'y']) AS till,
      regexp_extract_all(t, '\b[0-9]+(?:\.[0-9]+)?\b') AS bare FROM b)
    SELECT id, TRY_CAST(CASE WHEN len(clocks) > 1 THEN CAST(clocks[1] AS VARCHAR) WHEN dash.x <> '' THEN dash.x WHEN till.x <> '' THEN till.x WHEN len(bare) > 1 THEN bare[1] END AS DOUBLE) AS a,
    TRY_CAST(CASE WHEN len(clocks) > 1 THEN CAST(clocks[2] AS VARCHAR) WHEN dash.x <> '' THEN dash.y WHEN till.x <> '' THEN till.y WHEN len(bare) > 1 THEN bare[2] END AS DOUBLE) AS b FROM c""",
)
def _(spark, d):
    first = F.get(ps.time_spans(F.col("said")), F.lit(0))
    return _said(spark, d, SPANS).select("id", first["start"].alias("a"), first["end"].alias("b"))


PLACES = """CASE form % 6 WHEN 0 THEN '<answer>{"objects":[{"bbox":[' || u || ',1,9,9]},{"bbox":[' || v || ', 2, 9.5, 9]}]}</answer>' WHEN 1 THEN 'it is at [' || u || ', 0, 3, 4], or [' || u || ',0,3.0,4]'
WHEN 2 THEN '(' || u || ', ' || v || '), (7,8) and [1,2]' WHEN 3 THEN '{"other": [' || v || ',1,2,3], "bbox_2d": [' || u || ',1,2,3]}' WHEN 4 THEN 'corners ' || u || ' ' || v || ' 5 6 7' ELSE 'none of ' || u END"""


@query(
    "x8_candidate_boxes",
    f"""WITH a AS (SELECT *, CAST(form % 6 AS INTEGER) AS f FROM ({TEXTS})),
    b AS (SELECT id, CASE f WHEN 0 THEN [[u, 1, 9, 9], [v, 2, 9.5, 9]] WHEN 1 THEN [[u, 0, 3, 4]] WHEN 2 THEN [[u, v, 7, 8]] WHEN 3 THEN CASE WHEN u = v THEN [[u, 1, 2, 3]] ELSE [[u, 1, 2, 3], [v, 1, 2, 3]] END
      WHEN 4 THEN [[u, v, 5, 6]] ELSE [] END AS boxes, u, v FROM a)
    SELECT id, CAST(len(boxes) AS INTEGER) AS n, CAST(boxes[1][1] AS DOUBLE) AS x, CAST(boxes[1][2] AS DOUBLE) AS y, CAST(boxes[-1][1] AS DOUBLE) AS last_x FROM b""",
)
def _(spark, d):
    boxes = F.col("boxes")
    at = lambda box, i: F.get(box, F.lit(i))
    rows = _said(spark, d, PLACES).select("id", bx.candidate_boxes(F.col("said")).alias("boxes"))
    first = bx.pick_box(boxes, boxes[0])
    return rows.select("id", F.size(boxes).alias("n"), at(first, 0).alias("x"), at(first, 1).alias("y"), at(F.try_element_at(boxes, F.lit(-1)), 0).alias("last_x"))


@query("x8_picked_boxes", f"SELECT id, CAST(v AS DOUBLE) AS first_x, CAST(CASE WHEN v = u % 7 AND v < 5 THEN v ELSE u % 7 END AS DOUBLE) AS best_x FROM ({TEXTS})")
def _(spark, d):
    box = lambda x: F.array(x.cast("double"), F.lit(0.0), x + 4.0, F.lit(4.0))
    truth, boxes = box(F.col("u") % 7), F.array(box(F.col("v")), box(F.col("u") % 7 + 3), box(F.col("u") % 7))
    rows = _said(spark, d, "'x'")
    return rows.select("id", bx.pick_box(boxes, truth)[0].alias("first_x"), bx.pick_box(boxes, truth, best=True)[0].alias("best_x"))


LISTED = """CASE form % 4 WHEN 0 THEN kind || '? A. x B: y ' || l || ') z' WHEN 1 THEN l || '. one,' || m || ' : two' WHEN 2 THEN 'which one' ELSE 'AB. c (D) ' || m || '.' END"""


@query(
    "x17_letters",
    rf"""WITH a AS (SELECT *, {LISTED} AS said FROM ({TEXTS})), b AS (SELECT id, regexp_extract_all(said, '(?:^|[\s,])([A-H])\s*[:).]', 1) AS f FROM a)
    SELECT id, CASE WHEN len(f) = 0 THEN 'A,B,C,D' ELSE array_to_string(list_filter(f, lambda x, i: list_position(f, x) = i), ',') END AS letters FROM b""",
)
def _(spark, d):
    return _said(spark, d, LISTED).select("id", F.array_join(ps.listed_letters(F.col("said")), ",").alias("letters"))
