"""Registered queries on replies, contents, orders, the registry and SQL table functions."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F

from spindrift.functions import boxes as bx
from spindrift.functions import prompts as pr
from spindrift.functions import text as tx
from spindrift.functions.replies import Reply
from spindrift.operators import build
from spindrift.operators import evaluation as ev
from spindrift.operators import registry
from spindrift.operators import repository as rp
from spindrift.operators import rewards as rw
from spindrift.plans.tables import ROLLOUTS, read, rollouts

QUERIES, SQL = {}, {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


def _pick(items: list[str], at):
    """One of a few texts, by a number."""
    return F.get(F.array(*[F.lit(x) for x in items]), (at % len(items)).cast("int"))


def _listed(items: list[str], at: str) -> str:
    quoted = ", ".join("'" + x.replace("'", "''") + "'" for x in items)
    return f"([{quoted}])[CAST({at} % {len(items)} AS INTEGER) + 1]"


VALUES = ['""', '"  "', "[]", '{"k":""}', '"x"', "0", '{"k":[1.5]}', "true", "null", '[[["é"]]]']


@query(
    "n7_answer_content",
    f"""WITH a AS (SELECT event_id AS id, '[' || {_listed(VALUES, "event_id")} || ',' || {_listed(VALUES, "user_id")} || ']' AS doc FROM events)
    SELECT id, regexp_matches(regexp_replace(replace(doc, '"k":', ''), '[^0-9a-zé" ]', ' ', 'g'), '"[^"]*[^" ][^"]*"|[0-9]|true') AS content FROM a""",
)
def _(spark, d):
    doc = F.concat(F.lit("["), _pick(VALUES, F.col("event_id")), F.lit(","), _pick(VALUES, F.col("user_id")), F.lit("]"))
    return read(spark, d, "events").select(F.col("event_id").alias("id"), tx.has_content_udf(doc).alias("content"))


MASKS = ['{"counts":"12","size":[3,4]}', '{"counts":"","size":[3,4]}', '{"rle":{"0":"x"}}', '{"masks":[]}', "{}", "null"]
LABELS = ['"a"', '" "', "null", '["",[" "]]', "[0]"]


def _answered(records: pd.Series) -> pd.Series:
    return records.map(lambda r: not any(f.startswith("answer") for f in build.faults(json.loads(r))))


@query(
    "n8_oracle_content",
    f"""WITH r AS (SELECT event_id AS id, {_listed(MASKS, "event_id")}::JSON AS mask, {_listed(LABELS, "user_id")} AS label, event_id // 7 % 3 > 0 AS segments FROM events)
    SELECT id, regexp_matches(regexp_replace(label, '[^0-9a-z" ]', ' ', 'g'), '"[^"]*[^" ][^"]*"|[0-9]') OR (segments AND (length(coalesce(json_extract_string(mask, '$.counts'), '')) > 0 AND json_array_length(mask, '$.size') > 0 OR json_extract(mask, '$.rle') IS NOT NULL OR coalesce(json_array_length(mask, '$.masks'), 0) > 0)) AS content FROM r""",
)
def _(spark, d):
    kind = F.when(F.expr("event_id div 7 % 3 > 0"), "segmentation").otherwise("video_qa")
    text = F.format_string('{"problem":"p","problem_type":"%s","source":"s","videos":["v"],"images":[],"answer":%s,"task_payload":{"segmentation_output":%s}}', kind, _pick(LABELS, F.col("user_id")), _pick(MASKS, F.col("event_id")))
    return read(spark, d, "events").select(F.col("event_id").alias("id"), F.pandas_udf(_answered, "boolean")(text).alias("content"))


@query("i2_media_anchors", "SELECT doc_id, array_to_string(list_sort(list_distinct([source || '/' || lang || '.mp4', lang || '/' || doc_id || '.png', 'c.jpg'])), ',') AS anchors FROM documents")
def _(spark, d):
    own = F.col("doc_id").cast("string")
    paths = F.array(F.concat("source", F.lit("/x/../"), F.upper("lang"), F.lit(".MP4")), F.concat("lang", F.lit("\\"), own, F.lit(".png")), F.lit("./c.jpg"), F.concat("source", F.lit("//"), "lang", F.lit(".mp4")))
    return read(spark, d, "documents").select("doc_id", F.array_join(tx.anchors_udf(paths), ",").alias("anchors"))


HEADS = ["", "<think>it is <answer>no</answer></think> ", "  ", "so: ", "well</think>\n", "<THINK>a</think><think>b</think>"]
BODIES = ["<answer> 7 </answer>", "<answer>\n[1, 2]\n</answer> ", "<answer></answer>", "<Answer>a</answer> or <answer>b</ANSWER>", "9", "<answer>open"]
REPLY = f"""r AS (SELECT event_id AS id, {_listed(HEADS, "event_id")} || {_listed(BODIES, "user_id")} AS said FROM events)""".replace("\n", "' || chr(10) || '")


@query(
    "r15_replies",
    f"""WITH {REPLY} SELECT id, nullif(trim(regexp_extract(said, '^\\s*(?:(?:<think>)?.*?</think>\\s*)?<answer>\\s*(.*?)\\s*</answer>\\s*$', 1, 'si'), ' ' || chr(10)), '') AS payload,
      trim(coalesce(list_extract(regexp_extract_all(said, '<answer>\\s*(.*?)\\s*</answer>', 1, 'si'), -1), said), ' ' || chr(10)) AS answer FROM r""",
)
def _(spark, d):
    @F.pandas_udf("struct<payload:string,answer:string>")
    def parts(texts: pd.Series) -> pd.DataFrame:
        read_ = [Reply(t) for t in texts]
        return pd.DataFrame({"payload": [r.payload for r in read_], "answer": [r.answer for r in read_]})

    said = F.concat(_pick(HEADS, F.col("event_id")), _pick(BODIES, F.col("user_id")))
    return read(spark, d, "events").select(F.col("event_id").alias("id"), parts(said).alias("x")).select("id", "x.payload", "x.answer")


def share_of_words(item: dict, least: int = 20) -> dict[str, float]:
    """A scorer that is named by its path: how near a response comes to a number of words."""
    n = len(item["response"].split())
    return {"overall": min(1.0, n / least), "words": float(n)}


@query("r19_custom_scorer", "SELECT doc_id, round(least(1, len(regexp_extract_all(text, '[^\\s]+')) / 50), 9) AS overall, CAST(len(regexp_extract_all(text, '[^\\s]+')) AS DOUBLE) AS words FROM documents")
def _(spark, d):
    item = F.to_json(F.struct(F.col("text").alias("response")))
    rows = read(spark, d, "documents").select("doc_id", F.lit("length").alias("family"), item.alias("item"))
    scored = rw.score(rows, settings={"length": {"least": 50}}, scorers={"length": "spindrift.plans.answers:share_of_words"})
    return scored.select("doc_id", F.round(F.col("metrics")["overall"], 9).alias("overall"), F.col("metrics")["words"].alias("words"))


@query(
    "x11_cut_frames",
    """WITH k AS (SELECT event_id AS id, unnest([event_id % 50 || '.7', CAST(event_id % 50 + 60 AS VARCHAR), 'x' || user_id, '-' || event_id % 9 + 1 || '.5', '2e2']) AS key, unnest([0, 1, 2, 3, 4]) AS n FROM events)
    SELECT id, CAST(trunc(TRY_CAST(key AS DOUBLE)) AS BIGINT) AS frame, CAST(n AS DOUBLE) AS x0 FROM k WHERE TRY_CAST(key AS DOUBLE) IS NOT NULL AND NOT (n = 4 AND id % 3 = 0)""",
)
def _(spark, d):
    e = F.col("event_id")
    keys = [F.concat((e % 50).cast("string"), F.lit(".7")), (e % 50 + 60).cast("string"), F.concat(F.lit("x"), F.col("user_id").cast("string")), F.concat(F.lit("-"), (e % 9 + 1).cast("string"), F.lit(".5")), F.lit("2e2")]
    boxes = [F.when((e % 3 == 0) & F.lit(n == 4), "[1,2,3]").otherwise(f'[{n},"0",5,6.5]') for n in range(5)]
    parts = [F.concat(F.lit('"'), k, F.lit('":'), b) for k, b in zip(keys, boxes, strict=True)]

    @F.pandas_udf("map<string,array<double>>")
    def frames(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: bx.frame_boxes(json.loads(t), bx.cut_frame, bx.flat_box))

    rows = read(spark, d, "events").select(e.alias("id"), F.explode(frames(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")))).alias("frame", "box"))
    return rows.select("id", F.col("frame").cast("long").alias("frame"), F.get("box", F.lit(0)).alias("x0"))


@query(
    "q6_video_order",
    """SELECT doc_id, row_number() OVER (ORDER BY coalesce(nullif(CASE WHEN doc_id % 5 > 0 THEN source ELSE '' END, ''), lang), CAST(doc_id AS VARCHAR)) - 1 AS place FROM documents""",
)
def _(spark, d):
    rows = read(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 5 > 0, F.col("source")).otherwise("").alias("videoID"), F.col("lang").alias("video_id"), F.col("doc_id").alias("id"))
    return ev.in_video_order(rows).select("doc_id", "place")


@query("q7_image_order", "SELECT doc_id, row_number() OVER (ORDER BY coalesce(CASE WHEN doc_id % 6 > 0 THEN source END, ''), text, doc_id) - 1 AS place FROM documents")
def _(spark, d):
    own = F.format_string("%s\u0001%020d", F.col("text"), F.col("doc_id"))  # equal texts in the order of their ids
    rows = read(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 6 > 0, F.col("source")).alias("image_path"), own.alias("expression"))
    return ev.in_image_order(rows).select("doc_id", "place")


@query(
    "g_estimators",
    f"""WITH {ROLLOUTS} SELECT 'grpo' AS name, uid, row_id, round((reward - avg(reward) OVER w) / (coalesce(stddev_samp(reward) OVER w, 0) + 1e-6), 9) AS advantage FROM r WINDOW w AS (PARTITION BY uid)
    UNION ALL SELECT 'rloo', uid, row_id, round(reward - (sum(reward) OVER w - reward) / (count(*) OVER w - 1), 12) FROM r WINDOW w AS (PARTITION BY uid)""",
)
def _(spark, d):
    rows = rollouts(spark, d)
    parts = [registry.estimators.run(n, rows).select(F.lit(n).alias("name"), "uid", "row_id", F.round("advantage", places).alias("advantage")) for n, places in (("grpo", 9), ("rloo", 12))]
    return parts[0].unionByName(parts[1])


@query("s7_table_function", "SELECT event_id || ':00000' || n AS id, event_type || n AS query, value + n AS start FROM events, range(2) t(n)")
def _(spark, d):
    registry.register_table_functions(spark)
    span = lambda k: F.array(F.col("value") + k, F.col("value") + k + 1)
    names = F.array(F.concat("event_type", F.lit("0")), F.concat("event_type", F.lit("1")))
    rows = read(spark, d, "events").select(F.col("event_id").cast("string").alias("video"), names.alias("queries"), F.array(span(0), span(1)).alias("spans"))
    return spark.sql("SELECT t.id, t.query, t.start FROM {rows}, LATERAL expand_spans(video, queries, spans) AS t", rows=rows)


@query("s8_table_function", "SELECT event_id, n AS ordinal, '{\"id\": \"' || CASE n WHEN 0 THEN 'a' ELSE 'b' END || '\", \"v\": ' || event_id + n || '}' AS record FROM events, range(2) t(n)")
def _(spark, d):
    registry.register_table_functions(spark)
    text = F.format_string('{"items": {"b": {"v": %d}, "a": {"v": %d}}}', F.col("event_id") + 1, F.col("event_id"))
    rows = read(spark, d, "events").select("event_id", text.alias("text"))
    return spark.sql("SELECT event_id, t.ordinal, t.record FROM {rows}, LATERAL container_records(text) AS t", rows=rows)


BOXED = (
    '{"label":"all","objects":[{"bbox":[@,1,9,9],"name":"k"},{"bbox":[@,2,9,9]}]}', '[{"box":[1,@,3,4],"label":"","category":"c"}]', "(@,1),(5,6)", '{"regions":[{"name":"r","boxes":[[@,0,1,1],[@,0,2,2]]}]}',
)


@query(
    "x8_labels",
    f"""WITH t AS (SELECT event_id AS id, event_id % 4 AS f, replace({_listed(list(BOXED), "event_id")}, '@', CAST(user_id AS VARCHAR)) AS t FROM events), j AS (SELECT id, f, CASE WHEN f <> 2 THEN t::JSON END AS j FROM t)
    SELECT id, CASE f WHEN 0 THEN coalesce(json_extract_string(j, '$.objects[0].name'), json_extract_string(j, '$.label')) || ',' || coalesce(json_extract_string(j, '$.objects[1].name'), json_extract_string(j, '$.label'))
      WHEN 1 THEN coalesce(nullif(json_extract_string(j, '$[0].label'), ''), json_extract_string(j, '$[0].category')) WHEN 2 THEN '-' ELSE json_extract_string(j, '$.regions[0].name') || ',' || json_extract_string(j, '$.regions[0].name') END AS labels,
      CASE f WHEN 0 THEN json_extract_string(j, '$.label') WHEN 1 THEN json_extract_string(j, '$[0].category') WHEN 3 THEN json_extract_string(j, '$.regions[0].name') END AS best FROM j""",
)
def _(spark, d):
    u = F.col("user_id").cast("string")
    said = F.replace(_pick(list(BOXED), F.col("event_id")), F.lit("@"), u)
    rows = read(spark, d, "events").select(F.col("event_id").alias("id"), bx.candidates(said).alias("found"), F.array(F.col("user_id").cast("double"), F.lit(2.0), F.lit(9.0), F.lit(9.0)).alias("truth"))
    first_of = F.array_join(F.transform("found", lambda c: F.coalesce(c["label"], F.lit("-"))), ",")
    second = F.when((F.size("found") > 1) & (F.col("id") % 4 == 0), F.col("found")[1]["label"]).otherwise(bx.pick_candidate(F.col("found"), F.col("truth"))["label"])
    return rows.select("id", first_of.alias("labels"), second.alias("best"))


CARD = """d AS (SELECT DISTINCT source AS benchmark, lang AS split, source || '/' || lang AS annotation_path, CASE WHEN lang IN ('en', 'de') THEN 'qa' ELSE 'grounding' END AS task, CASE WHEN lang = 'fr' THEN 'f' END AS family,
  CASE WHEN source < 'src2' THEN 'MIT' ELSE 'CC-' || lang END AS license, length(source) * 100 + length(lang) AS expected_count FROM documents),
a AS (SELECT doc_id, source AS benchmark, CASE WHEN doc_id % 50 < 4 THEN source || '/' || lang ELSE 'media/' || doc_id END AS path, CASE WHEN doc_id % 50 < 4 THEN 'annotations' ELSE 'videos' END AS kind, n_chars AS bytes FROM documents)"""


def _card(spark, d):
    docs = read(spark, d, "documents")
    own = F.concat_ws("/", "source", "lang")
    datasets = docs.select("source", "lang").distinct().select(
        F.col("source").alias("benchmark"), F.col("lang").alias("split"), own.alias("annotation_path"), F.when(F.col("lang").isin("en", "de"), "qa").otherwise("grounding").alias("task"),
        F.when(F.col("lang") == "fr", "f").alias("family"), F.when(F.col("source") < "src2", "MIT").otherwise(F.concat(F.lit("CC-"), "lang")).alias("license"),
        F.concat(F.lit("https://"), "source").alias("source_url"), (F.length("source") * 100 + F.length("lang")).cast("long").alias("expected_count"),
    )
    told = F.col("doc_id") % 50 < 4
    assets = docs.select(F.col("source").alias("benchmark"), F.when(told, own).otherwise(F.concat(F.lit("media/"), "doc_id")).alias("path"), F.when(told, "annotations").otherwise("videos").alias("kind"), F.col("n_chars").alias("bytes"))
    return datasets, assets


@query(
    "a18_card_benchmarks",
    f"""WITH {CARD}, f AS (SELECT path, max(bytes) AS b FROM a WHERE kind = 'annotations' GROUP BY path), h AS (SELECT benchmark, count(*) AS n, sum(bytes) AS b FROM a GROUP BY benchmark),
    g AS (SELECT d.benchmark, list_sort(list(DISTINCT task)) AS task, list_sort(list(DISTINCT coalesce(family, task))) AS family, list_sort(list(DISTINCT license)) AS license, list_sort(list(split)) AS splits, CAST(sum(coalesce(f.b, 0)) AS BIGINT) AS dataset_size, CAST(sum(expected_count) AS BIGINT) AS row_count
      FROM d LEFT JOIN f ON d.annotation_path = f.path GROUP BY d.benchmark)
    SELECT g.benchmark, CASE WHEN len(task) = 1 THEN to_json(task[1]) ELSE to_json(task) END::VARCHAR AS task, array_to_string(family, ',') AS family, array_to_string(license, ',') AS license, to_json('https://' || g.benchmark)::VARCHAR AS source_url, array_to_string(splits, ',') AS splits,
      row_count, dataset_size, h.n AS asset_count, CAST(h.b AS BIGINT) AS byte_count FROM g JOIN h ON g.benchmark = h.benchmark""",
)
def _(spark, d):
    out = rp.card_benchmarks(*_card(spark, d))
    joined = [F.array_join(c, ",").alias(c) for c in ("family", "license", "splits")]
    return out.select("benchmark", *[rp.one_or_many(F.col(c)).alias(c) for c in ("task", "source_url")], *joined, "row_count", "dataset_size", "asset_count", "byte_count")


@query(
    "a18_card_totals",
    f"""WITH {CARD}, r AS (SELECT count(DISTINCT benchmark) AS benchmark_count, count(*) AS split_count, CAST(sum(expected_count) AS BIGINT) AS row_count FROM d)
    SELECT r.*, (SELECT count(*) FROM a) AS asset_count, (SELECT CAST(sum(bytes) AS BIGINT) FROM a) AS byte_count, CASE WHEN row_count < 1000 THEN 'n<1K' WHEN row_count < 10000 THEN '1K<n<10K' WHEN row_count < 100000 THEN '10K<n<100K' ELSE 'more' END AS size_category FROM r""",
)
def _(spark, d):
    return rp.card_totals(*_card(spark, d))


_NAMES = list(pr.TEMPLATES)
_TEMPLATE_SQL = ", ".join("'" + t.replace("'", "''") + "'" for t in pr.TEMPLATES.values())


@query(
    "x14_templates",
    f"""WITH e AS (SELECT event_id AS id, ([{_TEMPLATE_SQL}])[CAST(event_id % {len(_NAMES)} AS INTEGER) + 1] AS t, CASE event_id % 5 WHEN 0 THEN 'a {{options}} dog' WHEN 1 THEN '  red car? ' WHEN 2 THEN '' WHEN 3 THEN event_type || '.' ELSE 'the ' || user_id END AS q,
      'A. ' || event_type || chr(10) || 'B. ' || user_id AS o, event_id % {len(_NAMES)} = {_NAMES.index("spatial_grounding")} AS spatial FROM events),
    s AS (SELECT id, t, o, CASE WHEN spatial THEN CASE WHEN trim(q) = '' OR regexp_matches(trim(q), '[.?!]$') THEN trim(q) ELSE trim(q) || '.' END ELSE q END AS q FROM e)
    SELECT id, md5(replace(replace(replace(t, '{{question}}', chr(1)), '{{options}}', o), chr(1), q)) AS prompt FROM s""",
)
def _(spark, d):
    e, u = F.col("event_id"), F.col("user_id").cast("string")
    q = F.when(e % 5 == 0, "a {options} dog").when(e % 5 == 1, "  red car? ").when(e % 5 == 2, "").when(e % 5 == 3, F.concat("event_type", F.lit("."))).otherwise(F.concat(F.lit("the "), u))
    rows = read(spark, d, "events").select(e.alias("id"), _pick(_NAMES, e).alias("name"), q.alias("q"), F.array(F.concat(F.lit("A. "), "event_type"), F.concat(F.lit("B. "), u)).alias("options"))
    asked = F.when(F.col("name") == "spatial_grounding", pr.sentence(F.col("q"))).otherwise(F.col("q"))
    return rows.select("id", F.md5(pr.fill(F.col("name"), asked, F.col("options"))).alias("prompt"))
