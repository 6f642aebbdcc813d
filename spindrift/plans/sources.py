"""Registered queries on readers and writers: each writes a table with a writer of the library and reads it again."""

from __future__ import annotations

from pyspark.sql import functions as F

from spindrift.operators import dataset as ds
from spindrift.operators import loading
from spindrift.plans.tables import read
from spindrift.session import scratch_folder
from spindrift.sources import containers, jsonl, records

QUERIES, SQL = {}, {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


@query(
    "k1_canonical_lines",
    """SELECT event_id, '{"event_id":' || event_id || ',"event_type":"' || event_type || '","tags":["' || event_type || '","é\\""],"user":{"id":' || user_id || '}}' AS line FROM events""",
)
def _(spark, d):
    """Rows as canonical JSON, written in parts by many tasks, committed at once and read in splits."""
    rows = read(spark, d, "events").select(F.struct(F.col("user_id").alias("id")).alias("user"), "event_type", "event_id", F.array("event_type", F.lit("é\"")).alias("tags"))
    folder = scratch_folder(spark, "lines")
    jsonl.write_jsonl(rows.repartitionByRange("event_id").sortWithinPartitions("event_id"), f"{folder}/events", parts=True)
    return records.read_lines(spark, f"{folder}/events").select(F.get_json_object("record", "$.event_id").cast("long").alias("event_id"), F.col("record").alias("line"))


@query(
    "s3_fetch_lines",
    """WITH r AS (SELECT doc_id, n_chars, md5(text) AS digest, row_number() OVER (ORDER BY doc_id) - 1 AS ordinal FROM documents)
    SELECT DISTINCT r.doc_id, ordinal, n_chars, digest FROM r JOIN labels ON r.doc_id = labels.doc_id""",
)
def _(spark, d):
    """All documents as one file of lines; those that have labels are fetched by their places."""
    documents = read(spark, d, "documents")
    path = f"{scratch_folder(spark, 'lines')}/documents.jsonl"
    jsonl.write_jsonl(documents.repartitionByRange("doc_id").sortWithinPartitions("doc_id"), path)
    index = jsonl.line_index(spark, path)
    labelled = ds.global_rank(documents.select("doc_id"), ["doc_id"]).join(read(spark, d, "labels").select("doc_id").distinct(), "doc_id", "left_semi")
    wanted = index.join(labelled.select(F.col("rank").alias("ordinal")), "ordinal", "left_semi")
    row = F.from_json("record", "doc_id long, n_chars long, text string")
    fetched = jsonl.fetch_lines(index, wanted).select("ordinal", row.alias("x"))
    return fetched.select("x.doc_id", "ordinal", "x.n_chars", F.md5("x.text").alias("digest"))


@query("s2_container_records", "SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS ordinal, user_id FROM events")
def _(spark, d):
    """All events as the items of one list inside an object, read by many tasks."""
    rows = read(spark, d, "events").select("event_id", F.to_json(F.struct("event_id", "user_id", F.lit('"], {').alias("note"))).alias("record"))
    path = _container(rows, "event_id", '{"about": {"data": [1, "]"]}, "samples": [', "]}", spark)
    row = F.from_json("record", "event_id long, user_id long")
    return containers.read_containers(spark, path, size=1 << 16).select("ordinal", row.alias("x")).select("x.event_id", "ordinal", "x.user_id")


@query("s8_container_members", "SELECT 'k' || event_id AS id, row_number() OVER (ORDER BY 'k' || event_id) - 1 AS ordinal, event_type FROM events")
def _(spark, d):
    """All events as the members of a map inside an object, in the order of their keys."""
    member = F.concat(F.lit('"k'), F.col("event_id").cast("string"), F.lit('": '), F.to_json(F.struct("event_type", F.array(F.lit("\\")).alias("note"))))
    rows = read(spark, d, "events").select("event_id", member.alias("record"))
    path = _container(rows, "event_id", '{"info": {"items": 1}, "annotations": {', "}}", spark)
    row = F.from_json("record", "id string, event_type string")
    return containers.read_containers(spark, path, containers.CONTAINERS, members=True, size=1 << 16).select("ordinal", row.alias("x")).select("x.id", "ordinal", "x.event_type")


@query(
    "s9_samples",
    """SELECT doc_id, '"/data/' || CASE WHEN doc_id % 4 = 0 THEN 'media/' || lang ELSE source END || '/' || doc_id || '.mp4"' AS video, '"' || lang || '"' AS question, CASE WHEN doc_id % 3 = 0 THEN '"own"' ELSE '"s' || doc_id || '"' END AS id,
    CASE WHEN doc_id % 5 = 0 THEN '[' || doc_id || ',9]' END AS span FROM documents WHERE doc_id % 7 > 0 UNION ALL SELECT doc_id, NULL, NULL, CASE WHEN doc_id % 3 = 0 THEN '"own"' END, NULL FROM documents WHERE doc_id % 7 = 0""",
)
def _(spark, d):
    """All documents as samples in a line file; one in seven is not canonical and stays as it is."""
    own = F.col("doc_id")
    video = F.concat(F.when(own % 4 == 0, F.concat(F.lit("./media/"), "lang")).otherwise(F.col("source")), F.lit("/"), own.cast("string"), F.lit(".mp4"))
    rows = read(spark, d, "documents").select(
        "doc_id", F.when(own % 7 > 0, 1).otherwise(2).alias("schema_version"), F.lit("t").alias("eval_task"), F.concat(F.lit("s"), own.cast("string")).alias("sample_id"), F.col("source").alias("benchmark"),
        F.lit("test").alias("split"), F.col("lang").alias("problem"), F.lit("qa").alias("problem_type"), "source", F.array().cast("array<string>").alias("images"), F.array(F.struct(video.alias("path"))).alias("videos"),
        F.when(own % 3 == 0, "own").alias("id"), F.when(own % 5 == 0, F.struct(F.array(own, F.lit(9)).alias("span"))).alias("metadata"), F.lit("A").alias("answer"),
    )
    path = f"{scratch_folder(spark, 'samples')}/rows.jsonl"
    jsonl.write_jsonl(rows.select(F.to_json(F.struct("*")).alias("record")), path, raw=True)
    fields = loading.load_samples(spark, path, "/data").select("fields")
    named = [F.try_element_at("fields", F.lit(n)).alias(n) for n in ("video", "question", "id", "span")]
    return fields.select(F.try_element_at("fields", F.lit("doc_id")).cast("long").alias("doc_id"), *named)


@query(
    "s10_evaluation_rows",
    "SELECT doc_id, lang AS problem, '\"' || source || '\"' AS answer, 'media/video_qa/lvbench/videos/' || doc_id AS video FROM documents",
)
def _(spark, d):
    """All documents as the rows of one evaluation file, which must all be valid to be loaded."""
    own = F.col("doc_id").cast("string")
    rows = read(spark, d, "documents").select(
        F.lit(1).alias("schema_version"), *[F.lit("lvbench").alias(n) for n in ("eval_task", "benchmark")], F.lit("test").alias("split"), own.alias("sample_id"), F.col("lang").alias("problem"), F.lit("qa").alias("problem_type"),
        "source", F.array(F.concat(F.lit("media/video_qa/lvbench/videos/"), own)).alias("videos"), F.array().cast("array<string>").alias("images"), F.col("source").alias("answer"),
    )
    path = f"{scratch_folder(spark, 'rows')}/rows.jsonl"
    jsonl.write_jsonl(rows, path)
    loaded = loading.load_evaluation(spark, path, benchmark="lvbench", split="test")
    return loaded.select(F.col("sample_id").cast("long").alias("doc_id"), "problem", "answer", F.get("videos", F.lit(0)).alias("video"))


def _container(rows, key: str, head: str, tail: str, spark) -> str:
    """Rows of JSON texts as one JSON file, a line each, between two more lines."""
    path = f"{scratch_folder(spark, 'container')}/all.json"
    last = rows.agg(F.max(key).alias("_last"))
    lines = rows.join(F.broadcast(last)).select(F.col(key).alias("_k"), F.lit(1).alias("_at"), F.concat("record", F.when(F.col(key) < F.col("_last"), ",").otherwise("")).alias("line"))
    ends = spark.createDataFrame([(None, 0, head), (None, 2, tail)], "_k long, _at int, line string")
    jsonl.write_jsonl(lines.union(ends).repartitionByRange("_at", "_k").sortWithinPartitions("_at", "_k").select("line"), path, raw=True)
    return path
