"""Evaluation files read and checked, or read and adapted, in one step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.operators.records import SCHEMA_VERSION, evaluation_errors
from spindrift.operators.repository import evaluation_set_errors
from spindrift.session import durable
from spindrift.sources.records import read_lines, read_records

TEXTS = ("schema_version", "eval_task", "benchmark", "split", "sample_id", "family", "problem", "problem_type", "source")
LISTS = ("images", "videos", "choices", "subtitles", "artifacts")
NESTED = ("answer", "preprocessed", "task_payload", "metadata", "evaluation")
# Fields that make a row canonical, names of a path in a media entry, folders of assets.
CANONICAL = ("schema_version", "eval_task", "sample_id", "benchmark", "split", "problem", "answer", "images", "videos", "problem_type", "source")
MEDIA_KEYS = ("path", "video", "image", "video_path", "image_path", "file_name")
ASSET_FOLDERS = ("artifacts", "media")
# Parts of a ground truth that become fields of their own.
TRUTH_KEYS = (
    "bbox", "bboxes", "boxes", "coordinates", "duration", "end", "frame", "frame_id", "frame_ids", "gt_bbox", "mask", "masks", "negative_points",
    "normalized_solution", "object", "positive_points", "query", "segment", "segmentation", "span", "spans", "start", "target", "time", "timestamp",
    "timestamps", "trajectory",
)


def evaluation_columns(records: DataFrame) -> DataFrame:
    """Records (path, ordinal, record as JSON text) with the columns of an evaluation row; nested parts stay JSON text."""
    v = F.parse_json("record")
    part = lambda n: F.try_variant_get("_v", f"$.{n}", "variant")
    told = records.withColumn("_v", v)
    return told.select(
        "path", "ordinal", *[F.try_variant_get("_v", f"$.{n}", "string").alias(n) for n in TEXTS],
        *[F.try_variant_get("_v", f"$.{n}", "array<string>").alias(n) for n in LISTS],
        *[F.when(~F.is_variant_null(part(n)), F.to_json(part(n))).alias(n) for n in NESTED],
    )


def load_evaluation(spark: SparkSession, path: str | list[str], **expected: str) -> DataFrame:
    """Evaluation rows of line files, all of them valid (S10): path, ordinal and the columns of evaluation_columns.

    ``expected`` may fix eval_task, benchmark and split. Twenty faults at most are told of rows that break the schema
    (V5), differ from what is expected, or do not go together (V6); any fault stops the load.
    """
    rows = durable(evaluation_errors(evaluation_columns(read_lines(spark, path))).withColumn("row_id", F.col("ordinal")))
    other = [F.when(~F.col(n).eqNullSafe(F.lit(v)), F.lit(f"{n} must be {v}")) for n, v in expected.items()]
    faults = F.concat("errors", F.array_compact(F.array(*other)) if other else F.array().cast("array<string>"))
    place = F.concat_ws(":", F.element_at(F.split("path", "/"), -1), "ordinal")
    wrong = rows.select(F.format_string("%s: %s", place, F.array_join(faults, ", ")).alias("said"), F.size(faults).alias("n")).where("n > 0").select("said")
    sets = evaluation_set_errors(rows).select(F.format_string("%s %s", "kind", "value").alias("said"))
    if told := [r.said for r in wrong.union(sets).limit(20).collect()]:
        raise ValueError("; ".join(sorted(told)))
    return rows.drop("errors", "row_id")


def _json(value: Column) -> Column:
    """A text as JSON; null for null."""
    return F.when(value.isNotNull(), F.regexp_extract(F.to_json(F.array(value)), r"(?s)^\[(.*)\]$", 1))


def _resolved(path: Column, root: str, assets: str | None) -> Column:
    """A path of the repository under its root; one that leaves it, or is empty, stops the query."""
    bare = F.regexp_replace(F.trim(path), r"(^|/)(?:\./)+", "$1")
    own = F.lower(F.get(F.split(bare, "/"), F.lit(0))).isin(*ASSET_FOLDERS)
    below = F.concat(F.when(own, F.lit(assets or root)).otherwise(F.lit(root)), F.lit("/"), bare)
    inside = F.startswith(bare, F.lit(f"{root}/")) | (F.startswith(bare, F.lit(f"{assets}/")) if assets else F.lit(False))
    bad = (bare == "") | bare.rlike(r"(^|/)\.\.(/|$)") | (F.startswith(bare, F.lit("/")) & ~inside)
    return F.when(bad, F.raise_error(F.concat(F.lit("a path leaves the evaluation roots: "), path)).cast("string")).when(inside, bare).otherwise(below)


def load_samples(spark: SparkSession, paths: str | list[str], root: str, asset_root: str | None = None) -> DataFrame:
    """Samples for evaluators (S9): path, ordinal, canonical and ``fields``, a map of names to JSON texts.

    A row that is not canonical keeps its own fields. A canonical one gets, where it has none of that name, the aliases
    that evaluators read (id, question, ground_truth, options, first image, video and subtitle...), the parts of its
    metadata, payload and answer, and its media paths under the root (assets under ``asset_root`` if given).
    """
    read = read_records(spark, paths).withColumn("_v", F.parse_json("record"))
    of = lambda v, path="$": F.try_variant_get(v, path, "map<string,variant>")
    texts = lambda m: F.coalesce(F.transform_values(m, lambda k, x: F.to_json(x)), F.create_map().cast("map<string,string>"))
    version = F.try_variant_get("_v", "$.schema_version", "string") == str(SCHEMA_VERSION)
    named = F.size(F.array_intersect(F.map_keys(of(F.col("_v"))), F.array(*[F.lit(c) for c in CANONICAL]))) == len(CANONICAL)
    rows = read.select("path", "ordinal", "_v", F.coalesce(version & named, F.lit(False)).alias("canonical"), texts(of(F.col("_v"))).alias("_own"))

    def media_path(e: Column) -> Column:
        inner = [F.nullif(F.try_variant_get(e, f"$.{k}", "string"), F.lit("")) for k in MEDIA_KEYS]
        return F.when(F.schema_of_variant(e) == "STRING", F.try_variant_get(e, "$", "string")).otherwise(F.coalesce(*inner))

    media = {n: F.transform(F.try_variant_get("_v", f"$.{n}", "array<variant>"), lambda e: _resolved(media_path(e), root, asset_root)) for n in ("images", "videos", "subtitles")}
    found = rows.select("*", *[F.when(F.col("canonical"), F.coalesce(x, F.array().cast("array<string>"))).alias(f"_{n}") for n, x in media.items()])
    own, first = F.col("_own"), lambda n: F.get(F.col(f"_{n}"), F.lit(0))
    pairs: list[tuple[str, Column]] = [(n, F.transform(F.col(f"_{n}"), _json)) for n in media]
    put = F.map_from_arrays(
        F.array(*[F.lit(n) for n, _ in pairs]), F.array(*[F.concat(F.lit("["), F.array_join(x, ","), F.lit("]")) for _, x in pairs])
    )
    alias = {n: "sample_id" for n in ("id", "problem_id", "question_id")} | {"question": "problem", "prompt": "problem", "ground_truth": "answer", "solution": "answer"}
    alias |= {"dataset": "benchmark", "options": "choices", "question_type": "problem_type", "task_type": "problem_type"}
    same = [(n, F.coalesce(F.try_element_at(own, F.lit(o)), F.lit("[]") if o == "choices" else F.lit(None))) for n, o in alias.items()]
    kind = F.when(F.size("_videos") > 0, "video").when(F.size("_images") > 0, "image")
    lone = [("image", first("images")), ("image_path", first("images")), ("video", first("videos")), ("video_path", first("videos")), ("path", F.coalesce(first("videos"), first("images"))), ("subtitle", first("subtitles")), ("subtitle_path", first("subtitles")), ("data_type", kind)]
    listed = [("image_list", F.element_at(put, F.lit("images"))), *same, *[(n, _json(x)) for n, x in lone]]
    entries = F.filter(F.array(*[F.struct(F.lit(n).alias("key"), x.alias("value")) for n, x in listed]), lambda e: e["value"].isNotNull())
    answer = F.map_filter(texts(of(F.col("_v"), "$.answer")), lambda k, _: k.isin(*TRUTH_KEYS))
    more = [F.map_from_entries(entries), texts(of(F.col("_v"), "$.metadata")), texts(of(F.col("_v"), "$.task_payload")), answer, texts(of(F.col("_v"), "$.preprocessed"))]
    kept = F.map_concat(F.map_filter(own, lambda k, _: ~k.isin(*media)), F.map_filter(put, lambda k, _: F.map_contains_key(own, k)))
    join = lambda a, m: F.map_concat(a, F.map_filter(m, lambda k, _: ~F.map_contains_key(a, k)))
    filled = F.aggregate(F.array(*more), kept, join)
    return found.select("path", "ordinal", "canonical", F.when(F.col("canonical"), filled).otherwise(own).alias("fields"))
