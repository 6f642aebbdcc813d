"""Checks of dataset and evaluation records, field by field (V5, V7), and of segmentation prompts.

Nested parts of a record are JSON text; everything is a column expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.operators.repository import (
    annotation_path,
    benchmark_folder,
    errors_of,
    is_dataset_id,
    is_sha256,
    is_within,
    path_error,
)

# The schema version, and variables of a legacy environment that hold paths.
SCHEMA_VERSION = 1
ENVIRONMENT_NAME = r"^[A-Z][A-Z0-9_]*$"
PATH_VARIABLE = r"(_FILE|_DIR|_ROOT|_PATH|_CKPT|_CFG|_BASE|_PREFIX)$"
# An HTTP address without blanks and without a user.
SOURCE_URL = r"^[Hh][Tt][Tt][Pp][Ss]?://[^\s/?#@]+([/?#]\S*)?$"


def _no(ok: Column, text: str) -> Column:
    """The message where a check does not hold, or cannot be told."""
    return F.when(~F.coalesce(ok, F.lit(False)), F.lit(text))


def _identifiers(*names: str) -> list[Column]:
    return [_no(is_dataset_id(F.col(n)), f"{n} must be a lowercase snake_case identifier") for n in names]


def _optional(name: str, ok: Column, text: str) -> Column:
    return _no(F.col(name).isNull() | ok, text)


def _is_object(text: Column) -> Column:
    return F.json_object_keys(text).isNotNull()


def _unlike(paths: Column, repeats: bool = False) -> Column:
    """No two paths differ by case only; nor repeat, unless repeats are allowed."""
    spelled = F.array_distinct(paths) if repeats else paths
    return F.size(F.array_distinct(F.transform(spelled, lambda p: F.lower(p)))) == F.size(spelled)


def _in_folder(paths: Column, folder: Column) -> Column:
    return F.forall(paths, lambda p: F.coalesce(path_error(p).isNull() & is_within(p, folder), F.lit(False)))


def manifest_errors(df: DataFrame) -> DataFrame:
    """Adds ``errors`` to dataset records (V7).

    Columns: schema_version, benchmark, split, task, family, annotation_path, media_paths, artifact_paths,
    expected_count, license, source_url, redistribution_authorized; evaluation, preprocessing and metadata as JSON
    text; legacy_environment as a map of names to JSON text; checksums as a map of paths. Required fields that are
    null are errors; family, preprocessing, metadata, legacy_environment and checksums may be null.
    """
    c, folder = F.col, benchmark_folder(F.col("benchmark"))
    none = F.array().cast("array<string>")
    listed = lambda n: F.coalesce(c(n), none)
    variables = F.coalesce(F.map_entries("legacy_environment"), F.array().cast("array<struct<key:string,value:string>>"))
    is_text = lambda v: v.rlike(r'^\s*"')
    unquoted = lambda v: F.get_json_object(F.concat(F.lit('{"v":'), v, F.lit("}")), "$.v")
    of_paths = F.filter(variables, lambda e: e["key"].rlike(PATH_VARIABLE))
    held = F.transform(of_paths, lambda e: unquoted(e["value"]))
    entries = F.coalesce(F.map_entries("checksums"), F.array().cast("array<struct<key:string,value:string>>"))
    summed = F.transform(entries, lambda e: e["key"])
    every = F.array_compact(F.concat(F.array("annotation_path"), listed("media_paths"), listed("artifact_paths"), held, summed))
    scalars = lambda v: F.from_json(v, "array<string>")
    flat = lambda v: F.forall(scalars(v), lambda x: x.isNotNull() & ~x.rlike(r"^\s*[\[{]"))
    plain = lambda v: ~v.rlike(r"^\s*(\{|null\s*$)") & (~v.rlike(r"^\s*\[") | flat(v))
    checks = [
        _no(c("schema_version") == SCHEMA_VERSION, f"schema_version must be {SCHEMA_VERSION}"),
        *_identifiers("benchmark", "split", "task"),
        _optional("family", is_dataset_id(c("family")), "family must be a lowercase snake_case identifier"),
        _no(c("annotation_path") == annotation_path(c("benchmark"), c("split")), "annotation_path is not canonical"),
    ]
    for name, top in (("media_paths", "media/"), ("artifact_paths", "artifacts/")):
        checks += [
            _no(c(name).isNotNull(), f"{name} must be a list"),
            _no(_in_folder(listed(name), F.concat(F.lit(top), folder)), f"{name} must lie in the benchmark's folder"),
            _no(_unlike(listed(name)), f"{name} must differ by more than case"),
        ]
    checks += [
        _no(c("expected_count") >= 0, "expected_count must be a nonnegative integer"),
        _no(F.trim("license") != "", "license must be a nonempty string"),
        _no(c("source_url").rlike(SOURCE_URL), "source_url must be an HTTP(S) URL without embedded credentials"),
        _no(c("redistribution_authorized").isNotNull(), "redistribution_authorized must be an explicit boolean"),
        _no(F.size(F.json_object_keys("evaluation")) > 0, "evaluation must be a nonempty JSON object"),
        *[_optional(n, _is_object(c(n)), f"{n} must be a JSON object") for n in ("preprocessing", "metadata")],
        _no(F.forall(variables, lambda e: e["key"].rlike(ENVIRONMENT_NAME)), "legacy_environment names must be upper case"),
        _no(
            F.forall(variables, lambda e: plain(e["value"])),
            "legacy_environment values must be JSON scalars or lists of them",
        ),
        _no(F.forall(of_paths, lambda e: ~plain(e["value"]) | is_text(e["value"]) & path_error(unquoted(e["value"])).isNull()), "legacy_environment paths must be repository paths"),
        _no(F.forall(entries, lambda e: path_error(e["key"]).isNull() & is_sha256(e["value"])), "checksums must map repository paths to sha256"),
        _no(_unlike(summed), "checksum paths must differ by more than case"),
        _no(_unlike(every, repeats=True), "manifest paths must not differ by case only"),
    ]
    return df.withColumn("errors", errors_of(*checks))


def evaluation_errors(df: DataFrame) -> DataFrame:
    """Adds ``errors`` to evaluation rows (V5).

    Columns: schema_version, eval_task, benchmark, split, sample_id, family, problem, problem_type, source, answer
    (JSON text), images, videos, choices and subtitles (lists, the last two may be null), artifacts (list, may be null),
    and preprocessed, task_payload, metadata, evaluation as JSON text or null.
    """
    c, folder = F.col, benchmark_folder(F.col("benchmark"))
    filled = lambda x: F.coalesce(F.trim(x) != "", F.lit(False))
    known = is_dataset_id(c("benchmark"))
    media = lambda n, kind: ~known | _in_folder(c(n), F.concat(F.lit("media/"), folder, F.lit(f"/{kind}")))
    checks = [
        _no(c("schema_version") == SCHEMA_VERSION, f"schema_version must be {SCHEMA_VERSION}"),
        *_identifiers("eval_task", "benchmark", "split"),
        _no(filled(c("sample_id")), "sample_id must be a nonempty string"),
        _no(c("sample_id").isNull() | (F.regexp_replace("sample_id", r"(?U)^\s+|\s+$", "") == c("sample_id")) | ~filled(c("sample_id")), "sample_id must not contain surrounding whitespace"),
        _optional("family", is_dataset_id(c("family")), "family must be a lowercase snake_case identifier"),
        *[_no(filled(c(n)), f"{n} must be a nonempty string") for n in ("problem", "problem_type", "source")],
        _no(~c("answer").rlike(r'^\s*(""|null|\[\s*\]|\{\s*\}|"\s+")?\s*$'), "answer must have content"),
        _no(F.size(F.coalesce(c("images"), F.array())) + F.size(F.coalesce(c("videos"), F.array())) > 0, "at least one image or video is required"),
        _optional("choices", F.forall("choices", filled), "choices must be nonempty strings"),
        _optional("subtitles", F.forall("subtitles", filled), "subtitles must hold repository paths"),
        *[_optional(n, _is_object(c(n)), f"{n} must be a JSON object") for n in ("preprocessed", "task_payload", "metadata", "evaluation")],
        *[_optional(n, media(n, n), f"{n} must lie in the benchmark's folder") for n in ("images", "videos", "subtitles")],
        _optional("artifacts", ~known | _in_folder(c("artifacts"), F.concat(F.lit("artifacts/"), folder)), "artifacts must lie in the benchmark's folder"),
    ]
    return df.withColumn("errors", errors_of(*checks))


def _numbers(items: Column, count: int | None = None) -> Column:
    """A list of text as doubles; null unless all are numbers and there are ``count`` of them."""
    read = F.transform(items, lambda x: F.when(x == "true", 1.0).when(x == "false", 0.0).otherwise(x.try_cast("double")))
    ok = F.forall(read, lambda x: x.isNotNull())
    return F.when(ok & (F.size(items) == count) if count is not None else ok, read)


def segmentation_prompt(prompt: Column) -> Column:
    """Box, points and time of a prompt in JSON text (X12): a list of one box counts as that box; what is unfit is null."""
    raw = F.from_json(prompt, "boxes string, positive_points string, negative_points string, time string")
    nested = F.from_json(raw["boxes"], "array<array<string>>")
    box = F.coalesce(_numbers(F.from_json(raw["boxes"], "array<string>"), 4), F.when(F.size(nested) == 1, _numbers(F.get(nested, F.lit(0)), 4)))

    def points(name: str) -> Column:
        read = F.transform(F.from_json(raw[name], "array<array<string>>"), lambda p: _numbers(p, 2))
        return F.when((F.size(read) > 0) & F.forall(read, lambda p: p.isNotNull()), read)

    return F.struct(
        box.alias("boxes"), points("positive_points").alias("positive_points"), points("negative_points").alias("negative_points"),
        raw["time"].try_cast("double").alias("time"),
    )


def is_valid_prompt(prompt: Column, data_type: Column) -> Column:
    """Whether a segmentation prompt is complete: a box, points of both kinds, and a time where it is for a video."""
    read = segmentation_prompt(prompt)
    whole = read["boxes"].isNotNull() & read["positive_points"].isNotNull() & read["negative_points"].isNotNull()
    return whole & (~data_type.eqNullSafe(F.lit("video")) | read["time"].isNotNull())
