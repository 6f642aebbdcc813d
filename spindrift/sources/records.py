"""Readers of JSON records and tables."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindrift.sources.containers import CONTAINERS, WRAPPERS, read_containers


def read_jsonl(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """path, ordinal, record (VARIANT), error (S1, S3). Blank lines are skipped; ordinal grows down a file.

    Rows need no common schema. With ``strict`` a line that is no JSON object stops the query with path and ordinal.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("ordinal"), "value")
    parsed = lines.where(F.trim("value") != "").withColumn("record", F.try_parse_json("value"))
    fails = F.col("record").isNull() | ~F.schema_of_variant("record").startswith("OBJECT")
    where = F.concat_ws(":", "path", "ordinal")
    error = F.when(fails, F.concat(F.lit("not a JSON object: "), where))
    out = parsed.withColumn("error", error)
    if strict:
        out = out.withColumn("record", F.when(fails, F.raise_error(error).cast("variant")).otherwise(F.col("record")))
    return out.select("path", "ordinal", "record", "error")


def unwrap(text: str) -> list[dict]:
    """Records of a JSON text (S2): a list, a wrapper object, a lone object, or else one record a line."""
    try:
        value = json.loads(text)
    except ValueError:
        value = [json.loads(line) for line in text.splitlines() if line.strip()]
    if isinstance(value, dict):
        value = next((value[k] for k in WRAPPERS if isinstance(value.get(k), list)), [value])
    if not isinstance(value, list) or any(not isinstance(r, dict) for r in value):
        raise ValueError("records must be JSON objects")
    return value


def flatten_container(text: str) -> list[dict]:
    """Records of a container file (S8): a list, a named list inside an object, or a map of objects in key order."""
    value = json.loads(text)
    if isinstance(value, dict):
        inner = next((value[k] for k in CONTAINERS if isinstance(value.get(k), (list, dict))), value)
        if isinstance(inner, dict):
            inner = [{**({"id": k} if "id" not in v else {}), **v} for k, v in sorted(inner.items()) if isinstance(v, dict)]
        value = inner
    return value


def read_documents(spark: SparkSession, path: str | list[str], members: bool = False) -> DataFrame:
    """path, ordinal, record (JSON text) of whole JSON files (S2), or with ``members`` of containers (S8), read by ranges."""
    return read_containers(spark, path, CONTAINERS if members else WRAPPERS, members)


LINE_FILES = (".jsonl", ".ndjson")


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path, ordinal, record (JSON text) of files with a JSON object in every line that is not blank.

    A file is read in splits by many tasks. The ordinal counts the records of a file from 0: places inside a split and
    the records of the splits before it; both scans cut the files alike. Any other line stops the query.
    """
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_at"), "value")
    lines = raw.where(F.col("value").rlike(r"\S")).withColumn("_n", F.monotonically_increasing_id())
    splits = lines.groupBy("path", "_at").agg(F.min("_n").alias("_first"), F.count("*").alias("_rows"))
    ahead = Window.partitionBy("path").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)  # one row a split
    shifts = splits.select("path", "_at", (F.coalesce(F.sum("_rows").over(ahead), F.lit(0)) - F.col("_first")).alias("_shift"))
    out = lines.join(shifts, ["path", "_at"]).withColumn("ordinal", F.col("_n") + F.col("_shift"))
    bad = F.raise_error(F.concat(F.lit("not a JSON object: "), F.concat_ws(":", "path", "ordinal"))).cast("string")
    return out.select("path", "ordinal", F.when(F.col("value").rlike(r"^\s*\{"), F.col("value")).otherwise(bad).alias("record"))


def read_records(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, ordinal, record of files by suffix (S2): lines of JSON, or whole JSON files; both are read by many tasks."""
    given = [paths] if isinstance(paths, str) else list(paths)
    lined = [p for p in given if p.lower().endswith(LINE_FILES)]
    whole = [p for p in given if p not in lined]
    parts = [read(spark, files) for read, files in ((read_lines, lined), (read_documents, whole)) if files]
    return reduce(DataFrame.union, parts)


def read_split(spark: SparkSession, location: str) -> DataFrame:
    """A table by suffix (S4): name@split chooses the subfolder or file of a split."""
    path, _, split = location.partition("@")
    if split:
        path = f"{path.rstrip('/')}/{split}"
    kind = path.rsplit(".", 1)[-1].lower()
    if kind in ("json", "jsonl"):
        return spark.read.json(path)
    if kind in ("csv", "tsv"):
        return spark.read.csv(path, header=True, sep="\t" if kind == "tsv" else ",", multiLine=True)
    return spark.read.parquet(path)


def read_image_table(spark: SparkSession, path: str, image: str = "image") -> DataFrame:
    """A TSV table whose image column holds base64."""
    rows = spark.read.csv(path, sep="\t", header=True, multiLine=True, escape='"')
    return rows.withColumn(image, F.unbase64(image))


def expand_spans(df: DataFrame) -> DataFrame:
    """One row for each query and span of a video (S7): video, queries ARRAY<STRING>, spans ARRAY<ARRAY<DOUBLE>>.

    Lists of different length are an error; the id is the video and the place of the query in six digits.
    """
    bad = F.raise_error(F.lit("queries and spans differ in number")).cast("array<struct<query:string,span:array<double>>>")
    pairs = F.when(F.size("queries") == F.size("spans"), F.arrays_zip(F.col("queries").alias("query"), F.col("spans").alias("span"))).otherwise(bad)
    out = df.select("video", F.posexplode(pairs).alias("n", "x"))
    return out.select(F.format_string("%s:%06d", "video", "n").alias("id"), "video", F.col("x.query").alias("query"), F.col("x.span").alias("span"))


def gate_counts(df: DataFrame, group: str, expected: dict[str, int], expected_total: int | None) -> DataFrame:
    """df, if its group counts are those of the full release (S11); checked only for the official total."""
    if expected_total == sum(expected.values()):
        got = {r[0]: r[1] for r in df.groupBy(group).count().limit(len(expected) + 1).collect()}
        if got != expected:
            raise ValueError(f"{group} counts differ from the release: {got}")
    return df


def load_config(path: str) -> dict:
    """A YAML or JSON mapping (S12), read on the driver."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as error:
            raise RuntimeError("YAML settings need the yaml package; JSON works without it") from error
        value = yaml.safe_load(text)
    else:
        value = json.loads(text)
    if not isinstance(value, dict):
        raise ValueError("settings must be a mapping")
    return value
