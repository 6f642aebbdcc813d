"""Benchmark repository checks, inventory and merges."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.session import durable

# Identifiers and paths of a repository.
DATASET_ID = r"^[a-z][a-z0-9]*(_[a-z0-9]+)*$"
SHA256 = r"^[0-9a-f]{64}$"
GROUPS = {
    **dict.fromkeys(("videomme", "videommev2", "videommmu", "mmvu", "mvbench", "videoholmes", "longvideobench", "lvbench", "mlvu"), "video_qa"),
    **dict.fromkeys(("vsi", "mmsi", "mindcube", "revsi"), "spatial_intelligence"),
    "stvg": "spatial_temporal_grounding",
}
MEDIA_KINDS = ("images", "videos", "frames", "masks", "subtitles")
SIZE_CLASSES = ("n<1K", "1K<n<10K", "10K<n<100K", "100K<n<1M", "1M<n<10M", "10M<n<100M", "100M<n<1B", "n>1B")
# What must not be published: credentials, and paths of private machines.
SECRETS = {
    "assigned_secret": r"(?i)\b(?:api[_-]?key|access[_-]?token|auth[_-]?token|password|secret)\b\s*[:=]\s*['\"]?[A-Za-z0-9_./+=-]{12,}",
    "aws_key": r"\bAKIA[0-9A-Z]{16}\b",
    "access_token": r"\b(?:gh[pousr]|hf)_[A-Za-z0-9]{20,}\b",
    "url_credentials": r"://[^/\s:@]+:[^@\s/]+@",
    "private_key": r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----",
    "home_path": r"/(?:home|Users)/[A-Za-z0-9._-]+",
    "private_path": r"/(?:mnt|data/users?)/[A-Za-z0-9._-]+|/root(?:/|\b)",
    "address": r"\b(?:10|192\.168|172\.(?:1[6-9]|2[0-9]|3[01]))(?:\.[0-9]{1,3}){2,3}\b",
}
# Folders that tools generate, and suffixes of files that are no source.
GENERATED = (
    ".nox", ".tox", ".venv", ".mypy_cache", ".pytest_cache", ".ruff_cache", "__pycache__", "artifacts", "build",
    "cache", "checkpoints", "dist", "htmlcov", "logs", "outputs", "runs", "venv",
)
ARTIFACTS = (
    ".arrow", ".avi", ".bin", ".ckpt", ".jsonl", ".mkv", ".mov", ".mp4", ".npy", ".npz", ".parquet", ".pt", ".pth",
    ".pyc", ".safetensors", ".so", ".webm",
)


def _say(bad: Column, text: str | Column) -> Column:
    return F.when(bad, F.lit(text) if isinstance(text, str) else text)


def errors_of(*checks: Column) -> Column:
    """The messages of the checks that fail."""
    return F.array_compact(F.array(*checks))


def is_dataset_id(name: Column) -> Column:
    return F.coalesce(name.rlike(DATASET_ID), F.lit(False))


def is_sha256(value: Column) -> Column:
    return F.coalesce(value.rlike(SHA256), F.lit(False))


def path_error(path: Column) -> Column:
    """What is wrong with a repository path, or null (V1)."""
    parts = F.split(path, "/")
    has = lambda p: F.array_contains(parts, p)
    return (
        F.when(path.isNull() | (path == ""), "must be a nonempty relative path")
        .when(path.rlike(r"^\s|\s$|[\x00-\x1F]"), "must not contain surrounding blanks or controls")
        .when(path.contains("\\"), "must use / separators")
        .when(path.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), "must not be a URL")
        .when(path.startswith("/") | (path == "~") | path.startswith("~/"), "must be relative")
        .when(has(".."), "must not contain ..")
        .when(has(".") | has(""), "must be normalized")
    )


def benchmark_folder(benchmark: Column) -> Column:
    """group/benchmark, or the benchmark alone (V2)."""
    group = F.try_element_at(F.create_map(*[F.lit(x) for kv in GROUPS.items() for x in kv]), benchmark)
    return F.concat_ws("/", group, benchmark)


def annotation_path(benchmark: Column, split: Column) -> Column:
    return F.concat(F.lit("annotations/"), benchmark_folder(benchmark), F.lit("/"), split, F.lit(".jsonl"))


def is_within(path: Column, folder: Column) -> Column:
    """Whether a path is a folder or lies below it."""
    return (path == folder) | path.startswith(F.concat(folder, F.lit("/")))


def layout_errors(benchmark: Column, split: Column, annotation: Column, media: Column) -> Column:
    """V2 for a record: ids, the annotation path, and media paths below the benchmark's folder."""
    folder = F.concat(F.lit("media/"), benchmark_folder(benchmark))
    bad_media = F.exists(media, lambda m: path_error(m).isNotNull() | ~is_within(m, folder) | (m == folder))
    return errors_of(
        _say(~is_dataset_id(benchmark), "benchmark must be a lowercase snake_case identifier"),
        _say(~is_dataset_id(split), "split must be a lowercase snake_case identifier"),
        _say(~annotation.eqNullSafe(annotation_path(benchmark, split)), "annotation_path is not canonical"),
        _say(F.coalesce(bad_media, F.lit(False)), "media paths must lie below the benchmark's folder"),
    )


def path_collisions(paths: DataFrame, path: str = "path") -> DataFrame:
    """Paths that repeat or differ only by case (V3): folded, spellings, rows."""
    out = paths.groupBy(F.lower(path).alias("folded")).agg(F.count_distinct(path).alias("spellings"), F.count("*").alias("rows"))
    return out.where("rows > 1")


def check_files(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Assets that are missing, or whose size or checksum differs (V4): path, problem."""
    f = files.select(F.col("path").alias("_p"), F.col("bytes").alias("_b"), F.col("sha256").alias("_s"))
    problem = F.when(F.col("_p").isNull(), "missing").when(F.col("bytes") != F.col("_b"), "size").when(F.col("sha256") != F.col("_s"), "checksum")
    return manifest.join(f, F.col("path") == F.col("_p"), "left").select("path", problem.alias("problem")).where("problem IS NOT NULL")


def evaluation_set_errors(df: DataFrame) -> DataFrame:
    """What is wrong between evaluation rows (V6): kind, value, first_row, rows."""
    ids = df.groupBy("sample_id").agg(F.min("row_id").alias("first_row"), F.count("*").alias("rows")).where("rows > 1")
    folded = df.groupBy(F.lower("sample_id").alias("sample_id")).agg(F.min("row_id").alias("first_row"), F.count_distinct("sample_id").alias("rows")).where("rows > 1")
    one = df.groupBy(F.concat_ws("/", "eval_task", "benchmark", "split").alias("k")).agg(F.min("row_id").alias("first_row"), F.count("*").alias("rows"))
    total = one.agg(F.count("*").alias("_n"))  # one row
    mixed = one.crossJoin(F.broadcast(total)).where("_n > 1").select("k", "first_row", "rows")
    say = lambda d, kind, value: d.select(F.lit(kind).alias("kind"), F.col(value).alias("value"), "first_row", "rows")
    return say(ids, "duplicate_id", "sample_id").union(say(folded, "case_collision", "sample_id")).union(say(mixed, "mixed_identity", "k"))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that repeat (V7)."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1")


def checksum_conflicts(df: DataFrame) -> DataFrame:
    """Paths that go with several checksums (V7)."""
    return df.where("sha256 IS NOT NULL").groupBy("path").agg(F.count_distinct("sha256").alias("checksums")).where("checksums > 1")


def asset_errors(df: DataFrame, order: str = "row_id") -> DataFrame:
    """Adds ``errors`` to asset records, and whether each stands behind the path before it in order (V8).

    Neighbours are found by a global rank, so ids may have gaps and rows stay spread over tasks.
    """
    from spindrift.operators.dataset import global_rank

    ranked = global_rank(df, [order])
    before = ranked.select((F.col("rank") + 1).alias("rank"), F.col("path").alias("_before"))
    out = ranked.join(before, "rank", "left").drop("rank")
    checks = [
        _say(path_error(F.col("path")).isNotNull(), F.concat(F.lit("path "), path_error(F.col("path")))),
        _say(F.coalesce(F.col("bytes") < 0, F.lit(True)), "bytes must not be negative"),
        _say(F.col("sha256").isNotNull() & ~is_sha256(F.col("sha256")), "sha256 must be 64 hexadecimal digits"),
        _say(F.coalesce(F.col("_before") >= F.col("path"), F.lit(False)), "assets must be sorted by path"),
    ]
    return out.withColumn("errors", errors_of(*checks)).drop("_before")


def compare_paths(left: DataFrame, right: DataFrame) -> DataFrame:
    """Paths of one side only (V9): path, side."""
    a = left.select("path").distinct().withColumn("_l", F.lit(True))
    b = right.select("path").distinct().withColumn("_r", F.lit(True))
    both = a.join(b, "path", "full").where("_l IS NULL OR _r IS NULL")
    return both.select("path", F.when(F.col("_r").isNull(), "left").otherwise("right").alias("side"))


def runtime_checks(datasets: DataFrame, rows: DataFrame, references: DataFrame, assets: DataFrame) -> DataFrame:
    """Datasets whose row count differs, and referenced paths without an asset (V10): kind, value, expected, found."""
    got = rows.groupBy("dataset").agg(F.count("*").alias("found"))
    counts = datasets.join(got, "dataset", "left").fillna(0, ["found"]).where("expected != found")
    absent = references.select("path").distinct().join(assets, "path", "left_anti")
    none = F.lit(None).cast("long")
    return counts.select(F.lit("count").alias("kind"), F.col("dataset").alias("value"), F.col("expected").cast("long").alias("expected"), "found").union(
        absent.select(F.lit("asset"), "path", none, none)
    )


def profile_conflicts(df: DataFrame, key: str = "benchmark", profile: str = "profile") -> DataFrame:
    """Benchmarks whose splits name different profiles."""
    return df.groupBy(key).agg(F.count_distinct(profile).alias("profiles")).where("profiles > 1")


def hygiene(files: DataFrame, patterns: dict[str, str] | None = None, terms: tuple[str, ...] = (), largest: int | None = None) -> DataFrame:
    """Findings in (path, text) rows (V12): path, rule, hits, and the line of the first hit (null for rules on the path).

    Rules on the path find generated folders and artifact files; ``terms`` may stand neither in path nor text, whatever
    their case; ``largest`` bounds the bytes of a file.
    """
    rules = dict(SECRETS if patterns is None else patterns)
    if terms:
        rules["excluded_term"] = "(?i)" + "|".join(re.escape(t) for t in terms)
    path, none = F.lower("path"), F.lit(None).cast("int")
    finding = lambda rule, hits, line: F.struct(F.lit(rule).alias("rule"), hits.cast("int").alias("hits"), line.alias("line"))
    line = lambda p: F.size(F.split(F.substr("text", F.lit(1), F.greatest(F.regexp_instr("text", F.lit(p)) - 1, F.lit(0))), "\n"))
    found = [finding(n, F.regexp_count("text", F.lit(p)), line(p)) for n, p in sorted(rules.items())]
    if patterns is None:
        parts = F.split(path, "/")
        made = F.exists(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda x: x.isin(*GENERATED) | x.endswith(".egg-info"))
        found.append(finding("generated_folder", made, none))
        found.append(finding("artifact_file", path.rlike("(" + "|".join(re.escape(x) for x in ARTIFACTS) + ")$"), none))
    if terms:
        found.append(finding("excluded_term_in_path", F.regexp_count(path, F.lit(rules["excluded_term"])), none))
    if largest is not None:
        found.append(finding("too_large", F.octet_length("text") > largest, none))
    hits = F.filter(F.array(*found), lambda x: x["hits"] > 0)
    return files.select("path", F.explode_outer(hits).alias("x")).where("x IS NOT NULL").select("path", "x.*")


# Settings that the oracle recipe needs, and numbers that must be finite and above zero.
RECIPE = {
    "adv_estimator": "grpo",
    "scale_rewards": False,
    "oracle_injection": True,
    "oracle_injection_mode": "append",
    "calculate_log_probs": False,
    "selection_keep_oracle": True,
    "selection_strict_sign_balance": True,
    "directional_gain": True,
    "directional_gain_positive_only": True,
    "directional_gain_recenter": True,
    "detached_oracle_advantage": True,
    "detached_oracle_use_directional_gain": False,
    "post_selection_recenter": True,
    "post_selection_rms_match": True,
}
ABOVE_ZERO = ("directional_gain_gamma", "detached_oracle_advantage_scale", "oracle_reward_gate_beta")


def layout_faults(n: Column, prune: Column, positives: Column, negatives: Column, batch: Column, nodes: Column, devices: Column) -> Column:
    """Batch settings that do not fit each other (V13): n rollouts and the oracle, pruned to both quotas and the oracle.

    The batch with its oracles and the selected one must both divide into the workers. A null setting is a fault.
    """
    bad = lambda ok: ~F.coalesce(ok, F.lit(False))
    keep = F.greatest(F.lit(1), F.floor(n * (1 - prune)))
    workers = nodes * devices
    sized = (nodes > 0) & (devices > 0) & (batch > 0)
    whole = lambda rows: F.when(sized, F.try_mod(rows, workers) == 0).otherwise(True)
    return errors_of(
        _say(bad(n > 1), "n must be above 1"),
        _say(bad((prune > 0) & (prune < 1)), "selection_prune_ratio must lie between 0 and 1"),
        _say(bad((positives >= 0) & (negatives >= 0)), "quotas must not be negative"),
        _say(bad(positives + negatives + 1 == keep), "quotas and the oracle must fill the kept rows"),
        _say(bad(sized), "nodes, devices and batch must be positive"),
        _say(bad(whole(batch * keep)), "the selected batch must divide into the workers"),
        _say(bad(whole(batch * (n + 1))), "the batch with oracles must divide into the workers"),
    )


def recipe_faults(df: DataFrame) -> Column:
    """Settings of a run, one column each, that the oracle recipe does not allow (V13); a null setting is a fault."""
    bad = lambda ok: ~F.coalesce(ok, F.lit(False))
    above = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.col(c) > 0) & (F.col(c) < float("inf"))
    fixed = [_say(bad(F.col(k) == F.lit(v)), f"{k} must be {str(v).lower()}") for k, v in RECIPE.items()]
    positive = [_say(bad(above(k)), f"{k} must be finite and positive") for k in ABOVE_ZERO]
    low, high = F.col("detached_oracle_match_best_min"), F.col("detached_oracle_match_best_max")
    cap = above("detached_oracle_match_best_ratio") & (low >= 0) & (high >= low) & ~F.isnan(high) & (high < float("inf"))
    return errors_of(
        *fixed,
        *positive,
        _say(bad(F.trim("oracle_builder") != ""), "oracle_builder must be named"),
        _say(bad(cap), "the oracle cap needs a finite positive ratio and 0 <= min <= max"),
        _say(bad(F.col("post_selection_rms_min_scale").between(0, 1)), "post_selection_rms_min_scale must lie in [0, 1]"),
    )


def check_training(rollouts: int, prune: float, positives: int, negatives: int, prompts: int, world_size: int) -> None:
    """Settings that must fit each other."""
    from spindrift.operators.selection import selection_budget

    keep, _, rest = selection_budget(rollouts + 1, prune, positives)
    problems = []
    if rest != negatives:
        problems.append(f"quotas must fill {keep} rows: {positives} positive and {rest} negative")
    if (prompts * keep) % world_size:
        problems.append(f"{prompts * keep} kept rows do not divide into {world_size} workers")
    if problems:
        raise ValueError("; ".join(problems))


# Names of fields that hold paths.
PATH_KEY = r"(?:^|_)(?:path|paths|image|images|video|videos|file|file_name|mask)$"


def discover_paths(df: DataFrame, key: str, document: str, deepest: int = 64) -> DataFrame:
    """Strings that stand under path-like keys anywhere in JSON text (V14): key, place, path.

    Documents are opened level by level: one round explodes all containers of a depth, and those inside them go on to
    the next. Documents that nest deeper than ``deepest`` stop the query; null documents have no paths.
    """
    spark = df.sparkSession
    value = F.parse_json(F.col(document))
    level = df.where(F.col(document).isNotNull()).select(F.col(key).alias("_key"), F.lit("$").alias("_place"), F.lit(False).alias("_named"), value.alias("_value"))
    found = []
    for depth in range(deepest + 1):
        held = level.where(F.schema_of_variant("_value").rlike("^(OBJECT|ARRAY)"))
        parts = held.lateralJoin(spark.tvf.variant_explode(F.col("_value").outer()))
        step = F.when(F.col("key").isNull(), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("."), "key"))
        named = F.when(F.col("key").isNull(), F.col("_named")).otherwise(F.col("key").rlike(PATH_KEY))
        parts = parts.select("_key", F.concat("_place", step).alias("_place"), named.alias("_named"), F.col("value").alias("_value"), F.schema_of_variant("value").alias("_kind"))
        parts = durable(parts.where(F.col("_kind").rlike("^(OBJECT|ARRAY)") | (F.col("_named") & (F.col("_kind") == "STRING"))))
        text = F.try_variant_get("_value", "$", "string")
        found.append(parts.where((F.col("_kind") == "STRING") & text.rlike(r"(?U)\S")).select(F.col("_key").alias(key), F.col("_place").alias("place"), text.alias("path")))
        level = parts.where("_kind <> 'STRING'").drop("_kind")
        if level.isEmpty():
            return reduce(DataFrame.union, found)
    raise ValueError(f"documents nest deeper than {deepest} levels")


def require_selection(available: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Records of the wanted tasks and splits (F8); names that do not exist are an error."""
    absent = wanted.join(available, keys, "left_anti").select(*keys).distinct()
    if rows := absent.limit(20).collect():
        raise ValueError("unknown selection: " + ", ".join("/".join(map(str, r)) for r in rows))
    return available.join(wanted.select(*keys).distinct(), keys, "left_semi")


def assets_under(assets: DataFrame, roots: DataFrame, path: str = "path", root: str = "root") -> DataFrame:
    """Assets that are a root or lie below one.

    Every asset names its own ancestors, so the prefix join is a hash join and no pair of asset and root is made that
    does not match.
    """
    parts = F.split(path, "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    hits = assets.withColumn("_a", F.explode(ancestors)).join(roots.select(F.col(root).alias("_a")).distinct(), "_a", "left_semi")
    return hits.drop("_a").distinct()


def inventory(sources: DataFrame) -> DataFrame:
    """Per source and in all (A17): sources, rows and bytes; the expected total is null if any source is not locked."""
    locked = F.count("expected_count") == F.count("*")
    out = sources.groupingSets([["source"], []], "source").agg(
        F.grouping_id().alias("_g"), F.count("*").alias("datasets"), F.when(locked, F.sum("expected_count")).alias("expected_count"),
        F.sum("bytes").alias("bytes"),
    )
    return out.select(F.when(F.col("_g") == 0, F.coalesce("source", F.lit(""))).otherwise("(all)").alias("source"), "datasets", "expected_count", "bytes")


def unique_assets(assets: DataFrame) -> DataFrame:
    """The first definition of each path."""
    rest = [c for c in assets.columns if c not in ("path", "row_id")]
    return assets.groupBy("path").agg(*[F.min_by(c, "row_id").alias(c) for c in rest])


def card(rows: DataFrame) -> DataFrame:
    """Per benchmark and split (A18): counts, bytes, size class, and the one or many licences."""
    out = rows.groupBy("benchmark", "split").agg(F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"), F.array_sort(F.collect_set("license")).alias("_l"))
    return out.select("benchmark", "split", "rows", "bytes", size_class(F.col("rows")).alias("size"), human_bytes(F.col("bytes")).alias("volume"), F.array_join("_l", ", ").alias("license"))


def card_splits(datasets: DataFrame, assets: DataFrame) -> DataFrame:
    """Splits of a card (A18): benchmark, split, annotation_path, the bytes of its annotation file (0 if none) and its rows."""
    files = assets.where("kind = 'annotations'").groupBy(F.col("path").alias("annotation_path")).agg(F.max("bytes").alias("num_bytes"))
    out = datasets.join(files, "annotation_path", "left")
    return out.select("benchmark", "split", "annotation_path", F.coalesce("num_bytes", F.lit(0)).alias("num_bytes"), F.col("expected_count").alias("num_examples"))


def card_benchmarks(datasets: DataFrame, assets: DataFrame) -> DataFrame:
    """Benchmarks of a card (A18): the distinct tasks, families, licences and addresses of each, its splits, and its sizes.

    Lists are sorted; ``one_or_many`` says one of a single value as itself. A missing family is the task.
    """
    many = lambda c: F.array_sort(F.collect_set(c))
    sizes = card_splits(datasets, assets).groupBy("benchmark").agg(F.sum("num_bytes").alias("dataset_size"), F.sum("num_examples").alias("row_count"))
    told = datasets.groupBy("benchmark").agg(
        many("task").alias("task"), many(F.coalesce("family", "task")).alias("family"), many("license").alias("license"),
        many("source_url").alias("source_url"), F.array_sort(F.collect_list("split")).alias("splits"),
    )
    held = assets.groupBy("benchmark").agg(F.count("*").alias("asset_count"), F.sum("bytes").alias("byte_count"))
    return told.join(sizes, "benchmark").join(held, "benchmark", "left").fillna(0, ["asset_count", "byte_count"])


def card_totals(datasets: DataFrame, assets: DataFrame) -> DataFrame:
    """One row of totals of a card (A18), with the size class of all rows."""
    rows = datasets.agg(F.count_distinct("benchmark").alias("benchmark_count"), F.count("*").alias("split_count"), F.coalesce(F.sum("expected_count"), F.lit(0)).alias("row_count"))
    held = assets.agg(F.count("*").alias("asset_count"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("byte_count"))
    return rows.join(held).withColumn("size_category", size_class(F.col("row_count")))  # one row each


def one_or_many(values: Column) -> Column:
    """JSON text of a list's only value, or of the list."""
    return F.when(F.size(values) == 1, F.regexp_extract(F.to_json(values), r"(?s)^\[(.*)\]$", 1)).otherwise(F.to_json(values))


def size_class(n: Column) -> Column:
    """One of eight classes by powers of ten."""
    out = F.when(n < 1000, SIZE_CLASSES[0])
    for i, name in enumerate(SIZE_CLASSES[1:-1], 1):
        out = out.when(n < 1000 * 10**i, name)
    return out.otherwise(SIZE_CLASSES[-1])


def human_bytes(n: Column) -> Column:
    """Bytes with a binary unit (A19); halves of the last place go to the even digit."""
    x = n.cast("double")
    out = F.when(x < 1024, F.format_string("%.0f B", x))
    for i, unit in enumerate(("KiB", "MiB", "GiB"), 1):
        out = out.when(x < 1024 ** (i + 1), F.format_string(f"%.1f {unit}", F.bround(x / 1024**i, 1)))
    return out.otherwise(F.format_string("%.1f TiB", F.bround(x / 1024**4, 1)))


def family_table(rows: DataFrame, order: list[str]) -> DataFrame:
    """Families in a fixed order, others sorted behind (A20): family, rows, position."""
    place = F.array_position(F.array(*[F.lit(f) for f in order]), F.col("family"))
    out = rows.groupBy("family").agg(F.sum("rows").alias("rows"))
    w = Window.orderBy(F.when(place > 0, place).otherwise(len(order) + 1), "family")  # one row a family
    return out.withColumn("position", F.row_number().over(w))


def merge_assets(*parts: DataFrame) -> DataFrame:
    """Assets of all parts by path (J5): equal definitions count once, different ones are an error."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rest = [c for c in rows.columns if c != "path"]
    out = rows.groupBy("path").agg(F.count_distinct(F.struct(*rest)).alias("_n"), F.first(F.struct(*rest)).alias("_x"))
    clash = F.raise_error(F.concat(F.lit("conflicting definitions of "), "path")).cast("string")
    return out.select(F.when(F.col("_n") > 1, clash).otherwise(F.col("path")).alias("path"), *[F.col(f"_x.{c}").alias(c) for c in rest])


def merge_repositories(base: DataFrame, update: DataFrame, key: str = "benchmark") -> DataFrame:
    """The base with whole benchmarks replaced by those of the update."""
    return base.join(update.select(key).distinct(), key, "left_anti").unionByName(update)


def merge_repository_assets(base: DataFrame, update: DataFrame, references: DataFrame, path: str = "path") -> DataFrame:
    """The assets of a merged repository (J6): those of both sides that a kept record refers to or that lie below a
    referenced folder; equal definitions count once, different ones are an error, and so is a reference without asset.
    """
    merged = merge_assets(base, update)
    wanted = references.select(F.col(path).alias("_r")).where("_r IS NOT NULL").distinct()
    kept = assets_under(merged, wanted, path, "_r")
    parts = F.split(path, "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    absent = wanted.join(kept.select(F.explode(ancestors).alias("_r")).distinct(), "_r", "left_anti")
    if rows := absent.orderBy("_r").limit(20).collect():
        raise ValueError("references without assets: " + ", ".join(r["_r"] for r in rows))
    return kept
