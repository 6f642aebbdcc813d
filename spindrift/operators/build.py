"""The whole dataset build: sources and benchmarks in, train and held-out rows with an audit out."""

from __future__ import annotations

import json
import os
import posixpath
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions import text as tx
from spindrift.operators import dataset as ds
from spindrift.session import durable, observed
from spindrift.sources.records import read_records
from spindrift.sources.sinks import write_jsonl, write_manifest

# Names that a field may go by, in order.
PROBLEM = ("problem", "question", "prompt")
ANSWER = ("answer", "ground_truth", "oracle_label", "oracle_labels", "solution")
MEDIA = {"images": ("images", "image", "image_path"), "videos": ("videos", "video", "video_path")}
PATH_KEYS = ("path", "video", "image", "video_path", "image_path", "file_name")
MASK_KEYS = ("segmentation_rle", "rle", "mask", "masks")


@dataclass(frozen=True)
class Source:
    """One source of candidates; media_root binds relative paths."""

    name: str
    input: str
    task: str
    quota: int
    family: str | None = None
    media_root: str | None = None
    keep_type: bool = False


def _first(record: dict, names: tuple[str, ...]):
    return next((record[n] for n in names if record.get(n) is not None), None)


def _spoken(record: dict, role: str, last: bool):
    said = [m["content"] for m in record.get("messages") or [] if isinstance(m, dict) and str(m.get("role") or "").casefold() == role and m.get("content") is not None]
    return said[-1 if last else 0] if said else None


def path_of(entry) -> str | None:
    if isinstance(entry, dict):
        entry = next((entry[k] for k in PATH_KEYS if isinstance(entry.get(k), str) and entry[k].strip()), None)
    return entry.strip() or None if isinstance(entry, str) else None


def _bind(entry, root: str | None):
    if isinstance(entry, str):
        return tx.bind_path(entry, root)
    if isinstance(entry, dict):
        return {k: tx.bind_path(v, root) if k in PATH_KEYS and isinstance(v, str) and v.strip() else v for k, v in entry.items()}
    return entry


def canonical(raw: dict, task: str | None, source: str, family: str | None, root: str | None, keep_type: bool = True) -> dict:
    """The canonical record (N4): fields by alias, media bound to the root, other keys kept."""
    out = {k: v for k, v in raw.items() if k not in ("image", "video", "image_path", "video_path")}
    problem, answer = _first(raw, PROBLEM), _first(raw, ANSWER)
    out["problem"] = _spoken(raw, "user", False) if problem is None else problem
    out["answer"] = _spoken(raw, "assistant", True) if answer is None else answer
    for field, names in MEDIA.items():
        value = _first(raw, names)
        out[field] = [_bind(v, root) for v in (value if isinstance(value, list) else [] if value is None else [value])]
    out["problem_type"] = (raw.get("problem_type") or task) if keep_type else task
    out["source"] = source
    if family is not None:
        out["family"] = family
    return out


def faults(record: dict) -> list[str]:
    """What is wrong with a canonical record."""
    found = [f"{n} must be a nonempty string" for n in ("problem", "problem_type", "source") if not isinstance(record.get(n), str) or not record[n].strip()]
    output = (record.get("task_payload") or {}).get("segmentation_output") if isinstance(record.get("task_payload"), dict) else None
    masked = str(record.get("problem_type") or "").strip().casefold() == "segmentation" and isinstance(output, dict)
    masked = masked and (tx.has_content(output.get("counts")) and tx.has_content(output.get("size")) or any(tx.has_content(output.get(k)) for k in MASK_KEYS))
    if not tx.has_content(record.get("answer")) and not masked:
        found.append("answer must contain a nonempty oracle label")
    media = [m for f in MEDIA for m in record[f]]
    found += ["media must contain nonempty local paths"] * any(path_of(m) is None for m in media)
    return found + ["at least one image or video is required"] * (not media)


def described(record: dict) -> tuple[str, str, list[str], list[str]]:
    """Identity, digest, anchors and leakage tokens."""
    anchors = sorted({tx.fold_path(p) for f in MEDIA for m in record[f] if (p := path_of(m))})
    digest = tx.sha256(tx.canonical_json(record))
    return tx.identity_of(record["problem"], record["problem_type"], anchors), digest, anchors, tx.leakage_tokens(anchors)


def load_candidates(spark: SparkSession, sources: list[Source]) -> DataFrame:
    """Candidates of all sources; an invalid record stops the build and says which."""

    def one(s: Source) -> DataFrame:
        root = s.media_root or posixpath.dirname(s.input.removeprefix("file://"))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                rows = []
                for ordinal, text in zip(pdf["ordinal"], pdf["record"], strict=True):
                    try:
                        record = canonical(json.loads(text), s.task, s.name, s.family, root, s.keep_type)
                        wrong = faults(record)
                    except ValueError as error:
                        wrong = [str(error)]
                    if wrong:
                        raise ValueError(f"{s.name} record {ordinal}: " + "; ".join(wrong))
                    rows.append((s.name, ordinal, record["problem_type"], s.family or record.get("family"), *described(record), tx.canonical_json(record)))
                yield pd.DataFrame(rows, columns=["source", "source_index", "task", "family", "identity", "digest", "anchors", "tokens", "record"])

        schema = "source string, source_index long, task string, family string, identity string, digest string, anchors array<string>, tokens array<string>, record string"
        return read_records(spark, s.input).mapInPandas(run, schema)

    rows = reduce(DataFrame.union, [one(s) for s in sources])
    return durable(rows.withColumn("row_id", F.xxhash64("source", "source_index")))


def load_exclusions(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """Identities and tokens of benchmark rows, which may lack answers, types and prompts (F1)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, text in zip(pdf["path"], pdf["record"], strict=True):
                raw = json.loads(text)
                given = raw.get("prompt_identity", raw.get("identity"))
                asked = any(isinstance(raw.get(k), str) and raw[k].strip() for k in PROBLEM)
                loose = {**raw, "answer": "-", "problem_type": raw.get("problem_type") or "benchmark", **({} if asked else {"problem": "-"})}
                if not any(raw.get(n) for names in MEDIA.values() for n in names) and (media := raw.get("media", raw.get("media_path", raw.get("path")))):
                    loose["videos"] = media
                try:
                    record = canonical(loose, None, "benchmark", None, posixpath.dirname(path.removeprefix("file://").removeprefix("//")))
                    valid = not faults(record)
                except ValueError:
                    valid = False
                identity, _, _, tokens = described(record) if valid else (None, None, None, [])
                rows.append((given if isinstance(given, str) else None, identity if asked and raw.get("problem_type") else None, tokens, valid))
            yield pd.DataFrame(rows, columns=["explicit_identity", "computed_identity", "tokens", "valid"])

    schema = "explicit_identity string, computed_identity string, tokens array<string>, valid boolean"
    if not paths:
        return spark.createDataFrame([], "identity string"), spark.createDataFrame([], "token string")
    return ds.exclusions(read_records(spark, paths).mapInPandas(run, schema))


def build_dataset(
    spark: SparkSession, sources: list[Source], benchmarks: list[str], seed: int = 17, target: int | None = None,
    canary_size: int = 512, cap: int = 2, allow_shortfall: bool = False,
) -> dict[str, DataFrame]:
    """train, canary and audit (E1). Nothing is written; a shortfall or a leak is raised before anything could be."""
    if target is not None and target != sum(s.quota for s in sources):
        raise ValueError("the target must equal the sum of the quotas")
    candidates = load_candidates(spark, sources)
    identities, tokens = (durable(x) for x in load_exclusions(spark, benchmarks))
    marked, leaked = observed(ds.mark_leakage(candidates, identities, tokens), ds.leakage_measures())
    clean = durable(ds.drop_leakage(marked))
    quotas = spark.createDataFrame([(s.name, s.quota) for s in sources], "source string, quota long")
    decided = ds.select_train(clean, quotas, seed, cap)
    if not allow_shortfall:
        ds.require_no_shortfall(ds.shortfalls(decided, quotas))
    rows = [F.count("*").alias("rows")]
    train, in_train = observed(decided.where("verdict = 'taken'"), rows)
    canary, in_canary = observed(ds.select_canary(clean, train, canary_size, seed, cap).where("verdict = 'taken'"), rows)
    leaks = durable(ds.output_leakage(train, canary, identities, tokens))
    if bad := leaks.where("rows > 0").collect():
        raise ValueError("outputs leak: " + ", ".join(r["check"] for r in bad))
    counted = [(section, metric, n) for section, x in (("leakage", leaked), ("train", in_train), ("canary", in_canary)) for metric, n in x.items()]
    audit = ds.audit({"duplicates": ds.duplicate_stats(candidates)}).union(leaks.select(F.lit("output_leakage"), "check", "rows"))
    audit = audit.union(spark.createDataFrame(counted, "section string, metric string, value long"))
    return {"train": ds.output_order(train, seed, "train-output"), "canary": ds.output_order(canary, seed, "canary-output"), "audit": audit}


def write_dataset(parts: dict[str, DataFrame], folder: str, split: bool = False) -> None:
    """train.jsonl, canary.jsonl and manifest.json; equal inputs give equal bytes. With ``split`` folders of part files."""
    os.makedirs(folder, exist_ok=True)
    for name in ("train", "canary"):
        write_jsonl(parts[name].select("record"), f"{folder}/{name}.jsonl", raw=True, parts=split)
    manifest: dict = {}
    for r in parts["audit"].collect():  # a few counters
        manifest.setdefault(r["section"], {})[r["metric"]] = r["value"]
    write_manifest(manifest, f"{folder}/manifest.json")
