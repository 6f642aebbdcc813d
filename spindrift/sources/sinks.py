"""Writers (K1-K6); JSON lines are in ``jsonl``."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.sources.jsonl import write_jsonl

__all__ = ["log_metrics", "write_batch", "write_jsonl", "write_manifest", "write_results"]


def _replace(path: str, chunks) -> None:
    """Write beside the target and rename, so that readers see the old file or the whole new one."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    fd, temporary = tempfile.mkstemp(dir=folder, prefix=".partial-")
    try:
        with os.fdopen(fd, "w", encoding="utf-8") as f:
            for c in chunks:
                f.write(c)
        os.replace(temporary, path)
    except BaseException:
        os.unlink(temporary)
        raise


def write_manifest(value: dict, path: str) -> None:
    """An indented JSON document with sorted keys (K2)."""
    _replace(path, [json.dumps(value, ensure_ascii=False, indent=2, sort_keys=True, allow_nan=False) + "\n"])


def write_results(df: DataFrame, path: str) -> None:
    """Result rows as JSON files (K3), at any size."""
    df.write.mode("overwrite").json(path)


def write_batch(df: DataFrame, path: str) -> None:
    """A batch of columns (K5) as Parquet."""
    df.write.mode("overwrite").parquet(path)


def log_metrics(df: DataFrame, path: str, step: int) -> None:
    """Append a (metric, value) table to a metric log (K6)."""
    df.select(F.lit(step).cast("long").alias("step"), "metric", F.col("value").cast("double").alias("value")).write.mode("append").parquet(path)
