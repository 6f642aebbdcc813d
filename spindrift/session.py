"""Session construction and durable checkpoints shared by every operator."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def build_session(app: str = "spindrift", cores: int | str = "*", shuffle: int = 8) -> SparkSession:
    """A local session with the settings that the engine assumes; a cluster supplies its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use spark.checkpoint.dir where the session names one; a temporary folder only where it is unset, and not on a cluster."""
    context = spark.sparkContext
    shared = context.getConf().get("spark.checkpoint.dir", None)
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if shared is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spindrift-checkpoint-"))


def durable(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder and cut its lineage; it survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def observed(df: DataFrame, measures: list[Column]) -> tuple[DataFrame, dict]:
    """durable(df) and aggregates over its rows, taken in the pass that writes them."""
    seen = Observation()
    return durable(df.observe(seen, *measures)), seen.get


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder for tables beside the checkpoints, which the driver and all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
