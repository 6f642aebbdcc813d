"""Roles that the test tables play in the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as rollouts: a user is a prompt, the first event its oracle row."""
    events = read(spark, sf_dir, "events")
    w = Window.partitionBy("user_id")
    return events.select(
        F.col("user_id").alias("uid"),
        F.col("event_id").alias("row_id"),
        (F.col("value") / 500).alias("reward"),
        (F.col("event_id") == F.min("event_id").over(w)).alias("is_oracle_row"),
        F.col("event_type").alias("task"),
    )


ROLLOUTS = """r AS (SELECT user_id AS uid, event_id AS row_id, value / 500 AS reward,
  event_id = min(event_id) OVER (PARTITION BY user_id) AS is_oracle_row, event_type AS task FROM events)"""


def token_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as token columns: values, a mask of vec_id % 16 + 8 leading positions, and shifted copies."""
    e = read(spark, sf_dir, "embeddings")
    x = F.col("embedding").cast("array<double>")
    length = (F.col("vec_id") % 16 + 8).cast("int")
    return e.select(
        F.col("vec_id").alias("row_id"),
        (F.col("vec_id") % 20).alias("uid"),
        x.alias("reward_tokens"),
        F.transform(x, lambda v: v * 0.5 + 0.1).alias("value_tokens"),
        F.transform(x, lambda _, i: (i < length).cast("int")).alias("mask"),
        F.transform(x, lambda v: F.floor(F.abs(v) * 10).cast("int")).alias("tokens"),
        length.alias("length"),
    )


TOKENS = """t AS (SELECT vec_id AS row_id, vec_id % 20 AS uid, unnest(range(1, 65)) AS pos, embedding AS e, vec_id FROM embeddings),
k AS (SELECT row_id, uid, pos, CAST(e[pos] AS DOUBLE) AS reward, CAST(e[pos] AS DOUBLE) * 0.5 + 0.1 AS value,
  CASE WHEN pos <= vec_id % 16 + 8 THEN 1 ELSE 0 END AS mask,
  CAST(floor(abs(CAST(e[pos] AS DOUBLE)) * 10) AS INTEGER) AS token, vec_id % 16 + 8 AS length FROM t)"""


def exploded(df: DataFrame, *columns: str) -> DataFrame:
    """Token columns as rows: row_id, uid, pos (from 1) and the columns named."""
    zipped = F.arrays_zip(*[F.col(c) for c in columns])
    out = df.select("row_id", "uid", F.posexplode(zipped).alias("pos", "x"))
    return out.select("row_id", "uid", (F.col("pos") + 1).alias("pos"), *[F.col(f"x.{c}").alias(c) for c in columns])
