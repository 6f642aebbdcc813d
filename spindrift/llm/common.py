"""Small helpers that several operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()

#: Word classes of the contracts: runs of non-blank characters, and runs of letters and digits.
BLANK_WORD = r"[^\x20\x09-\x0D]+"
TERM_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: A side is broadcast only if it has at most so many rows and bytes; else it is shuffled.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64_000_000
#: A key with more than one in so many rows is dealt over several tasks.
SALT_SHARE = 500


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and leave every other character alone."""
    ascii_only = F.length(text) == F.octet_length(text)  # there the faster lower() says the same
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, ASCII_UPPER, ASCII_LOWER))


def terms(text: Column) -> Column:
    """Array of the lower-cased terms of a text; null and blank texts have none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), TERM_BREAK), "")


def maybe_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast df where it is proven to have at most ``rows`` rows of ``size`` bytes together, as JSON."""
    few = df.limit(rows + 1).agg(F.count("*").alias("n"), F.sum(F.octet_length(F.to_json(F.struct("*")))).alias("b")).first()
    return F.broadcast(df) if few["n"] <= rows and (few["b"] or 0) <= size else df


def salted_join(big: DataFrame, small: DataFrame, on: list[str], count: str = "n", share: int | None = None, counted: DataFrame | None = None) -> DataFrame:
    """Inner join of big with small, whose keys are unique and non-null and whose ``count`` says how many rows of big each has.

    Keys with more than one in ``share`` of the counted rows are dealt over several tasks: those are ``share`` keys at
    most, whatever the input, so that they may be broadcast. ``counted`` has the keys and ``count`` where small, which
    must be cheap to read twice, is not; ``count`` is dropped.
    """
    share = share or SALT_SHARE
    counted = small if counted is None else counted
    total, largest = counted.agg(F.sum(count), F.max(count)).first()
    most = max(1, -(-(total or 0) // share))
    if (largest or 0) <= most:
        return big.join(small.drop(count), on)
    hot = counted.where(F.col(count) > most).select(*on, F.expr(f"1 + {count} div {most}").cast("int").alias("_ways"))
    rest = [c for c, kind in big.dtypes if c not in on and "map<" not in kind]
    spread = F.when(F.col("_ways").isNull(), 0).otherwise(F.pmod(F.xxhash64(*rest), F.col("_ways"))).cast("int")
    left = big.join(F.broadcast(hot), on, "left").withColumn("_salt", spread).drop("_ways")
    ways = F.when(F.col(count) > most, F.expr(f"1 + {count} div {most}").cast("int")).otherwise(1)
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), ways - 1))).drop(count)
    return left.join(right, [*on, "_salt"]).drop("_salt")


def row_key(df: DataFrame, name: str = "_row") -> DataFrame:
    """Number the rows of df by their place in the input; only for a plan that is then materialised."""
    return df.withColumn(name, F.monotonically_increasing_id())
