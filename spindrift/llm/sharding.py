"""Contiguous shards of nearly equal byte size.

Method: rows are range-partitioned by key, each block is totalled, the block totals are prefix-summed
(one row a block, whatever the data), and a row's global byte position is its block's offset plus a running
sum inside the block. Shards are cut where that position crosses equal targets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.session import durable, shuffle_width


def positioned(df: DataFrame, key: str, weight: Column) -> DataFrame:
    """Add ``_index`` and ``_before``: how many rows, and how much weight, come before each row.

    The order is by key (nulls first); rows of one key follow their place in the input. Blocks are cut by key
    and place together, so one key may hold any share of the rows. Only the block totals are summed in one
    task: one row for each shuffle partition.
    """
    spark = df.sparkSession
    blocks = shuffle_width(spark)
    placed = (
        df.withColumn("_weight", weight.cast("long"))
        .withColumn("_place", F.monotonically_increasing_id())
        .repartitionByRange(blocks, F.col(key).asc_nulls_first(), F.col("_place"))
        .withColumn("_block", F.spark_partition_id())
    )
    placed = durable(placed)  # range bounds are sampled: fix them before they are read twice
    totals = placed.groupBy("_block").agg(F.count("*").alias("_rows"), F.sum("_weight").alias("_sum"))
    ahead = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        "_block",
        F.coalesce(F.sum("_rows").over(ahead), F.lit(0)).alias("_rows0"),
        F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_sum0"),
    )
    inside = Window.partitionBy("_block").orderBy(F.col(key).asc_nulls_first(), "_place")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    return (
        placed.withColumn("_n", F.row_number().over(inside) - 1)
        .withColumn("_w", F.coalesce(F.sum("_weight").over(before), F.lit(0)))
        .join(F.broadcast(starts), "_block")
        .withColumn("_index", F.col("_n") + F.col("_rows0"))
        .withColumn("_before", F.col("_w") + F.col("_sum0"))
        .drop("_block", "_n", "_w", "_rows0", "_sum0", "_place")
    )


def shard_by_bytes(
    df: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """Deal rows into contiguous shards of near-equal bytes.

    Size is the UTF-8 length of the text plus one; a null text counts as no bytes. Adds ``size``,
    ``text_crc32`` (0 for a null text), ``law``, ``shard``, ``slot`` (gapless from 0 in each shard) and
    ``grown_shard`` (null: this law moves rows when the shard count changes). A row belongs to the shard that
    holds its middle byte, so no cut is further from its target than half a document. Null keys come first;
    equal keys keep their input order. An empty table gives an empty result. Columns of df beside the key are
    dropped unless named in keep.
    """
    content = F.coalesce(F.col(text), F.lit(""))
    kept = [F.struct(*keep).alias("_keep")] if keep else []
    slim = df.select(
        F.col(key).alias("_key"),
        *kept,
        (F.octet_length(content) + F.lit(1)).cast("long").alias("_size"),
        F.crc32(content).alias("_crc"),
    )
    rows = positioned(slim, "_key", F.col("_size"))
    total = rows.agg(F.sum("_weight").alias("_total"))
    sharded = rows.join(F.broadcast(total)).withColumn(
        "_shard",
        F.expr(f"((2 * _before + _weight) * {int(shards)}) div (2 * _total)").cast("int"),
    )
    sharded = durable(sharded)
    first = sharded.groupBy("_shard").agg(F.min("_index").alias("_first"))
    return sharded.join(F.broadcast(first), "_shard").select(
        F.col("_key").alias(key),
        *(["_keep.*"] if keep else []),
        F.col("_size").alias("size"),
        F.col("_crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        F.col("_shard").alias("shard"),
        (F.col("_index") - F.col("_first")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
