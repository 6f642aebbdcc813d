"""The corpus pipeline: filters, deduplication, mixing and sharding, each stage written and read again.

Every stage takes (spark, docs, sf_dir), works on all rows that the stage before kept, and returns a DataFrame.

Null and empty texts pass every filter: they hold nothing that is toxic, copied or contaminated. Equal rows are judged
alike, but of a group of near-duplicates one row stays. Texts are read whole, however long. An empty table gives an
empty result with the same columns. Extra columns are handed on, whatever they are called, up to the last stage, where
those that share a name with its results are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spindrift.llm import decontaminate, mixing, near_duplicates, sharding, toxicity
from spindrift.llm.common import read
from spindrift.session import scratch_folder


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic."""
    return toxicity.civil_rows(docs, read(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near-duplicates (five-word shingles, similarity of 0.8)."""
    return near_duplicates.distinct_rows(docs, percent=80, size=5)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than one word in twenty lies in benchmark passages."""
    return decontaminate.clean_rows(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mix_rows(docs)


def deal_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every remaining document with its shard and slot, and its other columns but the text."""
    made = {"doc_id", "text", "size", "text_crc32", "law", "shard", "slot", "grown_shard"}
    return sharding.shard_by_bytes(docs, shards=8, keep=[c for c in docs.columns if c not in made])


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", deal_shards),
]

#: The first stage is a learned model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to documents; each result is written as Parquet to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    folder = scratch_folder(spark, "corpus-pipeline")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
