"""Queries of this subpackage over the test tables, and their SQL."""

from __future__ import annotations

from zlib import crc32

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm import decontaminate, licenses, lines, merkle, mixing, near_duplicates, nearest, ngrams, periodic, revisits, sharding, suffixes, toxicity
from spindrift.llm.common import read


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(read(spark, sf_dir, "documents"), length=100)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    scored = toxicity.score_toxicity(documents, toxicity.learn(documents, labels))
    return scored.select("doc_id", toxicity.is_held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    return mixing.plan_repeats(documents, mixing.word_count(F.col("text"))).drop("repeats")


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(read(spark, sf_dir, "documents"), percent=85, size=3)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.dedup_lines(read(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_exact", "n_near", F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, benchmark = read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")
    return decontaminate.contamination(documents, benchmark, window=13, share=20).drop("_h")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(read(spark, sf_dir, "documents"), shards=8)


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(read(spark, sf_dir, "documents"))


def op10_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = revisits.resolve_revisits(revisits.captures(read(spark, sf_dir, "pages")))
    listed = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return found.select(
        F.col("record_id").alias("revisit_id"),
        "uri_key",
        "resolved_id",
        "status",
        F.array_join(listed, ";").alias("headers"),
        F.octet_length("payload").cast("long").alias("n_bytes"),
    )


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    text = F.when(even, F.translate("text", "\n", "")).otherwise(F.col("text"))
    made = merkle.manifest(documents, columns, tampered=[*[F.col(c) for c in columns[:-1]], text])
    folded = merkle.fold(F.col("found_leaf"), F.col("proof"))
    digests = made.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"), folded.alias("folded_root"))
    return digests.withColumn("verified", F.col("folded_root") == F.col("root"))


def _tail_repeated(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The texts of the contract: from a place on, the words of one row in ten repeat with a period of their own."""
    h = crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def op12_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(read(spark, sf_dir, "documents"), rewrite=_tail_repeated)
    listed = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(listed, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    scored = ngrams.score_texts(read(spark, sf_dir, "documents"), learn=F.coalesce(~held_out, F.lit(True)))
    return scored.select("doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def queries() -> dict:
    found = (
        op1_suffix_dedup, op2_toxicity, op3_mixing, op4_near_duplicates, op5_line_dedup, op6_nearest, op7_decontamination,
        op8_sharding, op9_licenses, op10_revisits, op11_merkle, op12_periodic, op13_ngrams,
    )
    return {f.__name__: f for f in found}


OP6_SQL = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
d AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_distance(q.x, c.x) AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank,
             vec_id, score FROM d)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

OP10_SQL = r"""
WITH c AS (
  SELECT 2 * page_id AS id, url AS uri, 4 * page_id AS ts, 1 AS response, md5(coalesce(html, '')) AS etag, html, page_id
  FROM pages
  UNION ALL
  SELECT 2 * page_id + 1, CASE WHEN page_id % 11 = 0 THEN regexp_replace(url, '[?#].*$', '') || '/missing'
                               WHEN page_id % 2 = 0 THEN url || '#again' ELSE regexp_replace(url, '^http:', 'https:') END,
         4 * page_id + 2 + page_id % 3, 0,
         CASE WHEN page_id % 5 = 0 THEN md5(CAST(page_id AS VARCHAR)) ELSE md5(coalesce(html, '')) END, NULL, page_id
  FROM pages),
b AS (SELECT *, regexp_replace(uri, '#.*$', '') AS bare FROM c),
p AS (SELECT *, regexp_replace(lower(regexp_extract(bare, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www\.|:80$|:443$', '', 'g') AS host,
      regexp_replace(regexp_extract(bare, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '') AS path,
      list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'),
                lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]*|ref|fbclid|gclid)(=|$)'))) AS args FROM b),
k AS (SELECT *, host || path || CASE WHEN len(args) > 0 THEN '?' || array_to_string(args, '&') ELSE '' END AS uri_key FROM p),
f AS (SELECT v.id, v.uri_key, v.etag, v.ts, v.page_id,
      (SELECT max(r.ts) FROM k r WHERE r.response = 1 AND r.uri_key = v.uri_key AND r.ts < v.ts) AS rts
      FROM k v WHERE v.response = 0),
j AS (SELECT f.*, r.id AS rid, r.etag AS retag, r.html, r.ts AS r_ts FROM f LEFT JOIN k r
      ON r.response = 1 AND r.uri_key = f.uri_key AND r.ts = f.rts),
s AS (SELECT *, CASE WHEN rid IS NULL THEN 'orphan' WHEN etag <> retag THEN 'stale' ELSE 'resolved' END AS status FROM j)
SELECT id AS revisit_id, uri_key, rid AS resolved_id, status,
       CASE WHEN status = 'resolved' THEN 'cache-control=max-age=60;content-type=text/html;date=' || ts || ';etag=' || retag END AS headers,
       CASE WHEN status = 'resolved' THEN CAST(strlen(html) AS BIGINT) END AS n_bytes
FROM s
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_nearest": OP6_SQL, "op10_revisits": OP10_SQL}
