"""Registered queries on dataset building: normalisation, identity, leakage, quotas, splits, audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from spindrift.functions import text as tx
from spindrift.operators import dataset as ds
from spindrift.plans.tables import read

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def candidates(spark, d):
    """documents as candidates: the text is the prompt, lang the task, and media files are shared by five documents."""
    docs = read(spark, d, "documents")
    path = F.concat(F.lit("media/"), F.lower("source"), F.lit("/"), F.expr("CAST(doc_id div 5 AS STRING)"), F.lit(".mp4"))
    stem = F.concat(F.lower("source"), F.lit("-"), F.expr("CAST(doc_id div 5 AS STRING)"))
    return docs.select(
        F.col("doc_id").alias("row_id"),
        "source",
        F.col("doc_id").alias("source_index"),
        F.col("lang").alias("task"),
        F.when(F.col("doc_id") % 2 == 0, "even").otherwise("odd").alias("family"),
        F.sha2(tx.fold_ascii(F.col("text")), 256).alias("identity"),
        F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), "text"), 256).alias("digest"),
        F.array(path).alias("anchors"),
        F.array(F.concat(F.lit("path:"), path), F.concat(F.lit("stem:"), stem)).alias("tokens"),
    )


WIDE = "replace(nfc_normalize(replace(lower(coalesce(text, '')), chr(160), ' ')), 'ß', 'ss')"  # what NFKC and case folding change in these texts
FOLD = "trim(regexp_replace(regexp_replace(lower(coalesce(text, '')), '<image>|<video>', ' ', 'g'), '[ \\t\\n\\r]+', ' ', 'g'))"
UNICODE_FOLD = FOLD.replace("lower(coalesce(text, ''))", WIDE)
#: A page's address as a path of the form that os-independent normalisation gives.
ADDRESS = "regexp_replace(regexp_replace({}, '/+', '/', 'g'), '(.)/$', '\\1')"
CANDIDATES = f"""c AS (SELECT doc_id AS row_id, source, doc_id AS source_index, lang AS task, CASE WHEN doc_id % 2 = 0 THEN 'even' ELSE 'odd' END AS family,
  sha256({FOLD}) AS identity, sha256(doc_id || '|' || text) AS digest, 'media/' || lower(source) || '/' || (doc_id // 5) || '.mp4' AS anchor,
  lower(source) || '-' || (doc_id // 5) AS stem FROM documents)"""
EXCLUDED = """xi AS (SELECT DISTINCT identity FROM c WHERE row_id % 37 = 0), xt AS (SELECT DISTINCT 'stem:' || stem AS token FROM c WHERE row_id % 53 = 0)"""
MARKED = f"""{CANDIDATES}, {EXCLUDED}, m AS (SELECT c.*, identity IN (SELECT identity FROM xi) AS identity_hit,
  ('stem:' || stem) IN (SELECT token FROM xt) AS media_hit FROM c)"""


def excluded(c):
    ids = c.where("row_id % 37 = 0").select("identity").distinct()
    return ids, c.where("row_id % 53 = 0").select(F.element_at("tokens", 2).alias("token")).distinct()


def quotas(spark, d):
    """Sources with a third of their rows as quota."""
    return read(spark, d, "documents").groupBy("source").agg(F.expr("count(*) div 3").alias("quota"))


QUOTAS = "q AS (SELECT source, count(*) // 3 AS quota FROM documents GROUP BY source)"


@query("n1_normalize_text", f"SELECT doc_id, sha256({FOLD}) AS folded FROM documents")
def _(spark, d):
    return read(spark, d, "documents").select("doc_id", F.sha2(tx.fold_ascii(F.col("text")), 256).alias("folded"))


@query("n1_normalize_text_unicode", f"SELECT doc_id, {UNICODE_FOLD} AS folded FROM documents")
def _(spark, d):
    return read(spark, d, "documents").select("doc_id", tx.fold_text_udf("text").alias("folded"))


@query("n2_remote_reference", "SELECT page_id, regexp_matches(CASE WHEN page_id % 3 = 0 THEN replace(url, '://', '/') ELSE '  ' || url END, '^\\s*[A-Za-z][A-Za-z0-9+.-]*://') AS remote FROM pages")
def _(spark, d):
    url = F.when(F.col("page_id") % 3 == 0, F.regexp_replace("url", "://", "/")).otherwise(F.concat(F.lit("  "), "url"))
    return read(spark, d, "pages").select("page_id", tx.is_remote(url).alias("remote"))


@query("n3_local_path", f"SELECT page_id, '/data/' || {ADDRESS.format("regexp_replace(url, '^[a-z]+://', '')")} AS path FROM pages")
def _(spark, d):
    path = F.concat(F.lit("./a/../"), F.regexp_replace("url", "^[a-z]+://", ""))
    return read(spark, d, "pages").select("page_id", tx.bind_path_udf("/data")(path).alias("path"))


@query("n4_canonical_record", "SELECT event_id, event_type AS problem, CAST(event_id AS VARCHAR) AS answer, 1 AS images, 1 AS videos, 'video_qa' AS problem_type, 's' AS source FROM events")
def _(spark, d):
    raw = F.to_json(F.named_struct(
        F.lit("question"), F.col("event_type"), F.lit("solution"), F.col("event_id"), F.lit("image"), F.lit("a.png"), F.lit("videos"), F.array(F.lit("b.mp4")),
    ))
    rec = read(spark, d, "events").select("event_id", tx.canonical_record(F.parse_json(raw), "video_qa", "s").alias("r"))
    return rec.select("event_id", "r.problem", "r.answer", F.size("r.images").alias("images"), F.size("r.videos").alias("videos"), "r.problem_type", "r.source")


@query(
    "n5_message_content",
    """SELECT conv_id, arg_min(text, turn) FILTER (role = 'user') AS problem, arg_max(text, turn) FILTER (role = 'assistant') AS answer
    FROM conversations GROUP BY conv_id""",
)
def _(spark, d):
    c = read(spark, d, "conversations")
    messages = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    grouped = c.groupBy("conv_id").agg(messages.alias("m"))  # a conversation has a few turns
    return grouped.select("conv_id", tx.message_content(F.col("m"), "user").alias("problem"), tx.message_content(F.col("m"), "assistant", True).alias("answer"))


@query("n6_media_paths", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url ELSE url || ',' || 'b.mp4' END AS paths FROM pages")
def _(spark, d):
    images, videos = F.array("url", F.lit(" ")), F.array(F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise("b.mp4"))
    return read(spark, d, "pages").select("page_id", F.array_join(tx.media_paths(images, videos), ",").alias("paths"))


@query("n9_record_errors", """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'problem must be a nonempty string; ' ELSE '' END ||
    CASE WHEN doc_id % 4 = 0 THEN 'answer must contain a nonempty oracle label; ' ELSE '' END ||
    CASE WHEN doc_id % 5 = 0 THEN 'at least one image or video is required; ' ELSE '' END AS errors FROM documents""")
def _(spark, d):
    own = F.col("doc_id")
    none = F.array().cast("array<string>")
    errors = tx.record_errors(
        F.when(own % 3 == 0, " ").otherwise("p"), F.when(own % 4 == 0, None).otherwise("a"), F.col("lang"), F.col("source"),
        none, F.when(own % 5 == 0, none).otherwise(F.array(F.lit("a.mp4"))),
    )
    return read(spark, d, "documents").select("doc_id", F.concat_ws("", F.transform(errors, lambda e: F.concat(e, F.lit("; ")))).alias("errors"))


@query("i1_media_anchors", f"SELECT page_id, lower({ADDRESS.format('url')}) AS anchors FROM pages")
def _(spark, d):
    return read(spark, d, "pages").select("page_id", F.array_join(tx.anchors_udf(F.array("url", F.upper("url"))), ",").alias("anchors"))


@query(
    "i3_leakage_tokens",
    f"""WITH a AS (SELECT page_id, lower({ADDRESS.format("regexp_replace(url, '[?#].*$', '')")}) AS p FROM pages), n AS (SELECT *, regexp_extract(p, '[^/]+$') AS name FROM a)
    SELECT page_id, 'name:' || name || ',path:' || p || ',stem:' || regexp_replace(name, '(.)\\.[^.]+$', '\\1') AS tokens FROM n""",
)
def _(spark, d):
    anchors = tx.anchors_udf(F.array(F.regexp_replace("url", "[?#].*$", "")))
    return read(spark, d, "pages").select("page_id", F.array_join(tx.leakage_tokens_udf(anchors), ",").alias("tokens"))


@query("i4_prompt_identity", f"""SELECT doc_id, sha256('{{"media":["' || source || '"],"problem":' || to_json({UNICODE_FOLD}) || ',"problem_type":"' || lang || '"}}') AS identity FROM documents""")
def _(spark, d):
    return read(spark, d, "documents").select("doc_id", tx.identity_udf("text", "lang", F.array("source")).alias("identity"))


@query("i5_stable_rank", "SELECT doc_id, sha256('17|train|' || doc_id) AS rank FROM documents")
def _(spark, d):
    return read(spark, d, "documents").select("doc_id", tx.stable_rank(17, "train", F.col("doc_id").cast("string")).alias("rank"))


@query("i6_record_digest", "SELECT event_id, sha256(CAST(json(props) AS VARCHAR)) AS digest FROM events")
def _(spark, d):
    return read(spark, d, "events").select("event_id", tx.digest_udf("props").alias("digest"))


@query("f1_exclusions", f"WITH {CANDIDATES} SELECT 'identity' AS kind, identity AS value FROM c WHERE row_id % 4 = 0 AND row_id % 3 <> 0 UNION SELECT 'identity', 'given-' || row_id FROM c WHERE row_id % 3 = 0 UNION SELECT 'token', 'path:' || anchor FROM c WHERE row_id % 6 <> 0 UNION SELECT 'token', 'stem:' || stem FROM c WHERE row_id % 6 <> 0")
def _(spark, d):
    own = F.col("row_id")
    rows = candidates(spark, d).select(
        F.when(own % 3 == 0, F.concat(F.lit(" given-"), own)).alias("explicit_identity"),
        F.when((own % 4 == 0) & (own % 3 != 0), F.col("identity")).alias("computed_identity"),
        "tokens",
        (own % 6 != 0).alias("valid"),
    )
    ids, tokens = ds.exclusions(rows)
    return ids.select(F.lit("identity").alias("kind"), F.col("identity").alias("value")).union(tokens.select(F.lit("token"), "token"))


@query("f2_leakage_filter", f"WITH {MARKED} SELECT row_id, identity_hit, media_hit FROM m")
def _(spark, d):
    c = candidates(spark, d)
    return ds.mark_leakage(c, *excluded(c)).select("row_id", "identity_hit", "media_hit")


@query("f2_leakage_counts", f"WITH {MARKED} SELECT count(*) FILTER (identity_hit) AS candidate_prompt_rows, count(*) FILTER (media_hit) AS candidate_media_rows, count(*) FILTER (identity_hit OR media_hit) AS candidate_rows_excluded FROM m")
def _(spark, d):
    c = candidates(spark, d)
    return ds.leakage_counts(ds.mark_leakage(c, *excluded(c)))


@query("f3_duplicates", f"WITH {CANDIDATES}, n AS (SELECT count(*) AS n FROM c GROUP BY identity) SELECT CAST(sum(n - 1) AS BIGINT) AS duplicate_rows, count(*) FILTER (n > 1) AS duplicate_groups FROM n")
def _(spark, d):
    return ds.duplicate_stats(candidates(spark, d))


@query(
    "f4_output_leakage",
    f"""WITH {MARKED}, t AS (SELECT * FROM m WHERE row_id % 2 = 0), k AS (SELECT * FROM m WHERE row_id % 2 = 1),
    tt AS (SELECT 'path:' || anchor AS token FROM t UNION SELECT 'stem:' || stem FROM t), kt AS (SELECT 'path:' || anchor AS token FROM k UNION SELECT 'stem:' || stem FROM k)
    SELECT 'train_canary_identity' AS check, count(*) AS rows FROM (SELECT identity FROM t INTERSECT SELECT identity FROM k)
    UNION ALL SELECT 'train_canary_media', count(*) FROM (SELECT token FROM tt INTERSECT SELECT token FROM kt)
    UNION ALL SELECT 'excluded_identity', count(*) FROM (SELECT identity FROM m INTERSECT SELECT identity FROM xi)
    UNION ALL SELECT 'excluded_media', count(*) FROM ((SELECT token FROM tt UNION SELECT token FROM kt) INTERSECT SELECT token FROM xt)""",
)
def _(spark, d):
    c = candidates(spark, d)
    return ds.output_leakage(c.where("row_id % 2 = 0"), c.where("row_id % 2 = 1"), *excluded(c))


RANK = "sha256('17|train:' || source || '|' || identity || '|' || digest)"


@query(
    "q1a_select_quota",
    f"""WITH {CANDIDATES}, {QUOTAS}, u AS (SELECT *, {RANK} AS rk FROM c), o AS (SELECT *, row_number() OVER (PARTITION BY source, identity ORDER BY rk, digest, source_index) AS k FROM u),
    p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY rk, digest, source_index) AS pick FROM o WHERE k = 1)
    SELECT p.source, row_id, CAST(pick AS INTEGER) AS pick FROM p JOIN q ON p.source = q.source WHERE pick <= quota""",
)
def _(spark, d):
    return ds.select_quota(candidates(spark, d), quotas(spark, d)).select("source", "row_id", "pick")


def crowded(spark, d):
    """candidates whose media files are shared by ten documents of different sources, so that the cap refuses some."""
    path = F.concat(F.lit("media/"), F.expr("CAST(row_id div 10 AS STRING)"))
    return candidates(spark, d).withColumn("anchors", F.array(path))


CROWDED = "w AS (SELECT * REPLACE ('media/' || (row_id // 10) AS anchor) FROM c)"
ORDERED = """, cs AS (SELECT source, quota, row_number() OVER (ORDER BY n - quota, lower(source)) AS so FROM q JOIN (SELECT source, count(DISTINCT identity) AS n FROM c GROUP BY source) USING (source))"""


def one_by_one(name: str, rows: str, cap: int) -> str:
    """The selection as it is told: row by row, with the identities and media taken so far. rows numbers them as k."""
    return f"""{name}_n AS MATERIALIZED ({rows}),
    {name}_o AS MATERIALIZED (SELECT *, dense_rank() OVER (ORDER BY identity) AS idn, dense_rank() OVER (ORDER BY anchor) AS an FROM {name}_n),
    {name}_s AS (SELECT 0::BIGINT AS k, NULL::BIGINT AS row_id, ''::VARCHAR AS source, 0::BIGINT AS got, []::BIGINT[] AS ids, []::BIGINT[] AS used, NULL::VARCHAR AS verdict
      UNION ALL
      SELECT k, row_id, source, got + (v = 'taken')::BIGINT, CASE WHEN v = 'taken' THEN list_append(ids, idn) ELSE ids END, CASE WHEN v = 'taken' THEN list_append(used, an) ELSE used END, v
      FROM (SELECT *, CASE WHEN got >= quota THEN 'quota' WHEN list_contains(ids, idn) THEN 'identity' WHEN len(list_filter(used, lambda x: x = an)) >= {cap} THEN 'cap' ELSE 'taken' END AS v
        FROM (SELECT o.k, o.row_id, o.source, o.quota, o.idn, o.an, s.ids, s.used, CASE WHEN s.source = o.source THEN s.got ELSE 0 END AS got FROM {name}_s s JOIN {name}_o o ON o.k = s.k + 1))),
    {name} AS MATERIALIZED (SELECT row_id, source, verdict FROM {name}_s WHERE k > 0)"""


def train_rows(table: str) -> str:
    rank = f"sha256('17|train:' || {table}.source || '|' || identity || '|' || digest)"
    return f"SELECT {table}.*, quota, row_number() OVER (ORDER BY so, {rank}, digest, source_index, row_id) AS k FROM {table} JOIN cs ON {table}.source = cs.source"


@query("q1_select_train", f"WITH RECURSIVE {CANDIDATES}, {QUOTAS}{ORDERED}, {one_by_one('t', train_rows('c'), 2)} SELECT source, row_id, verdict FROM t")
def _(spark, d):
    return ds.select_train(candidates(spark, d), quotas(spark, d)).select("source", "row_id", "verdict")


@query(
    "q1_cap_rejections",
    f"WITH RECURSIVE {CANDIDATES}, {CROWDED}, {QUOTAS}{ORDERED}, {one_by_one('t', train_rows('w'), 1)} SELECT source, count(*) AS rejected FROM t WHERE verdict = 'cap' GROUP BY source",
)
def _(spark, d):
    return ds.cap_rejections(ds.select_train(crowded(spark, d), quotas(spark, d), cap=1))


CANARY_ROWS = """SELECT 'canary' AS source, row_id, identity, anchor, 40 AS quota, row_number() OVER (ORDER BY sha256('17|canary|' || identity || '|' || digest), digest, source_index, row_id) AS k
  FROM m WHERE NOT own AND NOT media"""


@query(
    "q2_select_canary",
    f"""WITH RECURSIVE {CANDIDATES}, {QUOTAS}{ORDERED}, {one_by_one('t', train_rows('c'), 2)}, x AS (SELECT c.* FROM c JOIN t ON c.row_id = t.row_id WHERE verdict = 'taken'),
    m AS (SELECT *, identity IN (SELECT identity FROM x) AS own, anchor IN (SELECT anchor FROM x) AS media FROM c), {one_by_one('y', CANARY_ROWS, 2)}
    SELECT m.row_id, CASE WHEN own THEN 'train_identity' WHEN media THEN 'train_media' ELSE verdict END AS verdict FROM m LEFT JOIN y ON m.row_id = y.row_id""",
)
def _(spark, d):
    c = candidates(spark, d)
    train = ds.select_train(c, quotas(spark, d)).where("verdict = 'taken'")
    return ds.select_canary(c, train, size=40).select("row_id", "verdict")


@query("q3_output_order", f"WITH {CANDIDATES} SELECT row_id, CAST(row_number() OVER (ORDER BY sha256('17|train-output|' || identity || '|' || digest), digest, source_index) - 1 AS BIGINT) AS rank FROM c")
def _(spark, d):
    c = candidates(spark, d).withColumn("_rank", ds.candidate_order(17, "train-output")[0])
    return ds.global_rank(c.select("row_id", "_rank", "digest", "source_index"), ["_rank", "digest", "source_index"]).select("row_id", F.col("rank").cast("long").alias("rank"))


@query("q4_shortfall", f"WITH {CANDIDATES}, u AS (SELECT source, count(DISTINCT identity) AS n FROM c GROUP BY source) SELECT source, 60 - n AS short FROM u WHERE n < 60")
def _(spark, d):
    c = candidates(spark, d)
    wide = c.select("source").distinct().withColumn("quota", F.lit(60).cast("long"))
    taken = ds.select_quota(c, wide).withColumn("verdict", F.lit("taken"))
    return ds.shortfalls(taken, wide)


@query("q5_sorted_limit", "SELECT doc_id, source FROM documents ORDER BY source, doc_id LIMIT 100")
def _(spark, d):
    return read(spark, d, "documents").select("doc_id", "source").orderBy("source", "doc_id").limit(100)


@query("q8_shard_contiguous", "WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY source, doc_id) - 1 AS k, count(*) OVER () AS n FROM documents) SELECT doc_id, CAST((SELECT count(*) FROM range(1, 7) t(i) WHERE k >= n * i // 7) AS INTEGER) AS shard FROM o")
def _(spark, d):
    return ds.shard_rows(read(spark, d, "documents").select("doc_id", "source"), ["source", "doc_id"], 7).select("doc_id", "shard")


@query("q8_shard_strided", "SELECT doc_id, CAST((row_number() OVER (ORDER BY source, doc_id) - 1) % 7 AS INTEGER) AS shard FROM documents")
def _(spark, d):
    return ds.shard_rows(read(spark, d, "documents").select("doc_id", "source"), ["source", "doc_id"], 7, contiguous=False).select("doc_id", "shard")


@query(
    "q9_task_batches",
    """WITH o AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('17|batch:' || lang || '|' || doc_id)) - 1 AS k, count(*) OVER (PARTITION BY lang) AS n FROM documents)
    SELECT doc_id, lang AS task, CAST(k // 16 AS BIGINT) AS batch, CAST(k % 16 AS BIGINT) AS slot FROM o WHERE k // 16 < n // 16""",
)
def _(spark, d):
    rows = read(spark, d, "documents").select("doc_id", F.col("lang").alias("task"))
    out = ds.task_batches(rows, 16, key="doc_id")
    return out.select("doc_id", "task", F.col("batch").cast("long").alias("batch"), F.col("slot").cast("long").alias("slot"))


@query(
    "a1_counts",
    f"""WITH {CANDIDATES} SELECT 'rows' AS dimension, NULL AS key, count(*) AS rows FROM c UNION ALL SELECT 'by_task', task, count(*) FROM c GROUP BY task
    UNION ALL SELECT 'by_source', source, count(*) FROM c GROUP BY source UNION ALL SELECT 'by_family', family, count(*) FROM c GROUP BY family""",
)
def _(spark, d):
    return ds.split_counts(candidates(spark, d))


@query(
    "a2_audit",
    f"""WITH {MARKED}, n AS (SELECT count(*) AS n FROM c GROUP BY identity)
    SELECT 'duplicates' AS section, 'duplicate_rows' AS metric, CAST(sum(n - 1) AS BIGINT) AS value FROM n
    UNION ALL SELECT 'duplicates', 'duplicate_groups', count(*) FILTER (n > 1) FROM n
    UNION ALL SELECT 'leakage', 'candidate_prompt_rows', count(*) FILTER (identity_hit) FROM m
    UNION ALL SELECT 'leakage', 'candidate_media_rows', count(*) FILTER (media_hit) FROM m
    UNION ALL SELECT 'leakage', 'candidate_rows_excluded', count(*) FILTER (identity_hit OR media_hit) FROM m""",
)
def _(spark, d):
    c = candidates(spark, d)
    return ds.audit({"duplicates": ds.duplicate_stats(c), "leakage": ds.leakage_counts(ds.mark_leakage(c, *excluded(c)))})


@query("j2_train_canary_anti", f"WITH {CANDIDATES} SELECT row_id FROM c WHERE row_id % 2 = 1 AND identity NOT IN (SELECT identity FROM c WHERE row_id % 2 = 0)")
def _(spark, d):
    c = candidates(spark, d)
    return c.where("row_id % 2 = 1").join(c.where("row_id % 2 = 0").select("identity"), "identity", "left_anti").select("row_id")


@query("j13_set_operations", "SELECT 'both' AS side, lang FROM (SELECT lang FROM documents INTERSECT SELECT lang FROM documents WHERE doc_id % 2 = 0) UNION ALL SELECT 'only', source FROM (SELECT source FROM documents EXCEPT SELECT source FROM documents WHERE doc_id % 3 = 0)")
def _(spark, d):
    docs = read(spark, d, "documents")
    both = docs.select("lang").intersect(docs.where("doc_id % 2 = 0").select("lang"))
    only = docs.select("source").subtract(docs.where("doc_id % 3 = 0").select("source"))
    return both.select(F.lit("both").alias("side"), "lang").union(only.select(F.lit("only"), "source"))


@query("f5_keep_answers", "SELECT event_id FROM events WHERE chr(CAST(65 + event_id % 10 AS INTEGER)) IN ('A', 'B', 'C', 'D')")
def _(spark, d):
    rows = read(spark, d, "events").select("event_id", F.char(65 + F.col("event_id") % 10).alias("answer"))
    return ds.keep_answers(rows, "ABCD").select("event_id")


@query("f6_usable_segments", "SELECT doc_id FROM documents WHERE lang IN ('en', 'fr') AND doc_id % 2 = 0 AND doc_id % 5 <> 0")
def _(spark, d):
    own, none = F.col("doc_id"), F.array().cast("array<string>")
    rows = read(spark, d, "documents").select(
        own, F.col("lang").alias("problem_type"), F.when(own % 2 == 0, "image").otherwise("video").alias("data_type"),
        F.when(own % 5 == 0, none).otherwise(F.array("source")).alias("media"),
    )
    return ds.usable_segments(rows, ["en", "fr"], "image").select("doc_id")


@query("f7_overlong", "SELECT doc_id FROM documents WHERE n_chars <= 2000")
def _(spark, d):
    return ds.drop_overlong(read(spark, d, "documents"), 2000, "n_chars").select("doc_id")
