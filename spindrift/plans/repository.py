"""Registered queries on batch algebra, validation, inventory and merges."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from spindrift.operators import batches as bt
from spindrift.operators import metrics as mt
from spindrift.operators import records as rc
from spindrift.operators import repository as rp
from spindrift.plans.tables import read, token_rows

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def batch(spark, d):
    return read(spark, d, "documents").select(F.col("doc_id").alias("row_id"), "source", "n_chars")


@query("b1_pop", "SELECT doc_id AS row_id, n_chars FROM documents")
def _(spark, d):
    return bt.pop_columns(batch(spark, d), ["source"])[1]


@query("b2_slice", "SELECT doc_id AS row_id, source FROM documents WHERE doc_id >= 100 AND doc_id < 300")
def _(spark, d):
    return bt.slice_rows(batch(spark, d), 100, 300).select("row_id", "source")


@query("b3_chunk", "SELECT doc_id AS row_id, doc_id // 50 AS chunk FROM documents")
def _(spark, d):
    rows = batch(spark, d)
    return bt.chunk(rows, 50, rows.count(), ragged=True).select("row_id", "chunk")


@query("b4_pad", "WITH n AS (SELECT count(*) AS n FROM documents) SELECT doc_id AS row_id, false AS is_pad FROM documents UNION ALL SELECT doc_id + n, true FROM documents, n WHERE doc_id < (64 - n % 64) % 64")
def _(spark, d):
    rows = batch(spark, d)
    return bt.pad_to_divisor(rows, 64, rows.count()).select("row_id", "is_pad")


@query("b5_fold", "SELECT doc_id // 8 AS block, string_agg(CAST(n_chars AS VARCHAR), ',' ORDER BY doc_id) AS chars FROM documents GROUP BY 1")
def _(spark, d):
    return bt.fold_rows(batch(spark, d), 8, "n_chars").select("block", F.array_join(F.transform("n_chars", lambda x: x.cast("string")), ",").alias("chars"))


@query("b6_iterate", "SELECT row_id, CAST(e AS INTEGER) AS epoch, CAST((row_number() OVER (PARTITION BY e ORDER BY sha256('17|epoch:' || e || '|' || row_id), row_id) - 1) // 16 AS BIGINT) AS batch FROM (SELECT doc_id AS row_id FROM documents), range(2) t(e)")
def _(spark, d):
    return bt.iterate(batch(spark, d), 16, 2).select("row_id", "epoch", F.col("batch").cast("long").alias("batch"))


@query("b7_reorder", "SELECT doc_id AS row_id, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS position FROM documents")
def _(spark, d):
    from spindrift.operators.dataset import global_rank

    rows = batch(spark, d)
    order = global_rank(rows.select("row_id", "n_chars"), ["n_chars", "row_id"]).withColumnRenamed("rank", "position")
    return bt.reorder(rows.select("row_id"), order).select("row_id", F.col("position").cast("long").alias("position"))


def lengths(spark, d):
    """Sequences in training batches of 64."""
    return token_rows(spark, d).select(F.expr("row_id div 64").alias("step"), "row_id", F.col("length").cast("long").alias("length"))


LENGTHS = "l AS MATERIALIZED (SELECT vec_id // 64 AS step, vec_id AS row_id, vec_id % 16 + 8 AS length, row_number() OVER (PARTITION BY vec_id // 64 ORDER BY vec_id) - 1 AS i FROM embeddings)"


def differenced(parts: str, equal_size: bool = False) -> str:
    """Largest differencing as a recursion over lists: the two states of the widest gap merge, heavy bins against light."""
    step = "p" if equal_size else "1"
    return f"""{LENGTHS}, z AS (SELECT step, {parts} AS p FROM l GROUP BY step),
    g AS (SELECT l.*, p, (row_number() OVER (PARTITION BY l.step ORDER BY length, i) - 1) // {step} AS slot FROM l JOIN z ON l.step = z.step),
    b AS (SELECT step, list_sort(list_concat(list({{'w': length, 'n': 1::BIGINT, 'items': [{{'i': i, 'v': length}}]}}), list_transform(range(any_value(p) - count(*)), lambda x: {{'w': 0::BIGINT, 'n': 0::BIGINT, 'items': []}})), 'DESC') AS bins FROM g GROUP BY step, slot),
    s AS (SELECT step, list({{'gap': bins[1].w - bins[-1].w, 'top': bins[1], 'bins': bins}}) AS states FROM b GROUP BY step
      UNION ALL
      SELECT step, list_append(rest, {{'gap': bins[1].w - bins[-1].w, 'top': bins[1], 'bins': bins}}) FROM (
        SELECT step, states[3:] AS rest, list_sort(list_transform(range(1, len(states[1].bins) + 1), lambda j: {{'w': states[1].bins[j].w + states[2].bins[len(states[1].bins) + 1 - j].w,
          'n': states[1].bins[j].n + states[2].bins[len(states[1].bins) + 1 - j].n, 'items': list_concat(states[1].bins[j].items, states[2].bins[len(states[1].bins) + 1 - j].items)}}), 'DESC') AS bins
        FROM (SELECT step, list_sort(states, 'DESC') AS states FROM s WHERE len(states) > 1))),
    f AS (SELECT step, unnest(range(len(states[1].bins))) AS part, unnest(states[1].bins).items AS items FROM s WHERE len(states) = 1),
    e AS (SELECT step, part, unnest(items) AS x FROM f), r AS (SELECT e.step, e.part, l.row_id, l.i, l.length FROM e JOIN l ON l.step = e.step AND l.i = e.x.i)"""


@query("b8_differencing", f"WITH RECURSIVE {differenced('4')} SELECT step, row_id, CAST(part AS INTEGER) AS part FROM r")
def _(spark, d):
    return bt.balance(lengths(spark, d), 4, "step", "length")


@query("b8_imbalance", f"WITH RECURSIVE {differenced('4')}, t AS (SELECT step * 4 + part AS bin, sum(length) AS load FROM r GROUP BY 1) SELECT CAST(min(load) AS BIGINT) AS min, CAST(max(load) AS BIGINT) AS max, avg(load) AS mean, CAST(max(load) - min(load) AS BIGINT) AS gap FROM t")
def _(spark, d):
    rows = lengths(spark, d)
    parts = bt.balance(rows, 4, "step", "length").join(rows.select("row_id", "length"), "row_id")
    return mt.imbalance(parts.withColumn("bin", F.expr("step * 4 + part")), "bin", "length")


@query(
    "b9_greedy",
    f"""WITH RECURSIVE {LENGTHS}, s AS (SELECT DISTINCT step, -1::BIGINT AS i, NULL::BIGINT AS row_id, 0::BIGINT AS part, [0, 0, 0, 0]::BIGINT[] AS loads FROM l
      UNION ALL
      SELECT step, i, row_id, p, list_transform(loads, lambda x, k: x + CASE WHEN k = p + 1 THEN length ELSE 0 END)
      FROM (SELECT l.step, l.i, l.row_id, l.length, loads, list_position(loads, list_min(loads))::BIGINT - 1 AS p FROM s JOIN l ON l.step = s.step AND l.i = s.i + 1))
    SELECT step, row_id, CAST(part AS INTEGER) AS part FROM s WHERE i >= 0""",
)
def _(spark, d):
    return bt.balance(lengths(spark, d), 4, "step", "length", method=bt.lightest_first)


@query(
    "b10_micro_batches",
    f"""WITH RECURSIVE {differenced('least(count(*), CAST(ceil(sum(length) / 512) AS BIGINT))')},
    m AS (SELECT step, part, row_number() OVER (PARTITION BY step ORDER BY sum(length * length) DESC, min(i) DESC) - 1 AS micro FROM r GROUP BY step, part)
    SELECT r.step, row_id, CAST(micro AS INTEGER) AS micro FROM r JOIN m ON r.step = m.step AND r.part = m.part""",
)
def _(spark, d):
    return bt.micro_batches(lengths(spark, d), 512, "step", "length")


@query("b12_equal_parts", f"WITH RECURSIVE {differenced('4', equal_size=True)} SELECT step, row_id, CAST(part AS INTEGER) AS part FROM r")
def _(spark, d):
    return bt.balance(lengths(spark, d), 4, "step", "length", equal_size=True, method=partial(bt.largest_differencing, ragged=True))


@query("b11_restore", "SELECT doc_id AS row_id FROM documents")
def _(spark, d):
    return bt.restore(batch(spark, d)).select("row_id")


@query("b13_shape", "SELECT vec_id AS row_id, 48 AS size, CAST(floor(abs(CAST(embedding[1] AS DOUBLE)) * 10) AS INTEGER) AS first FROM embeddings")
def _(spark, d):
    from spindrift.functions.tokens import shape_sequence

    out = shape_sequence(F.col("tokens"), 48, 0, cut="right")
    return token_rows(spark, d).select("row_id", F.size(out).alias("size"), F.get(out, F.lit(0)).alias("first"))


@query("b14_ragged", "SELECT r_regionkey AS id, r_name AS name, CAST(NULL AS DOUBLE) AS acctbal FROM region UNION ALL SELECT s_suppkey, NULL, s_acctbal FROM supplier")
def _(spark, d):
    region = read(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("id"), F.col("r_name").alias("name"))
    supplier = read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("acctbal"))
    return bt.ragged_union([region, supplier])


@query("b15_prompt_major", "SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS position FROM conversations")
def _(spark, d):
    return bt.prompt_major(read(spark, d, "conversations").select("conv_id", "turn"), "conv_id", "turn")


@query("j3_union_columns", "SELECT doc_id AS row_id, source, n_chars, lang FROM documents")
def _(spark, d):
    right = read(spark, d, "documents").select(F.col("doc_id").alias("row_id"), "source", "lang")
    return bt.union_columns(batch(spark, d), right)


@query("j9_pairs", "SELECT a.conv_id, a.turn AS first, b.turn AS second FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn < b.turn")
def _(spark, d):
    c = read(spark, d, "conversations").select("conv_id", F.col("turn").alias("first"))
    return c.join(c.withColumnRenamed("first", "second"), "conv_id").where("first < second")  # turns of one conversation


@query("j10_repeat", "SELECT doc_id AS row_id, CAST(c AS INTEGER) AS copy, doc_id * 3 + c AS position FROM documents, range(3) t(c)")
def _(spark, d):
    return bt.repeat_rows(batch(spark, d).select("row_id"), 3)


@query("j10_tile", "SELECT doc_id AS row_id, CAST(c AS INTEGER) AS copy, c * (SELECT count(*) FROM documents) + doc_id AS position FROM documents, range(3) t(c)")
def _(spark, d):
    rows = batch(spark, d).select("row_id")
    return bt.repeat_rows(rows, 3, interleave=False, total=rows.count())


@query("j11_concat", "SELECT doc_id AS row_id, source FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, source FROM documents WHERE doc_id % 2 = 1")
def _(spark, d):
    rows = batch(spark, d).select("row_id", "source")
    return bt.concat([rows.where("row_id % 2 = 0"), rows.where("row_id % 2 = 1")])


@query(
    "j12_append_oracles",
    """WITH p AS (SELECT user_id AS uid, event_id AS row_id, false AS is_oracle_row FROM events UNION ALL SELECT DISTINCT user_id, -user_id - 1, true FROM events),
    o AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY is_oracle_row, row_id) - 1 AS position FROM p) SELECT uid, row_id, is_oracle_row, CAST(position AS INTEGER) AS position FROM o""",
)
def _(spark, d):
    events = read(spark, d, "events")
    policy = events.select(F.col("user_id").alias("uid"), F.col("event_id").alias("row_id"))
    oracles = events.select(F.col("user_id").alias("uid")).distinct().withColumn("row_id", -F.col("uid") - 1)
    return bt.append_oracles(policy, oracles)


PATHS = "p AS (SELECT page_id AS row_id, CASE page_id % 6 WHEN 0 THEN 'media/' || page_id WHEN 1 THEN '/abs/' || page_id WHEN 2 THEN 'a/../' || page_id WHEN 3 THEN url WHEN 4 THEN 'a//b' ELSE '' END AS path FROM pages)"


def paths(spark, d):
    n, own = F.col("page_id") % 6, F.col("page_id").cast("string")
    path = (
        F.when(n == 0, F.concat(F.lit("media/"), own)).when(n == 1, F.concat(F.lit("/abs/"), own)).when(n == 2, F.concat(F.lit("a/../"), own))
        .when(n == 3, F.col("url")).when(n == 4, "a//b").otherwise("")
    )
    return read(spark, d, "pages").select(F.col("page_id").alias("row_id"), path.alias("path"))


@query(
    "v1_path_errors",
    f"""WITH {PATHS} SELECT row_id, CASE row_id % 6 WHEN 1 THEN 'must be relative' WHEN 2 THEN 'must not contain ..' WHEN 3 THEN 'must not be a URL' WHEN 4 THEN 'must be normalized' WHEN 5 THEN 'must be a nonempty relative path' END AS error FROM p""",
)
def _(spark, d):
    return paths(spark, d).select("row_id", rp.path_error(F.col("path")).alias("error"))


@query("v1_identifiers", "SELECT n_nationkey AS id, regexp_matches(CASE WHEN n_nationkey % 2 = 0 THEN lower(replace(n_name, ' ', '_')) ELSE n_name END, '^[a-z][a-z0-9]*(_[a-z0-9]+)*$') AS ok, n_nationkey % 3 = 0 AS hash_ok FROM nation")
def _(spark, d):
    name = F.when(F.col("n_nationkey") % 2 == 0, F.lower(F.regexp_replace("n_name", " ", "_"))).otherwise(F.col("n_name"))
    hash_ = F.when(F.col("n_nationkey") % 3 == 0, F.sha2("n_name", 256)).otherwise(F.col("n_name"))
    return read(spark, d, "nation").select(F.col("n_nationkey").alias("id"), rp.is_dataset_id(name).alias("ok"), rp.is_sha256(hash_).alias("hash_ok"))


@query("v2_layout", """SELECT n_nationkey AS id, CASE n_nationkey % 3 WHEN 0 THEN 'annotations/video_qa/mlvu/test.jsonl' WHEN 1 THEN 'annotations/spatial_intelligence/vsi/test.jsonl' ELSE 'annotations/refcoco/test.jsonl' END AS path,
    CASE n_nationkey % 4 WHEN 0 THEN 1 ELSE 0 END AS errors FROM nation""")
def _(spark, d):
    n = F.col("n_nationkey") % 3
    benchmark = F.when(n == 0, "mlvu").when(n == 1, "vsi").otherwise("refcoco")
    path = rp.annotation_path(benchmark, F.lit("test"))
    media = F.array(F.concat(F.lit("media/"), rp.benchmark_folder(benchmark), F.when(F.col("n_nationkey") % 4 == 0, "").otherwise("/videos/a.mp4")))
    errors = rp.layout_errors(benchmark, F.lit("test"), path, media)
    return read(spark, d, "nation").select(F.col("n_nationkey").alias("id"), path.alias("path"), F.size(errors).alias("errors"))


@query("v3_collisions", "SELECT lower(event_type) AS folded, 2 AS spellings, count(*) AS rows FROM events GROUP BY 1")
def _(spark, d):
    rows = read(spark, d, "events").select(F.when(F.col("event_id") % 2 == 0, F.upper("event_type")).otherwise(F.lower("event_type")).alias("path"))
    return rp.path_collisions(rows).select("folded", F.col("spellings").cast("int").alias("spellings"), "rows")


@query("v4_check_files", "SELECT 'f' || o_orderkey AS path, CASE WHEN o_orderkey % 7 = 0 THEN 'missing' WHEN o_orderkey % 5 = 0 THEN 'size' ELSE 'checksum' END AS problem FROM orders WHERE o_orderkey % 7 = 0 OR o_orderkey % 5 = 0 OR o_orderkey % 11 = 0")
def _(spark, d):
    own = F.col("o_orderkey")
    rows = read(spark, d, "orders")
    path = F.concat(F.lit("f"), own).alias("path")
    manifest = rows.select(path, own.alias("bytes"), F.lit("a").alias("sha256"))
    files = rows.where(own % 7 != 0).select(path, F.when(own % 5 == 0, own + 1).otherwise(own).alias("bytes"), F.when(own % 11 == 0, "b").otherwise("a").alias("sha256"))
    return rp.check_files(manifest, files)


def eval_rows(spark, d):
    own = F.col("doc_id")
    return read(spark, d, "documents").select(
        own.alias("row_id"), F.when(own % 9 == 0, 2).otherwise(1).alias("schema_version"), F.lit("qa").alias("eval_task"), F.col("lang").alias("benchmark"),
        F.lit("test").alias("split"), F.concat(F.when(own % 2 == 0, "ID").otherwise("id"), (own % 700).cast("string")).alias("sample_id"),
        F.when(own % 7 == 0, " ").otherwise("p").alias("problem"), F.lit("mc").alias("problem_type"), "source",
        F.array().cast("array<string>").alias("images"), F.array(F.when(own % 11 == 0, "/x").otherwise("x")).alias("videos"),
    )


def own_videos():
    folder = F.concat(F.lit("media/"), F.col("benchmark"), F.lit("/videos/x"))
    return F.array(F.when(F.get("videos", F.lit(0)) == "/x", "/x").otherwise(folder)).alias("videos")


@query(
    "v5_row_errors",
    """SELECT doc_id AS row_id, CAST((doc_id % 9 = 0)::INT + (doc_id % 7 = 0)::INT + (doc_id % 11 = 0)::INT + (doc_id % 13 = 0)::INT + (doc_id % 17 = 0)::INT + (doc_id % 19 = 0)::INT
      + (doc_id % 23 = 0)::INT + (doc_id % 58 = 0)::INT + (doc_id % 93 = 0)::INT + (doc_id % 37 = 0)::INT + (doc_id % 41 = 0)::INT + (doc_id % 43 = 0)::INT AS INTEGER) AS errors FROM documents""",
)
def _(spark, d):
    own = F.col("doc_id")
    if_ = lambda n, bad, good: F.when(own % n == 0, bad).otherwise(good)
    rows = eval_rows(spark, d).select(
        "row_id", "schema_version", "eval_task", "benchmark", "split", "problem", "problem_type", "source", own_videos(), F.col("row_id").alias("doc_id"),
    ).select(
        "*", if_(13, " padded", "s1").alias("sample_id"), if_(17, "Bad Family", None).alias("family"), if_(19, '"  "', '{"a": 1}').alias("answer"),
        F.array(if_(23, "media/other/images/x", F.concat(F.lit("media/"), "benchmark", F.lit("/images/x")))).alias("images"),
        F.when(own % 2 == 0, F.array(F.lit("A"), if_(29, " ", "B"))).alias("choices"), F.when(own % 3 == 0, F.array(if_(31, "elsewhere", F.concat(F.lit("media/"), "benchmark", F.lit("/subtitles/t"))))).alias("subtitles"),
        if_(37, "[1]", None).alias("preprocessed"), F.lit('{"x": []}').alias("task_payload"), if_(41, "text", None).alias("metadata"), F.lit("{}").alias("evaluation"),
        F.array(if_(43, "artifacts/x/../y", F.concat(F.lit("artifacts/"), "benchmark", F.lit("/m")))).alias("artifacts"),
    )
    return rc.evaluation_errors(rows).select("row_id", F.size("errors").alias("errors"))


@query(
    "v6_set_errors",
    """WITH e AS (SELECT doc_id AS row_id, CASE WHEN doc_id % 2 = 0 THEN 'ID' ELSE 'id' END || (doc_id % 700) AS sid, 'qa/' || lang || '/test' AS k FROM documents)
    SELECT 'duplicate_id' AS kind, sid AS value, min(row_id) AS first_row, count(*) AS rows FROM e GROUP BY sid HAVING count(*) > 1
    UNION ALL SELECT 'case_collision', lower(sid), min(row_id), count(DISTINCT sid) FROM e GROUP BY lower(sid) HAVING count(DISTINCT sid) > 1
    UNION ALL SELECT 'mixed_identity', k, min(row_id), count(*) FROM e GROUP BY k""",
)
def _(spark, d):
    return rp.evaluation_set_errors(eval_rows(spark, d))


@query(
    "v7_manifest_errors",
    "SELECT c_custkey AS id, CAST(CASE WHEN c_custkey % 24 < 23 THEN 1 ELSE 0 END + CASE WHEN c_custkey % 24 IN (1, 7, 19) THEN 1 ELSE 0 END AS INTEGER) AS errors FROM customer",
)
def _(spark, d):
    """Each record has one planted fault in turn; a fault of the benchmark or split also moves the annotation."""
    own, base = F.col("c_custkey") % 24, "media/spatial_intelligence/vsi"
    fault = lambda n, bad, good: F.when(own == n, bad).otherwise(good)
    lit, none = F.lit, F.lit(None)
    variable = F.create_map(
        fault(13, "lower", "MODEL_PATH"), fault(14, "[[1]]", fault(15, '"/abs"', '"models/x"')), lit("SCALE"), fault(16, "null", "[1, 2]"),
    )
    summed = F.create_map(fault(17, "../x", "models/x"), fault(18, "zz", "0" * 64), fault(19, "MODELS/x", "models/y"), lit("1" * 64))
    rows = read(spark, d, "customer").select(
        F.col("c_custkey").alias("id"), fault(0, 2, 1).alias("schema_version"), lit("vsi").alias("benchmark"), fault(1, "Test", "test").alias("split"), fault(2, "Q A", "qa").alias("task"),
        fault(3, "F!", none).alias("family"), fault(4, "annotations/vsi/test.jsonl", rp.annotation_path(lit("vsi"), lit("test"))).alias("annotation_path"),
        F.when(own == 5, none).otherwise(F.array(lit(base + "/videos"), fault(6, "media/vsi/x", fault(7, base + "/VIDEOS", base + "/images")))).alias("media_paths"),
        F.array(fault(8, "elsewhere", "artifacts/spatial_intelligence/vsi/a")).alias("artifact_paths"), fault(9, none, 5).alias("expected_count"), fault(10, " ", "MIT").alias("license"),
        fault(11, "https://user:key@a.org/x", "https://a.org/x").alias("source_url"), fault(12, none, lit(True)).alias("redistribution_authorized"),
        fault(20, "{}", '{"metric": "acc"}').alias("evaluation"), fault(21, "[1]", none).alias("preprocessing"), fault(22, "7", "{}").alias("metadata"),
        variable.alias("legacy_environment"), summed.alias("checksums"),
    )
    return rc.manifest_errors(rows).select("id", F.size("errors").alias("errors"))


@query("v7_duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def _(spark, d):
    return rp.duplicate_keys(read(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("v7_checksum_conflicts", "SELECT source AS path, count(DISTINCT lang) AS checksums FROM documents GROUP BY source HAVING count(DISTINCT lang) > 1")
def _(spark, d):
    return rp.checksum_conflicts(read(spark, d, "documents").select(F.col("source").alias("path"), F.col("lang").alias("sha256")))


@query("v8_asset_errors", "SELECT 3 * doc_id AS row_id, CAST((doc_id % 10 = 0 AND doc_id > 0)::INT + (doc_id % 4 = 0)::INT AS INTEGER) AS errors FROM documents")
def _(spark, d):
    own = F.col("doc_id")
    name = F.when(own % 10 == 0, F.lit("a")).otherwise(F.format_string("b/%09d", own))
    rows = read(spark, d, "documents").select((own * 3).alias("row_id"), name.alias("path"), own.alias("bytes"), F.when(own % 4 == 0, "zz").alias("sha256"))
    return rp.asset_errors(rows).select("row_id", F.size("errors").alias("errors"))


@query("v9_compare_paths", "SELECT 'f' || doc_id AS path, CASE WHEN doc_id % 5 = 0 THEN 'left' ELSE 'right' END AS side FROM documents WHERE (doc_id % 5 = 0) <> (doc_id % 7 = 0)")
def _(spark, d):
    rows = read(spark, d, "documents").select("doc_id", F.concat(F.lit("f"), "doc_id").alias("path"))
    return rp.compare_paths(rows.where("doc_id % 7 <> 0"), rows.where("doc_id % 5 <> 0")).select("path", "side")


@query(
    "v10_runtime",
    """SELECT 'count' AS kind, CAST(c_custkey AS VARCHAR) AS value, CAST(10 AS BIGINT) AS expected, n AS found FROM (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1) WHERE n <> 10
    UNION ALL SELECT 'asset', CAST(o_custkey AS VARCHAR), NULL, NULL FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_custkey % 50 = 0)""",
)
def _(spark, d):
    orders, customer = read(spark, d, "orders"), read(spark, d, "customer")
    datasets = customer.select(F.col("c_custkey").cast("string").alias("dataset"), F.lit(10).alias("expected"))
    rows = orders.select(F.col("o_custkey").cast("string").alias("dataset"))
    refs = orders.select(F.col("o_custkey").cast("string").alias("path"))
    assets = customer.where("c_custkey % 50 <> 0").select(F.col("c_custkey").cast("string").alias("path"))
    missing = customer.select(F.col("c_custkey").cast("string").alias("path")).join(assets, "path", "left_anti")
    known = assets.union(refs.distinct().join(missing.union(assets), "path", "left_anti").where("CAST(path AS BIGINT) % 50 <> 0"))
    return rp.runtime_checks(datasets, rows, refs, known)


@query("v11_profiles", "SELECT source AS benchmark, count(DISTINCT lang) AS profiles FROM documents GROUP BY source HAVING count(DISTINCT lang) > 1")
def _(spark, d):
    return rp.profile_conflicts(read(spark, d, "documents").select(F.col("source").alias("benchmark"), F.col("lang").alias("profile")))


@query("v12_addresses", "SELECT CAST(doc_id AS VARCHAR) AS path, 'address' AS rule, CAST(len(regexp_extract_all(text, '\\b(?:10|192\\.168|172\\.(?:1[6-9]|2[0-9]|3[01]))(?:\\.[0-9]{1,3}){2,3}\\b')) AS INTEGER) AS hits FROM documents WHERE regexp_matches(text, '\\b(?:10|192\\.168|172\\.(?:1[6-9]|2[0-9]|3[01]))(?:\\.[0-9]{1,3}){2,3}\\b')")
def _(spark, d):
    files = read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), "text")
    return rp.hygiene(files, {"address": rp.SECRETS["address"]}).select("path", "rule", "hits")


PLANTED = """CASE doc_id % 9 WHEN 0 THEN 'api_key = abcdef0123456789' WHEN 1 THEN 'AKIA' || 'ABCDEFGHIJKLMNOP' WHEN 2 THEN 'ghs_' || 'abcdefghij0123456789' WHEN 3 THEN 'https://me:pass@host/x'
WHEN 4 THEN '-----BEGIN RSA PRIVATE KEY-----' WHEN 5 THEN 'see /Users/me/notes' WHEN 6 THEN 'The SECRETWORD' ELSE 'nothing' END"""


@query(
    "v12_hygiene",
    f"""WITH f AS (SELECT doc_id, {PLANTED} AS t, CASE doc_id % 9 WHEN 7 THEN 'src/build/' || doc_id || '.py' WHEN 8 THEN 'src/' || doc_id || '.PT' ELSE 'src/' || doc_id END AS path FROM documents)
    SELECT path, CASE doc_id % 9 WHEN 0 THEN 'assigned_secret' WHEN 1 THEN 'aws_key' WHEN 2 THEN 'access_token' WHEN 3 THEN 'url_credentials' WHEN 4 THEN 'private_key' WHEN 5 THEN 'home_path'
      WHEN 6 THEN 'excluded_term' WHEN 7 THEN 'generated_folder' ELSE 'artifact_file' END AS rule, CAST(1 AS INTEGER) AS hits, CASE WHEN doc_id % 9 < 7 THEN CAST(2 + doc_id % 3 AS INTEGER) END AS line FROM f""",
)
def _(spark, d):
    own = F.col("doc_id")
    text = F.concat(F.repeat(F.lit("a line\n"), (own % 3 + 1).cast("int")), F.expr(PLANTED), F.lit("\nend"))
    path = F.concat(F.lit("src/"), F.when(own % 9 == 7, "build/").otherwise(""), own.cast("string"), F.when(own % 9 == 7, ".py").when(own % 9 == 8, ".PT").otherwise(""))
    return rp.hygiene(read(spark, d, "documents").select(path.alias("path"), text.alias("text")), terms=("secretword",))


@query("v14_discover_paths", "SELECT event_id AS id, '$.a.video_path' AS place, event_type || '.mp4' AS path FROM events")
def _(spark, d):
    doc = F.concat(F.lit('{"a":{"video_path":"'), "event_type", F.lit('.mp4","text":"no"},"n":1}'))
    return rp.discover_paths(read(spark, d, "events").select(F.col("event_id").alias("id"), doc.alias("doc")), "id", "doc")


@query("f8_selection", "SELECT doc_id, lang FROM documents WHERE lang IN ('en', 'de')")
def _(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "lang")
    return rp.require_selection(docs, docs.where("lang IN ('en', 'de')").select("lang").distinct(), ["lang"])


@query("f9_assets_under", "SELECT doc_id, source || '/' || lang || '/' || doc_id AS path FROM documents WHERE source = 'src1' OR (source = 'src2' AND lang = 'en')")
def _(spark, d):
    assets = read(spark, d, "documents").select("doc_id", F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"))
    roots = spark.createDataFrame([("src1",), ("src2/en",)], "root string")
    return rp.assets_under(assets, roots)


@query(
    "a17_inventory",
    """SELECT source, count(*) AS datasets, CASE WHEN count(CASE WHEN doc_id % 100 <> 3 THEN 1 END) = count(*) THEN CAST(sum(n_chars) AS BIGINT) END AS expected_count, CAST(sum(doc_id) AS BIGINT) AS bytes FROM documents GROUP BY source
    UNION ALL SELECT '(all)', count(*), NULL, CAST(sum(doc_id) AS BIGINT) FROM documents""",
)
def _(spark, d):
    rows = read(spark, d, "documents").select("source", F.when(F.col("doc_id") % 100 != 3, F.col("n_chars")).alias("expected_count"), F.col("doc_id").alias("bytes"))
    return rp.inventory(rows)


@query("a17_unique_assets", "SELECT source AS path, arg_min(n_chars, doc_id) AS bytes FROM documents GROUP BY source")
def _(spark, d):
    return rp.unique_assets(read(spark, d, "documents").select(F.col("source").alias("path"), F.col("n_chars").alias("bytes"), F.col("doc_id").alias("row_id")))


@query(
    "a18_card",
    """WITH c AS (SELECT source AS benchmark, lang AS split, CAST(sum(n_chars) AS BIGINT) AS rows, CAST(sum(n_chars * 1000) AS BIGINT) AS bytes, string_agg(DISTINCT CASE WHEN doc_id % 2 = 0 THEN 'MIT' ELSE 'CC0' END, ', ' ORDER BY CASE WHEN doc_id % 2 = 0 THEN 'MIT' ELSE 'CC0' END) AS license FROM documents GROUP BY 1, 2)
    SELECT benchmark, split, rows, bytes, CASE WHEN rows < 1000 THEN 'n<1K' WHEN rows < 10000 THEN '1K<n<10K' WHEN rows < 100000 THEN '10K<n<100K' WHEN rows < 1000000 THEN '100K<n<1M' ELSE '1M<n<10M' END AS size,
    CASE WHEN bytes < 1024 THEN printf('%.0f B', bytes::DOUBLE) WHEN bytes < 1048576 THEN printf('%.1f KiB', bytes / 1024.0) WHEN bytes < 1073741824 THEN printf('%.1f MiB', bytes / 1048576.0) ELSE printf('%.1f GiB', bytes / 1073741824.0) END AS volume, license FROM c""",
)
def _(spark, d):
    rows = read(spark, d, "documents").select(
        F.col("source").alias("benchmark"), F.col("lang").alias("split"), F.col("n_chars").alias("rows"), (F.col("n_chars") * 1000).alias("bytes"),
        F.when(F.col("doc_id") % 2 == 0, "MIT").otherwise("CC0").alias("license"),
    )
    return rp.card(rows)


@query("a19_size_class", "SELECT o_orderkey AS id, CASE WHEN x < 1000 THEN 'n<1K' WHEN x < 10000 THEN '1K<n<10K' WHEN x < 100000 THEN '10K<n<100K' WHEN x < 1000000 THEN '100K<n<1M' WHEN x < 10000000 THEN '1M<n<10M' WHEN x < 100000000 THEN '10M<n<100M' WHEN x < 1000000000 THEN '100M<n<1B' ELSE 'n>1B' END AS size FROM (SELECT o_orderkey, CAST(pow(o_orderkey, 3) AS BIGINT) AS x FROM orders)")
def _(spark, d):
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), rp.size_class(F.pow("o_orderkey", F.lit(3))).alias("size"))


@query("a20_family_table", "SELECT lang AS family, count(*) AS rows, CAST(row_number() OVER (ORDER BY CASE lang WHEN 'fr' THEN 1 WHEN 'en' THEN 2 ELSE 3 END, lang) AS INTEGER) AS position FROM documents GROUP BY lang")
def _(spark, d):
    rows = read(spark, d, "documents").select(F.col("lang").alias("family"), F.lit(1).cast("long").alias("rows"))
    return rp.family_table(rows, ["fr", "en"])


@query("j5_merge_assets", "SELECT DISTINCT source AS path, length(source) AS bytes FROM documents")
def _(spark, d):
    rows = read(spark, d, "documents").select("doc_id", F.col("source").alias("path"), F.length("source").cast("long").alias("bytes"))
    return rp.merge_assets(rows.where("doc_id % 2 = 0").drop("doc_id"), rows.where("doc_id % 3 <> 1").drop("doc_id"), rows.drop("doc_id"))


@query("j6_merge_repositories", "SELECT doc_id, lang AS benchmark FROM documents WHERE lang <> 'en' UNION ALL SELECT doc_id + 1000000, lang FROM documents WHERE lang = 'en' AND doc_id % 2 = 0")
def _(spark, d):
    base = read(spark, d, "documents").select("doc_id", F.col("lang").alias("benchmark"))
    update = base.where("benchmark = 'en' AND doc_id % 2 = 0").withColumn("doc_id", F.col("doc_id") + 1_000_000)
    return rp.merge_repositories(base, update)


@query("s7_expand_spans", "SELECT user_id || ':00000' || n AS id, CAST(user_id AS VARCHAR) AS video, CASE n WHEN 0 THEN 'a' ELSE 'b' END AS query, CAST(user_id + n AS DOUBLE) AS start FROM (SELECT DISTINCT user_id FROM events), range(2) t(n)")
def _(spark, d):
    from spindrift.sources.records import expand_spans

    u = F.col("user_id")
    span = lambda k: F.array((u + k).cast("double"), (u + k + 5).cast("double"))
    rows = read(spark, d, "events").select("user_id").distinct().select(u.cast("string").alias("video"), F.array(F.lit("a"), F.lit("b")).alias("queries"), F.array(span(0), span(1)).alias("spans"))
    return expand_spans(rows).select("id", "video", "query", F.get("span", F.lit(0)).alias("start"))


@query("s11_gate_counts", "SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def _(spark, d):
    from spindrift.sources.records import gate_counts

    docs = read(spark, d, "documents")
    return gate_counts(docs, "lang", {"en": 1}, None).groupBy("lang").agg(F.count("*").alias("n"))


@query("j7_window_free_prefix", "SELECT source AS root, count(*) AS assets FROM documents GROUP BY source")
def _(spark, d):
    docs = read(spark, d, "documents")
    assets = docs.select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"))
    under = rp.assets_under(assets, docs.select(F.col("source").alias("root")))
    return under.groupBy(F.split("path", "/")[0].alias("root")).agg(F.count("*").alias("assets"))


PROMPT_BOXES = ("[@,1,2,3]", "[[@,1,2,3]]", "[@,1,2]", '["@",1,"2",3]', "[[1,2,3,4],[5,6,7,8]]", "null", '[@,1,"x",3]')
PROMPT_POINTS = ("[[1,2]]", "[]", "[[1,2],[3]]", '[[1,"x"],[2,3]]', '[["4",5.5],[6,7]]', "[[1,2],[3,4],[5,6]]", "null")
PROMPT_TIMES = ("1.5", '"soon"', '"2"', "null")


def _listed(items: tuple[str, ...], at: str) -> str:
    return f"([{', '.join(chr(39) + x + chr(39) for x in items)}])[CAST({at} % {len(items)} AS INTEGER) + 1]"


_NUMERIC = "TRY_CAST(json_extract_string({0}, '$[' || {1} || ']') AS DOUBLE) IS NOT NULL"
_PAIRS = f"(coalesce(json_array_length(j, '$.{{0}}'), 0) > 0 AND list_bool_and(list_transform(range(CAST(coalesce(json_array_length(j, '$.{{0}}'), 0) AS BIGINT)), lambda i: json_array_length(j, '$.{{0}}[' || i || ']') = 2 AND {_NUMERIC.format("json_extract(j, '$.{0}[' || i || ']')", 0)} AND {_NUMERIC.format("json_extract(j, '$.{0}[' || i || ']')", 1)})))"


@query(
    "x12_prompts",
    f"""WITH p AS (SELECT event_id AS id, ('{{"boxes":' || replace({_listed(PROMPT_BOXES, "event_id")}, '@', CAST(user_id AS VARCHAR)) || ',"positive_points":' || {_listed(PROMPT_POINTS, "event_id // 7")} || ',"negative_points":' || {_listed(PROMPT_POINTS, "user_id")} || ',"time":' || {_listed(PROMPT_TIMES, "event_id // 3")} || '}}')::JSON AS j, event_id % 2 = 0 AS video FROM events),
    b AS (SELECT *, CASE json_array_length(j, '$.boxes') WHEN 4 THEN json_extract(j, '$.boxes') WHEN 1 THEN json_extract(j, '$.boxes[0]') END AS box FROM p),
    c AS (SELECT *, coalesce(json_array_length(box) = 4 AND list_bool_and(list_transform(range(4), lambda i: {_NUMERIC.format("box", "i")})), false) AS boxed, TRY_CAST(json_extract_string(j, '$.time') AS DOUBLE) IS NOT NULL AS timed FROM b)
    SELECT id, boxed AND {_PAIRS.format("positive_points")} AND {_PAIRS.format("negative_points")} AND (timed OR NOT video) AS valid, CASE WHEN boxed THEN CAST(json_extract_string(box, '$[0]') AS DOUBLE) END AS x FROM c""",
)
def _(spark, d):
    e, u = F.col("event_id"), F.col("user_id")
    pick = lambda items, at: F.get(F.array(*[F.lit(x) for x in items]), (at % len(items)).cast("int"))
    boxes = F.replace(pick(PROMPT_BOXES, e), F.lit("@"), u.cast("string"))
    parts = [("boxes", boxes), ("positive_points", pick(PROMPT_POINTS, F.expr("event_id div 7"))), ("negative_points", pick(PROMPT_POINTS, u)), ("time", pick(PROMPT_TIMES, F.expr("event_id div 3")))]
    prompt = F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{n}":'), x) for n, x in parts]), F.lit("}"))
    rows = read(spark, d, "events").select(e.alias("id"), prompt.alias("p"), F.when(e % 2 == 0, "video").otherwise("image").alias("k"))
    return rows.select("id", rc.is_valid_prompt(F.col("p"), F.col("k")).alias("valid"), F.get(rc.segmentation_prompt(F.col("p"))["boxes"], F.lit(0)).alias("x"))


@query(
    "j6_merge_assets",
    """WITH a AS (SELECT DISTINCT source || '/' || lang AS path, lang FROM documents) SELECT path FROM a WHERE lang IN ('en', 'de') OR path = 'src1/fr'""",
)
def _(spark, d):
    assets = read(spark, d, "documents").select(F.concat_ws("/", "source", "lang").alias("path"), "lang").distinct().withColumn("bytes", F.length("path"))
    base, update = assets.where("lang != 'de'").drop("lang"), assets.where("lang IN ('de', 'en')").drop("lang")
    wanted = assets.where("lang IN ('en', 'de') OR path = 'src1/fr'").select("path")
    return rp.merge_repository_assets(base, update, wanted).select("path")


@query(
    "v13_layout",
    """WITH s AS (SELECT event_id AS id, user_id % 10 AS n, CAST(event_id % 9 - 1 AS DOUBLE) / 8 AS prune, event_id % 4 - 1 AS pos, user_id % 3 AS neg, user_id % 7 * 4 AS batch, event_id % 3 AS nodes, 4 AS devices FROM events),
    k AS (SELECT *, greatest(1, CAST(floor(n * (1 - prune)) AS BIGINT)) AS keep, nodes > 0 AND batch > 0 AS sized FROM s)
    SELECT id, concat_ws('; ', CASE WHEN n <= 1 THEN 'n must be above 1' END, CASE WHEN prune <= 0 OR prune >= 1 THEN 'selection_prune_ratio must lie between 0 and 1' END,
      CASE WHEN pos < 0 THEN 'quotas must not be negative' END, CASE WHEN pos + neg + 1 <> keep THEN 'quotas and the oracle must fill the kept rows' END,
      CASE WHEN NOT sized THEN 'nodes, devices and batch must be positive' END, CASE WHEN sized AND batch * keep % (nodes * devices) <> 0 THEN 'the selected batch must divide into the workers' END,
      CASE WHEN sized AND batch * (n + 1) % (nodes * devices) <> 0 THEN 'the batch with oracles must divide into the workers' END) AS errors FROM k""",
)
def _(spark, d):
    e, u = F.col("event_id"), F.col("user_id")
    found = rp.layout_faults(u % 10, (e % 9 - 1).cast("double") / 8, e % 4 - 1, u % 3, u % 7 * 4, e % 3, F.lit(4))
    return read(spark, d, "events").select(e.alias("id"), F.array_join(found, "; ").alias("errors"))


SOUND = {**rp.RECIPE, **dict.fromkeys(rp.ABOVE_ZERO, 0.5), "oracle_builder": "module:build", "detached_oracle_match_best_ratio": 1.0, "detached_oracle_match_best_min": 0.0, "detached_oracle_match_best_max": 2.0, "post_selection_rms_min_scale": 0.5}
#: One fault for every setting, with what is said of it; the last setting is also tried as NaN, and one as null.
FAULTS = [
    *[(k, "other" if isinstance(v, str) else not v, f"{k} must be {str(v).lower()}") for k, v in rp.RECIPE.items()],
    *[(k, v, f"{k} must be finite and positive") for k, v in zip(rp.ABOVE_ZERO, (0.0, float("inf"), float("nan")), strict=True)],
    ("oracle_builder", " ", "oracle_builder must be named"),
    *[(f"detached_oracle_match_best_{k}", v, "the oracle cap needs a finite positive ratio and 0 <= min <= max") for k, v in (("ratio", 0.0), ("min", -1.0), ("min", 3.0), ("max", float("nan")))],
    *[("post_selection_rms_min_scale", v, "post_selection_rms_min_scale must lie in [0, 1]") for v in (1.5, float("nan"))],
    ("scale_rewards", None, "scale_rewards must be false"),
]


@query(
    "v13_recipe",
    f"SELECT event_id AS id, coalesce([{', '.join(repr(text) for *_, text in FAULTS)}][CAST(event_id % {len(FAULTS) + 1} AS INTEGER)], '') AS errors FROM events",
)
def _(spark, d):
    which = F.col("event_id") % (len(FAULTS) + 1)

    def setting(name):
        out = F.lit(SOUND[name])
        for i, (k, v, _) in enumerate(FAULTS, 1):
            out = F.when(which == i, F.lit(v)).otherwise(out) if k == name else out
        return out.alias(name)

    rows = read(spark, d, "events").select(F.col("event_id").alias("id"), *[setting(k) for k in SOUND])
    return rows.select("id", F.array_join(rp.recipe_faults(rows), "; ").alias("errors"))
