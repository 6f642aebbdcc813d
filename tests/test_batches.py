"""Batch algebra, balancing, repository checks, evaluation and streams."""

import random

import pytest
from pyspark.sql import functions as F

from spindrift.operators import batches as bt
from spindrift.operators import evaluation as ev
from spindrift.operators import repository as rp
from spindrift.streaming import scoring


def frame(spark, n):
    return spark.range(n).select(F.col("id").alias("row_id"), (F.col("id") * 2).alias("v"))


def test_padding_repeats_from_the_start(spark):
    out = sorted((r.row_id, r.v, r.is_pad) for r in bt.pad_to_divisor(frame(spark, 3), 8, 3).collect())
    assert [v for _, v, _ in out] == [0, 2, 4, 0, 2, 4, 0, 2] and sum(p for *_, p in out) == 5
    assert bt.unpad(bt.pad_to_divisor(frame(spark, 3), 8, 3)).count() == 3
    with pytest.raises(ValueError):
        bt.chunk(frame(spark, 3), 2, 3)


def test_union_columns_must_agree(spark):
    right = frame(spark, 3).withColumn("w", F.lit(1))
    assert bt.union_columns(frame(spark, 3), right).columns == ["row_id", "v", "w"]
    with pytest.raises(Exception, match="agree"):
        bt.union_columns(frame(spark, 3), right.withColumn("v", F.lit(0).cast("long"))).collect()
    with pytest.raises(Exception, match="agree"):
        bt.union_columns(frame(spark, 4), right).collect()
    with pytest.raises(ValueError):
        bt.concat([frame(spark, 1), right])


def test_large_groups_keep_their_rows_and_their_oracle(spark):
    policy = spark.createDataFrame([(u, r) for u, n in ((1, 5), (2, 2)) for r in range(n)], "uid long, row_id long")
    oracles = spark.createDataFrame([(1, 90), (2, 91)], "uid long, row_id long")
    rows = lambda *a: sorted((r.uid, r.position, r.row_id, r.is_oracle_row) for r in bt.append_oracles(policy, oracles, *a).collect())
    two = [(2, 0, 0, False), (2, 1, 1, False), (2, 2, 91, True)]
    assert rows() == [*((1, i, i, False) for i in range(5)), (1, 5, 90, True), *two]
    assert rows(3) == [(1, 0, 0, False), (1, 1, 1, False), (1, 2, 2, False), (1, 3, 90, True), *two]


def spread(lengths, parts):
    loads = [sum(lengths[i] for i in p) for p in parts]
    return max(loads) - min(loads)


def test_balancing():
    rng = random.Random(7)
    for _ in range(100):
        k = rng.randint(1, 4)
        lengths = [rng.randint(1, 60) for _ in range(k * rng.randint(1, 6))]
        for equal in (False, True):
            parts = bt.largest_differencing(lengths, k, equal)
            assert sorted(i for p in parts for i in p) == list(range(len(lengths)))
            if equal:
                assert len({len(p) for p in parts}) == 1
        assert spread(lengths, bt.largest_differencing(lengths, k)) <= max(lengths)
        assert sorted(i for p in bt.lightest_first(lengths, k, True) for i in p) == list(range(len(lengths)))
    assert bt.lightest_first([5, 1, 1], 2) == [[0], [1, 2]]
    assert spread([8, 7, 6, 5, 4], bt.largest_differencing([8, 7, 6, 5, 4], 2)) == 2
    with pytest.raises(ValueError):
        bt.largest_differencing([1, 2, 3], 2, True)


def test_micro_batches_stay_in_budget(spark):
    df = spark.createDataFrame([(0, i, n) for i, n in enumerate([9, 3, 3, 8, 2, 5])], "step long, row_id long, length long")
    got = {r.row_id: r.micro for r in bt.micro_batches(df, 10, "step", "length").collect()}
    assert set(got.values()) == {0, 1, 2} and len(got) == 6
    with pytest.raises(Exception, match="longer"):
        bt.micro_batches(df, 5, "step", "length").collect()


def test_repository_checks(spark):
    cases = {"a/b": None, "": "nonempty", "/a": "relative", "a/../b": "..", "a//b": "normalized", "http://x": "URL", "a\\b": "separators", " a": "blanks", "~/x": "relative"}
    df = spark.createDataFrame([(p,) for p in cases], "p string")
    for r in df.select("p", rp.path_error(F.col("p")).alias("e")).collect():
        assert (r.e is None) == (cases[r.p] is None) and (r.e is None or cases[r.p] in r.e)
    assets = spark.createDataFrame([("a/x", 1), ("a/x", 1), ("b", 2)], "path string, bytes long")
    assert rp.merge_assets(assets).count() == 2
    with pytest.raises(Exception, match="conflicting"):
        rp.merge_assets(assets, spark.createDataFrame([("b", 3)], "path string, bytes long")).collect()
    roots = spark.createDataFrame([("a",), ("b/c",)], "root string")
    assert [r.path for r in rp.assets_under(assets, roots).collect()] == ["a/x"]
    with pytest.raises(ValueError, match="unknown"):
        rp.require_selection(assets, spark.createDataFrame([("zzz",)], "path string"), ["path"])
    files = spark.createDataFrame([("f", "key /home/me/x"), ("g", "fine")], "path string, text string")
    assert [(r.path, r.rule, r.hits) for r in rp.hygiene(files).collect()] == [("f", "home_path", 1)]
    rp.check_training(8, 0.5, 1, 2, 64, 8)
    with pytest.raises(ValueError):
        rp.check_training(8, 0.5, 2, 2, 64, 8)


def test_evaluation_edges(spark):
    df = spark.createDataFrame([], "score double, group string, pred_answer string, answer string")
    assert ev.group_accuracy(df).count() == 0
    assert tuple(ev.answer_rates(df).first()) == (0, 0.0, 0.0)
    merged = ev.merge_shards([spark.createDataFrame([("1", 0, "a"), ("1", 1, "b")], "id string, line int, v string"), spark.createDataFrame([("1", 0, "c")], "id string, line int, v string")])
    assert [r.v for r in merged.collect()] == ["c"]
    ids = spark.createDataFrame([("10",), ("9",), ("b",)], "id string")
    assert [r.id for r in ids.orderBy(*ev.numeric_ids_first(F.col("id"))).collect()] == ["9", "10", "b"]
    nested = ev.nest_metrics(spark.createDataFrame([("a/x", 1.0), ("a/y", 2.0)], "metric string, value double"))
    assert nested.first().metrics == {"x": 1.0, "y": 2.0}
    with pytest.raises(Exception, match="fewer"):
        df = spark.createDataFrame([("<video>a", 2)], "p string, n int")
        df.select(ev.align_placeholders(F.col("p"), F.col("n"))).collect()


def test_streams(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # timers would keep the query from ending
    rows = [(u, u * 10 + i, float(i), i == 0) for u in (1, 2) for i in range(4)]
    spark.createDataFrame(rows[:7], scoring.GROUP).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(scoring.GROUP).parquet(str(tmp_path / "in"))
    q = scoring.complete_groups(stream, 3).writeStream.format("memory").queryName("groups").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.sql("SELECT uid, count(*) AS n FROM groups GROUP BY uid").collect()
    assert [tuple(r) for r in got] == [(1, 4)]
    q = scoring.score_stream(stream, lambda b: b.withColumn("double", F.col("reward") * 2), str(tmp_path / "out"), str(tmp_path / "c2"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 7
