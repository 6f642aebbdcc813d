"""Groups of a stream: every row comes out once, complete or with a reason, also over restarts."""

import time

from spindrift.streaming import scoring


def feed(spark, path, rows):
    spark.createDataFrame(rows, scoring.GROUP).coalesce(1).write.mode("append").parquet(path)


def run(spark, tmp_path, policy_rows, **options):
    stream = spark.readStream.schema(scoring.GROUP).parquet(str(tmp_path / "in"))
    q = scoring.split_groups(stream, policy_rows, str(tmp_path / "out"), str(tmp_path / "check"), **options)
    q.awaitTermination(120)
    assert q.exception() is None


def out(spark, tmp_path):
    groups = [(r.uid, r.row_id) for r in spark.read.parquet(str(tmp_path / "out" / "groups")).collect()]
    errors = [(r.uid, r.row_id, r.error) for r in spark.read.parquet(str(tmp_path / "out" / "errors")).collect()]
    return sorted(groups), sorted(errors)


def test_a_group_goes_on_after_a_restart_and_nothing_is_lost(spark, tmp_path):
    feed(spark, str(tmp_path / "in"), [(1, 10, 0.5, True), (1, 12, 1.0, False), (2, 20, 0.5, True), (2, 21, 1.0, False), (2, 22, 1.0, False), (2, 23, 1.0, False), (2, 24, 0.1, True)])
    run(spark, tmp_path, 2)
    assert out(spark, tmp_path) == ([(2, 20), (2, 21), (2, 22)], [(2, 23, "surplus"), (2, 24, "surplus")])
    feed(spark, str(tmp_path / "in"), [(1, 11, 0.2, False), (2, 25, 0.3, False), (3, 31, 0.1, False), (3, 32, 0.1, False), (3, 30, 0.1, False)])
    run(spark, tmp_path, 2)
    groups, errors = out(spark, tmp_path)
    assert groups == [(1, 10), (1, 11), (1, 12), (2, 20), (2, 21), (2, 22)]
    assert errors == [(2, 23, "surplus"), (2, 24, "surplus"), (2, 25, "late"), (3, 32, "surplus")]
    feed(spark, str(tmp_path / "in"), [(3, 33, 0.9, True)])
    run(spark, tmp_path, 2)
    assert out(spark, tmp_path)[0][-3:] == [(3, 30), (3, 31), (3, 33)]


def test_open_groups_time_out(spark, tmp_path):
    feed(spark, str(tmp_path / "in"), [(1, 10, 0.5, True), (1, 12, 1.0, False), (2, 20, 0.5, True), (2, 21, 0.5, False), (2, 22, 0.5, False)])
    run(spark, tmp_path, 2, timeout_ms=500)
    time.sleep(1)
    feed(spark, str(tmp_path / "in"), [(9, 90, 0.5, True)])
    run(spark, tmp_path, 2, timeout_ms=500)
    feed(spark, str(tmp_path / "in"), [(1, 11, 0.5, False)])
    run(spark, tmp_path, 2, timeout_ms=500_000)
    groups, errors = out(spark, tmp_path)
    assert groups == [(2, 20), (2, 21), (2, 22)]
    assert [e for e in errors if e[0] == 1] == [(1, 10, "incomplete"), (1, 11, "late"), (1, 12, "incomplete")]
