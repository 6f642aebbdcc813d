"""The pipeline: each stage judged on its own input, and the registered queries."""

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from spindrift.llm import decontaminate, mixing, near_duplicates, toxicity
from spindrift.llm.common import read

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder, docs, out = tmp_path_factory.mktemp("pipeline"), read(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        path = f"{folder}/{name}"
        result = stage(spark, docs, SF)
        result.write.parquet(path)
        after = spark.read.parquet(path)
        out.append((name, docs, after))
        docs = after
    return {name: (before, after) for name, before, after in out}


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_columns_are_those_of_documents(stages):
    for name, (before, after) in stages.items():
        if name != "sharding":
            assert after.columns == before.columns, name


def test_each_decision_takes_effect(spark, stages):
    before, after = stages["toxicity"]
    model = toxicity.learn(before, read(spark, SF, "labels"))
    assert ids(after) == ids(toxicity.score_toxicity(before, model).where("predicted = 0"))
    before, after = stages["near_duplicates"]
    assert ids(after) == ids(near_duplicates.near_duplicates(before, percent=80, size=5).where("kept"))
    before, after = stages["decontamination"]
    judged = decontaminate.contamination(before, read(spark, SF, "benchmark"))
    assert ids(after) == ids(judged.where("NOT contaminated"))
    before, after = stages["mixing"]
    from pyspark.sql import functions as F

    plan = mixing.plan_repeats(before, mixing.word_count(F.col("text"))).collect()
    assert ids(after) == sorted(i for r in plan for i in [r.doc_id] * r.repeats)
    before, after = stages["sharding"]
    assert ids(after) == ids(before)
    assert after.select("shard", "slot").distinct().count() == after.count()


def test_all_eleven_queries_are_registered():
    names = entry.queries()
    for n in range(1, 11):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert "pipeline" in names and set(entry.oracle_sql()) <= set(names)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Tables in a folder: documents with nulls, repeats and clashing columns, and the two that the stages read."""
    folder = str(tmp_path_factory.mktemp("odd"))
    text = " ".join(f"word{i}" for i in range(60))
    rows = [
        (1, None), (1, None), (2, ""), (None, ""), (None, "one two"), (None, text), (3, text), (3, text), (4, text + " more"),
        (5, "x" * 1_200_000), (6, None), (7, "alone here"), (8, "you grumblefoo"), (9, " ".join(f"item{i}" for i in range(20))),
    ]
    docs = [(i, t, None if i == 2 else "en", None if i == 7 else "a", None, "s", 1, 0.5, "r", 9) for i, t in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long, shard string, predicted int, score double, row string, _h int"
    spark.createDataFrame(docs, schema).write.parquet(f"{folder}/documents.parquet")
    taught = [(100 + i, "a b grumblefoo" if i % 2 else "a b c") for i in range(40)]
    spark.createDataFrame([(i, 1, i % 2) for i, _ in taught], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, " ".join(f"item{i}" for i in range(20)))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    more = spark.createDataFrame([(i, t, "en", "b", None, "s", 1, 0.5, "r", 9) for i, t in taught], schema)
    more.write.mode("append").parquet(f"{folder}/documents.parquet")
    return folder


def test_stages_on_odd_rows(spark, odd):
    docs, seen = read(spark, odd, "documents"), {}
    for name, stage in corpus_pipeline.STAGES[:3]:
        before, docs = docs, stage(spark, docs, odd).cache()
        assert docs.columns == before.columns
        seen[name] = sorted((r.doc_id or 0, len(r.text or "")) for r in docs.collect() if (r.doc_id or 0) < 100)
    bare = [(0, 0), (1, 0), (1, 0), (2, 0), (6, 0)]
    assert seen["toxicity"].count((8, 14)) == 0 and len(seen["toxicity"]) == 13
    assert [r for r in seen["near_duplicates"] if r[1] == 0] == bare
    assert sum(i == 3 for i, _ in seen["near_duplicates"]) == 1 and not any(i == 4 for i, _ in seen["near_duplicates"])
    assert not any(i == 9 for i, _ in seen["decontamination"]) and (5, 1_200_000) in seen["decontamination"]
    out = corpus_pipeline.run(spark, odd)
    assert out.count() > 0 and {"shard", "slot", "predicted", "score", "row", "_h"} <= set(out.columns)


def test_an_empty_table_gives_an_empty_result(spark, odd, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        read(spark, odd, name).where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and set(out.columns) == set(corpus_pipeline.run(spark, odd).columns)


def test_run_writes_and_rereads_every_stage(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and {"shard", "slot", "lang", "source"} <= set(out.columns)


@pytest.mark.parametrize(("name", "most"), [("near_duplicates", 85), ("decontamination", 90)])
def test_filters_take_few_stages(spark, stages, name, most):
    """Each Spark stage costs the driver memory, which the many tasks of a skewed input multiply."""
    before, after = stages[name]
    spark.sparkContext.setJobGroup(f"stages of {name}", name)
    try:
        result = dict(corpus_pipeline.STAGES)[name](spark, before, SF)
        assert ids(result) == ids(after)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    took = sum(len(tracker.getJobInfo(job).stageIds) for job in tracker.getJobIdsForGroup(f"stages of {name}"))
    assert took <= most, took
