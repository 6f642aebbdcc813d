"""Dataset building, sources and sinks."""

import json
import random

import pytest
from pyspark.sql import functions as F

from spindrift.functions import text as tx
from spindrift.operators import dataset as ds
from spindrift.sources import records, sinks


def test_text_identity():
    assert tx.fold_text("  PROMPT   <video>ＯＮＥ ß\n") == "prompt one ss"
    assert tx.fold_path("./A/../b\\C.mp4") == "b/c.mp4"
    assert tx.bind_path(" ./a/../b.mp4 ", "/root") == "/root/b.mp4"
    for bad in ("  ", "s3://x/y"):
        with pytest.raises(ValueError):
            tx.bind_path(bad)
    one, two = tx.identity_of("Prompt one", "qa", ["a.mp4"]), tx.identity_of("  PROMPT   ONE ", "QA", ["a.mp4"])
    assert one == two != tx.identity_of("Prompt one", "qa", ["b.mp4"])
    assert tx.leakage_tokens(["v/a.mp4"]) == ["name:a.mp4", "path:v/a.mp4", "stem:a"]
    assert tx.has_content({"a": [None, {"b": 0}]}) and not tx.has_content({"a": ["", float("nan")]})


def test_canonical_record_and_errors(spark):
    raw = [
        {"question": "q", "solution": 5, "image": "a.png", "problem_type": ""},
        {"messages": [{"role": "user", "content": "u"}, {"role": "assistant", "content": "x"}, {"role": "Assistant", "content": "y"}], "videos": ["v"]},
        {"problem": " ", "answer": "a"},
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(raw)], "i int, t string")
    rec = df.select("i", tx.canonical_record(F.parse_json("t"), "qa", "s").alias("r")).select("i", "r.*")
    out = rec.orderBy("i").collect()
    assert (out[0].problem, out[0].answer, out[0].images, out[0].problem_type) == ("q", "5", ["a.png"], "qa")
    assert (out[1].problem, out[1].answer, out[1].videos) == ("u", "y", ["v"])
    errors = rec.select("i", tx.record_errors(*[F.col(c) for c in ("problem", "answer", "problem_type", "source", "images", "videos")]).alias("e"))
    found = {r.i: r.e for r in errors.collect()}
    assert found[0] == [] and found[1] == [] and len(found[2]) == 2


def candidates(spark, n=60, seed=1, anchors=25, identities=40):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a = sorted(rng.sample(range(anchors), rng.randint(0, 3)))
        rows.append((i, rng.choice(["x", "Y", "z"]), i, f"id{rng.randrange(identities)}", f"d{i:03d}", [f"a{k}" for k in a], [f"path:a{k}" for k in a]))
    return rows, spark.createDataFrame(rows, "row_id long, source string, source_index long, identity string, digest string, anchors array<string>, tokens array<string>")


def rank(seed, namespace, row):
    import hashlib

    return hashlib.sha256(f"{seed}|{namespace}|{row[3]}|{row[4]}".encode()).hexdigest()


def greedy(rows, quotas, seed, cap):
    slack = {s: len({r[3] for r in rows if r[1] == s}) - q for s, q in quotas.items()}
    ids, used, got, verdict = set(), {}, {}, {}
    for s in sorted(quotas, key=lambda s: (slack[s], s.casefold())):
        for r in sorted((r for r in rows if r[1] == s), key=lambda r: (rank(seed, f"train:{s}", r), r[4], r[2])):
            if got.get(s, 0) >= quotas[s]:
                verdict[r[0]] = "quota"
            elif r[3] in ids:
                verdict[r[0]] = "identity"
            elif any(used.get(a, 0) >= cap for a in r[5]):
                verdict[r[0]] = "cap"
            else:
                verdict[r[0]] = "taken"
                ids.add(r[3])
                got[s] = got.get(s, 0) + 1
                for a in r[5]:
                    used[a] = used.get(a, 0) + 1
    return verdict


@pytest.mark.parametrize(("seed", "cap", "quota"), [(1, 1, 100), (2, 2, 8), (3, 1, 5)])
def test_capped_selection_equals_the_sequential_one(spark, seed, cap, quota):
    rows, df = candidates(spark, seed=seed)
    quotas = {"x": quota, "Y": quota + 2, "z": quota}
    table = spark.createDataFrame(list(quotas.items()), "source string, quota long")
    got = {r.row_id: r.verdict for r in ds.select_train(df, table, seed=17, cap=cap).collect()}
    assert got == greedy(rows, quotas, 17, cap)


def test_canary_keeps_apart_from_train(spark):
    rows, df = candidates(spark, seed=4)
    train = df.where("row_id < 20")
    decided = {r.row_id: r.verdict for r in ds.select_canary(df, train, size=6, cap=1).collect()}
    ids = {r[3] for r in rows[:20]}
    tokens = {t for r in rows[:20] for t in r[6]}
    chosen, used, seen = [], {}, set()
    for r in sorted(rows, key=lambda r: (rank(17, "canary", r), r[4], r[2])):
        if r[3] in ids:
            expected = "train_identity"
        elif set(r[6]) & tokens:
            expected = "train_media"
        elif len(chosen) >= 6:
            expected = "quota"
        elif r[3] in seen:
            expected = "identity"
        elif any(used.get(a, 0) >= 1 for a in r[5]):
            expected = "cap"
        else:
            expected = "taken"
            chosen.append(r[0])
            seen.add(r[3])
            for a in r[5]:
                used[a] = used.get(a, 0) + 1
        assert decided[r[0]] == expected
    leaks = ds.output_leakage(train, df.where(F.col("row_id").isin(chosen)), df.where("false").select("identity"), spark.createDataFrame([], "token string"))
    assert {r.rows for r in leaks.where("check LIKE 'train%'").collect()} == {0}


def test_shortfall_is_raised(spark):
    missing = spark.createDataFrame([("video_source", 1)], "source string, short long")
    with pytest.raises(ValueError, match="video_source short by 1"):
        ds.require_no_shortfall(missing)


def test_exclusions_excuse_only_named_rows(spark):
    schema = "explicit_identity string, computed_identity string, tokens array<string>, valid boolean"
    ids, tokens = ds.exclusions(spark.createDataFrame([(" given ", None, ["t1"], False), (None, "c", ["t2"], True)], schema))
    assert sorted(r.identity for r in ids.collect()) == ["c", "given"] and [r.token for r in tokens.collect()] == ["t2"]
    with pytest.raises(Exception, match="invalid"):
        ds.exclusions(spark.createDataFrame([(None, None, ["t"], False)], schema))[1].collect()


def test_task_batches_need_tasks(spark):
    df = spark.createDataFrame([(i, "a" if i < 5 else "b") for i in range(9)], "row_id long, task string")
    out = ds.task_batches(df, 2).collect()
    assert len(out) == 8 and {(r.task, r.batch) for r in out} == {("a", 0), ("a", 1), ("b", 0), ("b", 1)}
    with pytest.raises(Exception, match="no task"):
        ds.task_batches(spark.createDataFrame([(1, " ")], "row_id long, task string"), 1).collect()


def test_readers(spark, tmp_path):
    lines = tmp_path / "a.jsonl"
    lines.write_text('{"a": 1}\n\n{"b": [2]}\n')
    got = records.read_jsonl(spark, str(lines)).orderBy("ordinal").collect()
    assert [r.record.toPython() for r in got] == [{"a": 1}, {"b": [2]}]
    lines.write_text('{"a": 1}\n[3]\n')
    with pytest.raises(Exception, match="not a JSON object"):
        records.read_jsonl(spark, str(lines)).collect()
    assert records.read_jsonl(spark, str(lines), strict=False).where("error IS NOT NULL").count() == 1
    assert records.unwrap('{"data": [{"x": 1}]}') == [{"x": 1}] == records.unwrap('[{"x": 1}]') == records.unwrap('{"x": 1}')
    assert records.unwrap('{"x": 1}\n{"x": 2}') == [{"x": 1}, {"x": 2}]
    assert records.flatten_container('{"b": {"v": 2}, "a": {"v": 1}}') == [{"id": "a", "v": 1}, {"id": "b", "v": 2}]
    (tmp_path / "w.json").write_text('{"records": [{"x": 1}, {"x": 2}]}')
    assert records.read_documents(spark, str(tmp_path / "w.json")).count() == 2
    (tmp_path / "t.tsv").write_text("id\timage\n1\tYWI=\n")
    assert bytes(records.read_image_table(spark, str(tmp_path / "t.tsv")).first().image) == b"ab"
    with pytest.raises(ValueError, match="differ"):
        records.gate_counts(spark.createDataFrame([("a",)], "g string"), "g", {"a": 2}, 2)
    (tmp_path / "c.json").write_text('{"seed": 1}')
    assert records.load_config(str(tmp_path / "c.json")) == {"seed": 1}


def test_spans_must_pair_up(spark):
    df = spark.createDataFrame([("v", ["q"], [[1.0, 2.0], [3.0, 4.0]])], "video string, queries array<string>, spans array<array<double>>")
    with pytest.raises(Exception, match="differ in number"):
        records.expand_spans(df).collect()


def test_sinks_are_atomic_and_stable(spark, tmp_path):
    df = spark.createDataFrame([(2, "é"), (1, "b")], "n long, t string").orderBy("n")
    sinks.write_jsonl(df, str(tmp_path / "o.jsonl"))
    first = (tmp_path / "o.jsonl").read_bytes()
    sinks.write_jsonl(df, str(tmp_path / "o.jsonl"))
    assert first == (tmp_path / "o.jsonl").read_bytes() == '{"n":1,"t":"b"}\n{"n":2,"t":"é"}\n'.encode()
    with pytest.raises(ValueError):
        sinks.write_manifest({"x": float("nan")}, str(tmp_path / "m.json"))
    assert [p.name for p in tmp_path.iterdir()] == ["o.jsonl"]
    table = spark.createDataFrame([("loss", 1.5)], "metric string, value double")
    for step in (1, 2):
        sinks.log_metrics(table, str(tmp_path / "log"), step)
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2


SOURCE_ROWS = [
    {"problem": "Prompt one", "answer": "A", "videos": ["a.mp4"]},
    {"problem": "  PROMPT   ONE ", "answer": "A2", "videos": ["./a.mp4"]},
    {"problem": "Prompt two", "answer": "B", "videos": ["b.mp4"]},
    {"problem": "Prompt three", "answer": "C", "videos": ["c.mp4"]},
    {"problem": "Training prompt on benchmark media", "answer": "D", "videos": ["benchmark.mp4"]},
]


def test_whole_build(spark, tmp_path):
    from spindrift.operators import build

    (tmp_path / "source.jsonl").write_text("".join(json.dumps(r) + "\n" for r in SOURCE_ROWS))
    (tmp_path / "benchmarks.jsonl").write_text(json.dumps({"problem": "Prompt two?", "path": "benchmark.mp4", "problem_type": "x"}) + "\n")
    source = build.Source("video_source", str(tmp_path / "source.jsonl"), "video_qa_mc", 2, "video_qa", str(tmp_path))
    run = lambda s, **o: build.build_dataset(spark, [s], [str(tmp_path / "benchmarks.jsonl")], seed=17, cap=1, canary_size=1, **o)
    parts = run(source)
    assert parts["train"].count() == 2 and parts["canary"].count() == 1
    audit = {(r.section, r.metric): r.value for r in parts["audit"].collect()}
    assert audit["leakage", "candidate_rows_excluded"] == 1 and audit["leakage", "candidate_media_rows"] == 1
    assert audit["duplicates", "duplicate_rows"] == 1
    assert all(v == 0 for (s, _), v in audit.items() if s == "output_leakage")
    written = []
    for name in ("one", "two"):
        build.write_dataset(run(source), str(tmp_path / name))
        written.append([(tmp_path / name / f).read_bytes() for f in ("train.jsonl", "canary.jsonl", "manifest.json")])
    assert written[0] == written[1]
    rows = [json.loads(line) for line in written[0][0].decode().splitlines()]
    assert all(r["source"] == "video_source" and r["problem_type"] == "video_qa_mc" and r["family"] == "video_qa" for r in rows)
    wide = build.Source("video_source", source.input, source.task, 4, None, source.media_root)
    with pytest.raises(ValueError, match="video_source short by 1"):
        run(wide)
    assert run(wide, allow_shortfall=True)["train"].count() == 3
    with pytest.raises(ValueError, match="target"):
        run(source, target=5)


def test_ranks_within_keys_of_any_size(spark):
    rows = [(i, "hot" if i % 3 else f"k{i}", (i * 37) % 101) for i in range(200)]
    df = spark.createDataFrame(rows, "row_id long, k string, v long").repartition(7)
    got = {r.row_id: r["rank"] for r in ds.ranked_within(df, ["k"], ["v", "row_id"]).collect()}
    for key in {r[1] for r in rows}:
        own = sorted((r for r in rows if r[1] == key), key=lambda r: (r[2], r[0]))
        assert [got[r[0]] for r in own] == list(range(len(own)))
    assert ds.ranked_within(df.where("false"), ["k"], ["v"]).count() == 0


def test_line_files_are_read_in_splits(spark, tmp_path):
    import json

    first, second = tmp_path / "a.jsonl", tmp_path / "b.NDJSON"
    first.write_text("".join(f'{{"n": {i}}}\n' + ("\n  \n" if i % 7 == 0 else "") for i in range(300)))
    second.write_text('{"data": [{"n": 1}]}\n{"n": 2}')
    (tmp_path / "c.json").write_text('{"data": [{"n": 5}, {"n": 6}]}')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    try:
        rows = records.read_records(spark, [str(first), str(second), str(tmp_path / "c.json")])
        got = {(r.path.rsplit("/", 1)[1], r.ordinal): json.loads(r.record) for r in rows.collect()}
        assert records.read_lines(spark, str(first)).rdd.getNumPartitions() > 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [got["a.jsonl", i]["n"] for i in range(300)] == list(range(300))
    assert got["b.NDJSON", 0] == {"data": [{"n": 1}]} and got["b.NDJSON", 1] == {"n": 2}
    assert got["c.json", 1] == {"n": 6} and len(got) == 304
    second.write_text("[1]\n")
    with pytest.raises(Exception, match="not a JSON object"):
        records.read_lines(spark, str(second)).collect()
