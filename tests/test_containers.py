"""JSON containers read by ranges against whole parses; JSON lines written by tasks and read at places."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from spindrift.sources import containers, jsonl, records

TEXTS = ['a "quoted, [thing]"', "back\\slash\\\\", '\\"', "ünï", "{", "]", "", "x:y", "\n", "\\\\\\", "plain"]


def some(rng, depth=0):
    kind = rng.randrange(6 if depth < 3 else 3)
    if kind < 2:
        return rng.choice(TEXTS)
    if kind == 2:
        return rng.choice([None, True, 1.5, -3])
    if kind == 3:
        return [some(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {rng.choice(TEXTS + ["data", "items"]) + str(i): some(rng, depth + 1) for i in range(rng.randrange(4))}


def record(rng, i):
    return {"n": i, "text": rng.choice(TEXTS), "deep": some(rng), "data": [1, {"items": []}]}


def files(rng):
    rows = lambda n: [record(rng, i) for i in range(n)]
    return {
        "list": rows(30), "empty": [], "one": {"n": 7, "deep": some(rng), "x": {"data": [1]}}, "wrapped": {"meta": some(rng), "data": rows(20), "records": rows(3)},
        "other": {"results": {"not": "a list"}, "samples": rows(4), "tail": "]"}, "hollow": {"data": []}, "nothing": {},
    }


@pytest.mark.parametrize(("size", "indent"), [(17, None), (64, 2), (1 << 20, 1)])
def test_records_equal_a_whole_parse(spark, tmp_path, size, indent):
    made = files(random.Random(size))
    for name, value in made.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(value, indent=indent, ensure_ascii=bool(indent)))
    (tmp_path / "lines.json").write_text("\n".join(json.dumps(r) for r in made["list"]) + "\n\n")
    (tmp_path / "blank.json").write_text("")
    got = {}
    for r in containers.read_containers(spark, str(tmp_path), size=size).collect():
        got.setdefault(os.path.basename(r.path), {})[r.ordinal] = json.loads(r.record)
    for name in [*made, "lines"]:
        want = records.unwrap((tmp_path / f"{name}.json").read_text())
        assert got.get(f"{name}.json", {}) == dict(enumerate(want)), name
    assert "blank.json" not in got


@pytest.mark.parametrize("size", [23, 1 << 20])
def test_maps_of_records(spark, tmp_path, size):
    rng = random.Random(5)
    member = lambda: {k: record(rng, i) if i % 5 else 3 for i, k in enumerate(["b", "a", 'q"', "é", "zz", "data"])}
    made = {"map": member(), "inner": {"version": {"a": 1}, "annotations": member()}, "list": {"items": [record(rng, 1)], "questions": member()}, "plain": [record(rng, 2)]}
    for name, value in made.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(value))
    got = {}
    for r in containers.read_containers(spark, str(tmp_path), containers.CONTAINERS, members=True, size=size).collect():
        got.setdefault(os.path.basename(r.path), {})[r.ordinal] = json.loads(r.record)
    for name in made:
        assert got[f"{name}.json"] == dict(enumerate(records.flatten_container((tmp_path / f"{name}.json").read_text()))), name


def test_records_must_be_objects(spark, tmp_path):
    (tmp_path / "x.json").write_text('[{"a": 1}, 2]')
    with pytest.raises(Exception, match="must be JSON objects"):
        containers.read_containers(spark, str(tmp_path)).collect()


def test_parts_are_one_after_the_other(spark, tmp_path):
    df = spark.range(1000).select("id", F.concat(F.lit("é"), F.col("id").cast("string")).alias("t"), F.create_map(F.lit("k"), "id").alias("m")).repartitionByRange(7, "id").sortWithinPartitions("id")
    want = "".join(f'{{"id":{i},"m":{{"k":{i}}},"t":"é{i}"}}\n' for i in range(1000)).encode()
    for _ in range(2):
        jsonl.write_jsonl(df, str(tmp_path / "one.jsonl"))
        jsonl.write_jsonl(df, str(tmp_path / "many"), parts=True)
        names = sorted(os.listdir(tmp_path / "many"))
        assert len(names) > 1 and b"".join((tmp_path / "many" / n).read_bytes() for n in names) == want
        assert (tmp_path / "one.jsonl").read_bytes() == want
    jsonl.write_jsonl(df.where("false"), str(tmp_path / "one.jsonl"))
    assert (tmp_path / "one.jsonl").read_bytes() == b"" and sorted(os.listdir(tmp_path)) == ["many", "one.jsonl"]


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    fails = F.when(F.col("id") == 777, F.raise_error(F.lit("broken row"))).otherwise("fine").alias("t")
    target = tmp_path / "out.jsonl"
    with pytest.raises(Exception, match="broken row"):
        jsonl.write_jsonl(spark.range(1000).repartition(5).select(fails), str(target))
    assert os.listdir(tmp_path) == []
    jsonl.write_jsonl(spark.range(3), str(target))
    with pytest.raises(Exception, match="broken row"):
        jsonl.write_jsonl(spark.range(1000).repartition(5).select(fails), str(target))
    assert target.read_text() == '{"id":0}\n{"id":1}\n{"id":2}\n' and os.listdir(tmp_path) == ["out.jsonl"]


def test_lines_are_found_by_place(spark, tmp_path):
    rng = random.Random(1)
    lines = [json.dumps({"n": i, "t": rng.choice(TEXTS) * rng.randrange(9)}, ensure_ascii=False) for i in range(400)]
    (tmp_path / "a.jsonl").write_text("".join(x + ("\r\n" if i % 9 == 0 else "\n") + ("\n  \n" if i % 7 == 0 else "") for i, x in enumerate(lines)))
    (tmp_path / "b.jsonl").write_text('{"n": "only"}')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "900b")
    try:
        index = jsonl.line_index(spark, [str(tmp_path / "a.jsonl"), str(tmp_path / "b.jsonl")])
        raw = {n: (tmp_path / n).read_bytes() for n in ("a.jsonl", "b.jsonl")}
        rows = index.collect()
        assert len(rows) == 401
        for r in rows:
            name = os.path.basename(r.path)
            text = raw[name][r.offset : r.offset + r.length].decode().strip()
            assert text == (lines[r.ordinal] if name == "a.jsonl" else '{"n": "only"}')
        wanted = index.where("ordinal % 50 = 3 or ordinal = 399").select("path", "ordinal")
        got = {r.ordinal: json.loads(r.record) for r in jsonl.fetch_lines(index, wanted.union(wanted)).collect()}
        assert got == {i: json.loads(lines[i]) for i in [*range(3, 400, 50), 399]}
        (tmp_path / "c.jsonl").write_text("\n \n")
        with pytest.raises(Exception, match="has no records"):
            jsonl.line_index(spark, str(tmp_path / "*.jsonl")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
