"""Estimators and builders by name, table functions in SQL, labels of boxes."""

import pytest
from pyspark.sql import functions as F

from spindrift.functions import boxes as bx
from spindrift.functions import prompts as pr
from spindrift.operators import registry


def test_estimators_by_name_and_path(spark):
    df = spark.createDataFrame([(1, i, float(i)) for i in range(4)], "uid long, row_id long, reward double")
    assert sorted(registry.estimators.entries) == ["gae", "grpo", "reinforce_plus_plus", "remax", "rloo"]
    got = {r.row_id: r.advantage for r in registry.estimators.run("rloo", df).collect()}
    assert got == pytest.approx({i: i - (6 - i) / 3 for i in range(4)})
    same = registry.estimators.run("spindrift.operators.advantages:leave_one_out", df)
    assert {r.row_id: r.advantage for r in same.collect()} == got
    tokens = spark.createDataFrame([(1, [1.0, 2.0, 4.0], [1, 1, 0], 0.5)], "row_id long, reward_tokens array<double>, mask array<int>, baseline double")
    assert registry.estimators.run("remax", tokens).first().advantages == [2.5, 2.5, 0.0]
    with pytest.raises(ValueError, match="needs columns value_tokens"):
        registry.estimators.run("gae", tokens)
    with pytest.raises(KeyError, match="grpo"):
        registry.estimators.run("ppo", df)
    with pytest.raises(TypeError, match="no callable"):
        registry.builders.get("spindrift.operators.registry:GROUPED")
    with pytest.raises(ValueError, match="already"):
        registry.estimators.register("grpo")(len)


def test_table_functions(spark):
    registry.register_table_functions(spark)
    rows = spark.sql("SELECT * FROM expand_spans('v', array('a', 'b'), array(array(1D, 2D), array(3D, 4D)))").collect()
    assert [tuple(r) for r in rows] == [("v:000000", "a", 1.0, 2.0), ("v:000001", "b", 3.0, 4.0)]
    rows = spark.sql("""SELECT * FROM container_records('{"b": {"v": 1}, "a": {"id": 7}}')""").collect()
    assert [tuple(r) for r in rows] == [(0, '{"id": 7}'), (1, '{"id": "b", "v": 1}')]
    with pytest.raises(Exception, match="differ in number"):
        spark.sql("SELECT * FROM expand_spans('v', array('a'), array(array(1D, 2D), array(3D, 4D)))").collect()


def test_labels_come_from_the_nearest_name(spark):
    text = '{"name": "outer", "objects": [{"label": "cat", "bbox": [1,2,3,4]}, {"boxes": [[5,6,7,8], [1,2,3,4.0]]}, [0,0,1,1]]} [9,9,9,9]'
    assert bx.labelled_boxes_in(text)[:4] == [([1.0, 2.0, 3.0, 4.0], "cat"), ([5.0, 6.0, 7.0, 8.0], "outer"), ([0.0, 0.0, 1.0, 1.0], "outer"), ([9.0] * 4, None)]
    found = bx.candidates(F.lit(text))
    truth = F.array(*[F.lit(x) for x in (5.0, 6.0, 7.0, 9.0)])
    row = spark.range(1).select(bx.pick_candidate(found, truth).alias("first"), bx.pick_candidate(found, truth, best=True).alias("best")).first()
    assert (row.first.label, row.best.label, row.best.box) == ("cat", "outer", [5.0, 6.0, 7.0, 8.0])


def test_prompts_are_filled(spark):
    lit = F.lit
    options = F.array(lit("A. x"), lit("B. y"))
    row = spark.range(1).select(
        pr.fill("video_qa", lit("Which {options}?"), options), pr.fill("space_integer", lit("How many?")), pr.fill("spatial_grounding", pr.sentence(lit(" a dog "))), pr.fill("temporal_grounding_official", lit(None)),
        pr.sentence(lit("")), pr.sentence(lit("is it?")),
    ).first()
    assert row[0] == "Which {options}?\nOptions:\nA. x\nB. y\nAnswer with the option letter only within <answer>...</answer> tags. Example: <answer>A</answer>"
    assert row[1] == "How many?\nAnswer with an integer within <answer>...</answer> tags. Example: <answer>3</answer>"
    assert row[2].startswith('Locate "a dog." in the image.') and "sentence ''" in row[3] and row[4:] == ("", "is it?")
    assert set(pr.MEASURES.values()) < set(pr.TEMPLATES)
    with pytest.raises(Exception, match="no prompt template nothing"):
        spark.range(1).select(pr.fill("nothing", lit("x"))).collect()
