"""Rewards: the built oracle response wins in every family, formats are strict, masks round-trip."""

import json
import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from spindrift.functions import boxes as bx
from spindrift.functions import parsing as ps
from spindrift.functions.masks import Mask, pack_counts, repair_rle, unpack_counts
from spindrift.functions.replies import Reply, balanced_object
from spindrift.operators import rewards as rw

BOXES = {"1": [0, 0, 10, 10], "2": [10, 10, 20, 20]}
POINTS = {"boxes": [200, 200, 600, 600], "positive_points": [[300, 300], [400, 400], [500, 500]], "negative_points": [[10, 10], [900, 900], [10, 900]]}
CASES = [
    ("temporal_grounding", {"time": [1, 3]}, "<answer>8 to 9</answer>", {}),
    ("tracking", {"boxes": BOXES}, json.dumps({"boxes": BOXES}), {}),
    ("segmentation", POINTS, '<answer>{"boxes":[100,100,400,400]}</answer>', {}),
    ("spatial_grounding", {"bbox_2d": [10, 20, 40, 60]}, "[10,20,40,60]", {}),
    ("spatial_temporal_grounding", {"time": [1, 2], "boxes": BOXES}, '<answer>{"time":[1,2],"boxes":{"1":[50,50,60,60]}}</answer>', {}),
    ("spatial_intelligence", "5", "<answer>12</answer>", {"problem_type": "object_counting"}),
    ("video_qa", "<answer>H</answer>", "<answer>A</answer>", {}),
]


@pytest.mark.parametrize(("family", "truth", "wrong", "extra"), CASES)
def test_oracle_beats_wrong_answers(family, truth, wrong, extra):
    right = rw.ORACLES[family](truth, extra)
    score = lambda r: rw.SCORERS[family]({"ground_truth": truth, "response": r, **extra})["overall"]
    assert score(right) == 1.0 and score(wrong) < 1.0
    assert rw.infer_family(truth) == family


@pytest.mark.parametrize(
    ("name", "family"),
    [("Temporal Grounding", "temporal_grounding"), ("video_tracking", "tracking"), ("image-segmentation", "segmentation"), ("RefCOCO", "spatial_grounding"), ("spatial-temporal grounding", "spatial_temporal_grounding"), ("object_rel_direction_hard", "spatial_intelligence"), ("video_qa_mc", "video_qa")],
)
def test_labels(spark, name, family):
    assert rw.family_of(name) == family
    df = spark.createDataFrame([(None, name)], "task string, problem_type string")
    assert rw.route(df, ["task", "problem_type"]).first().family == family
    with pytest.raises(rw.UnknownTask):
        rw.family_of("cooking")


def test_partial_scores():
    one = '<answer>{"boxes":{"1":[0,0,10,10]}}</answer>'
    assert rw.score_tracking({"ground_truth": {"boxes": BOXES}, "response": one})["overall"] == 0.5
    tube = '<answer>{"time":[1,2],"boxes":{"1":[0,0,10,10]}}</answer>'
    assert rw.score_tube({"ground_truth": {"time": [1, 2], "boxes": BOXES}, "response": tube})["overall"] == pytest.approx(0.6)
    assert rw.score_choice({"ground_truth": "b", "response": "<answer>b</answer>"})["overall"] == 1.0
    assert rw.score_choice({"ground_truth": "b", "response": "it is B"})["format"] == 0.0


def runs_of(mask):
    flat = mask.T.reshape(-1)
    runs, now = [], 0
    for bit in flat:
        if bit != now:
            runs.append(0) if not runs else None
            now = bit
            runs.append(0)
        if not runs:
            runs.append(0)
        runs[-1] += 1
    return runs


def test_masks_round_trip_and_match_bitmaps():
    rng = random.Random(1)
    for _ in range(60):
        h, w = rng.randint(1, 12), rng.randint(1, 12)
        bitmap = np.array([[rng.random() < 0.3 for _ in range(w)] for _ in range(h)])
        flat = bitmap.T.reshape(-1).astype(int).tolist()
        runs, now, n = [], 0, 0
        for bit in flat:
            if bit != now:
                runs.append(n)
                n, now = 0, bit
            n += 1
        runs.append(n)
        assert unpack_counts(pack_counts(runs)) == runs
        mask = Mask.from_rle({"size": [h, w], "counts": pack_counts(runs)})
        assert bool(mask) == bool(bitmap.any())
        if bitmap.any():
            ys, xs = np.where(bitmap)
            assert mask.bounds() == (xs.min(), ys.min(), xs.max(), ys.max())
        for x in range(w):
            for y in range(h):
                for r in (0, 1, 3):
                    assert mask.near(x, y, r) == bool(bitmap[max(0, y - r) : y + r + 1, max(0, x - r) : x + r + 1].any())
    assert repair_rle(None, 3, 4) == {"size": [3, 4], "counts": [12]}
    assert Mask.from_rle({"size": [2], "counts": "1"}) is None


def square():
    runs = [20 * 100 + 20] + [40, 60] * 39 + [40]
    return {"size": [100, 100], "counts": [*runs, 10_000 - sum(runs)]}


def test_mask_aware_scores():
    item = {"ground_truth": POINTS, "response": rw.oracle_segmentation(POINTS), "data_type": "image", "segmentation_output": square()}
    out = rw.score_segmentation(item)
    assert (out["overall"], out["mask_aware_used"]) == (1.0, 1.0)
    packed = {**square(), "counts": pack_counts(square()["counts"])}
    empty = {"size": [100, 100], "counts": [10_000]}
    timed = {**POINTS, "time": 1.0}
    video = {"ground_truth": timed, "response": rw.oracle_segmentation(timed), "data_type": "video", "fps": 10, "segmentation_output": {"segmentation_rle": {"0": empty, "10": packed}, "frames": ["0", "10"]}}
    assert rw.score_segmentation(video)["overall"] == 1.0
    assert rw.score_segmentation({**video, "response": rw.oracle_segmentation({**timed, "time": 0.0})})["overall"] == 0.0


def test_scores_on_spark_keep_rows(spark):
    rows = [(i, family, json.dumps({"ground_truth": t, "response": rw.ORACLES[family](t, e), **e})) for i, (family, t, _, e) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "row_id long, family string, item string")
    assert {r.row_id: r.metrics["overall"] for r in rw.score(df).collect()} == {i: 1.0 for i in range(7)}
    with pytest.raises(Exception, match="overall"):
        rw.score(df.where("row_id = 0"), scorers={"temporal_grounding": lambda item: {"iou": 1.0}}).collect()


@pytest.mark.parametrize(
    ("text", "letter"),
    [("The answer is C.", "C"), ("(B) since", "B"), ("A. red", "A"), ("<think>A</think><answer>D</answer>", "D"), ("option E", "E"), ("", ""), ("nothing", ""), ("答案是 B", "B"), ("maybe A, but finally (C)", "C"),
     ("The best answer is A, not B", "B"), ("I choose (D) over C.", "C"), ("the answer is E ... the answer is unknown", "E"), ("b", "B"), ("Ab", ""), ("USA. no", "A"), ("x C: y D) z", "C"), ("'F'", "F"),
     ("<think>(A)</think><think>(B)", "B"), ("the answer is d", "D"), ("...", ""), (None, "")],
)
def test_choice_letters(spark, text, letter):
    assert one(spark, ps.choice_letter(F.lit(text))) == letter


def one(spark, *columns):
    row = spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()
    return row[0] if len(columns) == 1 else tuple(row)


def test_json_parsers():
    assert bx.boxes_in('<answer>{"bbox":[1,2,3,4]}</answer>') == [[1.0, 2.0, 3.0, 4.0]]
    assert bx.boxes_in('{"boxes":[[5,6,7,8],{"box":[1,2,3,4]}],"bbox":[9,9,9,9]} (1,2),(3,4)') == [[9.0] * 4, [5.0, 6.0, 7.0, 8.0], [1.0, 2.0, 3.0, 4.0]]
    assert bx.boxes_in("from (1, 2) (3,4.5) on") == [[1.0, 2.0, 3.0, 4.5]] and bx.boxes_in("1 2 3 4 5") == [[1.0, 2.0, 3.0, 4.0]]
    assert bx.boxes_in('```json\n[{"other":[1,2,3,4]}]\n```') == [[1.0, 2.0, 3.0, 4.0]] and bx.boxes_in(None) == bx.boxes_in("1 2 3") == []
    assert balanced_object('x {"a": {"b": 1}} y') == {"a": {"b": 1}}
    assert bx.frame_boxes({"1.7": [0, 0, 1, 1], "x": [1], "2": [0, 1]}, bx.cut_frame, bx.flat_box) == {"1": [0.0, 0.0, 1.0, 1.0]}
    assert bx.frame_boxes({"1.7": [0, 0, 1, 1], "2.0": [0, 0, 1, 1]}) == {"2": [0.0, 0.0, 1.0, 1.0]}


@pytest.mark.parametrize(
    ("text", "payload", "answer"),
    [
        ("<answer> 3 </answer>", "3", "3"), ("<think>a</think> <answer>b</answer>\n", "b", "b"), ("a</think><answer>b</answer>", "b", "b"), ("x <answer>b</answer>", None, "b"), ("<answer></answer>", None, ""),
        ("<answer>a</answer><answer>b</answer>", "a</answer><answer>b", "b"), ("<ANSWER>c</Answer> .", None, "c"), ("<answer>a", None, "<answer>a"), (None, None, ""), (5, None, "5"), ("<answer>a</think><answer>b</answer>", "b", "a</think><answer>b"),
    ],
)
def test_replies(text, payload, answer):
    assert (Reply(text).payload, Reply(text).answer) == (payload, answer)


def test_spoken_and_values():
    assert [Reply(t).spoken.text for t in ("<think>a</think>b", "a</think> b", "<think>a</think>b</think>c", "b<think>a", "a<think>x</think>b")] == ["b", "b", "c", "b<think>a", "ab"]
    values = [Reply(t).value for t in ("```json\n[1]\n```", 'so {"a": [2]} and {"b": 3}', "null", "4", "words", [7], "<answer>```{}```</answer>")]
    assert values == [[1], {"a": [2]}, None, 4, None, [7], {}]
    assert bx.first_box({"box": [9, 9, 9, 9], "bbox": [[1, 2, 3], {"bbox_2d": ["1", 2, 3, 4]}], "other": [5, 5, 5, 5]}) == [1, 2, 3, 4]
    assert bx.first_box([[True, 1, 2, 3], {}]) is None and bx.cornered([5, 1, 2, 4]) == [2, 1, 5, 4] and bx.cornered(None) is None


def test_picked_boxes(spark):
    box = lambda *xs: F.array(*[F.lit(float(x)) for x in xs])
    boxes = F.array(box(0, 0, 1, 1), box(0, 0, 4, 4), box(0, 0, 4, 4))
    got = one(spark, bx.pick_box(boxes, box(0, 0, 4, 5)), bx.pick_box(boxes, box(0, 0, 4, 5), best=True), bx.pick_box(F.slice(boxes, 1, 0), box(0, 0, 1, 1), best=True))
    assert got == ([0.0, 0.0, 1.0, 1.0], [0.0, 0.0, 4.0, 4.0], None)


@pytest.mark.parametrize(
    ("text", "spans"),
    [
        ("from 00:01:00 to 01:30.5", [(60.0, 90.5)]), ("<answer>3 - 7.5</answer>", [(3.0, 7.5)]), ("it starts at 4 and ends at 9", [(4.0, 9.0)]),
        ("1:00:30, 2:00 and 3:00", [(3630.0, 120.0)]), ("at 1:05 then 3 to 8", [(3.0, 8.0)]), ("<answer>a 1 to 2, 3 to 4", [(1.0, 2.0), (3.0, 4.0)]),
        ("9 - 12 <answer>1.5 2</answer> 7", [(1.5, 2.0)]), ("only 5", []), (None, []),
    ],
)
def test_time_spans(spark, text, spans):
    assert [tuple(r) for r in one(spark, ps.time_spans(F.lit(text)))] == spans


def test_free_text_parsers(spark):
    lit = F.lit
    assert tuple(one(spark, ps.predicted_span(lit("nothing"), lit(5)))) == (15.0, 25.0, False)
    assert tuple(one(spark, ps.predicted_span(lit("2.5 to 3.5"), lit(5)))) == (2.0, 4.0, True)
    assert one(spark, ps.same_to_cents(lit("1,000.001"), lit("<answer>1000.00</answer>")), ps.same_to_cents(lit("x"), lit("x"))) == (1.0, 0.0)
    options = F.array(lit("A. a cat"), lit("B. a dog"), lit("groß"))
    letters = [ps.true_letter(lit(t), options) for t in ("a dog", " A  CAT ", "GROSS", "(B)", None)] + [ps.true_letter(lit("(C)"), lit(None).cast("array<string>"))]
    assert one(spark, *letters) == ("B", "A", "C", "B", "", "C")
    assert one(spark, ps.loose_number(lit("A.2")), ps.loose_token(lit("</think> B")), ps.loose_token(lit("")), ps.loose_number(lit("none"))) == ("2", "B", "", "none")
    scores = one(spark, ps.loose_score(lit("object_counting_single"), lit("2"), lit("0")), ps.loose_score(lit("object_counting"), lit("2"), lit("2")), ps.loose_score(lit("route"), lit("b."), lit("B")))
    assert scores == (0.0, 1.0, 1.0)
    spatial = [tuple(x) for x in one(spark, *[ps.spatial_score(lit(k), lit(a), lit(t)) for k, a, t in (("object_abs_distance", "about 10", "10"), ("object_counting", "none", "4"), ("route", "(A)", "A"))])]
    assert spatial == [("MRA", "10.0", 1.0), ("MRA", "", 0.0), ("ACC", "A", 1.0)]
    assert one(spark, ps.listed_letters(lit("x A. b B. c")), ps.listed_letters(lit("which"))) == (["A", "B"], ["A", "B", "C", "D"])
    choices = F.array(lit("x"), lit("y"))
    got = one(spark, *[ps.indexed_letter(lit(i).cast("long"), lit(t), choices) for i, t in ((1, None), (2, None), (None, "(C)"), (None, "zebra"))])
    assert got == ("B", "", "C", "Z")


