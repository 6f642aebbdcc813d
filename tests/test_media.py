"""Masks as ranges against bitmaps, frames against a plain search, nearest frames on one timeline."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.functions import runs as rn
from spindrift.functions.masks import pack_counts
from spindrift.operators import evaluation as ev
from spindrift.operators import rewards as rw


def bitmap_of(polygons, height, width):
    out = np.zeros((height, width), dtype=bool)
    for flat in polygons:
        pts = list(zip(flat[0::2], flat[1::2], strict=False))
        if len(pts) < 3:
            continue
        own = np.zeros_like(out)
        for (xa, ya), (xb, yb) in zip(pts, pts[1:] + pts[:1], strict=True):
            for x in range(width):
                if min(xa, xb) <= x + 0.5 < max(xa, xb):
                    y = ya + (x + 0.5 - xa) * ((yb - ya) / (xb - xa))
                    own[:, x] ^= np.arange(height) + 0.5 >= y
        out |= own
    return out


def ranges_of_bitmap(mask):
    flat = np.concatenate(([0], mask.T.reshape(-1).astype(int), [0]))
    edge = np.flatnonzero(np.diff(flat))
    return list(zip(edge[0::2].tolist(), edge[1::2].tolist(), strict=True))


def shapes(seed, n=40):
    rng = random.Random(seed)
    point = lambda: rng.choice([rng.uniform(-4, 30), float(rng.randrange(-2, 28)), rng.randrange(50) / 2])
    out = [[], [[1.0, 1.0]], [[0.0, 0.0, 20.0, 0.0, 20.0, 15.0, 0.0, 15.0]], [[2.0, 2.0, 9.0, 2.0, 9.0, 9.0, 2.0, 9.0], [5.0, 5.0, 14.0, 5.0, 14.0, 12.0, 5.0, 12.0]]]
    return out + [[[point() for _ in range(2 * rng.randrange(1, 8))] for _ in range(rng.randrange(1, 4))] for _ in range(n)]


def test_polygons_and_questions_equal_bitmaps(spark):
    height, width, cases = 15, 20, shapes(3)
    df = spark.createDataFrame([(i, c, pack_counts(rn.counts_of_ranges(ranges_of_bitmap(bitmap_of(c, height, width)), height * width))) for i, c in enumerate(cases)], "i int, polygons array<array<double>>, packed string")
    h, w = F.lit(height), F.lit(width)
    df = df.select("i", rn.drawn_ranges(F.col("polygons"), h, w).alias("mask"), rn.packed_ranges(F.col("packed")).alias("same")).cache()
    grid = df.join(spark.range(-1, width + 1).select(F.col("id").alias("x"))).join(spark.range(-1, height + 1).select(F.col("id").alias("y")))
    asked = grid.select("i", "x", "y", *[rn.covers(F.col("mask"), F.col("x"), F.col("y"), h, r).alias(f"r{r}") for r in (0, 1, 3)])
    maps = [bitmap_of(c, height, width) for c in cases]
    for r in df.select("i", "mask", "same", rn.area(F.col("mask")).alias("area"), rn.bounds(F.col("mask"), h).alias("bounds")).collect():
        bits = maps[r.i]
        assert [tuple(x) for x in r.mask] == ranges_of_bitmap(bits) == [tuple(x) for x in r.same], cases[r.i]
        ys, xs = np.where(bits)
        assert r.area == bits.sum() and r.bounds == ([xs.min(), ys.min(), xs.max(), ys.max()] if len(xs) else None)
    for r in asked.collect():
        for radius, said in ((0, r.r0), (1, r.r1), (3, r.r3)):
            part = maps[r.i][max(0, r.y - radius) : r.y + radius + 1, max(0, r.x - radius) : max(0, r.x + radius + 1)]
            if 0 <= r.x < width:
                assert said == bool(0 <= r.y < height and part.any()), (cases[r.i], r)


def test_broken_runs_are_null(spark):
    df = spark.createDataFrame([("P",), (None,), ("",), ("o",)], "c string").select(rn.packed_ranges(F.col("c")).alias("m"))
    assert [r.m for r in df.collect()] == [None, None, [], None]


def test_frame_places_agree_with_rewards(spark):
    rng, rows = random.Random(2), []
    for i in range(300):
        n = rng.randrange(1, 7)
        keys = [f"f{k}" if i % 5 == 0 else str(rng.randrange(40)) for k in range(n)]
        rows.append((i, keys, rng.randrange(0, 60) / 4, rng.choice([None, 0.0, 2.0]), rng.choice([None, 10.0])))
    df = spark.createDataFrame(rows, "i int, keys array<string>, time double, fps double, duration double")
    got = {r.i: r.at for r in df.select("i", rn.frame_at(*[F.col(c) for c in df.columns[1:]]).alias("at")).collect()}
    assert got == {i: rw.frame_at(keys, *rest) for i, keys, *rest in rows}


@pytest.mark.parametrize("share", [0.1, 0.9])
def test_nearest_frames(spark, share):
    rng = random.Random(4)
    video = lambda: "hot" if rng.random() < share else rng.choice("abc")
    frames = [(video(), rng.randrange(500)) for _ in range(300)] + [(None, 1), ("a", None)]
    asked = [(i, video() if i % 40 else "none", rng.randrange(-20, 1040) / 2, "x") for i in range(400)]
    asked += [(1000, "a", None, "x"), (1001, "a", float("nan"), "x"), (1002, None, 1.0, "x"), (5, *asked[5][1:])]
    f = spark.createDataFrame(frames, "video string, frame long").repartition(5)
    q = spark.createDataFrame(asked, "id long, video string, time double, _key string").repartition(3)
    want = []
    for i, v, t, _ in asked:
        own = [x for w, x in frames if w == v and x is not None]
        if v is not None and t is not None and t == t and own:
            want.append((i, v, t, min(own, key=lambda x: (abs(x - t), x))))
    got = [(r.id, r.video, r.time, r.frame) for r in ev.nearest_frame(f, q, "video").collect()]
    assert sorted(got) == sorted(want)
    assert ev.nearest_frame(f.limit(0), q, "video").collect() == []


def test_sample_orders(spark):
    df = spark.createDataFrame([("b", None, "2"), ("", "b", None), (None, None, "9"), ("a", "z", "10")], "videoID string, video_id string, question_id string")
    assert [(r.question_id, r.place) for r in ev.in_video_order(df).collect()] == [("9", 0), ("10", 1), (None, 2), ("2", 3)]
    df = spark.createDataFrame([("b", "x"), ("a", "z"), (None, "y"), ("a", "y")], "image_path string, expression string")
    assert [(r.image_path, r.expression) for r in ev.in_image_order(df).collect()] == [(None, "y"), ("a", "y"), ("a", "z"), ("b", "x")]
