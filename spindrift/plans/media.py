"""Registered queries on masks and frames, and on the nearest frame of a time."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from spindrift.functions import runs as rn
from spindrift.functions.masks import pack_counts
from spindrift.operators import evaluation as ev
from spindrift.operators import rewards as rw
from spindrift.plans.tables import read

QUERIES, SQL = {}, {}
HEIGHT, WIDTH = 18, 24


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


@query(
    "j8_nearest_frame",
    """WITH f AS (SELECT DISTINCT user_id % 40 AS video, event_id AS frame FROM events), q AS (SELECT event_id AS id, user_id % 40 AS video, CAST(event_id + event_id * 7919 % 2003 - 1000 AS DOUBLE) AS time FROM events),
    lo AS (SELECT q.id, f.frame FROM q ASOF LEFT JOIN f ON q.video = f.video AND q.time >= f.frame),
    hi AS (SELECT q.id, f.frame FROM q ASOF LEFT JOIN f ON q.video = f.video AND q.time < f.frame)
    SELECT q.id, CASE WHEN hi.frame IS NULL OR q.time - lo.frame <= hi.frame - q.time THEN lo.frame WHEN lo.frame IS NULL THEN hi.frame ELSE hi.frame END AS frame
    FROM q JOIN lo ON q.id = lo.id JOIN hi ON q.id = hi.id""",
)
def _(spark, d):
    events = read(spark, d, "events")
    video, event = (F.col("user_id") % 40).alias("video"), F.col("event_id")
    asked = events.select(event.alias("id"), video, (event + event * 7919 % 2003 - 1000).cast("double").alias("time"))
    return ev.nearest_frame(events.select(video, event.alias("frame")), asked, "video").select("id", "frame")


def _triangles(spark, d):
    """events as triangles in an image; some reach beyond it, some are flat."""
    e = F.col("event_id")
    corner = lambda a, b, s: (e * a % s - b).cast("double") + 0.25
    points = [corner(7, 2, WIDTH), corner(5, 1, HEIGHT), corner(11, 0, WIDTH), corner(13, 3, HEIGHT), corner(17, 0, WIDTH + 9), corner(3, 0, HEIGHT + 9)]
    return read(spark, d, "events").select(e.alias("id"), F.array(F.array(*points)).alias("polygons"))


TRIANGLES = f"""p AS (SELECT event_id AS id, event_id * 7 % {WIDTH} - 2 + 0.25::DOUBLE AS xa, event_id * 5 % {HEIGHT} - 1 + 0.25::DOUBLE AS ya, event_id * 11 % {WIDTH} + 0.25::DOUBLE AS xb, event_id * 13 % {HEIGHT} - 3 + 0.25::DOUBLE AS yb,
  event_id * 17 % {WIDTH + 9} + 0.25::DOUBLE AS xc, event_id * 3 % {HEIGHT + 9} + 0.25::DOUBLE AS yc FROM events),
edges AS (SELECT id, xa AS x0, ya AS y0, xb AS x1, yb AS y1 FROM p UNION ALL SELECT id, xb, yb, xc, yc FROM p UNION ALL SELECT id, xc, yc, xa, ya FROM p),
crossed AS (SELECT id, col, y0 + (col + 0.5 - x0) * ((y1 - y0) / (x1 - x0)) AS y FROM edges, (SELECT unnest(range({WIDTH})) AS col) WHERE col + 0.5 >= least(x0, x1) AND col + 0.5 < greatest(x0, x1)),
inside AS (SELECT id, col AS x, row AS y FROM crossed, (SELECT unnest(range({HEIGHT})) AS row) GROUP BY id, col, row HAVING count(*) FILTER (WHERE crossed.y <= row + 0.5) % 2 = 1)"""


@query(
    "x13_polygon_runs",
    f"""WITH {TRIANGLES} SELECT p.id, count(x) AS pixels, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1, coalesce(bool_or(x = 9 AND y = 7), false) AS center
    FROM p LEFT JOIN inside ON p.id = inside.id GROUP BY p.id""",
)
def _(spark, d):
    size = [F.lit(HEIGHT), F.lit(WIDTH)]
    drawn = _triangles(spark, d).withColumn("mask", rn.drawn_ranges(F.col("polygons"), *size))
    mask, edge = F.col("mask"), rn.bounds(F.col("mask"), size[0])
    sides = [F.get(edge, F.lit(i)).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))]
    return drawn.select("id", rn.area(mask).alias("pixels"), *sides, rn.covers(mask, F.lit(9), F.lit(7), size[0]).alias("center"))


@query(
    "r12_packed_runs",
    f"""WITH {TRIANGLES} SELECT p.id, count(x) AS pixels, sum(x * {HEIGHT} + y) AS places FROM p LEFT JOIN inside ON p.id = inside.id GROUP BY p.id""",
)
def _(spark, d):
    @F.pandas_udf("string")
    def packed(shapes: pd.Series) -> pd.Series:
        return shapes.map(lambda s: pack_counts(rn.counts_of_ranges(rn.polygon_ranges([list(p) for p in s], HEIGHT, WIDTH), HEIGHT * WIDTH)))

    rows = _triangles(spark, d).select("id", rn.packed_ranges(packed("polygons")).alias("mask"))
    numbers = F.transform("mask", lambda r: (r["start"] + r["stop"] - 1) * (r["stop"] - r["start"]))
    total = F.when(F.size("mask") > 0, F.aggregate(numbers, F.lit(0).cast("long"), lambda a, n: a + n) / 2)
    return rows.select("id", rn.area(F.col("mask")).alias("pixels"), total.cast("long").alias("places"))


@query(
    "r14_near_mask",
    f"""WITH {TRIANGLES}, q AS (SELECT event_id AS id, event_id * 19 % {WIDTH + 4} - 2 AS px, event_id * 23 % {HEIGHT + 4} - 2 AS py FROM events)
    SELECT q.id, coalesce(bool_or(x = px AND y = py), false) AS on_mask, coalesce(bool_or(abs(x - px) <= 3 AND abs(y - py) <= 3 AND py BETWEEN 0 AND {HEIGHT - 1} AND px BETWEEN 0 AND {WIDTH - 1}), false) AS near_mask
    FROM q LEFT JOIN inside ON q.id = inside.id GROUP BY q.id""",
)
def _(spark, d):
    e, mask = F.col("id"), F.col("mask")
    drawn = _triangles(spark, d).withColumn("mask", rn.drawn_ranges(F.col("polygons"), F.lit(HEIGHT), F.lit(WIDTH)))
    x, y = e * 19 % (WIDTH + 4) - 2, e * 23 % (HEIGHT + 4) - 2
    near = (x >= 0) & (x < WIDTH) & rn.covers(mask, x, y, F.lit(HEIGHT), 3)
    return drawn.select("id", rn.covers(mask, x, y, F.lit(HEIGHT)).alias("on_mask"), near.alias("near_mask"))


@query(
    "r13_frame_pick",
    """WITH s AS (SELECT event_id AS id, event_id % 6 + 1 AS n, event_id % 4 = 3 AS words, user_id % 3 AS step, value / 40 AS time, CASE WHEN event_id % 3 = 0 THEN 2.0::DOUBLE END AS fps, CASE WHEN event_id % 5 < 2 THEN 12.5::DOUBLE END AS duration FROM events),
    k AS (SELECT *, unnest(range(n)) AS i FROM s), a AS (SELECT id, i, n, i * (step + 2) + step AS key, NOT words AND (fps IS NOT NULL OR duration IS NULL) AS by_key,
      CASE WHEN fps IS NOT NULL THEN time * fps WHEN duration IS NOT NULL THEN time / duration * (n - 1) WHEN NOT words THEN time ELSE 0 END AS target FROM k)
    SELECT id, arg_min(i, [abs(CASE WHEN by_key THEN key ELSE i END - target), CASE WHEN by_key THEN i ELSE i % 2 END, i]) AS at FROM a GROUP BY id""",
)
def _(spark, d):
    e, step = F.col("event_id"), F.col("user_id") % 3
    name = lambda i: F.when(e % 4 == 3, F.concat(F.lit("frame-"), i.cast("string"))).otherwise((i * (step + 2) + step).cast("string"))
    keys = F.transform(F.sequence(F.lit(0).cast("long"), e % 6), name)
    at = rn.frame_at(keys, F.col("value") / 40, F.when(e % 3 == 0, 2.0), F.when(e % 5 < 2, 12.5))
    return read(spark, d, "events").select(e.alias("id"), at.cast("long").alias("at"))


@query(
    "r7_mask_scores",
    """WITH s AS (SELECT event_id AS id, event_id % 30 AS x0, event_id % 20 AS y0, event_id % 30 + 5 + user_id % 9 AS x1, event_id % 20 + 4 + user_id % 7 AS y1, event_id * 13 % 1000 AS px, event_id * 7 % 1000 AS py, event_id * 11 % 900 AS bx, event_id * 3 % 900 AS b_y FROM events),
    m AS (SELECT *, least(x1, 49) AS mx, least(y1, 39) AS my FROM s),
    pts AS (SELECT id, i, (px + i * 150) % 1000 AS ux, (py + i * 90) % 1000 AS uy FROM m, (SELECT unnest(range(6)) AS i)),
    h AS (SELECT m.id, pts.i, round_even(ux * 50 / 1000.0::DOUBLE, 0) AS cx, round_even(uy * 40 / 1000.0::DOUBLE, 0) AS cy, x0, y0, mx, my FROM pts JOIN m ON pts.id = m.id),
    n AS (SELECT id, i, cx BETWEEN 0 AND 49 AND cy BETWEEN 0 AND 39 AND cx BETWEEN x0 - 3 AND mx + 3 AND cy BETWEEN y0 - 3 AND my + 3 AS near FROM h),
    r AS (SELECT id, count(*) FILTER (WHERE i < 3 AND near) / 3.0::DOUBLE AS plus, count(*) FILTER (WHERE i > 2 AND NOT near) / 3.0::DOUBLE AS minus FROM n GROUP BY id),
    b AS (SELECT m.id, plus, minus, bx * 0.05::DOUBLE AS l, b_y * 0.04::DOUBLE AS t, (bx + 100) * 0.05::DOUBLE AS rr, (b_y + 100) * 0.04::DOUBLE AS bb, x0, y0, mx + 1 AS ox, my + 1 AS oy FROM m JOIN r ON m.id = r.id),
    i AS (SELECT *, greatest(0, least(rr, ox) - greatest(l, x0)) * greatest(0, least(bb, oy) - greatest(t, y0)) AS cut FROM b),
    f AS (SELECT *, cut / ((rr - l) * (bb - t) + (ox - x0) * (oy - y0) - cut) AS fit FROM i)
    SELECT id, round(CAST(least(WEIGHTS0 * fit + WEIGHTS1 * plus + WEIGHTS2 * minus, CASE WHEN plus <= 0 THEN ZERO ELSE 1 END, CASE WHEN fit < LEAST_IOU THEN MISS ELSE 1 END) AS DOUBLE), 6) AS overall FROM f"""
    .replace("WEIGHTS0", str(rw.IMAGE_WEIGHTS[0])).replace("WEIGHTS1", str(rw.IMAGE_WEIGHTS[1])).replace("WEIGHTS2", str(rw.IMAGE_WEIGHTS[2]))
    .replace("ZERO", str(rw.ZERO_CAP)).replace("LEAST_IOU", str(rw.MISS_IOU)).replace("MISS", str(rw.MISS_CAP)),
)
def _(spark, d):
    e, u = F.col("event_id"), F.col("user_id")
    x0, y0 = e % 30, e % 20
    x1, y1 = F.least(x0 + 5 + u % 9, F.lit(49)), F.least(y0 + 4 + u % 7, F.lit(39))
    tall, gap = y1 - y0 + 1, 40 - (y1 - y0 + 1)
    # columns of the rectangle: all but the first are a gap and a run
    counts = F.concat(F.array(x0 * 40 + y0, tall), F.flatten(F.transform(F.sequence(x0 + 1, x1), lambda _: F.array(gap, tall))), F.array(F.lit(2000).cast("long") - (x1 * 40 + y1 + 1)))
    points = lambda lo: F.transform(F.array(*[F.lit(i).cast("long") for i in range(lo, lo + 3)]), lambda i: F.array((e * 13 % 1000 + i * 150) % 1000, (e * 7 % 1000 + i * 90) % 1000))
    box = F.array(e * 11 % 900, e * 3 % 900, e * 11 % 900 + 100, e * 3 % 900 + 100)
    said = F.to_json(F.struct(box.alias("boxes"), points(0).alias("positive_points"), points(3).alias("negative_points")))
    mask = F.struct(F.array(F.lit(40), F.lit(50)).alias("size"), counts.alias("counts"))
    item = F.to_json(F.struct(
        F.concat(F.lit("<answer>"), said, F.lit("</answer>")).alias("response"), F.lit('{"boxes":[0,0,9,9]}').alias("ground_truth"),
        F.lit("image").alias("data_type"), mask.alias("segmentation_output"),
    ))
    rows = read(spark, d, "events").select(e.alias("id"), F.lit("segmentation").alias("family"), item.alias("item"))
    return rw.score(rows).select("id", F.round(F.element_at("metrics", "overall"), 6).alias("overall"))
