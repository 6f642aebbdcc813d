"""Interval and box geometry as expressions."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column
from pyspark.sql import functions as F


def positive(x: Column) -> Column:
    return F.greatest(F.lit(0.0), x)


def interval_iou(a0: Column, a1: Column, b0: Column, b1: Column, guard: float = 0.0) -> Column:
    """Overlap over the hull of two spans in any order of ends (R8); disjoint spans are measured by their hull."""
    lo_a, hi_a, lo_b, hi_b = F.least(a0, a1), F.greatest(a0, a1), F.least(b0, b1), F.greatest(b0, b1)
    overlap = positive(F.least(hi_a, hi_b) - F.greatest(lo_a, lo_b))
    hull = F.greatest(hi_a, hi_b) - F.least(lo_a, lo_b)
    return F.coalesce(F.when(hull > guard, overlap / hull), F.lit(0.0))


def box_iou(a: Column, b: Column, guard: float = 0.0) -> Column:
    """Overlap over union of two [x1, y1, x2, y2] arrays (R9); negative extents have no area, null boxes give 0.

    Evaluators use a guard of 1e-12 (X10).
    """
    at = lambda box, i: F.get(box, F.lit(i))
    side = lambda lo, hi: positive(hi - lo)
    inner = side(F.greatest(at(a, 0), at(b, 0)), F.least(at(a, 2), at(b, 2))) * side(F.greatest(at(a, 1), at(b, 1)), F.least(at(a, 3), at(b, 3)))
    area = lambda x: side(at(x, 0), at(x, 2)) * side(at(x, 1), at(x, 3))
    union = area(a) + area(b) - inner
    return F.coalesce(F.when((F.size(a) == 4) & (F.size(b) == 4) & (union > guard), inner / union), F.lit(0.0))


def frame_ious(predicted: Column, target: Column, guard: float = 1e-12) -> Column:
    """IoU of every target frame of MAP<STRING, ARRAY<DOUBLE>> columns; frames without a prediction score 0."""
    return F.transform(F.map_entries(target), lambda e: box_iou(F.try_element_at(predicted, e["key"]), e["value"], guard))


def mean_or_zero(values: Column) -> Column:
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(values) > 0, total / F.size(values)).otherwise(0.0)


def common_frame_iou(predicted: Column, target: Column) -> Column:
    """Mean IoU over the frames that both have."""
    both = F.filter(F.map_entries(target), lambda e: F.map_contains_key(predicted, e["key"]))
    return mean_or_zero(F.transform(both, lambda e: box_iou(F.try_element_at(predicted, e["key"]), e["value"], 1e-12)))


def coverage(predicted: Column, target: Column) -> Column:
    """Share of the target frames that have a prediction."""
    hit = F.filter(F.map_keys(target), lambda k: F.map_contains_key(predicted, k))
    return F.when(F.size(target) > 0, F.size(hit) / F.size(target)).otherwise(0.0)


def relative_accuracy(predicted: Column, target: Column, thresholds: list[float] | None = None) -> Column:
    """Share of thresholds t with relative error at most 1 - t (R10); 0 for a target of 0."""
    levels = thresholds or [0.50 + 0.05 * i for i in range(10)]
    error = F.abs(predicted - target) / F.abs(target)
    hits = [(error <= F.lit(1.0 - t)).cast("double") for t in levels]
    total = hits[0]
    for h in hits[1:]:
        total = total + h
    return F.coalesce(F.when(target != 0, total / len(levels)), F.lit(0.0))


def even_thresholds() -> list[float]:
    """Ten evenly spaced thresholds as evaluators make them (X5): they differ from sums of 0.05 in the last bit."""
    step = (0.95 - 0.5) / 9
    return [0.5 + step * i for i in range(9)] + [0.95]


def assignment_similarity(predicted: Column, target: Column, sigma: float = 50.0) -> Column:
    """exp(-(d/3)**2 / 2 sigma**2) for the best matching of three points each."""
    at = lambda points, i, j: F.get(F.get(points, F.lit(i)), F.lit(j))
    gap = lambda i, j: F.hypot(at(predicted, i, 0) - at(target, j, 0), at(predicted, i, 1) - at(target, j, 1))
    sums = [gap(p[0], 0) + gap(p[1], 1) + gap(p[2], 2) for p in permutations(range(3))]
    mean = F.least(*sums) / 3
    fits = (F.size(predicted) == 3) & (F.size(target) == 3)
    return F.coalesce(F.when(fits, F.exp(-(mean * mean) / (2 * sigma * sigma))), F.lit(0.0))
