"""Masks as arrays of column-major ranges (R12, R14, X13): what is asked of a mask is an expression over its ranges.

A mask is ARRAY<STRUCT<start, stop>>, sorted and apart: pixel (x, y) of an image h rows high has the number x * h + y.
Packed run lengths and polygons are turned into ranges on Arrow batches; no bitmap is ever made.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from spindrift.functions.masks import unpack_counts

RANGES = "array<struct<start:long,stop:long>>"


def ranges_of_counts(counts: list[int]) -> list[tuple[int, int]]:
    """Foreground ranges of run lengths, which begin with background."""
    ends = np.cumsum(np.array(counts, dtype=np.int64))
    return [(int(a), int(b)) for a, b in zip(ends[0::2], ends[1::2], strict=False) if b > a]


def counts_of_ranges(ranges: list[tuple[int, int]], size: int) -> list[int]:
    """Run lengths of an image of so many pixels."""
    edges = [0, *(e for r in ranges for e in r), size]
    out = [b - a for a, b in zip(edges, edges[1:], strict=False)]
    return out[:-1] if len(out) > 1 and not out[-1] else out


def polygon_ranges(polygons: list[list[float]], height: int, width: int) -> list[tuple[int, int]]:
    """Ranges of the pixels whose centres lie in any of the polygons (flat lists x, y, x, y...; even-odd rule).

    The line through a column's centres crosses the edges of a polygon an even number of times; rows between the first
    and second crossing are inside, and so on. Polygons of less than three points are empty.
    """
    parts = []
    for flat in polygons:
        p = np.array(flat[: len(flat) // 2 * 2], dtype=np.float64).reshape(-1, 2)
        if len(p) < 3 or not np.isfinite(p).all():
            continue
        q = np.roll(p, -1, axis=0)
        low, high = np.minimum(p[:, 0], q[:, 0]), np.maximum(p[:, 0], q[:, 0])
        first = np.clip(np.ceil(low - 0.5), 0, width).astype(np.int64)  # centres in [low, high)
        count = np.maximum(np.clip(np.ceil(high - 0.5), 0, width).astype(np.int64) - first, 0)
        edge = np.repeat(np.arange(len(p)), count)
        column = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + first[edge]
        slope = (q[edge, 1] - p[edge, 1]) / (q[edge, 0] - p[edge, 0])
        y = p[edge, 1] + (column + 0.5 - p[edge, 0]) * slope
        by = np.lexsort((y, column))
        row = np.clip(np.ceil(y[by] - 0.5), 0, height).astype(np.int64) + column[by] * height
        parts.append(np.stack((row[0::2], row[1::2])))
    if not parts:
        return []
    start, stop = np.concatenate(parts, axis=1)
    order = np.argsort(start[keep := stop > start], kind="stable")
    out: list[tuple[int, int]] = []
    for a, b in zip(start[keep][order].tolist(), stop[keep][order].tolist(), strict=True):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _as_rows(ranges: list[tuple[int, int]] | None) -> list[dict] | None:
    return None if ranges is None else [{"start": a, "stop": b} for a, b in ranges]


def packed_ranges(counts: Column) -> Column:
    """Ranges of packed run lengths (R12); null where they cannot be read."""

    @F.pandas_udf(RANGES)
    def read(texts: pd.Series) -> pd.Series:
        def one(text):
            try:
                runs = unpack_counts(text) if text is not None else None
            except (ValueError, IndexError):
                runs = None
            return None if runs is None or any(r < 0 for r in runs) else _as_rows(ranges_of_counts(runs))

        return texts.map(one)

    return read(counts)


def drawn_ranges(polygons: Column, height: Column, width: Column) -> Column:
    """Ranges of polygons (X13), ARRAY<ARRAY<DOUBLE>>, in an image of a size; without polygons none."""

    @F.pandas_udf(RANGES)
    def draw(shapes: pd.Series, heights: pd.Series, widths: pd.Series) -> pd.Series:
        made = [_as_rows(polygon_ranges([] if s is None else [list(p) for p in s], int(h), int(w))) for s, h, w in zip(shapes, heights, widths, strict=True)]
        return pd.Series(made)

    return draw(polygons, height, width)


def area(mask: Column) -> Column:
    """Number of pixels."""
    return F.aggregate(mask, F.lit(0).cast("long"), lambda n, r: n + r["stop"] - r["start"])


def covers(mask: Column, x: Column, y: Column, height: Column, radius: int = 0) -> Column:
    """Whether (x, y) lies on the mask, or a pixel of the mask within radius rows and columns of it."""
    top, bottom = F.greatest(y - radius, F.lit(0)), F.least(y + radius, height - 1)

    def meets(r: Column) -> Column:
        first, last = F.floor(r["start"] / height), F.floor((r["stop"] - 1) / height)
        lo, hi = F.greatest(x - radius, first), F.least(x + radius, last)
        begins = F.when(lo == first, r["start"] % height).otherwise(0)  # rows of the range in its first column looked at
        ends = F.when(hi == last, (r["stop"] - 1) % height).otherwise(height - 1)
        one = (begins <= bottom) & (F.when(first == last, ends).otherwise(height - 1) >= top)
        two = (F.when(first == last, begins).otherwise(0) <= bottom) & (ends >= top)
        alone = (begins <= bottom) & (ends >= top)
        return (lo <= hi) & F.when(lo == hi, alone).otherwise((hi - lo > 1) | one | two)

    return F.coalesce((y >= 0) & (y < height) & F.exists(mask, meets), F.lit(False))


def bounds(mask: Column, height: Column) -> Column:
    """Least and largest column and row of the mask, x0, y0, x1, y1; null for an empty one."""
    column = lambda n: F.floor(n / height)
    over = lambda r: column(r["start"]) != column(r["stop"] - 1)
    top = F.array_min(F.transform(mask, lambda r: F.when(over(r), 0).otherwise(r["start"] % height)))
    bottom = F.array_max(F.transform(mask, lambda r: F.when(over(r), height - 1).otherwise((r["stop"] - 1) % height)))
    left, right = F.array_min(F.transform(mask, lambda r: column(r["start"]))), F.array_max(F.transform(mask, lambda r: column(r["stop"] - 1)))
    return F.when(F.size(mask) > 0, F.array(*[c.cast("long") for c in (left, top, right, bottom)]))


def frame_at(keys: Column, time: Column, fps: Column, duration: Column) -> Column:
    """The place, from 0, of the frame shown at a time (R13): the nearest on one axis, that of the keys or of the places.

    A rate turns seconds into key units and a duration into places; of equally near places the even one is taken.
    """
    numbers = F.transform(keys, lambda k: k.try_cast("double"))
    named, timed, spread = F.forall(numbers, lambda n: n.isNotNull()), F.coalesce(fps > 0, F.lit(False)), F.coalesce(duration > 0, F.lit(False))
    by_key = named & (timed | ~spread)
    target = F.when(timed, time * fps).when(spread, time / duration * (F.size(keys) - 1)).when(named, time).otherwise(0.0)
    gaps = F.transform(numbers, lambda n, i: F.struct(F.abs(F.when(by_key, n).otherwise(i) - target), F.when(by_key, i).otherwise(i % 2), i.alias("at")))
    return F.array_min(gaps)["at"]
