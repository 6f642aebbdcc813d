"""Boxes that an answer names (X8, X11): nested JSON, which column expressions cannot walk, read on Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping
from itertools import chain

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from spindrift.functions.geometry import box_iou
from spindrift.functions.replies import TAGGED, containers, number, unfenced

# Keys that may hold boxes, in the order in which they are read.
BOX_KEYS = ("bbox", "bbox_2d", "box", "boxes", "bboxes", "objects", "items", "regions", "detections", "predictions")
RANK = {key: rank for rank, key in enumerate(BOX_KEYS)}
# Keys of a lone box, in the order in which they are read.
OWN_RANK = {key: rank for rank, key in enumerate(("bbox_2d", "bbox", "box", "boxes"))}
# Keys that name what is in a box, in the order in which they are read.
LABEL_KEYS = ("label", "name", "category")
# How a coordinate is written, and boxes as two points or as a list.
COORDINATE = r"(-?\d+(?:\.\d+)?)"
POINTS = re.compile(r"\(C\s*,\s*C\)\s*,?\s*\(C\s*,\s*C\)".replace("C", COORDINATE))
LIST = re.compile(r"\[\s*C\s*,\s*C\s*,\s*C\s*,\s*C\s*\]".replace("C", COORDINATE))

Box = tuple[float, ...]


def _leaves(value, ranks: Mapping[str, int] = RANK, path: tuple = (), label: str | None = None) -> Iterator[tuple[tuple, Box, str | None]]:
    """Every list of four numbers that is reached through lists and known keys: the ranks of the way to it, box and label.

    A box has the label of the innermost object around it that names one.
    """
    if isinstance(value, (list, tuple)):
        if len(value) == 4 and None not in (xs := tuple(map(number, value))):
            yield path, xs, label
        else:
            yield from chain.from_iterable(_leaves(v, ranks, (*path, i), label) for i, v in enumerate(value))
    elif isinstance(value, Mapping):
        own = next((value[k] for k in LABEL_KEYS if value.get(k)), label)
        yield from chain.from_iterable(_leaves(value[k], ranks, (*path, ranks[k]), own) for k in ranks.keys() & value.keys())


def first_box(value) -> list[float] | None:
    """The box that stands first in a value."""
    _, box, _ = min(_leaves(value, OWN_RANK), default=(None, None, None), key=lambda leaf: leaf[0])
    return None if box is None else list(box)


def cornered(box: list[float] | None) -> list[float] | None:
    """A box from its least to its largest corner."""
    return box and [*map(min, box[:2], box[2:]), *map(max, box[:2], box[2:])]


def whole_frame(key) -> int | None:
    """The frame of a key that is a whole number."""
    x = number(key)
    return int(x) if x is not None and x == int(x) else None


def cut_frame(key) -> int | None:
    """The frame of a key that evaluators cut to a whole number (X11)."""
    try:
        return int(float(key))
    except (TypeError, ValueError, OverflowError):
        return None


def flat_box(value) -> list[float] | None:
    """Four values in a list that are numbers or say one (X11)."""
    try:
        xs = [float(v) for v in value] if isinstance(value, list) else []
    except (TypeError, ValueError):
        return None
    return xs if len(xs) == 4 else None


def frame_boxes(value, frame: Callable = whole_frame, box: Callable = first_box) -> dict[str, list[float]]:
    """Boxes by frame; entries whose key or box is none are left out."""
    pairs = ((frame(k), box(v)) for k, v in value.items()) if isinstance(value, Mapping) else ()
    return {str(k): b for k, b in pairs if k is not None and b is not None}


def _named(chunk: str) -> Iterator[tuple[Box, str | None]]:
    for value in containers(chunk):
        yield from ((box, label) for _, box, label in sorted(_leaves(value), key=lambda leaf: leaf[:2]))
    for pattern in (POINTS, LIST):
        yield from ((tuple(map(float, m.groups())), None) for m in pattern.finditer(chunk))


def labelled_boxes_in(text: str | None) -> list[tuple[list[float], str | None]]:
    """All boxes that an answer names, with their labels, in order, once each to six places; without any, its first four numbers."""
    text = text or ""
    parts = [m[1] for m in TAGGED.finditer(text)] or [text]
    found = list(chain.from_iterable(_named(unfenced(p)) for p in parts))
    if not found:
        loose = re.findall(COORDINATE, TAGGED.sub(r"\1", text))[:4]
        found = [(tuple(map(float, loose)), None)] if len(loose) == 4 else []
    once: dict[Box, tuple[list[float], str | None]] = {}
    for box, label in found:
        once.setdefault(tuple(round(x, 6) for x in box), (list(box), None if label is None else str(label)))
    return list(once.values())


def boxes_in(text: str | None) -> list[list[float]]:
    return [box for box, _ in labelled_boxes_in(text)]


def candidate_boxes(text: Column) -> Column:
    """Array of all boxes that an answer names (see labelled_boxes_in)."""
    return F.transform(candidates(text), lambda c: c["box"])


def candidates(text: Column) -> Column:
    """Array of the boxes that an answer names and their labels."""

    @F.pandas_udf("array<struct<box:array<double>,label:string>>")
    def read(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"box": box, "label": label} for box, label in labelled_boxes_in(t)])

    return read(text)


def pick_candidate(found: Column, truth: Column, best: bool = False) -> Column:
    """The first candidate, or the one that overlaps the true box most, of equal ones the first; null without any."""
    if not best:
        return F.get(found, F.lit(0))
    scored = F.transform(found, lambda c, i: F.struct(box_iou(c["box"], truth).alias("iou"), (-i).alias("early"), c.alias("own")))
    return F.array_max(scored)["own"]


def pick_box(boxes: Column, truth: Column, best: bool = False) -> Column:
    """The first box, or the one that overlaps the true box most, of equal ones the first; null without boxes."""
    if not best:
        return F.get(boxes, F.lit(0))
    scored = F.transform(boxes, lambda b, i: F.struct(box_iou(b, truth).alias("iou"), (-i).alias("early"), b.alias("box")))
    return F.array_max(scored)["box"]
