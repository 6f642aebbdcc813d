"""Run-length masks in column-major order, handled as runs and never as bitmaps."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Mapping, Sequence
from itertools import accumulate


def unpack_counts(packed: str) -> list[int]:
    """Run lengths from their packed text: five bits a character, a continuation bit, deltas to the run two before."""
    runs, bits, shift = [], 0, 0
    for c in packed:
        piece = ord(c) - 48
        bits |= (piece & 31) << shift
        shift += 5
        if piece & 32:
            continue
        if piece & 16:
            bits -= 1 << shift
        runs.append(bits + runs[-2] if len(runs) > 2 else bits)
        bits, shift = 0, 0
    if shift:
        raise ValueError("packed runs end inside a number")
    return runs


def pack_counts(runs: Sequence[int]) -> str:
    """The inverse of unpack_counts."""
    out = []
    for i, run in enumerate(runs):
        x = run - runs[i - 2] if i > 2 else run
        while True:
            piece, x = x & 31, x >> 5
            more = not (x == 0 and not piece & 16 or x == -1 and piece & 16)
            out.append(chr((piece | (32 if more else 0)) + 48))
            if not more:
                break
    return "".join(out)


class Mask:
    """A mask of height x width whose foreground is a list of column-major ranges."""

    def __init__(self, height: int, width: int, runs: Sequence[int]):
        self.height, self.width = height, width
        ends = list(accumulate(runs))
        size = height * width
        self.starts, self.stops = [], []
        for i in range(1, len(runs), 2):
            lo, hi = min(size, ends[i - 1]), min(size, ends[i])
            if hi > lo:
                self.starts.append(lo)
                self.stops.append(hi)

    @classmethod
    def from_rle(cls, value) -> Mask | None:
        """A mask from {size, counts}; None where they are malformed."""
        if not isinstance(value, Mapping) or not isinstance(value.get("size"), Sequence) or len(value["size"]) != 2:
            return None
        try:
            height, width = (int(v) for v in value["size"])
            counts = value.get("counts")
            if isinstance(counts, bytes):
                counts = counts.decode("ascii")
            runs = unpack_counts(counts) if isinstance(counts, str) else [int(c) for c in counts]
        except (TypeError, ValueError):
            return None
        if height <= 0 or width <= 0 or any(r < 0 for r in runs):
            return None
        return cls(height, width, runs)

    def __bool__(self) -> bool:
        return bool(self.starts)

    def bounds(self) -> tuple[int, int, int, int] | None:
        """Least and largest column and row of the foreground, both inclusive: x0, y0, x1, y1."""
        if not self.starts:
            return None
        h = self.height
        tops, bottoms = [], []
        for lo, hi in zip(self.starts, self.stops, strict=True):
            whole = lo // h != (hi - 1) // h  # a run over a column's edge touches its first and last row
            tops.append(0 if whole else lo % h)
            bottoms.append(h - 1 if whole else (hi - 1) % h)
        return self.starts[0] // h, min(tops), (self.stops[-1] - 1) // h, max(bottoms)

    def any_in(self, x0: int, y0: int, x1: int, y1: int) -> bool:
        """Whether a rectangle (ends exclusive, clipped) holds foreground."""
        x0, y0, x1, y1 = max(0, x0), max(0, y0), min(self.width, x1), min(self.height, y1)
        for x in range(x0, x1):
            lo, hi = x * self.height + y0, x * self.height + y1
            i = bisect_right(self.starts, hi - 1)
            if i and self.stops[i - 1] > lo:
                return True
        return False

    def near(self, x: int, y: int, radius: int) -> bool:
        """Whether (x, y) lies on the mask, or within radius of it; points off the image never do."""
        if not (0 <= x < self.width and 0 <= y < self.height):
            return False
        r = max(0, radius)
        return self.any_in(x - r, y - r, x + r + 1, y + r + 1)


def repair_rle(value, height: int, width: int) -> dict:
    """A usable {size, counts}: runs that are missing or broken become an empty mask (X13). Polygons need a rasteriser
    and are left to the caller."""
    mask = Mask.from_rle(value)
    if mask is not None:
        return dict(value)
    return {"size": [height, width], "counts": [height * width]}
