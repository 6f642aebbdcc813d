"""Maximal runs of repeated word sequences in texts, found on suffix trees.

Method (Stoye and Gusfield): the suffixes of a text are sorted by prefix doubling; the intervals of their common prefixes
are the inner nodes of its suffix tree. For each node of depth d, the leaves of all its children but the largest are
looked at: where the leaf d words before or after hangs below the node as well, but under another child, a square of
twice d words ends without going on. Each leaf is in the smaller half at most log n times. A square is rotated to the
left as long as the words agree; squares that reach the same ends are one run, whose period is the least of theirs.

A run of at least ``copies`` periods and ``least`` words repeats a stretch of ``least * (copies - 1) / copies`` words, so
texts in which no stretch of that length occurs twice need no tree: prefix doubling stops for them after four rounds.
Texts are independent and whole; several short ones share the arrays of a round. No shuffle is needed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of texts that share a round, and leaves that are looked at together.
ROUND, LEAVES = 400_000, 2_000_000

Run = tuple[int, int, int]
RUN = "struct<start:bigint,length:bigint,period:bigint>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def sorted_suffixes(words: np.ndarray, texts: np.ndarray, longest: int | None = None) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Suffixes in order, text by text: their order, the ranks of all prefixes of 1, 2, 4... words, what is still tied.

    Each text ends with a word that it does not have elsewhere. Only tied suffixes are sorted again.
    """
    order = np.argsort(words, kind="stable")
    order = order[np.argsort(texts[order], kind="stable")]
    key, text = words[order], texts[order]
    slots, rank, width = np.arange(len(words), dtype=np.int32), np.empty(len(words), dtype=np.int32), 1
    fresh = np.concatenate(([True], (key[1:] != key[:-1]) | (text[1:] != text[:-1])))
    at, ranks = order, []
    while True:
        heads = np.flatnonzero(fresh)
        sizes = np.diff(np.append(heads, len(slots)))
        rank[at] = np.repeat(slots[heads], sizes)
        ranks.append(rank)
        slots = slots[np.repeat(sizes > 1, sizes)]
        if not len(slots) or (longest and width >= longest):
            return order, ranks, slots
        at = order[slots]
        key = (rank[at].astype(np.int64) << 32) | rank[at + width]
        again = np.argsort(key, kind="stable")
        key, at = key[again], at[again]
        order[slots] = at
        fresh = np.concatenate(([True], key[1:] != key[:-1]))
        rank, width = rank.copy(), 2 * width


def common_prefixes(order: np.ndarray, ranks: list[np.ndarray]) -> np.ndarray:
    """Words that each suffix shares with the next."""
    i, j = order[:-1].copy(), order[1:].copy()
    out = np.zeros(len(i), dtype=np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        step = (ranks[k][i] == ranks[k][j]).astype(np.int64) << k
        i, j, out = i + step, j + step, out + step
    return out


def _beyond(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The first place after each one where a smaller value stands (the length, if none)."""
    mins = [values]
    while 2 << len(mins) <= 2 * len(values):
        half = 1 << (len(mins) - 1)
        mins.append(np.minimum(mins[-1][:-half], mins[-1][half:]))
    own, pos = values[at], at + 1
    for k in range(len(mins) - 1, -1, -1):
        inside = pos < len(mins[k])
        pos = pos + ((inside & (mins[k][np.where(inside, pos, 0)] >= own)).astype(np.int64) << k)
    return pos


def tree_nodes(common: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Inner nodes of the suffix tree below the root, and all their children but the largest.

    Depth, first and last slot (exclusive) of each node; node, first slot and last slot of each child.
    """
    cuts = np.flatnonzero(common > 0)
    lo, hi = len(common) - _beyond(common[::-1], len(common) - 1 - cuts), _beyond(common, cuts) + 1
    by = np.lexsort((cuts, hi, lo))
    cuts, lo, hi = cuts[by], lo[by], hi[by]
    fresh = np.ones(len(cuts), dtype=bool)
    fresh[1:] = (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
    heads = np.flatnonzero(fresh)
    node = np.cumsum(fresh) - 1
    first = np.insert(cuts + 1, heads, lo[heads])  # a child more than cuts
    owner = np.insert(node, heads, np.arange(len(heads)))
    last = np.insert(cuts + 1, np.append(heads[1:], len(cuts)), hi[heads])
    starts = heads + np.arange(len(heads))
    size = last - first
    most = np.flatnonzero(size == np.repeat(np.maximum.reduceat(size, starts), np.diff(np.append(starts, len(size)))))
    small = np.ones(len(size), dtype=bool)
    small[most[np.unique(owner[most], return_index=True)[1]]] = False
    return common[cuts[heads]], lo[heads], hi[heads], owner[small], np.stack((first[small], last[small]))


def ended_squares(order: np.ndarray, ranks: list[np.ndarray], longest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and half length of each square that does not go on by a word; halves of at most ``longest`` of their place."""
    slot = np.empty(len(order), dtype=np.int64)
    slot[order] = np.arange(len(order))
    depth, lo, hi, owner, ends = tree_nodes(common_prefixes(order, ranks))
    fits = depth[owner] <= longest[order[ends[0]]]
    owner, first, size = owner[fits], ends[0][fits], (ends[1] - ends[0])[fits]
    total, word, out = np.cumsum(size), ranks[0], [np.empty((2, 0), dtype=np.int64)]
    i = 0
    while i < len(owner):
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + LEAVES, "right")))
        many = size[i:j]
        at = order[np.repeat(first[i:j] - np.cumsum(many) + many, many) + np.arange(many.sum())].astype(np.int64)
        node = np.repeat(owner[i:j], many)
        for begin in (at, at - depth[node]):  # the leaf is the left or the right half's
            d = depth[node]
            other = begin + d if begin is at else begin
            known = (other >= 0) & (other < len(order))
            under = slot[np.where(known, other, 0)]
            known &= (under >= lo[node]) & (under < hi[node])
            a, d = begin[known], d[known]
            out.append(np.stack((a, d))[:, word[a + d] != word[a + 2 * d]])
        i = j
    found = np.concatenate(out, axis=1)
    return found[0], found[1]


def runs_of(words: list[np.ndarray], least: int = 24, copies: int = 3) -> list[list[Run]]:
    """Maximal runs of at least ``copies`` periods and ``least`` words in each text: start, length and period, sorted.

    A text is an array of 64-bit names of its words; different words have different names but for chance.
    """
    out: list[list[Run]] = [[] for _ in words]
    often = 1 << max(1, least * (copies - 1) // copies).bit_length() - 1
    for narrow in (True, False):  # first find the texts that repeat a stretch at all
        live = [k for k, w in enumerate(words) if len(w) >= least] if narrow else live
        if not live:
            return out
        sizes = np.array([len(words[k]) + 1 for k in live])
        ends = np.cumsum(sizes)
        flat = np.zeros(ends[-1], dtype=np.int64)
        texts = np.repeat(np.arange(len(live), dtype=np.uint16 if len(live) < 1 << 16 else np.int64), sizes)
        for k, end, size in zip(live, ends, sizes, strict=True):
            flat[end - size : end - 1] = words[k]
            flat[end - 1] = np.iinfo(np.int64).min  # no name of a word, but for chance
        order, ranks, tied = sorted_suffixes(flat, texts, often if narrow else None)
        if narrow:
            live = [live[t] for t in np.unique(texts[order[tied]])]
    begin, half = ended_squares(order, ranks, np.repeat(sizes - 1, sizes) // copies)
    if not len(begin):
        return out
    text = texts[begin].astype(np.int64)
    floor, start = ends[text] - sizes[text], begin.copy()
    for k in range(len(ranks) - 1, -1, -1):  # rotate to the left
        back = start - (1 << k)
        free = back >= floor
        back = np.where(free, back, start)
        start = np.where(free & (ranks[k][back] == ranks[k][back + half]), back, start)
    length = begin + 2 * half - start
    keep = length >= np.maximum(least, copies * half)
    rows = np.stack((start, length, half))[:, keep]
    rows = rows[:, np.lexsort((rows[2], rows[1], rows[0]))]
    same = np.zeros(rows.shape[1], dtype=bool)
    same[1:] = (rows[0, 1:] == rows[0, :-1]) & (rows[1, 1:] == rows[1, :-1])
    for s, n, q in rows[:, ~same].T.tolist():
        t = int(texts[s])
        out[live[t]].append((s - int(ends[t] - sizes[t]), n, q))
    return [sorted(r, key=lambda x: (x[0], x[2])) for r in out]


def strongest(runs: list[Run]) -> Run | None:
    """The run of the most periods; ties go to the smaller start, then the smaller period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None


def collapsed(words: list[bytes], runs: list[Run]) -> bytes:
    """The words outside runs and those of each run's first period, joined by blanks."""
    keep = np.ones(len(words), dtype=bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return b" ".join(words if not runs else [words[i] for i in np.flatnonzero(keep)])


def periodic_runs(
    df: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    least: int = 24,
    copies: int = 3,
    rewrite: Callable[[object, list[bytes]], list[bytes]] | None = None,
) -> DataFrame:
    """For each row its ``key``, ``n_words``, ``runs``, the strongest run ``best`` and the ``collapsed`` text.

    Words are what blanks divide, compared byte by byte. ``rewrite`` may change the words (UTF-8) of a key's text before
    the search. Null and empty texts have no words and an empty collapsed text. Rows are independent: repeated rows and
    equal keys give a row each, an empty table an empty result. Other columns of df are left out.
    """

    def solve(keys: list, texts: list[list[bytes]]) -> dict:
        names = [np.fromiter(map(hash, w), dtype=np.int64, count=len(w)) for w in texts]
        found = runs_of(names, least, copies)
        as_rows = lambda r: None if r is None else dict(zip(("start", "length", "period"), r, strict=True))
        return {
            "key": keys,
            "n": [len(w) for w in texts],
            "runs": [[as_rows(r) for r in runs] for runs in found],
            "best": [as_rows(strongest(runs)) for runs in found],
            "collapsed": [collapsed(w, runs) for w, runs in zip(texts, found, strict=True)],
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size, first = [], 0, 0
            for i, value in enumerate(batch.column(1)):
                words = value.as_buffer().to_pybytes().split() if value.is_valid else []
                if rewrite:
                    words = rewrite(batch.column(0)[i].as_py(), words)
                held.append(words)
                size += len(words)
                if size >= ROUND or i + 1 == len(batch):
                    keys = batch.column(0).slice(first, i + 1 - first)
                    got = solve(keys, held)
                    types = {"key": keys.type, "n": pa.int64(), "runs": pa.list_(_RUN), "best": _RUN, "collapsed": pa.binary()}
                    yield pa.RecordBatch.from_arrays([pa.array(v, types[n]) if n != "key" else v for n, v in got.items()], list(got))
                    held, size, first = [], 0, i + 1

    kind = dict(df.dtypes)[key]
    slim = df.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text"))
    rows = slim.mapInArrow(run, f"key {kind}, n long, runs array<{RUN}>, best {RUN}, collapsed binary")
    return rows.select(F.col("key").alias(key), F.col("n").alias("n_words"), "runs", "best", F.col("collapsed").cast("string").alias("collapsed"))
