"""Removal of repeated byte strings by an external sort of sampled suffixes.

This is induced sorting over a sample, not a suffix array. It departs from it in three ways, which the README gives
figures for: only suffixes at content-chosen places are sorted, 64-bit hash names stand for lexicographic ranks, and
two levels stand for recursion and carried common prefixes. The result is that of the whole array: every window of
``length`` bytes names one suffix inside it, the one at its least gram hash. Windows of equal bytes name suffixes at
the same place, so the order of the named suffixes settles which windows are equal.

1. A suffix tuple carries the name of its first GRAM bytes, the name of the common stretch that its windows span,
   and its place. Tuples are sorted in external runs that a disk-backed priority queue merges. Tuples of equal
   names but the first repeat all windows that they stand for.
2. Where one gram name goes with several stretch names, the common prefix ends inside the stretch. The first tuple
   of each stretch is opened: its bytes are fetched, and each of its windows becomes a tuple of the next level,
   sorted in the same way by the name of all its bytes.

The runs live in the worker's temporary folder only while a task sorts them, so a lost executor costs a retry.
"""

from __future__ import annotations

import hashlib
import heapq
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.llm.near_duplicates import _grow, mix
from spindrift.llm.sharding import positioned
from spindrift.session import durable, shuffle_width

_U = np.uint64
GRAM = 32
#: Bytes of tuples that a task holds before it writes a sorted run, and rows that are read back at a time.
RUN_BYTES, BLOCK_ROWS = 96_000_000, 65_536
#: Bytes of a text that are scanned at a time; positions must fit the low 21 bits of a sort key.
SCAN = 1 << 20
#: From so many stretches under one gram name, each window offset is sorted apart, so that tasks can share them.
HOT = 20_000

SUFFIX = np.dtype([("name", "<u8"), ("stretch", "<u8"), ("ord", "<i8"), ("at", "<i4"), ("lo", "u1"), ("hi", "u1")])
OPENED = np.dtype([("name", "<u8"), ("ord", "<i8"), ("lo", "<i4"), ("n", "<i4")])
WINDOW = np.dtype([("name", "<u8"), ("all", "<u8"), ("ord", "<i8"), ("p", "<i4")])
SPAN = np.dtype([("ord", "<i8"), ("lo", "<i4"), ("hi", "<i4")])


class ExternalSorter:
    """Sorts structured records by all their fields: sorted runs on disk, merged by a priority queue of blocks."""

    def __init__(self, fields: list[str], limit: int = RUN_BYTES, block: int = BLOCK_ROWS):
        self.fields, self.limit, self.block = fields, limit, block
        self.held: list[np.ndarray] = []
        self.size, self.runs = 0, []
        self.folder: tempfile.TemporaryDirectory | None = None

    def _sorted(self, parts: list[np.ndarray]) -> np.ndarray:
        x = np.concatenate(parts)
        return x[np.lexsort([x[f] for f in reversed(self.fields)])]

    def add(self, x: np.ndarray) -> None:
        if len(x):
            self.held.append(x)
            self.size += x.nbytes
            if self.size > self.limit:
                self.folder = self.folder or tempfile.TemporaryDirectory(prefix="runs-")
                self.runs.append(f"{self.folder.name}/{len(self.runs)}.npy")
                np.save(self.runs[-1], self._sorted(self.held))
                self.held, self.size = [], 0

    def merged(self) -> Iterator[np.ndarray]:
        """All records in order, in blocks; the runs are deleted at the end."""
        last = self._sorted(self.held) if self.held else None
        self.held, self.size = [], 0
        if not self.runs:
            if last is not None:
                yield last
            return
        try:
            readers = [np.load(r, mmap_mode="r") for r in self.runs] + ([last] if last is not None else [])
            at = [0] * len(readers)
            heads = [r[: self.block].copy() for r in readers]
            queue = [(tuple(h[-1][self.fields].tolist()), i) for i, h in enumerate(heads)]
            heapq.heapify(queue)  # least last record first: up to it, no run has anything unseen
            while queue:
                bound, least = queue[0]
                out = []
                for i, h in enumerate(heads):
                    if len(h):
                        keys = h[self.fields]
                        n = len(h) if i == least else self._rank(keys, bound)
                        out.append(h[:n])
                        heads[i] = h[n:]
                yield self._sorted(out)
                heapq.heappop(queue)
                at[least] += self.block
                heads[least] = readers[least][at[least] : at[least] + self.block].copy()
                if len(heads[least]):
                    heapq.heappush(queue, (tuple(heads[least][-1][self.fields].tolist()), least))
        finally:
            readers = []
            self.folder.cleanup()

    @staticmethod
    def _rank(keys: np.ndarray, bound: tuple) -> int:
        """How many of the sorted keys are at most bound."""
        lo, hi = 0, len(keys)
        while lo < hi:
            mid = (lo + hi) // 2
            if tuple(keys[mid].tolist()) <= bound:
                lo = mid + 1
            else:
                hi = mid
        return lo


def sampled_suffixes(raw: np.ndarray, order: int, length: int) -> np.ndarray:
    """The suffix tuples that the windows of one text name."""
    out = [_scan(raw[i : i + SCAN + length - 1], i, order, length) for i in range(0, max(1, len(raw) - length + 1), SCAN)]
    return np.concatenate(out)


def _scan(raw: np.ndarray, offset: int, order: int, length: int) -> np.ndarray:
    n, width = len(raw), length - GRAM + 1
    if n < length:
        return np.empty(0, dtype=SUFFIX)
    power, inverse = _grow(n + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, dtype=_U)
        np.cumsum((raw.astype(_U) + _U(1)) * power[:n], out=total[1:])
        grams = mix((total[GRAM:] - total[:-GRAM]) * inverse[: n - GRAM + 1])
        least = (grams & ~_U((1 << 21) - 1)) | np.arange(len(grams), dtype=_U)
        span = 1
        while 2 * span <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if width > span:
            least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
        at = (least & _U((1 << 21) - 1)).astype(np.int64)
        cut = np.flatnonzero(np.diff(at)) + 1
        lo, hi = np.concatenate(([0], cut)), np.concatenate((cut - 1, [len(at) - 1]))
        at = at[lo]
        stretch = mix((total[hi + length] - total[lo]) * inverse[lo] + ((at - lo) * 256 + (at - hi)).astype(_U))
    out = np.empty(len(at), dtype=SUFFIX)
    out["name"], out["stretch"], out["ord"], out["at"] = grams[at], stretch, order, at + offset
    out["lo"], out["hi"] = at - lo, at - hi
    return out


def _dealt(x: np.ndarray, parts: np.ndarray, count: int) -> Iterator[tuple[int, bytes]]:
    order = np.argsort(parts, kind="stable")
    cuts = np.searchsorted(parts[order], np.arange(count + 1))
    for p in range(count):
        if cuts[p + 1] > cuts[p]:
            yield p, x[order[cuts[p] : cuts[p + 1]]].tobytes()


def _part_of(keys: np.ndarray, count: int) -> np.ndarray:
    return ((mix(keys.astype(_U)) >> _U(33)) % _U(count)).astype(np.int64)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["kind", "part", "blob"])


BLOBS = "kind int, part int, blob binary"


def _repeats(x: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted suffix tuples: which are the first of their stretch, and the spans of the others."""
    new = np.concatenate(([True], (x["name"][1:] != x["name"][:-1]) | (x["stretch"][1:] != x["stretch"][:-1])))
    old = x[~new]
    spans = np.empty(len(old), dtype=SPAN)
    spans["ord"], spans["lo"] = old["ord"], old["at"] - old["lo"]
    spans["hi"] = old["at"] - old["hi"] + length
    return new, spans


def _level_one(texts: DataFrame, parts: int, length: int) -> DataFrame:
    """Kind 0: suffix tuples by name. Kind 1: spans that repeat a stretch of the same run of texts.

    A run sends one tuple for each stretch at most, so copies of a text are combined before the shuffle.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0

        def flush() -> pd.DataFrame:
            x = np.concatenate(held)
            x = x[np.lexsort((x["at"], x["ord"], x["stretch"], x["name"]))]
            new, spans = _repeats(x, length)
            first = x[new]
            rows = [(0, *r) for r in _dealt(first, _part_of(first["name"], parts), parts)]
            return _frame(rows + [(1, *r) for r in _dealt(spans, _part_of(spans["ord"], parts), parts)])

        for pdf in batches:
            for order, text in zip(pdf["ord"], pdf["text"], strict=True):
                if isinstance(text, str):
                    x = sampled_suffixes(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), order, length)
                    held.append(x)
                    size += len(x)
                if size > 250_000:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    return texts.mapInPandas(run, BLOBS)


def _to_open(y: np.ndarray, crowded: np.ndarray) -> np.ndarray:
    """Records that ask for the windows of these stretches; those of a crowded name ask for each window by itself."""
    out = []
    for x, apart in ((y[~crowded], False), (y[crowded], True)):
        n = x["lo"].astype(np.int32) - x["hi"] + 1
        lo, name = x["at"] - x["lo"], x["name"]
        if apart:  # one record for each window; its offset from the suffix goes into the name
            i = np.repeat(np.arange(len(x)), n)
            step = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
            with np.errstate(over="ignore"):
                name = mix(x["name"][i] + (x["lo"][i] - step + 1).astype(_U) * _U(0x9E3779B97F4A7C15))
            x, lo, n = x[i], lo[i] + step, np.ones(len(i), dtype=np.int32)
        z = np.empty(len(x), dtype=OPENED)
        z["name"], z["ord"], z["lo"], z["n"] = name, x["ord"], lo, n
        out.append(z)
    return np.concatenate(out)


def settled(blocks: Iterator[np.ndarray], length: int, hot: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """From sorted suffix tuples: spans that repeat an earlier stretch, and stretches to be opened.

    Beside a block, at most ``hot`` tuples are held: the first ones of the stretches of one name. A name with more is
    crowded.
    """
    held, before, crowd = np.empty(0, dtype=SUFFIX), None, None
    for x in blocks:
        new, spans = _repeats(x, length)
        if before == (x["name"][0], x["stretch"][0]):
            new[0], lead = False, np.empty(1, dtype=SPAN)
            lead["ord"], lead["lo"], lead["hi"] = x["ord"][:1], x["at"][:1] - x["lo"][:1], x["at"][:1] - x["hi"][:1] + length
            spans = np.concatenate((lead, spans))
        before = (x["name"][-1], x["stretch"][-1])
        first = np.concatenate((held, x[new]))
        cut = int(np.searchsorted(first["name"], x["name"][-1]))
        done, held = first[:cut], first[cut:]
        opened = [_settle_names(done, crowd, hot)]
        if len(held) and (held["name"][0] == crowd or len(held) > hot):
            crowd = held["name"][0]
            opened.append(_to_open(held, np.ones(len(held), dtype=bool)))
            held = held[:0]
        yield spans, np.concatenate(opened)
    yield np.empty(0, dtype=SPAN), _settle_names(held, crowd, hot)


def _settle_names(first: np.ndarray, crowd, hot: int) -> np.ndarray:
    """What to open of whole names, given the first tuple of each stretch; crowd is a name of which more came before."""
    if not len(first):
        return np.empty(0, dtype=OPENED)
    group = np.cumsum(np.concatenate(([True], first["name"][1:] != first["name"][:-1]))) - 1
    several = np.bincount(group)[group]
    crowded = several > hot
    if crowd is not None:
        crowded |= first["name"] == crowd
    wanted = (several > 1) | crowded
    return _to_open(first[wanted], crowded[wanted])


def _settle_suffixes(blobs: DataFrame, parts: int, length: int, hot: int) -> DataFrame:
    """Kind 1: spans that repeat an earlier stretch. Kind 2: stretches to be opened."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sorter = ExternalSorter(["name", "stretch", "ord", "at"])
        for pdf in batches:
            known = pdf["kind"] == 1
            if known.any():
                yield pdf[known]
            for blob in pdf["blob"][~known]:
                sorter.add(np.frombuffer(blob, dtype=SUFFIX))
        for found in settled(sorter.merged(), length, hot):
            for kind, y in enumerate(found, 1):
                yield _frame([(kind, *r) for r in _dealt(y, _part_of(y["ord"], parts), parts)])

    return blobs.repartition(parts, "part").mapInPandas(run, BLOBS)


def _beside_texts(texts: DataFrame, blobs: DataFrame, parts: int) -> DataFrame:
    """Texts and the records about them in the same partition, records first."""
    home = texts.withColumn("part", _spark_part(parts)).select("part", F.lit(9).alias("kind"), "ord", "text", F.lit(None).cast("binary").alias("blob"))
    told = blobs.select("part", "kind", F.lit(None).cast("long").alias("ord"), F.lit(None).cast("string").alias("text"), "blob")
    return home.unionByName(told).repartition(parts, "part").sortWithinPartitions("part", "kind")


def _spark_part(parts: int) -> Column:
    """The same part as _part_of gives for the order number, computed in pandas beside the scan."""

    @F.pandas_udf("int")
    def part(order: pd.Series) -> pd.Series:
        return pd.Series(_part_of(order.to_numpy(dtype=np.int64), parts).astype(np.int32))

    return part(F.col("ord"))


def _with_records(batches: Iterator[pd.DataFrame], dtype: np.dtype) -> Iterator[tuple]:
    """Each text's row with its records; the records of a part are held sorted by order number."""
    held: list[np.ndarray] = []
    records, now = np.empty(0, dtype=dtype), None
    for pdf in batches:
        for part, kind, order, text, blob in zip(pdf["part"], pdf["kind"], pdf["ord"], pdf["text"], pdf["blob"], strict=True):
            if part != now:
                held, records, now = [], np.empty(0, dtype=dtype), part
            if kind != 9:
                held.append(np.frombuffer(blob, dtype=dtype))
                continue
            if held:
                x = np.concatenate(held)
                records, held = x[np.lexsort((x["lo"], x["ord"]))], []
            order = int(order)
            lo, hi = np.searchsorted(records["ord"], [order, order + 1])
            yield order, text if isinstance(text, str) else None, records[lo:hi]


def _open(texts: DataFrame, blobs: DataFrame, parts: int, length: int) -> DataFrame:
    """Fetch the bytes of the opened stretches and deal them by gram name: records, then bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        heads, bodies, size = [], [], 0

        def flush() -> pd.DataFrame:
            x, part = np.concatenate(heads), None
            part = _part_of(x["name"], parts)
            out = []
            for p in np.unique(part).tolist():
                own = np.flatnonzero(part == p)
                out.append((len(own), p, x[own].tobytes() + b"".join(bodies[i] for i in own.tolist())))
            return _frame(out)

        for _, text, records in _with_records(batches, OPENED):
            if len(records):
                raw = text.encode("utf-8", "surrogatepass")
                heads.append(records)
                bodies += [raw[lo : lo + n + length - 1] for lo, n in zip(records["lo"].tolist(), records["n"].tolist(), strict=True)]
                size += sum(map(len, bodies[-len(records) :]))
                if size > 8_000_000:
                    yield flush()
                    heads, bodies, size = [], [], 0
        if heads:
            yield flush()

    return _beside_texts(texts, blobs.where("kind = 2"), parts).mapInPandas(run, BLOBS)


def _windows(blob: bytes, count: int, length: int) -> Iterator[np.ndarray]:
    """The windows of the opened stretches of one blob, some at a time, named by all their bytes."""
    x = np.frombuffer(blob, dtype=OPENED, count=count)
    raw = np.frombuffer(blob, dtype=np.uint8, offset=count * OPENED.itemsize)
    sizes = x["n"].astype(np.int64) + length - 1
    ends = np.cumsum(sizes)
    i = 0
    while i < len(x):
        base = int(ends[i] - sizes[i])
        j = max(i + 1, int(np.searchsorted(ends, base + 500_000, side="right")))
        part, y = raw[base : int(ends[j - 1])], x[i:j]
        power, inverse = _grow(len(part) + 1)
        which = np.repeat(np.arange(len(y)), y["n"])
        step = np.arange(len(which)) - np.repeat(np.cumsum(y["n"]) - y["n"], y["n"])
        at = (ends[i:j] - sizes[i:j] - base)[which] + step
        with np.errstate(over="ignore"):
            total = np.zeros(len(part) + 1, dtype=_U)
            np.cumsum((part.astype(_U) + _U(1)) * power[: len(part)], out=total[1:])
            names = mix((total[at + length] - total[at]) * inverse[at])
        out = np.empty(len(which), dtype=WINDOW)
        out["name"], out["all"], out["ord"], out["p"] = y["name"][which], names, y["ord"][which], y["lo"][which] + step
        yield out
        i = j


def _settle_windows(opened: DataFrame, parts: int, length: int) -> DataFrame:
    """Kind 1 spans: windows that are not the first of their name."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sorter, back = ExternalSorter(["name", "all", "ord", "p"]), ExternalSorter(["ord", "p"])
        for pdf in batches:
            for count, blob in zip(pdf["kind"].tolist(), pdf["blob"], strict=True):
                for x in _windows(blob, count, length):
                    sorter.add(x)
        before = None
        for x in sorter.merged():
            same = np.concatenate(([before == tuple(x[["name", "all"]][0].tolist())], (x["name"][1:] == x["name"][:-1]) & (x["all"][1:] == x["all"][:-1])))
            before = tuple(x[["name", "all"]][-1].tolist())
            back.add(x[same])
        for x in back.merged():
            new = np.concatenate(([True], (x["ord"][1:] != x["ord"][:-1]) | (x["p"][1:] > x["p"][:-1] + 1)))
            first = np.flatnonzero(new)
            last = np.concatenate((first[1:] - 1, [len(x) - 1]))
            spans = np.empty(len(first), dtype=SPAN)
            spans["ord"], spans["lo"], spans["hi"] = x["ord"][first], x["p"][first], x["p"][last] + length
            yield _frame([(1, *r) for r in _dealt(spans, _part_of(spans["ord"], parts), parts)])

    return opened.repartition(parts, "part").mapInPandas(run, BLOBS)


def merge_spans(x: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes from spans sorted by their start."""
    if not len(x):
        return []
    reach = np.maximum.accumulate(x["hi"])
    new = np.concatenate(([True], x["lo"][1:] > reach[:-1]))
    first = np.flatnonzero(new)
    return list(zip(x["lo"][first].tolist(), reach[np.concatenate((first[1:] - 1, [len(x) - 1]))].tolist(), strict=True))


def ordered_texts(documents: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame | None]:
    """(ord, text), and the keys by ord where they differ from it: ids repeat or are null."""
    kind = dict(documents.dtypes)[key]
    if kind in ("bigint", "int", "smallint", "tinyint"):
        odd = documents.groupBy(key).agg(F.count("*").alias("n")).where(F.col(key).isNull() | (F.col("n") > 1))
        if odd.isEmpty():
            return documents.select(F.col(key).cast("long").alias("ord"), F.col(text).alias("text")), None
    placed = durable(documents.select(F.col(key).alias("key"), F.col(text).alias("text")).withColumn("at", F.monotonically_increasing_id()))
    index = positioned(placed.select("key", "at"), "key", F.lit(1)).select("at", F.col("_index").alias("ord"))
    full = durable(placed.join(index, "at").select("ord", "key", "text"))
    return full.select("ord", "text"), full.select("ord", F.col("key").alias(key))


def repeated_spans(texts: DataFrame, length: int = 100, hot: int = HOT) -> DataFrame:
    """Spans of (ord, text) covered by a string of ``length`` bytes that also starts earlier, as dealt records."""
    parts = shuffle_width(texts.sparkSession)
    first = durable(_settle_suffixes(_level_one(texts, parts, length), parts, length, hot))
    later = _settle_windows(_open(texts, first, parts, length), parts, length)
    return first.where("kind = 1").union(later)


def remove_repeats(documents: DataFrame, length: int = 100, key: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """One row a document: key, n_bytes, n_removed, n_spans, kept_sha256 (and the kept text if asked for).

    A byte is removed if a string of ``length`` bytes that covers it also starts earlier: in a row of smaller id,
    or in the same text. Strings are judged on the input. Null texts are empty; texts shorter than ``length`` stay
    whole; longer ones are read whole, SCAN bytes at a time. Rows of equal or null ids follow their place in the input
    (nulls first) and repeat each other; an empty table gives no rows. Bytes of a character that is cut at a span's
    edge are left out of the kept text, not of its hash. Columns other than key and text are neither used nor
    returned, so their names cannot clash.
    """
    parts = shuffle_width(documents.sparkSession)
    texts, keys = ordered_texts(documents, key, text)
    spans = repeated_spans(texts, length)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = []
        for order, content, records in _with_records(batches, SPAN):
            raw = (content or "").encode("utf-8", "surrogatepass")
            runs = merge_spans(records)
            kept, at = [], 0
            for lo, hi in runs:
                kept.append(raw[at:lo])
                at = hi
            left = b"".join(kept) + raw[at:]
            row = (order, len(raw), len(raw) - len(left), len(runs), hashlib.sha256(left).hexdigest())
            rows.append((*row, left.decode("utf-8", "ignore")) if with_text else row)
            if len(rows) >= 2000:
                yield pd.DataFrame(rows, columns=names)
                rows = []
        yield pd.DataFrame(rows, columns=names)

    names = ["ord", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept_text"] * with_text
    schema = "ord long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * with_text
    out = _beside_texts(texts, spans, parts).mapInPandas(run, schema)
    if keys is None:
        return out.select(F.col("ord").cast(dict(documents.dtypes)[key]).alias(key), *names[1:])
    return keys.join(out, "ord").select(key, *names[1:])
