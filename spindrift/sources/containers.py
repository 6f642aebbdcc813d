"""JSON files that are one large value, read by many tasks.

A file is cut into byte ranges. For each range one task counts what the ranges behind it need to know: whether it turns a
string on or off, and by how much it nests deeper, for either state it may begin in. Sums over the ranges before, of
which there is a row each, then give every range its state, so that ranges can be scanned for the commas and brackets
that part records. A record is read by the task that holds its beginning, however far it goes on; nothing else is held.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindrift.operators.dataset import ranked_within
from spindrift.session import durable

# Names under which a wrapper holds its records, and a container its items, in order.
WRAPPERS = ("records", "data", "samples", "results")
CONTAINERS = ("annotations", "items", "questions")

QUOTE, BACKSLASH = 0x22, 0x5C
_DEEPER = np.zeros(256, dtype=np.int8)
_DEEPER[[ord(c) for c in "[{"]], _DEEPER[[ord(c) for c in "]}"]] = 1, -1
_MARK = _DEEPER != 0
_MARK[[ord(c) for c in ',:"']] = True
#: Bytes before a range that are read at a time to find where a run of backslashes begins.
LOOK_BACK = 4096


class Bytes:
    """Ranges of one file."""

    def __init__(self, path: str):
        system, at = pafs.FileSystem.from_uri(path if ":" in path else f"file://{path}")
        self.file = system.open_input_file(at)

    def read(self, start: int, end: int) -> bytes:
        return self.file.read_at(max(0, end - start), start)

    def backslashes_before(self, at: int) -> int:
        """How many backslashes stand right before a place."""
        n = 0
        while at:
            piece = self.read(max(0, at - LOOK_BACK), at)
            kept = piece.rstrip(b"\\")
            n += len(piece) - len(kept)
            if kept:
                break
            at -= len(piece)
        return n


def marks(raw: np.ndarray, before: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of brackets, commas, colons and quotes that no backslash escapes, and the bytes there."""
    at = np.flatnonzero(_MARK[raw])
    byte = raw[at]
    slashes = np.flatnonzero(raw == BACKSLASH)
    quotes = np.flatnonzero(byte == QUOTE)
    if not len(quotes) or not len(slashes) and not before:
        return at, byte
    fresh = np.diff(slashes, prepend=-2) > 1
    begin = slashes[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]] if len(slashes) else slashes
    place = np.searchsorted(slashes, at[quotes] - 1)
    run = np.zeros(len(quotes), dtype=np.int64)
    near = place < len(slashes)
    near[near] = slashes[place[near]] == at[quotes[near]] - 1
    run[near] = at[quotes[near]] - begin[place[near]]
    run += np.where(at[quotes] == run, before, 0)  # the run goes back over the start
    keep = np.ones(len(at), dtype=bool)
    keep[quotes[run % 2 == 1]] = False
    return at[keep], byte[keep]


def _outside(byte: np.ndarray, inside: int) -> np.ndarray:
    """Which marks stand outside strings, quotes among them that open one."""
    quote = byte == QUOTE
    return (inside + np.cumsum(quote) - quote) % 2 == 0


def byte_ranges(spark: SparkSession, path: str | list[str], size: int) -> DataFrame:
    """path, n, start, end of the ranges of files; of contents nothing is read."""
    files = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("_size"))
    cut = files.select("path", "_size", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.expr(f"(_size - 1) div {size}"), F.lit(0)).cast("long"))).alias("n"))
    return cut.select("path", "n", (F.col("n") * size).alias("start"), F.least(F.col("_size"), (F.col("n") + 1) * size).alias("end"))


def _scanned(df: DataFrame, scan, schema: str) -> DataFrame:
    """Rows that ``scan`` (file, row) yields for every range, with the range's path and n."""
    names = [c.strip().split(" ")[0] for c in schema.split(",")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    types = [kinds[c.strip().split(" ")[1]] for c in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                for rows in scan(Bytes(row["path"]), row):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(([row["path"]] * len(rows[0]), [row["n"]] * len(rows[0]), *rows), types, strict=True)], names)

    return df.mapInArrow(run, schema)


def states(ranges: DataFrame) -> DataFrame:
    """ranges with ``inside`` (1 where a range begins in a string) and ``depth`` (open brackets where it begins)."""

    def scan(file: Bytes, row: dict):
        _, byte = marks(np.frombuffer(file.read(row["start"], row["end"]), dtype=np.uint8), file.backslashes_before(row["start"]))
        step = _DEEPER[byte].astype(np.int64)
        out = _outside(byte, 0)
        yield [int((byte == QUOTE).sum() % 2)], [int(step[out].sum())], [int(step[~out].sum())]

    seen = durable(_scanned(ranges, scan, "path string, n long, odd long, out long, within long"))
    ahead = Window.partitionBy("path").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    turned = seen.withColumn("inside", (F.coalesce(F.sum("odd").over(ahead), F.lit(0)) % 2).cast("int"))
    deeper = F.when(F.col("inside") == 0, F.col("out")).otherwise(F.col("within"))
    placed = turned.withColumn("depth", F.coalesce(F.sum(deeper).over(ahead), F.lit(0)))
    return ranges.join(placed.select("path", "n", "inside", "depth"), ["path", "n"])


ROOT, VALUE, CUT, END = range(4)


def _structure(placed: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Where the values at depth 0 begin (ROOT), and the values of these names in an outermost object (VALUE)."""
    wanted = {json.dumps(n).encode(): n for n in names}
    longest = max(map(len, wanted), default=0)

    def scan(file: Bytes, row: dict):
        raw = np.frombuffer(file.read(row["start"], row["end"]), dtype=np.uint8)
        at, byte = marks(raw, file.backslashes_before(row["start"]))
        out = _outside(byte, row["inside"])
        at, byte = at[out], byte[out]
        step = _DEEPER[byte].astype(np.int64)
        depth = row["depth"] + np.cumsum(step) - np.maximum(step, 0)  # of brackets, outside them
        found = [(ROOT, int(p) + row["start"], chr(b), "") for p, b in zip(at[(step > 0) & (depth == 0)], byte[(step > 0) & (depth == 0)], strict=True)]
        for p in at[(byte == ord(":")) & (depth == 1)].tolist() if names else ():
            behind = file.read(max(0, row["start"] + p - longest - 64), row["start"] + p).rstrip()
            name = next((n for text, n in wanted.items() if behind.endswith(text)), None)
            if name:
                place = row["start"] + p + 1
                while (piece := file.read(place, place + 64)) and not piece.strip():
                    place += len(piece)
                place += len(piece) - len(piece.lstrip())
                found.append((VALUE, place, piece.lstrip()[:1].decode("latin-1"), name))
        yield tuple(map(list, zip(*found, strict=True))) or ([], [], [], [])

    return _scanned(placed, scan, "path string, n long, what int, place long, byte string, name string")


def _parts(placed: DataFrame) -> DataFrame:
    """Commas (CUT) and the end (END) of the container that opens at ``open`` with ``level`` brackets around its items."""

    def scan(file: Bytes, row: dict):
        raw = np.frombuffer(file.read(row["start"], row["end"]), dtype=np.uint8)
        at, byte = marks(raw, file.backslashes_before(row["start"]))
        out = _outside(byte, row["inside"])
        at, byte = at[out] + row["start"], byte[out]
        step = _DEEPER[byte].astype(np.int64)
        depth = row["depth"] + np.cumsum(step)
        later = at > row["open"]
        comma, close = later & (byte == ord(",")) & (depth == row["level"]), later & (step < 0) & (depth == row["level"] - 1)
        places = at[comma | close]
        if row["start"] <= row["open"] < row["end"]:
            yield [CUT], [row["open"]]
        yield np.where(close[comma | close], END, CUT).tolist(), places.tolist()

    return _scanned(placed, scan, "path string, n long, what int, place long")


def _with_next(rows: DataFrame) -> DataFrame:
    """rows (path, n, place) with the ``next`` place in the same file: in its range, or the first of the ranges behind."""
    here = Window.partitionBy("path", "n").orderBy("place")
    behind = Window.partitionBy("path").orderBy(F.col("n").desc()).rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    heads = rows.groupBy("path", "n").agg(F.min("place").alias("_head")).select("path", "n", F.min("_head").over(behind).alias("_later"))
    return rows.withColumn("_next", F.lead("place").over(here)).join(heads, ["path", "n"]).select(*rows.columns, F.coalesce("_next", "_later").alias("next"))


def read_containers(spark: SparkSession, path: str | list[str], names: tuple[str, ...] = WRAPPERS, members: bool = False, size: int = 1 << 25) -> DataFrame:
    """path, ordinal, record (JSON text) of JSON files that hold their records in one value each.

    Records are the items of an outermost list, or of the list under the first of ``names`` in an outermost object; else
    the object itself. Several outermost values are a record each. With ``members`` (S8) an object, outermost or under
    a name, is a map of records in the order of its keys: each gets its key as ``id`` unless it has one, and what is no
    object is left out. Otherwise records must be objects. Empty files have no records.
    """
    placed = durable(states(byte_ranges(spark, path, size)))
    found = durable(_structure(placed, names))
    rank = F.coalesce(*[F.when(F.col("name") == n, i) for i, n in enumerate(names)], F.lit(len(names))) if names else F.lit(0)
    holds = (F.col("what") == VALUE) & F.col("byte").isin(*(["[", "{"] if members else ["["]))
    files = found.groupBy("path").agg(
        F.count_if(F.col("what") == ROOT).alias("roots"),
        F.min_by(F.struct("place", "byte"), F.when(F.col("what") == ROOT, F.col("place"))).alias("root"),
        F.min_by(F.struct("place", "byte"), F.when(holds, F.struct(rank, F.col("place")))).alias("held"),
    )  # a row a file
    inner = (F.col("root.byte") == "{") & F.col("held").isNotNull() & (F.col("roots") == 1)
    listed = (F.col("root.byte") == "[") | F.lit(members)
    plan = files.select(
        "path",
        F.when(inner, F.col("held.place")).otherwise(F.col("root.place")).alias("open"),
        F.when(inner, 2).otherwise(1).alias("level"),
        F.when(inner, F.col("held.byte")).otherwise(F.col("root.byte")).alias("kind"),
        (inner | (listed & (F.col("roots") == 1))).alias("inside_one"),
    )
    within = placed.join(plan.where("inside_one"), "path")
    cuts = durable(_parts(within))
    ends = cuts.where(F.col("what") == END).groupBy("path").agg(F.min("place").alias("end"))
    spans = _with_next(cuts).join(ends, "path").where((F.col("what") == CUT) & (F.col("place") < F.col("end")))
    spans = spans.select("path", (F.col("place") + 1).alias("from"), F.col("next").alias("to"))
    roots = _with_next(found.where(F.col("what") == ROOT)).select("path", F.col("place").alias("from"), F.col("next").alias("to"))
    whole = roots.join(plan.where("not inside_one").select("path"), "path")
    spans = spans.select("*", F.lit(True).alias("part")).unionByName(whole.select("*", F.lit(False).alias("part"))).join(plan.select("path", "kind"), "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out = batch.to_pylist(), []
            files = {p: Bytes(p) for p in {r["path"] for r in rows}}
            for r in rows:
                file = files[r["path"]]
                text = file.read(r["from"], r["to"] if r["to"] is not None else file.file.size()).strip()
                if not text:
                    continue  # an empty container
                mapped = members and r["kind"] == "{" and r["part"]
                if mapped:
                    (key, value), = json.loads(b"{" + text + b"}").items()
                    if not isinstance(value, dict):
                        continue
                    value = {"id": key, **value}
                else:
                    key, value = "", json.loads(text)
                    if not isinstance(value, dict):
                        raise ValueError(f"records must be JSON objects: {r['path']} at byte {r['from']}")
                out.append((r["path"], key, r["from"], json.dumps(value, ensure_ascii=False, sort_keys=True)))
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.string(), pa.string(), pa.int64(), pa.string()], strict=True)], ["path", "key", "from", "record"])

    read = spans.repartitionByRange("path", "from").mapInArrow(run, "path string, key string, from long, record string")
    return ranked_within(read, ["path"], ["key", "from"]).select("path", F.col("rank").alias("ordinal"), "record")
