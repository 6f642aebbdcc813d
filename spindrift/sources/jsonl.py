"""JSON lines, written by many tasks and seen all at once (K1), and read at chosen places (S3).

Writing is a Spark data source: each task writes a part beside the target, and the commit, which has a message from every
task that succeeded, puts the parts in place by renaming. Parts of failed attempts are never named in a message and go
with the folder they lie in. Rows do not pass the driver.

Random access goes by an index of byte ranges, made in one pass over the splits; a fetch reads the ranges it is asked for.
Targets and files lie on a file system that the driver and all executors see; files are opened through Arrow, so those of
an object store can be read as well.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from spindrift.functions.text import canonical_json

# Writing


@dataclass
class Part(WriterCommitMessage):
    """What a task has written: its place among the tasks, its file, and how many rows."""

    place: int
    file: str
    rows: int


class JsonlWriter(DataSourceWriter):
    """Writes parts into a folder of its own beside the target."""

    def __init__(self, path: str, raw: bool, parts: bool, overwrite: bool):
        local = "/" + path[5:].lstrip("/") if path.startswith("file:") else path
        self.path, self.raw, self.parts = os.path.abspath(local), raw, parts
        if not overwrite and os.path.exists(self.path):
            raise FileExistsError(f"{self.path} is there already; overwrite it or choose another path")
        self.staging = f"{os.path.dirname(self.path)}/.partial-{uuid.uuid4().hex}"
        os.makedirs(self.staging)

    def write(self, iterator: Iterator) -> Part:
        task = TaskContext.get()
        file, rows = f"{self.staging}/{task.partitionId():08d}-{task.taskAttemptId()}", 0
        with open(file, "w", encoding="utf-8", newline="\n") as out:
            for row in iterator:
                out.write((row[0] if self.raw else canonical_json(row.asDict(recursive=True))) + "\n")
                rows += 1
        return Part(task.partitionId(), file, rows)

    def commit(self, messages: list) -> None:
        full = sorted((m for m in messages if m and m.rows), key=lambda m: m.place)
        ready = f"{self.staging}/ready"
        if self.parts:
            os.makedirs(ready)
            for number, m in enumerate(full):
                os.replace(m.file, f"{ready}/part-{number:05d}.jsonl")
        elif len(full) == 1:
            os.replace(full[0].file, ready)
        else:
            with open(ready, "wb") as out:
                for m in full:
                    with open(m.file, "rb") as part:
                        shutil.copyfileobj(part, out, 1 << 24)
        if os.path.isdir(self.path) or self.parts and os.path.exists(self.path):
            os.replace(self.path, f"{self.staging}/old")
        os.replace(ready, self.path)
        self._remove()

    def abort(self, messages: list) -> None:
        if os.path.isdir(self.staging):
            self._remove()

    def _remove(self) -> None:
        """Remove the parts. The folder gets another name first: a task that is still running then finds no place to write."""
        gone = f"{self.staging}-gone"
        os.rename(self.staging, gone)
        shutil.rmtree(gone)


class CanonicalJsonl(DataSource):
    """``df.write.format("canonical_jsonl")``: sorted keys, no blanks, one object a line.

    Options: ``parts`` for a folder of files instead of one file, ``raw`` for a column of texts that are JSON already.
    """

    @classmethod
    def name(cls) -> str:
        return "canonical_jsonl"

    def writer(self, schema, overwrite: bool) -> JsonlWriter:
        flag = lambda name: self.options.get(name, "false").lower() == "true"
        return JsonlWriter(self.options["path"], flag("raw"), flag("parts"), overwrite)


def write_jsonl(df: DataFrame, path: str, raw: bool = False, parts: bool = False) -> None:
    """Canonical JSON lines in df's order at a path that readers see old or whole: one file, or with ``parts`` a folder.

    Equal rows in an equal order give equal bytes, read part after part. One file is put together from the parts by the
    committing process, byte by byte; large tables are written in parts.
    """
    df.sparkSession.dataSource.register(CanonicalJsonl)
    df.write.format("canonical_jsonl").options(raw=raw, parts=parts).mode("overwrite").save(path)


# Random access


def line_index(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path, ordinal, offset and length in bytes of each line of JSON-lines files that is not blank (S3).

    Files are read in splits. A line's place is its place in the split plus the lines and bytes of the splits before it,
    of which there is one row each. A file without lines stops the query.
    """
    raw = spark.read.option("lineSep", "\n").text(path)
    lines = raw.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_n"),
        F.octet_length("value").cast("long").alias("_bytes"), F.col("value").rlike(r"\S").alias("_full"),
    )
    inside = Window.partitionBy("path", "_at").orderBy("_n").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda x: F.coalesce(F.sum(x).over(inside), F.lit(0))
    placed = lines.withColumns({"_line": before(F.col("_full").cast("long")), "_byte": before(F.col("_bytes") + 1)})
    ahead = Window.partitionBy("path").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    splits = lines.groupBy("path", "_at").agg(F.count_if("_full").alias("_lines"), F.sum(F.col("_bytes") + 1).alias("_sum"))
    starts = splits.select("path", "_at", *[F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(n) for c, n in (("_lines", "_line0"), ("_sum", "_byte0"))])
    out = placed.where("_full").join(starts, ["path", "_at"])
    index = out.select("path", (F.col("_line") + F.col("_line0")).alias("ordinal"), (F.col("_byte") + F.col("_byte0")).alias("offset"), F.col("_bytes").alias("length"))
    files = spark.read.format("binaryFile").load(path).select("path", F.lit(True).alias("_file"))
    named = files.select(F.regexp_replace("path", "^file:/+", "/").alias("_name"), "_file")
    seen = index.select(F.regexp_replace("path", "^file:/+", "/").alias("_name")).distinct()
    empty = named.join(seen, "_name", "left_anti").select(F.raise_error(F.concat(F.lit("a file has no records: "), "_name")).cast("string").alias("path"))
    return index.unionByName(empty.select("path", *[F.lit(None).cast("long").alias(c) for c in ("ordinal", "offset", "length")]))


def fetch_lines(index: DataFrame, wanted: DataFrame, gap: int = 1 << 16) -> DataFrame:
    """path, ordinal, record of the wanted lines (path, ordinal) of an index; an ordinal that is not there is left out.

    Wanted lines are sorted by file and place, so a task reads its files forwards; ranges less than ``gap`` bytes apart
    are read at once. A line that is wanted twice is returned once.
    """
    found = index.join(wanted.select("path", "ordinal").distinct(), ["path", "ordinal"], "left_semi")
    dealt = found.repartitionByRange("path", "offset").sortWithinPartitions("path", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, source = None, None
        for batch in batches:
            rows, texts, i = batch.to_pylist(), [], 0
            while i < len(rows):
                j, start, end = i, rows[i]["offset"], rows[i]["offset"] + rows[i]["length"]
                while j + 1 < len(rows) and rows[j + 1]["path"] == rows[i]["path"] and rows[j + 1]["offset"] - end <= gap and end - start < 1 << 26:
                    j += 1
                    end = rows[j]["offset"] + rows[j]["length"]
                if rows[i]["path"] != name:
                    if source:
                        source.close()
                    name = rows[i]["path"]
                    system, at = pafs.FileSystem.from_uri(name)
                    source = system.open_input_file(at)
                block = source.read_at(end - start, start)
                texts += [block[r["offset"] - start : r["offset"] - start + r["length"]].decode() for r in rows[i : j + 1]]
                i = j + 1
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("ordinal"), pa.array(texts, pa.string())], ["path", "ordinal", "record"])

    return dealt.mapInArrow(run, "path string, ordinal long, record string")
