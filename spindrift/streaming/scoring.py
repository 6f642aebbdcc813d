"""Streams of model answers: stateless scoring, and group advantages once a group is complete.

An extension: batch inputs are the rule. Scoring reuses the batch operators inside foreachBatch; advantages need
all rows of a group, which are kept as state until the oracle and its policy rows have arrived. Every row that comes in
goes out once: in a complete group, or with what kept it from one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

GROUP = "uid long, row_id long, reward double, is_oracle_row boolean"
#: Why a row is in no complete group.
SURPLUS, LATE, INCOMPLETE = "surplus", "late", "incomplete"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def score_stream(stream: DataFrame, score: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Score each micro-batch and append it as Parquet, one folder a batch; a repeated batch overwrites its own."""

    def write(batch: DataFrame, number: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class GroupKeeper(StatefulProcessor):
    """Holds the rows of a group until it is complete or its time is over, then a note that it is closed, for a while."""

    def __init__(self, policy_rows: int, timeout_ms: int, memory_ms: int):
        self.policy_rows, self.timeout_ms, self.memory_ms = policy_rows, timeout_ms, memory_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "row_id long, reward double, is_oracle_row boolean")
        self.closed = handle.getValueState("closed", "complete boolean", self.memory_ms)

    def _out(self, key: tuple, rows: list, error: str | None) -> Iterator[Row]:
        for r in rows:
            yield Row(uid=key[0], row_id=r[0], reward=r[1], is_oracle_row=r[2], error=error)

    def _close(self, complete: bool) -> None:
        self.rows.clear()
        self.closed.update((complete,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        fresh = [(r.row_id, r.reward, r.is_oracle_row) for r in rows]
        if self.closed.exists():
            yield from self._out(key, fresh, LATE)
            return
        held = [tuple(r) for r in self.rows.get()] if self.rows.exists() else []
        oracles = [r for r in held + fresh if r[2]]
        policy = sorted((r for r in held + fresh if not r[2]), key=lambda r: r[0])
        kept = oracles[:1] + policy[: self.policy_rows]
        yield from self._out(key, oracles[1:] + policy[self.policy_rows :], SURPLUS)
        if oracles and len(kept) > self.policy_rows:
            self._close(True)
            yield from self._out(key, kept, None)
        else:
            self.rows.put(kept)
            if not held:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.timeout_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        held = [tuple(r) for r in self.rows.get()] if self.rows.exists() else []
        self.rows.clear()  # the expired timer goes by itself
        self.closed.update((False,))
        yield from self._out(key, held, INCOMPLETE)

    def close(self) -> None:
        pass


def grouped_rows(stream: DataFrame, policy_rows: int, timeout_ms: int = 3_600_000, memory_ms: int = 86_400_000) -> DataFrame:
    """Every row of a stream of GROUP rows, with ``error``: null for those of complete groups.

    A group is complete with one oracle row and ``policy_rows`` others, of which those of the least ids are taken; the
    rest, and further oracle rows, are ``surplus``. Rows of a group that is still open ``timeout_ms`` after its first row
    come out as ``incomplete``. A closed group is remembered for ``memory_ms``: its rows are ``late``; after that time
    the group would begin anew. State is a group's open rows, at most policy_rows + 1, or one note.

    Timers make Spark start one empty batch after the other, so a query that is to end (``availableNow``) must be started
    with ``spark.sql.streaming.noDataMicroBatches.enabled`` off; timers then fire with the next data (see split_groups).
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    keeper = GroupKeeper(policy_rows, timeout_ms, memory_ms)
    return stream.groupBy("uid").transformWithState(keeper, f"{GROUP}, error string", "append", "processingTime")


def complete_groups(stream: DataFrame, policy_rows: int, timeout_ms: int = 3_600_000) -> DataFrame:
    """The rows of complete groups alone (see grouped_rows). Advantages are then computed on them in batch."""
    return grouped_rows(stream, policy_rows, timeout_ms).where("error IS NULL").drop("error")


def split_groups(stream: DataFrame, policy_rows: int, path: str, checkpoint: str, timeout_ms: int = 3_600_000, memory_ms: int = 86_400_000, **trigger) -> StreamingQuery:
    """Write the rows of complete groups to ``path``/groups and all others, with their error, to ``path``/errors.

    Both are Parquet, one folder a batch, which a repeated batch overwrites; a query that is started again goes on where
    its checkpoint ends.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        batch.where("error IS NULL").drop("error").write.mode("overwrite").parquet(f"{path}/groups/batch={number}")
        batch.where("error IS NOT NULL").write.mode("overwrite").parquet(f"{path}/errors/batch={number}")
        batch.unpersist()

    conf, flag = stream.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = conf.get(flag)
    conf.set(flag, str(bool(trigger)).lower())  # a query that runs on fires its timers without new data
    try:
        rows = grouped_rows(stream, policy_rows, timeout_ms, memory_ms)
        return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    finally:
        conf.set(flag, before)
