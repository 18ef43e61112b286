"""State that streams keep for each key, with event-time timers. Needs the RocksDB state store, see `with_rocksdb`.

Time is a column of microseconds, as timestamps come back from the state with another zone than they went in.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType


def with_rocksdb(spark: SparkSession) -> SparkSession:
    """The session with the state store that timers need; queries that are running keep theirs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark


class First(StatefulProcessor):
    """The first row of each key, by time and then by the order columns, when the watermark has passed it: no earlier one can come.

    The key is remembered for `forget_ms` of event time after that, in which further rows of it are dropped.
    """

    def __init__(self, schema: StructType, ts: str, order: list[str], forget_ms: int) -> None:
        self.schema, self.ts, self.order, self.forget = schema, ts, order, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", self.schema)
        self.sent = handle.getValueState("sent", StructType([StructField("until", LongType())]))

    def _place(self, row: Row) -> tuple:
        return (row[self.ts], *(row[c] for c in self.order))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        if self.sent.exists():
            if timerValues.getCurrentWatermarkInMs() < self.sent.get()[0]:
                return iter(())
            self.sent.clear()  # its timer fires after the rows of this batch
        best = min(rows, key=self._place)
        before = Row(*self.schema.names)(*self.held.get()) if self.held.exists() else None
        if before is None or self._place(best) < self._place(before):
            if before is not None:
                self.handle.deleteTimer(before[self.ts] // 1000 + 1)
            self.held.update(tuple(best[c] for c in self.schema.names))
            self.handle.registerTimer(best[self.ts] // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        due = expiredTimerInfo.getExpiryTimeInMs()
        if self.sent.exists() and self.sent.get()[0] == due:
            self.sent.clear()
        elif self.held.exists() and (row := Row(*self.schema.names)(*self.held.get()))[self.ts] // 1000 + 1 == due:
            self.held.clear()
            self.sent.update((due + self.forget,))
            self.handle.registerTimer(due + self.forget)
            yield row

    def close(self) -> None:
        pass


class Latest(StatefulProcessor):
    """The newest row of each key whenever it changes (`closed` false), and once more when the watermark is `idle_ms` past it
    (`closed` true); then the key is forgotten. Rows that are older than the newest change nothing."""

    def __init__(self, schema: StructType, ts: str, order: list[str], idle_ms: int) -> None:
        self.schema, self.ts, self.order, self.idle = schema, ts, order, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", self.schema)

    def _place(self, row: Row) -> tuple:
        return (row[self.ts], *(row[c] for c in self.order))

    def _out(self, values: tuple, closed: bool) -> Row:
        return Row(*self.schema.names, "closed")(*values, closed)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        best = max(rows, key=self._place)
        before = Row(*self.schema.names)(*self.held.get()) if self.held.exists() else None
        if before is not None and self._place(best) <= self._place(before):
            return
        if before is not None:
            self.handle.deleteTimer(before[self.ts] // 1000 + self.idle)
        values = tuple(best[c] for c in self.schema.names)
        self.held.update(values)
        self.handle.registerTimer(best[self.ts] // 1000 + self.idle)
        yield self._out(values, False)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        values = tuple(self.held.get())
        self.held.clear()
        yield self._out(values, True)

    def close(self) -> None:
        pass
