"""Each vehicle's recent fixes as keyed state, given out at every tick while the vehicle is active."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

#: The state store that keyed state needs, with changes written instead of whole states.
_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Streaming queries that are started here hold their state in the store that keyed state needs."""
    before = {k: spark.conf.get(k, None) for k in _STORE}
    for k, v in _STORE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Recent(StatefulProcessor):
    """A list of one vehicle's fixes, not older than keep_s seconds before the watermark or before its own last fix.

    Timers, one at a time: while the watermark is at most active_s seconds past the last fix, one
    goes off as soon as the watermark moves, and the fixes are given out again;
    after that, one goes off when the last fix is too old, and the state is removed.
    """

    def __init__(self, columns: list[str], schema: StructType, keep_s: int, active_s: int) -> None:
        self.columns, self.schema, self.keep_s, self.active_s = columns, schema, keep_s, active_s
        self.ts, self.id = columns.index("ts"), columns.index("event_id")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.fixes = handle.getListState("fixes", self.schema)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        held = self._held()
        known = {f[self.id] for f in held}
        new = []
        for pdf in rows:
            for row in zip(*(self._values(pdf[c]) for c in self.columns), strict=True):
                if row[self.id] not in known:
                    known.add(row[self.id])
                    new.append(row)
        if held:  # without fixes there is no timer either
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
        yield from self._tick(held, new, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        yield from self._tick(self._held(), [], timerValues.getCurrentWatermarkInMs())  # the timer that went off is deleted

    def close(self) -> None:
        pass

    @staticmethod
    def _values(column: pd.Series) -> list:
        """Plain values, None where there is none."""
        return [None if v is None or v is pd.NA or v != v else v for v in column.tolist()]

    def _held(self) -> list[tuple]:
        return [tuple(x) for x in self.fixes.get()] if self.fixes.exists() else []

    def _tick(self, held: list[tuple], new: list[tuple], mark_ms: int) -> Iterator[pd.DataFrame]:
        if not held and not new:
            return
        last = max(f[self.ts] for part in (held, new) for f in part)
        oldest = max(mark_ms / 1000, last) - self.keep_s
        fresh, new = [f for f in held if f[self.ts] > oldest], [f for f in new if f[self.ts] > oldest]
        if len(fresh) < len(held):
            self.fixes.put(fresh + new) if fresh or new else self.fixes.clear()
        elif new:
            self.fixes.appendList(new)
        every = fresh + new
        if not every:
            return
        active = mark_ms / 1000 - last <= self.active_s
        self.handle.registerTimer(max(mark_ms, 0) + 1 if active else int((last + self.keep_s) * 1000) + 1)
        if active:
            yield pd.DataFrame(dict(zip(self.columns, map(list, zip(*every, strict=True)), strict=True)))


def histories(stream: DataFrame, columns: list[str], keep_s: int, active_s: int, late: str = "1 minute") -> DataFrame:
    """At each tick the recent fixes (columns, among them event_id, tr_id and ts in seconds) of every active vehicle.

    stream has event_time as well.  Of repeated fixes (event_id) one is kept.  A
    vehicle's state is bounded by its fixes of keep_s seconds, and goes when none
    is left.  Start the query within keyed_state().
    """
    marked = stream.withWatermark("event_time", late).select("event_time", *columns)
    schema = stream.select(*columns).schema
    return marked.groupBy("tr_id").transformWithStateInPandas(Recent(columns, schema, keep_s, active_s), schema, "Append", "EventTime")


def active(fixes: DataFrame, now: int, keep_s: int) -> DataFrame:
    """Of a tick's fixes those not older than keep_s seconds at the newest one."""
    return fixes.where(F.col("ts") > now - keep_s)
