"""Streams whose rows are walked in order of time, with event-time timers and state that ends.

Rows wait in the state of their stream until the watermark has passed them, and are then taken in order, whatever the order and the
batches in which they came: the result is that of the batch form.  Once a stream has been silent for `idle` seconds
of event time its last line comes out and its state is gone.  Needs the RocksDB state store (see rocksdb()).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from pressglass.operators.ticker import BITS, merge_read

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams that begin here keep their state in RocksDB; the session's setting is put back."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


class InOrder(StatefulProcessor):
    """Hands a stream's rows to step(last, row) -> (last, rows to give) in order of time, then step(last, None).

    State: rows that wait (ms, order, row), and last; the key's one timer stands at the first row that waits, else at the
    end of the idle time.
    """

    def __init__(self, step: Callable, fields: list[str], last_schema: str, row_schema: str, names: list[str], idle: int):
        self.step, self.fields, self.last_schema, self.row_schema, self.names, self.idle = step, fields, last_schema, row_schema, names, idle * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", f"_ms long, {self.row_schema}")
        self.last = handle.getValueState("last", f"_ms long, {self.last_schema}")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        new = [(r["_ms"], *[r[f] for f in self.fields]) for r in rows]
        self.waiting.appendList(new)
        self._wake(min(r[0] for r in new))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        now = expiredTimerInfo.getExpiryTimeInMs()
        passed = max(now, timerValues.getCurrentWatermarkInMs())
        known = self.last.get() if self.last.exists() else None
        seen, last = (known[0], list(known[1:])) if known else (None, None)
        rows = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        ready, later, out = sorted(r for r in rows if r[0] <= passed), [r for r in rows if r[0] > passed], []
        for ms, *row in ready:
            if seen is not None and ms - seen >= self.idle:  # silent for so long that the line before it is over
                out += self.step(last, None)[1]
                last = None
            last, over = self.step(last, row)
            out, seen = out + over, ms
        if not later and seen is not None and passed >= seen + self.idle:
            out += self.step(last, None)[1]
            last, seen = None, None
        if later:
            self.waiting.put(later)
        else:
            self.waiting.clear()
        if last is None:
            self.last.clear()
        else:
            self.last.update((seen, *last))
        if later or last is not None:
            self._wake(min([*(r[0] for r in later), *([seen + self.idle] if last is not None else [])]), passed)
        return (Row(**dict(zip(self.names, (*key, *r), strict=True))) for r in out)

    def _wake(self, at: int, after: int = -1) -> None:
        timers = list(self.handle.listTimers())
        if timers and min(timers) <= at and min(timers) > after:
            return
        for t in timers:
            self.handle.deleteTimer(t)
        self.handle.registerTimer(at)

    def close(self) -> None:
        pass


def in_order(stream: DataFrame, by: str, time: str, step: Callable, last_schema: str, row_schema: str, out_schema: str, late: str, idle: int) -> DataFrame:
    """Rows (by, time, the fields of row_schema) of each value of `by`, walked in order of time, then of the fields."""
    fields = [f.split()[0] for f in row_schema.split(", ")]
    rows = stream.withWatermark(time, late).select(by, time, F.unix_millis(time).alias("_ms"), *fields)
    kinds = StructType.fromDDL(f"{by} {stream.schema[by].dataType.simpleString()}, {out_schema}")
    processor = InOrder(step, fields, last_schema, row_schema, kinds.names, idle)
    return rows.groupBy(by).transformWithState(statefulProcessor=processor, outputStructType=kinds, outputMode="Append", timeMode="EventTime")


def stream_merge_ticker(stream: DataFrame, by: str = "stream_id", time: str = "ts", late: str = "1 minute", idle: int = 600) -> DataFrame:
    """stream, t, text of lines that are over: reads (stream, ts, t, text) merge into the last line of their stream while they are alike.

    As merge_ticker() over all rows, but that a line ends after `idle` seconds without reads.  Rows that come later than `late`
    behind the newest one of any stream are dropped.
    """
    return in_order(stream, by, time, merge_read, "t int, text string", "t int, text string", "t int, text string", late, idle)


def stream_suppress_frames(stream: DataFrame, tol: int = BITS, by: str = "stream_id", time: str = "ts", late: str = "1 minute", idle: int = 3600) -> DataFrame:
    """stream, t of frames (stream, ts, t, signature of 0/1) that differ in more than tol places from the last one kept.

    As suppress_near_duplicates() over all rows, but that after `idle` seconds without frames the next one is kept.
    """

    def step(last: list | None, frame: list | None) -> tuple[list | None, list]:
        if frame is None:
            return None, []
        t, bits = frame
        if last is not None and sum(a != b for a, b in zip(last[0], bits, strict=False)) <= tol:
            return last, []
        return [list(bits)], [(t,)]

    return in_order(stream, by, time, step, "signature array<int>", "t int, signature array<int>", "t int", late, idle)
