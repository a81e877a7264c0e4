"""On-screen ticker reads and frame signatures."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from pressglass.functions.text import squash_ws, word_jaccard

GAP, ALIKE, BITS = 20, 0.6, 6


def ticker_events(matches: DataFrame, gap: int = GAP, by: tuple[str, ...] = ("stream_id", "keyword"), time: str = "t") -> DataFrame:
    """First matches of events: a match gap seconds or more after the match before it (which counts, event or not)."""
    before = F.lag(time).over(Window.partitionBy(*by).orderBy(time))
    return matches.withColumn("_before", before).where(F.col("_before").isNull() | (F.col(time) - F.col("_before") >= gap)).drop("_before")


def merge_reads(reads: Column) -> Column:
    """array<struct<t, text>> in order of time, reads of one scrolling line merged: the longest wording at its first time.

    For reads that are nested in a row already; merge_ticker() takes them as rows.
    """
    def add(kept: Column, r: Column) -> Column:
        new = squash_ws(F.coalesce(r["text"], F.lit("")))
        last = F.try_element_at(kept, F.lit(-1))
        old = squash_ws(F.coalesce(last["text"], F.lit("")))
        same = (old != "") & (F.contains(new, old) | F.contains(old, new) | (word_jaccard(old, new) >= ALIKE))
        richer = F.concat(F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0))), F.array(F.struct(last["t"].alias("t"), r["text"].alias("text"))))
        return F.when(new == "", kept).when((F.size(kept) > 0) & same, F.when(F.length(new) > F.length(old), richer).otherwise(kept)).otherwise(F.concat(kept, F.array(F.struct(r["t"].alias("t"), r["text"].alias("text")))))

    return F.aggregate(reads, F.slice(reads, 1, 0), add)


def _walked(df: DataFrame, by: str, order: list[str], columns: list[str], step: Callable, schema: str) -> DataFrame:
    """Rows of each value of `by` in order, handed one by one to step(last, row) -> (last, rows to give), then step(last, None).

    Sorted by Spark and read as they come: a task holds a batch and what step() keeps of a stream, never a whole stream.
    """
    rows = df.select(by, *columns).repartition(by).sortWithinPartitions(by, *order)
    names = [by, *(f.split()[0] for f in schema.split(", "))]
    kinds = ", ".join([f"{by} {df.schema[by].dataType.simpleString()}", schema])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last, began = None, None, False
        for batch in batches:
            out = []
            for own, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not began or own != key:
                    out += [(key, *r) for r in step(last, None)[1]] if began else []
                    key, last, began = own, None, True
                last, give = step(last, row)
                out += [(key, *r) for r in give]
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], arrow)
        if began:
            yield pa.RecordBatch.from_pylist([dict(zip(names, (key, *r), strict=True)) for r in step(last, None)[1]], arrow)

    arrow = to_arrow_schema(StructType.fromDDL(kinds))
    return rows.mapInArrow(each, kinds)


def line_form(text: str | None) -> str:
    return " ".join((text or "").split())


def alike(a: str, b: str) -> bool:
    """Whether two lines are reads of one: one holds the other, or they share enough words."""
    x, y = set(a.split()), set(b.split())
    return a in b or b in a or bool(x and y) and len(x & y) / len(x | y) >= ALIKE


def merge_read(last: list | None, read: list | None) -> tuple[list | None, list]:
    """A line (t, text) goes on with a read that is like it, in the longest wording at its first time; else it is over."""
    if read is None or not (new := line_form(read[1])):
        return last, [last] if read is None and last else []
    if last is None:
        return read, []
    old = line_form(last[1])
    if alike(old, new):
        return ([last[0], read[1]] if len(new) > len(old) else last), []
    return read, [last]


def merge_ticker(entries: DataFrame, by: str = "stream_id") -> DataFrame:
    """stream, t, text: entries (stream, t, text) of each stream merged in order of time, a broadcast at a time."""
    kinds = entries.schema
    return _walked(entries, by, ["t", "text"], ["t", "text"], merge_read, f"t {kinds['t'].dataType.simpleString()}, text string")


def ticker_sources(live: DataFrame, recorded: DataFrame, day: str, today: str) -> DataFrame:
    """Live streams only if the day is today, and the day's recordings, tagged by kind."""
    now = live.withColumn("kind", F.lit("live")) if day == today else live.limit(0).withColumn("kind", F.lit("live"))
    return now.unionByName(recorded.where(F.col("slot_date") == day).drop("slot_date").withColumn("kind", F.lit("bulletin")), allowMissingColumns=True)


def bit_signature(pixels: Column) -> Column:
    """1 where a value is above the mean."""
    mean = F.aggregate(pixels, F.lit(0.0), lambda a, x: a + x, lambda a: a / F.size(pixels))
    return F.transform(F.arrays_zip(F.array_repeat(mean, F.size(pixels)).alias("m"), pixels.alias("x")), lambda p: F.when(p["x"] > p["m"], 1).otherwise(0))


def hamming(a: Column, b: Column) -> Column:
    """Places at which two signatures differ, over the shorter length."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x != y), lambda d: F.coalesce(d, F.lit(False))))


def suppress_near_duplicates(frames: DataFrame, tol: int = BITS, by: str = "stream_id", order: str = "t", signature: str = "signature") -> DataFrame:
    """Frames that differ in more than tol bits from the last one kept of their stream."""

    def step(last: list | None, frame: list | None) -> tuple[list | None, list]:
        if frame is None:
            return last, []
        at, bits = frame
        if last is not None and sum(a != b for a, b in zip(last, bits, strict=False)) <= tol:
            return last, []
        return bits, [(at,)]

    return _walked(frames, by, [order, signature], [order, signature], step, f"{order} {frames.schema[order].dataType.simpleString()}")
