"""Removal of repeated long strings by a family of suffix arrays whose sizes grow geometrically.

Suffixes are taken at places that the text itself marks (minima of rolling hashes), at least one in WINDOW bytes, so equal
strings of `length` bytes have equal places.  A batch of documents gets its suffix array: entries sorted by the print of the
text around the place that all strings assigned to the place share (their core), then by that of all they cover (their block).
It is merge-scanned against the array of each level; cores that meet are stored.  Before a batch comes, levels
of equal size are merged, so there are as many levels as the number of batches has bits.

Strings assigned to places of equal blocks are equal.  Where only cores are equal, the strings at one place may be equal
to those at different ones: their ranges are halved in two steps, down to single strings, only one place of equal ones going on.
Prints have 64 bits and always count in pairs of independent ones, 128 in all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressglass.llm.common import Scratch, bounded_batches, numbered, stored

#: Bytes that a place's hash covers, and the least number of places in a row of which one is taken (of 400-byte strings).
GRAM, WINDOW = 16, 128
#: Widths of the ranges in the steps that follow the first.
STEPS = (16, 1)
MIX = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xBF58476D1CE4E5B9)]
ENTRY = "core long, block long, rid long, at int, low short, high short"


def places(data: bytes, window: int = WINDOW) -> np.ndarray:
    """Where a rolling hash is the least of `window` places in a row: told by the 2 * window + GRAM bytes around."""
    n = len(data) - GRAM + 1
    if n < window:
        return np.zeros(0, np.int64)
    h = np.frombuffer(data, np.uint8).astype(np.uint64)
    for s, c in zip((1, 2, 4, 8), MIX, strict=False):
        h = h[:-s] * c + h[s:]
    h ^= h >> np.uint64(32)
    h = ((h * MIX[4]) >> np.uint64(32)).astype(np.uint32)
    least, most, s = h, None, 1
    while s < window:
        least = np.minimum(least[:-s], least[s:])
        s *= 2
    rim = np.zeros(window - 1, np.uint32)
    most, s = np.concatenate([rim, least, rim]), 1
    while s < window:
        most = np.maximum(most[:-s], most[s:])
        s *= 2
    return np.flatnonzero(h == most)


def _prints(data: memoryview, at: int, first: int, last: int, length: int, window: int) -> tuple[int, int]:
    """Prints of core and block of the strings that begin first to last bytes before at - window; parts beyond the
    text's ends are told by their sizes."""
    begin, end = at - window - last, at - window - first + length
    beyond = max(0, -begin) << 32 | max(0, end - len(data))
    core = xxhash.xxh3_64_intdigest(data[at - window - first : at - window - last + length], last - first)
    return core, xxhash.xxh3_64_intdigest(data[max(0, begin) : end], beyond + 1)


def _signed(numbers: list[int]) -> pa.Array:
    return pa.array(np.array(numbers, np.uint64).view(np.int64))


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _entries(length: int, window: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """rid, text -> an entry for each place to which strings are assigned: those of which it is the first at window or more."""
    for batch in batches:
        cores, blocks, columns = [], [], [[] for _ in range(4)]
        for rid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            data = _bytes(text)
            n = len(data)
            if n < length:
                continue
            at = places(data, window)
            low = np.maximum(0, at - window + length - n)
            high = np.minimum(np.minimum(np.diff(at, prepend=at[0] - window) - 1, at - window), window - 1)
            has = low <= high
            at, low, high, view = at[has], low[has], high[has], memoryview(data)
            for a in at.tolist():
                core, block = _prints(view, a, 0, window - 1, length, window)
                cores.append(core)
                blocks.append(block)
            for c, x in zip(columns, (np.full(len(at), rid, np.int64), at, low, high), strict=True):
                c.append(x)
        rid, at, low, high = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in columns)
        yield pa.RecordBatch.from_arrays([_signed(cores), _signed(blocks), pa.array(rid), pa.array(at.astype(np.int32)), pa.array(low.astype(np.int16)), pa.array(high.astype(np.int16))], names=["core", "block", "rid", "at", "low", "high"])


def _narrower(length: int, window: int, width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """rid, text, lists of at, low, high, open -> an entry for each part of the ranges that is `width` wide at most."""
    for batch in batches:
        cores, blocks, rows = [], [], []
        for rid, text, *lists in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            data = memoryview(_bytes(text))
            for at, low, high, is_open in zip(*lists, strict=True):
                for first in range(low // width * width, high + 1, width):
                    core, block = _prints(data, at, first, first + width - 1, length, window)
                    cores.append(core ^ first)  # ranges meet their like only
                    blocks.append(block)
                    rows.append((rid, at, max(first, low), min(first + width - 1, high), is_open))
        kinds = [pa.int64(), pa.int32(), pa.int16(), pa.int16(), pa.bool_()]
        own = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([_signed(cores), _signed(blocks), *own], names=["core", "block", "rid", "at", "low", "high", "open"])


class SuffixFamily:
    """Suffix arrays of all batches so far: levels of entries, each with the number of batches in it."""

    def __init__(self, tables: Scratch, length: int = 400, window: int = WINDOW):
        self.tables, self.length, self.window = tables, length, window
        self.levels: list[tuple[int, DataFrame, Scratch]] = []
        self.met: list[DataFrame] = []

    def _array(self, entries: DataFrame, n: int) -> None:
        order, own = ["core", "block", "rid", "at"], self.tables.inner("level")
        with self.tables.inner("entries") as unsorted:  # ranges are found by reading the entries twice
            entries = unsorted.stored(entries, "entries")
            self.levels.append((n, own.stored(entries.repartitionByRange(*order).sortWithinPartitions(*order), "array"), own))

    def add(self, rows: DataFrame) -> DataFrame:
        """rows: rid, text. Takes a batch in; returns the cores of it that occur again, in it or in a level."""
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (n, a, old), (m, b, older) = self.levels.pop(), self.levels.pop()
            self._array(a.unionByName(b), n + m)
            old.remove()
            older.remove()
        self._array(rows.select("rid", "text").mapInArrow(partial(_entries, self.length, self.window), ENTRY), 1)
        own = self.levels[-1][1].groupBy("core").agg(F.count("*").alias("n"))
        met = own.where("n > 1").select("core")
        for _, level, _ in self.levels[:-1]:
            met = met.unionByName(own.select("core").join(level.select("core").distinct().hint("merge"), "core"))
        self.met.append(self.tables.stored(met.distinct(), "met"))
        return self.met[-1]

    def repeated(self) -> DataFrame:
        """The entries, of all levels, whose cores have met."""
        entries = reduce(DataFrame.unionByName, [level for _, level, _ in self.levels])
        met = reduce(DataFrame.unionByName, self.met).distinct()
        return entries.join(met.hint("merge"), "core")


def _told(entries: DataFrame, tables: Scratch) -> tuple[DataFrame, DataFrame]:
    """Of entries (with open: not known yet): which are known to be repeated, and which have to be told apart further."""
    entries = tables.stored(entries, "entries")
    mark = F.xxhash64("rid", "at")  # of equal ones the entry with the least mark goes on; if two have it, both may
    kinds = entries.groupBy("core", "block").agg(F.count("*").alias("n"), F.min(mark).alias("one"))
    many = kinds.groupBy("core").agg(F.min("block").alias("lo"), F.max("block").alias("hi")).where("lo != hi")
    many = many.select("core", F.col("core").alias("twin"), F.lit(True).alias("mixed"))
    # Joined on more than the grouping key: both sides are dealt out anew, so that AQE can split a core with many blocks.
    kinds = kinds.withColumn("twin", F.col("core")).join(many.hint("merge"), ["core", "twin"], "left").drop("twin").where("n > 1 or mixed")
    told = tables.stored(entries.join(kinds.hint("merge"), ["core", "block"]), "told")
    going_on = (F.col("n") == 1) | (mark == F.col("one"))
    unsure = told.where(F.col("mixed") & going_on).select("rid", "at", "low", "high", (F.col("open") & (F.col("n") == 1)).alias("open"))
    return told.where("open and n > 1").select("rid", "at", "low", "high"), unsure


def _kept(id_type: pa.DataType, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, text, begins and ends of repeated strings -> id, n_bytes, n_removed, n_spans, kept_sha256."""
    for batch in batches:
        rows = []
        lists = [batch.column(i) for i in (2, 3)]
        for i, text in enumerate(batch.column(1).to_pylist()):
            data = _bytes(text)
            if not lists[0][i].is_valid:
                rows.append((len(data), 0, 0, hashlib.sha256(data).hexdigest()))
                continue
            begin, end = (x[i].values.to_numpy() for x in lists)
            order = np.argsort(begin, kind="stable")
            begin, end = begin[order], np.maximum.accumulate(end[order])
            new = np.append(True, begin[1:] > end[:-1])  # spans that touch are one run
            begin, end = begin[new], end[np.append(new[1:], True)]
            edges = [0, *np.stack([begin, end], 1).ravel().tolist(), len(data)]
            kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            rows.append((len(data), len(data) - len(kept), len(begin), hashlib.sha256(kept).hexdigest()))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        found = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(id_type), *found], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def without_repeats(docs: DataFrame, length: int = 400, batches: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs (read from files): id, n_bytes, n_removed, n_spans, kept_sha256.

    Every byte of the UTF-8 text goes that a string of `length` bytes covers which also starts anywhere else in docs, the same
    text included; n_spans counts maximal runs of such bytes.  length must leave room for WINDOW: 400 or more.
    Null texts count as empty, ids of any type may be null or repeated, repeated rows are repeats of each other, columns
    besides id and text aren't read, and an empty table gives no rows.
    """
    if length < 3 * WINDOW + GRAM:
        raise ValueError(f"strings of {length} bytes are too short for places in every {WINDOW} bytes")
    spark = docs.sparkSession
    bounded_batches(spark)
    read = numbered(docs, "_rid").select(F.col("_rid").alias("rid"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    with Scratch(spark, "suffixes") as tables:
        family = SuffixFamily(tables, length)
        for k in range(batches):
            family.add(read.where(F.pmod(F.xxhash64("rid"), F.lit(batches)) == k))
        entries = family.repeated().withColumn("open", F.lit(True))
        known = []
        for width in STEPS:
            sure, unsure = _told(entries, tables)
            known.append(sure)
            lists = unsure.groupBy("rid").agg(F.collect_list(F.struct("at", "low", "high", "open")).alias("unsure"))
            texts = read.select("rid", "text").join(lists.hint("merge"), "rid")
            entries = texts.select("rid", "text", *[f"unsure.{c}" for c in ("at", "low", "high", "open")]).mapInArrow(partial(_narrower, length, WINDOW, width), f"{ENTRY}, open boolean")
        known.append(_told(entries, tables)[0])
        begin, end = F.col("at") - WINDOW - F.col("high"), F.col("at") - WINDOW - F.col("low") + length
        spans = reduce(DataFrame.unionByName, known).select("rid", F.struct(begin.alias("begin"), end.alias("end")).alias("s")).groupBy("rid").agg(F.collect_list("s").alias("s"))
        spans = spans.select("rid", F.col("s.begin").alias("begins"), F.col("s.end").alias("ends"))
        rows = read.join(spans.hint("merge"), "rid", "left").select("doc_id", "text", "begins", "ends")
        kind = docs.schema[id_col].dataType
        from pyspark.sql.pandas.types import to_arrow_type

        out = rows.mapInArrow(partial(_kept, to_arrow_type(kind)), f"doc_id {kind.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
        return stored(out.withColumnRenamed("doc_id", id_col), "without-repeats")
