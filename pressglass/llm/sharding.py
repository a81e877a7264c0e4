"""Sharding by minimax contiguous partition: the smallest capacity at which ordered atomic groups fit into n shards.

The order is that of the groups' first ids.  The search for the capacity is a binary search with a greedy check, done on
the driver over a directory of at most DIRECTORY runs of groups with their sums.  A greedy cut is known only to lie
in a run, so a capacity is surely feasible, surely not, or undecided.  Runs in which an undecided cut can lie are
broken up into shorter runs by the next Spark job, until all cuts are exact: a few rounds at any size.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressglass.llm.common import stored

#: Runs of groups that the driver holds at most.
DIRECTORY = 50_000


def _steps(ends: Sequence[int], single: Sequence[bool], capacity: int, n: int, low: bool) -> list[int]:
    """Greedy cuts (sums before each shard, then the end reached). ends: sums at the ends of the known runs;
    single: whether the run is one group.

    A limit inside a run of one group cuts before it.  Inside a longer run, low cuts before it (no later cut is
    sure), else at the limit itself (no cut lies later).
    """
    cuts, at = [0], 0
    for _ in range(n):
        i = bisect_right(ends, at + capacity)
        if i == len(ends):
            at = ends[-1]
        elif low or single[i]:
            at = max(at, ends[i - 1] if i else 0)
        else:
            at += capacity
        cuts.append(at)
    return cuts


def _smallest(ends: Sequence[int], single: Sequence[bool], n: int, floor: int, low: bool) -> int:
    """The smallest capacity of at least floor with which n greedy shards reach the end."""
    a, b = floor, max(floor, ends[-1])
    while a < b:
        c = (a + b) // 2
        if _steps(ends, single, c, n, low)[-1] >= ends[-1]:
            b = c
        else:
            a = c + 1
    return a


def _joined(windows: list[tuple[int, int]], most: int = 100) -> list[tuple[int, int]]:
    """At most so many windows that cover the given, sorted ones: the nearest are joined."""
    gaps = sorted(((b[0] - a[1]) for a, b in zip(windows, windows[1:], strict=False)), reverse=True)
    least = max(1, gaps[most - 1] if len(gaps) >= most else 1)
    out = windows[:1]
    for a, b in windows[1:]:
        if a - out[-1][1] < least:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def minimax_cuts(groups: DataFrame, n: int, directory: int = DIRECTORY) -> tuple[int, list[int]]:
    """groups: size and upto (the sum of all sizes up to the group's own, in order), sizes positive.

    Returns the smallest feasible capacity and, for each shard, the sum before it; shards at the end may be empty.
    """
    total, largest = groups.agg(F.max("upto"), F.max("size")).first()
    if not total:
        return 0, [0] * n
    known, windows, run = {total: False}, [(0, total)], 4 * total
    while True:
        run = max(1, min(run // 4, 2 * sum(b - a for a, b in windows) // directory))  # shorter each time
        inside = F.lit(False)
        for a, b in windows:
            inside |= (F.col("upto") > a) & (F.col("upto") <= b)
        cells = groups.where(inside).groupBy(F.floor(F.col("upto") / run)).agg(F.max("upto").alias("end"), F.count("*").alias("n_groups"))
        known |= {r.end: r.n_groups == 1 for r in cells.collect()}  # half of the directory, and a few at the windows' borders
        ends = sorted(known)
        single = [known[e] for e in ends]
        # The capacity lies in [hope, sure], each cut between the low cut at hope and the high cut at sure.
        sure, hope = _smallest(ends, single, n, largest, True), _smallest(ends, single, n, largest, False)
        early, late = _steps(ends, single, hope, n, True), _steps(ends, single, sure, n, False)
        open_runs = {i for a, b in zip(early, late, strict=True) for i in range(bisect_right(ends, a), min(len(ends), bisect_right(ends, b) + 1)) if not single[i]}
        if not open_runs:
            return sure, _steps(ends, single, sure, n, True)[:n]
        windows = _joined([(ends[i - 1] if i else 0, ends[i]) for i in sorted(open_runs)])


def _running(df: DataFrame, order: list[str], sums: dict[str, Column], what: str) -> DataFrame:
    """Adds to df, for each name in sums, the sum of the column over all rows up to the row's own, in a total order.

    Sorted by range and stored once; sums within a range are those of a window over the range's number, and the
    ranges' own sums (one row each) are added on the driver.  No range holds a group together, so none grows with one.
    """
    ranged = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_range", F.spark_partition_id()), what)
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    totals = ranged.groupBy("_range").agg(*[F.sum(c).alias(k) for k, c in sums.items()]).orderBy("_range").collect()
    before, rows = dict.fromkeys(sums, 0), []
    for r in totals:
        rows.append((r["_range"], *before.values()))
        before = {k: before[k] + r[k] for k in sums}
    spark = df.sparkSession
    ahead = F.broadcast(spark.createDataFrame(rows, "_range int, " + ", ".join(f"_{k} long" for k in sums)))  # a row for each range
    return ranged.withColumns({k: F.sum(c).over(within) for k, c in sums.items()}).join(ahead, "_range", "left").withColumns({k: F.col(k) + F.col(f"_{k}") for k in sums}).drop("_range", *[f"_{k}" for k in sums])


def shard(docs: DataFrame, n: int = 24, id_col: str = "doc_id", text_col: str = "text", overhead: int = 8) -> DataFrame:
    """One row per row of docs: id, size, text_crc32, shard, slot, rid.

    A row's size is its text's bytes plus overhead; null texts count as empty ones do.  Equal texts are one group and
    stay together, so a shard can be no smaller than the largest group, whose rows are never split.  Groups
    are in the order of their smallest id (null last), rows in it by id; slots count from 0 in that order.  Repeated
    rows each have a slot; an empty table gives no rows.
    """
    read = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    text = F.coalesce("text", F.lit(""))
    # Equal texts: equal SHA-256, length and CRC. From here on no text travels.
    rows = stored(read.select("rid", "doc_id", (F.octet_length(text) + overhead).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.sha2(text.cast("binary"), 256).alias("key")), "sizes")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("rid").alias("row"))).alias("first")
    groups = rows.groupBy("key", "size").agg(first, F.count("*").alias("n_rows")).select("key", "size", F.col("first.no_id").alias("g_no_id"), F.col("first.id").alias("g_id"), F.col("first.row").alias("g_row"), "n_rows")
    order = ["g_no_id", "g_id", "g_row"]
    summed = stored(_running(groups, order, {"upto": F.col("n_rows") * F.col("size"), "rows_upto": F.col("n_rows")}, "groups"), "sums")
    _, cuts = minimax_cuts(summed.select((F.col("n_rows") * F.col("size")).alias("size"), "upto"), n)
    begin = F.col("upto") - F.col("n_rows") * F.col("size")
    number = F.lit(0)
    for i, cut in enumerate(cuts[1:], 1):
        number = F.when(begin >= cut, i).otherwise(number)  # of equal cuts, the last: shards before it are empty
    placed = summed.withColumn("shard", number).withColumn("ahead", F.col("rows_upto") - F.col("n_rows"))
    starts = {r.shard: r.at for r in placed.groupBy("shard").agg(F.min("ahead").alias("at")).collect()}  # n rows
    start = F.lit(0)
    for k, at in starts.items():
        start = F.when(F.col("shard") == k, at).otherwise(start)
    # Joined on more than the groups' key: both sides are dealt out anew, and AQE can split a group with many rows.
    joined = rows.join(placed.select("key", "size", "shard", "ahead", *order, start.alias("start")), ["key", "size"])
    # Places of rows inside groups, by running counts over all rows in order: slot = rows before in the whole - before the shard.
    counted = _running(joined, [*order, "doc_id", "rid"], {"place": F.lit(1)}, "rows")
    return counted.select(F.col("doc_id").alias(id_col), "size", "text_crc32", "shard", (F.col("place") - 1 - F.col("start")).alias("slot"), "rid")
