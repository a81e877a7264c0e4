"""Joins and runs in time over tables, for timelines of any length.

A key's timeline is cut into buckets, so that no task holds all of it: windows run inside (key, bucket), and what has to pass from
one bucket to the next is one row for each of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, by: list[str], at: str, columns: list[str], width: float) -> DataFrame:
    """left with `columns` of the last row of right with the same key at or before its time, null if there is none.

    By union, sort and last value inside (key, bucket of `width`), with each bucket's last row carried over to later ones.
    Of right rows of one time the greatest counts; rows without a key or a time have no match, and left ones stay.
    """
    own = F.struct(*[F.col(c) for c in left.columns])
    payload = F.struct(F.col(at).alias("_t"), *[F.col(c) for c in columns])
    known = right.dropna(subset=[*by, at])
    kind = known.select(payload.alias("r")).schema["r"].dataType
    rows = left.select(*by, F.col(at).alias("_at"), F.lit(1).alias("_side"), own.alias("_own"), F.lit(None).cast(kind).alias("_r"))
    rows = rows.unionByName(known.select(*by, F.col(at).alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast(rows.schema["_own"].dataType).alias("_own"), payload.alias("_r")))
    rows = rows.withColumn("_bucket", F.floor(F.col("_at") / width))
    inside = Window.partitionBy(*by, "_bucket").orderBy("_at", "_side", "_r").rowsBetween(Window.unboundedPreceding, 0)
    seen = rows.withColumn("_seen", F.last("_r", ignorenulls=True).over(inside)).where("_side = 1")
    # One row for each key and bucket.
    ends = rows.groupBy(*by, "_bucket").agg(F.max("_r").alias("_last"))
    earlier = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*by, "_bucket", F.last("_last", ignorenulls=True).over(earlier).alias("_carried"))
    out = seen.join(carried, [*by, "_bucket"], "left").withColumn("_hit", F.when(F.col("_at").isNotNull(), F.coalesce("_seen", "_carried")))
    return out.select("_own.*", *[F.col("_hit")[c].alias(c) for c in columns])


def quality_over(words: DataFrame, spans: DataFrame, by: list[str]) -> DataFrame:
    """words (key, start, ...) with avg_logprob and no_speech_prob of the latest span (key, start, end, measures) that began at or
    before it, if it hasn't ended: quality_asof() over tables."""
    measures = ["avg_logprob", "no_speech_prob"]
    spans = spans.withColumn("_end", F.col("end"))
    joined = asof(words, spans, by, "start", ["_end", *measures], 3600.0)
    ok = F.col("start") <= F.col("_end")
    return joined.withColumns({m: F.when(ok, F.col(m)) for m in measures}).drop("_end")


def near(points: DataFrame, spans: DataFrame, by: list[str], at: str, start: str, end: str, radius: float = 0.0) -> DataFrame:
    """points joined with the spans of their key that end at or after at - radius and start at or before at + radius.

    Spans are filed in two or three bins as wide as they are (powers of two), points in one bin of each width that
    occurs: an equi-join in which each pair meets once.  Other columns of both must differ in name.
    """
    wide = spans.withColumn("_k", F.ceil(F.log2(F.greatest(F.col(end) - F.col(start) + 2 * radius, F.lit(1.0)))).cast("int"))
    widths = [r[0] for r in wide.select("_k").where("_k is not null").distinct().collect()]  # powers of two: a few
    bin_of = lambda x, k: F.floor(x / F.pow(F.lit(2.0), k)).cast("long")
    filed = wide.withColumn("_bin", F.explode(F.sequence(bin_of(F.col(start) - radius, F.col("_k")), bin_of(F.col(end) + radius, F.col("_k")))))
    if not widths:
        return points.join(filed.drop("_k", "_bin"), by).where("false")
    own = points.withColumn("_f", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), bin_of(F.col(at), F.lit(k)).alias("bin")) for k in sorted(widths)])))
    own = own.select(*points.columns, F.col("_f.k").alias("_k"), F.col("_f.bin").alias("_bin"))
    met = own.join(filed, [*by, "_k", "_bin"])
    return met.where((F.col(end) >= F.col(at) - radius) & (F.col(start) <= F.col(at) + radius)).drop("_k", "_bin")


def islands(rows: DataFrame, by: list[str], at: str, gap: float, width: float, name: str = "island") -> DataFrame:
    """rows with the number of their run: a new one begins where a row is more than `gap` after the one before it.

    By lag and a running sum inside (key, bucket of `width`); the last row's place and the sum so far are carried over.
    Rows without a key are a timeline, too; rows without a place lie in no run and are left out.
    """
    # One struct for the key: a null in it equals another one, also in the joins below.
    rows = rows.where(F.col(at).isNotNull()).withColumn("_bucket", F.floor(F.col(at) / width)).withColumn("_by", F.struct(*by))
    by, key = ["_by"], ["_by", "_bucket"]
    inside = Window.partitionBy(*key).orderBy(at)
    earlier = Window.partitionBy(*by).orderBy("_bucket")
    ends = rows.groupBy(*key).agg(F.max(at).alias("_end")).select(*key, F.lag("_end").over(earlier).alias("_before"))
    rows = rows.withColumn("_lag", F.lag(at).over(inside)).join(ends, key)
    before = F.coalesce("_lag", "_before")
    rows = rows.withColumn("_new", F.when(before.isNull() | (F.col(at) - before > gap), 1).otherwise(0))
    sums = rows.groupBy(*key).agg(F.sum("_new").alias("_n"))
    sums = sums.select(*key, F.coalesce(F.sum("_n").over(earlier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"))
    running = F.sum("_new").over(inside.rangeBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_run", running).join(sums, key).withColumn(name, F.col("_run") + F.col("_ahead")).drop("_by", "_bucket", "_lag", "_before", "_new", "_run", "_ahead")


def loops(found: DataFrame, by: list[str], place: str, second: str, n_words: int, least: int = 3) -> DataFrame:
    """key, lo, hi: times of `least` or more repeats of a phrase of n_words with at most one word between; found: one row per
    occurrence, its place in words and its second.  loop_ranges() over tables."""
    runs = islands(found, by, place, n_words + 1, 1024.0, "_island").groupBy(*by, "_island")
    spans = runs.agg(F.count("*").alias("_n"), F.min(second).alias("lo"), F.max(second).alias("hi"))
    return spans.where(F.col("_n") >= least).select(*by, "lo", "hi")


def outside(hits: DataFrame, spans: DataFrame, by: list[str], at: str, slack: float = 1.0) -> DataFrame:
    """hits that lie in none of their key's spans (key, lo, hi), nor within `slack` of one."""
    times = hits.select(*by, at).distinct()
    inside = near(times, spans.select(*by, "lo", "hi"), by, at, "lo", "hi", slack).select(*by, at).distinct()
    return hits.join(inside, [*by, at], "left_anti").select(*hits.columns)
