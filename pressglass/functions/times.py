"""Times, titles, durations and links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "Asia/Karachi"


def title_hours(title: Column) -> Column:
    """Clock hours (0-23) that a title names: 12AM, 9 a.m.; not 9:30."""
    found = F.regexp_extract_all(F.coalesce(title, F.lit("")), F.lit(r"(?i)(?<![\d:])(\d{1,2}\s*[ap])\.?m\.?(?![\p{L}\p{N}_])"), F.lit(1))
    hour = F.transform(found, lambda x: F.struct(F.regexp_extract(x, r"^(\d+)", 1).cast("int").alias("h"), F.lower(F.right(x, F.lit(1))).alias("half")))
    valid = F.filter(hour, lambda x: x["h"].between(1, 12))
    return F.array_sort(F.array_distinct(F.transform(valid, lambda x: x["h"] % 12 + F.when(x["half"] == "p", 12).otherwise(0))))


def title_has_time(title: Column) -> Column:
    return F.coalesce(title, F.lit("")).rlike(r"(?i)\b\d{1,2}\s*(?::\d{2})?\s*(?:am|pm|a\.m\.|p\.m\.)(?![\p{L}\p{N}_])")


def slot_airtime(slot_date: Column, local_time: Column, tz: Column | str = ZONE) -> Column:
    """The instant of a local date and HH:MM:SS."""
    return F.to_utc_timestamp(F.concat_ws(" ", slot_date, local_time).cast("timestamp"), tz)


def same_slot_date(published: Column, slot_date: Column, local_time: Column, tz: Column | str = ZONE) -> Column:
    """Same local day; for midnight slots the day before from 22:00 too."""
    local = F.from_utc_timestamp(published, tz)
    day = F.to_date(slot_date)
    eve = local_time.startswith("00:") & (F.to_date(local) == F.date_sub(day, 1)) & (F.hour(local) >= 22)
    return F.coalesce((F.to_date(local) == day) | eve, F.lit(False))


def iso_duration_seconds(text: Column) -> Column:
    """PnDTnHnMnS in seconds; null for anything else."""
    t = F.upper(F.trim(text))
    part = lambda unit, at: F.coalesce(F.when(F.regexp_extract(t, at, 1) != "", F.regexp_extract(t, at, 1).cast("int")), F.lit(0)) * unit
    total = part(86400, r"^P(\d+)D") + part(3600, r"T(\d+)H") + part(60, r"T(?:\d+H)?(\d+)M") + part(1, r"T(?:\d+H)?(?:\d+M)?(\d+)S")
    return F.when(t.rlike(r"^P(?=\d|T\d)(\d+D)?(T(?=\d)(\d+H)?(\d+M)?(\d+S)?)?$"), total)


def deep_link(base: Column, second: Column) -> Column:
    return F.when(second >= 0, F.concat(base, F.lit("&t="), second.cast("string"), F.lit("s"))).otherwise(base)


def mmss(second: Column) -> Column:
    """m:ss, from an hour on h:mm:ss."""
    s = F.greatest(second.cast("int"), F.lit(0))
    h, m, r = F.floor(s / 3600), F.floor(s / 60) % 60, s % 60
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.when(h > 0, F.concat_ws(":", h.cast("string"), two(m), two(r))).otherwise(F.concat_ws(":", m.cast("string"), two(r)))


def card_time(second: Column) -> Column:
    s = second.cast("int")
    return F.concat(F.floor(s / 60).cast("string"), F.lit("m "), F.lpad((s % 60).cast("string"), 2, "0"), F.lit("s"))


def period_bounds(d1: Column, d2: Column, t1: Column, t2: Column, tz: str = ZONE) -> Column:
    """struct(lo, hi, error) in UTC; an end at 23:59 takes in its last second; the end lies not before the start."""
    lo = F.to_utc_timestamp(F.concat(d1, F.lit(" "), F.coalesce(t1, F.lit("00:00"))).cast("timestamp"), tz)
    end = F.coalesce(t2, F.lit("23:59"))
    hi = F.to_utc_timestamp(F.concat(F.coalesce(d2, d1), F.lit(" "), end, F.when(end == "23:59", ":59").otherwise(":00")).cast("timestamp"), tz)
    bad = hi < lo
    return F.struct(F.when(~bad, lo).alias("lo"), F.when(~bad, hi).alias("hi"), F.when(bad, "The end lies before the start").alias("error"))


def edge_date(text: Column) -> Column:
    """The first ISO date in a string, null if there is none or it doesn't exist."""
    return F.try_to_date(F.regexp_extract(F.coalesce(text, F.lit("")), r"(\d{4}-\d{2}-\d{2})", 1), "yyyy-MM-dd")


def slot_date_is_past(slot_date: Column, now: Column, tz: str = ZONE) -> Column:
    return F.coalesce(F.try_to_date(slot_date, "yyyy-MM-dd") < F.to_date(F.from_utc_timestamp(now, tz)), F.lit(False))


def retry_offsets(delay: int = 60, retries: str = "90,120") -> list[int]:
    """Minutes after airtime at which a bulletin is looked for."""
    more = [int(x) for x in retries.split(",") if x.strip().isdigit()]
    return sorted({x for x in (delay, *more) if x > 0})
