"""Scheduled bulletins: expected slots, scoring of uploads, the best one, their states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressglass.functions import times
from pressglass.sizes import small

WINDOW_MIN, MARGIN, MISSING_MIN, CLAIM_S = 90, 0.75, 180, 1200
# Words of bulletin titles; canonical slots (time, label).
BULLETIN_WORDS = ("headline", "headlines", "bulletin", "news bulletin", "breaking news", "headlines bulletin", "news headlines")
CANONICAL = (("00:00:00", "Midnight"), ("06:00:00", "6 AM"), ("09:00:00", "9 AM"), ("12:00:00", "12 PM"), ("15:00:00", "3 PM"), ("18:00:00", "6 PM"), ("21:00:00", "9 PM"))
GENERIC_RULES = ("headline", "headlines", "bulletin", "news")


def looks_like_bulletin(title: Column, duration: Column, live: Column, least: int = 120) -> Column:
    low = F.lower(F.coalesce(title, F.lit("")))
    named = F.lit(False)
    for w in BULLETIN_WORDS:
        named |= F.contains(low, F.lit(w))
    news = F.contains(low, F.lit("news")) & low.rlike("am|pm|bulletin|headline")
    return ~F.coalesce(live, F.lit(False)) & (F.coalesce(duration, F.lit(least)) >= least) & (named | times.title_has_time(title) | news)


def snap_to_slot(minutes: Column, within: int = 90) -> Column:
    """struct(slot, label) of the nearest canonical slot on the clock's circle, the first of equals; null beyond `within` minutes."""
    each = []
    for i, (at, label) in enumerate(CANONICAL):
        m = int(at[:2]) * 60 + int(at[3:5])
        d = F.abs(minutes - m)
        each.append(F.struct(F.least(d, 1440 - d).alias("d"), F.lit(i).alias("i"), F.lit(at).alias("slot"), F.lit(label).alias("label")))
    best = F.array_min(F.array(*each))
    return F.when(best["d"] <= within, F.struct(best["slot"].alias("slot"), best["label"].alias("label")))


def detect_slots(uploads: DataFrame, now: Column, tz: str = times.ZONE, days: int = 21, top: int = 5) -> DataFrame:
    """channel_id, slot, label, n, example: the usual times of a channel's bulletins, the most frequent five."""
    recent = uploads.where((F.col("published") >= now - F.make_dt_interval(days=F.lit(days))) & looks_like_bulletin(F.col("title"), F.col("duration_seconds"), F.col("live")))
    local = F.from_utc_timestamp("published", tz)
    snapped = recent.select("channel_id", "title", "published", snap_to_slot(F.hour(local) * 60 + F.minute(local)).alias("s")).where("s is not null")
    per = snapped.groupBy("channel_id", F.col("s.slot").alias("slot"), F.col("s.label").alias("label")).agg(F.count("*").alias("n"), F.left(F.min_by("title", F.struct("published", "title")), F.lit(120)).alias("example"))
    rank = F.row_number().over(Window.partitionBy("channel_id").orderBy(F.desc("n"), "slot"))
    return per.withColumn("_n", rank).where(F.col("_n") <= top).drop("_n")


def slot_effective(slots: DataFrame, day: Column) -> DataFrame:
    return slots.where((F.coalesce("effective_from", day) <= day) & (F.coalesce("effective_to", day) >= day))


def expected_bulletins(channels: DataFrame, slots: DataFrame, days: DataFrame, existing: DataFrame) -> DataFrame:
    """channel_id, slot_id, slot_date for active channels and enabled slots on each day (few rows), without those that exist."""
    pairs = slots.where("enabled").join(small(channels.where("active").select("channel_id")), "channel_id", "left_semi")
    rows = pairs.join(small(days.select(F.col("day").alias("slot_date"))), (F.coalesce("effective_from", "slot_date") <= F.col("slot_date")) & (F.coalesce("effective_to", "slot_date") >= F.col("slot_date")))
    return rows.select("channel_id", "slot_id", "slot_date").join(existing.select("channel_id", "slot_id", "slot_date").distinct(), ["channel_id", "slot_id", "slot_date"], "left_anti")


def uploads_for_slot_day(uploads: DataFrame, day: str, tz: str = times.ZONE) -> DataFrame:
    """Per channel, uploads from four hours before the local day to four after; a channel without any keeps all it has."""
    start = F.to_utc_timestamp(F.lit(day).cast("timestamp"), tz)
    inside = F.coalesce(F.col("published").between(start - F.expr("interval 4 hours"), start + F.expr("interval 28 hours")), F.lit(False))
    some = uploads.where(inside).select("channel_id").distinct()
    rest = uploads.join(some, "channel_id", "left_anti")
    return uploads.where(inside).unionByName(rest)


def score_uploads(pairs: DataFrame, tz: str = times.ZONE, window: int = WINDOW_MIN) -> DataFrame:
    """pairs of slots and uploads -> those that may be it, with score and reasons.

    Needs: title, duration_seconds, live, published, slot_date, local_time, title_rules, min_duration_sec, max_duration_sec.
    """
    d, low = F.col("duration_seconds"), F.lower(F.coalesce("title", F.lit("")))
    air = times.slot_airtime(F.col("slot_date"), F.col("local_time"), tz)
    rows = pairs.where(~F.coalesce("live", F.lit(False)) & (d.isNull() | d.between(F.coalesce("min_duration_sec", F.lit(120)), F.coalesce("max_duration_sec", F.lit(3600)))))
    rows = rows.withColumn("_air", air).withColumn("_n", F.size(F.filter("title_rules", lambda r: F.contains(low, F.lower(r)))))
    rows = rows.withColumn("_hours", times.title_hours(F.col("title"))).withColumn("_off", F.abs(F.unix_timestamp("published") - F.unix_timestamp("_air")) / 60)
    air_hour = F.hour(F.from_utc_timestamp("_air", tz))
    length = F.when(d.between(300, 1800), 2.0).when(d <= 2400, 1.0).otherwise(0.0)
    rules = F.least(F.lit(4.0), 1.5 * F.col("_n"))
    word = F.when(low.rlike("headlines?|bulletin"), 2.0).otherwise(0.0)
    hours = F.when(F.size("_hours") == 0, 0.0).when(F.array_contains("_hours", air_hour), 4.0).otherwise(-4.0)
    near = F.when(F.col("_off") <= window, 3 + 2 * (1 - F.col("_off") / window)).when(F.col("_off") <= 2 * window, 1.0).otherwise(0.0)
    day = F.when(times.same_slot_date(F.col("published"), F.col("slot_date"), F.col("local_time"), tz), 1.0).otherwise(0.0)
    part = {"duration": length, "title rules": rules, "bulletin title": word, "title hour": hours, "publish time": near, "slot date": day}
    reasons = F.filter(F.array(*[F.when(v != 0, F.lit(k)) for k, v in part.items()]), lambda r: r.isNotNull())
    total = sum(part.values(), F.lit(0.0))
    rows = rows.withColumn("score", total).withColumn("reasons", reasons)
    far = F.coalesce(F.col("_off") > 2 * window, F.lit(False)) & (F.col("_n") == 0)
    return rows.where((F.col("score") > 0) & ~far).drop("_air", "_n", "_hours", "_off")


def classify_uploads(uploads: DataFrame, slots: DataFrame, tz: str = times.ZONE) -> DataFrame:
    """slots (with slot_date) joined with their channel's uploads of the day, scored; where none is of the day, with
    all that the channel has."""
    u = uploads.withColumnRenamed("channel_id", "_channel")
    start = F.to_utc_timestamp(F.col("slot_date").cast("timestamp"), tz)
    near = F.col("published").between(start - F.expr("interval 4 hours"), start + F.expr("interval 28 hours"))
    dated = slots.join(u, (F.col("channel_id") == F.col("_channel")) & near).drop("_channel")
    key = ["channel_id", "slot_date"]
    bare = slots.join(dated.select(*key).distinct(), key, "left_anti")
    rest = bare.join(u, F.col("channel_id") == F.col("_channel")).drop("_channel")
    return score_uploads(dated.unionByName(rest), tz)


def pick_best(scored: DataFrame, by: list[str], order: list, margin: float = MARGIN) -> DataFrame:
    """Per key its first row with `winner` (null where the runner-up is too near) and needs_review."""
    w = Window.partitionBy(*by).orderBy(F.desc("score"), *order)
    rows = scored.withColumn("_n", F.row_number().over(w)).withColumn("_next", F.lead("score").over(w)).where("_n = 1")
    review = F.coalesce(F.col("score") - F.col("_next") < margin, F.lit(False))
    return rows.withColumn("needs_review", review).drop("_n", "_next")


def top_candidates(scored: DataFrame, by: list[str], order: list, n: int = 8, fields: tuple[str, ...] = ("video_id", "title", "score", "reasons")) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), *order))
    best = scored.withColumn("_n", rank).where(F.col("_n") <= n)
    return best.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", *fields))), lambda x: F.struct(*[x[f].alias(f) for f in fields])).alias("candidates"))


def is_due(bulletins: DataFrame, now: Column, offsets: list[int] | None = None, tz: str = times.ZONE) -> DataFrame:
    """Bulletins to look for now: not final (unless their transcription is open), and late enough for their attempt."""
    steps = F.array(*[F.lit(x) for x in (offsets or times.retry_offsets())])
    elapsed = (F.unix_timestamp(now) - F.unix_timestamp(times.slot_airtime(F.col("slot_date"), F.col("local_time"), tz))) / 60
    final = F.coalesce("discovery_status", F.lit("")).isin("ready", "no_match", "missing", "needs_review")
    reopened = F.col("transcription_status").isin("pending", "failed")
    need = F.element_at(steps, F.least(F.coalesce("attempts", F.lit(0)) + 1, F.size(steps)))
    return bulletins.where((~final | reopened) & (elapsed >= F.element_at(steps, 1)) & (elapsed >= need))


def past_missing_deadline(bulletins: DataFrame, now: Column, tz: str = times.ZONE, minutes: int = MISSING_MIN) -> DataFrame:
    return bulletins.where((F.unix_timestamp(now) - F.unix_timestamp(times.slot_airtime(F.col("slot_date"), F.col("local_time"), tz))) / 60 >= minutes)


def needs_transcription(videos: DataFrame, transcripts: DataFrame, now: Column) -> DataFrame:
    """Videos without a transcript, with a stub of metadata, or whose claim (transcriber `transcribing`) is 20 minutes old or more.

    A claim without a time is fresh; a real transcript isn't made again, even an empty one.
    """
    marker = F.lower(F.coalesce("transcriber", F.lit("")))
    stub = (marker == "metadata") | (F.col("model") == "metadata")
    t = transcripts.select("video_id", (marker == "transcribing").alias("_claim"), F.coalesce(stub, F.lit(False)).alias("_stub"), F.col("created_at").alias("_at"))
    t = t.groupBy("video_id").agg(F.max("_claim").alias("_claim"), F.min("_stub").alias("_stub"), F.max("_at").alias("_at"))
    stale = F.coalesce(F.unix_timestamp(now) - F.unix_timestamp("_at") >= CLAIM_S, F.lit(False))
    need = F.when(F.col("_claim").isNull(), True).when(F.col("_claim"), stale).otherwise(F.col("_stub"))
    return videos.join(t, "video_id", "left").where(need).select(*videos.columns)


def bulletin_status(discovery: Column, transcription: Column) -> Column:
    names = {"discovering": "discovering", "ready": "ready", "no_match": "no keyword match", "missing": "late/missing", "failed": "failed", "needs_review": "needs review"}
    out = F.when((discovery == "transcribing") | (transcription == "running"), "transcribing")
    for k, v in names.items():
        out = out.when(discovery == k, v)
    return out.otherwise("waiting")


def latest_slot_status(bulletins: DataFrame, channels: DataFrame, now: Column, tz: str = times.ZONE) -> DataFrame:
    """Per active channel its latest bulletin that has aired (five minutes of grace), else its last one, else a waiting row."""
    air = times.slot_airtime(F.col("slot_date"), F.col("local_time"), tz)
    today = F.to_date("slot_date") == F.to_date(F.from_utc_timestamp(now, tz))
    ahead = today & (air > now + F.expr("interval 5 minutes"))
    rows = bulletins.withColumn("_air", air).withColumn("_n", F.row_number().over(Window.partitionBy("channel_id").orderBy(ahead.asc(), air.desc(), "bulletin_id"))).where("_n = 1")
    status = bulletin_status(F.col("discovery_status"), F.col("transcription_status"))
    rows = rows.select("channel_id", "bulletin_id", "local_time", status.alias("status"))
    return channels.where("active").select("channel_id", "name").join(rows, "channel_id", "left").withColumn("status", F.coalesce("status", F.lit("waiting")))


def bulletins_with_dims(bulletins: DataFrame, channels: DataFrame, slots: DataFrame, day: str) -> DataFrame:
    """A day's bulletins that have a video, with channel and slot, by time."""
    own = bulletins.where((F.col("slot_date") == day) & F.col("video_id").isNotNull())
    out = own.join(small(channels.select("channel_id", "name")), "channel_id").join(small(slots.select("slot_id", "local_time", "label")), "slot_id")
    return out.orderBy("local_time", "bulletin_id")


def transcripts_for_slots(transcripts: DataFrame, bulletins: DataFrame, day: str, local_times: list[str] | None = None) -> DataFrame:
    """Transcripts of a day's bulletins, by bulletin or by video; with times, of those slots and by bulletin only."""
    own = bulletins.where(F.col("slot_date") == day)
    if local_times:
        return transcripts.join(own.where(F.col("local_time").isin(local_times)).select("bulletin_id").distinct(), "bulletin_id", "left_semi")
    by_slot = transcripts.join(own.select("bulletin_id").distinct(), "bulletin_id", "left_semi")
    by_video = transcripts.join(own.where("video_id is not null").select("video_id").distinct(), "video_id", "left_semi")
    # A transcript may come by both ways.
    return by_slot.unionByName(by_video.select(*by_slot.columns).join(by_slot.select("video_id"), "video_id", "left_anti").select(*by_slot.columns))


def transcripts_in_period(transcripts: DataFrame, mentions: DataFrame, low: Column, high: Column) -> DataFrame:
    """By the publish time of the video's mention, else by when the transcript was made."""
    when = mentions.groupBy(F.col("external_id").alias("video_id")).agg(F.min("published_at").alias("_at"))
    rows = transcripts.join(when, "video_id", "left")
    return rows.where(F.coalesce("_at", "created_at").between(low, high)).drop("_at")


def attach_channel(transcripts: DataFrame, channels: DataFrame, bulletins: DataFrame | None = None) -> DataFrame:
    """Transcripts of known channels with the channel's name and their slot's label, Cached where they have none."""
    out = transcripts.join(small(channels.select("channel_id", F.col("name").alias("channel_name"))), "channel_id")
    if bulletins is None:
        return out.withColumn("slot_label", F.lit("Cached"))
    return out.join(bulletins.select("bulletin_id", F.col("label").alias("slot_label")), "bulletin_id", "left").withColumn("slot_label", F.coalesce("slot_label", F.lit("Cached")))


def scan_summary(bulletins: DataFrame, by: list[str] | None = None, mentions: DataFrame | None = None, alerts: DataFrame | None = None) -> DataFrame:
    """Counters of a run: channels, checked, discovered, transcribed, mentions, alerts, missing, failed, needs_review, cost_usd_est.

    mentions and alerts (external_id) are counted by the bulletin whose video they are of; the cost is that of
    transcribed bulletins with a duration (columns duration_seconds, model; without them it is 0).
    """
    from pressglass.operators.hits import transcription_cost

    rows = bulletins
    for name, found in (("_mentions", mentions), ("_alerts", alerts)):
        if found is None:
            rows = rows.withColumn(name, F.lit(0))
        else:
            per = found.groupBy(F.col("external_id").alias("video_id")).agg(F.count("*").alias(name))
            rows = rows.join(per, "video_id", "left")
    s, done = F.col("discovery_status"), F.col("transcription_status") == "done"
    priced = {"duration_seconds", "model"} <= set(bulletins.columns)
    cost = F.when(done & F.col("duration_seconds").isNotNull(), transcription_cost(F.col("duration_seconds"), F.coalesce("model", F.lit("")))) if priced else F.lit(0.0)
    return rows.groupBy(*(by or [])).agg(
        F.count_distinct("channel_id").alias("channels"), F.count("*").alias("checked"), F.count_if(F.col("video_id").isNotNull()).alias("discovered"), F.count_if(done).alias("transcribed"),
        F.coalesce(F.sum("_mentions"), F.lit(0)).alias("mentions"), F.coalesce(F.sum("_alerts"), F.lit(0)).alias("alerts"), F.count_if(s == "missing").alias("missing"), F.count_if(s == "failed").alias("failed"),
        F.count_if(s == "needs_review").alias("needs_review"), F.round(F.coalesce(F.sum(cost), F.lit(0.0)), 6).alias("cost_usd_est"),
    )


def channel_probe_summary(uploads: DataFrame, channels: DataFrame, now: Column, tz: str = times.ZONE) -> DataFrame:
    """channel_id, checked, bulletin_like, slots (labels), already_added, ok."""
    like = looks_like_bulletin(F.col("title"), F.col("duration_seconds"), F.col("live"))
    base = uploads.groupBy("channel_id").agg(F.count("*").alias("checked"), F.count_if(like).alias("bulletin_like"))
    found = detect_slots(uploads, now, tz).groupBy("channel_id").agg(F.array_sort(F.collect_list("slot")).alias("slots"))
    known = small(channels.select("channel_id", F.lit(True).alias("_known")))
    out = base.join(found, "channel_id", "left").join(known, "channel_id", "left")
    none = F.array().cast("array<string>")
    return out.select("channel_id", "checked", "bulletin_like", F.coalesce("slots", none).alias("slots"), F.coalesce("_known", F.lit(False)).alias("already_added"), (F.size(F.coalesce("slots", none)) > 0).alias("ok"))


def run_note(uploads: Column, audio: Column, transcripts: Column, hits: Column) -> Column:
    """Why a run found nothing."""
    return F.when(hits > 0, "").when(uploads == 0, "No uploads in this period").when(audio == 0, "No audio could be read").when(transcripts == 0, "No transcript was made").otherwise("The keywords were not spoken")
