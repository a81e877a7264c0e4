"""Quotas, retention, counts, media."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressglass.sizes import small

LIMIT, RETENTION_DAYS, SEARCH_DAYS = 25, 90, 90
CACHED_TEXT_DAYS, LOG_DAYS = 365, 730


def effective_time(now: Column, published: str = "published_at", detected: str = "detected_at") -> Column:
    return F.coalesce(published, detected, now)


def _since(days: int, now: Column) -> Column:
    return now - F.make_dt_interval(days=F.lit(days))


def within_retention(df: DataFrame, now: Column, days: int = RETENTION_DAYS, time: Column | None = None) -> DataFrame:
    return df.where((effective_time(now) if time is None else time) >= _since(days, now))


def within_search(df: DataFrame, now: Column, days: int = SEARCH_DAYS, time: Column | None = None) -> DataFrame:
    return within_retention(df, now, days, time)


def published_between(df: DataFrame, low: Column, high: Column, time: str = "published", live: str | None = "live") -> DataFrame:
    """Both ends count; rows without a time and live rows don't."""
    out = df.where(F.col(time).between(low, high))
    return out.where(~F.coalesce(live, F.lit(False))) if live else out


def keep_on_date_or_unknown(df: DataFrame, day: Column, published: str = "published_on") -> DataFrame:
    return df.where(F.coalesce(F.col(published) == day, F.lit(True)))


def not_before(df: DataFrame, floor: str = "2026-01-01", col: str = "date") -> DataFrame:
    """Editions from the day on which monitoring began; ISO dates compare as strings."""
    return df.where(F.col(col) >= floor)


def keyword_counts(mentions: DataFrame, wanted: DataFrame) -> DataFrame:
    """keyword (lower case), n for every wanted one: mentions that have it, each counted once; 0 where none has."""
    labels = mentions.select(F.explode(F.array_distinct(F.transform("matched_keywords", lambda k: F.lower(k)))).alias("keyword"))
    counts = labels.groupBy("keyword").agg(F.count("*").alias("n"))
    return wanted.select(F.lower("text").alias("keyword")).distinct().join(counts, "keyword", "left").select("keyword", F.coalesce("n", F.lit(0)).alias("n"))


def all_full(counts: DataFrame, limit: int = LIMIT) -> DataFrame:
    return counts.agg((F.coalesce(F.every(F.col("n") >= limit), F.lit(False)) & (F.count("*") > 0)).alias("all_full"))


def admit_new(candidates: DataFrame, existing: DataFrame, counts: DataFrame, limit: int = LIMIT) -> DataFrame:
    """candidates (module, external_id, keyword, pos) that are new, while their keyword has room, in order of pos."""
    key = ["module", "external_id", "fold"]
    fresh = candidates.withColumn("fold", F.lower("keyword")).join(existing.select("module", "external_id", F.lower("keyword").alias("fold")).distinct(), key, "left_anti")
    fresh = fresh.withColumn("first", F.row_number().over(Window.partitionBy(*key).orderBy("pos"))).where("first = 1")
    # Of a keyword's backlog only the first `limit` rows can be admitted, so they alone are ranked together.
    order = ["pos", "module", "external_id"]
    near = quota_ranks(fresh.drop("first"), ["fold"], order, limit).where("kept").drop("kept")
    ranked = near.withColumn("n_new", F.row_number().over(Window.partitionBy("fold").orderBy(*order)))
    have = small(counts.select(F.col("keyword").alias("fold"), F.col("n").alias("n_old")))
    return ranked.join(have, "fold", "left").where(F.col("n_new") + F.coalesce("n_old", F.lit(0)) <= limit).select("module", "external_id", "keyword", "pos")


def quota_ranks(labels: DataFrame, by: list[str], order: list, limit: int) -> DataFrame:
    """labels with `kept`: whether a row is among the first `limit` of its group.

    A hot group is cut down in SALTS parts first: only rows that are in the first `limit` of their part can be in the whole's,
    so no task sees more than SALTS * limit rows of one group in the second step.
    """
    part = F.pmod(F.xxhash64(*labels.columns), F.lit(SALTS))
    first = labels.withColumn("_part", part).withColumn("_n", F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order)))
    near = first.where(F.col("_n") <= limit).withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    kept = near.withColumn("kept", F.col("_n") <= limit)
    return kept.unionByName(first.where(F.col("_n") > limit).withColumn("kept", F.lit(False))).drop("_n", "_part")


SALTS = 32


def enforce_limits(mentions: DataFrame, now: Column, limit: int = LIMIT, delete_expired: bool = True) -> DataFrame:
    """Mentions after expiry and quotas, with `n_trimmed`.

    Newest first, each keyword keeps `limit` mentions per module; expired mentions use none.  A label beyond it goes, with
    its media; the screenshot becomes the first media left, or for print pages without any the full page.  Mentions
    without labels go.  Ties are in order of id.
    """
    module = F.coalesce(F.nullif(F.col("module"), F.lit("")), F.lit("newspaper"))
    live = mentions.withColumn("_eff", effective_time(now))
    if delete_expired:
        live = live.where(F.col("_eff") >= _since(RETENTION_DAYS, now))
    labels = live.select("id", "_eff", module.alias("_module"), F.posexplode("matched_keywords").alias("pos", "label")).where("label != ''").withColumn("fold", F.lower("label"))
    ranked = quota_ranks(labels, ["fold", "_module"], [F.desc("_eff"), "id", "pos"], limit)
    per = ranked.groupBy("id").agg(F.array_sort(F.collect_list(F.when(F.col("kept"), F.struct("pos", "label")))).alias("_keep"), F.collect_set(F.when(~F.col("kept"), F.col("fold"))).alias("_gone"), F.count_if(~F.col("kept")).cast("int").alias("n_trimmed"))
    rows = live.join(per, "id").where(F.size("_keep") > 0)
    cut = F.size("_gone") > 0
    media = F.when(cut, F.map_filter("keyword_media", lambda k, v: ~F.array_contains("_gone", F.lower(k)))).otherwise(F.col("keyword_media"))
    rows = rows.withColumn("_media", media)
    left = F.size(F.coalesce("_media", F.create_map().cast("map<string,string>")))
    shot = F.when(cut & (left > 0), F.get(F.map_values("_media"), F.lit(0))).when(cut & (F.col("module") == "epaper") & F.col("full_screenshot_path").isNotNull(), F.col("full_screenshot_path")).otherwise(F.col("screenshot_path"))
    out = rows.withColumn("screenshot_path", shot).withColumn("keyword_media", F.col("_media")).withColumn("matched_keywords", F.when(cut, F.transform("_keep", lambda x: x["label"])).otherwise(F.col("matched_keywords")))
    return out.select(*mentions.columns, "n_trimmed")


def limit_counts(before: DataFrame, after: DataFrame, now: Column) -> DataFrame:
    """One row: expired, trimmed (labels that went beyond the quota), deleted (mentions that lost all of theirs)."""
    labels = F.size(F.filter("matched_keywords", lambda k: k != ""))
    live = effective_time(now) >= _since(RETENTION_DAYS, now)
    b = before.agg(F.count_if(~live).alias("expired"), F.count_if(live).alias("n"), F.sum(F.when(live, labels)).alias("labels"))
    a = after.agg(F.count("*").alias("n_after"), F.sum(labels).alias("labels_after"))
    none = F.lit(0)
    return b.crossJoin(a).select("expired", (F.coalesce("labels", none) - F.coalesce("labels_after", none)).cast("long").alias("trimmed"), (F.col("n") - F.col("n_after")).alias("deleted"))


def media_paths(mentions: DataFrame) -> DataFrame:
    """Every path that a mention refers to."""
    every = F.concat(F.array("screenshot_path", "full_screenshot_path"), F.coalesce(F.map_values("keyword_media"), F.array().cast("array<string>")))
    return mentions.select(F.explode(every).alias("path")).where("path is not null and path != ''").distinct()


def orphan_media(before: DataFrame, after: DataFrame, pages: DataFrame) -> DataFrame:
    """Paths that were referred to, and now are by no mention and no page."""
    used = media_paths(after).union(pages.select(F.col("image_path").alias("path"))).where("path is not null").distinct()
    return media_paths(before).join(used, "path", "left_anti")


def pages_missing_media(mentions: DataFrame) -> DataFrame:
    """id, keywords with hits but without media."""
    none = F.array().cast("array<string>")
    missing = F.array_except(F.coalesce(F.map_keys("keyword_hits"), none), F.coalesce(F.map_keys("keyword_media"), none))
    return mentions.select("id", F.array_sort(missing).alias("missing")).where(F.size("missing") > 0)


def backfill_candidates(mentions: DataFrame, newest: int = 400, most: int = 40) -> DataFrame:
    """The first entries (id, keyword, start) without media among the newest mentions; entries without a start are skipped."""
    recent = mentions.orderBy(F.desc("id")).limit(newest).select("id", F.coalesce("keyword_media", F.create_map().cast("map<string,string>")).alias("_media"), F.explode("keyword_hits").alias("keyword", "_hits"))
    flat = recent.where(~F.map_contains_key("_media", F.col("keyword"))).select("id", "keyword", F.get("_hits", F.lit(0))["start"].alias("start"))
    return flat.where("start is not null").orderBy(F.desc("id"), "keyword").limit(most)


def attach_media(mentions: DataFrame, media: DataFrame) -> DataFrame:
    """media: id, keyword, path. Paths for keywords that lack one, the first of several; the keyword's first hit with a start
    gets it as its screenshot."""
    one = media.where("keyword is not null and path is not null").groupBy("id", "keyword").agg(F.min("path").alias("path"))
    per = one.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("keyword", "path")))).alias("_new"))
    rows = mentions.join(per, "id", "left").withColumn("_new", F.coalesce("_new", F.create_map().cast("map<string,string>")))
    have = F.coalesce("keyword_media", F.create_map().cast("map<string,string>"))
    usable = F.map_filter("_new", lambda k, v: ~F.map_contains_key(have, k) & F.coalesce(F.get(F.try_element_at("keyword_hits", k), F.lit(0))["start"].isNotNull(), F.lit(False)))
    rows = rows.withColumn("_use", usable)
    hits = F.transform_values("keyword_hits", lambda k, v: F.transform(v, lambda h, i: F.when((i == 0) & F.map_contains_key("_use", k), h.withField("screenshot", F.element_at("_use", k))).otherwise(h)))
    rows = rows.withColumn("keyword_hits", hits).withColumn("keyword_media", F.map_concat(have, "_use"))
    rows = rows.withColumn("screenshot_path", F.coalesce("screenshot_path", F.get(F.map_values("_use"), F.lit(0))))
    return rows.select(*mentions.columns)


def prune_retention(tables: dict[str, DataFrame], now: Column) -> dict[str, DataFrame]:
    """screenshots (taken_at) 90 days, cache (fetched_at) 365, logs (started_at) 730."""
    rules = {"screenshots": ("taken_at", RETENTION_DAYS), "cache": ("fetched_at", CACHED_TEXT_DAYS), "logs": ("started_at", LOG_DAYS)}
    return {k: df.where(F.col(rules[k][0]) >= _since(rules[k][1], now)) if k in rules else df for k, df in tables.items()}


def daily_digest(mentions: DataFrame, now: Column, sentiments: tuple[str, ...] = ("Positive", "Negative", "Neutral")) -> DataFrame:
    """source, one count for each sentiment, over the last 24 hours."""
    recent = mentions.where((F.col("detected_at") > _since(1, now)) & (F.col("detected_at") <= now))
    return recent.groupBy("source").pivot("sentiment", list(sentiments)).count().na.fill(0)


def list_mentions(mentions: DataFrame, keyword: str | None, limit: int = 50) -> DataFrame:
    out = mentions.where(F.exists("matched_keywords", lambda k: F.lower(k) == keyword.lower())) if keyword else mentions
    return out.orderBy(F.desc_nulls_last("published_at"), F.desc("id")).limit(limit)
