"""Whole searches, composed of operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressglass.functions import text as T
from pressglass.functions import times
from pressglass.operators import hits, match, merge, policy
from pressglass.operators.slots import attach_channel


def press_search(docs: DataFrame, keywords: DataFrame, snippet_for: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, labels, snippet for every document with a match, row by row: rows of one id, or without one, have their own."""
    found = match.labelled(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), keywords)
    return found.select(F.col("id").alias(id_col), "labels", T.snippet(F.col("text"), snippet_for).alias("snippet"))


def _by_keyword(located: DataFrame) -> DataFrame:
    """video_id, keyword_hits of located hits in the stored form; a keyword in two languages has the hits of both."""
    full = F.transform_values("keyword_hits", lambda k, v: F.transform(v, lambda h: F.struct(h["start"].alias("start"), h["end"].alias("end"), h["excerpt"].alias("excerpt"), F.lit(1.0).alias("confidence"), F.lit(None).cast("string").alias("screenshot"))))
    return hits.hits_map(located).select("video_id", full.alias("keyword_hits"))


def _mentions(located: DataFrame, info: DataFrame, schema: str, module: str = "youtube") -> DataFrame:
    """One mention per video from located hits; info: video_id, source, section, title, url, published_at."""
    names = [c.split()[0] for c in ["id long", "module", "external_id"]]
    per = _by_keyword(located).withColumn("matched_keywords", F.array_sort(F.map_keys("keyword_hits")))
    rows = per.join(info, "video_id")
    lead = F.get(F.element_at("keyword_hits", F.get("matched_keywords", F.lit(0))), F.lit(0))
    out = rows.select(F.lit(None).cast("long").alias(names[0]), F.lit(module).alias("module"), F.col("video_id").alias("external_id"), "source", "section", "title", "url", times.deep_link(F.col("url"), lead["start"]).alias("deeplink"), lead["excerpt"].alias("snippet"), "published_at", "matched_keywords", "keyword_hits")
    return out.sparkSession.createDataFrame([], schema).unionByName(out, allowMissingColumns=True)


def rematch(mentions: DataFrame, transcripts: DataFrame, keywords: DataFrame, channels: DataFrame, now: Column, schema: str, bulletins: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The watchlist applied to cached transcripts: search window, prefilter, location, merge. Returns mentions and alerts."""
    recent = policy.within_search(transcripts, now, time=F.col("created_at"))
    texts = recent.select("video_id", F.coalesce(F.nullif(hits.segments_text(F.col("segments")), F.lit("")), "text").alias("text"))
    keep = match.prefilter_candidates(texts, keywords, "video_id").select("video_id")
    near = recent.join(keep, "video_id", "left_semi")
    located = hits.locate_hits(near.select("video_id", "segments"), keywords)
    info = attach_channel(near, channels, bulletins).select("video_id", F.col("channel_name").alias("source"), F.col("slot_label").alias("section"), F.col("channel_name").alias("title"), F.concat(F.lit("https://www.youtube.com/watch?v="), "video_id").alias("url"), F.col("created_at").alias("published_at"))
    return merge.merge_mentions(mentions, _mentions(located, info, schema))


def repair_mentions(mentions: DataFrame, transcripts: DataFrame, keywords: DataFrame) -> DataFrame:
    """Stored labels that are still active located again in their transcript; other mentions only pruned."""
    wanted = mentions.select(F.col("external_id").alias("video_id"), F.explode("matched_keywords").alias("keyword"))
    located = hits.locate_hits(transcripts.join(wanted.select("video_id").distinct(), "video_id", "left_semi").select("video_id", "segments"), keywords).join(wanted, ["video_id", "keyword"])
    per = _by_keyword(located).withColumnRenamed("keyword_hits", "_new")
    rows = mentions.join(per.withColumnRenamed("video_id", "external_id"), "external_id", "left")
    rows = rows.withColumn("keyword_hits", F.coalesce("_new", "keyword_hits")).select(*mentions.columns)
    return hits.prune_hits(rows).where(F.size("matched_keywords") > 0)


def period_scan(uploads: DataFrame, transcripts: DataFrame, keywords: DataFrame, low: Column, high: Column, label: str, schema: str, tz: str = times.ZONE) -> tuple[DataFrame, DataFrame]:
    """Mentions of every upload in a period that isn't live, and the uploads that lack a transcript."""
    period = policy.published_between(uploads, low, high)
    todo = period.join(transcripts.select("video_id").distinct(), "video_id", "left_anti")
    located = hits.locate_hits(transcripts.join(period.select("video_id").distinct(), "video_id", "left_semi").select("video_id", "segments"), keywords)
    info = period.select("video_id", F.col("channel_id").alias("source"), F.concat(F.lit("Period · "), F.lit(label)).alias("section"), "title", "url", F.col("published").alias("published_at"))
    return _mentions(located, info, schema), todo


def edition_rematch(pages: DataFrame, keywords: DataFrame, today: str, days: int = 3) -> DataFrame:
    """page key, keyword: new keywords on pages of the last days."""
    recent = pages.where((F.to_date("date") > F.date_sub(F.to_date(F.lit(today)), days)) & (F.to_date("date") <= F.to_date(F.lit(today))))
    keyed = recent.select(F.struct("paper", "city", "date", "page_no").alias("page"), F.coalesce("text", F.array_join(F.transform("regions", lambda r: r["text"]), "\n\n")).alias("text"))
    return match.match_documents(keyed, keywords, "page")
