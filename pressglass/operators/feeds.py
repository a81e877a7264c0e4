"""Feeds, cards, caps and alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressglass.functions import text as T
from pressglass.functions import times
from pressglass.operators.hits import verify_hits
from pressglass.operators.policy import quota_ranks
from pressglass.storage import written

MODULE_LABELS = {"newspaper": "Web", "epaper": "E-Paper", "youtube": "YouTube"}


def cap_per_source(df: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each source; a source with most rows is cut in parts first."""
    return quota_ranks(df, by, order, n).where("kept").drop("kept")


def cap_hits(hits: DataFrame, per_page: int = 4, per_source: int = 24) -> DataFrame:
    """hits (source, page_no, region_no, ...): the first ones of each page and source in order; `capped`: whether the source lost any."""
    page = F.row_number().over(Window.partitionBy("source", "page_no").orderBy("region_no"))
    total = hits.groupBy("source").agg(F.count("*").alias("_all"))
    some = hits.withColumn("_p", page).where(F.col("_p") <= per_page).drop("_p")
    kept = quota_ranks(some, ["source"], ["page_no", "region_no"], per_source).where("kept").drop("kept")
    left = kept.groupBy("source").agg(F.count("*").alias("_left"))
    return kept.join(total.join(left, "source").select("source", (F.col("_left") < F.col("_all")).alias("capped")), "source")


def order_bulletins(bulletins: DataFrame) -> DataFrame:
    return bulletins.orderBy(F.desc("slot_date"), F.asc("bulletin_id"))


def list_keywords(keywords: DataFrame, module: str | None = None) -> DataFrame:
    out = keywords.where(F.col("module") == module) if module else keywords
    return out.orderBy(F.desc("created_at"), F.desc("id"))


def mention_cards(mentions: DataFrame, keyword: str | None = None, tz: str = times.ZONE) -> DataFrame:
    """Feed rows: label of the module, source, section (video only), local time, verified seconds by keyword, snippet, image."""
    module = F.col("module")
    label = F.coalesce(*[F.when(module == k, v) for k, v in MODULE_LABELS.items()], module)
    good = F.transform_values(F.coalesce("keyword_hits", F.create_map().cast("map<string,array<struct<start:int,end:int,excerpt:string,confidence:double,screenshot:string>>>")), lambda k, v: verify_hits(v, k, T.script_language(k)))
    media = F.coalesce("keyword_media", F.create_map().cast("map<string,string>"))
    want = F.lit(keyword) if keyword else F.get("matched_keywords", F.lit(0))
    rows = mentions.withColumn("_good", good).withColumn("_want", want)
    own = F.try_element_at(media, F.col("_want"))
    fallback = F.when((module == "epaper") & (F.size("matched_keywords") > 1), F.coalesce("full_screenshot_path", "screenshot_path")).otherwise(F.coalesce("screenshot_path", "full_screenshot_path"))
    line = F.array_join(F.transform(F.array_sort(F.map_keys(F.map_filter("_good", lambda k, v: F.size(v) > 0))), lambda k: F.concat(k, F.lit(" "), F.array_join(F.transform(F.element_at("_good", k), lambda h: times.card_time(h["start"])), ","))), "; ")
    lead = F.get(F.try_element_at("_good", F.col("_want")), F.lit(0))["excerpt"]
    return rows.select(
        "id", label.alias("module"), "source", F.when(module == "youtube", F.col("section")).alias("section"), "title",
        F.date_format(F.from_utc_timestamp(F.coalesce("published_at", "detected_at"), tz), "yyyy-MM-dd HH:mm").alias("local_time"),
        line.alias("timestamps"), F.coalesce(lead, "snippet").alias("snippet"), T.media_path(F.coalesce(own, fallback)).alias("image"), F.coalesce("deeplink", "url").alias("link"), "sentiment",
    )


def format_alert() -> Column:
    """Labelled lines of a mention, blank ones skipped; the link to the second, else the page."""
    part = lambda name, c: F.when(F.coalesce(F.trim(c), F.lit("")) != "", F.concat(F.lit(f"{name}: "), c))
    return F.concat_ws("\n", part("Keywords", F.array_join("matched_keywords", ", ")), part("Source", F.col("source")), part("Section", F.col("section")), part("Title", F.col("title")), part("Excerpt", F.col("snippet")), part("Link", F.coalesce(F.nullif(F.col("deeplink"), F.lit("")), F.col("url"))))


def build_label_batches(df: DataFrame, n: int = 8, id_col: str = "doc_id", text_col: str = "text", width: int = 400) -> DataFrame:
    """batch, request, ids: n numbered snippets each in order of id, only the last batch has fewer.

    Rows are numbered over all of df: sorted by range, and the ranges' sizes (one number each) added up on the driver.
    """
    rows = df.select(F.col(id_col).alias("id"), F.left(T.squash_ws(F.coalesce(text_col, F.lit(""))), F.lit(width)).alias("snippet"))
    own = {"_range": F.spark_partition_id(), "_row": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}
    rows = written(rows.repartitionByRange("id", "snippet").sortWithinPartitions("id", "snippet").withColumns(own), "label-batches")
    ahead, starts = 0, []
    for r in rows.groupBy("_range").count().orderBy("_range").collect():
        starts.append((r["_range"], ahead))
        ahead += r["count"]
    known = F.broadcast(df.sparkSession.createDataFrame(starts, "_range int, _ahead long"))  # a row for each range
    no = F.col("_row") + F.col("_ahead")
    rows = rows.join(known, "_range").select(F.floor(no / n).alias("batch"), (no % n).alias("pos"), "id", "snippet")
    line = F.transform(F.array_sort(F.collect_list(F.struct("pos", "snippet"))), lambda x: F.concat((x["pos"] + 1).cast("string"), F.lit(". "), x["snippet"]))
    return rows.groupBy("batch").agg(F.array_join(line, "\n").alias("request"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]).alias("ids"))


def align_batch_labels(items: DataFrame, replies: DataFrame, vocabulary: tuple[str, ...] = ("Positive", "Negative", "Neutral")) -> DataFrame:
    """items (batch, pos, ...) with replies (batch, labels) by place; missing or unknown labels are ''."""
    flat = replies.select("batch", F.posexplode("labels").alias("pos", "label"))
    out = items.join(flat, ["batch", "pos"], "left")
    return out.withColumn("label", T.coerce_sentiment(F.col("label"), vocabulary))
