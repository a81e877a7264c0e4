"""Reading and writing content tables, with explicit schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pressglass import schemas
from pressglass.functions import times
from pressglass.operators.feeds import format_alert
from pressglass.operators.slots import CANONICAL, GENERIC_RULES
from pressglass.sources.versions import VersionedTable


def _read(spark: SparkSession, path: str, schema: str | None, fmt: str = "parquet") -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).format(fmt).load(path)


def read_watchlist(spark: SparkSession, path: str, module: str | None = None, fmt: str = "parquet") -> DataFrame:
    df = _read(spark, path, schemas.KEYWORDS, fmt)
    return df.where(F.col("module") == module) if module else df


def read_content(spark: SparkSession, path: str, family: str, fmt: str = "parquet") -> DataFrame:
    """family: article, page or transcript."""
    return _read(spark, path, schemas.CONTENT[family], fmt)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Landed pages: page_id, url, html."""
    return _read(spark, path, "page_id long, url string, html string")


def read_upload_listing(spark: SparkSession, playlist: str, videos: str) -> DataFrame:
    """Landed JSON of playlist items and video details -> uploads; the item's video id stands in where the details lack it."""
    item = "items array<struct<snippet:struct<title:string,description:string,publishedAt:string,channelId:string,resourceId:struct<videoId:string>>,contentDetails:struct<videoId:string,videoPublishedAt:string>>>"
    detail = "items array<struct<id:string,contentDetails:struct<duration:string>,snippet:struct<liveBroadcastContent:string>>>"
    items = spark.read.schema(item).option("multiLine", True).json(playlist).select(F.explode("items").alias("i"))
    rows = items.select(F.coalesce("i.contentDetails.videoId", "i.snippet.resourceId.videoId").alias("video_id"), F.col("i.snippet.channelId").alias("channel_id"), F.col("i.snippet.title").alias("title"), F.col("i.snippet.description").alias("description"), F.try_to_timestamp(F.coalesce("i.contentDetails.videoPublishedAt", "i.snippet.publishedAt")).alias("published")).where("video_id is not null")
    more = spark.read.schema(detail).option("multiLine", True).json(videos).select(F.explode("items").alias("v")).select(F.col("v.id").alias("video_id"), times.iso_duration_seconds(F.col("v.contentDetails.duration")).alias("duration_seconds"), F.col("v.snippet.liveBroadcastContent").isin("live", "upcoming").alias("live")).dropDuplicates(["video_id"])
    out = rows.dropDuplicates(["video_id"]).join(more, "video_id", "left")
    return out.select("*", F.concat(F.lit("https://www.youtube.com/watch?v="), "video_id").alias("url")).withColumn("live", F.coalesce("live", F.lit(False)))


def read_upload_feed(spark: SparkSession, path: str) -> DataFrame:
    """A landed Atom feed -> uploads; entries without an id are left out."""
    schema = "`yt:videoId` string, `yt:channelId` string, title string, published string, `media:group` struct<`media:description`:string>"
    rows = spark.read.format("xml").option("rowTag", "entry").schema(schema).load(path)
    return rows.where(F.col("`yt:videoId`").isNotNull()).select(F.col("`yt:videoId`").alias("video_id"), F.col("`yt:channelId`").alias("channel_id"), "title", F.col("`media:group`.`media:description`").alias("description"), F.try_to_timestamp("published").alias("published"))


def parse_transcript(reply: Column, offset: Column) -> Column:
    """Segments of a verbose JSON reply: words if it has some, else segments; trimmed, empty ones dropped, times shifted."""
    got = F.from_json(reply, "words array<struct<word:string,start:double,end:double>>, segments array<struct<start:double,end:double,text:string,avg_logprob:double,no_speech_prob:double>>")
    none = F.lit(None).cast("double")
    shape = lambda s, t, lp, ns: F.struct((s["start"] + offset).alias("start"), (s["end"] + offset).alias("end"), F.trim(t).alias("text"), lp.alias("avg_logprob"), ns.alias("no_speech_prob"))
    words = F.transform(got["words"], lambda w: shape(w, w["word"], none, none))
    segs = F.transform(got["segments"], lambda s: shape(s, s["text"], s["avg_logprob"], s["no_speech_prob"]))
    return F.filter(F.when(F.size(got["words"]) > 0, words).otherwise(segs), lambda x: F.coalesce(x["text"], F.lit("")) != "")


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Lines of JSON (video_id, offset, reply) -> video_id, segments."""
    rows = spark.read.schema("video_id string, offset double, reply string").json(path)
    return rows.select("video_id", parse_transcript(F.col("reply"), F.coalesce("offset", F.lit(0.0))).alias("segments"))


def channel_dim(spark: SparkSession, channels: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame([(i, n, times.ZONE, True) for i, n in channels], "channel_id string, name string, tz string, active boolean")


def slot_dim(channels: DataFrame) -> DataFrame:
    """A slot for each channel and canonical time, the channel's rules joined with four generic words."""
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("local_time"), F.lit(n).alias("label")) for t, n in CANONICAL])).alias("s")
    out = channels.select("channel_id", each).select("channel_id", "s.local_time", "s.label")
    rules = F.array_union(F.array(F.lower("label"), F.lower(F.replace("label", F.lit(" "), F.lit("")))), F.array(*[F.lit(w) for w in GENERIC_RULES]))
    return out.withColumn("title_rules", rules).withColumn("min_duration_sec", F.lit(120)).withColumn("max_duration_sec", F.lit(3600)).withColumn("enabled", F.lit(True))


MENTION_KEY = ["module", "external_id"]


def write_mentions(mentions: DataFrame, path: str) -> int:
    """A new version of the table at path, committed when all of it is there; returns its number."""
    return VersionedTable(mentions.sparkSession, path, MENTION_KEY).write(mentions)["version"]


def read_mentions(spark: SparkSession, path: str) -> DataFrame:
    """The newest complete version; empty before the first one."""
    found = VersionedTable(spark, path, MENTION_KEY).read()
    return spark.createDataFrame([], schemas.MENTIONS) if found is None else found


def write_alert_log(mentions: DataFrame, path: str, now: Column) -> None:
    mentions.select(F.concat(F.lit("["), F.date_format(now, "yyyy-MM-dd HH:mm:ss"), F.lit("] "), F.replace(format_alert(), F.lit("\n"), F.lit(" | "))).alias("value")).write.mode("append").text(path)
