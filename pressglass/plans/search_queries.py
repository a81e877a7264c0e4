"""Registered queries of whole searches, feeds, slots and pages over columns of the given tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from pressglass import schemas
from pressglass.functions import text as T
from pressglass.functions import times
from pressglass.operators import feeds, hits, pages, slots, ticker
from pressglass.plans import search
from pressglass.plans.registry import query, table
from pressglass.plans.timeline_queries import mentions_of_events
from pressglass.sources.tables import read_content, read_transcripts, read_upload_listing, read_watchlist
from pressglass.storage import shared_path

SPOKEN = ["thing", "from", "this", "dans", "all rights reserved", "license"]
EDGE = r"[^\p{L}\p{N}_]"
KEYWORDS = "(SELECT unnest(['" + "','".join(SPOKEN) + "']) AS keyword)"
TURNS = r"SELECT conv_id, turn, trim(lower(regexp_replace(left(trim(coalesce(text, '')), 240), '\s+', ' ', 'g'))) AS norm FROM conversations"
#: A keyword is located in a conversation if the excerpt of a turn holds it (loops and phrases over turns apart, see the tests).
HEARD = rf"SELECT DISTINCT conv_id, keyword FROM ({TURNS}), {KEYWORDS} WHERE regexp_matches(norm, '(^|{EDGE})' || keyword || '($|{EDGE})')"


def watchlist(spark, terms=SPOKEN):
    return spark.createDataFrame([(i, t, "en", "youtube", True, None) for i, t in enumerate(terms)], schemas.KEYWORDS)


def recorded(spark, sf_dir):
    """conversations as stored transcripts of channels: one of five, made on a day of their number."""
    none = F.lit(None).cast("double")
    seg = F.struct((F.col("turn") * 10.0).alias("start"), (F.col("turn") * 10.0 + 10).alias("end"), F.coalesce("text", F.lit("")).alias("text"), none.alias("avg_logprob"), none.alias("no_speech_prob"))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(seg)).alias("segments"))
    return rows.select(
        F.col("conv_id").cast("string").alias("video_id"), (F.col("conv_id") % 5).cast("string").alias("channel_id"), F.lit(None).cast("long").alias("bulletin_id"), F.lit("t").alias("transcriber"), F.lit("large").alias("model"), F.lit("en").alias("language"), F.lit("").alias("text"), "segments",
        F.lit(None).cast("map<string,double>").alias("confidence"), (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(days=(F.col("conv_id") % 50).cast("int"))).alias("created_at"),
    )


@query(f"""
SELECT conv_id::VARCHAR AS external_id, 'ch' || (conv_id % 5) AS source, string_agg(keyword, '|' ORDER BY keyword) AS labels FROM ({HEARD})
WHERE DATE '2024-01-01' + (conv_id % 50)::INT >= TIMESTAMP '2024-04-10 00:00:00' - INTERVAL 90 DAY GROUP BY 1, 2
""")
def rematch(spark, sf_dir):
    made = recorded(spark, sf_dir)
    channels = made.select("channel_id").distinct().withColumn("name", F.concat(F.lit("ch"), "channel_id"))
    found, _ = search.rematch(spark.createDataFrame([], schemas.MENTIONS), made, watchlist(spark), channels, F.expr("timestamp'2024-04-10 00:00:00'"), schemas.MENTIONS)
    return found.select("external_id", "source", F.array_join("matched_keywords", "|").alias("labels"))


@query(f"""
WITH u AS (SELECT DISTINCT conv_id FROM conversations WHERE conv_id % 50 BETWEEN 3 AND 30 AND conv_id % 7 > 0)
SELECT u.conv_id::VARCHAR AS video_id, u.conv_id % 4 = 0 AS todo, string_agg(keyword, '|' ORDER BY keyword) FILTER (u.conv_id % 4 > 0) AS labels
FROM u LEFT JOIN ({HEARD}) h ON h.conv_id = u.conv_id GROUP BY 1, 2 HAVING todo OR labels IS NOT NULL
""")
def period_scan(spark, sf_dir):
    """Conversations as uploads of a period, a seventh of them live, a quarter without a transcript."""
    made = recorded(spark, sf_dir)
    number = F.col("video_id").cast("long")
    uploads = made.select("video_id", "channel_id", F.lit("t").alias("title"), F.lit("").alias("description"), F.col("created_at").alias("published"), F.lit(60).alias("duration_seconds"), (number % 7 == 0).alias("live"), F.lit("u").alias("url"))
    low, high = (F.expr(f"timestamp'2024-01-{d} 00:00:00'") for d in ("04", "31"))
    found, todo = search.period_scan(uploads, made.where(number % 4 > 0), watchlist(spark), low, high, "January", schemas.MENTIONS)
    scanned = found.select(F.col("external_id").alias("video_id"), F.lit(False).alias("todo"), F.array_join("matched_keywords", "|").alias("labels"))
    return scanned.unionByName(todo.select("video_id", F.lit(True).alias("todo"), F.lit(None).cast("string").alias("labels")))


@query(rf"""
SELECT doc_id, keyword FROM (SELECT doc_id, trim(lower(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))) AS norm FROM documents WHERE doc_id % 10 < 3), {KEYWORDS}
WHERE regexp_matches(norm, '(^|{EDGE})' || keyword || '($|{EDGE})')
""")
def edition_rematch(spark, sf_dir):
    """documents as print pages of ten days, of which the last three are matched again."""
    day = F.date_sub(F.lit("2024-03-10").cast("date"), (F.col("doc_id") % 10).cast("int")).cast("string")
    rows = table(spark, sf_dir, "documents").select(F.lit("p").alias("paper"), F.lit("c").alias("city"), day.alias("date"), F.col("doc_id").cast("int").alias("page_no"), "text", F.array().cast("array<struct<text:string>>").alias("regions"))
    return search.edition_rematch(rows, watchlist(spark), "2024-03-10").select(F.col("page.page_no").cast("long").alias("doc_id"), "keyword")


@query("""
SELECT event_id AS id, 'YouTube' AS module, 'x' AS section, strftime(ts + INTERVAL 5 HOUR, '%Y-%m-%d %H:%M') AS local_time, event_type || ' 0m 01s' AS timestamps, event_type AS snippet, 'u' AS link FROM events
""")
def mention_cards(spark, sf_dir):
    found = mentions_of_events(spark, sf_dir)
    more = {"published_at": F.lit(None).cast("timestamp"), "deeplink": F.lit(None).cast("string"), "screenshot_path": F.lit(None).cast("string"), "full_screenshot_path": F.lit(None).cast("string"), "sentiment": F.lit("")}
    return feeds.mention_cards(found.withColumns(more)).select("id", "module", "section", "local_time", "timestamps", "snippet", "link")


@query(r"""
SELECT event_id AS id, 'Keywords: ' || event_type || chr(10) || 'Source: s' || chr(10) || 'Section: x' || chr(10) || 'Title: t' || chr(10)
|| CASE WHEN event_id % 2 = 0 THEN 'Excerpt: at ' || user_id || chr(10) ELSE '' END || 'Link: ' || CASE WHEN event_id % 3 = 0 THEN 'deep' ELSE 'u' END AS alert FROM events
""")
def format_alert(spark, sf_dir):
    users = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "user_id")
    found = mentions_of_events(spark, sf_dir).join(users, "id")
    found = found.withColumns({"snippet": F.when(F.col("id") % 2 == 0, F.concat(F.lit("at "), "user_id")).otherwise(" "), "deeplink": F.when(F.col("id") % 3 == 0, "deep").otherwise("")})
    return found.select("id", feeds.format_alert().alias("alert"))


@query(rf"SELECT doc_id AS id, 'The' AS keyword FROM documents WHERE regexp_matches(trim(lower(regexp_replace(text, '\s+', ' ', 'g'))), '(^|{EDGE})the($|{EDGE})')")
def verified_keywords(spark, sf_dir):
    from pressglass.plans.queries import mentions_of

    found = mentions_of(spark, sf_dir, "the", "true")
    active = table(spark, sf_dir, "documents").limit(1).select(F.explode(F.array(F.lit("The"), F.lit("other"))).alias("text"))
    return hits.verified_keywords(found, active).select("id", F.explode("keywords").alias("keyword"))


@query(r"""
WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id, left(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')), 400)) - 1 AS r, left(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')), 400) AS s FROM documents)
SELECT r // 8 AS batch, md5(string_agg((r % 8 + 1) || '. ' || s, chr(10) ORDER BY r)) AS request_md5, string_agg(doc_id, ',' ORDER BY r) AS ids FROM d GROUP BY 1
""")
def build_label_batches(spark, sf_dir):
    got = feeds.build_label_batches(table(spark, sf_dir, "documents"))
    return got.select("batch", F.md5(F.col("request").cast("binary")).alias("request_md5"), F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))


@query("""
WITH p AS (SELECT page_id, 100 + page_id % 700 AS w, 200 + page_id % 1500 AS h FROM pages)
SELECT page_id, '/a' AS link, round(w / 10.0, 6) AS r, round(h / 20.0, 6) AS b FROM p WHERE w / 10.0 * (h / 20.0) <= 9200
UNION ALL SELECT page_id, '/b', 100.0, 100.0 FROM p WHERE 2000 - h >= 25 AND 100 * (100 - h / 20.0) <= 9200
""")
def image_map_regions(spark, sf_dir):
    """Two areas are planted into each page, whose sizes follow its id; the second one reaches both ends of the scan."""
    w, h = (100 + F.col("page_id") % 700).cast("string"), (200 + F.col("page_id") % 1500).cast("string")
    areas = F.concat(F.lit('<area coords="0,0,'), w, F.lit(",0,"), w, F.lit(","), h, F.lit(',0,5" href="/a"><area href=\'/b\' coords="0,'), h, F.lit(',1000,2000"><area href="/a" coords="0,0,90,90"><area coords="1,2,3"><area href="/c" coords="5,5,9,900">'))
    rows = table(spark, sf_dir, "pages").select("page_id", F.concat(areas, F.coalesce("html", F.lit(""))).alias("html"))
    return pages.image_map_regions(rows).where("link in ('/a', '/b')").select("page_id", "link", F.round("r", 6).alias("r"), F.round("b", 6).alias("b"))


HOST = r"lower(regexp_extract(url, '^https?://([^/?#:]*)', 1))"


@query(f"""
WITH h AS (SELECT page_id, url, {HOST} AS host FROM pages), d AS (SELECT DISTINCT host AS domain FROM h WHERE page_id % 2 = 0 AND host <> '' UNION SELECT DISTINCT regexp_replace(host, '^[^.]*[.]', '') FROM h WHERE host LIKE '%.%')
SELECT page_id, 's:' || arg_max(domain, length(domain)) AS slug FROM h LEFT JOIN d ON host = domain OR ends_with(host, '.' || domain) GROUP BY page_id
""")
def resolve_source_slug(spark, sf_dir):
    from pressglass.functions import urls

    rows = table(spark, sf_dir, "pages").select("page_id", "url")
    host = urls.url_host(F.col("url"))
    own = rows.where("page_id % 2 = 0").select(host.alias("domain")).where("domain <> ''")
    above = rows.select(host.alias("h")).where("h like '%.%'").select(F.regexp_replace("h", r"^[^.]*[.]", "").alias("domain"))
    domains = own.union(above).distinct().withColumn("slug", F.concat(F.lit("s:"), "domain"))
    return pages.resolve_source_slug(rows, domains).select("page_id", "slug")


@query("""
SELECT o_custkey AS source, count(*) AS pages, count(*) FILTER (o_orderstatus = 'F') AS read, count(*) FILTER (o_orderstatus = 'P') AS map_fail, sum(o_orderkey % 90 + 30)::BIGINT AS chars, sum(o_orderkey % 7)::BIGINT AS hits, max(o_orderkey % 7) > 4 OR sum(least(o_orderkey % 7, 4)) > 24 AS capped,
CASE WHEN sum(o_orderkey % 7) > 0 THEN '' WHEN count(*) FILTER (o_orderstatus = 'F') = 0 THEN 'No page could be read' WHEN sum(o_orderkey % 90 + 30) < 400 THEN 'Hardly any text' ELSE 'No keyword on these pages' END AS note FROM orders GROUP BY 1
""")
def edition_stats(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "F", "read").when(F.col("o_orderstatus") == "P", "map_fail").otherwise("ocr_fail")
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("source"), status.alias("status"), (F.col("o_orderkey") % 90 + 30).alias("chars"), (F.col("o_orderkey") % 7).alias("hits"))
    return pages.edition_stats(rows).select("source", "pages", "read", "map_fail", "chars", "hits", "capped", "note")


@query("""
SELECT o_orderkey, epoch(o_orderdate::DATE::TIMESTAMP)::BIGINT + 32400 - 18000 AS lo, CASE WHEN o_orderkey % 3 > 0 THEN epoch(o_orderdate::DATE::TIMESTAMP)::BIGINT + CASE WHEN o_orderkey % 3 = 1 THEN 86399 ELSE 64800 END - 18000 + 86400 END AS hi FROM orders WHERE o_orderkey % 3 > 0
UNION ALL SELECT o_orderkey, NULL, NULL FROM orders WHERE o_orderkey % 3 = 0
""")
def period_bounds(spark, sf_dir):
    """From nine o'clock of an order's day to the end, or 18:00, of the next one; the others end on the day before."""
    k, day = F.col("o_orderkey") % 3, F.to_date("o_orderdate")
    other = F.when(k == 0, F.date_sub(day, 1)).otherwise(F.date_add(day, 1)).cast("string")
    bounds = times.period_bounds(day.cast("string"), other, F.lit("09:00"), F.when(k == 2, "18:00"))
    return table(spark, sf_dir, "orders").select("o_orderkey", bounds.alias("p")).select("o_orderkey", F.unix_timestamp("p.lo").alias("lo"), F.unix_timestamp("p.hi").alias("hi"))


@query("""
WITH u AS (SELECT *, ts BETWEEN TIMESTAMP '2024-01-09 15:00:00' AND TIMESTAMP '2024-01-10 23:00:00' AS inside FROM events)
SELECT event_id FROM u WHERE inside OR user_id NOT IN (SELECT user_id FROM u WHERE inside)
""")
def uploads_for_slot_day(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("channel_id"), F.col("ts").cast("timestamp").alias("published"))
    return slots.uploads_for_slot_day(rows, "2024-01-10").select("event_id")


@query("""
WITH b AS (SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderdate::DATE = (SELECT max(o_orderdate::DATE) FROM orders))
SELECT DISTINCT l_orderkey * 10 + l_linenumber AS transcript FROM lineitem JOIN b ON o_orderkey = l_orderkey WHERE l_linenumber % 2 = 1 OR o_orderstatus <> 'P'
""")
def transcripts_for_slots(spark, sf_dir):
    """Line items as transcripts of the last day's orders: odd ones name their bulletin, the others its video."""
    from pressglass.plans.queries import bulletins

    b = bulletins(spark, sf_dir)
    day = b.agg(F.max("slot_date")).first()[0]
    odd = F.col("l_linenumber") % 2 == 1
    made = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("transcript"), F.when(odd, F.col("l_orderkey")).alias("bulletin_id"), F.when(~odd, F.col("l_orderkey").cast("string")).otherwise(F.concat(F.lit("x"), F.col("l_orderkey"), F.lit("-"), F.col("l_linenumber"))).alias("video_id"))
    return slots.transcripts_for_slots(made, b, day).select("transcript").distinct()


@query("""
SELECT user_id::VARCHAR AS channel_id, count(*) AS checked, count(*) FILTER (event_type IN ('click', 'view') AND value >= 20) AS bulletin_like, user_id % 2 = 0 AS already_added FROM events GROUP BY user_id
""")
def channel_probe_summary(spark, sf_dir):
    title = F.when(F.col("event_type") == "click", "News at 9 pm").when(F.col("event_type") == "view", "Headlines").otherwise("Song of the day")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("channel_id"), title.alias("title"), F.col("ts").cast("timestamp").alias("published"), F.ceil(F.col("value") * 6).alias("duration_seconds"), F.lit(False).alias("live"), "value")
    rows = rows.withColumn("duration_seconds", F.when(F.col("value") >= 20, 120).otherwise(119))
    channels = rows.select("channel_id").distinct().where("cast(channel_id as long) % 2 = 0")
    found = slots.channel_probe_summary(rows, channels, F.expr("timestamp'2024-01-31 00:00:00'"))
    return found.select("channel_id", "checked", "bulletin_like", "already_added")


@query("""
SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'live' ELSE 'bulletin' END AS kind FROM events WHERE event_id % 4 = 0 OR ts::DATE = DATE '2024-01-10'
""")
def ticker_sources(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    live = events.where("event_id % 4 = 0").select("event_id")
    recorded_ = events.where("event_id % 4 > 0").select("event_id", F.to_date("ts").cast("string").alias("slot_date"))
    return ticker.ticker_sources(live, recorded_, "2024-01-10", "2024-01-10")


@query("SELECT l_orderkey, l_linenumber, l_linenumber IN (1, 2, 5) AS hit FROM lineitem")
def title_has_time(spark, sf_dir):
    n = F.col("l_linenumber")
    title = F.when(n == 1, "News 9 PM").when(n == 2, "12:30 a.m. update").when(n == 3, "9 PMs met").when(n == 4, "spam 12").when(n == 5, "At 7am").otherwise(F.col("l_returnflag"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", times.title_has_time(title).alias("hit"))


@query("SELECT doc_id, 'newspaper' AS module, md5(coalesce(text, '')) AS body_md5 FROM documents")
def read_content_articles(spark, sf_dir):
    """documents written as a landed content table, and read with its schema."""
    path = shared_path(spark, "articles")
    table(spark, sf_dir, "documents").select(F.lit("newspaper").alias("module"), F.col("doc_id").cast("string").alias("external_id"), F.col("text").alias("body"), F.lit("more").alias("unknown")).write.parquet(path)
    got = read_content(spark, path, "article")
    return got.select(F.col("external_id").cast("long").alias("doc_id"), "module", F.md5(F.coalesce("body", F.lit("")).cast("binary")).alias("body_md5"))


@query("SELECT p_brand AS text, count(*) AS n FROM part WHERE p_partkey % 2 = 0 GROUP BY 1")
def read_watchlist_rows(spark, sf_dir):
    path = shared_path(spark, "watchlist")
    module = F.when(F.col("p_partkey") % 2 == 0, "epaper").otherwise("youtube")
    table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("text"), F.lit("en").alias("language"), module.alias("module"), F.lit(True).alias("active"), F.lit(None).cast("timestamp").alias("created_at")).write.json(path)
    return read_watchlist(spark, path, "epaper", "json").groupBy("text").agg(F.count("*").alias("n"))


@query(r"SELECT conv_id, turn, trim(text) AS text, turn * 2.5 + 100 AS start FROM conversations WHERE trim(coalesce(text, '')) <> ''")
def read_transcripts_replies(spark, sf_dir):
    """conversations as landed replies of a speech service, a line of JSON for each conversation."""
    path = shared_path(spark, "replies")
    seg = F.struct((F.col("turn") * 2.5).alias("start"), (F.col("turn") * 2.5 + 1).alias("end"), "text", "turn")
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(seg)).alias("segments"))
    rows.select(F.col("conv_id").cast("string").alias("video_id"), F.lit(100.0).alias("offset"), F.to_json(F.struct("segments")).alias("reply")).write.json(path)
    got = read_transcripts(spark, path).select(F.col("video_id").cast("long").alias("conv_id"), F.explode("segments").alias("s"))
    return got.select("conv_id", ((F.col("s.start") - 100) / 2.5).cast("long").alias("turn"), "s.text", "s.start")


@query("SELECT o_orderkey::VARCHAR AS video_id, o_custkey::VARCHAR AS channel_id, CASE WHEN o_orderkey % 2 = 0 THEN (o_orderkey % 50) * 60 + 5 END::INT AS duration_seconds, o_orderkey % 6 = 0 AS live FROM orders")
def read_upload_listing_rows(spark, sf_dir):
    """orders as landed listings of uploads, a file for each page of items, and details of every other one."""
    items, details = shared_path(spark, "items"), shared_path(spark, "details")
    orders = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey").cast("string")
    item = F.struct(F.struct(F.col("o_orderpriority").alias("title"), F.col("o_custkey").cast("string").alias("channelId"), F.struct(key.alias("videoId")).alias("resourceId")).alias("snippet"))
    orders.groupBy((F.col("o_orderkey") % 97).alias("page")).agg(F.collect_list(item).alias("items")).repartition("page").write.partitionBy("page").json(items)
    live = F.when(F.col("o_orderkey") % 6 == 0, "live").otherwise("none")
    length = F.concat(F.lit("PT"), (F.col("o_orderkey") % 50).cast("string"), F.lit("M5S"))
    detail = F.struct(key.alias("id"), F.struct(length.alias("duration")).alias("contentDetails"), F.struct(live.alias("liveBroadcastContent")).alias("snippet"))
    orders.where("o_orderkey % 2 = 0").groupBy((F.col("o_orderkey") % 97).alias("page")).agg(F.collect_list(detail).alias("items")).repartition("page").write.partitionBy("page").json(details)
    return read_upload_listing(spark, items, details).select("video_id", "channel_id", "duration_seconds", "live")


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'en' ELSE 'ur' END AS language FROM conversations")
def keyword_language(spark, sf_dir):
    word = F.when(F.col("turn") % 2 == 0, F.coalesce("text", F.lit("x"))).otherwise(F.concat(F.coalesce("text", F.lit("")), F.lit("میسی")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.keyword_language(word, F.lit("ur")).alias("language"))
