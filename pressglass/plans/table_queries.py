"""More registered queries: operators and functions on columns of the given tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from pressglass.functions import text as T
from pressglass.functions import times
from pressglass.operators import hits, match, merge, policy, slots
from pressglass.plans.registry import query, table

WS = r"'\s+', ' ', 'g'"
SPACED = f"trim(regexp_replace(coalesce(text, ''), {WS}))"
EDGE = r"[^\p{L}\p{N}_]"


def has(word: str, text: str = f"lower({SPACED})") -> str:
    return rf"regexp_matches({text}, '(^|{EDGE}){word}($|{EDGE})')"


@query(f"SELECT doc_id, md5({SPACED}) AS text_md5 FROM documents")
def squash_ws(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.squash_ws(F.coalesce("text", F.lit(""))).cast("binary")).alias("text_md5"))


@query(f"SELECT doc_id, {has('the')} AS hit FROM documents")
def whole_word_match(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.whole_word_match(F.col("text"), F.lit("The")).alias("hit"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey >= 3600 THEN (o_orderkey // 3600)::VARCHAR || ':' || lpad((o_orderkey // 60 % 60)::VARCHAR, 2, '0') ELSE (o_orderkey // 60)::VARCHAR END || ':' || lpad((o_orderkey % 60)::VARCHAR, 2, '0') AS clock
FROM orders
""")
def mmss(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", times.mmss(F.col("o_orderkey")).alias("clock"))


@query("SELECT event_id, 'v/' || user_id || CASE WHEN user_id % 3 > 0 THEN '&t=' || event_id || 's' ELSE '' END AS link FROM events")
def deep_link(spark, sf_dir):
    second = F.when(F.col("user_id") % 3 > 0, F.col("event_id")).otherwise(-1)
    return table(spark, sf_dir, "events").select("event_id", times.deep_link(F.concat(F.lit("v/"), F.col("user_id").cast("string")), second).alias("link"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber < 7 THEN l_linenumber * 3600 + l_quantity::INT * 60 + l_linenumber END::INT AS seconds FROM lineitem")
def iso_duration_seconds(spark, sf_dir):
    n, q = F.col("l_linenumber").cast("string"), F.col("l_quantity").cast("int").cast("string")
    text = F.when(F.col("l_linenumber") < 7, F.concat(F.lit("pt"), n, F.lit("H"), q, F.lit("M"), n, F.lit("S"))).otherwise(F.concat(F.lit("P"), q, F.lit("Y")))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", times.iso_duration_seconds(text).alias("seconds"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN l_linenumber + 17 ELSE l_linenumber + 5 END::INT AS hour FROM lineitem WHERE l_linenumber <> 7")
def title_hours(spark, sf_dir):
    n = F.col("l_linenumber")
    half = F.when(n % 2 == 0, " p.m.").otherwise("AM")
    title = F.when(n == 7, "News at 9:30 am").otherwise(F.concat(F.lit("Headlines "), (n + 5).cast("string"), half))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", times.title_hours(title).alias("hours"))
    return rows.select("l_orderkey", "l_linenumber", F.explode("hours").alias("hour"))


@query("SELECT o_orderkey, epoch(o_orderdate::TIMESTAMP)::BIGINT + 16200 AS air FROM orders")
def slot_airtime(spark, sf_dir):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.unix_timestamp(times.slot_airtime(day, F.lit("09:30:00"))).alias("air"))


@query("SELECT event_id, (ts + INTERVAL 5 HOUR)::DATE = ts::DATE OR ((ts + INTERVAL 5 HOUR)::DATE = ts::DATE - 1 AND hour(ts + INTERVAL 5 HOUR) >= 22) AS same FROM events")
def same_slot_date(spark, sf_dir):
    day = F.date_format("ts", "yyyy-MM-dd")
    return table(spark, sf_dir, "events").select("event_id", times.same_slot_date(F.col("ts"), day, F.lit("00:00:00")).alias("same"))


@query("SELECT o_orderkey, o_orderdate::DATE < DATE '1995-06-17' AS past FROM orders")
def slot_date_is_past(spark, sf_dir):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return table(spark, sf_dir, "orders").select("o_orderkey", times.slot_date_is_past(day, F.expr("timestamp'1995-06-16 20:00:00'")).alias("past"))


@query("SELECT page_id, 'frames/' || page_id || '.jpg' AS path FROM pages")
def media_path(spark, sf_dir):
    path = F.concat(F.lit("C:\\app\\Storage\\frames\\"), F.col("page_id").cast("string"), F.lit(".jpg"))
    return table(spark, sf_dir, "pages").select("page_id", T.media_path(path).alias("path"))


@query("SELECT doc_id, CASE WHEN quality = 1 THEN 'Positive' WHEN toxic = 1 THEN 'Negative' ELSE '' END AS label FROM labels")
def coerce_sentiment(spark, sf_dir):
    label = F.when(F.col("quality") == 1, " positive ").when(F.col("toxic") == 1, "NEGATIVE").otherwise("mixed")
    return table(spark, sf_dir, "labels").select("doc_id", T.coerce_sentiment(label).alias("label"))


@query("SELECT doc_id, doc_id % 100 / 100 AS relevance, CASE WHEN quality = 1 THEN 'Positive' ELSE 'Neutral' END AS sentiment FROM labels WHERE doc_id % 5 > 0")
def parse_scores(spark, sf_dir):
    score = (F.col("doc_id") % 100 / 100).cast("string")
    body = F.concat(F.lit('```json\n{"relevance": '), score, F.lit(', "sentiment": "'), F.when(F.col("quality") == 1, "positive").otherwise("no idea"), F.lit('"}\n```'))
    reply = F.when(F.col("doc_id") % 5 > 0, F.concat(F.lit("<think>so</think>"), body)).otherwise("I can't say")
    rows = table(spark, sf_dir, "labels").select("doc_id", T.parse_scores(reply).alias("s")).where("s is not null")
    return rows.select("doc_id", "s.relevance", "s.sentiment")


@query("SELECT p_brand AS text, count(*) AS n FROM part WHERE p_size % 2 = 0 AND p_size <> 10 GROUP BY 1")
def active_keywords(spark, sf_dir):
    blank = F.when(F.col("p_size") == 10, " ").otherwise(F.col("p_brand"))
    keywords = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), blank.alias("text"), F.lit("newspaper").alias("module"), (F.col("p_size") % 2 == 0).alias("active"))
    return match.active_keywords(keywords, "newspaper").groupBy("text").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, 0 AS pos, c_mktsegment AS term FROM customer UNION ALL SELECT c_custkey, 2, c_name FROM customer")
def parse_keyword_batch(spark, sf_dir):
    text = F.concat("c_mktsegment", F.lit(" ,"), F.lower("c_mktsegment"), F.lit("\n"), F.col("c_name"), F.lit("\r\n,"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", text.alias("t"))
    return match.parse_keyword_batch(rows, "t", "c_custkey")


@query("SELECT DISTINCT source FROM documents WHERE source IS NOT NULL AND lower(source) NOT IN (SELECT lower(source) FROM documents WHERE lang = 'fr' AND source IS NOT NULL)")
def exclude_hidden(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("source is not null")
    sources = docs.select(F.col("source").alias("name"), F.col("source").alias("slug")).distinct()
    return match.exclude_hidden(sources, docs.where("lang = 'fr'").select(F.upper("source").alias("name"))).select(F.col("name").alias("source"))


@query("SELECT DISTINCT source FROM documents WHERE lower(source) IN (SELECT lower(source) FROM documents WHERE lang = 'es')")
def select_sources(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("source is not null")
    return match.select_sources(docs.select(F.col("source").alias("name")).distinct(), docs.where("lang = 'es'").select(F.upper("source").alias("name"))).select(F.col("name").alias("source"))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' OR o_orderdate::DATE = DATE '1995-03-15'")
def keep_on_date_or_unknown(spark, sf_dir):
    day = F.when(F.col("o_orderstatus") != "P", F.to_date("o_orderdate"))
    return policy.keep_on_date_or_unknown(table(spark, sf_dir, "orders").select("o_orderkey", day.alias("published_on")), F.expr("date'1995-03-15'")).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate::DATE >= DATE '1996-01-01'")
def not_before_monitor_since(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"))
    return policy.not_before(rows, "1996-01-01").select("o_orderkey")


@query("SELECT bool_and(n >= 25) AS all_full FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)")
def all_full(spark, sf_dir):
    counts = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return policy.all_full(counts)


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 20 DAY")
def within_search(spark, sf_dir):
    return policy.within_search(table(spark, sf_dir, "events"), F.expr("timestamp'2024-01-31 00:00:00'"), 20, F.col("ts")).select("event_id")


def spoken(spark, sf_dir):
    """conversations as located keywords: the role is the keyword, each turn a hit of ten seconds."""
    hit = F.struct((F.col("turn") * 10).cast("int").alias("start"), (F.col("turn") * 10 + 10).cast("int").alias("end"), F.coalesce("text", F.lit("")).alias("excerpt"))
    rows = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("video_id"), F.col("role").alias("keyword")).agg(F.array_sort(F.collect_list(hit)).alias("hits"))
    return rows.withColumn("language", F.lit("en"))


@query("SELECT conv_id, role AS keyword, count(*) AS n, min(turn) * 10 AS first FROM conversations GROUP BY 1, 2")
def hits_map(spark, sf_dir):
    rows = hits.hits_map(spoken(spark, sf_dir)).select(F.col("video_id").alias("conv_id"), F.explode("keyword_hits").alias("keyword", "h"))
    return rows.select("conv_id", "keyword", F.size("h").cast("long").alias("n"), F.get("h", F.lit(0))["start"].alias("first"))


@query("SELECT conv_id, role AS keyword, min(turn) * 10 AS start FROM conversations WHERE (conv_id, role) IN (SELECT conv_id, min(role) FROM conversations GROUP BY 1) GROUP BY 1, 2")
def first_hit(spark, sf_dir):
    return hits.first_hit(spoken(spark, sf_dir)).select(F.col("video_id").alias("conv_id"), "keyword", "start")


@query("SELECT conv_id, min(turn) * 10 AS second FROM conversations GROUP BY 1")
def earliest_hit(spark, sf_dir):
    return hits.earliest_hit(spoken(spark, sf_dir)).select(F.col("video_id").alias("conv_id"), "second")


@query("SELECT conv_id, role AS keyword, min(turn) * 10 AS second FROM conversations GROUP BY 1, 2")
def keyword_second(spark, sf_dir):
    return hits.keyword_second(spoken(spark, sf_dir)).select(F.col("video_id").alias("conv_id"), "keyword", "second")


@query(f"SELECT conv_id, turn FROM conversations WHERE {has('the')}")
def verify_hits(spark, sf_dir):
    rows = spoken(spark, sf_dir).select("video_id", F.explode("hits").alias("h"))
    kept = rows.select("video_id", hits.verify_hits(F.array("h"), F.lit("The"), F.lit("en")).alias("kept"))
    return kept.select(F.col("video_id").alias("conv_id"), F.explode("kept").alias("k")).select("conv_id", (F.col("k.start") / 10).cast("long").alias("turn"))


@query("SELECT conv_id, turn * 10 + 1000 AS start, turn * 10 + 1010 AS stop FROM conversations")
def shift_window_times(spark, sf_dir):
    rows = spoken(spark, sf_dir).select("video_id", F.explode(hits.shift_window_times(F.col("hits"), F.lit(1000))).alias("s"))
    return rows.select(F.col("video_id").alias("conv_id"), "s.start", F.col("s.end").alias("stop"))


@query("SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_discount * 10 <= 0.6 AND l_tax * -20 >= -1.0 GROUP BY 1")
def reliable_segments(spark, sf_dir):
    seg = F.struct((F.col("l_tax") * -20).cast("double").alias("avg_logprob"), (F.col("l_discount") * 10).cast("double").alias("no_speech_prob"))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(seg).alias("s"))
    return rows.select("l_orderkey", F.size(hits.reliable_segments(F.col("s"))).cast("long").alias("n")).where("n > 0")


@query("""
SELECT o_orderkey, c_name AS channel_name, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE 'Cached' END AS slot_label FROM orders JOIN customer ON c_custkey = o_custkey
""")
def attach_channel(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    channels = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("channel_id"), F.col("c_name").alias("name"))
    made = orders.select("o_orderkey", F.col("o_custkey").alias("channel_id"), F.col("o_orderkey").alias("bulletin_id"))
    known = orders.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("bulletin_id"), F.col("o_orderpriority").alias("label"))
    return slots.attach_channel(made, channels, known).select("o_orderkey", "channel_name", "slot_label")


@query("SELECT o_orderkey FROM orders LEFT JOIN (SELECT l_orderkey, min(l_shipdate::TIMESTAMP) AS made FROM lineitem WHERE l_orderkey % 3 > 0 GROUP BY 1) ON l_orderkey = o_orderkey WHERE coalesce(made, o_orderdate::TIMESTAMP) BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1995-12-31'")
def transcripts_in_period(spark, sf_dir):
    made = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("video_id"), F.col("o_orderdate").cast("timestamp").alias("created_at"))
    seen = table(spark, sf_dir, "lineitem").where("l_orderkey % 3 > 0").select(F.col("l_orderkey").alias("external_id"), F.col("l_shipdate").cast("timestamp").alias("published_at"))
    return slots.transcripts_in_period(made, seen, F.expr("timestamp'1995-01-01'"), F.expr("timestamp'1995-12-31'")).select(F.col("video_id").alias("o_orderkey"))


@query("SELECT o_orderkey FROM orders WHERE TIMESTAMP '1997-01-01 06:00:00' >= o_orderdate::TIMESTAMP + INTERVAL 4 HOUR + INTERVAL 180 MINUTE")
def past_missing_deadline(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("slot_date"), F.lit("09:00:00").alias("local_time"))
    return slots.past_missing_deadline(rows, F.expr("timestamp'1997-01-01 06:00:00'")).select("o_orderkey")


@query("SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN 'and' ELSE 'and|the' END AS missing FROM documents")
def pages_missing_media(spark, sf_dir):
    hit = F.array(F.struct(F.lit(1).alias("start")))
    media = F.when(F.col("doc_id") % 2 == 0, F.create_map(F.lit("the"), F.lit("p")))
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.create_map(F.lit("the"), hit, F.lit("and"), hit).alias("keyword_hits"), media.alias("keyword_media"))
    return policy.pages_missing_media(rows).select("id", F.array_join("missing", "|").alias("missing"))


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-04-15 00:00:00' - INTERVAL 90 DAY")
def prune_retention(spark, sf_dir):
    kept = policy.prune_retention({"screenshots": table(spark, sf_dir, "events").withColumnRenamed("ts", "taken_at")}, F.expr("timestamp'2024-04-15 00:00:00'"))
    return kept["screenshots"].select("event_id")


@query("""
WITH o AS (SELECT DISTINCT source FROM documents WHERE lang = 'en' AND source IS NOT NULL), n AS (SELECT DISTINCT source FROM documents WHERE lang = 'de' AND source IS NOT NULL)
SELECT coalesce(o.source, n.source) AS name, CASE WHEN n.source IS NULL THEN 'old' ELSE 'new' END AS url, n.source IS NOT NULL AS active FROM o FULL JOIN n ON o.source = n.source
""")
def upsert_sources(spark, sf_dir):
    names = lambda lang: table(spark, sf_dir, "documents").where(F.col("lang") == lang).where("source is not null").select(F.col("source").alias("name")).distinct()
    more = {"kind": F.lit("web"), "language": F.lit("en")}
    old = names("en").withColumns({"url": F.lit("old"), **more, "active": F.lit(False)})
    return merge.upsert_sources(old, names("de").withColumns({"url": F.lit("new"), **more})).select("name", "url", "active")


@query("""
SELECT o_orderkey, CASE WHEN n IS NULL THEN 'stub' ELSE 'n' || n END AS text, CASE WHEN n IS NULL THEN 'metadata' ELSE 'transcribed' END AS transcriber, o_orderpriority AS language
FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_linenumber > 1 GROUP BY 1) ON l_orderkey = o_orderkey WHERE n IS NOT NULL OR o_orderkey % 2 = 0
""")
def finalize_transcripts(spark, sf_dir):
    stub = F.when(F.col("o_orderkey") % 2 == 0, "stub").otherwise("")
    old = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("video_id"), stub.alias("text"), F.lit("metadata").alias("model"), F.lit("transcribing").alias("transcriber"), F.lit(None).cast("string").alias("segments"), F.col("o_orderpriority").alias("language"))
    made = table(spark, sf_dir, "lineitem").where("l_linenumber > 1").groupBy(F.col("l_orderkey").alias("video_id")).agg(F.concat(F.lit("n"), F.count("*").cast("string")).alias("text"))
    made = made.withColumns({"model": F.lit("large"), "segments": F.lit("s")})
    return merge.finalize_transcripts(old, made).select(F.col("video_id").alias("o_orderkey"), "text", "transcriber", "language")


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE c_mktsegment END AS name, c_custkey % 3 = 0 OR c_custkey % 2 = 1 AS active FROM customer")
def upsert_channels(spark, sf_dir):
    rows = table(spark, sf_dir, "customer")
    old = rows.select(F.col("c_custkey").alias("channel_id"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise("").alias("name"), F.lit(False).alias("active"))
    seed = rows.where("c_custkey % 3 = 0 or c_custkey % 2 = 1").select(F.col("c_custkey").alias("channel_id"), F.col("c_mktsegment").alias("name"))
    merged = merge.upsert_channels(old, seed)
    return merged.select(F.col("channel_id").alias("c_custkey"), "name", "active")


@query("SELECT doc_id, lang AS label FROM documents WHERE lang <> 'en'")
def new_labels(spark, sf_dir):
    added = match.new_labels(F.array(F.lit("EN")), F.array(F.lower("lang")))
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(added).alias("label"))
