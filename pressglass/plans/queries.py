"""Registered queries over the given tables, each with the SQL that it must agree with where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressglass.functions import text as T
from pressglass.functions import times, urls
from pressglass.operators import feeds, hits, match, merge, pages, policy, quality, slots, ticker
from pressglass.plans import registry, search_queries, table_queries, timeline_queries  # noqa: F401 (they register their own)
from pressglass.plans.registry import query, table
from pressglass.plans.search import press_search
from pressglass.storage import drained
from pressglass.streaming.operators import stream_matches

TERMS = ["the", "of the", "and", "nicht", "und", "que", "de la", "worthless", "idiot", "all rights reserved", "General Public License", "token"]
NOW = "timestamp'2024-01-31 00:00:00'"


def watchlist(spark: SparkSession, terms: list[str] = TERMS) -> DataFrame:
    return spark.createDataFrame([(i, t, "en", "newspaper", True) for i, t in enumerate(terms)], "id long, text string, language string, module string, active boolean")


NORM = r"trim(lower(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')))"
KW = "(SELECT unnest(['" + "','".join(TERMS) + "']) AS keyword)"
EDGE = r"[^\p{L}\p{N}_]"
HIT = rf"regexp_matches(norm, '(^|{EDGE})' || replace(lower(keyword), ' ', '\s+') || '($|{EDGE})')"
MATCHES = f"SELECT doc_id, keyword FROM (SELECT doc_id, {NORM} AS norm FROM documents), {KW} WHERE {HIT}"


@query(f"SELECT doc_id, keyword, 'en' AS language FROM ({MATCHES})")
def match_documents(spark, sf_dir):
    return match.match_documents(table(spark, sf_dir, "documents"), watchlist(spark))


@query(f"SELECT doc_id, string_agg(keyword, '|' ORDER BY keyword) AS labels FROM ({MATCHES}) GROUP BY doc_id")
def labels_per_document(spark, sf_dir):
    found = match.labels_per_document(match.match_documents(table(spark, sf_dir, "documents"), watchlist(spark)))
    return found.select("doc_id", F.array_join("labels", "|").alias("labels"))


@query(f"SELECT lower(k.keyword) AS keyword, count(m.doc_id) AS n FROM (SELECT * FROM {KW} UNION ALL SELECT 'never there') k LEFT JOIN ({MATCHES}) m ON m.keyword = k.keyword GROUP BY 1")
def keyword_counts(spark, sf_dir):
    labels = match.labels_per_document(match.match_documents(table(spark, sf_dir, "documents"), watchlist(spark)))
    return policy.keyword_counts(labels.withColumnRenamed("labels", "matched_keywords"), watchlist(spark, [*TERMS, "never there"]))


SNIPPET = f"""
WITH d AS (SELECT doc_id, text, {NORM} AS en, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS ur FROM documents),
p AS (SELECT *, CASE WHEN contains(en, 'worthless') THEN en WHEN contains(ur, 'worthless') THEN ur WHEN contains(en, 'nicht') THEN en WHEN contains(ur, 'nicht') THEN ur END AS form,
  CASE WHEN contains(en, 'worthless') OR contains(ur, 'worthless') THEN 'worthless' ELSE 'nicht' END AS kw FROM d),
q AS (SELECT *, greatest(0, strpos(form, kw) - 1 - 100) AS a, least(length(form), strpos(form, kw) - 1 + length(kw) + 100) AS b FROM p)
SELECT doc_id, CASE WHEN form IS NULL THEN trim(left(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'), 200))
  ELSE (CASE WHEN a > 0 THEN '…' ELSE '' END) || trim(form[a + 1:b]) || (CASE WHEN b < length(form) THEN '…' ELSE '' END) END AS snippet FROM q
"""


@query(SNIPPET)
def keyword_snippets(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.snippet(F.col("text"), ["worthless", "nicht"]).alias("snippet"))


@query(
    r"""SELECT doc_id, md5(regexp_replace(replace(replace(replace(replace(replace(trim(regexp_replace(regexp_replace(coalesce(text, ''), '[#*`_]+', ' ', 'g'), '\s{2,}', ' ', 'g'), e' \t\n\r\x0b\f'),
    '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;'), '(?i)(public license|worthless)', '<mark>\1</mark>', 'g')) AS html_md5 FROM documents"""
)
def highlight(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.highlight(F.col("text"), ["worthless", "public license"]).cast("binary")).alias("html_md5"))


LINES = r"list_filter(list_transform(string_split_regex(coalesce(text, ''), '\r\n|[\n\r\x0b\x0c\x1c-\x1e]'), lambda x: trim(x, e' \t\r')), lambda x: x <> '')"
GATE = rf"""
WITH d AS (SELECT doc_id, {LINES} AS l, regexp_replace(coalesce(text, ''), '\s+', ' ', 'g') AS f FROM documents),
n AS (SELECT *, length(f) > 800 AND ((length(f) - length(replace(f, right(f, 40), ''))) // 40 >= 5 OR (length(f) - length(replace(f, right(f, 80), ''))) // 80 >= 5 OR (length(f) - length(replace(f, right(f, 160), ''))) // 160 >= 5) AS again FROM d)
SELECT doc_id, CASE WHEN len(l) = 0 THEN 'empty' WHEN len(l) >= 8 AND len(list_distinct(l)) / len(l) < 0.55 THEN 'repeated lines' WHEN again THEN 'repeated phrase' ELSE '' END AS reason FROM n
"""


@query(GATE)
def repetition_gate(spark, sf_dir):
    return quality.repetition_gate(table(spark, sf_dir, "documents"))


@query(rf"""
WITH l AS (SELECT doc_id, unnest({LINES}) AS line, generate_subscripts({LINES}, 1) AS pos FROM documents),
c AS (SELECT doc_id, line, count(*) AS n, min(pos) AS pos FROM l GROUP BY ALL)
SELECT doc_id, sum(n)::BIGINT AS n_lines, count(*) AS n_unique, arg_max(line, n * 1000000 - pos) AS top_line, max(n) AS top_n FROM c GROUP BY doc_id
""")
def line_stats(spark, sf_dir):
    return quality.line_stats(table(spark, sf_dir, "documents"))


@query("SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 60")
def cap_per_source(spark, sf_dir):
    return feeds.cap_per_source(table(spark, sf_dir, "documents").select("doc_id", "source"), ["source"], ["doc_id"], 60)


@query(r"SELECT doc_id, coalesce(arg_max(w, length(w) * 100000000 - i), '') AS token FROM (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM (SELECT doc_id, string_split(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')), ' ') AS w FROM documents)) GROUP BY doc_id")
def longest_token(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.longest_token(F.coalesce("text", F.lit(""))).alias("token"))


@query(f"SELECT doc_id, md5(nfc_normalize({NORM})) AS en_md5, md5(trim(regexp_replace(nfc_normalize(coalesce(text, '')), '\\s+', ' ', 'g'))) AS ur_md5 FROM documents")
def normalize_text(spark, sf_dir):
    forms = [F.md5(T.normalize_text(F.col("text"), lang).cast("binary")).alias(f"{lang}_md5") for lang in ("en", "ur")]
    return table(spark, sf_dir, "documents").select("doc_id", *forms)


@query(f"SELECT doc_id FROM (SELECT doc_id, {NORM} AS norm FROM documents) WHERE contains(norm, 'worthless') OR contains(norm, 'reserved') OR contains(norm, 'license')")
def prefilter_candidates(spark, sf_dir):
    return match.prefilter_candidates(table(spark, sf_dir, "documents"), watchlist(spark, ["worthless", "all rights reserved", "public license"])).select("doc_id")


PHRASES = r"SELECT DISTINCT lower(array_to_string(regexp_extract_all(text, '[\p{L}\p{N}_]+')[1:4], ' ')) AS keyword FROM benchmark"


@query(f"SELECT doc_id, keyword FROM (SELECT doc_id, {NORM} AS norm FROM documents), ({PHRASES}) WHERE keyword <> '' AND {HIT}")
def benchmark_phrases(spark, sf_dir):
    words = F.slice(F.regexp_extract_all("text", F.lit(f"({T.WORD}+)"), F.lit(1)), 1, 4)
    phrases = table(spark, sf_dir, "benchmark").select(F.lower(F.array_join(words, " ")).alias("text"), F.lit("en").alias("language"))
    return match.match_documents(table(spark, sf_dir, "documents"), phrases).select("doc_id", "keyword")


@query("SELECT CASE WHEN regexp_matches(coalesce(text, ''), '[\\x{0600}-\\x{06FF}\\x{0750}-\\x{077F}\\x{FB50}-\\x{FDFF}\\x{FE70}-\\x{FEFF}]') THEN 'ur' ELSE 'en' END AS language, count(*) AS n FROM documents GROUP BY 1")
def script_languages(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(T.script_language(F.col("text")).alias("language")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, lang, source FROM documents QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY n_chars DESC, doc_id) = 1")
def distinct_first(spark, sf_dir):
    return match.distinct_first(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars"), ["lang", "source"], [F.desc("n_chars"), "doc_id"]).drop("n_chars")


@query(f"SELECT m.doc_id, m.labels, s.snippet FROM (SELECT doc_id, string_agg(keyword, '|' ORDER BY keyword) AS labels FROM ({MATCHES}) GROUP BY doc_id) m JOIN ({SNIPPET}) s USING (doc_id)")
def press_search_cards(spark, sf_dir):
    found = press_search(table(spark, sf_dir, "documents"), watchlist(spark), ["worthless", "nicht"])
    return found.select("doc_id", F.array_join("labels", "|").alias("labels"), "snippet")


@query(f"SELECT doc_id, keyword, 'en' AS language FROM ({MATCHES})")
def stream_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return drained(stream_matches(spark.readStream.schema(docs.schema).parquet(f"{sf_dir}/documents.parq*et"), watchlist(spark)), "matches")


def mentions_of(spark, sf_dir, keyword, least):
    """documents as mentions of one keyword, with the text as the hit's excerpt."""
    hit = F.struct(F.lit(0).alias("start"), F.lit(5).alias("end"), F.col("text").alias("excerpt"), F.lit(1.0).alias("confidence"), F.lit(None).cast("string").alias("screenshot"))
    docs = table(spark, sf_dir, "documents").where(least)
    return docs.select(
        F.col("doc_id").alias("id"), F.lit("newspaper").alias("module"), F.col("doc_id").cast("string").alias("external_id"), "source", F.lit("s").alias("section"), F.lit("t").alias("title"), F.lit("u").alias("url"), F.lit("").alias("deeplink"), F.lit("").alias("snippet"),
        F.array(F.lit(keyword)).alias("matched_keywords"), F.create_map(F.lit(keyword), F.array(hit)).alias("keyword_hits"), F.create_map().cast("map<string,string>").alias("keyword_media"),
    )


def _excerpt_hit(k):
    return rf"regexp_matches(trim(lower(regexp_replace(text, '\s+', ' ', 'g'))), '(^|{EDGE}){k}($|{EDGE})')"


@query(f"""
WITH o AS (SELECT * FROM documents WHERE lang IN ('en', 'de')), n AS (SELECT * FROM documents WHERE lang <> 'en')
SELECT doc_id::VARCHAR AS external_id, 'the' AS labels FROM o WHERE lang = 'en' UNION ALL SELECT doc_id::VARCHAR, 'and' FROM n WHERE lang <> 'de'
UNION ALL SELECT doc_id::VARCHAR, CASE WHEN {_excerpt_hit('and')} AND {_excerpt_hit('the')} THEN 'and|the' WHEN {_excerpt_hit('and')} THEN 'and' ELSE 'the' END FROM o WHERE lang = 'de' AND ({_excerpt_hit('and')} OR {_excerpt_hit('the')})
""")
def merge_mentions(spark, sf_dir):
    # English and German documents are stored, German and other ones come: German ones meet.
    merged, _ = merge.merge_mentions(mentions_of(spark, sf_dir, "the", "lang in ('en', 'de')"), mentions_of(spark, sf_dir, "and", "lang <> 'en'"))
    return merged.select("external_id", F.array_join("matched_keywords", "|").alias("labels"))


@query(f"SELECT doc_id AS id, 'the' AS labels FROM documents WHERE {_excerpt_hit('the')}")
def prune_hits(spark, sf_dir):
    return hits.prune_hits(mentions_of(spark, sf_dir, "the", "true")).where(F.size("matched_keywords") > 0).select("id", F.array_join("matched_keywords", "|").alias("labels"))


@query("""
WITH o AS (SELECT doc_id, coalesce(text, '') AS body FROM documents WHERE lang IN ('en', 'de')), n AS (SELECT doc_id, CASE WHEN n_chars < 1000 THEN '' ELSE lang END AS body FROM documents WHERE lang <> 'en')
SELECT coalesce(o.doc_id, n.doc_id)::VARCHAR AS external_id, md5(coalesce(nullif(n.body, ''), o.body, '')) AS body_md5, n.doc_id IS NOT NULL AS fetched FROM o FULL JOIN n ON o.doc_id = n.doc_id
""")
def upsert_cache(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.lit("newspaper").alias("module"), F.col("doc_id").cast("string").alias("external_id"), F.lit("t").alias("title"), F.coalesce("text", F.lit("")).alias("body"), "lang", "n_chars", F.lit(None).cast("timestamp").alias("fetched_at"))
    new = docs.where("lang <> 'en'").withColumn("body", F.expr("if(n_chars < 1000, '', lang)"))
    out = merge.upsert_cache(docs.where("lang in ('en', 'de')"), new, F.expr(NOW))
    return out.select("external_id", F.md5(F.coalesce("body", F.lit("")).cast("binary")).alias("body_md5"), F.col("fetched_at").isNotNull().alias("fetched"))


SEGMENTS = "(SELECT conv_id, list(struct_pack(turn := turn, text := coalesce(text, '')) ORDER BY turn) AS segs FROM conversations GROUP BY conv_id)"


def transcripts(spark, sf_dir):
    """conversations as transcripts: turn n speaks from second 10 n to 10 n + 10."""
    turns = table(spark, sf_dir, "conversations")
    none = F.lit(None).cast("double")
    seg = F.struct((F.col("turn") * 10.0).alias("start"), (F.col("turn") * 10.0 + 10).alias("end"), F.coalesce("text", F.lit("")).alias("text"), none.alias("avg_logprob"), none.alias("no_speech_prob"))
    return turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(seg)).alias("segments"))


@query(rf"SELECT conv_id, len(list_filter(segs[1:40], lambda s: len(list_filter(string_split(trim(regexp_replace(s.text, '\s+', ' ', 'g')), ' '), lambda w: w <> '')) <= 2)) / len(segs[1:40]) >= 0.7 AS by_word FROM {SEGMENTS}")
def is_word_level(spark, sf_dir):
    return transcripts(spark, sf_dir).select("conv_id", hits.is_word_level(F.col("segments")).alias("by_word"))


@query(f"SELECT conv_id, md5(array_to_string(list_filter(list_transform(segs, lambda s: trim(s.text)), lambda x: x <> ''), ' ')) AS text_md5 FROM {SEGMENTS}")
def chunk_join(spark, sf_dir):
    return transcripts(spark, sf_dir).select("conv_id", F.md5(hits.segments_text(F.col("segments")).cast("binary")).alias("text_md5"))


@query(f"SELECT conv_id, left(array_to_string(list_filter(list_transform(list_filter(segs, lambda s: s.turn * 10 + 10 >= 25 - 6 AND s.turn * 10 <= 25 + 6), lambda s: trim(s.text)), lambda x: x <> ''), ' '), 240) AS excerpt FROM {SEGMENTS}")
def excerpt_around(spark, sf_dir):
    return transcripts(spark, sf_dir).select("conv_id", hits.excerpt_around(F.col("segments"), F.lit(25)).alias("excerpt"))


@query(f"SELECT conv_id, len(list_filter(segs, lambda s: s.turn * 10 + 10 >= 20 - 3 AND s.turn * 10 <= 20 + 3)) AS n FROM {SEGMENTS}")
def segments_near(spark, sf_dir):
    return transcripts(spark, sf_dir).select("conv_id", F.size(hits.segments_near(F.col("segments"), F.lit(20), 3)).alias("n"))


@query(r"""SELECT conv_id, turn, len(list_filter(range(1, len(t)), lambda i: t[i] = 'of' AND t[i + 1] = 'the')) AS n
FROM (SELECT conv_id, turn, regexp_extract_all(trim(lower(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))), '[\p{L}\p{N}_]+') AS t FROM conversations)""")
def phrase_positions(spark, sf_dir):
    words = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(F.array(T.word_tokens(T.normalize_text(F.col("text"), "en")))).alias("w"))
    return words.select("conv_id", "turn", F.size(hits.phrase_positions(F.col("w"), F.array(F.lit("of"), F.lit("the")))).alias("n"))


@query(r"""
WITH t AS (SELECT conv_id, turn, list_distinct(list_filter(string_split(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')), ' '), lambda w: w <> '')) AS w FROM conversations),
p AS (SELECT conv_id, turn, w, lag(w) OVER (PARTITION BY conv_id ORDER BY turn) AS v FROM t)
SELECT conv_id, turn, round(CASE WHEN v IS NULL OR len(v) = 0 OR len(w) = 0 THEN 0.0 ELSE len(list_intersect(v, w)) / len(list_distinct(list_concat(v, w))) END, 6) AS alike FROM p
""")
def word_jaccard(spark, sf_dir):
    from pyspark.sql import Window

    turns = table(spark, sf_dir, "conversations")
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return turns.withColumn("b", before).select("conv_id", "turn", F.round(T.word_jaccard(F.coalesce("b", F.lit("")), F.coalesce("text", F.lit(""))), 6).alias("alike"))


@query("SELECT conv_id, round(greatest(count(*) * 10.0, 10) / 3600 * 0.04, 6) AS cost FROM conversations GROUP BY conv_id")
def transcription_cost(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg((F.count("*") * 10).alias("d")).select("conv_id", hits.transcription_cost(F.col("d"), F.lit("whisper-large-v3-turbo")).alias("cost"))


@query()
def locate_hits(spark, sf_dir):
    # Anchored folds over located times are no SQL; tests compare with a walk in plain Python.
    found = hits.locate_hits(transcripts(spark, sf_dir), watchlist(spark), "conv_id")
    return found.select("conv_id", "keyword", F.inline("hits"))


EVENT_TIME = "epoch(date_trunc('second', ts))::BIGINT"


@query(f"""
WITH e AS (SELECT event_id, user_id, event_type, {EVENT_TIME} AS t FROM events)
SELECT event_id, user_id, event_type, t FROM (SELECT *, lag(t) OVER (PARTITION BY user_id, event_type ORDER BY t, event_id) AS b FROM e) WHERE b IS NULL OR t - b >= 86400
""")
def ticker_events(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.unix_timestamp("ts").alias("t"))
    # Reads of one second are one match, so which of them comes first decides nothing but the id that is shown.
    first = events.groupBy("user_id", "event_type", "t").agg(F.min("event_id").alias("event_id"))
    return ticker.ticker_events(first, 86_400, ("user_id", "event_type")).select("event_id", "user_id", "event_type", "t")


@query(f"""
WITH e AS (SELECT event_id AS id, CASE WHEN user_id % 3 = 0 THEN 'epaper' ELSE 'newspaper' END AS module, event_type, ts FROM events WHERE ts >= {NOW} - INTERVAL 90 DAY)
SELECT id, module, event_type AS label FROM e QUALIFY row_number() OVER (PARTITION BY module, event_type ORDER BY ts DESC, id) <= 25
""")
def enforce_limits(spark, sf_dir):
    out = policy.enforce_limits(event_mentions(spark, sf_dir), F.expr(NOW))
    return out.select("id", "module", F.array_join("matched_keywords", "|").alias("label"))


def event_mentions(spark, sf_dir):
    """events as mentions: the type is the keyword, the user decides the module."""
    path = F.concat(F.lit("/m/"), "event_id")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.when(F.col("user_id") % 3 == 0, "epaper").otherwise("newspaper").alias("module"), F.col("event_id").cast("string").alias("external_id"), (F.col("user_id") % 10).cast("string").alias("source"), F.col("ts").alias("published_at"), F.col("ts").alias("detected_at"),
        F.array("event_type").alias("matched_keywords"), F.create_map(F.col("event_type"), path).alias("keyword_media"), path.alias("screenshot_path"), F.lit(None).cast("string").alias("full_screenshot_path"),
        F.when(F.col("event_type") == "click", "Positive").when(F.col("event_type") == "error", "Negative").otherwise("Neutral").alias("sentiment"),
    )


@query(f"""
WITH e AS (SELECT event_id AS id, CASE WHEN user_id % 3 = 0 THEN 'epaper' ELSE 'newspaper' END AS module, event_type, ts, value FROM events),
k AS (SELECT id FROM e WHERE ts >= {NOW} - INTERVAL 90 DAY QUALIFY row_number() OVER (PARTITION BY module, event_type ORDER BY ts DESC, id) <= 25)
SELECT '/m/' || id AS path FROM e WHERE id NOT IN (SELECT id FROM k) AND event_type <> 'click'
""")
def orphan_media(spark, sf_dir):
    before = event_mentions(spark, sf_dir)
    used = before.where("matched_keywords[0] = 'click'").select(F.col("screenshot_path").alias("image_path"))
    return policy.orphan_media(before, policy.enforce_limits(before, F.expr(NOW)), used)


@query(f"SELECT event_type, count(*) AS n FROM events WHERE ts >= {NOW} - INTERVAL 10 DAY GROUP BY 1")
def within_retention(spark, sf_dir):
    return policy.within_retention(table(spark, sf_dir, "events"), F.expr(NOW), 10, F.col("ts")).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT event_id FROM events WHERE ts BETWEEN timestamp'2024-01-05 00:00:00' AND timestamp'2024-01-06 12:00:00' AND event_type <> 'error'")
def published_between(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("live", F.col("event_type") == "error")
    return policy.published_between(events, F.expr("timestamp'2024-01-05 00:00:00'"), F.expr("timestamp'2024-01-06 12:00:00'"), "ts").select("event_id")


@query("""
WITH e AS (SELECT event_id, user_id, event_type, value FROM events), x AS (SELECT DISTINCT user_id, event_type FROM e WHERE value > 150),
f AS (SELECT * FROM e WHERE (user_id, event_type) NOT IN (SELECT (user_id, event_type) FROM x) QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1)
SELECT user_id::VARCHAR AS external_id, event_type AS keyword, event_id AS pos FROM f QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id, user_id::VARCHAR) + 10 <= 25
""")
def admit_new(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.lit("m").alias("module"), F.col("user_id").cast("string").alias("external_id"), F.col("event_type").alias("keyword"), F.col("event_id").alias("pos"), "value")
    counts = events.select("keyword").distinct().withColumn("n", F.lit(10))
    return policy.admit_new(events, events.where("value > 150"), counts).drop("module")


SNAP = """
WITH e AS (SELECT event_id, user_id, event_type, ts, (hour(ts + INTERVAL 5 HOUR) * 60 + minute(ts))::INT AS m FROM events),
c AS (SELECT * FROM (VALUES (0, '00:00:00', 0), (1, '06:00:00', 360), (2, '09:00:00', 540), (3, '12:00:00', 720), (4, '15:00:00', 900), (5, '18:00:00', 1080), (6, '21:00:00', 1260)) AS c(i, slot, s)),
d AS (SELECT e.*, slot, i, least(abs(m - s), 1440 - abs(m - s)) AS d FROM e, c)
SELECT event_id, user_id, event_type, ts, arg_min(slot, d * 10 + i) AS slot, min(d) AS d FROM d GROUP BY ALL HAVING min(d) <= 90
"""
SNAP = SNAP.replace("event_type, ts, arg_min", "event_type, ts, arg_min").replace("GROUP BY ALL", "GROUP BY event_id, user_id, event_type, ts")


@query(f"SELECT slot, count(*) AS n FROM ({SNAP}) GROUP BY slot")
def snap_to_slot(spark, sf_dir):
    local = F.from_utc_timestamp("ts", times.ZONE)
    got = table(spark, sf_dir, "events").select(slots.snap_to_slot(F.hour(local) * 60 + F.minute(local)).alias("s")).where("s is not null")
    return got.groupBy(F.col("s.slot").alias("slot")).agg(F.count("*").alias("n"))


@query(f"""
SELECT user_id::VARCHAR AS channel_id, slot, n, example FROM (SELECT user_id, slot, count(*) AS n, arg_min(event_type || ' headlines', (ts, event_type)) AS example FROM ({SNAP})
WHERE ts >= {NOW} - INTERVAL 21 DAY GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, slot) <= 5
""")
def detect_slots(spark, sf_dir):
    uploads = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("channel_id"), F.concat("event_type", F.lit(" headlines")).alias("title"), F.col("ts").alias("published"), F.lit(600).alias("duration_seconds"), F.lit(False).alias("live"))
    return slots.detect_slots(uploads, F.expr(NOW)).drop("label")


@query(f"""
SELECT (user_id % 10)::VARCHAR AS source, count(*) FILTER (event_type = 'click') AS "Positive", count(*) FILTER (event_type = 'error') AS "Negative", count(*) FILTER (event_type NOT IN ('click', 'error')) AS "Neutral"
FROM events WHERE ts > timestamp'2024-01-10 00:00:00' - INTERVAL 1 DAY AND ts <= timestamp'2024-01-10 00:00:00' GROUP BY 1
""")
def daily_digest(spark, sf_dir):
    return policy.daily_digest(event_mentions(spark, sf_dir), F.expr("timestamp'2024-01-10 00:00:00'"))


@query("SELECT user_id, round(avg(value), 6) AS avg_logprob, count(value) AS n FROM events GROUP BY user_id")
def transcript_confidence(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumnRenamed("value", "avg_logprob")
    return hits.transcript_confidence(events, ["user_id"]).select("user_id", F.round("avg_logprob", 6).alias("avg_logprob"), "n")


@query("SELECT event_id, user_id, event_type FROM events QUALIFY row_number() OVER (ORDER BY ts DESC, event_id DESC) <= 50")
def list_mentions(spark, sf_dir):
    found = policy.list_mentions(event_mentions(spark, sf_dir), None, 50).select(F.col("id").alias("event_id"), F.get("matched_keywords", F.lit(0)).alias("event_type"))
    return found.join(table(spark, sf_dir, "events").select("event_id", "user_id"), "event_id")


ORIGIN = r"nullif(regexp_extract(url, '^(https?://[^/?#]+)', 1), '')"
PATH = r"coalesce(nullif(rtrim(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/'), ''), '/')"


@query(rf"""
SELECT page_id, {ORIGIN} AS origin, {PATH} AS path, {PATH} <> '/' AND NOT regexp_matches({PATH}, '(?i)/(?:{urls.LISTING_PARTS}|(?:{urls.LISTING_ENDS})/?$)(?:/|$)') AND NOT regexp_matches({PATH}, '(?i)\.(?:{urls.ASSETS})(?:\?|$)')
AND (regexp_matches({PATH}, '/\d{{3,}}') OR regexp_matches({PATH}, '(?i)/(?:{urls.STORY_PARTS})/') OR (len(list_filter(string_split({PATH}, '/'), lambda p: p <> '')) >= 2 AND length(list_filter(string_split({PATH}, '/'), lambda p: p <> '')[-1]) >= 16)) AS article FROM pages
""")
def page_urls(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", urls.url_origin(url).alias("origin"), urls.url_path(url).alias("path"), urls.is_article_url(url).alias("article"))


@query()
def main_text(spark, sf_dir):
    found = pages.extract_main_text(table(spark, sf_dir, "pages"))
    return found.select("page_id", F.length("text").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query(rf"""
WITH a AS (SELECT page_id, {ORIGIN} AS origin, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages),
u AS (SELECT page_id, regexp_replace(CASE WHEN starts_with(href, '/') THEN origin || href ELSE href END, '#.*$', '') AS u FROM a WHERE NOT regexp_matches(href, '^(#|javascript:|mailto:|tel:)|^$'))
SELECT DISTINCT page_id, u AS url FROM u
""")
def page_links(spark, sf_dir):
    return pages.extract_links(table(spark, sf_dir, "pages"), least_title=0, pattern=".").select("page_id", "url")


@query(r"""
SELECT page_id, 0 AS regions, len(list_filter(regexp_extract_all(html, '(?i)<img\b[^>]*>'), lambda i: regexp_matches(i, '(?i)\ssrc\s*=\s*"[^"]*(page|epaper|\.jpe?g)'))) AS images, 0 AS links,
CASE WHEN len(list_filter(regexp_extract_all(html, '(?i)<img\b[^>]*>'), lambda i: regexp_matches(i, '(?i)\ssrc\s*=\s*"[^"]*(page|epaper|\.jpe?g)'))) > 0 THEN 'image_only' ELSE 'unknown' END AS mode FROM pages
""")
def source_probe_summary(spark, sf_dir):
    return pages.source_probe_summary(table(spark, sf_dir, "pages"))


@query("SELECT vec_id, len(list_filter(embedding, lambda x: x::DOUBLE > list_sum(list_transform(embedding, lambda y: y::DOUBLE)) / len(embedding))) AS ones FROM embeddings")
def bit_signature(spark, sf_dir):
    sig = ticker.bit_signature(F.transform("embedding", lambda x: x.cast("double")))
    return table(spark, sf_dir, "embeddings").select("vec_id", sig.alias("s")).select("vec_id", F.aggregate("s", F.lit(0), lambda a, x: a + x).alias("ones"))


@query("""
WITH s AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE > list_sum(list_transform(embedding, lambda y: y::DOUBLE)) / len(embedding)) AS s FROM embeddings)
SELECT a.vec_id, len(list_filter(range(1, len(a.s) + 1), lambda i: a.s[i] <> b.s[i])) AS distance FROM s a JOIN s b ON b.vec_id = a.vec_id + 1
""")
def hamming(spark, sf_dir):
    s = table(spark, sf_dir, "embeddings").select("vec_id", ticker.bit_signature(F.transform("embedding", lambda x: x.cast("double"))).alias("s"))
    b = s.select((F.col("vec_id") - 1).alias("vec_id"), F.col("s").alias("t"))
    return s.join(b, "vec_id").select("vec_id", ticker.hamming(F.col("s"), F.col("t")).alias("distance"))


@query()
def suppress_near_duplicates(spark, sf_dir):
    frames = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 50).alias("stream_id"), F.col("vec_id").alias("t"), ticker.bit_signature(F.transform("embedding", lambda x: x.cast("double"))).alias("signature"))
    return ticker.suppress_near_duplicates(frames)


@query("""
SELECT d.doc_id, CASE WHEN l.quality = 1 THEN 'Positive' WHEN l.quality = 0 THEN 'Negative' ELSE '' END AS label
FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l USING (doc_id)
""")
def align_batch_labels(spark, sf_dir):
    where = ((F.col("doc_id") / 8).cast("long").alias("batch"), (F.col("doc_id") % 8).cast("int").alias("pos"))
    items = table(spark, sf_dir, "documents").select("doc_id", *where)
    known = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality")).select(*where, F.when(F.col("quality") == 1, " positive ").otherwise("NEGATIVE").alias("l"))
    place = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.try_element_at("m", i))
    replies = known.groupBy("batch").agg(F.map_from_entries(F.collect_list(F.struct("pos", "l"))).alias("m")).select("batch", place.alias("labels"))
    return feeds.align_batch_labels(items, replies).select("doc_id", "label")


@query("""
SELECT l_suppkey, l_orderkey, l_linenumber FROM (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_linenumber ORDER BY l_orderkey) <= 4)
QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_linenumber, l_orderkey) <= 24
""")
def cap_hits(spark, sf_dir):
    found = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("source"), F.col("l_linenumber").alias("page_no"), F.col("l_orderkey").alias("region_no"))
    return feeds.cap_hits(found).select(F.col("source").alias("l_suppkey"), F.col("region_no").alias("l_orderkey"), F.col("page_no").alias("l_linenumber"))


PRICE = "round(l_extendedprice / 10000, 2)::DOUBLE"


def priced(spark, sf_dir):
    """lineitem with PRICE as score: the product is rounded, as in the SQL, not the decimal digits of the price."""
    score = F.round(F.col("l_extendedprice") / 10000 * 100, 0) / 100
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", score.cast("double").alias("score"))


@query(f"""
WITH r AS (SELECT l_orderkey, l_linenumber, {PRICE} AS score, row_number() OVER w AS n, lead({PRICE}) OVER w AS nxt FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY {PRICE} DESC, l_linenumber))
SELECT l_orderkey, l_linenumber, coalesce(score - nxt < 0.75, false) AS needs_review FROM r WHERE n = 1
""")
def pick_best(spark, sf_dir):
    scored = priced(spark, sf_dir)
    return slots.pick_best(scored, ["l_orderkey"], [F.asc_nulls_last("l_linenumber")]).select("l_orderkey", "l_linenumber", "needs_review")


@query(f"SELECT l_orderkey, string_agg(l_linenumber, ',' ORDER BY n) AS best FROM (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY {PRICE} DESC, l_linenumber) AS n FROM lineitem) WHERE n <= 3 GROUP BY l_orderkey")
def top_candidates(spark, sf_dir):
    scored = priced(spark, sf_dir)
    top = slots.top_candidates(scored, ["l_orderkey"], ["l_linenumber"], 3, ("l_linenumber",))
    return top.select("l_orderkey", F.array_join(F.transform("candidates", lambda c: c["l_linenumber"].cast("string")), ",").alias("best"))


def bulletins(spark, sf_dir):
    """orders as bulletins: the customer is the channel, the priority the slot, the status the state."""
    status = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("bulletin_id"), F.col("o_custkey").cast("string").alias("channel_id"), F.left("o_orderpriority", F.lit(1)).cast("long").alias("slot_id"), F.to_date("o_orderdate").cast("string").alias("slot_date"), F.concat(F.lit("0"), F.left("o_orderpriority", F.lit(1)), F.lit(":00:00")).alias("local_time"),
        F.when(status != "P", F.col("o_orderkey").cast("string")).alias("video_id"), F.when(status == "F", "ready").when(status == "P", "missing").otherwise("pending").alias("discovery_status"), F.when(status == "F", "done").otherwise("pending").alias("transcription_status"), (F.col("o_orderkey") % 3).cast("int").alias("attempts"),
    )


@query("SELECT CASE o_orderstatus WHEN 'F' THEN 'ready' WHEN 'P' THEN 'late/missing' ELSE 'waiting' END AS status, count(*) AS n FROM orders GROUP BY 1")
def bulletin_status(spark, sf_dir):
    return bulletins(spark, sf_dir).groupBy(slots.bulletin_status(F.col("discovery_status"), F.col("transcription_status")).alias("status")).agg(F.count("*").alias("n"))


@query("SELECT left(o_orderpriority, 1)::BIGINT AS slot_id, count(DISTINCT o_custkey) AS channels, count(*) AS checked, count(*) FILTER (o_orderstatus <> 'P') AS discovered, count(*) FILTER (o_orderstatus = 'F') AS transcribed, count(*) FILTER (o_orderstatus = 'P') AS missing, 0 AS mentions, 0 AS alerts, 0 AS failed, 0 AS needs_review, 0.0::DOUBLE AS cost_usd_est FROM orders GROUP BY 1")
def scan_summary(spark, sf_dir):
    return slots.scan_summary(bulletins(spark, sf_dir), ["slot_id"])


@query("""
SELECT o_orderkey AS bulletin_id FROM orders WHERE true AND (epoch(timestamp'1997-01-01 12:00:00') - epoch(o_orderdate::DATE::TIMESTAMP + to_hours(left(o_orderpriority, 1)::INT) - INTERVAL 5 HOUR)) / 60 >= CASE o_orderkey % 3 WHEN 0 THEN 60 WHEN 1 THEN 90 ELSE 120 END
AND (o_orderstatus = 'O' OR o_orderstatus = 'P')
""")
def is_due(spark, sf_dir):
    return slots.is_due(bulletins(spark, sf_dir), F.expr("timestamp'1997-01-01 12:00:00'")).select("bulletin_id")


@query("""
WITH o AS (SELECT o_custkey::VARCHAR AS channel_id, left(o_orderpriority, 1)::BIGINT AS slot_id, o_orderdate::DATE::VARCHAR AS slot_date FROM orders),
d AS (SELECT DISTINCT slot_date FROM o ORDER BY slot_date DESC LIMIT 4), s AS (SELECT DISTINCT channel_id, slot_id FROM o JOIN customer ON c_custkey::VARCHAR = channel_id WHERE c_acctbal > 0)
SELECT channel_id, slot_id, slot_date FROM s, d EXCEPT SELECT channel_id, slot_id, slot_date FROM o
""")
def expected_bulletins(spark, sf_dir):
    b = bulletins(spark, sf_dir)
    channels = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("channel_id"), (F.col("c_acctbal") > 0).alias("active"))
    own = b.select("channel_id", "slot_id").distinct().select("*", F.lit(True).alias("enabled"), F.lit(None).cast("string").alias("effective_from"), F.lit(None).cast("string").alias("effective_to"))
    days = b.select(F.col("slot_date").alias("day")).distinct().orderBy(F.desc("day")).limit(4)
    return slots.expected_bulletins(channels, own, days, b)


@query("""
SELECT o_orderkey AS bulletin_id, c_name AS name, left(o_orderpriority, 1)::BIGINT AS slot_id FROM orders JOIN customer ON c_custkey = o_custkey
WHERE o_orderdate::DATE = (SELECT min(o_orderdate::DATE) FROM orders WHERE o_orderstatus <> 'P') AND o_orderstatus <> 'P'
""")
def bulletins_with_dims(spark, sf_dir):
    b = bulletins(spark, sf_dir)
    day = b.where("video_id is not null").agg(F.min("slot_date")).first()[0]
    channels = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("channel_id"), F.col("c_name").alias("name"))
    dims = b.select("slot_id", F.col("local_time").alias("label")).distinct().withColumn("local_time", F.col("label"))
    return slots.bulletins_with_dims(b.drop("local_time"), channels, dims, day).select("bulletin_id", "name", "slot_id")


@query("SELECT o_custkey::VARCHAR AS channel_id, o_orderkey AS bulletin_id FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate::DATE DESC, left(o_orderpriority, 1) DESC, o_orderkey) = 1")
def latest_slot_status(spark, sf_dir):
    channels = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("channel_id"), F.col("c_name").alias("name"), F.lit(True).alias("active"))
    return slots.latest_slot_status(bulletins(spark, sf_dir), channels, F.expr("timestamp'2001-01-01 00:00:00'")).where("bulletin_id is not null").select("channel_id", "bulletin_id")


@query("""
SELECT o_orderkey AS bulletin_id FROM orders LEFT JOIN (SELECT l_orderkey, min(l_shipdate::DATE) AS made, count(*) AS n FROM lineitem GROUP BY 1) t ON l_orderkey = o_orderkey
WHERE l_orderkey IS NULL OR n = 1 OR (n = 2 AND epoch(timestamp'1996-01-01 00:00:00') - epoch(made::TIMESTAMP) >= 1200)
""")
def needs_transcription(spark, sf_dir):
    videos = bulletins(spark, sf_dir).select("bulletin_id", F.col("bulletin_id").alias("video_id"))
    made = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("video_id")).agg(F.min(F.to_date("l_shipdate")).cast("timestamp").alias("created_at"), F.count("*").alias("n"))
    marker = F.when(F.col("n") == 1, "metadata").when(F.col("n") == 2, "transcribing").otherwise("large")
    made = made.select("video_id", "created_at", marker.alias("transcriber"), F.lit("large").alias("model"))
    return slots.needs_transcription(videos, made, F.expr("timestamp'1996-01-01 00:00:00'")).select("bulletin_id")


@query("SELECT c_mktsegment AS text, 'en' AS language, 'newspaper' AS module, true AS active FROM customer GROUP BY 1 UNION ALL SELECT p_brand, 'en', 'newspaper', true FROM part GROUP BY 1")
def upsert_keywords(spark, sf_dir):
    segments = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("text")).agg(F.min("c_custkey").alias("id"))
    old = segments.select("id", "text", F.lit("ur").alias("language"), F.lit("newspaper").alias("module"), F.lit(False).alias("active"))
    new = table(spark, sf_dir, "part").select(F.col("p_brand").alias("text")).union(segments.select(F.lower("text"))).select("text", F.lit("ur").alias("language"), F.lit("newspaper").alias("module"))
    return merge.upsert_keywords(old, new).drop("id")


@query("SELECT sha1(string_agg(c_mktsegment || chr(31) || 'en', chr(10) ORDER BY c_mktsegment)) AS fingerprint FROM (SELECT DISTINCT c_mktsegment FROM customer)")
def keyword_fingerprint(spark, sf_dir):
    return match.keyword_fingerprint(table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("text"), F.lit("en").alias("language")).distinct())


@query("SELECT 'newspaper' AS module, count(*) AS n FROM documents UNION ALL SELECT 'epaper', count(*) FROM pages UNION ALL SELECT 'youtube', count(DISTINCT conv_id) FROM conversations")
def union_results(spark, sf_dir):
    web = table(spark, sf_dir, "documents").select(F.lit("newspaper").alias("module"), F.col("doc_id").cast("string").alias("external_id"), "source")
    epaper = table(spark, sf_dir, "pages").select(F.lit("epaper").alias("module"), F.col("page_id").cast("string").alias("external_id"), "url")
    video = table(spark, sf_dir, "conversations").select(F.lit("youtube").alias("module"), F.col("conv_id").cast("string").alias("external_id")).distinct()
    return merge.union_results(web, epaper, video).groupBy("module").agg(F.count("*").alias("n"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
