"""What merging and pruning keep, on literal rows."""

import datetime as dt

from pyspark.sql import functions as F

from pressglass import schemas
from pressglass.operators import hits, match, merge, pages, slots, ticker

NOW = dt.datetime(2026, 7, 21, 12, 0)


def test_keywords_that_a_batch_does_not_name_stay(spark):
    old = [(1, "kashmir", "en", "newspaper", False, NOW), (2, "Kashmir", "ur", "newspaper", True, NOW), (3, "quiet", "en", "newspaper", False, NOW), (4, "میسی", "en", "newspaper", True, NOW), (5, "kashmir", "en", "youtube", False, NOW)]
    new = [("KASHMIR", "en", "newspaper"), (" ", "en", "newspaper"), ("میسی", "en", "newspaper"), ("Sarah Ahmed", "en", "newspaper"), ("sarah  ahmed", "en", "newspaper"), (None, "en", "newspaper")]
    got = merge.upsert_keywords(spark.createDataFrame(old, schemas.KEYWORDS), spark.createDataFrame(new, "text string, language string, module string")).collect()
    rows = {(r.id, r.text): (r.language, r.active, r.created_at) for r in got}
    assert rows == {(1, "kashmir"): ("en", True, NOW), (2, "Kashmir"): ("ur", True, NOW), (3, "quiet"): ("en", False, NOW), (4, "میسی"): ("ur", True, NOW), (5, "kashmir"): ("en", False, NOW), (None, "Sarah Ahmed"): ("en", True, None)}


def test_cache_and_transcripts_keep_their_columns(spark):
    old = spark.createDataFrame([("newspaper", "a", "t", "u", "body", NOW, NOW), ("newspaper", "b", "t", "u", "b", NOW, NOW)], schemas.ARTICLE_CACHE)
    new = spark.createDataFrame([("newspaper", "a", "", None, "longer body", None, None), ("newspaper", "c", "n", "v", "x", None, None)], schemas.ARTICLE_CACHE)
    got = merge.upsert_cache(old, new, F.lit(dt.datetime(2026, 8, 1)))
    rows = {r.external_id: tuple(r) for r in got.collect()}
    assert got.columns == old.columns and rows["b"][3:6] == ("u", "b", NOW)
    assert rows["a"] == ("newspaper", "a", "t", "u", "longer body", NOW, dt.datetime(2026, 8, 1)) and rows["c"][3] == "v"
    old = spark.createDataFrame([("v", "c", 7, "transcribing", "m", "ur", "", [], {"avg_logprob": -0.1}, NOW), ("w", "c", 8, "transcribing", "m", "ur", " ", [], None, NOW)], schemas.TRANSCRIPTS)
    made = spark.createDataFrame([("v", "words", "large", None)], f"video_id string, text string, model string, segments array<{schemas.SEGMENT}>")
    done = merge.finalize_transcripts(old, made)
    (row,) = done.collect()
    assert done.columns == old.columns and (row.channel_id, row.bulletin_id, row.language, row.text, row.transcriber, row.created_at) == ("c", 7, "ur", "words", "transcribed", NOW)


def hit(start, text):
    return {"start": start, "end": start + 1, "excerpt": text, "confidence": None, "screenshot": None}


def mention(i, key, found):
    return {"id": i, "module": "youtube", "external_id": key, "title": "t", "url": "u", "matched_keywords": sorted(found), "keyword_hits": found, "keyword_media": {}}


def test_mentions_without_hits_are_not_put_in(spark):
    old = spark.createDataFrame([mention(1, "a", {"flood": [hit(3, "a flood")]}) | {"section": "s"}], schemas.MENTIONS)
    new = spark.createDataFrame([mention(None, "a", {}) | {"section": "later"}, mention(None, "b", {"rain": []}), mention(None, "c", {"rain": [hit(1, "rain")]})], schemas.MENTIONS)
    merged, alerts = merge.merge_mentions(old, new)
    assert {(r.external_id, r.section) for r in merged.collect()} == {("a", "s"), ("c", None)}
    assert [r.external_id for r in alerts.collect()] == ["c"]


def test_keywords_in_two_languages(spark):
    located = spark.createDataFrame([("v", "news", "en", [(5, 6, "news")]), ("v", "news", "ur", [(5, 6, "news"), (2, 3, "news")]), ("v", "x", "en", [])], f"video_id string, keyword string, language string, hits {hits.HIT}")
    (row,) = hits.hits_map(located).collect()
    assert [h.start for h in row.keyword_hits["news"]] == [2, 5] and list(row.keyword_hits) == ["news"]
    rows = spark.createDataFrame([mention(1, "a", {"News": [hit(3, "the news"), hit(9, "nothing")], "gone": [hit(1, "nothing")]}), mention(2, "b", {"other": [hit(1, "no")]})], schemas.MENTIONS)
    languages = spark.createDataFrame([("News", "en"), ("News", "ur"), ("unused", "en")], "text string, language string")
    got = {r.id: r for r in hits.prune_hits(rows, languages).collect()}
    assert got[1].matched_keywords == ["News"] and [h.start for h in got[1].keyword_hits["News"]] == [3] and got[2].matched_keywords == []
    assert {r.id: r.matched_keywords for r in hits.prune_hits(rows).collect()} == {1: ["News"], 2: []}


def test_claims(spark):
    ago = lambda s: NOW - dt.timedelta(seconds=s)
    rows = [("stub", "groq", "metadata", ago(9)), ("stub2", "metadata", None, ago(9)), ("fresh", "Transcribing", None, ago(1_199)), ("stale", "transcribing", None, ago(1_200)), ("undated", "transcribing", None, None), ("real", "groq", "large", ago(99_999)), ("empty", "groq", "large", ago(99_999))]
    made = spark.createDataFrame([(*r, "") for r in rows], "video_id string, transcriber string, model string, created_at timestamp, text string")
    videos = spark.createDataFrame([(r[0],) for r in rows] + [("absent",)], "video_id string")
    assert {r.video_id for r in slots.needs_transcription(videos, made, F.lit(NOW)).collect()} == {"stub", "stub2", "stale", "absent"}


def test_links_of_pages_with_one_id(spark):
    html = '<a href="/2026/07/21/a-long-story-title-here">A title long enough to count</a>'
    rows = [(1, "http://a.org/", html), (1, "http://b.org/", html), (None, "http://c.org/", html), (2, "http://d.org/", None)]
    got = pages.extract_links(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted(r.url for r in got) == [f"http://{x}.org/2026/07/21/a-long-story-title-here" for x in "abc"]


def test_streams_are_walked_in_order(spark):
    lines = [("a", 12, "a b c"), ("a", 10, "a"), ("a", 11, "a b"), ("a", 13, " "), ("b", 5, "one"), ("b", 6, "two"), ("b", 7, "three"), ("c", 1, None)]
    got = ticker.merge_ticker(spark.createDataFrame(lines, schemas.TICKER)).collect()
    assert sorted(tuple(r) for r in got) == [("a", 10, "a b c"), ("b", 5, "one"), ("b", 6, "two"), ("b", 7, "three")]
    frames = [("s", t, [int(t * 7 // 2**i % 2) for i in range(12)]) for t in range(40)] + [("r", 0, [1] * 12), ("r", 1, [1] * 12)]
    kept, last = [], None
    for s, t, bits in frames:
        if last is None or last[0] != s or sum(a != b for a, b in zip(last[1], bits, strict=True)) > 3:
            kept.append((s, t))
            last = s, bits
    got = ticker.suppress_near_duplicates(spark.createDataFrame(frames, "stream_id string, t int, signature array<int>").repartition(5), 3).collect()
    assert sorted(map(tuple, got)) == sorted(kept) and 2 < len(kept) < 41


def test_long_watchlists_match_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "rain and flood, again"), (2, "heavy rain fell"), (3, "#$% sign"), (4, None)], "doc_id long, text string")
    words = spark.createDataFrame([("rain", "en"), ("heavy rain", "en"), ("#$%", "en"), ("flood", "ur"), (" ", "en")], "text string, language string")
    want = {(1, "rain", "en"), (2, "rain", "en"), (2, "heavy rain", "en"), (3, "#$%", "en"), (1, "flood", "ur")}
    assert {tuple(r) for r in match.match_documents(docs, words).collect()} == want
    monkeypatch.setattr(match, "PLAN_KEYWORDS", 2)
    assert {tuple(r) for r in match.match_documents(docs, words).collect()} == want
    assert {r.doc_id for r in match.prefilter_candidates(docs, words).collect()} == {1, 2, 3}
