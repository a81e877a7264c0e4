"""Long watchlists, rows without or with repeated ids, keywords in two languages, joins in time, edge cases of pages."""

import datetime as dt
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from pressglass import schemas
from pressglass.functions import text as T
from pressglass.operators import feeds, hits, match, pages, policy, timelines
from pressglass.plans import search
from pressglass.storage import drained
from pressglass.streaming.operators import stream_matches

NOW = dt.datetime(2026, 7, 21, 12, 0)
ODD = ["the rape. a.b", "x a.b y", "xa.b", "a.by", "#tag", "x#tag", "# tag", "tag #", "foreign, affairs", "foreign affairs", "Foreign  AFFAIRS today", "c++ code", "c+ + code", "حکومت پاكستان نے", "$%", "a$%b", "$ %", "qx here", "end of the end of", None, ""]
WORDS = ["rape", "a.b", "#tag", "foreign affairs", "c++", "پاکستان", "$%", "qx", "the end of", "end of the end", "tag", "%", "_", "of"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i % 7 if i % 5 else None, t) for i, t in enumerate(ODD)] + [(1, "foreign affairs"), (1, "nothing"), (None, "the #tag of it"), (None, "the #tag of it")]
    keywords = [(w, "ur" if w == "پاکستان" else "en") for w in WORDS] + [("tag", "ur"), (" ", "en")]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(keywords, "text string, language string")


def test_all_forms_of_matching_agree(odd, monkeypatch):
    docs, keywords = odd
    want = sorted(map(str, match.match_documents_theta(docs, keywords).collect()))
    assert sorted(map(str, match.match_documents(docs, keywords).collect())) == want
    labels = sorted(map(str, match.labelled(docs, keywords).collect()))
    cards = sorted(map(str, search.press_search(docs, keywords, ["tag"]).collect()))
    monkeypatch.setattr(match, "PLAN_KEYWORDS", 3)  # the positional index
    assert sorted(map(str, match.match_documents(docs, keywords).collect())) == want
    assert sorted(map(str, match.labelled(docs, keywords).collect())) == labels
    assert sorted(map(str, search.press_search(docs, keywords, ["tag"]).collect())) == cards
    assert sum("nothing" in c for c in labels) == 0 and sum("the #tag of it" in c for c in labels) == 2  # rows, not ids


def test_streams_match_the_same(spark, odd, tmp_path):
    docs, keywords = odd
    docs.write.parquet(f"{tmp_path}/docs")
    stream = spark.readStream.schema(docs.schema).parquet(f"{tmp_path}/docs")
    got = drained(stream_matches(stream, keywords), "matches").collect()
    assert {tuple(r) for r in got} == {tuple(r) for r in match.match_documents(docs, keywords).collect()}


def test_prefilter_equals_the_naive_form_at_50_000_keywords(spark):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcdefghiklmnop") for _ in range(rnd.randint(2, 9)))
    docs = [(i if i % 9 else None, " ".join(word() for _ in range(rnd.randint(0, 12)))) for i in range(300)] + [(5, None), (5, "Ünïcode İ text"), (5, "عمران خان")]
    keywords = [f"{word()} {word()}xyz" for _ in range(49_990)] + [docs[3][1][2:9], "cde", "ünïcode", "خان", *[d[1][:6] for d in docs[10:60] if d[1]]]
    keywords = [k for k in keywords if max(map(len, k.split()), default=0) >= 3]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = match.prefilter_candidates(df, spark.createDataFrame([(k, "ur" if ord(k[0]) > 0x500 else "en") for k in keywords], "text string, language string"))
    longest = {max(k.lower().split(), key=len) for k in keywords}
    want = [d for d in docs if any(w in (d[1] or "").lower() for w in longest)]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want)) and 20 < len(want) < len(docs)
    one = spark.createDataFrame([("x", "en")], "text string, language string")
    assert match.prefilter_candidates(df, one).count() == len(docs) and match.prefilter_candidates(df, one.where("false")).count() == 0


def test_nfc_class_holds_all_that_nfc_may_change(spark):
    rnd = random.Random(1)
    alone = [chr(c) for c in range(0x30000) if not 0xD800 <= c < 0xE000 and unicodedata.normalize("NFC", chr(c)) != chr(c)]
    mixed = ["é", "각", "ok", "अ़", "ą́", "שּׁ", *("x" + "".join(rnd.choice(alone) for _ in range(3)) for _ in range(50))]
    rows = spark.createDataFrame([(t,) for t in alone + mixed], "t string").select("t", T.composed(F.col("t")).alias("c")).collect()
    assert len(alone) > 560 and all(r.c == unicodedata.normalize("NFC", r.t) for r in rows)
    plain = spark.createDataFrame([("حکومت نے کہا",), ("日本語 テキスト",), ("हिन्दी",)], "t string").select(F.col("t").rlike(T.nfc_class()).alias("hit")).collect()
    assert [r.hit for r in plain][:2] == [False, False]


SEGMENT = {"end": 12.0, "avg_logprob": None, "no_speech_prob": None}
BOTH = [(1, "news", "en", "youtube", True, NOW), (2, "news", "ur", "youtube", True, NOW), (3, "flood", "en", "youtube", True, NOW)]


@pytest.fixture(scope="module")
def spoken(spark):
    rows = [("v", [SEGMENT | {"start": 10.0, "text": "the news of the flood"}]), ("w", [SEGMENT | {"start": 10.0, "text": "nothing"}])]
    rows = [(v, "c", None, "groq", "large", "en", "", s, None, NOW) for v, s in rows]
    return spark.createDataFrame(rows, schemas.TRANSCRIPTS), spark.createDataFrame(BOTH, schemas.KEYWORDS)


def test_keywords_in_two_languages_in_whole_searches(spark, spoken):
    transcripts, keywords = spoken
    uploads = spark.createDataFrame([("v", "c", "t", "", NOW, 60, False, "u"), ("x", "c", "t", "", NOW, 60, False, "u"), ("live", "c", "t", "", NOW, 60, True, "u")], schemas.UPLOADS)
    found, todo = search.period_scan(uploads, transcripts, keywords, F.lit(NOW), F.lit(NOW), "day", schemas.MENTIONS)
    (row,) = found.collect()
    assert (row.external_id, row.matched_keywords, row.section) == ("v", ["flood", "news"], "Period · day") and len(row.keyword_hits["news"]) == 1
    assert [r.video_id for r in todo.collect()] == ["x"]
    channels = spark.createDataFrame([("c", "Chan", None, "Asia/Karachi", None, None, None, True)], schemas.CHANNELS)
    old = spark.createDataFrame([], schemas.MENTIONS)
    merged, alerts = search.rematch(old, transcripts, keywords, channels, F.lit(NOW), schemas.MENTIONS)
    assert [(r.external_id, r.source, r.matched_keywords) for r in merged.collect()] == [("v", "Chan", ["flood", "news"])] and alerts.count() == 1
    stored = spark.createDataFrame([m.asDict(recursive=True) | {"matched_keywords": ["news", "gone"], "id": 4} for m in found.collect()], schemas.MENTIONS)
    (row,) = search.repair_mentions(stored, transcripts, keywords).collect()
    assert "news" in row.matched_keywords and row.keyword_hits["news"][0].start >= 10
    pages_ = spark.createDataFrame([("p", "c", "2026-07-20", 1, "", "", [], "the news"), ("p", "c", "2026-07-10", 2, "", "", [], "the news"), ("p", "c", "2026-07-21", 3, "", "", [(None, "flood", "")], None)], schemas.EDITION_PAGES)
    got = search.edition_rematch(pages_, keywords, "2026-07-21").collect()
    assert sorted((r.page.page_no, r.keyword, r.language) for r in got) == [(1, "news", "en"), (1, "news", "ur"), (3, "flood", "en")]


def mention(i, found, **more):
    return {"id": i, "module": "youtube", "external_id": str(i), "title": "t", "url": "u", "matched_keywords": sorted(found), "keyword_hits": found, **more}


def at(start):
    return [{"start": start, "end": 1, "excerpt": "x", "confidence": None, "screenshot": None}]


def test_media_of_mentions(spark):
    rows = spark.createDataFrame([mention(1, {"a": at(3), "b": at(None), "c": at(1)}, keyword_media={"c": "old"}), mention(2, {"a": at(5)}), mention(3, {})], schemas.MENTIONS)
    assert [tuple(r) for r in policy.backfill_candidates(rows).collect()] == [(2, "a", 5), (1, "a", 3)]
    assert [tuple(r) for r in policy.backfill_candidates(rows, newest=2).collect()] == [(2, "a", 5)]
    media = spark.createDataFrame([(1, "a", "z"), (1, "a", "y"), (1, "b", "q"), (1, "c", "new"), (2, None, "n"), (9, "a", "x")], "id long, keyword string, path string")
    got = {r.id: r for r in policy.attach_media(rows, media).collect()}
    assert got[1].keyword_media == {"c": "old", "a": "y"} and got[1].keyword_hits["a"][0].screenshot == "y" and not got[2].keyword_media
    active = spark.createDataFrame([("A",), ("c",)], "text string")
    labels = spark.createDataFrame([mention(1, {"a": [{"start": 1, "end": 2, "excerpt": "an A here", "confidence": None, "screenshot": None}], "c": at(1)}, )], schemas.MENTIONS)
    assert [tuple(r) for r in hits.verified_keywords(labels, active).collect()] == [(1, ["A"])]


def test_limits_are_counted(spark):
    when = lambda d: NOW - dt.timedelta(days=d)
    rows = [mention(i, {"k": at(1)}, detected_at=when(i)) for i in range(30)] + [mention(40, {"k": at(1), "free": at(1)}, detected_at=when(50)), mention(41, {"k": at(1)}, detected_at=when(91)), mention(42, {}, detected_at=when(1))]
    before = spark.createDataFrame(rows, schemas.MENTIONS)
    after = policy.enforce_limits(before, F.lit(NOW))
    assert tuple(policy.limit_counts(before, after, F.lit(NOW)).first()) == (1, 6, 6)  # 5 + 1 labels; 5 mentions and the one without labels


def test_collapsed_times(spark):
    rnd = random.Random(6)
    rows = [sorted(rnd.randint(0, 400) for _ in range(n)) for n in (0, 1, 2, 3, 50, 90)] + [list(range(10_000))]
    got = spark.createDataFrame([(r,) for r in rows], "s array<int>").select("s", hits.collapsed(F.col("s"), 3).alias("k")).collect()
    for r in got:
        kept = []
        for i, x in enumerate(r.s):
            if not kept or x - r.s[kept[-1]] >= 3:
                kept.append(i)
        assert r.k == kept


def test_joins_in_time(spark):
    rnd = random.Random(8)
    points = [(i, rnd.choice(["a", "b", None]), rnd.uniform(-50, 9_000) if i % 9 else None) for i in range(200)]
    spans = [(k, rnd.choice(["a", "b"]), s, s + rnd.choice([0, 1, 30, 4_000])) for k in range(40) for s in [rnd.uniform(0, 9_000)]]
    p, s = spark.createDataFrame(points, "i long, u string, t double"), spark.createDataFrame(spans, "k long, u string, s double, e double")
    got = timelines.near(p, s, ["u"], "t", "s", "e", 25.0)
    want = [(i, k) for i, u, t in points for k, v, a, b in spans if t is not None and u == v and b >= t - 25 and a <= t + 25]
    assert sorted((r.i, r.k) for r in got.collect()) == sorted(want) and want
    assert "CartesianProduct" not in got._jdf.queryExecution().toString() and "NestedLoop" not in got._jdf.queryExecution().toString()
    assert timelines.near(p, s.where("false"), ["u"], "t", "s", "e").count() == 0
    last = timelines.asof(p, s.select("u", F.col("s").alias("t"), "k"), ["u"], "t", ["k"], 500.0)
    best = {i: max(((a, k) for k, v, a, _ in spans if v == u and t is not None and a <= t), default=(0, None))[1] for i, u, t in points}
    assert {r.i: r.k for r in last.collect()} == best
    runs = timelines.islands(p.where("u is not null and t is not null"), ["u"], "t", 60.0, 700.0)
    for u in "ab":
        mine = sorted((r.t, r.island) for r in runs.where(F.col("u") == u).collect())
        assert all((y[1] != x[1]) == (y[0] - x[0] > 60) for x, y in zip(mine, mine[1:], strict=False))
    outside = timelines.outside(p, s.select("u", F.col("s").alias("lo"), F.col("e").alias("hi")), ["u"], "t", 2.0)
    lost = {i for i, u, t in points for _, v, a, b in spans if t is not None and u == v and a - 2 <= t <= b + 2}
    assert {r.i for r in outside.collect()} == {i for i, _, _ in points} - lost


def test_label_batches_are_full(spark):
    docs = spark.createDataFrame([(i, f" text {i}\n") for i in range(20)], "doc_id long, text string").repartition(7)
    got = feeds.build_label_batches(docs, 8).orderBy("batch").collect()
    assert [len(r.ids) for r in got] == [8, 8, 4] and [i for r in got for i in r.ids] == list(range(20))
    assert got[2].request.splitlines()[0] == "1. text 16"
    assert feeds.build_label_batches(docs.where("false")).count() == 0


def test_pages_of_one_id(spark):
    area = '<area href="/a" coords="0,0,500,0,500,400,0,400"><area href="/b" coords="0,400,900,400,900,900,0,900"><area href="/c" coords="0,0,9,9">'
    rows = [(1, "http://a.org/x", area + '<img src="page.jpg">'), (1, "http://b.org/x", '<a href="/y/z/w">t</a><a href="/y/z/w#2">t</a>' + area.replace("900", "1800")), (None, None, area * 2), (2, "http://c.org", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((str(r.page_id), r.regions, r.images, r.links, r.mode) for r in pages.source_probe_summary(df).collect())
    assert got == [("1", 3, 0, 1, "imagemap"), ("1", 3, 1, 0, "imagemap"), ("2", 0, 0, 0, "unknown"), ("None", 6, 0, 0, "imagemap")]
    boxes = sorted((str(r.page_id), r.link, round(r.r)) for r in pages.image_map_regions(df).collect())
    assert boxes == [("1", "/a", 28), ("1", "/a", 56), ("1", "/b", 100), ("1", "/b", 100), ("None", "/a", 56), ("None", "/b", 100)]


def test_edition_urls(spark):
    rows = [("jang", "https://e/static_pages", ["Lahore"], "2026-08-05", "family"), ("dawn", "https://e", ["national"], "2026-08-05", "dated"), ("z", "https://e", ["Khi"], "2026-08-05", "short")]
    df = spark.createDataFrame(rows, "paper string, base string, cities array<string>, date string, pattern string")
    got = {r.paper: r.url for r in pages.edition_page_urls(df).where("page_no = 3").collect()}
    assert got == {"jang": "https://e/static_pages/8-5-2026/lahore/mainpage/page3.jpg", "dawn": "https://e/2026/08/05/pages/05_08_2026_003.jpg", "z": "https://e/khi/050826-3"}
    stats = spark.createDataFrame([("a", "read", 900, 3), ("a", "read", 10, 5), ("b", "map_fail", None, None), ("c", "read", 999, 0)], "source string, status string, chars long, hits long")
    assert {r.source: (r.hits, r.capped, r.note) for r in pages.edition_stats(stats).collect()} == {"a": (8, True, ""), "b": (0, False, "No page could be read"), "c": (0, False, "No keyword on these pages")}


def test_route_and_slug(spark):
    got = pages.resolve_source_slug(spark.createDataFrame([("https://www.a.com.pk/x",), ("https://b.org",), (None,)], "url string"), spark.createDataFrame([("a.com.pk", "a"), ("com.pk", "no")], "domain string, slug string"))
    assert {r.url: r.slug for r in got.collect()} == {"https://www.a.com.pk/x": "a", "https://b.org": None, None: None}
    sources = spark.createDataFrame([("web", "en", None), ("epaper", "ur", None), ("epaper", "ur", True), ("epaper", "en", None)], "kind string, language string, clickable boolean")
    assert [r.route for r in pages.route_sources(sources, False).collect()] == ["web", "skip", "clickable", "image_only"]
