"""Matching, hits, policy, merging and slots on literal rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pressglass import schemas
from pressglass.functions import text as T
from pressglass.functions import times, urls
from pressglass.operators import feeds, hits, match, merge, pages, policy, quality, slots, ticker

URDU = "حکومت پاكستان نے کہا"
CASES = [
    ("the grape harvest was good", "rape", "en", False), ("the charge was rape.", "rape", "en", True), ("a Pakistani official said", "Pakistan", "en", False),
    ("Senator Aleema Khan spoke today", "aleema khan", "en", True), ("Aleema spoke today", "aleema khan", "en", False), (URDU, "پاکستان", "ur", True),
    ("پاکِسْتان کا اعلان", "پاکستان", "ur", True), ("یہ ایک عام جملہ ہے", "خامنہ ای", "ur", False), ("anything", " ", "en", False),
    ("foreign, affairs", "foreign affairs", "en", False), ("line\n broken words", "broken  WORDS", "en", True), ("price (a.b) here", "a.b", "en", True), ("x a\\Eb y", "a\\Eb", "en", True), ("café open", "café", "en", True),
]


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


@pytest.fixture(scope="module")
def cases(spark):
    docs = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "doc_id long, text string")
    keywords = spark.createDataFrame([(c[1], c[2]) for c in CASES], "text string, language string")
    return docs, keywords


def test_whole_word_cases(spark, cases):
    got = spark.createDataFrame(CASES, "t string, k string, l string, want boolean").select("want", T.whole_word_match(F.col("t"), F.col("k"), F.col("l")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_indexed_join_equals_theta_join(cases):
    docs, keywords = cases
    a, b = match.match_documents(docs, keywords), match.match_documents_theta(docs, keywords)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    sure = {tuple(r) for r in a.select("doc_id").collect()}
    for c in {c[1]: c for c in CASES if c[1].strip()}.values():
        own = docs.sparkSession.createDataFrame([(c[1], c[2])], "text string, language string")
        want = {r.doc_id for r in match.match_documents_theta(docs, own).collect()}
        assert want <= {r.doc_id for r in match.prefilter_candidates(docs, own).collect()}
    assert sure


def test_keyword_batches_and_languages(spark):
    df = spark.createDataFrame([(1, "Imran Khan, imran khan\n\n Kashmir ,میسی")], "id long, t string")
    assert [r.term for r in match.parse_keyword_batch(df, "t", "id").orderBy("pos").collect()] == ["Imran Khan", "Kashmir", "میسی"]
    r = one(spark, a=T.keyword_language(F.lit("میسی"), F.lit("en")), b=T.keyword_language(F.lit("messi"), F.lit("ur")))
    assert (r.a, r.b) == ("ur", "en")


def test_snippets_and_marks(spark):
    r = one(spark, a=T.snippet(F.lit("x" * 300 + " Word " + "y" * 300), ["word"]), b=T.snippet(F.lit(" a\n b "), ["zz"]), c=T.highlight(F.lit("# A <b> & Imran Khan, imran"), ["imran", "Imran Khan"]))
    assert r.a.startswith("…") and r.a.endswith("…") and "word" in r.a and r.b == "a b"
    assert r.c == "A &lt;b&gt; &amp; <mark>Imran Khan</mark>, <mark>imran</mark>"


def seg(start, text, end=None, lp=None, ns=None):
    return {"start": float(start), "end": None if end is None else float(end), "text": text, "avg_logprob": lp, "no_speech_prob": ns}


@pytest.mark.parametrize(
    "segments, keyword, language, want",
    [
        ([seg(10.0, "prime"), seg(10.5, "minister"), seg(11.2, "Shehbaz"), seg(12.0, "Sharif")], "Shehbaz Sharif", "en", [11]),
        ([seg(100 + i / 2, w, 100.5 + i / 2) for i, w in enumerate(["الف", "عمران", "خان", "بے"])], "عمران خان", "ur", [100]),
        ([seg(100 + i / 2, w, 100.5 + i / 2) for i, w in enumerate(["الف", "عمران", "خان،", "بے"])], "عمران خان", "ur", [100]),
        ([seg(30, "they said Imran Khan is well today", 32), seg(31.5, "Imran Khan is well today they said", 33), seg(33, "again Imran Khan spoke at length", 35)], "imran khan", "en", [31]),
        ([seg(10, "Imran", 10.5), seg(10.5, "Khan", 11), seg(200, "Imran", 201), seg(201, "Khan", 202)], "imran khan", "en", [10, 200]),
        ([seg(0, "Imran", 0.5), seg(0.5, "Khan", 1)], "imran khan", "en", [0]),
        ([seg(5, "Imran Khan", 6, None, 0.95)], "imran khan", "en", []),
        ([seg(5, "Imran Khan", 6, -1.8)], "imran khan", "en", []),
        ([seg(10 + i * 0.3, w) for i, w in enumerate(["Imran", "Khan"] * 4)], "imran khan", "en", []),
        ([seg(283, "Imran", 283.5), seg(283.5, "Khan", 284), *[seg(300 + i, w) for i, w in enumerate(["then", "other", "news"])]] + [seg(900 + i * 0.3, w) for i, w in enumerate(["Imran", "Khan"] * 4)], "imran khan", "en", [283]),
        ([], "imran", "en", []),
    ],
)
def test_located_hits(spark, segments, keyword, language, want):
    df = spark.createDataFrame([("v", segments)], f"video_id string, segments array<{schemas.SEGMENT}>")
    got = [h["start"] for r in hits.locate_hits(df, spark.createDataFrame([(keyword, language)], "text string, language string")).collect() for h in r.hits]
    assert got == want


def test_late_phrases_are_interpolated(spark):
    df = spark.createDataFrame([("v", [seg(100, "many words come first and then at last the Imran Khan", 130)])], f"video_id string, segments array<{schemas.SEGMENT}>")
    row = hits.locate_hits(df, spark.createDataFrame([("imran khan", "en")], "text string, language string")).first()
    assert 105 < row.hits[0].start <= 130 and row.hits[0].end == 130


def test_folds(spark):
    h = F.expr("transform(array(10, 12, 13, 16), x -> struct(x as start))")
    r = one(spark, kept=hits.collapse_utterances(h), ticks=ticker.merge_reads(F.expr("array(struct(10 as t, 'a' as text), struct(11 as t, 'a b' as text), struct(12 as t, 'a b c' as text), struct(13 as t, ' ' as text), struct(20 as t, 'other line' as text))")))
    assert [x.start for x in r.kept] == [10, 13, 16]
    assert [(x.t, x.text) for x in r.ticks] == [(10, "a b c"), (20, "other line")]
    events = ticker.ticker_events(spark.createDataFrame([("s", "k", t) for t in (0, 19, 38, 58)], "stream_id string, keyword string, t int"))
    assert sorted(x.t for x in events.collect()) == [0, 58]
    chunks = F.expr("array(struct(0D as start, array(struct(595D as start, 605D as end, 'a' as text)) as segments), struct(600D as start, array(struct(600D as start, 604D as end, 'b' as text), struct(605D as start, 607D as end, 'c' as text)) as segments))")
    assert [x.text for x in one(spark, s=hits.dedupe_overlap(chunks)).s] == ["a", "c"]


def test_slots(spark):
    r = one(spark, h=F.array(*[times.title_hours(F.lit(t)) for t in ("12AM News Bulletin", "10PM", "12 PM", "at 9 a.m.", "9:30 am")]), d=times.iso_duration_seconds(F.lit("P1DT2H3M4S")), bad=times.iso_duration_seconds(F.lit("later")), m=times.mmss(F.lit(3725)), air=times.slot_airtime(F.lit("2026-07-21"), F.lit("12:00:00")))
    assert r.h == [[0], [22], [12], [9], []] and r.d == 93784 and r.bad is None and r.m == "1:02:05" and r.air == dt.datetime(2026, 7, 21, 7, 0)
    slot = ("s", "c", "2026-07-21", "00:00:00", ["12am"], 120, 3600)
    ups = [("a", "c", "10PM News Bulletin", dt.datetime(2026, 7, 20, 19, 10), 600, False), ("b", "c", "12AM News Bulletin", dt.datetime(2026, 7, 20, 19, 10), 600, False), ("z", "c", "clip", dt.datetime(2026, 7, 20, 19, 10), 60, False)]
    s = spark.createDataFrame([slot], "slot_id string, channel_id string, slot_date string, local_time string, title_rules array<string>, min_duration_sec int, max_duration_sec int")
    u = spark.createDataFrame(ups, "video_id string, channel_id string, title string, published timestamp, duration_seconds int, live boolean")
    best = slots.pick_best(slots.classify_uploads(u, s), ["slot_id"], ["video_id"]).first()
    assert best.video_id == "b" and not best.needs_review


def mention(i, module, when, labels=("kashmir",)):
    return {"id": i, "module": module, "external_id": str(i), "published_at": when, "matched_keywords": list(labels), "keyword_media": {}, "keyword_hits": {}}


def test_quota_per_module_and_again(spark):
    now = dt.datetime(2026, 7, 1)
    rows = [mention(i, "newspaper", now - dt.timedelta(hours=i)) for i in range(35)] + [mention(100 + i, "epaper", now - dt.timedelta(days=5, hours=i)) for i in range(30)] + [mention(200, "epaper", now - dt.timedelta(days=91))]
    df = spark.createDataFrame(rows, schemas.MENTIONS)
    once = policy.enforce_limits(df, F.lit(now))
    counts = {r.module: r["count"] for r in once.groupBy("module").count().collect()}
    assert counts == {"newspaper": 25, "epaper": 25}
    again = policy.enforce_limits(once.drop("n_trimmed"), F.lit(now))
    assert {r.id for r in again.collect()} == {r.id for r in once.collect()}
    wanted = spark.createDataFrame([("Kashmir",), ("other",)], "text string")
    assert {r.keyword: r.n for r in policy.keyword_counts(once, wanted).collect()} == {"kashmir": 50, "other": 0}


def test_merge_is_stable_and_alerts_new_labels(spark):
    hit = lambda t: [{"start": 3, "end": 4, "excerpt": t, "confidence": 1.0, "screenshot": None}]
    old = mention(1, "youtube", None, ["flood"]) | {"keyword_hits": {"flood": hit("a flood came"), "gone": hit("nothing")}, "url": "u"}
    new = mention(None, "youtube", None, ["rain"]) | {"external_id": "1", "keyword_hits": {"rain": hit("some rain fell")}, "section": "late"}
    fresh = mention(None, "youtube", None, ["rain"]) | {"external_id": "2", "keyword_hits": {"rain": hit("more rain")}, "title": "t"}
    a = spark.createDataFrame([old], schemas.MENTIONS)
    b = spark.createDataFrame([new, fresh], schemas.MENTIONS)
    merged, alerts = merge.merge_mentions(a, b)
    got = {r.external_id: r for r in merged.collect()}
    assert got["1"].matched_keywords == ["flood", "rain"] and got["1"].section == "late" and got["1"].deeplink == "u&t=3s" and got["2"].snippet == "more rain"
    assert {r.external_id: r.added for r in alerts.collect()} == {"1": ["rain"], "2": ["rain"]}
    twice, more = merge.merge_mentions(merged, b)
    assert {r.external_id: r.matched_keywords for r in twice.collect()} == {"1": ["flood", "rain"], "2": ["rain"]} and more.count() == 0


def test_keyword_upserts(spark):
    old = spark.createDataFrame([(1, "Sarah Ahmed", "en", "m", False), (2, "messi", "ur", "m", True)], "id long, text string, language string, module string, active boolean")
    new = spark.createDataFrame([("sarah ahmed", "en", "m"), ("  ", "en", "m"), ("میسی", "en", "m"), ("messi", "ur", "m")], "text string, language string, module string")
    got = {r.text: (r.language, r.active) for r in merge.upsert_keywords(old, new).collect()}
    assert got == {"Sarah Ahmed": ("en", True), "messi": ("en", True), "میسی": ("ur", True)}


def test_repetition_gate(spark):
    real = "\n".join(f"line number {i} of a real page with words {i * 7}" for i in range(30))
    rows = [(1, "same line\n" * 533), (2, "\n".join([f"real {i}" for i in range(40)] + ["again and again"] * 300)), (3, "A sentence that loops on. " * 200), (4, " \n "), (5, None), (6, real), (7, real + "\nfooter\nfooter")]
    got = {r.doc_id: r.reason for r in quality.repetition_gate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "repeated lines", 2: "repeated lines", 3: "repeated phrase", 4: "empty", 5: "empty", 6: "", 7: ""}


def test_pages(spark):
    body = "<p>" + "word " * 50 + "<p>second &amp; last</p>"
    html = f'<html><head><meta content="2026-08-17T01:02" property="article:published_time"><script>var x = "<p>no</p>"</script></head><body><nav><p>menu</p></nav><article>{body}</article><a href="/news/2026/a-long-story-about-it">A headline that is long enough</a><a href="#x">A headline that is long enough</a></body></html>'
    areas = '<img src="page.jpg" usemap="#m" width="1000" height="2000"><area href="a.html" coords="0,0,500,1000"><area href="b.html" coords="0,0,10,900"><area href="c.html" coords="0,0,1000,2000"><area href="a.html" coords="600,0,900,1000">'
    df = spark.createDataFrame([(1, "https://www.x.org/", html), (2, "https://x.org/2026/08/18/s", areas), (3, "https://x.org/", None)], "page_id long, url string, html string")
    text = {r.page_id: r.text for r in pages.extract_main_text(df).collect()}
    assert text[1].endswith("\nsecond & last") and "menu" not in text[1] and "no" not in text[1].split() and text[3] == ""
    assert [(r.page_id, r.url) for r in pages.extract_links(df).collect()] == [(1, "https://www.x.org/news/2026/a-long-story-about-it")]
    dates = {r.page_id: r.d for r in df.select("page_id", pages.extract_published(F.col("html"), F.col("url")).alias("d")).collect()}
    assert dates == {1: dt.date(2026, 8, 17), 2: dt.date(2026, 8, 18), 3: None}
    assert [(r.link, r.l, r.t, r.r, r.b) for r in pages.image_map_regions(df).collect()] == [("a.html", 0.0, 0.0, 50.0, 50.0)]
    assert {r.page_id: r.mode for r in pages.source_probe_summary(df).collect()} == {1: "unknown", 2: "imagemap", 3: "unknown"}
    r = one(spark, a=urls.is_article_url(F.lit("https://x.org/category/sports/")), b=urls.is_article_url(F.lit("https://x.org/a/12345")), c=urls.absolute_url(F.lit("b.html"), F.lit("https://x.org/a/c.html")))
    assert (r.a, r.b, r.c) == (False, True, "https://x.org/a/b.html")


def test_caps_and_cards(spark):
    rows = [("s", p, r) for p in range(10) for r in range(6)]
    got = feeds.cap_hits(spark.createDataFrame(rows, "source string, page_no int, region_no int")).collect()
    assert len(got) == 24 and all(r.capped and r.region_no < 4 for r in got)
    card = feeds.mention_cards(spark.createDataFrame([mention(1, "epaper", dt.datetime(2026, 1, 1)) | {"screenshot_path": "/x/storage/a.png"}], schemas.MENTIONS)).first()
    assert card.module == "E-Paper" and card.image == "a.png" and card.local_time == "2026-01-01 05:00"
