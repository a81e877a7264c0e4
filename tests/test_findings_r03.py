"""Registered queries against their SQL on small tables that once told them apart."""

import datetime as dt

import duckdb
import pyarrow as pa
from pyspark.sql import functions as F

from pressglass.functions import text as T
from pressglass.operators import match, pages
from pressglass.plans import queries
from pressglass.storage import drained
from pressglass.streaming.operators import stream_matches


def differs(spark, folder, name):
    """What a query has and its SQL lacks, and the other way round, over the tables in folder."""
    spark_side = queries.queries()[name](spark, str(folder))
    spark_side.write.mode("overwrite").parquet(f"{folder}/out-{name}")
    own = duckdb.connect()
    for path in folder.glob("*.parquet"):
        own.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}/*.parquet'")
    own.execute(f"CREATE VIEW got AS SELECT * FROM '{folder}/out-{name}/*.parquet'")
    own.execute(f"CREATE TABLE want AS SELECT {', '.join(spark_side.columns)} FROM ({queries.oracle_sql()[name]})")
    rest = lambda a, b: own.execute(f"SELECT * FROM {a} EXCEPT ALL SELECT * FROM {b}").fetchall()
    return rest("got", "want"), rest("want", "got")


def events(spark, folder):
    day = dt.datetime(2024, 1, 2)
    at = lambda **k: day + dt.timedelta(**k)
    rows = []
    for user in (1, 2, None):  # the second user's third hour begins half a second after its sign-up
        for n, t in enumerate((at(hours=0), at(hours=30), at(hours=79, microseconds=-400_000 if user == 2 else 0) if user == 2 else at(hours=70))):
            rows.append((len(rows), t, user, "signup", 0.0))
        for t in (at(hours=20), at(hours=72, microseconds=-300_000), at(hours=90), None):
            rows.append((len(rows), t, user, "purchase", 0.0))
    rows.append((len(rows), None, 1, "signup", 0.0))
    # Three hours whose last one is in reach only by its nearest second.
    for t in (at(hours=100), at(hours=140), at(hours=188, microseconds=-400_000), at(hours=200)):
        rows.append((len(rows), t, 3, "signup", 0.0))
    for t in (at(hours=202, microseconds=-200_000), at(hours=99), at(hours=98, minutes=59, seconds=59.8)):
        rows.append((len(rows), t, 3, "purchase", 0.0))
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double")
    df.coalesce(1).write.parquet(f"{folder}/events.parquet")


def test_loops_by_nearest_seconds_and_without_a_user(spark, tmp_path):
    events(spark, tmp_path)
    for name in ("loop_ranges_tables", "hits_outside_loops"):
        assert differs(spark, tmp_path, name) == ([], [])
    assert spark.read.parquet(f"{tmp_path}/out-loop_ranges_tables").where("user_id is null").count() == 1


def test_scores_at_half_a_cent(spark, tmp_path):
    # 10050 / 10000 * 100 lies below 100.5 as a double; the digits say 1.005.
    prices = [float(100 * k + 50) for k in range(1, 400)]
    rows = [(i, j, p) for i, p in enumerate(prices) for j, p in enumerate((p, p - 7500.0, p - 7450.0))]
    rows += [(-1, None, 10_000.0), (-1, 2, 10_000.0)]
    df = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_extendedprice double")
    df.coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    assert differs(spark, tmp_path, "pick_best") == ([], [])


def test_few_keywords_are_matched_within_the_row(spark, tmp_path):
    # No word travels with the text that it is from: streams join nothing.
    spark.createDataFrame([(1, "The end of the of the"), (2, "otherwise"), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/d")
    stream = spark.readStream.schema("doc_id long, text string").parquet(f"{tmp_path}/d")
    got = stream_matches(stream, queries.watchlist(spark))
    assert "Join" not in got._jdf.queryExecution().analyzed().toString()
    assert sorted((r.doc_id, r.keyword) for r in drained(got, "m").collect()) == [(1, "of the"), (1, "the")]


def test_long_watchlists_are_filed_under_one_word(spark, monkeypatch):
    stored = {}
    monkeypatch.setattr(match, "written", lambda df, what: stored.setdefault(what, df), raising=False)
    monkeypatch.setattr(match, "PLAN_KEYWORDS", 3)
    words = [f"of the w{i}" for i in range(40)] + ["of the", "#w1", "w2 +", "c++"]
    keywords = spark.createDataFrame([(w, "en") for w in words], "text string, language string")
    texts = ["Of  the W7, of the w39x", "x#w1 of, the", "#w1y #w1", "w2 +of w2 +", "c+++ xc++ c++", "of the w3", "c ++"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {(r.doc_id, r.keyword) for r in match.match_documents(docs, keywords).collect()}
    assert got == {(r.doc_id, r.keyword) for r in match.match_documents_theta(docs, keywords).collect()}
    assert stored["keywords"].count() == len(words)  # not a row for each of their words


def test_texts_do_not_travel_with_their_tokens(spark, monkeypatch):
    stored = {}
    monkeypatch.setattr(match, "written", lambda df, what: stored.setdefault(what, df), raising=False)
    docs = spark.createDataFrame([(1, "a word0001, b"), (1, "none"), (None, "xword0299x c+-d"), (2, None), (3, "c+-")], "doc_id long, text string")
    words = [f"word{i:04d}" for i in range(300)]
    for more, want in (([], 2), (["c+-"], 3)):
        watch = spark.createDataFrame([(w, "en") for w in words + more], "text string, language string")
        stored.clear()
        assert match.prefilter_candidates(docs, watch).count() == want
        assert stored["digests"].columns == ["_digest"]


def test_common_letters_are_told_from_others_by_one_range(spark):
    assert T.nfc_class().startswith("[\\x{300}-") and T.nfc_class().count("&&") > 10
    rows = spark.createDataFrame([("a  b",), (" a\t",), ("a b",), (" a  \nb",)], "t string").select(T.single_spaced(F.col("t")))
    assert [r[0] for r in rows.collect()] == ["a b", " a ", "a b", " a b"]


def test_pages_are_parsed_a_few_at_a_time(spark):
    batch = pa.RecordBatch.from_pydict({"html": [str(i) for i in range(3 * pages.PAGES + 1)]})
    parts = list(pages.few_at_a_time(iter([batch, batch.slice(0, 0), batch.slice(0, 2)])))
    assert [p.num_rows for p in parts] == [*[pages.PAGES] * 3, 1, 2]
    assert [x for p in parts for x in p.column("html").to_pylist()] == [*map(str, range(3 * pages.PAGES + 1)), "0", "1"]
    df = spark.createDataFrame([(i, f"<div>text {i}</div>" if i % 3 else None) for i in range(50)], "page_id long, html string").coalesce(1)
    got = {r.page_id: r.text for r in pages.extract_main_text(df).collect()}
    assert got == {i: f"text {i}" if i % 3 else "" for i in range(50)}
