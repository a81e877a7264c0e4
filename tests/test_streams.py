"""Streams give what their batch forms give."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from pressglass import schemas
from pressglass.operators.match import match_documents
from pressglass.operators.ticker import merge_ticker
from pressglass.plans import registry
from pressglass.plans.queries import watchlist
from pressglass.sources.tables import read_mentions, write_mentions
from pressglass.sources.versions import VersionedTable, merged_versions
from pressglass.storage import drained
from pressglass.streaming import operators as S
from pressglass.streaming import sinks
from pressglass.streaming.ordered import PROVIDER, rocksdb, stream_merge_ticker, stream_suppress_frames


def source(spark, tmp_path, name, df):
    path = f"{tmp_path}/{name}"
    df.coalesce(1).write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def test_matches(spark, tmp_path):
    docs = spark.createDataFrame([(1, "The end of the day"), (2, "other"), (3, None)], "doc_id long, text string")
    got = drained(S.stream_matches(source(spark, tmp_path, "d", docs), watchlist(spark)), "m")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, match_documents(docs, watchlist(spark)).collect()))


AT = dt.datetime(2026, 1, 1)


def timed(rows):
    return [(s, AT + dt.timedelta(seconds=t), t, x) for s, t, x in rows]


def in_files(spark, tmp_path, schema, *batches):
    """A stream of one batch for each list of rows."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")


def test_ticker_lines_in_any_order_with_the_last_one(spark, tmp_path):
    rnd = random.Random(4)
    lines = [(s, t, rnd.choice(["a", "a b", "a b c", "x y z", "x y", "end of it", " ", None])) for s in ("s", "r", "q") for t in sorted(rnd.sample(range(300), 25))]
    shuffled = rnd.sample(lines, len(lines))
    near = sorted(range(len(lines)), key=lambda i: lines[i][1] // 60)  # rows of one minute come in any order
    parts = [[shuffled[i] for i in range(len(lines)) if shuffled[i][1] // 60 == m] for m in range(5)]
    assert sum(map(len, parts)) == len(near)
    schema = "stream_id string, ts timestamp, t int, text string"
    source_ = in_files(spark, tmp_path, schema, *map(timed, parts), timed([("beat", 5_000, "x")]), timed([("beat", 9_000, "x")]))
    with rocksdb(spark):
        got = drained(stream_merge_ticker(source_, late="2 minutes"), "t").where("stream_id <> 'beat'")
    want = merge_ticker(spark.createDataFrame(lines, "stream_id string, t int, text string"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert spark.conf.get(PROVIDER, "").endswith("HDFSBackedStateStoreProvider") or not spark.conf.get(PROVIDER, "")


def test_frames_and_dedupe(spark, tmp_path):
    rows = [("s", 1, [0] * 16), ("s", 2, [1] * 6 + [0] * 10), ("s", 3, [1] * 7 + [0] * 9), ("s", 9_000, [1] * 7 + [0] * 9)]
    schema = "stream_id string, ts timestamp, t int, signature array<int>"
    source_ = in_files(spark, tmp_path, schema, timed(rows[1:3]), timed(rows[:1]), timed(rows[3:]), timed([("beat", 20_000, [0])]))
    with rocksdb(spark):
        got = drained(stream_suppress_frames(source_), "f").where("stream_id = 's'")
    assert [r.t for r in got.orderBy("t").collect()] == [1, 3, 9_000]  # the last after an idle hour: its state had gone
    rows = spark.createDataFrame([("p", dt.datetime(2026, 1, 1, 0, 0, i)) for i in range(5)], "paper string, ts timestamp")
    assert drained(S.stream_dedupe(source(spark, tmp_path, "p", rows), ["paper"]), "p").count() == 1


def hit(text):
    return [{"start": 1, "end": 2, "excerpt": text, "confidence": None, "screenshot": None}]


def mention(key, word, day):
    found = {word: hit(f"the {word}")}
    return {"module": "youtube", "external_id": key, "title": "t", "url": "u", "detected_at": AT + dt.timedelta(days=day), "matched_keywords": [word], "keyword_hits": found, "keyword_media": {}}


def test_merged_mentions_survive_replays(spark, tmp_path):
    table, seen = VersionedTable(spark, f"file://{tmp_path}/mentions", ["module", "external_id"], buckets=16), []
    run = sinks.stream_merge_mentions(table, "youtube", lambda a: seen.append(sorted((r.external_id, *r.added) for r in a.collect())))
    first = spark.createDataFrame([mention(f"v{i}", "flood", 10) for i in range(40)], schemas.MENTIONS)
    second = spark.createDataFrame([mention("v3", "rain", 10), mention("new", "rain", 6), mention("late", "rain", 5), mention(None, "rain", 10)], schemas.MENTIONS)
    run(first, 0)
    run(second, 1)
    want = sorted(map(str, table.read().collect()))
    assert seen == [sorted((f"v{i}", "flood") for i in range(40)), [("new", "rain"), ("v3", "rain")]]
    run(second, 1)
    run(first, 0)  # replays: the same table, no second alert
    assert sorted(map(str, table.read().collect())) == want and len(seen) == 2 and len(want) == 41
    assert [r.external_id for r in sinks.late_rows(table, "youtube").collect()] == ["late"]  # four days late is taken, five days aren't
    assert table.newest()["ledger"]["youtube"]["n_late"] == 1
    wrote = {r.version: r.n_new for r in merged_versions(table).collect()}
    assert wrote[1] > 10 and max(n for v, n in wrote.items() if v > 1) <= 3  # a batch rewrites the buckets that it touches
    table.vacuum(keep=1)
    assert sorted(map(str, table.read().collect())) == want and len(table.manifests()) == 1


def test_a_batch_that_dies_is_merged_once(spark, tmp_path, monkeypatch):
    table, seen = VersionedTable(spark, f"file://{tmp_path}/mentions", ["module", "external_id"], buckets=4), []
    batch = spark.createDataFrame([mention("v", "flood", 1)], schemas.MENTIONS)
    with monkeypatch.context() as m:
        m.setattr(VersionedTable, "commit", lambda *_: 1 / 0)  # all data is there, the manifest isn't
        for _ in range(2):
            with pytest.raises(ZeroDivisionError):
                sinks.stream_merge_mentions(table, "s", seen.append)(batch, 0)
    assert table.read() is None and not seen

    def fails(_):
        raise OSError("no mail today")

    with pytest.raises(OSError):
        sinks.stream_merge_mentions(table, "s", fails)(batch, 0)
    sinks.stream_merge_mentions(table, "s", seen.append)(batch, 0)  # merged already, but not alerted yet
    sinks.stream_merge_mentions(table, "s", seen.append)(batch, 0)
    assert table.read().count() == 1 and len(seen) == 1 and seen[0].count() == 1


def test_writes_that_die_leave_the_old_version(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/mentions"
    rows = spark.createDataFrame([mention(f"v{i}", "flood", 1) for i in range(9)], schemas.MENTIONS)
    assert read_mentions(spark, path).count() == 0
    assert write_mentions(rows.limit(4), path) == 1
    with monkeypatch.context() as m:
        m.setattr(VersionedTable, "commit", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            write_mentions(rows, path)
    assert read_mentions(spark, path).count() == 4
    assert write_mentions(rows, path) == 2 and read_mentions(spark, path).count() == 9
    assert read_mentions(spark, path).columns == rows.columns


def test_catch_up_in_front_of_matches(spark, tmp_path):
    ledger, done = VersionedTable(spark, f"file://{tmp_path}/ledger", ["doc_id"]), []
    schema = "doc_id long, ts timestamp, text string"
    rows = lambda *days: [(d, AT + dt.timedelta(days=d), "the end") for d in days]
    stream = in_files(spark, tmp_path, schema, rows(10), rows(6, 5, 11), rows(7), [(99, None, "the end")])
    run = sinks.stream_catch_up(ledger, "docs", "ts", lambda b, i: done.extend(r.doc_id for r in match_documents(b, watchlist(spark, ["the"])).collect()))
    query = stream.writeStream.foreachBatch(run).option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(done) == [6, 7, 10, 11, 99]
    assert [r.doc_id for r in sinks.late_rows(ledger, "docs").collect()] == [5]
    run(spark.createDataFrame(rows(3), schema), 2)  # a batch in the ledger does nothing
    assert len(done) == 5 and ledger.newest()["ledger"]["docs"]["n_late"] == 1


def test_gate(spark):
    done, mark = [], [None]
    kw = watchlist(spark).select("text", "language")
    run = S.stream_rematch_gate(kw, lambda: mark[0], lambda m: mark.__setitem__(0, m), lambda b, i: done.append(i))
    for i in range(3):
        run(spark.range(1), i)
    assert done == [0]
    S.stream_rematch_gate(kw.union(spark.createDataFrame([("today", "en")], "text string, language string")), lambda: mark[0], lambda m: None, lambda b, i: done.append(i))(spark.range(1), 9)
    assert done == [0, 9]


def test_sessions_split_at_the_gap(spark, tmp_path):
    at = lambda s: dt.datetime(2026, 1, 1) + dt.timedelta(seconds=s)
    rows = spark.createDataFrame([("s", "k", at(t)) for t in (0, 19, 38, 58)], "stream_id string, keyword string, ts timestamp")
    batch = rows.groupBy("stream_id", "keyword", F.session_window("ts", "19 seconds")).agg(F.min("ts").alias("first"))
    assert sorted(r.first for r in batch.select(F.col("first")).collect()) == [at(0), at(58)] or batch.count() == 2
    assert S.stream_ticker_events(source(spark, tmp_path, "e", rows)).isStreaming


@pytest.mark.parametrize(("stream", "batch"), [("stream_merge_ticker", "merge_ticker"), ("stream_suppress_frames", "suppress_near_duplicates")])
def test_streamed_queries_give_what_batch_queries_give(spark, stream, batch):
    both = [registry.QUERIES[q](spark, "/root/testdata/sf0.001") for q in (stream, batch)]
    got, want = (sorted(map(str, df.select("stream_id", "t").collect())) for df in both)
    assert got == want and want
