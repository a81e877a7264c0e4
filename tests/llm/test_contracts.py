"""Operators against brute force in plain Python, with nulls, empty and long texts, ties, repeated rows, clashing columns."""

import hashlib
import random
import re
import zlib

import pytest

from pressglass.llm import crf, naming, pii, sharding, warc, winnow

SF = "/root/testdata/sf0.001"
ODD = [None, "", " \t\n", "a", "A b", "ab", "é É", "x" * 70_000, "y z " * 9_000, "a\x0bb", "a b"]


@pytest.fixture(scope="module")
def rows(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    docs += [(10_000 + i, t) for i, t in enumerate(ODD)]
    docs += [(20_000, "same text here"), (20_000, "same text here"), (20_001, "same text  here"), (20_001, "other text"), (None, "no id"), (None, "no id")]
    random.Random(1).shuffle(docs)
    return docs


@pytest.fixture(scope="module")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs"))
    extra = "rid string, id string, name string, text_hash string, w string, size string, key string, score string"
    spark.createDataFrame([(d, t, *["x"] * 8) for d, t in rows], f"doc_id long, text string, {extra}").repartition(3).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def same(got, want):
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_block_naming(docs, rows, monkeypatch):
    monkeypatch.setattr(naming, "BLOCK", 64)  # many rounds of pairs
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = {}
    for d, t in rows:
        groups.setdefault(norm(t), []).append((-len(t or ""), d is None, d or 0, d))
    want = []
    for n, g in groups.items():
        keep = min(g)[3]
        want += [(d, keep, len(g), hashlib.sha256(n.encode()).hexdigest()) for *_, d in g]
    got = naming.exact_groups(docs).collect()
    same([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], want)
    assert sum(r.kept for r in got) == len(groups) and all(r.doc_id == r.keep_id for r in got if r.kept)
    assert naming.drop_exact_copies(docs).count() == len(groups)


def windows(w, n):
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def test_winnowing(spark, docs, rows):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bench += [(900, "y z"), (901, "Ab"), (902, None), (903, "!!"), (904, "same text here"), (905, bench[0][1]), (905, bench[0][1]), (None, "a"), (906, "other, text")]
    got = winnow.contamination(docs, spark.createDataFrame([(i, t, "x", "y") for i, t in bench], "item_id long, text string, size string, w string")).collect()
    items = [(i, n, windows(find(t), n)) for i, t in bench if i is not None and (n := min(10, len(find(t))))]
    want = []
    for d, t in rows:
        w = find(t)
        hit, found = set(), set()
        for i, n, own in items:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in own:
                    hit |= set(range(s, s + n))
                    found.add(str(i))
        want.append((d, len(w), len(hit), len(found), ",".join(sorted(found)), bool(hit)))
    same([(r.doc_id, r.n_words, r.n_hit, r.n_items, ",".join(r.item_ids), r.contaminated) for r in got], want)
    kept = winnow.drop_contaminated(docs, spark.createDataFrame(bench, "item_id long, text string"))
    assert kept.count() == sum(not x[-1] for x in want) and kept.columns == docs.columns
    assert winnow.contamination(docs, spark.createDataFrame([], "item_id long, text string")).where("contaminated").count() == 0


def luhn(digits):
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


PLAIN = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(d := re.sub("[^0-9]", "", s)) <= 19 and luhn(d)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(re.sub("[^0-9]", "", s)) <= 15),
}


def test_personal_data(spark, docs, rows):
    rng = random.Random(4)
    more = ["a@b.com_x@y.com 1.2.3.4.5.6.7.8 256.1.1.1 0001.02.3.4", "4111 1111 1111 1111 and 4111-1111-1111-1112 +1 (974) 555-3436 +12 +1(", "🙂 é x.y%z+q@mail.example.com. +4930 1234567-", "IBAN DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432, not DE88370400440532013000", "my social security 123-45-6789 or 123-45-6789"]
    more += ["".join(rng.choices("1234 -.+()@ab.,", k=rng.randint(0, 80))) for _ in range(400)] + ["a" * 50_000, "1" * 50_000, "1." * 20_000, "a." * 20_000 + "@b" + ".c" * 20_000, "+1" + " " * 30_000, "4111 1111 1111 1111 " * 2_000]
    own = [*rows, *enumerate(more, 30_000)]
    extra = spark.createDataFrame([(d, t) for d, t in enumerate(more, 30_000)], "doc_id long, text string")
    got = pii.personal_data(docs.unionByName(extra, allowMissingColumns=True)).collect()
    want, base = [], {}
    for d, t in own:
        spans = {k: [m.span() for m in re.finditer(p, t or "") if ok(m[0])] for k, (p, ok) in PLAIN.items()}
        base[d, t] = ",".join(f"{k}:{a}:{b}" for k, s in spans.items() for a, b in s)
        want.append((d, *map(len, spans.values()), hashlib.sha256(base[d, t].encode()).hexdigest()))
    same([(r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got], want)
    by = {r.doc_id: r for r in got}
    assert [x for x in by[30_003].spans.split(",") if x.startswith("iban")] == ["iban:5:32", "iban:37:59"]
    assert "ssn:19:30" in by[30_004].spans


def test_words_near_personal_data(spark):
    """Words count that stand within AROUND characters before or behind the span, up to the next match of its kind."""
    far = " x" * 80
    texts = [f"order 321-54-9876{far} my social security number is 123-45-6789", f"ref 321-54-9876 social security{far} code 111-22-3333", f"321-54-9876{far} 123-45-6789{far} ssn 222-33-4444 {far}", "ssn: 321-54-9876, 123-45-6789"]
    rng = random.Random(8)
    texts += ["".join(rng.choice([" 123-45-6789 ", " ssn ", " a b c d e f ", "social ", " " + "z" * rng.randint(1, 60) + " "]) for _ in range(12)) for _ in range(60)]
    got = {r.doc_id: r.spans for r in pii.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        found = list(re.finditer(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", t))
        want = []
        for j, m in enumerate(found):
            low, high = found[j - 1].end() if j else 0, found[j + 1].start() if j + 1 < len(found) else len(t)
            near = t[max(low, m.start() - pii.AROUND) : m.start()] + " " + t[m.end() : min(high, m.end() + pii.AROUND)]
            if re.search("ssn|social|security", near.lower()):
                want.append(f"ssn:{m.start()}:{m.end()}")
        assert [x for x in got[i].split(",") if x.startswith("ssn")] == want, t


def test_minimax_shards(spark, docs, rows):
    n = 5
    got = sharding.shard(docs, n).collect()
    size = lambda t: len((t or "").encode()) + 8
    same([(r.doc_id, r.size, r.text_crc32) for r in got], [(d, size(t), zlib.crc32((t or "").encode())) for d, t in rows])
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    groups = {}
    for d, t in rows:
        groups.setdefault(t or "", []).append((d is None, d or 0))
    ordered = [size(t) * len(g) for t, g in sorted(groups.items(), key=lambda x: min(x[1]))]
    best = smallest(ordered, n)
    loads = [sum(r.size for r in got if r.shard == s) for s in range(n)]
    assert max(loads) == best
    by_text = {}
    for r in got:
        by_text.setdefault((r.size, r.text_crc32), set()).add(r.shard)
    assert all(len(s) == 1 for s in by_text.values())


def fits(sizes, capacity, n):
    shards, load = 1, 0
    for s in sizes:
        if load + s > capacity:
            shards, load = shards + 1, 0
        load += s
    return shards <= n


def smallest(sizes, n):
    low, high = max(sizes), sum(sizes)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if fits(sizes, mid, n) else (mid + 1, high)
    return low


@pytest.mark.parametrize("directory", [40, 200, 100_000])
def test_capacity_search_in_rounds(spark, directory):
    rng = random.Random(6)
    for n in (1, 3, 24):
        sizes = [rng.choice([1, 2, 5, 300, rng.randint(1, 3_000)]) for _ in range(1_500)]
        upto = [sum(sizes[: i + 1]) for i in range(len(sizes))]
        groups = spark.createDataFrame(list(zip(sizes, upto, strict=True)), "size long, upto long").cache()
        capacity, cuts = sharding.minimax_cuts(groups, n, directory)
        assert capacity == smallest(sizes, n)
        edges = [*cuts, sum(sizes)]
        assert all(b - a <= capacity for a, b in zip(edges, edges[1:], strict=False)) and all(c in (0, *upto) for c in cuts)


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/d")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/p")
    none = spark.read.parquet(f"{tmp_path}/d")
    assert naming.exact_groups(none).count() == 0 and sharding.shard(none, 24).count() == 0 and pii.personal_data(none).count() == 0
    assert winnow.contamination(none, spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0
    assert warc.round_trip(spark.read.parquet(f"{tmp_path}/p")).count() == 0
    field = crf.train(none, spark.createDataFrame([], "doc_id long, quality int"))
    assert crf.score(none, field).count() == 0


def test_warc(spark, tmp_path):
    import base64

    pages = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    pages += [(901, "http://a.org/", None), (902, None, ""), (903, "not a url", ""), (904, "http://x.org:8080/a b?q", pages[0][2]), (905, "http://www.é.org/", pages[0][2]), (906, "http://a.org/", "é" * 50_000), (906, "http://a.org/", "é" * 50_000)]
    path = f"{tmp_path}/pages"
    spark.createDataFrame([(*p, "x", "y") for p in pages], "page_id long, url string, html string, digest string, at string").repartition(3).write.parquet(path)
    got = warc.round_trip(spark.read.parquet(path)).collect()
    top, first = {}, set()
    for i, _, h in pages:
        top[h or ""] = max(i, top.get(h or "", i))
    want = []
    for i, _, h in sorted(pages, key=lambda p: -p[0]):
        data = (h or "").encode()
        lead = top[h or ""] == i and (h or "") not in first
        first.add(h or "")
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if lead else "revisit", None if lead else top[h or ""]))
    same([tuple(r) for r in got], want)


def test_warc_lookup(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 3)
    rows = [(i, f"http://h{i % 7}.org/p{i % 3}", f"<p>{i}</p>") for i in range(40)]
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2).write.parquet(f"{tmp_path}/pages")
    out, index = f"file://{tmp_path}/warc", f"file://{tmp_path}/index"
    directory = warc.write_index(warc.write_archives(spark.read.parquet(f"{tmp_path}/pages"), out), index)
    found = warc.Index([tuple(r) for r in directory.select("first_key", "first_page", "file", "at", "length").collect()], index)
    for i in range(21):
        url = f"http://h{i % 7}.org/p{i % 3}"
        assert sorted(r["payload"].decode() for r in found.records(url)) == sorted(h for _, u, h in rows if u == url)
    assert found.records("http://nowhere.org/") == []
    pages = spark.read.parquet(f"{tmp_path}/pages")
    assert sorted(r.page_id for r in warc.read_archives(pages, directory, index).collect()) == list(range(40))
    some = pages.where("page_id % 21 = 5").unionByName(pages.limit(1).selectExpr("-1L as page_id", "'http://zz.org/none' as url", "html"))
    assert sorted(r.page_id for r in warc.read_archives(some, directory, index).collect()) == [5, 26]


def test_field_by_brute_force():
    import itertools

    import numpy as np

    rng = np.random.default_rng(2)
    score, pull = rng.normal(size=5), rng.normal(size=(2, 2))
    weights = {}
    for labels in itertools.product((0, 1), repeat=5):
        weights[labels] = np.exp(sum(s for s, y in zip(score, labels, strict=True) if y) + sum(pull[a, b] for a, b in zip(labels, labels[1:], strict=False)))
    z = sum(weights.values())
    live = np.ones((2, 5), bool)
    live[1, 3:] = False
    p, total, expected = crf.marginals(np.stack([score, score]), live, pull, True)
    for i in range(5):
        assert abs(p[0, i] - sum(w for y, w in weights.items() if y[i]) / z) < 1e-9
    assert abs(np.exp(total[0]) - z) < 1e-6 * z
    alone, _, one = crf.marginals(score[None], live[:1], pull, True)
    for a, b in itertools.product((0, 1), repeat=2):
        want = sum(w * sum((x, y) == (a, b) for x, y in zip(labels, labels[1:], strict=False)) for labels, w in weights.items()) / z
        assert abs(one[a, b] - want) < 1e-9


def test_quality_on_held_out_documents(spark):
    from pressglass.llm import queries

    got = queries.op1_line_crf(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert len(got) > 80 and (got.predicted == got.quality).mean() > 0.95 and got.score.between(0, 1).all()


def test_training_is_bounded_and_takes_the_same_rows(spark, tmp_path, monkeypatch):
    rows = [(i % 40, ("Good words stand here, in a line.\n" if i % 2 else "BUY NOW!!! $$$ | click\n") * (1 + i % 7 * 30)) for i in range(80)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/d")
    docs, labels = spark.read.parquet(f"{tmp_path}/d"), spark.createDataFrame([(i, i % 2) for i in range(40)] + [(1, 1), (None, 1), (2, None)], "doc_id long, quality int")
    seen, fit = [], crf.LineField.fit

    def spied(self, features, rows, labels):
        seen.append((features.tobytes(), len(features), len(labels)))
        return fit(self, features, rows, labels, steps=5)

    monkeypatch.setattr(crf.LineField, "fit", spied)
    crf.train(docs, labels, sample_lines=500)
    crf.train(docs.repartition(5), labels, sample_lines=500)
    assert seen[0] == seen[1] and seen[0][1] <= 500 and seen[0][2] == 10


def test_quality_of_odd_rows(docs):
    got = crf.score(docs, crf.LineField(), keep=["doc_id", "name"]).collect()
    assert len(got) == docs.count() and all(r.score == 0.5 for r in got) and got[0].name == "x"


def test_pipeline_keeps_what_brute_force_keeps(spark, tmp_path):
    import corpus_pipeline
    from tests.llm.test_jaccard import brute

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    kept = {r.doc_id: r.text for r in docs.collect()}
    out = docs
    for name, expect in [("quality classifier", None), ("exact dedup", "exact"), ("n-gram Jaccard join", "near"), ("benchmark decontamination", "leaks")]:
        out = stage[name](spark, out, SF)
        out.write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        assert out.columns == docs.columns
        got = {r.doc_id for r in out.select("doc_id").collect()}
        if expect == "exact":
            groups = {}
            for d, t in kept.items():
                groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), d))
            assert got == {min(g)[1] for g in groups.values()}
        elif expect == "near":
            assert got == {c for d, _, c in brute(list(kept.items()))}
        elif expect == "leaks":
            found = {r.doc_id for r in winnow.contamination(spark.read.parquet(f"{tmp_path}/n-gram Jaccard join"), spark.read.parquet(f"{SF}/benchmark.parquet")).where("contaminated").collect()}
            assert got == set(kept) - found
        else:
            assert got <= set(kept) and len(got) > 0.6 * len(kept)
        kept = {d: t for d, t in kept.items() if d in got}
    assert {r.doc_id for r in stage["byte-level BPE"](spark, out, SF).collect()} == set(kept)
