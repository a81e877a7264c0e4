"""Merkle climb, suffix family and collocations against brute force: nulls, ties, repeated rows, long texts, clashing columns."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from pressglass.llm import collocations, merkle, suffixes

CLASH = "place string, tree string, leaf string, rid string, at string, n string, w1 string, rank string"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}"
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def stored(spark, rows, folder, n=3):
    spark.createDataFrame([(*r, *["x"] * 8) for r in rows], SCHEMA).repartition(n).write.mode("overwrite").parquet(str(folder))
    return spark.read.parquet(str(folder))


def same(got, want):
    assert sorted(map(str, got)) == sorted(map(str, want))


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(leaves):
    """All levels, and for each leaf the (left, right) siblings on its way up."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([H(*last[i : i + 3]) for i in range(0, len(last), 3)])
    ways = []
    for p in range(len(leaves)):
        way = []
        for level in levels[:-1]:
            s = p - p % 3
            way.append(("".join(level[s:p]), "".join(level[p + 1 : s + 3])))
            p //= 3
        ways.append(way)
    return levels[-1][0], ways


def leaf_of(row, text):
    fields = (row[0], row[3], row[2], row[4], text)
    return H(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in fields])


def brute_proofs(rows):
    by = defaultdict(list)
    for r in rows:
        found = r[1].replace("\n", "") if r[1] and r[0] is not None and r[0] % 2 else r[1]
        by[r[3]].append(((r[0] is not None, r[0] or 0), leaf_of(r, r[1]), leaf_of(r, found), r[0]))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[1] for x in sorted(by[s])]) for s in names}
    root, above = tree([trees[s][0] for s in names])
    out = []
    for s, top in zip(names, above, strict=True):
        for x, way in zip(sorted(by[s]), trees[s][1], strict=True):
            h, proof = x[2], ""
            for a, b in [*way, *top]:
                h, proof = H(a, h, b), proof + a + b
            out.append((x[3], x[1], trees[s][0], root, H(proof), h, h == root))
    return out


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 4, None: 1, "é": 90, "b": 3, "c": 27, "d": 28, "": 2}, {"a": 700}])
def test_merkle_climb(spark, tmp_path, sizes):
    rnd, rows = random.Random(1), []
    for s, n in sizes.items():
        for _ in range(n):
            i = rnd.choice([None, *range(500)]) if n > 3 else len(rows)
            rows.append((i, rnd.choice([None, "", "a\nb", "x\n" * 5_000, f"t {len(rows)}\n", "same", "é\r\n"]), rnd.choice([None, "en"]), s, rnd.choice([None, 3])))
    rows += rows[: len(rows) // 9]  # repeated rows
    found = F.when(F.col("doc_id") % 2 == 1, F.translate("text", "\n", "")).otherwise(F.col("text"))
    got = merkle.proofs(stored(spark, rows, tmp_path / "docs"), {"text": found})
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    want = brute_proofs(rows)
    same(map(tuple, got.collect()), want)
    if len(rows) > 1:
        assert {x[-1] for x in want} == {True, False}


def test_merkle_climb_of_nothing(spark, tmp_path):
    assert merkle.proofs(stored(spark, [], tmp_path / "none")).collect() == []
    docs = stored(spark, [(i, "t", "en", "s", 1) for i in range(40)], tmp_path / "docs")
    assert merkle.proofs(docs).where("verified").count() == 40  # nothing changed
    assert merkle.proofs(docs, {"n_chars": F.when(F.col("doc_id") == 7, 2).otherwise(F.col("n_chars"))}).where("not verified").select("doc_id").collect()[0][0] == 7


def brute_kept(rows, length):
    where = defaultdict(list)
    texts = [(r[1] or "").encode() for r in rows]
    for d, t in enumerate(texts):
        for p in range(len(t) - length + 1):
            where[t[p : p + length]].append((d, p))
    gone = [bytearray(len(t)) for t in texts]
    for places in where.values():
        if len(places) > 1:
            for d, p in places:
                gone[d][p : p + length] = b"\1" * length
    return [(r[0], len(t), sum(g), len(re.findall(b"\1+", bytes(g))), hashlib.sha256(bytes(b for b, x in zip(t, g, strict=True) if not x)).hexdigest()) for r, t, g in zip(rows, texts, gone, strict=True)]


def test_suffix_family(spark, tmp_path):
    rnd = random.Random(7)
    words = ["".join(rnd.choice("abcdefghié") for _ in range(rnd.randint(1, 9))) for _ in range(400)]
    prose = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    texts = [None, "", "short", "a" * 399, "a" * 399, "b" * 401, "c" * 400, "c" * 400, "xy" * 900, "line of text\n" * 300, prose(9_000)]
    for n in (398, 399, 400, 401, 402, 527, 700, 1_500):  # passages of about the least length, amid different text
        shared = (prose(400).encode()[:n]).decode(errors="ignore")
        texts += [prose(rnd.randint(0, 60)) + x + shared + y + prose(rnd.randint(0, 60)) for x, y in (("<", ">"), ("[", "]"), ("<", "]"))]
        texts += [shared, shared[3:] + "!"]
    whole = prose(700)
    texts += [whole, whole, whole[:2_000] + "#" + whole[2_001:], whole[900:2_300], whole[500:1_200] + whole[300:1_000]]
    rows = [(rnd.choice([None, *range(60)]), t, "en", "s", 1) for t in texts]
    for batches in (1, 5):
        docs = stored(spark, rows, tmp_path / f"docs{batches}", 2)
        got = suffixes.without_repeats(docs, batches=batches)
        assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        same(map(tuple, got.collect()), brute_kept(rows, 400))
    assert suffixes.without_repeats(stored(spark, [], tmp_path / "none")).collect() == []
    with pytest.raises(ValueError):
        suffixes.without_repeats(docs, length=100)


def test_levels_grow_geometrically(spark, tmp_path):
    from pressglass.llm.common import Scratch, numbered

    rows = numbered(stored(spark, [(i, "%05d " % i * 200, "en", "s", 1) for i in range(12)], tmp_path / "docs"), "rid2").select(F.col("doc_id").alias("rid"), "text")
    with Scratch(spark, "family") as tables:
        family = suffixes.SuffixFamily(tables)
        for k in range(6):
            family.add(rows.where(F.col("rid") % 6 == k))
            sizes = [n for n, _, _ in family.levels]
            assert sum(sizes) == k + 1 and sizes == sorted(sizes, reverse=True)
        assert sizes == [4, 1, 1]  # equal ones merge when the next batch comes
        assert family.add(rows.where("rid = 0")).count() > 0 and sizes != [n for n, _, _ in family.levels]


def test_places_are_the_texts_own():
    rnd = random.Random(3)
    shared = bytes(rnd.choice(b"abcdefgh ") for _ in range(3_000))
    a = suffixes.places(b"q" * 77 + shared)
    b = suffixes.places(bytes(rnd.choice(b"xyz") for _ in range(501)) + shared)
    inside = lambda at, ahead: {x - ahead for x in at.tolist() if 144 <= x - ahead <= 2_700}
    assert inside(a, 77) == inside(b, 501)
    assert max(y - x for x, y in zip(a, a[1:], strict=False)) <= suffixes.WINDOW
    assert suffixes.places(b"short").size == 0


def brute_phrases(rows, least, top, inside):
    f, n = Counter(), Counter()
    for r in rows:
        lang, text = "und" if r[2] is None else r[2], re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, 6) for i in range(len(w) - k + 1))
    found = {k: a for k, a in f.items() if a >= least and len(k[1]) > 1}
    within = Counter()
    for (lang, w), a in found.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                within[lang, w[i : i + k]] = max(within[lang, w[i : i + k]], a)
    by = defaultdict(list)
    for (lang, w), a in found.items():
        cuts = [(1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        if 100 * within[lang, w] < inside * a:
            by[lang].append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return [(lang, i, p.decode(), -a, left, right, n[lang], -s) for lang, c in by.items() for i, (s, a, p, left, right) in enumerate(sorted(c)[:top], 1)]


@pytest.mark.parametrize(("chunk", "inside"), [(6_000_000, 100), (300, 60)])
def test_collocations(spark, tmp_path, monkeypatch, chunk, inside):
    monkeypatch.setattr(collocations, "CHUNK", chunk)
    rnd = random.Random(5)
    words = ["The", "of", "é", "É", "a\x0bb", "c", "New York City", "x,y", "end.", " ", "new", "york", *[f"w{i}" for i in range(60)]]
    text = lambda n: "".join(rnd.choice(words) + rnd.choice(["  ", " ", "\t", "\n", " of the "]) for _ in range(n))
    rows = [(i, text(rnd.randint(0, 90)), rnd.choice([None, "und", "en", "de", "a b"]), "s", 1) for i in range(150)]
    rows += [(None, None, "en", "s", 1), (1, "", "en", "s", 1), (2, "...", "en", "s", 1), (3, "one", "fr", "s", 1), (3, "one", "fr", "s", 1), (4, "tick tock " * 3_000, "long", "s", 1)]
    docs = stored(spark, rows, tmp_path / "docs")
    got = collocations.collocations(docs, least=9, top=40, inside=inside)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = brute_phrases(rows, 9, 40, inside)
    assert len(want) > 40
    same(map(tuple, got.collect()), want)
    assert collocations.collocations(stored(spark, [], tmp_path / "none")).collect() == []


def test_scores_beyond_64_bits(spark):
    cut = spark.createDataFrame([(10**14, 10**15, 10**14, 10**14)], "a long, n long, l long, r long")
    assert cut.select(F.expr(collocations.SCORE).alias("s")).first()[0] == 1000 * 10**14 * 10**15 // 10**28
