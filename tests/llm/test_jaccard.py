"""op10 against brute force, and the connected components by themselves."""

import random
import re

import pytest

from pressglass.llm import jaccard
from pressglass.llm.common import Scratch

SF = "/root/testdata/sf0.001"


def brute(rows, percent=80):
    """doc_id -> (set size, smallest linked id), by an inverted index over shingles as text."""
    sets, by = {}, {}
    for i, (_, t) in enumerate(rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {" ".join(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
        for x in sets[i]:
            by.setdefault(x, []).append(i)
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, s in sets.items():
        common = {}
        for x in s:
            for j in by[x]:
                if j < i:
                    common[j] = common.get(j, 0) + 1
        for j, c in common.items():
            if 100 * c >= percent * (len(s) + len(sets[j]) - c):
                top[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), least.get(find(i), d)) for i, (d, _) in enumerate(rows)), key=str)


def check(spark, rows, tmp_path):
    spark.createDataFrame([(d, t, 1, "b") for d, t in rows], "doc_id long, text string, rid int, seat string").repartition(3).write.parquet(f"{tmp_path}/docs")
    got = jaccard.near_duplicates(spark.read.parquet(f"{tmp_path}/docs")).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows)


def test_documents(spark, tmp_path):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check(spark, rows, tmp_path)


@pytest.mark.parametrize(("small", "levels"), [(128, 4), (3, 4), (3, 2)])
def test_edges_and_dense_groups(spark, tmp_path, monkeypatch, small, levels):
    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard, "LEVELS", levels)
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [rng.choice(vocabulary) for _ in range(60)]
    rows = [(0, None), (1, ""), (2, " \n\t"), (3, "one two"), (4, "One TWO"), (5, "one two three four five"), (6, "É é"), (7, "é é"), (7, "é é"), (None, "no id at all here now"), (None, "no id at all here now"), (8, "no id at all here now")]
    for i in range(150):  # near copies at all distances from the base and each other
        t = list(base)
        for _ in range(rng.randint(0, 4)):
            t[rng.randrange(60)] = rng.choice(vocabulary)
        rows.append((100 + i, " ".join(t)))
    passage = " ".join(rng.choice(vocabulary) for _ in range(25))
    for i in range(60):  # one passage in unrelated texts
        rows.append((400 + i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 40))) + " " + passage))
    rows.append((900, " ".join(rng.choice(vocabulary) for _ in range(30_000))))
    rng.shuffle(rows)
    check(spark, rows, tmp_path)


def test_a_crowd_around_one_text(spark, tmp_path, monkeypatch):
    """Many edited copies of a text: some linked to it, some only to others, many to none; words put in, out and changed."""
    monkeypatch.setattr(jaccard, "SMALL", 20)
    rng = random.Random(23)
    base = [f"b{i}" for i in range(90)]
    texts = [base]
    for _ in range(500):
        t = list(rng.choice([base, base, rng.choice(texts)]))
        for _ in range(rng.randint(1, 5)):
            at = rng.randrange(len(t))
            t[at : at + rng.choice((0, 1, 1))] = [f"e{rng.randrange(6)}"] * rng.choice((0, 1, 1, 1))
        texts.append(t)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    check(spark, rows, tmp_path)


def test_a_large_cell_of_unlike_texts(spark, tmp_path, monkeypatch):
    """Texts that share most of what they have with many, yet aren't alike: no links, and few comparisons."""
    monkeypatch.setattr(jaccard, "SMALL", 20)
    rng = random.Random(29)
    blocks = [[f"k{b}w{i}" for i in range(12)] for b in range(16)]
    rows = [(i, " ".join(w for b in rng.sample(range(16), 8) for w in blocks[b])) for i in range(600)]
    check(spark, rows, tmp_path)


def test_needed_is_a_lower_bound():
    rng = random.Random(31)
    for _ in range(3_000):
        p = set(range(rng.randint(1, 60)))
        x, y = ({i for i in p if rng.random() > q} | {rng.randrange(100, 100 + m) for _ in range(rng.randint(0, m))} for q, m in ((0.1, 8), (0.15, 12)))
        if not x or not y:
            continue
        linked = lambda a, b: 100 * len(a & b) >= 80 * len(a | b)
        near = linked(x, p), linked(y, p)
        if linked(x, y) and x not in (y, p) and y != p and not all(near):
            shared = len((x ^ p) & (y ^ p))
            for s, n in ((x, near[0]), (y, near[1])):
                needed = jaccard._needed(len(s ^ p), len(s), len(p), n, 80)
                assert needed is not None and 1 <= needed <= shared


def test_sketches_are_no_farther_apart_than_sets():
    import numpy as np

    rng = np.random.default_rng(3)
    for _ in range(200):
        x, y = (np.unique(rng.integers(0, 400, rng.integers(0, 80)).astype(np.uint64)) for _ in range(2))
        bits = sum(int(a ^ b).bit_count() if a ^ b >= 0 else ((int(a ^ b)) & (1 << 64) - 1).bit_count() for a, b in zip(jaccard.sketch(x), jaccard.sketch(y), strict=True))
        assert bits <= len(np.setxor1d(x, y))


def test_only_the_result_is_left_in_the_shared_folder(spark, tmp_path):
    import os

    spark.createDataFrame([(i, f"a b c d e f {i % 3}") for i in range(9)], "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    base = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(base)) if os.path.isdir(base) else set()
    assert jaccard.near_duplicates(spark.read.parquet(f"{tmp_path}/docs")).count() == 9
    assert [x.split("-")[0] for x in set(os.listdir(base)) - before] == ["near"]


def test_sparse_groups_near_the_threshold(spark, tmp_path):
    rng = random.Random(17)
    rows = []
    for g in range(250):  # the members' seats have different members, so different pivots
        base = [f"g{g}w{i}" for i in range(rng.randint(40, 160))]
        for m in range(rng.randint(3, 8)):
            t = list(base)
            for _ in range(max(1, len(t) // rng.choice((60, 80, 100)))):
                t[rng.randrange(len(t))] = f"g{rng.randrange(250)}w{rng.randrange(160)}"
            rows.append((10 * g + m, " ".join(t)))
    check(spark, rows, tmp_path)


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/none")
    assert jaccard.near_duplicates(spark.read.parquet(f"{tmp_path}/none")).count() == 0


def test_components_of_long_chains(spark):
    rng = random.Random(2)
    order = list(range(1, 120))
    links = [(a, a + 1) for a in order] + [(500, 501), (501, 502), (700, 700)] + [(900 + rng.randrange(9), 900 + rng.randrange(9)) for _ in range(20)]
    with Scratch(spark, "test") as tables:
        got = {r.rid: r.component for r in jaccard.components(spark.createDataFrame(links, "a long, b long"), tables).collect()}
    assert all(got[i] == 1 for i in range(1, 121)) and got[502] == 500


def test_cells_by_parts_are_all_cells_once(spark, tmp_path):
    """Parts of the cells are dealt out in turn, which bounds what is on disk at a time; together they are all entries."""
    rng = random.Random(8)
    texts = [(i, jaccard._packed(" ".join(f"w{rng.randrange(40)}" for _ in range(rng.randrange(1, 60))))) for i in range(60)]
    df = spark.createDataFrame(texts, "rid long, body binary")
    order = jaccard._frequent(df, 5)
    (whole,) = jaccard._set_cells(df, order, 5, 80)
    parts = [[tuple(r) for r in part.collect()] for part in jaccard._set_cells(df, order, 5, 80, 3)]
    assert all(parts) and sorted(sum(parts, [])) == sorted(tuple(r) for r in whole.collect())
    for i, part in enumerate(parts):
        assert all((cell & (1 << 64) - 1) % 3 == i for cell, _ in part)


def test_no_text_is_left_once_the_sets_are_known(spark, tmp_path, monkeypatch):
    """Each part of the points goes as soon as its sets are known, before the next part's are."""
    events, remove, known = [], Scratch.remove, jaccard._known
    monkeypatch.setattr(Scratch, "remove", lambda self: (events.append("gone" if "/points-" in self.folder else "end"), remove(self)))
    monkeypatch.setattr(jaccard, "_known", lambda *a: (events.append("known"), known(*a))[1])
    check(spark, [(i, " ".join(f"w{j}" for j in range(i % 5, 30))) for i in range(40)], tmp_path)
    assert events == ["known", "gone"] * jaccard.POINT_PARTS + ["end"]
