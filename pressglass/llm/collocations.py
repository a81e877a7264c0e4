"""Phrase collocations by top-order marginalisation: only the longest windows are counted, shorter phrases are sums.

Every word opens one window: itself and the words that lead on from it, padded where its piece ends.  Equal windows are
counted, and one ROLLUP over the window's columns sums the counts of each shorter prefix; a phrase occurs as often as windows
begin with it.  Windows are padded early, from the first pair on that is too rare to be in any candidate, which leaves few
different ones.  Which pairs are frequent is found before, from counts of their hashes, and told to tasks by a bit array of
bounded size: it may take a rare pair for a frequent one (ROLLUP then finds its true count), never the reverse.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressglass.llm.common import Scratch, bounded_batches, placed, stored
from pressglass.sizes import small

#: Characters of one language's texts that are counted at a time.
CHUNK = 6_000_000
#: Bits for each frequent pair, and the most bits (32 MB) that tasks are sent.
PAIR_BITS, MOST_BITS = 16, 1 << 28
#: Of columns a, n, l, r; exact, for decimals of 38 digits hold its products.
SCORE = "cast(1000 as decimal(4, 0)) * cast(a as decimal(15, 0)) * cast(n as decimal(17, 0)) div (cast(l as decimal(18, 0)) * cast(r as decimal(18, 0)))"
#: Of a byte: 0 in a word, 1 between words, 2 between pieces.
KIND = np.zeros(256, np.uint8)
KIND[[0x20, 0x09]] = 1
KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def _words(data: bytes) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """The words in data as numbers, the words that these stand for, and whether the next word is in the same piece."""
    raw = np.frombuffer(data, np.uint8)
    kind = KIND[raw]
    inside = kind == 0
    none = np.zeros(1, np.int8)
    edges = np.diff(np.concatenate([none, inside.view(np.int8), none]))
    begin, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    piece = np.cumsum(kind == 2, dtype=np.int32)[begin]
    offsets = np.zeros(len(begin) + 1, np.int64)
    np.cumsum(end - begin, out=offsets[1:])
    words = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(offsets), pa.py_buffer(LOWER[raw][inside]))
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary, np.append(piece[1:] == piece[:-1], np.zeros(min(1, len(piece)), bool))


def _pair_hashes(lang: str, ids: np.ndarray, known: pa.Array, at: np.ndarray) -> np.ndarray:
    """A number for the pair of each word in `at` with the next one: equal pairs of a language have equal ones."""
    of = np.fromiter(map(xxhash.xxh64_intdigest, known.cast(pa.large_binary()).to_pylist()), np.uint64, len(known))
    mixed = of[ids[at]] * np.uint64(0x9E3779B97F4A7C15) + of[ids[at + 1]] * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(xxhash.xxh64_intdigest(lang))
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return (mixed ^ (mixed >> np.uint64(32))).view(np.int64)


def _pairs(lang: str, data: bytes) -> pa.RecordBatch:
    """The hashes of the pairs in data with their counts."""
    ids, known, goes_on = _words(data)
    hashes, n = np.unique(_pair_hashes(lang, ids, known, np.flatnonzero(goes_on)), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(n)], names=["pair", "n"])


def _windows(order: int, frequent: bytes, lang: str, data: bytes) -> pa.RecordBatch:
    """The windows of `order` words in data with their counts; pairs whose bit isn't set in frequent end a window."""
    ids, known, goes_on = _words(data)
    bits, at, n = np.frombuffer(frequent, np.uint8), np.flatnonzero(goes_on), len(ids)
    place = _pair_hashes(lang, ids, known, at) & (8 * len(bits) - 1)
    goes_on[at] = (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
    columns, alive = [ids], np.ones(n, bool)
    for k in range(1, order):
        column = np.full(n, -1, np.int32)
        alive = alive[: n - k] & goes_on[k - 1 : n - 1] if n > k else np.zeros(0, bool)
        column[: len(alive)] = np.where(alive, ids[k:], -1)
        columns.append(column)
    names = [f"w{k + 1}" for k in range(order)]
    found = pa.table(columns, names=names).group_by(names).aggregate([([], "count_all")])
    taken = [known.take(pa.array(c := found[x].to_numpy(), mask=c < 0)).cast(pa.string()) for x in names]
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), *taken, found["count_all"].combine_chunks()], names=["lang", *names, "n"])


def _by_language(count: Callable[[str, bytes], pa.RecordBatch]):
    """Runs count over the texts of one language, CHUNK characters or a little more at a time; rows: lang, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[str]] = defaultdict(list)
        sizes: dict[str, int] = defaultdict(int)

        def counted(lang: str) -> pa.RecordBatch:
            sizes.pop(lang)
            return count(lang, "\n".join(held.pop(lang)).encode("utf-8", "surrogatepass"))

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held[lang].append(text)
                sizes[lang] += len(text) + 1
                if sizes[lang] >= CHUNK:
                    yield counted(lang)
            if sum(sizes.values()) >= 2 * CHUNK:
                yield from map(counted, list(held))
        yield from map(counted, list(held))

    return run


def prefix_counts(texts: DataFrame, order: int, least: int, frequent: bytes) -> DataFrame:
    """lang, n_words, phrase, f of phrases of up to `order` words that occur `least` times or more; n_words 0: all words."""
    words = [f"w{k + 1}" for k in range(order)]
    windows = texts.select("lang", "text").mapInArrow(_by_language(partial(_windows, order, frequent)), "lang string, " + ", ".join(f"{w} string" for w in words) + ", n long")
    rolled = windows.rollup("lang", *words).agg(F.sum("n").alias("f"), F.grouping_id().alias("summed")).where((F.col("f") >= least) | (F.col("summed") == 2**order - 1))
    # A prefix of k words is a phrase if none of the k is padding; the row over all languages goes.
    rows = rolled.where(f"summed < {2 ** order}").select("lang", (order - F.bit_count("summed")).alias("n_words"), F.array_compact(F.array(*words)).alias("words"), "f")
    return rows.where(F.size("words") == F.col("n_words")).select("lang", "n_words", F.array_join("words", " ").alias("phrase"), "f")


def frequent_pairs(texts: DataFrame, least: int, tables: Scratch) -> bytes:
    """A bit array in which each pair that occurs `least` times has its bit set; gathered in bitmaps of 4 KiB."""
    hashes = texts.select("lang", "text").mapInArrow(_by_language(_pairs), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    found = tables.stored(hashes.where(F.col("n") >= least).select("pair"), "pairs")
    size, n = 1 << 15, found.count()
    while size < min(MOST_BITS, PAIR_BITS * n):
        size *= 2
    bit = F.col("pair").bitwiseAND(size - 1)
    out = bytearray(size // 8)
    for m in found.groupBy(F.floor(bit / 32768).alias("nr")).agg(F.bitmap_construct_agg(bit % 32768).alias("bits")).collect():
        out[m.nr * 4096 : m.nr * 4096 + len(m.bits)] = m.bits
    return bytes(out)


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, inside: int = 100, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `top` phrases of 2 to `longest` words.

    A-Z are lower-cased, pieces end at [.,;:!?] and line ends, words are what lies between blanks and tabs.  Of a phrase that
    occurs a >= least times, each cut into two parts has the score floor(1000 * a * n / (l * r)); its lowest cut counts, of
    equal ones the one with the shortest first part.  A phrase inside a longer one with 100 * f(longer) >= inside * a goes.
    Null texts are empty, a null language is `und`, repeated rows count each time, other columns aren't read, and an
    empty table gives no rows.  Phrases of equal score and a rank in the order of their bytes.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    with Scratch(spark, "collocations") as tables:
        counts = tables.stored(prefix_counts(texts, longest, least, frequent_pairs(texts, least, tables)), "counts")
        whole = counts.where("n_words = 0").select("lang", F.col("f").alias("n"))
        phrases = counts.where("n_words >= 2").select("lang", "n_words", "phrase", F.col("f").alias("a")).withColumn("words", F.split("phrase", " "))

        def part(of: str, name: str) -> DataFrame:
            return counts.where("n_words >= 1").select("lang", F.col("phrase").alias(of), F.col("f").alias(name))

        cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n_words") - 1)))
        cuts = cuts.withColumns({"first": F.array_join(F.slice("words", 1, F.col("k")), " "), "rest": F.array_join(F.slice("words", F.col("k") + 1, F.col("n_words") - F.col("k")), " ")})
        cuts = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"]).join(small(whole), "lang")
        best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(F.expr(SCORE).alias("score"), "k", "l", "r")).alias("best"))
        inner = phrases.where("n_words > 2").select("lang", "words", "n_words", "a", F.explode(F.sequence(F.lit(2), F.col("n_words") - 1)).alias("m"))
        inner = inner.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n_words") - F.col("m") + 1)))
        inner = inner.groupBy("lang", F.array_join(F.slice("words", F.col("i"), F.col("m")), " ").alias("phrase")).agg(F.max("a").alias("within"))
        left = best.join(inner, ["lang", "phrase"], "left").where(100 * F.coalesce("within", F.lit(0)) < inside * F.col("a"))
        left = left.select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")
        ranked = placed(left, [F.col("lang"), F.desc("score"), F.desc("a"), F.col("phrase")], tables.stored)
        first = ranked.groupBy("lang").agg(F.min("place").alias("ahead"))
        ranked = ranked.join(small(first), "lang").withColumn("rank", F.col("place") - F.col("ahead") + 1).where(F.col("rank") <= top)
        return stored(ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations")
