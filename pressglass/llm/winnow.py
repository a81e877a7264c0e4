"""Benchmark decontamination by winnowing, in DataFrame operations only.

Every run of `span` words has a fingerprint: the smallest of the hashes of its k-grams.  As neighbouring runs mostly
share theirs, a document has few distinct ones.  Training and test fingerprints are joined; hits are then extended to
the words themselves, so the result is exact: any shared run of `span` words is found, and nothing else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressglass.llm.common import ascii_lower, stored

#: What separates words, once A-Z are lower-cased.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words in a gram. Shorter spans are one gram.
GRAM = 5
#: The test side is broadcast up to so many fingerprints (16 bytes each), and joined by a shuffle beyond.
BROADCAST_ROWS = 500_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAP), "")


def _let(value: Column, body) -> Column:
    """body(value), with value evaluated once: inside lambdas, an expression would be evaluated for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _hashed(own_words: Column) -> Column:
    return F.transform(own_words, lambda x: F.xxhash64(x))


def _winnowed(hashed: Column, span: int) -> Column:
    """hashed: the words' hashes (an array that is bound already) -> what fingerprints() gives."""
    k = min(GRAM, span)

    def runs_of(parts: Column, length: int, value) -> Column:
        return parts if length == 1 else F.transform(F.sequence(F.lit(1), F.size(parts) - (length - 1)), lambda i: value(F.slice(parts, i, length)))

    runs = _let(runs_of(hashed, k, F.xxhash64), lambda grams: runs_of(grams, span - k + 1, F.array_min))
    return F.when(F.size(hashed) >= span, runs).otherwise(F.array().cast("array<long>"))


def fingerprints(own_words: Column, span: int) -> Column:
    """array<long>: for each run of span words in order, the smallest hash of its grams; empty for shorter texts."""
    return _let(_hashed(own_words), lambda h: _winnowed(h, span))


def benchmark_windows(benchmark: DataFrame, span: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, size, window (words), fingerprint: each run of span words of an item, or a shorter item's only one.

    Items without words (null or empty texts too) have none; rows without an id are left out.
    """
    items = benchmark.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("item_id"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    n = F.least(F.size("w"), F.lit(span))
    each = _let(F.struct("w", n.alias("n")), lambda x: F.transform(F.sequence(F.lit(1), F.size(x["w"]) - x["n"] + 1), lambda i: F.slice(x["w"], i, x["n"])))
    runs = items.select("item_id", n.alias("size"), F.explode(each).alias("window")).distinct()
    prints = F.element_at(fingerprints(F.col("window"), span), 1)
    for size in range(1, span):
        prints = F.when(F.col("size") == size, F.element_at(fingerprints(F.col("window"), size), 1)).otherwise(prints)
    return runs.withColumn("fingerprint", prints)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """id, text_hash (tells rows with the same id apart), text; and the same with words (w) instead."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return base, base.select("id", "text_hash", words(F.col("text")).alias("w"))


def hits(docs: DataFrame, benchmark: DataFrame, span: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text_hash, n_hit, item_ids of the documents with a hit, once for repeated rows."""
    base, split = _rows(docs, id_col, text_col)
    windows = stored(benchmark_windows(benchmark, span), "windows")
    sizes = sorted(r[0] for r in windows.select("size").distinct().collect())  # span of them at most
    prints = windows.select("size", "fingerprint").distinct()
    if prints.count() <= BROADCAST_ROWS:
        prints = F.broadcast(prints)
    if not sizes:
        return base.where("false").select("id", "text_hash", F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("item_ids"))

    def of_sizes(value) -> Column:
        """value(hashes of w, size), an array for each size, all in one: words are split and hashed once."""
        return F.explode(_let(_hashed(F.col("w")), lambda h: F.flatten(F.array(*[value(h, size) for size in sizes])))).alias("x")

    def sized(h: Column, size: int) -> Column:
        return F.transform(F.array_distinct(_winnowed(h, size)), lambda p: F.struct(F.lit(size).alias("size"), p.alias("fingerprint")))

    found = split.select("id", "text_hash", of_sizes(sized)).select("id", "text_hash", "x.*").join(prints, ["size", "fingerprint"], "left_semi")
    # Extension: documents with a hit are read again, and their runs with these fingerprints are compared word by word.
    found = stored(found.groupBy("id", "text_hash").agg(F.collect_set("fingerprint").alias("prints")), "hits")
    again = base.alias("b").join(found.alias("f"), F.col("b.id").eqNullSafe(F.col("f.id")) & (F.col("b.text_hash") == F.col("f.text_hash"))).select("b.id", "b.text_hash", "prints", words(F.col("text")).alias("w")).dropDuplicates(["id", "text_hash"])

    def placed(h: Column, size: int) -> Column:
        at = F.transform(_winnowed(h, size), lambda p, i: F.when(F.array_contains("prints", p), F.struct(F.lit(size).alias("size"), i.alias("at"), F.slice("w", i + 1, size).alias("window"))))
        return F.filter(at, lambda x: x.isNotNull())

    runs = again.select("id", "text_hash", of_sizes(placed)).select("id", "text_hash", "x.*")
    by_window = windows.select("size", "window").distinct()
    shared = stored(runs.join(by_window, ["size", "window"], "left_semi"), "shared")
    hit = shared.select("id", "text_hash", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("size") - 1)).alias("word")).groupBy("id", "text_hash").agg(F.count_distinct("word").alias("n_hit"))
    by_item = shared.select("id", "text_hash", "size", "window").distinct().join(windows, ["size", "window"]).select("id", "text_hash", F.col("item_id").cast("string").alias("item_id"))
    by_item = by_item.distinct().groupBy("id", "text_hash").agg(F.array_sort(F.collect_list("item_id")).alias("item_ids"))
    return hit.alias("h").join(by_item.alias("i"), F.col("h.id").eqNullSafe(F.col("i.id")) & (F.col("h.text_hash") == F.col("i.text_hash"))).select("h.id", "h.text_hash", "n_hit", "item_ids")


def contamination(docs: DataFrame, benchmark: DataFrame, span: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_words, n_hit (words inside any occurring window), n_items, item_ids (sorted
    as strings), contaminated.

    Null and empty texts have no words.  Repeated rows each give their row; rows that share an id are told apart
    by their text.  An empty benchmark hits nothing.  Other columns of either table are ignored.
    """
    _, split = _rows(docs, id_col, text_col)
    counts = split.select("id", "text_hash", F.size("w").alias("n_words"))
    found = hits(docs, benchmark, span, id_col, text_col)
    out = counts.alias("c").join(found.alias("h"), F.col("c.id").eqNullSafe(F.col("h.id")) & (F.col("c.text_hash") == F.col("h.text_hash")), "left")
    n_hit, items = F.coalesce("n_hit", F.lit(0)).cast("long"), F.coalesce("item_ids", F.array().cast("array<string>"))
    return out.select(F.col("c.id").alias(id_col), F.col("n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), items.alias("item_ids"), (n_hit > 0).alias("contaminated"), "c.text_hash")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, span: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without a hit, all their columns."""
    found = hits(docs, benchmark, span, id_col, text_col).select(F.col("id").alias("_id"), F.col("text_hash").alias("_hash"))
    own = F.xxhash64(F.coalesce(docs[text_col], F.lit("")))
    return docs.join(found, docs[id_col].eqNullSafe(found["_id"]) & (own == found["_hash"]), "left_anti")
