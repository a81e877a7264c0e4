"""Exact dedup by block naming: equal blocks get equal integer names, then equal pairs of names, up to one name a text.

No identity rests on a hash: a name stands for the block's bytes themselves, ranked by sorting.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressglass.llm.common import Scratch, bounded_batches, numbered, private, stored

WHITE = b" \t\n\v\f\r"
#: Bytes of normalised text in a block.
BLOCK = 16_384


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    # Compressed blocks travel; the same compressor makes the same bytes of the same block, and they can be undone.
    pack = zstandard.ZstdCompressor(level=3, write_content_size=False).compress
    for batch in batches:
        rows: list[tuple] = []
        for rid, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            text = text or ""
            data = text.encode("utf-8", "surrogatepass").translate(None, WHITE)
            n = max(1, -(-len(data) // BLOCK))
            digest = hashlib.sha256(data).digest()
            rows += [(rid, doc_id, len(text), digest, n, i, pack(data[i * BLOCK : (i + 1) * BLOCK])) for i in range(n)]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), [pa.int64(), batch.schema.field(1).type, pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary()], strict=True)], names=["rid", "doc_id", "n_chars", "digest", "n_blocks", "block_no", "block"])


def _named(df: DataFrame, keys: list[str]) -> DataFrame:
    """Replaces the key columns by `name`: equal keys have equal names, different ones different names.

    The distinct keys, found with map-side combining, are sorted in each partition; a name is a partition's number
    and a rank in it, so recomputed tasks give the same names.  They are joined back on one more column than
    they are grouped by: both sides are dealt out anew, so that AQE can split a key that has many rows.
    """
    named = df.groupBy(*keys).agg(F.lit(1).alias("one")).sortWithinPartitions(*keys)
    named = named.select(*[F.col(k).alias(f"{k}_") for k in keys], F.monotonically_increasing_id().alias("name")).withColumn("hash_", F.xxhash64(*[f"{k}_" for k in keys]))
    hashed = df.withColumn("hash", F.xxhash64(*keys))
    same = hashed["hash"] == named["hash_"]
    for k in keys:
        same &= hashed[k] == named[f"{k}_"]
    return hashed.join(named, same).drop("hash", "hash_", *keys, *[f"{k}_" for k in keys])


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", put: Callable[[DataFrame, str], DataFrame] = stored) -> DataFrame:
    """One row per row of docs: rid (the row's number), id, n_chars, text_sha256 (of the normalised text),
    keep_id, group_size, kept.

    Texts are equal when they are so without white space; null counts as empty.  Of equal texts the one with
    the most code points stays, then the smallest id (null ids last), then the first of repeated rows.  put() stores
    tables that the result reads.
    """
    bounded_batches(docs.sparkSession)
    read = numbered(docs, "_rid").select(F.col("_rid").alias("rid"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    blocks = read.mapInArrow(_blocks, f"rid long, doc_id {kind}, n_chars long, digest binary, n_blocks long, block_no long, block binary")
    own = ["rid", "doc_id", "n_chars", "digest", "n_blocks"]
    names = put(_named(blocks, ["block"]), "names")
    most = names.agg(F.max("n_blocks")).first()[0] or 1
    done = names.where("n_blocks = 1").select(*own, "name")
    rest = names.where("n_blocks > 1")
    while most > 1:  # one round for each doubling of the longest text
        most = -(-most // 2)
        left, right = F.max(F.when(F.col("block_no") % 2 == 0, F.col("name"))), F.max(F.when(F.col("block_no") % 2 == 1, F.col("name")))
        pairs = rest.groupBy(*own, F.floor(F.col("block_no") / 2).alias("block_no")).agg(left.alias("left"), F.coalesce(right, F.lit(-1)).alias("right"))
        rest = put(_named(pairs, ["left", "right"]), "names")
    # Texts of as many blocks were named in the same rounds; over different numbers names aren't compared.
    rows = done.unionByName(rest.select(*own, "name"))
    best = F.min(F.struct(-F.col("n_chars"), F.col("doc_id").isNull(), "doc_id", "rid")).alias("best")
    groups = rows.groupBy("n_blocks", "name").agg(best, F.count("*").alias("group_size"), F.first("digest").alias("digest"))
    groups = groups.select("n_blocks", "name", "digest", "group_size", F.col("best.doc_id").alias("keep_id"), F.col("best.rid").alias("keep_rid"))
    out = rows.join(groups, ["n_blocks", "name", "digest"])
    return out.select("rid", F.col("doc_id").alias(id_col), "n_chars", F.lower(F.hex("digest")).alias("text_sha256"), "keep_id", "group_size", (F.col("rid") == F.col("keep_rid")).alias("kept"))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs (read from files) that exact_groups() keeps, all their columns."""
    row = private(docs, "_rid")
    rows = numbered(docs, row)
    with Scratch(docs.sparkSession, "naming") as tables:
        groups = exact_groups(docs, id_col, text_col, tables.stored)
        gone = stored(groups.where("not kept").select(F.col("rid").alias(row)), "copies")
    return rows.join(gone.hint("merge"), row, "left_anti").select(*docs.columns)  # the same plan at every size
