"""A training-data pipeline over `documents`: each stage works on all that the one before it kept.

Rows may lack an id or a text, ids may repeat, and there may be more columns, whatever their names: all stages but the last keep
them as they are.  Null texts count as empty; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressglass.llm import bpe, crf, jaccard, naming, winnow
from pressglass.llm.common import Scratch, documents, private
from pressglass.llm.queries import held_out


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line CRF rejects (score below 0.5) go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    field = crf.train(docs, labels.where(~held_out(F.col("doc_id"))))
    names = private(docs, "score"), private(docs, "n_lines")
    scored = crf.score(docs.select(*docs.columns), field, keep=docs.columns, names_out=names)
    return scored.where(F.col(names[0]) >= 0.5).select(*docs.columns)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal without white space one stays."""
    return naming.drop_exact_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of Jaccard similarity 0.8 or more connect, the one with the smallest id stays."""
    return jaccard.drop_near_copies(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share ten words in a row with a benchmark item (or hold a shorter item) go."""
    return winnow.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document that is left, with digests of them and of what they decode to."""
    import public_tokenizers

    return bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), with_ids=True)


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact_copies),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", benchmark_leaks),
    ("byte-level BPE", token_ids),
]
#: Neither a trained field nor connected components over a similarity join are SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; a stage's table goes when the next one's is stored, the last stays."""
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES:
        tables = Scratch(spark, name.replace(" ", "-"))
        docs = tables.stored(stage(spark, docs, sf_dir), "kept")
        if before:
            before.remove()
        before = tables
    return docs.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
