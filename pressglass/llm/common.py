"""What several operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch: keeps a batch of long texts well below a worker's memory.
ARROW_ROWS = 400


def bounded_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Hands rows to Python workers in small batches, so that a batch of long texts stays small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def shared_folder(spark: SparkSession, what: str) -> str:
    """A fresh folder name below spark.checkpoint.dir, which the driver and all executors see.

    Only where that setting is absent and the master is local (tests) a temporary folder is set and used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


class Scratch:
    """Tables in one folder below the shared one, which goes with all of them when the scope ends.

    Only what no DataFrame reads any more may be in it: results are stored() outside.
    """

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.folder = spark, shared_folder(spark, what)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.remove()

    def remove(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)

    def inner(self, what: str) -> Scratch:
        """A scope in this one, for tables that may go before the others."""
        one = Scratch(self.spark, what)
        one.folder = f"{self.folder}/{what}-{uuid.uuid4().hex}"
        return one

    def stored(self, df: DataFrame, what: str) -> DataFrame:
        return stored(df, what, f"{self.folder}/{what}-{uuid.uuid4().hex}")

    def counted(self, df: DataFrame, what: str, **rows: Column) -> tuple[DataFrame, dict[str, int]]:
        """df stored, and how many of its rows meet each condition, found while it is written."""
        seen = Observation()
        df = self.stored(df.observe(seen, *[F.count_if(c).alias(k) for k, c in rows.items()]), what)
        return df, {k: seen.get.get(k, 0) for k in rows}  # an empty plan may observe nothing


def stored(df: DataFrame, what: str, path: str | None = None) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: the lineage ends there.

    The job's shuffle files are of no use once the table is there, so they are removed when it ends.
    """
    spark = df.sparkSession
    path = path or shared_folder(spark, what)
    schema = df.schema
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(setting) if before is None else spark.conf.set(setting, before)
    return spark.read.schema(schema).parquet(path)


@contextmanager
def by_part_of_the_key(spark: SparkSession) -> Iterator[None]:
    """Joins of sides that are dealt out by some of their keys go without dealing them out by all keys again."""
    setting = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, "false")
    try:
        yield
    finally:
        spark.conf.unset(setting) if before is None else spark.conf.set(setting, before)


def private(docs: DataFrame, name: str) -> str:
    """name, with underscores before it until docs has no such column."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def numbered(docs: DataFrame, name: str = "rid") -> DataFrame:
    """docs with a number for each row that is the same in every later job of the session.

    docs must be read from files.  The way in which files are cut into tasks depends on the number of cores unless
    it is pinned, so it is pinned here: executors that come or go between two jobs change no number.
    """
    spark = docs.sparkSession
    if not spark.conf.get("spark.sql.files.minPartitionNum", None):
        spark.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))
    return docs.withColumn(name, F.monotonically_increasing_id())


def placed(df: DataFrame, order: list[Column], put: Callable[[DataFrame, str], DataFrame], name: str = "place") -> DataFrame:
    """df with each row's place (from 0) in a total order over all rows.

    Rows are sorted by range and put() once; the ranges' sizes, one number each, are added up on the driver.  No range
    holds a group together, so a key with many rows lies in many of them.
    """
    own = {"_range": F.spark_partition_id(), "_row": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}
    rows = put(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns(own), "sorted")
    ahead, before = 0, []
    for r in rows.groupBy("_range").count().orderBy("_range").collect():
        before.append((r["_range"], ahead))
        ahead += r["count"]
    starts = F.broadcast(df.sparkSession.createDataFrame(before, "_range int, _ahead long"))
    return rows.join(starts, "_range").withColumn(name, F.col("_row") + F.col("_ahead")).drop("_range", "_row", "_ahead")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
