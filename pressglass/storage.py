"""Tables and streams in the shared folder of the cluster."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, what: str) -> str:
    """A fresh folder below spark.checkpoint.dir; only where that isn't set and the master is local (tests) a temporary one is made and set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a table in the shared folder: the lineage ends there."""
    out, schema = shared_path(df.sparkSession, what), df.schema
    df.write.parquet(out)
    return df.sparkSession.read.schema(schema).parquet(out)


def drained(stream: DataFrame, what: str) -> DataFrame:
    """All that a stream has to give now, written exactly once as Parquet and read back."""
    spark = stream.sparkSession
    out = shared_path(spark, what)
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", shared_path(spark, f"{what}-log")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
