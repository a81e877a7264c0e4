"""Tables in versions: data first, then a manifest, whose rename commits it; readers take the newest manifest.

A table is cut into buckets by its key.  A version names, for each bucket, the folder that holds it, so a write that touches few
buckets rewrites only these and takes the others over.  A folder that no manifest names is never read: a write that dies leaves the
version before it.  A manifest also holds the ledger of the streams that write to the table.  One writer at a time.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 64


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, key: list[str], buckets: int = BUCKETS):
        """key and buckets are those of the first write; later ones take them from the manifest."""
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(name)

    def _fs(self):
        return self._path(self.path).getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def _exists(self, name: str) -> bool:
        return self._fs().exists(self._path(name))

    def manifests(self) -> list[str]:
        """Committed versions, oldest first."""
        folder = f"{self.path}/_manifests"
        if not self._exists(folder):
            return []
        return sorted(str(s.getPath()) for s in self._fs().listStatus(self._path(folder)) if s.getPath().getName().endswith(".json"))

    def newest(self) -> dict:
        """The newest manifest: version, parts (folder of each bucket), schema, key, buckets, ledger; version 0 if there is none."""
        found = self.manifests()
        if not found:
            return {"version": 0, "parts": {}, "schema": None, "key": self.key, "buckets": self.buckets, "ledger": {}}
        return json.loads(self.spark.read.text(found[-1], wholetext=True).first()[0])

    def commit(self, manifest: dict) -> dict:
        """Makes manifest the newest one: it is written beside the others and then renamed."""
        version = manifest["version"] + 1
        draft, final = f"{self.path}/_drafts/{uuid.uuid4().hex}", f"{self.path}/_manifests/{version:012d}.json"
        if self._exists(final):
            raise RuntimeError(f"another writer has committed version {version} of {self.path}")
        out = self._fs().create(self._path(draft))
        out.write(bytearray(json.dumps(manifest | {"version": version}).encode()))
        out.close()
        self._fs().mkdirs(self._path(f"{self.path}/_manifests"))
        if not self._fs().rename(self._path(draft), self._path(final)):
            raise RuntimeError(f"version {version} of {self.path} can't be committed")
        return manifest | {"version": version}

    def bucket(self, manifest: dict, key: list[str] | None = None) -> Column:
        return F.pmod(F.xxhash64(*(key or manifest["key"])), F.lit(manifest["buckets"])).cast("int")

    def read(self, manifest: dict | None = None, buckets: list[int] | None = None) -> DataFrame | None:
        """The table at a version (the newest), or some of its buckets; None before the first write."""
        manifest = manifest or self.newest()
        if not manifest["schema"]:
            return None
        schema = StructType.fromJson(json.loads(manifest["schema"]))
        parts = [p for k, p in manifest["parts"].items() if buckets is None or int(k) in buckets]
        return self.spark.read.schema(schema).parquet(*parts) if parts else self.spark.createDataFrame([], schema)

    def put(self, df: DataFrame, what: str) -> DataFrame:
        """df stored in a folder of its own, which is part of the table once a manifest names it."""
        folder = f"{self.path}/{what}/{uuid.uuid4().hex}"
        df.write.parquet(folder)
        return self.spark.read.schema(df.schema).parquet(folder)

    def stage(self, df: DataFrame, manifest: dict, touched: list[int] | None = None) -> dict:
        """Writes df, which is all of the touched buckets (all buckets), and returns the manifest of the version with it."""
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        rows = df.withColumn("_bucket", self.bucket(manifest))
        rows.hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(folder)
        parts = {} if touched is None else {k: p for k, p in manifest["parts"].items() if int(k) not in touched}
        for k in range(manifest["buckets"]) if touched is None else touched:
            if self._exists(f"{folder}/_bucket={k}"):
                parts[str(k)] = f"{folder}/_bucket={k}"
        return manifest | {"parts": parts, "schema": df.schema.json()}

    def write(self, df: DataFrame) -> dict:
        """A new version that is df as a whole."""
        return self.commit(self.stage(df, self.newest()))

    def vacuum(self, keep: int = 2) -> None:
        """Removes versions before the last `keep` ones, with the data that only they name."""
        found = self.manifests()
        named = set()
        for m in found[-keep:]:
            named |= {p.rpartition("/")[0] for p in json.loads(self.spark.read.text(m, wholetext=True).first()[0])["parts"].values()}
        for m in found[:-keep]:
            self._fs().delete(self._path(m), False)
        if self._exists(f"{self.path}/data"):
            tails = {p.rpartition("/")[2] for p in named}
            for s in self._fs().listStatus(self._path(f"{self.path}/data")):
                if s.getPath().getName() not in tails:
                    self._fs().delete(s.getPath(), True)


def merged_versions(table: VersionedTable) -> DataFrame:
    """version, n_parts, n_new: how many buckets each committed version has, and how many of them it wrote itself."""
    rows, before = [], set()
    for m in table.manifests():
        one = json.loads(table.spark.read.text(m, wholetext=True).first()[0])
        own = set(one["parts"].values())
        rows.append((one["version"], len(own), len(own - before)))
        before = own
    return table.spark.createDataFrame(rows, "version int, n_parts int, n_new int")
