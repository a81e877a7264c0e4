"""What batches of a stream are merged into: versioned tables with a ledger, so that a replayed batch changes nothing."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressglass.operators.match import new_labels
from pressglass.operators.merge import merge_mentions
from pressglass.sources.versions import VersionedTable

CATCH_UP = dt.timedelta(days=4)


def catch_up(batch: DataFrame, high: dt.datetime | None, time: str, late: dt.timedelta = CATCH_UP) -> tuple[DataFrame, DataFrame]:
    """A batch's rows that are in time, and those more than `late` behind `high`, the newest time of the batches before.

    Rows without a time are in time.
    """
    if high is None:
        return batch, batch.limit(0)
    floor = F.lit(high - late)
    return batch.where(F.coalesce(F.col(time) >= floor, F.lit(True))), batch.where(F.col(time) < floor)


def _entry(manifest: dict, stream: str) -> dict:
    return manifest["ledger"].get(stream, {"batch": -1, "high": None, "n_late": 0, "alerts": None, "late": None})


def stream_merge_mentions(table: VersionedTable, stream: str, alert: Callable[[DataFrame], None] | None = None, time: str = "detected_at", late: dt.timedelta = CATCH_UP, languages: DataFrame | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: merges a batch of mentions into a versioned table.

    Only the buckets that hold a key of the batch are read and rewritten.  The version is committed with the stream's entry in the
    ledger: the batch's number, the newest time so far, the rows set aside as late (see catch_up(); stored beside the table
    and counted), and the alerts (module, external_id, added), stored too.  A batch that is in the ledger is not merged again;
    rows without a key are no mentions.  alert() gets the stored alerts once they are committed, and again only if it didn't come to its end.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        manifest = table.newest()
        entry = _entry(manifest, stream)
        if batch_id > entry["batch"]:
            manifest = _merged(table, manifest, entry, batch, batch_id, stream, time, late, languages)
            entry = _entry(manifest, stream)
        if alert and batch_id == entry["batch"] and entry["alerts"] and not entry.get("alerted"):
            alert(table.spark.read.schema("module string, external_id string, added array<string>").parquet(entry["alerts"]))
            table.commit(manifest | {"ledger": manifest["ledger"] | {stream: entry | {"alerted": True}}})

    return run


def _merged(table: VersionedTable, manifest: dict, entry: dict, batch: DataFrame, batch_id: int, stream: str, time: str, late: dt.timedelta, languages: DataFrame | None) -> dict:
    high = dt.datetime.fromisoformat(entry["high"]) if entry["high"] else None
    # The batch is read several times below, and its source may not give the same twice.
    rows = table.put(batch, "batches")
    newest = rows.agg(F.max(time)).first()[0]
    in_time, behind = catch_up(rows.dropna(subset=manifest["key"]), high, time, late)
    n_late = behind.count()
    if n_late:
        entry = entry | {"late": [*(entry["late"] or []), table.put(behind, "late").inputFiles()[0].rpartition("/")[0]]}
    touched = [r[0] for r in in_time.select(table.bucket(manifest)).distinct().collect()]  # no more than there are buckets
    existing = table.read(manifest, touched)
    if existing is None:
        existing = table.spark.createDataFrame([], batch.schema)
    merged, _ = merge_mentions(existing, in_time, languages)
    manifest = table.stage(merged, manifest, touched)
    # Alerts from what is stored now and what was before, over the batch's keys: the merge runs once.
    key = manifest["key"]
    had = existing.select(*key, F.col("matched_keywords").alias("_had"))
    now = table.read(manifest, touched).join(in_time.select(*key).distinct(), key, "left_semi").select(*key, "matched_keywords")
    added = now.join(had, key, "left").select(*key, new_labels(F.col("_had"), F.col("matched_keywords")).alias("added")).where(F.size("added") > 0)
    alerts = table.put(added, "alerts").inputFiles()
    times = [t for t in (high, newest) if t is not None]
    entry = entry | {"batch": batch_id, "high": max(times).isoformat() if times else None, "n_late": entry["n_late"] + n_late, "alerts": alerts[0].rpartition("/")[0] if alerts else None, "alerted": False}
    return table.commit(manifest | {"ledger": manifest["ledger"] | {stream: entry}})


def late_rows(table: VersionedTable, stream: str) -> DataFrame | None:
    """What was set aside as late; None if nothing was."""
    folders = _entry(table.newest(), stream)["late"]
    return table.spark.read.parquet(*folders) if folders else None


def stream_catch_up(ledger: VersionedTable, stream: str, time: str, work: Callable[[DataFrame, int], None], late: dt.timedelta = CATCH_UP) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function in front of any work: late rows are stored and counted, work() gets the others, once."""

    def run(batch: DataFrame, batch_id: int) -> None:
        manifest = ledger.newest()
        entry = _entry(manifest, stream)
        if batch_id <= entry["batch"]:
            return
        high = dt.datetime.fromisoformat(entry["high"]) if entry["high"] else None
        rows = ledger.put(batch, "batches")
        in_time, behind = catch_up(rows, high, time, late)
        n_late = behind.count()
        if n_late:
            entry = entry | {"late": [*(entry["late"] or []), ledger.put(behind, "late").inputFiles()[0].rpartition("/")[0]]}
        work(in_time, batch_id)
        newest = [t for t in (high, rows.agg(F.max(time)).first()[0]) if t is not None]
        entry = entry | {"batch": batch_id, "high": max(newest).isoformat() if newest else None, "n_late": entry["n_late"] + n_late}
        ledger.commit(manifest | {"ledger": manifest["ledger"] | {stream: entry}})

    return run
