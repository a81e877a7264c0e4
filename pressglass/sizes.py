"""Which tables may be broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a side table that are broadcast at most; larger ones are joined by a shuffle.
BROADCAST_ROWS = 100_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows (counted by a job that stops there)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
