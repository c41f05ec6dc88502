"""Size checks before a broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def small(df: DataFrame, max_rows: int = 10_000) -> DataFrame:
    """`df` marked for broadcast if it has at most `max_rows` rows (counted now, no further than that);
    otherwise as it is, so the join shuffles."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
