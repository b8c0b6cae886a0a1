"""Checked sizes: what may be broadcast, and what otherwise."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a few longs that are safe to broadcast: some 30 MB as a hashed relation.
BROADCAST_ROWS = 400_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df``, which should be materialised, has at most ``rows`` rows; reads no more than that."""
    return df.select(F.lit(1)).limit(rows + 1).count() <= rows


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """With a broadcast hint where the count allows it; else as it is, for a shuffle join under AQE."""
    return F.broadcast(df) if small(df, rows) else df
