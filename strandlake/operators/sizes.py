"""Broadcasts behind a check of the size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEW = 500_000


def broadcast_if_small(df: DataFrame, most: int = FEW) -> DataFrame:
    """df marked for broadcast if it has at most so many rows, else as it is, for a shuffled join; rows must be narrow."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
