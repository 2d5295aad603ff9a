"""Cutting lineage, and broadcasts behind a check of size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import fresh_path

#: Rows of a few columns up to which a table may be broadcast.
BROADCAST_ROWS = 1_000_000


def saved(df: DataFrame, label: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read back: it is made once, and survives lost executors."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df (saved, so that counting reads no column) with a broadcast hint if it has at most so many rows; else the join shuffles."""
    return F.broadcast(df) if df.count() <= rows else df
