"""Attach one-row aggregates (thresholds, maxima, totals) to every row of a frame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """``one_row`` is a global aggregate (exactly one row by construction), so the broadcast holds a
    single row and every row of ``df`` meets exactly one partner: no pairs are formed."""
    return df.join(F.broadcast(one_row), how="cross")
