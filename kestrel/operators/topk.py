"""Top-k with explicit null ordering and a total tiebreak."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def desc_first(c) -> Column:
    """DESC with NULLs first (the ordering the reference's database applies)."""
    return (c if isinstance(c, Column) else F.col(c)).desc_nulls_first()


def asc_last(c) -> Column:
    return (c if isinstance(c, Column) else F.col(c)).asc_nulls_last()


def top_n(df: DataFrame, order: list, n: int, tiebreak: list | None = None) -> DataFrame:
    """``ORDER BY order, tiebreak LIMIT n`` -> TakeOrderedAndProject.

    Each task keeps only its local top ``n`` and the driver merges ``n`` per
    task, so nothing unbounded is collected. ``tiebreak`` makes the cut
    deterministic when ranking values tie.
    """
    keys = list(order) + [asc_last(t) if isinstance(t, str) else t for t in (tiebreak or [])]
    return df.orderBy(*keys).limit(n)
