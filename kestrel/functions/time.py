"""Timestamp parsing and formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TS_FORMAT = "yyyy-MM-dd HH:mm:ss"


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def lenient_timestamp(x, fmt: str = TS_FORMAT) -> Column:
    """Parse text to a zone-less timestamp; anything unparseable becomes NULL.

    A plain cast raises under ANSI mode; ``try_to_timestamp`` does not.
    A date-only value amid full timestamps is NULL (the format is strict).
    """
    return F.try_to_timestamp(_c(x).cast("string"), F.lit(fmt)).cast("timestamp_ntz")


def year_range(ts, year: int) -> Column:
    """Half-open calendar-year predicate; stays prunable (no ``year(col)``)."""
    c = _c(ts)
    return (c >= F.lit(f"{year}-01-01 00:00:00").cast("timestamp_ntz")) & \
           (c < F.lit(f"{year + 1}-01-01 00:00:00").cast("timestamp_ntz"))


def year_month(x) -> Column:
    return F.date_format(_c(x), "yyyy-MM")
