"""Display formats for money, counts and percentages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def compact_brl(x) -> Column:
    """``R$ 1.23M`` from 1e6, ``R$ 1.2K`` from 1e3, else ``R$ 1,234.56``.

    Scaled values are rounded HALF_UP on exact decimals before formatting,
    so the text never depends on binary floating-point ties."""
    v = _c(x).cast("decimal(18,2)")
    millions = F.round(v / F.lit(1_000_000).cast("decimal(7,0)"), 2)
    thousands_ = F.round(v / F.lit(1_000).cast("decimal(4,0)"), 1)
    return (F.when(v >= 1_000_000, F.concat(F.lit("R$ "), millions.cast("string"), F.lit("M")))
             .when(v >= 1_000, F.concat(F.lit("R$ "), thousands_.cast("string"), F.lit("K")))
             .otherwise(F.concat(F.lit("R$ "), F.format_number(v, 2))))


def thousands(x) -> Column:
    """Integer with thousands separators (``1,234,567``)."""
    return F.format_number(_c(x).cast("long"), 0)


def usd(x) -> Column:
    return F.concat(F.lit("$"), F.format_number(_c(x).cast("double"), 2))


def pct1(x) -> Column:
    """One-decimal percentage text (``12.3%``)."""
    return F.format_string("%.1f%%", _c(x).cast("double"))
