"""Exact numeric helpers that stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_ratio_spark_sql(num: str, den: str, digits: int = 2) -> str:
    """SQL text of ``round(num / den, digits)`` with HALF_UP (away from zero), exact, for integer references.

    Rounding a double average first and then to ``digits`` can round twice;
    this computes the rounded quotient on integers, then converts once to
    double. NULL when ``den`` is 0 or NULL (the NULLIF rule)."""
    scale = 10 ** digits
    n, d = f"CAST({num} AS BIGINT)", f"nullif(CAST({den} AS BIGINT), 0L)"
    return (f"(CAST(signum({n}) * ((abs({n}) * {2 * scale}L + {d}) div ({d} * 2L)) AS DOUBLE) "
            f"/ {float(scale)}D)")


def round_ratio(num: str, den: str, digits: int = 2) -> Column:
    """:func:`round_ratio_spark_sql` for column names."""
    return F.expr(round_ratio_spark_sql(f"`{num}`", f"`{den}`", digits))
