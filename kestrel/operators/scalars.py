"""Attach global (one-row) aggregates to rows without a join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def with_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a one-row DataFrame (a global aggregate) to every row of ``df``.

    Expressed as one scalar subquery over a struct: Spark evaluates it once
    and inlines the value, so there is no join and nothing but one row moves."""
    cols = one_row.columns
    tmp = "__scalars__"
    while tmp in df.columns:
        tmp += "_"
    packed = one_row.selectExpr(f"struct({', '.join(_q(c) for c in cols)}) AS {tmp}").scalar()
    return df.withColumn(tmp, packed).selectExpr(
        *[_q(c) for c in df.columns], *[f"{tmp}.{_q(c)} AS {_q(c)}" for c in cols])


def one_row(*aggregates: DataFrame) -> DataFrame:
    """Combine one-row aggregates into a single row, in one job and without a join.

    The rows are unioned (each carries only its own columns, the others
    NULL) and collapsed by a global aggregate; every column is non-NULL in at
    most one input row, so ``first(ignorenulls)`` picks it deterministically."""
    from functools import reduce
    u = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), aggregates)
    cols = []
    for df in aggregates:
        cols += [c for c in df.columns if c not in cols]
    return u.agg(*[F.expr(f"first({_q(c)}, true) AS {_q(c)}") for c in cols])
