"""Keep-first deduplication on a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: list[str], order: list[str | Column] | None = None) -> DataFrame:
    """One row per ``keys``: the row that sorts first by ``order``.

    ``order`` defaults to the whole row, so the choice never depends on how
    rows were partitioned. Implemented as ``min_by`` in a grouped aggregate,
    which combines map-side: a key holding a third of all rows is reduced in
    every map task before the shuffle, never gathered in one task.
    """
    payload = [c for c in df.columns if c not in keys]
    if not payload:
        return df.select(*keys).distinct()
    row = f"struct({', '.join(_q(c) for c in payload)})"
    if order and all(isinstance(o, str) for o in order):
        picked = F.expr(f"min_by({row}, struct({', '.join(_q(o) for o in order)})) AS _kept")
    elif order:
        picked = F.min_by(F.expr(row), F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])).alias("_kept")
    else:
        picked = F.expr(f"min({row}) AS _kept")
    return df.groupBy(*keys).agg(picked).selectExpr(*[_q(k) for k in keys], "_kept.*")


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
