"""Percentiles over the last n rows, at every row."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kestrel.operators.logs import running_sum

# The reported percentiles.
PERCENTILES = {"p50": 0.50, "p95": 0.95, "p99": 0.99}


def rolling_percentiles(log: DataFrame, group: str, order: list[str], value: str, n: int,
                        slice_rows: int = 20_000) -> DataFrame:
    """``log`` with p50/p95/p99 of ``value`` over the last ``n`` rows of its group up to the row itself.

    Nearest rank, index ``round(p * (samples - 1))`` with halves to even, as over
    a service's bounded window; ``<value>_samples`` is the number of rows looked at. Rows without a
    value take no part. A null group is a group of its own.

    Rows get their place in the group by a skew-safe running count, and a group is cut
    into slices of ``slice_rows`` places. The last ``n - 1`` rows of a slice also go to the next one, as a halo, so
    every slice is evaluated on its own, and one hot group is spread over many tasks."""
    step = max(slice_rows, n)
    rows = running_sum(log.filter(F.col(value).isNotNull()), group, order, F.lit(1).cast("long"), "_place")
    own = F.expr(f"(_place - 1) div {step}")
    at_end = F.expr(f"(_place - 1) % {step} >= {step - (n - 1)}")
    dealt = rows.withColumn("_own", own).withColumn(
        "_at", F.explode(F.when(at_end, F.array(F.col("_own"), F.col("_own") + 1)).otherwise(F.array("_own"))))
    names = [f"{p}_{value}" for p in PERCENTILES]
    fields = [*log.schema.fields, *[T.StructField(c, T.LongType()) for c in names],
              T.StructField(f"{value}_samples", T.LongType())]

    def evaluate(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_place")
        window = part[value].rolling(n, min_periods=1)
        found = {c: window.quantile(p, interpolation="nearest").astype("int64")
                 for c, p in zip(names, PERCENTILES.values(), strict=True)}
        part = part.assign(**found, **{f"{value}_samples": part["_place"].clip(upper=n)})
        return part[part["_own"] == part["_at"]][[f.name for f in fields]]

    return dealt.groupBy(group, "_at").applyInPandas(evaluate, T.StructType(fields))
