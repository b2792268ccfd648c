"""Group rollups with modal values (one row per key)."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def modal_values(df: DataFrame, key: str, modes: list[str]) -> DataFrame:
    """Per ``key``, the most frequent value of each column; ties go to the smallest, NULLs are ignored.

    Two levels: (key, column, value) rows are counted with map-side combine,
    then each key keeps the best (count, value) pair of every column. No buffer grows
    with the distinct values of a key. Keys whose values are all NULL have no row."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    one_each = F.array(*[
        F.struct(F.lit(i).alias("_c"), *[(F.col(m) if j == i else F.lit(None).cast(kinds[m])).alias(f"_v{j}")
                                         for j, m in enumerate(modes)])
        for i in range(len(modes))])
    values = [f"_v{j}" for j in range(len(modes))]
    counts = (df.select(key, F.inline(one_each))
              .filter(reduce(or_, [F.col(v).isNotNull() for v in values]))
              .groupBy(key, "_c", *values).agg(F.count(F.lit(1)).alias("_n")))
    best = counts.groupBy(key).agg(*[
        F.min(F.when(F.col("_c") == i, F.struct((-F.col("_n")).alias("n"), F.col(v).alias("v")))).alias(m)
        for i, (m, v) in enumerate(zip(modes, values, strict=True))])
    return best.select(key, *[F.col(f"`{m}`.v").alias(m) for m in modes])


def modal_rollup(df: DataFrame, key: str, means: list[str], modes: list[str],
                 mean_digits: int = 6) -> DataFrame:
    """Per ``key``: rounded mean of ``means`` and the most frequent value of ``modes`` (:func:`modal_values`)."""
    averages = [F.round(F.avg(F.col(m)), mean_digits).alias(m) for m in means]
    mean = df.groupBy(key).agg(*averages) if means else df.select(key).distinct()
    mode = modal_values(df, key, modes).withColumnRenamed(key, "_key")
    return mean.join(mode, mean[key].eqNullSafe(mode["_key"]), "left").select(key, *means, *modes)
