"""Consecutive slices of ordered rows, written once in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.session import scratch_path

SLICE = "_slice"


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written and read back: computed once, and of a size the planner knows."""
    path = scratch_path(df.sparkSession, f"{label}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def range_slices(df: DataFrame, order: list[str], label: str) -> DataFrame:
    """``df`` range-partitioned on ``order`` and read back with the number of each row's slice.

    Every row of a slice is before every row of a later one. The slices are the
    table's partition folders, so that a filter on ``SLICE`` reads only the slices
    it names; they are written because their bounds are sampled and must not
    be drawn twice."""
    spark = df.sparkSession
    path = scratch_path(spark, f"{label}-{uuid.uuid4().hex}")
    sliced = df.repartitionByRange(*[F.col(c) for c in order]).withColumn(SLICE, F.spark_partition_id())
    sliced.write.partitionBy(SLICE).parquet(path)
    return spark.read.schema(sliced.schema).parquet(path)
