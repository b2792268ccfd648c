"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import ctypes
import functools
import gc
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.session import scratch_path
from kestrel.sources.tables import read_table

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, sf_dir, name)


def fold_case(col: Column) -> Column:
    """A-Z to a-z and nothing else; null counts as empty."""
    return F.translate(F.coalesce(col, F.lit("")), UPPER, LOWER)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have (case-insensitively)."""
    taken = {c.lower() for c in df.columns}
    out = f"__{name}"
    while out.lower() in taken:
        out += "_"
    return out


ROWS_PER_BATCH = 2000
_BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bounded_batches() -> None:
    """Let Python tasks get at most ``ROWS_PER_BATCH`` rows and ``BATCH_BYTES`` at once: whole texts are long."""
    spark = SparkSession.getActiveSession()
    small_batches(spark)
    now = int(spark.conf.get(_BATCH_CONF))
    if now <= 0 or now > ROWS_PER_BATCH:
        spark.conf.set(_BATCH_CONF, str(ROWS_PER_BATCH))


def scratch_folder(spark: SparkSession, label: str) -> str:
    """A new folder below the shared checkpoint folder."""
    return scratch_path(spark, f"{label}-{uuid.uuid4().hex}")


def materialize(df: DataFrame, label: str, row_group: int | None = None, group_rows: int | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage (a lost executor costs no recomputation of what went
    before), fixes values that depend on partitioning, and gives the planner
    the true size, so that a join broadcasts the table only when it is small.
    ``row_group``: bytes of a Parquet row group, for tables of few, long rows. Parquet looks at them every 100
    rows only; ``group_rows`` bounds the rows of a group.
    """
    spark = df.sparkSession
    path = scratch_folder(spark, label)
    writer = df.write if row_group is None else df.write.option("parquet.block.size", row_group)
    writer = writer if group_rows is None else writer.option("parquet.block.row.count.limit", group_rows)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


BATCH_BYTES = 16 << 20
_BYTES_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Let Python tasks get at most about ``most`` bytes at once (one row, if it is longer)."""
    now = spark.conf.get(_BYTES_CONF)
    if not now.rstrip("b").isdigit() or int(now.rstrip("b")) > most:
        spark.conf.set(_BYTES_CONF, str(most))


def releasing(task):
    """A Python task (a generator function over batches) that gives its memory back to the system when it ends.

    Workers live on between tasks and stages, and keep what they grew to otherwise."""
    @functools.wraps(task)
    def run(*args):
        try:
            yield from task(*args)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
            if trim is not None:
                trim(0)
    return run
