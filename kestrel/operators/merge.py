"""Incremental upsert: deltas merged into a stored table, bucket by bucket.

The table is Parquet in folders ``bucket=<k>``, ``k`` a hash of the key. A delta
is joined to the buckets it can touch; only buckets in which a row is new or
newer are rewritten, by dynamic partition overwrite, and all other files stay
as they are. The row with the largest (sequence, values) wins, so merging is
independent of the order and grouping of deltas, and a delta merged twice,
or again after a job that died while it replaced folders, leaves the same table.

Concurrent merges into one table are not supported: a table has one writer.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kestrel.session import cut_lineage

BUCKET = "bucket"


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def newest_per_key(rows: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The row with the largest (seq, values) of every key, map-side combined; a null sequence loses to any other."""
    rest = [c for c in rows.columns if c not in keys and c != seq]
    best = F.max(F.struct(F.col(seq), *[F.col(c) for c in rest])).alias("_best")
    return rows.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_best.`{c}`").alias(c) for c in (seq, *rest)]).select(rows.columns)


def _write(rows: DataFrame, path: str, keys: list[str], buckets: int, replace: str) -> None:
    # One task per bucket: a bucket is one file, however many tasks found its rows.
    (rows.withColumn(BUCKET, _bucket(keys, buckets)).repartition(BUCKET)
     .write.mode("overwrite").option("partitionOverwriteMode", replace).partitionBy(BUCKET).parquet(path))


def create_store(rows: DataFrame, path: str, keys: list[str], seq: str, buckets: int = 64) -> None:
    """Write a new table, in place of any at ``path``, with the newest row of every key.

    ``buckets`` stays fixed for the table; a bucket should hold some hundred megabytes."""
    _write(newest_per_key(rows, keys, seq), path, keys, buckets, "static")


def read_store(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table's rows (with their bucket, if the schema names it)."""
    return spark.read.schema(schema).parquet(path).select(*schema.names)


def merge_delta(delta: DataFrame, path: str, keys: list[str], seq: str, buckets: int = 64) -> list[int]:
    """Merge ``delta`` (the table's columns) into the table; the buckets that were rewritten."""
    spark = delta.sparkSession
    rest = [seq, *[c for c in delta.columns if c not in keys and c != seq]]
    new = cut_lineage(newest_per_key(delta, keys, seq).withColumn(BUCKET, _bucket(keys, buckets)))
    # At most one row per bucket.
    candidates = [r[BUCKET] for r in new.select(BUCKET).distinct().collect()]
    stored = read_store(spark, path, T.StructType([*delta.schema.fields, T.StructField(BUCKET, T.IntegerType())])).filter(
        F.col(BUCKET).isin(candidates))
    old = stored.select(BUCKET, *keys, F.struct(*rest).alias("_old"))
    fresh = new.select(BUCKET, *keys, F.struct(*rest).alias("_new"))
    same = reduce(and_, [fresh[c].eqNullSafe(old[c]) for c in (BUCKET, *keys)])
    changed = fresh.join(old, same, "left").filter("_old IS NULL OR _new > _old")
    touched = sorted(r[BUCKET] for r in changed.select(fresh[BUCKET]).distinct().collect())
    if touched:
        rows = stored.filter(F.col(BUCKET).isin(touched)).unionByName(new.filter(F.col(BUCKET).isin(touched)))
        # The folders that are read are the ones replaced, so the merged rows are written elsewhere first.
        _write(cut_lineage(newest_per_key(rows.drop(BUCKET), keys, seq)), path, keys, buckets, "dynamic")
    return touched
