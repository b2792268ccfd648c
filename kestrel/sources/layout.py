"""Production layout: fact tables bucketed on the order key.

At scale the dominant shuffle is line items -> one row per order, joined to
orders. Writing ``lineitem`` and ``orders`` bucketed (and sorted) by the order
key with the same bucket count makes both the per-order aggregation and the
order join shuffle-free: each task reads one bucket of each table. Dimension
tables are written plainly; events and conversations are bucketed on the key
their jobs group by (user, conversation).

The tables go to the session catalog (``saveAsTable`` under
``spark.sql.warehouse.dir``; on a cluster a shared warehouse with a metastore).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kestrel.sources.tables import TABLES, read_table

# Fixed layout: table -> bucketing column (None: plain table).
BUCKET_KEYS = {
    "lineitem": "l_orderkey",
    "orders": "o_orderkey",
    "events": "user_id",
    "conversations": "conv_id",
}


def write_layout(spark: SparkSession, sf_dir: str, database: str, buckets: int,
                 tables=TABLES, path_root: str | None = None) -> None:
    """Copy the driver tables into ``database`` with the bucketed layout.

    ``path_root`` places the files under a given shared folder (external
    tables); by default they go to the warehouse."""
    if path_root:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {database} LOCATION '{path_root}/_db'")
    else:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name in tables:
        df = read_table(spark, sf_dir, name)
        w = df.write.mode("overwrite").format("parquet")
        if path_root:
            w = w.option("path", f"{path_root}/{name}")
        key = BUCKET_KEYS.get(name)
        if key:
            w = w.bucketBy(buckets, key).sortBy(key)
        w.saveAsTable(f"{database}.{name}")


class CatalogTables:
    """Same attribute interface as ``Tables``, reading catalog tables."""

    def __init__(self, spark: SparkSession, database: str):
        self.spark = spark
        self.database = database

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.table(f"{self.database}.{name}")
        raise AttributeError(name)
