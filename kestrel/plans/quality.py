"""Data-quality jobs over the model tables."""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from kestrel.operators.integrity import fk_report, length_check, pk_check, profile, validate_counts
from kestrel.plans import etl
from kestrel.session import scratch_path
from kestrel.sources.raw import write_table
from kestrel.sources.tables import Tables


def profile_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rows, cols, null cells, full-row duplicates) for the fact and dimension tables."""
    t = Tables(spark, sf_dir)
    names = ["lineitem", "orders", "customer", "part", "supplier", "events"]
    return reduce(DataFrame.unionByName, [profile(getattr(t, n), n) for n in names])


def pk_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared keys: which hold, how many keys repeat, how many excess rows."""
    t = Tables(spark, sf_dir)
    checks = [
        (t.lineitem, ["l_orderkey", "l_linenumber"], "lineitem"),
        (t.orders, ["o_orderkey"], "orders"),
        (t.customer, ["c_custkey"], "customer"),
        (t.events, ["event_id"], "events"),
        (t.conversations, ["conv_id", "turn"], "conversations"),
    ]
    return reduce(DataFrame.unionByName, [pk_check(df, k, n) for df, k, n in checks])


# Limits of the stand-in texts, per table: raw columns, before any cleaning cuts them.
LENGTH_LIMITS = {
    "customer": {"c_name": 12, "c_mktsegment": 9}, "supplier": {"s_name": 10}, "nation": {"n_name": 8, "state": 2},
    "part": {"p_name": 12, "p_type": 6, "p_brand": 8}, "orders": {"o_orderstatus": 1, "o_orderpriority": 6},
    "lineitem": {"l_returnflag": 1, "l_linestatus": 1}, "events": {"event_type": 5},
}


def length_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose text is longer than its declared length, for every text column, on the raw text."""
    t = Tables(spark, sf_dir)
    raw = {n: getattr(t, n) for n in LENGTH_LIMITS} | {"nation": t.nation.selectExpr("n_name", "n_name AS state")}
    return reduce(DataFrame.unionByName, [length_check(raw[n], limits, n) for n, limits in LENGTH_LIMITS.items()])


def fk_report_driver(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fk_report(etl.fk_tables_driver(spark, sf_dir))


def load_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the cleaned tables to the shared scratch folder, read back, compare counts.

    The expected count of each table is observed while it is written
    (``DataFrame.observe``), so every table is computed once."""
    builders = {
        "customers": etl.clean_customers_driver, "sellers": etl.clean_sellers_driver,
        "orders": etl.clean_orders_driver, "order_items": etl.clean_items_driver,
        "order_payments": etl.clean_payments_driver, "order_reviews": etl.clean_reviews_driver,
    }
    root = scratch_path(spark, f"load-{uuid.uuid4().hex[:12]}")
    tables = {name: build(spark, sf_dir) for name, build in builders.items()}
    return write_and_validate(spark, tables, root)


def write_tables(tables: dict[str, DataFrame], root: str, parallel: int = 4) -> dict[str, int]:
    """Write independent tables, observing their row counts.

    The write jobs are submitted from a few driver threads at once and the
    scheduler overlaps them."""
    def load(item):
        name, df = item
        obs = Observation(f"rows_{name}")
        write_table(df.observe(obs, F.count(F.lit(1)).alias("rows")), f"{root}/{name}")
        return name, int(obs.get["rows"])

    with ThreadPoolExecutor(max_workers=max(1, min(parallel, len(tables)))) as pool:
        return dict(pool.map(load, tables.items()))


def load_report(spark: SparkSession, expected: dict[str, int], loaded: dict[str, DataFrame]) -> DataFrame:
    """table_name, expected, actual, status of written tables."""
    actual = [df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
              for name, df in loaded.items()]
    exp_df = spark.createDataFrame(list(expected.items()), "table_name string, row_count long")
    return validate_counts(spark, exp_df, reduce(DataFrame.unionByName, actual))


def write_and_validate(spark: SparkSession, tables: dict[str, DataFrame], root: str) -> DataFrame:
    """Write each table, read it back, report OK/MISMATCH."""
    expected = write_tables(tables, root)
    return load_report(spark, expected, {n: spark.read.schema(df.schema).parquet(f"{root}/{n}") for n, df in tables.items()})
