"""Marts refreshed by daily loads against full recomputation."""

import os

import pytest
from pyspark.sql import functions as F

from kestrel.plans import mart_refresh as R
from kestrel.plans import marts
from kestrel.plans.etl import CleanModel


def _model(spark, reviews):
    orders = [("o1", "c1", "2024-01-01 10:00:00", 3, False), ("o2", "c2", "2024-01-01 23:59:59", None, False),
              ("o3", "c3", "2024-01-02 00:00:00", 9, True), ("o4", "c1", "2024-02-02 08:00:00", -1, False),
              ("o5", "c2", None, 4, True), ("empty", "c4", "2024-01-02 01:00:00", None, False)]
    t = {"orders": spark.createDataFrame(orders, "order_id string, customer_id string, ts string, delivery_days int, is_late boolean")
         .withColumn("order_purchase_timestamp", F.col("ts").cast("timestamp")).drop("ts"),
         "customers": spark.createDataFrame([("c1", "p1", "SP"), ("c2", "p1", "RJ"), ("c3", "p3", "SP"), ("c4", "p4", None)],
                                            "customer_id string, customer_unique_id string, state string"),
         "products": spark.createDataFrame([("a", "toys"), ("b", None)], "product_id string, category_name_en string"),
         "order_items": spark.createDataFrame(
             [("o1", "a", 10.5, 1.0), ("o1", "a", 10.5, 1.0), ("o1", "b", 2.0, 0.0), ("o2", "a", 7.25, 0.5), ("o3", "b", 100.0, 9.99),
              ("o4", "b", 1.0, 1.0), ("o5", "a", 3.0, 0.25)], "order_id string, product_id string, price double, freight_value double")
         .withColumns({c: F.col(c).cast("decimal(10,2)") for c in ("price", "freight_value")})
         .withColumn("shipping_limit_date", F.lit(None).cast("timestamp")),
         "order_reviews": spark.createDataFrame(reviews, "order_id string, review_score int")}
    return CleanModel(t)


REVIEWS = [("o1", 5), ("o1", 2), ("o3", None), ("o5", 1)]


def _rows(found):
    return {k: sorted(map(repr, df.collect())) for k, df in found.items()}


def _full(c):
    return _rows({"month": marts.revenue_by_month(c), "category": marts.revenue_by_category(c), "state": marts.state_performance(c)})


@pytest.fixture()
def loaded(spark, tmpdir_path):
    c = _model(spark, REVIEWS)
    facts, states = f"{tmpdir_path}/facts", f"{tmpdir_path}/states"
    R.write_facts(c, facts)
    for day in ("2024-01-01", "2024-01-02", "2024-02-02", R.NO_PERIOD):
        R.load_periods(spark, facts, c, [day], states)
    return c, facts, states


def _folders(states):
    return {(n, d): sorted((f, os.stat(f"{states}/{n}/{d}/{f}").st_mtime_ns) for f in os.listdir(f"{states}/{n}/{d}"))
            for n in os.listdir(states) for d in os.listdir(f"{states}/{n}") if d.startswith(R.PERIOD)}


def test_daily_loads_equal_full_recomputation(spark, loaded):
    c, _, states = loaded
    assert _rows(R.merged_marts(spark, states)) == _full(c)


def test_a_load_reads_and_replaces_only_its_day(spark, loaded):
    c, facts, states = loaded
    for df in R.partial_states(spark, facts, c, ["2024-01-02"]).values():
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "2024-01-02" in plan.split("PartitionFilters")[1]
    before = _folders(states)
    R.load_periods(spark, facts, c, ["2024-01-02"], states)
    after = _folders(states)
    assert {k for k in before if before[k] != after[k]} == {(n, f"{R.PERIOD}=2024-01-02") for n in R.STATES}
    assert _rows(R.merged_marts(spark, states)) == _full(c)


def test_a_late_review_is_taken_in_by_its_orders_day(spark, loaded):
    _, facts, states = loaded
    late = _model(spark, [*REVIEWS, ("o3", 4), ("o3", 4)])
    R.write_facts(late, facts)
    R.load_periods(spark, facts, late, ["2024-01-02"], states)
    assert _rows(R.merged_marts(spark, states)) == _full(late)
