"""Physical-plan properties the scale design relies on."""

from pyspark.sql import functions as F

from kestrel.operators.dedupe import keep_first
from kestrel.operators.logs import last_n_lines
from kestrel.plans import business, marts
from kestrel.sources.model import Commerce

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_reads_only_needed_columns(spark):
    p = plan(marts.revenue_by_month(Commerce(spark, SF)))
    assert "ReadSchema: struct<l_orderkey:bigint,l_extendedprice:double,l_tax:double>" in p
    assert "l_quantity" not in p and "l_discount" not in p


def test_year_filter_reaches_the_scan(spark):
    p = plan(business.orders_in_year(Commerce(spark, SF), 1998))
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate," in p
    assert "LessThan(o_orderdate," in p


def test_order_facts_combine_before_the_shuffle(spark):
    p = plan(Commerce(spark, SF).order_facts())
    assert p.index("partial_sum") > p.index("Exchange hashpartitioning(order_id")


def test_keep_first_combines_map_side(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c")], "k int, v string")
    p = plan(keep_first(df, ["k"]))
    assert "partial_min" in p
    assert sorted(keep_first(df, ["k"]).collect()) == [(1, "a"), (2, "c")]


def test_last_n_is_trimmed_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("s"), F.col("id").alias("seq"), F.lit("x").alias("line"))
    p = plan(last_n_lines(df, "s", "seq", 4))
    assert "WindowGroupLimit" in p and "Partial" in p
    assert last_n_lines(df, "s", "seq", 4).count() == 12


def test_marts_join_customers_after_reducing_orders(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = plan(marts.state_performance(Commerce(spark, SF)))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(10 * 1024 * 1024))
    # The customer join consumes the per-customer aggregate, not per-order rows.
    join_at = p.index("SortMergeJoin [customer_id")
    assert "HashAggregate(keys=[customer_id" in p[join_at:]
