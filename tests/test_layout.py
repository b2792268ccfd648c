"""Bucketed layout: same answers, and the order-level join needs no shuffle."""

from kestrel.plans import marts
from kestrel.sources.layout import CatalogTables, write_layout
from kestrel.sources.model import Commerce

SF = "/root/testdata/sf0.001"


def test_bucketed_layout_is_shuffle_free_and_equal(spark, tmpdir_path):
    write_layout(spark, SF, "kestrel_layout_test", 4,
                 tables=["lineitem", "orders", "customer", "nation"], path_root=tmpdir_path)
    bucketed = Commerce(spark, SF, tables=CatalogTables(spark, "kestrel_layout_test"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = bucketed.orders(with_items_only=True)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    got = sorted(marts.state_performance(bucketed).collect())
    want = sorted(marts.state_performance(Commerce(spark, SF)).collect())
    assert got == want
