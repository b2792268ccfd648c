"""The raw-CSV ETL on a hand-made fixture holding the trap rows."""

import csv
import os
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from kestrel.plans import etl, marts
from kestrel.plans.kpis import on_time_rate, last_full_month
from kestrel.sources.raw import RAW_FILES, raw_path

PREFIX = "pub_"  # publisher prefix on the raw file names


def _write(d, name, rows):
    cols = RAW_FILES[name][1]
    with open(raw_path(d, name, PREFIX), "w", newline="", encoding="utf-8") as fh:
        w = csv.writer(fh, quoting=csv.QUOTE_MINIMAL)
        w.writerow(cols if name != "products" else
                   ["product_id", "product_category_name", "product_weight_g", "product_length_cm",
                    "product_height_cm", "product_width_cm"])
        w.writerows(rows)


@pytest.fixture(scope="module")
def raw_dir(tmp_path_factory):
    d = str(tmp_path_factory.mktemp("raw"))
    _write(d, "customers", [
        ["c1", "u1", "1037", "  santa bárbara d'oeste ", "sp"],
        ["c2", "u2", "01037", "mogi-guacu", "RJ"],
        ["c3", "u1", "123456", "", ""],
        ["c1", "u9", "99999", "other", "MG"],          # duplicate key: the first row wins
    ])
    _write(d, "sellers", [["s1", "1037", "sao paulo", "SP"], ["s2", "20000", "rio", "rj"]])
    _write(d, "products", [
        ["p1", "a", "1", "1", "1", "1"], ["p2", "a", "", "", "", ""], ["p9", "a", "3", "3", "3", "3"],
        ["p3", "", "5", "5", "5", "5"], ["p4", "", "", "", "", ""],
        ["p5", "b", "", "", "", ""], ["p6", "b", "", "", "", ""],
        ["p7", "c", "10", "10", "10", "10"], ["p8", "c", "20", "20", "20", "20"],
        ["p1", "c", "99", "99", "99", "99"],            # duplicate key, imputed before the dedupe
    ])
    _write(d, "category_translation", [["a", "alpha"], ["b", "beta"], ["c", "gamma"]])
    _write(d, "geolocation", [
        ["1037", "1.0", "10.0", "b city", "sp"], ["01037", "2.0", "20.0", "a city", "sp"],
        ["22222", "5.0", "5.0", "", ""],
    ])
    _write(d, "orders", [
        ["o1", "c1", "delivered", "2018-01-01 23:00:00", "", "", "2018-01-02 01:00:00", "2018-01-10 00:00:00"],
        ["o2", "c1", "delivered", "2018-01-02 06:00:00", "", "", "2018-01-02 00:00:00", "2018-01-10 00:00:00"],
        ["o3", "c2", "shipped", "2018-02-01 10:00:00", "", "", "", "2018-02-20 00:00:00"],
        ["o4", "c2", "delivered", "2018-02-03 00:00:00", "", "", "2018-03-10 00:00:00", "2018-03-01 00:00:00"],
        ["o5", "c2", "delivered", "2018-03-05 00:00:00", "", "", "2018-03-06 00:00:00", "2018-03-20 00:00:00"],
        ["o6", "cX", "delivered", "2018-03-05 00:00:00", "", "", "2018-03-06 00:00:00", "2018-03-20 00:00:00"],
        ["o7", "c1", "created", "not a date", "", "", "2018-01-01", "2018-01-10 00:00:00"],
    ])
    _write(d, "order_items", [
        ["o1", "1", "p1", "s1", "2018-01-03 00:00:00", "10.00", "2.00"],
        ["o1", "1", "p2", "s1", "2018-01-03 00:00:00", "99.00", "9.00"],   # duplicate key
        ["o2", "1", "p2", "s1", "2018-01-03 00:00:00", "2.345", "0.005"],
        ["o4", "1", "p3", "s2", "2018-02-05 00:00:00", "100.00", "10.00"],
        ["o4", "2", "p3", "s2", "2018-02-05 00:00:00", "100.00", "10.00"],
        ["o4", "3", "p3", "s2", "2018-02-05 00:00:00", "100.00", "10.00"],
        ["o5", "1", "p5", "s2", "2018-03-06 00:00:00", "50.00", "5.00"],
        ["o6", "1", "p1", "s1", "2018-03-06 00:00:00", "1.00", "1.00"],     # order dropped by FK
        ["oZ", "1", "p1", "s1", "2018-03-06 00:00:00", "1.00", "1.00"],     # unknown order
        ["o1", "2", "pZ", "s1", "2018-03-06 00:00:00", "1.00", "1.00"],     # unknown product
    ])
    _write(d, "order_payments", [
        ["o1", "1", "credit_card", "1", "12.00"], ["o2", "1", "boleto", "1", "2.35"],
        ["o4", "1", "credit_card", "3", "330.00"], ["o5", "1", "", "1", "55.00"], ["o6", "1", "voucher", "1", "2"],
    ])
    _write(d, "order_reviews", [
        ["r1", "o1", "5", "", "great, \"really\"\nsecond line", "2018-01-05 00:00:00", "2018-01-06 00:00:00"],
        ["r2", "o1", "4", "", "", "2018-01-05 00:00:00", "2018-01-06 00:00:00"],
        ["r3", "o2", "5", "", "", "2018-01-05 00:00:00", ""],
        ["r3", "o4", "1", "", "", "2018-03-12 00:00:00", ""],
        ["r9", "o6", "3", "", "", "2018-03-12 00:00:00", ""],
    ])
    return d


@pytest.fixture(scope="module")
def tables(spark, raw_dir):
    return {k: v.cache() for k, v in etl.build_all(spark, raw_dir, PREFIX).items()}


def _by(df, key):
    return {r[key]: r for r in df.collect()}


def test_customers_cleaned_and_first_row_kept(tables):
    c = _by(tables["customers"], "customer_id")
    assert set(c) == {"c1", "c2", "c3"}
    assert c["c1"]["customer_unique_id"] == "u1"
    assert (c["c1"]["city"], c["c1"]["state"], c["c1"]["zip_code_prefix"]) == ("Santa Bárbara D'Oeste", "SP", "01037")
    assert c["c2"]["city"] == "Mogi-Guacu"
    assert c["c3"]["zip_code_prefix"] == "123456" and c["c3"]["city"] is None and c["c3"]["state"] is None


def test_products_two_level_median(tables):
    p = _by(tables["products"], "product_id")
    w = {k: v["product_weight_g"] for k, v in p.items()}
    # group a: median(1, 3) = 2; NULL-category rows lose their 5 and, with
    # all-NULL group b, get the global median of [1, 2, 3, 10, 20, 99] = 6.5 -> 7.
    assert (w["p2"], w["p9"]) == (2, 3)
    assert w["p3"] == w["p4"] == w["p5"] == w["p6"] == 7
    assert p["p1"]["category_name_en"] == "alpha" and w["p1"] == 1
    assert p["p3"]["category_name_en"] is None


def test_geolocation_rollup(tables):
    g = _by(tables["geolocation"], "zip_code_prefix")
    assert set(g) == {"01037", "22222"}
    assert g["01037"]["lat"] == Decimal("1.500000") and g["01037"]["lng"] == Decimal("15.000000")
    assert g["01037"]["city"] == "A City" and g["01037"]["state"] == "SP"
    assert g["22222"]["city"] is None


def test_orders_derived_columns(tables):
    o = _by(tables["orders"], "order_id")
    assert set(o) == {"o1", "o2", "o3", "o4", "o5", "o7"}  # o6 has no customer
    assert o["o1"]["delivery_days"] == 0 and o["o2"]["delivery_days"] == -1
    assert o["o3"]["delivery_days"] is None and o["o3"]["is_late"] is False
    assert o["o4"]["is_late"] is True and o["o4"]["delivery_days"] == 35
    assert o["o7"]["order_purchase_timestamp"] is None
    assert o["o7"]["order_delivered_customer_date"] is None
    assert o["o1"]["order_purchase_timestamp"] == datetime(2018, 1, 1, 23, 0)


def test_items_fk_cascade_and_dedupe(tables):
    items = tables["order_items"].collect()
    keys = sorted((r["order_id"], r["order_item_id"]) for r in items)
    assert keys == [("o1", 1), ("o2", 1), ("o4", 1), ("o4", 2), ("o4", 3), ("o5", 1)]
    o1 = [r for r in items if r["order_id"] == "o1"][0]
    assert o1["price"] == Decimal("10.00")
    o2 = [r for r in items if r["order_id"] == "o2"][0]
    assert (o2["price"], o2["freight_value"]) == (Decimal("2.35"), Decimal("0.01"))


def test_reviews_free_text_and_fk(tables):
    r = tables["order_reviews"].collect()
    assert sorted((x["review_id"], x["order_id"]) for x in r) == [("r1", "o1"), ("r2", "o1"), ("r3", "o2"), ("r3", "o4")]
    r1 = [x for x in r if x["review_id"] == "r1"][0]
    assert r1["review_comment_message"] == 'great, "really"\nsecond line'
    assert sorted(x["order_id"] for x in tables["order_payments"].collect()) == ["o1", "o2", "o4", "o5"]


def test_marts_on_clean_tables(spark, tables):
    m = etl.CleanModel(tables)
    st = _by(marts.state_performance(m), "state")
    # RJ: o4 (late, 3 items) and o5 (on time, 1 item): item-weighted on-time 25%.
    assert st["RJ"]["orders"] == 2 and st["RJ"]["on_time_pct"] == 25.0
    assert st["RJ"]["revenue_brl"] == Decimal("385.00")
    assert st["RJ"]["avg_delivery_days"] == 26.5  # (35*3 + 1) / 4 = 26.5
    cat = _by(marts.revenue_by_category(m), "category")
    # o1 has two reviews, so its item counts twice (fan-out kept).
    assert cat["alpha"]["items_sold"] == 3
    assert cat["alpha"]["revenue_brl"] == Decimal("26.36")
    assert cat["alpha"]["avg_review_score"] == 4.67  # (5 + 4 + 5) / 3
    month = _by(marts.revenue_by_month(m), "month")
    assert sum(r["revenue_brl"] for r in month.values()) == Decimal("399.36")
    # Order-weighted on-time: o4 late among 6 orders (undelivered count as on time).
    assert abs(on_time_rate(m).collect()[0]["on_time_pct"] - 500 / 6) < 1e-9


def test_last_full_month_edges(spark, tables):
    m = etl.CleanModel(tables)
    r = last_full_month(m).collect()  # months 2018-01, 02, 03: last full is February vs January
    assert len(r) == 1 and r[0]["month"] == "2018-02-01"
    assert abs(r[0]["delta_pct"] - (330.0 - 14.36) / 14.36 * 100) < 1e-9


def test_run_etl_validates_and_registers(spark, raw_dir, tmpdir_path):
    report = _by(etl.run_etl(spark, raw_dir, os.path.join(tmpdir_path, "clean"), PREFIX), "table_name")
    assert {k: v["status"] for k, v in report.items()} == {k: "OK" for k in etl.LOAD_ORDER}
    assert spark.sql("SELECT COUNT(*) AS n FROM mart_state_performance").collect()[0]["n"] == 2
    assert spark.table("orders").filter(F.col("order_id") == "o6").count() == 0


def test_month_edges_one_and_two_months(spark, tables):
    # Keep only orders of the first month, then of the first two months.
    for last_day, expect_na in (("2018-02-01", True), ("2018-03-01", True)):
        t = dict(tables)
        t["orders"] = tables["orders"].filter(F.col("order_purchase_timestamp") < F.lit(last_day).cast("timestamp_ntz"))
        r = last_full_month(etl.CleanModel(t)).collect()
        assert [(x["month"], x["revenue"], x["delta_pct"]) for x in r] == [("n/a", 0.0, 0.0)]


def test_null_revenue_sorts_first_and_null_category_kept(spark, tables):
    from kestrel.plans import business
    t = dict(tables)
    # Category 'beta' (p5) gets only NULL prices; the NULL category keeps its group.
    t["order_items"] = tables["order_items"].withColumn(
        "price", F.when(F.col("product_id") == "p5", F.lit(None)).otherwise(F.col("price")))
    got = [(r["category_name_en"], r["revenue_brl"]) for r in business.top_categories_raw(etl.CleanModel(t), 5).collect()]
    assert got[0] == ("beta", None)
    assert (None, Decimal("330.00")) in got


def test_report_joins_orders_with_their_items_once(spark, raw_dir):
    tables = etl.build_all(spark, raw_dir, PREFIX)
    m = etl.ReportModel(tables)
    orders = m.orders(with_items_only=True)
    assert m.orders(with_items_only=True) is orders
    assert all("report-orders" in f for f in orders.inputFiles()) and orders.inputFiles()
    key = ["order_id", "n_items", "items_revenue_cents", "is_late", "purchased_at"]
    plain = etl.CleanModel(tables).orders(with_items_only=True)
    assert sorted(map(tuple, orders.select(key).collect()), key=repr) == sorted(map(tuple, plain.select(key).collect()), key=repr)


def test_file_rank_orders_as_paths():
    from kestrel.sources.raw import file_rank
    parts = [f"file:///d/part-{k:05d}-ab-c000.csv.gz" for k in (0, 7, 123)]
    assert file_rank(parts) == "substring(_metadata.file_name, 8, 3)"
    assert file_rank(parts[:1]) == "substring(_metadata.file_name, 26, 0)"
    for odd in ([], ["file:///d/a.csv", "file:///d/ab.csv"], ["file:///d/a.csv", "file:///e/b.csv"], ["file:///d/a%20b.csv"]):
        assert file_rank(odd) == "_metadata.file_path"


def _driver_dir(spark, d):
    spark.range(40).selectExpr("id AS c_custkey", "id % 3 AS c_nationkey", "concat('Name ', id) AS c_name", "id / 4 AS c_acctbal",
                               "'AUTO' AS c_mktsegment").write.parquet(f"{d}/customer.parquet")
    spark.range(4).selectExpr("id AS s_suppkey", "id AS s_nationkey", "concat('S ', id) AS s_name").write.parquet(f"{d}/supplier.parquet")
    spark.range(30).selectExpr("id AS p_partkey", "concat('part ', id) AS p_name", "IF(id % 4 = 0, 'PROMO', 'SMALL') AS p_type",
                               "CAST(id % 9 AS INT) AS p_size").write.parquet(f"{d}/part.parquet")
    spark.range(200).selectExpr("id AS o_orderkey", "id % 50 AS o_custkey", "'F' AS o_orderstatus",
                                "TIMESTAMP'2020-01-01 00:00:00' + make_interval(0, 0, 0, CAST(id AS INT)) AS o_orderdate").write.parquet(f"{d}/orders.parquet")
    spark.range(900).selectExpr("id * 7 % 210 AS l_orderkey", "CAST(id % 4 AS INT) AS l_linenumber", "id % 33 AS l_partkey", "id % 5 AS l_suppkey",
                                "id + 0.25D AS l_extendedprice", "0.1D AS l_tax", "TIMESTAMP'2020-02-01 00:00:00' AS l_shipdate",
                                ).repartition(6).write.parquet(f"{d}/lineitem.parquet")
    spark.range(60).selectExpr("id AS event_id", "id * 4 AS user_id", "'view' AS event_type", "id + 0.5D AS value",
                               "TIMESTAMP'2020-03-01 00:00:00' AS ts", "concat('{\"k\": ', id, '}') AS props").write.parquet(f"{d}/events.parquet")


def test_raw_files_are_packed_and_give_all_rows(spark, tmpdir_path):
    from kestrel.sources.raw import read_raw
    from kestrel.sources.raw_model import raw_frames, write_raw
    _driver_dir(spark, tmpdir_path)
    raw = write_raw(spark, tmpdir_path, os.path.join(tmpdir_path, "raw"))
    for name, want in raw_frames(spark, tmpdir_path).items():
        parts = [f for f in os.listdir(raw_path(raw, name)) if f.startswith("part-")]
        assert parts and all(f.endswith(".gz") for f in parts)
        assert read_raw(spark, raw, name).count() == want.count()


def test_etl_leaves_no_staged_tables_nor_shuffles(spark, tmpdir_path):
    from kestrel.session import scratch_path
    _driver_dir(spark, tmpdir_path)
    got = _by(etl.etl_full(spark, tmpdir_path), "table_name")
    assert {got[n]["status"] for n in etl.LOAD_ORDER} == {"OK"}
    items = [r for r in spark.read.parquet(f"{tmpdir_path}/lineitem.parquet").collect()]
    keys = {(r["l_orderkey"], r["l_linenumber"]) for r in items}
    assert 0 < got["order_items"]["actual"] < len(keys)
    left = os.listdir(scratch_path(spark, "").removeprefix("file:"))
    assert not [x for x in left if x.startswith("order_items-")]


def test_items_are_shuffled_for_one_key_at_a_time(spark, raw_dir, tmpdir_path, monkeypatch):
    """Each foreign key of a table with several meets rows that were written, not the plan of the dedupe before."""
    seen = []
    plain = etl.semi_filter
    monkeypatch.setattr(etl, "semi_filter", lambda child, *a: seen.append((a[0], child.inputFiles())) or plain(child, *a))
    etl.run_etl(spark, raw_dir, os.path.join(tmpdir_path, "clean"), PREFIX, register_views=False)
    of_items = [files for column, files in seen if column in ("product_id", "seller_id")]
    assert len(of_items) == 2 and all(files and all("/order_items-" in f for f in files) for files in of_items)


def test_only_scratch_is_removed(spark, tmpdir_path):
    from kestrel.session import remove_scratch, scratch_path
    path = scratch_path(spark, "gone")
    spark.range(3).write.mode("overwrite").parquet(path)
    remove_scratch(spark, path)
    assert not os.path.exists(path.removeprefix("file:"))
    with pytest.raises(ValueError):
        remove_scratch(spark, tmpdir_path)
    for outside in (scratch_path(spark, ""), scratch_path(spark, "../x")):
        with pytest.raises(ValueError):
            remove_scratch(spark, outside)
