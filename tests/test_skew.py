"""Hot keys: one order holds a third of all items, one customer a third of the
orders. The pre-aggregated marts must equal a brute-force evaluation of the
literal item-level definitions (pandas, joins with fan-out)."""

from datetime import datetime, timedelta
from decimal import Decimal

import pandas as pd
import pytest

from kestrel.operators.dedupe import keep_first
from kestrel.operators.logs import build_prompts, cache_effectiveness
from kestrel.plans import marts
from kestrel.plans.etl import CleanModel


@pytest.fixture(scope="module")
def hot(spark):
    t0 = datetime(2018, 1, 1)
    orders, items, reviews = [], [], []
    for o in range(60):
        cust = "hot" if o < 20 else f"c{o % 7}"
        delivered = t0 + timedelta(days=o % 40, hours=o % 5) if o % 9 else None
        orders.append((f"o{o}", cust, t0 + timedelta(days=o), delivered, t0 + timedelta(days=o + 30)))
    for i in range(180):
        oid = "o0" if i < 60 else f"o{i % 60}"
        items.append((oid, i, f"p{i % 4}", f"s{i % 3}", Decimal(f"{10 + i % 17}.{i % 100:02d}"),
                      Decimal(f"{i % 5}.{(i * 7) % 100:02d}")))
    for r in range(90):
        reviews.append((f"r{r}", "o0" if r < 30 else f"o{r % 60}", (r % 5) + 1 if r % 11 else None))
    customers = [("hot", "hot", "SP")] + [(f"c{k}", f"u{k % 3}", "RJ" if k % 2 else "MG") for k in range(7)]
    products = [(f"p{k}", None if k == 3 else f"cat{k % 2}") for k in range(4)]
    S = spark.createDataFrame
    tables = {
        "orders": S(orders, "order_id string, customer_id string, order_purchase_timestamp timestamp_ntz, "
                            "order_delivered_customer_date timestamp_ntz, order_estimated_delivery_date timestamp_ntz"),
        "order_items": S(items, "order_id string, order_item_id int, product_id string, seller_id string, "
                                "price decimal(10,2), freight_value decimal(10,2)"),
        "order_reviews": S(reviews, "review_id string, order_id string, review_score int"),
        "customers": S(customers, "customer_id string, customer_unique_id string, state string"),
        "products": S(products, "product_id string, category_name_en string"),
    }
    from kestrel.functions import metrics as M
    o = tables["orders"]
    tables["orders"] = o.withColumn("delivery_days", M.delivery_days("order_purchase_timestamp",
                                                                      "order_delivered_customer_date")) \
                        .withColumn("is_late", M.is_late("order_delivered_customer_date", "order_estimated_delivery_date"))
    tables["order_items"] = tables["order_items"].withColumn("shipping_limit_date", F_ts(spark))
    return tables, {k: v.toPandas() for k, v in tables.items()}


def F_ts(spark):
    from pyspark.sql import functions as F
    return F.lit(None).cast("timestamp_ntz")


def _round_half_up(x, digits):
    q = Decimal(1).scaleb(-digits)
    return float(Decimal(x).quantize(q, rounding="ROUND_HALF_UP"))


def test_state_mart_equals_item_level(hot):
    tables, pdf = hot
    got = {r["state"]: r for r in marts.state_performance(CleanModel(tables)).collect()}
    j = pdf["orders"].merge(pdf["customers"], on="customer_id").merge(pdf["order_items"], on="order_id")
    for state, g in j.groupby("state"):
        rev = sum(g["price"] + g["freight_value"])
        assert got[state]["revenue_brl"] == rev
        assert got[state]["orders"] == g["order_id"].nunique()
        on_time = 100 * Decimal(int((~g["is_late"]).sum())) / Decimal(len(g))
        assert got[state]["on_time_pct"] == _round_half_up(on_time, 2)
        days = g["delivery_days"].dropna()
        want = None if days.empty else _round_half_up(Decimal(int(days.sum())) / Decimal(len(days)), 1)
        assert got[state]["avg_delivery_days"] == want


def test_category_mart_keeps_review_fan_out(hot):
    tables, pdf = hot
    got = {r["category"]: r for r in marts.revenue_by_category(CleanModel(tables)).collect()}
    j = pdf["order_items"].merge(pdf["products"], on="product_id").merge(pdf["order_reviews"], on="order_id", how="left")
    j["category"] = j["category_name_en"].fillna("uncategorised")
    for cat, g in j.groupby("category"):
        assert got[cat]["revenue_brl"] == sum(g["price"] + g["freight_value"])
        assert got[cat]["items_sold"] == len(g)
        scores = g["review_score"].dropna()
        assert got[cat]["avg_review_score"] == _round_half_up(Decimal(int(scores.sum())) / Decimal(len(scores)), 2)


def test_month_mart_counts_people_once(hot):
    tables, pdf = hot
    got = {str(r["month"]): r for r in marts.revenue_by_month(CleanModel(tables)).collect()}
    j = pdf["order_items"].merge(pdf["orders"], on="order_id").merge(pdf["customers"], on="customer_id")
    j["month"] = pd.to_datetime(j["order_purchase_timestamp"]).dt.to_period("M").dt.start_time.dt.date.astype(str)
    for m, g in j.groupby("month"):
        assert got[m]["revenue_brl"] == sum(g["price"] + g["freight_value"])
        assert got[m]["orders"] == g["order_id"].nunique()
        assert got[m]["unique_customers"] == g["customer_unique_id"].nunique()


def test_hot_key_operators(spark):
    rows = [("hot", i, f"v{i % 13}") for i in range(3000)] + [(f"k{i}", i, "x") for i in range(6000)]
    df = spark.createDataFrame(rows, "k string, seq long, v string")
    kept = {r["k"]: (r["seq"], r["v"]) for r in keep_first(df, ["k"], ["seq"]).collect()}
    assert kept["hot"] == (0, "v0") and len(kept) == 6001
    eff = cache_effectiveness(df.withColumnRenamed("v", "key"), "key").collect()[0]
    assert (eff["questions"], eff["misses"]) == (9000, 14)
    lines = df.filter("k = 'hot'").selectExpr("k AS s", "seq", "v AS line")
    qs = lines.filter("seq % 500 = 0").selectExpr("s", "seq", "'q' AS question")
    got = {r["seq"]: r["prompt"] for r in build_prompts(lines, qs, "s", "seq", "line", "question", 3).collect()}
    assert got[0] == "q"
    assert got[1000] == "Prior conversation:\nv9\nv10\nv11\n\nCurrent question: q"
