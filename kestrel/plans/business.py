"""Business questions (Q1-Q6) and the golden-set data questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.functions import metrics as M
from kestrel.functions.numeric import round_ratio
from kestrel.functions.time import year_range
from kestrel.operators.scalars import one_row
from kestrel.operators.topk import desc_first, top_n
from kestrel.plans import marts
from kestrel.sources.model import Commerce

# Fixed parameters of the golden questions as posed on the stand-in data.
CARD_PAYMENT_TYPE = "purchase"
GOLDEN_YEAR = 1998
GOLDEN_CATEGORY = "STANDARD"


def total_orders(c: Commerce) -> DataFrame:
    """Q1: every order, with or without items."""
    return c.orders_base().agg(F.count(F.lit(1)).alias("total_orders"))


def _revenue_per_product(c: Commerce) -> DataFrame:
    return c.order_items().groupBy("product_id").agg(F.sum("revenue_cents").alias("rev"))


def top_categories_raw(c: Commerce, n: int = 5) -> DataFrame:
    """Q2: top categories by revenue; the NULL category is kept as its own group."""
    prod = c.products().select("product_id", "category_name_en")
    per_cat = (_revenue_per_product(c).join(prod, "product_id")
               .groupBy("category_name_en").agg(F.expr(M.from_cents_sql("sum(rev)")).alias("revenue_brl")))
    return top_n(per_cat, [desc_first("revenue_brl")], n,
                 [F.col("category_name_en").asc_nulls_first()])


def late_by_state(c: Commerce, n: int = 5) -> DataFrame:
    """Q3: states with most late orders."""
    late = c.orders().filter("is_late")
    per_cust = late.groupBy("customer_id").agg(F.expr("count(1) AS n"))
    per_state = (per_cust.join(c.customers().select("customer_id", "state"), "customer_id")
                 .groupBy("state").agg(F.expr("sum(n) AS late_delivery_count")))
    return top_n(per_state, [desc_first("late_delivery_count")], n, ["state"])


def payment_totals(c: Commerce) -> DataFrame:
    """Q4: count and value per payment type, NULL type kept, no limit."""
    return (c.payments().groupBy("payment_type")
            .agg(F.count(F.lit(1)).alias("num_payments"),
                 F.round(F.sum("payment_value"), 2).alias("total_value_brl"))
            .orderBy(desc_first("total_value_brl"), F.col("payment_type").asc_nulls_first()))


def sellers_five_star(c: Commerce, n: int = 5) -> DataFrame:
    """Q5: sellers by count of 5-star review rows, item-weighted.

    A 5-star review counts once per item of its order; reviews are reduced to
    one 5-star count per order, and items to one count per order and seller,
    before they meet."""
    five = (c.review_stats().filter(F.col("n_five") > 0)
            .join(c.orders_base().select("order_id"), "order_id", "left_semi")
            .select("order_id", "n_five"))
    items = c.order_items().groupBy("order_id", "seller_id").agg(F.count(F.lit(1)).alias("n"))
    per_seller = items.join(five, "order_id").groupBy("seller_id").agg(
        F.sum(F.col("n") * F.col("n_five")).alias("five_star_count"))
    return top_n(per_seller, [desc_first("five_star_count")], n, ["seller_id"])


def top_states_revenue(c: Commerce, n: int = 5) -> DataFrame:
    """Q6: states by revenue (items of orders with a known customer)."""
    m = marts.state_performance(c).select("state", "revenue_brl")
    return top_n(m, [desc_first("revenue_brl")], n, ["state"])


# ---- golden-set data questions --------------------------------------------
def table_counts(c: Commerce) -> DataFrame:
    parts = [
        ("customers", c.customers()), ("sellers", c.sellers()), ("products", c.products()),
        ("orders", c.orders_base()), ("order_items", c.order_items()),
        ("order_payments", c.payments()), ("order_reviews", c.reviews()),
    ]
    out = None
    for name, df in parts:
        one = df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        out = one if out is None else out.unionByName(one)
    return out


def catalog_overview(c: Commerce) -> DataFrame:
    """Table names with thousands-formatted row counts, largest first."""
    return (table_counts(c)
            .select("table_name", F.format_number("row_count", 0).alias("row_count_text"), "row_count")
            .orderBy(F.col("row_count").desc(), "table_name"))


def most_common_payment(c: Commerce) -> DataFrame:
    p = c.payments().filter(F.col("payment_type").isNotNull())
    g = p.groupBy("payment_type").agg(F.count(F.lit(1)).alias("payments"))
    return top_n(g, [desc_first("payments")], 1, ["payment_type"])


def state_most_orders(c: Commerce) -> DataFrame:
    per_cust = c.orders_base().groupBy("customer_id").agg(F.expr("count(1) AS n"))
    g = (per_cust.join(c.customers().select("customer_id", "state"), "customer_id")
         .groupBy("state").agg(F.expr("sum(n) AS orders")))
    return top_n(g, [desc_first("orders")], 1, ["state"])


def max_score(c: Commerce) -> DataFrame:
    return c.reviews().agg(F.max("review_score").alias("max_review_score"))


def orders_in_year(c: Commerce, year: int = GOLDEN_YEAR) -> DataFrame:
    o = c.orders_base().filter(year_range("purchased_at", year))
    return o.agg(F.count(F.lit(1)).alias("orders")).select(F.lit(year).alias("year"), "orders")


def latest_year(c: Commerce) -> DataFrame:
    return c.orders_base().agg(F.year(F.max("purchased_at")).alias("latest_year"))


def seller_state_revenue(c: Commerce, n: int = 1) -> DataFrame:
    """Top seller state(s) by revenue of the items they sold."""
    per_seller = c.order_items().groupBy("seller_id").agg(F.sum("revenue_cents").alias("rev"))
    g = (per_seller.join(c.sellers().select("seller_id", "state"), "seller_id")
         .groupBy("state").agg(F.expr(M.from_cents_sql("sum(rev)")).alias("revenue_brl")))
    return top_n(g, [desc_first("revenue_brl")], n, ["state"])


def avg_score_with_category(c: Commerce, category: str = GOLDEN_CATEGORY) -> DataFrame:
    """Average review score over orders holding at least one item of a category.

    EXISTS semantics, so an order with many such items counts once: order ids are made
    distinct and reviews reduced to sums per order before the semi join."""
    cat_parts = c.products().filter(F.col("category_name_en") == category).select("product_id")
    cat_orders = c.order_items().select("order_id", "product_id").join(cat_parts, "product_id", "left_semi")
    r = c.review_stats().join(cat_orders.select("order_id").distinct(), "order_id", "left_semi")
    a = r.agg(F.sum("score_sum").alias("s"), F.sum("score_n").alias("n"))
    return a.select(F.lit(category).alias("category"), round_ratio("s", "n", 2).alias("avg_review_score"))


def state_most_card_payments(c: Commerce, payment_type: str = CARD_PAYMENT_TYPE) -> DataFrame:
    """State whose customers made the most payments of a type (payment rows, not orders)."""
    per_order = (c.payments().filter(F.col("payment_type") == payment_type)
                 .groupBy("order_id").agg(F.count(F.lit(1)).alias("n")))
    per_cust = (per_order.join(c.orders_base().select("order_id", "customer_id"), "order_id")
                .groupBy("customer_id").agg(F.sum("n").alias("n")))
    g = (per_cust.join(c.customers().select("customer_id", "state"), "customer_id")
         .groupBy("state").agg(F.sum("n").alias("payments")))
    return top_n(g, [desc_first("payments")], 1, ["state"])


def delivery_stats(c: Commerce) -> DataFrame:
    """NULL-delivery count, average delivery days, distinct payment types / states / customers."""
    o = c.orders().agg(F.count_if(F.col("delivery_days").isNull()).alias("null_delivery_orders"),
                       F.sum("delivery_days").alias("_s"), F.count("delivery_days").alias("_n"))
    p = c.payments().agg(F.count_distinct("payment_type").alias("payment_types"))
    cu = c.customers().agg(F.count_distinct("state").alias("states"),
                           F.count_distinct("customer_unique_id").alias("unique_customers"))
    return one_row(o, p, cu).select(
        "null_delivery_orders", round_ratio("_s", "_n", 1).alias("avg_delivery_days"),
        "payment_types", "states", "unique_customers")
