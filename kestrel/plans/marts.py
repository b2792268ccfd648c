"""The semantic layer: three aggregate marts.

Each mart is computed from per-order facts (one row per order, built by a
map-side-combined aggregation of the line items), so the item-level joins of
the original definitions never materialise: a hot order, customer or product
contributes one pre-aggregated row to each join instead of many.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.functions import metrics as M
from kestrel.functions.numeric import round_ratio_spark_sql
from kestrel.sources.model import Commerce

UNCATEGORISED = "uncategorised"


def _aggs(*sql: str):
    """Aggregate expressions as SQL text (each parsed once on the JVM)."""
    return [F.expr(x) for x in sql]


def month_people(c: Commerce, by: tuple[str, ...] = ()) -> DataFrame:
    """Revenue (cents) and orders per month and person (per ``by`` too): a partial state that merges by adding.

    Orders are first reduced to (month, customer) rows, so the customer join
    sees one row per customer-month however many orders a customer placed.
    """
    o = c.orders(with_items_only=True).filter("purchased_at IS NOT NULL")
    per_cust_month = (o.groupBy(*by, F.expr(f"{M.month_start_sql('purchased_at')} AS month"), F.col("customer_id"))
                       .agg(*_aggs("sum(items_revenue_cents) AS rev", "count(1) AS n_orders")))
    cust = c.customers().select("customer_id", "customer_unique_id")
    # Distinct customers per month as a second grouping level (one row per
    # month and person), instead of an Expand-based distinct aggregate.
    return (per_cust_month.join(cust, "customer_id")
            .groupBy(*by, "month", "customer_unique_id")
            .agg(*_aggs("sum(rev) AS rev", "sum(n_orders) AS n_orders")))


def month_mart(people: DataFrame) -> DataFrame:
    """month, revenue_brl, orders, unique_customers of (month, person) rows."""
    return (people.groupBy("month")
            .agg(*_aggs(f"{M.from_cents_sql('sum(rev)')} AS revenue_brl", "sum(n_orders) AS orders",
                        "count(customer_unique_id) AS unique_customers")))


def revenue_by_month(c: Commerce) -> DataFrame:
    """month, revenue_brl, orders, unique_customers (orders with items and a known customer)."""
    return month_mart(month_people(c))


def _item_review_weights(c: Commerce, by: tuple[str, ...] = ()) -> DataFrame:
    """Items with the multiplicity the item-to-review LEFT JOIN gives them.

    An order with k reviews repeats each of its items k times (at least once),
    so revenue and counts are weighted by k, and score sums are per item. Items
    are first reduced to one row per order and product, so a hot order meets
    the join with as many rows as it has products.
    """
    rs = c.review_stats().select("order_id", "n_reviews", "score_sum", "score_n")
    items = c.order_items().groupBy(*by, "order_id", "product_id").agg(
        *_aggs("sum(revenue_cents) AS cents", "count(1) AS n"))
    w = "greatest(coalesce(n_reviews, 0), 1)"
    return (items.join(rs, "order_id", "left")
                 .selectExpr(*by, "product_id", f"cents * {w} AS w_revenue", f"n * {w} AS w_items",
                             "n * coalesce(score_sum, 0) AS score_sum", "n * coalesce(score_n, 0) AS score_n"))


def category_sums(c: Commerce, by: tuple[str, ...] = ()) -> DataFrame:
    """Revenue (cents), items, score sum and count per category (per ``by`` too), review fan-out kept."""
    per_product = (_item_review_weights(c, by).groupBy(*by, "product_id")
                   .agg(*_aggs("sum(w_revenue) AS rev", "sum(w_items) AS items",
                               "sum(score_sum) AS ssum", "sum(score_n) AS sn")))
    prod = c.products().select("product_id", "category_name_en")
    return (per_product.join(prod, "product_id")
            .groupBy(*by, F.expr(f"coalesce(category_name_en, '{UNCATEGORISED}') AS category"))
            .agg(*_aggs("sum(rev) AS rev", "sum(items) AS items", "sum(ssum) AS ssum", "sum(sn) AS sn")))


def category_mart(sums: DataFrame) -> DataFrame:
    """category, revenue_brl, items_sold, avg_review_score of one row per category."""
    return sums.selectExpr("category", f"{M.from_cents_sql('rev')} AS revenue_brl", "items AS items_sold",
                           f"{round_ratio_spark_sql('ssum', 'sn', 2)} AS avg_review_score")


def revenue_by_category(c: Commerce) -> DataFrame:
    """category, revenue_brl, items_sold, avg_review_score (review fan-out kept)."""
    return category_mart(category_sums(c))


STATE_SUMS = ("orders", "rev", "on_time_items", "rated_items", "day_sum", "day_items")


def state_sums(c: Commerce, by: tuple[str, ...] = ()) -> DataFrame:
    """The sums behind :func:`state_mart` per state (per ``by`` too).

    Orders are reduced to one row per customer before the customer join, so a
    customer holding a third of all orders is still one row on each side.
    """
    o = c.orders(with_items_only=True)
    per_cust = (o.groupBy(*by, "customer_id")
                .agg(*_aggs("count(1) AS orders", "sum(items_revenue_cents) AS rev",
                            "sum(CASE WHEN NOT is_late THEN n_items ELSE 0 END) AS on_time_items",
                            "sum(n_items) AS rated_items",
                            "sum(n_items * delivery_days) AS day_sum",
                            "sum(CASE WHEN delivery_days IS NOT NULL THEN n_items END) AS day_items")))
    cust = c.customers().select("customer_id", "state")
    return (per_cust.join(cust, "customer_id")
            .groupBy(*by, "state").agg(*_aggs(*[f"sum({x}) AS {x}" for x in STATE_SUMS])))


def state_mart(sums: DataFrame) -> DataFrame:
    """state, orders, revenue_brl, on_time_pct, avg_delivery_days of one row per state."""
    return (sums.selectExpr(
                "state", "orders", f"{M.from_cents_sql('rev')} AS revenue_brl",
                f"{round_ratio_spark_sql('on_time_items * 100', 'rated_items', 2)} AS on_time_pct",
                f"{round_ratio_spark_sql('day_sum', 'day_items', 1)} AS avg_delivery_days")
            .orderBy(F.col("revenue_brl").desc_nulls_first(), F.col("state")))


def state_performance(c: Commerce) -> DataFrame:
    """state, orders, revenue_brl, on_time_pct, avg_delivery_days (item-weighted)."""
    return state_mart(state_sums(c))


def register_marts(c: Commerce) -> None:
    """Expose the marts as temp views next to the model tables."""
    revenue_by_month(c).createOrReplaceTempView("mart_revenue_by_month")
    revenue_by_category(c).createOrReplaceTempView("mart_revenue_by_category")
    state_performance(c).createOrReplaceTempView("mart_state_performance")


def materialize_marts(c, out_dir: str) -> dict:
    """Write the three marts as Parquet (a materialised semantic layer) and
    return them read back, registered as views. Refreshing is rerunning this
    on the caller's schedule; readers see the last completed write."""
    from kestrel.sources.raw import write_table
    spark = c.spark if hasattr(c, "spark") else None
    built = {"mart_revenue_by_month": revenue_by_month(c),
             "mart_revenue_by_category": revenue_by_category(c),
             "mart_state_performance": state_performance(c)}
    out = {}
    for name, df in built.items():
        path = write_table(df, f"{out_dir}/{name}")
        spark = spark or df.sparkSession
        out[name] = spark.read.parquet(path)
        out[name].createOrReplaceTempView(name)
    return out
