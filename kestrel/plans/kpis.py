"""Dashboard KPIs and the ratios derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kestrel.functions import metrics as M
from kestrel.functions.numeric import round_ratio
from kestrel.operators.scalars import one_row, with_scalars
from kestrel.operators.topk import desc_first, top_n
from kestrel.plans import marts
from kestrel.sources.model import Commerce


def total_revenue(c: Commerce, name: str = "total_revenue") -> DataFrame:
    """One row: revenue of all items, summed on the scan (no shuffle but one partial sum per task)."""
    return c.order_items().agg(F.expr(M.from_cents_sql("sum(revenue_cents)")).alias(name))


def kpi_row(c: Commerce, approx_customers: bool = False) -> DataFrame:
    """One row: total_revenue, total_orders, total_customers, avg_delivery_days,
    latest_ts, avg_order_value. Each scalar is one aggregate pass over its table;
    the one-row results are combined by ``one_row`` (no join)."""
    items = total_revenue(c)
    orders = c.orders().agg(
        F.count(F.lit(1)).alias("total_orders"),
        F.sum("delivery_days").alias("_dsum"),
        F.count("delivery_days").alias("_dn"),
        F.max("purchased_at").alias("latest_ts"))
    # At scale, ``approx_customers`` swaps the exact distinct count (a shuffle
    # of every distinct id) for a fixed-size HyperLogLog++ sketch (~1% error).
    distinct = (F.approx_count_distinct("customer_unique_id", 0.01) if approx_customers
                else F.count_distinct("customer_unique_id"))
    custs = c.customers().agg(distinct.alias("total_customers"))
    row = one_row(items, orders, custs)
    aov = F.when(F.col("total_orders") > 0,
                 F.col("total_revenue").cast("double") / F.col("total_orders")).otherwise(F.lit(0.0))
    return row.select(
        "total_revenue", "total_orders", "total_customers",
        round_ratio("_dsum", "_dn", 1).alias("avg_delivery_days"),
        "latest_ts",
        aov.alias("avg_order_value"))


def on_time_rate(c: Commerce) -> DataFrame:
    """Order-weighted on-time %, unrounded; an undelivered order counts as on time; none -> 0."""
    o = c.orders().filter(F.col("is_late").isNotNull())
    agg = o.agg(F.count_if(~F.col("is_late")).alias("on_time"), F.count(F.lit(1)).alias("n"))
    pct = F.col("on_time").cast("double") * 100.0 / F.nullif(F.col("n"), F.lit(0)).cast("double")
    return agg.select(F.coalesce(pct, F.lit(0.0)).alias("on_time_pct"))


def payment_mix(c: Commerce) -> DataFrame:
    """Per non-null payment type: payments, total_value_brl (largest first)."""
    p = c.payments().filter(F.col("payment_type").isNotNull())
    return (p.groupBy("payment_type")
             .agg(F.count(F.lit(1)).alias("payments"),
                  F.round(F.sum("payment_value"), 2).alias("total_value_brl"))
             .orderBy(desc_first("total_value_brl"), "payment_type"))


def payment_top_share(c: Commerce) -> DataFrame:
    """The leading payment type and its share of all typed payment value (%).

    The unpartitioned window runs over the aggregated rows (one per type)."""
    mix = payment_mix(c)
    w_all = Window.partitionBy()
    w_ord = Window.orderBy(desc_first("total_value_brl"), F.col("payment_type").asc_nulls_last())
    ranked = mix.select("payment_type", "total_value_brl",
                        F.sum("total_value_brl").over(w_all).alias("_all"),
                        F.row_number().over(w_ord).alias("_rn"))
    return ranked.filter(F.col("_rn") == 1).select(
        "payment_type",
        (F.col("total_value_brl").cast("double") / F.col("_all").cast("double") * 100.0).alias("share_pct"))


def score_histogram(c: Commerce) -> DataFrame:
    r = c.reviews().filter(F.col("review_score").isNotNull())
    return r.groupBy("review_score").agg(F.count(F.lit(1)).alias("reviews")).orderBy("review_score")


def score_shares(c: Commerce) -> DataFrame:
    """Share of 5-star and 1-star reviews among scored reviews (%)."""
    r = c.reviews().filter(F.col("review_score").isNotNull())
    a = r.agg(F.count_if(F.col("review_score") == 5).alias("five"),
              F.count_if(F.col("review_score") == 1).alias("one"),
              F.count(F.lit(1)).alias("n"))
    den = F.nullif(F.col("n"), F.lit(0)).cast("double")
    return a.select((F.col("five").cast("double") / den * 100.0).alias("five_star_pct"),
                    (F.col("one").cast("double") / den * 100.0).alias("one_star_pct"),
                    F.col("n").alias("reviews"))


def top_state_shares(c: Commerce, n: int = 10) -> DataFrame:
    """Top-n states by mart revenue with their share of KPI total revenue (%)."""
    states = top_n(marts.state_performance(c).select("state", "revenue_brl"),
                   [desc_first("revenue_brl")], n, ["state"])
    return with_scalars(states, total_revenue(c, "_total")).select(
        "state", "revenue_brl",
        (F.col("revenue_brl").cast("double") / F.col("_total").cast("double") * 100.0).alias("share_pct"))


def state_share_if_top(c: Commerce, state: str, n: int = 10) -> DataFrame:
    """One state's revenue share, reported only when it ranks in the top n."""
    return top_state_shares(c, n).filter(F.col("state") == state)


def last_full_month(c: Commerce) -> DataFrame:
    """Last full month's revenue and month-over-month change.

    The final month is treated as partial and dropped; fewer than three months
    leaves fewer than two full ones, reported as ('n/a', 0, 0). The windows
    run over the monthly mart (one row per month)."""
    m = marts.revenue_by_month(c).select("month", F.col("revenue_brl").cast("double").alias("rev"))
    w = Window.orderBy(F.col("month").desc())
    ranked = m.select("month", "rev", F.row_number().over(w).alias("rn"),
                      F.lead("rev").over(w).alias("prev"))
    latest = ranked.filter(F.col("rn") == 2).filter(F.col("prev").isNotNull())
    delta = F.when(F.col("prev") != 0, (F.col("rev") - F.col("prev")) / F.col("prev") * 100.0).otherwise(0.0)
    found = latest.select(F.date_format("month", "yyyy-MM-dd").alias("month"),
                          F.col("rev").alias("revenue"), delta.alias("delta_pct"))
    fallback = (m.agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") < 3)
                 .select(F.lit("n/a").alias("month"), F.lit(0.0).alias("revenue"), F.lit(0.0).alias("delta_pct")))
    return found.unionByName(fallback)


def monthly_series(c: Commerce) -> DataFrame:
    return marts.revenue_by_month(c).select("month", "revenue_brl", "orders").orderBy("month")


def peak_month(c: Commerce) -> DataFrame:
    """Month with the highest revenue as YYYY-MM (earliest month wins a tie)."""
    m = marts.revenue_by_month(c)
    return top_n(m, [desc_first("revenue_brl")], 1, ["month"]).select(
        F.date_format("month", "yyyy-MM").alias("peak_month"), "revenue_brl")


def top_categories(c: Commerce, n: int = 10) -> DataFrame:
    m = marts.revenue_by_category(c).select("category", "revenue_brl")
    return top_n(m, [desc_first("revenue_brl")], n, ["category"])


def top_states(c: Commerce, n: int = 10) -> DataFrame:
    m = marts.state_performance(c).select("state", "revenue_brl", "orders")
    return top_n(m, [desc_first("revenue_brl")], n, ["state"])
