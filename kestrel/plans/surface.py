"""The guarded SQL surface, lookups and result-shape hints as registered jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.operators import lookups as LK
from kestrel.operators.guard import DEFAULT_ROW_CAP, SURFACE_TABLES, guarded_sql
from kestrel.operators.shape import chart_hint
from kestrel.plans import kpis, marts
from kestrel.sources.model import Commerce
from kestrel.sources.tables import Tables

# The ad-hoc statement the guarded surface runs in the registered check: a table joined to a mart.
ADHOC_SQL = """
SELECT m.state, m.orders, m.revenue_brl, count(*) AS customers
FROM mart_state_performance m
JOIN customers c ON c.state = m.state
GROUP BY m.state, m.orders, m.revenue_brl
"""

# Rate quotes (parameters); the last is the one the original tests pin.
RATE_QUOTES = [("1996-07-01", "BRL", "USD", 0.9950), ("1998-03-10", "BRL", "USD", 0.8812),
               ("1999-02-01", "BRL", "USD", 0.5236), ("2025-01-15", "BRL", "USD", 0.1995)]


_SURFACES: dict = {}


def surface_session(spark: SparkSession, sf_dir: str) -> SparkSession:
    """The session ad-hoc SQL runs in: a child session (same cluster, its own
    temp views) that holds the eight tables and three marts and nothing else the
    caller registered. One per Spark application and data folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _SURFACES:
        child = spark.newSession()
        child.conf.set("spark.sql.session.timeZone", "UTC")
        c = Commerce(child, sf_dir)
        tables = {"customers": c.customers(), "sellers": c.sellers(), "products": c.products(),
                  "geolocation": c.geolocation(), "orders": c.orders(), "order_items": c.order_items(),
                  "order_payments": c.payments(), "order_reviews": c.reviews()}
        for name, df in tables.items():
            df.createOrReplaceTempView(name)
        marts.register_marts(c)
        register_functions(child, rates_table(child))
        _SURFACES[key] = child
    return _SURFACES[key]


def register_functions(session: SparkSession, rates: DataFrame) -> None:
    """The lookup, rate and business terms as SQL functions that statements of the session can call.

    ``to_usd`` converts with the latest rate known when they are registered (one row is read)."""
    rate = LK.latest_rate(rates).first()["rate"]
    for name, (parameters, result, body) in LK.sql_functions(rate).items():
        session.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")


# The statement that calls them in the registered check; some states are given codes of the dimension, as users type them.
FUNCTIONS_SQL = """
SELECT m.state, state_info(CASE WHEN m.state LIKE '%1' THEN ' sp' WHEN m.state LIKE '%2' THEN 'Rj ' ELSE m.state END) AS state_text,
       to_usd(m.revenue_brl) AS revenue_usd, item_revenue(m.revenue_brl, 0.50) AS with_fee,
       (SELECT count(*) FROM orders o WHERE delivered_late(o.delivered_at, o.estimated_at)) AS late_orders
FROM mart_state_performance m
"""


def guarded_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A guarded statement that calls the surface's functions."""
    return guarded_adhoc(spark, sf_dir, FUNCTIONS_SQL)


def guarded_adhoc(spark: SparkSession, sf_dir: str, query: str = ADHOC_SQL,
                  cap: int = DEFAULT_ROW_CAP) -> DataFrame:
    return guarded_sql(surface_session(spark, sf_dir), query, SURFACE_TABLES, cap)


def rates_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RATE_QUOTES, "date string, from_ccy string, to_ccy string, rate double") \
                .withColumn("date", F.to_date("date"))


def state_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State dimension lookup of every customer's code.

    Stand-in codes: nation k has the k-th code of the dimension (counted from
    0), in lower case with a leading blank; every ninth nation has 'zz' and its
    number, which no state has."""
    codes = ", ".join(f"'{code.lower()}'" for code, _, _ in LK.BR_STATES)
    code = (f"CASE WHEN c_nationkey % 9 = 8 THEN concat('zz', c_nationkey) "
            f"ELSE concat(' ', element_at(array({codes}), c_nationkey + 1)) END")
    customers = Tables(spark, sf_dir).customer.selectExpr(f"{code} AS state")
    per_code = customers.groupBy("state").agg(F.count(F.lit(1)).alias("customers"))
    return LK.lookup_states(per_code, "state")


def revenue_usd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """KPI total revenue converted with the latest known BRL->USD rate (fallback flagged)."""
    j = LK.with_latest_rate(kpis.total_revenue(Commerce(spark, sf_dir)), rates_table(spark))
    usd = F.round(F.col("total_revenue") * F.col("rate").cast("decimal(10,4)"), 2)
    return j.select("total_revenue", F.col("rate"), "is_fallback", usd.alias("total_revenue_usd"))


def revenue_usd_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly revenue converted at the rate known on each month's first day."""
    m = marts.revenue_by_month(Commerce(spark, sf_dir)).select("month", "revenue_brl")
    j = LK.as_of_rate(m, "month", rates_table(spark))
    usd = F.round(F.col("revenue_brl") * F.col("rate").cast("decimal(10,4)"), 2)
    return j.select("month", "revenue_brl", "rate", "is_fallback", usd.alias("revenue_usd"))


def result_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chart hints for the monthly series and the top categories."""
    c = Commerce(spark, sf_dir)
    monthly = kpis.monthly_series(c).select(F.date_format("month", "yyyy-MM").alias("month"), "revenue_brl")
    cats = kpis.top_categories(c)
    return (chart_hint(monthly).select(F.lit("monthly_series").alias("result"), "rows", "chart")
            .unionByName(chart_hint(cats).select(F.lit("top_categories").alias("result"), "rows", "chart")))
