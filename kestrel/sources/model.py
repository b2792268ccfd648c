"""The marketplace model expressed over the driver's tables.

The reference's eight clean tables map onto the TPC-H-style tables as below.
These are fixed stand-in rules, used by every query and mirrored by the
oracle SQL:

  customers   customer: customer_id = customer_unique_id = c_custkey, city = c_name,
              state = nation.n_name via c_nationkey, segment = c_mktsegment
  sellers     supplier: seller_id = s_suppkey, city = s_name, state = nation.n_name
  products    part: product_id = p_partkey, category_name_pt = p_type,
              category_name_en = p_type except 'PROMO' parts, which carry no category
  orders      orders: order_id = o_orderkey, customer_id = o_custkey, order_status,
              purchase = o_orderdate, estimated = purchase + 60 days,
              delivered = latest l_shipdate of the order's items (NULL if it has none)
  order_items lineitem: order_id = l_orderkey, order_item_id = l_linenumber,
              product_id = l_partkey, seller_id = l_suppkey, shipping_limit = l_shipdate,
              price = l_extendedprice as decimal(12,2), freight = round(price x l_tax, 2)
  payments    events: order_id = user_id, payment_sequential = event_id,
              payment_type = event_type except 'error' events, which carry no type,
              payment_value = value as decimal(12,2), installments = k mod 12 + 1
  reviews     events: review_id = event_id, order_id = user_id,
              review_score = k mod 5 + 1 (k from props JSON), created = ts

Per-order facts (item count, item revenue, delivery date) are computed once
with a map-side-combined aggregation of line items; every order-level query
joins that one row per order instead of fanning out to the items.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.functions import metrics as M
from kestrel.sources.tables import Tables

NO_CATEGORY_TYPE = "PROMO"
NO_PAYMENT_TYPE = "error"


def memo(fn):
    """Cache a model table per instance and arguments: one query builds each
    derived DataFrame once, however many plans reuse it (same plan object, so
    Spark can also reuse its exchanges)."""
    def wrapper(self, *args, **kw):
        cache = self.__dict__.setdefault("_memo", {})
        key = (fn.__name__, args, tuple(sorted(kw.items())))
        if key not in cache:
            cache[key] = fn(self, *args, **kw)
        return cache[key]
    wrapper.__name__ = fn.__name__
    wrapper.__doc__ = fn.__doc__
    return wrapper


class ModelBase:
    """Derived per-order tables shared by every model implementation.

    A model provides customers(), sellers(), products(), order_items() (with
    ``revenue`` and ``revenue_cents``), orders_base(), orders(), payments() and
    reviews().
    """

    def order_items(self) -> DataFrame:  # pragma: no cover - interface
        raise NotImplementedError

    def reviews(self) -> DataFrame:  # pragma: no cover - interface
        raise NotImplementedError

    @memo
    def order_facts(self) -> DataFrame:
        """One row per order that has items: item count, item revenue (cents), delivery date."""
        return (self.order_items()
                .groupBy("order_id")
                .agg(F.count(F.lit(1)).alias("n_items"),
                     F.sum("revenue_cents").alias("items_revenue_cents"),
                     F.max("shipping_limit_date").alias("last_item_at")))

    @memo
    def review_stats(self) -> DataFrame:
        """One row per reviewed order: review count, score sum/count, 5-star count."""
        return (self.reviews().groupBy("order_id")
                .agg(F.count(F.lit(1)).alias("n_reviews"),
                     F.sum("review_score").alias("score_sum"),
                     F.count("review_score").alias("score_n"),
                     F.count_if(F.col("review_score") == 5).alias("n_five")))


_K = "CAST(get_json_object(props, '$.k') AS INT)"


class Commerce(ModelBase):
    def __init__(self, spark: SparkSession, sf_dir: str, tables=None):
        """``tables`` overrides where the driver tables come from (e.g. the
        bucketed catalog layout in kestrel.sources.layout)."""
        self.spark = spark
        self.sf_dir = sf_dir
        self.t = tables if tables is not None else Tables(spark, sf_dir)

    # ---- dimensions -------------------------------------------------
    @memo
    def nations(self) -> DataFrame:
        return self.t.nation.selectExpr("n_nationkey", "n_name AS state")

    @memo
    def customers(self) -> DataFrame:
        c = self.t.customer
        return (c.join(self.nations(), c.c_nationkey == F.col("n_nationkey"), "left")
                 .selectExpr("c_custkey AS customer_id", "c_custkey AS customer_unique_id",
                             "c_name AS city", "state", "c_mktsegment AS segment"))

    @memo
    def sellers(self) -> DataFrame:
        s = self.t.supplier
        return (s.join(self.nations(), s.s_nationkey == F.col("n_nationkey"), "left")
                 .selectExpr("s_suppkey AS seller_id", "s_name AS city", "state"))

    @memo
    def products(self) -> DataFrame:
        return self.t.part.selectExpr(
            "p_partkey AS product_id", "p_type AS category_name_pt",
            f"nullif(p_type, '{NO_CATEGORY_TYPE}') AS category_name_en",
            "p_brand AS brand", "p_size AS size", "p_retailprice AS retail_price")

    @memo
    def geolocation(self) -> DataFrame:
        """Stand-in places: one point per customer, rolled up to the zip prefix."""
        from kestrel.plans.etl import geolocation_driver
        return geolocation_driver(self.spark, self.sf_dir)

    # ---- facts ------------------------------------------------------
    @memo
    def order_items(self) -> DataFrame:
        price_cents = M.cents_of_sql("l_extendedprice")
        return self.t.lineitem.selectExpr(
            "l_orderkey AS order_id", "l_linenumber AS order_item_id",
            "l_partkey AS product_id", "l_suppkey AS seller_id",
            "l_shipdate AS shipping_limit_date",
            f"{M.money_sql('l_extendedprice')} AS price",
            f"{M.freight_sql('l_extendedprice', 'l_tax')} AS freight_value",
            f"{M.money_sql('l_extendedprice')} + {M.freight_sql('l_extendedprice', 'l_tax')} AS revenue",
            f"{price_cents} + {M.freight_cents_sql(price_cents, 'l_tax')} AS revenue_cents",
        )

    @memo
    def orders_base(self) -> DataFrame:
        return self.t.orders.selectExpr(
            "o_orderkey AS order_id", "o_custkey AS customer_id", "o_orderstatus AS order_status",
            "o_orderdate AS purchased_at", f"{M.estimated_sql('o_orderdate')} AS estimated_at")

    @memo
    def orders(self, with_items_only: bool = False) -> DataFrame:
        """Orders with derived delivery columns (and their per-order item facts)."""
        how = "inner" if with_items_only else "left"
        o = (self.orders_base()
             .join(self.order_facts().withColumnRenamed("last_item_at", "delivered_at"), "order_id", how))
        return o.selectExpr(
            "order_id", "customer_id", "order_status", "purchased_at", "estimated_at", "delivered_at",
            f"{M.delivery_days_sql('purchased_at', 'delivered_at')} AS delivery_days",
            f"{M.is_late_sql('delivered_at', 'estimated_at')} AS is_late",
            "coalesce(n_items, 0L) AS n_items", "items_revenue_cents")

    @memo
    def payments(self) -> DataFrame:
        return self.t.events.selectExpr(
            "user_id AS order_id", "event_id AS payment_sequential",
            f"nullif(event_type, '{NO_PAYMENT_TYPE}') AS payment_type",
            f"pmod({_K}, 12) + 1 AS payment_installments",
            f"{M.money_sql('value')} AS payment_value")

    @memo
    def reviews(self) -> DataFrame:
        return self.t.events.selectExpr(
            "event_id AS review_id", "user_id AS order_id",
            f"pmod({_K}, 5) + 1 AS review_score", "ts AS review_creation_date")
