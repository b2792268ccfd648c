"""Batch ETL: raw files -> cleaned, typed, key-checked tables -> marts.

``build_*`` read the raw CSVs (see kestrel.sources.raw) and apply the
cleaning rules; ``run_etl`` runs the whole pipeline: build, FK cascade, write
(dependency order), read-back validation, views. The ``clean_*_driver``
functions apply the same rules to the driver tables for the registered checks.
"""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.functions import metrics as M
from kestrel.functions import text as X
from kestrel.functions.time import lenient_timestamp
from kestrel.operators.dedupe import keep_first
from kestrel.operators.impute import impute_group_then_global
from kestrel.operators.integrity import FOREIGN_KEYS, fk_cascade, semi_filter
from kestrel.operators.rollup import modal_rollup
from kestrel.operators.scalars import one_row
from kestrel.operators.slices import stored
from kestrel.sources.model import ModelBase, memo
from kestrel.session import cut_lineage, release_shuffles, remove_scratch, scratch_path
from kestrel.sources.raw import FILE_ORDER, read_raw
from kestrel.sources.raw_model import write_raw
from kestrel.sources.tables import Tables

DIM_COLS = ["product_weight_g", "product_length_cm", "product_height_cm", "product_width_cm"]
ORDER_TS = ["order_purchase_timestamp", "order_approved_at", "order_delivered_carrier_date",
            "order_delivered_customer_date", "order_estimated_delivery_date"]
LOAD_ORDER = ["customers", "sellers", "products", "geolocation", "orders", "order_items",
              "order_payments", "order_reviews"]


def _int(c: str):
    """Whole part of a number text; what is no number, or too large, becomes NULL."""
    return F.col(c).try_cast("decimal(20,6)").try_cast("int")


def _money(c: str):
    """Text straight to an exact amount, rounded half up to cents; NULL as in :func:`_int`."""
    return F.round(F.col(c).try_cast("decimal(20,8)"), 2).try_cast("decimal(10,2)")


def _place(df: DataFrame, prefix: str) -> DataFrame:
    place = {f"{prefix}city", f"{prefix}state", f"{prefix}zip_code_prefix"}
    return df.select(
        *[F.col(c) for c in df.columns if c not in place],
        X.clean_city(F.col(f"{prefix}city")).alias("city"),
        X.clean_state(F.col(f"{prefix}state")).alias("state"),
        X.zfill(F.col(f"{prefix}zip_code_prefix"), 5).alias("zip_code_prefix"))


def build_customers(spark: SparkSession, raw_dir: str, prefix: str = "") -> DataFrame:
    df = _place(read_raw(spark, raw_dir, "customers", prefix), "customer_")
    df = keep_first(df, ["customer_id"], FILE_ORDER)
    return df.select("customer_id", "customer_unique_id", "zip_code_prefix", "city", "state")


def build_sellers(spark: SparkSession, raw_dir: str, prefix: str = "") -> DataFrame:
    df = _place(read_raw(spark, raw_dir, "sellers", prefix), "seller_")
    df = keep_first(df, ["seller_id"], FILE_ORDER)
    return df.select("seller_id", "zip_code_prefix", "city", "state")


def build_products(spark: SparkSession, raw_dir: str, prefix: str = "") -> DataFrame:
    """Translate categories (left lookup), impute dimensions, then keep-first on product_id."""
    p = read_raw(spark, raw_dir, "products", prefix)
    tr = read_raw(spark, raw_dir, "category_translation", prefix).select(
        "product_category_name", "product_category_name_english")
    df = p.join(tr, "product_category_name", "left")
    df = df.select("product_id", "product_category_name", "product_category_name_english",
                   *[_int(c).alias(c) for c in DIM_COLS], *FILE_ORDER)
    df = cut_lineage(df)  # the medians read it twice more; the file is parsed once
    df = impute_group_then_global(df, "product_category_name", DIM_COLS)
    df = (df.withColumnRenamed("product_category_name", "category_name_pt")
            .withColumnRenamed("product_category_name_english", "category_name_en"))
    df = keep_first(df, ["product_id"], FILE_ORDER)
    return df.select("product_id", "category_name_pt", "category_name_en", *DIM_COLS)


def rollup_places(points: DataFrame) -> DataFrame:
    """Raw points (zip_code_prefix, lat, lng, city, state) -> one row per zip.

    Mean lat/lng (6 digits), modal city/state, cleaned after the mode."""
    r = modal_rollup(points, "zip_code_prefix", ["lat", "lng"], ["city", "state"])
    return r.select("zip_code_prefix",
                    F.col("lat").cast("decimal(10,6)").alias("lat"),
                    F.col("lng").cast("decimal(10,6)").alias("lng"),
                    X.clean_city("city").alias("city"), X.clean_state("state").alias("state"))


def build_geolocation(spark: SparkSession, raw_dir: str, prefix: str = "") -> DataFrame:
    g = read_raw(spark, raw_dir, "geolocation", prefix)
    return rollup_places(g.select(
        X.zfill(F.col("geolocation_zip_code_prefix"), 5).alias("zip_code_prefix"),
        F.col("geolocation_lat").try_cast("double").alias("lat"),
        F.col("geolocation_lng").try_cast("double").alias("lng"),
        F.col("geolocation_city").alias("city"),
        F.col("geolocation_state").alias("state")))


# Stand-in points: one per customer; 997 zip prefixes, so that a zip has several points and modes can tie.
GEO_POINTS = ("CAST(c_custkey % 997 AS STRING) AS zip", "c_acctbal AS lat", "-c_acctbal AS lng",
              "concat('  ', lower(c_mktsegment)) AS city", "concat(char(97 + c_nationkey), 'x') AS state")


def geolocation_driver(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = Tables(spark, sf_dir).customer.selectExpr(*GEO_POINTS)
    return rollup_places(points.select(X.zfill(F.col("zip"), 5).alias("zip_code_prefix"), "lat", "lng", "city", "state"))


def build_orders(spark: SparkSession, raw_dir: str, prefix: str = "") -> DataFrame:
    o = read_raw(spark, raw_dir, "orders", prefix)
    o = o.select("order_id", "customer_id", "order_status",
                 *[lenient_timestamp(c).alias(c) for c in ORDER_TS], *FILE_ORDER)
    o = o.withColumn("delivery_days", M.delivery_days("order_purchase_timestamp", "order_delivered_customer_date")) \
         .withColumn("is_late", M.is_late("order_delivered_customer_date", "order_estimated_delivery_date"))
    o = keep_first(o, ["order_id"], FILE_ORDER)
    return o.select("order_id", "customer_id", "order_status", *ORDER_TS, "delivery_days", "is_late")


def build_order_items(spark: SparkSession, raw_dir: str, prefix: str = "") -> DataFrame:
    i = read_raw(spark, raw_dir, "order_items", prefix)
    i = i.select("order_id", _int("order_item_id").alias("order_item_id"), "product_id", "seller_id",
                 lenient_timestamp("shipping_limit_date").alias("shipping_limit_date"),
                 _money("price").alias("price"), _money("freight_value").alias("freight_value"), *FILE_ORDER)
    i = keep_first(i, ["order_id", "order_item_id"], FILE_ORDER)
    return i.select("order_id", "order_item_id", "product_id", "seller_id", "shipping_limit_date",
                    "price", "freight_value")


def build_order_payments(spark: SparkSession, raw_dir: str, prefix: str = "") -> DataFrame:
    p = read_raw(spark, raw_dir, "order_payments", prefix)
    p = p.select("order_id", _int("payment_sequential").alias("payment_sequential"), "payment_type",
                 _int("payment_installments").alias("payment_installments"),
                 _money("payment_value").alias("payment_value"), *FILE_ORDER)
    p = keep_first(p, ["order_id", "payment_sequential"], FILE_ORDER)
    return p.select("order_id", "payment_sequential", "payment_type", "payment_installments", "payment_value")


def build_order_reviews(spark: SparkSession, raw_dir: str, prefix: str = "") -> DataFrame:
    r = read_raw(spark, raw_dir, "order_reviews", prefix)
    r = r.select("review_id", "order_id", _int("review_score").alias("review_score"),
                 "review_comment_title", "review_comment_message",
                 lenient_timestamp("review_creation_date").alias("review_creation_date"),
                 lenient_timestamp("review_answer_timestamp").alias("review_answer_timestamp"), *FILE_ORDER)
    r = keep_first(r, ["review_id", "order_id"], FILE_ORDER)
    return r.select("review_id", "order_id", "review_score", "review_comment_title",
                    "review_comment_message", "review_creation_date", "review_answer_timestamp")


BUILDERS = {
    "customers": build_customers, "sellers": build_sellers, "products": build_products,
    "geolocation": build_geolocation, "orders": build_orders, "order_items": build_order_items,
    "order_payments": build_order_payments, "order_reviews": build_order_reviews,
}


def build_all(spark: SparkSession, raw_dir: str, prefix: str = "") -> dict[str, DataFrame]:
    """All clean tables after the FK cascade; ``prefix`` is the raw files' publisher prefix."""
    return fk_cascade(_build(spark, raw_dir, tuple(BUILDERS), prefix))


def _build(spark: SparkSession, raw_dir: str, names: tuple[str, ...], prefix: str) -> dict[str, DataFrame]:
    """The named tables before the FK cascade; a few builders run at once."""
    with ThreadPoolExecutor(max_workers=4) as pool:
        return dict(zip(names, pool.map(lambda n: BUILDERS[n](spark, raw_dir, prefix), names), strict=True))


# What may be written at once: a table's parents are in an earlier step.
LOAD_STEPS = (("customers", "sellers", "products", "geolocation"), ("orders",),
              ("order_items", "order_payments", "order_reviews"))


def run_etl(spark: SparkSession, raw_dir: str, out_dir: str, prefix: str = "", register_views: bool = True) -> DataFrame:
    """Build, filter and write the tables, parents first; validate; register the views. Returns the load report.

    Every raw file is parsed once: a child is filtered against the written
    files of its parents, not against their plans. A table's expected row count
    is observed during its write, the actual count read back from the files."""
    from kestrel.plans.quality import load_report, write_tables
    loaded: dict[str, DataFrame] = {}
    counts: dict[str, int] = {}
    for step in LOAD_STEPS:
        built = _build(spark, raw_dir, step, prefix)
        kept: dict[str, str] = {}
        for fk in FOREIGN_KEYS:
            if fk.child in built:
                if sum(other.child == fk.child for other in FOREIGN_KEYS) > 1:
                    built[fk.child] = _kept(spark, built[fk.child], fk.child, kept)
                built[fk.child] = semi_filter(built[fk.child], fk.column, loaded[fk.parent], fk.parent_column)
        counts |= write_tables(built, out_dir)
        loaded |= {n: spark.read.schema(built[n].schema).parquet(f"{out_dir}/{n}") for n in step}
        for path in kept.values():
            remove_scratch(spark, path)
        release_shuffles(spark)
    if register_views:
        from kestrel.plans.marts import register_marts
        for n, df in loaded.items():
            df.createOrReplaceTempView(n)
        register_marts(CleanModel(loaded))
    return load_report(spark, counts, loaded)


def _kept(spark: SparkSession, df: DataFrame, name: str, kept: dict[str, str]) -> DataFrame:
    """``df`` written and read back, in place of what ``kept`` has of that name.

    A table with several foreign keys is shuffled whole for its dedupe and for each key; written in between,
    only one of these shuffles is on the disks at a time."""
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path)
    if name in kept:
        remove_scratch(spark, kept[name])
    kept[name] = path
    release_shuffles(spark)
    return spark.read.schema(df.schema).parquet(path)


def etl_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole job over the driver tables: raw CSV files, eight clean tables, foreign keys, validation, marts.

    One row per table (expected and loaded rows) and per mart (its rows)."""
    root = scratch_path(spark, f"etl-{uuid.uuid4().hex[:12]}")
    write_raw(spark, sf_dir, f"{root}/raw")
    return etl_report(spark, f"{root}/raw", f"{root}/clean")


def etl_report(spark: SparkSession, raw_dir: str, out_dir: str) -> DataFrame:
    from kestrel.plans.marts import revenue_by_category, revenue_by_month, state_performance
    report = run_etl(spark, raw_dir, out_dir, register_views=False)
    model = ReportModel({n: spark.read.parquet(f"{out_dir}/{n}") for n in LOAD_ORDER})
    for name, mart in (("month", revenue_by_month), ("category", revenue_by_category), ("state", state_performance)):
        n = mart(model).agg(F.count(F.lit(1)).alias("actual"), F.sum("revenue_brl").alias("revenue_brl"))
        report = report.unionByName(n.select(F.lit(f"mart_{name}").alias("table_name"), F.lit(None).cast("long").alias("expected"),
                                             "actual", F.lit("OK").alias("status"), "revenue_brl"), allowMissingColumns=True)
    return report


class CleanModel(ModelBase):
    """The model over the cleaned tables (the ETL's output)."""

    def __init__(self, tables: dict[str, DataFrame]):
        self.tables = tables

    def customers(self):
        return self.tables["customers"]

    def sellers(self):
        return self.tables["sellers"]

    def products(self):
        return self.tables["products"]

    def order_items(self):
        i = self.tables["order_items"]
        return (i.withColumn("revenue", M.revenue("price", "freight_value"))
                 .withColumn("revenue_cents", M.to_cents("price") + M.to_cents("freight_value")))

    def orders_base(self):
        return self.tables["orders"].withColumnRenamed("order_purchase_timestamp", "purchased_at")

    def orders(self, with_items_only: bool = False):
        how = "inner" if with_items_only else "left"
        facts = self.order_facts().select("order_id", "n_items", "items_revenue_cents")
        o = self.orders_base().join(facts, "order_id", how)
        return o.withColumn("n_items", F.coalesce(F.col("n_items"), F.lit(0)))

    def payments(self):
        return self.tables["order_payments"]

    def reviews(self):
        return self.tables["order_reviews"]


class ReportModel(CleanModel):
    """The model of a report over several marts: orders with their item facts are joined and written once for all."""

    @memo
    def orders(self, with_items_only: bool = False):
        out = stored(super().orders(with_items_only), "report-orders")
        release_shuffles(out.sparkSession)
        return out


# ---- the same rules over the driver tables (registered checks) -------------
def clean_customers_driver(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    c = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    df = c.select(F.col("c_custkey").alias("customer_id"), F.col("c_custkey").alias("customer_unique_id"),
                  X.zfill(F.col("c_nationkey").cast("string"), 5).alias("zip_code_prefix"),
                  X.clean_city("c_name").alias("city"), X.clean_state("n_name").alias("state"))
    return keep_first(df, ["customer_id"])


def clean_sellers_driver(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    s = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    df = s.select(F.col("s_suppkey").alias("seller_id"),
                  X.zfill(F.col("s_nationkey").cast("string"), 5).alias("zip_code_prefix"),
                  X.clean_city("s_name").alias("city"), X.clean_state("n_name").alias("state"))
    return keep_first(df, ["seller_id"])


def clean_orders_driver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders through the text-timestamp path: format, lenient parse, derive, dedupe.

    Every 97th order has 'not a date' as its purchase text and every 89th a date without time: both become NULL."""
    t = Tables(spark, sf_dir)
    facts = (t.lineitem.groupBy(F.col("l_orderkey").alias("order_id"))
             .agg(F.max("l_shipdate").alias("delivered")))
    o = t.orders.select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"),
                        F.col("o_orderstatus").alias("order_status"),
                        F.expr("CASE WHEN o_orderkey % 97 = 0 THEN 'not a date' "
                               "WHEN o_orderkey % 89 = 0 THEN date_format(o_orderdate, 'yyyy-MM-dd') "
                               "ELSE date_format(o_orderdate, 'yyyy-MM-dd HH:mm:ss') END AS purchase_text"))
    o = o.join(facts, "order_id", "left").select(
        "order_id", "customer_id", "order_status",
        lenient_timestamp("purchase_text").alias("order_purchase_timestamp"),
        F.col("delivered").alias("order_delivered_customer_date"))
    o = o.withColumn("order_estimated_delivery_date", M.estimated_delivery("order_purchase_timestamp"))
    o = o.withColumn("delivery_days", M.delivery_days("order_purchase_timestamp", "order_delivered_customer_date")) \
         .withColumn("is_late", M.is_late("order_delivered_customer_date", "order_estimated_delivery_date"))
    return keep_first(o, ["order_id"])


def clean_items_driver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items keyed (order_id, order_item_id), which repeats; the first row by full-row order is kept."""
    li = Tables(spark, sf_dir).lineitem
    df = li.select(F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("order_item_id"),
                   F.col("l_partkey").alias("product_id"), F.col("l_suppkey").alias("seller_id"),
                   F.col("l_shipdate").alias("shipping_limit_date"),
                   M.money("l_extendedprice").alias("price"),
                   M.freight_from_rate("l_extendedprice", "l_tax").alias("freight_value"))
    return keep_first(df, ["order_id", "order_item_id"])


def clean_payments_driver(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kestrel.sources.model import Commerce
    return keep_first(Commerce(spark, sf_dir).payments(), ["order_id", "payment_sequential"])


def clean_reviews_driver(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kestrel.sources.model import Commerce
    return keep_first(Commerce(spark, sf_dir).reviews(), ["review_id", "order_id"])


# Fixed stand-in rule for imputation: parts named '... ring' have no recorded size.
UNSIZED_NAME = "%ring"


def impute_dimensions_driver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with missing sizes (and PROMO parts without a category) through the two-level median."""
    p = Tables(spark, sf_dir).part
    df = p.select(F.col("p_partkey").alias("product_id"),
                  F.nullif(F.col("p_type"), F.lit("PROMO")).alias("category"),
                  F.when(~F.col("p_name").like(UNSIZED_NAME), F.col("p_size")).alias("size"),
                  F.col("p_retailprice").alias("retail_price"))
    return impute_group_then_global(df, "category", ["size"])


def brand_rollup_driver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Geolocation-style rollup on parts by brand: mean price (6 digits), modal type and name."""
    p = Tables(spark, sf_dir).part
    return modal_rollup(p.select("p_brand", M.money("p_retailprice").alias("p_retailprice"), "p_type", "p_name"),
                        "p_brand", ["p_retailprice"], ["p_type", "p_name"])


def _orphaned(df: DataFrame, **rules: str) -> DataFrame:
    """``df`` with the key negated (no parent has a negative key) where the rule holds."""
    return df.withColumns({c: F.expr(f"CASE WHEN {rule} THEN -{c} ELSE {c} END") for c, rule in rules.items()})


def fk_tables_driver(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The model tables, whole, with orphans of every foreign key.

    Every foreign key holds in the driver data, so key arithmetic makes
    orphans: a fixed share of each child's rows gets a key that no parent has."""
    from kestrel.sources.model import Commerce
    c = Commerce(spark, sf_dir)
    return {
        "customers": c.customers(), "sellers": c.sellers(), "products": c.products(),
        "orders": _orphaned(c.orders_base(), customer_id="order_id % 13 = 0"),
        "order_items": _orphaned(c.order_items(), order_id="product_id % 23 = 0", product_id="order_id % 17 = 0",
                                 seller_id="order_id % 19 = 0"),
        "order_payments": _orphaned(c.payments(), order_id="payment_sequential % 29 = 0"),
        "order_reviews": _orphaned(c.reviews(), order_id="review_id % 31 = 0"),
    }


def fk_filter_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows kept and dropped per table by the FK cascade (the filtered orders are computed once)."""
    before = fk_tables_driver(spark, sf_dir)
    kept = semi_filter(before["orders"], "customer_id", before["customers"], "customer_id").select("order_id")
    after = fk_cascade(before, orders=cut_lineage(kept))
    parts = []
    for n in ["orders", "order_items", "order_payments", "order_reviews"]:
        b = before[n].agg(F.expr("count(1) AS rows_in"))
        a = after[n].agg(F.expr("count(1) AS rows_kept"))
        parts.append(one_row(b, a).selectExpr(f"'{n}' AS table_name", "rows_in", "rows_kept",
                                              "rows_in - rows_kept AS rows_dropped"))
    return reduce(DataFrame.unionByName, parts)
