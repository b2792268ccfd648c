"""The driver tables written as the nine raw CSV files (fixed stand-in rules).

The files hold what makes the cleaning rules matter: repeated keys, text that
is no timestamp, null words, orphans, and quoted newlines in the comments.

  customers   one row per customer; every eleventh again, later, with another city
  orders      every 13th order belongs to a customer that does not exist;
              every 97th has 'not a date' as its delivery
  order_items line items; those of every 17th order name no known product
  products    size 'NA' for every seventh part; PROMO parts have no category
  payments    value 'null' for every 19th event
  reviews     comments with a comma, a doubled quote and a newline
"""

from __future__ import annotations

import os
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.sources.raw import RAW_FILES, raw_path
from kestrel.sources.tables import Tables

PART_ROWS = 1_000_000
_TS = "date_format({}, 'yyyy-MM-dd HH:mm:ss')"


def raw_frames(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    t = Tables(spark, sf_dir)
    k = "CAST(get_json_object(props, '$.k') AS INT)"
    place = ("CAST(c_nationkey * 37 AS STRING) AS customer_zip_code_prefix",)
    customers = t.customer.selectExpr(
        "c_custkey AS customer_id", "c_custkey AS customer_unique_id", *place,
        "concat('  ', lower(c_name)) AS customer_city", "concat(char(97 + c_nationkey), 'xy') AS customer_state")
    again = customers.filter("customer_id % 11 = 0").withColumn("customer_city", F.lit("later copy"))
    return {
        "customers": customers.unionByName(again),
        "sellers": t.supplier.selectExpr(
            "s_suppkey AS seller_id", "CAST(s_nationkey AS STRING) AS seller_zip_code_prefix",
            "s_name AS seller_city", "concat(char(97 + s_nationkey), 'xy') AS seller_state"),
        "products": t.part.selectExpr(
            "p_partkey AS product_id", "nullif(p_type, 'PROMO') AS product_category_name",
            "length(p_name) AS product_name_lenght", "0 AS product_description_lenght", "1 AS product_photos_qty",
            "CASE WHEN p_partkey % 7 = 0 THEN 'NA' ELSE CAST(p_size * 10 AS STRING) END AS product_weight_g",
            "CAST(p_size AS STRING) AS product_length_cm", "concat(p_size, '.0') AS product_height_cm",
            "CASE WHEN p_partkey % 5 = 0 THEN 'nan' ELSE CAST(p_size + 1 AS STRING) END AS product_width_cm"),
        "category_translation": t.part.filter("p_type <> 'PROMO'").selectExpr(
            "p_type AS product_category_name", "lower(p_type) AS product_category_name_english").distinct(),
        "geolocation": t.customer.selectExpr(
            "CAST(c_custkey % 997 AS STRING) AS geolocation_zip_code_prefix", "c_acctbal AS geolocation_lat",
            "-c_acctbal AS geolocation_lng", "concat('  ', lower(c_mktsegment)) AS geolocation_city",
            "concat(char(97 + c_nationkey), 'x') AS geolocation_state"),
        "orders": t.orders.selectExpr(
            "o_orderkey AS order_id",
            "CASE WHEN o_orderkey % 13 = 0 THEN concat('gone-', o_custkey) ELSE CAST(o_custkey AS STRING) END AS customer_id",
            "o_orderstatus AS order_status", f"{_TS.format('o_orderdate')} AS order_purchase_timestamp",
            "CAST(NULL AS STRING) AS order_approved_at", "CAST(NULL AS STRING) AS order_delivered_carrier_date",
            f"CASE WHEN o_orderkey % 97 = 0 THEN 'not a date' ELSE {_TS.format('o_orderdate + make_interval(0, 0, 0, o_orderkey % 90)')} "
            "END AS order_delivered_customer_date",
            f"{_TS.format('o_orderdate + make_interval(0, 0, 0, 60)')} AS order_estimated_delivery_date"),
        "order_items": t.lineitem.selectExpr(
            "l_orderkey AS order_id", "l_linenumber AS order_item_id",
            "CASE WHEN l_orderkey % 17 = 0 THEN concat('gone-', l_partkey) ELSE CAST(l_partkey AS STRING) END AS product_id",
            "l_suppkey AS seller_id", f"{_TS.format('l_shipdate')} AS shipping_limit_date",
            "CAST(l_extendedprice AS DECIMAL(12,2)) AS price", "round(l_extendedprice * l_tax, 4) AS freight_value"),
        "order_payments": t.events.selectExpr(
            "user_id AS order_id", "event_id AS payment_sequential", "event_type AS payment_type",
            f"pmod({k}, 12) + 1 AS payment_installments",
            "CASE WHEN event_id % 19 = 0 THEN 'null' ELSE CAST(value AS STRING) END AS payment_value"),
        "order_reviews": t.events.selectExpr(
            "event_id AS review_id", "user_id AS order_id", f"pmod({k}, 5) + 1 AS review_score",
            "event_type AS review_comment_title",
            "concat('said \"well, ', event_type, '\"\\n and more') AS review_comment_message",
            f"{_TS.format('ts')} AS review_creation_date", "CAST(NULL AS STRING) AS review_answer_timestamp"),
    }


def write_raw(spark: SparkSession, sf_dir: str, raw_dir: str) -> str:
    """Write all nine files (as folders of compressed parts), a few at a time, and return their folder.

    Gzip cannot be split: a part holds at most ``PART_ROWS`` rows, and parts are dealt to tasks."""
    def write(item):
        name, df = item
        packed = {"compression": "gzip", "maxRecordsPerFile": PART_ROWS}
        df.select(*RAW_FILES[name][1]).write.options(header=True, quote='"', escape='"', **packed).csv(raw_path(raw_dir, name))

    with ThreadPoolExecutor(max_workers=4) as pool:
        list(pool.map(write, raw_frames(spark, sf_dir).items()))
    return os.path.normpath(raw_dir) if "://" not in raw_dir else raw_dir
