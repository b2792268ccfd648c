"""Raw marketplace files (CSV), JSON-lines logs, and table sinks.

Every raw file is read with an explicit all-string schema (no inference,
so ids keep their leading zeros) and cast afterwards. Free text may hold
quoted commas, doubled quotes and newlines (``escape='"'``; see MULTI_LINE).
"""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Raw file base names and the columns read from each. The
# public dataset's files carry a publisher prefix on every name except the
# category translation; pass it as ``prefix`` (see UNPREFIXED).
UNPREFIXED = {"category_translation"}
RAW_FILES = {
    "customers": ("customers_dataset.csv",
                  ["customer_id", "customer_unique_id", "customer_zip_code_prefix",
                   "customer_city", "customer_state"]),
    "sellers": ("sellers_dataset.csv",
                ["seller_id", "seller_zip_code_prefix", "seller_city", "seller_state"]),
    "products": ("products_dataset.csv",
                 ["product_id", "product_category_name", "product_name_lenght",
                  "product_description_lenght", "product_photos_qty", "product_weight_g",
                  "product_length_cm", "product_height_cm", "product_width_cm"]),
    "category_translation": ("product_category_name_translation.csv",
                             ["product_category_name", "product_category_name_english"]),
    "geolocation": ("geolocation_dataset.csv",
                    ["geolocation_zip_code_prefix", "geolocation_lat", "geolocation_lng",
                     "geolocation_city", "geolocation_state"]),
    "orders": ("orders_dataset.csv",
               ["order_id", "customer_id", "order_status", "order_purchase_timestamp",
                "order_approved_at", "order_delivered_carrier_date",
                "order_delivered_customer_date", "order_estimated_delivery_date"]),
    "order_items": ("order_items_dataset.csv",
                    ["order_id", "order_item_id", "product_id", "seller_id",
                     "shipping_limit_date", "price", "freight_value"]),
    "order_payments": ("order_payments_dataset.csv",
                       ["order_id", "payment_sequential", "payment_type",
                        "payment_installments", "payment_value"]),
    "order_reviews": ("order_reviews_dataset.csv",
                      ["review_id", "order_id", "review_score", "review_comment_title",
                       "review_comment_message", "review_creation_date",
                       "review_answer_timestamp"]),
}


def string_schema(cols: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType(), True) for c in cols])


def raw_path(raw_dir: str, name: str, prefix: str = "") -> str:
    fname = RAW_FILES[name][0]
    return os.path.join(raw_dir, fname if name in UNPREFIXED else prefix + fname)


# Texts that stand for no value in the raw files.
NULL_WORDS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A",
              "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
# Only these files have free text with quoted newlines; every other file can be split.
MULTI_LINE = {"order_reviews"}


def file_rank(files: list[str]) -> str:
    """SQL for a text that orders rows as the paths of their files do, without what all names share.

    It goes through the dedupe's shuffle with every row. Only files of one folder whose plain names are
    equally long are cut; of all others the path is taken."""
    names = [f.rsplit("/", 1)[-1] for f in files]
    alike = len({f.rsplit("/", 1)[0] for f in files}) == 1 and len({len(n) for n in names}) == 1
    if not alike or not all(re.fullmatch(r"[\w.-]+", n, re.ASCII) for n in names):
        return "_metadata.file_path"
    head = len(os.path.commonprefix(names))
    tail = len(os.path.commonprefix([n[head:][::-1] for n in names]))
    return f"substring(_metadata.file_name, {head + 1}, {len(names[0]) - head - tail})"


def read_raw(spark: SparkSession, raw_dir: str, name: str, prefix: str = "") -> DataFrame:
    """Read one raw CSV (a file or a folder of parts) as strings, null words as null, with its file-order columns.

    ``_file``, ``_block`` and ``_pos`` record where each row sat in its file
    (see :func:`file_rank`, split start, position inside the split): the keep-first dedupe
    orders by them. The header decides which columns exist; columns the
    code does not use are ignored.
    """
    cols = RAW_FILES[name][1]
    path = raw_path(raw_dir, name, prefix)
    options = {"header": True, "multiLine": name in MULTI_LINE, "quote": '"', "escape": '"'}
    found = spark.read.options(**options).csv(path)
    header = found.columns
    df = spark.read.schema(string_schema(header)).options(**options, nullValue="", enforceSchema=False).csv(path)
    words = ", ".join(f"'{w}'" for w in NULL_WORDS)
    return df.select(*[F.expr(f"CASE WHEN `{c}` NOT IN ({words}) THEN `{c}` END AS `{c}`") for c in cols if c in header],
                     F.expr(file_rank(found.inputFiles())).alias("_file"),
                     F.col("_metadata.file_block_start").alias("_block"),
                     F.monotonically_increasing_id().alias("_pos"))


FILE_ORDER = ["_file", "_block", "_pos"]


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None,
                mode: str = "overwrite") -> str:
    """Table sink: drop-and-recreate semantics (overwrite), Parquet."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


# Schema of the JSON-lines request log the log analytics read.
REQUEST_LOG_SCHEMA = T.StructType([
    T.StructField("ts", T.TimestampType()),
    T.StructField("api_key", T.StringType()),
    T.StructField("ip", T.StringType()),
    T.StructField("session_id", T.StringType()),
    T.StructField("question", T.StringType()),
    T.StructField("prompt_tokens", T.LongType()),
    T.StructField("completion_tokens", T.LongType()),
    T.StructField("failed", T.BooleanType()),
    T.StructField("cached", T.BooleanType()),
    T.StructField("blocked", T.BooleanType()),
    T.StructField("sql_error", T.BooleanType()),
    T.StructField("latency_ms", T.LongType()),
])


def read_json_log(spark: SparkSession, path: str, schema: T.StructType = REQUEST_LOG_SCHEMA) -> DataFrame:
    return spark.read.schema(schema).json(path)


GOLDEN_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("question", T.StringType()),
    T.StructField("contains", T.ArrayType(T.StringType())),
    T.StructField("max_latency_ms", T.LongType()),
])


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """Golden cases from a YAML or JSON file whose top level is a list.

    The case file is a small configuration (tens of cases): Spark reads its
    text, wherever it lies, and the parsed cases become a DataFrame that is
    joined to the answers."""
    import json
    text = spark.read.text(path, wholetext=True).first()[0]
    if path.endswith((".yaml", ".yml")):
        import yaml
        data = yaml.safe_load(text) or []
    else:
        data = json.loads(text) if text.strip() else []
    if not isinstance(data, list):
        raise ValueError(f"{path} must contain a list at the top level")
    rows = [(str(c["id"]), c.get("question"), [str(x) for x in (c.get("contains") or [])],
             c.get("max_latency_ms")) for c in data]
    return spark.createDataFrame(rows, GOLDEN_SCHEMA)


def write_report(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").json(path)
    return path
