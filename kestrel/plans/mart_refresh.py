"""Marts refreshed by load, without recomputing history.

Facts are stored in folders by ``period`` (a day, or any date format of the
purchase time). A load computes the partial states of its periods only, reading
only their folders, and stores them by period: sums per category and per
state, and one row per month and person, as persons must be counted once however many days
they bought on. A mart is the partial states of all periods, added. Loading a
period again replaces its states, so a repeated load changes nothing, and a late
review or correction is taken in by loading the period of its order again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.plans import marts
from kestrel.session import scratch_path
from kestrel.sources.model import Commerce, ModelBase

PERIOD = "period"
NO_PERIOD = "none"  # of orders without a purchase time


def _store(df: DataFrame, path: str, replace: str = "dynamic") -> None:
    # Rebalanced by period: few files each, and a period with most of the rows is split.
    (df.hint("rebalance", F.col(PERIOD)).write.mode("overwrite").option("partitionOverwriteMode", replace)
     .partitionBy(PERIOD).parquet(path))


def write_facts(c: ModelBase, path: str, grain: str = "yyyy-MM-dd") -> None:
    """Orders, items and reviews of a model, each with the period of its order; periods that are written are replaced."""
    orders = c.orders().withColumn(PERIOD, F.coalesce(F.date_format("purchased_at", grain), F.lit(NO_PERIOD)))
    keys = orders.select("order_id", PERIOD)
    items = c.order_items().select("order_id", "product_id", "revenue_cents")
    reviews = c.reviews().select("order_id", "review_score")
    _store(orders.select("order_id", "customer_id", "purchased_at", "delivery_days", "is_late", "n_items",
                         "items_revenue_cents", PERIOD), f"{path}/orders")
    _store(items.join(keys, "order_id"), f"{path}/order_items")
    _store(reviews.join(keys, "order_id"), f"{path}/reviews")


class StoredFacts(ModelBase):
    """The model over the stored facts of some periods; customers and products come from ``base``."""

    def __init__(self, spark: SparkSession, path: str, base, periods: list[str]):
        self.spark, self.path, self.base, self.periods = spark, path, base, periods

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}").withColumn(PERIOD, F.col(PERIOD).cast("string")).filter(
            F.col(PERIOD).isin(self.periods))

    def customers(self) -> DataFrame:
        return self.base.customers()

    def products(self) -> DataFrame:
        return self.base.products()

    def order_items(self) -> DataFrame:
        return self._table("order_items")

    def orders(self, with_items_only: bool = False) -> DataFrame:
        orders = self._table("orders")
        return orders.filter("n_items > 0") if with_items_only else orders

    def reviews(self) -> DataFrame:
        return self._table("reviews")


STATES = {"month": marts.month_people, "category": marts.category_sums, "state": marts.state_sums}


def partial_states(spark: SparkSession, facts: str, base, periods: list[str]) -> dict[str, DataFrame]:
    """The partial states of some periods, from their folders alone."""
    model = StoredFacts(spark, facts, base, periods)
    return {name: partial(model, (PERIOD,)) for name, partial in STATES.items()}


def load_periods(spark: SparkSession, facts: str, base, periods: list[str], states: str) -> None:
    """Compute and store the partial states of ``periods``, in place of what these periods had."""
    for name, df in partial_states(spark, facts, base, periods).items():
        _store(df, f"{states}/{name}")


def merged_marts(spark: SparkSession, states: str) -> dict[str, DataFrame]:
    """The three marts from the stored states of all periods."""
    month, category, state = (spark.read.parquet(f"{states}/{name}") for name in ("month", "category", "state"))
    people = month.groupBy("month", "customer_unique_id").agg(F.sum("rev").alias("rev"), F.sum("n_orders").alias("n_orders"))
    return {
        "month": marts.month_mart(people),
        "category": marts.category_mart(category.groupBy("category").agg(
            *[F.sum(c).alias(c) for c in ("rev", "items", "ssum", "sn")])),
        "state": marts.state_mart(state.groupBy("state").agg(*[F.sum(c).alias(c) for c in marts.STATE_SUMS])),
    }


def marts_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All three marts after two loads of facts stored by year, as rows (mart, name, measures)."""
    base = Commerce(spark, sf_dir)
    root = scratch_path(spark, f"refresh-{uuid.uuid4().hex}")
    write_facts(base, f"{root}/facts", "yyyy")
    # One row per period.
    periods = sorted(r[PERIOD] for r in spark.read.parquet(f"{root}/facts/orders").select(
        F.col(PERIOD).cast("string").alias(PERIOD)).distinct().collect())
    half = len(periods) // 2
    for part in (periods[:half], periods[half:]):
        if part:
            load_periods(spark, f"{root}/facts", base, part, f"{root}/states")
    if not periods:
        load_periods(spark, f"{root}/facts", base, [], f"{root}/states")
    m = merged_marts(spark, f"{root}/states")
    rows = [m["month"].select(F.lit("month").alias("mart"), F.date_format("month", "yyyy-MM-dd").alias("name"), "*").drop("month"),
            m["category"].select(F.lit("category").alias("mart"), F.col("category").alias("name"), "*").drop("category"),
            m["state"].select(F.lit("state").alias("mart"), F.col("state").alias("name"), "*").drop("state")]
    return rows[0].unionByName(rows[1], allowMissingColumns=True).unionByName(rows[2], allowMissingColumns=True)
