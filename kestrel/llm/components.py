"""Connected components of a link table, by alternating star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm.common import materialize


def _smallest_neighbour(links: DataFrame) -> DataFrame:
    """Per node, the smallest node among itself and its neighbours (map-side combined)."""
    return links.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))


def _large_star(links: DataFrame) -> DataFrame:
    """Larger neighbours of u are linked to the smallest node around u."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return (both.join(_smallest_neighbour(both), "u").filter("v > u")
            .select(F.col("v").alias("u"), F.col("m").alias("v")))


def _small_star(links: DataFrame) -> DataFrame:
    """u and its smaller neighbours are linked to the smallest of them."""
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v")
    low = _smallest_neighbour(down)
    return (down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v"))))


def connected_components(links: DataFrame, label: str = "components") -> DataFrame:
    """(node, root) for every node that has a link; root is the component's smallest node.

    ``links`` has two columns of one ordered type. Each round writes the links
    anew; the number of rounds grows with the logarithm of the longest chain.
    A node with very many links is split by Spark's skew join (one row per
    node on the other side) and its minimum is combined map-side."""
    a, b = links.columns
    now = materialize(
        links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v").distinct(), label)
    before = None
    while True:
        # Two numbers tell whether a round changed anything.
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = state
        now = materialize(_small_star(_large_star(now)).filter("u <> v").distinct(), label)
