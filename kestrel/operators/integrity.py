"""Referential integrity, key checks, profiles and load validation."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.operators.scalars import one_row


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _s(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


@dataclass(frozen=True)
class ForeignKey:
    child: str
    column: str
    parent: str
    parent_column: str


# The declared foreign keys of the clean tables.
FOREIGN_KEYS = (
    ForeignKey("orders", "customer_id", "customers", "customer_id"),
    ForeignKey("order_items", "order_id", "orders", "order_id"),
    ForeignKey("order_items", "product_id", "products", "product_id"),
    ForeignKey("order_items", "seller_id", "sellers", "seller_id"),
    ForeignKey("order_payments", "order_id", "orders", "order_id"),
    ForeignKey("order_reviews", "order_id", "orders", "order_id"),
)


def semi_filter(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Keep child rows whose ``column`` exists in the parent (EXISTS / left semi)."""
    keys = parent.selectExpr(f"{_q(parent_column)} AS {_q(column)}")
    return child.join(keys, column, "left_semi")


def fk_cascade(tables: dict[str, DataFrame], orders: DataFrame | None = None) -> dict[str, DataFrame]:
    """Defensive FK filtering, parents first: orders by customers; items by the
    filtered orders, products and sellers; payments and reviews by the filtered
    orders. ``orders`` gives the filtered orders, already computed."""
    t = dict(tables)
    t["orders"] = orders if orders is not None else semi_filter(t["orders"], "customer_id", t["customers"], "customer_id")
    for fk in FOREIGN_KEYS:
        if fk.child != "orders":
            t[fk.child] = semi_filter(t[fk.child], fk.column, t[fk.parent], fk.parent_column)
    return t


def fk_report(tables: dict[str, DataFrame], fks=FOREIGN_KEYS) -> DataFrame:
    """child_table, child_column, parent_table, parent_column, orphan_rows (rows whose key is not null and has no parent).

    One exchange per key domain: the keys of a parent and of all tables that
    refer to it are tagged, united and grouped once, combined map-side, so that a
    key on a third of all rows is one counter per map task."""
    domains: dict[tuple[str, str], list[ForeignKey]] = {}
    for fk in fks:
        domains.setdefault((fk.parent, fk.parent_column), []).append(fk)
    parts = []
    for (parent, column), children in domains.items():
        keyed = [(tables[parent], column), *[(tables[fk.child], fk.column) for fk in children]]
        tagged = [df.selectExpr(f"{_q(c)} AS _k", f"{tag} AS _tag").filter("_k IS NOT NULL") for tag, (df, c) in enumerate(keyed)]
        counts = [F.expr(f"count_if(_tag = {tag}) AS _n{tag}") for tag in range(1, len(keyed))]
        per_key = reduce(DataFrame.unionAll, tagged).groupBy("_k").agg(F.expr("bool_or(_tag = 0) AS _known"), *counts)
        orphans = per_key.agg(*[F.expr(f"CAST(coalesce(sum(IF(_known, 0, _n{tag})), 0) AS BIGINT) AS _n{tag}")
                                for tag in range(1, len(keyed))])
        rows = ", ".join(f"{_s(fk.child)}, {_s(fk.column)}, _n{tag}" for tag, fk in enumerate(children, 1))
        parts.append(orphans.selectExpr(f"stack({len(children)}, {rows}) AS (child_table, child_column, orphan_rows)").selectExpr(
            "child_table", "child_column", f"{_s(parent)} AS parent_table", f"{_s(column)} AS parent_column", "orphan_rows"))
    return reduce(DataFrame.unionByName, parts)


def _fingerprints(df: DataFrame) -> DataFrame:
    """_h1, _h2 (a 96-bit fingerprint of a row), _n (its rows), _nulls (their null cells), combined map-side."""
    refs = ", ".join(_q(c) for c in df.columns)
    nulls = " + ".join(f"CAST({_q(c)} IS NULL AS BIGINT)" for c in df.columns) or "0L"
    return (df.selectExpr(f"xxhash64({refs}) AS _h1", f"hash({refs}) AS _h2", f"{nulls} AS _nulls")
            .groupBy("_h1", "_h2").agg(F.expr("count(1) AS _n"), F.expr("sum(_nulls) AS _nulls")))


def duplicate_rows(df: DataFrame, prints: DataFrame | None = None) -> DataFrame:
    """One row: full-row duplicates beyond the first, exact.

    Phase 1 shuffles only a 96-bit fingerprint per row (a 64-bit and a
    32-bit hash) to find fingerprints seen more than once; phase 2 groups
    the full rows of just those candidates, so hash collisions cannot
    miscount. With few duplicates, phase 2 touches a sliver of the table.
    ``prints`` gives the fingerprints of :func:`_fingerprints`, already planned."""
    refs = ", ".join(_q(c) for c in df.columns)
    prints = _fingerprints(df) if prints is None else prints
    # Naming _nulls keeps it in this plan, so that Spark reuses the exchange of whoever else reads ``prints``.
    repeated = prints.filter("_n > 1 AND _nulls >= 0").select("_h1", "_h2")
    rows = df.selectExpr(f"xxhash64({refs}) AS _h1", f"hash({refs}) AS _h2", "*")
    candidates = rows.join(repeated, ["_h1", "_h2"], "left_semi")
    # Grouping by one struct of all columns equals grouping by the columns
    # (NULLs compare equal in both).
    return (candidates.groupBy(F.expr(f"struct({refs}) AS _row")).agg(F.expr("count(1) AS _c"))
            .agg(F.expr("CAST(coalesce(sum(_c - 1), 0) AS BIGINT) AS duplicate_rows")))


def profile(df: DataFrame, name: str) -> DataFrame:
    """table, rows, cols, null_cells, duplicate_rows (full-row duplicates beyond the first).

    Rows and null cells are summed from the fingerprint groups that
    :func:`duplicate_rows` uses, so one scan serves all three; a second one reads
    the rows of repeated fingerprints."""
    prints = _fingerprints(df)
    base = prints.agg(F.expr("CAST(coalesce(sum(_n), 0) AS BIGINT) AS rows"),
                      F.expr("CAST(coalesce(sum(_nulls), 0) AS BIGINT) AS null_cells"))
    return one_row(base, duplicate_rows(df, prints)).selectExpr(
        f"{_s(name)} AS table_name", "rows", f"{len(df.columns)} AS cols", "null_cells", "duplicate_rows")


def pk_check(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """table, key_rows, distinct_keys, duplicate_keys, excess_rows, null_key_rows."""
    k = df.select(*keys)
    null_key = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in keys])
    per_key = k.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    stats = per_key.agg(F.count(F.lit(1)).alias("distinct_keys"),
                        F.count_if(F.col("n") > 1).alias("duplicate_keys"),
                        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("excess_rows"))
    base = k.agg(F.count(F.lit(1)).alias("key_rows"), F.count_if(null_key).alias("null_key_rows"))
    return one_row(base, stats).selectExpr(f"{_s(name)} AS table_name", "key_rows", "distinct_keys",
                                           "duplicate_keys", "excess_rows", "null_key_rows")


def length_check(df: DataFrame, limits: dict[str, int], name: str) -> DataFrame:
    """Rows whose text exceeds a declared VARCHAR(n) length, per column."""
    aggs = [F.count_if(F.length(F.col(c)) > n).alias(c) for c, n in limits.items()]
    row = df.agg(*aggs)
    stacked = F.expr("stack({n}, {pairs}) as (column_name, too_long_rows)".format(
        n=len(limits), pairs=", ".join(f"'{c}', `{c}`" for c in limits)))
    return row.select(F.lit(name).alias("table_name"), stacked)


def validate_counts(spark: SparkSession, expected: DataFrame, actual: DataFrame) -> DataFrame:
    """table_name, expected, actual, status OK/MISMATCH; reports, never raises."""
    j = expected.withColumnRenamed("row_count", "expected").join(
        actual.withColumnRenamed("row_count", "actual"), "table_name", "full")
    status = F.when(F.col("expected") == F.col("actual"), "OK").otherwise("MISMATCH")
    return j.select("table_name", "expected", "actual", status.alias("status"))
