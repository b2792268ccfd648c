"""Named queries: (spark, sf_dir) -> DataFrame, one per operator family.

Outputs are normalised for cross-engine comparison: exact decimals become
doubles (converted once, after exact arithmetic), dates become ISO text and
timestamps ``yyyy-MM-dd HH:mm:ss`` text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from kestrel.session import ensure_checkpoint_dir
from kestrel.sources.model import Commerce

QueryFn = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, QueryFn] = {}


def normalize_output(df: DataFrame) -> DataFrame:
    """One projection (a single ``selectExpr``) converting output types."""
    exprs = []
    for f in df.schema.fields:
        ref = "`" + f.name.replace("`", "``") + "`"
        if isinstance(f.dataType, T.DecimalType):
            e = f"CAST({ref} AS DOUBLE)"
        elif isinstance(f.dataType, T.DateType):
            e = f"date_format({ref}, 'yyyy-MM-dd')"
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            e = f"date_format({ref}, 'yyyy-MM-dd HH:mm:ss')"
        else:
            e = ref
        exprs.append(f"{e} AS {ref}")
    return df.selectExpr(*exprs)


def register(name: str):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            # Zone-less timestamp maths and stream event times assume UTC.
            if spark.conf.get("spark.sql.session.timeZone", "UTC") != "UTC":
                spark.conf.set("spark.sql.session.timeZone", "UTC")
            ensure_checkpoint_dir(spark)
            return normalize_output(fn(spark, sf_dir))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        _REGISTRY[name] = run
        return fn
    return deco


def commerce_query(name: str, plan: Callable[[Commerce], DataFrame]) -> None:
    """Register a plan over the commerce model."""
    register(name)(lambda spark, d: plan(Commerce(spark, d)))


def all_queries() -> dict[str, QueryFn]:
    # Importing the query modules fills the registry.
    from kestrel.plans import queries  # noqa: F401
    return dict(_REGISTRY)
