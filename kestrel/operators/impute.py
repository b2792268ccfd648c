"""Two-level median imputation (group median, then global median)."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kestrel.operators.scalars import with_scalars
from kestrel.operators.slices import SLICE, range_slices, stored


def value_counts(df: DataFrame, cols: list[str], group: list[str]) -> DataFrame:
    """(group, _c, _v, _n): how often each column has each value, nulls left out, in one pass."""
    pairs = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in cols)
    return (df.select(*group, F.expr(f"stack({len(cols)}, {pairs}) AS (_c, _v)")).filter("_v IS NOT NULL")
            .groupBy(*group, "_c", "_v").agg(F.count(F.lit(1)).alias("_n")))


def middle_pieces(sliced: DataFrame, group: list[str]) -> DataFrame:
    """The (group, column, slice) pieces that hold a middle place, with the places before them.

    One row per piece goes through the window, none per value; of each group and
    column at most two pieces come out."""
    own = Window.partitionBy(*group, "_c")
    pieces = sliced.groupBy(*group, "_c", SLICE).agg(F.sum("_n").alias("_t"))
    upto = F.coalesce(F.sum("_t").over(own.orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return (pieces.select(*group, "_c", SLICE, "_t", upto.alias("_before"), F.sum("_t").over(own).alias("_all"))
            .withColumns({"_low": F.expr("(_all - 1) div 2"), "_high": F.expr("_all div 2")})
            .filter("_low BETWEEN _before AND _before + _t - 1 OR _high BETWEEN _before AND _before + _t - 1")
            .drop("_t", "_all"))


def medians(df: DataFrame, cols: list[str], group: list[str] | None = None) -> DataFrame:
    """The exact interpolating median of every column (per group), nulls ignored; columns keep their names.

    Rank selection over range slices: values are counted, the counts are
    written in slices ordered by (group, column, value), slice totals tell which
    slice holds the middle places, and running sums are made inside those
    slices only. No task sees all distinct values of a column, nor of a group;
    without a group the other slices are not even read. The median is the mean of the
    values at the two middle places. The result, one row per group, is stored."""
    keys = group or []
    sliced = range_slices(value_counts(df, cols, keys), [*keys, "_c", "_v"], "medians")
    wanted = middle_pieces(sliced, keys)
    if not keys:  # at most two rows a column
        rows = wanted.collect()
        sliced = sliced.filter(F.col(SLICE).isin([r[SLICE] for r in rows]))
        if rows:
            values = [F.struct(*[F.lit(r[f.name]).cast(f.dataType).alias(f.name) for f in wanted.schema]) for r in rows]
            wanted = df.sparkSession.range(1).select(F.inline(F.array(*values)))
    at = wanted.withColumnsRenamed({c: f"_w{c}" for c in (*keys, "_c", SLICE)})
    same = [F.col(c).eqNullSafe(F.col(f"_w{c}")) for c in (*keys, "_c", SLICE)]
    held = sliced.join(at, reduce(and_, same)).select(*keys, "_c", SLICE, "_v", "_n", "_before", "_low", "_high")
    inside = Window.partitionBy(*keys, "_c", SLICE).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    placed = held.withColumn("_upto", F.col("_before") + F.sum("_n").over(inside))

    def middle(c: str) -> Column:
        reached = [F.min(F.when((F.col("_c") == c) & (F.col("_upto") > F.col(place)), F.col("_v"))) for place in ("_low", "_high")]
        return ((reached[0] + reached[1]) / 2).alias(c)

    return stored(placed.groupBy(*keys).agg(*[middle(c) for c in cols]), "medians")


def impute_group_then_global(df: DataFrame, group: str, cols: list[str],
                             keep_null_group_values: bool = False) -> DataFrame:
    """Fill NULLs with the group median, then with the global median.

    Reference semantics (grouped ``transform`` drops NULL group keys): rows
    whose group is NULL lose even their existing value at the first step, and
    the global median is taken over the already group-filled column, so it
    sees only rows with a group. Set ``keep_null_group_values`` to keep them.

    Medians are exact; a fractional median is rounded HALF_UP when cast back to
    an integer column (:func:`medians`). The per-group medians (one row per group) are
    joined back; the global medians are a scalar subquery.
    """
    g = F.col(group)
    med_g = medians(df.filter(g.isNotNull()), cols, [group]).withColumnsRenamed({c: f"_gm_{c}" for c in cols})
    j = df.join(med_g, group, "left")
    for c in cols:
        filled = F.coalesce(F.col(c), F.col(f"_gm_{c}"))
        j = j.withColumn(c, F.when(g.isNotNull(), filled).otherwise(
            F.col(c) if keep_null_group_values else F.lit(None)).cast("double"))
    j = with_scalars(j, medians(j, cols).withColumnsRenamed({c: f"_am_{c}" for c in cols}))
    out_types = {f.name: f.dataType for f in df.schema.fields}
    for c in cols:
        v = F.coalesce(F.col(c), F.col(f"_am_{c}"))
        t = out_types[c].simpleString()
        if t in ("int", "bigint", "smallint", "tinyint"):
            v = F.round(v, 0).cast(t)
        j = j.withColumn(c, v)
    return j.select(*df.columns)
