"""Listing of the tables of a session with their sizes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from kestrel.sources.tables import TABLES, table_path

LISTING = "table_name string, columns int, row_count long"


def footer_session(spark: SparkSession) -> SparkSession:
    """A child session whose Parquet tables answer COUNT(*) from the files' footers, without reading a row."""
    child = spark.newSession()
    child.conf.set("spark.sql.session.timeZone", "UTC")
    child.conf.set("spark.sql.sources.useV1SourceList", "")
    child.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return child


def register_tables(session: SparkSession, sf_dir: str, names: tuple[str, ...] = TABLES) -> None:
    for name in names:
        session.read.parquet(table_path(sf_dir, name)).createOrReplaceTempView(name)


def list_catalog(session: SparkSession) -> DataFrame:
    """table_name, columns, row_count of every table and view that the session's current catalog lists.

    The listing is the catalog's, so a view registered later appears in the next
    one; the counts are one aggregate per table, and for Parquet tables of a
    :func:`footer_session` come from the footers alone."""
    names = sorted(t.name for t in session.catalog.listTables())
    if not names:
        return session.createDataFrame([], LISTING)
    counts = []
    for name in names:
        quoted, text = "`" + name.replace("`", "``") + "`", name.replace("\\", "\\\\").replace("'", "\\'")
        counts.append(session.sql(f"SELECT '{text}' AS table_name, {len(session.table(quoted).columns)} AS columns, "
                                  f"count(*) AS row_count FROM {quoted}"))
    return reduce(DataFrame.unionByName, counts)


def catalog_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given tables as the catalog of a session of their own lists them."""
    session = footer_session(spark)
    register_tables(session, sf_dir)
    return list_catalog(session)
