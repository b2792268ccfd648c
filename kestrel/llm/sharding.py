"""Contiguous shards of near equal bytes from global prefix sums.

Law ``bytes``: in doc_id order (null first; ties by size, checksum and input
position), document d with b bytes before it and size s goes to the shard in
which its middle b + s/2 falls when the total is cut at equal targets. So each
shard is a contiguous run, and its bytes differ from the target by at most the
size of one document at either end.

Only narrow rows (doc_id, size, checksum) are range-partitioned by doc_id and
written once with the number of their slice. Slice totals (one row per
partition) give every slice its byte and row offset; running sums inside a
slice do the rest, so no task ever sees more than one slice. The size is the
UTF-8 bytes plus 1 (null: 1; checksum of null: that of no bytes, 0).
An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kestrel.llm.common import materialize


def assign_shards(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row of ``docs``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("rid"),
    )
    order = ["doc_id", "size", "text_crc32", "rid"]
    rows = materialize(
        rows.repartitionByRange(*order).withColumn("slice", F.spark_partition_id()), "shard-slices")

    # One row per slice, that is at most spark.sql.shuffle.partitions rows.
    totals = rows.groupBy("slice").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    before = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    offsets = materialize(totals.select(
        "slice",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(everything).alias("total"),
    ), "shard-offsets")

    inside = Window.partitionBy("slice").orderBy(*order)
    placed = (
        rows.withColumn("upto", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("nth", F.row_number().over(inside))
        .join(F.broadcast(offsets), "slice")
        .withColumn("shard", F.expr(
            f"CAST(((2 * (bytes_before + upto) - size) * {shards}) DIV (2 * total) AS INT)"))
        .withColumn("place", F.col("rows_before") + F.col("nth") - 1)
    )
    # At most ``shards`` rows per slice: first place of each shard.
    firsts = placed.groupBy("shard").agg(F.min("place").alias("first"))
    return placed.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("place") - F.col("first")).alias("slot"))
