"""Sequence numbers that go on over appended parts of a log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kestrel.operators.logs import assign_seq
from kestrel.operators.merge import create_store, merge_delta, read_store


class NumberedLog:
    """A stored log whose rows are numbered per session from 1, part after part.

    ``<path>/marks`` holds one row per session, its highest number, in hash
    buckets (``operators/merge.py``); ``<path>/lines/_part=<k>`` the numbered rows. A
    part costs its own rows and the mark buckets it touches, whatever was
    appended before. Rows are ranked inside the part in time order
    (``assign_seq``, which spreads a huge session over tasks) and start after
    the session's mark. The rows are written before the marks and a part that
    is already stored is not numbered anew, so a part appended again, or after
    a job that died between the two, changes nothing. One writer; a null
    session is one of its own."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, session: str, ts: str, tiebreak: str, buckets: int = 64):
        self.spark, self.path, self.session, self.ts, self.tiebreak, self.buckets = spark, path, session, ts, tiebreak, buckets
        self.numbered = T.StructType([*schema.fields, T.StructField("seq", T.LongType())])
        self.marks = T.StructType([schema[session], T.StructField("mark", T.LongType())])

    def create(self) -> NumberedLog:
        """Start an empty log at the path, in place of any that is there."""
        create_store(self.spark.createDataFrame([], self.marks), f"{self.path}/marks", [self.session], "mark", self.buckets)
        self.spark.createDataFrame([], self.numbered).write.mode("overwrite").parquet(f"{self.path}/lines")
        return self

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.numbered).parquet(f"{self.path}/lines").select(*self.numbered.names)

    def _part(self, part: int) -> DataFrame:
        """The stored rows of a part, as the folder is listed now."""
        schema = T.StructType([*self.numbered.fields, T.StructField("_part", T.LongType())])
        return self.spark.read.schema(schema).parquet(f"{self.path}/lines").filter(F.col("_part") == part)

    def append(self, part: int, rows: DataFrame) -> None:
        if self._part(part).isEmpty():
            ranked = assign_seq(rows.select(*self.numbered.names[:-1]), self.session, self.ts, self.tiebreak)
            marks = read_store(self.spark, f"{self.path}/marks", self.marks).select(F.col(self.session).alias("_of"), "mark")
            after = ranked.join(marks, ranked[self.session].eqNullSafe(marks["_of"]), "left").withColumn(
                "seq", F.col("seq") + F.coalesce("mark", F.lit(0)))
            after.select(*self.numbered.names).write.mode("overwrite").parquet(f"{self.path}/lines/_part={part}")
        marks = self._part(part).groupBy(self.session).agg(F.max("seq").alias("mark"))
        merge_delta(marks, f"{self.path}/marks", [self.session], "mark", self.buckets)
