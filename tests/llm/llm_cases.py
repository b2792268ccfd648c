"""Shared fixtures: a small documents table with every awkward row."""

import random
import zlib

from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
    # Extra columns whose names the operators use themselves.
    T.StructField("digest", T.StringType()), T.StructField("kept", T.StringType()),
    T.StructField("fp", T.LongType()), T.StructField("__digest", T.StringType()),
    T.StructField("score", T.DoubleType()), T.StructField("rid", T.LongType()),
    T.StructField("text_hash", T.LongType()), T.StructField("tags", T.MapType(T.StringType(), T.StringType())),
])
WORDS = ["river", "stone", "Garden", "über", "être", "niño", "light", "harbour", "seven", "cloud", "paper", "winter"]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(300)) for _ in range(n))


def odd_rows():
    """(doc_id, text): nulls, empties, copies, case copies, near copies, repeated rows, a long text."""
    base = prose(120, 1)
    out = [(i, prose(5 + 7 * i, i)) for i in range(20)]
    out += [(30, base), (31, base), (32, base.upper()), (33, base.replace("stone", "Stone")), (34, base + " end")]
    out += [(40, None), (41, ""), (42, "  \n\t"), (None, None), (None, base), (43, "..."), (44, "é"), (45, "İI ı")]
    out += [(50, prose(60, 9)), (50, prose(60, 9)), (50, prose(61, 10)), (51, prose(60, 9))]
    out += [(60 + i, "copy of one text") for i in range(90)]
    out += [(200, prose(30_000, 77))]
    return out


def docs_frame(spark, rows):
    full = [(d, t, "en", "s", len(t) if t is not None else None, "x", "y", 1, "z", 0.5, 7, 3, {"a": "b"}) for d, t in rows]
    return spark.createDataFrame(full, DOCS)


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def remainder(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def write_tables(spark, folder, docs, benchmark=(), labels=(), pages=()):
    """The tables that the queries read, as the driver lays them out."""
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(benchmark), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(pages), "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
