"""Exact dedup with a heavy-hitter split (native DataFrame functions only).

Texts are equal when identical after lower-casing A-Z; a null text counts as
empty. Of equal texts the row with the largest doc_id stays; a null doc_id is
smaller than any other, and of rows that tie in text and doc_id exactly one
stays.

1. Row id, doc_id and SHA-256 digest of every row are written once: the
   text is read once and the rest works on this narrow table.
2. Misra-Gries summaries (Spark's ``approx_top_k``, a frequent-items sketch
   with map-side partial summaries) propose frequent digests. They are kept
   per hash bucket of the digest, so no single task merges all of them.
3. The proposals are counted exactly (map-side partial counts of few keys);
   those that are frequent indeed are the winners: at most
   ``buckets * per_bucket`` rows, so that they can be broadcast.
4. Rows of a winner are decided where they lie, without a shuffle. All other
   digests are rare by construction and go through an ordinary shuffle.

What the summaries propose changes only the route a row takes, never the
result. Empty input gives an empty result; extra columns are ignored by
``decide`` and passed through by ``drop_duplicates``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kestrel.llm.common import fold_case, fresh, materialize

KEY_BYTES = 128             # of a (digest, doc_id) pair in a broadcast table, generously
BROADCAST_BYTES = 64 << 20


def digest(col):
    return F.sha2(fold_case(col), 256)


def frequent_digests(rows: DataFrame, buckets: int = 64, per_bucket: int = 16, tracked: int = 1024,
                     min_rows: int = 64) -> DataFrame:
    """Verified heavy hitters of ``rows(rid, doc_id, digest)``.

    One row per digest that occurs at least ``min_rows`` times and that the
    Misra-Gries summary of its bucket ranks among the first ``per_bucket``:
    digest, hot_keep struct(doc_id, rid), hot_size."""
    proposed = (
        rows.groupBy(F.pmod(F.xxhash64("digest"), F.lit(buckets)).alias("bucket"))
        .agg(F.expr(f"approx_top_k(digest, {per_bucket}, {tracked})").alias("top"))
        .select(F.explode("top").alias("t"))
        .filter(F.col("t.count") >= min_rows)
        .select(F.col("t.item").alias("digest"))
    )
    return (
        rows.join(F.broadcast(proposed), "digest")
        .groupBy("digest")
        .agg(F.max(F.struct("doc_id", "rid")).alias("hot_keep"), F.count("*").alias("hot_size"))
        .filter(F.col("hot_size") >= min_rows)
    )


def decide(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **split) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    keep_id is the doc_id of the row that stays, group_size the number of rows
    with an equal text."""
    rows = materialize(
        docs.select(F.col(id_col).alias("doc_id"), digest(F.col(text_col)).alias("digest"))
        .withColumn("rid", F.monotonically_increasing_id()),
        "digests",
    )
    # At most buckets * per_bucket rows (see above), whatever the input.
    hot = F.broadcast(materialize(frequent_digests(rows, **split), "frequent"))
    routed = rows.join(hot, "digest", "left")
    group = Window.partitionBy("digest")
    cold = (
        routed.filter(F.col("hot_size").isNull())
        .select("doc_id", "digest", "rid",
                F.max(F.struct("doc_id", "rid")).over(group).alias("keep"),
                F.count("*").over(group).alias("group_size"))
    )
    warm = (
        routed.filter(F.col("hot_size").isNotNull())
        .select("doc_id", "digest", "rid", F.col("hot_keep").alias("keep"),
                F.col("hot_size").alias("group_size"))
    )
    return cold.unionByName(warm).select(
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        "group_size",
        (F.col("rid") == F.col("keep.rid")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    broadcast_bytes: int = BROADCAST_BYTES, **split) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Rows are removed by an anti-join against the losing (digest, doc_id)
    pairs. They are counted, and broadcast if they take ``broadcast_bytes`` or
    less, so that no text is shuffled; beyond that the join shuffles. Rows
    that tie with a winner in text and doc_id share its key; only such keys
    (normally none) take the grouped path that leaves one row of each."""
    verdicts = decide(docs, id_col, text_col, **split).groupBy("text_sha256", "doc_id").agg(
        F.max("kept").alias("wins"), F.count("*").alias("n"))
    keys = materialize(verdicts.filter(~F.col("wins") | (F.col("n") > 1)), "losers")
    name = fresh(docs, "digest")
    rows = docs.withColumn(name, digest(F.col(text_col)))

    def same(other: DataFrame):
        return (rows[name] == other["text_sha256"]) & rows[id_col].eqNullSafe(other["doc_id"])

    losers = keys.filter(~F.col("wins"))
    if losers.count() * KEY_BYTES <= broadcast_bytes:
        losers = F.broadcast(losers)
    tied = keys.filter("wins")
    out = rows.join(losers, same(losers), "left_anti")
    if not tied.isEmpty():
        repeated = rows.join(tied, same(tied), "left_semi")
        cols = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
        one = repeated.groupBy(name, F.col(id_col).alias(fresh(docs, "id"))).agg(
            F.max_by(cols, F.xxhash64(F.to_json(cols))).alias("r")).select("r.*")
        out = out.join(tied, (out[name] == tied["text_sha256"]) & out[id_col].eqNullSafe(tied["doc_id"]), "left_anti")
        out = out.unionByName(one)
    return out.drop(name)
