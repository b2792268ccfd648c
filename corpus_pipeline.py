"""A corpus pipeline over ``documents``: five stages, each one operator of ``kestrel.llm``.

Every stage gets all rows that its predecessor kept, is written as Parquet in
the shared folder and reread by the next. All but the last return the columns
of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.llm import decontamination, exact_dedup, packing, simhash, toxicity
from kestrel.llm.common import fresh, materialize, table
from kestrel.llm.queries import tokenizer_path, toxicity_model
from kestrel.session import ensure_checkpoint_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is 0.5 or more go."""
    model = toxicity_model(docs, table(spark, sf_dir, "labels"))
    score = fresh(docs, "score")
    return docs.withColumn(score, toxicity.score(F.col("text"), model)).filter(F.col(score) < 0.5).drop(score)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact_dedup.drop_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash component (4-word shingles, 4 bits) the row with the smallest doc_id stays."""
    return simhash.drop_near_duplicates(docs, shingle=4, max_bits=4)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 10 or more words of a benchmark item are cut out of the texts; n_chars follows the text."""
    cut = decontamination.remove_contamination(docs, table(spark, sf_dir, "benchmark"), window=10)
    if "n_chars" not in cut.columns:
        return cut
    return cut.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text")).cast(
        docs.schema["n_chars"].dataType))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sum-of-squares packing into sequences of 2048 tokens."""
    return packing.pack_documents(docs, tokenizer_path(), end_id=0, capacity=2048)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", remove_benchmark),
    ("best_fit_packing", pack_sequences),
]

# The classifier, the fingerprints and the tokenizer are beyond SQL; tests/llm compares run() with a
# brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    ensure_checkpoint_dir(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
