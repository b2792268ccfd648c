"""Golden-set scoring: join answers to cases, score substring expectations, summarise."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.functions.text import normalize_answer

# Fixed value: blended USD per 1M tokens used by the evaluation summary.
EVAL_COST_PER_1M = 0.075


def score_cases(golden: DataFrame, answers: DataFrame) -> DataFrame:
    """One row per golden case: missing expectations, passed, slow, error.

    golden: id, question, contains array<string>, max_latency_ms
    answers: id, answer, latency_ms, prompt_tokens, completion_tokens, error
    A case without an answer row counts as an error. ``slow`` flags a latency
    above the case budget and never fails the case."""
    a = answers.select("id", "answer", "latency_ms", "prompt_tokens", "completion_tokens", "error")
    j = golden.join(a, "id", "left")
    errored = F.col("error").isNotNull() | F.col("latency_ms").isNull()
    expected = F.coalesce(F.col("contains"), F.array().cast("array<string>"))
    hay = normalize_answer(F.coalesce(F.col("answer"), F.lit("")))
    missing = F.filter(expected, lambda e: ~F.contains(hay, normalize_answer(e)))
    return j.select(
        "id", "question",
        F.when(errored, F.lit(False)).otherwise(F.size(missing) == 0).alias("passed"),
        F.when(errored, F.lit("")).otherwise(F.coalesce(F.col("answer"), F.lit(""))).alias("answer"),
        F.coalesce(F.col("latency_ms"), F.lit(0)).cast("long").alias("latency_ms"),
        F.when(errored, F.lit(0)).otherwise(F.coalesce(F.col("prompt_tokens"), F.lit(0))).cast("long").alias("prompt_tokens"),
        F.when(errored, F.lit(0)).otherwise(F.coalesce(F.col("completion_tokens"), F.lit(0))).cast("long").alias("completion_tokens"),
        F.when(errored, expected).otherwise(missing).alias("missing"),
        (~errored & F.col("max_latency_ms").isNotNull() & (F.col("max_latency_ms") > 0)
         & (F.col("latency_ms") > F.col("max_latency_ms"))).alias("slow"),
        F.when(F.col("latency_ms").isNull() & F.col("error").isNull(), F.lit("no answer"))
         .otherwise(F.col("error")).alias("error"),
    )


def summarize(scored: DataFrame) -> DataFrame:
    """passed, n, pass_pct (1 decimal), slow, avg_latency_ms (integer floor), total_tokens, cost_usd."""
    a = scored.agg(F.count_if(F.col("passed")).alias("passed"), F.count(F.lit(1)).alias("n"),
                   F.count_if(F.col("slow")).alias("slow"),
                   F.coalesce(F.sum("latency_ms"), F.lit(0)).alias("_lat"),
                   F.coalesce(F.sum(F.col("prompt_tokens") + F.col("completion_tokens")), F.lit(0)).alias("total_tokens"))
    pct = F.when(F.col("n") > 0, F.round(F.col("passed").cast("double") / F.col("n") * 100, 1)).otherwise(F.lit(0.0))
    avg = F.when(F.col("n") > 0, F.floor(F.col("_lat") / F.col("n"))).otherwise(F.lit(0)).cast("long")
    return a.select("passed", "n", pct.alias("pass_pct"), "slow", avg.alias("avg_latency_ms"),
                    F.col("total_tokens").cast("long").alias("total_tokens"),
                    (F.col("total_tokens").cast("double") / 1_000_000 * EVAL_COST_PER_1M).alias("cost_usd"))


def select_cases(golden: DataFrame, ids: list[str] | None) -> DataFrame:
    """The ``--only`` filter: keep the listed case ids (all when None)."""
    return golden if not ids else golden.filter(F.col("id").isin(ids))
