"""Operators over operational logs: sessions, question keys, requests, tokens, rate limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kestrel.functions.text import question_key
from kestrel.operators.topk import top_n
from kestrel.session import cut_lineage

# ---- sessions ---------------------------------------------------------------
# Fixed value: one turn is a user line plus an assistant line.
LINES_PER_TURN = 2
DEFAULT_TURNS = 6


GROUP_LIMIT_CONF = "spark.sql.optimizer.windowGroupLimitThreshold"
TRIM_SALTS = 32


def newest_rows(df: DataFrame, group: list[str], order: list[Column], n: int, salt: Column) -> DataFrame:
    """The first ``n`` rows of every group by ``order``.

    ``row_number() <= n`` plans as WindowGroupLimit, whose partial stage cuts
    every group map-side, as long as ``n`` is within the planner's threshold.
    Beyond it a huge group would be sorted whole in one task, so the rows are
    first cut to ``n`` per group and salt, which spreads the group over
    ``TRIM_SALTS`` tasks; the final cut then sees at most salts x n rows."""
    def cut(rows: DataFrame, keys: list) -> DataFrame:
        rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        return rows.withColumn("_rn", rn).filter(F.col("_rn") <= n).drop("_rn")

    if n > int(df.sparkSession.conf.get(GROUP_LIMIT_CONF, "1000")):
        df = cut(df.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(TRIM_SALTS))), [*group, "_salt"]).drop("_salt")
    return cut(df, group)


def last_n_lines(lines: DataFrame, session: str, seq: str, n: int) -> DataFrame:
    """The last ``n`` lines of every session (by ``seq``), as stored after pruning."""
    return newest_rows(lines, [session], [F.col(seq).desc()], n, F.col(seq))


def next_seq(lines: DataFrame, session: str, seq: str) -> DataFrame:
    """Next sequence number per session: max + 1 (1 for an empty session)."""
    return lines.groupBy(session).agg((F.coalesce(F.max(seq), F.lit(0)) + 1).alias("next_seq"))


def running_sum(log: DataFrame, group: str, order: list[str], weight: Column, out: str) -> DataFrame:
    """``log`` with the sum of ``weight`` over the rows of its group up to the row itself, skew-safe.

    A window per group would sort a huge group in one task. Instead the rows
    are range-partitioned on (group, order), which cuts a huge group into
    consecutive slices, and written once with the number of their slice: the
    slice bounds are sampled, so they must not be drawn twice. Sums inside each
    (slice, group) piece are then offset by the totals of the group's earlier
    slices (one row per piece)."""
    keys = [F.col(c) for c in (group, *order)]
    sliced = cut_lineage(log.withColumn("_weight", weight).repartitionByRange(*keys)
                         .withColumn("_slice", F.spark_partition_id()))
    inside = Window.partitionBy("_slice", group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("_group").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (sliced.groupBy("_slice", F.col(group).alias("_group")).agg(F.sum("_weight").alias("_n"))
               .withColumn("_off", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
               .select(F.col("_slice").alias("_at"), "_group", "_off"))
    local = sliced.withColumn("_upto", F.sum("_weight").over(inside))
    same = (local["_slice"] == offsets["_at"]) & local[group].eqNullSafe(offsets["_group"])
    return local.join(offsets, same).withColumn(out, F.col("_off") + F.col("_upto")).drop(
        "_weight", "_slice", "_upto", "_at", "_group", "_off")


def assign_seq(log: DataFrame, session: str, ts: str, tiebreak: str) -> DataFrame:
    """Dense 1-based sequence numbers per session in time order (a null session is one of its own)."""
    return running_sum(log, session, [ts, tiebreak], F.lit(1).cast("long"), "seq")


def build_prompts(lines: DataFrame, questions: DataFrame, session: str, seq: str,
                  line: str, question: str, n: int) -> DataFrame:
    """Prompt text per question: the last ``n`` stored lines before it, then the question.

    ``Prior conversation:\\n<lines>\\n\\nCurrent question: <q>``; a question with
    no history stays plain. Sequence numbers may have gaps. Lines get their
    rank in the session and questions the number of lines before them
    (:func:`running_sum` over the narrow keys); a question then asks for the ``n``
    ranks before it, narrow rows that spread over all tasks, and the texts are
    joined to those alone.
    """
    narrow = lines.select(F.col(session).alias("_s"), F.col(seq).alias("_q"), F.lit(1).alias("_is_line"), F.col(line).alias("_line"))
    asked = questions.select(F.col(session).alias("_s"), F.col(seq).alias("_q"), F.lit(0).alias("_is_line"),
                             F.lit(None).cast("string").alias("_line")).distinct()
    # A question sorts before a line of the same number: only earlier lines count.
    ranked = running_sum(narrow.unionByName(asked), "_s", ["_q", "_is_line", "_line"], F.col("_is_line").cast("long"), "_rank")
    wanted = ranked.filter("_is_line = 0 AND _rank > 0").select(
        F.col("_s").alias("_ws"), F.col("_q").alias("_wq"),
        F.explode(F.sequence(F.greatest(F.col("_rank") - n + 1, F.lit(1)), F.col("_rank"))).alias("_wr"))
    stored = ranked.filter("_is_line = 1")
    hist = (wanted.join(stored, wanted["_ws"].eqNullSafe(stored["_s"]) & (wanted["_wr"] == stored["_rank"]))
            .groupBy("_ws", "_wq").agg(F.array_sort(F.collect_list(F.struct("_wr", "_line"))).alias("_h")))
    q = questions.join(hist, questions[session].eqNullSafe(hist["_ws"]) & (questions[seq] == hist["_wq"]), "left")
    prior = F.array_join(F.transform(F.col("_h"), lambda x: x["_line"]), "\n")
    prompt = F.when(F.col("_h").isNull(), F.col(question)).otherwise(
        F.concat(F.lit("Prior conversation:\n"), prior, F.lit("\n\nCurrent question: "), F.col(question)))
    return q.select(questions[session], questions[seq], prompt.alias("prompt"))


def forget_sessions(lines: DataFrame, forget: DataFrame, session: str) -> DataFrame:
    """Right-to-erasure: drop every line of the listed sessions (left anti join)."""
    return lines.join(forget.select(session).distinct(), session, "left_anti")


# ---- question keys and the response cache -------------------------------------
def with_question_key(log: DataFrame, question: str, out: str = "key") -> DataFrame:
    return log.withColumn(out, question_key(F.col(question)))


def cache_effectiveness(log: DataFrame, key: str) -> DataFrame:
    """A repeat of a normalised key is a hit, its first sighting a miss.

    Grouped per key (partial aggregation), so a key asked a billion times is
    one counter per map task, never a sorted group."""
    per_key = log.groupBy(key).agg(F.expr("count(1) AS n"))
    a = per_key.agg(F.expr("CAST(coalesce(sum(n), 0) AS BIGINT) AS questions"), F.expr("count(1) AS misses"))
    return a.selectExpr(
        "questions", "questions - misses AS hits", "misses",
        "CASE WHEN questions > 0 THEN CAST(questions - misses AS DOUBLE) / CAST(questions AS DOUBLE) "
        "ELSE 0.0D END AS hit_rate")


def recent_keys(log: DataFrame, key: str, seq: str, n: int) -> DataFrame:
    """The ``n`` most recently used keys (last access per key, newest first)."""
    last = log.groupBy(key).agg(F.max(seq).alias("last_access"))
    return top_n(last, [F.col("last_access").desc()], n, [key])


def latest_per_key(log: DataFrame, key: str, seq: str, values: list[str]) -> DataFrame:
    """Upsert semantics: the value carried by the latest ``seq`` of each key."""
    latest = F.max_by(F.struct(*[F.col(v) for v in values]), F.col(seq))
    return log.groupBy(key).agg(latest.alias("_v"), F.max(seq).alias(seq)).select(key, seq, "_v.*")


# ---- requests -------------------------------------------------------------------
def request_metrics(log: DataFrame) -> DataFrame:
    """Totals, failures, token sums, cache hits/misses, guardrail blocks, SQL errors."""
    aggs = [
        "count(1) AS queries_total",
        "count_if(failed) AS queries_failed",
        "CAST(coalesce(sum(prompt_tokens), 0) AS BIGINT) AS prompt_tokens_total",
        "CAST(coalesce(sum(completion_tokens), 0) AS BIGINT) AS completion_tokens_total",
        "count_if(cached) AS cache_hits",
        "count_if(NOT cached) AS cache_misses",
        "count_if(blocked) AS guardrail_blocks",
        "count_if(sql_error) AS sql_errors",
    ]
    return log.agg(*[F.expr(a) for a in aggs]).selectExpr(
        "*", "prompt_tokens_total + completion_tokens_total AS total_tokens")


# USD per one million tokens (prompt, completion).
PROMPT_COST_PER_1M = "0.05"
COMPLETION_COST_PER_1M = "0.10"


def token_cost(prompt_tokens, completion_tokens,
               prompt_rate: str = PROMPT_COST_PER_1M, completion_rate: str = COMPLETION_COST_PER_1M) -> Column:
    """``tokens / 1e6 * rate`` per side, summed, rounded to 6 digits, exact decimal."""
    p = F.col(prompt_tokens).cast("decimal(20,0)") if isinstance(prompt_tokens, str) else prompt_tokens
    c = F.col(completion_tokens).cast("decimal(20,0)") if isinstance(completion_tokens, str) else completion_tokens
    cost = (p * F.lit(prompt_rate).cast("decimal(10,4)") + c * F.lit(completion_rate).cast("decimal(10,4)")) \
        / F.lit(1_000_000).cast("decimal(10,0)")
    return F.round(cost, 6)


def nearest_rank_sql(sorted_ref: str, p: float) -> str:
    """SQL text of :func:`nearest_rank` for an array column reference."""
    n = f"size({sorted_ref})"
    idx = f"least(greatest(CAST(bround({p!r}D * ({n} - 1), 0) AS INT), 0), {n} - 1)"
    return f"CASE WHEN {n} > 0 THEN element_at({sorted_ref}, {idx} + 1) ELSE 0 END"


def nearest_rank(sorted_values, p: float) -> Column:
    """Nearest-rank percentile of a sorted array: index round-half-even(p*(n-1)), clamped; 0 if empty."""
    if isinstance(sorted_values, str):
        return F.expr(nearest_rank_sql(f"`{sorted_values}`", p))
    n = F.size(sorted_values)
    idx = F.least(F.greatest(F.bround(F.lit(p) * (n - 1), 0).cast("int"), F.lit(0)), n - 1)
    return F.when(n > 0, F.element_at(sorted_values, idx + 1)).otherwise(F.lit(0))


def latency_percentiles(log: DataFrame, ts: str, latency: str, tiebreak: str,
                        window: int = 1000, group: str | None = None,
                        ps=(0.50, 0.95, 0.99)) -> DataFrame:
    """p50/p95/p99 over the last ``window`` requests (overall, or per ``group``).

    The window is bounded (1,000 samples), so gathering it into one sorted
    array per group is bounded too; :func:`newest_rows` trims each group first."""
    if group is None:
        recent = top_n(log.select(ts, tiebreak, latency), [F.col(ts).desc()], window, [F.col(tiebreak).desc()])
        g = recent.agg(F.array_sort(F.collect_list(latency)).alias("_s"))
        keys = []
    else:
        recent = newest_rows(log.select(group, ts, tiebreak, latency), [group],
                             [F.col(ts).desc(), F.col(tiebreak).desc()], window, F.col(tiebreak))
        g = recent.groupBy(group).agg(F.array_sort(F.collect_list(latency)).alias("_s"))
        keys = [group]
    cols = [f"CAST({nearest_rank_sql('_s', p)} AS BIGINT) AS p{int(round(p * 100))}_latency_ms" for p in ps]
    return g.selectExpr(*keys, *cols, "CAST(size(_s) AS BIGINT) AS latency_samples")


def rate_limit_key(api_key, ip) -> Column:
    """``apikey:<key>`` when a key is sent, else ``ip:<address>`` (namespaced, never colliding)."""
    k = F.col(api_key) if isinstance(api_key, str) else api_key
    i = F.col(ip) if isinstance(ip, str) else ip
    return F.when(k.isNotNull() & (k != ""), F.concat(F.lit("apikey:"), k)).otherwise(F.concat(F.lit("ip:"), i))


def rate_limit_breaches(log: DataFrame, ts: str, key: Column, limit: int,
                        period: str = "1 minute") -> DataFrame:
    """Fixed windows per client: requests beyond ``limit`` per ``period`` are rejected."""
    per = (log.groupBy(F.window(F.col(ts), period).alias("w"), key.alias("client"))
              .agg(F.count(F.lit(1)).alias("requests")))
    return per.filter(F.col("requests") > limit).select(
        "client", F.col("w.start").alias("window_start"), "requests",
        (F.col("requests") - limit).alias("rejected"))


# ---- token usage from model responses -----------------------------------------
# The response shapes read, parsed once per row into one struct.
RESPONSE_SCHEMA = (
    "struct<llm_output:struct<token_usage:map<string,string>,usage:map<string,string>>,"
    "generations:array<array<struct<message:struct<usage_metadata:map<string,string>,"
    "response_metadata:struct<token_usage:map<string,string>,usage:map<string,string>>>>>>>")


def parsed_response_sql(json_ref: str) -> str:
    """SQL text that parses a response; project it as a column of its own, so that it is parsed once per row."""
    return f"from_json({json_ref}, '{RESPONSE_SCHEMA}')"


def token_usage_sql(p: str) -> tuple[str, str]:
    """Spark SQL text of (prompt, completion) tokens for a parsed response column."""

    def present(m: str) -> str:
        return f"(CASE WHEN size({m}) > 0 THEN {m} END)"

    def num(m: str, k: str) -> str:
        return f"coalesce(CAST(try_cast({m}['{k}'] AS DOUBLE) AS BIGINT), 0L)"

    top = f"coalesce({present(p + '.llm_output.token_usage')}, {present(p + '.llm_output.usage')})"
    rm = ("coalesce(" + present("g.message.response_metadata.token_usage") + ", "
          + present("g.message.response_metadata.usage") + ")")

    def per_generation(k_um: str, k_rm: str) -> str:
        body = (f"CASE WHEN size(g.message.usage_metadata) > 0 THEN {num('g.message.usage_metadata', k_um)} "
                f"ELSE {num(rm, k_rm)} END")
        return f"coalesce(aggregate(flatten({p}.generations), 0L, (acc, g) -> acc + {body}), 0L)"

    prompt = (f"CASE WHEN {top} IS NOT NULL THEN {num(top, 'prompt_tokens')} "
              f"ELSE {per_generation('input_tokens', 'prompt_tokens')} END")
    completion = (f"CASE WHEN {top} IS NOT NULL THEN {num(top, 'completion_tokens')} "
                  f"ELSE {per_generation('output_tokens', 'completion_tokens')} END")
    return prompt, completion


def with_token_usage(df: DataFrame, json_col: str) -> DataFrame:
    """``df`` with prompt_tokens and completion_tokens of the response JSON; the first matching shape wins.

    1. ``llm_output.token_usage`` or else ``llm_output.usage`` (prompt_tokens / completion_tokens);
    2. otherwise per generation message: ``usage_metadata`` (input_tokens / output_tokens),
       else ``response_metadata.token_usage`` or ``.usage``; summed over generations.
    Empty objects count as absent, missing pieces as 0."""
    prompt, completion = token_usage_sql("_parsed")
    return df.selectExpr("*", f"{parsed_response_sql(f'`{json_col}`')} AS _parsed").selectExpr(
        "*", f"{prompt} AS prompt_tokens", f"{completion} AS completion_tokens").drop("_parsed")
