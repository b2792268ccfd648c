"""Log analytics over the request and session logs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.functions import formatting as FM
from kestrel.functions import metrics as M
from kestrel.functions.text import question_key, redact
from kestrel.operators import logs as L
from kestrel.operators.merge import create_store, merge_delta, read_store
from kestrel.operators.numbering import NumberedLog
from kestrel.operators.rolling import rolling_percentiles
from kestrel.operators.scalars import one_row
from kestrel.session import scratch_path
from kestrel.sources import logs_model as LM
from kestrel.sources.tables import Tables

# Parameters of the registered log jobs on the stand-in data.
SESSION_LINES_KEPT = 4          # lines retained per session (2 x turns in the reference)
CACHE_CAPACITY = 128            # most-recently-used keys retained
RATE_LIMIT_PER_MINUTE = 1
LATENCY_WINDOW = 1000


def session_last_n(spark: SparkSession, sf_dir: str, n: int = SESSION_LINES_KEPT) -> DataFrame:
    lines = LM.session_lines(spark, sf_dir).select("session_id", "seq", "line")
    return L.last_n_lines(lines, "session_id", "seq", n)


def session_next_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.next_seq(LM.session_lines(spark, sf_dir), "session_id", "seq")


def session_assign_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense 1-based sequence per session in turn order (role breaks ties), skew-safe."""
    lines = LM.session_lines(spark, sf_dir).selectExpr("session_id", "seq AS turn", "role", "line")
    return L.assign_seq(lines, "session_id", "turn", "role")


def session_appended_seq(spark: SparkSession, sf_dir: str, parts: int = 3) -> DataFrame:
    """Sequence numbers over three appended parts of the session log (earlier, middle and later turns), numbered part by part."""
    lines = LM.session_lines(spark, sf_dir).selectExpr("session_id", "seq AS turn", "role", "line")
    last = lines.groupBy("session_id").agg(F.max("turn").alias("_last"))
    dealt = lines.join(last, "session_id").withColumn("_part", F.expr(f"least({parts - 1}, turn * {parts} DIV (_last + 1))"))
    log = NumberedLog(spark, scratch_path(spark, f"numbered-{uuid.uuid4().hex}"), lines.schema, "session_id", "turn", "role", 16).create()
    for k in range(parts):
        log.append(k, dealt.filter(F.col("_part") == k).drop("_last", "_part"))
    return log.read()


def session_prompts(spark: SparkSession, sf_dir: str, n: int = SESSION_LINES_KEPT) -> DataFrame:
    # All turns, renumbered so that the stored numbers have gaps.
    lines = LM.session_lines(spark, sf_dir).withColumn("seq", F.expr("seq * 2 + seq DIV 5"))
    questions = lines.filter(F.col("role") == "user").select("session_id", "seq", F.col("text").alias("question"))
    return L.build_prompts(lines.select("session_id", "seq", "line"), questions,
                           "session_id", "seq", "line", "question", n)


def session_forget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Erase every session that holds a system line (the erasure list derives from the log)."""
    lines = LM.session_lines(spark, sf_dir)
    forget = lines.filter(F.col("role") == "system").select("session_id")
    return L.forget_sessions(lines.select("session_id", "seq", "line"), forget, "session_id")


def cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = L.with_question_key(LM.question_log(spark, sf_dir), "question")
    return L.cache_effectiveness(q, "key")


def recent_keys(spark: SparkSession, sf_dir: str, n: int = CACHE_CAPACITY) -> DataFrame:
    q = L.with_question_key(LM.question_log(spark, sf_dir), "question")
    return L.recent_keys(q, "key", "seq", n)


def latest_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upsert result of the event stream: the latest event type and value per user."""
    e = Tables(spark, sf_dir).events.select("user_id", "event_id", "event_type", M.money("value").alias("value"))
    return L.latest_per_key(e, "user_id", "event_id", ["event_type", "value"])


def latest_merged(spark: SparkSession, sf_dir: str, buckets: int = 16) -> DataFrame:
    """The latest event type and value per user, by an initial load and two deltas merged into a stored table.

    The events are dealt into the three loads by their ids, so later loads bring older and newer rows of known users and new users."""
    e = Tables(spark, sf_dir).events.select("user_id", "event_id", "event_type", M.money("value").alias("value"))
    path = scratch_path(spark, f"latest-{uuid.uuid4().hex}")
    loads = [e.filter(F.pmod(F.xxhash64("event_id"), F.lit(3)) == k) for k in range(3)]
    create_store(loads[0], path, ["user_id"], "event_id", buckets)
    for delta in loads[1:]:
        merge_delta(delta, path, ["user_id"], "event_id", buckets)
    return read_store(spark, path, e.schema)


def latency_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = LM.request_log(spark, sf_dir)
    return L.latency_percentiles(log, "ts", "latency_ms", "request_id", LATENCY_WINDOW)


def latency_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = LM.request_log(spark, sf_dir)
    return L.latency_percentiles(log, "ts", "latency_ms", "request_id", LATENCY_WINDOW, group="event_type")


def latency_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latency percentiles over the last ``LATENCY_WINDOW`` requests of its type, at every request."""
    log = LM.request_log(spark, sf_dir).select("request_id", "event_type", "ts", "latency_ms")
    out = rolling_percentiles(log, "event_type", ["ts", "request_id"], "latency_ms", LATENCY_WINDOW)
    return out.drop("ts", "latency_ms")


def request_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters, token totals and cost, plus live sizes (cache keys, sessions)."""
    m = L.request_metrics(LM.request_log(spark, sf_dir))
    m = m.withColumn("estimated_cost_usd", L.token_cost("prompt_tokens_total", "completion_tokens_total"))
    q = L.with_question_key(LM.question_log(spark, sf_dir), "question")
    sizes = q.agg(F.count_distinct("key").alias("cache_size"))
    sess = LM.session_lines(spark, sf_dir).agg(F.count_distinct("session_id").alias("session_count"))
    return one_row(m, sizes, sess)


def token_usage_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = LM.request_log(spark, sf_dir)
    return log.groupBy("event_type").agg(F.sum("prompt_tokens").alias("prompt_tokens"),
                                         F.sum("completion_tokens").alias("completion_tokens"),
                                         F.count(F.lit(1)).alias("responses"))


def rate_limit_breaches(spark: SparkSession, sf_dir: str, limit: int = RATE_LIMIT_PER_MINUTE) -> DataFrame:
    log = LM.request_log(spark, sf_dir)
    return L.rate_limit_breaches(log, "ts", L.rate_limit_key("api_key", "ip"), limit, "1 minute")


def redact_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = LM.request_log(spark, sf_dir)
    return log.select("request_id", redact(F.col("api_key")).alias("api_key_hash"),
                      redact(F.col("session_id")).alias("session_hash"))


def question_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = LM.question_log(spark, sf_dir)
    return q.select("session_id", "turn", question_key(F.col("question")).alias("key"))


def format_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Display texts per order: compact BRL total, thousands-separated id, USD amount, date."""
    o = Tables(spark, sf_dir).orders
    price = M.money("o_totalprice")
    return o.select(F.col("o_orderkey").alias("order_id"),
                    FM.compact_brl(price).alias("total_text"),
                    FM.thousands(F.col("o_orderkey") * 1000).alias("id_text"),
                    FM.usd(price).alias("usd_text"),
                    F.date_format("o_orderdate", "yyyy-MM-dd").alias("date_text"))
