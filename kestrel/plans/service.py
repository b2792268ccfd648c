"""SQL audit, error triage, answer evaluation, traces and the JSON log as registered jobs over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.functions.text import normalize_answer
from kestrel.operators import evaluate, guard, shape
from kestrel.operators.logs import request_metrics
from kestrel.session import scratch_path
from kestrel.sources import logs_model as LM
from kestrel.sources.raw import read_json_log, write_report
from kestrel.sources.tables import Tables

# Stand-in SQL log: a statement per conversation turn, so that every verdict occurs.
_NOTE = "translate(text, '''\\\\', '  ')"
STATEMENT = f"""
CASE pmod(conv_id + turn, 12)
  WHEN 0 THEN split_part(text, ' ', 1)
  WHEN 1 THEN concat('SELECT ''', {_NOTE}, '; drop it'' AS note FROM orders')
  WHEN 2 THEN concat('SELECT * FROM orders; SELECT ', conv_id)
  WHEN 3 THEN concat('WITH t AS (SELECT ', turn, ' AS n) SELECT n FROM t; ')
  WHEN 4 THEN concat('SELECT `collect_list`(order_id) FROM orders WHERE order_id > ', conv_id)
  WHEN 5 THEN concat('SELECT * FROM `csv`.`/data/', conv_id, '`')
  WHEN 6 THEN concat('WITH gone AS (DELETE FROM orders) SELECT ', turn)
  WHEN 7 THEN '  '
  WHEN 8 THEN concat('SELECT ''\\\\'''', string_agg(city), '''' FROM customers -- ', conv_id)
  WHEN 10 THEN concat('SELECT * FROM Identifier (''parquet.`/data/', conv_id, '`'')')
  WHEN 11 THEN concat('SELECT approx_top_k(city, ', conv_id, ') FROM customers')
END"""

# Stand-in error messages: one per part, so that every hint occurs.
MESSAGE = """
CASE pmod(p_partkey, 9)
  WHEN 0 THEN concat('[UNRESOLVED_COLUMN.WITH_SUGGESTION] no column ', p_name)
  WHEN 1 THEN concat('table ', p_name, ' not found')
  WHEN 2 THEN concat('  syntax error at ', p_name, '  ')
  WHEN 3 THEN concat('line 1\\nfunction ', p_name, ' does not exist')
  WHEN 4 THEN '[DIVIDE_BY_ZERO] Division by zero'
  WHEN 5 THEN concat('[MISSING_AGGREGATION] ', p_type)
  WHEN 6 THEN concat('[CAST_INVALID_INPUT] ', p_brand)
  WHEN 7 THEN repeat(p_name, 60)
END"""


def sql_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict and reason of every statement of the SQL log."""
    log = Tables(spark, sf_dir).conversations.selectExpr("conv_id", "turn", f"{STATEMENT} AS sql")
    return guard.audit_sql(log).select("conv_id", "turn", "verdict", "reason")


def sql_error_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = Tables(spark, sf_dir).part.selectExpr("p_partkey AS part_id", f"{MESSAGE} AS message")
    return guard.triage_errors(errors).select("part_id", "error_text")


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as cases (first and fifth word expected), documents as answers.

    Item i is answered by document i; every ninth answer failed, every eleventh
    belongs to no case (its id is negated), latency is the answer's length."""
    t = Tables(spark, sf_dir)
    golden = t.benchmark.selectExpr(
        "CAST(item_id AS STRING) AS id", "substring(text, 1, 40) AS question",
        "array(upper(split_part(text, ' ', 1)), split_part(text, ' ', 5)) AS contains", "1500L AS max_latency_ms")
    answers = t.documents.selectExpr(
        "CAST(CASE WHEN doc_id % 11 = 10 THEN -doc_id ELSE doc_id END AS STRING) AS id", "text AS answer", "n_chars AS latency_ms", "n_chars DIV 4 AS prompt_tokens",
        "n_chars DIV 9 AS completion_tokens", "CASE WHEN doc_id % 9 = 4 THEN 'timeout' END AS error")
    return evaluate.score_cases(golden, answers)


def eval_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("id", "passed", "latency_ms", "prompt_tokens", "completion_tokens",
                                         F.array_join("missing", "|").alias("missing"), "slow", "error")


def eval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.summarize(_scored(spark, sf_dir))


def eval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evaluation summary written as a JSON report and read back."""
    summary = eval_summary(spark, sf_dir)
    path = write_report(summary, scratch_path(spark, f"eval-report-{uuid.uuid4().hex[:12]}"))
    return spark.read.schema(summary.schema).json(path)


def _traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One trace per conversation, a step per turn; observations are row lists of several forms, or prose."""
    steps = Tables(spark, sf_dir).conversations.selectExpr("conv_id", "turn", """struct(
        turn, CASE WHEN role = 'user' THEN 'search' WHEN turn % 4 = 3 THEN 'run_query' ELSE 'SQL_tool' END AS tool,
        text AS tool_input,
        CASE pmod(conv_id + turn, 5)
          WHEN 0 THEN concat('[(\\'', translate(split_part(text, ' ', 1), "'", ' '), '\\', ', turn, '), ("it\\\\"s", -1.5e3)]')
          WHEN 1 THEN concat('[[', turn, ', None], [', conv_id, ', True], ]')
          WHEN 2 THEN concat('[(\\'a\\', 1), (\\'b\\', 2, ', turn, ')]')
          WHEN 3 THEN concat('[(', turn, ',), (2,)]')
          ELSE text END AS observation) AS step""")
    return steps.groupBy("conv_id").agg(F.array_sort(F.collect_list("step")).alias("s")).selectExpr(
        "conv_id", "transform(s, x -> struct(x.tool, x.tool_input, x.observation)) AS steps")


def trace_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of the shaped steps of every trace."""
    return shape.shape_trace(_traces(spark, sf_dir)).selectExpr(
        "conv_id", "inline(transform(steps, (s, i) -> struct(CAST(i AS INT) AS step, s.tool AS tool, "
        "length(s.tool_input) AS input_chars, length(s.observation) AS observation_chars)))")


def last_sql_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape.last_sql_step(_traces(spark, sf_dir)).select("conv_id", F.length("sql_text").alias("sql_chars"), "sql_rows")


def request_log_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The request log written as JSON lines and read back: the same metrics."""
    path = scratch_path(spark, f"request-log-{uuid.uuid4().hex[:12]}")
    LM.request_log(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")).write.json(path)
    return request_metrics(read_json_log(spark, path))


def exact_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact decimal arithmetic per order: converted total and a quarter of it, rounded half up."""
    total = "CAST(o_totalprice AS DECIMAL(12,2))"
    return Tables(spark, sf_dir).orders.selectExpr(
        "o_orderkey AS order_id", f"round({total} * CAST('0.2009' AS DECIMAL(10,4)), 2) AS converted",
        f"round({total} / CAST(4 AS DECIMAL(1,0)), 2) AS quarter")


def normalized_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of every document's normalised text."""
    text = normalize_answer(F.col("text"))
    return Tables(spark, sf_dir).documents.select("doc_id", F.sha2(text, 256).alias("answer_sha256"))
