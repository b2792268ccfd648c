"""Operational logs expressed over the driver tables (fixed stand-in rules).

Request log (one request per ``events`` row, k = props.k):
  ts, request_id = event_id, api_key = 'key-<user_id>' except for 'view' and
  'error' events, which come without a key; ip = 10.0.<user_id div 256>.<user_id mod 256>;
  failed = 'error'; cached = 'view'; blocked = 'click' with k mod 10 = 0;
  sql_error = 'error' with odd k; latency_ms = round(value);
  response JSON carries k prompt and k div 2 completion tokens in the shape
  the event type selects ('click' llm_output.token_usage, 'purchase'
  llm_output.usage behind an empty token_usage, 'view' generation
  usage_metadata, 'signup' generation response_metadata.token_usage,
  'error' none).

Session log (``conversations``): session_id = conv_id, seq = turn,
line = '<Role>: <text>'; a question is a user turn.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.operators.logs import with_token_usage
from kestrel.sources.tables import Tables

# Response JSON templates per event type (k, k div 2).
RESPONSE_SHAPES = {
    "click": '{"llm_output": {"token_usage": {"prompt_tokens": %d, "completion_tokens": %d}}}',
    "purchase": '{"llm_output": {"token_usage": {}, "usage": {"prompt_tokens": %d, "completion_tokens": %d}}}',
    "view": '{"llm_output": null, "generations": [[{"message": {"usage_metadata": '
            '{"input_tokens": %d, "output_tokens": %d}}}]]}',
    "signup": '{"generations": [[{"message": {"response_metadata": '
              '{"token_usage": {"prompt_tokens": %d, "completion_tokens": %d}}}}]]}',
}
NO_USAGE = "{}"
# Each question's sequence in the question log: conv_id * SEQ_STRIDE + turn.
SEQ_STRIDE = 1_000_000


_K = "CAST(get_json_object(props, '$.k') AS INT)"


def _k():
    return F.expr(_K)


def response_json_sql() -> str:
    """SQL text building the response JSON per event (concat, not a formatter)."""
    k, half = f"CAST({_K} AS STRING)", f"CAST(floor({_K} / 2) AS STRING)"
    branches = []
    for et, tmpl in RESPONSE_SHAPES.items():
        a, b, c = tmpl.split("%d")
        parts = ", ".join([_lit(a), k, _lit(b), half, _lit(c)])
        branches.append(f"WHEN event_type = '{et}' THEN concat({parts})")
    return f"CASE {' '.join(branches)} ELSE {_lit(NO_USAGE)} END"


def _lit(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def response_json() -> F.Column:
    return F.expr(response_json_sql())


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return request_log_from(Tables(spark, sf_dir).events)


def request_log_from(e: DataFrame) -> DataFrame:
    """The request-log mapping over an events DataFrame (batch or streaming)."""
    log = e.selectExpr(
        "ts", "event_id AS request_id", "user_id", "event_type",
        "CASE WHEN event_type IN ('view', 'error') THEN NULL ELSE concat('key-', CAST(user_id AS STRING)) END AS api_key",
        "concat('10.0.', CAST(floor(user_id / 256) AS STRING), '.', CAST(pmod(user_id, 256) AS STRING)) AS ip",
        "concat('s', CAST(user_id AS STRING)) AS session_id",
        "event_type = 'error' AS failed",
        "event_type = 'view' AS cached",
        f"event_type = 'click' AND pmod({_K}, 10) = 0 AS blocked",
        f"event_type = 'error' AND pmod({_K}, 2) = 1 AS sql_error",
        "CAST(round(value) AS BIGINT) AS latency_ms",
        f"{response_json_sql()} AS response")
    return with_token_usage(log, "response")


def session_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session_lines_from(Tables(spark, sf_dir).conversations)


def session_lines_from(cv: DataFrame) -> DataFrame:
    return cv.selectExpr("conv_id AS session_id", "turn AS seq",
                         "concat(initcap(role), ': ', text) AS line", "role", "text")


def question_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    cv = Tables(spark, sf_dir).conversations.filter("role = 'user'")
    return cv.selectExpr("conv_id AS session_id", "turn", f"conv_id * {SEQ_STRIDE} + turn AS seq",
                         "text AS question")
