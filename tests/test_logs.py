"""Log operators: percentiles, sessions, cache keys, token JSON, rate limits, cost."""

import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from kestrel.operators import logs as L


def test_percentiles_nearest_rank(spark):
    t0 = datetime(2024, 1, 1)
    rows = [(t0 + timedelta(seconds=i), i, i) for i in range(1, 101)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, id long, ms long")
    r = L.latency_percentiles(df, "ts", "ms", "id").collect()[0]
    assert r["latency_samples"] == 100
    assert 49 <= r["p50_latency_ms"] <= 51 and 94 <= r["p95_latency_ms"] <= 96 and 98 <= r["p99_latency_ms"] <= 100
    # The definition: idx = round-half-even(p * (n - 1)).
    s = list(range(1, 101))
    assert r["p50_latency_ms"] == s[round(0.5 * 99)] and r["p95_latency_ms"] == s[round(0.95 * 99)]


def test_percentiles_keep_only_last_window(spark):
    t0 = datetime(2024, 1, 1)
    rows = [(t0 + timedelta(seconds=i), i, 1000 if i < 50 else 1) for i in range(100)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, id long, ms long")
    r = L.latency_percentiles(df, "ts", "ms", "id", window=50).collect()[0]
    assert (r["latency_samples"], r["p99_latency_ms"]) == (50, 1)


def test_percentiles_empty_is_zero(spark):
    df = spark.createDataFrame([], "ts timestamp_ntz, id long, ms long")
    r = L.latency_percentiles(df, "ts", "ms", "id").collect()[0]
    assert (r["latency_samples"], r["p50_latency_ms"], r["p95_latency_ms"]) == (0, 0, 0)


def test_session_keeps_last_cap_in_order(spark):
    cap = 12
    rows = [("s1", i, f"line {i}") for i in range(1, cap + 5)] + [("s2", 1, "only")]
    df = spark.createDataFrame(rows, "session_id string, seq long, line string")
    got = L.last_n_lines(df, "session_id", "seq", cap).orderBy("session_id", "seq").collect()
    s1 = [r["line"] for r in got if r["session_id"] == "s1"]
    assert s1 == [f"line {i}" for i in range(5, cap + 5)]
    assert [r["line"] for r in got if r["session_id"] == "s2"] == ["only"]


def test_next_seq(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 7)], "session_id string, seq long")
    assert {r["session_id"]: r["next_seq"] for r in L.next_seq(df, "session_id", "seq").collect()} == {"a": 3, "b": 8}


def test_prompt_text(spark):
    lines = spark.createDataFrame([("s", 1, "User: hi"), ("s", 2, "Assistant: hello"), ("s", 3, "User: q2")],
                                  "session_id string, seq long, line string")
    qs = spark.createDataFrame([("s", 1, "hi"), ("s", 3, "q2")], "session_id string, seq long, question string")
    got = {r["seq"]: r["prompt"] for r in L.build_prompts(lines, qs, "session_id", "seq", "line", "question", 12).collect()}
    assert got[1] == "hi"
    assert got[3] == "Prior conversation:\nUser: hi\nAssistant: hello\n\nCurrent question: q2"


def test_forget_sessions(spark):
    lines = spark.createDataFrame([("a", 1), ("b", 1), ("b", 2)], "session_id string, seq long")
    forget = spark.createDataFrame([("b",)], "session_id string")
    assert [r["session_id"] for r in L.forget_sessions(lines, forget, "session_id").collect()] == ["a"]


def test_recency_keeps_most_recent(spark):
    # set a, set b, touch a, set c with capacity 2 -> a and c remain.
    log = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3), ("c", 4)], "key string, seq long")
    assert sorted(r["key"] for r in L.recent_keys(log, "key", "seq", 2).collect()) == ["a", "c"]


def test_cache_effectiveness(spark):
    qs = ["How many orders?", "how many orders", "How, many orders!", "   how   many orders?   ", "Top state?"]
    log = L.with_question_key(spark.createDataFrame([(q,) for q in qs], "question string"), "question")
    r = L.cache_effectiveness(log, "key").collect()[0]
    assert (r["questions"], r["hits"], r["misses"]) == (5, 3, 2)


def _usage(spark, payloads):
    df = spark.createDataFrame([(json.dumps(p) if p is not None else None,) for p in payloads], "j string")
    return [tuple(r) for r in L.with_token_usage(df, "j").select("prompt_tokens", "completion_tokens").collect()]


def test_token_usage_shapes(spark):
    payloads = [
        {"llm_output": {"token_usage": {"prompt_tokens": 10, "completion_tokens": 5}}},
        {"llm_output": {"usage": {"prompt_tokens": 3, "completion_tokens": 4}}},
        {"generations": [[{"message": {"usage_metadata": {"input_tokens": 7, "output_tokens": 3},
                                       "response_metadata": {}}}]]},
        {"generations": [[{"message": {"usage_metadata": None,
                                       "response_metadata": {"token_usage": {"prompt_tokens": 4, "completion_tokens": 2}}}}]]},
        {"llm_output": {"token_usage": {"prompt_tokens": 1, "completion_tokens": 2}},
         "generations": [[{"message": {"usage_metadata": {"input_tokens": 99, "output_tokens": 99}}}]]},
        {},
        None,
        {"llm_output": {"token_usage": {}, "usage": {"prompt_tokens": 8, "completion_tokens": 1}}},
        {"generations": [[{"message": {"usage_metadata": {"input_tokens": 2, "output_tokens": 1}}},
                          {"message": {"usage_metadata": {"input_tokens": 3, "output_tokens": 1}}}]]},
    ]
    assert _usage(spark, payloads) == [(10, 5), (3, 4), (7, 3), (4, 2), (1, 2), (0, 0), (0, 0), (8, 1), (5, 2)]


def test_token_usage_accumulates(spark):
    payloads = [{"llm_output": {"token_usage": {"prompt_tokens": 5, "completion_tokens": 1}}},
                {"llm_output": {"token_usage": {"prompt_tokens": 10, "completion_tokens": 2}}}]
    assert [sum(x) for x in zip(*_usage(spark, payloads))] == [15, 3]


def test_rate_limit_key_and_breaches(spark):
    t0 = datetime(2024, 1, 1, 0, 0, 5)
    rows = [(t0, "k", "1.1.1.1"), (t0 + timedelta(seconds=10), "k", "1.1.1.1"),
            (t0 + timedelta(seconds=20), "k", "2.2.2.2"), (t0, None, "1.1.1.1"), (t0, "", "1.1.1.1")]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, api_key string, ip string")
    keys = [r[0] for r in df.select(L.rate_limit_key("api_key", "ip")).collect()]
    assert keys == ["apikey:k", "apikey:k", "apikey:k", "ip:1.1.1.1", "ip:1.1.1.1"]
    got = {r["client"]: (r["requests"], r["rejected"]) for r in
           L.rate_limit_breaches(df, "ts", L.rate_limit_key("api_key", "ip"), 2).collect()}
    assert got == {"apikey:k": (3, 1)}


def test_request_metrics_and_cost(spark):
    rows = [(10, 5, False, True, False, False), (100, 50, True, False, True, True)]
    df = spark.createDataFrame(rows, "prompt_tokens long, completion_tokens long, failed boolean, cached boolean, "
                                     "blocked boolean, sql_error boolean")
    m = L.request_metrics(df).withColumn("cost", L.token_cost("prompt_tokens_total", "completion_tokens_total")).collect()[0]
    assert (m["queries_total"], m["queries_failed"], m["cache_hits"], m["cache_misses"]) == (2, 1, 1, 1)
    assert (m["guardrail_blocks"], m["sql_errors"], m["total_tokens"]) == (1, 1, 165)
    assert float(m["cost"]) == round(110 / 1e6 * 0.05 + 55 / 1e6 * 0.10, 6)
    assert F is not None


def test_duplicate_rows_exact(spark):
    from kestrel.operators.integrity import duplicate_rows, profile
    rows = [(1, "a", None), (1, "a", None), (1, "a", None), (None, "a", 1), (1, None, None), (2, "b", 3)]
    df = spark.createDataFrame(rows, "x int, y string, z int")
    assert duplicate_rows(df).collect()[0]["duplicate_rows"] == 2
    p = profile(df, "t").collect()[0]
    assert (p["rows"], p["cols"], p["null_cells"], p["duplicate_rows"]) == (6, 3, 6, 2)


def test_assign_seq_numbers_every_row_with_its_payload(spark):
    from pyspark.sql import Window
    rows = spark.range(600_000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 1001 = 1 THEN NULL ELSE concat('s', id % 40) END AS session",
        "id DIV 7 AS ts", "id", "concat('line ', id, repeat('x', CAST(id % 50 AS INT))) AS line").repartition(16)
    w = Window.partitionBy("session").orderBy("ts", "id")
    want = rows.withColumn("seq", F.row_number().over(w).cast("long"))
    for _ in range(2):
        got = L.assign_seq(rows, "session", "ts", "id")
        assert got.columns == ["session", "ts", "id", "line", "seq"] and got.count() == 600_000
        assert got.exceptAll(want).isEmpty()


def test_prompts_take_the_last_lines_whatever_their_numbers(spark):
    lines = spark.createDataFrame([("a", 1, "l1"), ("a", 5, "l5"), ("a", 7, "l7"), ("a", 10, "q10"), ("b", 3, "x")],
                                  "s string, seq long, line string")
    asked = spark.createDataFrame([("a", 10, "q"), ("a", 1, "first"), ("c", 4, "none"), ("a", 90, "late")],
                                  "s string, seq long, question string")
    got = {(r.s, r.seq): r.prompt for r in L.build_prompts(lines, asked, "s", "seq", "line", "question", 2).collect()}
    head, tail = "Prior conversation:\n", "\n\nCurrent question: "
    assert got == {("a", 10): f"{head}l5\nl7{tail}q", ("a", 1): "first", ("c", 4): "none",
                   ("a", 90): f"{head}l7\nq10{tail}late"}


def test_long_windows_are_trimmed_in_two_steps(spark):
    rows = spark.range(20_000).selectExpr("'hot' AS s", "id AS seq", "concat('l', id) AS line")
    got = L.last_n_lines(rows, "s", "seq", 3000)
    assert {r.seq for r in got.collect()} == set(range(17_000, 20_000))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("row_number") >= 2 and "_salt" in plan
