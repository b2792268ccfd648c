"""Sources and sinks: JSON-lines request log, golden file, report sink."""

import json
import os
from datetime import datetime

import pytest

from kestrel.operators.evaluate import score_cases, summarize
from kestrel.operators.logs import request_metrics
from kestrel.sources.raw import read_golden, read_json_log, write_report


def test_json_lines_log_feeds_metrics(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "requests.jsonl")
    recs = [
        {"ts": "2024-01-01T00:00:01", "api_key": "k", "ip": "1.1.1.1", "question": "q", "prompt_tokens": 10,
         "completion_tokens": 5, "failed": False, "cached": True, "blocked": False, "sql_error": False, "latency_ms": 20},
        {"ts": "2024-01-01T00:00:02", "api_key": None, "ip": "2.2.2.2", "question": "q2", "prompt_tokens": 3,
         "completion_tokens": 1, "failed": True, "cached": False, "blocked": True, "sql_error": True, "latency_ms": 40},
    ]
    with open(path, "w") as fh:
        fh.write("\n".join(json.dumps(r) for r in recs))
    log = read_json_log(spark, path)
    assert log.first()["ts"] == datetime(2024, 1, 1, 0, 0, 1)
    m = request_metrics(log).collect()[0]
    assert (m["queries_total"], m["queries_failed"], m["total_tokens"], m["guardrail_blocks"]) == (2, 1, 19, 1)


def test_golden_yaml_and_report(spark, tmpdir_path):
    g = os.path.join(tmpdir_path, "g.yaml")
    with open(g, "w") as fh:
        fh.write("- id: t1\n  question: q?\n  contains: ['42']\n- id: t2\n  question: q2?\n  contains: [x]\n"
                 "  max_latency_ms: 10\n")
    golden = read_golden(spark, g)
    answers = spark.createDataFrame([("t1", "the answer is 42", 5, 1, 1, None), ("t2", "nope", 50, 1, 1, None)],
                                    "id string, answer string, latency_ms long, prompt_tokens long, "
                                    "completion_tokens long, error string")
    scored = score_cases(golden, answers)
    out = write_report(summarize(scored), os.path.join(tmpdir_path, "report"))
    rep = spark.read.json(out).collect()[0]
    assert (rep["passed"], rep["n"], rep["slow"]) == (1, 2, 1)
    bad = os.path.join(tmpdir_path, "bad.yaml")
    with open(bad, "w") as fh:
        fh.write("id: not-a-list\n")
    with pytest.raises(ValueError):
        read_golden(spark, bad)
