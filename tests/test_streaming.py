"""Streaming twins agree with their batch answers; marts materialise."""

from kestrel.plans import marts
from kestrel.sources.model import Commerce
from kestrel.streaming import streams as ST

SF = "/root/testdata/sf0.001"


def test_stream_quantiles_equal_batch(spark):
    got = sorted(ST.stream_latency_quantiles(spark, SF).collect())
    want = sorted(ST.latency_quantiles_batch(spark, SF).collect())
    assert got == want and len(got) > 0


def test_stream_session_bounded_state(spark):
    got = ST.stream_session(spark, SF, n=2).collect()
    per = {}
    for r in got:
        per.setdefault(r["session_id"], []).append(r["seq"])
    assert all(len(v) <= 2 for v in per.values())


def test_materialized_marts(spark, tmpdir_path):
    c = Commerce(spark, SF)
    out = marts.materialize_marts(c, tmpdir_path)
    assert sorted(out["mart_state_performance"].collect()) == sorted(marts.state_performance(c).collect())
    assert spark.table("mart_revenue_by_month").count() == marts.revenue_by_month(c).count()


def test_late_rows_beyond_the_watermark_are_dropped(spark, tmpdir_path):
    import os
    from datetime import datetime
    src = os.path.join(tmpdir_path, "events")
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    k = '{"k": 1}'
    batches = [
        [(1, datetime(2024, 1, 1, 0, 0, 5), 7, "click", 1.0, k), (2, datetime(2024, 1, 1, 0, 0, 9), 7, "click", 1.0, k),
         (3, datetime(2024, 1, 1, 0, 30, 0), 8, "click", 1.0, k)],                 # watermark -> 00:20
        [(5, datetime(2024, 1, 1, 0, 30, 10), 8, "click", 1.0, k)],                 # on time
        [(4, datetime(2024, 1, 1, 0, 0, 30), 7, "click", 1.0, k)],                  # 30 min behind: late
    ]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(os.path.join(src, f"b{i}"))
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
              .parquet(os.path.join(src, "*")))
    got = {(r["client"], r["requests"]) for r in ST.rate_limit_over(stream, limit=1, watermark="10 minutes").collect()}
    # Stream: the late 00:00:30 row is dropped, so key-7's 00:00 minute keeps 2 requests.
    assert got == {("apikey:key-7", 2), ("apikey:key-8", 2)}
    # Batch over the same rows counts it.
    from kestrel.operators.logs import rate_limit_breaches, rate_limit_key
    from kestrel.sources import logs_model as LM
    batch = LM.request_log_from(spark.createDataFrame([r for b in batches for r in b], schema))
    want = {(r["client"], r["requests"]) for r in
            rate_limit_breaches(batch, "ts", rate_limit_key("api_key", "ip"), 1).collect()}
    assert want == {("apikey:key-7", 3), ("apikey:key-8", 2)}


def test_dedupe_within_watermark(spark, tmpdir_path):
    import os
    from datetime import datetime
    src = os.path.join(tmpdir_path, "events")
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    k = '{"k": 1}'
    batches = [
        [(1, datetime(2024, 1, 1, 0, 0), 7, "click", 1.0, k), (2, datetime(2024, 1, 1, 0, 5), 7, "click", 1.0, k)],
        [(3, datetime(2024, 1, 1, 0, 20), 7, "click", 1.0, k)],     # within 1 h of the first: dropped
        [(4, datetime(2024, 1, 1, 3, 0), 8, "view", 1.0, k)],       # moves the watermark to 02:00
        [(6, datetime(2024, 1, 1, 3, 10), 9, "view", 1.0, k)],      # that watermark evicts key-7's state
        [(5, datetime(2024, 1, 1, 2, 30), 7, "click", 1.0, k)],     # key-7 seen again: emitted again
    ]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(os.path.join(src, f"b{i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(os.path.join(src, "*"))
    out = ST.dedupe_sightings(stream, "1 hour")
    got = sorted((r["user_id"], str(r["ts"])) for r in spark.read.parquet(out).collect())
    assert got == [(7, "2024-01-01 00:00:00"), (7, "2024-01-01 02:30:00"), (8, "2024-01-01 03:00:00"),
                   (9, "2024-01-01 03:10:00")]


def _lines_in_batches(spark, folder, batches):
    import os
    schema = "session_id long, seq long, line string"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(os.path.join(folder, f"b{i}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(os.path.join(folder, "*"))


def test_session_tails_over_batches_with_silent_and_late_sessions(spark, tmpdir_path):
    batches = [[(1, i, f"a{i}") for i in range(5)] + [(2, 1, "b1")], [(3, 1, "c1")], [(3, 2, "c2"), (1, 9, "a9")],
               [(3, 3, "c3")], [(2, 7, "b7"), (3, 4, "c4"), (1, 3, "late a3")], [(2, 8, "b8")]]
    rows = [r for b in batches for r in b]
    for idle in (0, 1, 50):
        stream = _lines_in_batches(spark, f"{tmpdir_path}/idle{idle}", batches)
        got = sorted((r.session_id, r.seq) for r in ST.keep_session_tails(stream, 2, idle_batches=idle).collect())
        want = sorted((s, q) for s, q, _ in rows
                      if sum(s2 == s and q2 > q for s2, q2, _ in rows) < 2 and not (s == 1 and q == 3))
        assert got == want


def test_missing_stream_output_is_empty_but_other_errors_are_raised(spark, tmpdir_path):
    import pytest
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.LongType())])
    assert ST._latest(spark, f"{tmpdir_path}/nothing", ["k"], schema).count() == 0
    path = f"{tmpdir_path}/bad/_batch=0"
    spark.range(3).selectExpr("CAST(id AS STRING) AS k", "'x' AS v").write.parquet(path)
    with pytest.raises(Exception, match="PARQUET_COLUMN_DATA_TYPE_MISMATCH"):
        ST._latest(spark, f"{tmpdir_path}/bad", ["k"], schema).collect()


SESSION_BATCHES = [  # session, seq, line, seconds
    [(1, i, f"a{i}", i) for i in range(5)] + [(2, 1, "b1", 3), (None, 1, "n1", 4)],
    [(3, 1, "c1", 500), (3, None, "c-null", 500)],
    [(3, 2, "c2", 9000), (3, 2, "c2", 9000), (3, 2, None, 9000)],    # the watermark moves on: 1, 2 and null are closed
    [(2, 7, "b7", 9100), (4, 1, "d1", 9100)],                        # 2 comes back
    [(1, 3, "late a3", 20), (2, 8, "b8", 9200)],                     # behind the watermark
    [(4, 2, "d2", 30000)], [(5, 1, "e1", 30001)], [(2, 9, "b9", 30002)],
]


def _session_stream(spark, folder, batches, first=0):
    schema = "session_id long, seq long, line string, at long"
    for i, rows in enumerate(batches, first):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/b{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")
    return stream.selectExpr("session_id", "seq", "line", "timestamp_seconds(at) AS ts")


def _last_lines(batches, n, late=("late a3",)):
    rows = [(s, q, t) for b in batches for s, q, t, _ in b if t not in late]
    out = []
    for session in {s for s, _, _ in rows}:
        mine = sorted((r for r in rows if r[0] == session), key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or ""))
        out += mine[-n:]
    return sorted(out, key=str)


def test_session_memory_equals_batch_over_many_batches(spark, tmpdir_path):
    for n in (1, 2, 4):
        root = f"{tmpdir_path}/n{n}"
        got = ST.session_memory(_session_stream(spark, f"{root}/in", SESSION_BATCHES), n, idle_seconds=600, root=f"{root}/run")
        assert got.columns == ["session_id", "seq", "line"]
        assert sorted(map(tuple, got.collect()), key=str) == _last_lines(SESSION_BATCHES, n)
    out = spark.read.parquet(f"{tmpdir_path}/n4/run/out")
    # Only sessions that a batch touches or closes are written, and idle ones are closed by time.
    per_batch = {b: {r.session_id for r in out.filter(f"_batch = {b} AND NOT closed").collect()} for b in range(len(SESSION_BATCHES))}
    assert per_batch[1] == {"3"} and per_batch[3] == {"2", "4"} and per_batch[5] == {"4"}
    closed = {r.session_id for r in out.filter("closed").collect()}
    assert {"1", "2", None} <= closed


def test_session_memory_of_a_huge_session_and_no_rows(spark, tmpdir_path):
    many = [(7, i * 7919 % 5000, f"t{i * 7919 % 5000}", i) for i in range(5000)]
    got = ST.session_memory(_session_stream(spark, f"{tmpdir_path}/big", [many]), 3)
    assert sorted(r.seq for r in got.collect()) == [4997, 4998, 4999]
    assert ST.session_memory(_session_stream(spark, f"{tmpdir_path}/none", [[]]), 3).count() == 0


def test_streams_resume_from_their_folder(spark, tmpdir_path):
    folder, root = f"{tmpdir_path}/in", f"{tmpdir_path}/run"
    for upto in range(1, len(SESSION_BATCHES) + 1):
        stream = _session_stream(spark, folder, SESSION_BATCHES[upto - 1:upto], upto - 1)
        got = ST.session_memory(stream, 2, idle_seconds=600, root=root)
        assert sorted(map(tuple, got.collect()), key=str) == _last_lines(SESSION_BATCHES[:upto], 2)
    # Nothing new: the same answer.
    again = ST.session_memory(_session_stream(spark, folder, []), 2, idle_seconds=600, root=root)
    assert sorted(map(tuple, again.collect()), key=str) == _last_lines(SESSION_BATCHES, 2)


def _request_rows(n, spread=7200):
    import random
    from datetime import datetime, timedelta
    r, start = random.Random(n), datetime(2024, 1, 1)
    return [(i, start + timedelta(seconds=r.randrange(spread)), r.randrange(9), r.choice(["click", "view", "error"]),
             r.choice([None, float(r.randrange(10 ** 6))]), f'{{"k": {r.randrange(50)}}}') for i in range(n)]


EVENT_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def _request_stream(spark, folder, parts, first=0):
    from kestrel.sources import logs_model as LM
    for i, rows in enumerate(parts, first):
        spark.createDataFrame(rows, EVENT_SCHEMA).coalesce(1).write.parquet(f"{folder}/b{i}")
    stream = spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")
    return ST._event_time(LM.request_log_from(stream))


def test_sliding_windows_are_merged_panes_and_resume(spark, tmpdir_path):
    from datetime import timedelta
    rows = _request_rows(600)
    folder, root = f"{tmpdir_path}/in", f"{tmpdir_path}/run"
    ST.sliding_over(_request_stream(spark, folder, [rows[:200]]), "10 minutes", 3, "1 day", root)
    got = ST.sliding_over(_request_stream(spark, folder, [rows[200:400], rows[400:]], 1), "10 minutes", 3, "1 day", root)
    got = {r.window_start: r for r in got.collect()}
    starts = {r[1].replace(minute=r[1].minute // 10 * 10, second=0) - timedelta(minutes=10 * b) for r in rows for b in range(3)}
    assert set(got) == starts
    for start, r in got.items():
        mine = [x for x in rows if start <= x[1] < start + timedelta(minutes=30)]
        values = sorted(round(x[4]) for x in mine if x[4] is not None)
        assert (r.requests, r.failed, r.cache_hits) == (len(mine), sum(x[3] == "error" for x in mine), sum(x[3] == "view" for x in mine))
        for q, v in ((50, r.p50_latency_ms), (95, r.p95_latency_ms), (99, r.p99_latency_ms)):
            assert v == (values[max(0, -(-q * len(values) // 100) - 1)] if values else None)
    # An event is in one pane of the state only.
    last = spark.read.parquet(f"{root}/out").groupBy("pane").agg({"requests": "max"}).collect()
    assert sum(r[1] for r in last) == len(rows)


def test_sketched_quantiles_stay_within_the_rank_error(spark, tmpdir_path):
    from bisect import bisect_left, bisect_right
    rows = _request_rows(20000, spread=1800)
    got = ST.sliding_over(_request_stream(spark, f"{tmpdir_path}/in", [rows]), "10 minutes", 3, "1 day").collect()
    full = max(got, key=lambda r: r.requests)
    values = sorted(round(x[4]) for x in rows if x[4] is not None)
    assert full.requests == len(rows)
    for q, v in ((0.5, full.p50_latency_ms), (0.95, full.p95_latency_ms), (0.99, full.p99_latency_ms)):
        low, high = bisect_left(values, v) / len(values), bisect_right(values, v) / len(values)
        assert low - 0.005 <= q <= high + 0.005


def test_rate_limit_resumes(spark, tmpdir_path):
    rows = _request_rows(300, spread=300)
    folder, root = f"{tmpdir_path}/in", f"{tmpdir_path}/run"

    def run(part, first):
        spark.createDataFrame(part, EVENT_SCHEMA).coalesce(1).write.parquet(f"{folder}/b{first}")
        return ST.rate_limit_over(spark.readStream.schema(EVENT_SCHEMA).parquet(f"{folder}/*"), 1, root=root)
    run(rows[:150], 0)
    got = {(r.client, r.window_start, r.requests) for r in run(rows[150:], 1).collect()}
    whole = ST.rate_limit_over(spark.readStream.schema(EVENT_SCHEMA).parquet(f"{folder}/*"), 1)
    assert got == {(r.client, r.window_start, r.requests) for r in whole.collect()} and got
