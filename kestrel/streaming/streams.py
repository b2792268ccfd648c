"""Structured Streaming twins of the log operators.

Each job reads a table as a file stream, runs with ``trigger(availableNow=True)``
(all data present now, then stop), and writes every micro-batch with its
batch id through ``foreachBatch``. The final answer is the latest version
of each key across batches, so it does not depend on how the input was cut
into batches; rows behind the watermark are dropped as late. Sink and
checkpoint live in the folder ``root`` that the caller gives: run again with
the same ``root``, a job goes on from its offsets and state, whether it stopped,
lost its driver or only new files came. Without ``root`` a job starts anew in
a folder of its own under the shared checkpoint folder.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kestrel.functions.text import question_key
from kestrel.operators.logs import last_n_lines, newest_rows, rate_limit_key
from kestrel.session import scratch_path
from kestrel.sources import logs_model as LM
from kestrel.sources.tables import table_path
from kestrel.streaming.session_state import NO_SEQ, STATE_STORE, TAIL_ROW, SessionTail, batch_tails

WATERMARK = "10 minutes"


def table_stream(spark: SparkSession, sf_dir: str, name: str, max_files: int | None = None) -> DataFrame:
    """A file stream over a table. A table may be one file or a folder of files;
    the source is given as a glob so both shapes list as the stream's files."""
    path = table_path(sf_dir, name)
    r = spark.readStream.schema(spark.read.parquet(path).schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    glob = path[:-1] + "[" + path[-1] + "]"
    return r.parquet(glob)


def _run_versioned(stream: DataFrame, name: str, mode: str, root: str | None = None) -> str:
    """Run to completion; batch ``b`` lands in ``<out>/_batch=b`` (read back with a ``_batch`` column)."""
    spark = stream.sparkSession
    root = root or scratch_path(spark, f"stream-{name}-{uuid.uuid4().hex[:12]}")
    out = f"{root}/out"

    def sink(batch: DataFrame, batch_id: int) -> None:
        # One folder per batch id, overwritten on a retry: a replayed batch
        # replaces its own output instead of adding a second copy.
        batch.write.mode("overwrite").parquet(f"{out}/_batch={batch_id}")

    q = (stream.writeStream.outputMode(mode).foreachBatch(sink)
         .option("checkpointLocation", f"{root}/checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return out


def _versions(spark: SparkSession, out: str, schema: T.StructType) -> DataFrame:
    """All emitted rows with their batch id."""
    schema = T.StructType([*schema.fields, T.StructField("_batch", T.LongType())])
    try:
        return spark.read.schema(schema).parquet(out)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)  # nothing was emitted


def _latest(spark: SparkSession, out: str, keys: list[str], schema: T.StructType) -> DataFrame:
    """Latest emitted version of each key (max batch id)."""
    rows = _versions(spark, out, schema)
    payload = [c for c in rows.columns if c not in keys and c != "_batch"]
    latest = F.max_by(F.struct(*[F.col(c) for c in payload]), F.col("_batch"))
    return rows.groupBy(*keys).agg(latest.alias("_v")).select(*keys, "_v.*")


def _event_time(df: DataFrame) -> DataFrame:
    """Streams need TIMESTAMP event time; the tables hold zone-less timestamps (UTC)."""
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def stream_rate_limit(spark: SparkSession, sf_dir: str, limit: int = 1, root: str | None = None) -> DataFrame:
    """Clients over ``limit`` requests in a 1-minute window (twin: rate_limit_breaches)."""
    return rate_limit_over(table_stream(spark, sf_dir, "events"), limit, root=root)


def rate_limit_over(events: DataFrame, limit: int = 1, watermark: str = WATERMARK, root: str | None = None) -> DataFrame:
    """The rate-limit stream over any events stream; rows older than the
    watermark (max event time seen minus ``watermark``) are dropped as late.
    Spark applies a batch's watermark to late input from the following batch
    on, so a row is dropped once the watermark was already past it when its
    batch began."""
    spark = events.sparkSession
    log = _event_time(LM.request_log_from(events))
    per = (log.withWatermark("ts", watermark)
              .groupBy(F.window("ts", "1 minute").alias("w"), rate_limit_key("api_key", "ip").alias("client"))
              .agg(F.count(F.lit(1)).alias("requests")))
    flagged = per.filter(F.col("requests") > limit).select(
        "client", F.col("w.start").cast("timestamp_ntz").alias("window_start"), "requests",
        (F.col("requests") - limit).alias("rejected"))
    out = _run_versioned(flagged, "rate-limit", "update", root)
    schema = T.StructType([T.StructField("client", T.StringType()), T.StructField("window_start", T.TimestampNTZType()),
                           T.StructField("requests", T.LongType()), T.StructField("rejected", T.LongType())])
    return _latest(spark, out, ["client", "window_start"], schema)


def stream_metrics(spark: SparkSession, sf_dir: str, window: str = "10 minutes", root: str | None = None) -> DataFrame:
    """Per tumbling window: requests, failures, cache hits, prompt/completion tokens."""
    log = _event_time(LM.request_log_from(table_stream(spark, sf_dir, "events")))
    per = (log.withWatermark("ts", WATERMARK)
              .groupBy(F.window("ts", window).alias("w"))
              .agg(F.count(F.lit(1)).alias("requests"), F.count_if(F.col("failed")).alias("failed"),
                   F.count_if(F.col("cached")).alias("cache_hits"),
                   F.sum("prompt_tokens").alias("prompt_tokens"),
                   F.sum("completion_tokens").alias("completion_tokens")))
    flat = per.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "requests", "failed",
                      "cache_hits", "prompt_tokens", "completion_tokens")
    out = _run_versioned(flat, "metrics", "update", root)
    schema = T.StructType([T.StructField("window_start", T.TimestampNTZType()), T.StructField("requests", T.LongType()),
                           T.StructField("failed", T.LongType()), T.StructField("cache_hits", T.LongType()),
                           T.StructField("prompt_tokens", T.LongType()),
                           T.StructField("completion_tokens", T.LongType())])
    return _latest(spark, out, ["window_start"], schema)


def keep_session_tails(lines: DataFrame, n: int, idle_batches: int = 50) -> DataFrame:
    """The last ``n`` lines of every session of a stream (session_id, seq, line).

    Every micro-batch is cut to ``n`` lines per session, joined to the stored
    tails, cut again and stored as the new tails: DataFrame operations only, and
    a huge session is trimmed before any shuffle. A session that is silent for
    more than ``idle_batches`` batches is closed: its tail moves to the closed
    sessions, so the stored tails hold no more than the active ones. Batch ``b``
    writes its own folders, overwritten on a replay. For streams without event
    times, and for one run; :func:`session_memory` resumes and closes by time."""
    spark = lines.sparkSession
    root = scratch_path(spark, f"stream-session-{uuid.uuid4().hex[:12]}")
    schema = T.StructType([*lines.schema.fields, T.StructField("seen", T.LongType())])

    def step(batch: DataFrame, b: int) -> None:
        rows = last_n_lines(batch, "session_id", "seq", n).withColumn("seen", F.lit(b).cast("long"))
        if b:
            rows = rows.unionByName(batch.sparkSession.read.schema(schema).parquet(f"{root}/tails/{b - 1}"))
        latest = rows.groupBy("session_id").agg(F.max("seen").alias("_last"))
        tails = last_n_lines(rows, "session_id", "seq", n).join(latest, "session_id").withColumn("seen", F.col("_last")).drop("_last")
        silent = F.col("seen") < b - idle_batches
        tails.filter(silent).select(*schema.names).write.mode("overwrite").parquet(f"{root}/closed/batch={b}")
        tails.filter(~silent).select(*schema.names).write.mode("overwrite").parquet(f"{root}/tails/{b}")
        last[0] = b

    last: list[int | None] = [None]
    query = (lines.writeStream.foreachBatch(step).option("checkpointLocation", f"{root}/checkpoint")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    if last[0] is None:
        return spark.createDataFrame([], lines.schema)
    closed = spark.read.schema(schema).parquet(*[f"{root}/closed/batch={b}" for b in range(last[0] + 1)])
    stored = spark.read.schema(schema).parquet(f"{root}/tails/{last[0]}")
    return last_n_lines(closed.unionByName(stored).drop("seen").distinct(), "session_id", "seq", n)


def session_memory(lines: DataFrame, n: int, idle_seconds: int = 3600, watermark: str = WATERMARK, root: str | None = None) -> DataFrame:
    """The last ``n`` lines of every session of a stream (session_id, seq, line, ts), ordered by seq, then line.

    Keyed state holds the tail of each session in the state store, so a batch
    costs what the sessions it touches cost, and only these are written. An
    event-time timer closes a session that was silent for that long: its tail is
    written once more as closed and its state goes. Lines of a session that
    comes back later are put together with its closed tails in the answer.
    Every batch of a task is cut to ``n`` lines per session before the shuffle,
    so a huge session sends each task's last lines only. Lines behind the
    watermark, or without time, are late and dropped; a null seq counts as
    the smallest, a null session is a session of its own."""
    spark, schema = lines.sparkSession, lines.select("session_id", "seq", "line").schema
    rows = lines.selectExpr("CAST(session_id AS STRING) AS session_id", f"coalesce(CAST(seq AS BIGINT), {NO_SEQ}) AS seq",
                            "line", "unix_millis(CAST(ts AS TIMESTAMP)) AS at").filter("at IS NOT NULL")
    cut = rows.mapInPandas(batch_tails(n), "session_id string, seq long, line string, at long")
    timed = cut.withColumn("ts", F.timestamp_millis("at")).withWatermark("ts", watermark)
    tails = timed.groupBy("session_id").transformWithStateInPandas(SessionTail(n, 1000 * idle_seconds), TAIL_ROW, "update", "EventTime")
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, STATE_STORE)  # read when the query starts
    try:
        out = _run_versioned(tails, "session-memory", "update", root)
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    found = _versions(spark, out, tails.schema)
    last = found.groupBy(F.col("session_id").alias("_s")).agg(
        F.max(F.when(F.col("closed"), F.col("_batch"))).alias("_closed"), F.max("_batch").alias("_newest"))
    # All closed tails, and the newest tail of a session that is still open.
    valid = F.col("closed") | (F.col("_batch") == F.col("_newest")) & (F.coalesce("_closed", F.lit(-1)) < F.col("_newest"))
    kept = found.join(last, found["session_id"].eqNullSafe(last["_s"])).filter(valid)
    tail = newest_rows(kept, ["session_id"], [F.col("seq").desc(), F.col("line").desc()], n, F.col("seq"))
    return tail.select(F.col("session_id").cast(schema["session_id"].dataType), F.expr(
        f"nullif(seq, {NO_SEQ})").cast(schema["seq"].dataType).alias("seq"), "line")


def stream_session(spark: SparkSession, sf_dir: str, n: int = 4, root: str | None = None) -> DataFrame:
    """Per-session memory kept over micro-batches: the last ``n`` lines (twin: session_last_n).

    Stand-in time of a turn: a minute per conversation and a second per turn."""
    lines = LM.session_lines_from(table_stream(spark, sf_dir, "conversations"))
    return session_memory(lines.selectExpr("session_id", "seq", "line", "timestamp_seconds(session_id * 60 + seq) AS ts"), n,
                          watermark="1 day", root=root)


def stream_dedupe(spark: SparkSession, sf_dir: str, root: str | None = None) -> DataFrame:
    """First sighting of each (user, event type) in every hour, with its time and the repeats that were dropped."""
    e = _event_time(table_stream(spark, sf_dir, "events"))
    seen = (e.withWatermark("ts", WATERMARK).groupBy(F.window("ts", "1 hour").alias("w"), "user_id", "event_type")
            .agg(F.min("ts").alias("first_ts"), (F.count(F.lit(1)) - 1).alias("dropped"))
            .select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "user_id", "event_type",
                    F.col("first_ts").cast("timestamp_ntz").alias("first_ts"), "dropped"))
    out = _run_versioned(seen, "dedupe-hourly", "update", root)
    return _latest(spark, out, ["window_start", "user_id", "event_type"], seen.schema)


def stream_questions(spark: SparkSession, sf_dir: str, root: str | None = None) -> DataFrame:
    """Each normalised question once per hour: who asked first and how often it was asked.

    Stand-in time of a turn: a minute per conversation and a second per turn."""
    q = table_stream(spark, sf_dir, "conversations").filter("role = 'user'").select(
        F.expr("timestamp_seconds(conv_id * 60 + turn)").alias("ts"),
        F.expr(f"conv_id * {LM.SEQ_STRIDE} + turn").alias("seq"), question_key(F.col("text")).alias("key"))
    asked = (q.withWatermark("ts", WATERMARK).groupBy(F.window("ts", "1 hour").alias("w"), "key")
             .agg(F.min("seq").alias("first_seq"), F.count(F.lit(1)).alias("asked"))
             .select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "key", "first_seq", "asked"))
    out = _run_versioned(asked, "questions", "update", root)
    return _latest(spark, out, ["window_start", "key"], asked.schema)


def dedupe_sightings(events: DataFrame, delay: str = "1 hour", root: str | None = None) -> str:
    """Emit each (user, event type) once per watermark delay: a repeat while the
    key's state lives is dropped, a sighting after it expired is emitted again.
    Returns the output folder (one ``_batch=b`` folder per micro-batch)."""
    e = _event_time(events)
    d = (e.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["user_id", "event_type"])
          .select("user_id", "event_type", "ts"))
    return _run_versioned(d, "dedupe", "append", root)


def stream_sightings(spark: SparkSession, sf_dir: str, delay: str = "1 hour", root: str | None = None) -> DataFrame:
    """Every (user, event type) that the deduplicated stream emitted, once; see :func:`dedupe_sightings`."""
    out = dedupe_sightings(table_stream(spark, sf_dir, "events"), delay, root)
    schema = T.StructType.fromDDL("user_id long, event_type string, ts timestamp")
    return _versions(spark, out, schema).select("user_id", "event_type").distinct()


QUANTILES = (0.5, 0.95, 0.99)


def _quantile_cols():
    qs = F.percentile_approx("latency_ms", list(QUANTILES), 10000).alias("_q")
    return [F.count(F.lit(1)).alias("requests"), qs]


def _flatten_quantiles(df: DataFrame) -> DataFrame:
    return df.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "requests",
                     *[F.col("_q")[i].alias(f"p{int(q * 100)}_latency_ms") for i, q in enumerate(QUANTILES)])


def latency_quantiles_batch(spark: SparkSession, sf_dir: str, window: str = "10 minutes") -> DataFrame:
    """Batch twin: approximate latency quantiles per tumbling window."""
    log = _event_time(LM.request_log(spark, sf_dir))
    return _flatten_quantiles(log.groupBy(F.window("ts", window).alias("w")).agg(*_quantile_cols()))


def stream_latency_quantiles(spark: SparkSession, sf_dir: str, window: str = "10 minutes", root: str | None = None) -> DataFrame:
    """Per tumbling window: request count and p50/p95/p99 latency (``percentile_approx``,
    whose buffer is a bounded sketch kept in the state store)."""
    log = _event_time(LM.request_log_from(table_stream(spark, sf_dir, "events")))
    per = log.withWatermark("ts", WATERMARK).groupBy(F.window("ts", window).alias("w")).agg(*_quantile_cols())
    out = _run_versioned(_flatten_quantiles(per), "latency-quantiles", "update", root)
    schema = T.StructType([T.StructField("window_start", T.TimestampNTZType()), T.StructField("requests", T.LongType())]
                          + [T.StructField(f"p{int(q * 100)}_latency_ms", T.LongType()) for q in QUANTILES])
    return _latest(spark, out, ["window_start"], schema)


SKETCH_K = 2048  # rank error of a sketch about 0.3 %; exact for up to so many values
_PANE = ("pane timestamp_ntz, requests long, failed long, cache_hits long, prompt_tokens long, completion_tokens long, "
         "sketch binary")


def latency_panes(log: DataFrame, pane: str, watermark: str = WATERMARK) -> DataFrame:
    """Of a request log with ``ts`` as TIMESTAMP: counters and a KLL sketch of the latency per pane, a tumbling window."""
    per = log.withWatermark("ts", watermark).groupBy(F.window("ts", pane).alias("w")).agg(
        F.count(F.lit(1)).alias("requests"), F.count_if(F.col("failed")).alias("failed"),
        F.count_if(F.col("cached")).alias("cache_hits"), F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"), F.expr(f"kll_sketch_agg_bigint(latency_ms, {SKETCH_K})").alias("sketch"))
    return per.select(F.col("w.start").cast("timestamp_ntz").alias("pane"), *[c for c in per.columns if c != "w"])


def merge_panes(panes: DataFrame, pane: str, n: int) -> DataFrame:
    """Sliding windows of ``n`` panes, one per pane: counters are added and sketches merged, no event is read again.

    A window that holds any request has a row. Quantiles are of the values
    seen in the window within the rank error of the sketch; without any
    latency they are null."""
    nth = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    windows = panes.withColumn("_nth", nth).withColumn("window_start", F.expr(f"pane - _nth * INTERVAL {pane}"))
    sums = [F.sum(c).alias(c) for c in ("requests", "failed", "cache_hits", "prompt_tokens", "completion_tokens")]
    merged = windows.groupBy("window_start").agg(*sums, F.expr("kll_merge_agg_bigint(sketch)").alias("_sketch"))
    quantile = "CASE WHEN kll_sketch_get_n_bigint(_sketch) > 0 THEN kll_sketch_get_quantile_bigint(_sketch, {q}D) END AS p{p}_latency_ms"
    return merged.selectExpr("window_start", "requests", "failed", "cache_hits", "prompt_tokens", "completion_tokens",
                             *[quantile.format(q=q, p=int(q * 100)) for q in QUANTILES])


def stream_sliding(spark: SparkSession, sf_dir: str, pane: str = "10 minutes", n: int = 6, root: str | None = None) -> DataFrame:
    """Sliding windows of ``n`` panes over the request log: an event updates its one pane in the state, windows are merged panes."""
    log = _event_time(LM.request_log_from(table_stream(spark, sf_dir, "events")))
    return sliding_over(log, pane, n, root=root)


def sliding_over(log: DataFrame, pane: str, n: int, watermark: str = WATERMARK, root: str | None = None) -> DataFrame:
    out = _run_versioned(latency_panes(log, pane, watermark), "sliding", "update", root)
    panes = _latest(log.sparkSession, out, ["pane"], T.StructType.fromDDL(_PANE))
    return merge_panes(panes, pane, n)
