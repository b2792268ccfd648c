"""Medians and modes without large buffers, incremental merge, rolling percentiles."""

import os
import random
import statistics

import pytest
from pyspark.sql import functions as F

from kestrel.operators import impute
from kestrel.operators.merge import BUCKET, create_store, merge_delta, newest_per_key, read_store
from kestrel.operators.rolling import rolling_percentiles
from kestrel.operators.rollup import modal_rollup
from kestrel.operators.slices import SLICE, range_slices


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# ---- medians ---------------------------------------------------------------------

@pytest.mark.parametrize("seed", range(4))
def test_medians_equal_python(spark, seed):
    r = random.Random(seed)
    rows = [(r.choice(["hot", "hot", "a", "b", None]), r.choice([None, r.randrange(6), -r.random()]), r.choice([None, 3, 4, 4]))
            for _ in range(400)] + [("one", 5.0, None), ("empty", None, None)]
    rows = [(g, None if v is None else float(v), n) for g, v, n in rows]
    df = spark.createDataFrame(rows, "g string, v double, n int").repartition(7)

    def mid(values):
        values = [x for x in values if x is not None]
        return statistics.median(values) if values else None

    got = {r["g"]: (r["v"], r["n"]) for r in impute.medians(df, ["v", "n"], ["g"]).collect()}
    want = {g: tuple(mid([x[i] for x in rows if x[0] == g]) for i in (1, 2)) for g in {x[0] for x in rows}}
    assert got == {g: m for g, m in want.items() if m != (None, None)}
    assert tuple(impute.medians(df, ["v", "n"]).first()) == tuple(mid([x[i] for x in rows]) for i in (1, 2))


def test_median_of_a_million_distinct_values_is_spread(spark):
    n = 1_000_001
    df = spark.range(n).select(F.lit("g").alias("g"), ((F.col("id") * 7919) % n / 8).alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        counts = impute.value_counts(df, ["v"], [])
        sliced = range_slices(counts, ["_c", "_v"], "test")
        sizes = [r["count"] for r in sliced.groupBy(SLICE).count().collect()]
        pieces = impute.middle_pieces(sliced, []).collect()
        assert len(sizes) == 4 and max(sizes) < n / 2 and len(pieces) <= 2
        assert impute.medians(df, ["v"]).first()["v"] == (n // 2) / 8
        assert impute.medians(df, ["v"], ["g"]).first()["v"] == (n // 2) / 8
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_only_the_middle_slices_are_read(spark):
    sliced = range_slices(impute.value_counts(spark.range(1000).selectExpr("id AS v"), ["v"], []), ["_c", "_v"], "test")
    at = [r[SLICE] for r in impute.middle_pieces(sliced, []).collect()]
    assert f"{SLICE}" in _plan(sliced.filter(F.col(SLICE).isin(at))).split("PartitionFilters")[1]


def test_medians_of_an_empty_table(spark):
    df = spark.createDataFrame([], "g string, v double")
    assert impute.medians(df, ["v"], ["g"]).count() == 0
    assert impute.medians(df, ["v"]).first()["v"] is None
    assert impute.impute_group_then_global(df, "g", ["v"]).count() == 0


# ---- modes -----------------------------------------------------------------------

def test_mode_ties_nulls_and_null_keys(spark):
    rows = [("k", "b", 1.0), ("k", "a", 2.0), ("k", None, None), (None, "x", 4.0), ("nulls", None, 1.0), ("m", "z", 1.0), ("m", "z", 1.0), ("m", "a", 1.0)]
    got = {r["k"]: (r["v"], r["c"], r["n"]) for r in modal_rollup(
        spark.createDataFrame(rows, "k string, c string, v double").withColumn("n", F.length("c")), "k", ["v"], ["c", "n"]).collect()}
    assert got == {"k": (1.5, "a", 1), None: (4.0, "x", 1), "nulls": (1.0, None, None), "m": (1.0, "z", 1)}


def test_mode_of_a_million_distinct_values(spark):
    df = spark.range(1_000_000).select(F.lit(1).alias("k"), F.when(F.col("id") % 1000 == 7, F.lit("often")).otherwise(
        F.concat(F.lit("v"), F.col("id"))).alias("c"))
    rolled = modal_rollup(df, "k", [], ["c"])
    assert rolled.first()["c"] == "often"
    assert "mode(" not in _plan(rolled) and "collect" not in _plan(rolled)


# ---- merge -----------------------------------------------------------------------

SCHEMA = "k string, seq long, v string"


def _files(path):
    return {(d, f): os.stat(os.path.join(path, d, f)).st_mtime_ns
            for d in os.listdir(path) if d.startswith(BUCKET) for f in os.listdir(os.path.join(path, d)) if f.endswith(".parquet")}


def test_merged_deltas_equal_one_batch_in_any_order(spark, tmpdir_path):
    r = random.Random(5)
    rows = [(r.choice(["hot", None, *map(str, range(60))]), r.choice([None, *range(50)]), r.choice([None, "a", "b"])) for _ in range(500)]
    whole = newest_per_key(spark.createDataFrame(rows, SCHEMA), ["k"], "seq")
    for name, parts in (("abc", [rows[:100], rows[100:300], rows[300:]]), ("cba", [rows[300:], rows[100:300], rows[:100]])):
        path = f"{tmpdir_path}/{name}"
        create_store(spark.createDataFrame(parts[0], SCHEMA), path, ["k"], "seq", 8)
        for part in parts[1:]:
            merge_delta(spark.createDataFrame(part, SCHEMA), path, ["k"], "seq", 8)
        got = read_store(spark, path, whole.schema)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, whole.collect()))


def test_untouched_buckets_keep_their_files_and_a_replay_writes_nothing(spark, tmpdir_path):
    path = f"{tmpdir_path}/t"
    create_store(spark.createDataFrame([(str(i), 1, "old") for i in range(200)], SCHEMA), path, ["k"], "seq", 16)
    before = _files(path)
    delta = spark.createDataFrame([("5", 2, "new"), ("6", 0, "late"), ("fresh", 1, "x")], SCHEMA)
    touched = merge_delta(delta, path, ["k"], "seq", 16)
    after = _files(path)
    assert 1 <= len(touched) <= 2 and len({d for d, _ in before}) > 10
    changed = {d for d in {d for d, _ in before | after} if {x for x in before.items() if x[0][0] == d} != {x for x in after.items() if x[0][0] == d}}
    assert changed == {f"{BUCKET}={b}" for b in touched}
    assert merge_delta(delta, path, ["k"], "seq", 16) == [] and _files(path) == after
    got = {r["k"]: r["v"] for r in read_store(spark, path, delta.schema).collect()}
    assert len(got) == 201 and got["5"] == "new" and got["6"] == "old" and got["fresh"] == "x"


def test_delta_with_other_column_order_and_empty_delta(spark, tmpdir_path):
    path = f"{tmpdir_path}/t"
    create_store(spark.createDataFrame([("a", 1, "x")], SCHEMA), path, ["k"], "seq", 4)
    assert merge_delta(spark.createDataFrame([], SCHEMA), path, ["k"], "seq", 4) == []
    merge_delta(spark.createDataFrame([("y", "a", 2)], "v string, k string, seq long"), path, ["k"], "seq", 4)
    assert [tuple(r) for r in read_store(spark, path, spark.createDataFrame([], SCHEMA).schema).collect()] == [("a", 2, "y")]


# ---- rolling percentiles ---------------------------------------------------------

def _rank(values, p):
    s = sorted(values)
    return s[max(0, min(len(s) - 1, round(p * (len(s) - 1))))]


@pytest.mark.parametrize("n,slice_rows", [(7, 10), (50, 1), (1000, 20_000), (1, 3)])
def test_rolling_percentiles_equal_python(spark, n, slice_rows):
    r = random.Random(n)
    rows = [(i, r.choice(["hot", "hot", "b", None]), r.randrange(30), r.choice([None, *range(20)])) for i in range(300)]
    got = rolling_percentiles(spark.createDataFrame(rows, "id long, g string, ts long, ms long"), "g", ["ts", "id"], "ms", n, slice_rows)
    want = {}
    for g in ("hot", "b", None):
        seen = []
        for i, _, _, ms in sorted((x for x in rows if x[1] == g and x[3] is not None), key=lambda x: (x[2], x[0])):
            seen.append(ms)
            want[i] = (*[_rank(seen[-n:], p) for p in (0.5, 0.95, 0.99)], min(len(seen), n))
    assert {x["id"]: (x["p50_ms"], x["p95_ms"], x["p99_ms"], x["ms_samples"]) for x in got.collect()} == want


def test_a_hot_group_is_cut_into_slices(spark):
    log = spark.range(5000).select("id", F.lit("hot").alias("g"), (F.col("id") % 97).alias("ms"))
    got = rolling_percentiles(log, "g", ["id"], "ms", 100, slice_rows=500)
    assert got.count() == 5000 and got.filter("ms_samples < 100").count() == 99
    assert "_at" in _plan(got)
