from pyspark.sql import functions as F
"""Golden scoring, state and rate lookups, chart hints and trace shaping."""

from datetime import date

from kestrel.operators import evaluate as EV
from kestrel.operators import lookups as LK
from kestrel.operators import shape as SH

GOLDEN = "id string, question string, contains array<string>, max_latency_ms long"
ANSWERS = "id string, answer string, latency_ms long, prompt_tokens long, completion_tokens long, error string"


def test_scoring_cases(spark):
    golden = spark.createDataFrame([
        ("orders_count", "How many?", ["99,441"], None),
        ("capital", "Capital?", ["Rio de Janeiro"], 15000),
        ("cats", "Top?", ["health_beauty", "toys"], None),
        ("slow", "anything?", ["ok"], 1),
        ("err", "?", ["x"], None),
        ("nbsp", "?", ["São Paulo"], None),
        ("unanswered", "?", ["y"], None),
    ], GOLDEN)
    answers = spark.createDataFrame([
        ("orders_count", "There are 99,441 orders.", 120, 10, 5, None),
        ("capital", "the capital is rio de janeiro.", 100, 1, 1, None),
        ("cats", "health_beauty is top", 100, 1, 1, None),
        ("slow", "ok", 50, 0, 0, None),
        ("err", None, 3, None, None, "RuntimeError('nope')"),
        ("nbsp", "in são paulo", 10, 0, 0, None),
    ], ANSWERS)
    r = {x["id"]: x for x in EV.score_cases(golden, answers).collect()}
    assert r["orders_count"]["passed"] and r["orders_count"]["missing"] == [] and not r["orders_count"]["slow"]
    assert (r["orders_count"]["prompt_tokens"], r["orders_count"]["completion_tokens"]) == (10, 5)
    assert r["capital"]["passed"]
    assert r["cats"]["missing"] == ["toys"] and not r["cats"]["passed"]
    assert r["slow"]["passed"] and r["slow"]["slow"]
    assert not r["err"]["passed"] and "nope" in r["err"]["error"] and r["err"]["missing"] == ["x"]
    assert r["nbsp"]["passed"]
    assert r["unanswered"]["error"] == "no answer" and not r["unanswered"]["passed"]
    s = EV.summarize(EV.score_cases(golden, answers)).collect()[0]
    assert (s["passed"], s["n"], s["slow"]) == (4, 7, 1)
    assert s["pass_pct"] == round(4 / 7 * 100, 1)
    assert s["avg_latency_ms"] == (120 + 100 + 100 + 50 + 3 + 10 + 0) // 7
    assert s["total_tokens"] == 19 and abs(s["cost_usd"] - 19 / 1e6 * 0.075) < 1e-15


def test_only_filter(spark):
    golden = spark.createDataFrame([("a", "q", [], None), ("b", "q", [], None)], GOLDEN)
    assert [r["id"] for r in EV.select_cases(golden, ["b"]).collect()] == ["b"]


def test_state_lookup(spark):
    df = spark.createDataFrame([("RJ",), ("mg",), (" sp ",), ("ZZ",), ("SPX",)], "code string")
    got = [r["state_info"] for r in LK.lookup_states(df, "code").collect()]
    assert got == ["RJ = Rio de Janeiro (capital: Rio de Janeiro)", "MG = Minas Gerais (capital: Belo Horizonte)",
                   "SP = São Paulo (capital: São Paulo)", "No Brazilian state found for code 'ZZ'.",
                   "SP = São Paulo (capital: São Paulo)"]
    assert LK.state_dimension(spark).count() == 27


def _rates(spark, rows):
    return spark.createDataFrame(rows, LK.RATE_SCHEMA)


def test_latest_rate_and_fallback(spark):
    r = LK.latest_rate(_rates(spark, [(date(2025, 1, 14), "BRL", "USD", 0.19), (date(2025, 1, 15), "BRL", "USD", 0.1995)])).collect()[0]
    assert (r["rate"], r["is_fallback"], r["rate_date"]) == (0.1995, False, "2025-01-15")
    r = LK.latest_rate(_rates(spark, [])).collect()[0]
    assert (r["rate"], r["is_fallback"]) == (0.20, True)


def test_as_of_rate(spark):
    rates = _rates(spark, [(date(2020, 1, 10), "BRL", "USD", 0.25), (date(2020, 3, 1), "BRL", "USD", 0.21)])
    facts = spark.createDataFrame([(date(2020, 1, 5),), (date(2020, 1, 10),), (date(2020, 2, 28),), (date(2020, 6, 1),),
                                   (date(2147, 6, 1),)], "d date")
    got = [(r["d"], r["rate"], r["is_fallback"]) for r in LK.as_of_rate(facts, "d", rates).orderBy("d").collect()]
    assert got == [(date(2020, 1, 5), 0.20, True), (date(2020, 1, 10), 0.25, False),
                   (date(2020, 2, 28), 0.25, False), (date(2020, 6, 1), 0.21, False),
                   (date(2147, 6, 1), 0.21, False)]


def test_chart_hint(spark):
    line = spark.createDataFrame([("2017-01", 1.0), ("2017-02", 2.0), ("2017-03", 3.0)], "m string, v double")
    assert SH.chart_hint(line).collect()[0]["chart"] == "line"
    bar = spark.createDataFrame([("health_beauty", 10), ("SP", 3)], "c string, v long")
    assert SH.chart_hint(bar).collect()[0]["chart"] == "bar"
    two_dates = spark.createDataFrame([("2017-01", 1.0), ("2017-02", 2.0)], "m string, v double")
    assert SH.chart_hint(two_dates).collect()[0]["chart"] == "bar"
    text_y = spark.createDataFrame([("a", "x"), ("b", "y")], "c string, v string")
    assert SH.chart_hint(text_y).collect()[0]["chart"] == "none"
    one_row = spark.createDataFrame([("a", 1)], "c string, v long")
    assert SH.chart_hint(one_row).collect()[0]["chart"] == "none"
    many = spark.createDataFrame([(f"c{i}", i) for i in range(25)], "c string, v long")
    assert SH.chart_hint(many).collect()[0]["chart"] == "none"


def test_trace_shaping_and_last_sql_step(spark):
    steps = [("sql_db_query", "SELECT 1", "[(1, 2), (3, 4)]"), ("web", "x" * 900, "y" * 2000),
             ("sql_db_query", "SELECT bad", "Error: boom"), ("sql_db_schema", "t", "CREATE TABLE t")]
    df = spark.createDataFrame([(1, steps)], f"trace_id int, steps array<{SH.STEP}>")
    shaped = SH.shape_trace(df).collect()[0]["steps"]
    assert len(shaped[1]["tool_input"]) == 500 and len(shaped[1]["observation"]) == 1000
    r = SH.last_sql_step(df).collect()[0]
    assert (r["sql_text"], r["sql_rows"]) == ("SELECT 1", "[(1, 2), (3, 4)]")


def test_last_sql_step_needs_two_columns(spark):
    steps = [("sql_db_query", "SELECT a, b", "[('x', 1), ('y', 2)]"),
             ("sql_db_query", "SELECT a", "[(1,), (2,)]")]
    df = spark.createDataFrame([(1, steps)], f"trace_id int, steps array<{SH.STEP}>")
    assert SH.last_sql_step(df).collect()[0]["sql_text"] == "SELECT a, b"


def test_row_lists(spark):
    cases = {
        "[('a', 1), ('b', 2)]": True, " [[1, 2], [3, 4], ] ": True, "[('it\\'s', None), (\"q(,)\", -1.5e-3)]": True,
        "[('a', 1)]": True, "[(1, 2,), (3, 4)]": True, "[('a', 1), ('b', 2, 3)]": False, "[(1,), (2,)]": False,
        "[1, 2]": False, "[]": False, "('a', 1)": False, "[(v, 1)]": False, "[(a, 1)]": False, "[('a', 1)": False,
        "[(date(2020, 1), 1)]": False, "Error: [('a', 1)]": False, "": False, "[('v', 'v')]": True,
    }
    rows = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r.t: r.ok for r in rows.select("t", SH.is_row_list(F.col("t")).alias("ok")).collect()}
    assert got == cases
    long = "[('" + "x" * 200_000 + "', 1)]"
    assert spark.createDataFrame([(long,)], "t string").select(SH.is_row_list(F.col("t")).alias("ok")).first().ok


def test_chart_hint_reports_every_row(spark):
    rows = spark.range(5000).selectExpr("CAST(id AS STRING) AS x", "id AS y")
    assert SH.chart_hint(rows).first()["rows"] == 5000
