"""Scalar Column functions: the trap rows T1, T2, T6, T8, T10 and the text helpers."""

import hashlib
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from kestrel.functions import metrics as M
from kestrel.functions import text as X
from kestrel.functions.formatting import compact_brl, pct1, thousands
from kestrel.functions.numeric import round_ratio
from kestrel.functions.time import lenient_timestamp, year_month


def one(spark, col, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(col).collect()]


def test_title_case_splits_on_every_non_letter(spark):
    got = one(spark, X.clean_city("c"), [("  santa bárbara d'oeste ",), ("mogi-guacu",), ("SÃO PAULO",), (None,)],
              "c string")
    assert got == ["Santa Bárbara D'Oeste", "Mogi-Guacu", "São Paulo", None]


def test_title_case_matches_python_title(spark):
    samples = ["rio de janeiro", "1st avenue", "o'neil-smith", "élan vital", "a1b2c"]
    got = one(spark, X.title_case("c"), [(s,) for s in samples], "c string")
    assert got == [s.title() for s in samples]


def test_zfill_never_truncates(spark):
    got = one(spark, X.zfill("z"), [("1037",), ("01037",), ("123456",), (None,)], "z string")
    assert got == ["01037", "01037", "123456", None]


def test_state_upper_first_two(spark):
    assert one(spark, X.clean_state("s"), [("sp",), ("rjx",), (None,)], "s string") == ["SP", "RJ", None]


def test_strip_removes_unicode_whitespace(spark):
    assert one(spark, X.strip("s"), [("  x y\t\n",)], "s string") == ["x y"]


def test_question_key_variants_collapse(spark):
    qs = ["How many orders?", "how many orders", "How, many orders!", "   how   many orders?   "]
    keys = one(spark, X.question_key("q"), [(q,) for q in qs], "q string")
    assert set(keys) == {"how many orders"}


def test_normalize_answer_handles_narrow_nbsp(spark):
    got = one(spark, X.normalize_answer("a"), [("São Paulo  IS", )], "a string")
    assert got == ["são paulo is"]


def test_redact(spark):
    got = one(spark, X.redact("v"), [("alice",), ("",), (None,)], "v string")
    assert got == [hashlib.sha256(b"alice").hexdigest()[:12], "-", "-"]


@pytest.mark.parametrize("value,expected", [
    ("2017-01-15", True), ("2017-01", True), ("2017", True), (" 2017-01 ", True),
    ("health_beauty", False), ("SP", False), ("", False),
])
def test_looks_like_date(spark, value, expected):
    assert one(spark, X.looks_like_date("v"), [(value,)], "v string") == [expected]


def test_delivery_days_floors_elapsed_periods(spark):
    rows = [(datetime(2018, 1, 1, 23, 0), datetime(2018, 1, 2, 1, 0)),
            (datetime(2018, 1, 2, 6, 0), datetime(2018, 1, 2, 0, 0)),
            (datetime(2018, 1, 1, 0, 0), datetime(2018, 1, 4, 0, 0)),
            (datetime(2018, 1, 1, 0, 0), None)]
    got = one(spark, M.delivery_days("a", "b"), rows, "a timestamp_ntz, b timestamp_ntz")
    assert got == [0, -1, 3, None]


def test_is_late_never_null(spark):
    rows = [(datetime(2018, 1, 5), datetime(2018, 1, 4)), (None, datetime(2018, 1, 4)),
            (datetime(2018, 1, 3), datetime(2018, 1, 4))]
    got = one(spark, M.is_late("d", "e"), rows, "d timestamp_ntz, e timestamp_ntz")
    assert got == [True, False, False]


def test_lenient_timestamp(spark):
    rows = [("2017-10-02 10:56:33",), ("not a date",), ("2018-01-01",), (None,)]
    got = one(spark, lenient_timestamp("t"), rows, "t string")
    assert got == [datetime(2017, 10, 2, 10, 56, 33), None, None, None]


def test_money_is_exact_decimal(spark):
    df = spark.createDataFrame([(0.01,)] * 1000 + [(2.345,), (0.005,)], "p double")
    total = df.agg(F.sum(M.money("p")).alias("s")).collect()[0]["s"]
    assert str(total) == "12.36"  # 1000 x 0.01 + 2.35 + 0.01 (HALF_UP casts)


def test_round_ratio_half_up_exact(spark):
    rows = [(2345, 1000), (-2345, 1000), (1, 3), (5, 0), (1, 8)]
    got = one(spark, round_ratio("a", "b", 2), rows, "a long, b long")
    assert got == [2.35, -2.35, 0.33, None, 0.13]


def test_compact_money_text(spark):
    got = one(spark, compact_brl("v"), [(5921678.12,), (1250.0,), (999.5,), (1234567.0,)], "v double")
    assert got == ["R$ 5.92M", "R$ 1.3K", "R$ 999.50", "R$ 1.23M"]


def test_number_formats(spark):
    df = spark.createDataFrame([(1234567, 12.345, datetime(2017, 1, 15))], "n long, p double, d timestamp_ntz")
    r = df.select(thousands("n"), pct1("p"), year_month("d")).collect()[0]
    assert list(r) == ["1,234,567", "12.3%", "2017-01"]


def test_exact_arithmetic_on_decimals(spark):
    df = spark.createDataFrame([("5921678.12", "0.2009"), ("10", "4")], "a string, b string")
    a, b = F.col("a").cast("decimal(20,2)"), F.col("b").cast("decimal(10,4)")
    r = df.select(F.round(a * b, 2).alias("m"), F.round(a / b, 2).alias("d")).collect()
    assert str(r[0]["m"]) == "1189665.13"
    assert str(r[1]["d"]) == "2.50"


def test_fast_cents_equal_decimal_path(spark):
    vals = [0.01, 2.345, 0.005, 1234.56, 99999.99, 1.0000001, 12.5, -3.455, 1e9 + 0.01, None]
    taxes = [0.0, 0.08, 0.075, 0.05, 0.01, 0.02, 0.04, 0.06, 0.07, 0.03]
    df = spark.createDataFrame(list(zip(vals, taxes)), "p double, t double")
    cents = M.cents_of_sql("p")
    fast = f"{cents} + {M.freight_cents_sql(cents, 't')} AS fast"
    slow = f"{M.to_cents_sql(M.money_sql('p'))} + {M.to_cents_sql(M.freight_sql('p', 't'))} AS slow"
    rows = df.selectExpr(fast, slow).collect()
    assert [r["fast"] for r in rows] == [r["slow"] for r in rows]
