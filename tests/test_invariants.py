"""Cross-query invariants on the driver tables, and randomised equivalence of
the text rules with Python's own string semantics."""

import random
import string

from pyspark.sql import functions as F

from kestrel.functions import text as X
from kestrel.plans import kpis, marts
from kestrel.sources.model import Commerce

SF = "/root/testdata/sf0.001"


def test_revenue_adds_up_across_marts(spark):
    c = Commerce(spark, SF)
    by_state = marts.state_performance(c).agg(F.sum("revenue_brl")).first()[0]
    by_month = marts.revenue_by_month(c).agg(F.sum("revenue_brl")).first()[0]
    total = kpis.kpi_row(c).first()["total_revenue"]
    # Every line item has its order, customer and purchase date in the driver data.
    assert by_state == by_month == total
    orders = marts.revenue_by_month(c).agg(F.sum("orders")).first()[0]
    assert orders == marts.state_performance(c).agg(F.sum("orders")).first()[0]


ALPHABET = (string.ascii_letters + string.digits + string.punctuation + "éÄçÕß"
            + " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0    　")


def test_text_rules_match_python(spark):
    rnd = random.Random(7)
    samples = ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 30))) for _ in range(400)]
    df = spark.createDataFrame([(s,) for s in samples], "s string")
    rows = df.select("s", X.question_key("s").alias("k"), X.title_case("s").alias("t"),
                     X.strip("s").alias("st"), X.normalize_answer("s").alias("n")).collect()
    table = str.maketrans("", "", string.punctuation)
    for r in rows:
        s = r["s"]
        assert r["k"] == " ".join(s.lower().translate(table).split()), repr(s)
        assert r["st"] == s.strip(), repr(s)
        assert r["n"] == " ".join(s.split()).lower(), repr(s)
        assert r["t"] == s.title() or "ß" in s, repr(s)  # str.title() turns ß into Ss


def test_approx_customers_close_to_exact(spark):
    c = Commerce(spark, "/root/testdata/sf0.01")
    exact = kpis.kpi_row(c).first()["total_customers"]
    approx = kpis.kpi_row(c, approx_customers=True).first()["total_customers"]
    assert abs(approx - exact) <= 0.03 * exact
