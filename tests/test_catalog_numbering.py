"""Catalog listing, numbering over appended parts, foreign keys by domain, SQL functions of the surface."""

import random
from datetime import datetime, timedelta

import pytest

from kestrel.operators import catalog
from kestrel.operators import lookups as LK
from kestrel.operators.guard import SURFACE_TABLES, guarded_sql
from kestrel.operators.integrity import ForeignKey, fk_report
from kestrel.operators.logs import assign_seq
from kestrel.operators.numbering import NumberedLog
from kestrel.plans import surface as SF

SF_DIR = "/root/testdata/sf0.001"
LOG = "session long, ts timestamp_ntz, line string"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_catalog_counts_come_from_footers_and_new_views_appear(spark):
    session = catalog.footer_session(spark)
    assert catalog.list_catalog(session).collect() == []
    catalog.register_tables(session, SF_DIR, ("orders", "nation"))
    listing = catalog.list_catalog(session)
    assert plan(listing).count("PushedAggregation: [COUNT(*)]") == 2
    session.range(7).selectExpr("id", "id AS twice").createOrReplaceTempView("fresh_view")
    rows = {r.table_name: (r.columns, r.row_count) for r in catalog.list_catalog(session).collect()}
    tables = {n: spark.read.parquet(f"{SF_DIR}/{n}.parquet") for n in ("orders", "nation")}
    assert rows == {"fresh_view": (2, 7), **{n: (len(df.columns), df.count()) for n, df in tables.items()}}
    assert "fresh_view" not in {t.name for t in spark.catalog.listTables()}


def _log_parts(seed):
    r, start = random.Random(seed), datetime(2024, 1, 1)
    rows = [(r.choice([1, 1, 1, 2, 3, None, r.randrange(40)]), start + timedelta(minutes=i // 2), f"line {i}") for i in range(400)]
    return [rows[:100], rows[100:300], rows[300:]]


def _numbers(rows):
    return sorted(str((r.session, r.ts, r.line, r.seq)) for r in rows.collect())


def test_numbers_over_appended_parts_equal_one_batch(spark, tmpdir_path):
    parts = _log_parts(3)
    whole = spark.createDataFrame([x for p in parts for x in p], LOG)
    log = NumberedLog(spark, f"{tmpdir_path}/log", whole.schema, "session", "ts", "line", 8).create()
    for k, part in enumerate(parts):
        log.append(k, spark.createDataFrame(part, LOG))
    log.append(3, whole.limit(0))
    before = _numbers(log.read())
    for k in (1, 2, 0):
        log.append(k, spark.createDataFrame(parts[k], LOG))  # a replay changes nothing
    assert _numbers(log.read()) == before
    assert _numbers(log.read()) == _numbers(assign_seq(whole, "session", "ts", "line"))


def test_numbering_goes_on_after_a_job_that_died_before_the_marks(spark, tmpdir_path, monkeypatch):
    from kestrel.operators import numbering
    parts = _log_parts(4)
    whole = spark.createDataFrame([x for p in parts for x in p], LOG)
    log = NumberedLog(spark, f"{tmpdir_path}/log", whole.schema, "session", "ts", "line", 8).create()

    def dies(*args):
        raise RuntimeError("lost")
    for k, part in enumerate(parts):
        with monkeypatch.context() as m, pytest.raises(RuntimeError):
            m.setattr(numbering, "merge_delta", dies)
            log.append(k, spark.createDataFrame(part, LOG))
        log.append(k, spark.createDataFrame(part, LOG))
    assert _numbers(log.read()) == _numbers(assign_seq(whole, "session", "ts", "line"))


def test_foreign_keys_by_domain(spark):
    r = random.Random(5)
    rows = [(r.choice([None, 7, 7, 7, r.randrange(80)]), r.choice(["a", "b", None])) for _ in range(500)]
    tables = {"p": spark.createDataFrame([(k,) for k in [*range(50), None, 3]], "id long"),
              "q": spark.createDataFrame([("a",), ("it's",)], "id string"),
              "c": spark.createDataFrame(rows, "`p id` long, q string"), "d": spark.createDataFrame([], "p int")}
    fks = (ForeignKey("c", "p id", "p", "id"), ForeignKey("d", "p", "p", "id"), ForeignKey("c", "q", "q", "id"))
    report = fk_report(tables, fks)
    assert set(map(tuple, report.collect())) == {
        ("c", "p id", "p", "id", sum(k is not None and k >= 50 for k, _ in rows)), ("d", "p", "p", "id", 0),
        ("c", "q", "q", "id", sum(q == "b" for _, q in rows))}
    # One exchange by key per domain, and no join.
    p = plan(fk_report(tables, fks))
    assert p.count("Exchange hashpartitioning") == 2 and "Join" not in p


def test_functions_of_the_surface_agree_with_the_lookups(spark):
    session = SF.surface_session(spark, SF_DIR)
    codes = ["SP", " sp", "rj ", "zz", "", "São", "df\n", "'x", "PAR"]
    frame = session.createDataFrame([(c,) for c in codes], "code string")
    want = {r.code: r.state_info for r in LK.lookup_states(frame, "code").collect()}
    assert {r.code: r.text for r in frame.selectExpr("code", "state_info(code) AS text").collect()} == want
    row = session.sql("SELECT to_usd(100.00) AS usd, to_usd(NULL) AS none, item_revenue(1.25, 0.50) AS r, state_info(NULL) AS s, "
                      "delivered_late(TIMESTAMP_NTZ'2024-01-02 00:00:00', TIMESTAMP_NTZ'2024-01-01 00:00:00') AS late, "
                      "delivered_late(NULL, TIMESTAMP_NTZ'2024-01-01 00:00:00') AS open").first()
    assert (float(row.usd), row.none, float(row.r), row.late, row.open) == (19.95, None, 1.75, True, False)
    assert row.s == "No Brazilian state found for code ''."


def test_guarded_statements_call_them_and_stay_guarded(spark):
    out = SF.guarded_functions(spark, SF_DIR)
    assert out.columns == ["state", "state_text", "revenue_usd", "with_fee", "late_orders"] and out.count() > 0
    session = SF.surface_session(spark, SF_DIR)
    assert guarded_sql(session, "SELECT to_usd(revenue_brl) AS usd FROM mart_state_performance", SURFACE_TABLES).columns == ["usd"]
    for bad in ("SELECT state_info(state) FROM parquet.`/root/testdata/sf0.001/nation.parquet`",
                "SELECT to_usd(1), state_info(collect_list(state)[0]) FROM customers",
                "SELECT unknown_function(state) FROM customers",
                "CREATE TEMPORARY FUNCTION f() RETURNS INT RETURN 1"):
        assert guarded_sql(session, bad, SURFACE_TABLES).columns == ["error"]
    # They live in the surface's own session.
    with pytest.raises(Exception, match="UNRESOLVED_ROUTINE"):
        spark.sql("SELECT to_usd(1)").collect()
