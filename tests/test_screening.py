"""Valuation, faults, policy, reports, health and the whole run."""

import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from accountloom import spec
from accountloom.operators import health, policy, results, valuation
from accountloom.plans import screening
from accountloom.sources import records, sinks
from tests.test_companies import make_store

LINES = {"revenue": 1000.0, "ebit": 150.0, "depreciation_amortisation": 40.0, "interest_expense": 10.0, "pretax_income": 140.0, "tax_expense": 35.0,
         "net_income": 100.0, "cash": 100.0, "short_term_investments": 0.0, "total_current_assets": 400.0, "total_current_liabilities": 250.0,
         "short_term_debt": 50.0, "long_term_debt": 200.0, "preferred_stock": 0.0, "minority_interest": 5.0, "total_equity": 500.0,
         "equity_method_investments": 0.0, "total_assets": 1100.0, "capex": 70.0, "acquisitions_net": 10.0}
PARAMS = {"risk_free_rate": 0.025, "mature_market_erp": 0.045, "long_run_nominal_growth": 0.025, "crp": 0.01, "tax_rate": 0.25,
          "unlevered_beta": 0.9, "sales_to_capital": 1.5, "ebit_margin": 0.12, "roic": 0.12}


def company(spark, **extra):
    df = spark.range(1).select(F.lit("A").alias("lei"), F.lit(12.0).alias("price"), F.lit(100e6).alias("shares"), *[
        F.array(*[F.lit(v * (0.8 + 0.05 * i)) for i in range(5)]).alias(k) for k, v in LINES.items()], *[F.lit(v).alias(k) for k, v in PARAMS.items()])
    return df.withColumns(extra) if extra else df


def severities(df):
    row = valuation.value_companies(df).first()
    return row, {c.cell: c.severity for c in row.checks}


def test_clean_company_is_valued(spark):
    row, checks = severities(company(spark))
    assert row.value_per_share > 0 and row.verdict in (spec.UNDERVALUED, spec.OVERVALUED, spec.FAIRLY_VALUED)
    assert "FAIL" not in checks.values() and row.credit_table == "SMALL" and 0 < row.terminal_share_of_ev < 1
    assert abs(row.margin - 0.15) < 1e-12 and abs(row.market_cap_m - 1200) < 1e-9


@pytest.mark.parametrize("cell, change", [
    ("D111", {"cash": "array(1D, 2D, null, 3D, 4D)"}), ("D112", {"price": "cast(null as double)"}),
    ("D114", {"shares": "shares * 1000000"}), ("D115", {"ladder_ascending": "false"}), ("D120", {"loaded_table": "'LARGE'"}),
    ("D99", {"forecast_years": "9"})])
def test_faults_void_the_result(spark, cell, change):
    row, checks = severities(company(spark, **{k: F.expr(v) for k, v in change.items()}))
    assert checks[cell] == "FAIL" and row.verdict == spec.VOID


def test_prices_give_three_verdicts(spark):
    value = severities(company(spark))[0].value_per_share
    verdict = {k: severities(company(spark, price=F.lit(p)))[0].verdict for k, p in (("low", 4.0), ("high", 60.0))}
    assert verdict == {"low": spec.UNDERVALUED, "high": spec.OVERVALUED} and value > 0


def test_old_ladder_warns(spark):
    assert severities(company(spark, ladder_age_days=F.lit(426)))[1]["D122"] == "WARNING"
    assert severities(company(spark, ladder_age_days=F.lit(425)))[1]["D122"] == "OK"


def test_zero_interest_means_top_rating(spark):
    row, _ = severities(company(spark, interest_expense=F.expr("array(0D, 0D, 0D, 0D, 0D)")))
    assert row.implied_rating == "AAA" and row.coverage == float("inf")


CHECKS = "array<struct<cell:string,severity:string,message:string>>"


def decide(spark, verdict, checks, a=0.1, b=0.1):
    df = spark.createDataFrame([(verdict, checks, a, b)], f"verdict string, checks {CHECKS}, reinvest_cashflow double, reinvest_sales_to_capital double")
    return policy.apply_policy(df).first()


W = lambda cell: (cell, "WARNING", f"WARNING - {cell}")


@pytest.mark.parametrize("verdict, checks, a, b, flag, held, blocking", [
    (spec.UNDERVALUED, [("D99", "OK", "OK")], .1, .1, True, [], []),
    (spec.UNDERVALUED, [W("D103")], .1, .1, True, [], []),
    (spec.UNDERVALUED, [W("D104")], .1, .25, True, [], []),
    (spec.UNDERVALUED, [W("D104")], .1, .3000001, False, ["D104"], ["D104"]),
    (spec.UNDERVALUED, [W("D104")], -.1, .1, False, ["D104"], ["D104"]),
    (spec.UNDERVALUED, [W("D104")], None, .1, False, ["D104"], ["D104"]),
    (spec.UNDERVALUED, [W("D110"), W("D122")], .1, .1, False, ["D110", "D122"], ["D110", "D122"]),
    (spec.FAIRLY_VALUED, [W("D110")], .1, .1, False, [], ["D110"]),
    (spec.UNDERVALUED + " ", [("D1", "NOTE", "NOTE")], .1, .1, True, [], []),
    (None, [], .1, .1, False, [], [])])
def test_policy(spark, verdict, checks, a, b, flag, held, blocking):
    row = decide(spark, verdict, checks, a, b)
    assert (row.research_flag, row.suppressed_by, row.blocking_checks) == (flag, held, blocking)


@pytest.fixture(scope="module")
def run(spark):
    years = [2021, 2022, 2023, 2024, 2025]
    h, f = make_store(spark, ("A", "B", "C", "D"), drop={("D", "capex")})
    f = f.withColumn("value", F.when(F.col("field") == "long_term_debt", 1e8).when(F.col("field") == "interest_expense", 5e6).otherwise(F.col("value")))
    rows = lambda data, schema: spark.createDataFrame(data, schema)
    listings = rows([(k, "I" + k, "T" + k, "IM", True) for k in "ABCD"], "lei string, isin string, ticker string, exchange string, is_primary boolean")
    prices = rows([(k, date(2026, 1, d), 10.0 + d) for k in "ABD" for d in (1, 5)], "lei string, as_of date, price double")
    shares = rows([(k, date(2026, 1, 1), 420e6 / 10) for k in "ABCD"], "lei string, as_of date, shares double")
    mapping = rows([(k, "Retail") for k in "ABCD"], "lei string, industry string")
    industries = rows([("Retail", 0.9, 1.5, 0.12, 0.12)], "name string, unlevered_beta double, sales_to_capital double, ebit_margin double, roic double")
    countries = rows([("IT", 0.01, 0.25)], "country string, crp double, tax_rate double")
    excluded = rows([("B", "by hand")], "lei string, reason string")
    market = {k: F.lit(PARAMS[k]) for k in ("risk_free_rate", "mature_market_erp", "long_run_nominal_growth")}
    valued, skipped = screening.screen_run(h, f, listings, prices, shares, mapping, industries, countries, excluded, market, years, F.lit(date(2026, 1, 9)))
    return valued.cache(), skipped


def test_run_values_only_eligible_companies(run):
    valued, skipped = run
    row = valued.collect()
    assert [r.lei for r in row] == ["A"] and row[0].price == 15.0 and row[0].price_age_days == 4
    assert [(r.lei, r.reason) for r in skipped.collect()] == [("D", "unresolved required fields")]


def test_run_is_published_without_prices(run, tmp_path, spark):
    valued, skipped = run
    public = results.public_view(results.with_labels(valued))
    assert not any(word in c for c in public.columns for word in ("price", "value", "units", "band_low", "band_high")
                   if c not in ("price_as_of", "price_age_days", "unvaluable"))
    assert len(results.results_sheet(valued).columns) == 19
    sinks.write_records(results.sidecars(valued, F.lit("r")), str(tmp_path / "cars"))
    assert json.loads(spark.read.text(str(tmp_path / "cars")).first().value)["company"]["lei"] == "A"
    t = screening.screen_triggers(valued, F.lit(date(2026, 1, 9)))
    sinks.write_triggers(t, str(tmp_path / "t"))
    sinks.write_triggers(t.withColumn("run_date", F.lit(date(2026, 2, 9))), str(tmp_path / "t"))
    newest = records.latest_run(spark.read.parquet(str(tmp_path / "t")))
    assert newest.count() == 1 and newest.first().run_date == date(2026, 2, 9)
    assert results.run_summary(valued, skipped).first().could_not_be_valued == 1


def test_sidecar_files(spark, tmp_path):
    doc = lambda lei: {"company": {"lei": lei}, "market_inputs": {"market_cap_millions": 10.0}, "results": {"verdict": "x"}, "checks": [], "decision": {}}
    for name, body in (("A_FP_2024-01-01", json.dumps(doc("A"))), ("A_FP_2024-02-01", json.dumps(doc("A"))), ("B_FP_2024-02-01", "{broken")):
        (tmp_path / f"{name}.provenance.json").write_text(body)
    good, bad = records.read_sidecars(spark, str(tmp_path))
    assert good.count() == 2 and [r.file for r in bad.collect()] == ["B_FP_2024-02-01.provenance.json"]
    assert records.latest_run(good).count() == 1
    assert records.read_sidecars(spark, str(tmp_path), "2024-01-01")[0].count() == 1


def test_trigger_files(spark, tmp_path):
    (tmp_path / "run_2024-01-01.json").write_text(json.dumps({"valuation_date": "2024-01-01", "research_queue": ["OLD"], "triggers": {
        "L1": {"lei": "L1", "ticker": "A", "value_per_share": 2.0, "blocking_checks": []}, "OLD": {"value_per_share": 1.0, "price": 2.0}}}))
    rows = {r.key: r for r in records.read_triggers(spark, str(tmp_path)).collect()}
    assert rows["OLD"].queued and rows["OLD"].blocking_checks is None and rows["L1"].ticker == "A"


STAGE = "key string, title string, done boolean, last_date date, ran_date date"


def stages(spark, **change):
    day = {k: date(2026, 3, 2) for k in spec.STAGE_REFRESH_DAYS}
    day.update({k: v for k, v in change.items() if isinstance(v, date)})
    rows = [(k, k.title(), change.get(k, True) is not False, day[k], change.get("ran") if k == "prices" else None) for k in day]
    return spark.createDataFrame(rows, STAGE)


def state(spark, today=date(2026, 3, 4), **change):
    return {r.key: r.health for r in health.stage_health(stages(spark, **change), F.lit(today)).collect()}


def test_stage_health(spark):
    assert set(state(spark).values()) == {"ok"}
    out = state(spark, prices=date(2026, 2, 20), extract=False, tables=date(2024, 12, 1))
    assert out["prices"] == "stale" and out["extract"] == "missing" and out["tables"] == "blocking"
    assert state(spark, identity=date(2026, 3, 3))["shares"] == "stale"
    assert state(spark, prices=date(2026, 2, 27), ran=date(2026, 3, 2), screen=date(2026, 3, 2))["prices"] == "ok"


@pytest.mark.parametrize("today, industries, keys", [
    (date(2026, 1, 20), date(2025, 6, 1), {"annual-data", "report-cycle"}), (date(2026, 3, 4), date(2025, 6, 1), set()),
    (date(2026, 5, 4), date(2025, 6, 1), {"report-cycle"})])
def test_reminders(spark, today, industries, keys):
    s = stages(spark, screen=date(2025, 12, 30) if today.month == 1 else date(2026, 3, 2), tables=date(2025, 6, 1))
    h = health.stage_health(s, F.lit(date(2026, 1, 5))).withColumn("health", F.when(F.col("key").isin("screen", "tables"), "ok").otherwise(F.col("health")))
    assert {r.key for r in health.calendar_reminders(h, today, F.lit(industries)).collect()} == keys


def test_alerts_are_sorted(spark):
    h = health.stage_health(stages(spark, prices=date(2026, 2, 20), extract=False, tables=date(2024, 12, 1)), F.lit(date(2026, 3, 4)))
    rows = health.alerts(h, health.calendar_reminders(h, date(2026, 3, 4), F.lit(date(2026, 1, 1)))).collect()
    assert [r.health for r in rows][:2] == ["blocking", "missing"] and rows[1].message == "no run on record"


def test_fingerprints(spark, tmp_path):
    import hashlib
    (tmp_path / "a.json").write_bytes(b"{}")
    out = {r.name: r.fingerprint for r in records.fingerprints(spark, [str(tmp_path / "a.json"), str(tmp_path / "gone.json")]).collect()}
    assert out == {"a.json": hashlib.sha256(b"{}").hexdigest()[:16], "gone.json": None}


def test_refresh_runs_once_a_day(spark):
    from accountloom.operators import portfolio
    book = spark.createDataFrame([("A", "open", date(2024, 1, 5)), ("B", "open", date(2024, 1, 9)), ("C", "closed", date(2023, 1, 1))],
                                 "lei string, status string, entry_date date")
    newest = spark.createDataFrame([("A", date(2024, 1, 8))], "lei string, as_of date")
    state = lambda day: spark.createDataFrame([("prices_refreshed", day)], "key string, value string")
    today = F.lit(date(2024, 1, 10))
    assert {(r.lei, r.since) for r in portfolio.refresh_plan(book, newest, state("2024-01-09"), today).collect()} == {
        ("A", date(2024, 1, 8)), ("B", date(2024, 1, 8))}
    assert portfolio.refresh_plan(book, newest, state("2024-01-10"), today).count() == 0


def test_cells_and_listing_buckets(spark, tmp_path):
    cells = spark.createDataFrame([("f", "s", 0, 0, "x", None)], records.CELLS)
    cells.write.parquet(str(tmp_path / "cells"))
    assert records.read_cells(spark, str(tmp_path / "cells")).first().text == "x"
    listings = spark.createDataFrame([("A", "I"), ("B", "J")], "lei string, isin string")
    sinks.write_listings(listings, str(tmp_path / "l"), 4)
    assert sinks.read_table(spark, str(tmp_path / "l")).select("lei", "isin").exceptAll(listings).count() == 0
