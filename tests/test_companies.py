"""Coverage, store, identity, share, parameter and classification cases."""

import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from accountloom import spec
from accountloom.operators import coverage, identity, parameters, shares, store
from accountloom.plans import screening
from accountloom.sources import filings, quotes, records, sinks

AT = datetime(2025, 1, 1)


# -- filing index ------------------------------------------------------------------

def test_filing_index_files(spark, tmp_path):
    rec = lambda lei, day, idx, name="", **kw: {"lei": lei, "name": name, "country": "IT", "reporting_date": day,
                                                "filing_index": idx, "json_url": "u" + idx, **kw}
    (tmp_path / "IT.json").write_text(json.dumps([
        rec("A", "2020-12-31", "A-1"), rec("A", "2020-12-31", "A-3", "Name"), rec("A", "2020-06-30", "A-3", "Late"),
        rec("A", "2021-12-31", "bad"), rec(None, None, "x", last_end_date="2021-12-31"), rec("B", None, "B-1")]))
    (tmp_path / "FR.json").write_text("{not json")
    index = filings.read_filing_index(spark, str(tmp_path))
    assert {r.lei for r in index.collect()} == {"A", "UNKNOWN"}
    best = {(r.lei, r.year): r for r in coverage.latest_filing_per_year(index).collect()}
    assert best["A", 2020].name == "Name" and best["A", 2020].entry == 3 and best["A", 2021].entry == -1
    cov = {r.lei: r for r in coverage.fold_coverage(coverage.latest_filing_per_year(index)).collect()}
    assert cov["A"].years == [2020, 2021] and cov["A"].name == "Name" and cov["A"].fiscal_month == 12


def test_modal_month_tie_goes_to_first_seen(spark):
    rows = [("A", "n", "IT", date(2020, 6, 30), "A-1", 0, "u", 1), ("A", "n", "IT", date(2021, 12, 31), "A-1", 2, "u", 0)]
    idx = spark.createDataFrame(rows, "lei string, name string, country string, reporting_date date, filing_index string, error_count int, json_url string, ord int")
    out = screening.coverage_run(idx).first()
    assert out.fiscal_month == 12 and not out.consistent_year_end and out.error_count == 2


def test_filings_without_url_never_compete(spark):
    rows = [("A", "", "IT", date(2020, 12, 31), "A-9", 0, "", 0), ("A", "", "IT", date(2020, 12, 31), "A-1", 0, "u", 1)]
    idx = spark.createDataFrame(rows, "lei string, name string, country string, reporting_date date, filing_index string, error_count int, json_url string, ord int")
    assert coverage.filing_lookup(idx).first().entry == 1 and coverage.latest_filing_per_year(idx).first().entry == 9


def test_coverage_file_round_trip(spark, sf_dir, tmp_path):
    from accountloom.bindings import filing_queries
    report = filing_queries.coverage_report(spark, sf_dir)
    sinks.write_report(report, str(tmp_path / "cov"))
    back = filings.read_universe(spark, str(tmp_path / "cov"))
    assert back.count() == report.where("complete = 'YES'").count() > 0


def test_coverage_file_keeps_texts_as_they_are(spark, tmp_path):
    names = ["", " A  b ", 'C "quoted", d', "two\nlines", "back\\slash", None]
    rows = [(f"L{i}", n, "IT", "YES", 5, "1996", "", 12, "YES", 0) for i, n in enumerate(names)]
    report = spark.createDataFrame(rows, "lei string, name string, country string, complete string, years_held int, "
                                   "years_present string, missing_years string, fiscal_month int, consistent_year_end string, errors long")
    sinks.write_report(report, str(tmp_path / "cov"))
    back = filings.read_universe(spark, str(tmp_path / "cov"))
    assert {r.lei: (r.name, r.missing_years) for r in back.collect()} == {f"L{i}": (n, "") for i, n in enumerate(names)}


def test_sample_is_spread(spark):
    rows = spark.range(1000).select(F.concat(F.lit("L"), "id").alias("lei"), F.when(F.col("id") % 10 < 7, "DE").when(
        F.col("id") % 10 < 9, "FR").otherwise("IT").alias("country"))
    picks = [r.country for r in coverage.stratified_sample(rows, 10, 3).collect()]
    assert sorted(picks) == ["DE"] * 4 + ["FR"] * 3 + ["IT"] * 3
    assert coverage.stratified_sample(rows, 10, 3).exceptAll(coverage.stratified_sample(rows, 10, 3)).count() == 0


def test_extraction_plan(spark):
    entities = spark.createDataFrame([("A",), ("B",)], "lei string")
    headers = spark.createDataFrame([("A", 2020, "complete", spec.EXTRACTOR_VERSION), ("A", 2021, "failed", spec.EXTRACTOR_VERSION),
                                     ("B", 2020, "partial", "old")], "lei string, fiscal_year int, status string, extractor_version string")
    lookup = spark.createDataFrame([("A", 2021, "u"), ("B", 2020, "u")], "lei string, year int, json_url string")
    out = {(r.lei, r.fiscal_year): r.state for r in screening.extraction_plan(entities, headers, lookup, [2020, 2021]).collect()}
    assert out == {("A", 2020): "cached", ("A", 2021): "todo", ("B", 2020): "todo", ("B", 2021): "no_filing"}


# -- store ---------------------------------------------------------------------------

HEADER = ("lei string, fiscal_year int, name string, country string, period_end date, source string, source_ref string, "
          "extractor_version string, extracted_at timestamp, status string, currency string, scale int")
FACT = "lei string, fiscal_year int, field string, value double, derivation string, element string, components array<string>, sign_flipped boolean"


def make_store(spark, leis=("A",), years=range(2021, 2026), drop=()):
    heads, facts = [], []
    for lei in leis:
        for y in years:
            heads.append((lei, y, "N" + lei, "IT", date(y, 12, 31), "esef", "ref", "v1", AT, "complete", "EUR", 1_000_000))
            for key in spec.LINE_ITEM_KEYS:
                optional = key in spec.OPTIONAL_KEYS
                value = 0.0 if optional else {"revenue": 1e9, "capex": 6e7}.get(key, 1e8)
                facts.append((lei, y, key, None if (lei, key) in drop else value, "assumed_zero" if optional else "reported", None, [], False))
    return spark.createDataFrame(heads, HEADER), spark.createDataFrame(facts, FACT)


def test_five_year_record(spark):
    h, f = make_store(spark, ("A", "B", "C"), drop={("B", "capex")})
    h = h.where("not (lei = 'C' and fiscal_year = 2023)")
    series, rejects = store.five_year_series(h, f, [2021, 2022, 2023, 2024, 2025])
    row = series.first()
    assert series.count() == 1 and row.revenue == [1000.0] * 5 and row.capex == [60.0] * 5 and row.name == "NA"
    assert {r.lei: r.reason for r in rejects.collect()} == {"B": "unresolved required fields", "C": "missing years"}
    with pytest.raises(ValueError):
        store.five_year_series(h, f, [2021, 2022, 2024, 2025, 2026])
    prov = store.provenance(h, f, [2021, 2022, 2023, 2024, 2025]).where("lei = 'A'").first()
    assert prov.sources == ["esef"] and len(prov.assumed_zeros["2021"]) == 8 and len(prov.period_ends) == 5


def test_failure_report_and_stats(spark):
    h, f = make_store(spark, ("A",), drop={("A", "capex")})
    report = {r.field: (r.unresolved, r.assumed_zeros) for r in store.field_failure_report(h, f.where("field <> 'cash'")).collect()}
    assert len(report) == 20 and report["capex"] == (5, 0) and report["cash"] == (5, 0) and report["preferred_stock"] == (0, 5)
    assert store.unresolved_company_years(h, f, "capex").count() == 5
    s = store.store_stats(h, f).first()
    assert (s.company_years, s.complete, s.entities, s.facts, s.assumed_zeros) == (5, 5, 1, 100, 40)
    assert store.line_grid(h, f.where("field <> 'cash'")).count() == 100


def test_wholesale_replace_and_clear(spark, tmp_path):
    h, f = make_store(spark, ("A", "B"))
    new_h = h.where("lei = 'A' and fiscal_year = 2021").withColumn("extractor_version", F.lit("v2"))
    new_f = f.where("lei = 'A' and fiscal_year = 2021 and field = 'revenue'")
    h2, f2 = store.put_company_years(h, f, new_h, new_f)
    assert f2.where("lei = 'A' and fiscal_year = 2021").count() == 1 and f2.count() == 181 and h2.count() == 10
    failed = store.failed_headers(h.where("fiscal_year = 2022").select("lei", "fiscal_year"), "v2", F.lit("no filing"), F.lit(AT))
    h3, f3 = store.put_company_years(h2, f2, failed, f.where("1 = 0"))
    assert f3.where("fiscal_year = 2022").count() == 0 and h3.where("status = 'failed' and name is null").count() == 2
    sinks.write_company_years(h3, f3, str(tmp_path))
    sinks.write_company_years(h3.where("fiscal_year = 2021"), f3.where("fiscal_year = 2021"), str(tmp_path))
    assert sinks.read_table(spark, str(tmp_path / "company_year")).count() == 10
    ch, cf = store.clear_extractions(h3, f3)
    assert ch.count() == cf.count() == 0 and ch.columns == h3.columns


def test_clear_drops_extractions_and_nothing_else(spark, tmp_path):
    path = str(tmp_path)
    h, f = make_store(spark, ("A", "B"))
    assert sinks.clear_extractions(spark, path) == {"company_year": 0, "fact": 0}
    sinks.upsert_company_years(spark, path, h, f)
    sinks.write_listings(spark.createDataFrame([("A", "I1")], "lei string, isin string"), f"{path}/listing", 4)
    files = lambda: sorted((str(p), p.stat().st_mtime_ns) for p in (tmp_path / "listing").rglob("*.parquet"))
    before = files()
    assert sinks.clear_extractions(spark, path) == {"company_year": h.count(), "fact": f.count()}
    assert files() == before and not (tmp_path / "fact").exists() and not (tmp_path / "company_year").exists()
    sinks.upsert_company_years(spark, path, h.where("lei = 'A'"), f.where("lei = 'A'"))
    assert {r.lei for r in sinks.read_table(spark, f"{path}/company_year").collect()} == {"A"}


def test_listings_are_replaced_per_entity(spark):
    schema = "lei string, isin string, exchange string, figi string, ord int"
    old = spark.createDataFrame([("A", "I1", "FP", "G1", 0), ("B", "I2", "FP", "G2", 0)], schema)
    new = spark.createDataFrame([("A", "I3", None, None, 0), ("A", "I4", "X", "G9", 1), ("A", "I5", "X", "G9", 2)], schema)
    out = {(r.lei, r.figi): r.isin for r in store.replace_listings(old, new, [F.col("ord")]).collect()}
    assert out == {("B", "G2"): "I2", ("A", "I3:?"): "I3", ("A", "G9"): "I5"}


def test_vocabulary(spark):
    h, f = make_store(spark)
    assert store.vocabulary_problems(h, f).count() == 0
    bad = f.withColumn("derivation", F.when(F.col("field") == "cash", "guess").otherwise(F.col("derivation")))
    assert store.vocabulary_problems(h.withColumn("status", F.lit("odd")), bad).count() == 10


def test_inception_is_written_once(spark):
    s = lambda rows: spark.createDataFrame(rows, "key string, value string")
    out = store.run_state(s([("inception_date", "1"), ("last_sync_date", "1")]), s([("inception_date", "2"), ("last_sync_date", "2"), ("x", "3")]))
    assert {r.key: r.value for r in out.collect()} == {"inception_date": "1", "last_sync_date": "2", "x": "3"}


# -- identity ------------------------------------------------------------------------

LINE = "lei string, country string, ord int, isin string, ticker string, exchange string, figi string, security_type string, security_type2 string, market_sector string, name string"


def line(lei, country, ord_, ticker, exchange, kind="Common Stock", sector="Equity"):
    return (lei, country, ord_, f"I{ord_}", ticker, exchange, f"G{ord_}", None, kind, sector, "n")


def test_primary_pick(spark):
    rows = [line("fi", "FI", 0, "KNE", "GR"), line("fi", "FI", 1, "1KNEBV", "IM"), line("fi", "FI", 2, "KNEBV", "FH"), line("fi", "FI", 3, "KNEBVEUR", "FH"),
            line("nl", "NL", 4, "CPR", "IM"), line("nl", "NL", 5, "58H", "GR"), line("de", "DE", 6, "SAP", "GY"), line("de", "DE", 7, "SAPX", "GR", "Depositary Receipt"),
            line("us", "IE", 8, "KNYJY", "US"), line("sec", "FI", 9, "AA", "GY"), line("bond", "FI", 10, "BB", "FH", sector="Corp"), line("war", "FI", 11, "WW", "FH", "Warrant"),
            line("tie", "FI", 13, "AB", "FH"), line("tie", "FI", 12, "AB", "FH")]
    picked = {r.lei: r for r in identity.pick_primary(identity.equity_lines(spark.createDataFrame(rows, LINE))).collect()}
    assert {k: (r.ticker, r.listing_tier) for k, r in picked.items()} == {
        "fi": ("KNEBV", "domicile"), "nl": ("CPR", "cross_listing_risk"), "de": ("SAP", "domicile"), "tie": ("AB", "domicile")}
    assert picked["tie"].ord == 12


def test_resolution_routes(spark):
    entities = spark.createDataFrame([(k, "N" + k, "FI") for k in ("man", "pend", "out", "name", "none", "debt", "lost")], "lei string, name string, country string")
    overrides = spark.createDataFrame([("man", "M", "FH", None, "2024-01-01"), ("pend", "P", "FH", None, None), ("out", None, None, True, None)],
                                      "lei string, ticker string, exchange string, exclude boolean, reviewed string")
    isin = [line("man", "FI", 0, "X", "FH"), line("pend", "FI", 1, "Y", "FH"), line("out", "FI", 2, "Z", "FH"), line("name", "FI", 3, "ADR", "US"),
            line("none", "FI", 4, "ADR", "US"), line("debt", "FI", 5, "B", "FH", sector="Corp")]
    name = [line("name", "FI", 6, "HOME", "FH"), line("pend", "FI", 7, "NO", "FH")]
    frame = lambda rows: spark.createDataFrame(rows, LINE).drop("country")
    isins = frame(isin).groupBy("lei").agg(F.count(F.lit(1)).alias("n_isins"))
    listings, outcomes = identity.resolve_listings(entities, overrides, frame(isin), frame(name), isins)
    got = {r.lei: (r.outcome, r.ticker) for r in outcomes.collect()}
    assert got == {"man": ("manual", "M"), "pend": ("domicile", "Y"), "out": ("excluded_manually", None), "name": ("domicile", "HOME"),
                   "none": ("no_home_listing", None), "debt": ("debt_only", None), "lost": ("unresolved", None)}
    primary = {r.lei: r.confidence for r in listings.where("is_primary").collect()}
    assert primary == {"man": "manual", "pend": "isin", "name": "name"}
    assert listings.where("lei = 'out'").count() == 0
    assert {r.lei for r in identity.needs_review(outcomes).collect()} == {"pend"}
    assert listings.where("lei = 'none' and not is_primary").count() == 1


def test_overrides_file(spark, tmp_path):
    (tmp_path / "o.json").write_text(json.dumps({"_c": 1, "overrides": {"L1": {"ticker": "A", "exchange": "FP", "note": "n", "reviewed": None}, "L2": {"exclude": True}}}))
    out = {r.lei: r for r in quotes.read_overrides(spark, str(tmp_path / "o.json")).collect()}
    assert out["L1"].ticker == "A" and out["L2"].exclude is True


# -- quotes --------------------------------------------------------------------------

def test_price_csv(spark, tmp_path):
    (tmp_path / "p.csv").write_text("﻿lei,price,currency,as_of,ticker\nA,1.5,eur,2024-01-01,X\nA, 2.5 , EUR ,,\n,9,EUR,,\n", encoding="utf-8")
    rows = quotes.read_price_csv(spark, str(tmp_path / "p.csv"), F.lit("2024-02-01").cast("date")).collect()
    assert len(rows) == 1 and (rows[0].price, rows[0].currency, rows[0].as_of) == (2.5, "EUR", date(2024, 2, 1))
    (tmp_path / "q.csv").write_text("lei,price\nA,1\n")
    with pytest.raises(ValueError):
        quotes.read_price_csv(spark, str(tmp_path / "q.csv"), F.lit("2024-02-01").cast("date"))


# -- shares --------------------------------------------------------------------------

def share_row(lei, price=10.0, revenue=1e9, diluted=50e6, current=None, source=None, name="n"):
    return (lei, name, "T", "FP", price, revenue, None, diluted, current, source)


SHARE = ("lei string, name string, ticker string, exchange string, price double, revenue double, wavg_basic double, wavg_diluted double, "
         "current_shares double, current_source string")


def test_derived_counts(spark):
    rows = [share_row("new"), share_row("same", current=50e6 + 0.2, source="eps-derived"), share_row("moved", current=40e6, source="eps-derived"),
            share_row("hand", current=40e6, source="manual"), share_row("band", price=1e6), share_row("neg", diluted=-5.0), share_row("noprice", price=None)]
    sheet = shares.worksheet(spark.createDataFrame(rows, SHARE))
    assert {r.lei for r in shares.seed_derived(sheet, F.lit("2024-01-01").cast("date")).collect()} == {"new", "moved"}
    assert {r.lei for r in sheet.where("note = 'FILL IN'").collect()} == {"band", "neg", "noprice"}
    assert shares.export_order(sheet).first().lei in {"band", "neg", "noprice"}


def test_import(spark):
    rows = spark.createDataFrame([share_row(k, current=50e6, source="eps-derived") for k in "abcdefgh"], SHARE)
    typed = spark.createDataFrame([("a", "50,000,000", "eps-derived"), ("b", "52,000,000", ""), ("c", "", ""), ("d", "x", ""), ("e", "-1", ""),
                                   ("f", "1", ""), ("g", "60000000", ""), ("h", "50000000", "manual")], "lei string, shares string, source string")
    out = {r.lei: r.outcome for r in shares.classify_import(rows.join(typed, "lei").withColumn("note", F.lit(""))).collect()}
    assert out == {"a": "unchanged", "b": "stored", "c": "blank", "d": "not_a_number", "e": "not_positive", "f": "out_of_band",
                   "g": "stored_with_warning", "h": "stored"}


# -- parameters ----------------------------------------------------------------------

CELL = "file string, sheet string, row int, col int, text string, number double"


def sheet(file, name, rows, top=0):
    return [(file, name, top + i, j, v if isinstance(v, str) else None, float(v) if isinstance(v, (int, float)) else None)
            for i, row in enumerate(rows) for j, v in enumerate(row) if v is not None]


def test_beta_column_is_found_by_content(spark):
    cells = sheet("betaEurope", "Industry Averages", [["Title"], ["Industry Name", "Unlevered beta corrected for cash", "Unlevered beta"],
                                                      ["Auto Parts", 0.95, 0.88], ["Total Market", 1, 1], ["", 5, 5]])
    out = parameters.industry_rows(spark.createDataFrame(cells, CELL)).collect()
    assert [(r.name, r.unlevered_beta) for r in out] == [("Auto Parts", 0.88)]


def test_country_sheet(spark):
    head = ["Country", "Country Risk Premium", "Total Equity Risk Premium"]
    rows = [["ERP settings"], head, ["Germany", 0.0, 0.0433], ["Italy", 0.02, 0.06], [" slovak republic ", 0.01, 0.05], ["Mars", 9, 9], ["Italy", None, 0.07]]
    cells = spark.createDataFrame(sheet("c", "ERPs by country", rows, 6), CELL)
    out = parameters.country_premiums(cells)
    got = {r.iso: (r.crp, r.total_erp) for r in out.collect()}
    assert got == {"DE": (0.0, 0.0433), "IT": (0.02, 0.07), "SK": (0.01, 0.05)}
    assert parameters.mature_premium(out).first()[0] == 0.0433
    assert parameters.percent_guard(out, ["crp", "total_erp"]).count() == 3
    assert parameters.percent_guard(out.withColumn("crp", F.col("crp") * 100), ["crp", "total_erp"]).count() == 0


def test_merge_keeps_what_was_not_read(spark):
    stored = spark.createDataFrame([("IT", 0.02, 0.24, "old", date(2020, 1, 1)), ("FR", 0.01, 0.25, "old", date(2020, 1, 1))],
                                   "iso string, crp double, tax_rate double, source string, as_of date")
    found = spark.createDataFrame([("IT", None, 0.279)], "iso string, crp double, tax_rate double")
    out = {r.iso: r for r in parameters.merge_parameters(stored, found, "iso", ["crp", "tax_rate"], "new", F.lit(date(2024, 1, 1))).collect()}
    assert (out["IT"].crp, out["IT"].tax_rate, out["IT"].source) == (0.02, 0.279, "new") and out["FR"].source == "old"


def test_rate_series(spark, tmp_path):
    (tmp_path / "r.csv").write_text("KEY,TIME_PERIOD,OBS_VALUE\na,2024-01-01,2.5\nb,2024-01-02,2.75\n")
    row = parameters.riskfree_from_series(records.read_rate_series(spark, str(tmp_path / "r.csv"))).first()
    assert abs(row.value - 0.0275) < 1e-12 and row.as_of == "2024-01-02" and row.status == "ok"


def page(rows, extra=""):
    body = "".join(f"<tr><td>{a}</td><td>to</td><td>{b}</td><td>{c}</td></tr>" for a, b, c in rows)
    return f"<html><table>{extra}{body}</table></html>"


def test_ladder_pages(spark):
    rungs = [(n, f"R{n}/A{n}", f"{20 - n}.00%") for n in range(15)]
    pages = spark.createDataFrame([(1, page(list(reversed(rungs)), "<tr><td>&gt;</td><td></td><td>Rating</td><td>Spread</td></tr>")),
                                   (2, page(rungs[:10])), (3, "<p>no table</p>")], "page_id long, html string")
    good, refused = parameters.accepted_ladders(parameters.ladder_from_html(pages))
    rows = good.collect()
    assert len(rows) == 15 and rows[0].coverage_from == 0.0 and rows[0].rating == "A0" and rows[1].spread == 0.19
    assert [(r.page_id, r.n) for r in refused.collect()] == [(2, 10)]


def test_ladder_diff_and_shape(spark, tmp_path):
    now = parameters.stored_ladder(spark)
    was = now.withColumn("spread", F.when((F.col("table") == "LARGE") & (F.col("row") == 3), 0.16).otherwise(F.col("spread")))
    changes = parameters.ladder_diff(was, now).collect()
    assert len(changes) == 1 and changes[0].text == "LARGE | Caa/CCC | spread 0.1600 to 0.0885"
    assert parameters.ladder_diff(now, now).count() == 0
    short = was.where("not (table = 'SMALL' and row = 14)")
    assert any(r.text.endswith("added") for r in parameters.ladder_diff(short, now).collect())
    assert parameters.ladder_shape_problems(now).count() == 0
    swapped = now.withColumn("row", F.when(F.col("row") == 1, 2).when(F.col("row") == 2, 1).otherwise(F.col("row")))
    assert {r.problem for r in parameters.ladder_shape_problems(swapped.union(now.limit(1))).collect()} >= {"thresholds are not ascending"}
    doc = {"vintage": "2026-01", "size_cutoff": {"eur_millions": 4300}, "tables": {t: {"rows": [
        dict(zip(("coverage_from", "rating", "rating_full", "spread"), r)) for r in rungs]} for t, rungs in spec.LADDERS.items()}}
    (tmp_path / "l.json").write_text(json.dumps(doc, indent=1))
    stored = records.read_ladder(spark, str(tmp_path / "l.json"))
    assert stored.count() == 30 and stored.select(now.columns).exceptAll(now).count() == 0
    new = parameters.apply_ladder(stored, now, F.lit("2026-03-05").cast("date")).first()
    assert (new.cutoff, new.vintage, new.next_expected) == (4300.0, "2026-03", "2027-03")


def test_constant_drift(spark):
    ok = spark.createDataFrame(list(spec.CONVENTIONS.items()), "cell string, value double")
    assert parameters.drifted_constants(ok).count() == 0
    off = ok.withColumn("value", F.when(F.col("cell") == "B63", 6.0).when(F.col("cell") != "B65", F.col("value")))
    assert {r.cell for r in parameters.drifted_constants(off).collect()} == {"B63", "B65", "B63+B64"}


def test_classification(spark):
    companies = spark.createDataFrame([("L1", "BRE", "Brembo", 9e9), ("L2", "BRE", "Small", 1e6), ("L3", "X", "Done", 1.0), ("L4", None, "Unlisted", 1.0), ("L5", "E", "Out", 1.0)],
                                      "lei string, ticker string, name string, revenue double")
    mapping = spark.createDataFrame([("L3", "Bank (Regional)")], "lei string, industry string")
    excluded = spark.createDataFrame([("L5", "r")], "lei string, reason string")
    open_ = parameters.unmapped(companies, mapping, excluded)
    assert [r.lei for r in open_.collect()] == ["L1", "L2"]
    lines = spark.createDataFrame([("- bre | Auto Parts",), ("L1 | auto part",), ("??? | Auto Parts",), ("BRE | Auto",), ("noise",)], "line string")
    industries = spark.createDataFrame([("Auto Parts",), ("Auto & Truck",), ("_note",)], "name string")
    out = {(r.key, r.answer): (r.lei, r.outcome, r.suggestion) for r in parameters.match_replies(parameters.parse_replies(lines), open_, industries).collect()}
    assert out == {("bre", "Auto Parts"): ("L2", "stored", None), ("L1", "auto part"): ("L1", "rejected", "Auto Parts"),
                   ("???", "Auto Parts"): (None, "unknown", None), ("BRE", "Auto"): ("L2", "rejected", "Auto & Truck")}
    assert [r.ticker for r in parameters.excluded_type_audit(mapping, companies).collect()] == ["X"]


def test_entities_in_ladder_cells(spark):
    marks = {"&#160;": " ", "&#xA0;": " ", "&nbsp;": " ", "&#65;": "A", "&#x2014;": "\u2014", "&ndash;": "\u2013", "&amp;lt;": "&lt;",
             "&unknown;": "&unknown;", "&": "&", "a&lt;b&gt;c": "a<b>c", "&#8364;5": "\u20ac5"}
    rows = spark.createDataFrame([(k, v) for k, v in marks.items()], "raw string, want string")
    got = rows.select("raw", "want", parameters._unescape(F.col("raw")).alias("got")).collect()
    assert all(r.got == r.want for r in got), [(r.raw, r.got) for r in got if r.got != r.want]


def test_sheet_rows_far_down_are_read(spark):
    cells = [("f", "s", 900, 0, "Country", None), ("f", "s", 900, 1, "Country Risk Premium", None),
             ("f", "s", 5000, 0, "Norway", None), ("f", "s", 5000, 1, None, 0.02)]
    df = spark.createDataFrame(cells, "file string, sheet string, row int, col int, text string, number double")
    out = parameters.sheet_columns(df, ("country", "country risk premium"), {"crp": (("country risk premium",), ())}, ("country",))
    assert [(r["row"], r.name, r.crp) for r in out.collect()] == [(5000, "Norway", 0.02)]


def test_rates_of_several_files_keep_file_order(spark, tmp_path):
    from accountloom.sources import records
    for name, rows in (("b.csv", "2024-02,3.0\n2024-03,4.0\n"), ("a.csv", "2023-12,1.0\n2024-01,2.0\n")):
        (tmp_path / name).write_text("TIME_PERIOD,OBS_VALUE\n" + rows)
    last = parameters.riskfree_from_series(records.read_rate_series(spark, str(tmp_path))).first()
    assert (last.as_of, last.value) == ("2024-03", 0.04)
