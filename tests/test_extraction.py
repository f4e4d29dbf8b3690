"""Small hand-made filings, all extracted in one job and checked one by one."""

import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from accountloom import spec
from accountloom.operators import extraction
from accountloom.sources import filings

YEAR = "2024-01-01T00:00:00/2025-01-01T00:00:00"
PRIOR = "2023-01-01T00:00:00/2024-01-01T00:00:00"
HALF = "2024-01-01T00:00:00/2024-07-01T00:00:00"
POINT, POINT_PRIOR = "2025-01-01T00:00:00", "2024-01-01T00:00:00"
JUNE, JUNE_POINT = "2023-07-01T00:00:00/2024-07-01T00:00:00", "2024-07-01T00:00:00"
EUR = "iso4217:EUR"
I = "ifrs-full:"
ACQUIRED = I + "CashFlowsUsedInObtainingControlOfSubsidiariesOrOtherBusinessesClassifiedAsInvestingActivities"
DIVESTED = I + "CashFlowsFromLosingControlOfSubsidiariesOrOtherBusinessesClassifiedAsInvestingActivities"
BORROWED = I + "NoncurrentPortionOfNoncurrentBorrowings"

BASE = [
    (I + "Revenue", YEAR, 1e9), (I + "ProfitLossFromOperatingActivities", YEAR, 120e6),
    (I + "DepreciationAndAmortisationExpense", YEAR, 50e6), (I + "ProfitLossBeforeTax", YEAR, 100e6),
    (I + "IncomeTaxExpenseContinuingOperations", YEAR, 25e6),
    (I + "ProfitLossAttributableToOwnersOfParent", YEAR, 75e6), (I + "CashAndCashEquivalents", POINT, 150e6),
    (I + "CurrentAssets", POINT, 400e6), (I + "CurrentLiabilities", POINT, 250e6), (I + "Equity", POINT, 550e6),
    (I + "Assets", POINT, 1200e6), (I + "PurchaseOfPropertyPlantAndEquipment", YEAR, -60e6)]


def without(*parts):
    return [f for f in BASE if not any(p in f[0] for p in parts)]


NO_SUBTOTALS = [f for f in BASE if f[0] not in (I + "CurrentAssets", I + "CurrentLiabilities")]

CASES = {
    "base": BASE,
    "comparative": BASE + [(I + "Revenue", PRIOR, 9e8), (I + "Equity", POINT_PRIOR, 5e8)],
    "segments": BASE + [(I + "Revenue", YEAR, 4e8, {"dimensions": {I + "SegmentsAxis": "seg:N"}}),
                        (I + "Revenue", YEAR, 6e8, {"dimensions": {I + "SegmentsAxis": "seg:S"}})],
    "usd_first": [(I + "Revenue", YEAR, 11e8, {"unit": "iso4217:USD"})] + BASE,
    "texts": BASE + [(I + "DescriptionOfAccountingPolicy", YEAR, "not a number"), (I + "Revenue", HALF, 48e7)],
    "june": [(f[0], JUNE if f[1] == YEAR else JUNE_POINT, f[2]) for f in BASE] + [(I + "Revenue", YEAR, 999)],
    "leases": BASE + [(BORROWED, POINT, 180e6), (I + "NoncurrentLeaseLiabilities", POINT, 45e6)],
    "spellings": BASE + [(I + "PurchaseOfPropertyPlantAndEquipmentClassifiedAsInvestingActivities", YEAR, -70e6),
                         (I + "PurchaseOfIntangibleAssetsClassifiedAsInvestingActivities", YEAR, -10e6)],
    "combined_capex": BASE + [
        (I + "PurchaseOfPropertyPlantAndEquipmentIntangibleAssetsOtherThanGoodwillInvestmentPropertyAndOtherNoncurrentAssets", YEAR, -95e6),
        (I + "PurchaseOfIntangibleAssetsClassifiedAsInvestingActivities", YEAR, -10e6)],
    "unknown_ebit": without("OperatingActivities") + [("testco:RisultatoOperativo", YEAR, 120e6)],
    "extension_ebit": without("OperatingActivities") + [("andco:EarningsBeforeInterestAndTaxesEbit", YEAR, 120e6)],
    "no_ebit": without("OperatingActivities") + [(I + "InterestExpense", YEAR, 8e6)],
    "no_ebit_income": without("OperatingActivities") + [
        (I + "FinanceCosts", YEAR, 8e6), (I + "FinanceIncome", YEAR, 3e6),
        (I + "ShareOfProfitLossOfAssociatesAndJointVenturesAccountedForUsingEquityMethod", YEAR, 2e6)],
    "split_da": without("Depreciation") + [(I + "AdjustmentsForDepreciationExpense", YEAR, 38e6),
                                           (I + "AdjustmentsForAmortisationExpense", YEAR, 12e6)],
    "profit_minority": without("OwnersOfParent") + [(I + "ProfitLoss", YEAR, 80e6),
                                                    (I + "ProfitLossAttributableToNoncontrollingInterests", YEAR, 5e6)],
    "profit_only": without("OwnersOfParent") + [(I + "ProfitLoss", YEAR, 80e6)],
    "pretax": without("ProfitLossBeforeTax") + [(I + "ProfitLoss", YEAR, 75e6)],
    "subtotals": NO_SUBTOTALS + [(I + "Inventories", POINT, 500), (I + "NoncurrentAssets", POINT, 500e6),
                                 (I + "NoncurrentLiabilities", POINT, 500e6)],
    "retailer": NO_SUBTOTALS + [(I + "Inventories", POINT, 500)],
    "no_marker": NO_SUBTOTALS,
    "bank": NO_SUBTOTALS + [(I + "LoansAndAdvancesToCustomers", POINT, 500), (I + "DepositsFromCustomers", POINT, 500)],
    "lone_pattern": without("Depreciation") + [("acme:AmortissementsDepreciationsEtProvisions", YEAR, 44e6)],
    "two_patterns": without("Depreciation") + [
        ("acme:Adjustmentsfordepreciationexpenseonrightofuseassets", YEAR, 20e6),
        ("acme:DepreciationOne", YEAR, 20e6), ("acme:DepreciationTwo", YEAR, 20e6)],
    "denied": without("Depreciation") + [(I + "FinancialAssetsAtAmortisedCost", YEAR, 9000)],
    "preferred": without("Depreciation") + [("kco:DepreciationAmortisationAndImpairmentCharges", YEAR, 61e6),
                                            ("kco:DepreciationAccordingToPlanAdjustment", YEAR, 55e6)],
    "capex_pattern": without("Purchase") + [("kco:InvestmentsInPropertyPlantAndEquipmentAndIntangibleAssets", YEAR, -88e6)],
    "capex_denied": without("Purchase") + [(I + "ProceedsFromSalesOfPropertyPlantAndEquipment", YEAR, 4e6),
                                           (I + "GainsLossesOnDisposalsOfPropertyPlantAndEquipment", YEAR, 9e5)],
    "gross_interest": BASE + [("kco:InterestExpenseAndOtherFinanceCosts", YEAR, 39e6),
                              (I + "InterestExpenseOnLeaseLiabilities", YEAR, 7e6),
                              ("kco:InterestPaidAndOtherFinanceCosts", YEAR, 38e6)],
    "debt_no_interest": BASE + [(BORROWED, POINT, 200e6)],
    "interest_no_debt": without("CurrentLiabilities") + [(I + "InterestExpense", YEAR, 5e6)],
    "zero_debt": BASE + [(I + "ShorttermBorrowings", POINT, 0), (I + "InterestExpense", YEAR, 5e6)],
    "zero_ncl": BASE + [(I + "NoncurrentLiabilities", POINT, 0), (I + "InterestExpense", YEAR, 5e6)],
    "residual_proxy": BASE + [(I + "InterestExpense", YEAR, 5e6)],
    "netted": BASE + [(ACQUIRED, YEAR, 80e6), (DIVESTED, YEAR, 30e6)],
    "netted_negative": BASE + [(ACQUIRED, YEAR, -80e6), (DIVESTED, YEAR, -30e6)],
    "divested": BASE + [(DIVESTED, YEAR, 30e6)],
    "eps": BASE + [(I + "BasicEarningsLossPerShare", YEAR, 1.5), (I + "DilutedEarningsLossPerShare", YEAR, 1.25)],
}


def document(facts):
    out = {}
    for i, (concept, period, value, *extra) in enumerate(facts):
        extra = extra[0] if extra else {}
        dims = {"concept": concept, "period": period, "entity": "lei:X", "unit": extra.get("unit", EUR)}
        dims.update(extra.get("dimensions", {}))
        out[f"f{i}"] = {"value": str(value), "dimensions": dims}
    return json.dumps({"facts": out})


@pytest.fixture(scope="module")
def documents(spark):
    rows = [(k, 2024, date(2024, 6, 30) if k == "june" else date(2024, 12, 31), "Name", "IT", "ref", document(f))
            for k, f in CASES.items()]
    return spark.createDataFrame(rows, "lei string, fiscal_year int, hint date, name string, country string, "
                                       "source_ref string, body string").repartition(4)


@pytest.fixture(scope="module")
def voted(documents):
    facts = filings.numeric_facts(filings.parse_documents(documents, extraction.KEYS, []))
    return extraction.vote_financial(extraction.extract_company_years(documents.drop("body"), facts)).cache()


@pytest.fixture(scope="module")
def rows(voted):
    return {r.lei: r for r in voted.collect()}


@pytest.fixture(scope="module")
def ebit_rows(documents):
    facts = filings.numeric_facts(filings.parse_documents(documents, extraction.KEYS, []))
    out = extraction.extract_company_years(documents.drop("body"), facts, ebit_fallback=True, strict_interest=False)
    return {r.lei: r for r in out.select("lei", "ebit", "status", "blocked").collect()}


@pytest.mark.parametrize("case, key, value, origin", [
    ("base", "revenue", 1e9, "reported"), ("comparative", "revenue", 1e9, "reported"),
    ("comparative", "total_equity", 55e7, "reported"), ("segments", "revenue", 1e9, "reported"),
    ("usd_first", "revenue", 1e9, "reported"), ("texts", "revenue", 1e9, "reported"),
    ("june", "revenue", 1e9, "reported"), ("leases", "long_term_debt", 225e6, "summed"),
    ("base", "capex", 60e6, "summed"), ("spellings", "capex", 80e6, "summed"),
    ("combined_capex", "capex", 95e6, "reported"), ("extension_ebit", "ebit", 120e6, "extension"),
    ("split_da", "depreciation_amortisation", 50e6, "summed"), ("profit_minority", "net_income", 75e6, "computed"),
    ("profit_only", "net_income", 80e6, "computed"), ("pretax", "pretax_income", 100e6, "computed"),
    ("subtotals", "total_current_assets", 700e6, "computed"), ("subtotals", "total_current_liabilities", 150e6, "computed"),
    ("lone_pattern", "depreciation_amortisation", 44e6, "extension"),
    ("preferred", "depreciation_amortisation", 61e6, "extension"), ("capex_pattern", "capex", 88e6, "extension"),
    ("gross_interest", "interest_expense", 39e6, "extension"), ("zero_debt", "short_term_debt", 0.0, "summed"),
    ("zero_ncl", "long_term_debt", 0.0, "debt_proxy"), ("residual_proxy", "long_term_debt", 400e6, "debt_proxy"),
    ("netted", "acquisitions_net", 50e6, "summed"), ("netted_negative", "acquisitions_net", 50e6, "summed"),
    ("divested", "acquisitions_net", -30e6, "summed")])
def test_line(rows, case, key, value, origin):
    fact = rows[case][key]
    assert fact.value == value and fact.derivation == origin


@pytest.mark.parametrize("case, key", [
    ("unknown_ebit", "ebit"), ("two_patterns", "depreciation_amortisation"), ("denied", "depreciation_amortisation"),
    ("capex_denied", "capex"), ("zero_debt", "long_term_debt"), ("no_ebit", "ebit")])
def test_line_stays_open(rows, case, key):
    assert rows[case][key] is None


def test_sign_flip_and_components(rows):
    assert rows["base"].capex.sign_flipped and len(rows["leases"].long_term_debt.components) == 2
    assert len(rows["spellings"].capex.components) == 2 and not rows["base"].revenue.sign_flipped


def test_status_and_blocks(rows):
    status = {k: r.status for k, r in rows.items()}
    assert status["base"] == "complete" and status["unknown_ebit"] == "partial" and status["extension_ebit"] == "complete"
    assert status["debt_no_interest"] == "partial" and not rows["debt_no_interest"].missing_required
    assert rows["debt_no_interest"].blocked == ["debt of 200,000,000 without an interest line"]
    assert rows["interest_no_debt"].blocked[0]== "interest of 5,000,000 without any debt line"
    assert rows["unknown_ebit"].missing_required == ["ebit"]


def test_financial_heuristic(rows):
    flags = {k: rows[k].likely_financial for k in ("bank", "retailer", "no_marker", "subtotals")}
    assert flags == {"bank": True, "retailer": False, "no_marker": False, "subtotals": False}
    assert rows["bank"].status == "failed"


def test_period_end_is_inferred(rows):
    assert rows["june"].period_end == date(2024, 6, 30) and rows["base"].period_end == date(2024, 12, 31)


def test_ebit_fallback_is_opt_in(rows, ebit_rows):
    assert ebit_rows["no_ebit"].ebit.value == 108e6 and ebit_rows["no_ebit"].ebit.derivation == "computed"
    assert ebit_rows["no_ebit_income"].ebit.value == 103e6
    assert ebit_rows["base"].ebit.derivation == "reported" and rows["no_ebit"].status == "partial"
    assert ebit_rows["debt_no_interest"].status == "complete" and ebit_rows["debt_no_interest"].blocked == []


def test_fact_rows_are_complete(voted):
    facts = extraction.fact_rows(voted)
    base = {r.field: r for r in facts.where("lei = 'base'").collect()}
    assert set(base) == set(spec.LINE_ITEM_KEYS)
    assert sum(r.derivation == "assumed_zero" for r in base.values()) == 8
    assert facts.where("lei = 'bank'").count() == 0
    assert facts.where("lei = 'unknown_ebit' and field = 'ebit' and value is null and derivation = 'reported'").count() == 1


def test_share_estimates(voted):
    est = extraction.share_estimates(voted).where("lei = 'eps'").first()
    assert est.wavg_basic == 50e6 and est.wavg_diluted == 60e6 and abs(est.dilution_factor - 1.2) < 1e-12
    assert extraction.share_estimates(voted).where("lei = 'base'").first().wavg_diluted is None


def test_skipped_facts(documents):
    parsed = filings.parse_documents(documents, extraction.KEYS, [])
    skipped = {r.lei: r for r in filings.skipped_counts(parsed, extraction.KEYS).collect()}
    assert skipped["segments"].skipped_dimensional == 2 and skipped["texts"].skipped_nonnumeric == 1


def test_vote_needs_every_year(spark):
    rows = spark.createDataFrame([("a", 2020, True, "complete"), ("a", 2021, False, "complete"), ("b", 2020, True, "partial")],
                                 "lei string, fiscal_year int, likely_financial boolean, status string")
    out = {(r.lei, r.fiscal_year): r for r in extraction.vote_financial(rows).collect()}
    assert out["a", 2020].status == "complete" and out["a", 2020].any_financial
    assert out["b", 2020].status == "failed"


def test_texts_read_after_the_reduction_give_the_same_lines(documents, voted):
    """Facts reduced as written, one period in three spellings, an unusable one, and names judged beforehand."""
    written = {"2024-01-01T00:00:00/2025-01-01T00:00:00": ["2024-01-01/2025-01-01", "2024-01-01T00:00:00/2024-12-31T23:59:59"],
               "2025-01-01T00:00:00": ["2025-01-01", "2024-12-31T18:00:00"]}
    spelled = [(c, written[p][i % 2] if i % 3 and p in written else p, v, *x) for i, (c, p, v, *x) in enumerate(CASES["gross_interest"])]
    odd = [(I + "Revenue", "sometime", 7.0), (I + "Revenue", "", 8.0), ("", YEAR, 9.0), ("acme:", YEAR, 1.0), (I + "Revenue", YEAR, "")]
    more = documents.sparkSession.createDataFrame(
        [("spelled", 2024, date(2024, 12, 31), "Name", "IT", "ref", document(spelled + odd)),
         ("empty", 2024, date(2024, 12, 31), "Name", "IT", "ref", '{"facts": {}}')], documents.schema)
    both = documents.unionByName(more)
    facts = filings.valued_facts(filings.open_documents(both, extraction.KEYS, []))
    named = extraction.named_written_facts(facts, extraction.KEYS, filings.read_texts)
    names = extraction.names_in_use(named)
    got = extraction.vote_financial(extraction.named_company_years(
        both.drop("body"), named, extraction.concept_names(names), placed=extraction.placed_names(names)))
    rows = {r.lei: r for r in got.collect()}
    assert {k: r for k, r in rows.items() if k in CASES} == {r.lei: r for r in voted.collect()}
    same = lambda r: {k: v for k, v in r.asDict().items() if k != "lei"}
    assert same(rows["spelled"]) == same(rows["gross_interest"])
    assert rows["empty"].status == "partial" and rows["empty"].revenue is None


def test_repeated_document_keeps_first_fact(spark):
    """A hot filing in many parts: duplicates are settled by document order."""
    parts = [("hot", 2024, i, document([(I + "Revenue", YEAR, 1000 + i)] * 3)) for i in range(400)]
    docs = spark.createDataFrame(parts, "lei string, fiscal_year int, part int, body string").repartition(8)
    facts = filings.numeric_facts(filings.parse_documents(docs, extraction.KEYS, ["part"]))
    best = extraction.best_facts(facts).collect()
    assert len(best) == 1 and best[0].value == 1000.0
    assert extraction.annual_period_ends(facts).first().n == 1200
