"""The registered queries against their oracles, and the shape of key plans."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_module
from accountloom.bindings import company_queries, filing_queries

SAMPLE = ("coverage_report", "best_duplicate_facts", "extracted_facts", "listing_outcomes", "industry_parameters",
          "classified_replies", "research_policy", "company_values", "portfolio_positions", "performance_series",
          "streamed_price_watch", "parsed_periods", "screening_run", "cleared_store", "outcomes_by_override_files",
          "values_by_ladder_files")


def cells(rows, columns):
    def show(v):
        if isinstance(v, float):
            return "null" if v != v else f"{v:.9g}"
        return str(v)
    return sorted(tuple(show(r[c]) for c in sorted(columns)) for r in rows)


@pytest.fixture(scope="module")
def oracle(sf_dir):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_oracle(spark, sf_dir, oracle, name):
    got = [r.asDict() for r in entry_module.queries()[name](spark, sf_dir).collect()]
    cursor = oracle.execute(entry_module.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    want = [dict(zip(columns, r)) for r in cursor.fetchall()]
    assert cells(got, columns) == cells(want, columns) and (not got or set(got[0]) == set(columns))


def test_entry_runs(spark):
    df = entry_module.entry(spark)
    assert df.count() > 0 and "complete" in df.columns


def test_every_oracle_has_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_have_no_cross_products(spark, sf_dir):
    queries = entry_module.queries()
    for name in ("latest_filing_per_year", "coverage_report", "primary_listing_pick", "as_of_prices", "position_events",
                 "research_policy", "company_values", "line_grid", "classified_replies"):
        text = plan(queries[name](spark, sf_dir))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def test_latest_rows_are_combined_before_the_shuffle(spark, sf_dir):
    text = plan(company_queries.latest_price(spark, sf_dir))
    assert "partial_max_by" in text and "Window" not in text


def test_scans_read_only_what_they_need(spark, sf_dir):
    text = plan(filing_queries.last_write_per_key(spark, sf_dir))
    assert "l_returnflag" not in text and "l_tax" not in text
