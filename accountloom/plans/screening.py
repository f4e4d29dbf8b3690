"""End-to-end dataflows put together from the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from accountloom import spec
from accountloom.operators import coverage, extraction, policy, results, store, valuation
from accountloom.sources import filings, sinks


def coverage_run(index: DataFrame) -> DataFrame:
    """Filing index to one coverage row per entity."""
    return coverage.fold_coverage(coverage.latest_filing_per_year(index))


def extraction_run(documents: DataFrame, order: list[str], **options) -> DataFrame:
    """Filing documents to voted company-years.

    ``documents``: lei, fiscal_year, hint, name, country, source_ref, body.
    """
    return extract_parsed(filing_headers(documents), filings.parse_documents(documents, extraction.KEYS, order), **options)


def filing_headers(documents: DataFrame) -> DataFrame:
    """One row per filing: hint, name, country, source_ref.

    Equal rows go first, in hash tables: the greatest of texts is found by sorting.
    """
    return documents.select(*extraction.KEYS, "hint", "name", "country", "source_ref").distinct().groupBy(*extraction.KEYS).agg(*[
        F.max(c).alias(c) for c in ("hint", "name", "country", "source_ref")])


def extract_parsed(headers: DataFrame, parsed: DataFrame, **options) -> DataFrame:
    """Voted company-years from facts that are parsed, and may be stored, already."""
    return extraction.vote_financial(
        extraction.extract_company_years(headers, filings.numeric_facts(parsed), **options))


def extract_named(headers: DataFrame, named: DataFrame, concepts: DataFrame, **options) -> DataFrame:
    """Voted company-years from the best facts per name, which may be stored already, and their concepts."""
    return extraction.vote_financial(extraction.named_company_years(headers, named, concepts, **options))


def write_extraction(voted: DataFrame, extracted_at: Column, path: str) -> dict[str, int]:
    """Write headers and facts of an extraction; what became of its company-years, counted on the way.

    The counts are taken from the rows of the first table while they are written. A company with a mixed
    financial signal counts once, at its first year.
    """
    first = F.col("fiscal_year") == F.min("fiscal_year").over(W.partitionBy("lei"))
    marked = voted.withColumn("_mixed", F.col("any_financial") & ~F.col("is_financial") & first)
    rows = extraction.company_year_rows(marked, extracted_at, "_mixed", "interest_zero_despite_debt")
    is_ = lambda status: F.count_if(F.col("status") == status)
    counts = sinks.write_counted(rows, f"{path}/company_year", ["fiscal_year"], {
        "complete": is_("complete"), "partial": is_("partial"), "financial": is_("failed"),
        "interest_zero_despite_debt": F.count_if("interest_zero_despite_debt"), "mixed_financial_signal": F.count_if("_mixed")})
    sinks.write_partitions(extraction.fact_rows(voted), f"{path}/fact", ["fiscal_year"])
    return counts


def extraction_plan(entities: DataFrame, headers: DataFrame, lookup: DataFrame,
                    years: list[int], version: str = spec.EXTRACTOR_VERSION) -> DataFrame:
    """Every (lei, year) of the universe with what is to be done about it.

    cached: usable at this version; todo: a filing exists; no_filing: none does.
    """
    due = coverage.missing_years(entities, headers, years, version).withColumn("due", F.lit(True))
    spine = entities.select("lei", F.explode(coverage.int_array(years)).alias("fiscal_year"))
    filed = lookup.select("lei", F.col("year").alias("fiscal_year"), F.lit(True).alias("filed"), "json_url")
    keys = ["lei", "fiscal_year"]
    state = F.when(F.col("due").isNull(), "cached").when(F.col("filed").isNull(), "no_filing").otherwise("todo")
    return spine.join(due, keys, "left").join(filed, keys, "left") \
        .select(*keys, state.alias("state"), "json_url")


def screen_run(headers: DataFrame, facts: DataFrame, listings: DataFrame, prices: DataFrame,
               shares: DataFrame, mapping: DataFrame, industries: DataFrame, countries: DataFrame,
               excluded: DataFrame, market: dict[str, Column], years: list[int], today: Column,
               research: spec.Policy = spec.Policy()) -> tuple[DataFrame, DataFrame]:
    """(results, skipped): value every eligible company and decide the research flag.

    A company whose five-year record is refused, or whose inputs are not usable, is
    skipped with a reason; the run goes on.
    """
    entities = coverage.complete_entities(headers, years)
    inputs = policy.screening_inputs(
        entities, headers, store.primary_listings(listings), store.latest_price(prices),
        store.latest_share_count(shares), mapping, industries, countries, years[-1])
    ready = policy.eligible(policy.readiness(inputs), excluded)
    series, rejects = store.five_year_series(headers, facts, years)
    joined = ready.join(series.drop("name", "country"), "lei").withColumns(dict(market))
    missing = [c for c in ("tax_rate", "unlevered_beta", "sales_to_capital", "ebit_margin", "roic")]
    gap = F.coalesce(*[F.when(F.col(c).isNull(), F.lit(f"{c} is missing")) for c in missing])
    checked = joined.withColumn("gap", gap)
    usable = checked.where(F.col("gap").isNull())
    valued = policy.apply_policy(valuation.with_price_age(valuation.value_companies(usable), today), research)
    skipped = ready.join(rejects, "lei").select("lei", "reason").unionByName(
        checked.where(F.col("gap").isNotNull()).select("lei", F.col("gap").alias("reason")))
    return valued.withColumn("current_price", F.col("price")), skipped


def screen_triggers(valued: DataFrame, run_date: Column) -> DataFrame:
    return results.triggers(valued, run_date)
