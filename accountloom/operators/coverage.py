"""Which companies filed for which years: dedupe, fold, summarise, sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from accountloom import spec
from accountloom.functions import ordered, text


def int_array(values: list[int]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def latest_filing_per_year(filings: DataFrame) -> DataFrame:
    """One filing per (lei, year): the highest entry number, the first seen on a tie.

    ``first_ord`` is where the pair first appears in the index, whichever filing wins.
    """
    entry = text.entry_number(F.col("filing_index"))
    keyed = filings.withColumn("year", F.year("reporting_date")).withColumn("entry", entry)
    carried = [c for c in keyed.columns if c not in ("lei", "year")]
    best = F.min_by(F.struct(*carried), F.struct(-F.col("entry"), F.col("ord"))).alias("won")
    return keyed.groupBy("lei", "year").agg(best, F.min("ord").alias("first_ord")) \
        .select("lei", "year", "first_ord", "won.*")


def filing_lookup(filings: DataFrame) -> DataFrame:
    """Best filing per (lei, year) among those that can be retrieved."""
    return latest_filing_per_year(filings.where(F.col("json_url") != ""))


def fold_coverage(per_year: DataFrame) -> DataFrame:
    """One row per entity: years, year-end months, error total, first name and country.

    Folding by (lei, month) first keeps the modal month exact, ties going to the month
    seen first, and leaves at most twelve rows per entity for the second step.
    """
    named = F.when(F.col("name") != "", F.col("first_ord"))
    monthly = per_year.withColumn("month", F.month("reporting_date")).groupBy("lei", "month").agg(
        F.count(F.lit(1)).alias("n"), F.min("first_ord").alias("seen"),
        F.sum("error_count").alias("errors"), F.collect_set("year").alias("ys"),
        F.min_by("name", named).alias("name"), F.min(named).alias("named_at"),
        F.min_by("country", F.col("first_ord")).alias("country"))
    return monthly.groupBy("lei").agg(
        F.coalesce(F.min_by("name", F.col("named_at")), F.lit("")).alias("name"),
        F.min_by("country", F.col("seen")).alias("country"),
        F.sort_array(F.flatten(F.collect_list("ys"))).alias("years"),
        F.min_by("month", F.struct(-F.col("n"), F.col("seen"))).alias("fiscal_month"),
        (F.count(F.lit(1)) <= 1).alias("consistent_year_end"),
        F.sum("errors").alias("error_count"))


def with_completeness(coverage: DataFrame, required: list[int]) -> DataFrame:
    """Adds the required years held and missing, and whether none is missing."""
    need = int_array(required)
    held = F.array_intersect(need, F.col("years"))
    return coverage.withColumn("years_held", F.size(held)) \
        .withColumn("missing", F.array_except(need, F.col("years"))) \
        .withColumn("complete", F.col("years_held") == len(required))


def coverage_totals(coverage: DataFrame, required: list[int]) -> DataFrame:
    c = with_completeness(coverage, required)
    done = F.count_if("complete")
    return c.agg(
        F.count(F.lit(1)).alias("entities_seen"), done.alias("entities_complete"),
        F.coalesce(F.bround(F.try_divide(done, F.count(F.lit(1))), 4), F.lit(0.0))
        .alias("completion_rate"),
        F.count_if(F.col("complete") & F.coalesce(F.col("fiscal_month") != 12, F.lit(True)))
        .alias("complete_non_calendar_fy"),
        F.count_if(F.col("complete") & ~F.col("consistent_year_end"))
        .alias("complete_moved_year_end"))


def years_held_histogram(coverage: DataFrame, required: list[int]) -> DataFrame:
    return with_completeness(coverage, required).groupBy("years_held") \
        .agg(F.count(F.lit(1)).alias("entities"))


def missing_by_year(coverage: DataFrame, required: list[int]) -> DataFrame:
    return with_completeness(coverage, required).select(F.explode("missing").alias("year")) \
        .groupBy("year").agg(F.count(F.lit(1)).alias("entities"))


def complete_by_country(coverage: DataFrame, required: list[int]) -> DataFrame:
    """Most common country first."""
    return with_completeness(coverage, required).where("complete").groupBy("country") \
        .agg(F.count(F.lit(1)).alias("entities")).orderBy(F.desc("entities"), "country")


def coverage_report(coverage: DataFrame, required: list[int]) -> DataFrame:
    """The published entity list: complete first, then country and name."""
    yes = lambda c: F.when(c, F.lit("YES")).otherwise(F.lit("no"))
    c = with_completeness(coverage, required)
    return c.orderBy(~F.col("complete"), "country", "name", "lei").select(
        "lei", "name", "country", yes(F.col("complete")).alias("complete"), "years_held",
        F.array_join(F.sort_array("years"), " ").alias("years_present"),
        F.array_join("missing", " ").alias("missing_years"), "fiscal_month",
        yes(F.col("consistent_year_end")).alias("consistent_year_end"),
        F.col("error_count").alias("archive_error_count"))


def window_roll(coverage: DataFrame, years: list[int], this_year: int) -> DataFrame:
    """Share of the complete entities that already filed the next year, and the decision."""
    nxt = years[-1] + 1
    c = with_completeness(coverage, years).where("complete")
    filed = F.count_if(F.array_contains("years", nxt))
    share = F.try_divide(filed, F.count(F.lit(1)))
    return c.agg(
        F.lit(nxt).alias("next_year"), filed.alias("filed"),
        F.count(F.lit(1)).alias("universe"), share.alias("share"),
        (F.coalesce(share >= spec.ROLL_SHARE, F.lit(False)) & F.lit(nxt < this_year)).alias("rolls"))


def missing_years(entities: DataFrame, store: DataFrame, years: list[int],
                  version: str | None) -> DataFrame:
    """(lei, year) pairs that still need extracting at this extractor version."""
    spine = entities.select("lei", F.explode(int_array(years)).alias("fiscal_year"))
    usable = store.where(F.col("status") != "failed")
    if version is not None:
        usable = usable.where(F.col("extractor_version") == version)
    return spine.join(usable.select("lei", "fiscal_year"), ["lei", "fiscal_year"], "left_anti")


def complete_entities(company_year: DataFrame, years: list[int]) -> DataFrame:
    """Entities with a complete record for every requested year."""
    return company_year.where((F.col("status") == "complete") & F.col("fiscal_year").isin(years)) \
        .groupBy("lei").agg(F.collect_set("fiscal_year").alias("held")) \
        .where(F.size("held") == len(years)).select("lei")


def stratified_sample(rows: DataFrame, n: int, seed: int, salts: int = 64) -> DataFrame:
    """``n`` entities, one per country in turn, larger countries first.

    Within a country the order is the MD5 of entity and seed.  Each country is cut to its first ``n``
    per salt and then once more, so no task ranks a whole large country.
    """
    pick = F.md5(F.concat_ws(":", "lei", F.lit(seed)))
    salted = rows.withColumn("_pick", pick).withColumn("_salt", F.pmod(F.xxhash64("_pick"), F.lit(salts)))
    rank = lambda *by: F.row_number().over(W.partitionBy(*by).orderBy("_pick", "lei"))
    first = salted.withColumn("_r", rank("country", "_salt")).where(F.col("_r") <= n)
    turns = first.withColumn("_turn", rank("country")).where(F.col("_turn") <= n)
    sizes = rows.groupBy("country").agg(F.count(F.lit(1)).alias("_size"))
    return turns.join(sizes, "country").orderBy("_turn", F.desc("_size"), "country").limit(n) \
        .select(*rows.columns)
