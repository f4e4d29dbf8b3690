"""The long fact store: replacing, reading, grids, reports and the five-year hand-off."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accountloom import spec
from accountloom.functions import ordered

KEYS = ["lei", "fiscal_year"]


# -- replacing ---------------------------------------------------------------------

def last_write(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last written row per key."""
    carry = [c for c in rows.columns if c not in keys]
    return ordered.latest(rows, keys, order, carry).select(*rows.columns)


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows whose key does not come in again, plus everything that comes in."""
    return stored.join(incoming.select(*keys).distinct(), keys, "left_anti") \
        .unionByName(incoming)


def put_company_years(headers: DataFrame, facts: DataFrame, new_headers: DataFrame,
                      new_facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Replace whole company-years; no fact of an older extraction survives.

    A failed header brings no facts, so its old ones go as well.
    """
    keys = new_headers.select(*KEYS).distinct()
    return (upsert(headers, new_headers, KEYS),
            facts.join(keys, KEYS, "left_anti").unionByName(new_facts))


def failed_headers(keys: DataFrame, version: str, reason: Column, at: Column) -> DataFrame:
    """Headers for company-years that could not be extracted."""
    none = lambda t: F.lit(None).cast(t)
    return keys.select(
        *KEYS, none("string").alias("name"), none("string").alias("country"),
        none("date").alias("period_end"), F.lit("esef").alias("source"), reason.alias("source_ref"),
        F.lit(version).alias("extractor_version"), at.alias("extracted_at"),
        F.lit("failed").alias("status"), none("string").alias("currency"),
        none("int").alias("scale"))


def replace_listings(stored: DataFrame, incoming: DataFrame, order: list[Column]) -> DataFrame:
    """All listings of an entity are replaced; within one batch the last row per key wins."""
    exchange = F.coalesce("exchange", F.lit("?"))
    keyed = incoming.withColumn("figi", F.coalesce("figi", F.concat_ws(":", F.col("isin"), exchange)))
    fresh = last_write(keyed, ["lei", "figi"], order)
    return stored.join(incoming.select("lei").distinct(), "lei", "left_anti") \
        .unionByName(fresh.select(*stored.columns))


def clear_extractions(headers: DataFrame, facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Empty extraction tables of the same shape; every other table is left alone."""
    return headers.where(F.lit(False)), facts.where(F.lit(False))


def run_state(state: DataFrame, changes: DataFrame) -> DataFrame:
    """Key-value run state: the inception date is written once, other keys are replaced."""
    keep_old = F.col("key") == "inception_date"
    both = state.select("key", F.col("value").alias("old")).join(
        changes.select("key", F.col("value").alias("new")), "key", "full")
    return both.select("key", F.when(keep_old, F.coalesce("old", "new"))
                       .otherwise(F.coalesce("new", "old")).alias("value"))


# -- checks and reports ------------------------------------------------------------

def vocabulary_problems(headers: DataFrame, facts: DataFrame) -> DataFrame:
    """Rows whose field, derivation, source or status is outside its closed set."""
    bad = lambda c, allowed, name: F.when(~F.col(c).isin(*allowed), F.lit(name))
    f = facts.select(*KEYS, F.explode(F.array_compact(F.array(
        bad("field", spec.LINE_ITEM_KEYS, "field"),
        bad("derivation", spec.DERIVATIONS, "derivation")))).alias("problem"))
    h = headers.select(*KEYS, F.explode(F.array_compact(F.array(
        bad("source", spec.SOURCES, "source"), bad("status", spec.STATUSES, "status")))).alias("problem"))
    return f.unionByName(h)


def line_grid(headers: DataFrame, facts: DataFrame) -> DataFrame:
    """Every usable company-year with all twenty lines, recorded or not.

    The twenty names are exploded from a constant instead of a cross join.
    """
    names = F.array(*[F.lit(k) for k in spec.LINE_ITEM_KEYS])
    return headers.where(F.col("status") != "failed").select(*KEYS, F.explode(names).alias("field")) \
        .join(facts, [*KEYS, "field"], "left")


def field_failure_report(headers: DataFrame, facts: DataFrame) -> DataFrame:
    """Unresolved and assumed-zero counts per line, worst first, zero rows included.

    Expected rows come from the headers and recorded rows from the facts; one combined
    aggregation of both replaces the join of the grid.
    """
    names = F.array(*[F.lit(k) for k in spec.LINE_ITEM_KEYS])
    expected = headers.select(
        F.explode(names).alias("field"), (F.col("status") != "failed").cast("int").alias("due"),
        F.lit(0).alias("seen"), F.lit(0).alias("empty"), F.lit(0).alias("zero"))
    zero = F.col("value").isNotNull() & (F.col("derivation") == "assumed_zero")
    recorded = facts.select(
        "field", F.lit(0).alias("due"), F.lit(1).alias("seen"),
        F.col("value").isNull().cast("int").alias("empty"), zero.cast("int").alias("zero"))
    return expected.unionByName(recorded).groupBy("field").agg(
        (F.sum("due") - F.sum("seen") + F.sum("empty")).alias("unresolved"),
        F.sum("zero").alias("assumed_zeros")) \
        .orderBy(F.desc("unresolved"), F.desc("assumed_zeros"), "field")


def unresolved_company_years(headers: DataFrame, facts: DataFrame, field: str) -> DataFrame:
    """Usable company-years where one line is missing or empty."""
    filled = facts.where((F.col("field") == field) & F.col("value").isNotNull()).select(*KEYS)
    return headers.where(F.col("status") != "failed").select(*KEYS).join(filled, KEYS, "left_anti")


def store_stats(headers: DataFrame, facts: DataFrame) -> DataFrame:
    """Counts by status, distinct entities, facts and assumed zeros, in one row."""
    none = F.lit(None).cast("string")
    rows = headers.select(F.lit("h").alias("t"), "lei", "status", none.alias("derivation")) \
        .unionByName(facts.select(F.lit("f").alias("t"), none.alias("lei"), none.alias("status"),
                                  "derivation"))
    per_entity = rows.groupBy("lei").agg(
        F.count_if(F.col("t") == "h").alias("years"),
        *[F.count_if(F.col("status") == s).alias(s) for s in spec.STATUSES],
        F.count_if(F.col("t") == "f").alias("facts"),
        F.count_if(F.col("derivation") == "assumed_zero").alias("zeros"))
    return per_entity.agg(
        F.sum("years").alias("company_years"), *[F.sum(s).alias(s) for s in spec.STATUSES],
        F.count("lei").alias("entities"), F.sum("facts").alias("facts"),
        F.sum("zeros").alias("assumed_zeros"))


def last_write_dates(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Calendar date of the last write per stage."""
    parts = [df.agg(F.to_date(F.max(c)).alias("last_date")).select(F.lit(stage).alias("stage"), "last_date")
             for stage, (df, c) in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# -- reads -------------------------------------------------------------------------

def latest_price(prices: DataFrame) -> DataFrame:
    """Newest row per entity."""
    return ordered.latest(prices, ["lei"], [F.col("as_of")],
                          [c for c in prices.columns if c != "lei"])


latest_share_count = latest_price


def price_history(prices: DataFrame) -> DataFrame:
    return prices.select("lei", "as_of", "price").orderBy("lei", "as_of")


def company_year_lookup(headers: DataFrame, facts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Facts of the wanted company-years, header columns first."""
    return wanted.select(*KEYS).distinct().join(headers, KEYS).join(facts, KEYS, "left")


def primary_listings(listings: DataFrame) -> DataFrame:
    """The one primary line per entity; a second one would be dropped by isin order."""
    rows = listings.where("is_primary")
    return ordered.earliest(rows, ["lei"], [F.col("isin"), F.col("exchange")],
                            [c for c in rows.columns if c != "lei"])


# -- hand-off ----------------------------------------------------------------------

def five_year_series(headers: DataFrame, facts: DataFrame,
                     years: list[int]) -> tuple[DataFrame, DataFrame]:
    """(series, rejects): twenty arrays of five values per entity, oldest first.

    An entity is refused when a year is missing or a required line of it is empty.
    """
    spec.check_window(years)
    due = headers.where(F.col("fiscal_year").isin(years))
    held = due.groupBy("lei").agg(
        F.count_distinct("fiscal_year").alias("n_years"),
        F.max_by("name", "fiscal_year").alias("name"),
        F.max_by("country", "fiscal_year").alias("country"),
        F.max_by("currency", "fiscal_year").alias("currency"),
        F.max_by("scale", "fiscal_year").alias("scale"))
    scale = F.lit(float(spec.SCALE))
    wanted = facts.where(F.col("fiscal_year").isin(years))
    lines = wanted.groupBy("lei", "field").agg(F.array(*[
        F.max(F.when(F.col("fiscal_year") == y, F.col("value") / scale)) for y in years]).alias("series"))
    full = F.col("field").isin(*spec.REQUIRED_KEYS) & ~F.exists("series", lambda v: v.isNull())
    wide = lines.groupBy("lei").agg(
        F.count_if(full).alias("n_full"),
        F.map_from_entries(F.collect_list(F.struct("field", "series"))).alias("by_line"))
    joined = held.join(wide, "lei", "left").withColumn("reason", F.when(
        F.col("n_years") < len(years), F.lit("missing years")).when(
        F.coalesce("n_full", F.lit(0)) < len(spec.REQUIRED_KEYS), F.lit("unresolved required fields")))
    series = joined.where(F.col("reason").isNull()).select(
        "lei", "name", "country", "currency", "scale",
        *[F.try_element_at("by_line", F.lit(k)).alias(k) for k in spec.LINE_ITEM_KEYS])
    return series, joined.where(F.col("reason").isNotNull()).select("lei", "reason")


def provenance(headers: DataFrame, facts: DataFrame, years: list[int]) -> DataFrame:
    """Sources, extractor versions, assumed zeros and derivations behind a five-year record."""
    rows = facts.where(F.col("fiscal_year").isin(years))
    per_year = rows.groupBy("lei", "fiscal_year").agg(
        F.sort_array(F.collect_list(F.when(F.col("derivation") == "assumed_zero", F.col("field"))))
        .alias("zeros"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("field", "derivation")))).alias("derivations"))
    by_lei = per_year.groupBy("lei").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.when(
            F.size("zeros") > 0, F.struct(F.col("fiscal_year").cast("string").alias("y"), F.col("zeros"))))))
        .alias("assumed_zeros"),
        F.map_from_arrays(
            F.transform(F.array_sort(F.collect_list("fiscal_year")), lambda y: y.cast("string")),
            F.transform(F.array_sort(F.collect_list(F.struct("fiscal_year", F.to_json("derivations").alias("d")))),
                        lambda s: s["d"])).alias("field_derivations"))
    top = headers.where(F.col("fiscal_year").isin(years)).groupBy("lei").agg(
        F.sort_array(F.collect_set("source")).alias("sources"),
        F.sort_array(F.collect_set("extractor_version")).alias("extractor_versions"),
        F.transform(F.array_sort(F.collect_list(F.struct("fiscal_year", "period_end"))),
                    lambda s: s["period_end"]).alias("period_ends"))
    return top.join(by_lei, "lei", "left")
