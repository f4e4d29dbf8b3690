"""Coverage, extraction and store queries on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from accountloom import spec
from accountloom.bindings.base import (
    DEALT, EXTRACT_SQL, FACTS_SQL, FILINGS_SQL, PERIOD_SQL, YEARS, filing_documents, filing_heads, filing_index,
    pick, sql_list, table)
from accountloom.functions import text
from accountloom.operators import coverage, extraction, store
from accountloom.plans import screening
from accountloom.session import stored, work_path
from accountloom.sources import filings, sinks

QUERIES, ORACLE = {}, {}
KEYS = extraction.KEYS


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn
    return register


def _coverage(spark, d):
    return screening.coverage_run(filing_index(spark, d))


ORDER = ["doc_no"]


def _facts(spark, d, keys=KEYS):
    """Every fact of the documents, parsed by the task that builds them."""
    return filings.parse_documents(filing_documents(spark, d), keys, ORDER)


def _parsed(spark, d):
    """The parsed facts, written once for all queries of an application."""
    return stored(spark, "facts", d, lambda: _facts(spark, d))


def _named(spark, d):
    """The best fact per filing, end date and concept, written once: what an extraction needs of the facts.

    The task that parses the documents of a filing reduces their facts, and reads concepts and periods of what is
    left; a filing cut into pieces has a row per piece.
    """
    return stored(spark, "named_facts", d, lambda: extraction.named_written_facts(filings.valued_facts(
        filings.open_documents(filing_documents(spark, d), DEALT, ORDER)), DEALT, filings.read_texts).drop("piece"))


NAMED_PER_TASK = 250_000
"""About how many of these facts a task brings together by filing, whatever their compressed size."""


def _voted(spark, d, **options):
    named = _named(spark, d)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), named.count() // NAMED_PER_TASK)
    names = stored(spark, "names", d, lambda: extraction.names_in_use(named))
    concepts = stored(spark, "concepts", d, lambda: extraction.concept_names(names))
    placed = stored(spark, "placed_names", d, lambda: extraction.placed_names(names))
    heads = stored(spark, "filing_heads", d, lambda: screening.filing_headers(filing_heads(spark, d)))
    return screening.extract_named(heads, named, concepts, parts=parts, placed=placed, **options)


def _stored_vote(spark, d):
    """One extraction for all queries of an application: written once to the shared folder."""
    return stored(spark, "company_years", d, lambda: _voted(spark, d))


def _store(spark, d):
    """Headers and facts of the stored extraction."""
    voted = _stored_vote(spark, d)
    return extraction.company_year_rows(voted, F.lit("2002-01-01").cast("timestamp")), extraction.fact_rows(voted)


# -- coverage ----------------------------------------------------------------------

@query(f"WITH {FILINGS_SQL} SELECT lei, year, entry::BIGINT AS entry, reporting_date, name, country, first_ord, ord FROM per_year")
def latest_filing_per_year(spark, d):
    return coverage.latest_filing_per_year(filing_index(spark, d)).select(
        "lei", "year", "entry", "reporting_date", "name", "country", "first_ord", "ord")


@query(f"""WITH {FILINGS_SQL} SELECT lei, year, json_url, reporting_date FROM filings WHERE json_url <> ''
QUALIFY row_number() OVER (PARTITION BY lei, year ORDER BY entry DESC, ord) = 1""")
def filing_lookup(spark, d):
    return coverage.filing_lookup(filing_index(spark, d)).select("lei", "year", "json_url", "reporting_date")


@query(f"""WITH {FILINGS_SQL} SELECT lei, name, country, array_to_string(years, ' ') AS years, fiscal_month,
consistent_year_end, error_count FROM cov""")
def coverage_by_entity(spark, d):
    return _coverage(spark, d).select("lei", "name", "country", F.array_join("years", " ").alias("years"),
                                      "fiscal_month", "consistent_year_end", "error_count")


@query(f"""WITH {FILINGS_SQL} SELECT count(*) AS entities_seen, count(*) FILTER (years_held = 5) AS entities_complete,
round(count(*) FILTER (years_held = 5) / count(*), 4) AS completion_rate,
count(*) FILTER (years_held = 5 AND fiscal_month <> 12) AS complete_non_calendar_fy,
count(*) FILTER (years_held = 5 AND NOT consistent_year_end) AS complete_moved_year_end FROM done""")
def coverage_totals(spark, d):
    return coverage.coverage_totals(_coverage(spark, d), YEARS)


@query(f"WITH {FILINGS_SQL} SELECT years_held, count(*) AS entities FROM done GROUP BY 1")
def years_held_histogram(spark, d):
    return coverage.years_held_histogram(_coverage(spark, d), YEARS)


@query(f"WITH {FILINGS_SQL} SELECT year::INT AS year, count(*) AS entities FROM (SELECT unnest(missing) AS year FROM done) GROUP BY 1")
def missing_by_year(spark, d):
    return coverage.missing_by_year(_coverage(spark, d), YEARS)


@query(f"WITH {FILINGS_SQL} SELECT country, count(*) AS entities FROM done WHERE years_held = 5 GROUP BY 1 ORDER BY 2 DESC, 1")
def complete_by_country(spark, d):
    return coverage.complete_by_country(_coverage(spark, d), YEARS)


@query(f"""WITH {FILINGS_SQL} SELECT lei, name, country, CASE WHEN years_held = 5 THEN 'YES' ELSE 'no' END AS complete,
years_held, array_to_string(years, ' ') AS years_present, array_to_string(missing, ' ') AS missing_years, fiscal_month,
CASE WHEN consistent_year_end THEN 'YES' ELSE 'no' END AS consistent_year_end, error_count AS archive_error_count
FROM done ORDER BY years_held <> 5, country, name, lei""")
def coverage_report(spark, d):
    return coverage.coverage_report(_coverage(spark, d), YEARS)


@query(f"WITH {FILINGS_SQL} SELECT lei, name, country, years_held::INT AS years_held FROM done WHERE years_held = 5")
def universe_from_report(spark, d):
    """The written coverage report read back as the universe of complete entities."""
    path = work_path(spark, "coverage")
    sinks.write_report(coverage.coverage_report(_coverage(spark, d), YEARS), path)
    return filings.read_universe(spark, path).select("lei", "name", "country", "years_held")


@query(f"""WITH {FILINGS_SQL}, u AS (SELECT list_contains(years, 2001) AS nxt FROM done WHERE years_held = 5)
SELECT 2001 AS next_year, count(*) FILTER (nxt) AS filed, count(*) AS universe,
(count(*) FILTER (nxt)) / count(*) AS share, (count(*) FILTER (nxt)) / count(*) >= 0.8 AS rolls FROM u""")
def fiscal_window_roll(spark, d):
    return coverage.window_roll(_coverage(spark, d), YEARS, 2003)


@query(f"""WITH {FILINGS_SQL}, spine AS (SELECT c.lei, y.fiscal_year FROM (SELECT DISTINCT lei FROM filings) c,
(SELECT unnest({YEARS}) AS fiscal_year) y),
usable AS (SELECT lei, year FROM per_year WHERE json_url <> '' AND entry >= 2)
SELECT lei, fiscal_year FROM spine s WHERE NOT EXISTS
(SELECT 1 FROM usable u WHERE u.lei = s.lei AND u.year = s.fiscal_year)""")
def missing_company_years(spark, d):
    per_year = coverage.latest_filing_per_year(filing_index(spark, d))
    headers = per_year.select(
        "lei", F.col("year").alias("fiscal_year"), F.when(F.col("json_url") == "", "failed").otherwise("complete").alias("status"),
        F.when(F.col("entry") >= 2, spec.EXTRACTOR_VERSION).otherwise("older").alias("extractor_version"))
    return coverage.missing_years(per_year.select("lei").distinct(), headers, YEARS, spec.EXTRACTOR_VERSION)


@query(f"""WITH {FILINGS_SQL}, s AS (SELECT country, count(*) AS size FROM done GROUP BY 1),
r AS (SELECT d.country, size, row_number() OVER (PARTITION BY d.country ORDER BY lei) AS turn FROM done d
  JOIN s USING (country)),
p AS (SELECT country FROM r ORDER BY turn, size DESC, country LIMIT 50)
SELECT country, count(*) AS picked FROM p GROUP BY 1""")
def stratified_sample_sizes(spark, d):
    entities = _coverage(spark, d).select("lei", "name", "country")
    return coverage.stratified_sample(entities, 50, seed=7).groupBy("country").agg(F.count(F.lit(1)).alias("picked"))


@query(f"""WITH {FILINGS_SQL}, s AS (SELECT country, count(*) AS size FROM done GROUP BY 1),
r AS (SELECT d.*, size, row_number() OVER (PARTITION BY d.country ORDER BY md5(lei || ':7'), lei) AS turn FROM done d
  JOIN s USING (country))
SELECT lei, name, country FROM r ORDER BY turn, size DESC, country LIMIT 50""")
def stratified_sample(spark, d):
    return coverage.stratified_sample(_coverage(spark, d).select("lei", "name", "country"), 50, seed=7)


def _named_parts(spark, d):
    parts = list(spec.EXCLUDED_NAME_PARTS) + [""] * 80
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("id"),
        F.concat_ws(" ", "p_name", F.initcap(pick(parts, F.col("p_partkey") % len(parts)))).alias("name"))


_PARTS_SQL = f"""n AS (SELECT p_partkey AS id, lower(p_name || ' ' ||
{sql_list(list(spec.EXCLUDED_NAME_PARTS) + [''] * 80)}[(p_partkey % {len(spec.EXCLUDED_NAME_PARTS) + 80} + 1)::INT]) AS low FROM part)"""


@query(f"""WITH {_PARTS_SQL} SELECT id, {" OR ".join(f"contains(low, '{p}')" for p in spec.EXCLUDED_NAME_PARTS)} AS dropped FROM n""")
def excluded_names(spark, d):
    kept, dropped = filings.split_excluded_names(_named_parts(spark, d))
    return kept.select("id", F.lit(False).alias("dropped")).unionByName(dropped.select("id", F.lit(True).alias("dropped")))


@query(f"""SELECT doc_id, {" OR ".join(f"contains(lower(text), '{p}')" for p in spec.EXCLUDED_NAME_PARTS)} AS hit,
length(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]', '', 'g')) AS plain_length FROM documents""")
def normalised_documents(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", text.contains_any(F.lower("text"), spec.EXCLUDED_NAME_PARTS).alias("hit"),
        F.length(text.normalise(F.col("text"))).cast("bigint").alias("plain_length"))


@query(f"""WITH {FILINGS_SQL}, f AS (SELECT country, country || '.json' AS file, count(*) AS records FROM filings GROUP BY ALL)
SELECT file, CASE WHEN country IN ('DE', 'FR') THEN 0 ELSE records END::BIGINT AS records,
  CASE WHEN country = 'DE' THEN 'does not parse' WHEN country = 'FR' THEN 'does not parse' ELSE '' END AS reason FROM f""")
def index_files(spark, d):
    """Country files as an archive has them, two of them cut off, read back with what is broken."""
    path = work_path(spark, "index")
    rows = filing_index(spark, d)
    record = F.to_json(F.struct("lei", "name", F.col("reporting_date").cast("string").alias("reporting_date"),
                                "filing_index", "error_count", "json_url"))
    files = rows.groupBy("country").agg(F.concat_ws(",", F.collect_list(record)).alias("j"))  # a file is one document
    whole = F.concat(F.lit("["), F.col("j"), F.lit("]"))
    cut = F.when(F.col("country") == "DE", F.concat(F.lit("["), F.expr("substring(j, 1, length(j) - 7)"))) \
        .when(F.col("country") == "FR", F.lit("<html>busy</html>")).otherwise(whole)
    files.select(cut.alias("value"), F.concat("country", F.lit(".json")).alias("file")) \
        .write.partitionBy("file").text(path)
    return filings.file_report(*filings.read_index_files(spark, f"{path}/*"), name=F.regexp_extract(
        F.col("path"), r"file=([^/]+)/", 1))


# -- facts and extraction ----------------------------------------------------------

@query(f"WITH {FACTS_SQL} SELECT lei, fy AS fiscal_year, outcome, count(*) AS n FROM parsed GROUP BY ALL")
def fact_outcomes(spark, d):
    return _parsed(spark, d).groupBy(*KEYS, "outcome").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {FACTS_SQL} SELECT lei, fy AS fiscal_year, count(*) FILTER (outcome = 'dimensional') AS skipped_dimensional,
count(*) FILTER (outcome = 'nonnumeric') AS skipped_nonnumeric FROM parsed GROUP BY ALL""")
def skipped_facts(spark, d):
    return filings.skipped_counts(_parsed(spark, d), KEYS)


@query(f"""WITH {FACTS_SQL} SELECT lei, fy AS fiscal_year, regexp_replace(concept, '^[^:]*:', '') AS local_name
FROM parsed GROUP BY ALL HAVING bool_and(outcome = 'dimensional')""")
def dimensional_only_names(spark, d):
    return filings.dimensional_only_names(_parsed(spark, d), KEYS)


@query(f"""WITH {FACTS_SQL} SELECT lei, fy AS fiscal_year, concept, local AS local_name, ifrs AS is_ifrs, "end",
kind IS NULL OR kind = 'annual' AS is_duration, count(*) AS n, sum(value::DECIMAL(18, 2))::DOUBLE AS total FROM facts
  GROUP BY ALL""")
def numeric_facts(spark, d):
    return filings.numeric_facts(_parsed(spark, d)).groupBy(
        *KEYS, "concept", "local_name", "is_ifrs", "end", "is_duration").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total"))


@query(f"""WITH {FACTS_SQL} SELECT lei, fy AS fiscal_year, kind, "end", count(*) AS n FROM facts WHERE kind IS NOT NULL
  GROUP BY ALL""")
def period_end_histogram(spark, d):
    facts = filings.numeric_facts(_parsed(spark, d))
    ends = extraction.annual_period_ends(facts).drop("seen").withColumn("kind", F.lit("annual"))
    return ends.unionByName(extraction.instant_dates(facts).withColumn("kind", F.lit("instant")))


@query(f"WITH {FACTS_SQL}, {PERIOD_SQL} SELECT lei, fy AS fiscal_year, pe AS period_end FROM period")
def inferred_period_ends(spark, d):
    ends = extraction.annual_period_ends(filings.numeric_facts(_facts(spark, d)))
    return extraction.infer_period_end(ends, filing_heads(spark, d).select(*KEYS, "hint").distinct())


@query(f"""WITH {FACTS_SQL} SELECT lei, fy AS fiscal_year, "end", kind, local AS local_name, value, concept, ifrs AS is_ifrs
FROM facts WHERE kind IS NOT NULL QUALIFY row_number() OVER (PARTITION BY lei, fy, "end", kind, local
ORDER BY NOT ifrs, NOT eur, l_orderkey, l_linenumber, l_partkey, l_extendedprice, j) = 1""")
def best_duplicate_facts(spark, d):
    return extraction.best_facts(filings.numeric_facts(_parsed(spark, d)))


_FACT_SQL = f"""WITH {EXTRACT_SQL} SELECT lei, fiscal_year, field, round(value, 2) AS value, derivation, element,
components, sign_flipped FROM fact"""


@query(_FACT_SQL)
def extracted_facts(spark, d):
    return extraction.fact_rows(_stored_vote(spark, d)).select(
        *KEYS, "field", F.round("value", 2).alias("value"), "derivation", "element",
        F.array_join("components", "|").alias("components"), "sign_flipped")


@query(f"""WITH {EXTRACT_SQL} SELECT lei, fiscal_year, CASE WHEN status <> 'failed' THEN name END AS name,
CASE WHEN status <> 'failed' THEN country END AS country, CASE WHEN status <> 'failed'
  THEN pe END AS period_end, status,
CASE WHEN status = 'failed' THEN '{spec.FINANCIAL_REASON}' ELSE source_ref END AS source_ref FROM headers""")
def company_years(spark, d):
    return extraction.company_year_rows(_stored_vote(spark, d), F.lit("2002-01-01").cast("timestamp")).select(
        *KEYS, "name", "country", "period_end", "status", "source_ref")


@query(f"""WITH {EXTRACT_SQL}, o AS (SELECT CASE WHEN status = 'failed' THEN 'financial' ELSE status END AS outcome FROM headers
UNION ALL SELECT 'interest_zero_despite_debt' FROM headers WHERE debt > 0 AND interest_expense IS NULL
UNION ALL SELECT 'mixed_financial_signal' FROM (SELECT DISTINCT lei FROM headers WHERE any_financial
  AND NOT is_financial))
SELECT outcome, count(*) AS n FROM o GROUP BY 1""")
def written_extraction_counts(spark, d):
    """The counters of an extraction, taken beside the write of its headers."""
    path = work_path(spark, "extraction")
    return sinks.count_rows(spark, screening.write_extraction(
        _stored_vote(spark, d), F.lit("2002-01-01").cast("timestamp"), path))


@query(f"""WITH {EXTRACT_SQL} SELECT lei, fiscal_year, n_missing::INT AS n_missing,
CASE WHEN debt > 0 AND interest_expense IS NULL
  THEN 'debt of ' || format('{{:,}}', round_even(debt, 0)::BIGINT) || ' without an interest line'
WHEN debt <= 0 AND coalesce(interest_expense, 0) > 0
  THEN 'interest of ' || format('{{:,}}', round_even(interest_expense, 0)::BIGINT) || ' without any debt line'
ELSE '' END AS reason FROM headers""")
def interest_contradictions(spark, d):
    return _stored_vote(spark, d).select(
        *KEYS, F.size("missing_required").alias("n_missing"), F.array_join("blocked", "; ").alias("reason"))


@query(f"""WITH {EXTRACT_SQL} SELECT lei, fiscal_year, round(coalesce(ebit, pretax_income + coalesce(interest_expense, 0)
- abs(coalesce(fin, 0)) - coalesce(assoc, 0)), 2) AS ebit, ebit IS NULL AND pretax_income IS NOT NULL AS computed
  FROM headers""")
def ebit_fallback(spark, d):
    return _voted(spark, d, ebit_fallback=True).select(
        *KEYS, F.round("ebit.value", 2).alias("ebit"),
        F.coalesce(F.col("ebit.derivation") == "computed", F.lit(False)).alias("computed"))


@query(f"""WITH {EXTRACT_SQL} SELECT lei, bool_and(likely_financial) AS is_financial, bool_or(likely_financial) AS any_financial
FROM headers GROUP BY 1""")
def financial_vote(spark, d):
    return _stored_vote(spark, d).select("lei", "is_financial", "any_financial").distinct()


@query(f"""WITH {EXTRACT_SQL}, o AS (SELECT CASE WHEN status = 'failed' THEN 'financial' ELSE status END AS outcome FROM headers
UNION ALL SELECT 'interest_zero_despite_debt' FROM headers WHERE debt > 0 AND interest_expense IS NULL
UNION ALL SELECT 'mixed_financial_signal' FROM (SELECT DISTINCT lei FROM headers WHERE any_financial
  AND NOT is_financial)
UNION ALL SELECT 'no_filing' FROM (SELECT DISTINCT lei FROM headers))
SELECT outcome, count(*) AS n FROM o GROUP BY 1""")
def extraction_counters(spark, d):
    voted = _stored_vote(spark, d)
    todo = voted.select(*KEYS, F.lit("todo").alias("state"))
    none = voted.select("lei").distinct().select("lei", F.lit(1990).alias("fiscal_year"), F.lit("no_filing").alias("state"))
    return extraction.extraction_counts(todo.unionByName(none), voted)


@query(f"""WITH {EXTRACT_SQL} SELECT lei, fiscal_year, round(net_income, 2) AS net_income,
round(net_income / nullif(basic, 0), 6) AS wavg_basic,
round(coalesce(net_income / nullif(diluted, 0), net_income / nullif(basic, 0)), 6) AS wavg_diluted,
round(basic / nullif(diluted, 0), 6) AS dilution_factor FROM headers WHERE net_income <> 0""")
def share_estimates(spark, d):
    return extraction.share_estimates(_stored_vote(spark, d)).select(
        *KEYS, F.round("net_income", 2).alias("net_income"), F.round("wavg_basic", 6).alias("wavg_basic"),
        F.round("wavg_diluted", 6).alias("wavg_diluted"), F.round("dilution_factor", 6).alias("dilution_factor"))


# -- store -------------------------------------------------------------------------

@query(f"""WITH {EXTRACT_SQL}, t AS (SELECT count(*) AS n FROM headers WHERE status <> 'failed')
SELECT k.field, (t.n - count(f.field) + count(*) FILTER (f.field IS NOT NULL
  AND f.value IS NULL))::BIGINT AS unresolved,
count(*) FILTER (f.derivation = 'assumed_zero') AS assumed_zeros
FROM (SELECT unnest({sql_list(spec.LINE_ITEM_KEYS)}) AS field) k CROSS JOIN t LEFT JOIN fact f ON f.field = k.field
GROUP BY k.field, t.n""")
def field_failure_report(spark, d):
    return store.field_failure_report(*_store(spark, d))


@query(f"""WITH {EXTRACT_SQL} SELECT h.lei, h.fiscal_year FROM headers h LEFT JOIN fact f
ON (h.lei, h.fiscal_year) = (f.lei, f.fiscal_year) AND f.field = 'capex' WHERE h.status <> 'failed' AND f.value IS NULL""")
def unresolved_capex_years(spark, d):
    return store.unresolved_company_years(*_store(spark, d), "capex")


@query(f"""WITH {EXTRACT_SQL} SELECT h.lei, h.fiscal_year FROM headers h LEFT JOIN fact f
ON (h.lei, h.fiscal_year) = (f.lei, f.fiscal_year) AND f.field = 'revenue' WHERE h.status <> 'failed'
  AND f.value IS NULL""")
def unresolved_revenue_years(spark, d):
    """A line that does have gaps."""
    return store.unresolved_company_years(*_store(spark, d), "revenue")


@query(f"""WITH {EXTRACT_SQL} SELECT h.lei, h.fiscal_year, k.field, f.value IS NOT NULL AS resolved
FROM headers h CROSS JOIN (SELECT unnest({sql_list(spec.LINE_ITEM_KEYS)}) AS field) k
LEFT JOIN fact f ON (h.lei, h.fiscal_year, k.field) = (f.lei, f.fiscal_year, f.field) WHERE h.status <> 'failed'""")
def line_grid(spark, d):
    return store.line_grid(*_store(spark, d)).select(*KEYS, "field", F.col("value").isNotNull().alias("resolved"))


@query(f"""WITH {EXTRACT_SQL} SELECT (SELECT count(*) FROM headers)::BIGINT AS company_years,
(SELECT count(*) FROM headers WHERE status = 'complete')::BIGINT AS complete,
(SELECT count(*) FROM headers WHERE status = 'partial')::BIGINT AS partial,
(SELECT count(*) FROM headers WHERE status = 'failed')::BIGINT AS failed,
(SELECT count(DISTINCT lei) FROM headers)::BIGINT AS entities, (SELECT count(*) FROM fact)::BIGINT AS facts,
(SELECT count(*) FROM fact WHERE derivation = 'assumed_zero')::BIGINT AS assumed_zeros""")
def store_statistics(spark, d):
    return store.store_stats(*_store(spark, d))


@query(f"""WITH {EXTRACT_SQL} SELECT lei FROM headers WHERE status = 'complete' AND fiscal_year IN {tuple(YEARS)}
GROUP BY lei HAVING count(DISTINCT fiscal_year) = 5""")
def complete_entities(spark, d):
    return coverage.complete_entities(_store(spark, d)[0], YEARS)


_SERIES_SQL = f"""WITH {EXTRACT_SQL}, held AS (SELECT lei, count(DISTINCT fiscal_year) AS n FROM headers
WHERE fiscal_year IN {tuple(YEARS)} GROUP BY 1),
full_ AS (SELECT lei, count(*) FILTER (value IS NOT NULL AND field IN {tuple(spec.REQUIRED_KEYS)}) AS n
FROM fact WHERE fiscal_year IN {tuple(YEARS)} GROUP BY 1)"""


@query(_SERIES_SQL + f""" SELECT f.lei, f.field, {", ".join(
    f"round(max(value) FILTER (fiscal_year = {y}) / 1000000.0, 8) AS y{y}" for y in YEARS)}
FROM fact f JOIN held USING (lei) JOIN full_ USING (lei) WHERE held.n = 5 AND full_.n = {5 * len(spec.REQUIRED_KEYS)}
AND fiscal_year IN {tuple(YEARS)} GROUP BY ALL""")
def five_year_series(spark, d):
    series, _ = store.five_year_series(*_store(spark, d), YEARS)
    lines = F.array(*[F.struct(F.lit(k).alias("field"), F.col(k).alias("s")) for k in spec.LINE_ITEM_KEYS])
    return series.select("lei", F.explode(lines).alias("l")).select(
        "lei", "l.field", *[F.round(F.col("l.s")[i], 8).alias(f"y{y}") for i, y in enumerate(YEARS)])


@query(_SERIES_SQL + f""" SELECT held.lei, CASE WHEN held.n < 5 THEN 'missing years' ELSE 'unresolved required fields' END AS reason
FROM held LEFT JOIN full_ USING (lei) WHERE held.n < 5 OR coalesce(full_.n, 0) < {5 * len(spec.REQUIRED_KEYS)}""")
def refused_series(spark, d):
    return store.five_year_series(*_store(spark, d), YEARS)[1]


@query(f"""WITH {EXTRACT_SQL} SELECT lei, fiscal_year, coalesce(string_agg(field, ' ' ORDER BY field)
FILTER (derivation = 'assumed_zero'), '') AS zeros FROM fact WHERE fiscal_year IN {tuple(YEARS)} GROUP BY ALL""")
def assumed_zero_provenance(spark, d):
    prov = store.provenance(*_store(spark, d), YEARS)
    held = prov.select("lei", F.explode("field_derivations").alias("y", "j"), "assumed_zeros")
    return held.select("lei", F.col("y").cast("int").alias("fiscal_year"), F.coalesce(
        F.array_join(F.try_element_at("assumed_zeros", F.col("y")), " "), F.lit("")).alias("zeros"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber
ORDER BY l_shipdate DESC, l_partkey DESC, l_extendedprice DESC) = 1""")
def last_write_per_key(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_shipdate")
    return store.last_write(rows, ["l_orderkey", "l_linenumber"],
                            [F.col("l_shipdate"), F.col("l_partkey"), F.col("l_extendedprice")]) \
        .drop("l_shipdate")


@query("""WITH new AS (SELECT o_orderkey AS k, 'new' AS origin, o_totalprice AS v FROM orders WHERE o_orderstatus = 'F'),
old AS (SELECT o_orderkey AS k, 'old' AS origin, o_totalprice / 2 AS v FROM orders WHERE o_orderpriority <> '1-URGENT')
SELECT * FROM new UNION ALL SELECT * FROM old WHERE k NOT IN (SELECT k FROM new)""")
def keyed_replace(spark, d):
    o = table(spark, d, "orders")
    new = o.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("k"), F.lit("new").alias("origin"),
                                                F.col("o_totalprice").alias("v"))
    old = o.where("o_orderpriority <> '1-URGENT'").select(F.col("o_orderkey").alias("k"), F.lit("old").alias("origin"),
                                                          (F.col("o_totalprice") / 2).alias("v"))
    return store.upsert(old, new, ["k"])


@query(f"""WITH {EXTRACT_SQL}, redone AS (SELECT lei, fiscal_year FROM headers WHERE fiscal_year = 1999)
SELECT 'fact' AS kind, fiscal_year, count(*) AS n FROM fact WHERE fiscal_year <> 1999 GROUP BY ALL
UNION ALL SELECT 'header', fiscal_year, count(*) FROM headers GROUP BY ALL""")
def failed_years_replace_facts(spark, d):
    headers, facts = _store(spark, d)
    failed = store.failed_headers(headers.where("fiscal_year = 1999").select(*KEYS), spec.EXTRACTOR_VERSION,
                                  F.lit("could not be read"), F.lit("2002-01-02").cast("timestamp"))
    h, f = store.put_company_years(headers, facts, failed, facts.where(F.lit(False)))
    count = lambda df, kind: df.groupBy("fiscal_year").agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(kind).alias("kind"), "fiscal_year", "n")
    return count(f, "fact").unionByName(count(h, "header"))


@query(f"""WITH {EXTRACT_SQL} SELECT 'company_year' AS "table", fiscal_year, count(*) AS n FROM headers GROUP BY ALL
UNION ALL SELECT 'fact', fiscal_year, count(*) FROM fact WHERE lei <> 'S1' OR fiscal_year <> 1996 GROUP BY ALL""")
def upserted_store(spark, d):
    """A written store in which one company-year is replaced by a failed one; only its bucket is written anew."""
    path = work_path(spark, "store")
    headers, facts = _store(spark, d)
    sinks.upsert_company_years(spark, path, headers, facts)
    failed = store.failed_headers(headers.where("lei = 'S1' AND fiscal_year = 1996").select(*KEYS), spec.EXTRACTOR_VERSION,
                                  F.lit("could not be read"), F.lit("2002-01-02").cast("timestamp"))
    sinks.upsert_company_years(spark, path, failed, facts.where(F.lit(False)))
    count = lambda name: sinks.read_table(spark, f"{path}/{name}").groupBy("fiscal_year").agg(F.count(F.lit(1)).alias("n")) \
        .select(F.lit(name).alias("table"), "fiscal_year", "n")
    return count("company_year").unionByName(count("fact"))


@query(f"""WITH {EXTRACT_SQL} SELECT 'company_year' AS "table", 'removed' AS state, count(*) AS n FROM headers
UNION ALL SELECT 'fact', 'removed', count(*) FROM fact
UNION ALL SELECT 'company_year', 'held', count(*) FROM headers WHERE fiscal_year = 1997
UNION ALL SELECT 'fact', 'held', count(*) FROM fact WHERE fiscal_year = 1997
UNION ALL SELECT 'listing', 'held', count(*) FROM supplier""")
def cleared_store(spark, d):
    """A written store whose extractions are dropped and one year put back; its listings stay."""
    path = work_path(spark, "store")
    headers, facts = _store(spark, d)
    sinks.upsert_company_years(spark, path, headers, facts)
    sinks.write_listings(table(spark, d, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("lei"), "s_name"),
                         f"{path}/listing", 8)
    removed = sinks.clear_extractions(spark, path)
    sinks.upsert_company_years(spark, path, headers.where("fiscal_year = 1997"), facts.where("fiscal_year = 1997"))
    out = spark.createDataFrame([(name, "removed", n) for name, n in removed.items()], "table string, state string, n long")
    for name in (*sinks.EXTRACTIONS, "listing"):
        out = out.unionByName(sinks.read_table(spark, f"{path}/{name}").agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(name).alias("table"), F.lit("held").alias("state"), "n"))
    return out


@query("""SELECT doc_id, 'field' AS problem FROM (SELECT doc_id, source FROM documents) WHERE source <> 'src0'
UNION ALL SELECT doc_id, 'status' FROM documents WHERE lang <> 'en'""")
def vocabulary_problems(spark, d):
    docs = table(spark, d, "documents")
    facts = docs.select(F.col("doc_id").alias("lei"), F.lit(2000).alias("fiscal_year"),
                        F.when(F.col("source") == "src0", "revenue").otherwise(F.col("source")).alias("field"),
                        F.lit("reported").alias("derivation"))
    headers = docs.select(F.col("doc_id").alias("lei"), F.lit(2000).alias("fiscal_year"), F.lit("esef").alias("source"),
                          F.when(F.col("lang") == "en", "complete").otherwise(F.col("lang")).alias("status"))
    return store.vocabulary_problems(headers, facts).select(F.col("lei").alias("doc_id"), "problem")


@query(f"""WITH {EXTRACT_SQL} SELECT h.lei, h.fiscal_year, h.status, f.field, round(f.value, 2) AS value FROM headers h
LEFT JOIN fact f ON (h.lei, h.fiscal_year) = (f.lei, f.fiscal_year) WHERE h.status = 'complete'""")
def company_year_lookup(spark, d):
    headers, facts = _store(spark, d)
    wanted = headers.where("status = 'complete'").select(*KEYS)
    return store.company_year_lookup(headers.select(*KEYS, "status"), facts, wanted).select(
        *KEYS, "status", "field", F.round("value", 2).alias("value"))


@query(f"""WITH {EXTRACT_SQL}, u AS (SELECT DISTINCT lei FROM headers), sp AS (SELECT lei, y::INT AS y
  FROM u, (SELECT unnest({YEARS}) AS y))
SELECT sp.lei, sp.y AS fiscal_year, CASE WHEN h.status IN ('complete', 'partial') AND sp.y < 2000 THEN 'cached'
WHEN h.status = 'complete' THEN 'todo' ELSE 'no_filing' END AS state FROM sp LEFT
  JOIN headers h ON (sp.lei, sp.y) = (h.lei, h.fiscal_year)""")
def extraction_plan(spark, d):
    headers, _ = _store(spark, d)
    stored = headers.where("fiscal_year < 2000")
    lookup = headers.where("status = 'complete'").select("lei", F.col("fiscal_year").alias("year"), F.lit("u").alias("json_url"))
    return screening.extraction_plan(headers.select("lei").distinct(), stored, lookup, YEARS).drop("json_url")


_NEEDED = ("revenue", "ebit", "depreciation_amortisation", "capex", "acquisitions_net")
_LATEST = ("interest_expense", "short_term_debt", "long_term_debt", "total_equity", "cash", "minority_interest",
           "preferred_stock", "short_term_investments", "equity_method_investments")
_RUNGS = ", ".join(f"('{t}', {a}::DOUBLE, {s}::DOUBLE)" for t, rungs in spec.LADDERS.items() for a, _, _, s in rungs)
_AMOUNT = "max(value) FILTER (field = '{}' AND fiscal_year = {}) / 1000000.0"
_SCREEN_SQL = f"""{_SERIES_SQL},
whole AS (SELECT lei FROM headers WHERE status = 'complete' AND fiscal_year IN {tuple(YEARS)}
  GROUP BY lei HAVING count(DISTINCT fiscal_year) = {len(YEARS)}),
quote AS (SELECT 'S' || s_suppkey AS lei, DATE '2001-08-01' - (s_suppkey % 12)::INT - 30 * o AS as_of,
  s_acctbal / 1e6 * (1 + o) AS price, 50000.0::DOUBLE * (1 + o) AS shares FROM supplier, (VALUES (0), (1)) x(o)
  QUALIFY row_number() OVER (PARTITION BY s_suppkey ORDER BY as_of DESC) = 1),
line AS (SELECT 'S' || s_suppkey AS lei, CASE WHEN s_suppkey % 7 > 0 THEN 'T' || s_suppkey ELSE '' END AS ticker,
  CASE s_suppkey % 3 WHEN 0 THEN 'Retail' WHEN 1 THEN 'Machinery' END AS industry, s_acctbal FROM supplier),
ready AS (SELECT lei, price, shares FROM whole JOIN quote USING (lei) JOIN line USING (lei)
  WHERE ticker <> '' AND industry IS NOT NULL AND price IS NOT NULL AND NOT s_acctbal < 500),
ser AS (SELECT lei, count(value) AS n_cells, {", ".join(
    f"{_AMOUNT.format(k, y)} AS {k}{i}" for k in _NEEDED for i, y in enumerate(YEARS))}, {", ".join(
    f"{_AMOUNT.format(k, YEARS[-1])} AS {k}4" for k in _LATEST)}
  FROM fact WHERE fiscal_year IN {tuple(YEARS)} GROUP BY lei),
refused AS (SELECT lei, CASE WHEN held.n < 5 THEN 'missing years' ELSE 'unresolved required fields' END AS reason
  FROM held LEFT JOIN full_ USING (lei) WHERE held.n < 5 OR coalesce(full_.n, 0) < {5 * len(spec.REQUIRED_KEYS)}),
v1 AS (SELECT *, price * shares / 1e6 AS cap, short_term_debt4 + long_term_debt4 AS debt,
  CASE WHEN revenue0 > 0 AND revenue4 > 0 THEN pow(revenue4 / revenue0, 0.25) - 1 END
    / (SELECT avg(p_size) / 20 FROM part) AS by_sales,
  ({" + ".join(f"(capex{i} + acquisitions_net{i} - depreciation_amortisation{i})" for i in range(5))})
    / nullif(({" + ".join(f"ebit{i}" for i in range(5))}) * 0.75, 0) AS by_cash,
  CASE WHEN {" AND ".join(f"ebit{i} / nullif(revenue{i}, 0) IS NOT NULL" for i in range(5))}
    THEN list_sort([{", ".join(f"ebit{i} / nullif(revenue{i}, 0)" for i in range(5))}])[3] END * revenue4 * 0.75 AS nopat
  FROM ready JOIN ser USING (lei) WHERE lei NOT IN (SELECT lei FROM refused)),
v2 AS (SELECT *, nopat / nullif(debt + total_equity4 - cash4, 0) AS roic,
  CASE WHEN interest_expense4 = 0 THEN 'Infinity'::DOUBLE ELSE ebit4 / nullif(interest_expense4, 0) END AS cover,
  CASE WHEN cap >= {spec.CREDIT_CUTOFF} THEN 'LARGE' ELSE 'SMALL' END AS tbl, debt / nullif(debt + cap, 0) AS wd,
  0.9 * (1 + 0.75 * (debt / nullif(cap, 0))) AS beta, interest_expense4 / nullif(debt, 0) AS actual,
  CASE WHEN by_cash IS NOT NULL AND by_sales IS NOT NULL THEN greatest(0, least(0.9, by_cash, by_sales)) END AS used,
  CASE WHEN by_cash IS NOT NULL AND by_sales IS NOT NULL
    THEN abs(by_cash - by_sales) / nullif(greatest(abs(by_cash), abs(by_sales)), 0) END AS apart,
  CASE WHEN by_cash * by_sales < 0 THEN 'Infinity'::DOUBLE
    WHEN least(abs(by_cash), abs(by_sales)) < 1e-9
      THEN CASE WHEN greatest(abs(by_cash), abs(by_sales)) > 1e-9 THEN 'Infinity'::DOUBLE ELSE 1 END
    ELSE greatest(abs(by_cash), abs(by_sales)) / least(abs(by_cash), abs(by_sales)) END AS ratio FROM v1),
v3 AS (SELECT v2.*, (SELECT arg_max(s, a) FROM (VALUES {_RUNGS}) l(t, a, s) WHERE t = tbl AND a <= cover) AS spread FROM v2),
v4 AS (SELECT *, (1 - wd) * (0.025 + beta * 0.045 + 0.01)
  + wd * least({spec.COST_OF_DEBT_CAP}, greatest(0.025 + spread, actual)) * 0.75 AS wacc, used * roic AS g FROM v3),
v5 AS (SELECT *, least(0.025, wacc - 0.005) AS gt FROM v4),
years_ AS (SELECT lei, n, nopat, wacc, g + (gt - g) * greatest(0, (n - 5) / 5) AS gn,
  roic + (wacc - roic) * greatest(0, (n - 5) / 5) AS rn FROM v5, range(1, 11) x(n) WHERE roic > 0 AND wacc > 0.005),
profit_ AS (SELECT *, nopat * exp(sum(ln(1 + gn)) OVER (PARTITION BY lei ORDER BY n)) AS p FROM years_),
pv_ AS (SELECT lei, sum(p * (1 - gn / rn) / pow(1 + wacc, n)) AS pv, arg_max(p, n) AS p10 FROM profit_ GROUP BY lei),
v6 AS (SELECT *, (pv + p10 * (1 + gt) * (1 - gt / wacc) / ((wacc - gt) * pow(1 + wacc, 10)) - debt - minority_interest4
  - preferred_stock4 + cash4 + short_term_investments4 + equity_method_investments4) / (shares / 1e6) AS vps
  FROM v5 LEFT JOIN pv_ USING (lei)),
v7 AS (SELECT *, (vps - price) / nullif(price, 0) AS up, coalesce(apart > 0.5 AND NOT coalesce(ratio < 3, false), false) AS blocked,
  n_cells <> 100 OR price <= 0
    OR NOT coalesce(cap / nullif(revenue4, 0) BETWEEN {spec.CAP_REVENUE_MIN} AND {spec.CAP_REVENUE_MAX}, false) AS bad FROM v6),
v8 AS (SELECT *, CASE WHEN bad OR up IS NULL THEN '{spec.VOID}' WHEN up > 0.25 THEN '{spec.UNDERVALUED}'
  WHEN up < -0.25 THEN '{spec.OVERVALUED}' ELSE '{spec.FAIRLY_VALUED}' END AS verdict FROM v7)"""


@query(f"""{_SCREEN_SQL} SELECT lei, verdict, verdict = '{spec.UNDERVALUED}' AND NOT blocked AS research_flag,
  CASE WHEN blocked THEN 'D104' ELSE '' END AS note, round(wacc, 6) AS wacc, round(vps, 4) AS value_per_share,
  round(up, 4) AS upside FROM v8
UNION ALL SELECT lei, 'skipped', false, reason, NULL, NULL, NULL FROM ready JOIN refused USING (lei)""")
def screening_run(spark, d):
    """Extraction to research flag in one flow, over every filing of every company."""
    headers, facts = _store(spark, d)
    k = F.col("s_suppkey")
    s = table(spark, d, "supplier").withColumn("lei", F.concat(F.lit("S"), k))
    day = F.lit("2001-08-01").cast("date")
    older = s.withColumn("o", F.explode(F.array(F.lit(0), F.lit(1))))  # everything once more, older or not primary
    line = F.when(k % 7 > 0, F.concat(F.lit("T"), k)).otherwise("")
    listings = older.select("lei", F.concat(F.lit("I"), k, F.lit("-"), "o").alias("isin"),
                            F.when(F.col("o") == 0, line).otherwise("OTC").alias("ticker"),
                            F.lit("IM").alias("exchange"), (F.col("o") == 0).alias("is_primary"))
    as_of = F.date_sub(day, (k % 12 + 30 * F.col("o")).cast("int")).alias("as_of")
    prices = older.select("lei", as_of, (F.col("s_acctbal") / 1e6 * (1 + F.col("o"))).alias("price"))
    counts = older.select("lei", as_of, (50000.0 * (1 + F.col("o"))).alias("shares"))
    mapping = s.select("lei", pick(("Retail", "Machinery", "Unknown"), k % 3).alias("industry"))
    p = table(spark, d, "part").agg(F.avg("p_size").alias("size"))
    industries = p.select(F.explode(F.array(F.lit("Retail"), F.lit("Machinery"))).alias("name"), F.lit(0.9).alias("unlevered_beta"),
                          (F.col("size") / 20).alias("sales_to_capital"), F.lit(0.1).alias("ebit_margin"), F.lit(0.12).alias("roic"))
    countries = headers.select("country").distinct().select("country", F.lit(0.01).alias("crp"), F.lit(0.25).alias("tax_rate"))
    excluded = s.where(F.col("s_acctbal") < 500).select("lei", F.lit("by hand").alias("reason"))
    market = {"risk_free_rate": F.lit(0.025), "mature_market_erp": F.lit(0.045), "long_run_nominal_growth": F.lit(0.025)}
    valued, skipped = screening.screen_run(headers, facts, listings, prices, counts, mapping, industries, countries, excluded,
                                           market, YEARS, day)
    figures = ("wacc", "value_per_share", "upside")
    flags = valued.select("lei", "verdict", "research_flag", F.array_join("blocking_checks", " ").alias("note"),
                          F.round("wacc", 6).alias("wacc"), *[F.round(c, 4).alias(c) for c in figures[1:]])
    none = [F.lit(None).cast("double").alias(c) for c in figures]
    return flags.unionByName(skipped.select("lei", F.lit("skipped").alias("verdict"), F.lit(False).alias("research_flag"),
                                            F.col("reason").alias("note"), *none))
