"""Valuation, policy, result, portfolio and health queries on the given tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from accountloom import spec
from accountloom.bindings.base import YEARS, pick, sql_list, table
from accountloom.bindings.company_queries import _LADDER_SQL, _QUOTE_SQL, _ladder_pages, prices
from accountloom.functions import numbers, ordered, text
from accountloom.operators import health, parameters, policy, portfolio, results, store, valuation
from accountloom.session import stored, work_path
from accountloom.sources import records

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn
    return register


# -- results: one company per order, checks out of its line items ------------------------

_CELLS = (("D103", "WARNING - actual rate above synthetic"), ("D104", "WARNING - estimates\n diverge"),
          ("D111", "FAIL - statement cells are missing"), ("D121", "NOTE - near the size cut-off"),
          ("D122", "WARNING - ladder older than fourteen months"))


def _results(spark, d):
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    flags = li.groupBy("l_orderkey").agg(
        F.bool_or(F.col("l_quantity") > 45).alias("f0"), F.bool_or(F.col("l_linenumber") == 3).alias("f1"),
        F.bool_or(F.col("l_quantity") == 7).alias("f2"), F.bool_or(F.col("l_returnflag") == "R").alias("f3"),
        F.bool_or(F.col("l_quantity") < 3).alias("f4"))
    k, cust = F.col("o_orderkey"), F.col("o_custkey")
    checks = F.array(*[
        F.struct(F.lit(cell).alias("cell"),
                 F.when(F.col(f"f{i}"), F.lit(msg)).when(~F.col(f"f{i}"), F.lit("OK")).alias("message"))
        for i, (cell, msg) in enumerate(_CELLS)])
    price = F.col("o_totalprice") / 1000
    base = o.join(flags, k == F.col("l_orderkey"), "left").select(
        k.alias("ord"), F.concat(F.lit("O"), k).alias("lei"), F.concat(F.lit("T"), cust).alias("ticker"),
        F.concat(F.lit("N"), k).alias("name"), F.lit("IT").alias("country"), F.lit("Retail").alias("industry"),
        F.lit("IM").alias("exchange"), price.alias("current_price"), price.alias("price"),
        F.when(k % 53 > 0, price * (F.lit(45) + F.lit(10) * (k % 15)) / 100).alias("value_per_share"),
        F.when(k % 37 > 0, F.col("o_totalprice") / 100).alias("market_cap_m"), checks.alias("texts"),
        ((cust % 40 - 10) / 100).alias("reinvest_cashflow"), ((k % 30 - 5) / 100).alias("reinvest_sales_to_capital"),
        (F.lit(0.05) + (k % 70) / 1000).alias("wacc"), F.when(k % 3 > 0, F.lit("AA")).alias("implied_rating"),
        F.when(k % 4 > 0, (k % 50) / 100).alias("terminal_share_of_ev"), F.when(k % 5 > 0, (k % 40) / 4).alias("margin_vs_industry"),
        ((k % 16) / 2).alias("roic_vs_industry"), F.lit("LARGE").alias("credit_table"), F.to_date("o_orderdate").alias("price_as_of"))
    checked = valuation.verdicts(base.withColumn("checks", valuation.with_severity(F.col("texts"))).drop("texts"))
    return policy.apply_policy(checked)


_RESULT_SQL = """flags AS (SELECT l_orderkey, bool_or(l_quantity > 45) AS f0, bool_or(l_linenumber = 3) AS f1, bool_or(l_quantity = 7) AS f2,
  bool_or(l_returnflag = 'R') AS f3, bool_or(l_quantity < 3) AS f4 FROM lineitem GROUP BY 1),
b AS (SELECT o_orderkey AS ord, 'O' || o_orderkey AS lei, 'T' || o_custkey AS ticker, o_totalprice / 1000 AS price, f0, f1, f2, f3, f4,
  CASE WHEN o_orderkey % 53 > 0 THEN o_totalprice / 1000 * (45 + 10 * (o_orderkey % 15)) / 100 END AS value,
  CASE WHEN o_orderkey % 37 > 0 THEN o_totalprice / 100 END AS cap, (o_custkey % 40 - 10) / 100 AS ra, (o_orderkey % 30 - 5) / 100 AS rb,
  0.05 + (o_orderkey % 70) / 1000 AS wacc, CASE WHEN o_orderkey % 3 > 0 THEN 'AA' END AS rating,
  CASE WHEN o_orderkey % 4 > 0 THEN (o_orderkey % 50) / 100 END AS terminal, CASE WHEN o_orderkey % 5 > 0
  THEN (o_orderkey % 40) / 4 END AS margin,
  (o_orderkey % 16) / 2 AS roic, o_orderdate::DATE AS dt FROM orders LEFT JOIN flags ON o_orderkey = l_orderkey),
v AS (SELECT *, (value - price) / price AS upside, coalesce(f2, false) AS void,
  CASE WHEN ra * rb < 0 THEN 'Infinity'::DOUBLE WHEN least(abs(ra), abs(rb)) < 1e-9 THEN CASE
  WHEN greatest(abs(ra), abs(rb)) > 1e-9 THEN 'Infinity'::DOUBLE ELSE 1 END
    ELSE greatest(abs(ra), abs(rb)) / least(abs(ra), abs(rb)) END AS ratio FROM b),
w AS (SELECT *, CASE WHEN void OR upside IS NULL THEN 'VOID - failed validation' WHEN upside > 0.25
  THEN 'UNDERVALUED - investigate'
    WHEN upside < -0.25 THEN 'OVERVALUED - screen out' ELSE 'FAIRLY VALUED - no action' END AS verdict,
  coalesce(f1, false) AND NOT ratio < 3 AS s104, coalesce(f4, false) AS s122 FROM v),
r AS (SELECT *, verdict = 'UNDERVALUED - investigate' AS qualifies, qualifies AND NOT s104 AND NOT s122 AS flag,
  qualifies AND (s104 OR s122) AS held, concat_ws(',', CASE WHEN s104 THEN 'D104' END, CASE WHEN s122
  THEN 'D122' END) AS blocking,
  CASE WHEN cap < 300 THEN 'micro   < 300m' WHEN cap < 2000 THEN 'small   300m - 2bn' WHEN cap < 4300
  THEN 'mid     2bn - 4.3bn' WHEN cap >= 4300 THEN 'large   > 4.3bn' END AS bucket,
  CASE WHEN verdict LIKE 'UNDER%' AND (s104 OR s122) THEN 'SUPPRESSED'
  ELSE split_part(verdict, ' - ', 1) END AS short FROM w),
fired AS (SELECT ord, lei, bucket, qualifies, c.cell, c.sev, c.msg, c.pos FROM r, LATERAL (VALUES
  ('D103', CASE WHEN f0 THEN 'WARNING' WHEN NOT f0 THEN 'OK' ELSE 'UNKNOWN' END, CASE WHEN f0
  THEN 'WARNING - actual rate above synthetic' WHEN NOT f0 THEN 'OK' ELSE 'empty -- not evaluated' END, 0),
  ('D104', CASE WHEN f1 THEN 'WARNING' WHEN NOT f1 THEN 'OK' ELSE 'UNKNOWN' END, CASE WHEN f1
  THEN 'WARNING - estimates' || chr(10) || ' diverge' WHEN NOT f1 THEN 'OK' ELSE 'empty -- not evaluated' END, 1),
  ('D111', CASE WHEN f2 THEN 'FAIL' WHEN NOT f2 THEN 'OK' ELSE 'UNKNOWN' END, CASE WHEN f2
  THEN 'FAIL - statement cells are missing' WHEN NOT f2 THEN 'OK' ELSE 'empty -- not evaluated' END, 2),
  ('D121', CASE WHEN f3 THEN 'NOTE' WHEN NOT f3 THEN 'OK' ELSE 'UNKNOWN' END, CASE WHEN f3
  THEN 'NOTE - near the size cut-off' WHEN NOT f3 THEN 'OK' ELSE 'empty -- not evaluated' END, 3),
  ('D122', CASE WHEN f4 THEN 'WARNING' WHEN NOT f4 THEN 'OK' ELSE 'UNKNOWN' END, CASE WHEN f4
  THEN 'WARNING - ladder older than fourteen months' WHEN NOT f4 THEN 'OK'
  ELSE 'empty -- not evaluated' END, 4)) c(cell, sev, msg, pos))"""


@query(f"""WITH {_RESULT_SQL} SELECT lei, verdict, qualifies AS qualifies_on_verdict, flag AS research_flag, CASE WHEN qualifies
  THEN blocking ELSE '' END AS suppressed_by,
blocking AS blocking_checks, round(ratio, 6) AS reinvestment_ratio, round(upside, 6) AS upside FROM r""")
def research_policy(spark, d):
    return _results(spark, d).select(
        "lei", "verdict", "qualifies_on_verdict", "research_flag", F.array_join("suppressed_by", ",").alias("suppressed_by"),
        F.array_join("blocking_checks", ",").alias("blocking_checks"), F.round("reinvestment_ratio", 6).alias("reinvestment_ratio"),
        F.round("upside", 6).alias("upside"))


@query(f"WITH {_RESULT_SQL} SELECT verdict, count(*) AS n FROM r GROUP BY 1")
def verdict_counts(spark, d):
    return results.verdict_counts(_results(spark, d))


@query(f"""WITH {_RESULT_SQL} SELECT cell, count(*) AS n FROM (SELECT 'D104' AS cell FROM r WHERE qualifies AND s104
UNION ALL SELECT 'D122' FROM r WHERE qualifies AND s122) GROUP BY 1""")
def suppression_counts(spark, d):
    return results.suppression_counts(_results(spark, d))


@query(f"""WITH {_RESULT_SQL} SELECT count(*) FILTER (qualifies) AS undervalued, count(*) FILTER (flag) AS queue,
round((count(*) FILTER (qualifies) - count(*) FILTER (flag)) / count(*) FILTER (qualifies), 6) AS suppression_rate
  FROM r""")
def suppression_rate(spark, d):
    return results.suppression_rate(_results(spark, d)).withColumn("suppression_rate", F.round("suppression_rate", 6))


@query(f"""WITH {_RESULT_SQL}, c AS (SELECT cell, count(*) AS n FROM (SELECT 'D104' AS cell FROM r WHERE qualifies AND s104
UNION ALL SELECT 'D122' FROM r WHERE qualifies AND s122) GROUP BY 1)
SELECT cell, n, round(n / (SELECT count(*) FROM r WHERE qualifies), 6) AS share, CASE cell WHEN 'D122'
  THEN 'process'
ELSE 'graded' END AS remark FROM c""")
def suppression_report(spark, d):
    return results.suppression_report(_results(spark, d)).withColumn("share", F.round("share", 6))


@query(f"WITH {_RESULT_SQL} SELECT cell, count(*) AS n FROM fired WHERE sev = 'FAIL' GROUP BY 1")
def fail_reasons(spark, d):
    return results.fail_reasons(_results(spark, d))


@query(f"""WITH {_RESULT_SQL} SELECT cell, coalesce(arg_max(msg, ord) FILTER (sev IN ('FAIL', 'WARNING', 'NOTE')), arg_min(msg, ord)) AS message FROM fired GROUP BY 1""")
def check_messages(spark, d):
    return results.check_messages(_results(spark, d))


@query(f"""WITH {_RESULT_SQL}, k AS (SELECT coalesce(bucket, 'micro   < 300m') AS b0, CASE WHEN cap IS NULL
  THEN 'micro   < 300m' ELSE bucket END AS b, short FROM r)
SELECT s.b AS size_bucket, count(short) AS n, count(*) FILTER (short = 'VOID') AS void,
  count(*) FILTER (short IN ('UNDERVALUED', 'SUPPRESSED')) AS under,
count(*) FILTER (short = 'FAIRLY VALUED') AS fair, count(*) FILTER (short = 'OVERVALUED') AS over
FROM (SELECT unnest({sql_list(b[0] for b in spec.SIZE_BUCKETS)}) AS b) s LEFT JOIN (SELECT CASE WHEN cap IS NULL
  THEN 'large   > 4.3bn' ELSE bucket END AS b, short FROM r) r USING (b) GROUP BY 1""")
def size_by_verdict(spark, d):
    return results.size_by_verdict(_results(spark, d))


@query(f"""WITH {_RESULT_SQL} SELECT bucket AS size_bucket, count(*) AS n, count(*) FILTER (verdict LIKE 'VOID%') AS void,
  count(*) FILTER (qualifies) AS undervalued,
count(*) FILTER (held) AS suppressed, round(coalesce(count(*) FILTER (held) / nullif(count(*) FILTER (qualifies), 0), 0), 6) AS suppressed_rate,
round(coalesce(median(abs(upside)), 0), 6) AS median_abs_upside, count(*) < 5 AS thin FROM r WHERE bucket IS NOT NULL
  GROUP BY 1""")
def outcomes_by_size(spark, d):
    return results.outcomes_by_size(_results(spark, d)).withColumns({
        "suppressed_rate": F.round("suppressed_rate", 6), "median_abs_upside": F.round("median_abs_upside", 6)})


@query(f"""WITH {_RESULT_SQL}, t AS (SELECT bucket, count(*) AS total FROM r WHERE bucket IS NOT NULL GROUP BY 1)
SELECT bucket AS size_bucket, cell, count(*) AS n, round(count(*) / any_value(total), 6) AS rate FROM fired
  JOIN t USING (bucket)
WHERE sev IN ('FAIL', 'WARNING') GROUP BY ALL""")
def check_rates_by_size(spark, d):
    return results.check_rates_by_size(_results(spark, d)).withColumn("rate", F.round("rate", 6))


_FOUR = f"""s AS (SELECT unnest({sql_list(b[0] for b in spec.SIZE_BUCKETS)}) AS b),
sized AS (SELECT CASE WHEN cap IS NULL THEN 'large   > 4.3bn' ELSE bucket END AS b, short FROM r)"""


@query(f"""WITH {_RESULT_SQL}, {_FOUR} SELECT CASE WHEN grouping(b) = 1 THEN 'all' ELSE b END AS size_bucket, count(short) AS n,
  count(*) FILTER (short = 'VOID') AS void, count(*) FILTER (short IN ('UNDERVALUED', 'SUPPRESSED')) AS under,
  count(*) FILTER (short = 'FAIRLY VALUED') AS fair, count(*) FILTER (short = 'OVERVALUED') AS over
FROM s LEFT JOIN sized USING (b) GROUP BY GROUPING SETS ((b), ())""")
def size_by_verdict_with_total(spark, d):
    return results.size_by_verdict_with_total(_results(spark, d))


@query(f"""WITH {_RESULT_SQL}, t AS (SELECT bucket, count(*) AS total FROM r WHERE bucket IS NOT NULL GROUP BY 1),
x AS (SELECT bucket, cell FROM fired WHERE sev IN ('FAIL', 'WARNING') AND bucket IS NOT NULL)
SELECT bucket AS size_bucket, cell, count(*) AS n, round(count(*) / any_value(total), 6) AS rate FROM x JOIN t USING (bucket) GROUP BY ALL
UNION ALL SELECT 'all', cell, count(*), round(count(*) / (SELECT sum(total) FROM t), 6) FROM x GROUP BY cell""")
def check_rates_with_total(spark, d):
    return results.check_rates_with_total(_results(spark, d)).withColumn("rate", F.round("rate", 6))


@query(f"WITH {_RESULT_SQL} SELECT count(*) AS valued, count(*) FILTER (NOT void) AS passed, count(*) FILTER (qualifies) AS undervalued, count(*) FILTER (flag) AS queue FROM r")
def pick_funnel(spark, d):
    return results.pick_funnel(_results(spark, d))


@query(f"WITH {_RESULT_SQL} SELECT lei, round(upside, 6) AS upside FROM r WHERE flag ORDER BY 2 DESC, 1")
def research_queue(spark, d):
    return results.research_queue(_results(spark, d)).select("lei", F.round("upside", 6).alias("upside"))


@query(f"""WITH {_RESULT_SQL} SELECT lei, short AS short_verdict, CASE WHEN void THEN 'statement cells are missing' WHEN flag
  THEN 'RESEARCH'
WHEN s104 AND s122 THEN 'estimates diverge  (+1)' WHEN s104 THEN 'estimates diverge'
  ELSE 'ladder older than fourteen mont' || '…' END AS note
FROM r WHERE void OR flag OR held""")
def findings(spark, d):
    return results.findings(_results(spark, d)).select("lei", "short_verdict", "note")


@query(f"""WITH {_RESULT_SQL} SELECT lei, concat_ws(', ', 'WACC ' || printf('%.1f', wacc * 100) || '%' || CASE
  WHEN rating IS NULL THEN '' ELSE ' (AA)' END,
CASE WHEN terminal IS NOT NULL THEN printf('%.0f', terminal * 100) || '% of value is terminal' END, CASE
  WHEN margin IS NOT NULL THEN 'margin ' || printf('%.2f', margin) || 'x industry' END,
'ROIC ' || printf('%.2f', roic) || 'x industry') AS why FROM r WHERE NOT void AND (flag OR held)""")
def reasons(spark, d):
    return results.reasons(_results(spark, d)).select("lei", "why")


@query(f"""WITH {_RESULT_SQL} SELECT lei, concat_ws(', ', 'discount rate ' || printf('%.1f', wacc * 100) || '%' || CASE
  WHEN rating IS NULL THEN '' ELSE ' (AA)' END,
CASE WHEN terminal IS NOT NULL THEN printf('%.0f', terminal * 100) || '% terminal value' END, CASE
  WHEN margin IS NOT NULL THEN 'margin ratio ' || printf('%.2f', margin) END) AS why FROM r""")
def published_reasons(spark, d):
    return _results(spark, d).select("lei", text.why_public(
        F.col("wacc"), F.col("implied_rating"), F.col("terminal_share_of_ev"), F.col("margin_vs_industry")).alias("why"))


@query(f"""WITH {_RESULT_SQL} SELECT lei, 'held' AS list, concat_ws(' · ', CASE WHEN s104 THEN 'estimates diverge' END, CASE
  WHEN s122 THEN 'ladder older than fourteen months' END) AS reason
FROM r WHERE held UNION ALL SELECT lei, 'void', 'statement cells are missing' FROM r WHERE void""")
def held_and_void_reasons(spark, d):
    return results.held_and_void_reasons(_results(spark, d)).drop("ticker")


@query(f"""WITH {_RESULT_SQL} SELECT 'N' || ord AS name, 'IM' AS exchange, price AS current_price, value AS value_per_share,
  round(upside, 6) AS upside, value / 1.25 AS trigger_price, verdict, CASE WHEN flag THEN 'RESEARCH' ELSE '' END AS flag, ticker,
  'IT' AS country, 'Retail' AS industry, CASE WHEN qualifies THEN replace(blocking, ',', ', ') ELSE '' END AS held_back_by,
  round(wacc, 6) AS wacc, rating AS implied_rating, 'LARGE' AS credit_table, dt AS price_as_of,
  (coalesce(f0::INT, 0) + coalesce(f1::INT, 0) + coalesce(f4::INT, 0))::INT AS warnings,
coalesce(f3::INT, 0)::INT AS notes, coalesce(f2::INT, 0)::INT AS fails FROM r""")
def results_sheet(spark, d):
    return results.results_sheet(_results(spark, d)).withColumns(
        {c: F.round(c, 6) for c in ("upside", "wacc")})


def _published(df):
    """The public view's whole list of columns beside its rows, so that a leaked one shows."""
    public = results.public_view(df)
    return public.withColumn("published", F.lit(", ".join(sorted(public.columns))))


@query(f"""WITH {_RESULT_SQL} SELECT lei, verdict, round(upside, 6) AS upside, 'blocking_checks, country, credit_table, exchange, finding, implied_rating, industry, lei, name, price_as_of, qualifies_on_verdict, research_flag, short_verdict, suppressed_by, ticker, upside, verdict, void, wacc' AS published FROM r WHERE flag""")
def published_results(spark, d):
    r = results.with_labels(_results(spark, d)).where("research_flag")
    return _published(r).select("lei", "verdict", F.round("upside", 6).alias("upside"), "published")


@query(f"""WITH {_RESULT_SQL} SELECT lei, ticker, value / 1.25 AS trigger_price, value / 1.2 AS watch_price, verdict, flag AS research_flag, void
FROM r WHERE value IS NOT NULL""")
def run_triggers(spark, d):
    return results.triggers(_results(spark, d), F.lit("2024-01-31").cast("date")).select(
        "lei", "ticker", "trigger_price", "watch_price", "verdict", "research_flag", "void")


@query(f"""WITH {_RESULT_SQL} SELECT count(*) FILTER (value IS NOT NULL) AS valued,
  count(*) FILTER (value IS NULL) AS could_not_be_valued, count(*) FILTER (qualifies) AS undervalued,
count(*) FILTER (flag) AS queue, round_even((count(*) FILTER (qualifies) - count(*) FILTER (flag)) /
  count(*) FILTER (qualifies), 4) AS suppression_rate FROM r""")
def run_summary(spark, d):
    r = _results(spark, d)
    return results.run_summary(r.where(F.col("value_per_share").isNotNull()), r.where(F.col("value_per_share").isNull()))


@query(f"""WITH {_RESULT_SQL} SELECT lei, verdict, flag, blocking AS held, 5::INT AS n_checks FROM r""")
def sidecar_records(spark, d):
    """The record of every valuation, written as text and read back, beside what holds the company back."""
    cars = results.sidecars(_results(spark, d), F.lit("2024-01-31"), "blocking_checks")
    record = F.struct(*[c for c in cars.columns if c != "blocking_checks"])
    doc = ordered.evaluate_once(cars, j=F.to_json(record)).select("j", "blocking_checks")
    back = ordered.evaluate_once(doc, r=F.from_json("j", records.SIDECAR.replace(", _corrupt_record STRING", "")))
    return back.select("r.company.lei", "r.results.verdict", F.col("r.decision.research_flag").alias("flag"),
                       F.array_join("blocking_checks", ",").alias("held"), F.size("r.checks").alias("n_checks"))


@query("SELECT o_orderkey, round(CASE WHEN o_totalprice > 0 THEN o_totalprice / 1.25 END, 6) AS low, round(o_totalprice / 0.75, 6) AS high FROM orders")
def fair_value_band(spark, d):
    o = table(spark, d, "orders")
    p = F.col("o_totalprice")
    return o.select("o_orderkey", F.round(numbers.fair_band_low(p, p), 6).alias("low"), F.round(numbers.fair_band_high(p, p), 6).alias("high"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(abs(l_discount - l_tax) / nullif(greatest(l_discount, l_tax), 0), 6) AS divergence FROM lineitem")
def estimate_divergence(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey",
                                              F.round(numbers.divergence(F.col("l_discount"), F.col("l_tax")), 6).alias("divergence"))


# -- valuation: five years of orders per customer --------------------------------------

_YEAR_SQL = f"""y AS (SELECT o_custkey, {", ".join(f"sum(o_totalprice::DECIMAL(18,2)) FILTER (year(o_orderdate) = {y})::DOUBLE AS y{i}" for i, y in enumerate(YEARS))} FROM orders GROUP BY 1)"""


def _series(spark, d):
    o = table(spark, d, "orders")
    amount = F.col("o_totalprice").cast("decimal(18,2)")
    return o.groupBy("o_custkey").agg(F.array(*[
        F.sum(F.when(F.year("o_orderdate") == y, amount)).cast("double") for y in YEARS]).alias("series"))


@query(f"""WITH {_YEAR_SQL} SELECT o_custkey, CASE WHEN y0 + y1 + y2 + y3 + y4 IS NOT NULL
  THEN list_median([y0, y1, y2, y3, y4]) END AS median,
round(CASE WHEN y0 > 0 AND y4 > 0 THEN pow(y4 / y0, 0.25) - 1 END, 6) AS cagr FROM y""".replace("list_median", "list_sort").replace("y4]) END", "y4])[3] END"))
def five_year_medians(spark, d):
    s = F.col("series")
    return _series(spark, d).select("o_custkey", valuation.five_point_median(s).alias("median"), F.round(valuation.revenue_cagr(s), 6).alias("cagr"))


def _valuation_inputs(spark, d):
    """Statement lines as fixed shares of yearly order totals; one company per customer."""
    full = _series(spark, d).where(~F.exists("series", lambda v: v.isNull()))
    k = F.col("o_custkey")
    weight = {"revenue": 1.0, "ebit": 0.15, "depreciation_amortisation": 0.04, "interest_expense": 0.01, "pretax_income": 0.14,
              "tax_expense": 0.03, "net_income": 0.1, "cash": 0.1, "short_term_investments": 0.01, "total_current_assets": 0.4,
              "total_current_liabilities": 0.3, "short_term_debt": 0.05, "long_term_debt": 0.2, "preferred_stock": 0.0,
              "minority_interest": 0.01, "total_equity": 0.5, "equity_method_investments": 0.02, "total_assets": 1.1,
              "capex": 0.07, "acquisitions_net": 0.01}
    share = lambda w: F.transform("series", lambda v: v * F.lit(w))
    lines = {key: share(w) for key, w in weight.items()}
    lines["interest_expense"] = F.transform("series", lambda v: F.when(k % 9 == 0, 0.0).otherwise(v * 0.01))
    par = {"price": 0.5 + (k % 200) / 20, "shares": F.lit(1e6) * (1 + k % 7), "risk_free_rate": F.lit(0.025),
           "mature_market_erp": F.lit(0.045), "long_run_nominal_growth": F.lit(0.025), "crp": (k % 4) / 200,
           "tax_rate": F.lit(0.25), "unlevered_beta": 0.6 + (k % 8) / 10, "sales_to_capital": 1 + (k % 5) / 4,
           "ebit_margin": F.lit(0.12), "roic": F.lit(0.1)}
    return full.select(F.concat(F.lit("C"), k).alias("lei"), *[c.alias(n) for n, c in lines.items()],
                       *[c.cast("double").alias(n) for n, c in par.items()]) \
        .withColumns({key: F.transform(key, lambda v: v / 100000) for key in weight})


_LADDER_VALUES = ", ".join(f"('{t}', {a}::DOUBLE, '{b}', {s}::DOUBLE)" for t, rungs in spec.LADDERS.items() for a, b, _, s in rungs)
_VALUE_SQL = f"""{_YEAR_SQL},
i AS (SELECT 'C' || o_custkey AS lei, o_custkey AS k, y0 / 1e5 AS r0, y4 / 1e5 AS r4, (y0 + y1 + y2 + y3 + y4) / 1e5 AS rs,
  (0.5 + (o_custkey % 200) / 20)::DOUBLE AS price, 1e6 * (1 + o_custkey % 7) AS shares, ((o_custkey % 4) / 200)::DOUBLE AS crp,
  (0.6 + (o_custkey % 8) / 10)::DOUBLE AS bu, (1 + (o_custkey % 5) / 4)::DOUBLE AS s2c
  FROM y WHERE y0 + y1 + y2 + y3 + y4 IS NOT NULL),
a AS (SELECT *, price * shares / 1e6 AS cap, 0.25 * r4 AS debt, CASE WHEN k % 9 = 0 THEN 0
  ELSE 0.01 * r4 END AS interest, pow(r4 / r0, 0.25) - 1 AS cagr,
  0.15 * r4 * 0.75 AS nopat, 0.65 * r4 AS ic, 0.04 * rs / (0.15 * rs * 0.75) AS d25 FROM i),
b AS (SELECT *, cagr / s2c AS d28, nopat / ic AS roic, CASE WHEN interest = 0 THEN 'Infinity'::DOUBLE
  ELSE 0.15 * r4 / interest END AS cover,
  CASE WHEN cap >= 4300 THEN 'LARGE' ELSE 'SMALL' END AS tbl, debt / (debt + cap) AS wd, bu * (1 + 0.75 * debt / cap) AS beta, interest / debt AS actual FROM a),
c AS (SELECT b.*, l.rating, l.spread, greatest(0, least(0.9, d25, d28)) AS used, 0.025 + l.spread AS synth FROM b
  JOIN (VALUES {_LADDER_VALUES}) l(t, cov, rating, spread) ON t = tbl AND cov <= cover
  QUALIFY row_number() OVER (PARTITION BY lei ORDER BY cov DESC) = 1),
e AS (SELECT *, least(0.25, greatest(synth, actual)) AS kd, (1 - wd) * (0.025 + beta * 0.045 + crp) + wd * least(0.25, greatest(synth, actual)) * 0.75 AS wacc,
  used * roic AS g FROM c),
t AS (SELECT *, least(0.025, wacc - 0.005) AS gt FROM e),
yrs AS (SELECT t.*, n, g + (gt - g) * greatest(0, (n - 5) / 5) AS gn, roic + (wacc - roic) * greatest(0, (n - 5) / 5) AS rn FROM t, range(1, 11) x(n)),
prof AS (SELECT *, nopat * exp(sum(ln(1 + gn)) OVER (PARTITION BY lei ORDER BY n)) AS p FROM yrs),
pv AS (SELECT lei, sum(p * (1 - gn / rn) / pow(1 + wacc, n)) AS pv, arg_max(p, n) AS p10 FROM prof GROUP BY 1),
val AS (SELECT t.*, pv + p10 * (1 + gt) * (1 - gt / wacc) / ((wacc - gt) * pow(1 + wacc, 10)) AS ev,
  p10 * (1 + gt) * (1 - gt / wacc) / ((wacc - gt) * pow(1 + wacc, 10)) AS tv FROM t JOIN pv USING (lei)),
fin AS (SELECT *, (ev - debt - 0.01 * r4 + 0.1 * r4 + 0.01 * r4 + 0.02 * r4) / (shares / 1e6) AS vps FROM val)"""


@query(f"""WITH {_VALUE_SQL} SELECT lei, tbl AS credit_table, rating AS implied_rating, round(wacc, 6) AS wacc,
  round(beta, 6) AS relevered_beta,
round(used, 6) AS reinvest_used, round(g, 6) AS growth, round(kd, 6) AS cost_of_debt, round(wd, 6) AS debt_weight,
  round(roic, 6) AS computed_roic FROM fin""")
def cost_of_capital(spark, d):
    v = valuation.value_companies(_valuation_inputs(spark, d))
    return v.select("lei", "credit_table", "implied_rating", *[F.round(c, 6).alias(c) for c in (
        "wacc", "relevered_beta", "reinvest_used", "growth", "cost_of_debt", "debt_weight", "computed_roic")])


@query(f"""WITH {_VALUE_SQL}, z AS (SELECT *, (vps - price) / price AS up, cap / r4 AS cr FROM fin)
SELECT lei, round(vps, 4) AS value_per_share, round(up, 4) AS upside, round(tv / ev, 4) AS terminal_share_of_ev,
CASE WHEN NOT cr BETWEEN 0.05 AND 30 THEN 'VOID - failed validation' WHEN up > 0.25 THEN 'UNDERVALUED - investigate'
  WHEN up < -0.25 THEN 'OVERVALUED - screen out'
ELSE 'FAIRLY VALUED - no action' END AS verdict, round(ev / (0.15 * r4), 4) AS implied_ev_ebit FROM z""")
def company_values(spark, d):
    v = valuation.value_companies(_valuation_inputs(spark, d))
    return v.select("lei", "verdict", *[F.round(c, 4).alias(c) for c in ("value_per_share", "upside", "terminal_share_of_ev", "implied_ev_ebit")])


_VINTAGE_SQL = f"""{_LADDER_SQL},
vint AS (SELECT unnest([min(page_id), max(page_id)]) AS vt FROM rungs WHERE n = 15),
rung AS (SELECT t, page_id AS v, coverage_from + CASE t WHEN 'SMALL' THEN 0.5 ELSE 0 END AS cov, rating,
  spread + CASE t WHEN 'SMALL' THEN 0.01 ELSE 0 END AS spread FROM rungs, (VALUES ('LARGE'), ('SMALL')) x(t) WHERE n = 15),
""" + _VALUE_SQL.replace("SELECT 'C' || o_custkey AS lei,", "SELECT 'C' || o_custkey || '@' || vt AS lei, vt,") \
    .replace("FROM y WHERE", "FROM y, vint WHERE").replace("cap >= 4300", "cap >= 500 * (1 + vt % 9)") \
    .replace(f"JOIN (VALUES {_LADDER_VALUES}) l(t, cov, rating, spread) ON t = tbl AND cov <= cover",
             "JOIN rung l ON l.t = tbl AND l.v = b.vt AND cov <= cover")


def _ladder_vintages(spark, d):
    """The ladders of all usable pages: a vintage per page, with a size cut-off of its own."""
    rungs = parameters.accepted_ladders(parameters.ladder_from_html(_ladder_pages(spark, d)))[0]
    small = F.col("table") == "SMALL"
    return rungs.select(
        F.explode(F.array(F.lit("LARGE"), F.lit("SMALL"))).alias("table"), F.col("page_id").cast("string").alias("vintage"),
        F.substring("rating", 2, 2).cast("int").alias("row"), "coverage_from", "rating", "rating_full", "spread",
        (500.0 * (1 + F.col("page_id") % 9)).alias("cutoff")).withColumns({
            "coverage_from": F.when(small, F.col("coverage_from") + 0.5).otherwise(F.col("coverage_from")),
            "spread": F.when(small, F.col("spread") + 0.01).otherwise(F.col("spread"))})


_BY_VINTAGE_SQL = f"""WITH {_VINTAGE_SQL}, z AS (SELECT *, (vps - price) / price AS up, cap / r4 AS cr FROM fin)
SELECT split_part(lei, '@', 1) AS lei, vt::VARCHAR AS ladder_vintage, tbl AS credit_table, rating AS implied_rating,
  round(wacc, 6) AS wacc, round(vps, 4) AS value_per_share,
  CASE WHEN NOT cr BETWEEN 0.05 AND 30 THEN 'VOID - failed validation' WHEN up > 0.25 THEN 'UNDERVALUED - investigate'
  WHEN up < -0.25 THEN 'OVERVALUED - screen out' ELSE 'FAIRLY VALUED - no action' END AS verdict FROM z"""


def _valued_by(spark, d, ladder):
    """Every company valued with the first and the last vintage of a ladder table."""
    pages = ladder.select(F.col("vintage").cast("long").alias("v"))
    both = F.array(*[pages.agg(f("v")).scalar().cast("string") for f in (F.min, F.max)])
    inputs = _valuation_inputs(spark, d).withColumn("ladder_vintage", F.explode(both))
    return valuation.value_companies(inputs, ladder).select(
        "lei", "ladder_vintage", "credit_table", "implied_rating", F.round("wacc", 6).alias("wacc"),
        F.round("value_per_share", 4).alias("value_per_share"), "verdict")


@query(_BY_VINTAGE_SQL)
def values_by_vintage(spark, d):
    """Every company valued with the first and the last ladder that was read."""
    return _valued_by(spark, d, stored(spark, "ladders", d, lambda: _ladder_vintages(spark, d)))


@query(_BY_VINTAGE_SQL)
def values_by_ladder_files(spark, d):
    """The same with ladders written as reference files, of at most 500 vintages each, and read back."""
    path = work_path(spark, "ladder-files")
    rung = F.struct("row", "coverage_from", "rating", "rating_full", "spread")
    tables = _ladder_vintages(spark, d).groupBy("vintage", "table").agg(
        F.sort_array(F.collect_list(rung)).alias("rungs"), F.max("cutoff").alias("eur_millions")) \
        .groupBy("vintage").agg(F.struct(F.max("eur_millions").alias("eur_millions")).alias("size_cutoff"), F.map_from_entries(
            F.collect_list(F.struct("table", F.struct(F.transform("rungs", lambda r: r.dropFields("row")).alias("rows"))))).alias("tables"))
    tables.groupBy(F.floor(F.col("vintage").cast("long") / 500).alias("file")).agg(F.to_json(F.collect_list(F.struct(
        "vintage", "size_cutoff", "tables"))).alias("value")).write.partitionBy("file").text(path)
    return _valued_by(spark, d, records.read_ladder(spark, f"{path}/*"))


@query(f"""WITH {_VALUE_SQL} SELECT lei, c AS cell, s AS severity FROM fin, LATERAL (VALUES ('D99', 'OK'), ('D103', CASE
  WHEN actual > synth THEN 'WARNING' ELSE 'OK' END),
('D104', CASE WHEN abs(d25 - d28) / greatest(abs(d25), abs(d28)) > 0.5 THEN 'WARNING'
  ELSE 'OK' END), ('D111', 'OK'), ('D112', 'OK'),
('D114', CASE WHEN cap / r4 BETWEEN 0.05 AND 30 THEN 'OK' ELSE 'FAIL' END), ('D115', 'OK'), ('D120', CASE
  WHEN k % 10 = 0 AND cap < 4300 THEN 'FAIL' ELSE 'OK' END),
('D122', CASE WHEN k % 11 = 0 THEN 'WARNING' ELSE 'OK' END)) x(c, s)""")
def valuation_checks(spark, d):
    k = F.substring("lei", 2, 20).cast("bigint")
    cap = F.col("price") * F.col("shares") / 1e6
    inputs = _valuation_inputs(spark, d).withColumns({
        "loaded_table": F.when(k % 10 == 0, "LARGE").otherwise(numbers.credit_table(cap)),
        "ladder_age_days": F.when(k % 11 == 0, 500).otherwise(10)})
    return valuation.value_companies(inputs).select("lei", F.explode("checks").alias("c")).select("lei", "c.cell", "c.severity")


@query("SELECT o_orderkey, (DATE '2001-08-05' - o_orderdate::DATE)::INT AS price_age_days FROM orders WHERE DATE '2001-08-05' - o_orderdate::DATE > 7")
def stale_prices(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("price_as_of"))
    return valuation.stale_prices(valuation.with_price_age(rows, F.lit("2001-08-05").cast("date"))).drop("price_as_of")


@query("SELECT 'O' || o_orderkey AS lei FROM orders WHERE o_orderkey % 9 = 0 OR o_orderkey % 10 = 0")
def price_echo_problems(spark, d):
    k = F.col("o_orderkey")
    given = table(spark, d, "orders").select(F.concat(F.lit("O"), k).alias("lei"), F.col("o_totalprice").alias("price"), k)
    back = given.select("lei", F.when(k % 9 == 0, None).when(k % 10 == 0, F.col("price") + 0.01).otherwise(F.col("price") + 0.001).alias("current_price"))
    return valuation.echo_problems(back, given).select("lei")


# -- portfolio: users are companies, every day of theirs carries a run --------------------------

def _runs(spark, d):
    e = table(spark, d, "events")
    rows = e.select(F.concat(F.lit("U"), "user_id").alias("lei"), F.to_date("ts").alias("run_date"), "event_id", "event_type", "value")
    one = ordered.earliest(rows, ["lei", "run_date"], [F.col("event_id")], ["event_type", "value", "event_id"])
    t = F.col("event_type")
    verdict = F.when(t.isin("purchase", "view"), spec.UNDERVALUED).when(t == "error", spec.OVERVALUED) \
        .when(t == "click", spec.FAIRLY_VALUED).otherwise(spec.VOID)
    factor = F.when(t.isin("purchase", "view"), 2.0).when(t == "error", 0.5).when(t == "click", 1.1)
    return one.select("run_date", "lei", F.concat(F.lit("T"), "lei").alias("ticker"), (F.col("value") * factor).alias("value_per_share"),
                      F.col("value").alias("price"), verdict.alias("verdict"), (t == "purchase").alias("research_flag"),
                      (t == "signup").alias("void"), (t == "view").alias("blocked"))


def _run_quotes(spark, d):
    p = prices(spark, d)
    return p.withColumn("seen_on", F.when(F.dayofmonth("as_of") == 20, F.date_add("as_of", 9)).otherwise(F.col("as_of")))


_BOOK_SQL = f"""{_QUOTE_SQL},
run AS (SELECT 'U' || user_id AS lei, ts::DATE AS run_date, event_type AS t, value AS price,
  value * CASE WHEN event_type IN ('purchase', 'view') THEN 2.0 WHEN event_type = 'error' THEN 0.5
  WHEN event_type = 'click' THEN 1.1 END AS vps,
  CASE WHEN event_type IN ('purchase', 'view') THEN 'UNDERVALUED - investigate' WHEN event_type = 'error'
  THEN 'OVERVALUED - screen out'
    WHEN event_type = 'click' THEN 'FAIRLY VALUED - no action' ELSE 'VOID - failed validation' END AS verdict
  FROM events QUALIFY row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY event_id) = 1),
cal AS (SELECT run_date, lead(run_date) OVER (ORDER BY run_date) AS next_run FROM (SELECT DISTINCT run_date FROM run)),
tl AS (SELECT lei, run_date AS d_at, 0 AS side, price, vps, verdict, t, run_date, next_run, NULL::DATE AS seen
  FROM run JOIN cal USING (run_date)
  UNION ALL SELECT lei, as_of, 1, price, NULL, NULL, NULL, NULL, NULL, CASE WHEN day(as_of) = 20 THEN as_of + 9
  ELSE as_of END FROM price),
k AS (SELECT *, last_value(t IGNORE NULLS) OVER w AS lt, last_value(run_date IGNORE NULLS) OVER w AS lr,
  last_value(verdict IGNORE NULLS) OVER w AS lv, last_value(vps IGNORE NULLS) OVER w AS lval,
  last_value(CASE WHEN t IS NOT NULL THEN [vps] END IGNORE NULLS) OVER w AS lrun,
  last_value(CASE WHEN t IS NOT NULL THEN [next_run] END IGNORE NULLS) OVER w AS ln FROM tl
  WINDOW w AS (PARTITION BY lei ORDER BY d_at, side ROWS UNBOUNDED PRECEDING)),
sig AS (SELECT *, CASE WHEN side = 0 THEN CASE WHEN t = 'purchase' AND price > 0 THEN 1 WHEN t IN ('error', 'click')
  THEN 0 END
  WHEN lt IS NOT NULL AND lt <> 'signup' AND price > 0 AND seen - d_at <= 7 THEN
    CASE WHEN lt <> 'view' AND (ln[1] IS NULL OR d_at < ln[1]) AND lrun[1] > 0 AND lrun[1] / price - 1 > 0.25 THEN 1
  WHEN lval > 0 AND lval / price - 1 <= 0 THEN 0 END END AS s FROM k),
st AS (SELECT *, coalesce(last_value(s IGNORE NULLS) OVER (PARTITION BY lei
  ORDER BY d_at, side ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held FROM sig),
ev AS (SELECT *, CASE WHEN s = 1 AND held = 0 THEN 'entry' WHEN s = 0 AND held = 1 THEN 'exit' END AS event FROM st
  WHERE (s = 1 AND held = 0) OR (s = 0 AND held = 1)),
trip AS (SELECT lei, 'T' || lei AS ticker, d_at AS entry_date, price AS entry_price, lrun[1] AS entry_value, event,
  lead(d_at) OVER x AS exit_date, lead(price) OVER x AS exit_price, lead(lval) OVER x AS exit_value,
  lead(CASE WHEN side = 0 THEN verdict ELSE 'PRICE AT FAIR VALUE - exited between screens' END) OVER x AS exit_verdict
  FROM ev WINDOW x AS (PARTITION BY lei ORDER BY d_at, side)),
lastrun AS (SELECT lei, max(run_date) AS rd, arg_max(verdict, run_date) AS rv, arg_max(vps, run_date) FILTER (vps IS NOT NULL) AS rvps FROM run GROUP BY 1),
book AS (SELECT trip.*, CASE WHEN exit_date IS NULL THEN 'open' ELSE 'closed' END AS status, 100 / entry_price AS units,
  CASE WHEN exit_date IS NULL THEN CASE WHEN rd >= entry_date THEN rv
  ELSE 'UNDERVALUED - investigate' END END AS last_verdict,
  CASE WHEN exit_date IS NULL THEN coalesce(rvps, entry_value) ELSE exit_value END AS last_value
  FROM trip JOIN lastrun USING (lei) WHERE event = 'entry'),
newest AS (SELECT lei, max(as_of) AS as_of, arg_max(price, as_of) AS price FROM price GROUP BY 1),
marked AS (SELECT b.*, CASE WHEN status = 'open' THEN coalesce(n.price, entry_price) ELSE
  coalesce(exit_price, entry_price) END AS mark,
  status = 'open' AND n.price IS NULL AS missing FROM book b LEFT JOIN newest n USING (lei))"""


@query(f'WITH {_BOOK_SQL} SELECT lei, d_at AS "at", side::INT AS side, event, price FROM ev')
def position_events(spark, d):
    return portfolio.position_events(_runs(spark, d), _run_quotes(spark, d)).select("lei", "at", "side", "event", "price")


def _book(spark, d):
    return portfolio.positions(_runs(spark, d), _run_quotes(spark, d))


@query(f"""WITH {_BOOK_SQL} SELECT lei, ticker, entry_date, entry_price, round(entry_value, 6) AS entry_value_per_share,
  round(units, 6) AS units, exit_date, exit_price, exit_verdict,
status, last_verdict, round(last_value, 6) AS last_value_per_share FROM book""")
def portfolio_positions(spark, d):
    return _book(spark, d).select(
        "lei", "ticker", "entry_date", "entry_price", F.round("entry_value_per_share", 6).alias("entry_value_per_share"), F.round("units", 6).alias("units"),
        "exit_date", "exit_price", "exit_verdict", "status", "last_verdict", F.round("last_value_per_share", 6).alias("last_value_per_share"))


def _marked(spark, d):
    return portfolio.mark(_book(spark, d), store.latest_price(prices(spark, d)))


@query(f"""WITH {_BOOK_SQL} SELECT lei, entry_date, status, round(units * mark, 4) AS value,
  round((units * mark - 100) / 100, 6) AS return_pct,
round((last_value - mark) / mark, 6) AS current_upside, coalesce(status = 'open'
  AND last_verdict LIKE 'VOID%', false) AS unvaluable FROM marked""")
def marked_positions(spark, d):
    return portfolio.book_order(_marked(spark, d), "all").select(
        "lei", "entry_date", "status", F.round("value", 4).alias("value"), F.round("return_pct", 6).alias("return_pct"),
        F.round("current_upside", 6).alias("current_upside"), "unvaluable")


@query(f"""WITH {_BOOK_SQL} SELECT count(*) * 100.0::DOUBLE AS invested, round(sum(units * mark), 4) AS current_value,
  round((sum(units * mark) - count(*) * 100) / (count(*) * 100), 6) AS return_pct,
count(*) FILTER (status = 'open') AS open, count(*) FILTER (status = 'closed') AS closed,
  count(*) FILTER (missing) AS missing,
round(avg((units * mark - 100) / 100) FILTER (status = 'open'), 6) AS held_return_pct FROM marked""")
def portfolio_totals(spark, d):
    return portfolio.totals(_marked(spark, d)).withColumns({
        "current_value": F.round("current_value", 4), "return_pct": F.round("return_pct", 6), "held_return_pct": F.round("held_return_pct", 6)})


_SPINE = f"""{_BOOK_SQL}, spine AS (SELECT entry_date AS d FROM book UNION SELECT exit_date FROM book WHERE exit_date IS NOT NULL
UNION SELECT as_of FROM price WHERE lei IN (SELECT lei FROM book)),
px AS (SELECT d, b.lei, b.entry_date, entry_price, CASE WHEN exit_date <= d THEN
  coalesce(nullif(exit_price, 0), entry_price) ELSE
  (SELECT arg_max(price, as_of) FROM price p WHERE p.lei = b.lei AND p.as_of <= d) END AS p FROM spine
  JOIN book b ON b.entry_date <= d)"""


@query(f"WITH {_SPINE} SELECT d AS date, round(avg(p / entry_price - 1), 6) AS return_pct, count(*) AS n FROM px WHERE p IS NOT NULL AND d <= DATE '2024-01-29' GROUP BY 1")
def performance_series(spark, d):
    book, p = ordered_frames(spark, d)
    return portfolio.performance_series(book, p, F.lit("2024-01-29").cast("date")).select(
        "date", F.round("return_pct", 6).alias("return_pct"), F.col("n").cast("bigint").alias("n"))


def ordered_frames(spark, d):
    """The book and the prices as stored tables: both are read several times."""
    return stored(spark, "book", d, lambda: _book(spark, d)), stored(spark, "prices", d, lambda: prices(spark, d))


@query(f"""WITH {_QUOTE_SQL}, asks AS (SELECT 'U' || user_id AS lei, max(ts)::DATE - 5 AS d_at FROM events GROUP BY 1)
SELECT a.lei, a.d_at AS "at", p.price AS known_price FROM asks a ASOF LEFT JOIN price p ON a.lei = p.lei
  AND a.d_at >= p.as_of""")
def as_of_prices(spark, d):
    asks = table(spark, d, "events").groupBy("user_id").agg(F.date_sub(F.to_date(F.max("ts")), 5).alias("at")) \
        .select(F.concat(F.lit("U"), "user_id").alias("lei"), "at")
    return portfolio.as_of_price(asks, prices(spark, d))


def _stored_runs(spark, d):
    """The runs as a table with a partition per run date, written once for all queries of an application."""
    return stored(spark, "runs", d, lambda: _runs(spark, d), ("run_date",))


def _last_run(spark, d):
    return records.latest_run(_stored_runs(spark, d))


_LAST_SQL = f"""{_BOOK_SQL}, lr AS (SELECT * FROM run WHERE run_date = (SELECT max(run_date) FROM run)),
pos AS (SELECT lei, 'T' || lei AS ticker, arg_max(t, run_date) AS t, arg_max(vps, run_date) AS vps, arg_max(verdict, run_date) AS verdict
  FROM run WHERE run_date < (SELECT max(run_date) FROM run)
  GROUP BY 1 HAVING arg_max(t, run_date) IN ('purchase', 'view'))"""


def _held(spark, d):
    earlier = records.earlier_runs(_stored_runs(spark, d))
    carry = ["ticker", "verdict", "value_per_share"]
    before = ordered.latest(earlier, ["lei"], [F.col("run_date")], carry)
    return before.where(F.col("verdict") == spec.UNDERVALUED).select(
        "lei", "ticker", F.col("verdict").alias("last_verdict"), F.col("value_per_share").alias("last_value_per_share"))


@query(f"WITH {_LAST_SQL} SELECT run_date, lei, verdict FROM lr")
def latest_run_rows(spark, d):
    return _last_run(spark, d).select("run_date", "lei", "verdict")


@query(f"""WITH {_LAST_SQL}, x AS (SELECT coalesce(p.lei, l.lei) AS lei, p.lei IS NOT NULL AS held, l.lei IS NOT NULL AS seen, l.t, l.price FROM pos p FULL JOIN lr l ON p.lei = l.lei)
SELECT lei, CASE WHEN held AND NOT seen THEN 'not_seen' WHEN held AND t = 'signup' THEN 'unvaluable' WHEN held
  AND t IN ('error', 'click') THEN 'exit' WHEN held THEN 'observe' ELSE 'enter' END AS action
FROM x WHERE held OR (t = 'purchase' AND price > 0)""")
def run_sync_actions(spark, d):
    return portfolio.sync_run(_held(spark, d), _last_run(spark, d)).select("lei", "action")


@query(f"WITH {_LAST_SQL} SELECT lei FROM pos WHERE lei NOT IN (SELECT lei FROM lr)")
def not_seen_positions(spark, d):
    return portfolio.not_seen(_held(spark, d).withColumn("status", F.lit("open")), _last_run(spark, d)).select("lei")


@query(f"WITH {_LAST_SQL} SELECT lei FROM pos UNION SELECT lei FROM lr")
def price_targets(spark, d):
    return portfolio.price_targets(_last_run(spark, d), _held(spark, d).withColumn("status", F.lit("open")))


def _triggers(spark, d):
    blocking = F.when(F.col("blocked"), F.array(F.lit("D122"))).otherwise(F.array().cast("array<string>"))
    v = F.col("value_per_share")
    return _last_run(spark, d).withColumns({"blocking_checks": blocking, "trigger_price": v / 1.25, "watch_price": v / 1.2})


@query(f"""WITH {_LAST_SQL}, fresh AS (SELECT lei, as_of, price FROM newest WHERE price > 0 AND DATE '2024-02-03' - as_of <= 7),
x AS (SELECT pos.lei, 'exit' AS action, as_of AS "on", price, vps / price - 1 AS up FROM pos JOIN fresh USING (lei)
  WHERE vps > 0 AND vps / price - 1 <= 0)
SELECT lei, action, "on", price, round(up, 6) AS upside FROM x UNION ALL
SELECT lr.lei, 'enter', f.as_of, f.price, round(vps / f.price - 1, 6) FROM lr JOIN fresh f ON lr.lei = f.lei
  WHERE t NOT IN ('signup', 'view') AND vps > 0
AND vps / f.price - 1 > 0.25 AND lr.lei NOT IN (SELECT lei FROM pos WHERE lei NOT IN (SELECT lei FROM x))""")
def price_update_actions(spark, d):
    quotes = portfolio.fresh_quotes(prices(spark, d), F.lit("2024-02-03").cast("date"))
    return portfolio.price_update(_held(spark, d), _triggers(spark, d), quotes).select("lei", "action", "on", "price", F.round("upside", 6).alias("upside"))


@query(f"""WITH {_LAST_SQL} SELECT lr.lei, n.price, CASE WHEN n.price <= vps / 1.25 THEN 'crossed'
  ELSE 'approaching' END AS status FROM lr JOIN newest n ON lr.lei = n.lei
WHERE vps IS NOT NULL AND verdict NOT LIKE 'UNDER%' AND n.price <= vps / 1.2""")
def price_watch(spark, d):
    return portfolio.watch_order(portfolio.price_watch(_triggers(spark, d), store.latest_price(prices(spark, d)))).select("lei", "price", "status")


@query(f"""WITH {_BOOK_SQL} SELECT lei, CASE WHEN status = 'open' THEN 'added' ELSE 'removed' END AS change,
CASE WHEN status = 'closed' THEN CASE split_part(exit_verdict, ' - ', 1) WHEN 'OVERVALUED' THEN 'Overvalued'
  WHEN 'FAIRLY VALUED' THEN 'Fairly Valued' ELSE 'Price At Fair Value' END END AS reason
FROM book WHERE (status = 'open' AND entry_date = DATE '2024-01-29') OR (status = 'closed'
  AND exit_date = DATE '2024-01-29')""")
def changed_positions(spark, d):
    return portfolio.changed_at(_book(spark, d), F.lit("2024-01-29").cast("date")).select("lei", "change", "reason")


@query(f"""WITH {_BOOK_SQL} SELECT min(greatest(entry_date, coalesce(n.as_of, entry_date))) AS since FROM book LEFT
  JOIN newest n USING (lei) WHERE status = 'open'""")
def backfill_start(spark, d):
    return portfolio.backfill_start(_book(spark, d), store.latest_price(prices(spark, d)))


@query(f"""WITH {_BOOK_SQL}, x AS (SELECT min(greatest(entry_date, coalesce(n.as_of, entry_date))) AS since FROM book LEFT
  JOIN newest n USING (lei) WHERE status = 'open')
SELECT lei, since FROM book, x WHERE status = 'open'""")
def refresh_plan(spark, d):
    book, p = ordered_frames(spark, d)
    e = table(spark, d, "events")
    state = e.agg(F.to_date(F.max("ts")).cast("string").alias("value")).select(F.lit("prices_refreshed").alias("key"), "value")
    return portfolio.refresh_plan(book, store.latest_price(p), state, F.lit("2024-01-31").cast("date"))


@query(f"""WITH {_BOOK_SQL} SELECT lei, entry_date, exit_date,
  round((coalesce(exit_price, entry_price) / entry_price - 1), 6) AS return_pct
FROM book WHERE status = 'closed'""")
def sold_positions(spark, d):
    return portfolio.book_order(_marked(spark, d), "sold").select("lei", "entry_date", "exit_date", F.round("return_pct", 6).alias("return_pct"))


@query(f"""WITH {_BOOK_SQL}, rec AS (SELECT lei, run_date, t, vps, price, verdict, right(lei, 1) IN ('1', '2', '3') AS old
  FROM run)
SELECT lei, run_date, CASE WHEN NOT old THEN verdict WHEN vps IS NULL THEN 'VOID - failed validation'
  WHEN (vps - price) / price > 0.25 THEN 'UNDERVALUED - investigate'
WHEN (vps - price) / price < -0.25 THEN 'OVERVALUED - screen out'
  ELSE 'FAIRLY VALUED - no action' END AS verdict, t = 'purchase' AS research_flag FROM rec""")
def replayed_runs(spark, d):
    runs = _runs(spark, d)
    old = F.substring("lei", -1, 1).isin("1", "2", "3")
    rec = runs.select(
        "run_date", F.when(old, F.col("ticker")).otherwise(F.col("lei")).alias("key"), F.when(~old, F.col("lei")).alias("lei"),
        F.when(~old, F.col("ticker")).alias("ticker"), "value_per_share", "price", F.when(~old, F.col("verdict")).alias("verdict"),
        F.when(~old, F.col("research_flag")).alias("research_flag"), F.col("research_flag").alias("queued"))
    tickers = table(spark, d, "events").select(F.concat(F.lit("U"), "user_id").alias("lei"), F.concat(F.lit("TU"), "user_id").alias("ticker")).distinct()
    return portfolio.replay_triggers(rec, tickers).select("lei", "run_date", "verdict", "research_flag")


# -- health: stage dates out of events and orders --------------------------------------

_STAGES = tuple(spec.STAGE_REFRESH_DAYS)
_STAGE_LAG = (200, 100, 50, 8, 120, 30, 430, 0, 10)


def _stage_rows(spark, d):
    e = table(spark, d, "events")
    newest = e.agg(F.to_date(F.max("ts")).alias("newest"), F.count(F.lit(1)).alias("n"))
    rows = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(lag).alias("lag")) for k, lag in zip(_STAGES, _STAGE_LAG)])
    return newest.select("newest", F.explode(rows).alias("s")).select(
        "s.key", F.initcap("s.key").alias("title"), (F.col("s.key") != "shares").alias("done"),
        F.when(F.col("s.key") != "industries", F.date_sub("newest", F.col("s.lag"))).alias("last_date"),
        F.when(F.col("s.key") == "prices", F.date_sub("newest", 1)).alias("ran_date"))


_STAGE_SQL = f"""nw AS (SELECT max(ts)::DATE AS newest FROM events),
sg AS (SELECT k AS key, CASE WHEN k <> 'industries' THEN newest - lag END AS last_date, CASE WHEN k = 'prices'
  THEN newest - 1 END AS ran_date, lim, par
  FROM nw, (VALUES {", ".join(f"('{k}', {lag}, {spec.STAGE_REFRESH_DAYS[k] or 'NULL'}, {repr(spec.STAGE_PARENT[k]) if k in spec.STAGE_PARENT else 'NULL'})" for k, lag in zip(_STAGES, _STAGE_LAG))}) v(k, lag, lim, par)),
hl AS (SELECT s.key, s.last_date, (DATE '2024-01-31' - s.last_date)::INT AS age_days, CASE WHEN s.key = 'tables'
  AND DATE '2024-01-31' - s.last_date > 425 THEN 'blocking'
  WHEN s.key = 'shares' THEN 'missing' WHEN DATE '2024-01-31' - s.last_date > s.lim THEN 'stale' WHEN
  coalesce(p.ran_date, p.last_date) > coalesce(s.ran_date, s.last_date) THEN 'stale' ELSE 'ok' END AS health
  FROM sg s LEFT JOIN sg p ON s.par = p.key)"""


def _health(spark, d):
    return health.stage_health(_stage_rows(spark, d), F.lit("2024-01-31").cast("date"))


@query(f"WITH {_STAGE_SQL} SELECT key, last_date, age_days, health FROM hl")
def stage_health(spark, d):
    return _health(spark, d).select("key", "last_date", "age_days", "health")


@query(f"""WITH {_STAGE_SQL} SELECT key, health FROM hl WHERE health <> 'ok' UNION ALL
SELECT 'report-cycle', 'stale' FROM hl WHERE key = 'screen' AND health = 'ok'
  AND (year(last_date), quarter(last_date)) <> (2024, 1)""")
def health_alerts(spark, d):
    h = _health(spark, d)
    reminders = health.calendar_reminders(h, date(2024, 1, 31), F.lit("2023-06-01").cast("date"))
    return health.alerts(h, reminders).select("key", "health")


@query("""SELECT 'prices' AS stage, max(ts)::DATE AS last_date FROM events UNION ALL SELECT 'extract', max(o_orderdate)::DATE
  FROM orders
UNION ALL SELECT 'shares', max(l_shipdate)::DATE FROM lineitem""")
def last_write_dates(spark, d):
    return store.last_write_dates({"prices": (table(spark, d, "events"), "ts"), "extract": (table(spark, d, "orders"), "o_orderdate"),
                                   "shares": (table(spark, d, "lineitem"), "l_shipdate")})


@query("""SELECT key, CASE WHEN key = 'inception_date' THEN coalesce(o, n) ELSE coalesce(n, o) END AS value FROM
(SELECT 'inception_date' AS key, min(ts)::DATE::VARCHAR AS o, max(ts)::DATE::VARCHAR AS n FROM events UNION ALL
SELECT 'last_sync_date', min(ts)::DATE::VARCHAR, max(ts)::DATE::VARCHAR FROM events)""")
def run_state_keys(spark, d):
    e = table(spark, d, "events")
    state = lambda f: e.agg(F.to_date(f("ts")).cast("string").alias("value")).select(
        F.explode(F.array(F.lit("inception_date"), F.lit("last_sync_date"))).alias("key"), "value")
    return store.run_state(state(F.min), state(F.max))
