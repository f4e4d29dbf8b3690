"""Scalar expressions on whole tables and whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from accountloom import spec
from accountloom.bindings.base import pick, table
from accountloom.functions import dates, numbers, text
from accountloom.sources.records import fingerprint

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn
    return register


_WORDS = ("OK", "warning", "FAIL", "NOTE", "odd")
_MSG = """m AS (SELECT doc_id, ['OK', 'warning', 'FAIL', 'NOTE', 'odd'][(doc_id % 5 + 1)::INT] || '  - ' || text AS msg,
  regexp_replace(trim(regexp_replace(['OK', 'warning', 'FAIL', 'NOTE', 'odd'][(doc_id % 5 + 1)::INT] || '  - ' || text, '[\\s\\x0b]+', ' ', 'g')), 'x^', '') AS flat FROM documents)"""


def _messages(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", F.concat(pick(_WORDS, F.col("doc_id") % 5), F.lit("  - "), "text").alias("msg"))


@query(f"""WITH {_MSG} SELECT doc_id, CASE WHEN doc_id % 5 = 4 THEN 'UNKNOWN'
  ELSE upper(['OK', 'warning', 'FAIL', 'NOTE', 'odd'][(doc_id % 5 + 1)::INT]) END AS severity,
length(flat[position(' - ' IN flat) + 3:])::INT AS stripped_length, md5(flat[position(' - ' IN flat) + 3:]) AS stripped, md5(CASE WHEN length(flat) <= 40 THEN flat ELSE rtrim(flat[1:39]) || '…' END) AS short FROM m""")
def check_message_parts(spark, d):
    m = F.col("msg")
    s = text.strip_severity(m)
    return _messages(spark, d).select("doc_id", text.severity(m).alias("severity"), F.length(s).alias("stripped_length"),
                                      F.md5(s).alias("stripped"), F.md5(text.shorten(m, 40)).alias("short"))


@query("""SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN (CASE WHEN o_orderkey % 2 = 0 THEN 'SUPPRESSED'
  ELSE 'UNDERVALUED' END) WHEN 1 THEN 'OVERVALUED' WHEN 2 THEN 'FAIRLY VALUED'
WHEN 3 THEN 'VOID' WHEN 4 THEN left('A LONG UNKNOWN TEXT', 14) ELSE 'PRICE AT FAIR ' END AS short,
CASE o_orderkey % 6 WHEN 0 THEN 'Undervalued' WHEN 1 THEN 'Overvalued' WHEN 2 THEN 'Fairly Valued' WHEN 3 THEN 'Void'
  WHEN 4 THEN 'A Long Unknown Text' ELSE 'Price At Fair Value' END AS reason FROM orders""")
def verdict_labels(spark, d):
    k = F.col("o_orderkey")
    v = pick((spec.UNDERVALUED, spec.OVERVALUED, spec.FAIRLY_VALUED, spec.VOID, "A LONG UNKNOWN TEXT", spec.EXIT_AT_FAIR_VALUE), k % 6)
    return table(spark, d, "orders").select("o_orderkey", text.short_verdict(v, k % 2 == 0).alias("short"), text.exit_reason(v).alias("reason"))


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice AS p, l_extendedprice * (0.5 + l_quantity / 40) AS v FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, round((v - p) / p, 6) AS upside, CASE WHEN (v - p) / p > 0.25
  THEN 'UNDERVALUED - investigate' WHEN (v - p) / p < -0.25 THEN 'OVERVALUED - screen out'
ELSE 'FAIRLY VALUED - no action' END AS verdict, v / 1.25 AS trigger_price, v / 1.2 AS watch_price, p / 1000000.0 AS scaled FROM x""")
def upside_and_triggers(spark, d):
    p = F.col("l_extendedprice")
    v = p * (F.lit(0.5) + F.col("l_quantity") / 40)
    up = numbers.upside(v, p)
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.round(up, 6).alias("upside"), numbers.verdict_from_upside(up).alias("verdict"),
        numbers.trigger_price(v).alias("trigger_price"), numbers.watch_price(v).alias("watch_price"), numbers.scaled(p).alias("scaled"))


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN o_totalprice WHEN 1 THEN NULL WHEN 2 THEN -o_orderkey WHEN 3
  THEN NULL ELSE o_orderkey * 1000.0 END::DOUBLE AS number,
round_even(o_orderkey % 1000 / 10000, 4) AS fraction, round_even(o_totalprice, 0) = round_even(o_totalprice + 0.2, 0) AS same FROM orders""")
def parsed_numbers(spark, d):
    k = F.col("o_orderkey")
    raw = F.when(k % 5 == 0, F.col("o_totalprice").cast("string")).when(k % 5 == 1, F.lit("NaN")) \
        .when(k % 5 == 2, F.concat(F.lit("-"), k)).when(k % 5 == 3, F.concat(k, F.lit("d"))).otherwise(F.concat(F.lit(" "), k, F.lit("e3 ")))
    return table(spark, d, "orders").select(
        "o_orderkey", numbers.parse_number(raw).alias("number"),
        numbers.percent_text(F.concat((k % 1000).cast("string"), F.lit("e-2 %"))).alias("fraction"),
        numbers.same_count(F.col("o_totalprice"), F.col("o_totalprice") + 0.2).alias("same"))


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN d WHEN 1 THEN d WHEN 4 THEN NULL END AS start,
CASE o_orderkey % 5 WHEN 0 THEN d + 364 WHEN 1 THEN d + 365 WHEN 2 THEN d - 1 WHEN 3
  THEN d END AS "end", o_orderkey % 5 < 2 AS is_duration
FROM (SELECT o_orderkey, o_orderdate::DATE AS d FROM orders) WHERE o_orderkey % 5 < 4""")
def parsed_periods(spark, d):
    k, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    s, e = day.cast("string"), F.date_add(day, 365).cast("string")
    raw = F.when(k % 5 == 0, F.concat(s, F.lit("T00:00:00/"), e, F.lit("T00:00:00"))) \
        .when(k % 5 == 1, F.concat(s, F.lit("/"), e, F.lit("T23:59:59"))).when(k % 5 == 2, s) \
        .when(k % 5 == 3, F.concat(s, F.lit("T12:30:00Z"))).otherwise("sometime")
    rows = table(spark, d, "orders").select("o_orderkey", dates.period(raw).alias("p"))
    return rows.where(F.col("p").isNotNull()).select("o_orderkey", "p.start", "p.end", "p.is_duration")


@query("""SELECT o_orderkey, (DATE '2001-09-01' - o_orderdate::DATE)::INT AS age, (year(o_orderdate), quarter(o_orderdate)) <> (2001, 3) AS new_quarter,
date_trunc('month', o_orderdate)::DATE AS vintage FROM orders""")
def ages_and_quarters(spark, d):
    today, day = F.lit("2001-09-01").cast("date"), F.to_date("o_orderdate")
    return table(spark, d, "orders").select(
        "o_orderkey", dates.age_days(today, day).alias("age"), dates.new_quarter(today, day).alias("new_quarter"),
        dates.vintage_date(F.date_format(day, "yyyy-MM")).alias("vintage"))


@query("""SELECT p_partkey, p_partkey % 3 = 0 AS cross_listed, CASE WHEN p_partkey % 4 = 0 THEN 'manual' WHEN p_partkey % 2 = 0
  THEN 'isin' ELSE 'name+non_domicile' END AS confidence FROM part""")
def listing_marks(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").select(
        "p_partkey", text.is_cross_listed(F.concat(F.when(k % 3 == 0, "1").otherwise(""), "p_name")).alias("cross_listed"),
        text.listing_confidence(pick(("manual", "name", "isin", "name"), k % 4), pick(("domicile", "cross_listing_risk"), k % 2)).alias("confidence"))


@query("SELECT page_id, substr(sha256(html), 1, 16) AS fingerprint FROM pages")
def parameter_fingerprints(spark, d):
    return table(spark, d, "pages").select("page_id", fingerprint(F.col("html")).alias("fingerprint"))


@query("SELECT c_nationkey, c_custkey, c_name FROM customer WHERE c_mktsegment = 'MACHINERY' ORDER BY c_acctbal DESC, c_custkey LIMIT 25")
def largest_companies(spark, d):
    """A top list: filter first, then order and cut."""
    c = table(spark, d, "customer").where(F.col("c_mktsegment") == "MACHINERY")
    return c.orderBy(F.desc("c_acctbal"), "c_custkey").limit(25).select("c_nationkey", "c_custkey", "c_name")


@query("""SELECT n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN 'SK' WHEN 1 THEN 'NL' WHEN 2 THEN 'DE' WHEN 3 THEN NULL
  ELSE 'GR' END AS iso FROM nation""")
def country_codes(spark, d):
    names = pick((" Slovak Republic ", "Netherlands (the)", "GERMANY", "Mars", "greece"), F.col("n_nationkey") % 5)
    return table(spark, d, "nation").select("n_nationkey", text.country_code(names).alias("iso"))
