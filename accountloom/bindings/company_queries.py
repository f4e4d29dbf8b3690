"""Identity, quote, share, parameter and classification queries on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from accountloom import spec
from accountloom.bindings.base import pick, sql_list, table
from accountloom.functions import numbers, text
from accountloom.operators import health, identity, parameters, policy, shares, store
from accountloom.session import stored, work_path
from accountloom.sources import quotes, records

QUERIES, ORACLE = {}, {}
TODAY = "2024-01-31"


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn
    return register


# -- instruments: one per order, entities are customers ------------------------------

ALL_VENUES = tuple(identity.VENUES) + ("LN", "US")
FIRST_VENUES = tuple(v[0] for v in (spec.HOME_VENUES[c] for c in spec.EURO_AREA))


def _instruments(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    k, cust = F.col("o_orderkey"), F.col("o_custkey")
    home = pick(FIRST_VENUES, F.col("c_nationkey") % 20)
    exchange = F.when(k % 6 == 0, home).otherwise(pick(ALL_VENUES, (k * 3 + cust) % len(ALL_VENUES)))
    base = F.concat(F.lit("T"), (cust % 500).cast("string"))
    ticker = F.when(k % 17 == 0, None).when(k % 9 == 0, F.concat(F.lit("1"), base)) \
        .when(k % 4 == 1, F.concat(base, F.lit("EUR"))).otherwise(base)
    pr = F.col("o_orderpriority")
    kind2 = F.when(pr == "1-URGENT", "Common Stock").when(pr == "2-HIGH", "REIT").when(pr == "3-MEDIUM", "Warrant") \
        .when(pr == "5-LOW", "Depositary Receipt")
    return o.join(c, cust == F.col("c_custkey")).select(
        F.concat(F.lit("C"), cust).alias("lei"), pick(spec.EURO_AREA, F.col("c_nationkey") % 20).alias("country"),
        k.alias("ord"), F.concat(F.lit("I"), k).alias("isin"), ticker.alias("ticker"), exchange.alias("exchange"),
        F.concat(F.lit("G"), k).alias("figi"), F.when(kind2.isNull(), "Preference Share").alias("security_type"),
        kind2.alias("security_type2"),
        F.when((F.col("o_orderstatus") == "P") & (k % 2 == 0), "Corp").otherwise("Equity").alias("market_sector"),
        F.col("c_name").alias("name"), (k % 5 == 0).alias("by_name"))


_INSTRUMENT_SQL = f"""
ins AS (SELECT 'C' || o_custkey AS lei, o_custkey, c_name AS name, {sql_list(spec.EURO_AREA)}[c_nationkey % 20 + 1] AS country,
  o_orderkey AS ord, 'I' || o_orderkey AS isin, 'G' || o_orderkey AS figi, o_orderkey % 5 = 0 AS by_name,
  CASE WHEN o_orderkey % 6 = 0 THEN {sql_list(FIRST_VENUES)}[c_nationkey % 20 + 1]
       ELSE {sql_list(ALL_VENUES)}[((o_orderkey * 3 + o_custkey) % {len(ALL_VENUES)} + 1)::INT] END AS exchange,
  CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderkey % 9 = 0 THEN '1T' || (o_custkey % 500)
       WHEN o_orderkey % 4 = 1 THEN 'T' || (o_custkey % 500) || 'EUR' ELSE 'T' || (o_custkey % 500) END AS ticker,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'Common Stock' WHEN '2-HIGH' THEN 'REIT' WHEN '3-MEDIUM' THEN 'Warrant'
       WHEN '5-LOW' THEN 'Depositary Receipt' ELSE 'Preference Share' END AS security_type,
  NOT (o_orderstatus = 'P' AND o_orderkey % 2 = 0) AS equity
  FROM orders JOIN customer ON o_custkey = c_custkey),
lines AS (SELECT *, CASE country {" ".join(f"WHEN '{c}' THEN exchange IN ({', '.join(repr(x) for x in v)})" for c, v in spec.HOME_VENUES.items())} END AS home
  FROM ins WHERE equity AND security_type <> 'Warrant'),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lei, by_name ORDER BY NOT home,
  coalesce(ticker, '') SIMILAR TO '[0-9].*',
  coalesce(ticker, '') LIKE '%EUR', lower(security_type) NOT LIKE '%common%', length(coalesce(ticker, '')),
  coalesce(ticker, ''), ord) AS r
  FROM lines WHERE exchange IN {tuple(identity.VENUES)} AND NOT (exchange IN ('GY', 'GR') AND NOT home)
  AND (NOT by_name OR ticker IS NOT NULL))"""


@query(f"WITH {_INSTRUMENT_SQL} SELECT lei, isin, ticker, exchange, figi, security_type FROM lines")
def equity_lines(spark, d):
    return identity.equity_lines(_instruments(spark, d)).select("lei", "isin", "ticker", "exchange", "figi", "security_type")


@query(f"""WITH {_INSTRUMENT_SQL} SELECT lei, ticker, exchange, ord, CASE WHEN home THEN 'domicile' ELSE 'cross_listing_risk' END
AS listing_tier FROM ranked WHERE r = 1 AND NOT by_name""")
def primary_listing_pick(spark, d):
    lines = identity.equity_lines(_instruments(spark, d)).where(~F.col("by_name"))
    return identity.pick_primary(lines).select("lei", "ticker", "exchange", "ord", "listing_tier")


def _overrides(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(
        F.concat(F.lit("C"), k).alias("lei"), F.when((k % 50).isin(1, 2), "OVR").alias("ticker"),
        F.when((k % 50).isin(1, 2), "FP").alias("exchange"), (k % 50 == 0).alias("exclude"),
        F.when(k % 50 == 1, "2024-01-01").alias("reviewed"))


def _resolved(spark, d, overrides=None):
    ins = _instruments(spark, d)
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    entities = c.select(F.concat(F.lit("C"), k).alias("lei"), F.col("c_name").alias("name"),
                        pick(spec.EURO_AREA, F.col("c_nationkey") % 20).alias("country"))
    overrides = _overrides(spark, d) if overrides is None else overrides
    isin_lines = ins.where(~F.col("by_name"))
    isins = isin_lines.groupBy("lei").agg(F.count(F.lit(1)).alias("n_isins"))
    return identity.resolve_listings(entities, overrides, isin_lines.drop("country"),
                                     ins.where("by_name").drop("country"), isins)


_RESOLVE_SQL = f"""{_INSTRUMENT_SQL},
decided AS (SELECT 'C' || c_custkey AS lei, c_name AS name, {sql_list(spec.EURO_AREA)}[c_nationkey % 20 + 1] AS country,
    c_custkey % 50 = 2 AS pending, p.ord AS p_ord, p.ticker AS p_ticker, p.exchange AS p_exchange, p.home AS p_home,
    n.ord AS n_ord, n.ticker AS n_ticker, n.exchange AS n_exchange, n.home AS n_home,
    CASE WHEN c_custkey % 50 = 0 THEN 'excluded' WHEN c_custkey % 50 = 1 THEN 'manual' WHEN p.lei IS NOT NULL
  THEN 'isin'
         WHEN n.lei IS NOT NULL THEN 'name' ELSE 'none' END AS route,
    (SELECT count(*) FROM lines l WHERE l.lei = 'C' || c_custkey AND NOT by_name) AS n_lines,
    (SELECT count(*) FROM ins i WHERE i.lei = 'C' || c_custkey AND NOT by_name) AS n_isins
  FROM customer LEFT JOIN (SELECT * FROM ranked WHERE r = 1 AND NOT by_name) p ON p.lei = 'C' || c_custkey
  LEFT JOIN (SELECT * FROM ranked WHERE r = 1 AND by_name) n ON n.lei = 'C' || c_custkey),
outcomes AS (SELECT lei, name, country, route, pending,
    CASE route WHEN 'excluded' THEN 'excluded_manually' WHEN 'manual' THEN 'manual'
      WHEN 'isin' THEN CASE WHEN p_home THEN 'domicile' ELSE 'cross_listing_risk' END
      WHEN 'name' THEN CASE WHEN n_home THEN 'domicile' ELSE 'cross_listing_risk' END
      ELSE CASE WHEN n_lines > 0 THEN 'no_home_listing' WHEN n_isins > 0 THEN 'debt_only'
  ELSE 'unresolved' END END AS outcome,
    CASE route WHEN 'manual' THEN 'OVR' WHEN 'isin' THEN p_ticker WHEN 'name' THEN n_ticker END AS ticker,
    CASE route WHEN 'manual' THEN 'FP' WHEN 'isin' THEN p_exchange WHEN 'name' THEN n_exchange END AS exchange
  FROM decided)"""


@query(f"WITH {_RESOLVE_SQL} SELECT * FROM outcomes")
def listing_outcomes(spark, d):
    return _resolved(spark, d)[1]


@query(f"""WITH {_RESOLVE_SQL} SELECT lei, outcome, ticker, exchange,
  CASE WHEN substr(lei, 2)::BIGINT % 50 <= 2 THEN 'by hand ' || lei END AS note FROM outcomes""")
def outcomes_by_override_files(spark, d):
    """Listings resolved with correction files of at most a thousand entities each, written and read back."""
    path = work_path(spark, "overrides")
    rows = _overrides(spark, d).where("exclude OR ticker IS NOT NULL").withColumn("note", F.concat(F.lit("by hand "), "lei"))
    entry = F.struct("lei", F.struct("ticker", "exchange", "exclude", "note", "reviewed").alias("o"))
    number = F.substring("lei", 2, 20).cast("bigint")
    rows.groupBy(F.floor(number / 1000).alias("file")).agg(F.map_from_entries(F.collect_list(entry)).alias("overrides")) \
        .select("file", F.to_json(F.struct(F.lit("kept by hand").alias("_comment"), "overrides")).alias("value")) \
        .write.partitionBy("file").text(path)
    read = quotes.read_overrides(spark, f"{path}/*")
    return _resolved(spark, d, read)[1].select("lei", "outcome", "ticker", "exchange").join(read.select("lei", "note"), "lei", "left")


@query(f"""WITH {_RESOLVE_SQL} SELECT lei, 'MANUAL:' || lei AS isin, true AS is_primary, 'manual' AS confidence FROM decided
  WHERE route = 'manual'
UNION ALL SELECT l.lei, isin, coalesce(l.ord = p_ord, false), CASE WHEN coalesce(l.ord = p_ord, false) AND NOT p_home
  THEN 'isin+non_domicile' ELSE 'isin' END
FROM lines l JOIN decided d ON l.lei = d.lei WHERE NOT by_name AND route IN ('isin', 'none')
UNION ALL SELECT l.lei, isin, l.ord = n_ord, CASE WHEN l.ord = n_ord AND NOT n_home THEN 'name+non_domicile'
  ELSE 'name' END
FROM lines l JOIN decided d ON l.lei = d.lei WHERE by_name AND l.ticker IS NOT NULL AND route = 'name'""")
def resolved_listings(spark, d):
    return _resolved(spark, d)[0].select("lei", "isin", "is_primary", "confidence")


@query(f"WITH {_RESOLVE_SQL} SELECT outcome, count(*) AS n FROM outcomes GROUP BY 1")
def listing_outcome_counts(spark, d):
    return identity.outcome_counts(_resolved(spark, d)[1])


@query(f"""WITH {_RESOLVE_SQL} SELECT 'C' || c_custkey AS lei, 'OVR' AS ticker, false AS is_new FROM customer
  WHERE c_mktsegment = 'MACHINERY'
UNION ALL SELECT lei, ticker, true FROM outcomes WHERE outcome IN ('cross_listing_risk', 'domicile')
  AND (outcome <> 'domicile' OR pending)
AND lei NOT IN (SELECT 'C' || c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')""")
def review_stub(spark, d):
    k = F.col("c_custkey")
    existing = table(spark, d, "customer").where(F.col("c_mktsegment") == "MACHINERY").select(
        F.concat(F.lit("C"), k).alias("lei"), F.lit("OVR").alias("ticker"), F.lit("FP").alias("exchange"),
        F.lit(False).alias("exclude"), F.lit("kept").alias("note"), F.lit(None).cast("string").alias("reviewed"))
    stub = identity.review_stub(existing, identity.needs_review(_resolved(spark, d)[1]))
    return stub.select("lei", "ticker", F.col("note").startswith("to review").alias("is_new"))


@query(f"""WITH {_INSTRUMENT_SQL} SELECT ord, CASE exchange {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in spec.VENUE_TO_MIC.items())} END AS mic,
CASE exchange {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in spec.VENUE_TO_SUFFIX.items())} END AS quote_suffix FROM ins""")
def venue_codes(spark, d):
    return identity.add_venue_codes(_instruments(spark, d)).select("ord", "mic", "quote_suffix")


@query(f"""WITH {_INSTRUMENT_SQL}, k AS (SELECT *,
  coalesce(CASE WHEN ord % 3 > 0 THEN 'F' || (ord % 4) END, isin || ':' || coalesce(exchange, '?')) AS f2
  FROM ins WHERE o_custkey % 3 > 0),
new AS (SELECT lei, f2 AS figi, isin FROM k QUALIFY row_number() OVER (PARTITION BY lei, f2 ORDER BY ord DESC) = 1)
SELECT * FROM new UNION ALL SELECT lei, 'S' || ord, isin FROM ins WHERE o_custkey % 3 = 0""")
def replaced_listings(spark, d):
    ins = _instruments(spark, d).withColumn("figi", F.when(F.col("ord") % 3 > 0, F.concat(
        F.lit("F"), (F.col("ord") % 4).cast("string"))))
    stored = ins.select("lei", F.concat(F.lit("S"), F.col("ord")).alias("figi"), "isin")
    incoming = ins.where(F.substring("lei", 2, 20).cast("bigint") % 3 > 0)
    return store.replace_listings(stored, incoming, [F.col("ord")])


@query("SELECT round(arg_max(value, event_id) / 100, 8) AS value, arg_max(ts::DATE, event_id)::VARCHAR AS as_of, 'ok' AS status FROM events")
def riskfree_from_files(spark, d):
    """The last observation of rate files that Spark has written in id order, read back by the reader."""
    path = work_path(spark, "rates")
    table(spark, d, "events").repartitionByRange(4, "event_id").sortWithinPartitions("event_id").select(
        F.col("value").cast("string").alias("OBS_VALUE"), F.to_date("ts").cast("string").alias("TIME_PERIOD")) \
        .write.csv(path, header=True)
    return parameters.riskfree_from_series(records.read_rate_series(spark, path)).withColumn("value", F.round("value", 8))


# -- quotes: events, entities are users ------------------------------------------------

def _quotes(spark, d):
    e = table(spark, d, "events")
    currency = F.when(F.col("event_type") == "signup", "usd").when(F.col("event_type") == "view", "eur").otherwise("EUR")
    return e.select(
        F.concat(F.lit("U"), "user_id").alias("lei"), F.to_date("ts").alias("as_of"), F.col("ts").alias("seen"),
        "event_id", F.when(F.col("event_id") % 29 == 0, 0.0).otherwise(F.col("value")).alias("price"),
        currency.alias("currency"), F.when(F.col("event_id") % 31 == 0, "HTTP 404").otherwise("ok").alias("status"))


_QUOTE_SQL = f"""q AS (SELECT 'U' || user_id AS lei, ts::DATE AS as_of, ts AS seen, event_id,
  CASE WHEN event_id % 29 = 0 THEN 0 ELSE value END AS price, CASE event_type WHEN 'signup' THEN 'USD'
  ELSE 'EUR' END AS currency,
  CASE WHEN event_id % 31 = 0 THEN 'HTTP 404' ELSE 'ok' END AS status FROM events),
g AS (SELECT *, CASE WHEN status <> 'ok' THEN 'fetch_failed' WHEN currency <> 'EUR' THEN 'wrong_currency'
  WHEN price <= 0 THEN 'zero_price' ELSE 'ok' END AS outcome, DATE '{TODAY}' - as_of > 7 AS old FROM q),
price AS (SELECT lei, as_of, price FROM g WHERE outcome = 'ok'
  QUALIFY row_number() OVER (PARTITION BY lei, as_of ORDER BY seen DESC, event_id DESC) = 1)"""


def _today():
    return F.lit(TODAY).cast("date")


@query(f"WITH {_QUOTE_SQL} SELECT event_id, outcome, outcome = 'ok' AND old AS stale FROM g")
def gated_quotes(spark, d):
    return quotes.gate_quotes(_quotes(spark, d), _today()).select("event_id", "outcome", "stale")


@query(f"""WITH {_QUOTE_SQL} SELECT outcome, count(*) AS n FROM (SELECT outcome FROM g UNION ALL
SELECT 'stale' FROM g WHERE outcome = 'ok' AND old) GROUP BY 1""")
def gate_counts(spark, d):
    return quotes.gate_counts(quotes.gate_quotes(_quotes(spark, d), _today()))


def prices(spark, d):
    good = quotes.gate_quotes(_quotes(spark, d), _today()).where("outcome = 'ok'")
    return store.last_write(good.select("lei", "as_of", "price", "seen", "event_id"), ["lei", "as_of"],
                            [F.col("seen"), F.col("event_id")]).select("lei", "as_of", "price")


@query(f"WITH {_QUOTE_SQL} SELECT lei, as_of, price FROM price QUALIFY row_number() OVER (PARTITION BY lei ORDER BY as_of DESC) = 1")
def latest_price(spark, d):
    return store.latest_price(prices(spark, d))


@query(f"WITH {_QUOTE_SQL} SELECT lei, as_of, price FROM price")
def price_history(spark, d):
    return store.price_history(prices(spark, d))


@query("""SELECT 'U' || user_id AS lei, ts::DATE AS as_of, value AS price, CASE event_type WHEN 'signup' THEN 'quoted in USD'
ELSE 'ok' END AS status FROM events WHERE event_type NOT IN ('click', 'error') AND value > 0""")
def quote_history_arrays(spark, d):
    seconds = F.unix_timestamp("ts")
    close = F.when(F.col("event_type") == "click", None).when(F.col("event_type") == "error", "n/a").otherwise(F.col("value").cast("string"))
    body = F.to_json(F.struct(F.struct(F.array(F.struct(
        F.struct(F.when(F.col("event_type") == "signup", "usd").otherwise("eur").alias("currency")).alias("meta"),
        F.array(seconds).alias("timestamp"),
        F.struct(F.array(F.struct(F.array(close).alias("close"))).alias("quote")).alias("indicators"))).alias("result")).alias("chart")))
    payloads = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).select(
        F.concat(F.lit("U"), "user_id").alias("lei"), body.alias("body"))
    return quotes.quote_history(payloads)


@query("""SELECT 'U' || user_id AS lei, CASE WHEN event_type <> 'error' THEN value END AS price, 'EUR' AS currency,
CASE WHEN event_type = 'click' THEN DATE '2024-01-31' ELSE ts::DATE END AS as_of,
CASE WHEN event_type = 'error' THEN 'unparseable response' ELSE 'ok' END AS status FROM events""")
def single_quotes(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    meta = F.struct(F.when(F.col("event_type") != "error", F.col("value")).alias("regularMarketPrice"),
                    F.lit("EUR").alias("currency"),
                    F.when(F.col("event_type") != "click", F.unix_timestamp("ts")).alias("regularMarketTime"))
    body = F.to_json(F.struct(F.struct(F.array(F.struct(meta.alias("meta"))).alias("result")).alias("chart")))
    return quotes.single_quotes(e.select(F.concat(F.lit("U"), "user_id").alias("lei"), body.alias("body")), _today())


@query("""SELECT 'U' || user_id AS lei, arg_max(value, event_id) AS price, arg_max(CASE event_type WHEN 'signup' THEN 'USD'
  ELSE 'EUR' END, event_id) AS currency,
arg_max(CASE WHEN event_type = 'click' THEN DATE '2024-01-31' ELSE ts::DATE END, event_id) AS as_of FROM events
  GROUP BY user_id""")
def price_file_rows(spark, d):
    e = table(spark, d, "events")
    raw = e.select(
        F.concat(F.lit(" U"), "user_id").alias("lei"), F.col("value").cast("string").alias("price"),
        F.when(F.col("event_type") == "signup", " usd ").otherwise("eur").alias("currency"),
        F.when(F.col("event_type") == "click", "").otherwise(F.to_date("ts").cast("string")).alias("as_of"),
        F.col("event_id").alias("ord"))
    return quotes.price_rows(raw, _today()).drop("symbol")


@query("SELECT 'D' || doc_id AS lei, source || '-' || i AS isin FROM documents, (VALUES (0), (1)) t(i) WHERE NOT (i = 1 AND lang = 'en')")
def registry_identifiers(spark, d):
    body = F.to_json(F.struct(F.array(
        F.struct(F.struct(F.concat("source", F.lit("-0")).alias("isin")).alias("attributes")),
        F.struct(F.struct(F.when(F.col("lang") != "en", F.concat("source", F.lit("-1"))).alias("isin")).alias("attributes"))).alias("data")))
    docs = table(spark, d, "documents").select(F.concat(F.lit("D"), "doc_id").alias("lei"), body.alias("body"))
    return quotes.identifiers(docs)


@query("SELECT 'D' || doc_id AS lei, source AS isin, 'F' || doc_id AS figi, lang AS exchange, 'Equity' AS market_sector FROM documents WHERE doc_id % 5 > 1")
def instrument_answers(spark, d):
    row = F.struct(F.concat(F.lit("F"), "doc_id").alias("figi"), F.col("lang").alias("exchCode"), F.lit("Equity").alias("marketSector"))
    body = F.when(F.col("doc_id") % 5 == 0, F.to_json(F.struct(F.lit("no match").alias("error")))) \
        .when(F.col("doc_id") % 5 == 1, F.lit('{"data": []}')).otherwise(F.to_json(F.struct(F.array(row).alias("data"))))
    docs = table(spark, d, "documents").select(F.concat(F.lit("D"), "doc_id").alias("lei"), F.col("source").alias("isin"), body.alias("body"))
    return quotes.instruments(docs).select("lei", "isin", "figi", "exchange", "market_sector")


# -- shares: one company per order ---------------------------------------------------

def _share_rows(spark, d):
    k = F.col("o_orderkey")
    total = F.col("o_totalprice")
    return table(spark, d, "orders").select(
        F.concat(F.lit("O"), k).alias("lei"), F.concat(F.lit("N"), k).alias("name"),
        F.when(k % 23 > 0, F.concat(F.lit("T"), k)).alias("ticker"), F.lit("FP").alias("exchange"),
        F.when(k % 19 > 0, total / 1000).alias("price"), F.when(k % 21 > 0, total * 1000).alias("revenue"),
        F.when(k % 7 > 0, (k % 1000 - 20) * 40000.5).alias("wavg_diluted"), ((k % 900) * 30000.0).alias("wavg_basic"),
        F.when(k % 4 == 0, (k % 1000 - 20) * 40000.0).alias("current_shares"),
        F.when(k % 4 == 0, F.when(k % 8 == 0, "manual").otherwise("eps-derived")).alias("current_source"))


_SHARE_SQL = """s AS (SELECT 'O' || o_orderkey AS lei, o_orderkey AS k, 'N' || o_orderkey AS name, o_orderkey % 23 > 0 AS listed,
  CASE WHEN o_orderkey % 19 > 0 THEN o_totalprice / 1000 END AS price, CASE WHEN o_orderkey % 21 > 0
  THEN o_totalprice * 1000 END AS revenue,
  CASE WHEN o_orderkey % 7 > 0 THEN (o_orderkey % 1000 - 20) * 40000.5::DOUBLE END AS wavg_diluted, (o_orderkey % 900) * 30000.0::DOUBLE AS wavg_basic,
  CASE WHEN o_orderkey % 4 = 0 THEN (o_orderkey % 1000 - 20) * 40000.0::DOUBLE END AS current_shares,
  CASE WHEN o_orderkey % 4 = 0 THEN (CASE WHEN o_orderkey % 8 = 0 THEN 'manual'
  ELSE 'eps-derived' END) END AS current_source FROM orders),
w AS (SELECT *, coalesce(nullif(wavg_diluted, 0), wavg_basic) AS derived,
  coalesce(derived > 0 AND price * derived / revenue BETWEEN 0.05 AND 30, false) AS good FROM s WHERE listed)"""


@query(f"""WITH {_SHARE_SQL} SELECT lei, derived, CASE WHEN good THEN derived END AS usable,
round_even(coalesce(current_shares, CASE WHEN good THEN derived END), 0) AS shares,
coalesce(current_source, CASE WHEN good THEN 'eps-derived' END) AS source,
round(CASE WHEN good THEN price * derived / revenue END, 3) AS implied_cap_rev,
CASE WHEN NOT good AND current_shares IS NULL THEN 'FILL IN' ELSE '' END AS note FROM w""")
def share_worksheet(spark, d):
    return shares.export_order(shares.worksheet(_share_rows(spark, d))).select(
        "lei", "derived", "usable", "shares", "source", F.round("implied_cap_rev", 3).alias("implied_cap_rev"), "note")


@query(f"""WITH {_SHARE_SQL} SELECT lei, DATE '{TODAY}' AS as_of, derived AS shares FROM w WHERE good AND (current_shares IS NULL
OR (current_source = 'eps-derived' AND round_even(current_shares, 0) <> round_even(derived, 0)))""")
def seeded_share_counts(spark, d):
    return shares.seed_derived(shares.worksheet(_share_rows(spark, d)), _today()).select("lei", "as_of", "shares")


@query(f"""WITH {_SHARE_SQL} SELECT lei, round(price * wavg_diluted / revenue, 3) AS cap_revenue,
CASE WHEN wavg_diluted <= 0 OR NOT wavg_diluted BETWEEN 1e5 AND 1e11 THEN 'shares_unusable'
WHEN NOT price * wavg_diluted / revenue BETWEEN 0.05 AND 30 THEN 'out_of_band' ELSE 'ok' END AS finding
FROM s WHERE price IS NOT NULL AND coalesce(wavg_diluted, 0) <> 0 AND coalesce(revenue, 0) <> 0""")
def market_cap_sanity(spark, d):
    return shares.market_cap_sanity(_share_rows(spark, d)).withColumn("cap_revenue", F.round("cap_revenue", 3))


def _imports(spark, d):
    rows = _share_rows(spark, d)
    k = F.substring("lei", 2, 20).cast("bigint")
    typed = F.when(k % 12 == 0, "").when(k % 12 == 1, "n/a").when(k % 12 == 2, "-5") \
        .when(k % 12 < 6, F.format_string("%,d", (k % 1000 - 20) * 40000)).otherwise(((k % 1000) * 38000).cast("string"))
    return shares.classify_import(rows.withColumns({
        "shares": typed, "source": F.when(k % 12 == 3, "eps-derived").otherwise(""), "note": F.lit(" x ")}))


_IMPORT_SQL = f"""{_SHARE_SQL}, i AS (SELECT *, coalesce(nullif(wavg_diluted, 0), wavg_basic) AS derived,
  CASE WHEN k % 12 = 2 THEN -5 WHEN k % 12 IN (3, 4, 5) THEN (k % 1000 - 20) * 40000 WHEN k % 12 > 5
  THEN (k % 1000) * 38000 END::DOUBLE AS n,
  CASE WHEN k % 12 = 3 THEN 'eps-derived' ELSE 'manual' END AS origin FROM s),
r AS (SELECT lei, n, origin, CASE WHEN k % 12 = 0 THEN 'blank' WHEN k % 12 = 1 THEN 'not_a_number' WHEN n <= 0
  THEN 'not_positive'
  WHEN coalesce(round(current_shares) = round(n) AND current_source = origin, false) THEN 'unchanged'
  WHEN NOT coalesce(price * n / revenue BETWEEN 0.05 AND 30, true) THEN 'out_of_band'
  WHEN derived > 0 AND abs(n - derived) / n > 0.05 THEN 'stored_with_warning' ELSE 'stored' END AS outcome FROM i)"""


@query(f"WITH {_IMPORT_SQL} SELECT lei, outcome FROM r")
def share_import_outcomes(spark, d):
    return _imports(spark, d).select("lei", "outcome")


@query(f"""WITH {_IMPORT_SQL} SELECT count(*) FILTER (outcome LIKE 'stored%') AS stored,
  count(*) FILTER (outcome = 'unchanged') AS unchanged,
count(*) FILTER (outcome = 'blank') AS blank,
  count(*) FILTER (outcome IN ('not_a_number', 'not_positive', 'out_of_band')) AS rejected,
count(*) FILTER (outcome = 'stored_with_warning') AS warned FROM r""")
def share_import_counts(spark, d):
    return shares.import_counts(_imports(spark, d))


@query(f"WITH {_IMPORT_SQL} SELECT lei, n AS shares, origin AS source, 'x' AS note FROM r WHERE outcome LIKE 'stored%'")
def imported_share_counts(spark, d):
    return shares.imported_rows(_imports(spark, d), _today()).drop("as_of")


# -- parameter sheets: cells out of nation, customer and part ----------------------------

_ALIASES = tuple(spec.COUNTRY_ALIASES) + ("atlantis",)
_COUNTRY_HEAD = ("Notes", "Country", "Rating", "Country Risk Premium", "Total Equity Risk Premium")


def _cells(spark, d):
    """The sheets' cells, written once for all queries of an application."""
    return stored(spark, "cells", d, lambda: _made_cells(spark, d))


def _made_cells(spark, d):
    """The sheet cells as a stored table: every sheet reads it several times."""
    region, nation = table(spark, d, "region"), table(spark, d, "nation")
    c, p = table(spark, d, "customer"), table(spark, d, "part")
    none, num = F.lit(None).cast("double"), lambda c: c.cast("double")
    cell = lambda df, file, sheet, row, col, txt, number: df.select(
        F.lit(file).alias("file"), F.lit(sheet).alias("sheet"), row.cast("int").alias("row"), col.cast("int").alias("col"),
        txt.cast("string").alias("text"), number.alias("number"))
    parts = []
    rk, nk = F.col("r_regionkey"), F.col("n_nationkey")
    parts.append(cell(region, "ctryprem", "ERPs by country", F.lit(7), rk, pick(_COUNTRY_HEAD, rk), none))
    per = c.groupBy("c_nationkey").agg(F.sum(F.col("c_acctbal").cast("decimal(18,2)")).cast("double").alias("s"), F.count(F.lit(1)).alias("n"))
    nat = nation.join(per, nk == F.col("c_nationkey"))
    crp = F.when(nk % 6 == 0, 0.0).otherwise(F.col("n") % 50 / 1000)
    row = nk + 8
    for col, txt, number in ((1, pick(_ALIASES, nk % len(_ALIASES)), none), (3, F.lit(None), crp), (4, F.lit(None), crp + 0.0433)):
        parts.append(cell(nat, "ctryprem", "ERPs by country", row, F.lit(col), txt, number))
    parts.append(cell(region, "ctryprem", "Country Tax Rates", F.lit(3), rk, pick(("Country", "x", "Tax Rate 2025", "y", "z"), rk), none))
    parts.append(cell(nat, "ctryprem", "Country Tax Rates", row, F.lit(0), pick(_ALIASES, nk % len(_ALIASES)), none))
    parts.append(cell(nat, "ctryprem", "Country Tax Rates", row, F.lit(2), F.lit(None), F.when(nk % 5 > 0, num(nk % 30) / 100)))
    ind = p.groupBy("p_brand").agg(F.sum(F.col("p_size").cast("bigint")).alias("size"), F.count(F.lit(1)).alias("n"))
    b = F.regexp_extract("p_brand", r"([0-9]+)", 1).cast("int")
    heads = {"betaEurope": ("Industry Name", "Unlevered beta corrected for cash", "Unlevered beta", "x", "y"),
             "EVAEurope": ("Industry Name", "(ROC - Cost of Capital)", "Cost of Capital", "ROC", "EVA"),
             "capexEurope": ("Industry Name", "Net Cap Ex/Sales", "Sales/ Invested Capital", "x", "y"),
             "marginEurope": ("Industry Name", "After-tax margin", "Pre-tax Unadjusted Operating Margin", "x", "y")}
    for i, (file, head) in enumerate(heads.items()):
        at = 3 if file == "EVAEurope" else 2
        parts.append(cell(region, file, "Industry Averages", F.lit(5), rk, pick(head, rk), none))
        parts.append(cell(ind, file, "Industry Averages", b + 10, F.lit(0),
                          F.when(b == 1, "Total Market").otherwise(F.col("p_brand")), none))
        keep = F.when(b % (i + 3) > 0, (F.col("size") % 977 + i) / 100)
        parts.append(cell(ind, file, "Industry Averages", b + 10, F.lit(at), F.lit(None), keep))
        parts.append(cell(ind, file, "Industry Averages", b + 10, F.lit(1), F.lit(None), F.lit(9.99)))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


_COUNTRY_SQL = f"""per AS (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1),
nat AS (SELECT n_nationkey AS k, {sql_list(_ALIASES)}[n_nationkey % {len(_ALIASES)} + 1] AS alias,
  CASE WHEN n_nationkey % 6 = 0 THEN 0 ELSE n % 50 / 1000 END AS crp, CASE WHEN n_nationkey % 5 > 0
  THEN n_nationkey % 30 / 100 END AS tax
  FROM nation JOIN per ON n_nationkey = c_nationkey),
coded AS (SELECT *, CASE alias {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in spec.COUNTRY_ALIASES.items())} END AS iso FROM nat)"""


@query(f"""WITH {_COUNTRY_SQL} SELECT iso, round(arg_max(crp, k), 6) AS crp, round(arg_max(crp + 0.0433, k), 6) AS total_erp
FROM coded WHERE iso IS NOT NULL GROUP BY iso""")
def country_premiums(spark, d):
    out = parameters.percent_guard(parameters.country_premiums(_cells(spark, d)), ["crp", "total_erp"])
    return out.select("iso", F.round("crp", 6).alias("crp"), F.round("total_erp", 6).alias("total_erp"))


@query(f"""WITH {_COUNTRY_SQL} SELECT iso, round(arg_max(tax, k) FILTER (tax IS NOT NULL), 6) AS tax_rate
FROM coded WHERE iso IS NOT NULL GROUP BY iso""")
def country_taxes(spark, d):
    return parameters.country_taxes(_cells(spark, d)).select("iso", F.round("tax_rate", 6).alias("tax_rate"))


@query(f"""WITH {_COUNTRY_SQL}, m AS (SELECT iso, min(k) AS k0, arg_max(crp, k) AS crp FROM coded WHERE iso IS NOT NULL
  GROUP BY iso)
SELECT round(arg_min(crp + 0.0433, k0), 6) AS mature_market_erp FROM m WHERE abs(crp) < 1e-9""")
def mature_premium(spark, d):
    return parameters.mature_premium(parameters.country_premiums(_cells(spark, d))).select(
        F.round("mature_market_erp", 6).alias("mature_market_erp"))


_INDUSTRY_SQL = """ind AS (SELECT p_brand AS name, regexp_extract(p_brand, '([0-9]+)', 1)::INT AS b, sum(p_size)::BIGINT AS size
  FROM part GROUP BY ALL),
merged AS (SELECT name, CASE WHEN b % 3 > 0 THEN round((size % 977) / 100, 6) END AS unlevered_beta,
  CASE WHEN b % 4 > 0 THEN round((size % 977 + 1) / 100, 6) END AS roic, CASE WHEN b % 5 > 0 THEN
  round((size % 977 + 2) / 100, 6) END AS sales_to_capital,
  CASE WHEN b % 6 > 0 THEN round((size % 977 + 3) / 100, 6) END AS ebit_margin FROM ind WHERE b <> 1),
industries AS (SELECT * FROM merged WHERE coalesce(unlevered_beta, roic, sales_to_capital, ebit_margin) IS NOT NULL)"""


def _industries(spark, d):
    return parameters.industry_rows(_cells(spark, d)).select(
        "name", *[F.round(c, 6).alias(c) for c in ("unlevered_beta", "roic", "sales_to_capital", "ebit_margin")])


@query(f"WITH {_INDUSTRY_SQL} SELECT * FROM industries")
def industry_parameters(spark, d):
    return _industries(spark, d)


@query(f"""WITH {_INDUSTRY_SQL}, old AS (SELECT p_type AS name, 1.0::DOUBLE AS unlevered_beta, 0.5::DOUBLE AS roic FROM part
  GROUP BY 1
UNION ALL SELECT name, 7.0, 8.0 FROM ind)
SELECT coalesce(o.name, n.name) AS name, coalesce(n.unlevered_beta, o.unlevered_beta) AS unlevered_beta,
  coalesce(n.roic, o.roic) AS roic,
CASE WHEN coalesce(n.unlevered_beta, n.roic) IS NOT NULL THEN 'sheet' ELSE o.src END AS source
FROM (SELECT *, 'stored' AS src FROM old) o FULL JOIN industries n ON o.name = n.name""")
def merged_industry_parameters(spark, d):
    p = table(spark, d, "part")
    row = lambda df, beta, roic: df.select("name", F.lit(beta).alias("unlevered_beta"), F.lit(roic).alias("roic"),
                                           F.lit("stored").alias("source"), F.lit("2020-01-01").cast("date").alias("as_of"))
    old = row(p.select(F.col("p_type").alias("name")).distinct(), 1.0, 0.5).unionByName(
        row(p.select(F.col("p_brand").alias("name")).distinct(), 7.0, 8.0))
    return parameters.merge_parameters(old, _industries(spark, d), "name", ["unlevered_beta", "roic"], "sheet", _today()).drop("as_of")


@query(f"""WITH {_INDUSTRY_SQL} SELECT 'industries' AS block, count(*) AS total, count(unlevered_beta) AS filled_unlevered_beta,
count(roic) AS filled_roic, count(*) = count(unlevered_beta) AND count(*) = count(roic) AS ready FROM industries""")
def parameter_completeness(spark, d):
    return parameters.parameter_completeness(_industries(spark, d), ["unlevered_beta", "roic"], "industries")


@query("""SELECT CASE WHEN key = 'long_run_nominal_growth' THEN
  coalesce(max(value) FILTER (key = 'risk_free_rate') OVER (), value) ELSE value END AS value, key
FROM (SELECT 'risk_free_rate' AS key, max(o_totalprice) / 1e7 AS value FROM orders UNION ALL
SELECT 'long_run_nominal_growth', 0.5 UNION ALL SELECT 'mature_market_erp', min(o_totalprice) / 1e5 FROM orders)""")
def growth_equals_riskfree(spark, d):
    o = table(spark, d, "orders")
    row = lambda key, v: o.agg(v.alias("value")).select(F.lit(key).alias("key"), "value", F.lit("2024-01-01").alias("as_of"))
    market = row("risk_free_rate", F.max("o_totalprice") / 1e7).unionByName(row("long_run_nominal_growth", F.lit(0.5))) \
        .unionByName(row("mature_market_erp", F.min("o_totalprice") / 1e5))
    return parameters.growth_equals_riskfree(market).drop("as_of")


@query("""SELECT round(arg_max(value, event_id) / 100, 8) AS value, arg_max(ts::DATE, event_id)::VARCHAR AS as_of, 'ok' AS status FROM events""")
def riskfree_from_series(spark, d):
    series = table(spark, d, "events").select(F.col("value").cast("string").alias("OBS_VALUE"),
                                              F.to_date("ts").cast("string").alias("TIME_PERIOD"), F.col("event_id").alias("ord"))
    return parameters.riskfree_from_series(series).withColumn("value", F.round("value", 8))


@query("""SELECT 'B' || (63 + r_regionkey) AS cell, v AS expected, f AS found FROM (SELECT r_regionkey,
[5, 5, 0.12, 0.4, 0.02][r_regionkey + 1]::DOUBLE AS v, [5, 6, 0.12, 0.41, NULL][r_regionkey + 1]::DOUBLE AS f
  FROM region)
WHERE f IS NULL OR abs(f - v) > 1e-9 UNION ALL SELECT 'B' || k, e, NULL
  FROM (VALUES (68, 0.9::DOUBLE), (69, 1), (70, 0.005)) t(k, e)
UNION ALL SELECT 'B63+B64', 10, 11""")
def drifted_constants(spark, d):
    rk = F.col("r_regionkey")
    actual = table(spark, d, "region").select(F.concat(F.lit("B"), (rk + 63).cast("string")).alias("cell"),
                                              pick((5.0, 6.0, 0.12, 0.41), F.least(rk, F.lit(3))).alias("value")) \
        .withColumn("value", F.when(F.col("cell") != "B67", F.col("value")))
    return parameters.drifted_constants(actual)


# -- ladder pages ------------------------------------------------------------------------

def _ladder_pages(spark, d):
    k = F.col("page_id")
    rung = lambda i: F.concat(
        F.lit("<tr class='r'><td>"), (i + k % 7).cast("string"), F.lit("</td><td>x</td><td> R"), i.cast("string"),
        F.lit("/<b>A"), i.cast("string"), F.lit("</b></td>\n<td>"), (20 - i).cast("string"), F.lit("."),
        (k % 90 + 10).cast("string"), F.lit("&nbsp;%</td></tr>"))
    n = F.when(k % 5 == 0, 14).otherwise(15)
    rows = F.array_join(F.transform(F.sequence(F.lit(1), n), rung), "\n")
    head = "<TABLE border=1><tr><th>from</th></tr><tr><td>from</td><td>to</td><td>Rating</td><td>Spread</td></tr>"
    return table(spark, d, "pages").select(
        "page_id", F.concat("html", F.lit(head), rows, F.lit("</TABLE><table><tr><td>9</td><td></td><td>Z/Z</td><td>1%</td></tr></table>")).alias("html"))


_LADDER_SQL = """rungs AS (SELECT page_id, (i + page_id % 7)::DOUBLE AS coverage_from, 'A' || i AS rating, 'R' || i || '/A' || i AS rating_full,
  round_even(((20 - i) || '.' || (page_id % 90 + 10))::DOUBLE / 100, 4) AS spread, CASE WHEN page_id % 5 = 0 THEN 14
  ELSE 15 END AS n
  FROM pages, range(1, 16) t(i) WHERE i < 15 OR page_id % 5 <> 0)"""


@query(f"WITH {_LADDER_SQL} SELECT page_id, coverage_from, rating, rating_full, spread FROM rungs WHERE n = 15")
def ladders_from_pages(spark, d):
    return parameters.accepted_ladders(parameters.ladder_from_html(_ladder_pages(spark, d)))[0]


@query(f"WITH {_LADDER_SQL} SELECT DISTINCT page_id, 14::BIGINT AS n FROM rungs WHERE n = 14")
def refused_ladder_pages(spark, d):
    return parameters.accepted_ladders(parameters.ladder_from_html(_ladder_pages(spark, d)))[1]


def _two_ladders(spark, d):
    rungs = parameters.ladder_from_html(_ladder_pages(spark, d)).select(
        F.col("page_id").cast("string").alias("table"), F.substring("rating", 2, 2).cast("int").alias("row"),
        "coverage_from", "rating", "rating_full", "spread", F.lit(4300.0).alias("cutoff"))
    moved = F.col("row") + F.col("table").cast("int")
    current = rungs.where(F.col("row") < 14).withColumns({
        "coverage_from": F.when(moved % 4 == 0, F.col("coverage_from") + 1).otherwise(F.col("coverage_from")),
        "spread": F.when(moved % 6 == 0, F.col("spread") + 0.001).otherwise(F.col("spread"))})
    return current, rungs


@query(f"""WITH {_LADDER_SQL}, l AS (SELECT *, page_id::VARCHAR AS tbl, substr(rating, 2)::INT AS row FROM rungs)
SELECT tbl AS "table", row, tbl || ' | ' || rating_full || ' | ' || CASE WHEN row >= 14 THEN 'added'
  ELSE concat_ws('; ',
  CASE WHEN (row + page_id) % 4 = 0 THEN 'coverage_from ' || (coverage_from + 1)::DOUBLE || ' to ' || coverage_from::DOUBLE END,
  CASE WHEN (row + page_id) % 6 = 0 THEN 'spread ' || printf('%.4f', spread + 0.001) || ' to ' || printf('%.4f', spread) END) END AS text
FROM l WHERE row >= 14 OR (row + page_id) % 4 = 0 OR (row + page_id) % 6 = 0""")
def ladder_differences(spark, d):
    return parameters.ladder_diff(*_two_ladders(spark, d)).select("table", "row", "text")


@query(f"""WITH {_LADDER_SQL} SELECT page_id::VARCHAR AS "table", substr(rating, 2)::INT AS row, coverage_from, spread, 4300.0::DOUBLE AS cutoff,
'2024-01' AS vintage, '2025-01' AS next_expected FROM rungs""")
def applied_ladder(spark, d):
    current, fetched = _two_ladders(spark, d)
    return parameters.apply_ladder(current, fetched.drop("cutoff"), _today()).drop("rating", "rating_full")


@query(f"""WITH {_LADDER_SQL} SELECT DISTINCT page_id::VARCHAR AS "table", 'wrong number of rows' AS problem FROM rungs
UNION ALL SELECT DISTINCT page_id::VARCHAR, 'thresholds are not ascending' FROM rungs r1
WHERE EXISTS (SELECT 1 FROM range(1, 13) t(i) WHERE (i + r1.page_id) % 4 = 0 AND i < 13 AND
  (i + 1 + (CASE WHEN (i + 1 + r1.page_id) % 4 = 0 THEN 1 ELSE 0 END)) < i + 1)""")
def ladder_shape_problems(spark, d):
    return parameters.ladder_shape_problems(_two_ladders(spark, d)[0])


@query(f"""SELECT c_custkey, CASE WHEN c_acctbal / 2 >= 4300 THEN 'LARGE' ELSE 'SMALL' END AS tbl, r.rating, r.spread FROM customer
JOIN (SELECT * FROM (VALUES {", ".join(f"('{t}', {a}::DOUBLE, '{b}', {s}::DOUBLE)" for t, rungs in spec.LADDERS.items() for a, b, _, s in rungs)})
v(tbl, cov, rating, spread)) r ON r.tbl = CASE WHEN c_acctbal / 2 >= 4300 THEN 'LARGE' ELSE 'SMALL' END
  AND r.cov <= c_acctbal / 500 - 3
QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY cov DESC) = 1""")
def ladder_lookup(spark, d):
    cap, cover = F.col("c_acctbal") / 2, F.col("c_acctbal") / 500 - 3
    return table(spark, d, "customer").select(
        "c_custkey", numbers.credit_table(cap).alias("tbl"), numbers.by_credit_table(cap, cover, "rating").alias("rating"),
        numbers.by_credit_table(cap, cover, "spread").alias("spread"))


# -- classification ------------------------------------------------------------------------

def _classified(spark, d):
    k = F.col("c_custkey")
    lei = F.concat(F.lit("C"), k)
    c = table(spark, d, "customer")
    companies = c.select(lei.alias("lei"), F.when(k % 13 > 0, F.concat(F.lit("T"), (k % 700).cast("string"))).alias("ticker"),
                         F.col("c_name").alias("name"), (F.col("c_acctbal") * 1e6).alias("revenue"))
    mapping = c.where(F.col("c_mktsegment") == "HOUSEHOLD").select(lei.alias("lei"), pick(("Bank (Money Center)", "Machinery", "R.E.I.T. REIT", "", "Retail"), k % 5).alias("industry"))
    excluded = c.where(F.col("c_acctbal") > 9000).select(lei.alias("lei"), F.lit("by hand").alias("reason"))
    return companies, mapping, excluded


_CLASS_SQL = """co AS (SELECT 'C' || c_custkey AS lei, c_custkey AS k, CASE WHEN c_custkey % 13 > 0
  THEN 'T' || (c_custkey % 700) END AS ticker,
  c_name AS name, c_acctbal > 9000 AS out, c_acctbal * 1e6 / 1e6 AS revenue_m, CASE WHEN c_mktsegment = 'HOUSEHOLD'
  THEN ['Bank (Money Center)', 'Machinery', 'R.E.I.T. REIT', '', 'Retail'][(c_custkey % 5 + 1)::INT] END AS industry
  FROM customer),
un AS (SELECT * FROM co WHERE ticker IS NOT NULL AND coalesce(industry, '') = '' AND NOT out)"""


@query(f"WITH {_CLASS_SQL} SELECT lei, ticker, round(revenue_m, 4) AS revenue_m FROM un")
def unmapped_companies(spark, d):
    return parameters.unmapped(*_classified(spark, d)).select("lei", "ticker", F.round("revenue_m", 4).alias("revenue_m"))


@query(f"WITH {_CLASS_SQL} SELECT lei, coalesce(ticker, lei) AS ticker, name, industry FROM co WHERE regexp_matches(lower(industry), 'bank|insur|brokerage|investment|reit|real estate|financial')")
def excluded_type_audit(spark, d):
    companies, mapping, _ = _classified(spark, d)
    return parameters.excluded_type_audit(mapping, companies)


def _replies(spark, d):
    k = F.col("p_partkey")
    key = F.when(k % 11 == 0, F.concat(F.lit("C"), (k % 900).cast("string"))).otherwise(F.concat(F.lit("t"), (k % 900).cast("string")))
    answer = F.when(k % 3 == 0, F.lower("p_brand")).when(k % 7 == 0, F.lit("zzz unknown")).otherwise(F.col("p_brand"))
    gap = pick((" | ", "\t", " ; ", "   ", " "), k % 5)
    return table(spark, d, "part").select("p_partkey", F.when(k % 17 == 0, "").otherwise(
        F.concat(pick(("- ", "* ", "", "  "), k % 4), key, gap, answer, F.lit(" "))).alias("line"))


_REPLY_SQL = """re AS (SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN 'C' ELSE 't' END || (p_partkey % 900) AS key,
  CASE WHEN p_partkey % 3 = 0 THEN lower(p_brand) WHEN p_partkey % 7 = 0 THEN 'zzz unknown' ELSE p_brand END AS answer
  FROM part WHERE p_partkey % 17 > 0 AND p_partkey % 5 <> 4)"""


@query(f"WITH {_REPLY_SQL} SELECT * FROM re")
def reply_lines(spark, d):
    return parameters.parse_replies(_replies(spark, d))


@query(f"""WITH {_REPLY_SQL}, {_CLASS_SQL}, {_INDUSTRY_SQL}, bt AS (SELECT upper(ticker) AS t, arg_min(lei, (revenue_m, lei)) AS lei FROM un GROUP BY 1),
m AS (SELECT re.*, coalesce(bt.lei, un.lei) AS lei, i.name AS ok FROM re LEFT JOIN bt ON upper(key) = t LEFT
  JOIN un ON un.lei = key
LEFT JOIN industries i ON i.name = answer)
SELECT p_partkey, key, answer, lei, CASE WHEN lei IS NULL THEN 'unknown' WHEN ok IS NULL THEN 'rejected'
  ELSE 'stored' END AS outcome,
CASE WHEN lei IS NOT NULL AND ok IS NULL THEN (SELECT min(name) FROM industries
  WHERE contains(lower(name), lower(answer)[1:6])) END AS suggestion FROM m""")
def classified_replies(spark, d):
    return parameters.match_replies(parameters.parse_replies(_replies(spark, d)), parameters.unmapped(*_classified(spark, d)), _industries(spark, d))


@query(f"""WITH {_REPLY_SQL}, {_CLASS_SQL}, {_INDUSTRY_SQL}, bt AS (SELECT upper(ticker) AS t, min(lei) AS lei FROM un GROUP BY 1)
SELECT CASE WHEN coalesce(bt.lei, un.lei) IS NULL THEN 'unknown' WHEN i.name IS NULL THEN 'rejected'
  ELSE 'stored' END AS outcome, count(*) AS n
FROM re LEFT JOIN bt ON upper(key) = t LEFT JOIN un ON un.lei = key LEFT JOIN industries i ON i.name = answer GROUP BY 1""")
def reply_counts(spark, d):
    return parameters.reply_counts(parameters.match_replies(
        parameters.parse_replies(_replies(spark, d)), parameters.unmapped(*_classified(spark, d)), _industries(spark, d)))


@query(f"""WITH {_CLASS_SQL} SELECT 'mapping' AS t, lei FROM co WHERE industry <> 'Machinery'
UNION ALL SELECT 'excluded', lei FROM co WHERE out OR industry = 'Machinery'""")
def excluded_companies(spark, d):
    companies, mapping, excluded = _classified(spark, d)
    out = mapping.where(F.col("industry") == "Machinery").select("lei")
    m, x = parameters.exclude_companies(mapping, excluded, out, "Excluded business type")
    return m.select(F.lit("mapping").alias("t"), "lei").unionByName(x.select(F.lit("excluded").alias("t"), "lei"))


@query(f"WITH {_CLASS_SQL} SELECT lei FROM co WHERE out AND revenue_m <= 9500")
def included_companies(spark, d):
    companies, _, excluded = _classified(spark, d)
    back = companies.where(F.col("revenue") > 9.5e9).select("lei")
    return parameters.include_companies(excluded, back).select("lei")


@query(f"""WITH {_CLASS_SQL}, e AS (SELECT lei, lei AS key FROM co UNION SELECT lei, ticker FROM co WHERE ticker IS NOT NULL),
k AS (SELECT DISTINCT 'T' || (o_custkey % 900) AS key FROM orders) SELECT k.key, min(e.lei) AS lei FROM k LEFT
  JOIN e USING (key) GROUP BY 1""")
def found_entities(spark, d):
    keys = table(spark, d, "orders").select(F.concat(F.lit("T"), (F.col("o_custkey") % 900).cast("string")).alias("key")).distinct()
    return parameters.find_entity(_classified(spark, d)[0], keys)


# -- readiness -----------------------------------------------------------------------------

def _readiness(spark, d):
    companies, mapping, excluded = _classified(spark, d)
    k = F.substring("lei", 2, 20).cast("bigint")
    known = _industries(spark, d).select(F.col("name").alias("industry"), F.col("name").alias("known_industry"))
    rows = companies.withColumns({
        "price": F.when(k % 6 > 0, F.lit(1.0)), "shares": F.when(k % 8 > 0, F.lit(1.0)),
        "industry": F.when(k % 5 == 0, None).when(k % 3 == 0, F.concat(F.lit("Brand#"), (k % 40).cast("string"))).otherwise(F.lit("Brand#2")),
        "country": F.when(k % 14 > 0, F.lit("IT")), "crp": F.when(k % 14 > 0, F.lit(0.01))}).join(known, "industry", "left")
    return policy.readiness(rows), excluded


_READY_SQL = f"""{_CLASS_SQL}, {_INDUSTRY_SQL}, r0 AS (SELECT co.lei, co.k, co.ticker, co.out, CASE WHEN k % 5 = 0 THEN NULL
  WHEN k % 3 = 0 THEN 'Brand#' || (k % 40) ELSE 'Brand#2' END AS ind FROM co),
r AS (SELECT r0.*, i.name IS NOT NULL AS known FROM r0 LEFT JOIN industries i ON i.name = r0.ind),
gaps AS (SELECT lei, 'listing' AS gap FROM r WHERE ticker IS NULL UNION ALL SELECT lei, 'price' FROM r
  WHERE k % 6 = 0 UNION ALL SELECT lei, 'shares' FROM r WHERE k % 8 = 0
 UNION ALL SELECT lei, 'industry' FROM r WHERE ind IS NULL UNION ALL
  SELECT lei, 'industry without values: ' || ind FROM r WHERE ind IS NOT NULL AND NOT known
 UNION ALL SELECT lei, 'country without values: unknown' FROM r WHERE k % 14 = 0)"""


@query(f"WITH {_READY_SQL} SELECT lei, gap FROM gaps")
def readiness_gaps(spark, d):
    return _readiness(spark, d)[0].select("lei", F.explode("gaps").alias("gap"))


@query(f"WITH {_READY_SQL} SELECT split_part(gap, ' ', 1) AS gap, count(*) AS n FROM gaps GROUP BY 1")
def readiness_gap_counts(spark, d):
    return policy.gap_counts(_readiness(spark, d)[0])


@query(f"WITH {_READY_SQL} SELECT gap, count(*) AS n FROM gaps GROUP BY 1")
def readiness_gap_texts(spark, d):
    return policy.gap_text_counts(_readiness(spark, d)[0])


@query(f"WITH {_READY_SQL} SELECT lei FROM r WHERE NOT out AND NOT EXISTS (SELECT 1 FROM gaps g WHERE g.lei = r.lei)")
def eligible_companies(spark, d):
    checked, excluded = _readiness(spark, d)
    return policy.eligible(checked, excluded).select("lei")


@query(f"""WITH {_READY_SQL} SELECT count(*) AS entities, count(ticker) AS listings, count(*) FILTER (k % 6 > 0) AS priced,
  count(*) FILTER (k % 8 > 0) AS with_shares,
count(ind) AS mapped, count(*) FILTER (NOT EXISTS (SELECT 1 FROM gaps g WHERE g.lei = r.lei)) AS ready FROM r""")
def stage_counts(spark, d):
    return health.stage_counts(_readiness(spark, d)[0])
