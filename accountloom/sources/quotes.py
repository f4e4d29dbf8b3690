"""Price files, quote answers and identifier answers as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from accountloom import spec
from accountloom.functions import dates, numbers, ordered, text

CHART = ("chart STRUCT<result: ARRAY<STRUCT<meta: STRUCT<regularMarketPrice: DOUBLE, currency: STRING, "
         "regularMarketTime: BIGINT>, timestamp: ARRAY<BIGINT>, indicators: STRUCT<quote: "
         "ARRAY<STRUCT<close: ARRAY<STRING>>>>>>>")
FIGI = ("STRUCT<error: STRING, data: ARRAY<STRUCT<figi: STRING, ticker: STRING, exchCode: STRING, "
        "name: STRING, marketSector: STRING, securityType: STRING, securityType2: STRING>>>")


def require_columns(names: list[str], needed: list[str]) -> None:
    """A missing currency column must fail before anything is read."""
    missing = [c for c in needed if c not in names]
    if missing:
        raise ValueError(f"price file lacks column(s) {', '.join(missing)}; a currency is never assumed")


def read_price_csv(spark: SparkSession, path: str, today: Column) -> DataFrame:
    """Hand-made price files: the last row of an entity wins."""
    raw = spark.read.csv(path, header=True, encoding="UTF-8")
    raw = raw.toDF(*[c.lstrip("﻿") for c in raw.columns])
    require_columns(raw.columns, ["lei", "price", "currency"])
    at = F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"),
                  F.monotonically_increasing_id().alias("n"))
    return price_rows(raw.withColumn("ord", at), today)


def price_rows(raw: DataFrame, today: Column) -> DataFrame:
    """Trimmed and typed price rows, the last one written per entity."""
    get = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) if c in raw.columns else F.lit("")
    rows = raw.select(
        get("lei").alias("lei"), numbers.parse_number(get("price")).alias("price"),
        F.upper(get("currency")).alias("currency"),
        F.coalesce(dates.iso_date(text.blank_to_null(get("as_of"))), F.when(get("as_of") == "", today)).alias("as_of"),
        text.blank_to_null(get("ticker")).alias("symbol"), "ord").where(F.col("lei") != "")
    return ordered.latest(rows, ["lei"], [F.col("ord")], ["price", "currency", "as_of", "symbol"])


def quote_history(payloads: DataFrame, body: str = "body") -> DataFrame:
    """Daily closes out of the parallel arrays of a chart answer; UTC dates.

    Missing, non-numeric and non-positive closes are left out.  ``status`` is ok only for EUR.
    """
    r = F.from_json(body, CHART)["chart"]["result"][0]
    opened = payloads.select(
        "lei", F.upper(F.coalesce(r["meta"]["currency"], F.lit(""))).alias("currency"),
        F.explode(F.arrays_zip(r["timestamp"].alias("ts"), r["indicators"]["quote"][0]["close"].alias("close"))).alias("q"))
    rows = opened.select("lei", "currency", F.to_date(F.timestamp_seconds("q.ts")).alias("as_of"),
                         numbers.parse_number(F.col("q.close")).alias("price"))
    status = F.when(F.col("currency") == "EUR", "ok").otherwise(F.concat(F.lit("quoted in "), "currency"))
    return rows.where(F.col("price") > 0).select("lei", "as_of", "price", status.alias("status"))


def single_quotes(payloads: DataFrame, today: Column, body: str = "body") -> DataFrame:
    """Last price of a chart answer; its day in UTC, or today when it names none."""
    meta = F.from_json(body, CHART)["chart"]["result"][0]["meta"]
    rows = payloads.select("lei", meta.alias("m"))
    status = F.when(F.col("m.regularMarketPrice").isNotNull(), "ok").otherwise("unparseable response")
    return rows.select(
        "lei", F.col("m.regularMarketPrice").alias("price"), F.col("m.currency").alias("currency"),
        F.coalesce(F.to_date(F.timestamp_seconds("m.regularMarketTime")), today).alias("as_of"), status.alias("status"))


def gate_quotes(quotes: DataFrame, today: Column, stale_days: int = spec.QUOTE_MAX_AGE) -> DataFrame:
    """Why a quote is stored or not.  Foreign currencies are rejected, never converted;
    old quotes are stored and flagged; a date that does not parse counts as today's."""
    outcome = (F.when(F.col("status") != "ok", "fetch_failed")
               .when(F.upper(F.coalesce("currency", F.lit(""))) != "EUR", "wrong_currency")
               .when(F.coalesce(F.col("price") <= 0, F.lit(True)), "zero_price").otherwise("ok"))
    age = F.coalesce(F.datediff(today, "as_of"), F.lit(0))
    return quotes.withColumn("outcome", outcome).withColumn(
        "stale", (F.col("outcome") == "ok") & (age > stale_days))


def gate_counts(gated: DataFrame) -> DataFrame:
    """Outcomes of a price fetch; a stale quote counts in both of its classes."""
    return gated.select(F.explode(F.array_compact(F.array(
        F.col("outcome"), F.when(F.col("stale"), F.lit("stale"))))).alias("outcome")) \
        .groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def identifiers(payloads: DataFrame, body: str = "body") -> DataFrame:
    """Security identifiers of each entity out of registry answers."""
    doc = F.from_json(body, "STRUCT<data: ARRAY<STRUCT<attributes: STRUCT<isin: STRING>>>>")
    return payloads.select("lei", F.explode(doc["data"]["attributes"]["isin"]).alias("isin")) \
        .where(F.coalesce("isin", F.lit("")) != "")


def instruments(payloads: DataFrame, body: str = "body") -> DataFrame:
    """Instrument rows per identifier.  An answer with an error is no answer; an empty one
    is a genuine 'not found' and simply yields no rows."""
    doc = F.from_json(body, FIGI)
    opened = payloads.select("lei", "isin", doc.alias("d")).where(F.col("d.error").isNull())
    return opened.select("lei", "isin", F.posexplode("d.data").alias("pos", "r")).select(
        "lei", "isin", F.struct("isin", "pos").alias("ord"), "r.figi", "r.ticker",
        F.col("r.exchCode").alias("exchange"), "r.name", F.col("r.marketSector").alias("market_sector"),
        F.col("r.securityType").alias("security_type"), F.col("r.securityType2").alias("security_type2"))


OVERRIDES = T.StructType([T.StructField("overrides", T.MapType(T.StringType(), T.StructType([
    T.StructField("ticker", T.StringType()), T.StructField("exchange", T.StringType()),
    T.StructField("exclude", T.BooleanType()), T.StructField("note", T.StringType()),
    T.StructField("reviewed", T.StringType())])))])


def read_overrides(spark: SparkSession, path: str) -> DataFrame:
    """The hand-kept file of primary-listing corrections, one row per entity."""
    doc = spark.read.schema(OVERRIDES).json(path, multiLine=True)
    return doc.select(F.explode("overrides").alias("lei", "o")).select("lei", "o.*")
