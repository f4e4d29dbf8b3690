"""The streaming jobs on the events table, read as a file stream."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from accountloom import spec
from accountloom.bindings.base import table
from accountloom.bindings.company_queries import _QUOTE_SQL, TODAY
from accountloom.bindings.run_queries import ORACLE as RUN_ORACLE
from accountloom.bindings.run_queries import _run_quotes, _runs
from accountloom.session import shared_folder
from accountloom.sources import quotes
from accountloom.streaming import daily

QUERIES, ORACLE = {}, {}
ORACLE_POSITIONS = RUN_ORACLE["position_events"]


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn
    return register


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def _event_stream(spark, d):
    return daily.read_stream(spark, d, table(spark, d, "events").schema, glob="events.parquet")


def _quotes(e):
    currency = F.when(F.col("event_type") == "signup", "USD").otherwise("EUR")
    return e.select(
        F.concat(F.lit("U"), "user_id").alias("lei"), F.to_date("ts").alias("as_of"),
        F.struct("ts", "event_id").alias("fetched_at"),
        F.when(F.col("event_id") % 29 == 0, 0.0).otherwise(F.col("value")).alias("price"), currency.alias("currency"),
        F.when(F.col("event_id") % 31 == 0, "HTTP 404").otherwise("ok").alias("status"))


@query(f"WITH {_QUOTE_SQL} SELECT lei, as_of, price, DATE '{TODAY}' - as_of > 7 AS stale FROM price")
def streamed_prices(spark, d):
    folder = _folder(spark)
    today = F.lit(TODAY).cast("date")
    daily.store_prices(_quotes(_event_stream(spark, d)), today, f"{folder}/prices", f"{folder}/checkpoint").awaitTermination()
    return daily.stored_prices(spark, f"{folder}/prices")


@query(f"""WITH {_QUOTE_SQL}, t AS (SELECT 'U' || user_id AS lei, max(value) / 3 AS trigger_price,
  max(value) / 2.5 AS watch_price FROM events GROUP BY user_id)
SELECT g.lei, as_of, CASE WHEN price <= trigger_price THEN 'crossed' ELSE 'approaching' END AS status, count(*) AS n
FROM g JOIN t ON g.lei = t.lei WHERE outcome = 'ok' AND price <= watch_price GROUP BY ALL""")
def streamed_price_watch(spark, d):
    folder = _folder(spark)
    e = table(spark, d, "events")
    triggers = e.groupBy("user_id").agg(F.max("value").alias("top")).select(
        F.concat(F.lit("U"), "user_id").alias("lei"), F.lit("T").alias("ticker"), F.lit(spec.FAIRLY_VALUED).alias("verdict"),
        F.lit(1.0).alias("price"), (F.col("top") / 3).alias("trigger_price"), (F.col("top") / 2.5).alias("watch_price"))
    gated = quotes.gate_quotes(_quotes(_event_stream(spark, d)), F.lit(TODAY).cast("date")).where("outcome = 'ok'")
    hits = daily.watch_stream(gated, triggers)
    daily.run_available(hits, f"{folder}/hits", f"{folder}/checkpoint").awaitTermination()
    out = spark.read.schema(hits.schema).parquet(f"{folder}/hits")
    return out.groupBy("lei", F.col("price_as_of").alias("as_of"), "status").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_QUOTE_SQL} SELECT lei, as_of, price, DATE '{TODAY}' - as_of > 7 AS stale FROM price")
def streamed_fresh_days(spark, d):
    """Every company and day once, with the price of its newest fetch."""
    folder = _folder(spark)
    fresh = daily.fresh_stream(_quotes(_event_stream(spark, d)), F.lit(TODAY).cast("date"))
    daily.store_fresh(fresh, f"{folder}/fresh", f"{folder}/checkpoint").awaitTermination()
    return daily.stored_prices(spark, f"{folder}/fresh")


def _overlapping_files(spark, d, folder):
    """Files for every four days, in the order of the days; each day comes in the files of the next four as well.

    Every turn is written by as many tasks as the table has splits and without a sort, so files, and what a
    task holds, stay of one size however large the table is. The turns go one after another: a stream takes
    files by their age, and a turn that came too late would be dropped.
    """
    e = table(spark, d, "events")
    turn = F.floor(F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) / 4)
    span = e.agg(F.min(turn).alias("first"), F.max(turn).alias("last")).first()
    turns = range(span["first"], span["last"] + 2) if span["first"] is not None else ()
    for n in turns:
        e.where(turn.isin(n, n - 1)).write.parquet(f"{folder}/turn={n}")
    return e.schema


@query(f"""WITH {_QUOTE_SQL} SELECT p.lei, p.as_of, p.price, DATE '{TODAY}' - p.as_of > 7 AS stale, count(*) AS fetches
FROM price p JOIN g ON (p.lei, p.as_of) = (g.lei, g.as_of) AND g.outcome = 'ok' GROUP BY ALL""")
def streamed_unique_prices(spark, d):
    """Overlapping files, two in a batch: what the last turn of a batch brought comes again in a later one."""
    folder = _folder(spark)
    schema = _overlapping_files(spark, d, f"{folder}/files")
    stream = daily.read_stream(spark, f"{folder}/files/turn=*", schema, files_per_batch=2)
    unique = daily.unique_stream(_quotes(stream), F.lit(TODAY).cast("date"))
    daily.store_unique(unique, f"{folder}/unique", f"{folder}/checkpoint").awaitTermination()
    return daily.stored_prices(spark, f"{folder}/unique").join(
        daily.stored_fetches(spark, f"{folder}/unique"), ["lei", "as_of"])


@query(ORACLE_POSITIONS)
def streamed_positions(spark, d):
    """Same entries and exits as ``position_events``, kept by the stateful stream."""
    folder = _folder(spark)
    rows = daily.position_input(_runs(spark, d), _run_quotes(spark, d))
    rows.write.parquet(f"{folder}/rows")
    stream = daily.position_stream(daily.read_stream(spark, f"{folder}/rows", rows.schema))
    daily.run_available(stream, f"{folder}/events", f"{folder}/checkpoint").awaitTermination()
    out = daily.standing_events(spark.read.schema(daily.EVENTS).parquet(f"{folder}/events"))
    return out.select("lei", F.col("day").alias("at"), "side", "event", "price")
