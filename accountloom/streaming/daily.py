"""The daily price loop as Structured Streaming jobs.

Runs and quotes arrive as files.  Every job can run continuously or, with
``availableNow``, once a day over whatever is new since its checkpoint.
"""

from __future__ import annotations

import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from accountloom import spec
from accountloom.functions import ordered
from accountloom.operators import portfolio
from accountloom.sources import quotes as quote_source

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
WATERMARK = f"{spec.QUOTE_MAX_AGE} days"


def read_stream(spark: SparkSession, path: str, schema, files_per_batch: int | None = None,
                glob: str = "*.parquet") -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


# -- storing branch ----------------------------------------------------------------

def store_prices(stream: DataFrame, today: Column, path: str, checkpoint: str) -> StreamingQuery:
    """Gate incoming quotes and store them all, late ones included and flagged.

    Every batch writes its own folder, overwritten if the batch is repeated, so a lost
    executor or a restart never doubles a row.  ``stored_prices`` reads the newest fetch
    per company and day, which is how a correction replaces an earlier quote.
    """
    def write(batch: DataFrame, number: int) -> None:
        gated = quote_source.gate_quotes(batch, today).where("outcome = 'ok'")
        one = ordered.latest(gated, ["lei", "as_of"], [F.col("fetched_at"), F.col("price")],
                             ["price", "stale", "fetched_at"])
        one.write.mode("overwrite").parquet(f"{path}/batch={number:010d}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint) \
        .trigger(availableNow=True).start()


def stored_prices(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.parquet(path)
    return ordered.latest(rows, ["lei", "as_of"], [F.col("fetched_at"), F.col("batch")], ["price", "stale"])


# -- acting branch -----------------------------------------------------------------

def fresh_stream(stream: DataFrame, today: Column) -> DataFrame:
    """Quotes that may be acted on: gated, at most a week late, the newest fetch per company and day.

    Seven days are the rule for acting on a quote, so they are the watermark: state older than
    that is dropped, and so are quotes that come later.  A later fetch within the week updates
    its company and day; ``store_fresh`` and ``stored_prices`` keep the newest.
    """
    gated = quote_source.gate_quotes(stream, today).where("outcome = 'ok'")
    timed = gated.withColumn("event_time", F.col("as_of").cast("timestamp")).withWatermark("event_time", WATERMARK)
    newest = F.max_by(F.struct("price", "stale", "fetched_at"), F.struct("fetched_at", "price")).alias("won")
    return timed.groupBy("lei", "as_of", "event_time").agg(newest).select("lei", "as_of", "won.*")


def unique_stream(stream: DataFrame, today: Column) -> DataFrame:
    """Good quotes, each fetch once: files that overlap bring the same fetch again.

    A repeat within a week of the newest day is dropped by its key; older state goes with the
    watermark, so its size follows a week of quotes, and quotes that late are not acted on.
    """
    gated = quote_source.gate_quotes(stream, today).where("outcome = 'ok'")
    return gated.withColumn("event_time", F.col("as_of").cast("timestamp")).withWatermark("event_time", WATERMARK) \
        .dropDuplicatesWithinWatermark(["lei", "as_of", "fetched_at", "price"]) \
        .select("lei", "as_of", "price", "stale", "fetched_at")


def store_unique(unique: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Store each batch's fetches with how many came in, one folder per batch; ``stored_prices`` reads the newest."""
    def write(batch: DataFrame, number: int) -> None:
        one = batch.groupBy("lei", "as_of").agg(
            F.max_by(F.struct("price", "stale", "fetched_at"), F.struct("fetched_at", "price")).alias("won"),
            F.count(F.lit(1)).alias("fetches"))
        one.select("lei", "as_of", "won.*", "fetches").write.mode("overwrite").parquet(f"{path}/batch={number:010d}")

    return unique.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored_fetches(spark: SparkSession, path: str) -> DataFrame:
    """How many different fetches every company and day had over all batches."""
    return spark.read.parquet(path).groupBy("lei", "as_of").agg(F.sum("fetches").alias("fetches"))


def store_fresh(fresh: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Store what each batch has updated, one folder per batch."""
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number:010d}")

    return fresh.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint) \
        .trigger(availableNow=True).start()


def watch_stream(quotes: DataFrame, triggers: DataFrame) -> DataFrame:
    """Trigger crossings of each incoming quote against the last run; stream-static join.

    The trigger table has one row per company and is left to the planner's size check.
    """
    return portfolio.price_watch(triggers, quotes)


EVENTS = "lei string, day date, side int, event string, price double, verdict string, revision int"
ROW = ("price double, verdict string, value double, research_flag boolean, void boolean, blocked boolean, "
       "next_run int, delay int")
STATE = ("held int, last_day int, last_side int, next_run int, blocked boolean, void boolean, has_run boolean, "
         "run_value double, live_value double, verdict string, revision int")


def position_input(runs: DataFrame, quotes: DataFrame) -> DataFrame:
    """Run rows and quotes as one stream keyed by company, one row per company, day and kind.

    Every run row carries the date of the following run, joined from the run calendar.
    """
    none = lambda t: F.lit(None).cast(t)
    runs = portfolio.one_per_day(portfolio.with_next_run(runs), "run_date", [F.col("ticker")])
    quotes = portfolio.one_per_day(quotes.select("lei", "as_of", "price", "seen_on"), "as_of", [F.col("seen_on")])
    r = runs.select("lei", F.col("run_date").alias("day"), F.lit(portfolio.RUN_SIDE).alias("side"), "price",
                    "verdict", F.col("value_per_share").alias("value"), "research_flag",
                    (F.col("void") | portfolio.void_text(F.col("verdict"))).alias("void"), "blocked",
                    F.unix_date("next_run").alias("next_run"), none("int").alias("delay"))
    q = quotes.select("lei", F.col("as_of").alias("day"), F.lit(portfolio.QUOTE_SIDE).alias("side"), "price",
                      none("string").alias("verdict"), none("double").alias("value"),
                      none("boolean").alias("research_flag"), none("boolean").alias("void"),
                      none("boolean").alias("blocked"), none("int").alias("next_run"),
                      F.datediff("seen_on", "as_of").alias("delay"))
    return r.unionByName(q).withColumn("day", F.unix_date("day"))


class Positions(StatefulProcessor):
    """State of one company: held or not, what the latest run said, and its rows by day.

    A company has one run row and one quote per day, so its rows are bounded by the calendar.
    New rows are applied in order.  If one of them comes before the newest that was applied,
    the company is worked out again from its rows, and all its events are given anew under
    the next revision; ``standing_events`` reads the last one.
    """

    # Bound here so that the class carries everything a worker needs.
    run_side, max_age = portfolio.RUN_SIDE, spec.QUOTE_MAX_AGE
    enter_above, exit_at = spec.VERDICT_BAND, spec.EXIT_UPSIDE
    undervalued, at_fair_value = spec.UNDERVALUED, spec.EXIT_AT_FAIR_VALUE
    schema, row = STATE, ROW
    blank = (0, -1, -1, None, False, False, False, None, None, None)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("position", self.schema)
        self.rows = handle.getMapState("rows", "day int, side int", self.row)

    def handleInputRows(self, key, rows, timer_values):
        *state, revision = self.state.get() if self.state.exists() else (*self.blank, 0)
        new = {}
        for frame in rows:
            for r in frame.itertuples(index=False):
                row = tuple(None if pd.isna(x) else x for x in (
                    r.price, r.verdict, r.value, r.research_flag, r.void, r.blocked, r.next_run, r.delay))
                new[int(r.day), int(r.side)] = (*row[:6], *[None if x is None else int(x) for x in row[6:]])
        for at, row in new.items():
            self.rows.updateValue(at, row)
        out = []
        if min(new) <= (state[1], state[2]):
            new = {tuple(at): tuple(row) for at, row in self.rows.iterator()}
            state, revision = list(self.blank), revision + 1
            out.append((key[0], min(new)[0], -1, None, None, None, revision))
        for at in sorted(new):
            state, event = self.step(state, at, new[at])
            if event:
                out.append((key[0], *at, *event, revision))
        self.state.update((*state, revision))
        frame = pd.DataFrame(out, columns=["lei", "day", "side", "event", "price", "verdict", "revision"])
        frame["day"] = pd.to_datetime(frame["day"], unit="D").dt.date
        yield frame

    def step(self, state, at, row):
        """The state after one row, and the entry or exit that it brings."""
        held, _, _, next_run, blocked, void, has_run, value, live, verdict = state
        price, said, fair, flag, is_void, is_blocked, following, delay = row
        day, side = at
        if side == self.run_side:
            next_run, blocked, void, has_run, verdict, value = following, bool(is_blocked), bool(is_void), True, said, fair
            live = value if value is not None and not void else live
            signal, reason = self.run_signal(bool(flag), void, verdict, price), verdict
        else:
            current = next_run is None or day < next_run
            fresh = price is not None and price > 0 and delay is not None and delay <= self.max_age
            signal = self.quote_signal(has_run and fresh and not void, current and not blocked, value, live, price)
            reason = self.at_fair_value if signal == 0 else self.undervalued
        event = None
        if signal is not None and signal != held:
            held = signal
            event = ("entry" if held else "exit", price, reason)
        return [held, day, side, next_run, blocked, void, has_run, value, live, verdict], event

    def run_signal(self, flag, void, verdict, price):
        if flag and price is not None and price > 0:
            return 1
        return 0 if not void and verdict != self.undervalued else None

    def quote_signal(self, usable, may_enter, value, live, price):
        if not usable:
            return None
        if may_enter and value is not None and value > 0 and value / price - 1 > self.enter_above:
            return 1
        return 0 if live is not None and live > 0 and live / price - 1 <= self.exit_at else None

    def close(self) -> None:
        pass


def standing_events(events: DataFrame) -> DataFrame:
    """The events of every company's last revision."""
    last = events.groupBy("lei").agg(F.max("revision").alias("revision"))
    return events.join(last, ["lei", "revision"]).where(F.col("event").isNotNull()).drop("revision")


def position_stream(rows: DataFrame) -> DataFrame:
    """Entries and exits as they happen, with the state kept per company."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    return rows.groupBy("lei").transformWithStateInPandas(
        statefulProcessor=Positions(), outputStructType=EVENTS, outputMode="Append", timeMode="None")


def run_available(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process whatever has arrived since the last call, append it to a table, and stop."""
    return stream.writeStream.format("parquet").option("path", path) \
        .option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
