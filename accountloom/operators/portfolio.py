"""Positions out of runs and quotes, their marks and the performance series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from accountloom import spec
from accountloom.functions import numbers, ordered, text

MONEY = "decimal(38,12)"
RUN_SIDE, QUOTE_SIDE = 0, 1


def void_text(verdict: Column) -> Column:
    return F.coalesce(verdict.startswith("VOID"), F.lit(False))


def with_next_run(runs: DataFrame) -> DataFrame:
    """Adds the date of the following run, whoever took part in it.

    The run calendar has one row per run date, so its single window stays small.
    """
    calendar = runs.select("run_date").distinct().withColumn(
        "next_run", F.lead("run_date").over(W.orderBy("run_date")))
    return runs.join(calendar, "run_date")


def one_per_day(rows: DataFrame, day: str, order: list[Column]) -> DataFrame:
    """One row per company and day, the last one in ``order``.

    This bounds every later window over a company by the calendar, however many rows a
    single company brings; the reduction itself is combined before the shuffle.
    """
    carry = [c for c in rows.columns if c not in ("lei", day)]
    return ordered.latest(rows, ["lei", day], order, carry)


def timeline(runs: DataFrame, quotes: DataFrame) -> DataFrame:
    """Runs and quotes of a company in one ordered stream; on one day the run comes first.

    ``runs``: run_date, lei, ticker, value_per_share, price, verdict, research_flag, void,
    blocked, next_run.  ``quotes``: lei, as_of, price, seen_on.
    """
    r0 = one_per_day(runs, "run_date", [F.col("ticker")])
    q0 = one_per_day(quotes.select("lei", "as_of", "price", "seen_on"), "as_of", [F.col("seen_on")])
    r = r0.select(
        "lei", F.col("run_date").alias("at"), F.lit(RUN_SIDE).alias("side"), "price",
        F.struct("run_date", "next_run", "ticker", "verdict", (F.col("void") | void_text(F.col("verdict"))).alias("void"),
                 "blocked", F.col("value_per_share").alias("value")).alias("run"),
        F.when(~(F.col("void") | void_text(F.col("verdict"))), F.col("value_per_share")).alias("live_value"),
        "research_flag", F.lit(None).cast("date").alias("seen_on"))
    q = q0.select("lei", F.col("as_of").alias("at"), F.lit(QUOTE_SIDE).alias("side"), "price", "seen_on")
    return r.unionByName(q, allowMissingColumns=True)


def position_events(runs: DataFrame, quotes: DataFrame) -> DataFrame:
    """Entries and exits of every company over its whole history.

    Each row signals enter, exit or nothing; the state before a row is the last signal
    before it, so positions come from windows over one shuffle instead of a replay.
    """
    rows = timeline(with_next_run(runs), quotes)
    known = ordered.known_so_far(rows, ["lei"], ["at", "side"],
                                 {"last_run": F.col("run"), "last_value": F.col("live_value")})
    run, is_run = F.col("last_run"), F.col("side") == RUN_SIDE
    fresh = F.datediff("seen_on", "at") <= spec.QUOTE_MAX_AGE
    usable = (F.col("price") > 0) & fresh
    current = run["next_run"].isNull() | (F.col("at") < run["next_run"])
    up_exit = F.try_divide(F.when(F.col("last_value") > 0, F.col("last_value")), F.col("price")) - 1
    up_entry = F.try_divide(F.when(run["value"] > 0, run["value"]), F.col("price")) - 1
    enter_quote = usable & current & ~run["void"] & ~run["blocked"] & (up_entry > spec.VERDICT_BAND)
    exit_quote = usable & ~run["void"] & (up_exit <= spec.EXIT_UPSIDE)
    signal = (F.when(is_run, F.when(F.col("research_flag") & (F.col("price") > 0), 1)
                     .when(~run["void"] & (run["verdict"] != spec.UNDERVALUED), 0))
              .otherwise(F.when(enter_quote, 1).when(exit_quote, 0)))
    marked = known.withColumn("signal", signal)
    state = ordered.known_so_far(marked, ["lei"], ["at", "side"],
                                 {"held_before": F.col("signal")}, include_current=False)
    held = F.coalesce("held_before", F.lit(0))
    edge = F.when((F.col("signal") == 1) & (held == 0), "entry") \
        .when((F.col("signal") == 0) & (held == 1), "exit")
    return state.withColumn("event", edge).where(F.col("event").isNotNull())


def positions(runs: DataFrame, quotes: DataFrame) -> DataFrame:
    """One row per round trip.  A company has at most one open position at a time."""
    events = position_events(runs, quotes)
    value = F.col("last_run.value")
    entry = F.struct(F.col("at").alias("date"), "price", value.alias("value"),
                     F.col("last_run.ticker").alias("ticker"))
    trips = ordered.known_so_far(events, ["lei"], ["at", "side"],
                                 {"entry": F.when(F.col("event") == "entry", entry)})
    closing = F.when(F.col("event") == "exit", F.struct(
        F.col("at").alias("date"), "price",
        F.when(F.col("side") == RUN_SIDE, F.col("last_run.verdict"))
        .otherwise(F.lit(spec.EXIT_AT_FAIR_VALUE)).alias("verdict"), "last_value"))
    per_trip = trips.withColumn("closing", closing).groupBy("lei", "entry").agg(
        F.first("closing", True).alias("closing"))
    live = ~F.col("void") & ~void_text(F.col("verdict")) & F.col("value_per_share").isNotNull()
    seen = runs.groupBy("lei").agg(
        F.max("run_date").alias("run_date"), F.max_by("verdict", "run_date").alias("run_verdict"),
        F.max_by("value_per_share", F.when(live, F.col("run_date"))).alias("value_per_share"))
    joined = per_trip.join(seen, "lei", "left")
    is_open = F.col("closing").isNull()
    after = is_open & (F.col("run_date") >= F.col("entry.date"))
    return joined.select(
        "lei", F.col("entry.ticker").alias("ticker"), F.col("entry.date").alias("entry_date"),
        F.col("entry.price").alias("entry_price"), F.col("entry.value").alias("entry_value_per_share"),
        numbers.upside(F.col("entry.value"), F.col("entry.price")).alias("entry_upside"),
        (F.lit(spec.STAKE) / F.col("entry.price")).alias("units"),
        F.when(after, F.col("run_date")).when(is_open, F.col("entry.date")).alias("last_seen_date"),
        F.when(after, F.col("run_verdict")).when(is_open, F.lit(spec.UNDERVALUED)).alias("last_verdict"),
        F.when(is_open, F.coalesce("value_per_share", "entry.value"))
        .otherwise(F.col("closing.last_value")).alias("last_value_per_share"),
        F.col("closing.date").alias("exit_date"), F.col("closing.price").alias("exit_price"),
        F.col("closing.verdict").alias("exit_verdict"),
        F.when(is_open, "open").otherwise("closed").alias("status"))


def sync_run(held: DataFrame, run: DataFrame) -> DataFrame:
    """What one run does to the open positions: enter, exit, observe, unvaluable, not_seen.

    ``held``: open positions by lei.  ``run``: the rows of one run.
    """
    r = run.select("lei", F.struct(
        "ticker", "price", "verdict", "value_per_share", "research_flag",
        (F.col("void") | void_text(F.col("verdict"))).alias("void")).alias("run"))
    both = held.select("lei", F.col("ticker").alias("held_ticker")).join(r, "lei", "full")
    have, seen = F.col("held_ticker").isNotNull(), F.col("run").isNotNull()
    action = (F.when(have & ~seen, "not_seen").when(have & F.col("run.void"), "unvaluable")
              .when(have & (F.col("run.verdict") != spec.UNDERVALUED), "exit").when(have, "observe")
              .when(F.col("run.research_flag") & (F.col("run.price") > 0), "enter"))
    return both.withColumn("action", action).where(F.col("action").isNotNull()).select(
        "lei", F.coalesce("run.ticker", "held_ticker").alias("ticker"), "action", "run.price",
        F.col("run.verdict").alias("verdict"),
        F.when(F.col("action") != "unvaluable", F.col("run.value_per_share")).alias("value_per_share"))


def fresh_quotes(prices: DataFrame, today: Column) -> DataFrame:
    """Newest quote per company if it is a price and not older than a week."""
    newest = ordered.latest(prices, ["lei"], [F.col("as_of")], ["as_of", "price"])
    return newest.where((F.col("price") > 0) & (F.datediff(today, "as_of") <= spec.QUOTE_MAX_AGE))


def price_update(open_positions: DataFrame, triggers: DataFrame, quotes: DataFrame) -> DataFrame:
    """Exits, then entries, on fresh quotes against the values of the last run.

    ``open_positions``: lei, ticker, last_verdict, last_value_per_share.  ``triggers``: the
    last run; a null blocking list means an old record, which enters nothing.
    """
    o = open_positions.join(quotes, "lei")
    out = numbers.upside(F.col("last_value_per_share"), F.col("price"))
    exits = o.where(~void_text(F.col("last_verdict")) & (F.col("last_value_per_share") > 0)) \
        .withColumn("upside", F.col("last_value_per_share") / F.col("price") - 1) \
        .where(F.col("upside") <= spec.EXIT_UPSIDE).select(
            "lei", "ticker", F.lit("exit").alias("action"), F.col("as_of").alias("on"), "price", "upside")
    clean = triggers.where(~F.coalesce("void", F.lit(False)) & (F.size("blocking_checks") == 0)
                           & (F.col("value_per_share") > 0))
    still_held = open_positions.select("lei").join(exits.select("lei"), "lei", "left_anti")
    entries = clean.drop("price").join(still_held, "lei", "left_anti").join(quotes, "lei") \
        .withColumn("upside", F.col("value_per_share") / F.col("price") - 1) \
        .where(F.col("upside") > spec.VERDICT_BAND).select(
            "lei", "ticker", F.lit("enter").alias("action"), F.col("as_of").alias("on"), "price", "upside")
    return exits.unionByName(entries)


def price_watch(triggers: DataFrame, newest: DataFrame) -> DataFrame:
    """Companies whose price went through, or near, the trigger of the last run."""
    t = triggers.where(F.col("trigger_price").isNotNull()
                       & ~F.coalesce(F.col("verdict").startswith("UNDERVALUED"), F.lit(False))) \
        .withColumnRenamed("price", "run_price")
    hit = t.join(newest.select("lei", "price", F.col("as_of").alias("price_as_of")), "lei")
    return hit.withColumn("status", watch_status()).where(F.col("status").isNotNull()).select(
        "lei", "ticker", "price", "price_as_of", "trigger_price", "watch_price", "run_price",
        F.col("verdict").alias("run_verdict"), "status")


def watch_status() -> Column:
    return F.when(F.col("price") <= F.col("trigger_price"), "crossed") \
        .when((F.col("watch_price") != 0) & (F.col("price") <= F.col("watch_price")), "approaching")


def watch_order(hits: DataFrame) -> DataFrame:
    return hits.orderBy(F.col("status") != "crossed", "ticker", "lei")


def mark(book: DataFrame, newest: DataFrame) -> DataFrame:
    """Open positions at the newest price, at cost when there is none; closed ones at exit."""
    n = newest.select("lei", F.col("price").alias("_p"), F.col("as_of").alias("_d"))
    is_open = F.col("status") == "open"
    rows = book.join(n, "lei", "left").withColumns({
        "price": F.when(is_open, F.coalesce("_p", "entry_price")).otherwise(F.coalesce("exit_price", "entry_price")),
        "price_as_of": F.when(is_open, F.when(F.col("_p").isNotNull(), F.col("_d"))).otherwise(F.col("exit_date")),
        "missing_price": is_open & F.col("_p").isNull()})
    rows = rows.withColumn("value", F.col("units") * F.col("price"))
    return rows.withColumns({
        "return_pct": (F.col("value") - spec.STAKE) / spec.STAKE,
        "current_upside": numbers.upside(F.col("last_value_per_share"), F.col("price")),
        "unvaluable": is_open & void_text(F.col("last_verdict"))}).drop("_p", "_d")


def totals(marked: DataFrame) -> DataFrame:
    """Invested, current value, return and counts; the mean return of what is held now."""
    is_open = F.col("status") == "open"
    invested = F.count(F.lit(1)) * F.lit(spec.STAKE)
    value = F.coalesce(F.sum(F.col("value").cast(MONEY)).cast("double"), F.lit(0.0))
    held = F.avg(F.when(is_open, F.col("return_pct").cast(MONEY))).cast("double")
    return marked.agg(
        invested.alias("invested"), value.alias("current_value"),
        F.coalesce(F.try_divide(value - invested, invested), F.lit(0.0)).alias("return_pct"),
        F.count_if(is_open).alias("open"), F.count_if(~is_open).alias("closed"),
        F.count_if("missing_price").alias("missing"),
        F.coalesce(held, F.lit(0.0)).alias("held_return_pct"))


def performance_series(book: DataFrame, prices: DataFrame, today: Column) -> DataFrame:
    """Equal-weight mean return per date and the number of positions behind it.

    The return of a position is a step function of the date, so the sum over all positions
    changes only where one of them changes.  Every change becomes one row (date, delta),
    the deltas are added up per date, and one running total over the calendar gives the
    mean.  Work grows with the prices, not with dates times positions.  Deltas are exact
    decimals, so the running total does not drift.  Closed positions stay in at their
    exit price, as every later date counts them.

    ``prices``: lei, as_of, price with one row per company and date.
    """
    b = book.where((F.col("entry_price") != 0) & (F.col("entry_date") <= today)).select(
        "lei", "entry_date", "exit_date", "entry_price",
        F.coalesce(numbers.nonzero(F.col("exit_price")), F.col("entry_price")).alias("final_price"))
    held_prices = one_per_day(prices.select("lei", "as_of", "price"), "as_of", [F.col("price")]) \
        .join(b.select("lei").distinct(), "lei", "left_semi")
    lasting = b.where(F.col("exit_date").isNull() | (F.col("exit_date") > F.col("entry_date")))
    trip = F.struct("entry_date", "entry_price", "exit_date")
    stream = held_prices.select("lei", F.col("as_of").alias("at"), F.lit(0).alias("kind"), "price") \
        .unionByName(lasting.select("lei", F.col("entry_date").alias("at"), F.lit(1).alias("kind"),
                                    trip.alias("trip")), allowMissingColumns=True)
    known = ordered.known_so_far(stream, ["lei"], ["at", "kind"],
                                 {"now": F.col("trip"), "known": F.col("price")})
    inside = F.col("now.exit_date").isNull() | (F.col("at") < F.col("now.exit_date"))
    moving = known.where(F.col("now").isNotNull() & F.col("known").isNotNull() & inside).select(
        "lei", "now.entry_date", F.col("at").alias("date"),
        (F.col("known") / F.col("now.entry_price") - 1).cast(MONEY).alias("r"))
    closing = b.where(F.col("exit_date").isNotNull()).select(
        "lei", "entry_date", F.col("exit_date").alias("date"),
        (F.col("final_price") / F.col("entry_price") - 1).cast(MONEY).alias("r"))
    steps = moving.unionByName(closing).where(F.col("date") <= today)
    per_trip = W.partitionBy("lei", "entry_date").orderBy("date")
    deltas = steps.withColumn("before", F.lag("r").over(per_trip)).select(
        "date", (F.col("r") - F.coalesce("before", F.lit(0).cast(MONEY))).alias("delta"),
        F.when(F.col("before").isNull(), 1).otherwise(0).alias("joins"))
    spine = held_prices.select(F.col("as_of").alias("date")) \
        .unionByName(book.select(F.explode(F.array_compact(F.array("entry_date", "exit_date"))).alias("date"))) \
        .where(F.col("date") <= today).select("date", F.lit(0).cast(MONEY).alias("delta"), F.lit(0).alias("joins"))
    daily = deltas.unionByName(spine).groupBy("date").agg(
        F.sum("delta").cast(MONEY).alias("delta"), F.sum("joins").alias("joins"))
    so_far = W.orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    summed = daily.select("date", F.sum("delta").over(so_far).alias("s"), F.sum("joins").over(so_far).alias("n"))
    return summed.where(F.col("n") > 0).select(
        "date", (F.col("s").cast("double") / F.col("n")).alias("return_pct"), "n").orderBy("date")


def as_of_price(asks: DataFrame, prices: DataFrame) -> DataFrame:
    """Price known on or before each asked (company, date), asked once per distinct pair.

    One ordered stream per company instead of a range join; null where no price is known.
    """
    p = one_per_day(prices.select("lei", "as_of", "price"), "as_of", [F.col("price")])
    both = p.select("lei", F.col("as_of").alias("at"), F.lit(0).alias("side"), "price").unionByName(
        asks.select("lei", "at").distinct().withColumn("side", F.lit(1)), allowMissingColumns=True)
    filled = ordered.known_so_far(both, ["lei"], ["at", "side"], {"known_price": F.col("price")})
    return filled.where(F.col("side") == 1).select("lei", "at", "known_price")


def price_targets(triggers: DataFrame, book: DataFrame) -> DataFrame:
    """Companies to fetch prices for: the last run and everything held."""
    held = book.where(F.col("status") == "open").select("lei")
    return triggers.select("lei").unionByName(held).distinct()


def not_seen(book: DataFrame, run: DataFrame) -> DataFrame:
    return book.where(F.col("status") == "open").join(run.select("lei"), "lei", "left_anti")


def changed_at(book: DataFrame, scan_date: Column) -> DataFrame:
    """Positions that entered or left at one scan, with the short reason of the leavers."""
    added = (F.col("status") == "open") & (F.col("entry_date") == scan_date)
    gone = (F.col("status") == "closed") & (F.col("exit_date") == scan_date)
    return book.where(added | gone).select(
        "lei", "ticker", F.when(added, "added").otherwise("removed").alias("change"),
        F.when(gone, text.exit_reason(F.col("exit_verdict"))).alias("reason"))


def backfill_start(book: DataFrame, newest: DataFrame) -> DataFrame:
    """Earliest day a held company still needs prices from."""
    o = book.where(F.col("status") == "open").join(newest.select("lei", "as_of"), "lei", "left")
    return o.agg(F.min(F.greatest("entry_date", F.coalesce("as_of", "entry_date"))).alias("since"))


def refresh_plan(book: DataFrame, newest: DataFrame, state: DataFrame, today: Column) -> DataFrame:
    """Held companies to refresh and the day to backfill from; empty once done for today.

    ``state`` is the key-value run state; its refresh date is checked by an anti join, so
    the decision is part of the plan.
    """
    done = state.where((F.col("key") == "prices_refreshed") & (F.col("value") == today.cast("string"))) \
        .select(F.lit(1).alias("_one"))
    start = backfill_start(book, newest).withColumn("_one", F.lit(1))
    due = start.where(F.col("since").isNotNull()).join(done, "_one", "left_anti")
    held = book.where(F.col("status") == "open").select("lei", F.lit(1).alias("_one"))
    return held.join(F.broadcast(due), "_one").select("lei", "since")   # one row by construction


def book_order(marked: DataFrame, view: str) -> DataFrame:
    """Orders of the published lists: all, held, sold, and the stored reads."""
    open_ = F.col("status") == "open"
    if view == "all":
        return marked.orderBy(~open_, F.desc("return_pct"), "lei", "entry_date")
    if view == "held":
        return marked.where(open_).orderBy(F.desc("return_pct"), "lei")
    if view == "sold":
        return marked.where(~open_).orderBy(F.coalesce(F.col("exit_date").cast("string"), F.lit("")), "ticker")
    return marked.orderBy("entry_date", "ticker", "lei")


def replay_triggers(records: DataFrame, by_ticker: DataFrame) -> DataFrame:
    """Run rows out of stored trigger records of any age.

    ``records``: run_date, key, lei, ticker, value_per_share, price, verdict, research_flag,
    queued.  Old records are keyed by ticker and carry no verdict or flag.
    """
    t = by_ticker.select(F.col("ticker").alias("_t"), F.col("lei").alias("_lei"))
    rows = records.join(t, F.col("key") == F.col("_t"), "left").withColumns({
        "lei": F.coalesce(text.blank_to_null(F.col("lei")), "_lei"),
        "ticker": F.when(F.coalesce("lei", F.lit("")) != "", F.coalesce("ticker", "key")).otherwise(F.col("key"))})
    rows = rows.where(F.col("lei").isNotNull()).withColumn(
        "upside", numbers.upside(F.col("value_per_share"), F.col("price")))
    return rows.withColumns({
        "verdict": F.coalesce(text.blank_to_null(F.col("verdict")), numbers.verdict_from_upside(F.col("upside"))),
        "research_flag": F.coalesce("research_flag", "queued"), "void": F.lit(False)}).drop("_t", "_lei", "queued")
