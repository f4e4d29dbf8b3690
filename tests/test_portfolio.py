"""Portfolio windows against a plain replay, plus the small fixed cases."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from accountloom import spec
from accountloom.operators import portfolio
from accountloom.streaming import daily

RUN = ("run_date date, lei string, ticker string, value_per_share double, price double, verdict string, "
       "research_flag boolean, void boolean, blocked boolean")
QUOTE = "lei string, as_of date, price double, seen_on date"
DAY0 = date(2024, 1, 1)


def replay(runs, quotes):
    """Row at a time: each run is applied first, then the quotes of the day."""
    events, held, last = [], {}, {}
    run_days = sorted({r[0] for r in runs})
    days = sorted(set(run_days) | {q[1] for q in quotes})
    current = {}
    for day in days:
        if day in run_days:
            current = {r[1]: r for r in runs if r[0] == day}
            for lei, r in sorted(current.items()):
                _, _, ticker, value, price, verdict, flag, void, blocked = r
                void = void or verdict.startswith("VOID")
                if lei in held:
                    if void:
                        held[lei]["verdict"] = verdict
                    elif verdict != spec.UNDERVALUED:
                        events.append((lei, day, 0, "exit", price))
                        del held[lei]
                    else:
                        held[lei]["verdict"] = verdict
                        held[lei]["value"] = value if value is not None else held[lei]["value"]
                elif flag and price is not None and price > 0:
                    held[lei] = {"verdict": spec.UNDERVALUED, "value": value}
                    events.append((lei, day, 0, "entry", price))
        for lei, _, price, seen in sorted(q for q in quotes if q[1] == day):
            fresh = price is not None and price > 0 and (seen - day).days <= 7
            exited = False
            if lei in held:
                h = held[lei]
                if fresh and not h["verdict"].startswith("VOID") and h["value"] is not None and h["value"] > 0 \
                        and h["value"] / price - 1 <= 0:
                    events.append((lei, day, 1, "exit", price))
                    del held[lei]
                    exited = True
            if lei not in held and not exited and lei in current and fresh:
                _, _, _, value, _, verdict, _, void, blocked = current[lei]
                if not (void or verdict.startswith("VOID")) and not blocked and value is not None and value > 0 \
                        and value / price - 1 > 0.25:
                    held[lei] = {"verdict": spec.UNDERVALUED, "value": value}
                    events.append((lei, day, 1, "entry", price))
    return sorted(events)


def history(seed, companies=25, days=60):
    rng = random.Random(seed)
    runs, quotes = [], []
    for d in range(days):
        day = DAY0 + timedelta(days=d)
        for c in range(companies):
            lei = f"L{c}"
            if d % 9 == 0 and rng.random() < 0.75:
                verdict = rng.choice([spec.UNDERVALUED] * 3 + [spec.OVERVALUED, spec.FAIRLY_VALUED, spec.VOID])
                void = verdict == spec.VOID
                value = None if void else rng.choice([8.0, 10.0, 14.0])
                flag = verdict == spec.UNDERVALUED and rng.random() < 0.6
                blocked = not flag and rng.random() < 0.4
                runs.append((day, lei, "T" + lei, value, rng.choice([6.0, 7.5, None]) if not flag else 6.5, verdict, flag, void, blocked))
            if rng.random() < 0.6:
                stale = rng.random() < 0.1
                quotes.append((lei, day, rng.choice([5.0, 7.0, 9.0, 11.0, 15.0]), day + timedelta(days=9 if stale else 1)))
    return runs, quotes


@pytest.mark.parametrize("seed", [3, 11])
def test_events_match_a_replay(spark, seed):
    runs, quotes = history(seed)
    out = portfolio.position_events(spark.createDataFrame(runs, RUN), spark.createDataFrame(quotes, QUOTE))
    got = sorted((r.lei, r.at, r.side, r.event, r.price) for r in out.collect())
    assert got == replay(runs, quotes)


@pytest.mark.parametrize("order", [(0, 1, 2, 3), (1, 3, 0, 2)])
def test_stream_matches_a_replay_over_several_batches(spark, tmp_path, order):
    runs, quotes = history(7, companies=12, days=40)
    rows = daily.position_input(spark.createDataFrame(runs, RUN), spark.createDataFrame(quotes, QUOTE)).cache()
    out, mark = str(tmp_path / "events"), str(tmp_path / "mark")
    first = (DAY0 - date(1970, 1, 1)).days
    for part in order:
        inside = (F.col("day") >= first + part * 10) & (F.col("day") < first + part * 10 + 10)
        rows.where(inside).coalesce(1).write.mode("append").parquet(str(tmp_path / "rows"))
        stream = daily.position_stream(daily.read_stream(spark, str(tmp_path / "rows"), rows.schema))
        daily.run_available(stream, out, mark).awaitTermination()
    events = daily.standing_events(spark.read.schema(daily.EVENTS).parquet(out))
    got = sorted((r.lei, r.day, r.side, r.event, r.price) for r in events.collect())
    assert got == replay(runs, quotes)


def test_price_store_keeps_corrections_and_late_quotes(spark, tmp_path):
    schema = "lei string, as_of date, fetched_at timestamp, price double, currency string, status string"
    path, out, mark = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark")
    from datetime import datetime
    batches = [[("a", date(2024, 1, 1), datetime(2024, 1, 1), 10.0, "EUR", "ok"), ("b", date(2024, 1, 1), datetime(2024, 1, 1), 5.0, "GBX", "ok")],
               [("a", date(2024, 1, 1), datetime(2024, 1, 2), 11.0, "EUR", "ok"), ("a", date(2023, 11, 1), datetime(2024, 1, 2), 9.0, "EUR", "ok")]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        stream = daily.read_stream(spark, path, spark.createDataFrame([], schema).schema)
        daily.store_prices(stream, F.lit("2024-01-03").cast("date"), out, mark).awaitTermination()
    got = {(r.lei, r.as_of): (r.price, r.stale) for r in daily.stored_prices(spark, out).collect()}
    assert got == {("a", date(2024, 1, 1)): (11.0, False), ("a", date(2023, 11, 1)): (9.0, True)}


def test_fresh_quotes_take_the_newest_fetch(spark, tmp_path):
    from datetime import datetime
    schema = "lei string, as_of date, fetched_at timestamp, price double, currency string, status string"
    path, out, mark = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark")
    batches = [[("a", date(2024, 1, 20), datetime(2024, 1, 20), 10.0, "EUR", "ok"), ("a", date(2024, 1, 19), datetime(2024, 1, 20), 8.0, "EUR", "ok")],
               [("a", date(2024, 1, 20), datetime(2024, 1, 21), 11.0, "EUR", "ok"), ("a", date(2024, 1, 19), datetime(2024, 1, 19), 7.0, "EUR", "ok")],
               [("a", date(2024, 1, 2), datetime(2024, 1, 22), 9.0, "EUR", "ok")]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        stream = daily.read_stream(spark, path, spark.createDataFrame([], schema).schema)
        daily.store_fresh(daily.fresh_stream(stream, F.lit("2024-01-22").cast("date")), out, mark).awaitTermination()
    got = {(r.lei, r.as_of): r.price for r in daily.stored_prices(spark, out).collect()}
    assert got == {("a", date(2024, 1, 20)): 11.0, ("a", date(2024, 1, 19)): 8.0}   # the last is over a week late


def test_round_trips(spark):
    runs, quotes = history(5)
    events = replay(runs, quotes)
    book = portfolio.positions(spark.createDataFrame(runs, RUN), spark.createDataFrame(quotes, QUOTE)).collect()
    entries = sorted((e[0], e[1], e[4]) for e in events if e[3] == "entry")
    exits = sorted((e[0], e[1], e[4]) for e in events if e[3] == "exit")
    assert sorted((b.lei, b.entry_date, b.entry_price) for b in book) == entries
    assert sorted(((b.lei, b.exit_date, b.exit_price) for b in book if b.status == "closed"), key=str) == sorted(exits, key=str)
    held = [b.lei for b in book if b.status == "open"]
    assert len(held) == len(set(held)) and all(abs(b.units * b.entry_price - 100) < 1e-9 for b in book)


BOOK = ("lei string, ticker string, entry_date date, entry_price double, units double, last_verdict string, "
        "last_value_per_share double, exit_date date, exit_price double, exit_verdict string, status string")


def _slow_series(book, prices, today):
    out = {}
    dates = {b[2] for b in book} | {b[7] for b in book if b[7]} | {p[1] for p in prices if p[0] in {b[0] for b in book}}
    for d in sorted(x for x in dates if x <= today):
        rets = []
        for b in book:
            if b[2] > d:
                continue
            if b[7] and b[7] <= d:
                px = b[8] or b[3]
            else:
                known = [p for p in prices if p[0] == b[0] and p[1] <= d]
                if not known:
                    continue
                px = max(known, key=lambda p: p[1])[2]
            rets.append(px / b[3] - 1)
        if rets:
            out[d] = (sum(rets) / len(rets), len(rets))
    return out


def test_two_position_series(spark):
    d = date
    book = [("L1", "A", d(2026, 6, 1), 10.0, 10.0, None, None, None, None, None, "open"),
            ("L2", "B", d(2026, 7, 1), 20.0, 5.0, None, None, None, None, None, "open")]
    prices = [("L1", d(2026, 6, 1), 10.0), ("L1", d(2026, 7, 1), 11.0), ("L1", d(2026, 8, 1), 12.5),
              ("L2", d(2026, 7, 1), 20.0), ("L2", d(2026, 8, 1), 21.0)]
    out = portfolio.performance_series(spark.createDataFrame(book, BOOK), spark.createDataFrame(prices, "lei string, as_of date, price double"),
                                       F.lit("2026-12-31").cast("date")).collect()
    assert (out[0].return_pct, out[0].n) == (0.0, 1)
    assert abs(out[-1].return_pct - 0.15) < 1e-9 and out[-1].n == 2


@pytest.mark.parametrize("seed", [1, 2])
def test_series_matches_the_direct_mean(spark, seed):
    rng = random.Random(seed)
    book, prices = [], []
    for c in range(12):
        at = rng.randrange(5)
        while at < 50:
            stay = rng.choice([0, 3, 9, 100])
            closed = at + stay < 50
            entry = DAY0 + timedelta(days=at)
            book.append((f"L{c}", "T", entry, rng.choice([5.0, 8.0]), 1.0, None, None,
                         entry + timedelta(days=stay) if closed else None, rng.choice([6.0, None]) if closed else None, None,
                         "closed" if closed else "open"))
            if not closed:
                break
            at += stay + rng.choice([0 if stay else 1, 4])
    for c in range(14):
        prices += [(f"L{c}", DAY0 + timedelta(days=k), rng.choice([4.0, 6.0, 9.0])) for k in range(60) if rng.random() < 0.5]
    today = DAY0 + timedelta(days=55)
    out = portfolio.performance_series(spark.createDataFrame(book, BOOK), spark.createDataFrame(prices, "lei string, as_of date, price double"), F.lit(today))
    got = {r.date: (r.return_pct, r.n) for r in out.collect()}
    want = _slow_series(book, prices, today)
    assert set(got) == set(want)
    assert all(abs(got[k][0] - want[k][0]) < 1e-9 and got[k][1] == want[k][1] for k in want)


def test_mark_and_totals(spark):
    d = date
    book = [("a", "A", d(2024, 1, 1), 10.0, 10.0, "VOID - failed validation", 12.0, None, None, None, "open"),
            ("b", "B", d(2024, 1, 1), 20.0, 5.0, spec.UNDERVALUED, None, None, None, None, "open"),
            ("c", "C", d(2024, 1, 1), 20.0, 5.0, None, 30.0, d(2024, 2, 1), None, spec.OVERVALUED, "closed")]
    newest = spark.createDataFrame([("a", 12.0, d(2024, 3, 1))], "lei string, price double, as_of date")
    marked = portfolio.mark(spark.createDataFrame(book, BOOK), newest)
    rows = {r.lei: r for r in marked.collect()}
    assert rows["a"].value == 120.0 and rows["a"].unvaluable and rows["a"].current_upside == 0.0
    assert rows["b"].value == 100.0 and rows["b"].missing_price and rows["c"].value == 100.0
    t = portfolio.totals(marked).first()
    assert (t.invested, t.current_value, t.open, t.closed, t.missing) == (300.0, 320.0, 2, 1, 1)
    assert abs(t.held_return_pct - 0.1) < 1e-12
    assert [r.lei for r in portfolio.book_order(marked, "held").collect()] == ["a", "b"]


def test_sync_and_price_update(spark):
    held = spark.createDataFrame([("a", "A", spec.UNDERVALUED, 10.0), ("b", "B", spec.UNDERVALUED, 10.0), ("c", "C", spec.VOID, 10.0),
                                  ("d", "D", spec.UNDERVALUED, 10.0)], "lei string, ticker string, last_verdict string, last_value_per_share double")
    run = spark.createDataFrame([(DAY0, "a", "A", 10.0, 7.0, spec.UNDERVALUED, True, False, False), (DAY0, "b", "B", 9.0, 9.0, spec.FAIRLY_VALUED, False, False, False),
                                 (DAY0, "c", "C", None, 7.0, spec.VOID, False, True, False), (DAY0, "e", "E", 12.0, 8.0, spec.UNDERVALUED, True, False, False),
                                 (DAY0, "f", "F", 12.0, None, spec.UNDERVALUED, True, False, False)], RUN)
    actions = {r.lei: r.action for r in portfolio.sync_run(held, run).collect()}
    assert actions == {"a": "observe", "b": "exit", "c": "unvaluable", "d": "not_seen", "e": "enter"}
    triggers = run.withColumn("blocking_checks", F.when(F.col("lei") == "f", F.array(F.lit("D122"))).when(F.col("lei") != "x", F.array().cast("array<string>")))
    quotes = spark.createDataFrame([(k, DAY0, p) for k, p in (("a", 10.0), ("c", 20.0), ("d", 5.0), ("e", 9.6), ("f", 1.0), ("b", 7.2))], "lei string, as_of date, price double")
    fresh = portfolio.fresh_quotes(quotes, F.lit(DAY0 + timedelta(days=7)))
    out = {r.lei: r.action for r in portfolio.price_update(held, triggers, fresh).collect()}
    assert out == {"a": "exit"}   # e is at exactly 25 percent, b stays held, c is void, f is blocked
    assert portfolio.fresh_quotes(quotes, F.lit(DAY0 + timedelta(days=8))).count() == 0
    old = triggers.withColumn("blocking_checks", F.lit(None).cast("array<string>"))
    cheap = quotes.withColumn("price", F.lit(1.0))
    assert portfolio.price_update(held, old, portfolio.fresh_quotes(cheap, F.lit(DAY0))).where("action = 'enter'").count() == 0


def test_replay_of_old_records(spark):
    schema = "run_date date, key string, lei string, ticker string, value_per_share double, price double, verdict string, research_flag boolean, queued boolean"
    rows = [(DAY0, "L1", "L1", "A", 13.0, 10.0, "kept", True, False)] + [
        (DAY0, t, None, None, v, 10.0, None, None, t == "B") for t, v in (("B", 13.0), ("C", 7.0), ("D", 10.0), ("E", None))] + [
        (DAY0, "Z", None, None, 1.0, 1.0, None, None, False)]
    names = spark.createDataFrame([("B", "L2"), ("C", "L3"), ("D", "L4"), ("E", "L5")], "ticker string, lei string")
    out = {r.ticker: r for r in portfolio.replay_triggers(spark.createDataFrame(rows, schema), names).collect()}
    assert {t: r.verdict for t, r in out.items()} == {"A": "kept", "B": spec.UNDERVALUED, "C": spec.OVERVALUED, "D": spec.FAIRLY_VALUED, "E": spec.VOID}
    assert out["B"].lei == "L2" and out["B"].research_flag and not out["C"].research_flag
