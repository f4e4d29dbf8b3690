from datetime import date

import pytest
from pyspark.sql import functions as F

from accountloom import spec
from accountloom.functions import dates, numbers, ordered, text


def one(spark, expr, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(expr.alias("x")).first().x


@pytest.mark.parametrize("raw, start, end, duration", [
    ("2024-01-01T00:00:00/2025-01-01T00:00:00", date(2024, 1, 1), date(2024, 12, 31), True),
    ("2025-01-01T00:00:00", None, date(2024, 12, 31), False), ("2025-01-01", None, date(2024, 12, 31), False),
    ("2024-01-29T00:00:00/2025-01-27T00:00:00", date(2024, 1, 29), date(2025, 1, 26), True),
    ("2024-12-31T12:00:00", None, date(2024, 12, 31), False), ("2024-12-31T23:59:59Z", None, date(2024, 12, 31), False),
    ("2025-01-01Tgarbage", None, date(2024, 12, 31), False), ("20250101", None, date(2024, 12, 31), False)])
def test_period(spark, raw, start, end, duration):
    p = one(spark, dates.period(F.col("raw")), raw=raw)
    assert (p.start, p.end, p.is_duration) == (start, end, duration)


@pytest.mark.parametrize("raw", ["garbage", "/", "2024/2025", "2024-13-01", ""])
def test_unusable_period(spark, raw):
    assert one(spark, dates.period(F.col("raw")), raw=raw) is None


@pytest.mark.parametrize("raw, value", [
    ("1.5", 1.5), (" -3e2 ", -300.0), ("1_000", 1000.0), (".5", 0.5), ("5.", 5.0), ("nan", None), ("inf", None),
    ("1d", None), ("1f", None), ("0x10", None), ("", None), ("1__0", None), ("text", None), ("1e999", None)])
def test_parse_number(spark, raw, value):
    assert one(spark, numbers.parse_number(F.col("raw")), raw=raw) == value


@pytest.mark.parametrize("a, b, ratio", [
    (0.3, 0.1, 3.0), (-0.3, 0.49, float("inf")), (0.0, 0.2, float("inf")), (0.0, 0.0, 1.0), (-0.2, -0.1, 2.0)])
def test_reinvestment_ratio(spark, a, b, ratio):
    assert abs(one(spark, numbers.reinvestment_ratio(F.col("a"), F.col("b")), a=a, b=b) - ratio) < 1e-9 or ratio == float("inf")


@pytest.mark.parametrize("coverage, rating", [
    (float("inf"), "AAA"), (8.5, "AAA"), (8.4, "AA"), (-5.0, "D"), (0.2, "C"), (0.0, "D")])
def test_ladder_pick(spark, coverage, rating):
    assert one(spark, numbers.ladder_pick(F.col("c"), "LARGE", "rating"), c=coverage) == rating


@pytest.mark.parametrize("raw, entry", [("A-2024-3", 3), ("bad", -1), (None, -1), ("A-x", -1), ("A- 7", 7)])
def test_entry_number(spark, raw, entry):
    assert one(spark, text.entry_number(F.col("r").cast("string")), r=raw) == entry


@pytest.mark.parametrize("line, pair", [
    ("- BRE | Auto Parts", ("BRE", "Auto Parts")), ("* A\tB", ("A", "B")), ("A ; B ; C", ("A", "B ; C")),
    ("A   Steel Works", ("A", "Steel Works")), ("single", None), ("| x", None), ("", None)])
def test_reply_line(spark, line, pair):
    out = one(spark, text.reply_line(F.col("l")), l=line)
    assert (out and (out.key, out.answer)) == pair


def test_check_texts(spark):
    assert one(spark, text.strip_severity(F.col("m")), m="WARNING -  two\n words - more") == "two words - more"
    assert one(spark, text.severity(F.col("m")), m=" fail - x") == "FAIL"
    assert one(spark, text.severity(F.lit(None).cast("string"))) == "UNKNOWN"
    assert one(spark, text.shorten(F.col("m"), 8), m="abcdefg hij") == "abcdefg…"
    assert one(spark, text.exit_reason(F.col("m")), m="OVERVALUED - screen out") == "Overvalued"


def test_rounding_is_half_even(spark):
    assert one(spark, numbers.same_count(F.col("a"), F.col("b")), a=2.5, b=2.0)
    assert one(spark, numbers.percent_text(F.col("p")), p="0.40%") == 0.004


def test_window_guard():
    assert spec.fiscal_window(2025) == [2021, 2022, 2023, 2024, 2025]
    for bad in ([2020, 2021, 2023, 2024, 2025], [2024], [2025, 2024, 2023, 2022, 2021]):
        with pytest.raises(ValueError):
            spec.check_window(bad)


def test_specification_shape():
    assert len(spec.LINE_ITEMS) == 20 and len(spec.REQUIRED_KEYS) == 12
    assert all(len(rungs) == 15 and list(rungs) == sorted(rungs) for rungs in spec.LADDERS.values())


def test_known_so_far_matches_a_replay(spark):
    import random
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.7 else f"k{rng.randrange(5)}", i, float(i) if rng.random() < 0.2 else None)
            for i in range(600)]
    df = spark.createDataFrame(rows, "k string, t int, v double").repartition(6)
    for current in (True, False):
        out = ordered.known_so_far(df, ["k"], ["t"], {"known": F.col("v")}, include_current=current)
        last, want = {}, {}
        for k, t, v in rows:
            before = last.get(k)
            last[k] = v if v is not None else before
            want[k, t] = last[k] if current else before
        assert {(r.k, r.t): r.known for r in out.collect()} == want
