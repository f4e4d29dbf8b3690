"""Date expressions: reporting periods, ages, quarters.  'Today' is always an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_date(c: Column) -> Column:
    """'YYYY-MM-DD' or 'YYYYMMDD' at the start of a text; null when it is no date."""
    dashed = (F.substring(c, 5, 1) == "-") & (F.substring(c, 8, 1) == "-") & F.substring(c, 10, 1).between("0", "9")
    packed = c.rlike(r"^[0-9]{8}(?:T|$)")
    return F.when(dashed, F.substring(c, 1, 10).try_cast("date")).when(packed, F.concat_ws(
        "-", F.substring(c, 1, 4), F.substring(c, 5, 2), F.substring(c, 7, 2)).try_cast("date"))


def _past_midnight(c: Column) -> Column:
    """True only for a valid clock time other than 00:00:00."""
    clock = r"^[0-9-]{8,10}.([01][0-9]|2[0-3]):?([0-5][0-9])?:?([0-5][0-9])?(?:[.,][0-9]+)?(?:Z|[+-][0-9:]+)?$"
    usual = (F.length(c) <= 10) | c.endswith("T00:00:00")
    digits = F.concat(*[F.regexp_extract(c, clock, i) for i in (1, 2, 3)])
    return F.when(usual, False).otherwise(digits.rlike("[1-9]"))


def period_texts(raw: Column) -> tuple[Column, Column, Column]:
    """(left, right, is_duration) of a written period; an instant has its text on the right."""
    is_duration = raw.contains("/")
    right = F.when(is_duration, F.substring(raw, F.instr(raw, "/") + 1, F.length(raw))).otherwise(raw)
    return F.trim(F.substring_index(raw, "/", 1)), F.trim(right), is_duration


def period_days(left: Column, right: Column, is_duration: Column) -> tuple[Column, Column, Column]:
    """(start day, end day, whether the end is past midnight) as written."""
    return F.when(is_duration, iso_date(left)), iso_date(right), _past_midnight(right)


def period_of(start: Column, end_day: Column, past: Column, is_duration: Column) -> Column:
    """struct(start, end, is_duration) out of the written days, null where one is missing."""
    end = F.when(past, end_day).otherwise(F.date_sub(end_day, 1))
    usable = end.isNotNull() & (~is_duration | start.isNotNull())
    return F.when(usable, F.struct(start.alias("start"), end.alias("end"), is_duration.alias("is_duration")))


def period(raw: Column) -> Column:
    """Reporting period as struct(start, end, is_duration), end made inclusive.

    An end or instant at midnight names the first moment after the period, so it is
    moved back one day.  No clock zone is applied: the written day is what counts.
    """
    left, right, is_duration = period_texts(raw)
    return period_of(*period_days(left, right, is_duration), is_duration)


def age_days(today: Column, day: Column) -> Column:
    return F.datediff(today, day)


def new_quarter(today: Column, last: Column) -> Column:
    return F.date_trunc("quarter", today) != F.date_trunc("quarter", last)


def vintage_date(c: Column) -> Column:
    """'YYYY-MM' is read as the first day of that month."""
    return F.when(F.length(c) == 7, iso_date(F.concat(c, F.lit("-01")))).otherwise(iso_date(c))
