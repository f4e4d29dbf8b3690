"""Share counts: derived from the accounts, checked against revenue, imported by hand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accountloom import spec
from accountloom.functions import numbers, text

DERIVED = "eps-derived"


def in_cap_band(price: Column, shares: Column, revenue: Column) -> Column:
    """Market cap over revenue inside the accepted band; null when it cannot be formed."""
    ratio = F.try_divide(price * shares, revenue)
    return ratio.between(spec.CAP_REVENUE_MIN, spec.CAP_REVENUE_MAX)


def worksheet(companies: DataFrame) -> DataFrame:
    """One row per listed company with the count to use and where it comes from.

    ``companies``: lei, name, ticker, exchange, price, revenue, wavg_basic, wavg_diluted,
    current_shares, current_source (the last two null when no count is stored).
    """
    derived = F.coalesce(numbers.nonzero(F.col("wavg_diluted")), F.col("wavg_basic"))
    good = F.coalesce((F.col("derived") > 0) & (F.col("price") != 0) & (F.col("revenue") != 0)
                      & in_cap_band(F.col("price"), F.col("derived"), F.col("revenue")), F.lit(False))
    rows = companies.where(F.coalesce("ticker", F.lit("")) != "").withColumn("derived", derived)
    rows = rows.withColumn("usable", F.when(good, F.col("derived")))
    return rows.withColumns({
        "shares": F.bround(F.coalesce("current_shares", "usable"), 0),
        "source": F.coalesce("current_source", F.when(F.col("usable").isNotNull(), F.lit(DERIVED))),
        "implied_cap_rev": F.try_divide(F.col("price") * F.col("usable"), F.col("revenue")),
        "note": F.when(F.col("usable").isNull() & F.col("current_shares").isNull(), "FILL IN").otherwise("")})


def export_order(rows: DataFrame) -> DataFrame:
    """Rows that still need a number first."""
    return rows.orderBy(F.col("shares").isNotNull(), "name", "lei")


def seed_derived(rows: DataFrame, today: Column) -> DataFrame:
    """Derived counts to store: where none exists, or where the stored one is derived too
    and the accounts now imply another.  A count from any other source stays."""
    current = F.col("current_shares")
    due = F.col("usable").isNotNull() & (current.isNull() | (
        (F.col("current_source") == DERIVED) & ~numbers.same_count(current, F.col("usable"))))
    return rows.where(due).select("lei", today.alias("as_of"), F.col("usable").alias("shares"),
                                  F.lit(DERIVED).alias("source"), F.lit(None).cast("string").alias("note"))


def market_cap_sanity(rows: DataFrame) -> DataFrame:
    """Unusable derived counts told apart from companies that really are out of band."""
    checked = rows.where(F.col("price").isNotNull() & (F.coalesce("wavg_diluted", F.lit(0.0)) != 0)
                         & (F.coalesce("revenue", F.lit(0.0)) != 0))
    ratio = F.col("price") * F.col("wavg_diluted") / F.col("revenue")
    shares = F.col("wavg_diluted")
    verdict = F.when((shares <= 0) | ~shares.between(spec.SHARES_MIN, spec.SHARES_MAX), "shares_unusable") \
        .when(~ratio.between(spec.CAP_REVENUE_MIN, spec.CAP_REVENUE_MAX), "out_of_band").otherwise("ok")
    return checked.select("lei", ratio.alias("cap_revenue"), verdict.alias("finding"))


def classify_import(entered: DataFrame) -> DataFrame:
    """What becomes of every row of a filled-in worksheet.

    ``entered``: lei, shares (text), source, note and the joined context columns price,
    revenue, wavg_basic, wavg_diluted, current_shares, current_source.
    """
    raw = F.regexp_replace(F.trim(F.coalesce("shares", F.lit(""))), ",", "")
    source = F.trim(F.when(F.coalesce("source", F.lit("")) == "", "manual").otherwise(F.col("source")))
    rows = entered.withColumns({"raw": raw, "count": numbers.parse_number(raw), "origin": source,
                                "derived": F.coalesce(numbers.nonzero(F.col("wavg_diluted")), F.col("wavg_basic"))})
    count = F.col("count")
    unchanged = F.coalesce(numbers.same_count(F.col("current_shares"), count)
                           & (F.col("current_source") == F.col("origin")), F.lit(False))
    band = in_cap_band(F.col("price"), count, numbers.nonzero(F.col("revenue")))
    gap = F.try_divide(F.abs(count - F.col("derived")), count)
    outcome = (F.when((F.coalesce(F.trim("lei"), F.lit("")) == "") | (F.col("raw") == ""), "blank")
               .when(count.isNull(), "not_a_number").when(count <= 0, "not_positive")
               .when(unchanged, "unchanged").when(~F.coalesce(band, F.lit(True)), "out_of_band")
               .when((F.col("derived") > 0) & (gap > 0.05), "stored_with_warning").otherwise("stored"))
    return rows.withColumn("outcome", outcome)


def import_counts(classified: DataFrame) -> DataFrame:
    stored = F.col("outcome").isin("stored", "stored_with_warning")
    return classified.agg(
        F.count_if(stored).alias("stored"), F.count_if(F.col("outcome") == "unchanged").alias("unchanged"),
        F.count_if(F.col("outcome") == "blank").alias("blank"),
        F.count_if(F.col("outcome").isin("not_a_number", "not_positive", "out_of_band")).alias("rejected"),
        F.count_if(F.col("outcome") == "stored_with_warning").alias("warned"))


def imported_rows(classified: DataFrame, today: Column) -> DataFrame:
    return classified.where(F.col("outcome").isin("stored", "stored_with_warning")).select(
        "lei", today.alias("as_of"), F.col("count").alias("shares"), F.col("origin").alias("source"),
        text.blank_to_null(F.trim(F.coalesce("note", F.lit("")))).alias("note"))
