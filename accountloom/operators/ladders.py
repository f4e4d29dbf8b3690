"""Credit ladders as data: rungs of any vintage looked up by a company's interest cover.

A ladder is a table of rungs (table, vintage, row, coverage_from, rating, rating_full, spread, cutoff),
read from a reference file or taken from a fetched page. Rungs become half-open ranges, so that the
lookup is an equi-join on table and vintage whose range condition at most one rung meets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from accountloom import spec

KEYS = ["table", "vintage"]


def rung_ranges(ladder: DataFrame) -> DataFrame:
    """Every rung with the cover at which it ends; the top rung has no end.

    A ladder has a handful of rungs, so its window is small; rungs that share a threshold are empty but
    for the last one. ``ladder_ascending`` says whether all thresholds of the ladder ascend by row.
    """
    by_cover = W.partitionBy(*KEYS).orderBy("coverage_from", "row")
    by_row = W.partitionBy(*KEYS).orderBy("row")
    climbs = F.coalesce(F.col("coverage_from") >= F.lag("coverage_from").over(by_row), F.lit(True))
    return ladder.withColumns({"coverage_to": F.lead("coverage_from").over(by_cover), "_climbs": climbs}) \
        .withColumn("ladder_ascending", F.bool_and("_climbs").over(W.partitionBy(*KEYS))).drop("_climbs")


def vintage_in_force(ladder: DataFrame, today: Column) -> DataFrame:
    """The rungs of every table's newest vintage (yyyy-MM) that has begun by ``today``."""
    begun = ladder.where(F.to_date(F.concat("vintage", F.lit("-01"))) <= today)
    newest = begun.groupBy("table").agg(F.max("vintage").alias("vintage"))
    return begun.join(newest, KEYS, "left_semi")


def size_cutoffs(ladder: DataFrame) -> DataFrame:
    """The market cap in millions from which on companies take the LARGE table, per vintage."""
    return ladder.groupBy("vintage").agg(F.coalesce(F.max("cutoff"), F.lit(spec.CREDIT_CUTOFF)).alias("ladder_cutoff"))


def with_credit_table(companies: DataFrame, ladder: DataFrame) -> DataFrame:
    """Adds ``credit_table`` from the cut-off that the company's vintage states."""
    cut = size_cutoffs(ladder).withColumnRenamed("vintage", "ladder_vintage")
    large = F.col("market_cap_m") >= F.coalesce("ladder_cutoff", F.lit(spec.CREDIT_CUTOFF))
    return companies.join(cut, "ladder_vintage", "left") \
        .withColumn("credit_table", F.when(large, "LARGE").otherwise("SMALL")).drop("ladder_cutoff")


def look_up(companies: DataFrame, ladder: DataFrame) -> DataFrame:
    """Adds implied_rating, ladder_spread and ladder_ascending by credit_table, ladder_vintage and coverage.

    Companies: credit_table, ladder_vintage, coverage. Infinite cover reaches the top rung; cover below
    the first rung, no cover, and a vintage without such a table give nulls.
    """
    rungs = rung_ranges(ladder).select(
        F.col("table").alias("credit_table"), F.col("vintage").alias("ladder_vintage"), "coverage_from", "coverage_to",
        F.col("rating").alias("implied_rating"), F.col("spread").alias("ladder_spread"), "ladder_ascending")
    c, r = companies.alias("c"), rungs.alias("r")
    inside = (F.col("c.coverage") >= F.col("r.coverage_from")) & (
        F.col("r.coverage_to").isNull() | (F.col("c.coverage") < F.col("r.coverage_to")))
    same = (F.col("c.credit_table") == F.col("r.credit_table")) & (F.col("c.ladder_vintage") == F.col("r.ladder_vintage"))
    return c.join(r, same & inside, "left").select("c.*", "r.implied_rating", "r.ladder_spread", "r.ladder_ascending")


def ladder_age_days(vintage: Column, today: Column) -> Column:
    """Days since the first of the vintage's month."""
    return F.datediff(today, F.to_date(F.concat(vintage, F.lit("-01"))))
