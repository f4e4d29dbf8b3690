"""Ordered picks by combined aggregation, and values carried along bounded streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from accountloom.session import cut_lineage


def earliest(df: DataFrame, keys: list[str], order: list[Column], carry: list[str]) -> DataFrame:
    """The row with the smallest order key per group, by map-side combined aggregation.

    A ranked window would bring a whole group to one task; this keeps one row per group
    and task before the shuffle.
    """
    won = F.min_by(F.struct(*carry), F.struct(*order)).alias("_won")
    return df.groupBy(*keys).agg(won).select(*keys, "_won.*")


def latest(df: DataFrame, keys: list[str], order: list[Column], carry: list[str]) -> DataFrame:
    """The row with the greatest order key per group; see :func:`earliest`."""
    won = F.max_by(F.struct(*carry), F.struct(*order)).alias("_won")
    return df.groupBy(*keys).agg(won).select(*keys, "_won.*")


def known_so_far(df: DataFrame, keys: list[str], order: list[str], carried: dict[str, Column],
                 include_current: bool = True) -> DataFrame:
    """Last non-null value of each ``carried`` expression up to every row of its key.

    For streams with a bounded number of rows per key: callers first reduce them to one row
    per key, day and kind, so a key never holds more rows than the calendar has days.
    Calls with the same keys and order share one shuffle and one sort.
    """
    before = W.partitionBy(*keys).orderBy(*order) \
        .rowsBetween(W.unboundedPreceding, 0 if include_current else -1)
    return df.select("*", *[F.last(c, ignorenulls=True).over(before).alias(n) for n, c in carried.items()])


def evaluate_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns whose costly expressions must not be repeated in later filters.

    The optimizer copies an expression into every filter it moves below the projection.
    Behind a generator the values are computed once per row and filters stay above it.
    """
    made = df.select("*", F.struct(*[c.alias(n) for n, c in columns.items()]).alias("_made"))
    return made.select(*df.columns, F.explode(F.array("_made")).alias("_made")).select(
        *df.columns, *[F.col(f"_made.{n}").alias(n) for n in columns])


MEDIAN_VALUES = 4096
MEDIAN_PIECES = 256


def exact_median(df: DataFrame, keys: list[str], value: Column, name: str = "median",
                 small: int = MEDIAN_VALUES, pieces: int = MEDIAN_PIECES) -> DataFrame:
    """The exact median of a number per group; groups without a value are left out.

    Equal values are counted first, combined before the shuffle. While a group has more than ``small``
    different values, it is cut into ``pieces`` ranges at approximate quantiles, the ranges are counted
    exactly, and only those that hold the middle are kept. So no task ever sorts a whole group, however
    few groups there are, and the driver sees one number per round.
    """
    if small < 2 or pieces < 4:
        raise ValueError("two values can be the middle, and fewer than four ranges do not narrow them down")
    held = df.select(*keys, value.cast("double").alias("_v")).where(F.col("_v").isNotNull()) \
        .groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n"))
    held = cut_lineage(held)
    total = F.sum("_n")
    state = held.groupBy(*keys).agg(
        F.expr("(sum(_n) - 1) div 2").alias("_k1"), F.expr("sum(_n) div 2").alias("_k2"), F.lit(0).cast("long").alias("_below"),
        F.count(F.lit(1)).alias("_different"))
    state = cut_lineage(state)
    cuts = [i / pieces for i in range(1, pieces)]
    same = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys]
    while (state.agg(F.max("_different")).first()[0] or 0) > small:
        pivots = held.groupBy(*keys).agg(F.percentile_approx("_v", cuts, 10 * pieces).alias("_pivots"))
        placed = held.alias("h").join(pivots.alias("p"), same("h", "p")).select(
            "h.*", F.size(F.filter("_pivots", lambda p: p < F.col("_v"))).alias("_piece"))
        placed = cut_lineage(placed)
        counted = placed.groupBy(*keys, "_piece").agg(total.alias("_n"), F.count(F.lit(1)).alias("_d"))
        before = F.sum("_n").over(W.partitionBy(*keys).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1))
        ranges = counted.alias("c").join(state.alias("s"), same("c", "s")).select("c.*", "_k1", "_k2", "_below") \
            .withColumn("_before", F.col("_below") + F.coalesce(before, F.lit(0)))
        middle = ranges.where((F.col("_before") <= F.col("_k2")) & (F.col("_before") + F.col("_n") > F.col("_k1")))
        state = cut_lineage(middle.groupBy(*keys, "_k1", "_k2").agg(
            F.min("_before").alias("_below"), F.sum("_d").alias("_different")))
        kept = middle.select(*keys, "_piece")
        held = cut_lineage(placed.alias("h").join(
            kept.alias("k"), [*same("h", "k"), F.col("h._piece") == F.col("k._piece")], "left_semi").drop("_piece"))
    upto = F.sum("_n").over(W.partitionBy(*keys).orderBy("_v"))
    steps = held.alias("h").join(state.alias("s"), same("h", "s")).select("h.*", "_k1", "_k2", "_below") \
        .withColumn("_upto", F.col("_below") + upto)
    at = lambda k: F.min(F.when(F.col("_upto") > F.col(k), F.col("_v")))
    return steps.groupBy(*keys).agg(((at("_k1") + at("_k2")) / 2).alias(name))
