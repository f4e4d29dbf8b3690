"""Writers.  All of them write partitioned files; none brings rows to the driver."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from accountloom.session import cut_lineage


def write_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Replace exactly the partitions that come in.

    Rows are spread by the partition columns first, so a partition is written by few
    tasks; adaptive execution splits a partition that is too large for one.
    """
    df.hint("rebalance", *by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
        .partitionBy(*by).parquet(path)


def write_counted(df: DataFrame, path: str, by: list[str], counts: Mapping[str, Column]) -> dict[str, int]:
    """Write a table and return counts over its rows, taken while they are written.

    The counts are aggregates of the written rows themselves (no distinct ones), so the table is
    neither read back nor computed a second time for them.
    """
    seen = Observation()
    write_partitions(df.observe(seen, *[c.alias(name) for name, c in counts.items()]), path, by)
    return {name: int(seen.get[name] or 0) for name in counts}


def count_rows(spark: SparkSession, counts: Mapping[str, int], key: str = "outcome") -> DataFrame:
    """Counts taken beside a write as rows, those that are not zero."""
    return spark.createDataFrame([(k, n) for k, n in counts.items() if n], f"{key} string, n long")


def write_company_years(headers: DataFrame, facts: DataFrame, path: str) -> None:
    """Both extraction tables, partitioned by fiscal year.

    The incoming rows must hold whole years: use the merged output of the store upsert.
    """
    write_partitions(headers, f"{path}/company_year", ["fiscal_year"])
    write_partitions(facts, f"{path}/fact", ["fiscal_year"])


BUCKETS = 64
"""Buckets of a fiscal year in the store; a bucket is what an upsert reads and writes anew."""


def upsert_company_years(spark: SparkSession, path: str, headers: DataFrame, facts: DataFrame, buckets: int = BUCKETS) -> None:
    """Replace the incoming company-years in the store under ``path``, and write only their partitions.

    Both tables are partitioned by fiscal year and by a bucket of the entity. The stored rows of the
    touched partitions are read, less the incoming company-years, joined with what comes in, and
    overwrite exactly these partitions: the files of all others stay as they are. A failed header
    brings no facts, and its old ones go. An empty or new store takes everything.
    """
    bucket = F.pmod(F.xxhash64("lei"), F.lit(buckets)).cast("int")
    by = ["fiscal_year", "bucket"]
    keys = cut_lineage(headers.select("lei", "fiscal_year", bucket.alias("bucket")).distinct())
    touched = F.broadcast(keys.select(*by).distinct())  # at most ``buckets`` rows per fiscal year
    for name, rows in (("company_year", headers), ("fact", facts)):
        target, new = f"{path}/{name}", rows.withColumn("bucket", bucket)
        old = _stored_rows(spark, target, new)
        kept = old.join(touched, by, "left_semi").join(keys.select("lei", "fiscal_year"), ["lei", "fiscal_year"], "left_anti")
        merged = cut_lineage(kept.unionByName(new))
        emptied = old.select(*by).join(touched, by, "left_semi").distinct() \
            .join(merged.select(*by).distinct(), by, "left_anti").collect()  # partitions, not rows
        write_partitions(merged, target, by)
        _drop_partitions(spark, target, emptied, by)


def _stored_rows(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The stored table, or an empty one of the same shape where there is none yet."""
    try:
        return spark.read.schema(like.schema).parquet(path)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return like.where(F.lit(False))


def _drop_partitions(spark: SparkSession, path: str, gone: list, by: list[str]) -> None:
    """Delete the folders of partitions without rows, which an overwrite by partition leaves as they are."""
    if gone:
        base = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = base.getFileSystem(spark._jsc.hadoopConfiguration())
        for row in gone:
            files.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/" + "/".join(f"{c}={row[c]}" for c in by)), True)


EXTRACTIONS = ("company_year", "fact")


def clear_extractions(spark: SparkSession, path: str) -> dict[str, int]:
    """Drop the two extraction tables of the store under ``path``; how many rows of each went.

    Listings, prices and all other tables of the store keep their files. Rows are counted from the file
    footers. A cleared store is a new one to the next upsert; a table that is not there counts zero rows.
    """
    removed = {}
    for name in EXTRACTIONS:
        target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        files = target.getFileSystem(spark._jsc.hadoopConfiguration())
        there = files.exists(target)
        removed[name] = spark.read.parquet(f"{path}/{name}").count() if there else 0
        if there:
            files.delete(target, True)
    return removed


def write_listings(listings: DataFrame, path: str, buckets: int) -> None:
    """Listings in hash buckets of the entity, so that later joins meet co-located."""
    listings.withColumn("bucket", F.pmod(F.xxhash64("lei"), F.lit(buckets))) \
        .hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)


CSV_TEXTS = {"escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "emptyValue": '""'}
"""Texts as they are: quotes doubled, blanks kept, an empty text quoted and thereby told from a missing one."""


def write_report(df: DataFrame, path: str, header: bool = True) -> None:
    """An ordered report as CSV; list columns are expected to be joined texts."""
    df.write.mode("overwrite").options(**CSV_TEXTS).csv(path, header=header)


def write_records(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Nested records as JSON lines; infinite ratios are written as text."""
    safe = df.select(*[F.col(c).cast("string").alias(c) if t == "double" and c == "reinvestment_ratio"
                       else F.col(c) for c, t in df.dtypes])
    writer = safe.write.mode("overwrite").option("ignoreNullFields", "false")
    (writer.partitionBy(*by) if by else writer).json(path)


def write_triggers(triggers: DataFrame, path: str) -> None:
    """Trigger rows, one partition per run date; other runs stay as they are."""
    write_partitions(triggers, path, ["run_date"])


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
