"""Ladders, rate series, sheet cells and run records as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RUNG = "STRUCT<coverage_from: DOUBLE, rating: STRING, rating_full: STRING, spread: DOUBLE>"
CHECKS = "ARRAY<STRUCT<cell: STRING, severity: STRING, message: STRING>>"
SIDECAR = (f"company STRUCT<lei: STRING, ticker: STRING, name: STRING, country: STRING, industry: STRING>, "
           f"market_inputs STRUCT<market_cap_millions: DOUBLE, price_age_days: INT>, "
           f"results STRUCT<verdict: STRING, upside: DOUBLE, value_per_share: DOUBLE, current_price: DOUBLE>, "
           f"checks {CHECKS}, decision STRUCT<qualifies_on_verdict: BOOLEAN, research_flag: BOOLEAN, "
           f"suppressed_by: ARRAY<STRING>, suppressor_messages: ARRAY<STRING>>, _corrupt_record STRING")


def read_ladder(spark: SparkSession, path: str) -> DataFrame:
    """Rungs of every ladder of a reference file, with vintage and size cut-off."""
    schema = f"vintage STRING, size_cutoff STRUCT<eur_millions: DOUBLE>, tables MAP<STRING, STRUCT<rows: ARRAY<{RUNG}>>>"
    doc = spark.read.schema(schema).json(path, multiLine=True)
    tables = doc.select("vintage", F.col("size_cutoff.eur_millions").alias("cutoff"),
                        F.explode("tables").alias("table", "t"))
    return tables.select("table", "vintage", "cutoff", F.posexplode("t.rows").alias("row", "r")) \
        .select("table", "row", "r.*", "cutoff", "vintage")


def read_rate_series(spark: SparkSession, path: str) -> DataFrame:
    """Observations of rate files; ``ord`` orders them by file name, block and line."""
    rows = spark.read.csv(path, header=True)
    return rows.select("OBS_VALUE", "TIME_PERIOD", F.struct(
        F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line")).alias("ord"))


CELLS = T.StructType([
    T.StructField("file", T.StringType()), T.StructField("sheet", T.StringType()),
    T.StructField("row", T.IntegerType()), T.StructField("col", T.IntegerType()),
    T.StructField("text", T.StringType()), T.StructField("number", T.DoubleType())])


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """Sheet cells from a long table: file, sheet, row, col, text, number."""
    return spark.read.schema(CELLS).parquet(path)


def read_sidecars(spark: SparkSession, path: str, run_date: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, unreadable files) of one run folder, or of one date by file name."""
    glob = f"*_{run_date}.provenance.json" if run_date else "*.provenance.json"
    rows = spark.read.schema(SIDECAR).json(
        path, multiLine=True, pathGlobFilter=glob, columnNameOfCorruptRecord="_corrupt_record")
    named = rows.select("*", F.col("_metadata.file_name").alias("file"))
    day = F.regexp_extract("file", r"_([0-9]{4}-[0-9]{2}-[0-9]{2})\.provenance\.json$", 1)
    dated = named.withColumn("run_date", F.when(day != "", day).try_cast("date"))
    broken = F.col("_corrupt_record").isNotNull() | F.col("company").isNull()
    return dated.where(~broken).drop("_corrupt_record"), dated.where(broken).select("file")


def latest_run(runs: DataFrame) -> DataFrame:
    """Rows of the newest run.

    The newest date is a scalar subquery. Where ``run_date`` is a partition column, it becomes a
    partition filter, and only the files of that run are read.
    """
    return runs.where(F.col("run_date") == newest_run_date(runs))


def newest_run_date(runs: DataFrame) -> Column:
    """The newest run date as a scalar subquery; null without runs."""
    return runs.agg(F.max("run_date")).scalar()


def earlier_runs(runs: DataFrame) -> DataFrame:
    """Rows of all runs but the newest; the newest one's files are not read."""
    return runs.where(F.col("run_date") < newest_run_date(runs))


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Stored runs, one partition per run date."""
    return spark.read.parquet(path).withColumn("run_date", F.col("run_date").cast("date"))


def read_triggers(spark: SparkSession, path: str) -> DataFrame:
    """Trigger records of stored runs, keyed by entity or, in old files, by ticker."""
    entry = ("STRUCT<lei: STRING, ticker: STRING, value_per_share: DOUBLE, price: DOUBLE, trigger_price: DOUBLE, "
             "watch_price: DOUBLE, verdict: STRING, research_flag: BOOLEAN, void: BOOLEAN, "
             "blocking_checks: ARRAY<STRING>>")
    schema = f"valuation_date STRING, research_queue ARRAY<STRING>, triggers MAP<STRING, {entry}>"
    doc = spark.read.schema(schema).json(path, multiLine=True)
    rows = doc.select(F.col("valuation_date").try_cast("date").alias("run_date"),
                      F.coalesce("research_queue", F.array().cast("array<string>")).alias("queue"),
                      F.explode("triggers").alias("key", "t"))
    return rows.select("run_date", "key", F.array_contains("queue", F.col("key")).alias("queued"), "t.*")


def fingerprints(spark: SparkSession, paths: list[str]) -> DataFrame:
    """First sixteen hex digits of the SHA-256 of each parameter file; null when it is missing."""
    wanted = spark.createDataFrame([(p.rstrip("/").rsplit("/", 1)[-1],) for p in paths], "name string")
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*").option("ignoreMissingFiles", "true") \
        .load(sorted({p.rsplit("/", 1)[0] for p in paths})).select(
            F.element_at(F.split("path", "/"), -1).alias("name"), fingerprint(F.col("content")).alias("fingerprint"))
    return wanted.join(found, "name", "left")


def fingerprint(content: Column) -> Column:
    return F.substring(F.sha2(content, 256), 1, 16)
