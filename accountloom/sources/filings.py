"""Filing index, filing documents and the entity list as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from accountloom import spec
from accountloom.functions import dates, numbers, text
from accountloom.functions.ordered import evaluate_once

RAW_FILING = T.StructType([
    T.StructField("lei", T.StringType()), T.StructField("name", T.StringType()),
    T.StructField("country", T.StringType()), T.StructField("reporting_date", T.StringType()),
    T.StructField("last_end_date", T.StringType()), T.StructField("filing_index", T.StringType()),
    T.StructField("language", T.StringType()), T.StructField("error_count", T.IntegerType()),
    T.StructField("json_url", T.StringType()), T.StructField("package_url", T.StringType()),
])
COVERAGE_CSV = T.StructType([
    T.StructField("lei", T.StringType()), T.StructField("name", T.StringType()),
    T.StructField("country", T.StringType()), T.StructField("complete", T.StringType()),
    T.StructField("years_held", T.IntegerType()), T.StructField("years_present", T.StringType()),
    T.StructField("missing_years", T.StringType()), T.StructField("fiscal_month", T.StringType()),
    T.StructField("consistent_year_end", T.StringType()),
    T.StructField("archive_error_count", T.LongType()),
])
DOCUMENT = T.StructType([T.StructField("facts", T.MapType(T.StringType(), T.StructType([
    T.StructField("value", T.StringType()),
    T.StructField("dimensions", T.MapType(T.StringType(), T.StringType())),
])))])


def normalise_filings(raw: DataFrame, order: Column, *extra: str) -> DataFrame:
    """Index records with a date; missing texts and numbers get their neutral value."""
    empty = F.lit("")
    day = F.coalesce(F.col("reporting_date").cast("string"), F.col("last_end_date").cast("string"))
    return raw.select(
        F.coalesce(text.blank_to_null(F.col("lei")), F.lit("UNKNOWN")).alias("lei"),
        F.coalesce("name", empty).alias("name"),
        F.coalesce("country", empty).alias("country"),
        dates.iso_date(day).alias("reporting_date"),
        F.coalesce("filing_index", empty).alias("filing_index"),
        F.coalesce("language", empty).alias("language"),
        F.coalesce("error_count", F.lit(0)).alias("error_count"),
        F.coalesce("json_url", empty).alias("json_url"),
        F.coalesce("package_url", empty).alias("package_url"),
        order.alias("ord"), *extra,
    ).where(F.col("reporting_date").isNotNull())


def read_filing_index(spark: SparkSession, path: str) -> DataFrame:
    """The records of all country files that can be read; see :func:`read_index_files`."""
    return read_index_files(spark, path, "*.json")[0].drop("path")


def read_index_files(spark: SparkSession, path: str, pattern: str = "*") -> tuple[DataFrame, DataFrame]:
    """(records, broken): one JSON array per country file, read element by element.

    A file that does not parse ends up in ``broken`` (path, file, reason, bytes) instead of vanishing; a
    record of a file that does, but is no object of the index, is listed there as well. A file is
    never split, so the row id ascends in it: the record order of the archive, which decides ties
    later, is (file, row id).
    """
    kept = T.StructType([*RAW_FILING.fields, T.StructField("_corrupt_record", T.StringType())])
    rows = spark.read.schema(kept).json(path, multiLine=True, mode="PERMISSIVE", pathGlobFilter=pattern,
                                        columnNameOfCorruptRecord="_corrupt_record")
    named = rows.select("*", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("pos"))
    known = F.coalesce(*[F.col(f.name).cast("string") for f in RAW_FILING.fields]).isNotNull()
    good = named.where(F.col("_corrupt_record").isNull() & known).drop("_corrupt_record") \
        .withColumn("country", F.coalesce(text.blank_to_null(F.col("country")), F.regexp_replace("file", r"\.json$", "")))
    bad = named.where(F.col("_corrupt_record").isNotNull() | ~known).select(
        "path", "file", F.when(F.col("_corrupt_record").isNull(), "no index record").otherwise("does not parse").alias("reason"),
        F.octet_length("_corrupt_record").alias("bytes"))
    return normalise_filings(good, F.struct("file", "pos"), "path"), bad


def file_report(records: DataFrame, broken: DataFrame, name: Column) -> DataFrame:
    """Per file: how many records it gave, and why it gave none; ``name`` is made from the path."""
    read = records.select("path", F.lit(1).alias("_n"), F.lit("").alias("reason"))
    lost = broken.select("path", F.lit(0).alias("_n"), "reason")
    return read.unionByName(lost).groupBy(name.alias("file")).agg(
        F.sum("_n").alias("records"), F.max("reason").alias("reason"))


def read_universe(spark: SparkSession, path: str) -> DataFrame:
    """Complete entities of a coverage file.

    Spark reads any text equal to ``nullValue`` as missing, a quoted empty one too; the mark, which no
    report holds, leaves that to fields without anything in them.
    """
    return spark.read.csv(path, schema=COVERAGE_CSV, header=True, escape='"', multiLine=True, nullValue="\x00", emptyValue="") \
        .where(F.col("complete") == "YES")


def split_excluded_names(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped) by business words in the entity name; two filters over one input."""
    hit = text.contains_any(F.lower(F.coalesce("name", F.lit(""))), spec.EXCLUDED_NAME_PARTS)
    return rows.where(~hit), rows.where(hit)


PART_BITS, ROW_BITS, FACT_BITS = 12, 26, 16
"""How many partitions, documents of a partition, and facts of a document an ordinal can tell apart."""


def number_documents(documents: DataFrame, order: list[str | Column], name: str = "doc_no", at_least: int = 1,
                     whole: int | None = None) -> DataFrame:
    """Adds a whole number that ascends with ``order``, short enough to be packed into a rank.

    Rows are dealt by range and sorted within their partition, so the number is the partition and
    the place in it. Write the result before using it twice. ``at_least`` is a number of partitions
    below which the setting for shuffles is not followed. Rows that agree in the first ``whole`` columns of
    the order stay in one partition, and Spark knows the rows to be partitioned by these.
    """
    parts = max(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), at_least)
    sorted_ = documents.repartitionByRange(min(parts, 1 << PART_BITS), *order[:whole]).sortWithinPartitions(*order)
    rows = sorted_.withColumn("_id", F.monotonically_increasing_id())
    part, row = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    number = F.shiftleft(part, ROW_BITS) + _below(row, ROW_BITS, "too many documents in a partition")
    return rows.withColumn(name, number).drop("_id")


def _below(c: Column, bits: int, message: str) -> Column:
    return F.when(c < (1 << bits), c).otherwise(F.raise_error(F.lit(message)).cast("long"))


def parse_documents(documents: DataFrame, keys: list[str], order: list[str],
                    body: str = "body") -> DataFrame:
    """One row per fact of every filing document, with the reason it is or is not usable.

    ``outcome`` is numeric, dimensional, incomplete, blank, nonnumeric or bad_period.
    ``ord`` keeps the document order, which decides between duplicates: the number of the
    document (the one column of ``order``; none where a key has one document) and the place in it.
    """
    return classify_facts(open_documents(documents, keys, order, body), keys)


def open_documents(documents: DataFrame, keys: list[str], order: list[str], body: str = "body") -> DataFrame:
    """One row per fact of every filing document, its texts as written; see :func:`parse_documents`.

    A fact is made flat where its document is opened, so its map of dimensions is not copied into a row.
    """
    if len(order) > 1:
        raise ValueError("number the documents first")
    nothing = F.array().cast("array<string>")
    dims = lambda e: F.coalesce(e["value"]["dimensions"], F.map_from_arrays(nothing, nothing))
    at = lambda e, name: F.try_element_at(dims(e), F.lit(name))
    flat = F.transform(F.map_entries(F.from_json(body, DOCUMENT)["facts"]), lambda e, i: F.struct(
        i.cast("long").alias("pos"), at(e, "concept").alias("concept"), at(e, "period").alias("raw_period"),
        at(e, "unit").alias("unit"), e["value"]["value"].alias("raw"),
        F.exists(F.map_keys(dims(e)), lambda d: ~d.isin(*spec.CORE_DIMENSIONS)).alias("dimensional")))
    opened = documents.select(*keys, *order, F.explode(flat).alias("f"))
    number = F.col(order[0]).cast("long") if order else F.lit(0).cast("long")
    place = _below(F.col("f.pos"), FACT_BITS, "too many facts in a document")
    return opened.select(*keys, (F.shiftleft(number, FACT_BITS) + place).alias("ord"),
                         *[f"f.{c}" for c in ("concept", "raw_period", "unit", "raw", "dimensional")])


def _has_text(c: str) -> Column:
    return F.coalesce(F.col(c) != "", F.lit(False))


def _prefix(concept: Column, tail: Column) -> Column:
    return F.when(F.coalesce(tail, F.lit("")) != "", F.substring_index(concept, ":", 1)).otherwise(F.lit(""))


def _tail(concept: Column) -> Column:
    return F.when(concept.contains(":"), F.substring(concept, F.instr(concept, ":") + 1, F.length(concept)))


def classify_facts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Split concepts, parse values and periods, and name the outcome of every fact.

    The texts are cut first and read in two further steps: as one expression the generated code grows
    beyond what the JVM compiles, and every fact is then interpreted.
    """
    concept = F.col("concept")
    left, right, is_duration = dates.period_texts(F.col("raw_period"))
    cut = evaluate_once(rows, _left=left, _right=right, _duration=is_duration, _tail=_tail(concept))
    start, end_day, past = dates.period_days(F.col("_left"), F.col("_right"), F.col("_duration"))
    read = evaluate_once(cut, value=numbers.parse_number(F.col("raw")), _start=start)
    read = evaluate_once(read, _end=end_day, _past=past)
    parsed = evaluate_once(
        read, local_name=F.coalesce(text.blank_to_null(F.col("_tail")), concept),
        prefix=_prefix(concept, F.col("_tail")),
        p=dates.period_of(F.col("_start"), F.col("_end"), F.col("_past"), F.col("_duration")))
    outcome = (F.when(F.col("dimensional"), "dimensional")
               .when(~_has_text("concept") | ~_has_text("raw_period"), "incomplete")
               .when(~_has_text("raw"), "blank")
               .when(F.col("value").isNull(), "nonnumeric")
               .when(F.col("p").isNull(), "bad_period")
               .otherwise("numeric"))
    return parsed.select(
        *keys, "ord", "concept", "prefix", "local_name", "value", "unit",
        F.col("p.start").alias("start"), F.col("p.end").alias("end"),
        F.col("p.is_duration").alias("is_duration"),
        F.coalesce(F.col("prefix").startswith("ifrs"), F.lit(False)).alias("is_ifrs"),
        F.datediff("p.end", "p.start").alias("days"),
        outcome.alias("outcome"))


def valued_facts(rows: DataFrame) -> DataFrame:
    """Opened facts with a value; numeric ones but for the period, which is still as written."""
    told = rows.where(~F.col("dimensional") & _has_text("concept") & _has_text("raw_period") & _has_text("raw"))
    return evaluate_once(told.drop("dimensional"), value=numbers.parse_number(F.col("raw"))).drop("raw") \
        .where(F.col("value").isNotNull())


def read_texts(rows: DataFrame) -> DataFrame:
    """Reads the concept and the written period of every row, which may stand for many facts; bad periods are left out.

    Adds what :func:`classify_facts` makes of them: local_name, is_ifrs, end, is_duration and days.
    """
    concept = F.col("concept")
    left, right, is_duration = dates.period_texts(F.col("raw_period"))
    cut = evaluate_once(rows, _left=left, _right=right, _duration=is_duration, _tail=_tail(concept))
    start, end_day, past = dates.period_days(F.col("_left"), F.col("_right"), F.col("_duration"))
    read = evaluate_once(cut, _start=start, _end=end_day, _past=past)
    parsed = evaluate_once(
        read, local_name=F.coalesce(text.blank_to_null(F.col("_tail")), concept),
        is_ifrs=F.coalesce(_prefix(concept, F.col("_tail")).startswith("ifrs"), F.lit(False)),
        p=dates.period_of(F.col("_start"), F.col("_end"), F.col("_past"), F.col("_duration")))
    return parsed.where(F.col("p").isNotNull()).select(
        *[c for c in rows.columns if c != "raw_period"], "local_name", "is_ifrs", F.col("p.end").alias("end"),
        F.col("p.is_duration").alias("is_duration"), F.datediff("p.end", "p.start").alias("days"))


def numeric_facts(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("outcome") == "numeric").drop("outcome")


def skipped_counts(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """Facts left out per filing, by reason."""
    return parsed.groupBy(*keys).agg(
        F.count_if(F.col("outcome") == "dimensional").alias("skipped_dimensional"),
        F.count_if(F.col("outcome") == "nonnumeric").alias("skipped_nonnumeric"))


def dimensional_only_names(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """Local names a filing carries only as breakdowns."""
    return parsed.groupBy(*keys, "local_name").agg(
        F.bool_and(F.col("outcome") == "dimensional").alias("only")) \
        .where("only").drop("only")
