"""Aggregates, lists and published tables of one screening run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accountloom import spec
from accountloom.functions import numbers, ordered, text
from accountloom.operators.valuation import is_void

LABELS = ("VOID", "UNDERVALUED", "SUPPRESSED", "FAIRLY VALUED", "OVERVALUED")


def held_back() -> Column:
    return F.size("suppressed_by") > 0


def has_findings() -> Column:
    """Void, flagged, or held back: the rows worth reading."""
    return is_void(F.col("checks")) | F.col("research_flag") | held_back()


def with_labels(results: DataFrame) -> DataFrame:
    return results.withColumns({
        "void": is_void(F.col("checks")), "finding": has_findings(),
        "short_verdict": text.short_verdict(F.col("verdict"), held_back()),
        "size_bucket": numbers.size_bucket(F.col("market_cap_m"), spec.SIZE_BUCKETS[-1][0]),
        "trigger_price": numbers.trigger_price(F.col("value_per_share")),
        "watch_price": numbers.watch_price(F.col("value_per_share"))})


def verdict_counts(results: DataFrame) -> DataFrame:
    return results.groupBy(F.coalesce(text.blank_to_null(F.col("verdict")), F.lit("(blank)")).alias("verdict")) \
        .agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "verdict")


def suppression_counts(results: DataFrame) -> DataFrame:
    """How often each check held an undervalued company back."""
    return results.where("qualifies_on_verdict").select(F.explode("suppressed_by").alias("cell")) \
        .groupBy("cell").agg(F.count(F.lit(1)).alias("n"))


def suppression_rate(results: DataFrame) -> DataFrame:
    under, queue = F.count_if("qualifies_on_verdict"), F.count_if("research_flag")
    return results.agg(under.alias("undervalued"), queue.alias("queue"),
                       F.coalesce(F.try_divide(under - queue, under), F.lit(0.0)).alias("suppression_rate"))


def suppression_report(results: DataFrame, policy: spec.Policy = spec.Policy()) -> DataFrame:
    """Counts with their share of the undervalued and the remark that goes with them.

    The total rides along as a pseudo cell of the same aggregation, so the report needs no
    second pass; it is one row, which is broadcast.
    """
    under = results.where("qualifies_on_verdict").select(
        F.explode(F.array_append("suppressed_by", F.lit(""))).alias("cell"))
    counts = under.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    whole = counts.where(F.col("cell") == "").select(F.lit(1).alias("_k"), F.col("n").alias("undervalued"))
    share = F.col("n") / F.col("undervalued")
    return counts.where(F.col("cell") != "").withColumn("_k", F.lit(1)).join(F.broadcast(whole), "_k").select(
        "cell", "n", share.alias("share"),
        numbers.suppression_tag(F.col("cell"), tuple(policy.graded), share).alias("remark"))


def fail_reasons(results: DataFrame) -> DataFrame:
    return _opened(results).where(F.col("severity") == "FAIL").groupBy("cell") \
        .agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "cell")


def _opened(results: DataFrame, *extra: str) -> DataFrame:
    return results.select(*extra, F.posexplode("checks").alias("pos", "check")) \
        .select(*extra, "pos", "check.*")


def check_messages(results: DataFrame) -> DataFrame:
    """A readable message per check: the last one that fired, else the first one seen."""
    rows = _opened(results, "ord")
    fired = F.col("severity").isin("FAIL", "WARNING", "NOTE") \
        & ~F.upper(F.trim("message")).startswith("OK")
    at = F.struct("ord", "pos")
    return rows.groupBy("cell").agg(F.coalesce(
        F.max_by("message", F.when(fired, at)), F.min_by("message", at)).alias("message"))


TOTAL = "all"


def _sized(results: DataFrame) -> DataFrame:
    """Short verdicts by bucket, with one row without a verdict for every bucket there is."""
    buckets = F.array(*[F.lit(b[0]) for b in spec.SIZE_BUCKETS])
    real = with_labels(results).select("size_bucket", "short_verdict")
    spine = results.sparkSession.range(1).select(
        F.explode(buckets).alias("size_bucket"), F.lit(None).cast("string").alias("short_verdict"))
    return real.unionByName(spine)


def _verdict_columns() -> list[Column]:
    return [F.count("short_verdict").alias("n"),
            F.count_if(F.col("short_verdict") == "VOID").alias("void"),
            F.count_if(F.col("short_verdict").isin("UNDERVALUED", "SUPPRESSED")).alias("under"),
            F.count_if(F.col("short_verdict") == "FAIRLY VALUED").alias("fair"),
            F.count_if(F.col("short_verdict") == "OVERVALUED").alias("over")]


def size_by_verdict(results: DataFrame) -> DataFrame:
    """Verdict counts per size bucket; all four buckets are always there."""
    return _sized(results).groupBy("size_bucket").agg(*_verdict_columns())


def size_by_verdict_with_total(results: DataFrame) -> DataFrame:
    """Verdict counts per size bucket and over all of them, in one pass of grouping sets.

    ``grouping_id`` tells the total from a bucket, so a bucket without a label is still a bucket.
    """
    bucket = F.col("size_bucket")
    rows = _sized(results).groupingSets([[bucket], []], bucket).agg(F.grouping_id().alias("_set"), *_verdict_columns())
    return rows.withColumn("size_bucket", F.when(F.col("_set") == 1, F.lit(TOTAL)).otherwise(bucket)).drop("_set")


def outcomes_by_size(results: DataFrame) -> DataFrame:
    """Counts, rates and the median distance from the market, per size bucket.

    There are four buckets, so the median is selected by counted ranges (``ordered.exact_median``)
    instead of being sorted in four tasks.
    """
    bucketed = results.withColumn("size_bucket", numbers.size_bucket(F.col("market_cap_m"), None)) \
        .where(F.col("size_bucket").isNotNull())
    n = F.count(F.lit(1))
    under, held = F.count_if("qualifies_on_verdict"), F.count_if(held_back())
    counts = bucketed.groupBy("size_bucket").agg(
        n.alias("n"), F.count_if(F.coalesce(F.col("verdict").startswith("VOID"), F.lit(False))).alias("void"),
        under.alias("undervalued"), held.alias("suppressed"),
        F.coalesce(F.try_divide(held, under), F.lit(0.0)).alias("suppressed_rate"),
        (n < spec.THIN_BUCKET).alias("thin"))
    middle = ordered.exact_median(bucketed, ["size_bucket"], F.abs("upside"), "median_abs_upside")
    return counts.join(middle, "size_bucket", "left").select(
        "size_bucket", "n", "void", "undervalued", "suppressed", "suppressed_rate",
        F.coalesce("median_abs_upside", F.lit(0.0)).alias("median_abs_upside"), "thin")


def check_rates_by_size(results: DataFrame) -> DataFrame:
    """Share of a bucket's companies in which each FAIL or WARNING check fired.

    The bucket size is counted by a pseudo cell in the same aggregation.
    """
    bucketed = results.withColumn("size_bucket", numbers.size_bucket(F.col("market_cap_m"), None)) \
        .where(F.col("size_bucket").isNotNull())
    fired = F.filter("checks", lambda c: c["severity"].isin("FAIL", "WARNING"))
    cells = F.array_append(F.transform(fired, lambda c: c["cell"]), F.lit(""))
    counts = bucketed.select("size_bucket", F.explode(cells).alias("cell")) \
        .groupBy("size_bucket", "cell").agg(F.count(F.lit(1)).alias("n"))
    sizes = counts.where(F.col("cell") == "").select("size_bucket", F.col("n").alias("companies"))
    return counts.where(F.col("cell") != "").join(sizes, "size_bucket").select(
        "size_bucket", "cell", "n", (F.col("n") / F.col("companies")).alias("rate"))


def check_rates_with_total(results: DataFrame) -> DataFrame:
    """Share of companies in which each FAIL or WARNING check fired, per bucket and over all buckets.

    Both levels come from one pass of grouping sets over (bucket, cell); the companies of a level are
    the pseudo cell of the same aggregation.
    """
    bucketed = results.withColumn("size_bucket", numbers.size_bucket(F.col("market_cap_m"), None)) \
        .where(F.col("size_bucket").isNotNull())
    fired = F.filter("checks", lambda c: c["severity"].isin("FAIL", "WARNING"))
    cells = F.array_append(F.transform(fired, lambda c: c["cell"]), F.lit(""))
    bucket, cell = F.col("size_bucket"), F.col("cell")
    counts = bucketed.select("size_bucket", F.explode(cells).alias("cell")) \
        .groupingSets([[bucket, cell], [cell]], bucket, cell) \
        .agg(F.grouping("size_bucket").alias("_whole"), F.count(F.lit(1)).alias("n")) \
        .withColumn("size_bucket", F.when(F.col("_whole") == 1, F.lit(TOTAL)).otherwise(bucket)).drop("_whole")
    sizes = counts.where(cell == "").select("size_bucket", F.col("n").alias("companies"))
    return counts.where(cell != "").join(sizes, "size_bucket").select(
        "size_bucket", "cell", "n", (F.col("n") / F.col("companies")).alias("rate"))


def pick_funnel(results: DataFrame) -> DataFrame:
    return results.agg(
        F.count(F.lit(1)).alias("valued"), F.count_if(~is_void(F.col("checks"))).alias("passed"),
        F.count_if("qualifies_on_verdict").alias("undervalued"), F.count_if("research_flag").alias("queue"))


def research_queue(results: DataFrame) -> DataFrame:
    """Flagged companies, largest upside first."""
    return results.where("research_flag").orderBy(F.coalesce("upside", F.lit(0.0)).desc(), "lei")


def findings(results: DataFrame) -> DataFrame:
    """Rows worth reading with a one-line note, flagged first, then by verdict."""
    fails = F.transform(F.filter("checks", lambda c: c["severity"] == "FAIL"), lambda c: c["message"])
    held = F.transform(F.filter("checks", lambda c: F.array_contains(F.col("suppressed_by"), c["cell"])),
                       lambda c: c["message"])
    rows = with_labels(results).where("finding").withColumns({"_fails": fails, "_held": held})
    more = lambda c: F.when(F.size(c) > 1, F.concat(F.lit("  (+"), (F.size(c) - 1).cast("string"), F.lit(")"))) \
        .otherwise(F.lit(""))
    note = lambda c: F.concat(text.shorten(text.strip_severity(F.try_element_at(c, F.lit(1))), 32), more(c))
    return rows.withColumn("note", F.when(F.col("void"), note(F.col("_fails")))
                           .when(F.col("research_flag"), F.lit("RESEARCH"))
                           .when(held_back(), note(F.col("_held"))).otherwise(F.lit(""))) \
        .drop("_fails", "_held").orderBy(~F.col("research_flag"), "verdict", "lei")


def reasons(results: DataFrame) -> DataFrame:
    """Why each usable finding landed where it did, flagged first, then by ticker."""
    line = text.why(F.col("wacc"), F.col("implied_rating"), F.col("terminal_share_of_ev"),
                    F.col("margin_vs_industry"), F.col("roic_vs_industry"))
    rows = with_labels(results).where(F.col("finding") & ~F.col("void")).withColumn("why", line)
    return rows.where(F.col("why") != "").orderBy(~F.col("research_flag"), "ticker", "lei")


def held_and_void_reasons(results: DataFrame) -> DataFrame:
    """Ticker lists of the published page with the reason behind each, in ticker order."""
    void = is_void(F.col("checks"))
    fails = F.transform(F.filter("checks", lambda c: c["severity"] == "FAIL"), lambda c: c["message"])
    held = F.col("qualifies_on_verdict") & ~F.col("research_flag")
    lists = F.array_compact(F.array(
        F.when(held, F.struct(F.lit("held").alias("list"), text.joined_reasons(F.col("suppressor_messages")).alias("reason"))),
        F.when(void, F.struct(F.lit("void").alias("list"), text.joined_reasons(fails).alias("reason")))))
    return results.select("lei", "ticker", F.explode(lists).alias("entry")) \
        .select("lei", "ticker", "entry.list", "entry.reason").orderBy("list", "ticker", "lei")


RESULT_SHEET = ("name", "exchange", "current_price", "value_per_share", "upside", "trigger_price", "verdict",
                "flag", "ticker", "country", "industry", "held_back_by", "wacc", "implied_rating",
                "credit_table", "price_as_of", "warnings", "notes", "fails")


def results_sheet(results: DataFrame) -> DataFrame:
    """The nineteen published columns, one row per company."""
    count = lambda s: F.size(F.filter("checks", lambda c: c["severity"] == s))
    return results.withColumns({
        "trigger_price": numbers.trigger_price(F.col("value_per_share")),
        "flag": F.when(F.col("research_flag"), "RESEARCH").otherwise(""),
        "held_back_by": F.array_join("suppressed_by", ", "),
        "warnings": count("WARNING"), "notes": count("NOTE"), "fails": count("FAIL")}).select(*RESULT_SHEET)


# What may be published.  No quoted price, no value per share, and nothing from
# which one follows (units are a stake divided by the entry price).
PUBLIC_COLUMNS = (
    "lei", "ticker", "name", "exchange", "country", "industry", "run_date", "verdict", "short_verdict", "flag",
    "research_flag", "qualifies_on_verdict", "held_back_by", "suppressed_by", "upside", "current_upside", "wacc",
    "implied_rating", "credit_table", "price_as_of", "price_age_days", "warnings", "notes", "fails", "why", "why_public",
    "size_band", "sub_industry", "void", "finding", "blocking_checks", "entry_date", "exit_date", "exit_verdict",
    "last_seen_date", "last_verdict", "status", "return_pct", "unvaluable", "missing_price", "n")


def public_view(df: DataFrame) -> DataFrame:
    """Only the columns that may be published; percentages and verdicts are among them."""
    return df.select(*[c for c in df.columns if c in PUBLIC_COLUMNS])


def triggers(results: DataFrame, run_date: Column) -> DataFrame:
    """What later price updates need, one row per valued company and run."""
    rows = with_labels(results).where(F.col("trigger_price").isNotNull())
    return rows.select(
        run_date.alias("run_date"), "lei", "ticker", "value_per_share",
        F.col("current_price").alias("price"), "trigger_price", "watch_price", "verdict",
        "research_flag", "void", "blocking_checks")


def run_summary(results: DataFrame, skipped: DataFrame) -> DataFrame:
    """Counts of one run in one row; the queue and triggers stay tables."""
    under, queue = F.count_if("qualifies_on_verdict"), F.count_if("research_flag")
    rate = F.bround(F.coalesce(F.try_divide(under - queue, under), F.lit(0.0)), 4)
    both = results.select("qualifies_on_verdict", "research_flag", F.lit(True).alias("valued")) \
        .unionByName(skipped.select(F.lit(False).alias("qualifies_on_verdict"),
                                    F.lit(False).alias("research_flag"), F.lit(False).alias("valued")))
    return both.agg(F.count_if("valued").alias("valued"), F.count_if(~F.col("valued")).alias("could_not_be_valued"),
                    under.alias("undervalued"), queue.alias("queue"), rate.alias("suppression_rate"))


def sidecars(results: DataFrame, run: Column, *extra: str) -> DataFrame:
    """The nested record behind every valuation; optional parts may be null. ``extra`` columns ride along."""
    pick = lambda *names: F.struct(*[F.col(n) for n in names if n in results.columns])
    return results.select(
        "lei", run.alias("run"),
        pick("lei", "ticker", "name", "country", "industry").alias("company"),
        pick("price", "price_as_of", "price_age_days", "shares", "market_cap_m").alias("market_inputs"),
        pick("risk_free_rate", "mature_market_erp", "long_run_nominal_growth", "crp", "tax_rate",
             "unlevered_beta", "sales_to_capital", "ebit_margin", "roic").alias("parameters"),
        pick("credit_table").alias("credit_table"),
        pick("value_per_share", "upside", "verdict", "wacc", "relevered_beta", "implied_rating",
             "terminal_share_of_ev", "margin_vs_industry", "roic_vs_industry",
             "equity_method_over_assets", "implied_ev_ebit").alias("results"),
        "checks",
        pick("verdict", "qualifies_on_verdict", "research_flag", "suppressed_by",
             "suppressor_messages", "reinvestment_ratio").alias("decision"), *extra)
