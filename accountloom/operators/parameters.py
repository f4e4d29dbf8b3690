"""Parameter sheets, the credit ladder and the company-to-industry map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from accountloom import spec
from accountloom.functions import numbers, ordered, text

SHEET = ["file", "sheet"]


# -- sheets found by content -------------------------------------------------------

def header_rows(cells: DataFrame, words: tuple[str, ...]) -> DataFrame:
    """First row of every sheet in which each of the words occurs in some cell."""
    label = F.lower(F.trim(F.coalesce("text", F.lit(""))))
    seen = cells.groupBy(*SHEET, "row").agg(
        *[F.bool_or(label.contains(w)).alias(f"w{i}") for i, w in enumerate(words)])
    for i in range(len(words)):
        seen = seen.where(f"w{i}")
    return seen.groupBy(*SHEET).agg(F.min("row").alias("header"))


def heading(include: tuple[str, ...], exclude: tuple[str, ...] = ()) -> Column:
    """A header cell with all of one list and none of another."""
    label = F.lower(F.trim(F.coalesce("text", F.lit(""))))
    ok = (label != "") & text.contains_all(label, include)
    for word in exclude:
        ok = ok & ~label.contains(word)
    return ok


def sheet_columns(cells: DataFrame, words: tuple[str, ...],
                  wanted: dict[str, tuple[tuple[str, ...], tuple[str, ...]]],
                  name_words: tuple[str, ...]) -> DataFrame:
    """Data rows of each sheet below its header: the row name and the wanted numbers.

    Header and columns are found by content.  One pass finds the columns, one groups the
    data cells by row; both are combined aggregations.
    """
    headed = cells.join(header_rows(cells, words), SHEET)
    at = headed.where(F.col("row") == F.col("header")).groupBy(*SHEET).agg(
        F.coalesce(F.min(F.when(heading(name_words), F.col("col"))), F.lit(0)).alias("c_name"),
        *[F.min(F.when(heading(inc, exc), F.col("col"))).alias(f"c_{k}") for k, (inc, exc) in wanted.items()])
    data = headed.where(F.col("row") > F.col("header")).join(at, SHEET)
    here = lambda k: F.col("col") == F.col(f"c_{k}")
    return data.groupBy(*SHEET, "row").agg(
        F.max(F.when(here("name"), F.trim(F.coalesce(F.col("text"), F.lit(""))))).alias("name"),
        *[F.max(F.when(here(k), F.col("number"))).alias(k) for k in wanted])


def country_premiums(cells: DataFrame) -> DataFrame:
    """Risk premium and total premium per country code; a later row replaces an earlier one."""
    rows = sheet_columns(
        cells.where(F.col("sheet") == "ERPs by country"), ("country", "country risk premium"),
        {"crp": (("country risk premium",), ()), "total_erp": (("total equity risk premium",), ())},
        ("country",))
    return _by_country(rows, ["crp", "total_erp"])


def country_taxes(cells: DataFrame) -> DataFrame:
    rows = sheet_columns(cells.where(F.col("sheet") == "Country Tax Rates"), ("country", "tax rate"),
                         {"tax_rate": (("tax rate",), ())}, ("country",))
    return _by_country(rows, ["tax_rate"])


def _by_country(rows: DataFrame, values: list[str]) -> DataFrame:
    coded = rows.withColumn("iso", text.country_code(F.col("name"))).where(F.col("iso").isNotNull())
    return coded.groupBy("iso").agg(
        F.min("row").alias("first_row"),
        *[F.max_by(v, F.when(F.col(v).isNotNull(), F.col("row"))).alias(v) for v in values])


def mature_premium(countries: DataFrame) -> DataFrame:
    """Total premium of the first country whose own premium is zero."""
    zero = (F.abs("crp") < 1e-9) & (F.col("total_erp") != 0)
    return countries.agg(F.min_by("total_erp", F.when(zero, F.col("first_row"))).alias("mature_market_erp"))


def percent_guard(countries: DataFrame, values: list[str]) -> DataFrame:
    """Nothing passes when any rate is above one: the sheet then holds percentages.

    The decision rides along as a semi join on a one-row aggregate, so no value is
    looked at on the driver.
    """
    over = F.greatest(*[F.coalesce(v, F.lit(0.0)) for v in values])
    flag = countries.agg(F.max(over).alias("top")).where(F.coalesce("top", F.lit(0.0)) <= 1) \
        .select(F.lit(1).alias("_one"))
    return countries.withColumn("_one", F.lit(1)).join(F.broadcast(flag), "_one", "left_semi").drop("_one")  # one row


def industry_rows(cells: DataFrame) -> DataFrame:
    """Industry parameters of all files, one row per industry name.

    Each file feeds its own column; the files are laid side by side by one aggregation on
    the name instead of a chain of outer joins.
    """
    names = {spec.INDUSTRY_COLUMNS[f][0] for f in spec.INDUSTRY_COLUMNS}
    base = cells.where((F.col("sheet") == "Industry Averages") & F.col("file").isin(*spec.INDUSTRY_COLUMNS))
    wanted = {t: (inc, exc) for t, inc, exc in spec.INDUSTRY_COLUMNS.values()}
    rows = sheet_columns(base, ("industry name",), wanted, ("industry name",))
    owner = lambda t: F.col("file") == [f for f, s in spec.INDUSTRY_COLUMNS.items() if s[0] == t][0]
    kept = rows.where((F.coalesce("name", F.lit("")) != "") & ~F.lower("name").startswith("total market"))
    merged = kept.groupBy("name").agg(*[
        F.max_by(t, F.when(owner(t) & F.col(t).isNotNull(), F.col("row"))).alias(t) for t in sorted(names)])
    return merged.where(F.coalesce(*sorted(names)).isNotNull())


def merge_parameters(stored: DataFrame, found: DataFrame, key: str, values: list[str],
                     source: str, as_of: Column) -> DataFrame:
    """Only values that were read replace stored ones; touched rows are stamped."""
    fresh = found.select(key, *[F.col(v).alias(f"new_{v}") for v in values])
    any_new = F.coalesce(*[F.col(f"new_{v}") for v in values]).isNotNull()
    both = stored.join(fresh, key, "full")
    return both.select(
        key, *[F.coalesce(f"new_{v}", v).alias(v) for v in values],
        F.when(any_new, F.lit(source)).otherwise(F.col("source")).alias("source"),
        F.when(any_new, as_of).otherwise(F.col("as_of")).alias("as_of"))


def growth_equals_riskfree(market: DataFrame) -> DataFrame:
    """Terminal growth and its date copied from the stored risk-free rate, when there is one."""
    growth = F.col("key") == "long_run_nominal_growth"
    rate = market.where((F.col("key") == "risk_free_rate") & F.col("value").isNotNull()).select(
        F.lit("long_run_nominal_growth").alias("key"), F.col("value").alias("rf"), F.col("as_of").alias("rf_at"))
    return market.join(rate, "key", "left").select(
        "key", F.when(growth, F.coalesce("rf", "value")).otherwise(F.col("value")).alias("value"),
        F.when(growth, F.coalesce("rf_at", "as_of")).otherwise(F.col("as_of")).alias("as_of"))


def parameter_completeness(block: DataFrame, values: list[str], label: str) -> DataFrame:
    """Filled and total cells of one parameter block, and whether nothing is missing."""
    total = F.count(F.lit(1))
    filled = [F.count_if(F.col(v).isNotNull()).alias(f"filled_{v}") for v in values]
    ready = F.lit(True)
    for v in values:
        ready = ready & (F.count_if(F.col(v).isNull()) == 0)
    return block.agg(F.lit(label).alias("block"), total.alias("total"), *filled, ready.alias("ready"))


def drifted_constants(actual: DataFrame) -> DataFrame:
    """Model constants that are missing or changed, and forecast years that do not sum to ten."""
    spark = actual.sparkSession
    expected = text.constant_rows(spark, list(spec.CONVENTIONS.items()), "cell, expected")
    joined = expected.join(actual, "cell", "left")
    off = F.col("value").isNull() | (F.abs(F.col("value") - F.col("expected")) > 1e-9)
    each = joined.where(off).select("cell", "expected", F.col("value").alias("found"))
    both = actual.where(F.col("cell").isin("B63", "B64")).agg(
        F.sum("value").alias("found"), F.count("value").alias("n")) \
        .where((F.col("n") == 2) & (F.col("found") != 10)) \
        .select(F.lit("B63+B64").alias("cell"), F.lit(10.0).alias("expected"), "found")
    return each.unionByName(both)


# -- credit ladder -----------------------------------------------------------------

def ladder_from_html(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Rungs of the first table of every page, wherever they sit in it.

    A row counts when its rating holds a slash and its numbers parse; columns are
    threshold, label, rating, spread.
    """
    table = F.regexp_extract(F.col(html), r"(?is)<table\b.*?</table>", 0)
    cell_text = lambda c: F.trim(F.regexp_replace(
        _unescape(F.regexp_replace(F.regexp_extract(c, r"(?is)^<td\b[^>]*>(.*)</td>$", 1), r"<[^>]+>", "")),
        r"\s+", " "))
    rows = pages.select(key, F.posexplode(F.regexp_extract_all(
        table, F.lit(r"(?is)<tr\b.*?</tr>"), 0)).alias("row", "tr"))
    cells = rows.select(key, "row", F.transform(F.regexp_extract_all(
        "tr", F.lit(r"(?is)<td\b[^>]*>.*?</td>"), 0), cell_text).alias("cells"))
    at = lambda n: F.try_element_at("cells", F.lit(n + 1))
    parsed = ordered.evaluate_once(
        cells, coverage_from=numbers.parse_number(at(0)), rating_full=at(2), spread=numbers.percent_text(at(3)))
    rungs = parsed.where(F.col("rating_full").contains("/") & F.col("coverage_from").isNotNull()
                         & F.col("spread").isNotNull())
    return rungs.select(key, "coverage_from", F.substring_index("rating_full", "/", -1).alias("rating"),
                        "rating_full", "spread")


# Named marks that occur in rating tables, with their characters.
NAMED_ENTITIES = {
    "nbsp": " ", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "ndash": "\u2013", "mdash": "\u2014", "minus": "\u2212",
    "le": "\u2264", "ge": "\u2265", "plusmn": "\u00b1", "times": "\u00d7", "middot": "\u00b7", "hellip": "\u2026",
    "thinsp": "\u2009", "ensp": "\u2002", "emsp": "\u2003", "shy": "\u00ad", "euro": "\u20ac", "pound": "\u00a3",
    "lsquo": "\u2018", "rsquo": "\u2019", "ldquo": "\u201c", "rdquo": "\u201d", "amp": "&"}


def _unescape(c: Column) -> Column:
    """Entities as characters: by decimal or hexadecimal number, or by name; each is read once.

    The text is cut before every ampersand, and the mark that a part begins with is replaced.
    """
    names = F.create_map(*[F.lit(x) for pair in NAMED_ENTITIES.items() for x in pair])

    def part(x: Column) -> Column:
        mark = F.regexp_extract(x, r"^&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z]+);", 1)
        code = F.when(mark.rlike("^#[xX]"), F.conv(F.substring(mark, 3, 6), 16, 10)) \
            .when(mark.startswith("#"), F.substring(mark, 2, 7)).try_cast("int")
        # From four UTF-32 bytes, so that numbers above 255 are characters, too.
        char = F.when(code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF), F.decode(
            F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        known = F.coalesce(F.when(code == 160, F.lit(" ")), char, names[mark])
        return F.when((mark != "") & known.isNotNull(),
                      F.concat(known, F.substr(x, F.length(mark) + 3))).otherwise(x)

    return F.array_join(F.transform(F.split(c, "(?=&)"), part), "")


def accepted_ladders(rungs: DataFrame, key: str = "page_id") -> tuple[DataFrame, DataFrame]:
    """(accepted, refused): a page is used only with exactly fifteen rungs."""
    counts = rungs.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    good = counts.where(F.col("n") == spec.LADDER_ROWS)
    ranked = rungs.join(good.select(key), key)
    return ranked.orderBy(key, "coverage_from"), counts.where(F.col("n") != spec.LADDER_ROWS)


def ladder_diff(current: DataFrame, fetched: DataFrame) -> DataFrame:
    """Rungs of the new ladder that differ from the one at the same position.

    Both sides: table, row, coverage_from, rating_full, spread.  Position is the key, since
    the threshold is exactly what is expected to move.
    """
    was = current.select("table", "row", F.struct("coverage_from", "rating_full", "spread").alias("was"))
    now = fetched.select("table", "row", F.struct("coverage_from", "rating_full", "spread").alias("now"))
    both = now.join(was, ["table", "row"], "left")
    same = (F.col("was.rating_full").eqNullSafe(F.col("now.rating_full"))
            & F.col("was.coverage_from").eqNullSafe(F.col("now.coverage_from"))
            & (F.abs(F.coalesce("was.spread", F.lit(0.0)) - F.col("now.spread")) < 1e-9))
    return both.where(F.col("was").isNull() | ~same).withColumn(
        "text", text.ladder_change(F.col("table"), F.col("was"), F.col("now")))


def apply_ladder(store: DataFrame, fetched: DataFrame, today: Column) -> DataFrame:
    """New rungs with today's vintage; the size cut-off of the store is never touched."""
    cut = store.groupBy("table").agg(F.first("cutoff", True).alias("cutoff"))
    return fetched.join(cut, "table", "left").select(
        "table", "row", "coverage_from", "rating", "rating_full", "spread", "cutoff",
        F.date_format(today, "yyyy-MM").alias("vintage"),
        F.date_format(F.add_months(today, 12), "yyyy-MM").alias("next_expected"))


def ladder_shape_problems(ladder: DataFrame) -> DataFrame:
    """Ladders without exactly fifteen rungs or with thresholds out of order."""
    by_row = ladder.groupBy("table").agg(
        F.count(F.lit(1)).alias("n"),
        F.transform(F.array_sort(F.collect_list(F.struct("row", "coverage_from"))),
                    lambda s: s["coverage_from"]).alias("thresholds"))
    sorted_ = F.col("thresholds") == F.array_sort("thresholds")
    return by_row.select("table", F.explode(F.array_compact(F.array(
        F.when(F.col("n") != spec.LADDER_ROWS, F.lit("wrong number of rows")),
        F.when(~sorted_, F.lit("thresholds are not ascending"))))).alias("problem"))


# -- company to industry -----------------------------------------------------------

def valid_industries(industries: DataFrame) -> DataFrame:
    return industries.where(~F.col("name").startswith("_"))


def unmapped(companies: DataFrame, mapping: DataFrame, excluded: DataFrame) -> DataFrame:
    """Listed companies without an industry, largest revenue first."""
    mapped = mapping.where(F.coalesce("industry", F.lit("")) != "")
    rows = companies.where(F.coalesce("ticker", F.lit("")) != "") \
        .join(mapped.select("lei"), "lei", "left_anti").join(excluded.select("lei"), "lei", "left_anti")
    return rows.withColumn("revenue_m", F.coalesce("revenue", F.lit(0.0)) / 1e6) \
        .orderBy(F.desc("revenue_m"), "lei")


def excluded_type_audit(mapping: DataFrame, companies: DataFrame) -> DataFrame:
    """Companies mapped to a business type the valuation does not fit."""
    hit = mapping.where(text.contains_any(F.lower("industry"), spec.EXCLUDED_INDUSTRY_PARTS)
                        & ~F.col("lei").startswith("_"))
    c = companies.select("lei", "ticker", "name")
    return hit.join(c, "lei", "left").select(
        "lei", F.coalesce("ticker", "lei").alias("ticker"), F.coalesce("name", "lei").alias("name"), "industry")


def parse_replies(lines: DataFrame, column: str = "line") -> DataFrame:
    """Usable 'KEY | Industry' lines as key and answer."""
    parsed = ordered.evaluate_once(lines, reply=text.reply_line(F.col(column)))
    return parsed.where(F.col("reply").isNotNull()).select(
        *[c for c in lines.columns if c != column], "reply.key", "reply.answer")


def match_replies(replies: DataFrame, open_companies: DataFrame, industries: DataFrame,
                  letters: int = 6) -> DataFrame:
    """Every reply with its company, its outcome and a suggestion for unknown answers.

    The key is matched on the ticker without case first, then on the entity code.  Where
    several open companies share a ticker, the one with the smallest revenue answers, then the
    first by entity code.  A suggestion is the first valid name that contains the first
    ``letters`` letters of the answer: that is how the rule reads, and answers that agree in
    them get the same suggestion.  It is found by an equi-join on the letter runs of the valid
    names, not by comparing all pairs.
    """
    by_ticker = ordered.earliest(
        open_companies.select(F.upper("ticker").alias("t"), F.col("lei").alias("t_lei"), "revenue_m"),
        ["t"], [F.col("revenue_m"), F.col("t_lei")], ["t_lei"])
    by_lei = open_companies.select(F.col("lei").alias("l_lei"))
    valid = valid_industries(industries).select(F.col("name").alias("valid_name"))
    matched = replies.join(by_ticker, F.upper("key") == F.col("t"), "left") \
        .join(by_lei, F.col("key") == F.col("l_lei"), "left") \
        .withColumn("lei", F.coalesce("t_lei", "l_lei")) \
        .join(valid, F.col("answer") == F.col("valid_name"), "left")
    starts = valid.select("valid_name", F.lower("valid_name").alias("low"))
    runs = starts.select("valid_name", "low", F.explode(F.sequence(F.lit(1), F.lit(letters))).alias("width")) \
        .where(F.length("low") >= F.col("width")) \
        .select("valid_name", F.explode(F.transform(
            F.sequence(F.lit(1), F.length("low") - F.col("width") + 1),
            lambda i: F.substring(F.col("low"), i, F.col("width")))).alias("run"))
    suggestion = runs.groupBy("run").agg(F.min("valid_name").alias("suggestion"))
    outcome = F.when(F.col("lei").isNull(), "unknown").when(F.col("valid_name").isNull(), "rejected") \
        .otherwise("stored")
    return matched.withColumn("outcome", outcome).withColumn(
        "probe", F.when(F.col("outcome") == "rejected", F.substring(F.lower("answer"), 1, letters))) \
        .join(suggestion, F.col("probe") == F.col("run"), "left") \
        .select(*replies.columns, "lei", "outcome", "suggestion")


def reply_counts(matched: DataFrame) -> DataFrame:
    return matched.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def exclude_companies(mapping: DataFrame, excluded: DataFrame, leis: DataFrame,
                      reason: str) -> tuple[DataFrame, DataFrame]:
    """Take companies out of the universe with a reason; their mapping goes."""
    fresh = leis.select("lei", F.lit(reason).alias("reason"))
    return (mapping.join(leis.select("lei"), "lei", "left_anti"),
            excluded.join(leis.select("lei"), "lei", "left_anti").unionByName(fresh))


def include_companies(excluded: DataFrame, leis: DataFrame) -> DataFrame:
    """Bring companies back; they need a new mapping."""
    return excluded.join(leis.select("lei"), "lei", "left_anti")


def find_entity(companies: DataFrame, keys: DataFrame) -> DataFrame:
    """Entity by code or by ticker; the smallest entity code wins."""
    either = companies.select("lei", F.explode(F.array_distinct(F.array_compact(
        F.array("lei", "ticker")))).alias("key"))
    return keys.join(either, "key", "left").groupBy("key").agg(F.min("lei").alias("lei"))


def riskfree_from_series(series: DataFrame) -> DataFrame:
    """Last observation of a rate series as a fraction, with its date and a status."""
    last = series.agg(F.max_by(F.struct("OBS_VALUE", "TIME_PERIOD"), F.col("ord")).alias("last"))
    value = numbers.parse_number(F.col("last.OBS_VALUE"))
    status = F.when(F.col("last").isNull(), "empty response").when(value.isNull(), "unparseable").otherwise("ok")
    return last.select((value / 100).alias("value"), F.col("last.TIME_PERIOD").alias("as_of"), status.alias("status"))


def stored_ladder(spark: SparkSession) -> DataFrame:
    """The thirty constant rungs as rows."""
    rows = [(name, i, *rung) for name, rungs in spec.LADDERS.items() for i, rung in enumerate(rungs)]
    return text.constant_rows(spark, rows, "table, row, coverage_from, rating, rating_full, spread")
