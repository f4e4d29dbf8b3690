"""Text expressions: names, check messages, verdict labels, reply lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from accountloom import spec


def collapse(c: Column) -> Column:
    """Runs of white space become one blank; null becomes the empty text."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def strip_blank(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def sql_literal(v) -> str:
    """A constant as SQL text."""
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, str):
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"{v!r}D" if isinstance(v, float) else repr(v)


def constant_array(values) -> Column:
    return F.expr(f"array({', '.join(map(sql_literal, values))})")


def constant_rows(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    """A small constant table that the planner sees as local rows of known size."""
    body = ", ".join("(" + ", ".join(map(sql_literal, r)) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({columns})")


def lookup(c: Column, table: dict[str, str]) -> Column:
    """Constant map lookup, null when the key is unknown."""
    pairs = ", ".join(sql_literal(x) for pair in table.items() for x in pair)
    return F.try_element_at(F.expr(f"map({pairs})"), c)


def contains_any(c: Column, parts: tuple[str, ...]) -> Column:
    """True when ``c`` holds at least one of the literal parts."""
    escaped = "|".join("".join("\\" + ch if not ch.isalnum() and ch != " " else ch
                               for ch in p) for p in parts)
    return c.rlike(escaped)


def contains_all(c: Column, parts: tuple[str, ...]) -> Column:
    out = F.lit(True)
    for p in parts:
        out = out & c.contains(p)
    return out


def normalise(c: Column) -> Column:
    """Lower case, letters and digits only."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")


def entry_number(c: Column) -> Column:
    """Integer after the last dash of a filing index; -1 when there is none."""
    tail = F.regexp_extract(F.coalesce(c, F.lit("")), r"(?:^|-)\s*(\+?[0-9]+(?:_[0-9]+)*)\s*$", 1)
    return F.coalesce(F.regexp_replace(tail, "_", "").try_cast("bigint"), F.lit(-1).cast("bigint"))


def strip_severity(c: Column) -> Column:
    """The part of a check message after its first ' - '."""
    t = collapse(c)
    at = F.instr(t, " - ")
    return F.when(at > 0, F.substring(t, at + 3, F.length(t))).otherwise(t)


def severity(c: Column) -> Column:
    """First word of a check text; a missing or unknown word is never a pass."""
    word = F.upper(F.regexp_extract(F.coalesce(c, F.lit("")), r"^\s*(\S+)", 1))
    return F.when(word.isin(*spec.CHECK_SEVERITIES), word).otherwise(F.lit("UNKNOWN"))


def exit_reason(c: Column) -> Column:
    label = F.substring_index(F.coalesce(c, F.lit("")), " - ", 1)
    return F.array_join(F.transform(F.split(label, "-"), F.initcap), "-")


def short_verdict(verdict: Column, held_back: Column) -> Column:
    """Short label; an undervalued company that is held back reads SUPPRESSED."""
    label = F.coalesce(lookup(verdict, spec.SHORT_VERDICTS), F.substring(verdict, 1, 14))
    return F.when((label == "UNDERVALUED") & held_back, F.lit("SUPPRESSED")).otherwise(label)


def shorten(c: Column, width: int) -> Column:
    t = collapse(c)
    return F.when(F.length(t) <= width, t).otherwise(
        F.concat(F.rtrim(F.substring(t, 1, width - 1)), F.lit("…")))


def why(wacc: Column, rating: Column, terminal: Column, margin: Column, roic: Column) -> Column:
    """One line of the figures behind a verdict; absent figures are left out."""
    rated = F.when(F.coalesce(rating, F.lit("")) != "", F.concat(F.lit(" ("), rating, F.lit(")"))) \
        .otherwise(F.lit(""))
    return F.concat_ws(
        ", ",
        F.when(wacc.isNotNull(), F.concat(F.format_string("WACC %.1f%%", wacc * 100), rated)),
        F.when(terminal.isNotNull(), F.format_string("%.0f%% of value is terminal", terminal * 100)),
        F.when(margin.isNotNull(), F.format_string("margin %.2fx industry", margin)),
        F.when(roic.isNotNull(), F.format_string("ROIC %.2fx industry", roic)))


def why_public(wacc: Column, rating: Column, terminal: Column, margin: Column) -> Column:
    """The figures as the published page words them."""
    rated = F.when(F.coalesce(rating, F.lit("")) != "", F.concat(F.lit(" ("), rating, F.lit(")"))) \
        .otherwise(F.lit(""))
    return F.concat_ws(
        ", ",
        F.when(wacc.isNotNull(), F.concat(F.format_string("discount rate %.1f%%", wacc * 100), rated)),
        F.when(terminal.isNotNull(),
               F.format_string("%.0f%% terminal value", terminal * 100)),
        F.when(margin.isNotNull(), F.format_string("margin ratio %.2f", margin)))


def is_cross_listed(ticker: Column) -> Column:
    return F.coalesce(ticker.rlike("^[0-9]"), F.lit(False))


def listing_confidence(route: Column, tier: Column) -> Column:
    """isin, name or manual; marked when the line is outside the domicile."""
    return F.when(route == "manual", route).when(tier == "domicile", route) \
        .otherwise(F.concat(route, F.lit("+non_domicile")))


def reply_line(c: Column) -> Column:
    """'- KEY | Answer' as struct(key, answer); null when the line is not usable."""
    text = strip_blank(F.regexp_replace(strip_blank(c), r"^[-*]+", ""))
    parts = F.split(text, r"\s*[|\t;]\s*|\s{2,}", 2)
    key, answer = strip_blank(parts[0]), strip_blank(F.try_element_at(parts, F.lit(2)))
    return F.when((key != "") & (answer != ""), F.struct(key.alias("key"), answer.alias("answer")))


def country_code(name: Column) -> Column:
    return lookup(F.lower(strip_blank(name)), spec.COUNTRY_ALIASES)


def joined_reasons(messages: Column) -> Column:
    """Stripped messages joined by a middle dot; a dash when there are none."""
    return F.when(F.size(messages) > 0, F.array_join(F.transform(messages, strip_severity), " · ")) \
        .otherwise(F.lit("—"))


LADDER_PARTS = ("coverage_from", "rating_full", "spread")


def changed_parts(was: Column, now: Column) -> Column:
    """Columns of a rung that differ, each with its old and new value as text; empty if none do."""
    differs = {"coverage_from": was["coverage_from"] != now["coverage_from"],
               "rating_full": was["rating_full"] != now["rating_full"],
               "spread": F.abs(was["spread"] - now["spread"]) > 1e-9}
    shown = lambda side, k: F.format_string("%.4f", side[k]) if k == "spread" else side[k].cast("string")
    return F.array_compact(F.array(*[
        F.when(differs[k], F.struct(F.lit(k).alias("part"), shown(was, k).alias("was"), shown(now, k).alias("now")))
        for k in LADDER_PARTS]))


def ladder_change(table: Column, was: Column, now: Column) -> Column:
    """One line for a changed rung, from its changed parts; ``was`` is null for a new rung."""
    parts = F.transform(changed_parts(was, now), lambda x: F.concat(x["part"], F.lit(" "), x["was"], F.lit(" to "), x["now"]))
    what = F.when(was.isNull(), F.lit("added")).when(F.size(parts) == 0, F.lit("same")).otherwise(F.array_join(parts, "; "))
    return F.concat_ws(" | ", table, now["rating_full"], what)
