"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

Every measure is a DataFrame expression over the text of its own row, so the whole operator is a
scan and a projection: no shuffle, no Python, no state.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"

# Common function words of the four languages, lower case.
STOP_WORDS = (
    "the and of to in is that it for was with as be on by this are from or an a at "
    "der die das und ist nicht ein eine mit den von zu für des auf im sich "
    "le la les de des et est un une que pour dans en qui avec du "
    "el los las y es un una que por con para se no del lo su").split()


class Rule(NamedTuple):
    """The range in which ``factor * of / per`` passes; None leaves a side open, or divides by 1."""

    name: str
    of: str
    per: str | None = None
    factor: float = 1.0
    least: float | None = None
    most: float | None = None


RULES = (
    Rule("words", "n_words", least=50),
    Rule("repeated_words", "n_repeat_words", "n_words", 100.0, most=50),
    Rule("word_length", "word_chars", "n_words", least=2, most=15),
    Rule("symbols", "n_symbols", "n_words", most=0.1),
    Rule("stop_words", "n_stop_words", "n_words", least=0.02),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", most=0.4),
)
"""The first two are the base rules; a ratio over nothing is null and fails."""

BASE = ("words", "repeated_words")


def passes(rule: Rule) -> Column:
    value = F.col(rule.of).cast("double") * rule.factor
    if rule.per:
        value = value / F.when(F.col(rule.per) != 0, F.col(rule.per))
    low = F.lit(True) if rule.least is None else value >= rule.least
    high = F.lit(True) if rule.most is None else value <= rule.most
    return F.coalesce(low & high, F.lit(False))


def _repeated(words: Column) -> Column:
    """Words that lie in a three-word window found twice or more, the first one included.

    Windows are sorted by hash with their places; those with an equal neighbour repeat. Sorted
    again by place, each covers the words up to the next one's start, three at most.
    """
    n = F.size(words)
    windows = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.xxhash64(
        F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i"))))
    return F.sort_array(F.coalesce(windows, F.array().cast("array<struct<h:bigint,i:int>>")))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The measures of every document, natively; one row per row, null text as empty."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")) \
        .select("id", "text", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words"),
                F.filter(F.split("text", "\n", -1), lambda x: x.rlike(WORD)).alias("lines"))
    rows = rows.select(
        "id", F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("words", lambda w: F.lower(w).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        _repeated(F.col("words")).alias("windows"))
    w = F.col("windows")
    starts = F.sort_array(F.transform(F.filter(w, lambda x, j: (
        (j > 0) & (F.get(w, j - 1)["h"] == x["h"])) | F.coalesce(F.get(w, j + 1)["h"] == x["h"], F.lit(False))),
        lambda x: x["i"]))
    rows = rows.withColumn("starts", starts)
    s = F.col("starts")
    covered = F.aggregate(F.transform(s, lambda p, j: F.least(F.lit(3), F.coalesce(F.get(s, j + 1) - p, F.lit(3)))),
                          F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.withColumn("n_repeat_words", covered).drop("windows", "starts")


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: tuple[str, ...] = BASE,
          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: the measures, base_failed (a base rule fails), kept (all rules pass), failed.

    ``failed`` lists the names of failed rules. A null or empty text has no words and fails; null
    ids are kept; repeated rows give repeated rows; other columns are not read; an empty table
    gives an empty result.
    """
    rows = measure(docs, id_col, text_col)
    failed = F.filter(F.array(*[F.when(~passes(r), F.lit(r.name)) for r in rules]), lambda x: x.isNotNull())
    return rows.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       "n_lines", "n_stop_words", failed.alias("failed")) \
        .withColumn("base_failed", F.arrays_overlap("failed", F.array(*[F.lit(b) for b in base]))) \
        .withColumn("kept", F.size("failed") == 0)
