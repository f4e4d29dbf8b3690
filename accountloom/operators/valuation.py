"""Discounted cash flow value per company, as column expressions on one wide row.

Formulas marked *given* are fixed by the data model.  Those marked *choice* are known only
by intent; the formula is this package's own and documented here:

* D25 denominator (choice): five-year sum of EBIT after tax; the numerator is the five-year
  sum of capex + acquisitions - D&A.
* D29 cap (choice): 0.90 of after-tax operating profit, and not below zero.
* D34 (choice): debt / (debt + market cap), debt being short plus long term.
* D35 (choice): textbook relevering, beta x (1 + (1 - tax) x debt / market cap).
* D47 (choice): cost of equity = risk-free + beta x mature premium + country premium, after-tax
  cost of debt, market weights.
* Forecast (choice within given limits): five years at the computed growth, five years fading
  to the terminal rate, return on capital fading to WACC over the same years.
* D79 (choice): value - debt - minority - preferred + cash + short-term investments + associates.
* D89-D93 (choice): plain ratios.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accountloom import spec
from accountloom.functions import numbers, text
from accountloom.operators import ladders

REINVEST_CAP = 0.90
MIN_SPREAD = 0.005
YEARS = 10


def last(key: str) -> Column:
    return F.try_element_at(F.col(key), F.lit(-1))


def first(key: str) -> Column:
    return F.try_element_at(F.col(key), F.lit(1))


def five_point_median(values: Column) -> Column:
    """Middle of five values; null when one of them is missing."""
    return F.when((F.size(values) == spec.FISCAL_YEARS) & ~F.exists(values, lambda v: v.isNull()),
                  F.sort_array(values)[2])


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def revenue_cagr(series: Column) -> Column:
    """Four-year compound growth from the first to the last of five years."""
    a, b = F.try_element_at(series, F.lit(1)), F.try_element_at(series, F.lit(-1))
    return F.when((a > 0) & (b > 0), F.pow(b / a, F.lit(0.25)) - 1)


def normalise(df: DataFrame) -> DataFrame:
    """Five-year margins, invested capital, reinvestment and growth."""
    margins = F.zip_with("ebit", "revenue", lambda e, r: F.try_divide(e, r))
    invested = F.zip_with(F.zip_with("capex", "acquisitions_net", lambda a, b: a + b),
                          "depreciation_amortisation", lambda a, b: a - b)
    staged = df.withColumns({
        "margin": five_point_median(margins),
        "debt": last("short_term_debt") + last("long_term_debt"),
        "interest": last("interest_expense"),
        "cagr": revenue_cagr(F.col("revenue")),
        "market_cap_m": F.col("price") * F.col("shares") / spec.SCALE,
        "reinvest_cashflow": F.try_divide(total(invested), total(F.col("ebit")) * (1 - F.col("tax_rate")))})
    staged = staged.withColumns({
        "nopat": F.col("margin") * last("revenue") * (1 - F.col("tax_rate")),
        "invested_capital": F.col("debt") + last("total_equity") - last("cash"),
        "reinvest_sales_to_capital": F.try_divide(F.col("cagr"), F.col("sales_to_capital"))})
    return staged.withColumns({
        "computed_roic": F.try_divide(F.col("nopat"), F.col("invested_capital")),
        "reinvest_divergence": numbers.divergence(F.col("reinvest_cashflow"), F.col("reinvest_sales_to_capital")),
        "reinvest_used": F.when(
            F.col("reinvest_cashflow").isNotNull() & F.col("reinvest_sales_to_capital").isNotNull(),
            F.greatest(F.lit(0.0), F.least(F.lit(REINVEST_CAP), F.col("reinvest_cashflow"),
                                           F.col("reinvest_sales_to_capital"))))})


def cost_of_capital(df: DataFrame, ladder: DataFrame | None = None) -> DataFrame:
    """Credit ladder by company size, cost of debt, relevered beta and WACC.

    With a ``ladder`` table, rating, spread and size cut-off are those of the company's
    ``ladder_vintage``; without one they are the constants of the model.
    """
    cap = F.col("market_cap_m")
    staged = df.withColumns({
        "coverage": F.when(F.col("interest") == 0, F.lit(float("inf"))).otherwise(
            F.try_divide(last("ebit"), F.col("interest"))),
        "debt_weight": F.try_divide(F.col("debt"), F.col("debt") + cap),
        "relevered_beta": F.col("unlevered_beta") * (1 + (1 - F.col("tax_rate")) * F.try_divide(F.col("debt"), cap)),
        "actual_rate": F.try_divide(F.col("interest"), F.col("debt"))})
    if ladder is None:
        staged = staged.withColumns({
            "credit_table": numbers.credit_table(cap),
            "implied_rating": numbers.by_credit_table(cap, F.col("coverage"), "rating"),
            "ladder_spread": numbers.by_credit_table(cap, F.col("coverage"), "spread")})
    else:
        staged = ladders.look_up(ladders.with_credit_table(staged, ladder), ladder)
    staged = staged.withColumn("synthetic_rate", F.col("risk_free_rate") + F.col("ladder_spread")).drop("ladder_spread")
    staged = staged.withColumns({
        "cost_of_debt": F.least(F.lit(spec.COST_OF_DEBT_CAP), F.greatest("synthetic_rate", "actual_rate")),
        "cost_of_equity": F.col("risk_free_rate") + F.col("relevered_beta") * F.col("mature_market_erp") + F.col("crp")})
    return staged.withColumn(
        "wacc", (1 - F.col("debt_weight")) * F.col("cost_of_equity")
        + F.col("debt_weight") * F.col("cost_of_debt") * (1 - F.col("tax_rate")))


def forecast(df: DataFrame) -> DataFrame:
    """Ten forecast years, the terminal value and the equity bridge."""
    staged = df.withColumns({
        "growth": F.col("reinvest_used") * F.col("computed_roic"),
        "terminal_growth": F.least("long_run_nominal_growth", "risk_free_rate", F.col("wacc") - MIN_SPREAD)})

    def step(acc: Column, year: Column) -> Column:
        fade = F.greatest(F.lit(0.0), (year - 5) / F.lit(5.0))
        g = F.col("growth") + (F.col("terminal_growth") - F.col("growth")) * fade
        roic = F.col("computed_roic") + (F.col("wacc") - F.col("computed_roic")) * fade
        profit = acc["profit"] * (1 + g)
        discount = acc["discount"] * (1 + F.col("wacc"))
        cash = profit * (1 - F.try_divide(g, roic))
        return F.struct(profit.alias("profit"), discount.alias("discount"),
                        (acc["pv"] + F.try_divide(cash, discount)).alias("pv"))

    start = F.struct(F.col("nopat").alias("profit"), F.lit(1.0).alias("discount"), F.lit(0.0).alias("pv"))
    usable = (F.col("computed_roic") > 0) & (F.col("wacc") > MIN_SPREAD)
    staged = staged.withColumn("path", F.when(usable, F.aggregate(
        F.sequence(F.lit(1), F.lit(YEARS)), start, step)))
    g = F.col("terminal_growth")
    terminal = F.try_divide(
        F.col("path.profit") * (1 + g) * (1 - F.try_divide(g, F.col("wacc"))),
        (F.col("wacc") - g) * F.col("path.discount"))
    staged = staged.withColumn("terminal_value", terminal).withColumn(
        "enterprise_value", F.col("path.pv") + F.col("terminal_value"))
    bridge = (F.col("enterprise_value") - F.col("debt") - last("minority_interest") - last("preferred_stock")
              + last("cash") + last("short_term_investments") + last("equity_method_investments"))
    return staged.withColumns({
        "value_per_share": F.try_divide(bridge, F.col("shares") / spec.SCALE),
        "terminal_share_of_ev": F.try_divide(F.col("terminal_value"), F.col("enterprise_value")),
        "margin_vs_industry": F.try_divide(F.col("margin"), F.col("ebit_margin")),
        "roic_vs_industry": F.try_divide(F.col("computed_roic"), F.col("roic")),
        "equity_method_over_assets": F.try_divide(last("equity_method_investments"), last("total_assets")),
        "implied_ev_ebit": F.try_divide(F.col("enterprise_value"), F.col("margin") * last("revenue"))}).drop("path")


def _check(cell: str, severity: str, bad: Column, message: str) -> Column:
    body = F.when(bad, F.lit(f"{severity} - {message}")).when(~bad, F.lit("OK"))
    return F.struct(F.lit(cell).alias("cell"), body.alias("message"))


def run_checks(df: DataFrame) -> DataFrame:
    """The checks whose rule is known; a check that cannot be evaluated reads UNKNOWN.

    Optional input columns: loaded_table, ladder_ascending, ladder_age_days, forecast_years.
    """
    have = lambda name, default: F.col(name) if name in df.columns else default
    cells = reduce(lambda a, b: a + b, [
        F.size(F.filter(F.coalesce(k, F.array().cast("array<double>")), lambda v: v.isNotNull()))
        for k in spec.LINE_ITEM_KEYS])
    ratio = F.try_divide(F.col("market_cap_m"), last("revenue"))
    no_price = F.coalesce(F.col("price") <= 0, F.lit(True))
    checks = F.array(
        _check("D99", "FAIL", have("forecast_years", F.lit(YEARS)) != YEARS, "forecast years do not sum to 10"),
        _check("D103", "WARNING", F.coalesce(F.col("actual_rate") > F.col("synthetic_rate"), F.lit(False)),
               "actual interest rate above the synthetic one"),
        _check("D104", "WARNING", F.col("reinvest_divergence") > 0.5, "reinvestment estimates diverge"),
        _check("D111", "FAIL", cells != 100, "statement cells are missing"),
        _check("D112", "FAIL", no_price, "no share price"),
        _check("D114", "FAIL", ~F.coalesce(ratio.between(spec.CAP_REVENUE_MIN, spec.CAP_REVENUE_MAX), F.lit(False)),
               "market cap out of line with revenue"),
        _check("D115", "FAIL", ~have("ladder_ascending", F.lit(True)), "ladder thresholds are not ascending"),
        _check("D120", "FAIL", have("loaded_table", F.col("credit_table")) != F.col("credit_table"),
               "ladder does not match the market cap"),
        _check("D122", "WARNING", have("ladder_age_days", F.lit(0)) > spec.LADDER_BLOCK_DAYS,
               "ladder older than fourteen months"))
    return df.withColumn("checks", with_severity(checks))


def with_severity(checks: Column) -> Column:
    """Adds the severity word to every check; a missing text is never a pass."""
    return F.transform(checks, lambda c: F.struct(
        c["cell"].alias("cell"), text.severity(c["message"]).alias("severity"),
        F.coalesce(c["message"], F.lit("empty -- not evaluated")).alias("message")))


def is_void(checks: Column) -> Column:
    return F.exists(checks, lambda c: c["severity"] == "FAIL")


def verdicts(df: DataFrame) -> DataFrame:
    up = numbers.upside(F.col("value_per_share"), F.col("price"))
    return df.withColumn("upside", up).withColumn("verdict", F.when(
        is_void(F.col("checks")), F.lit(spec.VOID)).otherwise(numbers.verdict_from_upside(F.col("upside"))))


def value_companies(inputs: DataFrame, ladder: DataFrame | None = None) -> DataFrame:
    """Value, checks and verdict of every company; one projection chain without a shuffle.

    A ``ladder`` is joined by table and vintage (``ladder_vintage`` of the inputs): companies meet one
    rung each, and a ladder of common size is broadcast by the planner.
    """
    return verdicts(run_checks(forecast(cost_of_capital(normalise(inputs), ladder))))


def with_price_age(results: DataFrame, today: Column) -> DataFrame:
    return results.withColumn("price_age_days", F.datediff(today, F.col("price_as_of")))


def stale_prices(results: DataFrame) -> DataFrame:
    return results.where(F.col("price_age_days") > spec.QUOTE_MAX_AGE)


def echo_problems(results: DataFrame, given: DataFrame) -> DataFrame:
    """Results whose price is missing or differs from the price that was put in."""
    both = results.select("lei", "current_price").join(given.select("lei", F.col("price").alias("given")), "lei")
    return both.where(F.col("current_price").isNull() | (F.abs(F.col("current_price") - F.col("given")) > 0.005))
