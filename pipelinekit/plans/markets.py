"""Report on how local markets and high incomes go together, by zip code.

Inputs: ``markets`` with a ``zip`` per market, and ``returns`` with ``zipcode``,
``agi_stub`` (income bracket) and ``N1`` (number of returns), all strings. Zip codes
stay strings throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Zip codes that stand for totals, not for places.
SUMMARY_ZIPS = ("00000", "99999")


def known_zips(markets: DataFrame) -> DataFrame:
    return markets.filter(F.col("zip").isNotNull())


def markets_by_zip(markets: DataFrame) -> DataFrame:
    return markets.groupBy("zip").agg(F.count(F.lit(1)).alias("num_farmers_markets"))


def place_zips(returns: DataFrame) -> DataFrame:
    zipcode = F.col("zipcode")
    low, high = SUMMARY_ZIPS
    return returns.filter((zipcode != low) & (zipcode != high) & zipcode.isNotNull())


def typed_returns(returns: DataFrame) -> DataFrame:
    """Bracket and count as integers; text that is no number becomes null."""
    return returns.select(
        "zipcode",
        F.col("agi_stub").try_cast("int").alias("income_bracket"),
        F.col("N1").try_cast("int").alias("num_returns"),
    )


def returns_by_bracket(returns: DataFrame, top_bracket: int = 6) -> DataFrame:
    """Returns in the top bracket, below it, and in all, per zip code."""
    bracket, number = F.col("income_bracket"), F.col("num_returns")

    def summed(where):
        return F.sum(F.when(where, number).otherwise(0))

    return returns.groupBy("zipcode").agg(
        summed(bracket == top_bracket).alias("high_income_returns"),
        summed(bracket < top_bracket).alias("low_income_returns"),
        F.sum(number).alias("all_returns"),
    )


def with_income_flag(brackets: DataFrame, threshold: float = 0.1) -> DataFrame:
    """Share of high incomes, and whether it exceeds ``threshold``; null without returns."""
    share = F.try_divide("high_income_returns", "all_returns")
    percent = F.try_divide(100 * F.col("high_income_returns"), "all_returns")
    return brackets.select(
        percent.alias("high_income_percent"), *brackets.columns, (share > F.lit(float(threshold))).alias("is_high_income")
    )


def join_markets_and_income(markets: DataFrame, income: DataFrame) -> DataFrame:
    """Every income row, with its markets where there are any."""
    return markets.join(income, markets["zip"] == income["zipcode"], "right_outer")


def with_market_flag(joined: DataFrame) -> DataFrame:
    return joined.withColumn("has_fm", F.coalesce("num_farmers_markets", F.lit(0)) > 0)


# The names of the cases, by whether there is a market and incomes are high.
CASES = {
    "has_fm_high_income": (True, True),
    "has_fm_low_income": (True, False),
    "no_fm_high_income": (False, True),
    "no_fm_low_income": (False, False),
}


def _is(flag: str, value: bool) -> Column:
    return F.col(flag) if value else ~F.col(flag)


def with_cases(flagged: DataFrame) -> DataFrame:
    """The four market/income cases; a null income flag can leave a case null."""
    cases = [(_is("has_fm", fm) & _is("is_high_income", high)).alias(name) for name, (fm, high) in CASES.items()]
    return flagged.select(*cases, "*")


def case_totals(cases: DataFrame) -> DataFrame:
    """Count each case over all rows: one row, with nulls for no rows; null counts as no."""
    rows = F.count(F.lit(1))

    def counted(condition: Column) -> Column:
        return F.when(rows > 0, F.count_if(condition))

    return cases.agg(
        *[counted(F.col(name)).alias(name) for name in CASES],
        rows.alias("num_zipcodes"),
        counted(_is("has_fm", True)).alias("has_fm"),
        counted(_is("has_fm", False)).alias("no_fm"),
    )


def case_percents(totals: DataFrame) -> DataFrame:
    percents = [
        F.try_divide(100 * F.col(f"{side}_high_income"), side).alias(f"{side}_high_income_percent") for side in ("has_fm", "no_fm")
    ]
    return totals.select(*percents, *CASES, "num_zipcodes")


def market_report(
    markets: DataFrame, returns: DataFrame, top_bracket: int = 6, threshold: float = 0.1
) -> DataFrame:
    """The whole report: one row of case counts and percentages."""
    counted = known_zips(markets).transform(markets_by_zip)
    income = (
        place_zips(returns)
        .transform(typed_returns)
        .transform(returns_by_bracket, top_bracket)
        .transform(with_income_flag, threshold)
    )
    joined = join_markets_and_income(counted, income)
    return joined.transform(with_market_flag).transform(with_cases).transform(case_totals).transform(case_percents)
