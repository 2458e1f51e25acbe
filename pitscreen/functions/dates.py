"""Calendar rules: formation dates, reporting lags, fiscal labels, windows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F


def formation_date(year: Column) -> Column:
    """Portfolios form on 1 July."""
    return F.make_date(year, F.lit(7), F.lit(1))


def holding_end(year: Column) -> Column:
    """Last calendar day of the twelve months that start at formation."""
    return F.make_date(year + 1, F.lit(6), F.lit(30))


def between_formations(bars: DataFrame, first_year: int, last_year: int, months_before: int,
                       months_after: int, slack_days: int = 0) -> DataFrame:
    """Bars from ``months_before`` the first formation to ``months_after`` the last.

    The bounds are literals, so they reach the scan and skip files and row groups outside.
    """

    def shifted(year: int, months: int) -> dt.date:
        index = year * 12 + 6 + months
        return dt.date(index // 12, index % 12 + 1, 1)

    start = shifted(first_year, -months_before) - dt.timedelta(days=slack_days)
    return bars.where((F.col("date") >= F.lit(start))
                      & (F.col("date") < F.lit(shifted(last_year, months_after))))


def available_date(report_date: Column, lag_months: int) -> Column:
    return F.add_months(report_date, lag_months)


def fiscal_label(period_end: Column) -> Column:
    """A period ending June or later carries its own calendar year, else the one before."""
    return F.year(period_end) - F.when(F.month(period_end) < 6, 1).otherwise(0)


# Fiscal year end (month, day, years after the label) per market.
FISCAL_YEAR_END = {
    "us": (12, 31, 0),
    "japan": (3, 31, 1),
    "vietnam": (12, 31, 0),
}


def fiscal_end(fiscal_year: Column, market: str) -> Column:
    month, day, shift = FISCAL_YEAR_END[market.lower()]
    return F.make_date(fiscal_year + shift, F.lit(month), F.lit(day))


def holding_formation(date: Column) -> Column:
    """The formation year whose holding year contains ``date``."""
    return F.year(F.add_months(date, -6))


def formations_covering(date: Column, months_before: int, slack_days: int = 0) -> Column:
    """Array of formation years y with  fd(y) - months - slack <= date < fd(y).

    A date lies in only a few such windows, so exploding this array replaces any join of
    bars with a table of formation years.
    """
    candidates = F.sequence(F.year(date), F.year(date) + F.lit(months_before // 12 + 1))
    return F.filter(
        candidates,
        lambda y: (F.date_sub(F.add_months(formation_date(y), -months_before), slack_days)
                   <= date) & (date < formation_date(y)))
