"""As-of lookups: the last (or first) price on one side of a date.

Each lookup is an equi join on the ticker followed by a date filter and a ``max_by`` /
``min_by`` aggregate. Windows that are bounded in time join on (ticker, month) as well, so
only bars near the wanted date are shuffled together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

_MONTH = "_asof_month"


def _month_index(date) -> F.Column:
    return F.year(date) * 12 + F.month(date)


def last_within(left: DataFrame, bars: DataFrame, on: str, date_col: str, days: int,
                values: dict[str, str], bar_key: str = "ticker",
                bar_date: str = "date") -> DataFrame:
    """Backward as-of join with a tolerance in days.

    ``values`` maps a bar column to its output name; rows without a bar keep nulls. The
    bars of one (ticker, month) are bounded by the sessions of a month.
    """
    months = F.sequence(_month_index(F.date_sub(date_col, days)), _month_index(F.col(date_col)))
    keys = (left.select(on, date_col).distinct()
            .withColumn(_MONTH, F.explode(months)))
    near = bars.select(F.col(bar_key).alias(on), F.col(bar_date).alias("_bar_date"),
                       *[F.col(v).alias(f"_v_{v}") for v in values],
                       _month_index(F.col(bar_date)).alias(_MONTH))
    found = (keys.join(near, [on, _MONTH])
             .where((F.col("_bar_date") <= F.col(date_col))
                    & (F.col("_bar_date") >= F.date_sub(date_col, days)))
             .groupBy(on, date_col)
             .agg(*[F.max_by(f"_v_{v}", "_bar_date").alias(out) for v, out in values.items()]))
    return left.join(found, [on, date_col], "left")


def market_cap_at_period_end(fundamentals: DataFrame, prices: DataFrame,
                             tolerance_days: int = 14) -> DataFrame:
    """Shares times the last close at or before the period end.

    The raw close is used where the prices carry one: reported share counts pair with
    unadjusted prices.
    """
    close = "close_raw" if "close_raw" in prices.columns else "adj_close"
    priced = last_within(fundamentals, prices, "ticker", "report_date", tolerance_days,
                         {close: "_close"})
    return (priced.withColumn("market_cap", F.col("shares_outstanding") * F.col("_close"))
            .select(*fundamentals.columns, "market_cap"))


def year_end_price(prices: DataFrame, days: int = 30, close: str = "close_raw") -> DataFrame:
    """(ticker, fiscal_year, price): last close in the ``days`` before 31 December."""
    year_end = F.make_date(F.year("date"), F.lit(12), F.lit(31))
    return (prices.where(F.col("date") > F.date_sub(year_end, days))
            .groupBy("ticker", F.year("date").alias("fiscal_year"))
            .agg(F.max_by(close, "date").alias("price")))


def first_session_from(bars: DataFrame, month: int, day: int, key: str, date: str,
                       values: list[str]) -> DataFrame:
    """Forward as-of inside the calendar year: first bar on or after month/day."""
    start = F.make_date(F.year(date), F.lit(month), F.lit(day))
    return (bars.where(F.col(date) >= start)
            .groupBy(key, F.year(date).alias("formation_year"))
            .agg(F.min(date).alias(date),
                 *[F.min_by(v, date).alias(v) for v in values]))


def last_on_or_before(targets: DataFrame, bars: DataFrame, on: str, target: str,
                      bar_date: str, values: dict[str, str]) -> DataFrame:
    """Backward as-of join without a tolerance, for targets on any day.

    Of the target's own month every bar is met, of each month before it only the last one, so a
    key's rows are bounded by its months and the sessions of one.
    """
    bar = bars.select(on, F.col(bar_date).alias("_bar_date"), _month_index(F.col(bar_date)).alias(_MONTH),
                      *[F.col(v).alias(f"_v_{v}") for v in values])
    cols = ["_bar_date", *[f"_v_{v}" for v in values]]
    month_end = bar.groupBy(on, _MONTH).agg(F.max("_bar_date").alias("_bar_date"),
                                            *[F.max_by(c, "_bar_date").alias(c) for c in cols[1:]])
    wanted = targets.select(on, target).distinct().withColumn("_target_month", _month_index(F.col(target)))
    before = wanted.join(month_end, on).where(F.col(_MONTH) < F.col("_target_month"))
    within = (wanted.withColumn(_MONTH, F.col("_target_month")).join(bar, [on, _MONTH])
              .where(F.col("_bar_date") <= F.col(target)))
    found = (before.select(on, target, *cols).unionByName(within.select(on, target, *cols)).groupBy(on, target)
             .agg(*[F.max_by(f"_v_{v}", "_bar_date").alias(out) for v, out in values.items()]))
    return targets.join(found, [on, target], "left")
