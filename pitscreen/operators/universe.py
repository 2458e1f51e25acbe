"""Who may be bought at each formation, using only what was public then."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pitscreen.functions.dates import (available_date, formation_date, holding_end,
                                       holding_formation)
from pitscreen.operators.ordering import beside, exact_quantiles, top_k
from pitscreen.sources.schemas import require

# Lines that must be present, where the frame carries them, before a name may enter.
COMPLETE_LINES = ["total_assets", "net_income", "cfo", "current_assets",
                  "current_liabilities", "shares_outstanding", "revenue", "cogs",
                  "book_value", "market_cap"]


def point_in_time(fundamentals: DataFrame, lag_months: int = 5,
                  need_prior: bool = True) -> DataFrame:
    """Fiscal year T-1 rows public at formation T, with ``formation_year``.

    A name also needs its T-2 row unless the market arrives scored.
    """
    formed = formation_date(F.col("fiscal_year") + 1)
    public = (fundamentals
              .where(available_date(F.col("report_date"), lag_months) <= formed)
              .withColumn("formation_year", F.col("fiscal_year") + 1))
    if not need_prior:
        return public
    prior = fundamentals.select("ticker", (F.col("fiscal_year") + 1).alias("fiscal_year"))
    return public.join(prior, ["ticker", "fiscal_year"], "left_semi")


def snapshot(fundamentals: DataFrame, lag_months: int = 5, need_prior: bool = True) -> DataFrame:
    """Every statement row a formation may read: T-1 as above plus T-2 and T-3."""
    usable = point_in_time(fundamentals, lag_months, need_prior)
    if not need_prior:
        return usable
    names = usable.select("ticker", "formation_year")
    earlier = (fundamentals
               .withColumn("formation_year", F.explode(F.array(
                   F.col("fiscal_year") + 2, F.col("fiscal_year") + 3)))
               .join(names, ["ticker", "formation_year"], "left_semi"))
    return usable.unionByName(earlier)


def liquidity_stats(prices: DataFrame) -> DataFrame:
    """Per ticker and formation: bars, median traded value, last bar of the year before.

    Grouped by (ticker, year), so a group is bounded by the sessions of one year.
    """
    return (prices.groupBy("ticker", (holding_formation(F.col("date")) + 1).alias("formation_year"))
            .agg(F.count("*").alias("days"),
                 F.median(F.col("adj_close") * F.col("volume")).alias("adv"),
                 F.max("date").alias("last_date")))


def alive(stats: DataFrame, min_days: int = 200, quiet_days: int = 10) -> DataFrame:
    formed = formation_date(F.col("formation_year"))
    return stats.where((F.col("days") >= min_days)
                       & (F.col("last_date") >= F.date_sub(formed, quiet_days)))


def complete_rows(snap: DataFrame) -> DataFrame:
    """Drops rows missing any required line the frame carries, or without market value."""
    require(snap, ["book_value", "market_cap"], "fundamentals")
    lines = [c for c in COMPLETE_LINES if c in snap.columns]
    return snap.na.drop(subset=lines).where(F.col("market_cap") > 0)


def build_universe(prices: DataFrame, snap: DataFrame, top_n: int = 150, min_days: int = 200,
                   membership: DataFrame | None = None) -> DataFrame:
    """At most ``top_n`` names per formation by median traded value, with adv and bm."""
    rows = complete_rows(snap)
    if membership is not None:
        # the formation date is a column of the key, so no list of names is shipped
        listed = membership.select(F.year("date").alias("formation_year"), "ticker").distinct()
        rows = rows.join(listed, ["ticker", "formation_year"], "left_semi")
    live = alive(liquidity_stats(prices), min_days).drop("days", "last_date")
    eligible = rows.join(live, ["ticker", "formation_year"])
    picked = top_k(eligible, ["formation_year"], [F.desc("adv"), F.col("ticker")], top_n, "adv_rank")
    return picked.withColumn("bm", F.try_divide("book_value", "market_cap"))


def high_bm_subset(universe: DataFrame, quantile: float = 0.2) -> DataFrame:
    """Names at or above the (1 - quantile) quantile of book-to-market of their formation."""
    cuts = exact_quantiles(universe, ["formation_year"], "bm", {"_cut": 1 - quantile})
    return (universe.join(F.broadcast(cuts), "formation_year")
            .where(F.col("bm") >= F.col("_cut")).drop("_cut"))


def feasibility(value_names: DataFrame, snap: DataFrame, universe: DataFrame, prices: DataFrame,
                k: int, first_year: int, last_year: int,
                evaluation_end: str | None = None) -> DataFrame:
    """Per formation year: can it be filled and held to the end, and if not, why."""
    spark = prices.sparkSession
    years = spark.range(first_year, last_year + 1).select(
        F.col("id").cast("int").alias("formation_year"))
    end = prices.agg(F.max("date").alias("price_end"))
    count = lambda df, out: df.groupBy("formation_year").agg(F.count("*").alias(out))
    # every side has one row per formation year
    t = beside(years.join(count(snap, "statements"), "formation_year", "left")
               .join(count(universe, "universe"), "formation_year", "left")
               .join(count(value_names, "value_names"), "formation_year", "left")
               .na.fill(0, ["statements", "universe", "value_names"]), end)
    limit = F.col("price_end")
    if evaluation_end:
        limit = F.least(limit, F.lit(evaluation_end).cast("date"))
    stop = holding_end(F.col("formation_year"))
    day = lambda d: F.date_format(d, "yyyy-MM-dd")
    reason: Column = (
        F.when(F.col("statements") == 0, "no point-in-time statements")
        .when(F.col("value_names") < k, F.concat(
            F.lit("high-B/M subset "), F.col("value_names"), F.lit(f" < basket {k}")))
        .when(stop > limit, F.concat(
            F.lit("holding year ends "), day(stop), F.lit(", past the "), day(limit),
            F.lit(" evaluation end")))
        .otherwise(""))
    return (t.withColumn("reason", reason).withColumn("usable", F.col("reason") == "")
            .select("formation_year", "universe", "value_names", "usable", "reason"))
