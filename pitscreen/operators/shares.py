"""Share counts: issued, outstanding, the guarded choice, and its audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from pitscreen.functions.numeric import (MAX_TREASURY_FRAC, PAR_VALUE, SHARE_GAP_TOL,
                                         book_equity, book_to_market, issued_shares, safe_div)
from pitscreen.operators.ordering import beside, exact_quantiles

SHARE_COLS = ["shares_issued", "shares_out", "shares_gap", "shares_source", "shares"]


def share_count(df: DataFrame, paid_in: str = "paid_in_capital", out: str = "share_at_period_end",
                unit: float = 1.0, par: float = PAR_VALUE, tol: float = SHARE_GAP_TOL,
                max_treasury: float | Column = MAX_TREASURY_FRAC) -> DataFrame:
    """Adds the issued count, the vendor's count, their gap, and the count to use.

    The vendor's count is taken when it lies within the two guards, never above issued.
    """
    issued, vendor = issued_shares(F.col(paid_in), unit, par), F.col(out).cast("double")
    gap = safe_div(vendor - issued, issued)
    cap = max_treasury if isinstance(max_treasury, Column) else F.lit(max_treasury)
    usable = F.coalesce(vendor.isNotNull() & (gap <= tol) & (gap >= -cap), F.lit(False))
    return df.withColumns({
        "shares_issued": issued, "shares_out": vendor, "shares_gap": gap,
        "shares_source": F.when(usable, "outstanding").otherwise("par_implied"),
        "shares": F.when(usable, F.least(vendor, issued)).otherwise(issued)})


def vendor_counts(summary: DataFrame) -> DataFrame:
    """(symbol, period, share_at_period_end) from the annual rows of the summary."""
    return (summary.where((F.col("quarter") == 0) & (F.col("share_at_period_end") > 0))
            .select("symbol", F.col("year").cast("string").alias("period"),
                    "share_at_period_end"))


def book_to_market_panel(panel: DataFrame, closes: DataFrame, counts: DataFrame) -> DataFrame:
    """Book equity, share choice, market equity and both ratios per firm-year."""
    be = book_equity(F.col("owner_equity"), F.col("minority_interest"))
    p = share_count(panel.join(counts, ["symbol", "period"], "left")
                    .join(closes, ["symbol", "period"], "left")
                    .withColumn("book_equity", be))
    me = F.col("close") * F.col("shares")
    return p.select(
        "symbol", "period", "book_equity", *SHARE_COLS, "close", me.alias("market_equity"),
        book_to_market(F.col("book_equity"), me).alias("bm"),
        book_to_market(F.col("book_equity"), F.col("close") * F.col("shares_issued"))
        .alias("bm_shares_issued"), "close_date", "price_stale",
        (F.coalesce("treasury_stock", F.lit(0.0)) != 0).alias("has_treasury"))


def bm_coverage(bm: DataFrame) -> DataFrame:
    """One row: how many rows have a ratio, and why the others do not."""
    has, vendor = F.col("bm").isNotNull(), F.col("shares_source") == "outstanding"
    n = F.count_if
    return bm.agg(
        F.count("*").alias("rows"), n(has).alias("with_bm"),
        n(F.col("close").isNull()).alias("no_close"),
        n(F.col("shares_issued") == 0).alias("no_capital"),
        n(F.col("book_equity") <= 0).alias("non_positive_equity"),
        n(F.coalesce("price_stale", F.lit(False))).alias("stale_price"),
        n("has_treasury").alias("treasury_held"), n(has & vendor).alias("vendor_count"),
        n(has & vendor & (F.col("shares_gap") < -SHARE_GAP_TOL)).alias("vendor_below_issued"),
        n(has & ~vendor).alias("fell_back"))


def share_source_counts(bm: DataFrame) -> DataFrame:
    """Where the denominator came from and why it fell back."""
    gap, n = F.col("shares_gap"), F.count_if
    return bm.agg(
        F.count("*").alias("rows"), n(F.col("shares_source") == "outstanding").alias("outstanding"),
        n(F.abs(gap) <= SHARE_GAP_TOL).alias("same_as_issued"),
        n(gap < -SHARE_GAP_TOL).alias("below_issued"),
        n(F.col("shares_source") == "par_implied").alias("par_implied"),
        n(F.col("shares_out").isNull()).alias("no_vendor_count"),
        n(gap > SHARE_GAP_TOL).alias("above_issued"),
        n(gap < -MAX_TREASURY_FRAC).alias("below_guard"))


def bm_by_period(bm: DataFrame) -> DataFrame:
    """Coverage, quartiles and stale share per year."""
    has = F.col("bm").isNotNull()
    counts = bm.groupBy("period").agg(
        F.count("*").alias("rows"), F.count("bm").alias("with_bm"),
        F.round(100 * safe_div(F.count_if(F.coalesce("price_stale", F.lit(False))),
                               F.count_if(has)), 1).alias("stale_pct"))
    q = exact_quantiles(bm, ["period"], "bm", {"p25": 0.25, "median_bm": 0.5, "p75": 0.75})
    return counts.join(F.broadcast(q), "period", "left")  # one row a year


def at_least_one(one: DataFrame, cols: list[str]) -> DataFrame:
    """A one-row summary that is also there, with nulls, when nothing was summarised."""
    return one.agg(*[F.max(c).alias(c) for c in cols])


def ratio_shift(df: DataFrame, new: Column, old: Column) -> DataFrame:
    """How far two versions of a number differ: counts off by 1, 5, 20 per cent, medians."""
    r = df.select(safe_div(new, old).alias("ratio")).where("ratio is not null")
    off, n = F.abs(F.col("ratio") - 1), F.count_if
    moved = exact_quantiles(r.where(off > 0.01), [], "ratio", {"median_moved": 0.5, "p95_moved": 0.95})
    counts = r.agg(F.count("*").alias("rows"), n(off <= 1e-9).alias("unchanged"),
                   n(off > 0.01).alias("off_1pct"), n(off > 0.05).alias("off_5pct"),
                   n(off > 0.20).alias("off_20pct"), F.max("ratio").alias("largest"))
    return beside(counts, at_least_one(moved, ["median_moved", "p95_moved"]))


def describe(df: DataFrame, by: list[str], value: str, probs: list[float]) -> DataFrame:
    """count, mean, sd, min, max and exact percentiles of a column."""
    stats = df.groupBy(*by).agg(
        F.count(value).alias("count"), F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))
    q = exact_quantiles(df, by, value, {f"p{round(100 * p, 1):g}".replace(".", "_"): p for p in probs})
    return stats.join(F.broadcast(q), by, "left") if by else beside(stats, q)


# ---- diagnosis of the vendor's count ----

def comparable_counts(summary: DataFrame, par: float = PAR_VALUE) -> DataFrame:
    """Annual rows where both counts exist, with the signed relative gap."""
    implied = F.col("paid_in_capital") / par
    return (summary.where((F.col("quarter") == 0) & (F.col("paid_in_capital") > 0)
                          & (F.col("share_at_period_end") > 0))
            .withColumn("implied", implied)
            .withColumn("rel", (F.col("share_at_period_end") - implied) / implied)
            .withColumn("has_treasury", F.coalesce("treasury_stock", F.lit(0.0)) != 0))


def count_agreement(base: DataFrame) -> DataFrame:
    d, n = F.col("share_at_period_end") - F.col("implied"), F.count_if
    return base.agg(F.count("*").alias("rows"), n(F.abs(d) < 1).alias("exact"),
                    n(d <= -1).alias("below"), n(d >= 1).alias("above"))


def gap_band(rel: Column) -> Column:
    """Five ordered bands of the gap."""
    t, m = SHARE_GAP_TOL, MAX_TREASURY_FRAC
    return (F.when(rel <= -m, 1).when(rel <= -t, 2).when(rel <= t, 3).when(rel <= m, 4)
            .otherwise(5))


def gap_bands(base: DataFrame) -> DataFrame:
    return (base.groupBy(gap_band(F.col("rel")).alias("band"))
            .agg(F.count("*").alias("rows"), F.count_if("has_treasury").alias("with_treasury"),
                 F.round(100 * F.avg(F.col("has_treasury").cast("double")), 1)
                 .alias("treasury_pct")))


def treasury_netting(base: DataFrame) -> DataFrame:
    """Of the rows with treasury stock: netted out, left in, or above issued."""
    t = base.where("has_treasury")
    d, n = F.col("share_at_period_end") - F.col("implied"), F.count_if
    counts = t.agg(F.count("*").alias("rows"), n(d < -1).alias("netted"),
                   n(F.abs(d) < 1).alias("not_netted"), n(d > 1).alias("above"))
    med = exact_quantiles(t.where(d < -1), [], "rel", {"median_gap": 0.5})
    return beside(counts, at_least_one(med, ["median_gap"]))


def trace(base: DataFrame, symbol: str) -> DataFrame:
    """One symbol's charter capital, counts and gap by year."""
    return (base.where(F.col("symbol") == symbol)
            .select("year", "paid_in_capital", F.col("implied").cast("bigint").alias("implied"),
                    F.col("share_at_period_end").cast("bigint").alias("outstanding"),
                    F.round(F.col("implied") - F.col("share_at_period_end")).cast("bigint")
                    .alias("gap_shares"), F.round(-100 * F.col("rel"), 3).alias("gap_pct"),
                    "has_treasury").orderBy("year"))


def frozen_symbols(base: DataFrame, min_years: int = 5) -> DataFrame:
    """Symbols whose outstanding count never moves while charter capital does."""
    per = base.groupBy("symbol").agg(
        F.count("*").alias("years"), F.count_distinct("share_at_period_end").alias("n_out"),
        F.count_distinct("implied").alias("n_implied"))
    return per.where((F.col("years") >= min_years) & (F.col("n_out") == 1) & (F.col("n_implied") > 1))


def worst_above(base: DataFrame, frozen: DataFrame, n: int = 15) -> DataFrame:
    """Largest outstanding-over-issued multiples, marking frozen symbols (a top-n report)."""
    return (base.where(F.col("rel") > SHARE_GAP_TOL)
            .join(frozen.select("symbol", F.lit(True).alias("frozen")), "symbol", "left")
            .withColumn("frozen", F.coalesce("frozen", F.lit(False)))
            .withColumn("times", F.round(F.col("share_at_period_end") / F.col("implied"), 2))
            .orderBy(F.desc("times"), "symbol", "year").limit(n)
            .select("symbol", "year", "times", "has_treasury", "frozen"))


def suspicious_drops(base: DataFrame) -> DataFrame:
    """Falls of the outstanding count between neighbouring years, by treasury stock."""
    w = W.partitionBy("symbol").orderBy("year")
    p = (base.withColumn("near", F.coalesce(F.col("year") - F.lag("year").over(w) == 1, F.lit(False)))
         .withColumn("prev", F.lag("share_at_period_end").over(w)))
    fell = F.col("near") & (F.col("share_at_period_end") < F.col("prev") * (1 - SHARE_GAP_TOL))
    return p.agg(F.count_if("near").alias("pairs"), F.count_if(fell).alias("fell"),
                 F.count_if(fell & F.col("has_treasury")).alias("with_treasury"),
                 F.count_if(fell & ~F.col("has_treasury")).alias("without_treasury"))


def guard_sensitivity(bm: DataFrame, thresholds: list[float]) -> DataFrame:
    """Usable vendor counts and median ratio as the treasury guard widens.

    Each row is exploded to the few thresholds, so one pass serves all of them.
    """
    rows = bm.where(F.col("bm").isNotNull()).select(
        "book_equity", "close", "shares_issued", "shares_out", "bm",
        (F.col("shares_issued") * PAR_VALUE).alias("paid_in_capital"),
        F.explode(F.array(*[F.lit(x) for x in thresholds])).alias("threshold"))
    tried = share_count(rows, out="shares_out", max_treasury=F.col("threshold"))
    tried = tried.withColumn("bm_try", book_to_market(
        F.col("book_equity"), F.col("close") * F.col("shares")))
    counts = tried.groupBy("threshold").agg(
        F.count_if(F.col("shares_source") == "outstanding").alias("usable"),
        F.count_if(F.abs(F.col("bm_try") / F.col("bm") - 1) > 0.01).alias("changed_1pct"))
    med = exact_quantiles(tried, ["threshold"], "bm_try", {"median_bm": 0.5})
    return counts.join(F.broadcast(med), "threshold")


def flagged_rows(bm: DataFrame, at_least: float = 1.10) -> DataFrame:
    """Rows to inspect: fallback count, or a ratio moved by more than ten per cent."""
    moved = safe_div(F.col("bm"), F.col("bm_shares_issued"))
    return (bm.where(F.col("bm").isNotNull()).withColumn("bm_ratio", moved)
            .where((F.col("shares_source") == "par_implied") | (F.col("bm_ratio") > at_least))
            .orderBy(F.desc("bm_ratio"), "symbol", "period"))
