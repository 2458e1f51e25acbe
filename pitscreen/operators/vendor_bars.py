"""Vendor bars to month ends, June turnover, entry and exit prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from pitscreen.functions.numeric import adjusted_close, safe_div
from pitscreen.operators.asof import first_session_from, last_on_or_before
from pitscreen.operators.ordering import beside, exact_quantiles
from pitscreen.operators.shares import SHARE_COLS, share_count
from pitscreen.session import land

# Fixed values of the market's rules.
SHARE_UNIT = 1000
WINDOW_DAYS = 30
MIN_TRADED_PCT = 50
TURNOVER_PERCENTILE = 10
MAX_ENTRY_LEAD_DAYS = 30
MAX_EXIT_LAG_DAYS = 30


def dated(bars: DataFrame) -> DataFrame:
    """Text dates to dates, once, at ingest."""
    return bars.withColumn("date", F.to_date("date"))


def share_bars(bars: DataFrame, priced: bool = True) -> DataFrame:
    """Rows quoted in share units (index rows carry another unit)."""
    out = bars.where(F.col("unit") == SHARE_UNIT)
    return out.where(F.col("price_close") > 0) if priced else out


def export_prices(bars: DataFrame, names: DataFrame) -> DataFrame:
    """Adjusted closes and matched volume of the exported names, rounded for hand-over."""
    adj = adjusted_close(F.col("price_close"), F.col("unit"), F.col("adj_ratio"))
    return (share_bars(bars).where(F.col("adj_ratio") > 0)
            .join(names.select("symbol").distinct(), "symbol", "left_semi")
            .select(F.col("symbol").alias("ticker"), "date", F.round(adj, 4).alias("adj_close"),
                    F.round("deal_volume").cast("bigint").alias("volume")))


def index_levels(bars: DataFrame, symbols: list[str]) -> DataFrame:
    """Benchmark levels; asks for no symbol that has no rows."""
    adj = adjusted_close(F.col("price_close"), F.col("unit"), F.col("adj_ratio"))
    return (bars.where(F.col("symbol").isin(symbols) & (F.col("price_close") > 0)
                       & (F.col("adj_ratio") > 0))
            .select(F.col("symbol").alias("ticker"), "date", adj.alias("adj_close"),
                    F.col("total_volume").alias("volume")))


def absent_symbols(bars: DataFrame, symbols: list[str]) -> DataFrame:
    want = bars.sparkSession.createDataFrame([(s,) for s in symbols], "symbol string")
    return want.join(bars.select("symbol").distinct(), "symbol", "left_anti")


def month_end_bars(bars: DataFrame) -> DataFrame:
    """Last traded session of each (symbol, month), else its last session, flagged stale.

    ``max_by`` on (traded, date) combines before the shuffle; no month is sorted.
    """
    traded = F.col("total_volume") > 0
    best = F.max_by(F.struct("date", (F.col("price_close") * F.col("unit")).alias("close")),
                    F.struct(traded, F.col("date")))
    return (share_bars(bars).groupBy("symbol", F.trunc("date", "month").alias("month"))
            .agg(best.alias("b"), F.count("*").alias("sessions"),
                 F.count_if(traded).alias("traded_sessions"))
            .select("symbol", "month", "b.date", "b.close", "sessions", "traded_sessions",
                    (F.col("traded_sessions") == 0).alias("stale")))


def last_bar_of_month(bars: DataFrame) -> DataFrame:
    adj = adjusted_close(F.col("price_close"), F.col("unit"), F.col("adj_ratio"))
    return (share_bars(bars).groupBy("symbol", F.trunc("date", "month").alias("month"))
            .agg(F.max("date").alias("date"), F.max_by(adj, "date").alias("close_adj")))


def period_end_close(month_ends: DataFrame, month: int = 12) -> DataFrame:
    return (month_ends.where(F.month("month") == month)
            .select("symbol", F.year("month").cast("string").alias("period"), "close",
                    F.col("date").alias("close_date"), F.col("stale").alias("price_stale")))


def unmatched_closes(panel: DataFrame, month_ends: DataFrame, closes: DataFrame) -> DataFrame:
    """Why firm-years have no close: before the first trade, after the last, or a gap."""
    span = month_ends.groupBy("symbol").agg(F.min(F.year("month")).alias("first"),
                                            F.max(F.year("month")).alias("last"))
    y = F.col("period").cast("int")
    p = (panel.select("symbol", "period").join(closes, ["symbol", "period"], "left")
         .join(span, "symbol", "left"))
    none = F.col("close").isNull()
    return p.agg(F.count("*").alias("rows"), F.count_if(~none).alias("matched"),
                 F.count_if(none).alias("unmatched"),
                 F.count_if(none & (y < F.col("first"))).alias("before_first_trade"),
                 F.count_if(none & (y > F.col("last"))).alias("after_last_trade"),
                 F.count_if(none & y.between(F.col("first"), F.col("last"))).alias("gap"))


def repeated_blocks(bars: DataFrame) -> DataFrame:
    """Per year: bars repeating the previous day's block or matched volume."""
    w = W.partitionBy("symbol").orderBy("date")  # one row a session
    p = (share_bars(bars, priced=False)
         .withColumn("pv_prev", F.lag("putthrough_volume").over(w))
         .withColumn("dv_prev", F.lag("deal_volume").over(w)))
    again = lambda v, prev: (F.col(v) > 0) & (F.col(v) == F.col(prev))
    pv, dv = again("putthrough_volume", "pv_prev"), again("deal_volume", "dv_prev")
    return p.groupBy(F.year("date").alias("year")).agg(
        F.count("*").alias("bars"), F.count_if(pv).alias("pv_repeat_bars"),
        F.count_if(dv).alias("dv_repeat_bars"),
        F.round(100 * safe_div(F.sum(F.when(pv, F.col("putthrough_volume")).otherwise(0.0)),
                               F.sum("total_volume")), 2).alias("pv_repeat_vol_pct"))


def _june(date: Column, days: int = WINDOW_DAYS) -> Column:
    end = F.make_date(F.year(date), F.lit(6), F.lit(30))
    return (date <= end) & (date > F.date_sub(end, days))


def window_calendar(bars: DataFrame, days: int = WINDOW_DAYS) -> DataFrame:
    """Sessions of the screening window per year, from every symbol including indices."""
    return (bars.where(_june(F.col("date"), days))
            .groupBy(F.year("date").alias("formation_year"), "date").agg(F.lit(1).alias("_d"))
            .groupBy("formation_year")
            .agg(F.count("*").alias("market_sessions"), F.min("date").alias("window_start"),
                 F.max("date").alias("window_end")))


def window_volumes(bars: DataFrame, days: int = WINDOW_DAYS) -> DataFrame:
    value = F.col("deal_volume") * F.col("price_average") * F.col("unit")
    return (share_bars(bars, priced=False).where(_june(F.col("date"), days))
            .groupBy("symbol", F.year("date").alias("formation_year"))
            .agg(F.count("*").alias("bars"), F.count_if(F.col("deal_volume") > 0)
                 .alias("traded_sessions"), F.sum("deal_volume").alias("deal_volume"),
                 F.sum("total_volume").alias("total_volume"), F.sum(value).alias("deal_value"),
                 F.max("date").alias("last_bar")))


def window_rows(bars: DataFrame) -> DataFrame:
    """Window volumes beside the market's sessions, by the fiscal year they screen: a row a symbol and year."""
    cal = window_calendar(bars).select("formation_year", "market_sessions")
    return (window_volumes(bars).join(F.broadcast(cal), "formation_year")
            .withColumn("traded_pct", F.round(
                100 * F.col("traded_sessions") / F.col("market_sessions"), 2))
            .withColumn("period", (F.col("formation_year") - 1).cast("string")))


def turnover_rows(capital: DataFrame, windows: DataFrame, counts: DataFrame) -> DataFrame:
    """``window_rows`` over the share count of the fiscal year they screen."""
    p = share_count(capital.join(counts, ["symbol", "period"], "left"))
    t = p.join(windows, ["symbol", "period"], "left")
    keep = [c for c in ("treasury_stock",) if c in t.columns]
    return t.select(
        "symbol", "period", *keep, "paid_in_capital", *SHARE_COLS, "formation_year",
        "market_sessions", "bars", "traded_sessions", "traded_pct", "deal_volume",
        "total_volume", "deal_value", "last_bar",
        safe_div(F.col("deal_volume"), F.col("shares")).alias("turnover"),
        safe_div(F.col("deal_volume"), F.col("shares_issued")).alias("turnover_issued"),
        safe_div(F.col("total_volume"), F.col("shares")).alias("turnover_total"),
        F.round(100 * (1 - safe_div(F.col("deal_volume"), F.col("total_volume"))), 2)
        .alias("putthrough_pct"),
        safe_div(F.col("deal_value"), F.col("traded_sessions")).alias("adtv"))


def turnover_cuts(market: DataFrame, percentile: float = TURNOVER_PERCENTILE) -> DataFrame:
    """The market's own percentile per formation year, on both share bases."""
    p = percentile / 100
    q = lambda col, name: exact_quantiles(
        market.where(F.col("formation_year").isNotNull()), ["formation_year"], col, {name: p})
    return q("turnover", "min_turnover").join(q("turnover_issued", "min_turnover_issued"),
                                              "formation_year")


def tradeable(panel: DataFrame, cuts: DataFrame, min_traded: float = MIN_TRADED_PCT) -> DataFrame:
    """Strictly above the market's cut and traded on enough sessions; null without turnover."""
    verdict = lambda t, cut: F.when(F.col("turnover").isNotNull(), F.coalesce(
        (F.col(t) > F.col(cut)) & (F.col("traded_pct") >= min_traded), F.lit(False)))
    return (panel.join(F.broadcast(cuts), "formation_year", "left")  # one row a year
            .withColumn("tradeable", verdict("turnover", "min_turnover"))
            .withColumn("tradeable_issued", verdict("turnover_issued", "min_turnover_issued")))


def capital_raised_next(panel: DataFrame, more_than: float = 1.05) -> DataFrame:
    """Marks rows whose next row's charter capital is more than 5% higher."""
    nxt = F.lead("paid_in_capital").over(W.partitionBy("symbol").orderBy("period"))
    return panel.withColumn("raised_next", F.coalesce(
        safe_div(nxt, F.col("paid_in_capital")) > more_than, F.lit(False)))


def turnover_coverage(panel: DataFrame) -> DataFrame:
    has, n = F.col("turnover").isNotNull(), F.count_if
    zero = has & (F.col("deal_volume") == 0)
    return panel.agg(
        F.count("*").alias("rows"), n(has).alias("with_window"), n(F.col("bars").isNull()).alias("no_bars"),
        n(F.col("shares_source") == "outstanding").alias("vendor_count"), n(zero).alias("zero_volume"),
        n(zero & (F.col("traded_pct") >= MIN_TRADED_PCT)).alias("zero_but_traded"),
        n(F.col("bars") < F.col("market_sessions") / 2).alias("listed_under_half"),
        n("raised_next").alias("raised_next"))


def turnover_by_period(panel: DataFrame) -> DataFrame:
    kept = F.coalesce("tradeable", F.lit(False))
    counts = panel.groupBy("period").agg(
        F.max("formation_year").alias("formation"), F.count("*").alias("rows"),
        F.count("turnover").alias("with_window"), F.max("min_turnover").alias("min_turnover"),
        F.count_if(kept).alias("tradeable"),
        F.round(100 * safe_div(F.count_if(kept), F.count("turnover")), 1).alias("kept_pct"))
    med = (exact_quantiles(panel, ["period"], "turnover", {"med_turnover": 0.5})
           .join(exact_quantiles(panel, ["period"], "traded_pct", {"med_traded_pct": 0.5}), "period"))
    return counts.join(F.broadcast(med), "period", "left")


def floor_sensitivity(panel: DataFrame, floors: list[int]) -> DataFrame:
    """What each traded-day floor keeps with and without the turnover cut."""
    rows = panel.withColumn("floor", F.explode(F.array(*[F.lit(x) for x in floors])))
    has = F.col("turnover").isNotNull()
    above = has & (F.col("traded_pct") >= F.col("floor"))
    liquid = F.coalesce(F.col("turnover") > F.col("min_turnover"), F.lit(False))
    return rows.groupBy("floor").agg(
        F.count_if(above).alias("floor_only"), F.count_if(above & liquid).alias("both_screens"),
        F.count_if(above & ~liquid).alias("turnover_removes"))


def filter_cost(panel: DataFrame, scores: DataFrame, cutoff: int = 8) -> DataFrame:
    """What the screen takes out of the selection, per period and in total."""
    t = scores.join(panel.select("symbol", "period", "tradeable"), ["symbol", "period"], "left")
    s, v = F.coalesce(F.col("f_score") >= cutoff, F.lit(False)), F.col("tradeable")
    return (t.rollup("period").agg(
        F.count_if(s).alias("selected"), F.count_if(s & F.coalesce(v, F.lit(False))).alias("tradeable"),
        F.count_if(s & (v == False)).alias("dropped"),  # noqa: E712
        F.count_if(s & v.isNull()).alias("no_window"))
        .withColumn("period", F.coalesce("period", F.lit("ALL")))
        .withColumn("kept_pct", F.round(100 * safe_div(F.col("tradeable"), F.col("selected")), 1)))


def basis_flips(panel: DataFrame) -> DataFrame:
    """Verdicts that change when turnover is measured on issued instead of chosen shares."""
    now = F.coalesce("tradeable", F.lit(False))
    old = F.coalesce("tradeable_issued", F.lit(False))
    lift = safe_div(F.col("turnover"), F.col("turnover_issued"))
    return panel.agg(
        F.count("turnover").alias("rows"), F.count_if(lift > 1.0001).alias("rose"),
        F.count_if(old).alias("tradeable_issued"), F.count_if(now).alias("tradeable"),
        F.count_if(now & ~old).alias("flipped_in"), F.count_if(old & ~now).alias("flipped_out"))


# ---- entry, exit, forward return ----

def entry_prices(bars: DataFrame) -> DataFrame:
    """First session on or after 1 July per (symbol, fiscal year it trades on)."""
    b = (share_bars(bars)
         .withColumn("close_raw", F.col("price_close") * F.col("unit"))
         .withColumn("price_traded", F.col("total_volume") > 0))
    e = first_session_from(b, 7, 1, "symbol", "date", ["close_raw", "adj_ratio", "price_traded"])
    lead = F.datediff("date", F.make_date(F.col("formation_year"), F.lit(7), F.lit(1)))
    return e.select("symbol", (F.col("formation_year") - 1).cast("string").alias("period"),
                    F.col("date").alias("price_date"), lead.alias("entry_lead_days"),
                    "price_traded", "close_raw", "adj_ratio",
                    safe_div(F.col("close_raw"), F.col("adj_ratio")).alias("close_adj"))


def exit_prices(panel: DataFrame, bars: DataFrame, holding_years: int = 1) -> DataFrame:
    """Adds the last adjusted close on or before the following 30 June, and what it means."""
    # read four times below, and a row a month in place of a row a session
    month_ends = land(last_bar_of_month(bars).withColumn("exit_price_date", F.col("date")), "exit-month-ends")
    last = month_ends.groupBy("symbol").agg(F.max("date").alias("_last_print"))
    end = month_ends.agg(F.max("date").alias("_data_end"))
    p = panel.withColumn("exit_date", F.make_date(
        F.col("period").cast("int") + 1 + holding_years, F.lit(6), F.lit(30)))
    found = last_on_or_before(
        p.select("symbol", "exit_date").distinct(), month_ends, "symbol", "exit_date", "date",
        {"exit_price_date": "exit_price_date", "close_adj": "close_adj_exit"})
    t = beside(p.join(found, ["symbol", "exit_date"], "left").join(last, "symbol", "left"), end)
    lag = F.datediff("exit_date", "exit_price_date")
    complete = F.col("exit_date") <= F.col("_data_end")
    resumed = F.coalesce(F.col("_last_print") > F.col("exit_date"), F.lit(False))
    gone = complete & F.coalesce(lag > MAX_EXIT_LAG_DAYS, F.lit(False)) & ~resumed
    return (t.withColumn("exit_lag_days", lag).withColumn("holding_complete", complete)
            .withColumn("exit_permanent", gone).drop("_last_print", "_data_end"))


def forward_return(panel: DataFrame, delisting_return: float | None = None) -> DataFrame:
    r = F.when(F.col("holding_complete"), safe_div(F.col("close_adj_exit"), F.col("close_adj")) - 1)
    if delisting_return is not None:
        r = F.when(F.col("exit_permanent"), F.lit(delisting_return)).otherwise(r)
    return panel.withColumn("fwd_return_1y", r)


def delisting_policies(panel: DataFrame, policies: list[float | None],
                       selected: Column) -> DataFrame:
    """Median and mean forward return under each policy, all finished rows and selected."""
    table = F.array(*[F.struct(F.lit("last traded price" if x is None else f"{x:.0%}").alias("policy"),
                               F.lit(x).cast("double").alias("value")) for x in policies])
    r = F.when(F.col("exit_permanent") & F.col("p.value").isNotNull(), F.col("p.value")).otherwise(
        F.col("fwd_return_1y"))
    rows = (panel.where("holding_complete").withColumn("sel", F.coalesce(selected, F.lit(False)))
            .withColumn("p", F.explode(table))
            .select(F.col("p.policy").alias("policy"), "sel", r.alias("ret"))
            .withColumn("ret_sel", F.when(F.col("sel"), F.col("ret"))))
    means = rows.groupBy("policy").agg(F.avg("ret").alias("mean"), F.avg("ret_sel").alias("mean_selected"))
    med = (exact_quantiles(rows, ["policy"], "ret", {"median": 0.5})
           .join(exact_quantiles(rows, ["policy"], "ret_sel", {"median_selected": 0.5}), "policy", "left"))
    return means.join(F.broadcast(med), "policy")


def lag_buckets(panel: DataFrame, days: str, near: int, far: int) -> DataFrame:
    """Distribution of entry leads or exit lags."""
    d = F.col(days)
    return panel.agg(
        F.count(d).alias("priced"), F.count_if(d <= near).alias("near"),
        F.count_if((d > near) & (d <= far)).alias("middle"), F.count_if(d > far).alias("far"),
        F.max(d).alias("longest"))


def return_by_period(panel: DataFrame, investable: Column, selected: Column) -> DataFrame:
    inv = F.coalesce(investable & F.col("holding_complete"), F.lit(False))
    sel = F.coalesce(inv & selected, F.lit(False))
    t = (panel.withColumn("_i", F.when(inv, F.col("fwd_return_1y")))
         .withColumn("_s", F.when(sel, F.col("fwd_return_1y"))))
    counts = t.groupBy("period").agg(
        F.count_if(inv).alias("investable"), F.count_if(sel).alias("selected"),
        F.count_if(inv & F.col("exit_permanent")).alias("gone"))
    med = (exact_quantiles(t, ["period"], "_i", {"inv_median": 0.5})
           .join(exact_quantiles(t, ["period"], "_s", {"sel_median": 0.5}), "period", "left"))
    return counts.join(F.broadcast(med), "period", "left")


def coverage_screen(grid: DataFrame, bars: DataFrame, until: str) -> DataFrame:
    """Coverage score and traded days per symbol, with the verdict ``kept``."""
    years = [c for c in grid.columns if c.isdigit()]
    score = sum((F.least(F.col(c), F.lit(3)) for c in years[1:]), F.least(F.col(years[0]), F.lit(3)))
    days = (bars.where(F.col("date") <= F.lit(until).cast("date")).groupBy("symbol")
            .agg(F.count("*").alias("price_available_day")))
    return (grid.withColumn("coverage_score_year", score / 3).join(days, "symbol", "left")
            .na.fill(0, ["price_available_day"])
            .withColumn("kept", ~((F.col("coverage_score_year") < 2)
                                  | (F.col("price_available_day") == 0))))
