"""Numeric report tables: joins of result tables, each a few rows per market."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from pitscreen.functions.numeric import safe_div
from pitscreen.operators.evaluate import ALPHA
from pitscreen.operators.ordering import beside, spread_rank
from pitscreen.operators.paths import YEAR
from pitscreen.sources.schemas import FLAGS

# Order of strategies in reports.
STRATEGY_ORDER = ["score_EW", "score_GMV", "score_GMVsec", "score_high_EW", "score_LS", "value_EW",
                  "mktcap_EW", "liquidity_EW", "universe_EW", "universe_GMV"]
TESTED = ["ann_return", "sharpe", "max_drawdown"]


def strategy_order(book: Column) -> Column:
    pos = F.array_position(F.array(*[F.lit(s) for s in STRATEGY_ORDER]), book)
    return F.when(pos > 0, pos).otherwise(len(STRATEGY_ORDER) + 1).cast("int")


def publishable_panel(panel: DataFrame) -> DataFrame:
    """Identifiers, flags, score, sector and the rank by book-to-market; no continuous value.

    The rank covers every scored name of a year, so it is computed slice by slice.
    """
    ranked = spread_rank(panel, ["score_year"], "bm", "ticker", "bm_rank", ascending=False)
    keys = ["score_year", "ticker"]
    return (panel.select("score_year", "fiscal_year", "ticker", "fscore", *FLAGS, "sector")
            .join(ranked.select(*keys, F.col("bm_rank").cast("int").alias("bm_rank")), keys, "left"))


def sample_windows(headline: DataFrame, full: DataFrame) -> DataFrame:
    """First, last and number of formations per market, headline against full span."""
    agg = lambda d, p: d.groupBy("market").agg(
        F.min(YEAR).alias(f"{p}_first"), F.max(YEAR).alias(f"{p}_last"),
        F.count_distinct(YEAR).alias(f"{p}_formations"))
    return agg(headline, "headline").join(agg(full, "full"), "market", "full_outer")


def performance_table(summary: DataFrame, placement: DataFrame, benchmarks: DataFrame | None = None
                      ) -> DataFrame:
    """One row per strategy: every tested statistic beside its own p-value, then the rest.

    ``placement`` is (book, metric, p_value, random_mean, random_std).
    """
    p = placement.groupBy("book").pivot("metric", TESTED).agg(
        F.first("p_value").alias("p"), F.first("random_mean").alias("null_mean"),
        F.first("random_std").alias("null_sd"))
    cols = ["ann_return", "sharpe", "max_drawdown", "ann_vol", "turnover", "effective_n"]
    t = summary.select("book", *cols).join(p, "book", "left")
    if benchmarks is not None:
        t = t.unionByName(benchmarks.select("book", "ann_return", "sharpe", "max_drawdown", "ann_vol"),
                          allowMissingColumns=True)
    return t.withColumn("position", strategy_order(F.col("book"))).orderBy("position", "book")


def cross_country(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for market, t in tables.items():
        t = t.withColumn("market", F.lit(market))
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    return out


def grid_table(sweep: DataFrame, draws: list[int]) -> DataFrame:
    """K by N: one row per (market, k), p-values of each N side by side, D checked for N."""
    return (sweep.groupBy("mkt", "k").agg(
        F.min_by("EW", "N").alias("EW"), F.min_by("uniEW", "N").alias("uniEW"),
        F.min_by("value", "N").alias("value"), F.min_by("to_EW", "N").alias("to_EW"),
        F.min_by("effN_GMV", "N").alias("effN_GMV"), F.min_by("D", "N").alias("D"),
        F.min_by("D_p", "N").alias("D_p"),
        (F.count_distinct("D") <= 1).alias("D_same_for_all_N"),
        *[F.max(F.when(F.col("N") == n, F.col("p"))).alias(f"p_{n}") for n in draws]))


def gain_rows(gain: DataFrame, market: str, family: str, spec: str) -> DataFrame:
    """Rows of the shared gain table, rounded as it is kept."""
    r = lambda c, n: F.round(c, 4).alias(n)
    return gain.select(F.lit(market).alias("market"), F.lit(family).alias("family"),
                       F.lit(spec).alias("spec"), r("D_score", "D"), r("random_mean", "D_random_mean"),
                       r("percentile", "percentile"), r("p_value", "p_value"),
                       F.col("significant").alias("significant_5pct"), "n_draws")


def gain_per_k(sweep: DataFrame) -> DataFrame:
    """D does not vary with N, so one row per (market, k)."""
    return (sweep.groupBy("mkt", "k").agg(F.min_by("D", "N").alias("D"), F.min_by("D_p", "N").alias("p_value"))
            .select(F.col("mkt").alias("market"), F.lit("grid (full universe)").alias("family"),
                    F.concat(F.lit("k="), F.col("k"), F.lit(", GMV")).alias("spec"),
                    F.round("D", 4).alias("D"), F.round("p_value", 4).alias("p_value"),
                    (F.col("p_value") < ALPHA).alias("significant_5pct")))


def broad_universe(summary: DataFrame, placement: DataFrame) -> DataFrame:
    """Broad-universe strategies with the ratio's p-value against both random pools."""
    p = (placement.where((F.col("metric") == "sharpe") & (F.col("basis") == "gross"))
         .groupBy(F.lit("score_EW").alias("book"))
         .pivot("pool", ["random (full universe)", "random (other names)"]).agg(F.first("p_value")))
    p = p.toDF("book", "p_full_universe", "p_other_names")
    return summary.select("book", "ann_return", "ann_vol", "sharpe", "max_drawdown", "turnover",
                          "effective_n").join(p, "book", "left")


def feasibility_table(probe: DataFrame) -> DataFrame:
    """Formations examined, usable, and why the others are blocked, per market."""
    r, bad = F.col("reason"), ~F.col("usable")
    none, end = r == "no point-in-time statements", r.contains("evaluation end")
    return probe.groupBy("market").agg(
        F.count("*").alias("examined"), F.count_if("usable").alias("usable"),
        F.min(F.when(F.col("usable"), F.col(YEAR))).alias("first_usable"),
        F.max(F.when(F.col("usable"), F.col(YEAR))).alias("last_usable"),
        F.count_if(bad & none).alias("no_statements"), F.count_if(bad & end).alias("past_end"),
        F.count_if(bad & ~none & ~end).alias("other"))


def coverage_stats(diagnostics: DataFrame) -> DataFrame:
    """Universe range, overlap with random baskets, tie-break share, per market."""
    return diagnostics.groupBy("market").agg(
        F.min("universe").alias("universe_min"), F.max("universe").alias("universe_max"),
        F.avg("overlap_random").alias("overlap_random"), F.avg("tie_break_slots").alias("tie_break_slots"),
        F.count_if("value_fallback").alias("value_fallbacks"), F.avg("n_score_high").alias("n_score_high"))


def findings(sweep: DataFrame) -> DataFrame:
    """Per market: cells, significant cells, significant gains, cells beating the universe."""
    return sweep.groupBy("mkt").agg(
        F.count("*").alias("cells"), F.count_if("sig").alias("significant"),
        F.count_if(F.col("D_p") < ALPHA).alias("significant_gain"),
        F.count_if(F.col("EW") > F.col("uniEW")).alias("beats_universe"),
        F.min("EW").alias("EW_min"), F.max("EW").alias("EW_max"))


def best_benchmark(metrics: DataFrame, own_sharpe: DataFrame) -> DataFrame:
    """Best benchmark by ratio and whether the own book lies above it (one row each)."""
    best = metrics.agg(F.max_by("book", "sharpe").alias("best"), F.max("sharpe").alias("best_sharpe"))
    return (beside(best, own_sharpe.agg(F.max("sharpe").alias("own")))
            .select("best", "best_sharpe", "own", (F.col("own") > F.col("best_sharpe")).alias("above")))


def full_period(full: DataFrame, headline: DataFrame, full_place: DataFrame,
                headline_place: DataFrame) -> DataFrame:
    """Full-span figures beside the headline window's, one row per strategy."""
    s = lambda d, p: d.select("book", F.col("sharpe").alias(f"{p}_sharpe"),
                              F.col("ann_return").alias(f"{p}_ann_return"))
    q = lambda d, p: d.where(F.col("metric") == "sharpe").select(
        "book", F.col("percentile").alias(f"{p}_percentile"), F.col("p_value").alias(f"{p}_p_value"))
    t = s(full, "full").join(s(headline, "headline"), "book", "left")
    t = t.join(q(full_place, "full"), "book", "left").join(q(headline_place, "headline"), "book", "left")
    return t.withColumn("sharpe_delta", F.col("full_sharpe") - F.col("headline_sharpe"))


def score_histogram(scored: DataFrame) -> DataFrame:
    return scored.groupBy(YEAR, "fscore").agg(F.count("*").alias("names"))


def score_describe(scored: DataFrame) -> DataFrame:
    """Scores take ten values, so the exact percentile's table stays tiny."""
    q = lambda p: F.percentile("fscore", F.lit(p))
    return scored.groupBy(YEAR).agg(
        F.count("fscore").alias("count"), F.avg("fscore").alias("mean"), F.stddev_samp("fscore").alias("std"),
        F.min("fscore").alias("min"), q(0.25).alias("p25"), q(0.5).alias("p50"), q(0.75).alias("p75"),
        F.max("fscore").alias("max"))


def ratio_histogram(values: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """Equal-width bins between the extremes; the last bin is closed on both sides."""
    ends = values.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    v = beside(values.where(F.col(column).isNotNull()), ends)
    width = (F.col("hi") - F.col("lo")) / bins
    # the extremes come from a run of their own, so the smallest value may fall a hair below
    b = F.greatest(F.lit(1), F.least(F.floor(safe_div(F.col(column) - F.col("lo"), width)) + 1,
                                     F.lit(bins)))
    return (v.withColumn("bin", F.coalesce(b, F.lit(1)).cast("int")).withColumn("_w", width)
            .groupBy("bin").agg(F.first(F.col("lo") + (F.col("bin") - 1) * F.col("_w")).alias("left"),
                                F.count("*").alias("draws")))


def price_windows(panel: DataFrame, prices: DataFrame, months: int = 36, least: int = 126,
                  ks: tuple[int, ...] = (20, 30)) -> DataFrame:
    """Per score year: what the estimation window and the holding year can support."""
    from pitscreen.functions.dates import holding_end
    from pitscreen.operators import paths as P

    names = panel.select((F.col("score_year") + 1).alias(YEAR), "ticker").distinct()
    windows = F.explode(P.formations_covering(F.col("date"), months)).alias(YEAR)
    # every date of the exported prices is a session; the first of a window has no return
    days = P.calendar(prices).select("date", windows).withColumn(
        "s", F.row_number().over(W.partitionBy(YEAR).orderBy("date")))
    size = days.groupBy(YEAR).agg((F.max("s") - 1).cast("bigint").alias("window_sessions"))
    # a name's first date is found before anything is joined, so a bar is never shuffled
    first = (prices.select("ticker", "date", windows).groupBy(YEAR, "ticker").agg(F.min("date").alias("date"))
             .join(F.broadcast(days), [YEAR, "date"]).select(YEAR, "ticker", F.col("s").alias("f")))
    t = (names.join(first, [YEAR, "ticker"], "left").join(F.broadcast(size), YEAR)
         .withColumn("need", F.greatest(F.lit(least), F.floor(F.col("window_sessions") / 2)))
         .withColumn("have", F.coalesce(F.col("window_sessions") + 1 - F.col("f"), F.lit(0)))
         .withColumn("ok", F.col("have") >= F.col("need")))
    out = t.groupBy(YEAR).agg(
        F.count("*").alias("universe"), F.first("window_sessions").alias("window_sessions"),
        F.first("need").alias("min_required"), F.count_if("ok").alias("eligible"),
        (F.first("window_sessions") + 1 - F.max(F.when(F.col("ok"), F.col("f")))).alias("usable_obs"))
    held = (P.calendar(prices).groupBy(P.holding_formation(F.col("date")).alias(YEAR))
            .agg(F.count("*").alias("holding_sessions")))
    end = prices.agg(F.max("date").alias("_end"))
    q = {"q_universe": F.round(F.col("eligible") / F.col("usable_obs"), 2)}
    q |= {f"q_k{k}": F.round(F.lit(k) / F.col("usable_obs"), 3) for k in ks}
    return (beside(out.join(held, YEAR, "left").na.fill(0, ["holding_sessions"]), end)
            .withColumn("dropped_no_price", F.col("universe") - F.col("eligible"))
            .withColumn("holding_complete", F.col("_end") >= holding_end(F.col(YEAR)))
            .withColumns(q).drop("_end"))
