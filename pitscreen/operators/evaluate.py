"""Performance, placement among random baskets, turnover and cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from pitscreen.functions.numeric import safe_div
from pitscreen.operators.ordering import beside
from pitscreen.operators.paths import YEAR

# Fixed values of the study.
TRADING_DAYS = 252
ALPHA = 0.05
COST_PER_SIDE = 0.0020
SHORT_BORROW_ANNUAL = 0.01


def metrics(daily: DataFrame, by: list[str], rf_annual: float = 0.0) -> DataFrame:
    """Compound and annual return, volatility, ratio and drawdown per series.

    A series has one row per session, so its window is bounded by the calendar; the
    aggregate reuses the window's partitioning.
    """
    run = W.partitionBy(*by).orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    nav = daily.withColumn("nav", F.product(1 + F.col("r")).over(run))
    deep = nav.withColumn("dd", F.col("nav") / F.max("nav").over(run) - 1)
    base = deep.groupBy(*by).agg(
        F.count("r").alias("n_days"), (F.product(1 + F.col("r")) - 1).alias("cum_return"),
        (F.stddev_samp("r") * F.sqrt(F.lit(float(TRADING_DAYS)))).alias("ann_vol"),
        F.min("dd").alias("max_drawdown"))
    ann = F.pow(1 + F.col("cum_return"), F.lit(float(TRADING_DAYS)) / F.col("n_days")) - 1
    return (base.withColumn("ann_return", ann)
            .withColumn("sharpe", F.when(F.col("ann_vol") > 0,
                                         (F.col("ann_return") - rf_annual) / F.col("ann_vol"))))


def nav(daily: DataFrame, by: list[str]) -> DataFrame:
    """Growth of one unit per series; a missing return counts as zero."""
    run = W.partitionBy(*by).orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    return daily.withColumn("nav", F.product(1 + F.coalesce("r", F.lit(0.0))).over(run))


def calendar_year_returns(daily: DataFrame, by: list[str], year: Column | None = None) -> DataFrame:
    """Compound return per calendar year, or per ``year`` expression if given."""
    y = (F.year("date") if year is None else year).alias("year")
    return daily.groupBy(*by, y).agg(
        (F.product(1 + F.coalesce("r", F.lit(0.0))) - 1).alias("ret"))


def place(stats: DataFrame, random: DataFrame, on: list[str], stat: str = "stat",
          draw_stat: str = "draw_stat", higher_is_better: bool = True,
          corrected: bool = False) -> DataFrame:
    """Each statistic inside its random distribution, matched on ``on``.

    Percentile counts strictly worse draws, p counts draws at least as good; ``corrected``
    adds one to both sides of p. ``stats`` holds a few rows per key and is shipped to the
    draws, which are aggregated where they are.
    """
    s, d = F.col(stat), F.col(draw_stat)
    worse, as_good = (d < s, d >= s) if higher_is_better else (d > s, d <= s)
    out = (random.where(d.isNotNull() & ~F.isnan(d)).join(F.broadcast(stats), on)
           .groupBy(*stats.columns)
           .agg(F.avg(F.when(worse, 1.0).otherwise(0.0)).alias("percentile"),
                F.count_if(as_good).alias("_ge"), F.count("*").alias("n_draws"),
                F.avg(draw_stat).alias("random_mean"),
                F.stddev_pop(draw_stat).alias("random_std"),
                F.stddev_samp(draw_stat).alias("random_std_sample")))
    add = 1 if corrected else 0
    return (out.withColumn("p_value", (F.col("_ge") + add) / (F.col("n_draws") + add))
            .withColumn("significant", F.col("p_value") < ALPHA).drop("_ge"))


def long_metrics(m: DataFrame, names: list[str], value: str) -> DataFrame:
    """One row per (series, metric)."""
    keep = [c for c in m.columns if c not in names]
    cells = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("v")) for n in names])
    return (m.select(*keep, F.explode(cells).alias("_c"))
            .select(*keep, "_c.metric", F.col("_c.v").alias(value)))


def paired_gain(optimised: DataFrame, equal: DataFrame, by: list[str]) -> DataFrame:
    """Sharpe(optimised) - Sharpe(equal weight) basket by basket."""
    a = optimised.select(*by, F.col("sharpe").alias("_o"))
    b = equal.select(*by, F.col("sharpe").alias("_e"))
    return (a.join(b, by).select(*by, (F.col("_o") - F.col("_e")).alias("gain"))
            .where(F.col("gain").isNotNull()))


def turnover(before: DataFrame, after: DataFrame, by: list[str]) -> DataFrame:
    """Half the absolute weight change over the union of names.

    Both books are stacked and netted per name, so nothing is joined.
    """
    stack = (after.select(*by, "ticker", F.col("w"))
             .unionByName(before.select(*by, "ticker", (-F.col("w")).alias("w"))))
    return (stack.groupBy(*by, "ticker").agg(F.abs(F.sum("w")).alias("d"))
            .groupBy(*by).agg((F.sum("d") / 2).alias("turnover")))


def rebalance_turnover(target: DataFrame, drifted: DataFrame) -> DataFrame:
    """Per (formation_year, book): drifted old book against the new target.

    Only years whose previous formation held the same book.
    """
    before = drifted.withColumn(YEAR, F.col(YEAR) + 1)
    both = (target.select(YEAR, "book").distinct()
            .join(before.select(YEAR, "book").distinct(), [YEAR, "book"]))
    t = turnover(before, target, [YEAR, "book"])
    return t.join(both, [YEAR, "book"])


def random_turnover(draws: DataFrame) -> DataFrame:
    """Per draw and year, of all draws: share of names replaced since the previous formation."""
    size = draws.groupBy(YEAR, "draw").agg(F.count("*").alias("k"))
    prev = draws.select((F.col(YEAR) + 1).alias(YEAR), "draw", "ticker")
    same = (draws.join(prev, [YEAR, "draw", "ticker"], "left_semi")
            .groupBy(YEAR, "draw").agg(F.count("*").alias("same")))
    held = size.select((F.col(YEAR) + 1).alias(YEAR), "draw", F.col("k").alias("prev_k"))
    return (size.join(held, [YEAR, "draw"]).join(same, [YEAR, "draw"], "left")
            .select(YEAR, "draw",
                    (1 - F.coalesce("same", F.lit(0)) / F.col("prev_k")).alias("turnover")))


def effective_n(positions: DataFrame) -> DataFrame:
    """Per (formation_year, book): 1 / sum of squared weights, normalised by gross size."""
    a = F.abs("w")
    return (positions.groupBy(YEAR, "book")
            .agg((F.pow(F.sum(a), 2) / F.sum(a * a)).alias("effective_n"),
                 F.count("*").alias("names"), F.max(a).alias("max_weight"),
                 F.count_if(a > 1e-9).alias("non_zero_names"),
                 F.coalesce(F.sum(F.when(F.col("w") < 0, -F.col("w"))), F.lit(0.0))
                 .alias("short_notional")))


def cost_drag(turnover_mean: Column, short_notional: Column | None = None,
              cost_per_side: float = COST_PER_SIDE) -> Column:
    drag = 2 * turnover_mean * F.lit(cost_per_side)
    return drag if short_notional is None else drag + F.lit(SHORT_BORROW_ANNUAL) * short_notional


def summary(daily: DataFrame, positions: DataFrame, drifted: DataFrame,
            rf_annual: float = 0.0, cost_per_side: float = COST_PER_SIDE,
            empty_first: float | None = None) -> DataFrame:
    """Gross performance, concentration, turnover and net figures per book.

    ``nominal_k`` is a book's size at the first formation of all; ``empty_first`` is what it is for a
    book that held nothing then.
    """
    m = metrics(daily.where(F.col("r").isNotNull()), ["book"], rf_annual)
    conc = effective_n(positions)
    conc = beside(conc, conc.agg(F.min(YEAR).alias("_first")))
    size = (conc.groupBy("book")
            .agg(F.coalesce(F.max(F.when(F.col(YEAR) == F.col("_first"), F.col("names"))).cast("double"),
                            F.lit(empty_first).cast("double")).alias("nominal_k"),
                 F.min("names").cast("double").alias("min_k"),
                 F.avg("names").alias("mean_k"), F.max("names").cast("double").alias("max_k"),
                 F.avg("effective_n").alias("effective_n"),
                 F.avg("short_notional").alias("_short")))
    trade = rebalance_turnover(positions, drifted).groupBy("book").agg(
        F.avg("turnover").alias("turnover"))
    t = (m.join(size, "book", "left").join(trade, "book", "left")
         .na.fill(0.0, ["turnover", "_short"]))
    net = F.col("ann_return") - F.col("cost_drag")
    return (t.withColumn("cost_drag", cost_drag(F.col("turnover"), F.col("_short"), cost_per_side))
            .withColumn("net_ann_return", net)
            .withColumn("net_sharpe", F.when(
                F.col("ann_vol") != 0, safe_div(net - rf_annual, F.col("ann_vol"))))
            .drop("_short"))
