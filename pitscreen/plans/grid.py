"""The broad-universe study: every scoreable name, a sweep over basket size and draws."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property, lru_cache

from pyspark.sql import DataFrame, functions as F

from pitscreen.functions.dates import between_formations
from pitscreen.operators import baskets as B, evaluate as E, paths as P
from pitscreen.operators.ordering import beside, exact_quantiles
from pitscreen.operators.paths import YEAR
from pitscreen.operators.tiles import tiled_returns
from pitscreen.operators.universe_variance import universe_minimum_variance
from pitscreen.operators.weights import equal_weight, long_short, optimised_weights
from pitscreen.session import land
from pitscreen.sources.markets import allows_shorting

# Fixed value: smallest number of returns a name needs, whatever the window holds.
LEAST_EST_DAYS = 126


@dataclass(frozen=True)
class GridSpec:
    market: str = "us"
    first_year: int = 2012
    last_year: int = 2024
    k: int = 30
    n_draws: int = 1000
    n_optimised: int | None = None  # draws that are optimised; all of them unless limited
    seed: int = 42
    cov_months: int = 36
    min_est_days: int | None = None
    delisting_return: float = 0.0


class Market:
    """What every cell of the sweep shares: windows, eligible names, growth steps.

    Nothing here depends on k, the number of draws or the seed.
    """

    def __init__(self, panel: DataFrame, prices: DataFrame, sectors: DataFrame, spec: GridSpec):
        self.scored = (panel.withColumn(YEAR, F.col("score_year") + 1)
                       .where(F.col(YEAR).between(spec.first_year, spec.last_year)))
        self.sectors, self.spec = sectors, spec
        span = (spec.first_year, spec.last_year)
        self.past_bars = between_formations(prices, *span, spec.cov_months, 0, P.BASE_DAYS)
        self.held_bars = between_formations(prices, *span, 0, 12, P.BASE_DAYS)

    @cached_property
    def panel(self) -> DataFrame:
        return land(self.scored, "grid-panel")

    @cached_property
    def all_series(self) -> DataFrame:
        return land(P.estimation_series(self.past_bars, self.panel, self.spec.cov_months), "all-series")

    @cached_property
    def series(self) -> DataFrame:
        """Estimation series of the eligible names: enough returns before formation."""
        return self.all_series.where(F.col("n_returns") >= self.needed())

    def needed(self):
        if self.spec.min_est_days is not None:
            return F.lit(self.spec.min_est_days)
        return F.greatest(F.lit(LEAST_EST_DAYS), F.floor(F.col("sessions") / 2))

    @cached_property
    def eligible(self) -> DataFrame:
        names = self.series.select(YEAR, "ticker")
        return land(self.panel.join(names, [YEAR, "ticker"], "left_semi"), "eligible")

    @cached_property
    def sizes(self) -> DataFrame:
        return self.eligible.groupBy(YEAR).agg(F.count("*").alias("size"))

    @cached_property
    def steps(self) -> DataFrame:
        return land(P.growth_steps(self.held_bars, self.eligible, self.spec.delisting_return), "grid-steps")

    @cached_property
    def sessions(self) -> DataFrame:
        return land(P.holding_sessions(self.held_bars), "sessions")

    @cached_property
    def universe_positions(self) -> DataFrame:
        members = self.eligible.select(YEAR, "ticker")
        equal = equal_weight(members, [YEAR]).withColumn("book", F.lit("universe_EW"))
        return equal.select(YEAR, "book", "ticker", "w")

    @cached_property
    def universe_gmv(self) -> DataFrame:
        return land(universe_minimum_variance(self.series), "universe-gmv")

    @cached_property
    def universe_daily(self) -> DataFrame:
        """The equal-weight universe meets its steps once, whatever the cells."""
        return land(self.returns_of(self.universe_positions, ["universe_EW"]), "universe-daily")

    @cached_property
    def universe_gmv_daily(self) -> DataFrame:
        return land(self.returns_of(self.universe_gmv, ["universe_GMV"]), "universe-gmv-daily")

    @cached_property
    def growth(self) -> DataFrame:
        """(formation_year, ticker, growth): growth of one unit by the end of the holding year."""
        return land(P.growth_at_end(self.steps), "grid-growth")

    def returns_of(self, positions: DataFrame, books: list[str] | None = None) -> DataFrame:
        """Daily returns; a listed book that holds nothing in a year earns zero that year."""
        daily = P.book_returns(P.book_values(positions, self.steps, self.sessions))
        if not books:
            return daily
        every = self.sizes.select(YEAR, F.explode(F.array(*[F.lit(b) for b in books])).alias("book"))
        idle = every.join(positions.select(YEAR, "book").distinct(), [YEAR, "book"], "left_anti")
        flat = (idle.join(F.broadcast(self.sessions.select(YEAR, "date")), YEAR)
                .select(YEAR, "book", "date", F.lit(0.0).alias("r")))
        return daily.unionByName(flat)


class Cell:
    """One (k, seed) cell; its draws nest, so smaller experiments are prefixes."""

    def __init__(self, market: Market, spec: GridSpec):
        self.m, self.spec = market, spec

    @cached_property
    def baskets(self) -> dict[str, DataFrame]:
        s, e = self.spec, self.m.eligible
        ranked_value = B.top_by(e, "bm", s.k).select(YEAR, "ticker")
        with_bm = e.groupBy(YEAR).agg(F.count("bm").alias("n"))
        short = with_bm.where(F.col("n") < max(5, s.k // 4)).select(YEAR)
        # too few names with a ratio: the value control is the universe itself
        fallback = e.select(YEAR, "ticker").join(F.broadcast(short), YEAR, "left_semi")
        value = ranked_value.join(F.broadcast(short), YEAR, "left_anti").unionByName(fallback)
        return {
            "score": B.score_basket(e, s.k, s.seed),
            "score_short": B.score_basket(e, s.k, s.seed, lowest=True),
            "score_high": B.threshold_basket(e, 8),
            "value": value,
        }

    @cached_property
    def basket_positions(self) -> DataFrame:
        """Equal-weight books, the spread book and the optimised score basket."""
        out = None
        for name in ("score", "score_high", "value"):
            p = equal_weight(self.baskets[name].select(YEAR, "ticker"), [YEAR]).withColumn(
                "book", F.lit(f"{name}_EW")).select(YEAR, "book", "ticker", "w")
            out = p if out is None else out.unionByName(p)
        if allows_shorting(self.spec.market):
            out = out.unionByName(long_short(
                self.baskets["score"].select(YEAR, "ticker"),
                self.baskets["score_short"].select(YEAR, "ticker")).select(YEAR, "book", "ticker", "w"))
        return land(out, "cell-positions")

    @lru_cache  # noqa: B019 - one cell per run
    def optimised_positions(self, how: str) -> DataFrame:
        book = self.baskets["score"].select(YEAR, F.lit(f"score_{how}").alias("book"), "ticker")
        return land(optimised_weights(book, self.m.series, how, self.m.sectors), how)

    def positions(self, optimised: bool = True) -> DataFrame:
        out = self.basket_positions.unionByName(self.m.universe_positions)
        if optimised:
            out = (out.unionByName(self.optimised_positions("GMV"))
                   .unionByName(self.optimised_positions("GMVsec"))
                   .unionByName(self.m.universe_gmv))
        return out

    def books(self, optimised: bool = True) -> list[str]:
        out = ["score_EW", "score_high_EW", "value_EW", "universe_EW"]
        if allows_shorting(self.spec.market):
            out.append("score_LS")
        return out + (["score_GMV", "score_GMVsec", "universe_GMV"] if optimised else [])

    @cached_property
    def basket_daily(self) -> DataFrame:
        own = [b for b in self.books(False) if b != "universe_EW"]
        return land(self.m.returns_of(self.basket_positions, own), "basket-daily")

    @cached_property
    def optimised_daily(self) -> DataFrame:
        both = self.optimised_positions("GMV").unionByName(self.optimised_positions("GMVsec"))
        return land(self.m.returns_of(both, ["score_GMV", "score_GMVsec"]), "optimised-daily")

    def daily(self, optimised: bool = True) -> DataFrame:
        """Daily returns of all books, a row a book and session."""
        out = self.basket_daily.unionByName(self.m.universe_daily)
        return out.unionByName(self.optimised_daily).unionByName(self.m.universe_gmv_daily) if optimised else out

    @cached_property
    def draws(self) -> DataFrame:
        s = self.spec
        return land(B.random_baskets(self.m.eligible, s.k, s.n_draws, s.seed, "grid"), "grid-draws")

    @cached_property
    def draws_excluding(self) -> DataFrame:
        """Random baskets from names the score did not pick; years too small give none."""
        s = self.spec
        pool = self.m.eligible.select(YEAR, "ticker").join(
            self.baskets["score"].select(YEAR, "ticker"), [YEAR, "ticker"], "left_anti")
        full = pool.groupBy(YEAR).agg(F.count("*").alias("_n")).where(F.col("_n") >= s.k).select(YEAR)
        pool = pool.join(F.broadcast(full), YEAR, "left_semi")
        return land(B.random_baskets(pool, s.k, s.n_draws, s.seed, "others"), "other-draws")

    def draw_positions(self, draws: DataFrame, how: str = "EW") -> DataFrame:
        d = draws.withColumnRenamed("draw", "book")
        if how == "EW":
            return equal_weight(d, [YEAR, "book"])
        return optimised_weights(B.limited(d, self.spec.n_optimised), self.m.series, how)

    @cached_property
    def draw_metrics(self) -> DataFrame:
        daily = tiled_returns(self.draw_positions(self.draws), self.m.steps, self.m.sessions)
        return land(E.metrics(daily, ["book"]), "draw-metrics")

    def metrics(self, optimised: bool = False) -> DataFrame:
        return E.metrics(self.daily(optimised), ["book"])

    def summary(self, optimised: bool = True) -> DataFrame:
        pos = self.positions(optimised)
        return E.summary(self.daily(optimised), pos, P.drifted(pos, self.m.growth), empty_first=0.0)

    def yearly_returns(self, optimised: bool = True) -> DataFrame:
        return E.calendar_year_returns(self.daily(optimised), ["book"])

    def draw_cost(self) -> DataFrame:
        """One row: mean turnover of the random control and its yearly cost."""
        t = E.random_turnover(self.draws).agg(F.coalesce(F.avg("turnover"), F.lit(0.0)).alias("mc_turnover"))
        return t.withColumn("mc_cost_drag", E.cost_drag(F.col("mc_turnover")))

    def placement(self, book: str = "score_EW", first: int | None = None) -> DataFrame:
        """The book against both random pools, gross and net, return and ratio.

        ``first`` limits the draws: cells of the sweep that differ only in the number of
        draws read prefixes of the same baskets.
        """
        n = first or self.spec.n_draws
        s = self.summary(optimised=book not in ("score_EW", "score_high_EW", "value_EW", "universe_EW"))
        own = s.where(F.col("book") == book)
        gross = ["ann_return", "sharpe"]
        stats = own.select(F.explode(F.array(*[
            F.struct(F.lit(m).alias("metric"), F.lit(b).alias("basis"), v.alias("stat"))
            for m, b, v in [("ann_return", "gross", F.col("ann_return")), ("sharpe", "gross", F.col("sharpe")),
                            ("ann_return", "net", F.col("net_ann_return")),
                            ("sharpe", "net", F.col("net_sharpe"))]])).alias("x")).select("x.*")
        cost = self.draw_cost().select("mc_cost_drag")

        def dist(m: DataFrame, pool: str) -> DataFrame:
            net = beside(m, cost)
            after = F.col("ann_return") - F.col("mc_cost_drag")
            cells = [("ann_return", "gross", F.col("ann_return")), ("sharpe", "gross", F.col("sharpe")),
                     ("ann_return", "net", after),
                     ("sharpe", "net", F.when(F.col("ann_vol") != 0, after / F.col("ann_vol")))]
            return (net.where(F.col("book") < n).select(F.lit(pool).alias("pool"), F.explode(F.array(*[
                F.struct(F.lit(a).alias("metric"), F.lit(b).alias("basis"), v.alias("draw_stat"))
                for a, b, v in cells])).alias("x")).select("pool", "x.*"))

        others = E.metrics(tiled_returns(self.draw_positions(self.draws_excluding), self.m.steps, self.m.sessions), ["book"])
        both = dist(self.draw_metrics, "random (full universe)").unionByName(
            dist(others, "random (other names)"))
        keyed = stats.withColumn("pool", F.explode(F.array(
            F.lit("random (full universe)"), F.lit("random (other names)"))))
        return E.place(keyed, both, ["pool", "metric", "basis"])

    def synergy(self) -> DataFrame:
        m = lambda p: E.metrics(self.m.returns_of(p), ["book"])
        tag = lambda df: df.withColumn("book", F.lit("score"))
        equal = self.basket_positions.where(F.col("book") == "score_EW")
        own = E.paired_gain(m(tag(self.optimised_positions("GMV"))), m(tag(equal)), ["book"])
        first = B.limited(self.draw_metrics, self.spec.n_optimised)
        rand = E.paired_gain(m(self.draw_positions(self.draws, "GMV")), first, ["book"])
        key = lambda df: df.withColumn("construction", F.lit("GMV")).drop("book")
        return E.place(key(own).withColumnRenamed("gain", "D_score"),
                       key(rand).withColumnRenamed("gain", "D"), ["construction"], "D_score", "D")

    def diagnostics(self) -> DataFrame:
        """Counts per formation; every joined part has one row a year."""
        e, b, k = self.m.eligible, self.baskets, self.spec.k
        y = lambda df, *aggs: df.groupBy(YEAR).agg(*aggs)
        picked = b["score"].select(YEAR, "ticker")
        shared = (self.draws.join(picked, [YEAR, "ticker"], "left_semi").groupBy(YEAR)
                  .agg(F.count("*").alias("_hit")))
        drawn = y(self.draws, F.count("*").alias("_drawn"))
        last = land(P.last_bars(self.m.held_bars, self.m.panel), "last-bars")  # eligible names are names of the panel
        quiet = e.select(YEAR, "ticker").join(last, [YEAR, "ticker"], "left_anti")
        parts = [
            y(self.m.panel, F.count("*").alias("panel_names")),
            y(b["score"], F.min("fscore").alias("score_basket_min")),
            y(b["score_high"], F.count("*").alias("n_score_high")),
            y(b["value"], F.count("*").alias("value_basket_size")),
            y(b["score_short"], F.max("fscore").alias("short_leg_max")),
            B.tie_break_slots(e, k), shared, drawn,
            exact_quantiles(self.m.series, [YEAR], "n_returns", {"cov_est_days": 0.5}),
            y(self.m.series, F.max(self.m.needed()).cast("int").alias("cov_min_est_days")),
            P.stopped_names(self.m.held_bars, self.m.panel, last),
            y(quiet, F.count("*").alias("no_price_after_formation")),
            y(self.basket_positions.where((F.col("book") == "score_LS") & (F.col("w") < 0)),
              F.count("*").alias("short_leg_names")),
        ]
        out = y(e, F.count("*").alias("universe"), F.count("bm").alias("bm_coverage"),
                F.avg("fscore").alias("fscore_mean"))
        for p in parts:
            out = out.join(p, YEAR, "left")
        return (out.na.fill(0, ["n_score_high", "no_price_after_formation", "short_leg_names", "_hit"])
                .withColumn("dropped_no_price", F.col("panel_names") - F.col("universe"))
                .withColumn("value_fallback", F.col("bm_coverage") < max(5, k // 4))
                .withColumn("overlap_random", F.col("_hit") / F.col("_drawn"))
                .withColumn("overlap_expected", F.lit(k) / F.col("universe"))
                .withColumn("long_short_run", F.col("short_leg_names") > 0)
                .drop("panel_names", "_hit", "_drawn"))


def score_overlap(market: Market, first: DataFrame, second: DataFrame, k: int) -> DataFrame:
    """Share of k two books have in common, per formation."""
    return B.overlap(first, second, [YEAR]).withColumn("share", F.col("shared") / k)


def sweep(market: Market, spec: GridSpec, ks: list[int], draws: list[int]) -> DataFrame:
    """One row per (k, N): the consolidated grid.

    Each k draws its largest experiment once; every N reads a prefix of it. Windows,
    growth steps and the universe's weights are the market's and serve every cell.
    """
    rows = None
    for k in ks:
        cell = Cell(market, replace(spec, k=k, n_draws=max(draws)))
        s = cell.summary()
        pick = lambda book, col, out: F.max(F.when(F.col("book") == book, F.col(col))).alias(out)
        one = s.agg(pick("score_EW", "sharpe", "EW"), pick("universe_EW", "sharpe", "uniEW"),
                    pick("value_EW", "sharpe", "value"), pick("score_EW", "turnover", "to_EW"),
                    pick("score_GMV", "effective_n", "effN_GMV")).withColumn("k", F.lit(k))
        gain = cell.synergy().select(F.col("D_score").alias("D"), F.col("p_value").alias("D_p"),
                                     F.lit(k).alias("k"))
        own = cell.metrics().where(F.col("book") == "score_EW").select(
            F.col("sharpe").alias("stat"), F.explode(F.array(*[F.lit(n) for n in draws])).alias("N"))
        rand = (cell.draw_metrics.select("book", F.col("sharpe").alias("draw_stat"), F.explode(
            F.array(*[F.lit(n) for n in draws])).alias("N")).where(F.col("book") < F.col("N")))
        placed = E.place(own, rand, ["N"]).select(
            "N", F.col("percentile").alias("pct"), F.col("p_value").alias("p"),
            F.col("significant").alias("sig"), F.lit(k).alias("k"))
        cell_rows = placed.join(F.broadcast(one), "k").join(F.broadcast(gain), "k")
        rows = cell_rows if rows is None else rows.unionByName(cell_rows)
    return rows.withColumn("mkt", F.lit(spec.market))


def tie_break_sweep(market: Market, spec: GridSpec, seeds: list[int]) -> DataFrame:
    """Score-basket performance per tie-break seed, all seeds in one plan.

    The seed is a column: each seed's basket is a book of its own.
    """
    tried = market.eligible.select(YEAR, "ticker", "fscore", F.explode(
        F.array(*[F.lit(s) for s in seeds])).alias("seed"))
    basket = B.score_basket(tried, spec.k, F.col("seed"), by=(YEAR, "seed"))
    pos = equal_weight(basket.select(YEAR, F.col("seed").alias("book"), "ticker"), [YEAR, "book"])
    m = land(E.metrics(market.returns_of(pos), ["book"]).withColumnRenamed("book", "seed"), "seed-metrics")
    cell = Cell(market, spec)
    stats = m.select("seed", F.lit("sharpe").alias("metric"), F.col("sharpe").alias("stat"))
    rand = cell.draw_metrics.select(F.lit("sharpe").alias("metric"), F.col("sharpe").alias("draw_stat"))
    slots = B.tie_break_slots(market.eligible, spec.k).agg(
        F.round(F.avg("tie_break_slots"), 2).alias("mean_tie_break_slots"),
        F.count_if(F.col("tie_break_slots") >= spec.k).alias("years_fully_tie_broken"))
    placed = E.place(stats, rand, ["metric"]).select("seed", "percentile", "p_value", "significant")
    return beside(m.select("seed", "sharpe", "ann_return").join(placed, "seed"), slots)


def spread(df: DataFrame, columns: list[str]) -> DataFrame:
    """Min, median, max and standard deviation of each column over the runs (a few rows)."""
    cells = F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("v")) for c in columns])
    return (df.select(F.explode(cells).alias("c")).groupBy(F.col("c.measure").alias("measure"))
            .agg(F.min("c.v").alias("min"), F.median("c.v").alias("median"), F.max("c.v").alias("max"),
                 F.stddev_samp("c.v").alias("std")))
