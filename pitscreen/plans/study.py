"""The multi-year study of one market, every formation in one plan."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, lru_cache

from pyspark.sql import DataFrame, functions as F

from pitscreen.functions.dates import between_formations
from pitscreen.operators import baskets as B, evaluate as E, paths as P, universe as U
from pitscreen.operators.paths import YEAR
from pitscreen.operators.scoring import nine_signals
from pitscreen.operators.tiles import tiled_returns
from pitscreen.operators.weights import equal_weight, long_short, optimised_weights
from pitscreen.session import land
from pitscreen.sources.layout import lay_out
from pitscreen.sources.markets import allows_shorting

OPTIMISED = ("GMV", "GMVsec")


@dataclass(frozen=True)
class StudySpec:
    market: str = "us"
    first_year: int = 2012
    last_year: int = 2024
    k: int = 30
    universe_size: int = 150
    value_quantile: float = 0.4
    n_draws: int = 1000
    n_optimised: int | None = None  # draws that are optimised; all of them unless limited
    lag_months: int = 5
    min_days: int = 200
    seed: int = 42
    cov_months: int = 36
    delisting_return: float = 0.0


class Study:
    """Tables of one study, each built when first asked for.

    Universe, scores, baskets, growth steps and estimation series concern at most
    ``universe_size`` names a year. They are read many times and therefore written once;
    prices are scanned once per table built from them.
    """

    def __init__(self, spec: StudySpec, fundamentals: DataFrame, prices: DataFrame,
                 sectors: DataFrame, membership: DataFrame | None = None,
                 scores: DataFrame | None = None):
        self.spec, self.fundamentals, self.prices = spec, fundamentals, prices
        self.sectors, self.membership, self.scores = sectors, membership, scores

    def _years(self, df: DataFrame) -> DataFrame:
        return df.where(F.col(YEAR).between(self.spec.first_year, self.spec.last_year))

    def _bars(self, months_before: int, months_after: int, slack_days: int = 0) -> DataFrame:
        return between_formations(self.prices, self.spec.first_year, self.spec.last_year,
                                  months_before, months_after, slack_days)

    @cached_property
    def held_bars(self) -> DataFrame:
        return self._bars(0, 12, P.BASE_DAYS)

    @cached_property
    def snapshot(self) -> DataFrame:
        rows = self._years(U.point_in_time(self.fundamentals, self.spec.lag_months,
                                           need_prior=self.scores is None))
        if self.scores is None:
            return rows
        # a name that cannot be ranked may not take a place in the top-n universe
        ranked = self.scores.select("ticker", (F.col("score_year") + 1).alias(YEAR)).distinct()
        return rows.join(ranked, ["ticker", YEAR], "left_semi")

    @cached_property
    def universe(self) -> DataFrame:
        return land(U.build_universe(self._bars(12, 0), self.snapshot, self.spec.universe_size,
                                     self.spec.min_days, self.membership), "universe")

    @cached_property
    def value_set(self) -> DataFrame:
        return U.high_bm_subset(self.universe, self.spec.value_quantile)

    @cached_property
    def scored(self) -> DataFrame:
        score = self.scores if self.scores is not None else nine_signals(self.fundamentals)
        own = score.drop("bm", "market_cap", "adv", "sector", "fiscal_year")
        names = self.value_set.select(YEAR, "ticker", "bm", "market_cap", "adv")
        return land(own.withColumn(YEAR, F.col("score_year") + 1).join(names, [YEAR, "ticker"]),
                    "scored")

    @cached_property
    def sizes(self) -> DataFrame:
        """Effective basket size per formation: k, or fewer where fewer names are scored."""
        return self.scored.groupBy(YEAR).agg(
            F.least(F.lit(self.spec.k), F.count("*").cast("int")).alias("k_eff"))

    @cached_property
    def baskets(self) -> dict[str, DataFrame]:
        s = self.spec
        cut = lambda df: B.limit_to(df, self.sizes)
        score = B.score_basket(self.scored, s.k, s.seed)
        return {
            "score": score,
            "score_short": B.score_basket(self.scored, s.k, s.seed, lowest=True),
            "value": cut(B.top_by(self.value_set, "bm", s.k)),
            "mktcap": cut(B.top_by(self.value_set, "market_cap", s.k)),
            "liquidity": cut(B.liquidity_matched(self.value_set, score, s.k, s.seed)),
        }

    @cached_property
    def series(self) -> DataFrame:
        return land(P.estimation_series(
            self._bars(self.spec.cov_months, 0, P.BASE_DAYS), self.value_set, self.spec.cov_months),
                    "series")

    def _equal(self, basket: str, book: str) -> DataFrame:
        members = self.baskets[basket].select(YEAR, "ticker")
        return equal_weight(members, [YEAR]).withColumn("book", F.lit(book))

    @cached_property
    def equal_positions(self) -> DataFrame:
        """Books that need no optimiser."""
        out = self._equal("score", "score_EW")
        for name in ("value", "mktcap", "liquidity"):
            out = out.unionByName(self._equal(name, f"{name}_EW"))
        if allows_shorting(self.spec.market):
            out = out.unionByName(long_short(
                self.baskets["score"].select(YEAR, "ticker"),
                self.baskets["score_short"].select(YEAR, "ticker")))
        return land(out.select(YEAR, "book", "ticker", "w"), "positions")

    @lru_cache  # noqa: B019 - one study object per run
    def optimised_positions(self, how: str) -> DataFrame:
        book = self.baskets["score"].select(YEAR, F.lit(f"score_{how}").alias("book"), "ticker")
        return land(optimised_weights(book, self.series, how, self.sectors), how)

    @cached_property
    def positions(self) -> DataFrame:
        out = self.equal_positions
        for how in OPTIMISED:
            out = out.unionByName(self.optimised_positions(how))
        return out

    @cached_property
    def draws(self) -> DataFrame:
        s = self.spec
        return land(B.random_baskets(self.value_set, s.k, s.n_draws, s.seed, "study",
                                     self.sizes), "draws")

    def draw_positions(self, how: str = "EW") -> DataFrame:
        """(formation_year, book = draw, ticker, w) of the random baskets."""
        d = self.draws.withColumnRenamed("draw", "book")
        if how == "EW":
            return equal_weight(d, [YEAR, "book"])
        return optimised_weights(B.limited(d, self.spec.n_optimised), self.series, how, self.sectors)

    @cached_property
    def steps(self) -> DataFrame:
        return land(P.growth_steps(self.held_bars, self.value_set, self.spec.delisting_return),
                    "steps")

    @cached_property
    def sessions(self) -> DataFrame:
        return land(P.holding_sessions(self.held_bars), "sessions")

    def returns_of(self, positions: DataFrame) -> DataFrame:
        return P.book_returns(P.book_values(positions, self.steps, self.sessions))

    @cached_property
    def daily(self) -> DataFrame:
        return self.returns_of(self.positions)

    @cached_property
    def equal_daily(self) -> DataFrame:
        return self.returns_of(self.equal_positions)

    @cached_property
    def laid_out_daily(self) -> DataFrame:
        """``equal_daily`` from bars and positions laid out by (formation_year, ticker): only sums by day are shuffled."""
        keys, s = [YEAR, "ticker"], self.spec
        bars = lay_out(P.bars_by_formation(self.prices), "bars", keys, ("date",), folder_by=YEAR)
        held = lay_out(self.equal_positions, "held", keys, buckets=bars.buckets).read()
        names = held.select(YEAR, "ticker").distinct()
        steps = P.growth_steps(bars.read(s.first_year, s.last_year), names, s.delisting_return)
        return P.book_returns(P.book_values(held, steps, self.sessions))

    def draw_daily(self, how: str = "EW") -> DataFrame:
        return tiled_returns(self.draw_positions(how), self.steps, self.sessions)

    def summary(self, equal_only: bool = False) -> DataFrame:
        pos = self.equal_positions if equal_only else self.positions
        return E.summary(self.equal_daily if equal_only else self.daily, pos,
                         P.end_weights(pos, self.steps))

    def placement(self, book: str = "score_EW", how: str = "EW") -> DataFrame:
        names = ["ann_return", "sharpe", "max_drawdown"]
        pos = self.equal_positions if how == "EW" else self.optimised_positions(how)
        own = E.metrics(self.returns_of(pos.where(F.col("book") == book)), ["book"])
        rand = E.metrics(self.draw_daily(how), ["book"]).withColumnRenamed("book", "draw")
        return E.place(
            E.long_metrics(own.select("book", *names), names, "stat"),
            E.long_metrics(rand.select("draw", *names), names, "draw_stat"), ["metric"])

    def synergy(self, how: str = "GMV") -> DataFrame:
        """Optimisation gain of the score basket placed among paired gains of random ones."""
        m = lambda p: E.metrics(self.returns_of(p), ["book"])
        equal = self.equal_positions.where(F.col("book") == "score_EW")
        tag = lambda df: df.withColumn("book", F.lit("score"))
        own = E.paired_gain(m(tag(self.optimised_positions(how))), m(tag(equal)), ["book"])
        first = B.limited(self.draw_positions("EW"), self.spec.n_optimised)
        rand = E.paired_gain(m(self.draw_positions(how)), m(first), ["book"])
        key = lambda df: df.withColumn("construction", F.lit(how)).drop("book")
        return E.place(key(own).withColumnRenamed("gain", "D_score"),
                       key(rand).withColumnRenamed("gain", "D"),
                       ["construction"], "D_score", "D")

    def turnover_table(self, equal_only: bool = False) -> DataFrame:
        pos = self.equal_positions if equal_only else self.positions
        return E.rebalance_turnover(pos, P.end_weights(pos, self.steps))

    def diagnostics(self) -> DataFrame:
        """Counts per formation; every part has one row a year."""
        y = lambda df, *aggs: df.groupBy(YEAR).agg(*aggs)
        basket = self.baskets["score"]
        shorts = (self.equal_positions.where((F.col("book") == "score_LS") & (F.col("w") < 0)))
        parts = [
            y(self.universe, F.count("*").alias("universe")),
            y(self.value_set, F.count("*").alias("value_set")),
            y(self.scored, F.count("*").alias("scored"), F.avg("fscore").alias("fscore_mean")),
            B.tie_break_slots(self.scored, self.sizes),
            y(self.series, F.median("n_returns").cast("int").alias("cov_est_days")),
            P.stopped_names(self.held_bars, self.value_set.select(YEAR, "ticker")),
            y(basket, F.count("*").alias("k"), F.min("fscore").alias("fscore_basket_min")),
            y(shorts, F.count("*").alias("short_leg_names")),
        ]
        out = parts[0]
        for p in parts[1:]:
            out = out.join(p, YEAR, "left")
        return (out.withColumn("long_short_run", F.coalesce(F.col("short_leg_names") > 0, F.lit(False)))
                .na.fill(0, ["short_leg_names"]))
