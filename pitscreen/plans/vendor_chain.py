"""Vendor tables to the final panel: extract, check, value, score, screen, price, export."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, functions as F, Window as W

from pitscreen.functions.numeric import positive_or_null, safe_div
from pitscreen.operators import checks as V, shares as H, statement_scores as C, vendor_bars as N
from pitscreen.operators.ordering import beside
from pitscreen.session import land
from pitscreen.sources.line_items import panel_keys, wide
from pitscreen.sources.schemas import FLAGS

DIRECT = ["cfo", "cfi", "cff", "cash_begin", "cash_end", "net_cash_flow", "fx_effect"]

# Flag names of the panel in FLAGS order.
EXPORT_FLAGS = ["f_roa", "f_cfoa", "f_d_roa", "f_accrual", "f_d_lever", "f_d_liquid",
                "f_eq_offer", "f_d_margin", "f_d_turn"]

# Exclusion reasons, coarsest first.
REASONS = [
    "dropped_failed_accounting_checks",
    "dropped_no_prior_year",
    "dropped_incomplete_signals",
    "dropped_unresolved_identifier",
    "dropped_no_book_to_market",
    "dropped_no_june_turnover",
    "dropped_no_formation_price",
    "dropped_below_liquidity_gate",
]


def extract(long: DataFrame) -> DataFrame:
    """Wide panel of the needed lines: one scan of the long table and one shuffle."""
    return wide(long, panel_keys())


def fill_from_direct(panel: DataFrame) -> DataFrame:
    """Indirect cash-flow lines, completed from the direct statement."""
    return panel.withColumns({
        c: F.coalesce(c, f"{c}_direct") for c in DIRECT if f"{c}_direct" in panel.columns})


def zero_issuance(panel: DataFrame) -> DataFrame:
    """No issuance line and unchanged charter capital since the year before means zero."""
    y, w = F.col("period").cast("int"), W.partitionBy("symbol").orderBy("period")
    prev = F.when(y - F.lag(y).over(w) == 1, F.lag("paid_in_capital").over(w))
    p = (panel.withColumn("paid_in_capital_prev", prev)
         .withColumn("d_paid_in_capital", F.abs(F.col("paid_in_capital") - F.col("paid_in_capital_prev"))))
    return p.withColumn("stock_issuance_proceeds", F.when(
        (F.col("d_paid_in_capital") == 0) & F.col("stock_issuance_proceeds").isNull(), 0.0)
        .otherwise(F.col("stock_issuance_proceeds")))


def field_coverage(panel: DataFrame, by: str, cols: list[str]) -> DataFrame:
    """Share of non-missing values per column."""
    return panel.groupBy(by).agg(F.count("*").alias("names"), *[
        F.round(F.avg(F.col(c).isNotNull().cast("double")), 3).alias(c) for c in cols])


class VendorChain:
    """The stages in order; what several later stages read is written once."""

    def __init__(self, long: DataFrame, bars: DataFrame, summary: DataFrame, grid: DataFrame,
                 until: str = "2025-12-31", strict_checks: bool = True,
                 sectors: DataFrame | None = None, min_traded_pct: float = N.MIN_TRADED_PCT):
        self.long, self.bars, self.summary, self.grid = long, N.dated(bars), summary, grid
        self.until, self.strict, self.sectors = until, strict_checks, sectors
        self.min_traded_pct = min_traded_pct

    @cached_property
    def screen(self) -> DataFrame:
        return N.coverage_screen(self.grid, self.bars, self.until)

    @cached_property
    def extracted(self) -> DataFrame:
        p = zero_issuance(fill_from_direct(extract(self.long)))
        kept = self.screen.where("kept").select("symbol")
        return land(V.infer_currency_effect(p.join(kept, "symbol", "left_semi")), "extract")

    @cached_property
    def results(self) -> DataFrame:
        return V.run_checks(self.extracted)

    @cached_property
    def clean_keys(self) -> DataFrame:
        return self.results.where(V.clean(self.results, "hard", not self.strict)).select("symbol", "period")

    @cached_property
    def held_out(self) -> DataFrame:
        return self.results.where(~V.clean(self.results, "hard", not self.strict))

    @cached_property
    def panel(self) -> DataFrame:
        """Firm-years that passed the checks."""
        return land(self.extracted.join(self.clean_keys, ["symbol", "period"], "left_semi"), "clean")

    @cached_property
    def month_ends(self) -> DataFrame:
        return N.month_end_bars(self.bars)

    @cached_property
    def counts(self) -> DataFrame:
        return H.vendor_counts(self.summary)

    @cached_property
    def bm(self) -> DataFrame:
        return land(H.book_to_market_panel(
            self.panel, N.period_end_close(self.month_ends), self.counts), "bm")

    @cached_property
    def raw_scores(self) -> DataFrame:
        return C.raw_differences(C.ratio_levels(C.drop_suffix(self.panel, "_direct")))

    @cached_property
    def scores(self) -> DataFrame:
        return land(C.score_points(self.raw_scores), "scores")

    @cached_property
    def windows(self) -> DataFrame:
        """June windows, one pass over the bars for both panels that are screened."""
        return land(N.window_rows(self.bars), "windows")

    @cached_property
    def market_turnover(self) -> DataFrame:
        capital = self.extracted.select("symbol", "period", "paid_in_capital")
        return land(N.turnover_rows(capital, self.windows, self.counts), "turnover")

    @cached_property
    def turnover(self) -> DataFrame:
        rows = N.turnover_rows(self.panel.select("symbol", "period", "paid_in_capital", "treasury_stock"),
                               self.windows, self.counts)
        return land(N.capital_raised_next(
            N.tradeable(rows, N.turnover_cuts(self.market_turnover), self.min_traded_pct)), "tradeable")

    def key_differences(self) -> DataFrame:
        """Rows on one side only between the three panels; all zero when they agree."""
        k = ["symbol", "period"]
        side = lambda a, b, n: a.select(*k).exceptAll(b.select(*k)).agg(F.count("*").alias(n))
        return beside(beside(side(self.scores, self.bm, "scores_only"),
                             side(self.bm, self.scores, "bm_only")),
                      side(self.turnover, self.bm, "turnover_only"))

    def share_disagreements(self) -> DataFrame:
        """Share columns both panels derive must agree row by row."""
        a = self.bm.select("symbol", "period", F.struct(*H.SHARE_COLS).alias("a"))
        b = self.turnover.select("symbol", "period", F.struct(*H.SHARE_COLS).alias("b"))
        return (a.join(b, ["symbol", "period"]).where(~F.col("a").eqNullSafe(F.col("b")))
                .agg(F.count("*").alias("rows")))

    @cached_property
    def final(self) -> DataFrame:
        k = ["symbol", "period"]
        bm = (self.bm.withColumnRenamed("close", "close_dec")
              .withColumnRenamed("close_date", "close_dec_date")
              .withColumnRenamed("price_stale", "close_dec_stale"))
        own = self.turnover.drop(*H.SHARE_COLS, "treasury_stock", "paid_in_capital")
        p = (C.export_scores(self.scores).join(bm, k).join(own, k)
             .join(N.entry_prices(self.bars), k, "left"))
        return land(N.forward_return(N.exit_prices(p, self.bars)), "final")

    # ---- reports on the final panel ----

    @staticmethod
    def investable():
        have = (F.col("f_score").isNotNull() & F.col("bm").isNotNull()
                & F.col("turnover").isNotNull() & F.col("close_raw").isNotNull())
        return have & F.coalesce("tradeable", F.lit(False))

    def funnel(self, cutoff: int = 8) -> DataFrame:
        """Counts through the cumulative gates and their share of scored rows."""
        c = F.col
        gates = [("scored", c("f_score").isNotNull()), ("has_bm", c("bm").isNotNull()),
                 ("has_turnover", c("turnover").isNotNull()), ("has_price", c("close_raw").isNotNull()),
                 ("tradeable", F.coalesce("tradeable", F.lit(False))),
                 ("selected", F.coalesce(c("f_score") >= cutoff, F.lit(False)))]
        passed, counts = F.lit(True), []
        for i, (name, ok) in enumerate(gates):
            passed = passed & ok
            counts.append(F.struct(F.lit(i).alias("step"), F.lit(name).alias("gate"),
                                   F.count_if(passed).alias("rows")))
        one = self.final.agg(F.array(*counts).alias("g"))
        return (one.select(F.explode("g").alias("g"), F.col("g")[0]["rows"].alias("_all"))
                .select("g.step", "g.gate", "g.rows", F.round(
                    100 * safe_div(F.col("g.rows"), F.col("_all")), 1).alias("pct_of_scored")))

    def funnel_by_period(self, cutoff: int = 8) -> DataFrame:
        inv = self.investable()
        return self.final.groupBy("period").agg(
            F.first("formation_year", ignorenulls=True).alias("formation"),
            F.count("*").alias("rows"), F.count_if(inv).alias("investable"),
            F.count_if(inv & (F.col("f_score") >= cutoff)).alias("selected"))

    def ledger(self) -> DataFrame:
        """Per year: source rows by the first gate that removed them; must add up."""
        src = self.extracted.select("symbol", "period")
        c = F.col
        p = src.join(self.final, ["symbol", "period"], "left")
        reason = (F.when(c("signals_available").isNull(), REASONS[0])
                  .when(c("signals_available") == 1, REASONS[1])
                  .when(c("f_score").isNull(), REASONS[2])
                  .when(c("bm").isNull(), REASONS[4]).when(c("turnover").isNull(), REASONS[5])
                  .when(c("close_raw").isNull(), REASONS[6])
                  .when(~F.coalesce("tradeable", F.lit(False)), REASONS[7]).otherwise("scored"))
        t = p.withColumn("reason", reason)
        return t.groupBy(c("period").cast("int").alias("score_year")).agg(
            F.count("*").alias("rows_in_source"),
            *[F.count_if(c("reason") == r).alias(r) for r in [*REASONS, "scored"]])

    def export(self, first_formation: int = 0) -> DataFrame:
        """The score panel of the study contract, gated and renamed."""
        rows = self.final.where(self.investable())
        out = rows.select(
            F.col("symbol").alias("ticker"), F.col("period").cast("int").alias("score_year"),
            F.col("period").cast("int").alias("fiscal_year"),
            F.col("f_score").cast("int").alias("fscore"), "bm",
            *[F.col(a).cast("int").alias(b) for a, b in zip(EXPORT_FLAGS, FLAGS)])
        if self.sectors is None:
            out = out.withColumn("sector", F.lit("Unknown"))
        else:
            one = self.sectors.groupBy("ticker").agg(F.max("sector").alias("sector"))
            out = out.join(one, "ticker", "left").na.fill("Unknown", ["sector"])
        return out.where(F.col("score_year") >= first_formation - 1)

    def export_contract(self) -> DataFrame:
        e = self.export()
        total = sum((F.col(f) for f in FLAGS[1:]), F.col(FLAGS[0]))
        binary = F.lit(True)
        for f in FLAGS:
            binary = binary & F.col(f).isin(0, 1)
        return V.contract(e, ["score_year", "ticker", "fscore", "sector", "bm"],
                          ["score_year", "ticker"], {
            "score in 0..9": F.col("fscore").between(0, 9), "flags binary": binary,
            "flags sum to score": total == F.col("fscore"), "bm positive": F.col("bm") > 0})

    def reduced_fundamentals(self) -> DataFrame:
        """Book and market value per firm-year; non-positive book value becomes missing."""
        y = F.col("period").cast("int")
        return self.final.select(
            F.col("symbol").alias("ticker"), y.alias("fiscal_year"),
            F.make_date(y, F.lit(12), F.lit(31)).alias("report_date"),
            positive_or_null(F.col("book_equity")).alias("book_value"),
            F.col("market_equity").alias("market_cap"))
