"""Nine binary accounting signals and their sum, for every firm-year at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pitscreen.functions.numeric import bm_from_cap, ratio_or_inf, safe_div
from pitscreen.sources.schemas import FLAGS, SCORE_PANEL

# Inputs that must be present in both the scored and the prior year.
REQUIRED_LINES = [
    "total_assets", "net_income", "cfo", "long_term_debt", "current_assets",
    "current_liabilities", "shares_outstanding", "revenue", "cogs",
]


def _flag(cond: Column) -> Column:
    # a comparison with a missing side earns no point
    return F.coalesce(cond, F.lit(False)).cast("int")


def pair_years(fundamentals: DataFrame) -> DataFrame:
    """Each firm-year beside its prior year (``p_*``) and the assets of two years before.

    One shuffle: the three roles of a row are exploded to the year they serve and meet
    again in a single aggregate per (ticker, year).
    """
    lines = [c for c in [*REQUIRED_LINES, "equity_issued"] if c in fundamentals.columns]
    row = F.struct(*lines)
    roles = F.array(*[F.struct(F.lit(back).alias("back"),
                               (F.col("fiscal_year") + back).alias("score_year"))
                      for back in (0, 1, 2)])
    # of several statements for one year the first reported counts, as for book-to-market
    filed = (F.coalesce(F.col("report_date").cast("date"), F.lit("9999-12-31").cast("date"))
             if "report_date" in fundamentals.columns else F.lit(0))
    flat = fundamentals.select("ticker", row.alias("_row"), filed.alias("_filed"), F.explode(roles).alias("_r"))
    at = lambda back: F.min_by("_row", F.when(F.col("_r.back") == back, F.col("_filed")))
    wide = (flat.groupBy("ticker", F.col("_r.score_year").alias("score_year"))
            .agg(at(0).alias("t"), at(1).alias("p"),
                 at(2)["total_assets"].alias("pp_assets"))
            .where(F.col("t").isNotNull() & F.col("p").isNotNull()))
    return wide.select("ticker", "score_year", "pp_assets",
                       *[F.col(f"t.{c}").alias(c) for c in lines],
                       *[F.col(f"p.{c}").alias(f"p_{c}") for c in lines])


def with_completeness(pairs: DataFrame) -> DataFrame:
    complete = F.lit(True)
    for c in REQUIRED_LINES:
        complete = complete & F.col(c).isNotNull() & F.col(f"p_{c}").isNotNull()
    cash = (F.col("equity_issued").isNotNull() if "equity_issued" in pairs.columns
            else F.lit(False))
    return (pairs.withColumn("complete", complete)
            .withColumn("issuance_from_cash", cash)
            .withColumn("no_two_year_assets", F.col("pp_assets").isNull()))


def nine_signals(fundamentals: DataFrame, two_years_back: bool = True) -> DataFrame:
    """(ticker, score_year, nine flags, fscore) for firm-years with complete inputs.

    Ratios scale by beginning-of-year assets on both sides of a change; leverage uses
    average assets. A firm without assets from two years before falls back to the prior
    year's. Issuance reads the cash-flow line, else the share count.
    """
    pairs = with_completeness(pair_years(fundamentals)).where("complete")
    c = F.col
    begin = c("p_total_assets")
    begin_prior = F.coalesce(c("pp_assets"), begin) if two_years_back else begin
    average = (c("total_assets") + begin) / 2
    average_prior = (begin + begin_prior) / 2
    r = ratio_or_inf
    roa = r(c("net_income"), begin)
    margin = lambda p: r(c(f"{p}revenue") - c(f"{p}cogs"), c(f"{p}revenue"))
    by_count = c("shares_outstanding") <= c("p_shares_outstanding")
    issuance = (F.when(c("issuance_from_cash"), c("equity_issued") <= 0).otherwise(by_count)
                if "equity_issued" in pairs.columns else by_count)
    rules = {
        "f_roa": roa > 0,
        "f_cfo": c("cfo") > 0,
        "f_droa": roa > r(c("p_net_income"), begin_prior),
        "f_accrual": r(c("cfo"), begin) > roa,
        "f_dlever": r(c("long_term_debt"), average)
                    < r(c("p_long_term_debt"), average_prior),
        "f_dliquid": r(c("current_assets"), c("current_liabilities"))
                     > r(c("p_current_assets"), c("p_current_liabilities")),
        "f_eq_offer": issuance,
        "f_dmargin": margin("") > margin("p_"),
        "f_dturn": r(c("revenue"), begin) > r(c("p_revenue"), begin_prior),
    }
    flagged = pairs.select("ticker", "score_year",
                           *[_flag(rules[f]).alias(f) for f in FLAGS])
    return flagged.withColumn("fscore", sum((c(f) for f in FLAGS[1:]), c(FLAGS[0])))


def scoring_ledger(fundamentals: DataFrame) -> DataFrame:
    """Per score year: scored, dropped for incomplete inputs, and how issuance was read."""
    pairs = with_completeness(pair_years(fundamentals))
    ok = F.col("complete")
    return pairs.groupBy("score_year").agg(
        F.count_if(ok).alias("scored"),
        F.count_if(~ok).alias("dropped_incomplete_signals"),
        F.count_if(ok & F.col("issuance_from_cash")).alias("eq_offer_from_cashflow"),
        F.count_if(ok & ~F.col("issuance_from_cash")).alias("eq_offer_from_shares"),
        F.count_if(ok & F.col("no_two_year_assets")).alias("no_tm2_assets"))


def members_for_scoring(df: DataFrame, membership: DataFrame, year_col: str) -> DataFrame:
    """Keeps names that belong to the index at the formation using ``year_col``.

    Score year y feeds formation y + 1. A formation without a membership list is not
    filtered. The list of formations has one row a year; the names are joined, not shipped.
    """
    m = membership.select((F.year("date") - 1).alias(year_col), "ticker").distinct()
    listed = F.broadcast(m.select(year_col).distinct().withColumn("_listed", F.lit(True)))
    return (df.join(listed, year_col, "left")
            .join(m.withColumn("_member", F.lit(True)), ["ticker", year_col], "left")
            .where(F.col("_listed").isNull() | F.col("_member"))
            .drop("_listed", "_member"))


def score_panel(fundamentals: DataFrame, sectors: DataFrame | None = None,
                membership: DataFrame | None = None,
                first_year: int | None = None, last_year: int | None = None) -> DataFrame:
    """The panel every study reads: flags, score, sector, book-to-market, market value."""
    scored = nine_signals(fundamentals)
    if first_year is not None:
        scored = scored.where(F.col("score_year") >= first_year)
    if last_year is not None:
        scored = scored.where(F.col("score_year") <= last_year)
    if membership is not None:
        scored = members_for_scoring(scored, membership, "score_year")
    values = (fundamentals.groupBy("ticker", F.col("fiscal_year").alias("score_year"))
              .agg(F.min_by(F.struct("book_value", "market_cap"), "report_date").alias("_v"))
              .select("ticker", "score_year",
                      bm_from_cap(F.col("_v.book_value"), F.col("_v.market_cap")).alias("bm"),
                      F.col("_v.market_cap").alias("market_cap")))
    panel = (scored.withColumn("fiscal_year", F.col("score_year"))
             .join(values, ["ticker", "score_year"], "left"))
    if sectors is None:
        panel = panel.withColumn("sector", F.lit(None).cast("string"))
    else:
        panel = panel.join(sectors.select("ticker", "sector"), "ticker", "left")
    return panel.select(*SCORE_PANEL)


def issuance_sensitivity(fundamentals: DataFrame) -> DataFrame:
    """Per score year: how often the two issuance measures disagree, mean score each way.

    Snapshots of two years only, as when the measures are compared on their own. The
    second scoring differs in one flag, so it is derived instead of scored again.
    """
    by_cash = nine_signals(fundamentals, two_years_back=False)
    pairs = with_completeness(pair_years(fundamentals)).where("complete").select(
        "ticker", "score_year", "issuance_from_cash",
        _flag(F.col("shares_outstanding") <= F.col("p_shares_outstanding")).alias("by_count"))
    both = by_cash.select("ticker", "score_year", "f_eq_offer", "fscore").join(
        pairs, ["ticker", "score_year"])
    count_score = F.col("fscore") - F.col("f_eq_offer") + F.col("by_count")
    flips = F.count_if(F.col("f_eq_offer") != F.col("by_count"))
    return both.groupBy("score_year").agg(
        F.count("*").alias("firms"),
        F.count_if("issuance_from_cash").alias("cash_line_available"),
        flips.alias("signal_flips"),
        F.avg("fscore").alias("mean_fscore_cash"),
        F.avg(count_score).alias("mean_fscore_share"),
        safe_div(flips, F.count("*")).alias("flip_rate"))


def complete_workbook_rows(rows: DataFrame, flags: list[str], symbol: str,
                           score: str) -> DataFrame:
    """Tags each pre-scored row with why it is dropped, or 'kept'."""
    n = sum((F.col(f).isNotNull().cast("int") for f in flags[1:]),
            F.col(flags[0]).isNotNull().cast("int"))
    return (rows.withColumn("n_signals", n)
            .withColumn("outcome", F.when(n < len(flags), "dropped_incomplete_signals")
                        .when(F.col(symbol).isNull(), "dropped_no_symbol")
                        .when(F.col(score).isNull(), "dropped_no_score").otherwise("kept")))


def workbook_ledger(tagged: DataFrame, year: str = "score_year") -> DataFrame:
    """Per year and in total: rows, the three drop reasons, kept, and shares of rows."""
    cnt = lambda o: F.count_if(F.col("outcome") == o).alias(o)
    agg = tagged.rollup(year).agg(
        F.count("*").alias("rows"), cnt("dropped_incomplete_signals"),
        cnt("dropped_no_symbol"), cnt("dropped_no_score"), cnt("kept"),
        F.median(F.when(F.col("outcome") == "dropped_incomplete_signals", F.col("n_signals")))
        .alias("median_signals_when_incomplete"))
    pct = lambda c: F.round(100 * safe_div(F.col(c), F.col("rows")), 2)
    return (agg.withColumn("pct_dropped_incomplete", pct("dropped_incomplete_signals"))
            .withColumn("pct_kept", pct("kept")))
