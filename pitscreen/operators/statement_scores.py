"""The second scorer: level ratios, raw differences, then points; missing stays missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from pitscreen.functions.numeric import safe_div

KEYS = ("symbol", "period")
LAGGED = ("roa", "lever", "liquid", "margin", "turn")

# Comparator of each raw number.
POINTS = {
    "roa": lambda x: x > 0,
    "cfoa": lambda x: x > 0,
    "d_roa": lambda x: x > 0,
    "accrual": lambda x: x < 0,
    "d_lever": lambda x: x < 0,
    "d_liquid": lambda x: x > 0,
    "eq_offer": lambda x: x <= 0,
    "d_margin": lambda x: x > 0,
    "d_turn": lambda x: x > 0,
}
SIGNALS = list(POINTS)


def _by_symbol():
    return W.partitionBy("symbol").orderBy("period")  # one row a year


def contiguous() -> Column:
    """The symbol's previous row is exactly one year back."""
    y = F.col("period").cast("int")
    return F.coalesce(y - F.lag(y).over(_by_symbol()) == 1, F.lit(False))


def previous(value: Column, when: Column) -> Column:
    return F.when(when, F.lag(value).over(_by_symbol()))


def ratio_levels(panel: DataFrame) -> DataFrame:
    p = panel.withColumn("contiguous", contiguous())
    p = p.withColumn("total_assets_begin", previous(F.col("total_assets"), F.col("contiguous")))
    begin, c = F.col("total_assets_begin"), F.col
    sales = F.when(c("net_sales") > 0, c("net_sales"))
    return p.select(
        *KEYS, "contiguous", "total_assets_begin",
        safe_div(c("net_income_parent"), begin).alias("roa"),
        safe_div(c("cfo"), begin).alias("cfoa"),
        safe_div(c("long_term_debt"), (c("total_assets") + begin) / 2).alias("lever"),
        safe_div(c("current_assets"), c("current_liabilities")).alias("liquid"),
        safe_div(c("gross_profit"), sales).alias("margin"),
        safe_div(sales, begin).alias("turn"),
        c("stock_issuance_proceeds").alias("equity_raised"), "long_term_debt")


def raw_differences(levels: DataFrame) -> DataFrame:
    """The nine raw numbers; a change is missing unless the year before is the row before."""
    p = levels.withColumns({f"_{k}": previous(F.col(k), F.col("contiguous")) for k in LAGGED})
    p = p.withColumn("_debt", previous(F.col("long_term_debt"), F.col("contiguous")))
    d = lambda k: F.col(k) - F.col(f"_{k}")
    return p.select(
        *KEYS, F.col("roa"), F.col("cfoa"), d("roa").alias("d_roa"),
        (F.col("roa") - F.col("cfoa")).alias("accrual"), d("lever").alias("d_lever"),
        d("liquid").alias("d_liquid"), F.col("equity_raised").alias("eq_offer"),
        d("margin").alias("d_margin"), d("turn").alias("d_turn"),
        "long_term_debt", F.col("_debt").alias("long_term_debt_prev"))


def score_points(raw: DataFrame, points: dict = POINTS, min_signals: int = 9) -> DataFrame:
    """Adds ``f_<signal>``, how many are available, and the score where enough are."""
    flagged = raw.withColumns({f"f_{s}": points[s](F.col(s)) for s in SIGNALS})
    count = lambda test: sum((test(F.col(f"f_{s}")).cast("int") for s in SIGNALS[1:]),
                             test(F.col(f"f_{SIGNALS[0]}")).cast("int"))
    return (flagged.withColumn("signals_available", count(lambda f: f.isNotNull()))
            .withColumn("f_score", F.when(
                F.col("signals_available") >= min_signals,
                count(lambda f: F.coalesce(f, F.lit(False))))))


def export_scores(scored: DataFrame) -> DataFrame:
    """Raw numbers under ``raw_`` beside the points; helper columns dropped."""
    return scored.select(
        *KEYS, *[F.col(s).alias(f"raw_{s}") for s in SIGNALS], *[f"f_{s}" for s in SIGNALS],
        "signals_available", "f_score")


def drop_suffix(df: DataFrame, suffix: str) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.endswith(suffix)])


def frequency(df: DataFrame, column: str) -> DataFrame:
    """Value counts with their share of all rows, missing values included."""
    counts = df.groupBy(column).agg(F.count("*").alias("rows"))  # a handful of values
    return counts.withColumn("pct", F.round(
        100 * F.col("rows") / F.sum("rows").over(W.partitionBy(F.lit(1))), 2))


def signal_coverage(scored: DataFrame) -> DataFrame:
    """Earned, not earned, not applicable per signal."""
    cells = F.array(*[F.struct(F.lit(s).alias("signal"), F.col(f"f_{s}").alias("f"))
                      for s in SIGNALS])
    return (scored.select(F.explode(cells).alias("c")).groupBy(F.col("c.signal").alias("signal"))
            .agg(F.count_if("c.f").alias("earned"), F.count_if(~F.col("c.f")).alias("not_earned"),
                 F.count_if(F.col("c.f").isNull()).alias("not_applicable"))
            .withColumn("earned_pct", F.round(100 * safe_div(
                F.col("earned"), F.col("earned") + F.col("not_earned")), 2)))


def scores_by_period(scored: DataFrame) -> DataFrame:
    return scored.groupBy("period").agg(
        F.count("f_score").alias("scored"), F.round(F.avg("f_score"), 2).alias("mean"),
        F.count_if(F.col("f_score") >= 8).alias("high"),
        F.count_if(F.col("f_score") <= 1).alias("low"))


def leverage_zero_point(scored: DataFrame) -> DataFrame:
    """How the unchanged-leverage case splits, and the mean score under the looser rule."""
    s = scored.where(F.col("f_score").isNotNull())
    zero = F.col("d_lever") == 0
    debt, prev = F.col("long_term_debt"), F.col("long_term_debt_prev")
    return s.agg(
        F.count("*").alias("scored_rows"), F.count_if(F.col("d_lever") < 0).alias("negative"),
        F.count_if(F.col("d_lever") > 0).alias("positive"), F.count_if(zero).alias("zero"),
        F.count_if(zero & (debt == 0) & (prev == 0)).alias("zero_no_debt"),
        F.count_if(zero & ((debt > 0) | (prev > 0))).alias("zero_with_debt"),
        F.round(F.avg("f_score"), 3).alias("mean_score"),
        F.round(F.avg(F.col("f_score") + zero.cast("int")), 3).alias("mean_score_loose"))


def leverage_rule_shift(raw: DataFrame, cutoff: int = 7) -> DataFrame:
    """Names at the cutoff under `< 0` and `<= 0`, per period and in total.

    The looser rule can only add a point; ``lost`` counts violations of that nesting.
    """
    loose = dict(POINTS, d_lever=lambda x: x <= 0)
    strict = score_points(raw)
    both = strict.withColumn("_loose", F.when(
        F.col("f_score").isNotNull(),
        F.col("f_score") - F.col("f_d_lever").cast("int") + loose["d_lever"](F.col("d_lever")).cast("int")))
    a = F.coalesce(F.col("f_score") >= cutoff, F.lit(False))
    b = F.coalesce(F.col("_loose") >= cutoff, F.lit(False))
    t = both.rollup("period").agg(
        F.count("f_score").alias("scored"), F.count_if(a).alias("strict"),
        F.count_if(b).alias("loose"), F.count_if(a & ~b).alias("lost"))
    return (t.withColumn("period", F.coalesce("period", F.lit("ALL")))
            .withColumn("added", F.col("loose") - F.col("strict"))
            .withColumn("added_pct", F.round(100 * safe_div(F.col("added"), F.col("strict")), 1)))
