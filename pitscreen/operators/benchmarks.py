"""Benchmark series, currency conversion, factor regressions and local factors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from pitscreen.functions.dates import available_date, between_formations, formation_date
from pitscreen.functions.numeric import safe_div
from pitscreen.operators import paths as P
from pitscreen.operators.evaluate import ALPHA, TRADING_DAYS
from pitscreen.operators.ordering import exact_quantiles
from pitscreen.operators.paths import YEAR
from pitscreen.session import land

# Rolling median width and the largest believable deviation from it.
MEDIAN_ROWS = 11
MEDIAN_MIN = 3
BAD_TICK = 0.4
HAC_LAGS = 5


def centred_median(value: str, order: W, rows: int = MEDIAN_ROWS, least: int = MEDIAN_MIN) -> Column:
    """Median of a short centred window; the frame holds ``rows`` values."""
    half = rows // 2
    near = F.sort_array(F.collect_list(value).over(order.rowsBetween(-half, half)))
    n = F.size(near)
    mid = (F.get(near, F.floor((n - 1) / 2).cast("int")) + F.get(near, F.floor(n / 2).cast("int"))) / 2
    return F.when(n >= least, mid)


def benchmark_returns(prices: DataFrame, tickers: list[str] | None = None,
                      start: Column | None = None, end: Column | None = None) -> DataFrame:
    """(ticker, date, r) without isolated bad ticks, sliced before differencing."""
    px = prices if tickers is None else prices.where(F.col("ticker").isin(tickers))
    w = W.partitionBy("ticker").orderBy("date")  # one row a session
    good = (px.withColumn("_m", centred_median("adj_close", w))
            .where(F.abs(F.col("adj_close") / F.col("_m") - 1) < BAD_TICK))
    if start is not None:
        good = good.where(F.col("date") >= start)
    if end is not None:
        good = good.where(F.col("date") <= end)
    return (good.withColumn("r", F.col("adj_close") / F.lag("adj_close").over(w) - 1)
            .where(F.col("r").isNotNull()).select("ticker", "date", "r"))


def to_usd(local: DataFrame, fx: DataFrame, key: str = "ticker") -> DataFrame:
    """Local returns in dollars; the rate (local per dollar) is carried over missing days."""
    w = W.partitionBy(key).orderBy("date")
    rate = F.last("rate", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    # one rate per session: bounded by the calendar
    aligned = (local.join(F.broadcast(fx.select("date", F.col("adj_close").alias("rate"))), "date", "left")
               .withColumn("_fx", rate))
    move = F.lag("_fx").over(w) / F.col("_fx") - 1
    return (aligned.withColumn("r", (1 + F.col("r")) * (1 + move) - 1)
            .where(F.col("r").isNotNull()).select(key, "date", "r"))


# A rational approximation of the complementary error function, good to 1.5e-7.
ERFC = [0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429]
ERFC_SCALE = 0.3275911


def two_sided_normal(t: Column) -> Column:
    """Probability of a standard normal at least as far from zero."""
    z = F.abs(t) / F.sqrt(F.lit(2.0))
    u = 1 / (1 + ERFC_SCALE * z)
    tail = F.lit(0.0)
    for c in reversed(ERFC):
        tail = u * (c + tail)
    return tail * F.exp(-z * z)


def factor_regression(daily: DataFrame, factors: DataFrame, by: str = "book",
                      lags: int = HAC_LAGS) -> DataFrame:
    """OLS of excess returns on three factors, alpha tested with Bartlett-weighted errors.

    The 3x3 normal equations are solved in closed form from aggregated moments. Alpha is a
    weighted sum of the returns, so its variance only needs the products of one scalar
    series with its own lags. Every series is one row a session.
    """
    x = ["mkt_rf", "smb", "hml"]
    # one factor row per session: bounded by the calendar
    d = (daily.join(F.broadcast(factors.select("date", *x, "rf")), "date")
         .withColumn("y", F.col("r") - F.col("rf")).na.drop(subset=["y", *x]))
    k = W.partitionBy(by)
    centred = d.withColumns({f"c_{v}": F.col(v) - F.avg(v).over(k) for v in ["y", *x]})
    pairs = {f"s_{a}_{b}": F.sum(F.col(f"c_{a}") * F.col(f"c_{b}"))
             for i, a in enumerate(x) for b in [*x[i:], "y"]}
    m = centred.groupBy(by).agg(
        F.count("*").alias("n_obs"), *[F.avg(v).alias(f"m_{v}") for v in ["y", *x]],
        F.sum(F.col("c_y") * F.col("c_y")).alias("s_y_y"),
        *[e.alias(n) for n, e in pairs.items()])
    s = lambda a, b: F.col(f"s_{a}_{b}" if x.index(a) <= x.index(b) else f"s_{b}_{a}")
    cof = {}
    for i in range(3):
        for j in range(3):
            r = [v for q, v in enumerate(x) if q != i]
            c = [v for q, v in enumerate(x) if q != j]
            sign = 1 if (i + j) % 2 == 0 else -1
            cof[i, j] = sign * (s(r[0], c[0]) * s(r[1], c[1]) - s(r[0], c[1]) * s(r[1], c[0]))
    det = sum((s(x[0], x[j]) * cof[0, j] for j in (1, 2)), s(x[0], x[0]) * cof[0, 0])
    m = m.withColumns({f"v_{i}{j}": cof[i, j] / det for i in range(3) for j in range(3)})
    beta = lambda i: sum((F.col(f"v_{i}{j}") * F.col(f"s_{x[j]}_y") for j in (1, 2)),
                         F.col(f"v_{i}0") * F.col(f"s_{x[0]}_y"))
    m = m.withColumns({f"b_{i}": beta(i) for i in range(3)})
    m = m.withColumn("alpha_daily", F.col("m_y") - sum(
        (F.col(f"b_{i}") * F.col(f"m_{x[i]}") for i in (1, 2)), F.col("b_0") * F.col(f"m_{x[0]}")))
    pull = lambda i: sum((F.col(f"v_{i}{j}") * F.col(f"m_{x[j]}") for j in (1, 2)),
                         F.col(f"v_{i}0") * F.col(f"m_{x[0]}"))
    m = m.withColumns({f"g_{i}": pull(i) for i in range(3)})
    e = centred.join(m, by)  # already partitioned by series
    fit = sum((F.col(f"b_{i}") * F.col(f"c_{x[i]}") for i in (1, 2)), F.col("b_0") * F.col(f"c_{x[0]}"))
    load = sum((F.col(f"g_{i}") * F.col(f"c_{x[i]}") for i in (1, 2)), F.col("g_0") * F.col(f"c_{x[0]}"))
    e = (e.withColumn("e", F.col("c_y") - fit)
         .withColumn("u", (1 / F.col("n_obs") - load) * F.col("e")))
    w = W.partitionBy(by).orderBy("date")
    weighted = F.col("u") * F.col("u")
    for lag in range(1, lags + 1):
        weighted = weighted + F.coalesce(
            2 * (1 - lag / (lags + 1)) * F.col("u") * F.lag("u", lag).over(w), F.lit(0.0))
    e = e.withColumn("_w", weighted)
    err = e.groupBy(by).agg(F.sum("_w").alias("var"), F.sum(F.col("e") * F.col("e")).alias("sse"))
    out = m.join(err, by)
    t = F.col("alpha_daily") / F.sqrt("var")
    return (out.withColumn("alpha_tstat", t).withColumn("alpha_pvalue", two_sided_normal(t))
            .select(by, "alpha_daily", (F.col("alpha_daily") * TRADING_DAYS).alias("alpha_annual"),
                    "alpha_tstat", "alpha_pvalue", (F.col("alpha_pvalue") < ALPHA).alias("alpha_significant"),
                    F.col("b_0").alias("beta_mkt"), F.col("b_1").alias("beta_smb"),
                    F.col("b_2").alias("beta_hml"), (1 - F.col("sse") / F.col("s_y_y")).alias("r2"),
                    "n_obs"))


def factor_members(fundamentals: DataFrame, prices: DataFrame, first_year: int, last_year: int,
                   lag_months: int = 6, min_names: int = 30) -> DataFrame:
    """(formation_year, ticker, leg, market_cap): size and value legs of each formation."""
    prices = between_formations(prices, first_year, last_year, 0, 12, P.BASE_DAYS)
    year = F.col("fiscal_year") + 1
    snap = (fundamentals.withColumn(YEAR, year)
            .where(F.col(YEAR).between(first_year, last_year)
                   & (available_date(F.col("report_date"), lag_months) <= formation_date(F.col(YEAR)))
                   & (F.col("market_cap") > 0) & (F.col("book_value") > 0))
            .select(YEAR, "ticker", "market_cap", (F.col("book_value") / F.col("market_cap")).alias("bm")))
    quoted = P.holding_bars(prices, snap).select(YEAR, "ticker").distinct()
    enough = lambda df: df.join(F.broadcast(
        df.groupBy(YEAR).agg(F.count("*").alias("_n")).where(F.col("_n") >= min_names).select(YEAR)), YEAR)
    # read five times below; a row per name and formation
    held = land(enough(enough(snap).join(quoted, [YEAR, "ticker"], "left_semi")), "factor-names")
    cuts = (exact_quantiles(held, [YEAR], "market_cap", {"size_cut": 0.5})
            .join(exact_quantiles(held, [YEAR], "bm", {"low": 0.30, "high": 0.70}), YEAR))
    t = held.join(F.broadcast(cuts), YEAR)  # one row a year
    size = F.when(F.col("market_cap") <= F.col("size_cut"), "S").otherwise("B")
    value = (F.when(F.col("bm") <= F.col("low"), "L").when(F.col("bm") >= F.col("high"), "H")
             .otherwise("M"))
    return t.select(YEAR, "ticker", F.concat(size, value).alias("leg"), "market_cap")


def local_factors(fundamentals: DataFrame, prices: DataFrame, first_year: int, last_year: int,
                  lag_months: int = 6, rf_annual: float = 0.0, min_names: int = 30) -> DataFrame:
    """(date, mkt_rf, smb, hml, rf) from the market's own 2x3 sort, legs drifting all year."""
    prices = between_formations(prices, first_year, last_year, 0, 12, P.BASE_DAYS)
    members = factor_members(fundamentals, prices, first_year, last_year, lag_months, min_names)
    both = members.withColumn("book", F.explode(F.array(F.col("leg"), F.lit("MKT"))))
    total = both.groupBy(YEAR, "book").agg(F.sum("market_cap").alias("_t"))
    pos = (both.join(F.broadcast(total), [YEAR, "book"])  # seven rows a year
           .select(YEAR, "book", "ticker", (F.col("market_cap") / F.col("_t")).alias("w")))
    steps = P.growth_steps(prices, members.select(YEAR, "ticker"))
    daily = P.book_returns(P.book_values(pos, steps, P.holding_sessions(prices)))
    legs = ["SL", "SM", "SH", "BL", "BM", "BH", "MKT"]
    wide = daily.groupBy("date").pivot("book", legs).agg(F.first("r"))

    def mean(names):
        some = sum((F.coalesce(F.col(n), F.lit(0.0)) for n in names[1:]), F.coalesce(F.col(names[0]), F.lit(0.0)))
        n = sum((F.col(c).isNotNull().cast("int") for c in names[1:]), F.col(names[0]).isNotNull().cast("int"))
        return safe_div(some, n)

    rf = rf_annual / TRADING_DAYS
    return (wide.select("date", (F.col("MKT") - rf).alias("mkt_rf"),
                        (mean(["SL", "SM", "SH"]) - mean(["BL", "BM", "BH"])).alias("smb"),
                        (mean(["SH", "BH"]) - mean(["SL", "BL"])).alias("hml"),
                        F.lit(rf).alias("rf")).na.drop())
