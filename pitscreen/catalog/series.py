"""Returns panels, benchmarks, currency, factors and regressions."""

from pyspark.sql import functions as F, Window as W

from pitscreen.catalog.registry import query
from pitscreen.catalog.study import r6, study
from pitscreen.catalog.views import VIEWS
from pitscreen.operators import asof as A, benchmarks as M, evaluate as E, paths as P
from pitscreen.operators.ordering import exact_quantiles

VIEWS["panel_returns"] = """
WITH cal AS (SELECT DISTINCT date, y AS formation_year FROM prices, (SELECT CAST(unnest([1997, 1998, 1999, 2000]) AS INTEGER) AS y)
  WHERE date >= make_date(y, 7, 1) - 7 AND date <= make_date(y + 1, 6, 30)),
n AS (SELECT DISTINCT formation_year, ticker FROM value_set),
g AS (SELECT n.formation_year, n.ticker, c.date, p.adj_close,
  last_value(p.adj_close IGNORE NULLS) OVER (PARTITION BY n.formation_year, n.ticker ORDER BY c.date) AS px
 FROM n JOIN cal c ON c.formation_year = n.formation_year LEFT JOIN prices p ON p.ticker = n.ticker AND p.date = c.date),
r AS (SELECT formation_year, ticker, date, px / lag(px) OVER (PARTITION BY formation_year, ticker ORDER BY date) - 1 AS r FROM g)
SELECT * FROM r WHERE r IS NOT NULL AND date > make_date(formation_year, 7, 1)
"""

query("returns_panel", "B13 W7 W8 B18", "SELECT formation_year, ticker, date, round(r, 6) AS r FROM panel_returns", "panel_returns value_set")(
    lambda t: r6(P.returns_panel(study(t).held_bars, study(t).value_set)))

query("delisting_return_steps", "B13 W16", """
WITH n AS (SELECT DISTINCT formation_year, ticker FROM value_set),
l AS (SELECT n.formation_year, n.ticker, max(p.date) AS last FROM n JOIN prices p ON p.ticker = n.ticker AND p.date >= make_date(formation_year, 7, 1) - 7
  AND p.date <= make_date(formation_year + 1, 6, 30) GROUP BY 1, 2),
x AS (SELECT l.formation_year, l.ticker, (SELECT min(date) FROM hold_sessions s WHERE s.formation_year = l.formation_year AND s.date > l.last) AS date FROM l),
a AS (SELECT formation_year, ticker, date, r FROM panel_returns UNION ALL SELECT formation_year, ticker, date, -0.3 FROM x WHERE date IS NOT NULL)
SELECT formation_year, ticker, round(product(1 + r) - 1, 6) AS total FROM (
  SELECT formation_year, ticker, date, min(r) FILTER (r = -0.3) AS hit, coalesce(min(r) FILTER (r = -0.3), max(r)) AS r FROM a GROUP BY 1, 2, 3) GROUP BY 1, 2""",
      "panel_returns value_set hold_sessions")(
    lambda t: r6(P.returns_panel(study(t).held_bars, study(t).value_set, -0.3).groupBy("formation_year", "ticker").agg(
        (F.product(1 + F.col("r")) - 1).alias("total"))))

query("stopped_names", "W16", """
WITH l AS (SELECT v.formation_year, v.ticker, max(p.date) AS last FROM value_set v JOIN prices p ON p.ticker = v.ticker AND p.date >= make_date(formation_year, 7, 1) - 7
  AND p.date <= make_date(formation_year + 1, 6, 30) GROUP BY 1, 2)
SELECT formation_year, count(*) FILTER (last < (SELECT max(date) FROM prices WHERE date <= make_date(formation_year + 1, 6, 30))) AS delisted_in_holding_year FROM l GROUP BY 1""",
      "value_set")(lambda t: P.stopped_names(study(t).held_bars, study(t).value_set))

query("fixed_weight_book_returns", "B17 W8", """
WITH n AS (SELECT formation_year AS y, book, ticker, w FROM positions),
h AS (SELECT n.*, p.date, p.adj_close FROM n JOIN prices p ON p.ticker = n.ticker AND p.date >= make_date(y, 7, 2) AND p.date <= make_date(y + 1, 6, 30)),
d AS (SELECT y, book, date, row_number() OVER (PARTITION BY y, book ORDER BY date) AS s FROM (SELECT DISTINCT y, book, date FROM h)),
r AS (SELECT h.y, h.book, h.date, h.w, CASE WHEN d.s - lag(d.s) OVER k = 1 THEN h.adj_close / lag(h.adj_close) OVER k - 1 END AS r
 FROM h JOIN d ON d.y = h.y AND d.book = h.book AND d.date = h.date WINDOW k AS (PARTITION BY h.y, h.book, h.ticker ORDER BY h.date))
SELECT y AS formation_year, book, date, round(sum(w * r), 6) AS r FROM r GROUP BY 1, 2, 3 HAVING sum(w * r) IS NOT NULL""", "positions")(
    lambda t: r6(P.fixed_weight_returns(t.prices, study(t).equal_positions, F.make_date("formation_year", F.lit(7), F.lit(2)),
                                        F.make_date(F.col("formation_year") + 1, F.lit(6), F.lit(30)))))

query("nav_series", "E30 W9", """
SELECT book, date, round(product(1 + r) OVER (PARTITION BY book ORDER BY date), 6) AS nav FROM book_daily""", "book_daily")(
    lambda t: E.nav(study(t).equal_daily, ["book"]).select("book", "date", F.round("nav", 6).alias("nav")))

query("year_end_price", "J9", """
SELECT ticker, CAST(year(date) AS INTEGER) AS fiscal_year, round(max_by(close_raw, date), 4) AS price FROM prices
WHERE date > make_date(CAST(year(date) AS INTEGER), 12, 31) - 30 GROUP BY 1, 2""", "prices")(
    lambda t: A.year_end_price(t.prices).withColumn("price", F.round("price", 4)))

VIEWS["bench_returns"] = """
WITH m AS (SELECT *, CASE WHEN count(*) OVER w >= 3 THEN median(adj_close) OVER w END AS med FROM benchmarks WHERE ticker <> 'FX'
  WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)),
g AS (SELECT * FROM m WHERE abs(adj_close / med - 1) < 0.4 AND date BETWEEN DATE '1997-07-02' AND DATE '2001-06-30'),
r AS (SELECT ticker, date, adj_close / lag(adj_close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS r FROM g)
SELECT * FROM r WHERE r IS NOT NULL
"""


def bench(t):
    return M.benchmark_returns(t.benchmarks, ["INDEX", "ETF"], F.lit("1997-07-02").cast("date"),
                               F.lit("2001-06-30").cast("date"))


query("benchmark_returns", "E13 W11 T7", "SELECT ticker, date, round(r, 6) AS r FROM bench_returns", "bench_returns")(
    lambda t: r6(bench(t)))

query("benchmark_metrics", "E13 E1", """
WITH n AS (SELECT *, product(1 + r) OVER (PARTITION BY ticker ORDER BY date) AS nav FROM bench_returns),
d AS (SELECT *, nav / max(nav) OVER (PARTITION BY ticker ORDER BY date) - 1 AS dd FROM n)
SELECT ticker, count(*) AS n_days, round(stddev_samp(r) * sqrt(252), 6) AS ann_vol, round(min(dd), 6) AS max_drawdown,
 round(product(1 + r) ** (252.0 / count(*)) - 1, 6) AS ann_return FROM d GROUP BY 1""", "bench_returns")(
    lambda t: r6(E.metrics(bench(t), ["ticker"]).select("ticker", "n_days", "ann_vol", "max_drawdown", "ann_return")))

query("returns_in_usd", "E14", """
WITH a AS (SELECT b.*, last_value(f.adj_close IGNORE NULLS) OVER (PARTITION BY b.ticker ORDER BY b.date) AS fx FROM bench_returns b
  LEFT JOIN benchmarks f ON f.ticker = 'FX' AND f.date = b.date),
r AS (SELECT ticker, date, (1 + r) * (lag(fx) OVER (PARTITION BY ticker ORDER BY date) / fx) - 1 AS r FROM a)
SELECT ticker, date, round(r, 6) AS r FROM r WHERE r IS NOT NULL""", "bench_returns benchmarks")(
    lambda t: r6(M.to_usd(bench(t), t.benchmarks.where(F.col("ticker") == "FX"))))

VIEWS["ff_members"] = """
WITH s AS (SELECT fiscal_year + 1 AS formation_year, ticker, market_cap, book_value / market_cap AS bm FROM fundamentals
  WHERE report_date + INTERVAL 6 MONTH <= make_date(fiscal_year + 1, 7, 1) AND market_cap > 0 AND book_value > 0 AND fiscal_year + 1 BETWEEN 1997 AND 2000),
h AS (SELECT s.* FROM s WHERE EXISTS (SELECT 1 FROM prices p WHERE p.ticker = s.ticker AND p.date >= make_date(formation_year, 7, 1) - 7
   AND p.date <= make_date(formation_year + 1, 6, 30))),
c AS (SELECT formation_year, median(market_cap) AS sz, quantile_cont(bm, 0.3) AS lo, quantile_cont(bm, 0.7) AS hi FROM h GROUP BY 1 HAVING count(*) >= 5)
SELECT h.formation_year, ticker, CASE WHEN market_cap <= sz THEN 'S' ELSE 'B' END || CASE WHEN bm <= lo THEN 'L' WHEN bm >= hi THEN 'H' ELSE 'M' END AS leg, market_cap
FROM h JOIN c ON c.formation_year = h.formation_year
"""
VIEWS["ff_growth"] = VIEWS["growth"].replace("FROM value_set", "FROM ff_members")
VIEWS["ff_factors"] = """
WITH b AS (SELECT formation_year, ticker, leg AS book, market_cap FROM ff_members UNION ALL SELECT formation_year, ticker, 'MKT', market_cap FROM ff_members),
p AS (SELECT *, market_cap / sum(market_cap) OVER (PARTITION BY formation_year, book) AS w FROM b),
v AS (SELECT p.formation_year, book, g.date, sum(w * g.g) AS value FROM p JOIN ff_growth g ON g.formation_year = p.formation_year AND g.ticker = p.ticker GROUP BY ALL),
r AS (SELECT book, date, value / coalesce(lag(value) OVER (PARTITION BY formation_year, book ORDER BY date), 1.0) - 1 AS r FROM v)
SELECT date, max(r) FILTER (book = 'MKT') AS mkt_rf,
 avg(r) FILTER (book IN ('SL', 'SM', 'SH')) - avg(r) FILTER (book IN ('BL', 'BM', 'BH')) AS smb,
 avg(r) FILTER (book IN ('SH', 'BH')) - avg(r) FILTER (book IN ('SL', 'BL')) AS hml, 0.0::DOUBLE AS rf
FROM r GROUP BY 1
"""


def factors(t):
    if "factors" not in t.__dict__:
        from pitscreen.session import land

        t.factors = land(M.local_factors(t.fundamentals, t.prices, 1997, 2000, min_names=5), "factors")
    return t.factors


query("factor_legs", "E16", "SELECT formation_year, ticker, leg, round(market_cap, 4) AS market_cap FROM ff_members", "ff_members")(
    lambda t: M.factor_members(t.fundamentals, t.prices, 1997, 2000, min_names=5)
    .withColumn("market_cap", F.round("market_cap", 4)))

query("local_factors", "E16 T8", """
SELECT date, round(mkt_rf, 6) AS mkt_rf, round(smb, 6) AS smb, round(hml, 6) AS hml, rf FROM ff_factors WHERE smb IS NOT NULL AND hml IS NOT NULL""", "ff_factors")(
    lambda t: r6(factors(t)))

# Regression by sequential residuals: each step removes one regressor from the ones after it.
VIEWS["regression"] = """
WITH d AS (SELECT b.book, b.date, b.r - f.rf AS y, f.mkt_rf AS x1, f.smb AS x2, f.hml AS x3 FROM book_daily b JOIN ff_factors f USING (date)
  WHERE smb IS NOT NULL AND hml IS NOT NULL),
c AS (SELECT *, y - avg(y) OVER k AS cy, x1 - avg(x1) OVER k AS c1, x2 - avg(x2) OVER k AS c2, x3 - avg(x3) OVER k AS c3 FROM d WINDOW k AS (PARTITION BY book)),
a1 AS (SELECT *, c2 - c1 * (sum(c1 * c2) OVER k / sum(c1 * c1) OVER k) AS q2, c3 - c1 * (sum(c1 * c3) OVER k / sum(c1 * c1) OVER k) AS q3a FROM c WINDOW k AS (PARTITION BY book)),
a2 AS (SELECT *, q3a - q2 * (sum(q2 * q3a) OVER k / sum(q2 * q2) OVER k) AS q3 FROM a1 WINDOW k AS (PARTITION BY book)),
b3 AS (SELECT *, sum(q3 * cy) OVER k / sum(q3 * q3) OVER k AS beta3 FROM a2 WINDOW k AS (PARTITION BY book)),
b2 AS (SELECT *, sum(q2 * (cy - beta3 * c3)) OVER k / sum(q2 * q2) OVER k AS beta2 FROM b3 WINDOW k AS (PARTITION BY book)),
b1 AS (SELECT *, sum(c1 * (cy - beta3 * c3 - beta2 * c2)) OVER k / sum(c1 * c1) OVER k AS beta1 FROM b2 WINDOW k AS (PARTITION BY book)),
e AS (SELECT *, cy - beta1 * c1 - beta2 * c2 - beta3 * c3 AS e,
  1 - x1 * (sum(x1) OVER k / sum(x1 * x1) OVER k) AS o1, x2 - x1 * (sum(x1 * x2) OVER k / sum(x1 * x1) OVER k) AS p2, x3 - x1 * (sum(x1 * x3) OVER k / sum(x1 * x1) OVER k) AS p3a FROM b1 WINDOW k AS (PARTITION BY book)),
e2 AS (SELECT *, o1 - p2 * (sum(p2 * o1) OVER k / sum(p2 * p2) OVER k) AS o2, p3a - p2 * (sum(p2 * p3a) OVER k / sum(p2 * p2) OVER k) AS p3 FROM e WINDOW k AS (PARTITION BY book)),
e3 AS (SELECT *, o2 - p3 * (sum(p3 * o2) OVER k / sum(p3 * p3) OVER k) AS o FROM e2 WINDOW k AS (PARTITION BY book)),
u AS (SELECT *, o / sum(o * o) OVER (PARTITION BY book) * e AS u, o / sum(o * o) OVER (PARTITION BY book) * y AS ay FROM e3),
l AS (SELECT *, u * u + coalesce(2 * (5 / 6.0::DOUBLE) * u * lag(u, 1) OVER k, 0) + coalesce(2 * (4 / 6.0::DOUBLE) * u * lag(u, 2) OVER k, 0) + coalesce(2 * (3 / 6.0::DOUBLE) * u * lag(u, 3) OVER k, 0)
  + coalesce(2 * (2 / 6.0::DOUBLE) * u * lag(u, 4) OVER k, 0) + coalesce(2 * (1 / 6.0::DOUBLE) * u * lag(u, 5) OVER k, 0) AS v FROM u WINDOW k AS (PARTITION BY book ORDER BY date))
SELECT book, sum(ay) AS alpha_daily, sum(ay) / sqrt(sum(v)) AS t, any_value(beta1) AS beta1, any_value(beta2) AS beta2, any_value(beta3) AS beta3,
 1 - sum(e * e) / sum(cy * cy) AS r2, count(*) AS n_obs FROM l GROUP BY 1
"""

query("factor_regression", "E15 J14", """
SELECT book, round(alpha_daily * 252, 6) AS alpha_annual, round(t, 6) AS alpha_tstat, abs(t) > 1.959963984540054 AS alpha_significant, round(alpha_p, 6) AS alpha_pvalue, round(beta1, 6) AS beta_mkt,
 round(beta2, 6) AS beta_smb, round(beta3, 6) AS beta_hml, round(r2, 6) AS r2, n_obs FROM (
 SELECT *, u * (0.254829592::DOUBLE + u * (-0.284496736::DOUBLE + u * (1.421413741::DOUBLE + u * (-1.453152027::DOUBLE + u * 1.061405429::DOUBLE)))) * exp(-t * t / 2) AS alpha_p
 FROM (SELECT *, 1 / (1 + 0.3275911::DOUBLE * abs(t) / sqrt(2.0::DOUBLE)) AS u FROM regression))""", "regression")(
    lambda t: r6(M.factor_regression(study(t).equal_daily, factors(t)).drop("alpha_daily")))

query("price_on_or_before", "J7", """
WITH t AS (SELECT DISTINCT ticker, make_date(year(date), 3, 15) AS target FROM prices)
SELECT t.ticker, t.target, p.date AS price_date, round(p.adj_close, 6) AS price
FROM t ASOF LEFT JOIN prices p ON t.ticker = p.ticker AND t.target >= p.date""", "prices")(
    lambda t: A.last_on_or_before(
        t.prices.select("ticker", F.make_date(F.year("date"), F.lit(3), F.lit(15)).alias("target")).distinct(),
        t.prices.withColumn("price_date", F.col("date")), "ticker", "target", "date",
        {"price_date": "price_date", "adj_close": "price"}).withColumn("price", F.round("price", 6)))

query("banded_quantiles", "A5", """
SELECT CAST(year(date) AS INTEGER) AS year, round(quantile_cont(adj_close, 0.05), 6) AS q05,
 round(quantile_cont(adj_close, 0.5), 6) AS q50, round(quantile_cont(adj_close, 0.95), 6) AS q95 FROM prices GROUP BY 1""",
      "prices")(lambda t: r6(exact_quantiles(
          t.prices.withColumn("year", F.year("date")), ["year"], "adj_close",
          {"q05": 0.05, "q50": 0.5, "q95": 0.95}, accuracy=20)))
