"""The broad-universe grid, optimised weights, sweeps."""


from pyspark.sql import functions as F

from pitscreen.catalog.optimised import placed
from pitscreen.catalog.registry import query
from pitscreen.catalog.study import METRICS_SQL, floyd_sql, r6, study
from pitscreen.catalog.views import VIEWS

from pitscreen.operators import baskets as B, evaluate as E, paths as P, scoring as S
from pitscreen.operators.ordering import beside
from pitscreen.plans import grid as G

SPEC = G.GridSpec(market="vietnam", first_year=1997, last_year=2000, k=10, n_draws=60,
                  seed=42, cov_months=36)


def market(t) -> G.Market:
    if "grid_market" not in t.__dict__:
        t.grid_market = G.Market(S.score_panel(t.fundamentals, t.sectors), t.prices, t.sectors, SPEC)
    return t.grid_market


def cell(t) -> G.Cell:
    if "grid_cell" not in t.__dict__:
        t.grid_cell = G.Cell(market(t), SPEC)
    return t.grid_cell


VIEWS["est_sessions"] = """
SELECT y AS formation_year, date, date > make_date(y, 7, 1) - INTERVAL 36 MONTH AS inside
FROM (SELECT DISTINCT date FROM prices), (SELECT CAST(unnest([1997, 1998, 1999, 2000]) AS INTEGER) AS y)
WHERE date >= make_date(y, 7, 1) - INTERVAL 36 MONTH - INTERVAL 7 DAY AND date < make_date(y, 7, 1)
"""
VIEWS["est_counts"] = """
WITH f AS (SELECT s.formation_year, p.ticker, min(p.date) AS first FROM est_sessions s JOIN prices p ON p.date = s.date GROUP BY 1, 2)
SELECT f.formation_year, f.ticker, count(*) FILTER (s.inside AND s.date > f.first) AS n_returns, count(*) FILTER (s.inside) AS sessions
FROM f JOIN est_sessions s ON s.formation_year = f.formation_year GROUP BY 1, 2
"""
VIEWS["eligible"] = """
SELECT s.score_year + 1 AS formation_year, s.ticker, s.fscore, book_value / market_cap AS bm, n_returns, sessions,
 row_number() OVER (PARTITION BY s.score_year ORDER BY fscore DESC, md5(concat_ws(':', 42, s.score_year + 1, s.ticker))) AS rank,
 row_number() OVER (PARTITION BY s.score_year ORDER BY fscore, md5(concat_ws(':', 42, s.score_year + 1, s.ticker)) DESC) AS low_rank,
 row_number() OVER (PARTITION BY s.score_year ORDER BY book_value / market_cap DESC NULLS LAST, s.ticker) AS bm_rank
FROM signals s JOIN fundamentals f ON f.ticker = s.ticker AND f.fiscal_year = s.score_year
JOIN est_counts e ON e.ticker = s.ticker AND e.formation_year = s.score_year + 1
WHERE n_returns >= greatest(126, sessions // 2)
"""
VIEWS["grid_positions"] = """
WITH m AS (
 SELECT formation_year, 'score_EW' AS book, ticker, 1 AS leg FROM eligible WHERE rank <= 10
 UNION ALL SELECT formation_year, 'score_high_EW', ticker, 1 FROM eligible WHERE fscore >= 8
 UNION ALL SELECT formation_year, 'value_EW', ticker, 1 FROM eligible WHERE bm_rank <= 10 AND bm IS NOT NULL
 UNION ALL SELECT formation_year, 'universe_EW', ticker, 1 FROM eligible
 UNION ALL SELECT formation_year, 'score_LS', ticker, 1 FROM eligible WHERE rank <= 10
 UNION ALL SELECT formation_year, 'score_LS', ticker, -1 FROM eligible WHERE low_rank <= 10 AND rank > 10)
SELECT formation_year, book, ticker, leg * 1.0::DOUBLE / count(*) OVER (PARTITION BY formation_year, book, leg) AS w FROM m
"""
GROWTH = VIEWS["growth"]
VIEWS["grid_growth"] = GROWTH.replace("FROM value_set", "FROM eligible")
_swap = lambda text: (text.replace("positions", "grid_positions").replace(" growth", " grid_growth")
                      .replace("drifted", "grid_drifted").replace("book_daily", "grid_daily")
                      .replace("book_metrics", "grid_metrics").replace("book_turnover", "grid_turnover")
                      .replace(" conc ", " grid_conc "))
for _a, _b in (("grid_daily", "book_daily"), ("grid_drifted", "drifted"), ("grid_turnover", "book_turnover"),
               ("grid_conc", "conc"), ("grid_metrics", "book_metrics"), ("grid_summary_view", "book_summary")):
    VIEWS[_a] = _swap(VIEWS[_b])
VIEWS["grid_daily"] += """
UNION ALL SELECT y.formation_year, b.book, s.date, 0.0 FROM (SELECT DISTINCT formation_year FROM eligible) y,
 (SELECT unnest(['score_EW', 'score_high_EW', 'value_EW', 'universe_EW', 'score_LS']) AS book) b JOIN hold_sessions s ON s.formation_year = y.formation_year
WHERE NOT EXISTS (SELECT 1 FROM grid_positions p WHERE p.formation_year = y.formation_year AND p.book = b.book)
"""
VIEWS["grid_draws"] = floyd_sql(
    "SELECT formation_year, count(*) AS size, 10 AS k_eff FROM eligible GROUP BY 1",
    "SELECT formation_year, ticker FROM eligible", 60, "grid", 10)
VIEWS["other_draws"] = floyd_sql(
    "SELECT formation_year, count(*) AS size, 10 AS k_eff FROM eligible WHERE rank > 10 GROUP BY 1 HAVING count(*) >= 10",
    "SELECT formation_year, ticker FROM eligible WHERE rank > 10", 60, "others", 10)
for _n in ("grid", "other"):
    VIEWS[f"{_n}_draw_daily"] = VIEWS["draw_daily"].replace("random_draws", f"{_n}_draws").replace(" growth", " grid_growth")
    VIEWS[f"{_n}_draw_metrics"] = METRICS_SQL.format(by="draw", src=f"{_n}_draw_daily")
VIEWS["grid_mc_turnover"] = """
SELECT a.formation_year, a.draw, 1 - count(b.ticker) / 10.0::DOUBLE AS turnover FROM grid_draws a
LEFT JOIN grid_draws b ON b.draw = a.draw AND b.ticker = a.ticker AND b.formation_year = a.formation_year - 1
WHERE a.draw < 500 AND a.formation_year > 1997 GROUP BY 1, 2
"""

query("estimation_eligibility", "B2 W7", """
SELECT e.formation_year, e.ticker, n_returns, sessions FROM est_counts e JOIN signals s
 ON s.ticker = e.ticker AND s.score_year + 1 = e.formation_year WHERE n_returns >= greatest(126, sessions // 2)""",
      "est_counts signals")(lambda t: market(t).series.select(YEAR := "formation_year", "ticker", "n_returns", "sessions"))

query("grid_baskets", "B3 K2 K3 K6 B12", "SELECT formation_year, book, ticker, round(w, 6) AS w FROM grid_positions",
      "grid_positions")(lambda t: r6(cell(t).positions(optimised=False)))

query("grid_draws", "B5 B16", "SELECT * FROM grid_draws", "grid_draws")(lambda t: cell(t).draws)

query("grid_draws_other_names", "B6 J4", "SELECT * FROM other_draws", "other_draws")(
    lambda t: cell(t).draws_excluding)

query("grid_summary", "E11 E18 E9", """
SELECT book, n_days, round(ann_return, 6) AS ann_return, round(ann_vol, 6) AS ann_vol, round(sharpe, 6) AS sharpe,
 round(max_drawdown, 6) AS max_drawdown, round(effective_n, 6) AS effective_n, round(turnover, 6) AS turnover,
 round(cost_drag, 6) AS cost_drag, round(net_sharpe, 6) AS net_sharpe, coalesce(nominal_k, 0) AS nominal_k FROM grid_summary_view""", "grid_summary_view")(
    lambda t: r6(cell(t).summary(optimised=False).select(
        "book", "n_days", "ann_return", "ann_vol", "sharpe", "max_drawdown", "effective_n", "turnover",
        "cost_drag", "net_sharpe", "nominal_k")))

query("grid_random_metrics", "B16 T15", """
SELECT draw, n_days, round(ann_return, 6) AS ann_return, round(ann_vol, 6) AS ann_vol, round(sharpe, 6) AS sharpe FROM grid_draw_metrics""",
      "grid_draw_metrics")(lambda t: r6(cell(t).draw_metrics.select(
          F.col("book").alias("draw"), "n_days", "ann_return", "ann_vol", "sharpe")))

query("random_turnover", "E7 J16", "SELECT formation_year, draw, round(turnover, 6) AS turnover FROM grid_mc_turnover",
      "grid_mc_turnover")(lambda t: r6(E.random_turnover(cell(t).draws)))

query("cost_of_random_control", "E8", """
SELECT round(avg(turnover), 6) AS mc_turnover, round(2 * avg(turnover) * 0.0020, 6) AS mc_cost_drag FROM grid_mc_turnover""",
      "grid_mc_turnover")(lambda t: r6(cell(t).draw_cost()))

query("grid_placement", "E2 E3 E9", """
WITH c AS (SELECT 2 * avg(turnover) * 0.0020 AS drag FROM grid_mc_turnover),
s AS (SELECT * FROM (SELECT unnest([{'metric': 'ann_return', 'basis': 'gross', 'stat': ann_return}, {'metric': 'sharpe', 'basis': 'gross', 'stat': sharpe},
  {'metric': 'ann_return', 'basis': 'net', 'stat': net_ann_return}, {'metric': 'sharpe', 'basis': 'net', 'stat': net_sharpe}], recursive := true)
  FROM grid_summary_view WHERE book = 'score_EW')),
a AS (SELECT 'random (full universe)' AS pool, * FROM grid_draw_metrics UNION ALL SELECT 'random (other names)', * FROM other_draw_metrics),
d AS (SELECT pool, unnest([{'metric': 'ann_return', 'basis': 'gross', 'v': ann_return}, {'metric': 'sharpe', 'basis': 'gross', 'v': sharpe},
  {'metric': 'ann_return', 'basis': 'net', 'v': ann_return - drag}, {'metric': 'sharpe', 'basis': 'net', 'v': (ann_return - drag) / ann_vol}], recursive := true) FROM a, c)
SELECT pool, d.metric, d.basis, round(stat, 6) AS stat, round(avg(CASE WHEN v < stat THEN 1.0 ELSE 0.0 END), 6) AS percentile,
 round(avg(CASE WHEN v >= stat THEN 1.0 ELSE 0.0 END), 6) AS p_value, count(*) AS n_draws, round(avg(v), 6) AS random_mean
FROM s JOIN d ON d.metric = s.metric AND d.basis = s.basis GROUP BY pool, d.metric, d.basis, stat""",
      "grid_summary_view grid_draw_metrics other_draw_metrics grid_mc_turnover")(
    lambda t: r6(cell(t).placement().select("pool", "metric", "basis", "stat", "percentile", "p_value",
                                            "n_draws", "random_mean")))

query("grid_yearly_returns", "E12", """
SELECT book, CAST(year(date) AS INTEGER) AS year, round(product(1 + r) - 1, 6) AS ret FROM grid_daily GROUP BY 1, 2""", "grid_daily")(
    lambda t: r6(cell(t).yearly_returns(optimised=False)))

query("holding_year_returns", "E12", """
SELECT book, formation_year AS year, round(product(1 + r) - 1, 6) AS ret FROM grid_daily GROUP BY 1, 2""", "grid_daily")(
    lambda t: r6(E.calendar_year_returns(cell(t).daily(False), ["book"],
                                         F.col("formation_year"))))

query("grid_diagnostics", "E19", """
WITH h AS (SELECT DISTINCT e.formation_year, e.ticker FROM eligible e JOIN prices p ON p.ticker = e.ticker
  AND p.date >= make_date(formation_year, 7, 1) - 7 AND p.date <= make_date(formation_year + 1, 6, 30)),
st AS (SELECT s.score_year + 1 AS fy, s.ticker, max(p.date) AS last FROM signals s JOIN prices p ON p.ticker = s.ticker
  AND p.date >= make_date(s.score_year + 1, 7, 1) - 7 AND p.date <= make_date(s.score_year + 2, 6, 30) GROUP BY 1, 2),
en AS (SELECT fy, max(last) AS e0 FROM st GROUP BY 1),
cal AS (SELECT s.fy, (SELECT max(date) FROM prices WHERE date <= make_date(s.fy + 1, 6, 30)) AS e FROM en s),
dl AS (SELECT st.fy, count(*) FILTER (last < e) AS n FROM st JOIN cal ON cal.fy = st.fy GROUP BY 1),
ov AS (SELECT d.formation_year, count(e.ticker) / count(*) AS o FROM grid_draws d LEFT JOIN eligible e
  ON e.formation_year = d.formation_year AND e.ticker = d.ticker AND e.rank <= 10 GROUP BY 1),
cut AS (SELECT formation_year, min(fscore) FILTER (rank = 10) AS c FROM eligible GROUP BY 1)
SELECT e.formation_year, count(*) AS universe, count(bm) AS bm_coverage, round(avg(e.fscore), 6) AS fscore_mean, min(e.fscore) FILTER (rank <= 10) AS score_basket_min,
 count(*) FILTER (e.fscore >= 8) AS n_score_high, count(*) FILTER (bm_rank <= 10 AND bm IS NOT NULL) AS value_basket_size, max(e.fscore) FILTER (low_rank <= 10) AS short_leg_max,
 10 - count(*) FILTER (e.fscore > c) AS tie_break_slots, round(median(n_returns), 6) AS cov_est_days, CAST(max(greatest(126, sessions // 2)) AS INTEGER) AS cov_min_est_days,
 any_value(dl.n) AS delisted_in_holding_year, count(*) - count(h.ticker) AS no_price_after_formation, count(*) FILTER (low_rank <= 10 AND rank > 10) AS short_leg_names,
 (SELECT count(*) FROM signals s WHERE s.score_year + 1 = e.formation_year) - count(*) AS dropped_no_price, false AS value_fallback, round(any_value(o), 6) AS overlap_random,
 round(10.0 / count(*), 6) AS overlap_expected, count(*) FILTER (low_rank <= 10 AND rank > 10) > 0 AS long_short_run
FROM eligible e LEFT JOIN h ON h.formation_year = e.formation_year AND h.ticker = e.ticker JOIN ov ON ov.formation_year = e.formation_year
JOIN cut ON cut.formation_year = e.formation_year LEFT JOIN dl ON dl.fy = e.formation_year GROUP BY 1""", "eligible grid_draws")(
    lambda t: r6(cell(t).diagnostics()))

query("book_overlap", "J16 O2", """
SELECT a.formation_year, count(*) AS shared, round(count(*) / 10.0::DOUBLE, 6) AS share FROM grid_positions a JOIN grid_positions b
 ON b.formation_year = a.formation_year AND b.ticker = a.ticker AND b.book = 'value_EW' WHERE a.book = 'score_EW' GROUP BY 1""", "grid_positions")(
    lambda t: r6(G.score_overlap(market(t), cell(t).baskets["score"].select("formation_year", "ticker"),
                                 cell(t).baskets["value"], 10)))

VIEWS["seed_sweep"] = """
WITH r AS (SELECT e.formation_year, e.ticker, seed, row_number() OVER (PARTITION BY formation_year, seed
   ORDER BY fscore DESC, md5(concat_ws(':', seed, formation_year, ticker))) AS rk FROM eligible e, (SELECT unnest([42, 43, 44]) AS seed)),
v AS (SELECT r.formation_year, seed, g.date, avg(g.g) AS value FROM r JOIN grid_growth g ON g.formation_year = r.formation_year AND g.ticker = r.ticker
  WHERE rk <= 10 GROUP BY ALL),
d AS (SELECT *, value / coalesce(lag(value) OVER (PARTITION BY formation_year, seed ORDER BY date), 1.0) - 1 AS r FROM v),
m AS (""" + METRICS_SQL.format(by="seed", src="d") + """)
SELECT CAST(seed AS INTEGER) AS seed, round(m.sharpe, 6) AS sharpe, round(m.ann_return, 6) AS ann_return, round(avg(CASE WHEN g.sharpe < m.sharpe THEN 1.0 ELSE 0.0 END), 6) AS percentile,
 round(avg(CASE WHEN g.sharpe >= m.sharpe THEN 1.0 ELSE 0.0 END), 6) AS p_value, avg(CASE WHEN g.sharpe >= m.sharpe THEN 1.0 ELSE 0.0 END) < 0.05 AS significant
FROM m, grid_draw_metrics g GROUP BY seed, m.sharpe, m.ann_return"""


def seed_sweep(t):
    return r6(G.tie_break_sweep(market(t), SPEC, [42, 43, 44]).drop("mean_tie_break_slots", "years_fully_tie_broken"))


query("tie_break_seed_sweep", "E21", "SELECT * FROM seed_sweep", "seed_sweep")(seed_sweep)

query("seed_spread", "A17", """
SELECT measure, min(v) AS min, round(median(v), 6) AS median, max(v) AS max, round(stddev_samp(v), 6) AS std
FROM (UNPIVOT (SELECT sharpe, ann_return, percentile, p_value FROM seed_sweep) ON COLUMNS(*) INTO NAME measure VALUE v) GROUP BY 1""",
      "seed_sweep")(lambda t: r6(G.spread(seed_sweep(t), ["sharpe", "ann_return", "percentile", "p_value"])))

# ---- optimised weights, beside an independent solution in SQL (catalog/optimised.py) ----


@query("optimised_book_invariants", "B8 B9 B10 B11", """
WITH w AS (SELECT w.*, NULL::VARCHAR AS sector FROM gmv_weights w
  UNION ALL SELECT w.*, coalesce(s.sector, 'Unknown') FROM capped_weights w LEFT JOIN sectors s ON s.ticker = w.ticker),
c AS (SELECT formation_year, book, sector, sum(w) AS sw, count(*) OVER (PARTITION BY formation_year, book) AS n_sectors FROM w GROUP BY 1, 2, 3)
SELECT w.formation_year, w.book, count(*) AS names, round(sum(w.w), 6) AS total, min(w.w) >= 0 AS long_only,
 CASE WHEN w.book = 'score_GMVsec' THEN (SELECT max(sw) <= max(greatest(0.2, 1.0 / n_sectors + 1e-6)) + 1e-5 FROM c
   WHERE c.formation_year = w.formation_year AND c.book = w.book) END AS within_caps
FROM w GROUP BY w.formation_year, w.book""", "gmv_weights capped_weights sectors")
def _invariants(t):
    s = study(t)
    pos = s.optimised_positions("GMV").unionByName(s.optimised_positions("GMVsec"))
    per_sector = pos.join(t.sectors.select("ticker", "sector"), "ticker", "left").groupBy(
        "formation_year", "book", F.coalesce("sector", F.lit("Unknown")).alias("sector")).agg(
        F.sum("w").alias("sw"), F.min("w").alias("mw"), F.count("*").alias("n"))
    cap = F.greatest(F.lit(0.20), 1 / F.count("*") + 1e-6)
    return per_sector.groupBy("formation_year", "book").agg(
        F.sum("n").alias("names"), F.round(F.sum("sw"), 6).alias("total"), (F.min("mw") >= 0).alias("long_only"),
        F.when(F.col("book") == "score_GMVsec", F.max("sw") <= cap + 1e-9).alias("within_caps"))


@query("universe_weight_invariants", "B9 E18", """
SELECT formation_year, count(*) AS names, round(sum(w), 6) AS total, min(w) >= 0 AS long_only, sum(w * w) >= 1.0 / count(*) - 1e-12 AS concentrates
FROM universe_weights GROUP BY 1""", "universe_weights")
def _universe_invariants(t):
    w = market(t).universe_gmv
    return w.groupBy("formation_year").agg(
        F.count("*").alias("names"), F.round(F.sum("w"), 6).alias("total"), (F.min("w") >= 0).alias("long_only"),
        (F.sum(F.col("w") * F.col("w")) >= 1 / F.count("*") - 1e-12).alias("concentrates"))


@query("gain_does_not_depend_on_draws", "E4 E22 E23", """
SELECT replace(book, 'k', '')::INTEGER AS k, round(gain, 6) AS least_gain, round(gain, 6) AS most_gain FROM swept_gain""", "swept_gain")
def _gain_invariance(t):
    """The gain of a basket size, over cells that differ in the number of draws: one value, the one of the SQL."""
    from pitscreen.catalog.reports import swept

    return r6(swept(t).groupBy("k").agg(F.min("D").alias("least_gain"), F.max("D").alias("most_gain")))



query("minimum_variance_weights", "B8 B9 B11", "SELECT formation_year, book, ticker, round(w, 6) AS w FROM gmv_weights", "gmv_weights")(
    lambda t: r6(study(t).optimised_positions("GMV")))
query("sector_capped_weights", "B10", "SELECT formation_year, book, ticker, round(w, 3) AS w FROM capped_weights", "capped_weights")(
    lambda t: study(t).optimised_positions("GMVsec").withColumn("w", F.round("w", 3)))
query("universe_minimum_variance", "B9 E18", "SELECT formation_year, book, ticker, round(w, 6) AS w FROM universe_weights", "universe_weights")(
    lambda t: r6(market(t).universe_gmv))
query("optimised_study_summary", "E11 E17")(lambda t: study(t).summary())
query("paired_optimisation_gain", "E4", placed("study_pair"), "study_pair_gain")(lambda t: r6(study(t).synergy("GMV")))
query("grid_paired_gain", "E4 E22", placed("grid_pair"), "grid_pair_gain")(lambda t: r6(cell(t).synergy()))
query("grid_sweep", "E18 E23")(lambda t: G.sweep(market(t), SPEC, [8, 10], [20, 40]))
