"""Report tables over the study and the grid."""

import re

from pyspark.sql import functions as F

from pitscreen.catalog.chain import chain
from pitscreen.catalog.grid import SPEC as GRID_SPEC, cell, market
from pitscreen.catalog.registry import query
from pitscreen.catalog.series import bench
from pitscreen.catalog.study import METRICS_SQL, PANEL_SQL, r6, study
from pitscreen.catalog.views import VIEWS
from pitscreen.operators import evaluate as E, report as R, scoring as S, tables as O, universe as U
from pitscreen.plans import grid as G

NAMES = ["ann_return", "sharpe", "max_drawdown"]


def headline(t):
    """The same study over fewer formations."""
    return study(t, first_year=1998)


def swept(t):
    if "swept" not in t.__dict__:
        from pitscreen.session import land

        t.swept = land(G.sweep(market(t), GRID_SPEC, [8, 10], [20, 40]), "sweep")
    return t.swept


VIEWS["head_daily"] = "SELECT * FROM book_daily WHERE formation_year >= 1998"
VIEWS["head_metrics"] = METRICS_SQL.format(by="book", src="head_daily")
VIEWS["head_draws"] = "SELECT * FROM draw_daily WHERE formation_year >= 1998"
VIEWS["head_draw_metrics"] = METRICS_SQL.format(by="draw", src="head_draws")

query("publishable_panel", "E27 W12", """
WITH p AS (""" + PANEL_SQL.replace("round(CASE WHEN market_cap > 0 THEN book_value / market_cap END, 6) AS bm", "CASE WHEN market_cap > 0 THEN book_value / market_cap END AS bm") + """)
SELECT score_year, fiscal_year, ticker, fscore, f_roa, f_cfo, f_droa, f_accrual, f_dlever, f_dliquid, f_eq_offer, f_dmargin, f_dturn, sector,
 CASE WHEN bm IS NOT NULL THEN CAST(row_number() OVER (PARTITION BY score_year ORDER BY -bm NULLS LAST, md5(ticker), ticker) AS INTEGER) END AS bm_rank FROM p""",
      "signals sectors membership")(
    lambda t: R.publishable_panel(S.score_panel(t.fundamentals, t.sectors, t.membership)))

FEASIBILITY_SQL = """
WITH y AS (SELECT CAST(unnest(range(1995, 2003)) AS INTEGER) AS formation_year),
f AS (SELECT formation_year, count(*) AS n FROM pit GROUP BY 1), u AS (SELECT formation_year, count(*) AS n FROM universe GROUP BY 1), v AS (SELECT formation_year, count(*) AS n FROM value_set GROUP BY 1),
a AS (SELECT y.formation_year, coalesce(f.n, 0) AS s, coalesce(u.n, 0) AS universe, coalesce(v.n, 0) AS value_names FROM y LEFT JOIN f USING (formation_year) LEFT JOIN u USING (formation_year) LEFT JOIN v USING (formation_year)),
r AS (SELECT *, CASE WHEN s = 0 THEN 'no point-in-time statements' WHEN value_names < 10 THEN 'high-B/M subset ' || value_names || ' < basket 10'
 WHEN make_date(formation_year + 1, 6, 30) > DATE '2000-12-31' THEN 'holding year ends ' || (formation_year + 1) || '-06-30, past the 2000-12-31 evaluation end' ELSE '' END AS reason FROM a)
"""

query("formation_feasibility", "N15", FEASIBILITY_SQL + """
SELECT formation_year, universe, value_names, reason = '' AS usable, reason FROM r""", "pit universe value_set")(
    lambda t: U.feasibility(study(t).value_set, study(t).snapshot, study(t).universe, t.prices, 10, 1995, 2002, "2000-12-31"))

query("feasibility_table", "E24", FEASIBILITY_SQL + """
SELECT 'us' AS market, count(*) AS examined, count(*) FILTER (reason = '') AS usable, min(formation_year) FILTER (reason = '') AS first_usable, max(formation_year) FILTER (reason = '') AS last_usable,
 count(*) FILTER (s = 0) AS no_statements, count(*) FILTER (reason LIKE '%evaluation end%') AS past_end, count(*) FILTER (reason LIKE 'high%') AS other FROM r""", "pit universe value_set")(
    lambda t: R.feasibility_table(U.feasibility(study(t).value_set, study(t).snapshot, study(t).universe, t.prices, 10, 1995, 2002, "2000-12-31")
                                  .withColumn("market", F.lit("us"))))

query("study_diagnostics", "E19 E24", """
WITH u AS (SELECT formation_year, count(*) AS universe FROM universe GROUP BY 1), v AS (SELECT formation_year, count(*) AS value_set FROM value_set GROUP BY 1),
c AS (SELECT formation_year, min(fscore) FILTER (rank = k_eff) AS c FROM scored GROUP BY 1),
l AS (SELECT v.formation_year, v.ticker, max(p.date) AS last FROM value_set v JOIN prices p ON p.ticker = v.ticker AND p.date >= make_date(formation_year, 7, 1) - 7
  AND p.date <= make_date(formation_year + 1, 6, 30) GROUP BY 1, 2),
d AS (SELECT formation_year, count(*) FILTER (last < (SELECT max(date) FROM prices WHERE date <= make_date(formation_year + 1, 6, 30))) AS n FROM l GROUP BY 1)
SELECT s.formation_year, any_value(universe) AS universe, any_value(value_set) AS value_set, count(*) AS scored, round(avg(fscore), 6) AS fscore_mean, any_value(k_eff) - count(*) FILTER (fscore > c) AS tie_break_slots,
 any_value(d.n) AS delisted_in_holding_year, count(*) FILTER (rank <= 10) AS k, min(fscore) FILTER (rank <= 10) AS fscore_basket_min, count(*) FILTER (low_rank <= 10 AND rank > 10) AS short_leg_names,
 count(*) FILTER (low_rank <= 10 AND rank > 10) > 0 AS long_short_run
FROM scored s JOIN u USING (formation_year) JOIN v USING (formation_year) JOIN c USING (formation_year) JOIN d USING (formation_year) GROUP BY 1""", "universe value_set scored")(
    lambda t: r6(study(t).diagnostics().drop("cov_est_days")))

query("performance_table", "E24 E3", """
WITH s AS (SELECT unnest([{'metric': 'ann_return', 'stat': ann_return}, {'metric': 'sharpe', 'stat': sharpe}, {'metric': 'max_drawdown', 'stat': max_drawdown}], recursive := true) FROM book_metrics WHERE book = 'score_EW'),
d AS (SELECT unnest([{'metric': 'ann_return', 'v': ann_return}, {'metric': 'sharpe', 'v': sharpe}, {'metric': 'max_drawdown', 'v': max_drawdown}], recursive := true) FROM draw_metrics),
p AS (SELECT metric, avg(CASE WHEN v >= stat THEN 1.0 ELSE 0.0 END) AS p FROM s JOIN d USING (metric) GROUP BY metric, stat)
SELECT b.book, round(ann_return, 6) AS ann_return, round(sharpe, 6) AS sharpe, round(effective_n, 6) AS effective_n, round(CASE WHEN book = 'score_EW' THEN (SELECT p FROM p WHERE metric = 'sharpe') END, 6) AS sharpe_p,
 round(CASE WHEN book = 'score_EW' THEN (SELECT p FROM p WHERE metric = 'max_drawdown') END, 6) AS max_drawdown_p FROM book_summary b""", "book_summary book_metrics draw_metrics")(
    lambda t: r6(R.performance_table(study(t).summary(equal_only=True), study(t).placement()).select(
        "book", "ann_return", "sharpe", "effective_n", "sharpe_p", "max_drawdown_p")))

query("full_period_robustness", "E20", """
WITH p AS (SELECT 'score_EW' AS book, avg(CASE WHEN d.sharpe < b.sharpe THEN 1.0 ELSE 0.0 END) AS pct, avg(CASE WHEN d.sharpe >= b.sharpe THEN 1.0 ELSE 0.0 END) AS p FROM draw_metrics d, (SELECT sharpe FROM book_metrics WHERE book = 'score_EW') b),
q AS (SELECT 'score_EW' AS book, avg(CASE WHEN d.sharpe < b.sharpe THEN 1.0 ELSE 0.0 END) AS pct, avg(CASE WHEN d.sharpe >= b.sharpe THEN 1.0 ELSE 0.0 END) AS p FROM head_draw_metrics d, (SELECT sharpe FROM head_metrics WHERE book = 'score_EW') b)
SELECT f.book, round(f.sharpe, 6) AS full_sharpe, round(f.ann_return, 6) AS full_ann_return, round(h.sharpe, 6) AS headline_sharpe, round(h.ann_return, 6) AS headline_ann_return, round(f.sharpe - h.sharpe, 6) AS sharpe_delta,
 round(p.pct, 6) AS full_percentile, round(p.p, 6) AS full_p_value, round(q.pct, 6) AS headline_percentile, round(q.p, 6) AS headline_p_value
FROM book_metrics f JOIN head_metrics h USING (book) LEFT JOIN p USING (book) LEFT JOIN q USING (book)""", "book_metrics head_metrics draw_metrics head_draw_metrics")(
    lambda t: r6(R.full_period(study(t).summary(equal_only=True), headline(t).summary(equal_only=True),
                               study(t).placement().withColumn("book", F.lit("score_EW")),
                               headline(t).placement().withColumn("book", F.lit("score_EW")))))

query("sample_windows", "E24", """
SELECT 'us' AS market, min(formation_year) FILTER (formation_year >= 1998) AS headline_first, max(formation_year) FILTER (formation_year >= 1998) AS headline_last,
 count(DISTINCT formation_year) FILTER (formation_year >= 1998) AS headline_formations, min(formation_year) AS full_first, max(formation_year) AS full_last, count(DISTINCT formation_year) AS full_formations FROM universe""", "universe")(
    lambda t: R.sample_windows(headline(t).universe.withColumn("market", F.lit("us")), study(t).universe.withColumn("market", F.lit("us"))))

query("cross_country", "E24", """
SELECT m.market, book, round(sharpe, 6) AS sharpe FROM book_metrics, (SELECT unnest(['us', 'japan']) AS market) m
UNION ALL SELECT 'vietnam', book, round(sharpe, 6) FROM grid_metrics""", "book_metrics grid_metrics")(
    lambda t: r6((lambda a, b: R.cross_country({"us": a, "japan": a, "vietnam": b}))(
        study(t).summary(equal_only=True).select("book", "sharpe"), cell(t).summary(optimised=False).select("book", "sharpe"))
        .select("market", "book", "sharpe")))

query("coverage_stats", "E26", """
WITH o AS (SELECT d.formation_year, count(e.ticker) / count(*) AS o FROM grid_draws d LEFT JOIN eligible e ON e.formation_year = d.formation_year AND e.ticker = d.ticker AND e.rank <= 10 GROUP BY 1),
c AS (SELECT formation_year, min(fscore) FILTER (rank = 10) AS c FROM eligible GROUP BY 1),
y AS (SELECT e.formation_year, count(*) AS n, any_value(o) AS o, 10 - count(*) FILTER (fscore > c) AS slots, count(*) FILTER (fscore >= 8) AS high FROM eligible e JOIN o USING (formation_year) JOIN c USING (formation_year) GROUP BY 1)
SELECT 'vietnam' AS market, min(n) AS universe_min, max(n) AS universe_max, round(avg(o), 6) AS overlap_random, round(avg(slots), 6) AS tie_break_slots, 0::BIGINT AS value_fallbacks, round(avg(high), 6) AS n_score_high FROM y""",
      "eligible grid_draws")(lambda t: r6(R.coverage_stats(cell(t).diagnostics().withColumn("market", F.lit("vietnam")))))

query("exclusions_by_market", "E24 N12", """
SELECT 'us' AS market, count(*) AS scored, 0::BIGINT AS dropped_failed_accounting_checks, count(*) AS held FROM signals
UNION ALL SELECT 'vietnam', count(*) FILTER (investable), count(*) FILTER (signals_available IS NULL), count(*) FROM vextract LEFT JOIN vfinal USING (symbol, period)""", "signals vextract vfinal")(
    lambda t: O.ledger_totals(O.align_ledgers([
        S.scoring_ledger(t.fundamentals).select("score_year", "scored", "dropped_incomplete_signals").withColumn("market", F.lit("us")),
        chain(t).ledger().drop("rows_in_source").withColumn("market", F.lit("vietnam"))], ["scored"]), ["market"])
    .select("market", "scored", "dropped_failed_accounting_checks", "held"))

query("broad_universe_table", "E24", """
SELECT book, round(sharpe, 6) AS sharpe, round(turnover, 6) AS turnover, round(CASE WHEN book = 'score_EW' THEN (SELECT avg(CASE WHEN d.sharpe >= g.sharpe THEN 1.0 ELSE 0.0 END) FROM grid_draw_metrics d) END, 6) AS p_full_universe,
 round(CASE WHEN book = 'score_EW' THEN (SELECT avg(CASE WHEN d.sharpe >= g.sharpe THEN 1.0 ELSE 0.0 END) FROM other_draw_metrics d) END, 6) AS p_other_names FROM grid_summary_view g""",
      "grid_summary_view grid_draw_metrics other_draw_metrics")(
    lambda t: r6(R.broad_universe(cell(t).summary(optimised=False), cell(t).placement()).select(
        "book", "sharpe", "turnover", "p_full_universe", "p_other_names")))

query("score_histogram", "E29 A7", "SELECT formation_year, fscore, count(*) AS names FROM scored GROUP BY 1, 2", "scored")(
    lambda t: R.score_histogram(study(t).scored))

query("score_describe", "E29 A6", """
SELECT formation_year, count(fscore) AS count, round(avg(fscore), 6) AS mean, round(stddev_samp(fscore), 6) AS std, min(fscore) AS min, round(quantile_cont(fscore, 0.25), 6) AS p25, round(quantile_cont(fscore, 0.5), 6) AS p50,
 round(quantile_cont(fscore, 0.75), 6) AS p75, max(fscore) AS max FROM scored GROUP BY 1""", "scored")(
    lambda t: r6(R.score_describe(study(t).scored)))

query("random_ratio_histogram", "E29", """
WITH e AS (SELECT min(sharpe) AS lo, max(sharpe) AS hi FROM draw_metrics), b AS (SELECT CAST(least(floor((sharpe - lo) / ((hi - lo) / 10)) + 1, 10) AS INTEGER) AS bin, lo, hi FROM draw_metrics, e)
SELECT bin, round(any_value(lo) + (bin - 1) * ((any_value(hi) - any_value(lo)) / 10), 6) AS "left", count(*) AS draws FROM b GROUP BY 1""", "draw_metrics")(
    lambda t: r6(R.ratio_histogram(E.metrics(study(t).draw_daily("EW"), ["book"]), "sharpe", 10)))

query("best_benchmark", "E26", """
WITH n AS (SELECT *, product(1 + r) OVER (PARTITION BY ticker ORDER BY date) AS nav FROM bench_returns),
m AS (SELECT ticker, (product(1 + r) ** (252.0 / count(*)) - 1) / (stddev_samp(r) * sqrt(252)) AS sharpe FROM n GROUP BY 1), o AS (SELECT sharpe AS own FROM book_metrics WHERE book = 'score_EW')
SELECT max_by(ticker, sharpe) AS best, round(max(sharpe), 6) AS best_sharpe, round(any_value(own), 6) AS own, any_value(own) > max(sharpe) AS above FROM m, o""", "bench_returns book_metrics")(
    lambda t: r6(R.best_benchmark(E.metrics(bench(t), ["ticker"]).withColumnRenamed("ticker", "book"),
                                  study(t).summary(equal_only=True).where(F.col("book") == "score_EW"))))

query("price_windows", "N14", """
WITH n AS (SELECT DISTINCT score_year + 1 AS fy, ticker FROM signals),
d AS (SELECT fy, date, row_number() OVER (PARTITION BY fy ORDER BY date) AS s FROM (SELECT DISTINCT fy, p.date FROM (SELECT DISTINCT fy FROM n) n, prices p WHERE p.date >= make_date(fy, 7, 1) - INTERVAL 36 MONTH AND p.date < make_date(fy, 7, 1))),
w AS (SELECT fy, max(s) - 1 AS t FROM d GROUP BY 1),
f AS (SELECT n.fy, n.ticker, min(d.s) AS f FROM n JOIN prices p ON p.ticker = n.ticker JOIN d ON d.fy = n.fy AND d.date = p.date GROUP BY 1, 2),
e AS (SELECT n.fy, n.ticker, f, t, t + 1 - f >= greatest(126, t // 2) AS ok FROM n LEFT JOIN f USING (fy, ticker) JOIN w ON w.fy = n.fy)
SELECT fy AS formation_year, count(*) AS universe, any_value(t) AS window_sessions, greatest(126, any_value(t) // 2) AS min_required, count(*) FILTER (ok) AS eligible, any_value(t) + 1 - max(f) FILTER (ok) AS usable_obs,
 (SELECT count(DISTINCT date) FROM prices WHERE date >= make_date(fy, 7, 1) AND date <= make_date(fy + 1, 6, 30)) AS holding_sessions, count(*) - count(*) FILTER (ok) AS dropped_no_price,
 (SELECT max(date) FROM prices) >= make_date(fy + 1, 6, 30) AS holding_complete, round(count(*) FILTER (ok) / (any_value(t) + 1 - max(f) FILTER (ok)), 2) AS q_universe,
 round(20 / (any_value(t) + 1 - max(f) FILTER (ok)), 3) AS q_k20, round(30 / (any_value(t) + 1 - max(f) FILTER (ok)), 3) AS q_k30 FROM e GROUP BY 1""", "signals prices")(
    lambda t: R.price_windows(S.nine_signals(t.fundamentals), t.prices))

# These rest on optimised weights and have no SQL equivalent.
query("grid_table", "E23 E24")(lambda t: R.grid_table(swept(t), [20, 40]))
query("grid_findings", "E26")(lambda t: R.findings(swept(t)))
query("gain_table", "E22 O4")(lambda t: O.upsert(
    R.gain_per_k(swept(t).withColumn("mkt", F.lit("us"))), R.gain_per_k(swept(t)).unionByName(
        R.gain_rows(study(t).synergy("GMV"), "vietnam", "main study (high-B/M subset)", "k=10, GMV"), allowMissingColumns=True), "market")[0])

# the study's views once more, with issuance read from share counts
CHAIN = ["signals", "scored", "liquid_match", "positions", "book_daily", "drifted", "book_metrics", "book_turnover",
         "conc", "book_summary"]
for _v in CHAIN:
    VIEWS[f"count_{_v}"] = re.sub(rf"\b({'|'.join(CHAIN)})\b", r"count_\1", VIEWS[_v]).replace(
        "equity_issued IS NOT NULL", "false")
HEADLINE = """SELECT '{label}' AS measure, round(ann_return, 6) AS ann_return, round(sharpe, 6) AS sharpe, round(net_sharpe, 6) AS net_sharpe,
 (SELECT round(avg(CASE WHEN d.sharpe < s.sharpe THEN 1.0 ELSE 0.0 END), 6) FROM draw_metrics d) AS percentile,
 (SELECT round(avg(CASE WHEN d.sharpe >= s.sharpe THEN 1.0 ELSE 0.0 END), 6) FROM draw_metrics d) AS p_value,
 (SELECT avg(CASE WHEN d.sharpe >= s.sharpe THEN 1.0 ELSE 0.0 END) < 0.05 FROM draw_metrics d) AS significant
FROM {view} s WHERE book = 'score_EW'"""
query("issuance_headline", "C8 E24", HEADLINE.format(label="cash_flow", view="book_summary") + " UNION ALL "
      + HEADLINE.format(label="share_count", view="count_book_summary"),
      "book_summary count_book_summary draw_metrics")(lambda t: r6(_issuance_headline(t)))


def _issuance_headline(t):
    """The study under each issuance measure."""
    from pitscreen.catalog.study import SPEC
    from pitscreen.plans.study import Study

    out = None
    for label, f in (("cash_flow", t.fundamentals), ("share_count", t.fundamentals.withColumn("equity_issued", F.lit(None).cast("double")))):
        st = Study(SPEC, f, t.prices, t.sectors)
        s = st.summary(equal_only=True).where(F.col("book") == "score_EW").select(
            F.lit(label).alias("measure"), "ann_return", "sharpe", "net_sharpe")
        p = st.placement().where(F.col("metric") == "sharpe").select(
            F.lit(label).alias("measure"), "percentile", "p_value", "significant")
        row = s.join(p, "measure")
        out = row if out is None else out.unionByName(row)
    return out
