"""The main study: universe, value subset, scores, baskets, paths, evaluation."""

from dataclasses import replace

from pyspark.sql import functions as F

from pitscreen.catalog.registry import query
from pitscreen.catalog.views import VIEWS
from pitscreen.operators import baskets as B, evaluate as E, paths as P, scoring as S
from pitscreen.operators import universe as U
from pitscreen.plans.study import Study, StudySpec

# Sizes suited to the stand-in market; every one is a parameter of the plan.
SPEC = StudySpec(market="us", first_year=1997, last_year=2000, k=10, universe_size=60,
                 value_quantile=0.4, n_draws=50, lag_months=6, min_days=60,
                 seed=42, cov_months=36)


def study(t, **changes) -> Study:
    """The study over ``t``; kept on the tables object so its landed parts are reused."""
    spec = replace(SPEC, **changes)
    kept = t.__dict__.setdefault("studies", {})
    if spec not in kept:
        kept[spec] = Study(spec, t.fundamentals, t.prices, t.sectors)
    return kept[spec]


def r6(df, *cols):
    """Rounds doubles so that two engines' sums compare equal."""
    doubles = cols or [n for n, k in df.dtypes if k == "double"]
    return df.withColumns({c: F.round(c, 6) for c in doubles})


VIEWS["signals"] = """
WITH j AS (
 SELECT t.*, p.total_assets AS a1, coalesce(q.total_assets, p.total_assets) AS a2,
        q.total_assets AS a2_raw, p.net_income AS ni1, p.long_term_debt AS ltd1,
        p.current_assets AS ca1, p.current_liabilities AS cl1, p.shares_outstanding AS sh1,
        p.revenue AS rev1, p.cogs AS cogs1, p.cfo AS cfo1
 FROM fundamentals t JOIN fundamentals p ON p.ticker = t.ticker AND p.fiscal_year = t.fiscal_year - 1
 LEFT JOIN fundamentals q ON q.ticker = t.ticker AND q.fiscal_year = t.fiscal_year - 2),
f AS (
 SELECT ticker, fiscal_year AS score_year, equity_issued IS NOT NULL AS from_cash,
        a2_raw IS NULL AS no_two,
        CAST(net_income / a1 > 0 AS INTEGER) AS f_roa, CAST(cfo > 0 AS INTEGER) AS f_cfo,
        CAST(net_income / a1 > ni1 / a2 AS INTEGER) AS f_droa,
        CAST(cfo / a1 > net_income / a1 AS INTEGER) AS f_accrual,
        CAST(long_term_debt / ((total_assets + a1) / 2) < ltd1 / ((a1 + a2) / 2) AS INTEGER) AS f_dlever,
        CAST(current_assets / current_liabilities > ca1 / cl1 AS INTEGER) AS f_dliquid,
        CAST(CASE WHEN equity_issued IS NOT NULL THEN equity_issued <= 0
                  ELSE shares_outstanding <= sh1 END AS INTEGER) AS f_eq_offer,
        CAST((revenue - cogs) / revenue > (rev1 - cogs1) / rev1 AS INTEGER) AS f_dmargin,
        CAST(revenue / a1 > rev1 / a2 AS INTEGER) AS f_dturn,
        CAST(shares_outstanding <= sh1 AS INTEGER) AS by_count
 FROM j
 WHERE total_assets IS NOT NULL AND net_income IS NOT NULL AND cfo IS NOT NULL
   AND current_assets IS NOT NULL AND current_liabilities IS NOT NULL AND ca1 IS NOT NULL
   AND cl1 IS NOT NULL AND a1 IS NOT NULL AND cfo1 IS NOT NULL)
SELECT *, f_roa + f_cfo + f_droa + f_accrual + f_dlever + f_dliquid + f_eq_offer + f_dmargin + f_dturn AS fscore
FROM f
"""

VIEWS["pit"] = """
SELECT f.*, fiscal_year + 1 AS formation_year FROM fundamentals f
WHERE f.report_date + INTERVAL 6 MONTH <= make_date(fiscal_year + 1, 7, 1)
  AND EXISTS (SELECT 1 FROM fundamentals g WHERE g.ticker = f.ticker AND g.fiscal_year = f.fiscal_year - 1)
  AND fiscal_year + 1 BETWEEN 1997 AND 2000
"""

VIEWS["liq"] = """
SELECT ticker, CAST(year(date + INTERVAL 6 MONTH) AS INTEGER) AS formation_year,
       count(*) AS days, median(adj_close * volume) AS adv, max(date) AS last_date
FROM prices GROUP BY 1, 2
"""

VIEWS["universe"] = """
SELECT *, book_value / market_cap AS bm FROM (
 SELECT p.*, l.adv, row_number() OVER (PARTITION BY p.formation_year ORDER BY l.adv DESC, p.ticker) AS adv_rank
 FROM pit p JOIN liq l ON l.ticker = p.ticker AND l.formation_year = p.formation_year
 WHERE l.days >= 60 AND l.last_date >= make_date(p.formation_year, 7, 1) - 10
   AND market_cap > 0 AND total_assets IS NOT NULL AND net_income IS NOT NULL AND cfo IS NOT NULL
   AND current_assets IS NOT NULL AND current_liabilities IS NOT NULL)
WHERE adv_rank <= 60
"""

VIEWS["value_set"] = """
SELECT u.* FROM universe u JOIN (SELECT formation_year, quantile_cont(bm, 0.6) AS cut FROM universe GROUP BY 1) c
  ON c.formation_year = u.formation_year AND u.bm >= c.cut
"""

VIEWS["scored"] = """
SELECT v.formation_year, v.ticker, v.bm, v.market_cap, v.adv, s.fscore,
       row_number() OVER (PARTITION BY v.formation_year ORDER BY s.fscore DESC,
         md5(concat_ws(':', 42, v.formation_year, v.ticker))) AS rank,
       row_number() OVER (PARTITION BY v.formation_year ORDER BY s.fscore,
         md5(concat_ws(':', 42, v.formation_year, v.ticker)) DESC) AS low_rank,
       least(10, count(*) OVER (PARTITION BY v.formation_year)) AS k_eff
FROM value_set v JOIN signals s ON s.ticker = v.ticker AND s.score_year = v.formation_year - 1
"""

VIEWS["liquid_match"] = """
WITH a AS (
 SELECT v.formation_year, v.ticker, s.rank AS t, k.k_eff,
        row_number() OVER (PARTITION BY v.formation_year ORDER BY v.adv, v.ticker) AS r,
        count(*) OVER (PARTITION BY v.formation_year) AS n,
        md5(concat_ws(':', 42, 'liquidity', v.formation_year, v.ticker)) AS h
 FROM value_set v JOIN (SELECT DISTINCT formation_year, k_eff FROM scored) k ON k.formation_year = v.formation_year
 LEFT JOIN scored s ON s.formation_year = v.formation_year AND s.ticker = v.ticker AND s.rank <= 10),
b AS (SELECT *, greatest(1, coalesce(ceil(5.0::DOUBLE * (r - 1) / nullif(n - 1, 0)), 1)) - 1 AS bucket FROM a),
c AS (SELECT *, count(t) OVER (PARTITION BY formation_year, bucket) AS want,
        row_number() OVER (PARTITION BY formation_year, bucket, t IS NOT NULL ORDER BY h, ticker) AS place FROM b),
d AS (SELECT *, CASE WHEN t IS NOT NULL THEN 3 WHEN place <= want THEN 1 ELSE 2 END AS stage FROM c),
e AS (SELECT *, row_number() OVER (PARTITION BY formation_year ORDER BY stage, coalesce(t, 0), h, ticker) AS pick FROM d)
SELECT formation_year, ticker, CAST(bucket AS INTEGER) AS bucket, stage, CAST(pick AS INTEGER) AS rank, k_eff
FROM e WHERE pick <= 10
"""

VIEWS["positions"] = """
WITH ks AS (SELECT DISTINCT formation_year, k_eff FROM scored),
val AS (SELECT v.formation_year, v.ticker, row_number() OVER (PARTITION BY v.formation_year ORDER BY bm DESC, ticker) AS r FROM value_set v),
cap AS (SELECT v.formation_year, v.ticker, row_number() OVER (PARTITION BY v.formation_year ORDER BY market_cap DESC, ticker) AS r FROM value_set v),
longs AS (SELECT formation_year, ticker FROM scored WHERE rank <= 10),
shorts AS (SELECT formation_year, ticker FROM scored WHERE low_rank <= 10
           EXCEPT SELECT formation_year, ticker FROM longs),
m AS (
 SELECT formation_year, 'score_EW' AS book, ticker, 1 AS leg FROM longs
 UNION ALL SELECT v.formation_year, 'value_EW', ticker, 1 FROM val v JOIN ks ON ks.formation_year = v.formation_year AND r <= k_eff
 UNION ALL SELECT v.formation_year, 'mktcap_EW', ticker, 1 FROM cap v JOIN ks ON ks.formation_year = v.formation_year AND r <= k_eff
 UNION ALL SELECT formation_year, 'liquidity_EW', ticker, 1 FROM liquid_match WHERE rank <= k_eff
 UNION ALL SELECT formation_year, 'score_LS', ticker, 1 FROM longs WHERE formation_year IN (SELECT formation_year FROM shorts)
 UNION ALL SELECT formation_year, 'score_LS', ticker, -1 FROM shorts)
SELECT formation_year, book, ticker, leg * 1.0::DOUBLE / count(*) OVER (PARTITION BY formation_year, book, leg) AS w FROM m
"""

VIEWS["hold_sessions"] = """
SELECT DISTINCT date, CAST(year(date - INTERVAL 6 MONTH) AS INTEGER) AS formation_year
FROM prices WHERE date > make_date(CAST(year(date - INTERVAL 6 MONTH) AS INTEGER), 7, 1)
"""

VIEWS["growth"] = """
WITH n AS (SELECT DISTINCT formation_year, ticker FROM value_set),
base AS (SELECT n.formation_year, n.ticker,
   coalesce(max_by(adj_close, date) FILTER (date <= make_date(formation_year, 7, 1)),
            min_by(adj_close, date) FILTER (date > make_date(formation_year, 7, 1))) AS base,
   max(date) AS last_trade
 FROM n JOIN prices p ON p.ticker = n.ticker AND p.date >= make_date(formation_year, 7, 1) - 7
   AND p.date <= make_date(formation_year + 1, 6, 30) GROUP BY ALL)
SELECT g.formation_year, g.ticker, g.date, b.last_trade,
       CASE WHEN p.date >= make_date(g.formation_year, 7, 1) - 7 THEN p.adj_close / b.base ELSE 1.0 END AS g
FROM (SELECT n.*, s.date FROM n JOIN hold_sessions s ON s.formation_year = n.formation_year) g
LEFT JOIN base b ON b.formation_year = g.formation_year AND b.ticker = g.ticker
ASOF LEFT JOIN prices p ON p.ticker = g.ticker AND p.date <= g.date
"""

VIEWS["book_daily"] = """
WITH v AS (SELECT p.formation_year, p.book, sign(p.w) AS leg, g.date, sum(abs(p.w) * g.g) AS value
 FROM positions p JOIN growth g ON g.formation_year = p.formation_year AND g.ticker = p.ticker GROUP BY ALL),
r AS (SELECT *, value / coalesce(lag(value) OVER (PARTITION BY formation_year, book, leg ORDER BY date), 1.0) - 1 AS r FROM v)
SELECT formation_year, book, date, sum(leg * r) AS r FROM r GROUP BY ALL
"""

VIEWS["drifted"] = """
WITH e AS (SELECT formation_year, ticker, max_by(g, date) AS g FROM growth GROUP BY ALL)
SELECT p.formation_year, book, p.ticker,
       p.w * e.g / sum(abs(p.w) * e.g) OVER (PARTITION BY p.formation_year, book, sign(w)) AS w
FROM positions p JOIN e ON e.formation_year = p.formation_year AND e.ticker = p.ticker
"""

METRICS_SQL = """
SELECT {by}, count(*) AS n_days, product(1 + r) - 1 AS cum_return,
       stddev_samp(r) * sqrt(252) AS ann_vol, min(nav / peak - 1) AS max_drawdown,
       product(1 + r) ** (252.0 / count(*)) - 1 AS ann_return,
       (product(1 + r) ** (252.0 / count(*)) - 1) / nullif(stddev_samp(r) * sqrt(252), 0) AS sharpe
FROM (SELECT *, max(nav) OVER (PARTITION BY {by} ORDER BY date) AS peak
      FROM (SELECT *, product(1 + r) OVER (PARTITION BY {by} ORDER BY date) AS nav FROM {src}))
GROUP BY ALL
"""
VIEWS["book_metrics"] = METRICS_SQL.format(by="book", src="book_daily")

VIEWS["book_turnover"] = """
WITH both_years AS (SELECT DISTINCT a.formation_year, a.book FROM positions a
  JOIN positions b ON b.book = a.book AND b.formation_year = a.formation_year - 1),
s AS (SELECT formation_year, book, ticker, w FROM positions
      UNION ALL SELECT formation_year + 1, book, ticker, -w FROM drifted),
d AS (SELECT formation_year, book, ticker, abs(sum(w)) AS d FROM s GROUP BY ALL)
SELECT formation_year, book, sum(d) / 2 AS turnover FROM d SEMI JOIN both_years b USING (formation_year, book) GROUP BY ALL
"""

VIEWS["conc"] = """
SELECT formation_year, book, sum(abs(w)) ** 2 / sum(w * w) AS effective_n, count(*) AS names,
       max(abs(w)) AS max_weight, count(*) FILTER (abs(w) > 1e-9) AS non_zero_names,
       coalesce(sum(-w) FILTER (w < 0), 0.0) AS short_notional
FROM positions GROUP BY ALL
"""

VIEWS["book_summary"] = """
WITH c AS (SELECT book, CAST(max(names) FILTER (formation_year = (SELECT min(formation_year) FROM conc )) AS DOUBLE) AS nominal_k, CAST(min(names) AS DOUBLE) AS min_k,
   avg(names) AS mean_k, CAST(max(names) AS DOUBLE) AS max_k, avg(effective_n) AS effective_n, avg(short_notional) AS short FROM conc GROUP BY 1),
t AS (SELECT book, avg(turnover) AS turnover FROM book_turnover GROUP BY 1),
a AS (SELECT m.*, nominal_k, min_k, mean_k, max_k, effective_n, coalesce(turnover, 0) AS turnover,
   2 * coalesce(turnover, 0) * 0.0020 + 0.01 * coalesce(short, 0) AS cost_drag
 FROM book_metrics m LEFT JOIN c USING (book) LEFT JOIN t USING (book))
SELECT *, ann_return - cost_drag AS net_ann_return, (ann_return - cost_drag) / nullif(ann_vol, 0) AS net_sharpe FROM a
"""


def floyd_sql(sizes: str, members: str, draws: int, label: str, k: int) -> str:
    """Members of ``draws`` baskets: sizes(formation_year, size, k_eff), members by hash order."""
    return f"""
WITH z AS (SELECT formation_year, size, least({k}, size, k_eff) AS k FROM ({sizes})),
d AS (SELECT z.*, u.draw FROM z, (SELECT unnest(range(0, {draws})) AS draw) u),
p AS (SELECT formation_year, draw, unnest(list_reduce(range(size - k + 1, size + 1), lambda s, j:
   CASE WHEN list_contains(s, 1 + CAST('0x' || substr(md5(concat_ws(':', 42, '{label}', formation_year, draw, j)), 1, 15) AS BIGINT) % j)
        THEN list_append(s, j)
        ELSE list_append(s, 1 + CAST('0x' || substr(md5(concat_ws(':', 42, '{label}', formation_year, draw, j)), 1, 15) AS BIGINT) % j) END,
   CAST([] AS BIGINT[]))) AS idx FROM d),
m AS (SELECT formation_year, ticker, row_number() OVER (PARTITION BY formation_year ORDER BY md5(ticker), ticker) AS idx FROM ({members}))
SELECT p.formation_year, CAST(p.draw AS INTEGER) AS draw, m.ticker FROM p JOIN m ON m.formation_year = p.formation_year AND m.idx = p.idx
"""


VIEWS["random_draws"] = floyd_sql(
    "SELECT v.formation_year, count(*) AS size, min(k_eff) AS k_eff FROM value_set v "
    "JOIN (SELECT DISTINCT formation_year, k_eff FROM scored) k USING (formation_year) GROUP BY 1",
    "SELECT formation_year, ticker FROM value_set", 50, "study", 10)

VIEWS["draw_daily"] = """
WITH p AS (SELECT *, 1.0::DOUBLE / count(*) OVER (PARTITION BY formation_year, draw) AS w FROM random_draws),
v AS (SELECT p.formation_year, p.draw, g.date, sum(p.w * g.g) AS value
 FROM p JOIN growth g ON g.formation_year = p.formation_year AND g.ticker = p.ticker GROUP BY ALL)
SELECT formation_year, draw, date,
       value / coalesce(lag(value) OVER (PARTITION BY formation_year, draw ORDER BY date), 1.0) - 1 AS r FROM v
"""
VIEWS["draw_metrics"] = METRICS_SQL.format(by="draw", src="draw_daily")

SUMMARY = ("book, n_days, " + ", ".join(f"round({c}, 6) AS {c}" for c in (
    "cum_return ann_return ann_vol sharpe max_drawdown nominal_k min_k mean_k max_k effective_n "
    "turnover cost_drag net_ann_return net_sharpe").split()))


# ---- scoring ----

query("nine_signal_scores", "C1 O2", """
SELECT ticker, score_year, f_roa, f_cfo, f_droa, f_accrual, f_dlever, f_dliquid, f_eq_offer,
       f_dmargin, f_dturn, fscore FROM signals""", "signals")(
    lambda t: S.nine_signals(t.fundamentals))

query("scoring_ledger", "C2", """
SELECT score_year, count(*) AS scored, 0::BIGINT AS dropped_incomplete_signals,
       count(*) FILTER (from_cash) AS eq_offer_from_cashflow,
       count(*) FILTER (NOT from_cash) AS eq_offer_from_shares,
       count(*) FILTER (no_two) AS no_tm2_assets FROM signals GROUP BY 1""", "signals")(
    lambda t: S.scoring_ledger(t.fundamentals))

PANEL_SQL = """
SELECT s.ticker, f_roa, f_cfo, f_droa, f_accrual, f_dlever, f_dliquid, f_eq_offer, f_dmargin, f_dturn,
       fscore, s.score_year, s.score_year AS fiscal_year, sector,
       round(CASE WHEN market_cap > 0 THEN book_value / market_cap END, 6) AS bm,
       round(market_cap, 4) AS market_cap
FROM signals s LEFT JOIN fundamentals f ON f.ticker = s.ticker AND f.fiscal_year = s.score_year
LEFT JOIN sectors c ON c.ticker = s.ticker
WHERE NOT EXISTS (SELECT 1 FROM membership m WHERE year(m.date) - 1 = s.score_year)
   OR EXISTS (SELECT 1 FROM membership m WHERE year(m.date) - 1 = s.score_year AND m.ticker = s.ticker)
"""


@query("score_panel", "C3 J2 J3 P18 O1 C10", PANEL_SQL, "signals sectors membership")
def _score_panel(t):
    panel = S.score_panel(t.fundamentals, t.sectors, t.membership)
    return panel.withColumns({"bm": F.round("bm", 6), "market_cap": F.round("market_cap", 4)})


@query("issuance_sensitivity", "C8 J15", """
WITH j AS (SELECT t.ticker, t.fiscal_year AS score_year, t.equity_issued,
  CAST(t.net_income / p.total_assets > 0 AS INTEGER) + CAST(t.cfo > 0 AS INTEGER)
  + CAST(t.net_income / p.total_assets > p.net_income / p.total_assets AS INTEGER)
  + CAST(t.cfo / p.total_assets > t.net_income / p.total_assets AS INTEGER)
  + CAST(t.long_term_debt / ((t.total_assets + p.total_assets) / 2) < p.long_term_debt / ((p.total_assets + p.total_assets) / 2) AS INTEGER)
  + CAST(t.current_assets / t.current_liabilities > p.current_assets / p.current_liabilities AS INTEGER)
  + CAST((t.revenue - t.cogs) / t.revenue > (p.revenue - p.cogs) / p.revenue AS INTEGER)
  + CAST(t.revenue / p.total_assets > p.revenue / p.total_assets AS INTEGER) AS eight,
  CAST(t.shares_outstanding <= p.shares_outstanding AS INTEGER) AS by_count
 FROM fundamentals t JOIN fundamentals p ON p.ticker = t.ticker AND p.fiscal_year = t.fiscal_year - 1),
k AS (SELECT *, CASE WHEN equity_issued IS NULL THEN by_count ELSE CAST(equity_issued <= 0 AS INTEGER) END AS by_cash FROM j)
SELECT score_year, count(*) AS firms, count(equity_issued) AS cash_line_available,
       count(*) FILTER (by_cash <> by_count) AS signal_flips,
       round(avg(eight + by_cash), 6) AS mean_fscore_cash, round(avg(eight + by_count), 6) AS mean_fscore_share,
       round(count(*) FILTER (by_cash <> by_count) / count(*), 6) AS flip_rate
FROM k GROUP BY 1""", "fundamentals")
def _issuance(t):
    return r6(S.issuance_sensitivity(t.fundamentals))


# ---- point in time, universe, baskets ----

query("pit_snapshot", "P2 P3 O1 O2", """
WITH u AS (SELECT *, fiscal_year + 1 AS formation_year FROM filed f
 WHERE report_date + INTERVAL 5 MONTH <= make_date(fiscal_year + 1, 7, 1)
   AND EXISTS (SELECT 1 FROM filed g WHERE g.ticker = f.ticker AND g.fiscal_year = f.fiscal_year - 1))
SELECT formation_year, ticker, fiscal_year, report_date, total_assets FROM u
UNION ALL
SELECT u.formation_year, f.ticker, f.fiscal_year, f.report_date, f.total_assets
FROM u JOIN filed f ON f.ticker = u.ticker AND f.fiscal_year IN (u.formation_year - 2, u.formation_year - 3)""",
      "filed")(lambda t: U.snapshot(t.filed, 5).select(
          "formation_year", "ticker", "fiscal_year", "report_date", "total_assets"))

query("liquidity_stats", "A1", """
SELECT ticker, formation_year, days, round(adv, 6) AS adv, last_date FROM liq""", "liq")(
    lambda t: U.liquidity_stats(t.prices).withColumn("adv", F.round("adv", 6)))

query("formation_universe", "B1 K1 P4 J3", """
SELECT formation_year, ticker, CAST(adv_rank AS INTEGER) AS adv_rank, round(adv, 6) AS adv, round(bm, 6) AS bm FROM universe""",
      "universe")(lambda t: study(t).universe.select(
          "formation_year", "ticker", "adv_rank", F.round("adv", 6).alias("adv"),
          F.round("bm", 6).alias("bm")))

query("value_subset", "K5 A5", "SELECT formation_year, ticker, round(bm, 6) AS bm FROM value_set",
      "value_set")(lambda t: study(t).value_set.select(
          "formation_year", "ticker", F.round("bm", 6).alias("bm")))


@query("value_subset_whole_market", "K5 A5", """
WITH u AS (SELECT ticker, fiscal_year + 1 AS formation_year, book_value / market_cap AS bm FROM fundamentals
 WHERE market_cap > 0),
c AS (SELECT formation_year, quantile_cont(bm, 0.8) AS cut FROM u GROUP BY 1)
SELECT u.formation_year, ticker, round(bm, 6) AS bm FROM u JOIN c USING (formation_year) WHERE bm >= cut""",
       "fundamentals")
def _value_whole(t):
    rows = U.complete_rows(t.fundamentals).select(
        (F.col("fiscal_year") + 1).alias("formation_year"), "ticker",
        F.try_divide("book_value", "market_cap").alias("bm"))
    return r6(U.high_bm_subset(rows, 0.2))


query("score_basket_ranked", "K3 J1", """
SELECT formation_year, ticker, CAST(fscore AS INTEGER) AS fscore, CAST(rank AS INTEGER) AS rank
FROM scored WHERE rank <= 10""", "scored")(lambda t: study(t).baskets["score"].select(
    "formation_year", "ticker", "fscore", "rank"))

query("tie_break_slots", "K4", """
WITH c AS (SELECT formation_year, min(fscore) FILTER (rank = k_eff) AS cut, any_value(k_eff) AS k FROM scored GROUP BY 1)
SELECT s.formation_year, CAST(any_value(k) - count(*) FILTER (fscore > cut) AS BIGINT) AS tie_break_slots
FROM scored s JOIN c USING (formation_year) GROUP BY 1""", "scored")(
    lambda t: B.tie_break_slots(study(t).scored, study(t).sizes))

query("liquidity_matched_basket", "B4 W13", """
SELECT formation_year, ticker, bucket, stage, rank FROM liquid_match""", "liquid_match")(
    lambda t: B.liquidity_matched(study(t).value_set, study(t).baskets["score"], 10, 42))

query("random_baskets", "B5", "SELECT * FROM random_draws", "random_draws")(
    lambda t: study(t).draws)

query("study_positions", "B3 B7 B12 K2 J4 T13", """
SELECT formation_year, book, ticker, round(w, 6) AS w FROM positions""", "positions")(
    lambda t: r6(study(t).equal_positions))


# ---- paths and evaluation ----

query("book_daily_returns", "B14 B15 B18 W9 W17 T14", """
SELECT formation_year, book, date, round(r, 6) AS r FROM book_daily""", "book_daily")(
    lambda t: r6(study(t).equal_daily))

query("laid_out_book_returns", "B14 S19", """
SELECT formation_year, book, date, round(r, 6) AS r FROM book_daily""", "book_daily")(
    lambda t: r6(study(t).laid_out_daily))

query("end_weights", "B14", "SELECT formation_year, book, ticker, round(w, 6) AS w FROM drifted",
      "drifted")(lambda t: r6(P.end_weights(study(t).equal_positions, study(t).steps)))

query("study_summary", "E1 E9 E11 E17 A12 A13 W10", f"SELECT {SUMMARY} FROM book_summary",
      "book_summary")(lambda t: r6(study(t).summary(equal_only=True)))

query("strategy_turnover", "E5 E6", """
SELECT formation_year, book, round(turnover, 6) AS turnover FROM book_turnover""",
      "book_turnover")(lambda t: r6(study(t).turnover_table(equal_only=True)))

query("effective_holdings", "E10", """
SELECT formation_year, book, round(effective_n, 6) AS effective_n, names, round(max_weight, 6) AS max_weight,
       non_zero_names, round(short_notional, 6) AS short_notional FROM conc""", "conc")(
    lambda t: r6(E.effective_n(study(t).equal_positions)))

query("random_book_metrics", "B16 E1 T15", """
SELECT draw, n_days, round(cum_return, 6) AS cum_return, round(ann_return, 6) AS ann_return,
       round(ann_vol, 6) AS ann_vol, round(sharpe, 6) AS sharpe, round(max_drawdown, 6) AS max_drawdown
FROM draw_metrics""", "draw_metrics")(
    lambda t: r6(E.metrics(study(t).draw_daily("EW"), ["book"]).withColumnRenamed("book", "draw")))

query("placement", "E2 E3", """
WITH s AS (UNPIVOT (SELECT ann_return, sharpe, max_drawdown FROM book_metrics WHERE book = 'score_EW')
  ON ann_return, sharpe, max_drawdown INTO NAME metric VALUE stat),
d AS (UNPIVOT (SELECT draw, ann_return, sharpe, max_drawdown FROM draw_metrics)
  ON ann_return, sharpe, max_drawdown INTO NAME metric VALUE v)
SELECT 'score_EW' AS book, metric, round(stat, 6) AS stat, round(avg(CASE WHEN v < stat THEN 1.0 ELSE 0.0 END), 6) AS percentile,
       round(avg(CASE WHEN v >= stat THEN 1.0 ELSE 0.0 END), 6) AS p_value, count(*) AS n_draws,
       round(avg(v), 6) AS random_mean, round(stddev_pop(v), 6) AS random_std,
       round(stddev_samp(v), 6) AS random_std_sample, avg(CASE WHEN v >= stat THEN 1.0 ELSE 0.0 END) < 0.05 AS significant
FROM s JOIN d USING (metric) GROUP BY metric, stat""", "book_metrics draw_metrics")(
    lambda t: r6(study(t).placement()))
