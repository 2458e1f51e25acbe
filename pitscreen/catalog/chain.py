"""Vendor statements and bars to the final panel, stage by stage."""

from pyspark.sql import functions as F

from pitscreen.catalog.registry import query
from pitscreen.catalog.study import r6
from pitscreen.catalog.views import VIEWS
from pitscreen.operators import checks as V, shares as H, statement_scores as C
from pitscreen.operators import vendor_bars as N
from pitscreen.plans import vendor_chain as P
from pitscreen.sources import line_items as L

UNTIL = "2001-06-30"


def chain(t) -> P.VendorChain:
    if "chain" not in t.__dict__:
        t.chain = P.VendorChain(t.vendor_long, t.vendor_bars, t.annual_summary, t.coverage_grid,
                                UNTIL, strict_checks=False, sectors=t.sectors,
                                min_traded_pct=10)
    return t.chain


VIEWS["vbars"] = "SELECT * REPLACE (CAST(date AS DATE) AS date) FROM vendor_bars"

VIEWS["cover"] = """
SELECT g.*, (""" + " + ".join(f'least("{y}", 3)' for y in range(1995, 2002)) + """) / 3 AS coverage_score_year,
       coalesce(n, 0) AS price_available_day,
       NOT ((""" + " + ".join(f'least("{y}", 3)' for y in range(1995, 2002)) + """) / 3 < 2 OR coalesce(n, 0) = 0) AS kept
FROM coverage_grid g LEFT JOIN (SELECT symbol, count(*) AS n FROM vbars WHERE date <= DATE '2001-06-30' GROUP BY 1) d
  ON d.symbol = g.symbol
"""

VIEWS["vextract"] = """
WITH a AS (SELECT symbol, period, total_assets, current_assets, current_liabilities, total_liabilities,
   equity_section, owner_equity, minority_interest, paid_in_capital, treasury_stock, long_term_liabilities,
   long_term_debt, net_sales, cogs, gross_profit, net_income_total, net_income_minority, net_income_parent,
   coalesce(cfo, cfo_direct) AS cfo, cfi, cff, net_cash_flow, fx_effect, cash_begin, cash_end, stock_issuance_proceeds
 FROM vendor_statements WHERE symbol IN (SELECT symbol FROM cover WHERE kept)),
b AS (SELECT a.*, abs(a.paid_in_capital - p.paid_in_capital) AS d_paid_in_capital FROM a
 LEFT JOIN a p ON p.symbol = a.symbol AND CAST(p.period AS INTEGER) = CAST(a.period AS INTEGER) - 1)
SELECT * REPLACE (
  CASE WHEN d_paid_in_capital = 0 AND stock_issuance_proceeds IS NULL THEN 0 ELSE stock_issuance_proceeds END AS stock_issuance_proceeds,
  CASE WHEN fx_effect IS NULL AND coalesce(cfo, 0) + coalesce(cff, 0) + coalesce(cfi, 0) = net_cash_flow THEN 0 ELSE fx_effect END AS fx_effect)
FROM b
"""

VIEWS["vchecks"] = """
SELECT symbol, period,
 abs(total_liabilities + equity_section - total_assets) / coalesce(nullif(greatest(abs(total_liabilities + equity_section), abs(total_assets)), 0), 1) <= 1e-6 AS balance_identity,
 abs(gross_profit - (net_sales - cogs)) / abs(total_assets) <= 1e-6 AS gross_profit_decomposes,
 abs(cfo + cfi + cff - net_cash_flow) / abs(total_assets) <= 1e-6 AS cf_sums_to_net,
 CASE WHEN fx_effect IS NOT NULL THEN abs(cash_begin + cfo + cfi + cff + fx_effect - cash_end) / abs(total_assets) <= 1e-6 END AS cf_internal_roll,
 abs(total_liabilities - (long_term_liabilities + current_liabilities)) / abs(total_assets) <= 1e-6 AS total_liabilities_identity,
 abs(net_income_parent - (net_income_total - net_income_minority)) / abs(total_assets) <= 1e-6 AS net_income_parent_identity,
 stock_issuance_proceeds >= 0 AS issuance_nonneg
FROM vextract
"""
CHECKS = [r.name for r in V.RULES]

VIEWS["vpanel"] = """
SELECT e.* FROM vextract e JOIN vchecks c USING (symbol, period)
WHERE """ + " AND ".join(f"coalesce(c.{n}, true)" for n in CHECKS)

VIEWS["vmonth"] = """
SELECT symbol, month, date, close, sessions, traded_sessions, traded_sessions = 0 AS stale FROM (
 SELECT symbol, CAST(date_trunc('month', date) AS DATE) AS month, date, price_close * unit AS close,
  count(*) OVER w AS sessions, count(*) FILTER (total_volume > 0) OVER w AS traded_sessions,
  row_number() OVER (PARTITION BY symbol, date_trunc('month', date) ORDER BY total_volume > 0 DESC, date DESC) AS rn
 FROM vbars WHERE unit = 1000 AND price_close > 0
 WINDOW w AS (PARTITION BY symbol, date_trunc('month', date)))
WHERE rn = 1
"""

VIEWS["vcounts"] = """
SELECT symbol, CAST(year AS VARCHAR) AS period, share_at_period_end FROM annual_summary
WHERE quarter = 0 AND share_at_period_end > 0
"""

SHARES = """
 paid_in_capital / 10000 AS shares_issued, share_at_period_end AS shares_out,
 (share_at_period_end - paid_in_capital / 10000) / nullif(paid_in_capital / 10000, 0) AS shares_gap
"""
CHOICE = """
 CASE WHEN coalesce(shares_gap <= 0.005 AND shares_gap >= -0.30, false) THEN 'outstanding' ELSE 'par_implied' END AS shares_source,
 CASE WHEN coalesce(shares_gap <= 0.005 AND shares_gap >= -0.30, false) THEN least(shares_out, shares_issued) ELSE shares_issued END AS shares
"""

VIEWS["vbm"] = f"""
WITH a AS (SELECT p.symbol, p.period, owner_equity - coalesce(minority_interest, 0) AS book_equity, treasury_stock, {SHARES},
   m.close, m.date AS close_date, m.stale AS price_stale
 FROM vpanel p LEFT JOIN vcounts c USING (symbol, period)
 LEFT JOIN vmonth m ON m.symbol = p.symbol AND month(m.month) = 12 AND CAST(year(m.month) AS VARCHAR) = p.period),
b AS (SELECT *, {CHOICE} FROM a)
SELECT *, close * shares AS market_equity,
 CASE WHEN book_equity > 0 THEN book_equity / nullif(close * shares, 0) END AS bm,
 CASE WHEN book_equity > 0 THEN book_equity / nullif(close * shares_issued, 0) END AS bm_shares_issued,
 coalesce(treasury_stock, 0) <> 0 AS has_treasury FROM b
"""

VIEWS["vlevels"] = """
WITH a AS (SELECT *, CAST(period AS INTEGER) - lag(CAST(period AS INTEGER)) OVER w = 1 AS near,
   lag(total_assets) OVER w AS ta1 FROM vpanel WINDOW w AS (PARTITION BY symbol ORDER BY period)),
b AS (SELECT *, coalesce(near, false) AS contiguous, CASE WHEN near THEN ta1 END AS beg,
   CASE WHEN net_sales > 0 THEN net_sales END AS sales FROM a)
SELECT symbol, period, contiguous, beg AS total_assets_begin, net_income_parent / nullif(beg, 0) AS roa,
 cfo / nullif(beg, 0) AS cfoa, long_term_debt / nullif((total_assets + beg) / 2, 0) AS lever,
 current_assets / nullif(current_liabilities, 0) AS liquid, gross_profit / nullif(sales, 0) AS margin,
 sales / nullif(beg, 0) AS turn, stock_issuance_proceeds AS equity_raised, long_term_debt FROM b
"""

VIEWS["vraw"] = """
WITH a AS (SELECT *, CASE WHEN contiguous THEN lag(roa) OVER w END AS roa1, CASE WHEN contiguous THEN lag(lever) OVER w END AS lever1,
  CASE WHEN contiguous THEN lag(liquid) OVER w END AS liquid1, CASE WHEN contiguous THEN lag(margin) OVER w END AS margin1,
  CASE WHEN contiguous THEN lag(turn) OVER w END AS turn1, CASE WHEN contiguous THEN lag(long_term_debt) OVER w END AS long_term_debt_prev
 FROM vlevels WINDOW w AS (PARTITION BY symbol ORDER BY period))
SELECT symbol, period, roa, cfoa, roa - roa1 AS d_roa, roa - cfoa AS accrual, lever - lever1 AS d_lever,
 liquid - liquid1 AS d_liquid, equity_raised AS eq_offer, margin - margin1 AS d_margin, turn - turn1 AS d_turn,
 long_term_debt, long_term_debt_prev FROM a
"""

VIEWS["vscores"] = """
WITH a AS (SELECT *, roa > 0 AS f_roa, cfoa > 0 AS f_cfoa, d_roa > 0 AS f_d_roa, accrual < 0 AS f_accrual,
  d_lever < 0 AS f_d_lever, d_liquid > 0 AS f_d_liquid, eq_offer <= 0 AS f_eq_offer, d_margin > 0 AS f_d_margin,
  d_turn > 0 AS f_d_turn FROM vraw),
b AS (SELECT *, """ + " + ".join(f"CAST(f_{s} IS NOT NULL AS INTEGER)" for s in C.SIGNALS) + """ AS signals_available FROM a)
SELECT *, CASE WHEN signals_available >= 9 THEN """ + " + ".join(
    f"CAST(coalesce(f_{s}, false) AS INTEGER)" for s in C.SIGNALS) + """ END AS f_score FROM b
"""

JUNE = "date <= make_date(year(date), 6, 30) AND date > make_date(year(date), 6, 30) - 30"
VIEWS["vcalendar"] = f"""
SELECT CAST(year(date) AS INTEGER) AS formation_year, count(DISTINCT date) AS market_sessions,
       min(date) AS window_start, max(date) AS window_end FROM vbars WHERE {JUNE} GROUP BY 1
"""
VIEWS["vwindow"] = f"""
SELECT symbol, CAST(year(date) AS INTEGER) AS formation_year, count(*) AS bars,
 count(*) FILTER (deal_volume > 0) AS traded_sessions, sum(deal_volume) AS deal_volume, sum(total_volume) AS total_volume,
 sum(deal_volume * price_average * unit) AS deal_value, max(date) AS last_bar
FROM vbars WHERE unit = 1000 AND {JUNE} GROUP BY 1, 2
"""

TURN = f"""
WITH a AS (SELECT p.symbol, p.period, treasury_stock, paid_in_capital, {SHARES}, w.* EXCLUDE (symbol), k.market_sessions
 FROM {{src}} p LEFT JOIN vcounts c USING (symbol, period)
 LEFT JOIN vwindow w ON w.symbol = p.symbol AND CAST(w.formation_year - 1 AS VARCHAR) = p.period
 LEFT JOIN vcalendar k ON k.formation_year = w.formation_year),
b AS (SELECT *, {CHOICE}, round(100.0 * traded_sessions / market_sessions, 2) AS traded_pct FROM a)
SELECT *, deal_volume / nullif(shares, 0) AS turnover, deal_volume / nullif(shares_issued, 0) AS turnover_issued,
 total_volume / nullif(shares, 0) AS turnover_total, round(100 * (1 - deal_volume / nullif(total_volume, 0)), 2) AS putthrough_pct,
 deal_value / nullif(traded_sessions, 0) AS adtv FROM b
"""
VIEWS["vmarket"] = TURN.format(src="vextract")
VIEWS["vcuts"] = """
SELECT formation_year, quantile_cont(turnover, 0.1) AS min_turnover, quantile_cont(turnover_issued, 0.1) AS min_turnover_issued
FROM vmarket WHERE formation_year IS NOT NULL GROUP BY 1
"""
VIEWS["vturn"] = TURN.format(src="vpanel")
VIEWS["vtrade"] = """
SELECT t.*, min_turnover, min_turnover_issued,
 CASE WHEN turnover IS NOT NULL THEN coalesce(turnover > min_turnover AND traded_pct >= 10, false) END AS tradeable,
 CASE WHEN turnover IS NOT NULL THEN coalesce(turnover_issued > min_turnover_issued AND traded_pct >= 10, false) END AS tradeable_issued,
 coalesce(lead(paid_in_capital) OVER (PARTITION BY symbol ORDER BY period) / nullif(paid_in_capital, 0) > 1.05, false) AS raised_next
FROM vturn t LEFT JOIN vcuts c ON c.formation_year = t.formation_year
"""

VIEWS["ventry"] = """
SELECT symbol, CAST(fy - 1 AS VARCHAR) AS period, date AS price_date, CAST(date - make_date(fy, 7, 1) AS INTEGER) AS entry_lead_days,
 total_volume > 0 AS price_traded, price_close * unit AS close_raw, adj_ratio, price_close * unit / adj_ratio AS close_adj
FROM (SELECT *, CAST(year(date) AS INTEGER) AS fy, row_number() OVER (PARTITION BY symbol, year(date) ORDER BY date) AS rn
      FROM vbars WHERE unit = 1000 AND price_close > 0 AND date >= make_date(year(date), 7, 1)) WHERE rn = 1
"""

VIEWS["vfinal"] = """
WITH px AS (SELECT symbol, date, price_close * unit / adj_ratio AS close_adj FROM vbars WHERE unit = 1000 AND price_close > 0),
a AS (SELECT s.*, b.book_equity, b.market_equity, b.bm, t.turnover, t.traded_pct, t.tradeable, t.formation_year, t.last_bar,
  e.price_date, e.entry_lead_days, e.close_raw, e.close_adj,
  make_date(CAST(s.period AS INTEGER) + 2, 6, 30) AS exit_date
 FROM vscores s JOIN vbm b USING (symbol, period) JOIN vtrade t USING (symbol, period) LEFT JOIN ventry e USING (symbol, period)),
x AS (SELECT a.*, px.date AS exit_price_date, px.close_adj AS close_adj_exit,
  CAST(a.exit_date - px.date AS INTEGER) AS exit_lag_days, a.exit_date <= (SELECT max(date) FROM px) AS holding_complete
 FROM a ASOF LEFT JOIN px ON px.symbol = a.symbol AND px.date <= a.exit_date),
y AS (SELECT x.*, holding_complete AND coalesce(exit_lag_days > 30, false) AND NOT coalesce(l.last > exit_date, false) AS exit_permanent
 FROM x LEFT JOIN (SELECT symbol, max(date) AS last FROM px GROUP BY 1) l ON l.symbol = x.symbol)
SELECT *, CASE WHEN holding_complete THEN close_adj_exit / nullif(close_adj, 0) - 1 END AS fwd_return_1y,
 f_score IS NOT NULL AND bm IS NOT NULL AND turnover IS NOT NULL AND close_raw IS NOT NULL AND coalesce(tradeable, false) AS investable
FROM y
"""


# ---- extract and coverage ----

query("coverage_screen", "P23 N17", """
SELECT symbol, round(coverage_score_year, 6) AS coverage_score_year, price_available_day, kept FROM cover""",
      "cover")(lambda t: r6(chain(t).screen.select(
          "symbol", "coverage_score_year", "price_available_day", "kept")))

EXTRACT_COLS = ("total_assets owner_equity minority_interest paid_in_capital treasury_stock net_sales cogs "
                "gross_profit cfo cfi cff net_cash_flow fx_effect cash_begin cash_end "
                "stock_issuance_proceeds d_paid_in_capital").split()
query("statement_extract", "A11 S5 S7 S8 P10 P11 P12 W6 J3", "SELECT symbol, period, " + ", ".join(
    f"round({c}, 4) AS {c}" for c in EXTRACT_COLS) + " FROM vextract", "vextract")(
    lambda t: chain(t).extracted.select("symbol", "period", *[
        F.round(c, 4).alias(c) for c in EXTRACT_COLS]))

query("line_mapping_coverage", "S7 S8", """
SELECT statement, key, count(*) AS rows FROM (
 UNPIVOT (SELECT symbol, period, """ + ", ".join(
    f"{k} AS {s}__{k}" for s, k in __import__("pitscreen.sources.standin", fromlist=["Tables"]).Tables.LONG_LINES)
      + """ FROM vendor_statements) ON COLUMNS(* EXCLUDE (symbol, period)) INTO NAME line VALUE v)
 , LATERAL (SELECT split_part(line, '__', 1) AS statement, split_part(line, '__', 2) AS key)
WHERE v IS NOT NULL GROUP BY 1, 2""", "vendor_statements")(
    lambda t: t.vendor_long.withColumnRenamed("name", "label")
    .join(F.broadcast(L.mapping(t.spark)), ["statement", "label"])
    .groupBy("statement", "key").agg(F.count("*").alias("rows")))

PRESENT = """SELECT DISTINCT split_part(line, '__', 1) AS statement, split_part(line, '__', 2) AS key FROM (
 UNPIVOT (SELECT symbol, period, """ + ", ".join(
    f"{k} AS {s}__{k}" for s, k in __import__("pitscreen.sources.standin", fromlist=["Tables"]).Tables.LONG_LINES) + """
 FROM vendor_statements) ON COLUMNS(* EXCLUDE (symbol, period)) INTO NAME line VALUE v) WHERE v IS NOT NULL"""
NEEDED = "VALUES " + ", ".join(f"('{p}', '{s}', '{k}')" for p, s, k in dict.fromkeys(L.needed()))


def present(t):
    """The lines that the vendor's long table holds, by their canonical names."""
    return t.vendor_long.withColumnRenamed("name", "label").join(F.broadcast(L.mapping(t.spark)), ["statement", "label"])


query("line_support", "S7 S8", f"""
SELECT purpose, count(*) AS needed, count(h.key) AS there, count(*) = count(h.key) AS supported
FROM ({NEEDED}) n(purpose, statement, key) LEFT JOIN ({PRESENT}) h USING (statement, key) GROUP BY 1""",
      "vendor_statements")(lambda t: L.support(present(t), L.needs(t.spark)))

query("missing_lines", "S7", f"""
SELECT purpose, statement, key FROM ({NEEDED}) n(purpose, statement, key) ANTI JOIN ({PRESENT}) h USING (statement, key)""",
      "vendor_statements")(lambda t: L.missing_lines(present(t), L.needs(t.spark)).distinct())

query("field_coverage", "A9", """
SELECT period, count(*) AS names, round(avg(CAST(minority_interest IS NOT NULL AS DOUBLE)), 3) AS minority_interest,
 round(avg(CAST(treasury_stock IS NOT NULL AS DOUBLE)), 3) AS treasury_stock, round(avg(CAST(cfo IS NOT NULL AS DOUBLE)), 3) AS cfo,
 round(avg(CAST(fx_effect IS NOT NULL AS DOUBLE)), 3) AS fx_effect FROM vextract GROUP BY 1""", "vextract")(
    lambda t: P.field_coverage(chain(t).extracted, "period",
                               ["minority_interest", "treasury_stock", "cfo", "fx_effect"]))

# ---- checks ----

query("accounting_checks", "V1 V2 V3 T17", "SELECT * FROM vchecks", "vchecks")(
    lambda t: chain(t).results)

query("check_summary", "V4 K9", """
SELECT "check", 'hard' AS severity, 'universal' AS framework, count(ok) AS tested, count(*) FILTER (NOT ok) AS failed,
 round(100.0 * count(*) FILTER (NOT ok) / nullif(count(ok), 0), 3) AS fail_pct, count(*) FILTER (ok IS NULL) AS not_applicable
FROM vchecks UNPIVOT INCLUDE NULLS (ok FOR "check" IN (""" + ", ".join(CHECKS) + """)) GROUP BY 1""",
      "vchecks")(lambda t: V.summary(chain(t).results))

query("check_offenders", "V5", """
SELECT symbol, period, round(total_liabilities, 4) AS total_liabilities, round(equity_section, 4) AS equity_section,
 round(total_assets, 4) AS total_assets FROM vextract JOIN vchecks USING (symbol, period) WHERE NOT balance_identity""",
      "vchecks")(lambda t: V.rows_where(chain(t).results, chain(t).extracted, "balance_identity", False)
                 .withColumns({c: F.round(c, 4) for c in (
                     "total_liabilities", "equity_section", "total_assets")}))

query("check_not_applicable", "V5", """
SELECT symbol, period, round(stock_issuance_proceeds, 4) AS stock_issuance_proceeds
FROM vextract JOIN vchecks USING (symbol, period) WHERE issuance_nonneg IS NULL""", "vchecks")(
    lambda t: V.rows_where(chain(t).results, chain(t).extracted, "issuance_nonneg", None)
    .withColumn("stock_issuance_proceeds", F.round("stock_issuance_proceeds", 4)))

query("check_failures_by_year", "V6", """
SELECT substr(period, 1, 4) AS year, round(count(*) FILTER (NOT cf_internal_roll) / nullif(count(cf_internal_roll), 0), 6) AS fail_rate
FROM vchecks GROUP BY 1""", "vchecks")(
    lambda t: r6(V.failures_by_year(chain(t).results, "cf_internal_roll")))


@query("clean_rules", "V7 J11", "SELECT symbol, period, "
       + " AND ".join(f"coalesce({n}, true)" for n in CHECKS) + " AS lenient, "
       + " AND ".join(f"coalesce({n}, false)" for n in CHECKS) + " AS strict FROM vchecks", "vchecks")
def _clean(t):
    res = chain(t).results
    return res.select("symbol", "period", V.clean(res).alias("lenient"),
                      V.clean(res, untestable_passes=False).alias("strict"))


query("minority_placement", "V8", """
SELECT period, CASE WHEN r IS NULL THEN 'untestable' WHEN coalesce(abs(r) / abs(total_assets) <= 1e-6, false) THEN 'inside'
  WHEN coalesce(abs(r - minority_interest) / abs(total_assets) <= 1e-6, false) THEN 'outside' ELSE 'unexplained' END AS placement,
 count(*) AS rows FROM (SELECT *, total_assets - total_liabilities - equity_section AS r FROM vextract) GROUP BY 1, 2""",
      "vextract")(lambda t: V.minority_placement(chain(t).extracted)
                  .groupBy("period", "placement").agg(F.count("*").alias("rows")))

# ---- book-to-market and share count ----

query("month_end_bars", "W1 A2", """
SELECT symbol, month, date, round(close, 4) AS close, sessions, traded_sessions, stale FROM vmonth""", "vmonth")(
    lambda t: chain(t).month_ends.withColumn("close", F.round("close", 4)))

query("month_last_bar", "W2", """
SELECT symbol, month, date, round(close_adj, 4) AS close_adj FROM (SELECT symbol, CAST(date_trunc('month', date) AS DATE) AS month, date,
 price_close * unit / adj_ratio AS close_adj, row_number() OVER (PARTITION BY symbol, date_trunc('month', date) ORDER BY date DESC) AS rn
 FROM vbars WHERE unit = 1000 AND price_close > 0) WHERE rn = 1""", "vbars")(
    lambda t: N.last_bar_of_month(chain(t).bars).withColumn("close_adj", F.round("close_adj", 4)))

query("unmatched_closes", "N6 N7 J12 W14", """
WITH s AS (SELECT symbol, min(year(month)) AS f, max(year(month)) AS l FROM vmonth GROUP BY 1),
p AS (SELECT p.symbol, CAST(p.period AS INTEGER) AS y, m.close, f, l FROM vpanel p LEFT JOIN s USING (symbol)
 LEFT JOIN vmonth m ON m.symbol = p.symbol AND month(m.month) = 12 AND year(m.month) = CAST(p.period AS INTEGER))
SELECT count(*) AS rows, count(close) AS matched, count(*) - count(close) AS unmatched,
 count(*) FILTER (close IS NULL AND y < f) AS before_first_trade, count(*) FILTER (close IS NULL AND y > l) AS after_last_trade,
 count(*) FILTER (close IS NULL AND y BETWEEN f AND l) AS gap FROM p""", "vpanel vmonth")(
    lambda t: N.unmatched_closes(chain(t).panel, chain(t).month_ends,
                                 N.period_end_close(chain(t).month_ends)))

query("book_to_market", "P13 P14 P15 P16 P17 N6", """
SELECT symbol, period, round(book_equity, 4) AS book_equity, round(shares_issued, 4) AS shares_issued, round(shares_out, 4) AS shares_out,
 round(shares_gap, 6) AS shares_gap, shares_source, round(shares, 4) AS shares, round(close, 4) AS close, round(market_equity, 4) AS market_equity,
 round(bm, 6) AS bm, round(bm_shares_issued, 6) AS bm_shares_issued, close_date, price_stale, has_treasury FROM vbm""", "vbm")(
    lambda t: chain(t).bm.withColumns({
        **{c: F.round(c, 4) for c in ("book_equity", "shares_issued", "shares_out", "shares", "close", "market_equity")},
        **{c: F.round(c, 6) for c in ("shares_gap", "bm", "bm_shares_issued")}}))

query("bm_coverage", "A3", """
SELECT count(*) AS rows, count(bm) AS with_bm, count(*) FILTER (close IS NULL) AS no_close, count(*) FILTER (shares_issued = 0) AS no_capital,
 count(*) FILTER (book_equity <= 0) AS non_positive_equity, count(*) FILTER (coalesce(price_stale, false)) AS stale_price,
 count(*) FILTER (has_treasury) AS treasury_held, count(*) FILTER (bm IS NOT NULL AND shares_source = 'outstanding') AS vendor_count,
 count(*) FILTER (bm IS NOT NULL AND shares_source = 'outstanding' AND shares_gap < -0.005) AS vendor_below_issued,
 count(*) FILTER (bm IS NOT NULL AND shares_source <> 'outstanding') AS fell_back FROM vbm""", "vbm")(
    lambda t: H.bm_coverage(chain(t).bm))

query("share_source_counts", "A3 P16", """
SELECT count(*) AS rows, count(*) FILTER (shares_source = 'outstanding') AS outstanding, count(*) FILTER (abs(shares_gap) <= 0.005) AS same_as_issued,
 count(*) FILTER (shares_gap < -0.005) AS below_issued, count(*) FILTER (shares_source = 'par_implied') AS par_implied,
 count(*) FILTER (shares_out IS NULL) AS no_vendor_count, count(*) FILTER (shares_gap > 0.005) AS above_issued,
 count(*) FILTER (shares_gap < -0.3) AS below_guard FROM vbm""", "vbm")(
    lambda t: H.share_source_counts(chain(t).bm))

query("bm_by_period", "A5 A18", """
SELECT period, count(*) AS rows, count(bm) AS with_bm, round(100.0 * count(*) FILTER (coalesce(price_stale, false)) / nullif(count(bm), 0), 1) AS stale_pct,
 round(quantile_cont(bm, 0.25), 6) AS p25, round(median(bm), 6) AS median_bm, round(quantile_cont(bm, 0.75), 6) AS p75 FROM vbm GROUP BY 1""",
      "vbm")(lambda t: r6(H.bm_by_period(chain(t).bm)))

query("bm_basis_shift", "A16", """
WITH r AS (SELECT bm / nullif(bm_shares_issued, 0) AS r FROM vbm WHERE bm / nullif(bm_shares_issued, 0) IS NOT NULL)
SELECT count(*) AS rows, count(*) FILTER (abs(r - 1) <= 1e-9) AS unchanged, count(*) FILTER (abs(r - 1) > 0.01) AS off_1pct,
 count(*) FILTER (abs(r - 1) > 0.05) AS off_5pct, count(*) FILTER (abs(r - 1) > 0.20) AS off_20pct, round(max(r), 6) AS largest,
 round(quantile_cont(r, 0.5) FILTER (abs(r - 1) > 0.01), 6) AS median_moved,
 round(quantile_cont(r, 0.95) FILTER (abs(r - 1) > 0.01), 6) AS p95_moved FROM r""", "vbm")(
    lambda t: r6(H.ratio_shift(chain(t).bm, F.col("bm"), F.col("bm_shares_issued"))))

query("bm_vs_vendor_pb", "A16", """
WITH r AS (SELECT b.bm / (1 / pb) AS r FROM vbm b JOIN annual_summary a ON a.symbol = b.symbol AND CAST(a.year AS VARCHAR) = b.period AND a.quarter = 0
  WHERE pb > 0 AND abs(shares_gap) > 0.005 AND b.bm IS NOT NULL)
SELECT count(*) AS rows, count(*) FILTER (abs(r - 1) <= 1e-9) AS unchanged, count(*) FILTER (abs(r - 1) > 0.01) AS off_1pct,
 count(*) FILTER (abs(r - 1) > 0.05) AS off_5pct, count(*) FILTER (abs(r - 1) > 0.20) AS off_20pct, round(max(r), 6) AS largest,
 round(quantile_cont(r, 0.5) FILTER (abs(r - 1) > 0.01), 6) AS median_moved,
 round(quantile_cont(r, 0.95) FILTER (abs(r - 1) > 0.01), 6) AS p95_moved FROM r""", "vbm annual_summary")(
    lambda t: r6(H.ratio_shift(
        chain(t).bm.where(F.abs("shares_gap") > H.SHARE_GAP_TOL).join(
            t.annual_summary.where((F.col("quarter") == 0) & (F.col("pb") > 0)).select(
                "symbol", F.col("year").cast("string").alias("period"), "pb"), ["symbol", "period"]),
        F.col("bm"), 1 / F.col("pb"))))

query("gap_describe", "A6", """
WITH b AS (SELECT (share_at_period_end - paid_in_capital / 10000) / (paid_in_capital / 10000) AS rel FROM annual_summary
 WHERE quarter = 0 AND paid_in_capital > 0 AND share_at_period_end > 0)
SELECT count(rel) AS count, round(avg(rel), 6) AS mean, round(stddev_samp(rel), 6) AS std, round(min(rel), 6) AS min, round(max(rel), 6) AS max,
 round(quantile_cont(rel, 0.01), 6) AS p1, round(quantile_cont(rel, 0.25), 6) AS p25, round(quantile_cont(rel, 0.5), 6) AS p50,
 round(quantile_cont(rel, 0.99), 6) AS p99 FROM b""", "annual_summary")(
    lambda t: r6(H.describe(H.comparable_counts(t.annual_summary), [], "rel", [0.01, 0.25, 0.5, 0.99])))

BASE_SQL = """WITH b AS (SELECT *, paid_in_capital / 10000 AS implied, (share_at_period_end - paid_in_capital / 10000) / (paid_in_capital / 10000) AS rel,
 coalesce(treasury_stock, 0) <> 0 AS has_treasury FROM annual_summary WHERE quarter = 0 AND paid_in_capital > 0 AND share_at_period_end > 0)
"""
query("gap_bands", "A10", BASE_SQL + """
SELECT CASE WHEN rel <= -0.3 THEN 1 WHEN rel <= -0.005 THEN 2 WHEN rel <= 0.005 THEN 3 WHEN rel <= 0.3 THEN 4 ELSE 5 END AS band, count(*) AS rows,
 count(*) FILTER (has_treasury) AS with_treasury, round(100 * avg(CAST(has_treasury AS DOUBLE)), 1) AS treasury_pct FROM b GROUP BY 1""",
      "annual_summary")(lambda t: H.gap_bands(H.comparable_counts(t.annual_summary)))

query("count_agreement", "A18", BASE_SQL + """
SELECT count(*) AS rows, count(*) FILTER (abs(share_at_period_end - implied) < 1) AS exact, count(*) FILTER (share_at_period_end - implied <= -1) AS below,
 count(*) FILTER (share_at_period_end - implied >= 1) AS above FROM b""", "annual_summary")(
    lambda t: H.count_agreement(H.comparable_counts(t.annual_summary)))

query("treasury_netting", "A18", BASE_SQL + """
SELECT count(*) AS rows, count(*) FILTER (share_at_period_end - implied < -1) AS netted, count(*) FILTER (abs(share_at_period_end - implied) < 1) AS not_netted,
 count(*) FILTER (share_at_period_end - implied > 1) AS above, round(median(rel) FILTER (share_at_period_end - implied < -1), 6) AS median_gap
FROM b WHERE has_treasury""", "annual_summary")(
    lambda t: r6(H.treasury_netting(H.comparable_counts(t.annual_summary))))

query("frozen_symbols", "A4 A15", BASE_SQL + """
SELECT symbol, count(*) AS years, count(DISTINCT share_at_period_end) AS n_out, count(DISTINCT implied) AS n_implied FROM b GROUP BY 1
HAVING count(*) >= 5 AND count(DISTINCT share_at_period_end) = 1 AND count(DISTINCT implied) > 1""", "annual_summary")(
    lambda t: H.frozen_symbols(H.comparable_counts(t.annual_summary)))

query("worst_share_counts", "K8", BASE_SQL + """,
f AS (SELECT symbol FROM b GROUP BY 1 HAVING count(*) >= 5 AND count(DISTINCT share_at_period_end) = 1 AND count(DISTINCT implied) > 1)
SELECT symbol, year, round(share_at_period_end / implied, 2) AS times, has_treasury, symbol IN (SELECT symbol FROM f) AS frozen
FROM b WHERE rel > 0.005 ORDER BY times DESC, symbol, year LIMIT 15""", "annual_summary")(
    lambda t: H.worst_above(H.comparable_counts(t.annual_summary),
                            H.frozen_symbols(H.comparable_counts(t.annual_summary))))

query("suspicious_drops", "W15", BASE_SQL + """,
w AS (SELECT *, coalesce(year - lag(year) OVER (PARTITION BY symbol ORDER BY year) = 1, false) AS near,
  lag(share_at_period_end) OVER (PARTITION BY symbol ORDER BY year) AS prev FROM b),
d AS (SELECT *, near AND share_at_period_end < prev * (1 - 0.005) AS fell FROM w)
SELECT count(*) FILTER (near) AS pairs, count(*) FILTER (fell) AS fell, count(*) FILTER (fell AND has_treasury) AS with_treasury,
 count(*) FILTER (fell AND NOT has_treasury) AS without_treasury FROM d""", "annual_summary")(
    lambda t: H.suspicious_drops(H.comparable_counts(t.annual_summary)))

query("share_trace", "P25", BASE_SQL + """
SELECT year, paid_in_capital, CAST(floor(implied) AS BIGINT) AS implied, CAST(floor(share_at_period_end) AS BIGINT) AS outstanding,
 CAST(round(implied - share_at_period_end) AS BIGINT) AS gap_shares, round(-100 * rel, 3) AS gap_pct, has_treasury FROM b WHERE symbol = '5'""",
      "annual_summary")(lambda t: H.trace(H.comparable_counts(t.annual_summary), "5"))

query("guard_sensitivity", "V12", """
WITH r AS (SELECT b.*, t AS threshold, coalesce(shares_gap <= 0.005 AND shares_gap >= -t, false) AS u FROM vbm b,
  (SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5, 1.0])::DOUBLE AS t) WHERE bm IS NOT NULL),
s AS (SELECT *, book_equity / nullif(close * CASE WHEN u THEN least(shares_out, shares_issued) ELSE shares_issued END, 0) AS b2 FROM r)
SELECT threshold, count(*) FILTER (u) AS usable, count(*) FILTER (abs(b2 / bm - 1) > 0.01) AS changed_1pct, round(median(b2), 6) AS median_bm
FROM s GROUP BY 1""", "vbm")(
    lambda t: r6(H.guard_sensitivity(chain(t).bm, [0.1, 0.2, 0.3, 0.4, 0.5, 1.0])))

query("flagged_share_rows", "A18", """
SELECT symbol, period, round(shares_gap, 6) AS shares_gap, shares_source, round(bm, 6) AS bm, round(bm / nullif(bm_shares_issued, 0), 6) AS bm_ratio
FROM vbm WHERE bm IS NOT NULL AND (shares_source = 'par_implied' OR bm / nullif(bm_shares_issued, 0) > 1.10)""", "vbm")(
    lambda t: r6(H.flagged_rows(chain(t).bm).select(
        "symbol", "period", "shares_gap", "shares_source", "bm", "bm_ratio")))

# ---- second scorer ----

query("ratio_levels", "C4 W4 P7", "SELECT symbol, period, contiguous, " + ", ".join(
    f"round({c}, 6) AS {c}" for c in "roa cfoa lever liquid margin turn".split()) + " FROM vlevels", "vlevels")(
    lambda t: r6(C.ratio_levels(chain(t).panel).select(
        "symbol", "period", "contiguous", "roa", "cfoa", "lever", "liquid", "margin", "turn")))

query("statement_scores", "C4 C5 P22", "SELECT symbol, period, " + ", ".join(
    f"round({s}, 6) AS raw_{s}, f_{s}" for s in C.SIGNALS)
      + ", CAST(signals_available AS INTEGER) AS signals_available, CAST(f_score AS INTEGER) AS f_score FROM vscores",
      "vscores")(lambda t: C.export_scores(chain(t).scores).withColumns(
          {f"raw_{s}": F.round(f"raw_{s}", 6) for s in C.SIGNALS}))

query("signals_available_counts", "A7 C7", """
SELECT CAST(signals_available AS INTEGER) AS signals_available, count(*) AS rows, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS pct
FROM vscores GROUP BY 1""", "vscores")(lambda t: C.frequency(chain(t).scores, "signals_available"))

query("signal_coverage", "C7", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{s}' AS signal, count(*) FILTER (f_{s}) AS earned, count(*) FILTER (NOT f_{s}) AS not_earned, "
    f"count(*) FILTER (f_{s} IS NULL) AS not_applicable, round(100.0 * count(*) FILTER (f_{s}) / nullif(count(f_{s}), 0), 2) AS earned_pct FROM vscores"
    for s in C.SIGNALS) + ")", "vscores")(lambda t: C.signal_coverage(chain(t).scores))

query("scores_by_period", "A2 A3", """
SELECT period, count(f_score) AS scored, round(avg(f_score), 2) AS mean, count(*) FILTER (f_score >= 8) AS high,
 count(*) FILTER (f_score <= 1) AS low FROM vscores GROUP BY 1""", "vscores")(
    lambda t: C.scores_by_period(chain(t).scores))

query("leverage_zero_point", "C6", """
SELECT count(*) AS scored_rows, count(*) FILTER (d_lever < 0) AS negative, count(*) FILTER (d_lever > 0) AS positive, count(*) FILTER (d_lever = 0) AS zero,
 count(*) FILTER (d_lever = 0 AND long_term_debt = 0 AND long_term_debt_prev = 0) AS zero_no_debt,
 count(*) FILTER (d_lever = 0 AND (long_term_debt > 0 OR long_term_debt_prev > 0)) AS zero_with_debt,
 round(avg(f_score), 3) AS mean_score, round(avg(f_score + CAST(d_lever = 0 AS INTEGER)), 3) AS mean_score_loose
FROM vscores WHERE f_score IS NOT NULL""", "vscores")(lambda t: C.leverage_zero_point(chain(t).scores))

query("leverage_rule_shift", "C6 A8", """
WITH a AS (SELECT period, f_score, coalesce(f_score >= 5, false) AS s,
  coalesce(f_score - CAST(f_d_lever AS INTEGER) + CAST(d_lever <= 0 AS INTEGER) >= 5, false) AS l FROM vscores)
SELECT coalesce(period, 'ALL') AS period, count(f_score) AS scored, count(*) FILTER (s) AS strict, count(*) FILTER (l) AS loose,
 count(*) FILTER (s AND NOT l) AS lost, count(*) FILTER (l) - count(*) FILTER (s) AS added,
 round(100.0 * (count(*) FILTER (l) - count(*) FILTER (s)) / nullif(count(*) FILTER (s), 0), 1) AS added_pct FROM a GROUP BY ROLLUP (period)""",
      "vscores")(lambda t: C.leverage_rule_shift(chain(t).raw_scores, 5))

# ---- liquidity screen ----

query("repeated_blocks", "W3", """
WITH b AS (SELECT *, lag(putthrough_volume) OVER w AS p, lag(deal_volume) OVER w AS d FROM vbars WHERE unit = 1000
 WINDOW w AS (PARTITION BY symbol ORDER BY date))
SELECT CAST(year(date) AS INTEGER) AS year, count(*) AS bars, count(*) FILTER (putthrough_volume > 0 AND putthrough_volume = p) AS pv_repeat_bars,
 count(*) FILTER (deal_volume > 0 AND deal_volume = d) AS dv_repeat_bars,
 round(100.0 * coalesce(sum(putthrough_volume) FILTER (putthrough_volume > 0 AND putthrough_volume = p), 0) / nullif(sum(total_volume), 0), 2) AS pv_repeat_vol_pct
FROM b GROUP BY 1""", "vbars")(lambda t: N.repeated_blocks(chain(t).bars))

query("window_calendar", "N1 A4", "SELECT * FROM vcalendar", "vcalendar")(
    lambda t: N.window_calendar(chain(t).bars))

query("window_volumes", "N2", """
SELECT symbol, formation_year, bars, traded_sessions, deal_volume, total_volume, round(deal_value, 7) AS deal_value, last_bar FROM vwindow""",
      "vwindow")(lambda t: N.window_volumes(chain(t).bars).withColumn("deal_value", F.round("deal_value", 7)))

query("turnover_screen", "N3 N4 J13", """
SELECT symbol, period, formation_year, traded_pct, round(turnover, 9) AS turnover, round(turnover_issued, 9) AS turnover_issued,
 round(turnover_total, 9) AS turnover_total, putthrough_pct, round(adtv, 1) AS adtv, round(min_turnover, 9) AS min_turnover, tradeable FROM vtrade""",
      "vtrade")(lambda t: chain(t).turnover.select(
          "symbol", "period", "formation_year", "traded_pct", *[F.round(c, 9).alias(c) for c in (
              "turnover", "turnover_issued", "turnover_total", "min_turnover")],
          "putthrough_pct", F.round("adtv", 1).alias("adtv"), "tradeable"))

query("turnover_coverage", "N5 W5", """
SELECT count(*) AS rows, count(turnover) AS with_window, count(*) FILTER (bars IS NULL) AS no_bars, count(*) FILTER (shares_source = 'outstanding') AS vendor_count,
 count(*) FILTER (turnover IS NOT NULL AND deal_volume = 0) AS zero_volume, count(*) FILTER (turnover IS NOT NULL AND deal_volume = 0 AND traded_pct >= 50) AS zero_but_traded,
 count(*) FILTER (bars < market_sessions / 2) AS listed_under_half, count(*) FILTER (raised_next) AS raised_next FROM vtrade""", "vtrade")(
    lambda t: N.turnover_coverage(chain(t).turnover))

query("turnover_by_period", "N5 A5", """
SELECT period, max(formation_year) AS formation, count(*) AS rows, count(turnover) AS with_window, round(max(min_turnover), 9) AS min_turnover,
 count(*) FILTER (tradeable) AS tradeable, round(100.0 * count(*) FILTER (tradeable) / nullif(count(turnover), 0), 1) AS kept_pct,
 round(median(turnover), 9) AS med_turnover, round(median(traded_pct), 6) AS med_traded_pct FROM vtrade GROUP BY 1""", "vtrade")(
    lambda t: N.turnover_by_period(chain(t).turnover).withColumns({
        "min_turnover": F.round("min_turnover", 9), "med_turnover": F.round("med_turnover", 9),
        "med_traded_pct": F.round("med_traded_pct", 6)}))

query("floor_sensitivity", "N5", """
SELECT floor, count(*) FILTER (turnover IS NOT NULL AND traded_pct >= floor) AS floor_only,
 count(*) FILTER (turnover IS NOT NULL AND traded_pct >= floor AND turnover > min_turnover) AS both_screens,
 count(*) FILTER (turnover IS NOT NULL AND traded_pct >= floor AND NOT turnover > min_turnover) AS turnover_removes
FROM vtrade, (SELECT unnest([0, 10, 25, 50, 75, 90])::INTEGER AS floor) GROUP BY 1""", "vtrade")(
    lambda t: N.floor_sensitivity(chain(t).turnover, [0, 10, 25, 50, 75, 90]))

query("screen_cost", "N5 A8", """
WITH a AS (SELECT s.period, coalesce(f_score >= 6, false) AS s, tradeable AS v FROM vscores s LEFT JOIN vtrade t USING (symbol, period))
SELECT coalesce(period, 'ALL') AS period, count(*) FILTER (s) AS selected, count(*) FILTER (s AND coalesce(v, false)) AS tradeable,
 count(*) FILTER (s AND v = false) AS dropped, count(*) FILTER (s AND v IS NULL) AS no_window,
 round(100.0 * count(*) FILTER (s AND coalesce(v, false)) / nullif(count(*) FILTER (s), 0), 1) AS kept_pct FROM a GROUP BY ROLLUP (period)""",
      "vscores vtrade")(lambda t: N.filter_cost(chain(t).turnover, chain(t).scores, 6))

query("turnover_basis_flips", "N5", """
SELECT count(turnover) AS rows, count(*) FILTER (turnover / nullif(turnover_issued, 0) > 1.0001) AS rose, count(*) FILTER (tradeable_issued) AS tradeable_issued,
 count(*) FILTER (tradeable) AS tradeable, count(*) FILTER (coalesce(tradeable, false) AND NOT coalesce(tradeable_issued, false)) AS flipped_in,
 count(*) FILTER (coalesce(tradeable_issued, false) AND NOT coalesce(tradeable, false)) AS flipped_out FROM vtrade""", "vtrade")(
    lambda t: N.basis_flips(chain(t).turnover))

# ---- prices, returns, export ----

query("entry_prices", "J8 N8", """
SELECT symbol, period, price_date, entry_lead_days, price_traded, round(close_raw, 4) AS close_raw, adj_ratio, round(close_adj, 4) AS close_adj FROM ventry""",
      "ventry")(lambda t: N.entry_prices(chain(t).bars).withColumns({
          "close_raw": F.round("close_raw", 4), "close_adj": F.round("close_adj", 4)}))

query("panel_key_agreement", "J10 O3", """
SELECT (SELECT count(*) FROM (SELECT symbol, period FROM vscores EXCEPT SELECT symbol, period FROM vbm)) AS scores_only,
 (SELECT count(*) FROM (SELECT symbol, period FROM vbm EXCEPT SELECT symbol, period FROM vscores)) AS bm_only,
 (SELECT count(*) FROM (SELECT symbol, period FROM vtrade EXCEPT SELECT symbol, period FROM vbm)) AS turnover_only""", "vscores vbm vtrade")(
    lambda t: chain(t).key_differences())

query("share_column_agreement", "J10", """
SELECT count(*) AS rows FROM vbm a JOIN vtrade b USING (symbol, period) WHERE a.shares IS DISTINCT FROM b.shares OR a.shares_source <> b.shares_source""", "vbm vtrade")(
    lambda t: chain(t).share_disagreements())

query("final_panel", "J7 J10 N9 N10", """
SELECT symbol, period, CAST(f_score AS INTEGER) AS f_score, round(bm, 6) AS bm, round(turnover, 9) AS turnover, tradeable, price_date, entry_lead_days,
 exit_date, exit_price_date, round(close_adj_exit, 4) AS close_adj_exit, exit_lag_days, holding_complete, exit_permanent, round(fwd_return_1y, 6) AS fwd_return_1y FROM vfinal""",
      "vfinal")(lambda t: chain(t).final.select(
          "symbol", "period", "f_score", F.round("bm", 6).alias("bm"), F.round("turnover", 9).alias("turnover"),
          "tradeable", "price_date", "entry_lead_days", "exit_date", "exit_price_date",
          F.round("close_adj_exit", 4).alias("close_adj_exit"), "exit_lag_days", "holding_complete",
          "exit_permanent", F.round("fwd_return_1y", 6).alias("fwd_return_1y")))

query("delisting_policies", "N10", """
WITH p AS (SELECT * FROM (VALUES ('last traded price', NULL), ('-30%', -0.30), ('-50%', -0.50), ('-100%', -1.0)) t(policy, v)),
r AS (SELECT policy, coalesce(f_score >= 6, false) AS sel, CASE WHEN exit_permanent AND v IS NOT NULL THEN v::DOUBLE ELSE fwd_return_1y END AS ret
 FROM vfinal, p WHERE holding_complete)
SELECT policy, round(avg(ret), 6) AS mean, round(avg(ret) FILTER (sel), 6) AS mean_selected, round(median(ret), 6) AS median,
 round(median(ret) FILTER (sel), 6) AS median_selected FROM r GROUP BY 1""", "vfinal")(
    lambda t: r6(N.delisting_policies(chain(t).final, [None, -0.30, -0.50, -1.00], F.col("f_score") >= 6)))

query("entry_lead_buckets", "N18", """
SELECT count(entry_lead_days) AS priced, count(*) FILTER (entry_lead_days <= 2) AS near, count(*) FILTER (entry_lead_days > 2 AND entry_lead_days <= 30) AS middle,
 count(*) FILTER (entry_lead_days > 30) AS far, max(entry_lead_days) AS longest FROM vfinal""", "vfinal")(
    lambda t: N.lag_buckets(chain(t).final, "entry_lead_days", 2, 30))

query("exit_lag_buckets", "N18", """
SELECT count(exit_lag_days) AS priced, count(*) FILTER (exit_lag_days <= 3) AS near, count(*) FILTER (exit_lag_days > 3 AND exit_lag_days <= 30) AS middle,
 count(*) FILTER (exit_lag_days > 30) AS far, max(exit_lag_days) AS longest FROM vfinal WHERE holding_complete""", "vfinal")(
    lambda t: N.lag_buckets(chain(t).final.where("holding_complete"), "exit_lag_days", 3, 30))

query("forward_return_by_period", "N19", """
SELECT period, count(*) FILTER (i) AS investable, count(*) FILTER (i AND f_score >= 6) AS selected, count(*) FILTER (i AND exit_permanent) AS gone,
 round(median(fwd_return_1y) FILTER (i), 6) AS inv_median, round(median(fwd_return_1y) FILTER (i AND f_score >= 6), 6) AS sel_median
FROM (SELECT *, investable AND holding_complete AS i FROM vfinal) GROUP BY 1""", "vfinal")(
    lambda t: r6(N.return_by_period(chain(t).final, chain(t).investable(), F.col("f_score") >= 6)))

query("investable_funnel", "N11", """
WITH f AS (SELECT f_score IS NOT NULL AS a, bm IS NOT NULL AS b, turnover IS NOT NULL AS c, close_raw IS NOT NULL AS d, coalesce(tradeable, false) AS e,
  coalesce(f_score >= 6, false) AS g FROM vfinal),
n AS (SELECT * FROM (SELECT 0 AS step, 'scored' AS gate, count(*) FILTER (a) AS rows FROM f UNION ALL SELECT 1, 'has_bm', count(*) FILTER (a AND b) FROM f
 UNION ALL SELECT 2, 'has_turnover', count(*) FILTER (a AND b AND c) FROM f UNION ALL SELECT 3, 'has_price', count(*) FILTER (a AND b AND c AND d) FROM f
 UNION ALL SELECT 4, 'tradeable', count(*) FILTER (a AND b AND c AND d AND e) FROM f UNION ALL SELECT 5, 'selected', count(*) FILTER (a AND b AND c AND d AND e AND g) FROM f))
SELECT step, gate, rows, round(100.0 * rows / (SELECT nullif(rows, 0) FROM n WHERE step = 0), 1) AS pct_of_scored FROM n""", "vfinal")(
    lambda t: chain(t).funnel(6))

query("funnel_by_period", "N11 A2", """
SELECT period, max(formation_year) AS formation, count(*) AS rows, count(*) FILTER (investable) AS investable,
 count(*) FILTER (investable AND f_score >= 6) AS selected FROM vfinal GROUP BY 1""", "vfinal")(
    lambda t: chain(t).funnel_by_period(6))

query("exclusion_ledger", "N12 T16", """
SELECT CAST(e.period AS INTEGER) AS score_year, count(*) AS rows_in_source, count(*) FILTER (signals_available IS NULL) AS dropped_failed_accounting_checks,
 count(*) FILTER (signals_available = 1) AS dropped_no_prior_year, count(*) FILTER (signals_available <> 1 AND f_score IS NULL) AS dropped_incomplete_signals,
 0::BIGINT AS dropped_unresolved_identifier, count(*) FILTER (f_score IS NOT NULL AND bm IS NULL) AS dropped_no_book_to_market,
 count(*) FILTER (f_score IS NOT NULL AND bm IS NOT NULL AND turnover IS NULL) AS dropped_no_june_turnover,
 count(*) FILTER (f_score IS NOT NULL AND bm IS NOT NULL AND turnover IS NOT NULL AND close_raw IS NULL) AS dropped_no_formation_price,
 count(*) FILTER (f_score IS NOT NULL AND bm IS NOT NULL AND turnover IS NOT NULL AND close_raw IS NOT NULL AND NOT coalesce(tradeable, false)) AS dropped_below_liquidity_gate,
 count(*) FILTER (investable) AS scored FROM vextract e LEFT JOIN vfinal f USING (symbol, period) GROUP BY 1""", "vextract vfinal")(
    lambda t: chain(t).ledger())

query("export_panel_rows", "N13 P1 J5 P21", """
SELECT f.symbol AS ticker, CAST(period AS INTEGER) AS score_year, CAST(period AS INTEGER) AS fiscal_year, CAST(f_score AS INTEGER) AS fscore, round(bm, 6) AS bm,
 CAST(f_roa AS INTEGER) AS f_roa, CAST(f_cfoa AS INTEGER) AS f_cfo, CAST(f_d_roa AS INTEGER) AS f_droa, CAST(f_accrual AS INTEGER) AS f_accrual,
 CAST(f_d_lever AS INTEGER) AS f_dlever, CAST(f_d_liquid AS INTEGER) AS f_dliquid, CAST(f_eq_offer AS INTEGER) AS f_eq_offer,
 CAST(f_d_margin AS INTEGER) AS f_dmargin, CAST(f_d_turn AS INTEGER) AS f_dturn, coalesce(s.sector, 'Unknown') AS sector
FROM vfinal f LEFT JOIN sectors s ON s.ticker = f.symbol WHERE investable""", "vfinal sectors")(
    lambda t: chain(t).export().withColumn("bm", F.round("bm", 6)))

_FLAG_SUM = " + ".join(f"CAST({f} AS INTEGER)" for f in P.EXPORT_FLAGS)
_CLAUSES = [("score_year present", "period IS NULL"), ("ticker present", "symbol IS NULL"), ("fscore present", "f_score IS NULL"),
            ("sector present", "false"), ("bm present", "bm IS NULL"), ("score in 0..9", "NOT f_score BETWEEN 0 AND 9"),
            ("flags binary", " OR ".join(f"{f} IS NULL" for f in P.EXPORT_FLAGS)),
            ("flags sum to score", f"{_FLAG_SUM} <> f_score"), ("bm positive", "NOT bm > 0")]
query("export_contract", "V10", """
SELECT 'unique on (score_year, ticker)' AS "check", count(*) - count(DISTINCT (symbol, period)) AS failing FROM vfinal WHERE investable
""" + "".join(f"UNION ALL SELECT '{n}', count(*) FILTER ({bad}) FROM vfinal WHERE investable\n" for n, bad in _CLAUSES), "vfinal")(
    lambda t: chain(t).export_contract())

query("export_prices", "S6 P13 P21", """
SELECT symbol AS ticker, date, round(price_close * unit / adj_ratio, 4) AS adj_close, CAST(round(deal_volume) AS BIGINT) AS volume FROM vbars
WHERE unit = 1000 AND price_close > 0 AND adj_ratio > 0 AND symbol IN (SELECT symbol FROM vfinal WHERE investable)""", "vbars vfinal")(
    lambda t: N.export_prices(chain(t).bars, chain(t).final.where(chain(t).investable())))

query("reduced_fundamentals", "N16 P6 P20 T2", """
SELECT symbol AS ticker, CAST(period AS INTEGER) AS fiscal_year, make_date(CAST(period AS INTEGER), 12, 31) AS report_date,
 round(CASE WHEN book_equity > 0 THEN book_equity END, 4) AS book_value, round(market_equity, 4) AS market_cap FROM vfinal""", "vfinal")(
    lambda t: chain(t).reduced_fundamentals().withColumns({
        "book_value": F.round("book_value", 4), "market_cap": F.round("market_cap", 4)}))

query("index_levels", "S16", """
SELECT symbol AS ticker, date, round(price_close * unit / adj_ratio, 4) AS adj_close, total_volume AS volume FROM vbars WHERE symbol = 'INDEX'""",
      "vbars")(lambda t: N.index_levels(chain(t).bars, ["INDEX"]).withColumn("adj_close", F.round("adj_close", 4)))

query("absent_benchmarks", "S16 J4", """
SELECT s AS symbol FROM (SELECT unnest(['INDEX', 'NOSUCH']) AS s) WHERE s NOT IN (SELECT symbol FROM vbars)""", "vbars")(
    lambda t: N.absent_symbols(chain(t).bars, ["INDEX", "NOSUCH"]))
