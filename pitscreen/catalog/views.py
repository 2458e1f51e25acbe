"""SQL views the query equivalents are written over (DuckDB dialect)."""

from __future__ import annotations

import re

VIEWS: dict[str, str] = {}

VIEWS["statements"] = """
SELECT l_suppkey AS firm_no, CAST(l_suppkey AS VARCHAR) AS ticker, fiscal_year,
       make_date(fiscal_year, 12, 31) AS report_date,
       round(gross, 4) AS total_assets,
       round(rev - 2 * cost - tax, 4) AS net_income,
       round(rev - 2 * cost - tax + swing, 4) AS cfo,
       round(debt, 4) AS long_term_debt, round(ca, 4) AS current_assets,
       round(cl, 4) AS current_liabilities, round(shares, 4) AS shares_outstanding,
       CASE WHEN l_suppkey % 3 <> 0 THEN round(issued, 4) END AS equity_issued,
       round(rev, 4) AS revenue, round(2 * cost, 4) AS cogs,
       round(gross - debt, 4) AS book_value
FROM (SELECT l_suppkey, CAST(year(l_shipdate) AS INTEGER) AS fiscal_year,
             sum(l_extendedprice) AS gross,
             sum(l_extendedprice * (1 - l_discount)) AS rev,
             sum(l_quantity * p_retailprice) AS cost,
             sum(l_extendedprice * l_tax) AS tax,
             sum(CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE -1 END * l_extendedprice * l_discount) AS swing,
             coalesce(sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice END), 0.0) AS debt,
             sum(CASE WHEN l_linenumber <= 3 THEN l_extendedprice END) AS ca,
             sum(CASE WHEN l_linenumber > 3 THEN l_extendedprice END) AS cl,
             sum(l_quantity) AS shares,
             sum(CASE WHEN l_discount = 0 AND l_tax = 0 THEN l_extendedprice ELSE 0 END) AS issued
      FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2)
"""

VIEWS["bars"] = """
SELECT ticker, date, adj_close, adj_close * adj_ratio AS close_raw, adj_ratio, volume, deal_volume
FROM (SELECT ticker, date, volume, deal_volume,
             CASE WHEN year(date) < 1997 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS adj_ratio,
             round(100 * exp(sum(x) OVER (PARTITION BY ticker ORDER BY date)), 4) AS adj_close
      FROM (SELECT CAST(l_suppkey AS VARCHAR) AS ticker, CAST(l_shipdate AS DATE) AS date,
                   avg(l_discount) - 0.05 AS x, sum(l_quantity) AS volume,
                   sum(CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE 0 END) AS deal_volume
            FROM lineitem GROUP BY 1, 2))
WHERE NOT (substr(md5(ticker), 1, 1) = '0' AND date > DATE '1999-10-15')
"""

VIEWS["prices"] = "SELECT ticker, date, adj_close, close_raw, volume FROM bars"

VIEWS["fundamentals"] = """
SELECT s.* EXCLUDE (firm_no), shares_outstanding *
       (SELECT max_by(p.close_raw, p.date) FROM prices p WHERE p.ticker = s.ticker
          AND p.date <= s.report_date AND p.date >= s.report_date - 14) AS market_cap
FROM statements s
"""

VIEWS["filed"] = """
SELECT * REPLACE (CAST(report_date + to_months(CAST(ticker AS INTEGER) % 4) AS DATE) AS report_date)
FROM fundamentals
"""

VIEWS["sectors"] = """
SELECT CAST(s_suppkey AS VARCHAR) AS ticker, s_name AS name, r_name AS sector
FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey
"""

VIEWS["membership"] = """
SELECT make_date(y, 7, 1) AS date, CAST(s_suppkey AS VARCHAR) AS ticker
FROM supplier, (SELECT CAST(unnest(range(1996, 2002)) AS INTEGER) AS y)
WHERE substr(md5(concat(y, ':', s_suppkey)), 1, 1) < 'd'
"""

VIEWS["benchmarks"] = """
SELECT * FROM (
 SELECT 'INDEX' AS ticker, date, mean * CASE WHEN day(date) = 15 AND month(date) = 5 THEN 2.0 ELSE 1.0 END AS adj_close, volume FROM bench_day
 UNION ALL SELECT 'ETF', date, mean * 2 + 50, volume FROM bench_day
 UNION ALL SELECT 'FX', date, CASE WHEN dayofweek(date) <> 0 THEN 100 + dayofyear(date) * 0.1::DOUBLE END, volume FROM bench_day)
WHERE adj_close IS NOT NULL
"""
VIEWS["bench_day"] = """
SELECT date, round(avg(adj_close) * 0.9973::DOUBLE, 4) AS mean, round(sum(volume), 4) AS volume FROM prices GROUP BY date
"""

VIEWS["vendor_bars"] = """
SELECT ticker AS symbol, strftime(date, '%Y-%m-%d') AS date, close_raw / 1000 AS price_close,
       close_raw * 0.99 / 1000 AS price_average, 1000.0::DOUBLE AS unit, adj_ratio,
       volume AS total_volume, deal_volume, volume - deal_volume AS putthrough_volume
FROM bars
UNION ALL
SELECT ticker, strftime(date, '%Y-%m-%d'), adj_close, adj_close, 1.0, 1.0, volume, 0.0, 0.0
FROM benchmarks WHERE ticker = 'INDEX'
"""

VIEWS["vendor_statements"] = """
WITH a AS (
 SELECT s.*, ticker AS symbol, CAST(fiscal_year AS VARCHAR) AS period, book_value AS equity_section,
        book_value AS owner_equity,
        CASE WHEN firm_no % 4 = 0 THEN round(book_value * 0.05, 4) END AS minority_interest,
        CASE WHEN firm_no % 3 = 0 THEN firm_no * 2.0e7 WHEN fiscal_year % 2 = 0 THEN shares_outstanding * 10000
             ELSE floor(shares_outstanding / 500) * 500.0 * 10000 END AS paid_in_capital,
        CASE WHEN firm_no % 5 = 0 THEN -1000.0::DOUBLE * firm_no WHEN firm_no % 5 = 1 THEN 0.0 END AS treasury_stock,
        revenue AS net_sales,
        revenue - cogs + CASE WHEN firm_no % 19 = 0 THEN total_assets * 0.01 ELSE 0.0 END AS gross_profit,
        net_income AS net_income_total,
        CASE WHEN firm_no % 4 = 0 THEN round(net_income * 0.03, 4) ELSE 0.0 END AS net_income_minority,
        cfo AS cfo_direct, round(-0.3 * total_assets, 4) AS cfi, round(0.2 * long_term_debt, 4) AS cff,
        CASE WHEN firm_no % 2 = 0 THEN 0.0::DOUBLE END AS fx_effect, current_assets AS cash_begin,
        CASE WHEN firm_no % 29 = 0 THEN -equity_issued ELSE equity_issued END AS stock_issuance_proceeds
 FROM statements s),
b AS (
 SELECT * REPLACE (CASE WHEN firm_no % 6 <> 0 THEN cfo END AS cfo),
        CASE WHEN firm_no % 13 = 0 AND fiscal_year = 1998 THEN long_term_debt * 1.05
             WHEN firm_no % 17 = 0 THEN long_term_debt + minority_interest
             ELSE long_term_debt END AS total_liabilities,
        net_income_total - net_income_minority AS net_income_parent,
        cfo_direct + cff + cfi AS net_cash_flow FROM a)
SELECT *, total_liabilities - current_liabilities AS long_term_liabilities,
       cash_begin + net_cash_flow + CASE WHEN firm_no % 23 = 0 THEN total_assets * 0.02 ELSE 0.0 END AS cash_end
FROM b
"""

VIEWS["annual_summary"] = """
SELECT symbol, fiscal_year AS year, paid_in_capital, treasury_stock,
       CASE WHEN n % 11 = 0 THEN NULL
            WHEN n % 7 = 0 THEN max(shares_outstanding) OVER (PARTITION BY symbol)
            WHEN n % 5 = 0 THEN round(paid_in_capital / 10000 * 0.92, 0)
            ELSE paid_in_capital / 10000 END AS share_at_period_end,
       round(shares_outstanding / book_value * 100, 6) AS pb, quarter
FROM (SELECT *, CAST(symbol AS INTEGER) AS n FROM vendor_statements), (SELECT unnest([0, 4]) AS quarter)
"""

VIEWS["coverage_grid"] = """
SELECT ticker AS symbol,
""" + ",\n".join(
    f"CAST(sum(CASE WHEN fiscal_year = {y} THEN least(CAST(ticker AS INTEGER) % 8, 4) ELSE 0 END) AS INTEGER) AS \"{y}\""
    for y in range(1995, 2002)) + "\nFROM statements GROUP BY ticker"


def _mentions(text: str) -> list[str]:
    return [v for v in VIEWS if re.search(rf"\b{v}\b", text)]


def with_views(names: list[str], body: str) -> str:
    """``body`` preceded by the views it needs, dependencies first."""
    done: list[str] = []

    def visit(name: str) -> None:
        if name in done:
            return
        for dep in _mentions(VIEWS[name]):
            if dep != name:
                visit(dep)
        done.append(name)

    for n in names:
        visit(n)
    if not done:
        return body.strip()
    ctes = ",\n".join(f"{n} AS MATERIALIZED ({VIEWS[n].strip()})" for n in done)
    body = body.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
