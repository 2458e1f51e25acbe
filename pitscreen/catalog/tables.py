"""Sources, sinks, facts, identifiers and table merging."""

from uuid import uuid4

from pyspark.sql import functions as F

from pitscreen.catalog.registry import query
from pitscreen.catalog.series import factors
from pitscreen.catalog.study import r6, study
from pitscreen.catalog.views import VIEWS
from pitscreen.functions import numeric as N, symbols as Y
from pitscreen.functions.dates import FISCAL_YEAR_END, fiscal_end, fiscal_label
from pitscreen.operators import checks as V, membership as MB, scoring as S, tables as O
from pitscreen.operators.ordering import beside, spread_rank
from pitscreen.session import land, shared_folder
from pitscreen.sources import facts as X, markets, refresh as R, tables as T, workbooks as W
from pitscreen.sources.schemas import FLAGS
from pitscreen.sources.standin import FACTS_SQL


def scratch(t, name: str) -> str:
    return f"{shared_folder(t.spark).rstrip('/')}/written/{name}-{uuid4().hex}"


# ---- files ----

@query("market_files", "S1 S2 S3 S9 S19", """
SELECT f.ticker, fiscal_year, report_date, round(total_assets, 4) AS total_assets, n FROM fundamentals f
LEFT JOIN (SELECT ticker, count(*) AS n FROM prices GROUP BY 1) p ON p.ticker = f.ticker""", "fundamentals prices")
def _market_files(t):
    folder = scratch(t, "market")
    T.write_table(t.fundamentals, f"{folder}/us_fundamentals.csv", "csv")
    T.write_table(t.prices, f"{folder}/us_prices.csv.gz", "csv.gz")
    T.write_table(t.sectors, f"{folder}/us_sectors.csv", "csv")
    T.write_table(t.benchmarks, f"{folder}/us_benchmarks.csv.gz", "csv.gz")
    m = T.load_market(t.spark, "us", folder)
    n = m.prices.groupBy("ticker").agg(F.count("*").alias("n"))
    return (m.fundamentals.select("ticker", "fiscal_year", "report_date", F.round("total_assets", 4).alias("total_assets"))
            .join(n, "ticker", "left"))


@query("yearly_parts", "S4 O6", """
SELECT fiscal_year AS year, count(*) AS rows, round(sum(revenue), 4) AS revenue FROM fundamentals WHERE fiscal_year >= 1998 GROUP BY 1""", "fundamentals")
def _yearly(t):
    path = scratch(t, "yearly")
    T.write_table(t.fundamentals.withColumn("year", F.col("fiscal_year")), path, by=["year"])
    return (T.read_yearly(t.spark, path).where(F.col("year") >= 1998).groupBy("year")
            .agg(F.count("*").alias("rows"), F.round(F.sum("revenue"), 4).alias("revenue")))


@query("workbook_sheets", "S4 O6", """
SELECT fiscal_year AS year, count(*) AS rows, round(sum(total_assets), 4) AS total_assets,
       round(sum(CASE WHEN fiscal_year >= 1998 THEN revenue END), 4) AS revenue, max(report_date) AS last_report
FROM fundamentals WHERE fiscal_year >= 1996 GROUP BY 1""", "fundamentals")
def _workbook_sheets(t):
    """Two sets of workbooks, the older one without a column, read as one table: a sheet a fiscal year."""
    path = scratch(t, "workbooks")
    f = t.fundamentals.select("ticker", "fiscal_year", "report_date", "total_assets", "revenue")
    W.write_workbooks(f.where("fiscal_year < 1998").drop("revenue"), path, "fiscal_year")
    W.write_workbooks(f.where("fiscal_year >= 1998"), path, "fiscal_year")
    sheets = W.read_workbooks(t.spark, path, f"ticker string, year {f.schema['fiscal_year'].dataType.simpleString()}, "
                              "report_date date, total_assets double, revenue double", r"199[6-9]|[2-9]\d{3}", "year")
    return sheets.groupBy("year").agg(F.count("*").alias("rows"), F.round(F.sum("total_assets"), 4).alias("total_assets"),
                                      F.round(F.sum("revenue"), 4).alias("revenue"), F.max("report_date").alias("last_report"))


@query("factor_file", "S15", """
SELECT date, round(round(mkt_rf * 100, 4) / 100, 8) AS mkt_rf, round(round(smb * 100, 4) / 100, 8) AS smb FROM ff_factors
WHERE smb IS NOT NULL AND hml IS NOT NULL""", "ff_factors")
def _factor_file(t):
    path = scratch(t, "factors")
    pct = lambda c: F.format_string("%.4f", F.round(F.col(c) * 100, 4))
    line = F.concat_ws(",", F.date_format("date", "yyyyMMdd"), *[F.concat(F.lit("  "), pct(c)) for c in ("mkt_rf", "smb", "hml", "rf")])
    notes = t.spark.createDataFrame([("Three factors, daily, per cent",), (",Mkt-RF,SMB,HML,RF",), ("",), ("  Copyright",), ("1999,  1.0",)], "value string")
    factors(t).select(line.alias("value")).unionByName(notes).write.text(path)
    return T.read_factor_file(t.spark, path).select("date", F.round("mkt_rf", 8).alias("mkt_rf"), F.round("smb", 8).alias("smb"))


@query("wide_prices_to_long", "S21", """
SELECT ticker, date, adj_close, adj_close * 2 AS close_raw, volume FROM benchmarks""", "benchmarks")
def _wide(t):
    names = ["INDEX", "ETF", "FX"]
    wide = lambda v: t.benchmarks.groupBy("date").pivot("ticker", names).agg(F.first(v))
    b = t.benchmarks.withColumn("close", F.col("adj_close") * 2)
    close = b.groupBy("date").pivot("ticker", names).agg(F.first("close"))
    return T.long_prices(wide("adj_close"), close, wide("volume")).select("ticker", "date", "adj_close", "close_raw", "volume")


def _not_needed():
    raise AssertionError("a fresh stored table is not built again")


@query("stored_panel_reuse", "S17 S18", "SELECT count(*) AS bars, min(date) AS first FROM prices", "prices")
def _reuse(t):
    path = scratch(t, "reuse")
    T.reuse_or_build(t.spark, path, lambda: t.prices.drop("close_raw"), lambda _: True)
    px = T.reuse_or_build(t.spark, path + "-b", lambda: t.prices, T.prices_fresh("1995-06-30"))
    px = T.reuse_or_build(t.spark, path + "-b", _not_needed, T.prices_fresh("1995-06-30"))
    return px.agg(F.count("*").alias("bars"), F.min("date").alias("first"))


@query("stale_years_rewritten", "S17 S18 O4", """
SELECT fiscal_year, fiscal_year = (SELECT max(fiscal_year) - 1 FROM fundamentals) AS rewritten, count(*) AS rows,
 round(sum(total_assets + CASE WHEN fiscal_year = (SELECT max(fiscal_year) - 1 FROM fundamentals) THEN 1 ELSE 0 END), 2) AS total
FROM fundamentals WHERE fiscal_year > (SELECT min(fiscal_year) FROM fundamentals) GROUP BY fiscal_year""", "fundamentals")
def _stale_years(t):
    """One year of the inputs changes and another goes: which partitions have new files, and what the table holds."""
    path, year = scratch(t, "refreshed"), "fiscal_year"
    inputs = t.fundamentals.select("ticker", year, "total_assets")
    build = lambda df: df.withColumn("assets_in_millions", F.col("total_assets") / 1e6)
    files = lambda: spark_files(t.spark.read.parquet(path), year)
    R.refresh(t.spark, path, inputs, year, build)
    before = land(files(), "files-before")
    ends = inputs.agg(F.min(year).alias("least"), F.max(year).alias("most")).first()  # one row
    changed = (inputs.where(F.col(year) > ends["least"])
               .withColumn("total_assets", F.col("total_assets") + F.when(F.col(year) == ends["most"] - 1, 1).otherwise(0)))
    R.refresh(t.spark, path, changed, year, build)
    same = files().join(before.withColumnRenamed("files", "_files"), year)
    return (R.read_refreshed(t.spark, path, year).groupBy(year).agg(F.count("*").alias("rows"), F.round(F.sum("total_assets"), 2).alias("total"))
            .join(same, year).select(year, (F.col("files") != F.col("_files")).alias("rewritten"), "rows", "total"))


def spark_files(df, by):
    """(by, files): the files of each partition."""
    return df.select(by, F.col("_metadata.file_path").alias("f")).groupBy(by).agg(F.sort_array(F.collect_set("f")).alias("files"))


@query("checked_writes", "V10 A11 S16", """
SELECT a.attempt, count(*) AS rows, count(*) FILTER (total_assets IS NULL) AS no_assets,
 CASE WHEN attempt = 2 THEN count(*) FILTER (net_income IS NULL OR net_income <= 0) ELSE 0 END AS losses,
 count(*) FILTER (total_assets IS NULL) = 0 AND (attempt = 1 OR count(*) FILTER (net_income IS NULL OR net_income <= 0) = 0) AS published,
 count(*) AS readable
FROM fundamentals, (SELECT unnest([1, 2]) AS attempt) a GROUP BY a.attempt""", "fundamentals")
def _checked_writes(t):
    """A write that keeps its contract, then one that breaks it: readers still see the first."""
    path, out = scratch(t, "checked"), []
    rules = {"no_assets": F.col("total_assets").isNotNull()}
    for attempt, more in ((1, {}), (2, {"losses": F.col("net_income") > 0})):
        try:
            seen, published = R.write_checked(t.fundamentals, path, rules | more), True
        except R.ContractBreach as breach:
            seen, published = breach.observed, False
        readable = R.read_published(t.spark, path).count()
        out.append((attempt, seen["rows"], seen["no_assets"], seen.get("losses", 0), published, readable))
    return t.spark.createDataFrame(out, "attempt int, rows long, no_assets long, losses long, published boolean, readable long")


query("deepened_prices", "S20", """
WITH cut AS (SELECT * FROM prices WHERE ticker IN (SELECT ticker FROM sectors WHERE sector <> 'ASIA') OR date >= DATE '1997-01-01'),
late AS (SELECT ticker FROM cut GROUP BY 1 HAVING min(date) > DATE '1996-01-01')
SELECT ticker, date, adj_close FROM cut
UNION ALL SELECT ticker, date, adj_close + 1 FROM prices p WHERE ticker IN (SELECT ticker FROM late)
 AND NOT EXISTS (SELECT 1 FROM cut c WHERE c.ticker = p.ticker AND c.date = p.date)""", "prices sectors")(
    lambda t: O.deepen(
        t.prices.join(t.sectors.select("ticker", "sector"), "ticker")
        .where((F.col("sector") != "ASIA") | (F.col("date") >= "1997-01-01")).select(*t.prices.columns),
        t.prices.withColumn("adj_close", F.col("adj_close") + 1), "1996-01-01").select("ticker", "date", "adj_close"))

# ---- company facts ----

VIEWS["fact_rows"] = "SELECT * FROM (" + FACTS_SQL.format(src="statements") + ") WHERE val IS NOT NULL"
_TAGS = " UNION ALL ".join(
    f"SELECT '{f}' AS field, {str(flow).lower()} AS flow, '{tag}' AS tag, {i} AS prio"
    for f, flow, tags in X.FIELD_TAGS for i, tag in enumerate(tags))
VIEWS["first_prints"] = f"""
WITH h AS (SELECT f.*, t.field, row_number() OVER (PARTITION BY ticker, field, "end" ORDER BY filed, prio, pos) AS rn
 FROM fact_rows f JOIN ({_TAGS}) t ON t.tag = f.tag AND f.taxonomy = 'us-gaap'
 WHERE form = '10-K' AND unit = 'USD' AND (NOT flow OR ("start" IS NOT NULL AND "end" - "start" BETWEEN 330 AND 400)))
SELECT ticker, field, "end", val, filed FROM h WHERE rn = 1
"""
VIEWS["fact_shares"] = """
WITH c AS (SELECT *, CASE WHEN tag = 'CommonStockSharesOutstanding' AND form = '10-K' THEN 0
   WHEN tag = 'EntityCommonStockSharesOutstanding' AND form IN ('10-K', '10-K/A', '10-Q') THEN 1
   WHEN tag = 'WeightedAverageNumberOfSharesOutstandingBasic' AND form = '10-K' AND ("start" IS NULL OR "end" - "start" BETWEEN 330 AND 400) THEN 2 END AS prio
  FROM fact_rows WHERE unit = 'shares'),
s AS (SELECT ticker, prio, filed, "end" AS d, sum(val) AS shares FROM c WHERE prio IS NOT NULL GROUP BY ALL),
p AS (SELECT ticker, "end" FROM first_prints WHERE field = 'total_assets'),
m AS (SELECT p.ticker, p."end", s.shares, row_number() OVER (PARTITION BY p.ticker, p."end" ORDER BY s.prio, s.filed, s.d) AS rn
 FROM p JOIN s ON s.ticker = p.ticker AND s.d BETWEEN p."end" - (CASE prio WHEN 0 THEN 15 WHEN 1 THEN 30 ELSE 0 END) AND p."end" + (CASE prio WHEN 0 THEN 15 WHEN 1 THEN 240 ELSE 0 END))
SELECT ticker, "end", shares FROM m WHERE rn = 1
"""
_FIELDS = [f for f, _, _ in X.FIELD_TAGS]
VIEWS["fact_wide"] = """
SELECT ticker, "end", """ + ", ".join(
    f"max(val) FILTER (field = '{f}') AS {f}, max(filed) FILTER (field = '{f}') AS {f}_filed" for f in _FIELDS) + """
FROM first_prints GROUP BY 1, 2
"""

query("facts_exploded", "S10 T12", """
SELECT taxonomy, tag, unit, form, count(*) AS rows, round(sum(val), 0) AS total FROM fact_rows GROUP BY ALL""", "fact_rows")(
    lambda t: X.explode_facts(t.companies).groupBy("taxonomy", "tag", "unit", "form").agg(
        F.count("*").alias("rows"), F.round(F.sum("val"), 0).alias("total")))

query("first_reported_facts", "S10", """SELECT ticker, field, "end", round(val, 6) AS val, filed FROM first_prints""", "first_prints")(
    lambda t: X.first_reported(X.explode_facts(t.companies)).withColumn("val", F.round("val", 6)))

@query("facts_from_json", "S10 T12", """SELECT ticker, field, "end", round(val, 6) AS val, filed FROM first_prints""", "first_prints")
def _json_facts(t):
    """Companies written as JSON lines, read as text and parsed, beside texts that are no company."""
    path = scratch(t, "json")
    odd = ["", "no json", "{}", "[1, 2]", '{"ticker": "X", "facts": 3}', '{"ticker": "X", "facts": {"us-gaap": {"Assets": {"units": {"USD": {}}}}}}']
    texts = t.companies.select(F.to_json(F.struct("ticker", "facts")).alias("value"))
    texts.unionByName(t.spark.createDataFrame([(x,) for x in odd], "value string")).write.text(path)
    return X.first_reported(X.facts_from_json(t.spark.read.text(path))).withColumn("val", F.round("val", 6))


query("fact_share_counts", "S11", """SELECT ticker, "end", round(shares, 6) AS shares_outstanding FROM fact_shares""", "fact_shares")(
    lambda t: X.share_counts(X.explode_facts(t.companies), t.statements.select("ticker", F.col("report_date").alias("end")))
    .withColumn("shares_outstanding", F.round("shares_outstanding", 6)))

_late = lambda f: f"CASE WHEN {f}_filed - report_date <= 45 THEN {f} END"
query("fact_canonical_rows", "S12 P5 P8", f"""
WITH d AS (SELECT *, greatest(total_assets_filed, net_income_filed, cfo_filed, revenue_filed, book_value_filed) AS report_date FROM fact_wide WHERE total_assets IS NOT NULL)
SELECT d.ticker, d."end" AS period_end, report_date, CAST(year(d."end") - CASE WHEN month(d."end") < 6 THEN 1 ELSE 0 END AS INTEGER) AS fiscal_year,
 round({_late('total_assets')}, 6) AS total_assets, round({_late('net_income')}, 6) AS net_income, round({_late('cfo')}, 6) AS cfo, round({_late('revenue')}, 6) AS revenue,
 round(coalesce({_late('cogs')}, {_late('revenue')} - {_late('gross_profit')}), 6) AS cogs, round(coalesce({_late('long_term_debt')}, 0), 6) AS long_term_debt,
 round({_late('book_value')}, 6) AS book_value, round(s.shares, 6) AS shares_outstanding
FROM d LEFT JOIN fact_shares s ON s.ticker = d.ticker AND s."end" = d."end" """, "fact_wide fact_shares")(
    lambda t: X.canonical_rows(X.explode_facts(t.companies)).select(
        "ticker", "period_end", "report_date", "fiscal_year", *[F.round(c, 6).alias(c) for c in (
            "total_assets", "net_income", "cfo", "revenue", "cogs", "long_term_debt", "book_value", "shares_outstanding")]))

query("membership_at_formation", "S13 S14", """
SELECT make_date(y, 7, 1) AS date, upper(replace(trim(' t.' || m.ticker), '.', '-')) AS ticker FROM membership m JOIN (SELECT CAST(unnest(range(1997, 2004)) AS INTEGER) AS y) k
 ON year(m.date) = least(y, 2001)""", "membership")(
    lambda t: O.members_at(t.membership_history, 1997, 2003))

query("membership_any_day", "S13 S14 T4", """
WITH d AS (SELECT DISTINCT date FROM prices WHERE day(date) <= 7),
s AS (SELECT d.date, max(m.date - INTERVAL 4 MONTH) AS snap FROM d JOIN (SELECT DISTINCT date FROM membership) m ON m.date - INTERVAL 4 MONTH <= d.date GROUP BY 1)
SELECT s.date, upper(replace(trim(' t.' || m.ticker), '.', '-')) AS ticker FROM s JOIN membership m ON m.date - INTERVAL 4 MONTH = s.snap""", "prices membership")(
    lambda t: MB.members_on(t.prices.where(F.dayofmonth("date") <= 7).select("date"), MB.intervals(t.membership_history)))

query("membership_spells", "S13 T4", """
WITH n AS (SELECT DISTINCT ticker, CAST(year(date) AS INTEGER) AS y FROM membership),
i AS (SELECT *, y - row_number() OVER (PARTITION BY ticker ORDER BY y) AS spell FROM n)
SELECT upper(replace(trim(' t.' || ticker), '.', '-')) AS ticker, make_date(min(y), 3, 1) AS start,
 CASE WHEN max(y) < 2001 THEN make_date(CAST(max(y) + 1 AS INTEGER), 3, 1) END AS "end" FROM i GROUP BY i.ticker, spell""", "membership")(
    lambda t: MB.intervals(t.membership_history))

# ---- identifiers and projections ----

query("vendor_identifiers", "P19", """
WITH v AS (SELECT s_suppkey AS n, CASE s_suppkey % 5 WHEN 0 THEN lpad(CAST(s_suppkey AS VARCHAR), 7, '0') || 'D UN Equity' WHEN 1 THEN CAST(s_suppkey + 1000 AS VARCHAR) || ' JT Equity'
   WHEN 2 THEN 'BRK/B UN Equity' WHEN 3 THEN 'SINGLE' ELSE 'AB' || CAST(s_suppkey AS VARCHAR) || ' UW Equity' END AS id FROM supplier)
SELECT n, id, CASE n % 5 WHEN 0 THEN NULL WHEN 1 THEN CAST(n + 1000 AS VARCHAR) || '.T' WHEN 2 THEN 'BRK/B.T' WHEN 3 THEN NULL ELSE 'AB' || CAST(n AS VARCHAR) || '.T' END AS japan,
 CASE n % 5 WHEN 0 THEN NULL WHEN 1 THEN CAST(n + 1000 AS VARCHAR) WHEN 2 THEN 'BRK/B' WHEN 3 THEN NULL ELSE 'AB' || CAST(n AS VARCHAR) END AS us,
 CASE n % 5 WHEN 1 THEN CASE WHEN n + 1000 < 100000 THEN CAST(n + 1000 AS VARCHAR) || '.T' END END AS plain_japan, CASE n % 5 WHEN 2 THEN 'BRK-B' WHEN 3 THEN 'SINGLE' END AS plain_us FROM v""")(
    lambda t: (lambda n: t.raw("supplier").select(n.alias("n"), F.when(n % 5 == 0, F.concat(F.lpad(n.cast("string"), 7, "0"), F.lit("D UN Equity")))
        .when(n % 5 == 1, F.concat((n + 1000).cast("string"), F.lit(" JT Equity"))).when(n % 5 == 2, "BRK/B UN Equity").when(n % 5 == 3, "SINGLE")
        .otherwise(F.concat(F.lit("AB"), n.cast("string"), F.lit(" UW Equity"))).alias("id")))(F.col("s_suppkey"))
    .select("n", "id", Y.price_symbol(F.col("id"), "japan").alias("japan"), Y.price_symbol(F.col("id"), "us").alias("us"),
            Y.plain_symbol(F.col("id"), "japan").alias("plain_japan"), Y.plain_symbol(F.col("id"), "us").alias("plain_us")))

query("fiscal_calendar", "P5 P6", """
SELECT ticker, date, CAST(year(date) - CASE WHEN month(date) < 6 THEN 1 ELSE 0 END AS INTEGER) AS label, make_date(CAST(year(date) AS INTEGER) + 1, 3, 31) AS japan_end,
 make_date(CAST(year(date) AS INTEGER), 12, 31) AS us_end FROM prices""", "prices")(
    lambda t: t.prices.select("ticker", "date", fiscal_label(F.col("date")).alias("label"),
                              fiscal_end(F.year("date"), "japan").alias("japan_end"), fiscal_end(F.year("date"), "us").alias("us_end")))

query("first_present_fields", "P8 P9 P10", """
SELECT symbol, period, round(coalesce(cfo, cfo_direct), 4) AS cfo, round(coalesce(CASE WHEN firm_no % 3 = 0 THEN NULL ELSE cogs END, net_sales - gross_profit), 4) AS cogs
FROM vendor_statements""", "vendor_statements")(
    lambda t: (lambda v: v.select("symbol", "period", F.round(N.first_present(v, ["absent", "cfo", "cfo_direct"]), 4).alias("cfo"), F.round(
        N.cogs_from_gross_profit(F.when(F.col("firm_no") % 3 != 0, F.col("cogs")), F.col("net_sales"), F.col("gross_profit")), 4).alias("cogs")))(t.vendor_statements))

query("shorting_registry", "P24", """
WITH m AS (SELECT * FROM (VALUES ('us', true, false), ('united states', true, false), ('japan', true, false), ('jp', true, false), ('vietnam', true, true), ('vn', true, true)) v(market, allows_shorting, hypothetical_short))
SELECT market, allows_shorting, hypothetical_short, (SELECT count(*) FROM positions WHERE w < 0) AS short_positions FROM m""", "positions")(
    lambda t: beside(markets.shorting_table(t.spark), study(t).equal_positions.where("w < 0").agg(
        F.count("*").alias("short_positions"))))

# ---- dedupe, merge, compare ----

query("keep_first_and_last", "K7", """
SELECT ticker, fiscal_year, round(max_by(total_assets, report_date), 4) AS last_assets, round(min_by(total_assets, report_date), 4) AS first_assets FROM (
 SELECT ticker, fiscal_year, report_date, total_assets FROM fundamentals UNION ALL SELECT ticker, fiscal_year, report_date + 90, total_assets * 2 FROM fundamentals) GROUP BY 1, 2""", "fundamentals")(
    lambda t: (lambda two: O.keep_one(two, ["ticker", "fiscal_year"], [F.col("report_date")], first=False).select(
        "ticker", "fiscal_year", F.round("total_assets", 4).alias("last_assets")).join(
        O.keep_one(two, ["ticker", "fiscal_year"], [F.col("report_date")]).select(
            "ticker", "fiscal_year", F.round("total_assets", 4).alias("first_assets")), ["ticker", "fiscal_year"]))(
        (lambda f: f.unionByName(f.withColumn("report_date", F.date_add("report_date", 90)).withColumn("total_assets", F.col("total_assets") * 2)))(
            t.fundamentals.select("ticker", "fiscal_year", "report_date", "total_assets"))))

query("upsert_by_market", "O4 O6", """
SELECT sector AS market, ticker, 'old' AS src, NULL::VARCHAR AS note FROM sectors WHERE sector <> 'ASIA' UNION ALL SELECT sector, ticker, 'new', name FROM sectors WHERE sector = 'ASIA'""", "sectors")(
    lambda t: O.upsert(t.sectors.select(F.col("sector").alias("market"), "ticker", F.lit("old").alias("src")),
                       t.sectors.where(F.col("sector") == "ASIA").select(F.col("sector").alias("market"), "ticker", F.lit("new").alias("src"), F.col("name").alias("note")),
                       "market")[0].select("market", "ticker", "src", "note"))

query("upsert_by_key", "O4", """
SELECT ticker, CASE WHEN sector = 'ASIA' THEN 'fresh' ELSE 'kept' END AS src FROM sectors""", "sectors")(
    lambda t: O.upsert_rows(t.sectors.select("ticker", F.lit("kept").alias("src")),
                            t.sectors.where(F.col("sector") == "ASIA").select("ticker", F.lit("fresh").alias("src")), ["ticker"]))

query("merged_sectors", "O5", """
SELECT ticker, CASE WHEN sector = 'EUROPE' THEN 'second' ELSE sector END AS sector FROM sectors""", "sectors")(
    lambda t: O.merge_first([t.sectors.withColumn("sector", F.when(F.col("sector") != "EUROPE", F.col("sector"))),
                             t.sectors.withColumn("sector", F.lit("second"))], "ticker", "sector"))

query("compare_result_tables", "V11", """
SELECT ticker, fiscal_year, CASE WHEN fiscal_year = 1995 THEN 'missing' WHEN fiscal_year = 2002 THEN 'new' ELSE 'changed' END AS status, CASE WHEN fiscal_year BETWEEN 1996 AND 2001 THEN 'revenue' END AS "column" FROM (
 SELECT ticker, fiscal_year FROM fundamentals WHERE fiscal_year = 1995 UNION ALL SELECT ticker, 2002 FROM fundamentals WHERE fiscal_year = 2001
 UNION ALL SELECT ticker, fiscal_year FROM fundamentals WHERE fiscal_year = 1998)""", "fundamentals")(
    lambda t: (lambda f: V.compare_tables(
        f, f.where(F.col("fiscal_year") > 1995).withColumn("revenue", F.col("revenue") * F.when(F.col("fiscal_year") == 1998, 1.001).otherwise(1 + 1e-12))
        .unionByName(f.where(F.col("fiscal_year") == 2001).withColumn("fiscal_year", F.lit(2002))), ["ticker", "fiscal_year"])
        .select("ticker", "fiscal_year", "status", "column"))(t.fundamentals.select("ticker", "fiscal_year", "revenue", "cogs")))

query("compare_by_digests", "V11 E26", """
SELECT ticker, fiscal_year, 'changed' AS status, 'revenue' AS "column" FROM fundamentals WHERE fiscal_year = 1998 AND CAST(ticker AS INTEGER) % 7 = 0 AND revenue IS NOT NULL
UNION ALL SELECT ticker, fiscal_year, 'missing', NULL FROM fundamentals WHERE fiscal_year = 1999 AND CAST(ticker AS INTEGER) % 11 = 0""", "fundamentals")(
    lambda t: (lambda f: V.compare_large(
        f, f.where((F.col("fiscal_year") != 1999) | (F.col("ticker").cast("int") % 11 != 0)).withColumn(
            "revenue", F.col("revenue") * F.when((F.col("fiscal_year") == 1998) & (F.col("ticker").cast("int") % 7 == 0), 1.001).otherwise(1)),
        ["ticker", "fiscal_year"]).select("ticker", "fiscal_year", "status", "column"))(t.fundamentals.select("ticker", "fiscal_year", "revenue", "cogs")))

query("price_coverage", "A14", """
WITH m AS (SELECT DISTINCT CAST(year(date) AS INTEGER) AS y, ticker FROM membership),
e AS (SELECT DISTINCT ticker FROM prices), d AS (SELECT DISTINCT m.y, p.ticker FROM m JOIN prices p ON p.ticker = m.ticker AND p.date >= make_date(m.y, 7, 1) - INTERVAL 36 MONTH AND p.date < make_date(m.y, 7, 1))
SELECT m.y AS formation_year, count(*) AS constituents, count(e.ticker) AS priced_at_all, count(d.ticker) AS priced_before, round(100.0 * count(e.ticker) / count(*), 1) AS pct_priced
FROM m LEFT JOIN e ON e.ticker = m.ticker LEFT JOIN d ON d.y = m.y AND d.ticker = m.ticker GROUP BY 1""", "membership prices")(
    lambda t: O.price_coverage(t.membership, t.prices))

query("has_price", "A14", """
SELECT DISTINCT m.ticker, EXISTS (SELECT 1 FROM prices p WHERE p.ticker = m.ticker) AS has_price FROM membership m""", "membership prices")(
    lambda t: O.has_price(t.membership, t.prices))


def _workbook(t):
    n = F.col("ticker").cast("int")
    s = S.nine_signals(t.fundamentals)
    return s.select("score_year", F.when(n % 9 != 0, F.col("ticker")).alias("symbol"), F.when(n % 7 != 0, F.col("fscore")).alias("score"),
                    *[F.when((n % 5 != 0) | F.lit(f in FLAGS[:6]), F.col(f)).alias(f) for f in FLAGS])


query("workbook_ledger", "C9 A8", """
WITH a AS (SELECT score_year, CAST(ticker AS INTEGER) AS n FROM signals),
o AS (SELECT score_year, CASE WHEN n % 5 = 0 THEN 6 ELSE 9 END AS k, CASE WHEN n % 5 = 0 THEN 'i' WHEN n % 9 = 0 THEN 's' WHEN n % 7 = 0 THEN 'c' ELSE 'k' END AS o FROM a)
SELECT score_year, count(*) AS rows, count(*) FILTER (o = 'i') AS dropped_incomplete_signals, count(*) FILTER (o = 's') AS dropped_no_symbol, count(*) FILTER (o = 'c') AS dropped_no_score,
 count(*) FILTER (o = 'k') AS kept, median(k) FILTER (o = 'i') AS median_signals_when_incomplete, round(100.0 * count(*) FILTER (o = 'i') / count(*), 2) AS pct_dropped_incomplete,
 round(100.0 * count(*) FILTER (o = 'k') / count(*), 2) AS pct_kept FROM o GROUP BY ROLLUP (score_year)""", "signals")(
    lambda t: S.workbook_ledger(S.complete_workbook_rows(_workbook(t), FLAGS, "symbol", "score")))

query("rank_by_book_to_market", "W12", """
SELECT fiscal_year, ticker, CAST(row_number() OVER (PARTITION BY fiscal_year ORDER BY -(book_value / market_cap), md5(ticker), ticker) AS BIGINT) AS rank
FROM fundamentals WHERE book_value / market_cap IS NOT NULL""", "fundamentals")(
    lambda t: spread_rank(t.fundamentals.withColumn("bm", F.try_divide("book_value", "market_cap")), ["fiscal_year"], "bm", "ticker", ascending=False)
    .select("fiscal_year", "ticker", "rank"))

query("aligned_ledgers", "P26", """
SELECT 'a' AS market, count(*) AS scored, 0::BIGINT AS dropped_no_prior_year, 0::BIGINT AS dropped_incomplete_signals, count(*) AS held, 100.0::DOUBLE AS pct_scored FROM signals
UNION ALL SELECT 'b', count(*), 70, 0, count(*) + 70, round(100.0 * count(*) / (count(*) + 70), 2) FROM signals""", "signals")(
    lambda t: (lambda l: O.ledger_totals(O.align_ledgers(
        [l.withColumn("market", F.lit("a")), l.withColumn("market", F.lit("b")).withColumn(
            "dropped_no_prior_year", F.when(F.col("score_year") == 1996, 70).otherwise(0))],
        ["scored", "dropped_no_prior_year", "dropped_incomplete_signals"]), ["market"]))(
        S.scoring_ledger(t.fundamentals).select("score_year", "scored", "dropped_incomplete_signals"))
    .select("market", "scored", "dropped_no_prior_year", "dropped_incomplete_signals", "held", "pct_scored"))
