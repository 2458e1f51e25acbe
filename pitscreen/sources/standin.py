"""Market tables derived from the star schema, one per input contract.

Suppliers stand in for companies and ship days for sessions. Numbers are rounded once,
here, so that any engine deriving the same tables continues from identical values.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F, Window as W

from pitscreen.functions.numeric import PAR_VALUE
from pitscreen.operators.asof import market_cap_at_period_end
from pitscreen.session import land

UNLISTED_AFTER = "1999-10-15"


def _hex(col) -> F.Column:
    return F.substring(F.md5(col), 1, 1)


class Tables:
    """Lazily derived inputs for one data directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def statements(self) -> DataFrame:
        """Annual lines per company, without a market value."""
        li = self.raw("lineitem").select(
            "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
            "l_returnflag", "l_linenumber", F.year("l_shipdate").alias("fiscal_year"))
        part = self.raw("part").select("p_partkey", "p_retailprice")
        c = F.col
        rev = c("l_extendedprice") * (1 - c("l_discount"))
        signed = F.when(c("l_linenumber") % 2 == 0, 1).otherwise(-1)
        no_terms = (c("l_discount") == 0) & (c("l_tax") == 0)
        sums = (li.join(part, c("l_partkey") == c("p_partkey"))
                .groupBy("l_suppkey", "fiscal_year").agg(
            F.sum("l_extendedprice").alias("gross"),
            F.sum(rev).alias("rev"),
            F.sum(c("l_quantity") * c("p_retailprice")).alias("cost"),
            F.sum(c("l_extendedprice") * c("l_tax")).alias("tax"),
            F.sum(signed * c("l_extendedprice") * c("l_discount")).alias("swing"),
            F.coalesce(F.sum(F.when(c("l_returnflag") == "R", c("l_extendedprice"))),
                       F.lit(0.0)).alias("debt"),
            F.sum(F.when(c("l_linenumber") <= 3, c("l_extendedprice"))).alias("ca"),
            F.sum(F.when(c("l_linenumber") > 3, c("l_extendedprice"))).alias("cl"),
            F.sum("l_quantity").alias("shares"),
            F.sum(F.when(no_terms, c("l_extendedprice")).otherwise(0)).alias("issued")))
        r = lambda x: F.round(x, 4)
        return sums.select(
            c("l_suppkey").alias("firm_no"),
            c("l_suppkey").cast("string").alias("ticker"),
            c("fiscal_year"),
            F.make_date(c("fiscal_year"), F.lit(12), F.lit(31)).alias("report_date"),
            r(c("gross")).alias("total_assets"),
            r(c("rev") - 2 * c("cost") - c("tax")).alias("net_income"),
            r(c("rev") - 2 * c("cost") - c("tax") + c("swing")).alias("cfo"),
            r(c("debt")).alias("long_term_debt"),
            r(c("ca")).alias("current_assets"),
            r(c("cl")).alias("current_liabilities"),
            r(c("shares")).alias("shares_outstanding"),
            F.when(c("l_suppkey") % 3 != 0, r(c("issued"))).alias("equity_issued"),
            r(c("rev")).alias("revenue"),
            r(2 * c("cost")).alias("cogs"),
            r(c("gross") - c("debt")).alias("book_value"))

    @cached_property
    def daily(self) -> DataFrame:
        """One row per company and ship day, by the company's number."""
        return (self.raw("lineitem")
                .groupBy("l_suppkey", F.to_date("l_shipdate").alias("date"))
                .agg((F.avg("l_discount") - 0.05).alias("x"),
                     F.sum("l_quantity").alias("volume"),
                     F.sum(F.when(F.col("l_linestatus") == "F", F.col("l_quantity"))
                           .otherwise(0)).alias("deal_volume")))

    @cached_property
    def bars(self) -> DataFrame:
        # One row per session and ticker, so a ticker's window is bounded by the calendar.
        walk = F.sum("x").over(W.partitionBy("l_suppkey").orderBy("date"))
        listed = ~((F.col("date") > F.lit(UNLISTED_AFTER)) & (_hex(F.col("ticker")) == "0"))
        adj = F.round(100 * F.exp(walk), 4)
        return (self.daily
                .select(F.col("l_suppkey").cast("string").alias("ticker"), "date", adj.alias("adj_close"), "volume", "deal_volume")
                .withColumn("adj_ratio", F.when(F.year("date") < 1997, 2.0).otherwise(1.0))
                .withColumn("close_raw", F.col("adj_close") * F.col("adj_ratio"))
                .where(listed))

    @cached_property
    def prices(self) -> DataFrame:
        return self.bars.select("ticker", "date", "adj_close", "close_raw", "volume")

    def landed(self) -> Tables:
        """The same tables with those that many plans read written once."""
        out = Tables(self.spark, self.dir)
        out.statements = land(self.statements, "statements")
        out.bars = land(self.bars, "bars")
        out.fundamentals = land(out.fundamentals, "fundamentals")
        return out

    @cached_property
    def fundamentals(self) -> DataFrame:
        return market_cap_at_period_end(
            self.statements.drop("firm_no"), self.prices, tolerance_days=14)

    @cached_property
    def filed(self) -> DataFrame:
        """Fundamentals whose filing day varies by company (late filers exist)."""
        return self.fundamentals.withColumn(
            "report_date",
            F.add_months("report_date", F.col("ticker").cast("int") % 4))

    @cached_property
    def sectors(self) -> DataFrame:
        s, n, r = self.raw("supplier"), self.raw("nation"), self.raw("region")
        return (s.join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey"))
                .join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
                .select(F.col("s_suppkey").cast("string").alias("ticker"),
                        F.col("s_name").alias("name"), F.col("r_name").alias("sector")))

    @cached_property
    def membership(self) -> DataFrame:
        """Index constituents (formation date, ticker); names enter and leave by year."""
        years = F.explode(F.sequence(F.lit(1996), F.lit(2001)))
        return (self.raw("supplier")
                .select(F.col("s_suppkey").cast("string").alias("ticker"))
                .select("ticker", years.alias("y"))
                .where(_hex(F.concat_ws(":", "y", "ticker")) < "d")
                .select(F.make_date("y", F.lit(7), F.lit(1)).alias("date"), "ticker"))

    @cached_property
    def benchmarks(self) -> DataFrame:
        """Two index series and one exchange rate, with a few bad ticks."""
        day = self.prices.groupBy("date").agg(
            F.round(F.avg("adj_close") * 0.9973, 4).alias("mean"),
            F.round(F.sum("volume"), 4).alias("volume"))
        bad = F.when((F.dayofmonth("date") == 15) & (F.month("date") == 5), 2.0).otherwise(1.0)
        rows = F.array(
            F.struct(F.lit("INDEX").alias("ticker"), (F.col("mean") * bad).alias("adj_close")),
            F.struct(F.lit("ETF").alias("ticker"),
                     (F.col("mean") * 2 + 50).alias("adj_close")),
            F.struct(F.lit("FX").alias("ticker"),
                     F.when(F.dayofweek("date") != 1,
                            100 + F.dayofyear("date") * 0.1).alias("adj_close")))
        return (day.select("date", "volume", F.explode(rows).alias("s"))
                .select("s.ticker", "date", F.col("s.adj_close").alias("adj_close"), "volume")
                .where(F.col("adj_close").isNotNull()))

    # ---- vendor-shaped inputs ----

    @cached_property
    def vendor_bars(self) -> DataFrame:
        """Daily bars as a vendor stores them: text dates, quote units, index rows."""
        date = F.col("date").cast("string").alias("date")
        shares = self.bars.select(
            F.col("ticker").alias("symbol"), date,
            (F.col("close_raw") / 1000).alias("price_close"),
            (F.col("close_raw") * 0.99 / 1000).alias("price_average"),
            F.lit(1000.0).alias("unit"), "adj_ratio",
            F.col("volume").alias("total_volume"), "deal_volume",
            (F.col("volume") - F.col("deal_volume")).alias("putthrough_volume"))
        index = self.benchmarks.where(F.col("ticker") == "INDEX").select(
            F.col("ticker").alias("symbol"), date, F.col("adj_close").alias("price_close"),
            F.col("adj_close").alias("price_average"), F.lit(1.0).alias("unit"),
            F.lit(1.0).alias("adj_ratio"), F.col("volume").alias("total_volume"),
            F.lit(0.0).alias("deal_volume"), F.lit(0.0).alias("putthrough_volume"))
        return shares.unionByName(index)

    @cached_property
    def vendor_statements(self) -> DataFrame:
        """Wide annual statements with the lines the accounting rules read."""
        c, n = F.col, F.col("firm_no")
        minority = F.when(n % 4 == 0, F.round(c("book_value") * 0.05, 4))
        return (self.statements
                .withColumnRenamed("ticker", "symbol")
                .withColumn("period", c("fiscal_year").cast("string"))
                .withColumn("equity_section", c("book_value"))
                .withColumn("owner_equity", c("book_value"))
                .withColumn("total_liabilities", F.when(
                    (n % 13 == 0) & (c("fiscal_year") == 1998), c("long_term_debt") * 1.05)
                    .when(n % 17 == 0, c("long_term_debt") + minority)
                    .otherwise(c("long_term_debt")))
                .withColumn("long_term_liabilities",
                            c("total_liabilities") - c("current_liabilities"))
                .withColumn("minority_interest", minority)
                .withColumn("paid_in_capital", F.when(n % 3 == 0, n * 2.0e7).when(
                    c("fiscal_year") % 2 == 0, c("shares_outstanding") * PAR_VALUE)
                    .otherwise(F.floor(c("shares_outstanding") / 500) * 500.0 * PAR_VALUE))
                .withColumn("treasury_stock", F.when(n % 5 == 0, -1000.0 * n)
                            .when(n % 5 == 1, 0.0))
                .withColumn("net_sales", c("revenue"))
                .withColumn("gross_profit", c("revenue") - c("cogs")
                            + F.when(n % 19 == 0, c("total_assets") * 0.01).otherwise(0.0))
                .withColumn("net_income_total", c("net_income"))
                .withColumn("net_income_minority", F.when(
                    n % 4 == 0, F.round(c("net_income") * 0.03, 4)).otherwise(0.0))
                .withColumn("net_income_parent",
                            c("net_income_total") - c("net_income_minority"))
                .withColumn("cfo_direct", c("cfo"))
                .withColumn("cfo", F.when(n % 6 != 0, c("cfo")))
                .withColumn("cfi", F.round(-0.3 * c("total_assets"), 4))
                .withColumn("cff", F.round(0.2 * c("long_term_debt"), 4))
                .withColumn("net_cash_flow", c("cfo_direct") + c("cff") + c("cfi"))
                .withColumn("fx_effect", F.when(n % 2 == 0, 0.0))
                .withColumn("cash_begin", c("current_assets"))
                .withColumn("cash_end", c("cash_begin") + c("net_cash_flow")
                            + F.when(n % 23 == 0, c("total_assets") * 0.02).otherwise(0.0))
                .withColumn("stock_issuance_proceeds", F.when(
                    n % 29 == 0, -c("equity_issued")).otherwise(c("equity_issued"))))

    # Statement lines of the long table: (statement, canonical key).
    LONG_LINES = [
        ("balance_sheet", "total_assets"), ("balance_sheet", "current_assets"),
        ("balance_sheet", "current_liabilities"), ("balance_sheet", "total_liabilities"),
        ("balance_sheet", "equity_section"), ("balance_sheet", "owner_equity"),
        ("balance_sheet", "minority_interest"), ("balance_sheet", "paid_in_capital"),
        ("balance_sheet", "treasury_stock"), ("balance_sheet", "long_term_liabilities"),
        ("balance_sheet", "long_term_debt"),
        ("income_statement", "net_sales"), ("income_statement", "cogs"),
        ("income_statement", "gross_profit"), ("income_statement", "net_income_total"),
        ("income_statement", "net_income_minority"), ("income_statement", "net_income_parent"),
        ("cash_flow", "cfo"), ("cash_flow", "cfi"), ("cash_flow", "cff"),
        ("cash_flow", "net_cash_flow"), ("cash_flow", "fx_effect"),
        ("cash_flow", "cash_begin"), ("cash_flow", "cash_end"),
        ("cash_flow", "stock_issuance_proceeds"), ("cash_flow_direct", "cfo_direct"),
    ]

    @cached_property
    def vendor_long(self) -> DataFrame:
        """(symbol, period, statement, name, value) with the vendor's own line labels."""
        from pitscreen.sources.line_items import LABELS

        cells = F.array(*[
            F.struct(F.lit(s).alias("statement"), F.lit(LABELS[s][k]).alias("name"),
                     F.col(k).alias("value")) for s, k in self.LONG_LINES])
        return (self.vendor_statements.select("symbol", "period", F.explode(cells).alias("c"))
                .select("symbol", "period", "c.statement", "c.name", "c.value")
                .where(F.col("value").isNotNull()))

    @cached_property
    def annual_summary(self) -> DataFrame:
        """Vendor's annual summary; quarter 0 is the year. Share counts are imperfect."""
        c, n = F.col, F.col("symbol").cast("int")
        frozen = F.max("shares_outstanding").over(W.partitionBy("symbol"))
        wide = self.vendor_statements.select(
            "symbol", c("fiscal_year").alias("year"), "shares_outstanding", "paid_in_capital",
            "treasury_stock", "book_value").withColumn("latest", frozen)
        outstanding = (F.when(n % 11 == 0, F.lit(None).cast("double"))
                       .when(n % 7 == 0, c("latest"))
                       .when(n % 5 == 0, F.round(c("paid_in_capital") / PAR_VALUE * 0.92, 0))
                       .otherwise(c("paid_in_capital") / PAR_VALUE))
        full = wide.select(
            "symbol", "year", "paid_in_capital", "treasury_stock",
            outstanding.alias("share_at_period_end"),
            F.round(c("shares_outstanding") / c("book_value") * 100, 6).alias("pb"),
            F.explode(F.array(F.lit(0), F.lit(4))).alias("quarter"))
        return full

    @cached_property
    def coverage_grid(self) -> DataFrame:
        """symbol x year counts of statements on file (0 to 3)."""
        n = F.col("ticker").cast("int")
        years = [F.sum(F.when(F.col("fiscal_year") == y, F.least(
            n % 8, F.lit(4)).cast("int")).otherwise(0)).cast("int").alias(str(y))
            for y in range(1995, 2002)]
        return self.statements.groupBy("ticker").agg(*years).withColumnRenamed("ticker", "symbol")

    @cached_property
    def fact_rows(self) -> DataFrame:
        """One row per company fact: first prints, restatements, other tags and durations."""
        sql = FACTS_SQL.format(src="{src}").replace('"end"', "`end`")
        return self.spark.sql(sql, src=self.statements).where(F.col("val").isNotNull())

    @cached_property
    def companies(self) -> DataFrame:
        """(ticker, facts): nested as delivered; a company has a few facts a year."""
        f = self.fact_rows
        fact = F.struct(F.col("start").cast("string").alias("start"), F.col("end").cast("string").alias("end"),
                        "val", F.col("filed").cast("string").alias("filed"), "form")
        lists = f.groupBy("ticker", "taxonomy", "tag", "unit").agg(
            F.sort_array(F.collect_list(F.struct("pos", fact.alias("f")))).alias("l"))
        units = lists.groupBy("ticker", "taxonomy", "tag").agg(F.map_from_entries(F.collect_list(
            F.struct("unit", F.col("l.f")))).alias("units"))
        tags = units.groupBy("ticker", "taxonomy").agg(F.map_from_entries(F.collect_list(
            F.struct("tag", F.struct("units")))).alias("tags"))
        return tags.groupBy("ticker").agg(F.map_from_entries(F.collect_list(
            F.struct("taxonomy", "tags"))).alias("facts"))

    @cached_property
    def membership_history(self) -> DataFrame:
        """Snapshots (date, comma list), a hundred names a row, symbols as typed by the source."""
        m = self.membership.withColumn("n", F.col("ticker").cast("int"))
        return (m.groupBy(F.add_months("date", -4).alias("date"), F.floor(F.col("n") / 100).alias("c"))
                .agg(F.concat_ws(",", F.collect_list(F.concat(F.lit(" t."), "ticker"))).alias("tickers"))
                .select("date", "tickers"))


# (taxonomy, tag, unit, start, end, value, filed, form, condition) over the statements.
_FACTS = [
    ("us-gaap", "Assets", "USD", None, "e", "total_assets", "e + 40 + firm_no % 15", "10-K", "true"),
    ("us-gaap", "Assets", "USD", None, "e", "total_assets * 1.1", "e + 400", "10-K", "true"),
    ("us-gaap", "Assets", "USD", None, "e", "total_assets * 0.9", "e + 10", "8-K", "firm_no % 2 = 0"),
    ("us-gaap", "NetIncomeLoss", "USD", "b", "e", "net_income", "e + 40 + firm_no % 15", "10-K", "true"),
    ("us-gaap", "NetIncomeLoss", "USD", "e - 90", "e", "net_income * 0.25", "e + 5", "10-K", "true"),
    ("us-gaap", "NetCashProvidedByUsedInOperatingActivities", "USD", "b", "e", "cfo",
     "e + 60", "10-K", "firm_no % 2 = 0"),
    ("us-gaap", "NetCashProvidedByUsedInOperatingActivitiesContinuingOperations", "USD", "b", "e",
     "cfo * 1.01", "e + 60", "10-K", "true"),
    ("us-gaap", "Revenues", "USD", "b", "e", "revenue", "e + 50", "10-K", "fiscal_year < 1998 OR firm_no % 3 = 0"),
    ("us-gaap", "RevenueFromContractWithCustomerExcludingAssessedTax", "USD", "b", "e",
     "revenue * 1.02", "e + 45 + firm_no % 10", "10-K", "fiscal_year >= 1998"),
    ("us-gaap", "CostOfRevenue", "USD", "b", "e", "cogs", "e + 50", "10-K", "firm_no % 4 <> 0"),
    ("us-gaap", "GrossProfit", "USD", "b", "e", "revenue - cogs", "e + 50", "10-K", "true"),
    ("us-gaap", "ProceedsFromIssuanceOfCommonStock", "USD", "b", "e", "equity_issued", "e + 50", "10-K", "true"),
    ("us-gaap", "AssetsCurrent", "USD", None, "e", "current_assets", "e + 50", "10-K", "true"),
    ("us-gaap", "LiabilitiesCurrent", "USD", None, "e", "current_liabilities", "e + 50", "10-K", "true"),
    ("us-gaap", "StockholdersEquity", "USD", None, "e", "book_value", "e + 50", "10-K", "firm_no % 9 <> 0"),
    ("us-gaap", "LongTermDebtNoncurrent", "USD", None, "e", "long_term_debt",
     "e + 50 + firm_no % 7 * 20", "10-K", "firm_no % 5 <> 0"),
    ("us-gaap", "CommonStockSharesOutstanding", "shares", None, "e - 5", "shares_outstanding * 0.6",
     "e + 50", "10-K", "firm_no % 2 = 0"),
    ("us-gaap", "CommonStockSharesOutstanding", "shares", None, "e - 5", "shares_outstanding * 0.4",
     "e + 50", "10-K", "firm_no % 2 = 0"),
    ("dei", "EntityCommonStockSharesOutstanding", "shares", None, "e + 30", "shares_outstanding",
     "e + 60", "10-Q", "firm_no % 3 <> 0"),
    ("us-gaap", "WeightedAverageNumberOfSharesOutstandingBasic", "shares", "b", "e",
     "shares_outstanding * 0.99", "e + 50", "10-K", "true"),
]

FACTS_SQL = ("WITH s AS (SELECT ticker, CAST(firm_no AS INT) AS firm_no, fiscal_year, total_assets, net_income, cfo, "
             "long_term_debt, current_assets, current_liabilities, shares_outstanding, equity_issued, "
             "revenue, cogs, book_value, make_date(fiscal_year, 12, 31) AS e, make_date(fiscal_year, 1, 1) AS b FROM {src})\n"
             + "\nUNION ALL\n".join(
    f"SELECT ticker, '{tax}' AS taxonomy, '{tag}' AS tag, '{unit}' AS unit, "
    f"{('CAST(' + start + ' AS DATE)') if start else 'CAST(NULL AS DATE)'} AS start, CAST({end} AS DATE) AS \"end\", "
    f"CAST({val} AS DOUBLE) AS val, CAST({filed} AS DATE) AS filed, '{form}' AS form, {i} AS pos FROM s WHERE {cond}"
    for i, (tax, tag, unit, start, end, val, filed, form, cond) in enumerate(_FACTS)))
