"""Nested company facts to first-reported canonical annual rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pitscreen.functions.dates import fiscal_label

# Fixed values: (field, flow, tags in order of preference), all in the us-gaap taxonomy.
FIELD_TAGS = [
    ("net_income", True, ["NetIncomeLoss", "ProfitLoss"]),
    ("cfo", True, ["NetCashProvidedByUsedInOperatingActivities",
                   "NetCashProvidedByUsedInOperatingActivitiesContinuingOperations"]),
    ("revenue", True, ["Revenues", "RevenueFromContractWithCustomerExcludingAssessedTax",
                       "SalesRevenueNet", "SalesRevenueGoodsNet",
                       "RevenueFromContractWithCustomerIncludingAssessedTax"]),
    ("cogs", True, ["CostOfRevenue", "CostOfGoodsAndServicesSold", "CostOfGoodsSold"]),
    ("gross_profit", True, ["GrossProfit"]),
    ("equity_issued", True, [
        "ProceedsFromIssuanceOfCommonStock", "ProceedsFromIssuanceOfCommonStockNetOfIssuanceCosts",
        "ProceedsFromIssuanceOrSaleOfEquity", "ProceedsFromStockOptionsExercised",
        "ProceedsFromIssuanceOfSharesUnderIncentiveAndShareBasedCompensationPlans"]),
    ("total_assets", False, ["Assets"]),
    ("current_assets", False, ["AssetsCurrent"]),
    ("current_liabilities", False, ["LiabilitiesCurrent"]),
    ("book_value", False, [
        "StockholdersEquity",
        "StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest"]),
    ("long_term_debt", False, ["LongTermDebtNoncurrent", "LongTermDebt"]),
]
ANNUAL_FORM = "10-K"
ANNUAL_DAYS = (330, 400)
LATE_DAYS = 45
CORE_FIELDS = ["net_income", "cfo", "revenue", "book_value"]

# Share-count sources in order (taxonomy, tag, forms, days before and after
# the period end, flow).
SHARE_SOURCES = [
    ("us-gaap", "CommonStockSharesOutstanding", ["10-K"], 15, 15, False),
    ("dei", "EntityCommonStockSharesOutstanding", ["10-K", "10-K/A", "10-Q"], 30, 240, False),
    ("us-gaap", "WeightedAverageNumberOfSharesOutstandingBasic", ["10-K"], 0, 0, True),
]


def explode_facts(companies: DataFrame, facts: str = "facts") -> DataFrame:
    """One row per fact; ``pos`` keeps the order facts are listed in."""
    tags = companies.select("ticker", F.explode(facts).alias("taxonomy", "tags"))
    units = (tags.select("ticker", "taxonomy", F.explode("tags").alias("tag", "concept"))
             .select("ticker", "taxonomy", "tag", F.explode("concept.units").alias("unit", "list")))
    rows = units.select("ticker", "taxonomy", "tag", "unit", F.posexplode("list").alias("pos", "f"))
    return rows.select(
        "ticker", "taxonomy", "tag", "unit", "pos", F.to_date("f.start").alias("start"),
        F.to_date("f.end").alias("end"), F.col("f.val").alias("val"),
        F.to_date("f.filed").alias("filed"), F.col("f.form").alias("form"))


def _opened(df: DataFrame, variant: str, key: str, value: str) -> DataFrame:
    """A row for each member of an object or list; anything else, or nothing, has none."""
    members = df.sparkSession.tvf.variant_explode(F.col(variant).outer()).toDF("_pos", key, value)
    return df.lateralJoin(members).drop(variant)


def facts_from_json(lines: DataFrame, text: str = "value") -> DataFrame:
    """The rows of ``explode_facts`` from companies as delivered, one JSON text a row: ticker and facts.

    Only the tags that a field or share count reads are opened. A text that is no JSON, and branches that
    are missing or of another kind, give no rows; ``malformed`` counts the former.
    """
    wanted = sorted({("us-gaap", tag) for *_, tags in FIELD_TAGS for tag in tags} | {(s[0], s[1]) for s in SHARE_SOURCES})
    get = lambda c, path, kind: F.try_variant_get(F.col(c), f"$.{path}", kind)
    docs = lines.select(F.try_parse_json(F.col(text)).alias("doc")).where("doc IS NOT NULL")
    top = docs.select(get("doc", "ticker", "string").alias("ticker"), get("doc", "facts", "variant").alias("facts"))
    tags = _opened(_opened(top, "facts", "taxonomy", "concepts").drop("_pos"), "concepts", "tag", "concept").drop("_pos")
    read = tags.where(F.concat_ws(" ", "taxonomy", "tag").isin([" ".join(x) for x in wanted]))
    units = _opened(read.withColumn("units", get("concept", "units", "variant")).drop("concept"), "units", "unit", "list").drop("_pos")
    rows = _opened(units, "list", "_key", "f").where("_key IS NULL")  # lists have places, objects names
    day = lambda name: F.to_date(get("f", name, "string"))
    return rows.select("ticker", "taxonomy", "tag", "unit", F.col("_pos").alias("pos"), day("start").alias("start"),
                       day("end").alias("end"), get("f", "val", "double").alias("val"), day("filed").alias("filed"),
                       get("f", "form", "string").alias("form"))


def malformed(lines: DataFrame, text: str = "value") -> DataFrame:
    """One row: texts, and those that are no JSON."""
    return lines.agg(F.count("*").alias("texts"), F.count_if(F.try_parse_json(F.col(text)).isNull()).alias("malformed"))


def field_table(spark: SparkSession) -> DataFrame:
    rows = [(f, flow, "us-gaap", t, i) for f, flow, tags in FIELD_TAGS for i, t in enumerate(tags)]
    return spark.createDataFrame(rows, "field string, flow boolean, taxonomy string, tag string, prio int")


def _annual() -> F.Column:
    return F.datediff("end", "start").between(*ANNUAL_DAYS)


def first_reported(facts: DataFrame) -> DataFrame:
    """(ticker, field, end, val, filed): earliest filing of a period, then tag preference."""
    wanted = F.broadcast(field_table(facts.sparkSession))  # under thirty rows
    hits = (facts.where((F.col("form") == ANNUAL_FORM) & (F.col("unit") == "USD") & F.col("val").isNotNull())
            .join(wanted, ["taxonomy", "tag"])
            .where(~F.col("flow") | (F.col("start").isNotNull() & _annual())))
    return hits.groupBy("ticker", "field", "end").agg(
        F.min_by("val", F.struct("filed", "prio", "pos")).alias("val"), F.min("filed").alias("filed"))


def share_counts(facts: DataFrame, periods: DataFrame) -> DataFrame:
    """(ticker, end, shares): best source first, classes filed together summed."""
    rule = None
    for i, (tax, tag, forms, lo, hi, flow) in enumerate(SHARE_SOURCES):
        ok = ((F.col("taxonomy") == tax) & (F.col("tag") == tag) & F.col("form").isin(forms))
        if flow:
            ok = ok & (F.col("start").isNull() | _annual())
        one = F.struct(F.lit(i).alias("prio"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"))
        rule = F.when(ok, one) if rule is None else rule.when(ok, one)
    counted = (facts.where((F.col("unit") == "shares") & F.col("val").isNotNull())
               .withColumn("s", rule).where(F.col("s").isNotNull())
               .groupBy("ticker", "s", "filed", F.col("end").alias("as_of"))
               .agg(F.sum("val").alias("shares")))
    # a company's periods and its share facts: a few rows a year on each side
    near = (periods.select("ticker", "end").join(counted, "ticker")
            .where(F.col("as_of").between(F.expr("date_sub(end, s.lo)"), F.expr("date_add(end, s.hi)"))))
    return near.groupBy("ticker", "end").agg(
        F.min_by("shares", F.struct("s.prio", "filed", "as_of")).alias("shares_outstanding"))


def canonical_rows(facts: DataFrame) -> DataFrame:
    """Annual rows as known at the original filing.

    The report date is the latest first print among the core fields; a value first printed
    more than 45 days later was not public then and is dropped.
    """
    first = first_reported(facts)
    fields = [f for f, _, _ in FIELD_TAGS]
    wide = (first.groupBy("ticker", "end").pivot("field", fields)
            .agg(F.first(F.struct("val", "filed"))).where(F.col("total_assets").isNotNull()))
    core = [F.col("total_assets.filed"), *[F.col(f"{f}.filed") for f in CORE_FIELDS]]
    dated = wide.withColumn("report_date", F.greatest(*core))
    value = lambda f: F.when(F.datediff(F.col(f"{f}.filed"), "report_date") <= LATE_DAYS, F.col(f"{f}.val"))
    flat = dated.select("ticker", "end", "report_date", *[value(f).alias(f) for f in fields])
    shares = share_counts(facts, flat)
    return (flat.join(shares, ["ticker", "end"], "left")
            .withColumn("cogs", F.coalesce("cogs", F.col("revenue") - F.col("gross_profit")))
            .withColumn("long_term_debt", F.coalesce("long_term_debt", F.lit(0.0)))
            .withColumn("fiscal_year", fiscal_label(F.col("end")))
            .withColumnRenamed("end", "period_end").drop("gross_profit"))
