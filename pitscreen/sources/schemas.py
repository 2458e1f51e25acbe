"""Column contracts of the tables the operators read."""

from __future__ import annotations

from pyspark.sql import DataFrame, types as T

STATEMENT_LINES = [
    "total_assets", "net_income", "cfo", "long_term_debt", "current_assets",
    "current_liabilities", "shares_outstanding", "equity_issued", "revenue", "cogs",
    "book_value", "market_cap",
]

FUNDAMENTALS = T.StructType(
    [T.StructField("ticker", T.StringType()),
     T.StructField("fiscal_year", T.IntegerType()),
     T.StructField("report_date", T.DateType())]
    + [T.StructField(c, T.DoubleType()) for c in STATEMENT_LINES])

# A market that arrives scored carries no statement lines.
SCORED_MARKET_FUNDAMENTALS = T.StructType([
    T.StructField("ticker", T.StringType()),
    T.StructField("fiscal_year", T.IntegerType()),
    T.StructField("report_date", T.DateType()),
    T.StructField("book_value", T.DoubleType()),
    T.StructField("market_cap", T.DoubleType()),
])

PRICES = T.StructType([
    T.StructField("ticker", T.StringType()),
    T.StructField("date", T.DateType()),
    T.StructField("adj_close", T.DoubleType()),
    T.StructField("close_raw", T.DoubleType()),
    T.StructField("volume", T.DoubleType()),
])

SECTORS = T.StructType([
    T.StructField("ticker", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("sector", T.StringType()),
])

MEMBERSHIP = T.StructType([
    T.StructField("date", T.DateType()),
    T.StructField("ticker", T.StringType()),
])

FLAGS = ["f_roa", "f_cfo", "f_droa", "f_accrual", "f_dlever", "f_dliquid",
         "f_eq_offer", "f_dmargin", "f_dturn"]

SCORE_PANEL = ["ticker", *FLAGS, "fscore", "score_year", "fiscal_year", "sector", "bm",
               "market_cap"]

_FACT = T.StructType([
    T.StructField("start", T.StringType()),
    T.StructField("end", T.StringType()),
    T.StructField("val", T.DoubleType()),
    T.StructField("filed", T.StringType()),
    T.StructField("form", T.StringType()),
])
# taxonomy -> tag -> {units: unit -> facts}
COMPANY_FACTS = T.MapType(T.StringType(), T.MapType(T.StringType(), T.StructType([
    T.StructField("units", T.MapType(T.StringType(), T.ArrayType(_FACT)))])))


def missing_columns(df: DataFrame, contract: list[str] | T.StructType) -> list[str]:
    names = contract if isinstance(contract, list) else contract.fieldNames()
    return [c for c in names if c not in df.columns]


def require(df: DataFrame, contract: list[str] | T.StructType, what: str) -> DataFrame:
    gone = missing_columns(df, contract)
    if gone:
        raise KeyError(f"{what} must carry {gone}")
    return df
