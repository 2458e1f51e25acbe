"""Reading and writing market tables as files."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from pitscreen.functions.numeric import nan_to_null
from pitscreen.operators.tables import stack
from pitscreen.sources import schemas

MARKETS = ("us", "japan")

# Markets whose score panel is delivered, not computed here, and how to get it.
DELIVERED_PANEL = {"vietnam": "run the vendor chain and export its score panel"}


@dataclass(frozen=True)
class MarketTables:
    fundamentals: DataFrame
    prices: DataFrame
    sectors: DataFrame
    benchmarks: DataFrame


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Text table with a header; columns are matched by the header's names."""
    head = spark.read.option("header", True).csv(path).columns
    typed = {f.name: f.dataType for f in schema}
    by_file = T.StructType([T.StructField(c, typed.get(c, T.StringType())) for c in head])
    raw = spark.read.option("header", True).schema(by_file).csv(path)
    return nan_to_null(raw.select(*[c for c in schema.fieldNames() if c in head]))


def read_gzip_csv(spark: SparkSession, path: str, schema: T.StructType, key: str) -> DataFrame:
    """A gzip file is one split; rows are spread again before any work on them."""
    return read_csv(spark, path, schema).repartition(key)


def load_market(spark: SparkSession, market: str, folder: str) -> MarketTables:
    """The four tables of a market; a missing file names the file."""
    m = market.lower()
    files = {"fundamentals": f"{folder}/{m}_fundamentals.csv", "prices": f"{folder}/{m}_prices.csv.gz",
             "sectors": f"{folder}/{m}_sectors.csv", "benchmarks": f"{folder}/{m}_benchmarks.csv.gz"}

    def get(name: str, schema: T.StructType) -> DataFrame:
        try:
            if files[name].endswith(".gz"):
                return read_gzip_csv(spark, files[name], schema, "ticker")
            return read_csv(spark, files[name], schema)
        except AnalysisException as e:
            raise FileNotFoundError(f"{files[name]} is missing; land the market's files first") from e

    return MarketTables(get("fundamentals", schemas.FUNDAMENTALS), get("prices", schemas.PRICES),
                        get("sectors", schemas.SECTORS), get("benchmarks", schemas.PRICES))


def load_prices(spark: SparkSession, market: str, folder: str) -> DataFrame:
    return _known(spark, market, folder).prices


def _known(spark: SparkSession, market: str, folder: str) -> MarketTables:
    if market.lower() not in MARKETS:
        raise NotImplementedError(f"no adapter for market {market!r}")
    return load_market(spark, market, folder)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", by: list[str] | None = None) -> None:
    """Parquet, or CSV / gzip CSV with a header; optionally one folder per value of ``by``."""
    w = df.write.mode("overwrite")
    if by:
        w = w.partitionBy(*by)
    if fmt == "parquet":
        w.parquet(path)
    elif fmt in ("csv", "csv.gz"):
        w = w.option("header", True)
        (w.option("compression", "gzip") if fmt == "csv.gz" else w).csv(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")


def read_yearly(spark: SparkSession, folder: str, year: str = "year") -> DataFrame:
    """A folder with one part per year; the folder name gives the year column.

    Years may carry different columns; a filter on the year prunes the parts read.
    """
    return (spark.read.option("mergeSchema", True).parquet(folder)
            .withColumn(year, F.col(year).cast("int")))


def stack_years(parts: dict[int, DataFrame], year: str = "year") -> DataFrame:
    """Per-year tables (sheets) as one table tagged with the year."""
    return stack([df.withColumn(year, F.lit(y)) for y, df in parts.items()])


def read_factor_file(spark: SparkSession, path: str) -> DataFrame:
    """Daily factors in per cent, between a title block and annotations, as decimals."""
    lines = spark.read.text(path).where(F.rlike("value", F.lit(r"^\s*\d{8},")))
    parts = F.split("value", ",")
    num = lambda i: F.trim(F.get(parts, F.lit(i))).cast("double") / 100
    return lines.select(F.to_date(F.trim(F.get(parts, F.lit(0))), "yyyyMMdd").alias("date"),
                        num(1).alias("mkt_rf"), num(2).alias("smb"), num(3).alias("hml"), num(4).alias("rf"))


def wide_to_long(wide: DataFrame, value: str, day: str = "date") -> DataFrame:
    """date x ticker columns to (date, ticker, value)."""
    names = [c for c in wide.columns if c != day]
    return wide.unpivot(day, names, "ticker", value)


def long_prices(adj_close: DataFrame, close: DataFrame, volume: DataFrame) -> DataFrame:
    """Three wide tables of one download to canonical bars; rows without a price go."""
    a, c, v = (wide_to_long(adj_close, "adj_close"), wide_to_long(close, "close_raw"),
               wide_to_long(volume, "volume"))
    return (a.where(F.col("adj_close").isNotNull())
            .join(c, ["date", "ticker"], "left").join(v, ["date", "ticker"], "left"))


def reuse_or_build(spark: SparkSession, path: str, build: Callable[[], DataFrame],
                   fresh: Callable[[DataFrame], bool]) -> DataFrame:
    """The stored table if it exists and is fresh, else built, stored and read back."""
    try:
        stored = spark.read.parquet(path)
        if fresh(stored):
            return stored
    except AnalysisException:
        pass
    write_table(build(), path)
    return spark.read.parquet(path)


def prices_fresh(needed_from: str) -> Callable[[DataFrame], bool]:
    """Stored prices are stale when history starts too late or raw closes are absent."""

    def check(px: DataFrame) -> bool:
        if "close_raw" not in px.columns:
            return False
        first = px.agg(F.min("date").cast("string").alias("d")).first()["d"]  # one row
        return first is not None and first <= needed_from

    return check


def panel_or_build(spark: SparkSession, market: str, path: str, build: Callable[[], DataFrame],
                   refresh: bool = False) -> DataFrame:
    """The stored score panel unless absent or ``refresh``; delivered panels are never built."""
    if market in DELIVERED_PANEL:
        try:
            return spark.read.parquet(path)
        except AnalysisException as e:
            raise FileNotFoundError(f"{path} is missing; {DELIVERED_PANEL[market]}") from e
    return reuse_or_build(spark, path, build, lambda _: not refresh)
