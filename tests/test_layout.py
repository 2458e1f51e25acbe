"""Tables laid out by their keys: joins and windows without a shuffle, folders that are never opened."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pitscreen.operators import paths as P
from pitscreen.sources.layout import lay_out

KEYS = ["formation_year", "ticker"]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df) -> list[str]:
    return [x for x in plan(df).splitlines() if "Exchange" in x and "Broadcast" not in x]


@pytest.fixture(scope="module")
def market(spark):
    days = spark.range(1500).select(F.date_add(F.lit(dt.date(2018, 6, 20)), F.col("id").cast("int")).alias("date"))
    bars = days.join(spark.range(12).select(F.concat(F.lit("T"), "id").alias("ticker"), "id")).where(
        F.pmod(F.xxhash64("date", "ticker"), F.lit(7)) > 1).withColumn("adj_close", 50 + F.pmod(F.hash("date", "id"), F.lit(1000)) / 100)
    books = spark.createDataFrame([(y, f"b{b}", f"T{i}", (-0.25 if b == 2 and i % 2 else 0.25)) for y in (2018, 2019, 2020)
                                   for b in range(3) for i in range(b, b + 4)], "formation_year int, book string, ticker string, w double")
    return bars.select("ticker", "date", "adj_close"), books


def test_paths_without_a_shuffle_by_name(spark, market):
    prices, books = market
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        bars = lay_out(P.bars_by_formation(prices), "bars", KEYS, ("date",), folder_by="formation_year")
        held = lay_out(books, "held", KEYS, buckets=bars.buckets).read()
        names = held.select(*KEYS).distinct()
        steps = P.growth_steps(bars.read(2018, 2019), names)
        assert shuffles(steps) == []
        sessions = P.holding_sessions(prices)
        values = P.book_values(held, steps, sessions)
        assert not [x for x in shuffles(values) if "ticker" in x]
        plain = P.growth_steps(prices, books)
        assert [x for x in shuffles(plain) if "ticker" in x]
        for delisted in (0.0, -0.3):
            want = P.book_values(books, P.growth_steps(prices, books, delisted), sessions)
            got = P.book_values(held, P.growth_steps(bars.read(), names, delisted), sessions)
            rows = lambda df: sorted((*r[:4], round(r.value, 9)) for r in df.select(*KEYS[:1], "book", "leg", "date", "value").collect())
            assert rows(got) == rows(want)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_folders_are_pruned(spark, market):
    laid = lay_out(P.bars_by_formation(market[0]), "bars", KEYS, ("date",), folder_by="formation_year", buckets=3)
    all_rows, one = laid.read(), laid.read(2019, 2019)
    assert one.columns == all_rows.columns == ["ticker", "date", "adj_close", "formation_year"]
    filters = next(x for x in plan(one).splitlines() if "PartitionFilters" in x)
    assert "formation_year_folder" in filters[filters.index("PartitionFilters"):filters.index("PushedFilters")]
    files = {f.rsplit("/", 2)[1] for f in one.select(F.input_file_name().alias("f")).distinct().toPandas()["f"]}
    assert files == {"formation_year_folder=2019"}
    assert one.select(F.input_file_name()).distinct().count() <= 3
    assert one.count() == all_rows.where("formation_year = 2019").count() > 0


def test_names_that_clash_and_tables_without_folders(spark):
    df = spark.createDataFrame([(2001, "A", 1), (2002, None, 2), (None, "B", 3)],
                               "formation_year int, ticker string, formation_year_folder int")
    laid = lay_out(df, "odd-name", KEYS, folder_by="formation_year")
    assert sorted(map(str, laid.read().collect())) == sorted(map(str, df.collect())) and laid.read(2002).count() == 1
    assert lay_out(df.limit(0), "empty", KEYS).read().count() == 0
    with pytest.raises(ValueError):
        lay_out(df, "flat", KEYS).read(first=2001)
