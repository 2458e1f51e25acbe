"""Physical plans: what is pushed down, pruned and kept small."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pitscreen.operators import baskets as B, paths as P, vendor_bars as N
from pitscreen.session import land, shared_folder


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def bars(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("bars") / "t")
    rows = [(f"S{i % 5}", dt.date(2020, 1 + i % 12, 1 + i % 28), 1.0, 1.0, 1000.0, 1.0, 5.0, 4.0, 1.0) for i in range(300)]
    spark.createDataFrame(rows, "symbol string, date date, price_close double, price_average double, unit double, "
                                "adj_ratio double, total_volume double, deal_volume double, putthrough_volume double"
                          ).write.parquet(path)
    return spark.read.parquet(path)


def test_filters_and_columns_reach_the_scan(bars):
    p = plan(N.month_end_bars(bars))
    assert "EqualTo(unit,1000.0)" in p and "GreaterThan(price_close,0.0)" in p
    schema = p[p.index("ReadSchema"):].splitlines()[0]
    assert "putthrough_volume" not in schema and "adj_ratio" not in schema
    assert "Window" not in p  # month ends come from a combining aggregate


def test_top_k_limits_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).cast("int").alias("formation_year"),
                                  F.col("id").cast("string").alias("ticker"), (F.col("id") % 10).cast("int").alias("fscore"))
    p = plan(B.score_basket(df, 5, 1))
    assert p.count("WindowGroupLimit") == 2 and "Partial" in p


def test_random_baskets_never_pair_draws_with_the_pool(spark):
    pool = spark.range(1000).select(F.lit(2024).alias("formation_year"), F.col("id").cast("string").alias("ticker"))
    p = plan(B.random_baskets(pool, 5, 100))
    assert "CartesianProduct" not in p and "NestedLoop" not in p


def test_paths_have_no_grid_of_names_by_sessions(spark):
    px = spark.createDataFrame([("A", dt.date(2024, 7, d), 1.0) for d in range(1, 9)], "ticker string, date date, adj_close double")
    pos = spark.createDataFrame([(2024, "b", "A", 1.0)], "formation_year int, book string, ticker string, w double")
    v = P.book_values(pos, P.growth_steps(px, pos), P.holding_sessions(px))
    assert "CartesianProduct" not in plan(v) and "NestedLoop" not in plan(v)
    assert v.count() == 7


def test_landed_table_keeps_schema_and_lives_in_the_shared_folder(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0])], "k int, a array<double>")
    got = land(df, "t")
    assert got.schema == df.schema and got.collect() == df.collect()
    assert shared_folder(spark).rstrip("/") in got.inputFiles()[0]


def test_study_reads_only_the_sessions_it_needs(bars):
    from pitscreen.functions.dates import between_formations

    p = plan(between_formations(bars, 2012, 2024, 36, 0, 7).select("symbol"))
    assert "GreaterThanOrEqual(date,2009-06-24)" in p and "LessThan(date,2024-07-01)" in p
    p = plan(between_formations(bars, 2012, 2024, 0, 12, 7).select("symbol"))
    assert "GreaterThanOrEqual(date,2012-06-24)" in p and "LessThan(date,2025-07-01)" in p
