"""Steps whose work must not be repeated or shuffled whole as tables grow."""
import datetime as dt

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pitscreen.operators import paths as P, report as R, universe_variance as V, vendor_bars as N
from pitscreen.operators.weights import optimised_weights
from pitscreen.plans import grid as G
from pitscreen.sources import line_items as L

PRICES = "ticker string, date date, adj_close double"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_price_windows_aggregate_a_names_first_date(spark):
    days = [dt.date(2000, 1, 3) + dt.timedelta(i) for i in range(170)]
    rows = [("A", d, 1.0) for d in days] + [("B", d, 1.0) for d in days[160:]]
    panel = spark.createDataFrame([("A", 1999), ("B", 1999), ("C", 1999)], "ticker string, score_year int")
    got = R.price_windows(panel, spark.createDataFrame(rows, PRICES))
    r = got.collect()
    assert [(x.formation_year, x.universe, x.eligible, x.window_sessions, x.usable_obs) for x in r] == [(2000, 3, 1, 169, 169)]
    assert "partial_min(date" in plan_of(got)


def test_names_are_laid_out_in_blocks():
    n = 3 * V.NAMES + 5
    years = np.where(np.arange(n) % 3 == 0, 2001, 2000).astype(np.int32)
    batch = pa.RecordBatch.from_pydict({"formation_year": years, "total": np.full(n, 9), "start": np.full(n, 1), "ticker": [str(i) for i in range(n)]})
    blocks = list(V._blocks([batch]))
    assert max(some.num_rows for *_, some in blocks) <= V.NAMES
    assert sorted(int(t) for *_, some in blocks for t in some["ticker"].to_pylist()) == list(range(n))
    assert all(set(some["formation_year"].to_pylist()) == {year} and (total, start) == (9, 1) for year, total, start, some in blocks)


def test_wide_lines_aggregate_in_fixed_width(spark):
    long = spark.createDataFrame([("A", "2020", "balance_sheet", L.LABELS["balance_sheet"]["total_assets"], 1.0)],
                                 "symbol string, period string, statement string, name string, value double")
    got = L.wide(long, L.panel_keys())
    assert "ObjectHashAggregate" not in plan_of(got) and got.first().total_assets == 1.0


def test_june_windows_are_a_table_of_their_own(spark):
    bar = lambda s, d, unit, v: (s, dt.date(2000, 6, d), unit, 2.0, 2.0, 1.0, v, v)
    bars = spark.createDataFrame([bar("A", 20, 1000.0, 5.0), bar("A", 21, 1000.0, 0.0), *[bar("I", d, 1.0, 1.0) for d in (20, 21, 22, 23)]],
                                 "symbol string, date date, unit double, price_close double, price_average double, adj_ratio double, "
                                 "total_volume double, deal_volume double")
    capital = spark.createDataFrame([("A", "1999", 100_000.0), ("B", "1999", 100_000.0)], "symbol string, period string, paid_in_capital double")
    counts = spark.createDataFrame([], "symbol string, period string, share_at_period_end double")
    windows = N.window_rows(bars)
    assert [(r.symbol, r.period, r.bars, r.market_sessions, r.traded_pct) for r in windows.collect()] == [("A", "1999", 2, 4, 25.0)]
    got = {r.symbol: (r.turnover, r.bars) for r in N.turnover_rows(capital, windows, counts).collect()}
    assert got == {"A": (0.5, 2), "B": (None, None)}


def test_bars_are_dealt_before_they_are_repeated(spark):
    days = [dt.date(2000, 6, d) for d in (5, 6, 7, 8)]
    prices = spark.createDataFrame([(t, d, 1.0 + i) for t in "AB" for i, d in enumerate(days)], PRICES)
    names = spark.createDataFrame([("A", 2000), ("A", 2001), ("A", 2001), ("B", 2002), ("C", 2000)], "ticker string, formation_year int")
    got = P.estimation_series(prices, names)
    assert "REPARTITION_BY_COL" in plan_of(got)
    assert dict(got.dtypes)["formation_year"] == "int"
    assert {(r.formation_year, r.ticker, len(r.at), r.n_returns) for r in got.collect()} == {
        (2000, "A", 3, 3), (2001, "A", 3, 3), (2002, "B", 3, 3)}


def test_only_series_of_held_names_are_shuffled(spark):
    series = spark.createDataFrame([(2000, f"N{i}", 0, 4, [1, 2, 3, 4], [0.1, -0.1 * i, 0.2, 0.01]) for i in range(9)],
                                   "formation_year int, ticker string, first int, sessions int, at array<int>, r array<double>")
    got = optimised_weights(spark.createDataFrame([(2000, "b", "N1"), (2000, "b", "none")], "formation_year int, book string, ticker string"), series, "GMV")
    assert "LeftSemi" in plan_of(got) and [(r.ticker, r.w) for r in got.collect()] == [("N1", 1.0)]


def test_universe_books_meet_the_steps_once(spark, monkeypatch):
    monkeypatch.setattr(G, "land", lambda df, name: df)
    asked = []

    class Some(G.Market):
        universe_positions = universe_gmv = None

        def __init__(self):
            self.spec = G.GridSpec()

        def returns_of(self, positions, books=None):
            asked.extend(books)
            return spark.range(1).select(F.lit(2000).alias("formation_year"), F.lit(books[0]).alias("book"), "id")

    class One(G.Cell):
        basket_positions = spark.range(1)

        def optimised_positions(self, how):
            return spark.range(1)

    market = Some()
    for k in (8, 10):
        cell = One(market, G.GridSpec(k=k))
        assert cell.daily(True).count() == 4 and cell.daily(False).count() == 2
    assert asked.count("universe_EW") == asked.count("universe_GMV") == 1 and asked.count("score_EW") == 2
