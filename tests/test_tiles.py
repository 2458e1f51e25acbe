"""Random books as a blocked product, held against the joined rows."""
import random

import pytest

from pitscreen.operators import paths as P
from pitscreen.operators.tiles import tiled_moves, tiled_returns


@pytest.fixture(scope="module")
def market(spark):
    rnd = random.Random(4)
    days = [f"2001-{m:02d}-{d:02d}" for m in (7, 8, 9) for d in (2, 9, 16, 23)]
    sessions = spark.createDataFrame([(y, d.replace("2001", str(y)), i + 1) for y in (2001, 2002) for i, d in enumerate(days)],
                                     "formation_year int, date string, session int").selectExpr("formation_year", "date(date) AS date", "session")
    names = [f"N{i}" for i in range(30)]
    steps = spark.createDataFrame([(y, n, d.replace("2001", str(y)), rnd.uniform(-0.1, 0.12)) for y in (2001, 2002) for n in names[:28]
                                   for d in days if rnd.random() < 0.6], "formation_year int, ticker string, date string, step double").selectExpr(
        "formation_year", "ticker", "date(date) AS date", "step")
    books = [(y, b, n, 1 / 5) for y in (2001, 2002) for b in range(23) for n in rnd.sample(names, 5)] + [(2002, 99, "N29", 1.0)]
    return spark.createDataFrame(books, "formation_year int, book int, ticker string, w double"), steps, sessions


@pytest.mark.parametrize("tile", [{}, {"books": 4, "names": 7}, {"books": 1, "names": 1000}])
def test_tiles_equal_joined_rows(market, tile):
    positions, steps, sessions = market
    got = {(r.formation_year, r.book, r.date): r.r for r in tiled_returns(positions, steps, sessions, **tile).collect()}
    want = {(r.formation_year, r.book, r.date): r.r for r in P.book_returns(P.book_values(positions, steps, sessions)).collect()}
    assert got.keys() == want.keys() and len(got) == (2 * 23 + 1) * 12
    assert all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)
    assert {r for (y, b, _), r in got.items() if b == 99} == {0.0}


def test_a_step_meets_blocks_and_not_books(spark, market):
    positions, steps, sessions = market
    out = tiled_moves(positions, steps, sessions, books=32)
    assert out.count() == 2 * 23 + 1  # one row a book, whatever the sessions
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInPandas" in plan and "CartesianProduct" not in plan
