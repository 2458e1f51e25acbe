"""Membership spells, comparison by digests, the Gram matrix in levels."""
import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitscreen.operators import checks as V, membership as M
from pitscreen.operators.universe_variance import gram, windows
from test_weights import factor_returns, sparse_series


def test_spells_answer_any_day(spark):
    rnd = random.Random(3)
    snaps = [dt.date(2000, 1, 1) + dt.timedelta(days=d) for d in (0, 90, 200, 400, 800, 900, 1500)]
    lists = {s: sorted(n for n in "ABCDEFG" if rnd.random() < 0.6) for s in snaps}
    rows = [(s, ",".join(f" {n}" for n in part)) for s, names in lists.items() for part in (names[:2], names[2:])]
    spells = M.intervals(spark.createDataFrame(rows, "date date, tickers string"))
    days = [dt.date(1999, 12, 1) + dt.timedelta(days=d) for d in range(0, 2200, 13)] + snaps
    got = {(r.date, r.ticker) for r in M.members_on(spark.createDataFrame([(d,) for d in days], "date date"), spells).collect()}
    want = {(d, n) for d in days for n in lists.get(max((s for s in snaps if s <= d), default=None), [])}
    assert got == want and len(want) > 100
    per_name = spells.groupBy("ticker").count().agg(F.max("count")).first()[0]
    assert per_name >= 2  # a name that left came back as a second spell


def test_digests_find_what_a_full_comparison_finds(spark):
    old = spark.range(5000).selectExpr("id AS k", "id % 13 * 1.5D AS v", "if(id % 17 = 0, null, id) AS w")
    new = (old.where("k <> 77").withColumn("v", F.when(F.col("k") == 5, 99.0).when(F.col("k") == 6, F.col("v") * (1 + 1e-12)).otherwise(F.col("v")))
           .unionByName(spark.createDataFrame([(9999, 1.0, 2)], "k long, v double, w long")))
    rows = lambda df: sorted(tuple(map(str, r)) for r in df.collect())
    assert rows(V.compare_large(old, new, ["k"])) == rows(V.compare_tables(old, new, ["k"])) and V.compare_large(old, new, ["k"]).count() == 3
    assert V.compare_large(old, old, ["k"]).count() == 0
    fewer = new.drop("w")
    assert rows(V.compare_large(old, fewer, ["k"], buckets=64)) == rows(V.compare_tables(old, fewer, ["k"]))


@pytest.mark.parametrize("fan", [1, 3, 32])
def test_gram_in_levels(spark, fan):
    x = factor_returns(50, 40, 2)
    s = sparse_series(spark, x).repartition(7)
    rows = gram(s.join(windows(s).drop("names"), "formation_year"), fan).collect()
    z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    assert np.allclose(np.stack([r.row for r in sorted(rows, key=lambda r: r.t)]), z @ z.T)
