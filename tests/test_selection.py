"""Baskets, ranks and quantiles, including groups that hold most of the table."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitscreen.operators import baskets as B, ordering as O
from pitscreen.sources import markets


def ranked_names(df, k, seed, **how):
    return [r.ticker for r in B.score_basket(df, k, seed, **how).orderBy("rank").collect()]


def tied(spark, n_best=2, n_tied=12, n_worst=3):
    """Scores with a large tie in the middle; book-to-market falls with the number in the name."""
    scores = [7] * n_best + [5] * n_tied + [2] * n_worst
    rows = [(2019, f"S{i:02d}", s, 10.0 - i) for i, s in enumerate(scores)]
    return spark.createDataFrame(rows, "formation_year int, ticker string, fscore int, bm double")


def test_a_tie_at_the_cut_is_drawn_by_seed(spark):
    df = tied(spark)
    best, middle, worst = {"S00", "S01"}, {f"S{i:02d}" for i in range(2, 14)}, {"S14", "S15", "S16"}
    draws = {seed: ranked_names(df, 6, seed) for seed in range(4)}
    for picked in draws.values():
        assert set(picked[:2]) == best and set(picked[2:]) <= middle and len(picked) == 6
    assert len({tuple(p[2:]) for p in draws.values()}) > 1
    assert ranked_names(df, 6, 3) == draws[3]
    assert set(ranked_names(df, 17, 0)[-3:]) == worst
    assert ranked_names(df, 17, 0, lowest=True) == ranked_names(df, 17, 0)[::-1]


def test_slots_left_for_the_tie(spark):
    df = tied(spark)
    slots = {k: B.tie_break_slots(df, k).first().tie_break_slots for k in (2, 6, 14, 17)}
    assert slots[6] == 4
    assert slots[2] in (0, 2) and slots[14] in (0, 12)


def test_quintiles_match_the_hand_cases(spark):
    # 0-based equal-frequency buckets of ranks 1..n
    for n, want in ((5, [0, 1, 2, 3, 4]), (7, [0, 0, 1, 2, 3, 4, 4]), (10, [0, 0, 1, 1, 2, 2, 3, 3, 4, 4])):
        got = [r.b for r in spark.range(1, n + 1).select(B.quintile(F.col("id"), F.lit(n)).alias("b")).collect()]
        assert got == want, (n, got)


def test_liquidity_match_mirrors_buckets_and_fills_up(spark):
    v = spark.createDataFrame([(2024, f"N{i:02d}", float(i)) for i in range(30)],
                              "formation_year int, ticker string, adv double")
    target = v.where("adv >= 20").withColumn("rank", F.col("adv").cast("int"))
    m = B.liquidity_matched(v, target.where("adv < 26"), 6).collect()
    assert len(m) == 6 and not {r.ticker for r in m} & {f"N{i}" for i in range(20, 26)}
    everyone = v.withColumn("rank", F.col("adv").cast("int") + 1)
    assert {r.stage for r in B.liquidity_matched(v, everyone, 6).collect()} == {3}


def test_random_baskets_are_uniform_distinct_and_nested(spark):
    pool = spark.createDataFrame([(y, f"N{i:03d}") for y in (2023, 2024) for i in range(40)],
                                 "formation_year int, ticker string")
    d = B.random_baskets(pool, 10, 400, seed=7)
    sizes = d.groupBy("formation_year", "draw").agg(F.count_distinct("ticker").alias("n")).select("n").distinct()
    assert [r.n for r in sizes.collect()] == [10]
    hits = [r["count"] for r in d.groupBy("formation_year", "ticker").count().collect()]
    assert len(hits) == 80 and min(hits) > 60 and max(hits) < 145  # mean 100, sd about 8.7
    few = {tuple(r) for r in B.random_baskets(pool, 10, 5, seed=7).collect()}
    assert few == {tuple(r) for r in d.where("draw < 5").collect()}
    assert few != {tuple(r) for r in B.random_baskets(pool, 10, 5, seed=8).collect()}
    whole = B.random_baskets(pool, 99, 2, seed=7).groupBy("formation_year", "draw").count().collect()
    assert {r["count"] for r in whole} == {40}


def skewed(spark, n=30_000):
    """One year holds nine tenths of the rows, one value a third of them."""
    rng = np.random.default_rng(0)
    v = np.where(np.arange(n) % 3 == 0, 5.0, np.round(rng.normal(5, 2, n), 3))
    y = np.where(np.arange(n) % 10 == 0, 1, 0)
    return spark.createDataFrame([(int(a), f"K{i}", float(b)) for i, (a, b) in enumerate(zip(y, v))],
                                 "g int, k string, v double").repartition(8), y, v


def test_quantiles_are_exact_on_skewed_groups(spark):
    df, y, v = skewed(spark)
    probs = {"lo": 0.0, "a": 0.1, "m": 0.5, "z": 0.97, "hi": 1.0}
    for r in O.exact_quantiles(df, ["g"], "v", probs).collect():
        want = np.quantile(v[y == r.g], list(probs.values()))
        assert [r[p] for p in probs] == pytest.approx(list(want), abs=1e-12)
    one = O.exact_quantiles(df, [], "v", {"m": 0.3}).first()
    assert one.m == pytest.approx(np.quantile(v, 0.3))


@pytest.mark.parametrize("n", [1, 2, 3, 7, 50, 83])
def test_quantiles_of_small_groups(spark, n):
    v = np.random.default_rng(n).normal(size=n)
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    r = O.exact_quantiles(df, [], "v", {"a": 0.1, "b": 0.25, "c": 0.9}).first()
    assert [r.a, r.b, r.c] == pytest.approx(list(np.quantile(v, [0.1, 0.25, 0.9])))


def test_spread_rank_equals_row_number_and_splits_hot_values(spark):
    df, y, v = skewed(spark)
    got = O.spread_rank(df, ["g"], "v", "k", ascending=False)
    from pyspark.sql import Window as W
    w = W.partitionBy("g").orderBy(F.desc("v"), F.md5("k"), "k")
    want = df.withColumn("rank", F.row_number().over(w))
    both = got.select("g", "k", "rank").exceptAll(want.select("g", "k", F.col("rank").cast("bigint")))
    assert both.count() == 0 and got.count() == len(v)


def test_hashed_index_numbers_each_group(spark):
    df, y, _ = skewed(spark, 3000)
    got = O.hashed_index(df, ["g"], "k")
    r = got.groupBy("g").agg(F.min("index").alias("a"), F.max("index").alias("b"),
                             F.count_distinct("index").alias("n"), F.max("size").alias("s")).collect()
    assert all(x.a == 1 and x.b == x.n == x.s == (y == x.g).sum() for x in r)


def test_shorting_registry():
    assert all(markets.allows_shorting(m) for m in ("us", "Japan", "vietnam", "vn"))
    assert markets.is_hypothetical_short("vn") and not markets.is_hypothetical_short("us")
    assert not markets.allows_shorting("elsewhere") and not markets.is_hypothetical_short("elsewhere")


def test_top_k_beyond_the_pushed_limit(spark):
    n, k = 30_000, 5000
    df = spark.range(n).select((F.col("id") % 2).alias("y"), (F.col("id") * 7919 % 10007).alias("v"), "id")
    got = O.top_k(df, ["y"], [F.desc("v"), F.col("id")], k).collect()
    for y in (0, 1):
        want = sorted(((-(i * 7919 % 10007), i) for i in range(y, n, 2)))[:k]
        mine = sorted((r.rank, r.id) for r in got if r.y == y)
        assert [i for _, i in mine] == [i for _, i in want] and [r for r, _ in mine] == list(range(1, k + 1))
    plan = O.top_k(df, ["y"], [F.desc("v"), F.col("id")], k)._jdf.queryExecution().executedPlan().toString()
    assert "_slice" in plan
