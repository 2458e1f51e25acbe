"""Baskets per formation year, as rows (formation_year, ticker)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from pitscreen.operators.ordering import hashed_index, top_k

YEAR = "formation_year"


def shuffle_key(*parts) -> Column:
    """Reproducible random order: md5 of the parts joined by ':'."""
    return F.md5(F.concat_ws(":", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts]))


def tie_break(seed: int | Column) -> Column:
    return shuffle_key(seed, F.col(YEAR), F.col("ticker"))


def score_basket(scored: DataFrame, k: int, seed: int | Column = 42, lowest: bool = False,
                 by: tuple[str, ...] = (YEAR,)) -> DataFrame:
    """Top (or bottom) k by score; equal scores are ordered by a seeded hash.

    The bottom basket reads the same order from its other end.
    """
    order = ([F.asc("fscore"), tie_break(seed).desc()] if lowest
             else [F.desc("fscore"), tie_break(seed).asc()])
    return top_k(scored, list(by), order, k)


def tie_break_slots(scored: DataFrame, k: int | DataFrame) -> DataFrame:
    """How many of the k slots the tie-break decides, per formation year.

    ``k`` is one size for all years or a table (formation_year, k_eff).
    """
    per_score = scored.groupBy(YEAR, "fscore").agg(F.count("*").alias("n"))  # ten rows a year
    if isinstance(k, int):
        per_score = per_score.withColumn("k_eff", F.lit(k))
    else:
        per_score = per_score.join(F.broadcast(k), YEAR)
    above = F.coalesce(F.sum("n").over(
        W.partitionBy(YEAR).orderBy(F.desc("fscore")).rowsBetween(W.unboundedPreceding, -1)),
        F.lit(0))
    total = F.sum("n").over(W.partitionBy(YEAR))
    cut_here = ((F.col("above") < F.col("k_eff")) & (F.col("total") >= F.col("k_eff"))
                & (F.col("above") + F.col("n") >= F.col("k_eff")))
    return (per_score.withColumn("above", above).withColumn("total", total)
            .groupBy(YEAR).agg(F.coalesce(
                F.max(F.when(cut_here, F.col("k_eff") - F.col("above"))),
                F.lit(0)).cast("bigint").alias("tie_break_slots")))


def top_by(df: DataFrame, column: str, k: int, largest: bool = True) -> DataFrame:
    order = F.desc(column) if largest else F.asc(column)
    return top_k(df.where(F.col(column).isNotNull()), [YEAR], [order, F.col("ticker")], k)


def limit_to(basket: DataFrame, sizes: DataFrame, rank: str = "rank") -> DataFrame:
    """Keeps ranks up to the year's effective basket size ``k_eff``."""
    return basket.join(F.broadcast(sizes), YEAR).where(F.col(rank) <= F.col("k_eff")).drop("k_eff")


def threshold_basket(scored: DataFrame, at_least: int = 8) -> DataFrame:
    return scored.where(F.col("fscore") >= at_least)


def quintile(rank: Column, n: Column, buckets: int = 5) -> Column:
    """0-based equal-frequency bucket of a 1-based rank among n."""
    edge = F.ceil(F.lit(float(buckets)) * (rank - 1) / F.nullif(n - 1, F.lit(0)))
    return (F.greatest(F.lit(1), F.coalesce(edge, F.lit(1))) - 1).cast("int")


def liquidity_matched(value_set: DataFrame, target: DataFrame, k: int, seed: int = 42,
                      column: str = "adv") -> DataFrame:
    """Names outside the target whose traded value is distributed like the target's.

    Buckets of the value set; each bucket offers as many non-target names as the target
    holds there, then any other non-target names, then target names, up to k. The value
    set is cut from a top-n universe, so windows per year are bounded by n.
    """
    y = W.partitionBy(YEAR)
    ranked = (value_set.select(YEAR, "ticker", column)
              .withColumn("_r", F.row_number().over(y.orderBy(column, "ticker")))
              .withColumn("_n", F.count("*").over(y))
              .withColumn("bucket", quintile(F.col("_r"), F.col("_n")))
              .join(target.select(YEAR, "ticker", F.col("rank").alias("_t")), [YEAR, "ticker"], "left"))
    in_target = F.col("_t").isNotNull()
    key = shuffle_key(seed, "liquidity", F.col(YEAR), F.col("ticker"))
    b = W.partitionBy(YEAR, "bucket")
    staged = (ranked.withColumn("_key", key)
              .withColumn("_want", F.count_if(in_target).over(b))
              .withColumn("_place", F.row_number().over(
                  W.partitionBy(YEAR, "bucket", in_target).orderBy("_key", "ticker")))
              .withColumn("stage", F.when(in_target, 3)
                          .when(F.col("_place") <= F.col("_want"), 1).otherwise(2)))
    order = [F.col("stage"), F.coalesce(F.col("_t"), F.lit(0)), F.col("_key"), F.col("ticker")]
    return top_k(staged, [YEAR], order, k).select(YEAR, "ticker", "bucket", "stage", "rank")


def _pick(seed: Column | int, label: str, j: Column) -> Column:
    """Uniform integer in 1..j from the hash of (seed, label, year, draw, j)."""
    h = shuffle_key(seed, label, F.col(YEAR), F.col("draw"), j)
    return F.pmod(F.conv(F.substring(h, 1, 15), 16, 10).cast("bigint"), j) + 1


def sample_positions(sizes: DataFrame, k: int, n_draws: int, seed: int = 42,
                     label: str = "all") -> DataFrame:
    """(formation_year, draw, index): k distinct positions out of ``size`` per draw.

    Floyd's sampling: k hash evaluations give a uniform k-subset of 1..size, however large
    the universe is. Rows are draws times k; the universe is never paired with the draws.
    """
    count = F.least(F.lit(k).cast("bigint"), F.col("size"))
    if "k_eff" in sizes.columns:
        count = F.least(count, F.col("k_eff").cast("bigint"))
    draws = (sizes.withColumn("_k", count).where("_k > 0")
             .withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n_draws - 1))))
             .repartition(YEAR, "draw"))
    steps = F.sequence(F.col("size") - F.col("_k") + 1, F.col("size"))

    def step(chosen, j):
        t = _pick(seed, label, j)
        return F.array_append(chosen, F.when(F.array_contains(chosen, t), j).otherwise(t))

    empty = F.array().cast("array<bigint>")
    return draws.select(YEAR, "draw", F.explode(F.aggregate(steps, empty, step)).alias("index"))


def random_baskets(pool: DataFrame, k: int, n_draws: int, seed: int = 42, label: str = "all",
                   sizes: DataFrame | None = None) -> DataFrame:
    """(formation_year, draw, ticker): fresh uniform baskets from each year's pool.

    ``sizes`` may carry a smaller ``k_eff`` per year. Draw d does not depend on n_draws,
    so a smaller experiment is a prefix of a larger one.
    """
    numbered = hashed_index(pool.select(YEAR, "ticker"), [YEAR], "ticker")
    per_year = pool.groupBy(YEAR).agg(F.count("*").alias("size"))
    if sizes is not None:
        per_year = per_year.join(sizes, YEAR)
    picks = sample_positions(per_year, k, n_draws, seed, label)
    return picks.join(numbered.drop("size"), [YEAR, "index"]).select(YEAR, "draw", "ticker")


def overlap(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """Names two books share, per ``by``."""
    return a.join(b.select(*[c for c in by if c in b.columns], "ticker"),
                  [*[c for c in by if c in b.columns], "ticker"]).groupBy(*by).agg(
        F.count("*").alias("shared"))


def limited(books: DataFrame, n: int | None) -> DataFrame:
    """The first ``n`` random books, or all of them."""
    return books if n is None else books.where(F.col("book") < n)
