"""Exact ranks and quantiles whose groups may hold most of the table.

A window over one formation year sorts that year in one task. These helpers split each
group by value first, so no task holds a whole group, and combine small per-slice counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

# percentile_approx guarantees a rank error of n / ACCURACY.
ACCURACY = 10_000
# The largest limit that Spark pushes below a window's shuffle, and the hash slices beyond it.
PUSHED, SLICES = 1000, 64


def beside(df: DataFrame, one: DataFrame) -> DataFrame:
    """``df`` with the columns of a global aggregate (exactly one row) on every row.

    The aggregate becomes a scalar subquery, so nothing is joined.
    """
    row = one.select(F.struct(*one.columns)).scalar()
    return df.withColumn("_one", row).select(*df.columns, "_one.*")


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per group with their rank.

    Up to ``PUSHED`` rows Spark pushes the limit below the shuffle, so each task forwards at most k
    rows a group. Beyond it each group is cut by hash first, and only the best k of each slice meet.
    ``order`` must be total.
    """
    if k > PUSHED:
        slice_ = F.pmod(F.xxhash64(*df.columns), F.lit(SLICES))
        w = W.partitionBy(*by, "_slice").orderBy(*order)
        df = (df.withColumn("_slice", slice_).withColumn(rank, F.row_number().over(w))
              .where(F.col(rank) <= k).drop("_slice", rank))
    return (df.withColumn(rank, F.row_number().over(W.partitionBy(*by).orderBy(*order)))
            .where(F.col(rank) <= k))


def hashed_index(df: DataFrame, by: list[str], key: str, index: str = "index",
                 size: str = "size") -> DataFrame:
    """Numbers the rows of each group 1..n in the order of md5(key).

    Rows are sliced by the first three hex digits of the hash; a slice's offset is the
    number of rows in the slices before it. ``key`` must be unique within a group.
    """
    sliced = df.withColumn("_h", F.md5(F.col(key))).withColumn("_slice", F.substring("_h", 1, 3))
    per_slice = sliced.groupBy(*by, "_slice").agg(F.count("*").alias("_n"))
    w = W.partitionBy(*by).orderBy("_slice")  # at most 4096 rows a group
    offsets = per_slice.select(
        *by, "_slice",
        (F.sum("_n").over(w) - F.col("_n")).alias("_before"),
        F.sum("_n").over(W.partitionBy(*by)).alias(size))
    local = F.row_number().over(W.partitionBy(*by, "_slice").orderBy("_h", key))
    return (sliced.withColumn("_local", local).join(offsets, [*by, "_slice"])
            .withColumn(index, F.col("_before") + F.col("_local"))
            .drop("_h", "_slice", "_local", "_before"))


def spread_rank(df: DataFrame, by: list[str], value: str, key: str, rank: str = "rank",
                size: str = "size", slices: int = 200, ascending: bool = True) -> DataFrame:
    """Full row_number per group by ``value``, ties by md5(key); missing values unranked.

    Groups are cut at approximate quantiles. A value that fills whole slices by itself is
    cut again by its hash prefix, so a value held by a third of all rows spreads as well.
    """
    v = F.col(value).cast("double") * (1 if ascending else -1)
    have = df.where(F.col(value).isNotNull()).withColumn("_v", v)
    cuts = have.groupBy(*by).agg(
        F.percentile_approx("_v", [i / slices for i in range(1, slices)], ACCURACY).alias("_cuts"))
    # one row per group; groups are formation years, so this is bounded by the calendar
    placed = have.join(F.broadcast(cuts), by)
    at_cut = F.filter("_cuts", lambda c: c == F.col("_v"))
    hot = F.size(at_cut) > 1
    placed = (placed.withColumn("_h", F.md5(F.col(key)))
              .withColumn("_slice", F.struct(
                  F.size(F.filter("_cuts", lambda c: c < F.col("_v"))).alias("bin"),
                  hot.alias("hot"),
                  F.when(hot, F.substring("_h", 1, 2)).otherwise("").alias("prefix")))
              .drop("_cuts"))
    per_slice = placed.groupBy(*by, "_slice").agg(F.count("*").alias("_n"))
    w = W.partitionBy(*by).orderBy("_slice")
    offsets = per_slice.select(
        *by, "_slice", (F.sum("_n").over(w) - F.col("_n")).alias("_before"),
        F.sum("_n").over(W.partitionBy(*by)).alias(size))
    local = F.row_number().over(W.partitionBy(*by, "_slice").orderBy("_v", "_h", key))
    return (placed.withColumn("_local", local).join(offsets, [*by, "_slice"])
            .withColumn(rank, F.col("_before") + F.col("_local"))
            .drop("_v", "_h", "_slice", "_local", "_before"))


def exact_quantiles(df: DataFrame, by: list[str], value: str, probs: dict[str, float],
                    accuracy: int = ACCURACY) -> DataFrame:
    """Linearly interpolated quantiles per group, one column per entry of ``probs``.

    Pass one brackets every quantile with an approximate sketch; pass two counts the rows
    below the bracket and keeps only the distinct values inside it. The result equals the
    exact ``percentile`` while no task sees more than a thin band of a group.
    """
    if not by:
        one = df.withColumn("_whole", F.lit(1))
        return exact_quantiles(one, ["_whole"], value, probs, accuracy).drop("_whole")
    have = df.select(*by, F.col(value).cast("double").alias("_v")).where("_v is not null")
    slack = 2.0 / accuracy
    names = list(probs)
    edges = [e for p in probs.values() for e in (max(0.0, p - slack), min(1.0, p + slack))]
    sketch = have.groupBy(*by).agg(
        F.count("*").alias("_n"), F.percentile_approx("_v", edges, accuracy).alias("_e"),
        F.min("_v").alias("_min"), F.max("_v").alias("_max"))
    # Beyond ``accuracy`` rows the slack exceeds the sketch's error by at least one rank; a
    # smaller group is its own band.
    small = F.col("_n") <= accuracy
    bands = F.array(*[
        F.struct(F.lit(name).alias("q"), F.lit(probs[name]).alias("p"),
                 F.when(small | F.lit(probs[name] <= slack), F.col("_min"))
                 .otherwise(F.col("_e")[2 * i]).alias("lo"),
                 F.when(small | F.lit(probs[name] >= 1 - slack), F.col("_max"))
                 .otherwise(F.col("_e")[2 * i + 1]).alias("hi"))
        for i, name in enumerate(names)])
    sketch = sketch.select(*by, "_n", bands.alias("_bands"))
    # one row per group; groups are years or formation dates, bounded by the calendar
    banded = have.join(F.broadcast(sketch), by)
    banded = banded.select(*by, "_v", "_n", F.explode("_bands").alias("_b"))
    inside = F.col("_v").between(F.col("_b.lo"), F.col("_b.hi"))
    distinct = (banded.where(F.col("_v") <= F.col("_b.hi"))
                .groupBy(*by, F.col("_b.q").alias("_q"), F.col("_b.p").alias("_p"), "_n",
                         F.when(inside, F.col("_v")).alias("_v"))
                .agg(F.count("*").alias("_c")))
    w = W.partitionBy(*by, "_q").orderBy(F.col("_v").asc_nulls_first())
    ranked = distinct.withColumn("_upto", F.sum("_c").over(w))
    pos = F.col("_p") * (F.col("_n") - 1)
    lower = F.min(F.when(F.col("_upto") >= F.floor(pos) + 1, F.col("_v")))
    upper = F.min(F.when(F.col("_upto") >= F.ceil(pos) + 1, F.col("_v")))
    frac = F.first(pos - F.floor(pos))
    solved = ranked.groupBy(*by, "_q").agg(lower.alias("_lo"), upper.alias("_hi"),
                                           frac.alias("_f"))
    out = solved.groupBy(*by).pivot("_q", names).agg(
        F.first(F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_f")))
    return out
