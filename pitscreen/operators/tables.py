"""Merging and deduplicating result tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from pitscreen.functions.symbols import member_symbol


def keep_one(df: DataFrame, key: list[str], order: list[Column], first: bool = True) -> DataFrame:
    """One row per key, the first or last in an explicit order.

    ``min_by`` / ``max_by`` combine before the shuffle, so a key with many copies never
    gathers in one task.
    """
    rest = F.struct(*[c for c in df.columns if c not in key])
    by = F.struct(*order)
    pick = (F.min_by if first else F.max_by)(rest, by).alias("_r")
    return df.groupBy(*key).agg(pick).select(*key, "_r.*").select(*df.columns)


def stack(frames: list[DataFrame]) -> DataFrame:
    """All rows of all frames; a column one of them lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def upsert(previous: DataFrame, fresh: DataFrame, part: str) -> tuple[DataFrame, DataFrame]:
    """Replaces the parts (markets) present in ``fresh``; returns the table and the kept parts."""
    parts = fresh.select(part).distinct()
    kept = previous.join(parts, part, "left_anti")
    return stack([kept, fresh]), kept.select(part).distinct()


def upsert_rows(previous: DataFrame, fresh: DataFrame, key: list[str]) -> DataFrame:
    """Fresh rows win on their key; other rows and extra columns are carried through."""
    return stack([previous.join(fresh.select(*key), key, "left_anti"), fresh])


def merge_first(sources: list[DataFrame], key: str, value: str) -> DataFrame:
    """First non-missing value per key in source order."""
    ranked = stack([s.select(key, value, F.lit(i).alias("_s")) for i, s in enumerate(sources)])
    return keep_one(ranked.where(F.col(value).isNotNull()), [key], [F.col("_s"), F.col(value)]).drop("_s")


def deepen(prices: DataFrame, extra: DataFrame, need_by: str) -> DataFrame:
    """Adds history for tickers that start too late; an existing bar wins."""
    late = prices.groupBy("ticker").agg(F.min("date").alias("f")).where(F.col("f") > F.lit(need_by).cast("date"))
    known = prices.select("ticker").distinct()
    wanted = extra.join(late.select("ticker"), "ticker", "left_semi").unionByName(
        extra.join(known, "ticker", "left_anti"))
    return upsert_rows(wanted, prices, ["ticker", "date"])


def members_at(history: DataFrame, first_year: int, last_year: int) -> DataFrame:
    """(date, ticker) at each 1 July from snapshots (date, comma list).

    A snapshot may be split over several rows; the latest date on or before formation counts.
    """
    lists = F.array(*[F.make_date(F.lit(y), F.lit(7), F.lit(1)) for y in range(first_year, last_year + 1)])
    dates = history.select(F.col("date").alias("snap")).distinct()  # one row per snapshot
    asof = (dates.select("snap", F.explode(lists).alias("formation"))
            .where(F.col("snap") <= F.col("formation"))
            .groupBy("formation").agg(F.max("snap").alias("snap")))
    raw = F.explode(F.split("tickers", ","))
    return (history.withColumnRenamed("date", "snap").join(F.broadcast(asof), "snap")
            .select(F.col("formation").alias("date"), raw.alias("raw"))
            .where(F.trim("raw") != "").select("date", member_symbol(F.col("raw")).alias("ticker")))


def price_coverage(membership: DataFrame, prices: DataFrame, months: int = 36) -> DataFrame:
    """Per formation: constituents, priced at all, priced in the months before."""
    from pitscreen.functions.dates import formations_covering

    year = F.year("date").alias("formation_year")
    m = membership.select(year, "ticker").distinct()
    ever = prices.select("ticker", F.lit(1).alias("ever")).distinct()
    deep = (prices.select("ticker", F.explode(formations_covering(F.col("date"), months)).alias("formation_year"))
            .distinct().withColumn("deep", F.lit(1)))
    return (m.join(ever, "ticker", "left").join(deep, ["formation_year", "ticker"], "left")
            .groupBy("formation_year").agg(
                F.count("*").alias("constituents"), F.count("ever").alias("priced_at_all"),
                F.count("deep").alias("priced_before"),
                F.round(100 * F.count("ever") / F.count("*"), 1).alias("pct_priced")))


def has_price(universe: DataFrame, prices: DataFrame) -> DataFrame:
    return (universe.select("ticker").distinct()
            .join(prices.select("ticker", F.lit(True).alias("has_price")).distinct(), "ticker", "left")
            .na.fill(False, ["has_price"]))


def align_ledgers(ledgers: list[DataFrame], counts: list[str]) -> DataFrame:
    """Markets record different reasons: absent counts are zero."""
    out = stack(ledgers)
    for c in counts:
        if c not in out.columns:
            out = out.withColumn(c, F.lit(0))
    return out.na.fill(0)


def ledger_totals(ledger: DataFrame, by: list[str]) -> DataFrame:
    """Column totals and the share scored of what reached the screen."""
    counts = [c for c, t in ledger.dtypes if t in ("int", "bigint") and c not in (*by, "score_year")]
    t = ledger.groupBy(*by).agg(*[F.sum(c).alias(c) for c in counts])
    held = sum((F.col(c) for c in counts if c.startswith("dropped_")), F.col("scored"))
    return (t.withColumn("held", held)
            .withColumn("pct_scored", F.round(F.try_divide(100 * F.col("scored"), F.col("held")), 2)))
