"""Mixing sources to target weights by Poisson replication.

A source of size ``size`` that should make up ``share`` of a corpus of ``budget`` times the
present size repeats each of its documents at a mean rate of share * budget * total / size. A
document's number of copies is the quantile, at a uniform number hashed from seed and key, of a
Poisson distribution with that mean. Nothing is random: reruns, retries and other engines agree,
and a change of one source's target moves no other source's uniform numbers. Copies are then
spread over the whole result by a hash of (seed, key, copy).

Cases: rows without a source are a source of their own; a null key hashes as ``null``; repeated
rows get equal counts; a source of size 0 (only empty texts) counts by documents, at rate
``budget``; a source that the targets do not name gets weight 0; an empty table gives no rows. Other
columns go along, whatever their names; the names asked for as ``copy`` and ``order`` must be free
(ValueError). Very long texts only weigh more: their length is all that is looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitscreen.llm.frames import col, free_name
from pitscreen.session import land

UNIFORM_BITS = 60


def hashed(*parts: Column) -> Column:
    """60 bits of the md5 of the parts, joined by colons, as a long."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def poisson_tables(rates: DataFrame) -> DataFrame:
    """(source, cdf): P(X <= k) for k = 0, 1, ... far into the upper tail, for each source with a positive rate.

    Running sums of logs, a row for each k, so that no rate underflows and the work is in proportion to the rate.
    """
    last = F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 30).cast("int")
    steps = rates.where("rate > 0").select("source", "rate", F.explode(F.sequence(F.lit(0), last)).alias("k"))
    so_far = W.partitionBy("source").orderBy("k")
    more = F.when(F.col("k") == 0, -F.col("rate")).otherwise(F.ln("rate") - F.ln(F.col("k").cast("double")))
    summed = steps.withColumn("logp", F.sum(more).over(so_far)).withColumn("cdf", F.sum(F.exp("logp")).over(so_far))
    return summed.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("k", "cdf")))["cdf"].alias("cdf"))


def rates(docs: DataFrame, targets: DataFrame | None = None, budget: float = 1.0, temperature: float = 0.5,
          source: str = "source", text: str = "text") -> DataFrame:
    """(source, size, share, rate): one row per source; sizes are code points.

    ``targets`` has (source, weight); without it weights are size ** temperature.
    """
    sizes = docs.groupBy(col(source).alias("source")).agg(
        F.sum(F.length(F.coalesce(col(text), F.lit(""))).cast("long")).alias("size"))
    if targets is None:
        weighted = sizes.withColumn("weight", F.pow(F.col("size").cast("double"), F.lit(temperature)))
    else:
        t = targets.groupBy("source").agg(F.sum("weight").cast("double").alias("weight"))
        weighted = (sizes.alias("s").join(t.alias("t"), F.expr("s.source <=> t.source"), "left")
                    .select("s.source", "s.size", F.coalesce("t.weight", F.lit(0.0)).alias("weight")))
    totals = weighted.agg(F.sum("size").alias("total"), F.sum("weight").alias("weights"))
    share = F.when(F.col("weights") > 0, F.col("weight") / F.col("weights")).otherwise(F.lit(0.0))
    rate = F.when(F.col("size") > 0, share * budget * F.col("total") / F.col("size")).otherwise(F.lit(float(budget)))
    # totals is one row, so this joins each source with that row
    return (weighted.withColumn("one", F.lit(1)).join(totals.withColumn("one", F.lit(1)), "one")
            .select("source", "size", share.alias("share"), rate.alias("rate")))


def mix(docs: DataFrame, targets: DataFrame | None = None, budget: float = 1.0, temperature: float = 0.5,
        seed: int = 17, key: str = "doc_id", source: str = "source", text: str = "text",
        copy: str | None = None, order: str | None = None) -> DataFrame:
    """Each row of ``docs`` as often as its count says, globally shuffled, with the columns of ``docs``.

    ``copy`` and ``order`` name further columns for the copy number (from 0) and the shuffle key.
    The rates are landed, one row per source; joining them is the optimizer's choice by their size.
    """
    asked = tuple(c for c in (copy, order) if c)
    if len({c.lower() for c in (*docs.columns, *asked)}) < len(docs.columns) + len(asked):
        raise ValueError(f"columns named {asked} exist already")
    s_name, cdf, n_name, c_name, o_name = (free_name(docs, f"mix_{x}", asked) for x in ("source", "cdf", "n", "copy", "order"))
    c_name, o_name = copy or c_name, order or o_name
    lookup = land(poisson_tables(rates(docs, targets, budget, temperature, source, text)), "source-rates")
    both = docs.join(lookup.toDF(s_name, cdf), col(source).eqNullSafe(F.col(s_name)), "left")
    uniform = hashed(F.lit(seed), col(key)).cast("double") / F.lit(float(1 << UNIFORM_BITS))
    n = F.when(F.col(cdf).isNull(), F.lit(0)).otherwise(F.size(F.filter(F.col(cdf), lambda c: c <= uniform)))
    copies = (both.withColumn(n_name, n).where(F.col(n_name) > 0)
              .withColumn(c_name, F.explode(F.sequence(F.lit(0), F.col(n_name) - 1)))
              .withColumn(o_name, hashed(F.lit(seed), col(key), col(c_name))))
    spread = copies.repartitionByRange(col(o_name)).sortWithinPartitions(col(o_name))
    return spread.select(*map(col, docs.columns), *map(col, asked))
