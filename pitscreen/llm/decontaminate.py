"""Benchmark items inside long documents: size-partitioned MinHash containment, verified exactly.

An item is *in* a document when at least ``threshold`` of its distinct word shingles are. Items
are partitioned by the power of two of their set size. An item's sketch holds its k smallest
shingle hashes, k = m - ceil(threshold * m) + 1 for a set of m: an item that misses fewer than k
shingles leaves at least one of these in the document, so no item is overlooked, however much
longer the document is. A document probes with those of its shingles whose hash is not above
the largest sketch value of the item partitions that it is big enough for. Documents that meet
a sketch value are read again and the containment of each candidate is counted exactly.

Everything is DataFrame operations. Cases: texts are lower-cased, words are split at space and
0x09-0x0D; an item of fewer than ``n`` words is one shingle of its own length; an item without
words is in nothing; null texts are empty; rows of one key and text count once; an empty table on
either side gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitscreen.llm.frames import SPACE, col, free_name, matched
from pitscreen.session import land


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), SPACE), "")


def shingles(w: str, n: int) -> Column:
    """Hashes of the ``n``-word windows of the word array column ``w``; none if it is shorter."""
    last = F.size(w) - n
    window = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
                         lambda i: F.xxhash64(*[F.get(F.col(w), i + k) for k in range(n)]))
    return F.when(last >= 0, window).otherwise(F.array().cast("array<bigint>"))


def item_sets(items: DataFrame, item: str, text: str, n: int) -> DataFrame:
    """(iid, item, q, grams, m): distinct shingles of each item, of q words (fewer than n in short items)."""
    named = items.select(col(item).alias("item"), col(text).cast("string").alias("text"))
    w = (named.select(F.xxhash64(F.col("item").cast("string"), "text").alias("iid"), "item",
                      words(F.col("text")).alias("w")).where(F.size("w") > 0).dropDuplicates(["iid"]))
    q = F.least(F.size("w"), F.lit(n))
    grams = F.coalesce(*[F.when(q == k, F.array_distinct(shingles("w", k))) for k in range(1, n + 1)])
    return w.select("iid", "item", q.alias("q"), grams.alias("grams")).withColumn("m", F.size("grams"))


def sketches(sets: DataFrame, threshold: float) -> DataFrame:
    """(iid, q, h, need, part): the k smallest hashes of each set, its least overlap and partition."""
    need = F.ceil(F.col("m") * F.lit(threshold) - F.lit(1e-9)).cast("int")
    kept = F.slice(F.array_sort("grams"), F.lit(1), F.col("m") - need + 1)
    return sets.select("iid", "q", need.alias("need"), F.floor(F.log2(need)).cast("int").alias("part"),
                       F.explode(kept).alias("h"))


def find(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
         item_text: str = "text", threshold: float = 0.8, n: int = 5) -> DataFrame:
    """(key, item, n_item_shingles, n_found, containment) of every pair that reaches the threshold.

    The benchmark is read into a landed table of sketches; whether that is broadcast is the
    optimizer's choice by its size on disk.
    """
    sets = land(item_sets(items, item, item_text, n), "item-sets")
    sketch = land(sketches(sets, threshold), "item-sketches")
    tops = sketch.groupBy("q", "part").agg(F.max("h").alias("top")).collect()  # at most n * 32 rows
    named = docs.select(col(key).alias("key"), col(text).cast("string").alias("text")).withColumn(
        "t", F.xxhash64("text"))
    split = named.select("t", words(F.col("text")).alias("w"))

    probes = None
    for q in sorted({r["q"] for r in tops}):
        bound: Column = F.lit(None).cast("long")
        so_far = -(1 << 63)
        steps = []
        for part, top in sorted((r["part"], r["top"]) for r in tops if r["q"] == q):
            so_far = max(so_far, top)
            steps.append((part, so_far))
        for part, top in steps:
            bound = F.when(F.size("w") - (q - 1) >= 2 ** part, F.lit(top)).otherwise(bound)
        each = (split.select("t", (F.size("w") - (q - 1)).alias("room"), bound.alias("bound"),
                             F.explode(shingles("w", q)).alias("h"))
                .where(F.col("h") <= F.col("bound")).select("t", "room", F.lit(q).alias("q"), "h"))
        probes = each if probes is None else probes.unionByName(each)
    if probes is None:
        probes = split.select("t", F.lit(0).alias("room"), F.lit(0).alias("q"),
                              F.lit(0).cast("long").alias("h")).where(F.lit(False))
    pairs = land(probes.join(sketch, ["q", "h"]).where(F.col("room") >= F.col("need"))
                 .select("t", "iid").distinct(), "candidates")

    texts = matched(named, pairs.select("t").distinct(), ["t"], "left_semi")
    both = texts.select("key", "t", words(F.col("text")).alias("w")).join(pairs, "t").join(sets, "iid")
    have = F.coalesce(*[F.when(F.col("q") == k, F.size(F.array_intersect("grams", shingles("w", k))))
                        for k in range(1, n + 1)])
    counted = both.select("key", "iid", "item", "m", have.alias("n_found")).groupBy("key", "iid", "item").agg(
        F.max(F.struct("n_found", "m")).alias("best"))
    found = counted.select(col("key").alias(key), col("item").alias(item), F.col("best.m").alias("n_item_shingles"),
                           F.col("best.n_found").alias("n_found"),
                           (F.col("best.n_found") / F.col("best.m")).alias("containment"))
    return found.where(F.col("containment") >= threshold - 1e-12)


def clean(docs: DataFrame, items: DataFrame, text: str = "text", item_text: str = "text",
          threshold: float = 0.8, n: int = 5) -> DataFrame:
    """``docs`` without the rows whose text contains an item; all its columns stay.

    Texts are matched by hash and length, so null and repeated keys need no care.
    """
    t = free_name(docs, "text_key")
    marked = docs.withColumn(t, F.concat_ws(":", F.xxhash64(col(text)), F.length(col(text))))
    ids = items.select(F.monotonically_increasing_id().alias("item_id"), col(item_text).alias("text"))
    hits = find(marked.select(col(t).alias("text_key"), col(text).alias("text")), land(ids, "items"),
                key="text_key", threshold=threshold, n=n)
    gone = land(hits.select(F.col("text_key").alias(t)).distinct(), "contaminated")
    return matched(marked, gone, [t], "left_anti").drop(t)
