"""Connected components of an edge table, by alternating stars.

Each round is two aggregates and two joins over the edges; the number of rounds grows with the
logarithm of the component size. Nothing is collected but two numbers a round. Once no more than ``FEW``
edges are left, what is joined to them is broadcast, so a round shuffles for its aggregates alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from pitscreen.llm.frames import settle

#: Edges up to which the least neighbours (16 bytes for each of at most twice as many nodes) are broadcast.
FEW = 250_000


def _settled(edges: DataFrame) -> tuple[DataFrame, tuple[int, int]]:
    """The landed edges, and a number and a hash that tell whether they have changed."""
    seen = Observation()
    mark = F.xxhash64("a", "b").bitwiseAND(F.lit((1 << 40) - 1))
    out = settle(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(mark).alias("h")), "edges")
    return out, (seen.get["n"], seen.get["h"] or 0)


def stars(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """Edges (a, b), a > b, that connect what ``edges`` (a, b longs) connect.

    Without a limit of rounds every node but the least of its component has one edge, to that one.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    before, done = None, 0
    while rounds is None or done < rounds:
        few = before is not None and before[0] <= FEW
        # every neighbour that is larger than a node goes to the least neighbour
        both = now.select("a", "b").union(now.select(F.col("b"), F.col("a"))).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(F.broadcast(least) if few else least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b")
        # a node and its smaller neighbours go to the least of these
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(F.broadcast(least) if few else least, "a").select(F.greatest("b", "m").alias("a"), F.col("m").alias("b"))
                 .union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        now, after = _settled(small)
        done += 1
        if after == before or not after[0]:
            break
        before = after
    return now


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of ``edges``; comp is the least node of its component."""
    return labels(stars(edges))


def labels(edges: DataFrame) -> DataFrame:
    """(node, comp) of edges from ``stars``."""
    return edges.select(F.col("a").alias("node"), F.col("b").alias("comp")).union(
        edges.select("b", "b").distinct().toDF("node", "comp"))
