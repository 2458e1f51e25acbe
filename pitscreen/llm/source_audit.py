"""How far the sources of a language differ in their use of terms.

A term of a language is a row of (source, count) entries, one for each source that uses it, in the
order of the sources' names. The rows, with the number of terms that share a row, are inserted into
a frequent-pattern tree: rows that begin alike share a path, and a node counts the terms below it. For
two sources, the divergence summed over all terms is what it would be if neither used any term, plus
what each one's counts change against the other's zero (from the nodes' totals), plus a correction for terms
that both use, which every pair of a node and an ancestor adds once, times the node's count.

The tree is never whole in one place: rows are range-partitioned in path order, so a task holds a run of
neighbouring paths and builds its part from sorted batches. All sums are linear in the nodes' counts, so a path
that a cut divides gives the same totals. Counts, probabilities and divergences are whole numbers.

Work: a row has an entry a source, as the result has a row for each pair of sources of a language. Counts are summed
in each task before they are shuffled, by (lang, source, term), so no source or term is one key.

Cases: null text, lang and source count as ''; a repeated row is a document of its own; a group or
language without terms has pairs of value 0 and no term rows; an empty table gives an empty result; long texts are
read in blocks, and one text is in memory at a time; only the three columns are read, so others cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitscreen.llm import grams
from pitscreen.llm.frames import BROADCAST_ROWS, col, settle

#: (node, ancestor) combinations that are evaluated together.
CHUNK = 1 << 21

_TERM = np.zeros(256, bool)
_TERM[0x41:0x5B] = _TERM[0x61:0x7B] = _TERM[0x80:] = True


def _codes(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    coded = column.cast(pa.large_string()).fill_null("").dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def _counted(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of a batch of (text, lang, source); a null term stands for the group itself."""
    (lang, langs), (source, sources) = _codes(batch.column(1)), _codes(batch.column(2))
    group = lang * len(sources) + source
    names = ["lang", "source", "term", "n", "docs"]

    def rows(g: np.ndarray, terms: pa.Array, n: np.ndarray, docs: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [langs.take(pa.array(g // len(sources))).cast(pa.string()), sources.take(pa.array(g % len(sources))).cast(pa.string()),
             terms.cast(pa.string()), pa.array(n.astype(np.int64)), pa.array(docs.astype(np.int64))], names)

    g, n = np.unique(group, return_counts=True)
    yield rows(g, pa.nulls(len(g), pa.string()), n * 0, n)
    for block in grams.blocks(batch.column(0).cast(pa.large_string()), 8 << 20):
        inside = _TERM[block.data]
        start, end, text = block.spans(inside)
        ends = np.concatenate([[0], np.cumsum(end - start)])
        words = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(
            np.ascontiguousarray(grams.LOWER[block.data[inside]]))]).dictionary_encode()
        term, size = words.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(len(words.dictionary), 1)
        in_text, n = np.unique(text * size + term, return_counts=True)
        key = group[block.first + in_text // size] * size + in_text % size
        found, at = np.unique(key, return_inverse=True)
        if len(found):
            yield rows(found // size, words.dictionary.take(pa.array(found % size)).cast(pa.large_string(), safe=False),
                       np.bincount(at, weights=n), np.bincount(at))


def counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents that hold the term; a null term has all documents of the group."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _counted(batch)

    narrow = docs.select(*[col(c).cast("string").alias(f"c{i}") for i, c in enumerate((text, lang, source))])
    return (narrow.mapInArrow(run, "lang string, source string, term string, n long, docs long")
            .groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))


#: 1 + floor(10^9 (n + 2) / (total + 2 terms)); a language without terms has no probabilities.
_PROBABILITY = ("if(terms = 0, 0L, 1L + (1000000000BD * cast({n} + 2 AS DECIMAL(19,0)))"
                " div cast({total} + 2 * terms AS DECIMAL(20,0)))")
_DIVERGENCE = "coalesce(({p} - {q}) * ({p} - {q}) div nullif({p} + {q}, 0L), 0L)"


# Tree ----------------------------------------------------------------------------------------

def node_sums(rows: pa.RecordBatch) -> pa.RecordBatch:
    """What the tree of some sorted rows gives to each pair of sources and to each (source, p).

    Rows: lang, path (a list of source, p, p of no occurrence), n. Result: (lang, a, b, p, zero, v); with b, ``v``
    is the pair's correction, else the number of terms that source ``a`` gives the probability ``p``.
    """
    lang, path, n = rows.column(0), rows.column(1), rows.column(2).to_numpy()
    coded = lang.dictionary_encode()
    lang_of = coded.indices.to_numpy(zero_copy_only=False)
    item = path.flatten()
    names = item.field(0).dictionary_encode()
    source = names.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    p, zero = item.field(1).to_numpy(zero_copy_only=False), item.field(2).to_numpy(zero_copy_only=False)
    size = path.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    first = np.cumsum(size) - size
    row = np.repeat(np.arange(len(n)), size)
    depth = np.arange(len(row)) - np.repeat(first, size)

    shared = np.zeros(len(n), np.int64)  # leading entries that a row shares with the one before
    alike = np.flatnonzero(lang_of[1:] == lang_of[:-1]) + 1
    for d in range(int(size.max()) if len(size) else 0):
        alike = alike[(size[alike] > d) & (size[alike - 1] > d)]
        i, j = first[alike] + d, first[alike - 1] + d
        alike = alike[(source[i] == source[j]) & (p[i] == p[j])]
        if not len(alike):
            break
        shared[alike] = d + 1
    times = np.zeros(len(row), np.int64)
    for d in range(int(size.max()) if len(size) else 0):
        begin = np.flatnonzero(shared <= d)
        total = np.add.reduceat(n, begin)
        has = size[begin] > d
        times[first[begin[has]] + d] = total[has]
    node = np.flatnonzero(times)

    width = max(len(names.dictionary), 1)
    out = []
    key = np.stack([lang_of[row[node]], source[node], p[node], zero[node]])
    single, at = np.unique(key, axis=1, return_inverse=True)
    v = np.zeros(single.shape[1], np.int64)
    np.add.at(v, at.ravel(), times[node])
    out.append((single[0], single[1], np.full(len(v), -1), single[2], single[3], v))
    ends = np.cumsum(depth[node])
    lo = 0
    while lo < len(node):
        base = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + CHUNK, side="right")))
        part = node[lo:hi]
        below = np.repeat(part, depth[part])
        above = (np.arange(len(below)) - np.repeat(np.cumsum(depth[part]) - depth[part], depth[part])
                 + np.repeat(first[row[part]], depth[part]))

        def f(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            return (x - y) ** 2 // (x + y)

        change = times[below] * (f(p[above], p[below]) - f(p[above], zero[below]) - f(zero[above], p[below])
                                 + f(zero[above], zero[below]))
        pair, at = np.unique((lang_of[row[below]].astype(np.int64) * width + source[above]) * width + source[below],
                             return_inverse=True)
        v = np.zeros(len(pair), np.int64)
        np.add.at(v, at, change)
        nothing = np.zeros(len(pair), np.int64)
        out.append((pair // width // width, pair // width % width, pair % width, nothing, nothing, v))
        lo = hi
    which, a, b, p, zero, v = (np.concatenate(x) for x in zip(*out, strict=True))
    source_of = names.dictionary
    return pa.RecordBatch.from_arrays(
        [coded.dictionary.take(pa.array(which)), source_of.take(pa.array(a)),
         source_of.take(pa.array(np.where(b < 0, 0, b), mask=b < 0)), pa.array(p), pa.array(zero), pa.array(v)],
        ["lang", "a", "b", "p", "zero", "v"])


# Audit ---------------------------------------------------------------------------------------

def _beside(df: DataFrame, small: DataFrame, on: list[str]) -> DataFrame:
    """Inner join on a settled table, which is broadcast only after its rows are counted."""
    few = small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return df.join(F.broadcast(small) if few else small, on)


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = 10,
          top: int = 10, salts: int = 16) -> DataFrame:
    """(lang, source, part, item, value, rank).

    ``pair``: the divergence of every two sources of a language, all ranks; ``term``: the ``top`` terms
    that a source uses more often than its language, by divergence from it.
    """
    found = settle(counts(docs, text, lang, source), "term-counts")
    kept = settle(found.where("term IS NOT NULL").groupBy("lang", "term")
                  .agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"),
                       F.collect_list(F.struct("source", "n")).alias("uses"))
                  .where(F.col("docs") >= least_docs).select("lang", "term", "lang_n", "uses"), "kept-terms")
    uses = kept.select("lang", "term", "lang_n", F.explode("uses").alias("u")).select(
        "lang", "term", "lang_n", F.col("u.source").alias("source"), F.col("u.n").alias("n"))
    by_lang = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
    groups = settle(
        found.where("term IS NULL").select("lang", "source")
        .join(uses.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left")
        .join(by_lang, "lang", "left").fillna(0, ["total", "terms", "lang_total"])
        .withColumn("zero", F.expr(_PROBABILITY.format(n="0L", total="total"))), "audit-groups")
    items = (_beside(uses, groups, ["lang", "source"])
             .withColumn("p", F.expr(_PROBABILITY.format(n="n", total="total")))
             .withColumn("q", F.expr(_PROBABILITY.format(n="lang_n", total="lang_total"))))

    # terms
    each = W.partitionBy("lang", "source")
    terms = (items.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                                         F.expr(_DIVERGENCE.format(p="p", q="q")).alias("value"))
             .withColumn("rank", F.row_number().over(each.orderBy(F.desc("value"), "item"))).where(F.col("rank") <= top))

    # pairs
    paths = (items.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("source", "p", "zero"))).alias("path"))
             .groupBy("lang", "path").agg(F.count("*").alias("n")))
    ordered = paths.repartitionByRange("lang", "path").sortWithinPartitions("lang", "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield node_sums(batch)

    sums = settle(ordered.mapInArrow(run, "lang string, a string, b string, p long, zero long, v long")
                  .groupBy("lang", "a", "b", "p", "zero").agg(F.sum("v").alias("v")), "tree-sums")
    salt = F.pmod(F.xxhash64("a"), F.lit(salts))
    one = groups.select("lang", F.col("source").alias("a"), F.col("zero").alias("zero_a"), "terms").withColumn("salt", salt)
    other = groups.select("lang", F.col("source").alias("b"), F.col("zero").alias("zero_b"),
                          F.explode(F.expr(f"sequence(0L, {salts - 1}L)")).alias("salt"))
    pairs = settle(one.join(other, ["lang", "salt"]).where("a <> b").drop("salt"), "source-pairs")
    # what the counts of a source change against each other source's zero
    alone = (sums.where("b IS NULL").select("lang", "a", "p", "v").join(pairs, ["lang", "a"])
             .groupBy("lang", "a", "b").agg(F.sum(F.expr(
                 f"v * ({_DIVERGENCE.format(p='p', q='zero_b')} - {_DIVERGENCE.format(p='zero_a', q='zero_b')})")).alias("v")))
    both = sums.where("b IS NOT NULL").select("lang", "a", "b", "v")
    ground = pairs.where("a < b").select("lang", "a", "b", F.expr(
        f"terms * {_DIVERGENCE.format(p='zero_a', q='zero_b')}").alias("v"))
    half = (ground.unionByName(both)
            .unionByName(alone.select("lang", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "v"))
            .groupBy("lang", "a", "b").agg(F.sum("v").alias("value")))
    values = half.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")),
                                                   F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("x"),
                         "value").select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")
    ranked = values.withColumn("rank", F.row_number().over(each.orderBy(F.desc("value"), "item")))
    return ranked.unionByName(terms)

