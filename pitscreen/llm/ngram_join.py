"""N-gram Jaccard self-join by vertical partitioning.

Texts of equal shingle sets are one class and are joined once. The shingle hashes are cut into
contiguous ranges of one global order, the fragments; every set leaves a segment in each. Fragments
are counted on their own: a shingle that no other class has can be in no intersection, and is
dropped there. What is left, a fraction, keeps its number of classes, which orders shingles from
rare to common for prefix filtering: two sets at the threshold share one of their rarest. A pair
that meets in a prefix is judged by its partial overlaps, fragment by fragment, summed per pair.

Groups of thousands of near copies are not expanded into all pairs. First each class is tried
against a few leaders of its buckets, which joins most groups into components. Then all pairs
across components that meet in a prefix are tried, where the members of a bucket's largest
component only meet members of others. Pairs inside a component need no test, as they cannot
change what is connected. So every link between different components is found, by full test.
``link_counts`` and ``class_links`` do not take this way: they test all pairs that meet in a prefix.

Cases: texts are lower-cased in A-Z; a text of fewer than ``n`` words is one shingle, its words in
order; texts without words (and nulls) have empty sets and link with nothing; repeated rows are
in one class; null keys link like others; an empty table gives no rows; only key and text
are read. A very long text is one block: memory for its bytes, words and shingles. Shingles and classes are told apart by 64-bit hashes, a segment keeps 48 bits of each
hash within its fragment.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitscreen.llm import grams
from pitscreen.llm.components import components, stars
from pitscreen.llm.frames import col, free_name, map_text, matched, settle

#: Shingles in a fragment: what one task sorts at a time, 16 bytes each.
FRAGMENT = 3_000_000
#: The least number of fragments, so that segments are small on small inputs too.
FRAGMENTS = 64
#: Coarse fragments in which partial overlaps are counted.
PARTS = 8
LEADERS = 3
#: Classes of a bucket that meet in one task where all links are listed.
HOT = 1000


def signatures(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5) -> DataFrame:
    """(key, n, d1, d2): size and order-free digests of each text's shingle set."""

    def measure(texts: pa.Array) -> dict[str, np.ndarray]:
        out = {"n": [], "d1": [], "d2": []}
        for b in grams.blocks(texts):
            h, text_of, _ = grams.shingle_sets(b, n)
            size = np.bincount(text_of, minlength=b.count)
            full = np.flatnonzero(size)
            first = (np.cumsum(size) - size)[full]
            for name, salt in (("d1", 0x51), ("d2", 0xA7)):
                d = np.zeros(b.count, dtype=np.uint64)
                if len(full):
                    d[full] = grams.mix(np.add.reduceat(grams.mix(h + np.uint64(salt)), first))
                out[name].append(d.view(np.int64))
            out["n"].append(size)
        return {k: np.concatenate(v) if v else np.empty(0, np.int64) for k, v in out.items()}

    found = map_text(docs, text, measure, [(c, T.LongType()) for c in ("n", "d1", "d2")], [key], "m")
    return found.select(col(key).alias("key"), "m.*")


def segments(docs: DataFrame, fragments: int, text: str = "text", n: int = 5) -> DataFrame:
    """Packed segments: (frag, nodes, runs, low, high), a row for each fragment of some MB of texts."""
    schema = T.StructType([T.StructField("frag", T.IntegerType())] + [
        T.StructField(c, T.BinaryType()) for c in ("nodes", "runs", "low", "high")])
    width = (1 << 64) // fragments + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in grams.blocks(batch.column(0), 8 << 20):
                parts, texts, nodes = [], [], []
                for small in grams.blocks(pa.LargeStringArray.from_buffers(
                        b.count, pa.py_buffer(np.ascontiguousarray(b.offsets)), pa.py_buffer(b.data)), grams.BLOCK):
                    h, t, _ = grams.shingle_sets(small, n)
                    size = np.bincount(t, minlength=small.count)
                    d = np.zeros(small.count, dtype=np.uint64)
                    full = np.flatnonzero(size)
                    if len(full):
                        d[full] = grams.mix(np.add.reduceat(grams.mix(h + np.uint64(0x51)),
                                                            (np.cumsum(size) - size)[full]))
                    parts.append(h)
                    texts.append(t + small.first)
                    nodes.append(d)
                h, t, d = np.concatenate(parts), np.concatenate(texts), np.concatenate(nodes)
                _, once = np.unique(d, return_index=True)  # copies within the block count once
                real = np.zeros(len(d), dtype=bool)
                real[once] = True
                keep = real[t]
                h, t = h[keep], t[keep]
                if not len(h):
                    continue
                frag = (h // np.uint64(width)).astype(np.int32)
                order = np.argsort(frag, kind="stable")
                h, t, frag = h[order], t[order], frag[order]
                offset = h - frag.astype(np.uint64) * np.uint64(width)
                shift = max(0, (width - 1).bit_length() - 48)
                offset >>= np.uint64(shift)
                at = np.flatnonzero(np.concatenate([[True], frag[1:] != frag[:-1]]))
                cols: list[list] = [[], [], [], [], []]
                for lo, hi in zip(at, [*at[1:], len(h)], strict=True):
                    new = np.flatnonzero(np.concatenate([[True], t[lo + 1:hi] != t[lo:hi - 1]]))
                    cols[0].append(int(frag[lo]))
                    cols[1].append(d[t[lo:hi][new]].tobytes())
                    cols[2].append(np.diff(np.append(new, hi - lo)).astype("<u4").tobytes())
                    cols[3].append((offset[lo:hi] & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes())
                    cols[4].append((offset[lo:hi] >> np.uint64(32)).astype("<u2").tobytes())
                    if len(cols[0]) == 16:
                        yield _packed(cols)
                        cols = [[], [], [], [], []]
                if cols[0]:
                    yield _packed(cols)

    return docs.select(col(text).cast("string").alias("x")).mapInArrow(run, schema)


def _packed(cols: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32())] + [pa.array(c, pa.binary()) for c in cols[1:]],
                                      ["frag", "nodes", "runs", "low", "high"])


SHARED = T.StructType([T.StructField("node", T.LongType()), T.StructField("part", T.IntegerType()),
                       T.StructField("grams", T.ArrayType(T.LongType())),
                       T.StructField("df", T.ArrayType(T.IntegerType()))])


def shared_segments(packed: DataFrame, fragments: int) -> DataFrame:
    """(node, part, grams, df): of each class and fragment, the shingles that other classes have too."""

    def count(table: pa.Table) -> pa.Table:
        frag = table["frag"][0].as_py()

        def joined(name: str, kind: str) -> np.ndarray:
            return np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in table[name]])

        node, run = joined("nodes", "<u8"), joined("runs", "<u4").astype(np.int64)
        _, once = np.unique(node, return_index=True)
        real = np.zeros(len(node), dtype=bool)
        real[once] = True
        keep = np.repeat(real, run)
        h = (joined("low", "<u4")[keep].astype(np.int64) | joined("high", "<u2")[keep].astype(np.int64) << 32)
        node, run = node[real], run[real]
        order = np.argsort(h)
        s = h[order]
        new = np.concatenate([[True], s[1:] != s[:-1]]) if len(s) else np.empty(0, bool)
        at = np.flatnonzero(new)
        df = np.empty(len(h), dtype=np.int32)
        df[order] = np.repeat(np.diff(np.append(at, len(s))), np.diff(np.append(at, len(s))))
        owner = np.repeat(np.arange(len(node)), run)
        many = df > 1
        size = np.bincount(owner[many], minlength=len(node))
        some = size > 0
        offsets = pa.array(np.concatenate([[0], np.cumsum(size[some])]), pa.int32())
        # a gram's name holds its fragment, so names differ between fragments
        name = h[many] ^ (np.int64(frag) << np.int64(48))
        return pa.table({"node": node[some].view(np.int64), "part": pa.array(
            np.full(int(some.sum()), frag * PARTS // fragments), pa.int32()),
            "grams": pa.ListArray.from_arrays(offsets, pa.array(name)),
            "df": pa.ListArray.from_arrays(offsets, pa.array(df[many]))},
            schema=pa.schema([("node", pa.int64()), ("part", pa.int32()), ("grams", pa.list_(pa.int64())),
                              ("df", pa.list_(pa.int32()))]))

    return packed.groupBy("frag").applyInArrow(count, SHARED)


def least_overlap(size: Column, percent: int) -> Column:
    """The least intersection that a set of this size needs with any partner."""
    return F.ceil(size * percent / 100 - 1e-9).cast("long")


PREFIX = T.StructType([T.StructField(c, T.LongType()) for c in ("node", "n", "shared")] + [
    T.StructField("common", T.DoubleType()),
    T.StructField("bits", T.StructType([T.StructField(f"b{i}", T.LongType()) for i in range(4)])),
    T.StructField("h", T.LongType())])


def prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """A row for each prefix shingle ``h`` of each set: its rarest, after those that no other class has.

    ``common`` is the mean number of classes of the set's shingles; ``bits`` is a bitmap of 256 bits
    in which every shared shingle flips one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            node, n, shared = (np.asarray(batch.column(i)).astype(np.int64) for i in range(3))
            df, g = (np.asarray(batch.column(i).flatten()) for i in (3, 4))
            owner = np.repeat(np.arange(len(node)), shared)
            order = np.lexsort((g, df, owner))
            first = np.cumsum(shared) - shared
            rank = np.arange(len(g)) - first[owner]
            need = -(-n * percent // 100)
            head = order[rank < (shared - need + 1)[owner]]
            to = owner[head]
            common = np.bincount(owner, weights=df, minlength=len(node)) / n
            odd = np.bincount(owner * 256 + (g & 255), minlength=len(node) * 256) & 1
            bits = np.packbits(odd.astype(np.uint8).reshape(-1, 256), axis=1, bitorder="little").view("<i8")
            fields = [pa.array(bits[to, i]) for i in range(4)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(node[to]), pa.array(n[to]), pa.array(shared[to]), pa.array(common[to]),
                 pa.StructArray.from_arrays(fields, [f"b{i}" for i in range(4)]), pa.array(g[head])],
                PREFIX.fieldNames())

    return sets.select("node", "n", "shared", "df", "grams").mapInArrow(run, PREFIX)


def differing(x: str, y: str) -> Column:
    """The number of bits in which two bitmaps differ, at most the number of shingles only one set has."""
    return sum((F.bit_count(F.col(f"{x}.b{i}").bitwiseXOR(F.col(f"{y}.b{i}"))) for i in range(1, 4)),
               F.bit_count(F.col(f"{x}.b0").bitwiseXOR(F.col(f"{y}.b0"))))


def verified(pairs: DataFrame, segs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, na, b, nb) whose partial overlaps sum to the threshold."""
    a = segs.select(F.col("node").alias("a"), "part", F.col("grams").alias("ga"))
    b = segs.select(F.col("node").alias("b"), "part", F.col("grams").alias("gb"))
    partial = (pairs.join(a, "a").join(b, ["b", "part"])
               .select("a", "na", "b", "nb", F.size(F.array_intersect("ga", "gb")).alias("o")))
    summed = partial.groupBy("a", "na", "b", "nb").agg(F.sum("o").alias("o"))
    return summed.where(100 * F.col("o") >= percent * (F.col("na") + F.col("nb") - F.col("o"))).select("a", "b")


def alike(x: str, y: str, percent: int) -> Column:
    """Whether two sets can be similar enough.

    All they can share is what others have too, and each bit in which their bitmaps differ is a
    shingle that one of them lacks.
    """
    both = F.col(f"{x}shared") + F.col(f"{y}shared")
    most = F.least(F.col(f"{x}shared"), F.col(f"{y}shared"), (both - differing(f"{x}bits", f"{y}bits")) / 2)
    return 100 * most >= percent * (F.col(f"{x}n") + F.col(f"{y}n") - most)


def indexed(docs: DataFrame, classes: DataFrame, shingles: int, text: str, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Segments and prefixes of the classes that can have a link."""
    fragments = max(FRAGMENTS, PARTS * -(-shingles // (PARTS * FRAGMENT)))
    shared = settle(shared_segments(segments(docs, fragments, text, n), fragments), "shared-segments")
    able = (shared.groupBy("node").agg(F.sum(F.size("grams")).alias("shared")).join(classes.select("node", "n"), "node")
            .where(F.col("shared") >= least_overlap(F.col("n"), percent)))
    segs = settle(shared.join(able, "node").groupBy("node", "n", "shared", "part").agg(
        F.flatten(F.collect_list("grams")).alias("grams"), F.flatten(F.collect_list("df")).alias("df")), "segments")

    whole = segs.groupBy("node", "n", "shared").agg(
        F.flatten(F.collect_list("df")).alias("df"), F.flatten(F.collect_list("grams")).alias("grams"))
    return segs, settle(prefixes(whole, percent), "prefixes")


def class_links(docs: DataFrame, classes: DataFrame, shingles: int, text: str, n: int, percent: int) -> DataFrame:
    """Every pair (a, b) of classes at the threshold, each once; none is left out, inside components or not.

    All classes of a bucket meet. A bucket of more than ``HOT`` classes is dealt to several tasks: a class
    is in one of its shares as the first of a pair and in all of them as the second.
    """
    segs, prefix = indexed(docs, classes, shingles, text, n, percent)
    sizes = prefix.groupBy("h").agg(F.count("*").alias("c")).where("c > 1")
    dealt = prefix.join(sizes, "h").withColumn("shares", F.ceil(F.col("c") / HOT).cast("long"))
    names = ("node", "n", "shared", "bits")
    left = dealt.select("h", F.pmod(F.xxhash64("node"), "shares").alias("share"), *[F.col(c).alias("x" + c) for c in names])
    right = dealt.select("h", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("share"),
                         *[F.col(c).alias("y" + c) for c in names])
    met = left.join(right, ["h", "share"]).where((F.col("xnode") < F.col("ynode")) & alike("x", "y", percent))
    tried = met.select(F.col("xnode").alias("a"), F.col("xn").alias("na"), F.col("ynode").alias("b"),
                       F.col("yn").alias("nb")).distinct()
    return settle(verified(settle(tried, "class-pairs"), segs, percent), "class-links")


def links(docs: DataFrame, classes: DataFrame, shingles: int, text: str, n: int, percent: int) -> DataFrame:
    """Edges (a, b) between classes that connect what all links connect."""
    segs, prefix = indexed(docs, classes, shingles, text, n, percent)

    # the leader of a bucket with the most common shingles is the likeliest original of its copies
    me = F.struct("node", "n", "shared", "bits")
    lead = prefix.groupBy("h").agg(F.max_by(me, F.struct("common", "node")).alias("l0"), *[
        F.min_by(me, F.xxhash64(F.lit(i), "h", "node")).alias(f"l{i}") for i in range(1, LEADERS)],
        F.count("*").alias("c")).where("c > 1")
    met = (prefix.join(lead, "h").select(me.alias("x"), F.explode(F.array_distinct(
        F.array(*[f"l{i}" for i in range(LEADERS)]))).alias("l")).where("x.node <> l.node"))
    tried = (met.groupBy("x", "l").agg(F.count("*").alias("votes")).where(alike("x.", "l.", percent))
             .groupBy("x").agg(F.slice(F.sort_array(F.collect_list(F.struct("votes", "l")), asc=False), 1, LEADERS).alias("l"))
             .select("x", F.explode("l.l").alias("l")))
    first = F.when(F.col("x.node") < F.col("l.node"), F.struct("x", "l")).otherwise(F.struct(F.col("l").alias("x"), F.col("x").alias("l")))
    tried = settle(tried.select(first.alias("p")).select(
        F.col("p.x.node").alias("a"), F.col("p.x.n").alias("na"), F.col("p.l.node").alias("b"),
        F.col("p.l.n").alias("nb")).distinct(), "leader-pairs")
    found = settle(verified(tried, segs, percent), "leader-links")

    # a few rounds merge most of each group; what they leave apart only costs tests below
    joined = stars(found, rounds=2)
    comp = joined.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("comp"))
    placed = settle(prefix.join(comp, "node", "left").select(
        "h", "node", "n", "shared", "bits", F.coalesce("comp", "node").alias("comp")), "placed")
    mixed = (placed.groupBy("h", "comp").agg(F.count("*").alias("c")).groupBy("h")
             .agg(F.max(F.struct("c", "comp")).alias("top"), F.count("*").alias("comps")).where("comps > 1")
             .select("h", F.col("top.comp").alias("top")))
    open_ = placed.join(mixed, "h")
    left = open_.select("h", "top", *[F.col(c).alias("x" + c) for c in ("node", "n", "shared", "bits", "comp")])
    right = open_.select("h", *[F.col(c).alias("y" + c) for c in ("node", "n", "shared", "bits", "comp")])
    # those outside the bucket's largest component meet all others; two such meet once
    across = (left.where("xcomp <> top").join(right, "h")
              .where((F.col("xcomp") != F.col("ycomp")) & alike("x", "y", percent)
                     & ((F.col("ycomp") == F.col("top")) | (F.col("xnode") < F.col("ynode")))))
    swap = F.col("xnode") < F.col("ynode")
    rest = (across.select(F.when(swap, F.col("xnode")).otherwise(F.col("ynode")).alias("a"),
                          F.when(swap, F.col("xn")).otherwise(F.col("yn")).alias("na"),
                          F.when(swap, F.col("ynode")).otherwise(F.col("xnode")).alias("b"),
                          F.when(swap, F.col("yn")).otherwise(F.col("xn")).alias("nb"))
            .distinct().join(tried.select("a", "b"), ["a", "b"], "left_anti"))
    more = settle(verified(rest, segs, percent), "cross-links")
    return joined.union(more)


def classed(docs: DataFrame, key: str, text: str, n: int) -> tuple[DataFrame, DataFrame, int]:
    """Signatures of all rows, their classes, and the shingles of all rows: copies in other blocks come along."""
    seen = Observation()
    sig = settle(signatures(docs, key, text, n).observe(seen, F.sum("n").alias("n")), "signatures")
    classes = settle(sig.where("n > 0").groupBy("d1", "d2", "n").agg(
        F.min("key").alias("least"), F.count("*").alias("copies")).withColumnRenamed("d1", "node"), "classes")
    return sig, classes, seen.get["n"] or 0


def link_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """(key, n_shingles, class_id, copies, n_links) of every row.

    ``class_id`` is the least key among the rows with the same shingle set; ``n_links`` counts all other
    rows at the threshold, those of the same set included. An empty set links with nothing.
    """
    sig, classes, shingles = classed(docs, key, text, n)
    pairs = class_links(docs, classes, shingles, text, n, percent)
    ends = pairs.select(F.col("a").alias("node"), F.col("b").alias("other")).union(pairs.select("b", "a"))
    many = classes.select(F.col("node").alias("other"), F.col("copies").alias("c"))
    linked = ends.join(many, "other").groupBy("node").agg(F.sum("c").alias("linked"))
    named = classes.join(linked, "node", "left").select(
        F.col("node").alias("d1"), "d2", "n", "least", "copies",
        (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = sig.join(named, ["d1", "d2", "n"], "left")
    return out.select(col("key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("least", "key").alias("class_id"),
                      F.coalesce("copies", F.lit(1)).alias("copies"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """(key, n_shingles, component, copies) of every row.

    ``component`` is the least key among all rows that links reach, and the row's own key for an
    empty set; ``copies`` counts the rows with the same shingle set.
    """
    sig, classes, shingles = classed(docs, key, text, n)
    comp = components(links(docs, classes, shingles, text, n, percent))
    placed = classes.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = placed.groupBy("comp").agg(F.min("least").alias("component"))
    named = placed.join(least, "comp").select(F.col("node").alias("d1"), "d2", "n", "component", "copies")
    out = sig.join(named, ["d1", "d2", "n"], "left")
    return out.select(col("key").alias(key), F.col("n").alias("n_shingles"),
                      F.coalesce("component", "key").alias("component"), F.coalesce("copies", F.lit(1)).alias("copies"))


def representatives(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group, that of the least key; rows with an empty set all stay.

    Rows are told apart by two hashes of key and text; of rows equal in both one stays. The rows that
    go are fewer than those that stay, so they are what the texts are matched with.
    """
    mark, one, two = free_name(docs, "row_key"), free_name(docs, "row_hash1"), free_name(docs, "row_hash2")
    hashed = docs.withColumns({name: F.xxhash64(F.lit(i), col(key).cast("string"), col(text))
                               for i, name in enumerate((one, two))})
    marked = hashed.withColumn(mark, F.struct(col(key).alias("key"), col(one).alias("one"), col(two).alias("two")))
    found = groups(marked.select(col(mark).alias("mark"), col(text).alias("text")), "mark", "text", n, percent)
    # rows that go and rows that lie there several times are found together; all others need no table
    goes = F.col("mark") != F.col("component")
    found = settle(found.where("n_shingles > 0").groupBy("mark", "component").agg(F.count("*").alias("c"))
                   .where(goes | (F.col("c") > 1)).select(F.col("mark.one").alias(one), F.col("mark.two").alias(two),
                                                          goes.alias("goes")), "near-copies")
    gone, twins = (found.where(x).select(one, two) for x in ("goes", "not goes"))
    kept = matched(hashed, gone, [one, two], "left_anti")
    if twins.limit(1).count():
        kept = matched(kept, twins, [one, two], "left_anti").unionByName(
            matched(kept, twins, [one, two], "left_semi").dropDuplicates([one, two]))
    return kept.select(*map(col, docs.columns))
