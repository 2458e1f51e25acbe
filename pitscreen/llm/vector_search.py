"""Nearest rows by inner product: an adaptive scan over dimensions inside the lists a query probes.

Index. Directions are clustered on a bounded sample; every row belongs to the list of its nearest
centre, and a query probes the lists whose centres it agrees with most. How many it must probe is measured:
the true nearest of up to ``CALIBRATION`` queries (found against all rows, in blocks) have to lie in the
probed lists for a share of at least ``recall``. Vectors without any structure need most lists.

Scan. Vectors are rotated by a random orthogonal matrix and stored in blocks of ``WIDTH`` columns. After each
block the squared distance so far, scaled up to all dimensions, tests the hypothesis that the row is nearer
than the query's k-th best so far; if it is rejected (bound ``1 + EPSILON / sqrt(d)``) the row is abandoned for that query.
What is left is scored on the original vectors in double precision, dimension by dimension in order. The first k-th best comes
from the sample, whose rows are candidates like all others.

Distribution. Lists are packed into blocks of bounded size, large lists cut into several; a block meets its
queries in shares of bounded size, and a task holds one block and streams its queries. Of rows with equal vectors only
the k + 1 least ids can be among the k nearest of any query, so the others are dropped before and after the
shuffle, without changing a result: a very common vector is a few rows. Tables of up to ``WHOLE`` rows are one list.

Cases: vectors that are null, zero, or hold null or non-finite numbers take no part, nor do those whose length is not the
commonest one, nor null ids; repeated rows of an id and vector count once, and an id never finds itself; equal scores rank
by id; a query with fewer candidates than k returns those its lists and the sample hold; an empty table, or one
without queries, gives an empty result; only the two columns are read, so others cannot clash. There are no texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitscreen.llm.frames import col, settle

#: Tables up to this many rows are searched whole.
WHOLE = 4096
#: Sample of the index: rows for each list, and bytes in all.
PER_LIST, SAMPLE_BYTES = 64, 32 << 20
CALIBRATION = 256
WIDTH, EPSILON = 16, 2.1
#: Rows scanned together, queries scanned together, queries that meet a block in one task.
ROWS, QUERIES, SHARE = 4096, 512, 16_384
BLOCK_BYTES = 32 << 20
#: Products of queries and rows in one table.
TABLE = 1 << 22


def vectors(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the vectors that take part, and those vectors."""
    right = np.flatnonzero(column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == dim)
    flat = column.take(pa.array(right)).flatten()
    x = flat.to_numpy(zero_copy_only=False).reshape(-1, dim)  # nulls are read as not a number
    ok = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
    return right[ok], np.ascontiguousarray(x[ok])


def least_copies(ids: np.ndarray, x: np.ndarray, most: int) -> np.ndarray:
    """Rows that remain when of equal vectors only the ``most`` least distinct ids are kept."""
    raw = x.view(np.dtype((np.void, x.shape[1] * x.dtype.itemsize))).ravel()
    _, same = np.unique(raw, return_inverse=True)
    order = np.lexsort((ids, same))
    s, i = same[order], ids[order]
    first = np.ones(len(order), bool)
    first[1:] = (s[1:] != s[:-1]) | (i[1:] != i[:-1])
    order, s = order[first], s[first]
    begin = np.searchsorted(s, s)
    return np.sort(order[np.arange(len(s)) - begin < most])


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of the rows, in double precision, dimension by dimension."""
    total = np.zeros(len(q))
    for j in range(q.shape[1]):
        total += q[:, j].astype(np.float64) * x[:, j].astype(np.float64)
    return total


# Index ---------------------------------------------------------------------------------------

@dataclass
class Index:
    dim: int
    k: int
    centres: np.ndarray
    rotation: np.ndarray
    sample_ids: np.ndarray
    sample: np.ndarray
    probes: int = 1
    block_of: np.ndarray | None = None  # first block of each list
    blocks_of: np.ndarray | None = None  # number of blocks of each list
    shares: np.ndarray | None = None  # query shares of each block

    @property
    def lists(self) -> int:
        return len(self.centres)

    def list_of(self, x: np.ndarray) -> np.ndarray:
        return np.argmax(x.astype(np.float32) @ self.centres.T, axis=1) if self.lists > 1 else np.zeros(len(x), np.int64)

    def order(self, q: np.ndarray) -> np.ndarray:
        """Lists by agreement of their centres, best first; equal ones by number."""
        return np.argsort(-(q.astype(np.float32) @ self.centres.T), axis=1, kind="stable")

    def probed(self, q: np.ndarray) -> np.ndarray:
        if self.probes >= self.lists:
            return np.ones((len(q), self.lists), bool)
        marks = np.zeros((len(q), self.lists), bool)
        np.put_along_axis(marks, self.order(q)[:, :self.probes], True, axis=1)
        return marks


def _unit(x: np.ndarray) -> np.ndarray:
    return (x / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)).astype(np.float32)


def cluster(x: np.ndarray, lists: int, rounds: int = 12, seed: int = 11) -> np.ndarray:
    """Centres of directions by spherical k-means; empty clusters start anew at rows that fit worst."""
    x = _unit(np.unique(x, axis=0))
    rnd = np.random.default_rng(seed)
    lists = max(1, min(lists, len(x)))
    centres = x[np.sort(rnd.choice(len(x), lists, replace=False))] if len(x) else np.zeros((1, x.shape[1]), np.float32)
    for _ in range(rounds if lists > 1 else 0):
        fit = x @ centres.T
        near = fit.argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        empty = np.flatnonzero(np.bincount(near, minlength=lists) == 0)
        if len(empty):
            sums[empty] = x[np.argsort(fit.max(axis=1), kind="stable")[:len(empty)]]
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 0, sums / np.maximum(length, 1e-30), centres).astype(np.float32)
    return centres


def _narrow(df: DataFrame, key: str, vector: str) -> DataFrame:
    kind = df.schema[vector].dataType.elementType
    wide = T.ArrayType(kind if isinstance(kind, (T.FloatType, T.DoubleType)) else T.DoubleType())
    return (df.select(col(key).cast("long").alias("id"), col(vector).cast(wide).alias("v"))
            .where("id IS NOT NULL AND v IS NOT NULL"))


def _drawn(rows: DataFrame, share: float, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """About a share of the rows, by a hash, on the driver."""
    if share < 1:
        part = F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(1 << 30))
        rows = rows.where(part < int(share * (1 << 30)))
    found = rows.toArrow()
    v = found["v"].combine_chunks()
    at, x = vectors(v, dim)
    return found["id"].to_numpy()[at], x


def _closest(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, row) of the k best rows of each query, without its own id, by single-precision products."""
    step = max(1, TABLE // max(len(ids), 1))
    parts = [_closest_few(q_ids[lo:lo + step], q[lo:lo + step], ids, x, k) for lo in range(0, len(q), step)]
    return (np.concatenate([i + n * step for n, (i, _) in enumerate(parts)] or [np.empty(0, np.int64)]),
            np.concatenate([j for _, j in parts] or [np.empty(0, np.int64)]))


def _closest_few(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    s = q.astype(np.float32) @ x.astype(np.float32).T
    s[q_ids[:, None] == ids[None, :]] = -np.inf
    k = min(k, len(ids))
    best = np.argpartition(-s, k - 1, axis=1)[:, :k] if k else np.empty((len(q), 0), np.int64)
    at = np.repeat(np.arange(len(q)), k)
    flat = best.ravel()
    real = np.isfinite(s[at, flat])
    return at[real], flat[real]


def _calibrated(rows: DataFrame, index: Index, queries: tuple[np.ndarray, np.ndarray], recall: float) -> tuple[int, np.ndarray]:
    """Lists to probe, and rows of each list, from one pass over all rows."""
    q_ids, q = queries
    k = index.k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = np.zeros(index.lists, np.int64)
        held = [np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64), np.empty(0, np.int64)]
        for batch in batches:
            at, x = vectors(batch.column(1), index.dim)
            ids = batch.column(0).to_numpy()[at]
            keep = least_copies(ids, x, k + 1)
            ids, x = ids[keep], x[keep]
            where = index.list_of(x)
            sizes += np.bincount(where, minlength=index.lists)
            of, row = _closest(q_ids, q, ids, x, k)
            held = [np.concatenate(c) for c in zip(held, [of, exact(q[of], x[row]), where[row], ids[row]], strict=True)]
            order = np.lexsort((held[3], -held[1], held[0]))
            held = [h[order] for h in held]
            top = np.arange(len(order)) - np.searchsorted(held[0], held[0]) < k
            held = [h[top] for h in held]
        one = np.arange(index.lists)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([one * 0 - 1, held[0]])), pa.array(np.concatenate([one * 0.0, held[1]])),
             pa.array(np.concatenate([one, held[2]])), pa.array(np.concatenate([sizes, held[3]]))], ["q", "score", "list", "n"])

    found = settle(rows.mapInArrow(run, "q long, score double, list long, n long"), "probe-plan")
    sizes = np.zeros(index.lists, np.int64)
    for r in found.where("q < 0").groupBy("list").agg(F.sum("n").alias("n")).collect():  # a row a list
        sizes[r.list] = r.n
    best = W.partitionBy("q").orderBy(F.desc("score"), "n")
    top = (found.where("q >= 0").distinct().withColumn("r", F.row_number().over(best)).where(F.col("r") <= k)
           .select("q", "list").toArrow())  # at most k rows a calibration query
    if not top.num_rows:
        return index.lists, sizes
    order = index.order(q)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(index.lists)[None, :], axis=1)
    need = np.sort(place[top["q"].to_numpy(), top["list"].to_numpy()]) + 1
    return int(need[min(len(need) - 1, int(np.ceil(recall * len(need))) - 1)]), sizes


def _packed(index: Index, sizes: np.ndarray, least: int, most: int) -> None:
    """Deals lists to blocks: neighbouring lists together, large lists cut."""
    target = int(np.clip(sizes.sum() // 64, least, most))
    # lists that agree stand side by side: nearest neighbour chain from the first one
    left, chain = np.ones(index.lists, bool), []
    at = 0
    for _ in range(index.lists):
        chain.append(at)
        left[at] = False
        if left.any():
            at = int(np.argmax(np.where(left, index.centres @ index.centres[at], -np.inf)))
    index.block_of, index.blocks_of = np.zeros(index.lists, np.int64), np.ones(index.lists, np.int64)
    block, filled = 0, 0
    for i in chain:
        if filled and filled + sizes[i] > target:
            block, filled = block + 1, 0
        index.block_of[i] = block
        if sizes[i] > target:
            index.blocks_of[i] = -(-int(sizes[i]) // target)
            block += int(index.blocks_of[i])
            filled = 0
        else:
            filled += int(sizes[i])
    index.shares = np.ones(block + 1, np.int64)


def _query_blocks(index: Index, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, block) pairs: the blocks of the lists that each query probes."""
    at, which = np.nonzero(index.probed(q))
    n = index.blocks_of[which]
    step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    pair = np.unique(np.repeat(at, n) * len(index.shares) + np.repeat(index.block_of[which], n) + step)
    return pair // len(index.shares), pair % len(index.shares)


# Scan ----------------------------------------------------------------------------------------

class Best:
    """The k best rows of each of some queries."""

    def __init__(self, n: int, k: int, floor: np.ndarray):
        self.floor = floor  # known to be reached by k rows, here or elsewhere
        self.score, self.id = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)
        self.mine = np.zeros((n, k), bool)

    @property
    def bound(self) -> np.ndarray:
        return np.maximum(self.score[:, -1], self.floor)

    def add(self, of: np.ndarray, score: np.ndarray, ids: np.ndarray, mine: bool) -> None:
        """Takes in (query, score, id); an id with a score it is known with is not taken twice."""
        keep = score >= self.bound[of]
        of, score, ids = of[keep], score[keep], ids[keep]
        if not len(of):
            return
        k = self.score.shape[1]
        who = np.unique(of)
        q = np.concatenate([np.repeat(who, k), of])
        s = np.concatenate([self.score[who].ravel(), score])
        i = np.concatenate([self.id[who].ravel(), ids])
        m = np.concatenate([self.mine[who].ravel(), np.full(len(of), mine)])
        order = np.lexsort((~m, i, -s, q))
        q, s, i, m = q[order], s[order], i[order], m[order]
        new = np.ones(len(q), bool)
        new[1:] = (q[1:] != q[:-1]) | (s[1:] != s[:-1]) | (i[1:] != i[:-1]) | np.isinf(s[1:])
        q, s, i, m = q[new], s[new], i[new], m[new]
        begin = np.searchsorted(q, q)
        place = np.arange(len(q)) - begin
        top = place < k
        self.score[who], self.id[who], self.mine[who] = -np.inf, np.iinfo(np.int64).max, False
        self.score[q[top], place[top]], self.id[q[top], place[top]], self.mine[q[top], place[top]] = s[top], i[top], m[top]


class Rows:
    """The rows of a block: rotated column blocks in list order, beside the original vectors."""

    def __init__(self, index: Index, ids: np.ndarray, x: np.ndarray):
        keep = least_copies(ids, x, index.k + 1)
        ids, x = ids[keep], x[keep]
        which = index.list_of(x)
        order = np.argsort(which, kind="stable")
        self.index, self.ids, self.x, self.list = index, ids[order], x[order], which[order]
        self.parts, self.squares = rotated(index, self.x)

    def scan(self, q_ids: np.ndarray, q: np.ndarray, home: np.ndarray, floor: np.ndarray
             ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, score) of rows of this block, and for queries at home of the sample, among the k best so far."""
        index, best = self.index, Best(len(q), self.index.k, floor)
        here = np.flatnonzero(home)
        of, score, ids = from_sample(index, q_ids[here], q[here])
        best.add(here[of], score, ids, False)
        parts, squares = rotated(index, q)
        probed = index.probed(q)
        begin = np.flatnonzero(np.diff(self.list, prepend=-1))
        for lo, hi in zip(begin, np.append(begin[1:], len(self.list)), strict=True):
            asks = np.flatnonzero(probed[:, self.list[lo]])
            for at in range(lo, hi, ROWS) if len(asks) else ():
                self._list(best, q_ids, q, asks, parts, squares, at, min(at + ROWS, hi))
        use = (best.mine | home[:, None]) & np.isfinite(best.score)
        return np.nonzero(use)[0], best.id[use], best.score[use]

    def _list(self, best, q_ids, q, asks, parts, squares, lo, hi) -> None:
        """Adds the rows lo..hi: each block of columns leaves fewer (query, row) pairs."""
        dim = self.index.dim
        whole_q, whole_x = squares[-1], self.squares[-1]
        scale = whole_q[asks][:, None] + whole_x[lo:hi][None, :]
        most = np.maximum(scale - 2 * best.bound[asks][:, None], 0) + 1e-5 * scale  # squared distance of the k-th best
        so_far = parts[0][asks] @ self.parts[0][lo:hi].T
        left = squares[0][asks][:, None] + self.squares[0][lo:hi][None, :] - 2 * so_far
        seen = self.parts[0].shape[1]
        i, j = np.nonzero(left * (dim / seen) <= (1 + EPSILON / np.sqrt(seen)) ** 2 * most)
        so_far, most = so_far[i, j], most[i, j]
        i, j = asks[i], j + lo
        for n in range(1, len(self.parts)):
            so_far = so_far + np.einsum("ij,ij->i", parts[n][i], self.parts[n][j])
            seen += self.parts[n].shape[1]
            slack = (1 + EPSILON / np.sqrt(seen)) ** 2 * (dim / seen) ** -1 if seen < dim else 1.0
            stay = squares[n][i] + self.squares[n][j] - 2 * so_far <= slack * most + (2e-5 * (whole_q[i] + whole_x[j]) if seen == dim else 0)
            i, j, so_far, most = i[stay], j[stay], so_far[stay], most[stay]
        other = q_ids[i] != self.ids[j]
        i, j = i[other], j[other]
        best.add(i, exact(q[i], self.x[j]), self.ids[j], True)


def from_sample(index: Index, q_ids: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, score, id) of the k best rows of the sample."""
    of, row = _closest(q_ids, q, index.sample_ids, index.sample, index.k)
    return of, exact(q[of], index.sample[row]), index.sample_ids[row]


def floors(index: Index, q_ids: np.ndarray, q: np.ndarray) -> np.ndarray:
    """A score that k rows of the sample reach, for each query."""
    of, score, _ = from_sample(index, q_ids, q)
    least = np.full(len(q), np.inf)
    np.minimum.at(least, of, score)
    return np.where(np.bincount(of, minlength=len(q)) >= index.k, least, -np.inf)


def rotated(index: Index, x: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Column blocks of the rotated vectors, and the squared length up to the end of each block."""
    y = (x.astype(np.float64) @ index.rotation).astype(np.float32)
    parts = [np.ascontiguousarray(y[:, c:c + WIDTH]) for c in range(0, index.dim, WIDTH)]
    return parts, list(np.cumsum([np.einsum("ij,ij->i", p, p) for p in parts], axis=0))


def _raw(x: np.ndarray) -> pa.Array:
    width = x.shape[1] * x.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(np.arange(len(x) + 1, dtype=np.int32) * width),
                                                      pa.py_buffer(np.ascontiguousarray(x).tobytes())])


DEALT = "block long, share long, asks boolean, id long, home boolean, floor double, v binary"


def nearest(df: DataFrame, queries: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding",
            recall: float = 0.95, probes: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of every row that ``queries`` marks.

    ``queries`` is a condition on ``key``. Without ``probes`` the number of lists to probe is measured for ``recall``.
    """
    spark = df.sparkSession
    rows = _narrow(df.select(col(key), col(vector)), key, vector)
    asking = _narrow(df.where(queries).select(col(key), col(vector)), key, vector)
    length = F.size("v")
    common = rows.where(length > 0).groupBy(length.alias("dim")).agg(F.count("*").alias("n")).orderBy(
        F.desc("n"), F.desc("dim")).limit(1).collect()
    result = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("rank", T.IntegerType()),
                           T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType())])
    if not common:
        return spark.createDataFrame([], result)
    dim, n = common[0].dim, common[0].n
    dtype = np.float32 if isinstance(rows.schema["v"].dataType.elementType, T.FloatType) else np.float64
    lists = 1 if n <= WHOLE else int(np.clip(np.sqrt(n), 16, 4096))
    want = min(max(PER_LIST * lists, 1024), SAMPLE_BYTES // (dim * np.dtype(dtype).itemsize))
    ids, x = _drawn(rows, want / n, dim)
    if not len(x):  # none of the sampled vectors takes part: the rest may
        ids, x = np.empty(0, np.int64), np.empty((0, dim), dtype)
    rotation = np.linalg.qr(np.random.default_rng(7).standard_normal((dim, dim)))[0]
    centres = cluster(x, lists) if len(x) else np.zeros((1, dim), np.float32)
    keep = least_copies(ids, x, k + 1) if len(x) else np.empty(0, np.int64)
    keep = keep[np.unique(ids[keep], return_index=True)[1]] if len(keep) else keep
    index = Index(dim, k, centres, rotation, ids[keep], x[keep])
    asked = asking.count()
    if index.lists > 1:
        index.probes, sizes = _calibrated(rows, index, _drawn(asking, CALIBRATION / max(asked, 1), dim), recall)
        index.probes = min(probes or index.probes, index.lists)
    else:
        sizes = np.array([n])
    width = dim * np.dtype(dtype).itemsize
    _packed(index, sizes, 256, max(256, BLOCK_BYTES // width))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(index.shares), np.int64)
        for batch in batches:
            _, q = vectors(batch.column(1), dim)
            total += np.bincount(_query_blocks(index, q)[1], minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["block", "n"])

    for r in asking.mapInArrow(counted, "block long, n long").groupBy("block").agg(F.sum("n").alias("n")).collect():
        index.shares[r.block] = -(-r.n // SHARE)  # a row for each block
    sent = spark.sparkContext.broadcast(index)

    def deal(asks: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index, before = sent.value, 0
            for batch in batches:
                at, x = vectors(batch.column(1), dim)
                ids = batch.column(0).to_numpy()[at]
                if asks:
                    of, block = _query_blocks(index, x)
                    share = (ids[of] // 20 + of) % index.shares[block]
                    home, floor = block == index.block_of[index.list_of(x)][of], floors(index, ids, x)
                else:
                    keep = least_copies(ids, x, k + 1)
                    ids, x = ids[keep], x[keep]
                    which = index.list_of(x)
                    # a list's rows go to its blocks in turn, whatever their ids
                    block = index.block_of[which] + (np.arange(len(ids)) + before) % index.blocks_of[which]
                    before += len(ids)
                    times = index.shares[block]
                    of = np.repeat(np.arange(len(ids)), times)
                    share = np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times)
                    block, home, floor = block[of], np.zeros(len(of), bool), np.zeros(len(ids))
                for lo in range(0, len(of), 1 << 15):
                    part = of[lo:lo + (1 << 15)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(block[lo:lo + len(part)]), pa.array(share[lo:lo + len(part)]), pa.array(np.full(len(part), asks)),
                         pa.array(ids[part]), pa.array(home[lo:lo + len(part)]), pa.array(floor[part]), _raw(x[part])],
                        ["block", "share", "asks", "id", "home", "floor", "v"])
        return run

    dealt = rows.mapInArrow(deal(False), DEALT).unionByName(asking.mapInArrow(deal(True), DEALT))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, now, held, rows = sent.value, None, [], None
        for batch in batches:
            place = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(3)])
            cut = np.flatnonzero(np.any(place[:, 1:] != place[:, :-1], axis=0)) + 1
            v = b"".join(batch.column(6).to_pylist())
            whole, ids = np.frombuffer(v, dtype).reshape(-1, dim), batch.column(3).to_numpy()
            at_home, floor = batch.column(4).to_numpy(zero_copy_only=False), batch.column(5).to_numpy()
            for lo, hi in zip([0, *cut], [*cut, place.shape[1]], strict=True):
                if lo == hi:
                    continue
                if now != tuple(place[:2, lo]):
                    now, held, rows = tuple(place[:2, lo]), [], None
                if not place[2, lo]:
                    held.append((ids[lo:hi], whole[lo:hi]))
                    continue
                if rows is None and held:
                    rows, held = Rows(index, *(np.concatenate(c) for c in zip(*held, strict=True))), []
                rows = rows or Rows(index, np.empty(0, np.int64), np.empty((0, dim), dtype))
                for a in range(lo, hi, QUERIES):
                    b = min(a + QUERIES, hi)
                    of, found, score = rows.scan(ids[a:b], whole[a:b], at_home[a:b], floor[a:b])
                    yield pa.RecordBatch.from_arrays([pa.array(ids[a:b][of]), pa.array(found), pa.array(score)],
                                                     ["query_id", "vec_id", "score"])

    # rows come before queries, so that a task streams the queries past the block it holds
    met = dealt.repartition("block", "share").sortWithinPartitions("block", "share", "asks")
    found = met.mapInArrow(search, "query_id long, vec_id long, score double").distinct()
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
