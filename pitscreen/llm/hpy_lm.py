"""Hierarchical Pitman-Yor language model of words over words and characters.

Each word is a restaurant for the words that follow it, and the first word of a text follows the end
token. The tables of these restaurants are customers of one restaurant of words without a context.
The base measure that gives its tables their dishes spells the word, byte by byte, from a hierarchy of
restaurants: one for each context of two bytes, whose tables are customers of the restaurant of
the shorter context, down to one for all contexts and the uniform distribution. So a word that was
not seen after another falls back to its probability without a context, and a word never seen to its spelling.

Seating is sampled by Gibbs moves: a customer leaves its table and is seated anew, at a table in
proportion to its size less the discount, or at a new one in proportion to the parent's
probability. Pairs and words are seated in parallel, given the table totals of the sweep before. Pairs
begin with one table each. Of pairs, of words and of their spelling, each in its own sweeps, the predictive
probabilities of ``samples`` sweeps, after ``burn``, are averaged.

Counts are exact and come from all training rows: tables of words and of pairs, never collected. The most
frequent words and pairs, at most ``FREQUENT`` of each, are broadcast. Pairs of frequent words are dealt by their
key to buckets, packed, of about a million tokens each; pairs with a rare word meet its state in shuffle joins.

Cases: a null or empty text is its end token alone; without training rows each score is 0; repeated rows
are scored each; an empty table gives no rows; only key and text are read. Words and pairs are joined by
64-bit hashes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitscreen.llm import grams
from pitscreen.llm.frames import col, discard, settle

#: Bound on the number of words that are broadcast, 16 bytes each and 16 more a sample, and on that of pairs, 16 bytes each.
FREQUENT = 1 << 19
SYMBOLS = 257  # bytes and, unused so far, one more for a base that sums to one
SPACE = 0x20   # before and after each word
THETA = 1.0
CHAR_DISCOUNT, CHAR_THETA = (0.3, 0.5, 0.7), 1.0  # by context length
MOVES = 4
#: Bytes of text whose words, or pairs, are counted together; a worker holds some 25 bytes for each.
COUNTED = 4 << 20
#: Keys of word pairs are counted and scored in so many turns; more turns need less disk, and read the texts more often.
PARTS = 1
#: Lines with a rare word are joined in so many turns.
TURNS = 2


def seat(c: np.ndarray, a: np.ndarray, d: float, rng: np.random.Generator, moves: int = MOVES) -> np.ndarray:
    """Numbers of tables of dishes with ``c`` customers whose new tables weigh ``a``, after Gibbs moves."""
    t = (c > 0).astype(np.int64)
    order = np.argsort(-c, kind="stable")
    ascending = -c[order]
    for k in range(1, 64):
        live = order[:np.searchsorted(ascending, -k, side="left")]
        if not len(live):
            break
        t[live] += rng.random(len(live)) < a[live] / (a[live] + k - d * t[live])
    big = np.flatnonzero(c > 64)
    t[big] = np.minimum(c[big], t[big] + rng.poisson(a[big] * np.log((c[big] + a[big]) / (64 + a[big]))))
    many = np.flatnonzero(c > 1)
    if not len(many):
        return t
    cm, am, tm = c[many], a[many], t[many].copy()
    slots = tm + moves
    start = np.cumsum(slots) - slots
    owner = np.repeat(np.arange(len(many)), slots)
    used = np.arange(len(owner)) - start[owner] < tm[owner]
    weight = rng.exponential(size=len(owner)) * used
    extra = np.floor((cm - tm)[owner] * weight / np.add.reduceat(weight, start)[owner]).astype(np.int64)
    size = used.astype(np.int64) + extra
    size[start] += cm - np.add.reduceat(size, start)
    free = start + tm
    for _ in range(moves):
        total = np.cumsum(size)
        first = total[start] - size[start]
        gone = np.searchsorted(total, first + np.floor(rng.random(len(many)) * cm).astype(np.int64), side="right")
        size[gone] -= 1
        tm -= size[gone] == 0
        new = rng.random(len(many)) < am / (am + cm - 1 - d * tm)
        new |= tm == 0
        pull = np.where(size > 0, size - d, 0.0)
        total = np.cumsum(pull)
        first, last = total[start] - pull[start], total[start + slots - 1]
        to = np.searchsorted(total, first + rng.random(len(many)) * (last - first), side="right")
        to = np.clip(to, start, start + slots - 1)
        to = np.where(new | (size[to] == 0), np.where(new, free, start + 0), to)
        opened = size[to] == 0
        size[to] += 1
        tm += opened
        free += new & opened
    t[many] = tm
    return t


@dataclass
class Spelling:
    """Predictive probabilities of a byte after two others: rows of ``p``, found through ``row``."""

    row: np.ndarray
    p: np.ndarray

    def log(self, before2: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        return np.log(self.p[self.row[before2], symbol])


def fit_spelling(context: np.ndarray, symbol: np.ndarray, n: np.ndarray, rng: np.random.Generator,
                 sweeps: int = 3) -> Spelling:
    """Character restaurants from customers ``n`` of (two bytes, byte); at most 256 ** 3 rows."""
    def grouped(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        code = keys[0]
        for k in keys[1:]:
            code = code * SYMBOLS + k
        return np.unique(code, return_inverse=True)

    u1, to1 = grouped(context & 255, symbol)
    c1, s1 = u1 // SYMBOLS, u1 % SYMBOLS
    u0, to0 = np.unique(s1, return_inverse=True)
    t2, t1, t0 = np.ones(len(n)), np.ones(len(u1)), np.ones(len(u0))
    k2, to2 = np.unique(context, return_inverse=True)

    def predict(cust: np.ndarray, tables: np.ndarray, at: np.ndarray, s: np.ndarray, rows: int, parent: np.ndarray,
                depth: int) -> np.ndarray:
        d = CHAR_DISCOUNT[depth]
        total = np.bincount(at, weights=cust, minlength=rows)
        opened = np.bincount(at, weights=tables, minlength=rows)
        p = ((CHAR_THETA + d * opened) / (CHAR_THETA + total))[:, None] * parent
        p[at, s] += (cust - d * tables) / (CHAR_THETA + total[at])
        return p

    def tables(cust: np.ndarray, now: np.ndarray, at: np.ndarray, rows: int, base: np.ndarray, depth: int) -> np.ndarray:
        d = CHAR_DISCOUNT[depth]
        opened = np.bincount(at, weights=now, minlength=rows)[at]
        return seat(cust.astype(np.int64), (CHAR_THETA + d * opened) * base, d, rng)

    uniform = np.full((1, SYMBOLS), 1 / SYMBOLS)
    for sweep in range(sweeps + 1):
        n1 = np.bincount(to1, weights=t2, minlength=len(u1))
        n0 = np.bincount(to0, weights=t1, minlength=len(u0))
        p0 = predict(n0, t0, np.zeros(len(u0), np.int64), u0, 1, uniform, 0)
        p1 = predict(n1, t1, c1, s1, 256, np.repeat(p0, 256, axis=0), 1)
        if sweep == sweeps:
            break
        t2 = tables(n, t2, to2, len(k2), p1[context & 255, symbol], 2)
        n1 = np.bincount(to1, weights=t2, minlength=len(u1))
        t1 = tables(n1, t1, c1, 256, p0[0][s1], 1)
        n0 = np.bincount(to0, weights=t1, minlength=len(u0))
        t0 = tables(n0, t0, np.zeros(len(u0), np.int64), 1, np.full(len(u0), 1 / SYMBOLS), 0)
    p2 = predict(n, t2, to2, symbol, len(k2), p1[k2 & 255], 2) if len(k2) else np.empty((0, SYMBOLS))
    row = np.arange(1 << 16) & 255
    row[k2] = 256 + np.arange(len(k2))
    return Spelling(row.astype(np.int32), np.concatenate([p1, p2]))


def spelled(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts and symbols of all words, closing space included, and the symbols of each word."""
    _, where, data = words.cast(pa.large_binary()).buffers()
    offsets = np.frombuffer(where, np.int64)[words.offset:words.offset + len(words) + 1]
    raw = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None and data.size else np.empty(0, np.uint8)
    lens = np.diff(offsets)
    n = lens + 1
    first = np.cumsum(n) - n
    symbol = np.full(int(n.sum()), SPACE, dtype=np.int64)
    symbol[np.arange(len(raw)) + np.repeat(np.arange(len(lens)), lens)] = raw
    at = np.arange(len(symbol)) - np.repeat(first, n)
    one, two = np.full(len(symbol), SPACE), np.full(len(symbol), SPACE)
    one[1:], two[2:] = symbol[:-1], symbol[:-2]
    one[at < 1] = SPACE
    two[at < 2] = SPACE
    return two * 256 + one, symbol, n


def vocabulary(docs: DataFrame, train: Column, text: str = "text", unseen: bool = False) -> DataFrame:
    """(word, c): training count of every training word; the end token is the empty word.

    With ``unseen`` the words of other rows come too, with a count of 0. Words are counted per
    block of texts before the shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            used = np.asarray(batch.column(1).to_numpy(zero_copy_only=False), dtype=bool)
            yield pa.RecordBatch.from_arrays([pa.array([b""], pa.binary()), pa.array([int(used.sum())], pa.int64())], ["word", "c"])
            for b in grams.blocks(batch.column(0), COUNTED):
                w = b.words()
                if not len(w.text):
                    continue
                h = w.hashes()
                _, once, which = np.unique(h, return_index=True, return_inverse=True)
                c = np.bincount(which, weights=used[b.first + w.text]).astype(np.int64)
                if not unseen:
                    once, c = once[c > 0], c[c > 0]
                if not len(once):
                    continue
                lens = (w.end - w.start)[once]
                at = np.cumsum(lens) - lens
                raw = grams.LOWER[b.data[np.arange(int(lens.sum())) + np.repeat(w.start[once] - at, lens)]]
                offsets = np.append(at, lens.sum()).astype(np.int32)
                words = pa.Array.from_buffers(pa.binary(), len(once), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays([words, pa.array(c)], ["word", "c"])

    found = docs.select(col(text).cast("string").alias("x"), train.alias("t")).mapInArrow(run, "word binary, c long")
    return found.groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Model:
    """Totals, and of each sample the spelling and the number of tables it was drawn with."""

    tokens: int
    types: int
    discount: float
    samples: list[tuple[Spelling, float]]
    seed: int

    def base(self, words: pa.Array, spelling: Spelling) -> np.ndarray:
        before, symbol, n = spelled(words)
        return np.exp(np.add.reduceat(spelling.log(before, symbol), np.cumsum(n) - n)) if len(n) else np.empty(0)

    def seated(self, words: pa.Array, c: np.ndarray, spelling: Spelling, opened: float, salt: int) -> tuple[np.ndarray, np.ndarray]:
        """Tables and base probabilities; the seed follows from the rows, so a retried task agrees."""
        base = self.base(words, spelling)
        rng = np.random.default_rng([self.seed, salt, zlib.crc32(words[0].as_py()) if len(words) else 0])
        return seat(c, (THETA + self.discount * opened) * base, self.discount, rng), base

    def probability(self, words: pa.Array, c: np.ndarray) -> np.ndarray:
        """Predictive probability of each word, averaged over the samples."""
        total = np.zeros(len(c))
        for i, (spelling, opened) in enumerate(self.samples):
            t, base = self.seated(words, c, spelling, opened, i)
            total += ((c - self.discount * t) + (THETA + self.discount * opened) * base) / (THETA + self.tokens)
        return total / max(1, len(self.samples))


def _customers(words: DataFrame, model: Model | None, spelling: Spelling | None, opened: float, salt: int) -> DataFrame:
    """(ctx, sym, n) summed over training words by their tables (one each without a model), and the
    table total as the row with ctx -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        codes, counts = [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            w, c = batch.column(0), np.asarray(batch.column(1))
            t = np.ones(len(c), np.int64) if model is None else model.seated(w, c, spelling, opened, salt)[0]
            before, symbol, n = spelled(w)
            u, which = np.unique(before * SYMBOLS + symbol, return_inverse=True)
            codes.append(u)
            counts.append(np.bincount(which, weights=np.repeat(t, n)))
            total += int(t.sum())
            if sum(map(len, codes)) > 2_000_000:
                u, which = np.unique(np.concatenate(codes), return_inverse=True)
                codes, counts = [u], [np.bincount(which, weights=np.concatenate(counts))]
        u, which = np.unique(np.concatenate(codes), return_inverse=True) if codes else (np.empty(0, np.int64), [])
        n = np.bincount(which, weights=np.concatenate(counts)).astype(np.int64) if codes else np.empty(0, np.int64)
        yield pa.RecordBatch.from_pydict({"ctx": np.append(u // SYMBOLS, -1), "sym": np.append(u % SYMBOLS, 0),
                                          "n": np.append(n, total)})

    return words.where("c > 0").select("word", "c").mapInArrow(run, "ctx long, sym long, n long").groupBy("ctx", "sym").agg(
        F.sum("n").alias("n"))


def _spelling(rows: pa.Table, seed: int) -> tuple[Spelling, float]:
    """The character restaurants of a sweep; what is collected has at most 256 ** 3 rows of bytes."""
    t = rows.sort_by([("ctx", "ascending"), ("sym", "ascending")])
    ctx, sym, n = (t[c].to_numpy() for c in ("ctx", "sym", "n"))
    real = ctx >= 0
    return fit_spelling(ctx[real], sym[real], n[real], np.random.default_rng(seed)), float(n[~real].sum())


def fit(words: DataFrame, burn: int = 1, samples: int = 2, seed: int = 5, start: pa.Table | None = None) -> Model:
    """``words`` is a landed vocabulary. Each sweep is one pass over it and one small aggregate.

    ``start``, if given, are the customers of the spelling when each training word has one table.
    """
    one, two = (F.sum(F.when(F.col("c") == k, 1).otherwise(0)) for k in (1, 2))
    row = words.agg(F.sum("c").alias("n"), F.sum(F.when(F.col("c") > 0, 1).otherwise(0)).alias("v"), one.alias("n1"),
                    two.alias("n2")).first()
    n1, n2 = row["n1"] or 0, row["n2"] or 0
    model = Model(row["n"] or 0, row["v"] or 0, min(0.95, max(0.1, n1 / (n1 + 2 * n2) if n1 else 0.5)), [], seed)
    spelling, opened = _spelling(_customers(words, None, None, 0.0, 0).toArrow() if start is None else start, seed)
    for sweep in range(burn + samples - 1):
        if sweep >= burn:
            model.samples.append((spelling, opened))
        spelling, opened = _spelling(_customers(words, model, spelling, opened, 100 + sweep).toArrow(), seed + 1 + sweep)
    model.samples.append((spelling, opened))
    return model


def word_hashes(words: pa.Array) -> np.ndarray:
    """The hash of each word, as texts have it; 0 for the end token."""
    _, where, data = words.cast(pa.large_binary()).buffers()
    offsets = np.frombuffer(where, np.int64)[words.offset:words.offset + len(words) + 1]
    lens = np.diff(offsets)
    h = np.zeros(len(words), dtype=np.uint64)
    if lens.any():
        raw = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]]
        h[lens > 0] = grams.run_hashes(raw, lens[lens > 0])
    return h.view(np.int64)


def probabilities(words: DataFrame, model: Model, *keep: str) -> DataFrame:
    """(h, c, logp) of every word of a vocabulary, by the hash that texts are looked up with, and the columns ``keep``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w, c = batch.column(0), np.asarray(batch.column(1))
            yield pa.RecordBatch.from_arrays([pa.array(word_hashes(w)), batch.column(1), pa.array(np.log10(model.probability(w, c))),
                                              *batch.columns[2:]], ["h", "c", "logp", *keep])

    return words.select("word", "c", *keep).mapInArrow(
        run, "h long, c long, logp double" + "".join(f", {x} {words.schema[x].dataType.simpleString()}" for x in keep))


def least_count(rows: DataFrame, most: int, total: int) -> int:
    """The least count ``c`` that at most ``most`` of the rows reach, whose counts add up to ``total`` or less."""
    cap = max(1, -(-total // most))
    found = rows.where("c > 0").groupBy(F.least("c", F.lit(cap)).alias("c")).agg(F.count("*").alias("n")).collect()
    have = {r["c"]: r["n"] for r in found}
    least, n = cap, have.get(cap, 0)
    while least > 1 and n + have.get(least - 1, 0) <= most:
        least -= 1
        n += have.get(least, 0)
    return least


def find(table: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each wanted value is in a sorted table, and whether it is there."""
    if not len(table):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    where = np.minimum(np.searchsorted(table, wanted), len(table) - 1)
    return where, table[where] == wanted


@dataclass
class Tokens:
    """Tokens of a block: preceding word and word, as hashes and as places in a sorted table (-1: not there),
    their joint key and text, and the words per text."""

    u: np.ndarray
    w: np.ndarray
    uid: np.ndarray
    wid: np.ndarray
    joint: np.ndarray
    text: np.ndarray
    per_text: np.ndarray


def sequence(b: grams.Block, top: np.ndarray) -> Tokens:
    """Each text ends with the end token, whose hash is 0, and its first word follows one."""
    words = b.words()
    w = np.zeros(len(words.text) + b.count, dtype=np.uint64)
    w[np.arange(len(words.text)) + words.text] = words.hashes()
    names, which = np.unique(w, return_inverse=True)
    where, hit = find(top, names.view(np.int64))
    wid = np.where(hit, where, -1).astype(np.int32)[which]
    u, uid = np.zeros_like(w), np.empty_like(wid)
    u[1:], uid[1:] = w[:-1], wid[:-1]
    uid[:1] = wid[-1:]
    text = np.repeat(np.arange(b.count), words.per_text + 1)
    return Tokens(u.view(np.int64), w.view(np.int64), uid, wid, joint_key(u, w), text, words.per_text)


def joint_key(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The hash of a word after another, from the hashes of both."""
    return grams.mix(grams.mix(u + np.uint64(1)) + w)


def keyed(found: DataFrame, *keep: str) -> DataFrame:
    """``key``, the joint key of ``u`` and ``w``, and the long columns ``keep``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, w = (np.asarray(batch.column(i)).view(np.uint64) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(joint_key(u, w).view(np.int64)), *batch.columns[2:]], ["key", *keep])

    return found.select("u", "w", *keep).mapInArrow(run, ", ".join(f"{x} long" for x in ("key", *keep)))


def packed(group: np.ndarray, *values: np.ndarray | tuple[np.ndarray, np.ndarray]) -> list[pa.Array]:
    """The groups of an ascending array, and the values of each as bytes; of a pair, those its mask marks."""
    names, first = np.unique(group, return_index=True)
    cut = np.append(first, len(group))
    out = [pa.array(names.astype(np.int64))]
    for x in values:
        ends = cut
        if isinstance(x, tuple):
            ends, x = np.append(0, np.cumsum(x[0]))[cut], x[1][x[0]]
        out.append(pa.Array.from_buffers(pa.binary(), len(names), [
            None, pa.py_buffer((ends * x.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x))]))
    return out


def sizes(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Bytes of each value of a binary column, 0 for null."""
    return np.asarray(pc.fill_null(pc.binary_length(column), 0)).astype(np.int64)


def unpacked(column: pa.Array | pa.ChunkedArray, kind: type) -> np.ndarray:
    """All values of a binary column, one after another."""
    raw = [x.as_buffer() for x in column if x.is_valid]
    return np.concatenate([np.frombuffer(x, kind) for x in raw]) if raw else np.empty(0, kind)


def named(ids: np.ndarray, others: np.ndarray, top: np.ndarray) -> np.ndarray:
    """Hashes of words by their places in ``top``; those that are not there come from ``others`` in turn."""
    h = np.empty(len(ids), np.int64)
    h[ids < 0] = others
    h[ids >= 0] = top[ids[ids >= 0]]
    return h


def bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    """The share of a key, a 64-bit hash, among ``buckets``, a power of two; ascends with the unsigned key."""
    return (key.view(np.uint64) >> np.uint64(65 - buckets.bit_length())).astype(np.int64)


COUNTS = ("bucket long, ones long, twos long, single binary, rare_single binary, u binary, w binary, c binary, rare binary, "
          "h binary, n_w binary, n_u binary")


def pairs(docs: DataFrame, train: Column, text: str, part: int, top: Broadcast | None = None, buckets: int = 64) -> DataFrame:
    """Training counts of each word after each, of those whose keys leave ``part``, packed by bucket.

    Of pairs of one customer the keys (``rare_single``: with a word that ``top`` lacks) and what they add to
    their words ``h``; of the others ``u``, ``w``, ``c``, and whether ``top`` lacks one of them.
    """
    empty = np.empty(0, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = empty if top is None else top.value
        for batch in batches:
            used = np.asarray(batch.column(1).to_numpy(zero_copy_only=False), dtype=bool)
            for b in grams.blocks(batch.column(0), COUNTED):
                t = sequence(b, table)
                here = np.flatnonzero(used[b.first + t.text] & (t.joint % np.uint64(PARTS) == part))
                order = here[np.argsort(t.joint[here])]
                key = t.joint[order]
                first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[:len(key)])
                at = order[first]
                uid, wid, c = t.uid[at], t.wid[at], np.diff(np.append(first, len(key))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    packed(bucket_of(key[first], buckets), uid, wid, c, (uid < 0, t.u[at]), (wid < 0, t.w[at])),
                    ["bucket", "u", "w", "c", "xu", "xw"])

    def count(found: pa.Table) -> pa.Table:
        table = empty if top is None else top.value
        uid, wid, c = (unpacked(found[x], np.int32) for x in ("u", "w", "c"))
        u, w = named(uid, unpacked(found["xu"], np.int64), table), named(wid, unpacked(found["xw"], np.int64), table)
        key = joint_key(u.view(np.uint64), w.view(np.uint64))
        order = np.argsort(key)
        ordered = key[order]
        first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
        c = np.add.reduceat(c[order].astype(np.int64), first)
        at = order[first]
        rare, one = (uid[at] < 0) | (wid[at] < 0), c == 1
        key = ordered[first]
        h, which = np.unique(np.concatenate([w[at[one]], u[at[one]]]), return_inverse=True)
        m = int(one.sum())
        n_w, n_u = (np.bincount(x, minlength=len(h)).astype(np.int32) for x in (which[:m], which[m:]))
        many = at[~one]
        row = [key[one & ~rare], key[one & rare], u[many], w[many], c[~one], rare[~one], h, n_w, n_u]
        return pa.table([found["bucket"][:1].cast(pa.int64()), pa.array([m]), pa.array([int((c == 2).sum())]), *[
            pa.array([x.tobytes()], pa.binary()) for x in row]], names=[x.split()[0] for x in COUNTS.split(", ")])

    found = docs.select(col(text).cast("string").alias("x"), train.alias("t")).mapInArrow(
        run, "bucket long, u binary, w binary, c binary, xu binary, xw binary")
    return found.groupBy("bucket").applyInArrow(count, COUNTS)


def spread(found: DataFrame, **kinds: type) -> DataFrame:
    """One row for each of the values packed in the columns ``kinds``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays([pa.array(unpacked(c, k).astype(np.int64)) for c, k in zip(
                    row.columns, kinds.values(), strict=True)], list(kinds))

    return found.select(*kinds).mapInArrow(run, ", ".join(f"{x} long" for x in kinds))


PAIRS = ("u", "w", "c", "kept", "t")
SEATED = "rare long, " + ", ".join(f"{x} binary" for x in PAIRS)


def bundle(rare: int, *values: np.ndarray) -> pa.RecordBatch:
    """Pairs as one row."""
    return pa.RecordBatch.from_arrays([pa.array([rare]), *[pa.array([x.astype(np.int64).tobytes()], pa.binary()) for x in values]],
                                      ["rare", *PAIRS])


def repeated(counted: DataFrame) -> DataFrame:
    """Pairs of two customers or more, at one table each, those with a rare word apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                u, w, c, rare = (unpacked(x.slice(i, 1), k) for x, k in zip(
                    batch.columns, (np.int64, np.int64, np.int64, np.bool_), strict=True))
                for side in (0, 1):
                    at = rare == side
                    if at.any():
                        yield bundle(side, u[at], w[at], c[at], np.zeros(at.sum()), np.ones(at.sum()))

    return counted.select("u", "w", "c", "rare").mapInArrow(run, SEATED)


def tables(found: DataFrame) -> DataFrame:
    """(h, n_w, n_u): tables that each word has after others, and that others have after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            share = np.cumsum(sizes(batch.column(0))) >> 21  # about 2 MB of words are added up at a time
            cut = np.append(np.unique(share, return_index=True)[1], len(share))
            for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                u, w, t = (unpacked(x.slice(lo, hi - lo), np.int64) for x in batch.columns)
                h, which = np.unique(np.concatenate([w, u]), return_inverse=True)
                n_w, n_u = (np.bincount(x, t, len(h)).astype(np.int64) for x in (which[:len(w)], which[len(w):]))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h, n_w, n_u)], ["h", "n_w", "n_u"])

    return found.select("u", "w", "t").mapInArrow(run, "h long, n_w long, n_u long")


def frequent_states(known: DataFrame, frequent: Column) -> Broadcast:
    """Hashes, probabilities without a context and tables as a context of the frequent words, by hash."""
    state = known.where(frequent).select("h", F.pow(F.lit(10.0), F.col("logp")).cast("float").alias("p"),
                                         F.col("opened").cast("float")).toArrow().sort_by("h")
    return known.sparkSession.sparkContext.broadcast(tuple(state[x].to_numpy() for x in ("h", "p", "opened")))


def seated_pairs(many: DataFrame, known: DataFrame, discount: float, seed: int, shared: Broadcast, keep: bool) -> DataFrame:
    """Pairs with their new tables, given the tables of ``known``; with ``keep`` they are added to ``kept``.

    The frequent words, ``shared``, are met where the pairs are, others (pairs marked ``rare``) in joins with ``known``.
    """

    def seated(rare: int, u: np.ndarray, w: np.ndarray, c: np.ndarray, kept: np.ndarray, p: np.ndarray, opened: np.ndarray):
        rng = np.random.default_rng([seed, zlib.crc32(joint_key(u.view(np.uint64), w.view(np.uint64)).tobytes())])
        t = seat(c, (THETA + discount * opened) * p, discount, rng)
        return bundle(rare, u, w, c, kept + t if keep else kept, t)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, p, opened = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                u, w, c, kept = (unpacked(x.slice(i, 1), np.int64) for x in batch.columns)
                yield seated(0, u, w, c, kept, p[find(h, w)[0]].astype(float), opened[find(h, u)[0]].astype(float))

    def far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield seated(1, *(np.asarray(x) for x in batch.columns))

    word = known.select(F.col("h").alias("w"), F.pow(F.lit(10.0), F.col("logp")).alias("p"))
    context = known.select(F.col("h").alias("u"), "opened")
    pair = PAIRS[:4]
    rare = spread(many.where("rare = 1"), **dict.fromkeys(pair, np.int64))
    met = rare.join(word, "w").join(context, "u").select(*pair, "p", F.col("opened").cast("double"))
    return many.where("rare = 0").select(*pair).mapInArrow(near, SEATED).unionByName(met.mapInArrow(far, SEATED))


@dataclass
class Contexts:
    """Totals of the corpus, the restaurants of preceding words, and the last model that is their parent."""

    tokens: int
    types: int
    discount: float
    words: Model
    samples: int            # of the seating of pairs
    known: DataFrame        # (h, c, opened, ps, opens): of each word its count, mean tables as a context, and by sample its
                            # probability without a context and its tables as one
    least: int              # words of this count or more are frequent
    buckets: int            # of pairs of frequent words
    single: list[DataFrame]  # by part, keys of pairs of one customer: (bucket, single, rare_single), packed
    many: list[DataFrame]   # (rare, u, w, c, kept, t): by part, the other pairs, packed; ``kept`` are their tables, summed over the samples

    @property
    def own(self) -> list[DataFrame]:
        """(key, c, own): by part, customers of each trained pair less its tables' discounts, the samples' mean."""
        return [_all([self.own_single(i, "single"), self.own_single(i, "rare_single"), self.own_many(q)])
                for i, q in enumerate(self.many)]

    def own_single(self, part: int, which: str) -> DataFrame:
        return spread(self.single[part], **{which: np.int64}).select(
            F.col(which).alias("key"), F.lit(1).cast("long").alias("c"), F.lit(1 - self.discount).alias("own"))

    def own_many(self, many: DataFrame) -> DataFrame:
        return keyed(spread(many, **dict.fromkeys(PAIRS[:4], np.int64)), "c", "kept").select(
            "key", "c", (F.col("c") - self.discount / self.samples * F.col("kept")).alias("own"))


def fit_contexts(docs: DataFrame, train: Column, text: str = "text", burn: int = 1, samples: int = 2, seed: int = 5) -> Contexts:
    """Restaurants of all preceding words. Pairs begin at one table each; each sweep seats all pairs anew.

    A pair of one customer has one table whatever is drawn. The tables are the customers of the words'
    restaurant, which is fitted again after each sweep. The first ``burn`` sweeps are left out, of each of the
    ``samples`` next the tables and the restaurant they led to are kept together.
    """
    words = settle(hashed(vocabulary(docs, train, text, unseen=True)), "vocabulary")
    row = words.agg(F.sum("c").alias("n"), F.sum(F.when(F.col("c") > 0, 1).otherwise(0)).alias("v")).first()
    least = least_count(words, FREQUENT, row["n"] or 0)
    frequent = F.col("c") >= least
    top = words.where(frequent).select("h").toArrow()["h"].to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(np.sort(top))
    buckets = 1 << max(6, ((row["n"] or 0) >> 20).bit_length())
    ones, single, many, fixed = [0, 0], [], [], []
    for i in range(PARTS):
        counted = settle(pairs(docs, train, text, i, shared, buckets), f"pairs-{i}")
        found = counted.agg(F.sum("ones"), F.sum("twos")).first()
        ones = [x + (y or 0) for x, y in zip(ones, found, strict=True)]
        # a pair of one customer keeps its one table: its key remains, and what it adds to its words
        single.append(settle(counted.select("bucket", "single", "rare_single"), f"single-{i}"))
        fixed.append(settle(spread(counted, h=np.int64, n_w=np.int32, n_u=np.int32).groupBy("h").agg(
            F.sum("n_w").alias("n_w"), F.sum("n_u").alias("n_u")), f"fixed-{i}"))
        many.append(settle(repeated(counted), f"many-{i}"))
        discard(counted)
    shared.destroy()
    discount = min(0.95, max(0.1, ones[0] / (ones[0] + 2 * ones[1]) if ones[0] else 0.5))
    once = settle(_all(fixed).groupBy("h").agg(F.sum("n_w").alias("n_w"), F.sum("n_u").alias("n_u")), "fixed")
    discard(*fixed)
    kept, start = [], None
    for sweep in range(burn + samples + 1):
        moved = once.unionByName(tables(_all(many))).groupBy("h").agg(F.sum("n_w").alias("n_w"), F.sum("n_u").alias("n_u"))
        held = settle(words.join(moved, "h", "left").select(
            "word", "h", F.col("c").alias("count"), F.coalesce("n_w", F.lit(0)).alias("c"),
            F.coalesce("n_u", F.lit(0)).alias("opened"), *kept), "customers")
        discard(words)
        start = _customers(held, None, None, 0.0, 0).toArrow() if start is None else start
        model = fit(held, seed=seed + 50 * sweep, start=start)
        # the parent's probability is joined by hash; two words of one hash would be one
        last = sweep == burn + samples
        known = probabilities(held, model, "word", "count", "opened", *kept).select(
            "h", *([] if last else ["word"]), "logp", F.col("count").alias("c"), "opened", *kept)
        if sweep > burn:
            known = known.withColumns({f"p{sweep}": F.pow(F.lit(10.0), "logp"), f"open{sweep}": F.col("opened").cast("double")})
            kept += [f"p{sweep}", f"open{sweep}"]
        known = settle(known, "states" if last else "known-words")
        discard(held)
        if last:
            break
        shared = frequent_states(known, frequent)
        for i, p in enumerate(many):
            many[i] = settle(seated_pairs(p, known, discount, seed + 1000 * sweep + i, shared, sweep >= burn), f"seated-{i}")
            discard(p)
        shared.destroy()
        words = known
    discard(once)
    opens = F.array(*kept[1::2])
    known = known.select("h", "c", (F.aggregate(opens, F.lit(0.0), lambda x, y: x + y) / samples).alias("opened"),
                         F.array(*kept[::2]).alias("ps"), opens.alias("opens"))
    return Contexts(row["n"] or 0, row["v"] or 0, discount, model, samples, known, least, buckets, single, many)


def _all(tables_of: list[DataFrame], allowMissingColumns: bool = False) -> DataFrame:
    every = tables_of[0]
    for more in tables_of[1:]:
        every = every.unionByName(more, allowMissingColumns)
    return every


def hashed(words: DataFrame) -> DataFrame:
    """A vocabulary with the hash ``h`` that texts are looked up with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(word_hashes(batch.column(0)))],
                                             ["word", "c", "h"])

    return words.select("word", "c").mapInArrow(run, "word binary, c long, h long").dropDuplicates(["h"])


def score(docs: DataFrame, model: Contexts, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, n_known, base_score, score) of every row.

    A token's probability is what its pair has in the restaurant of the word before it, and the parent's
    share, averaged over the samples. Frequent words and pairs are met where the text is. Other pairs of frequent
    words are dealt by their key, packed by block of texts, to where the counts of their bucket are; the sums go back to their
    block. Each pair with a rare word is a line that gets what that word has, and its count, in joins. Rows are told
    apart there by a hash of key and text; rows equal in both have the same score. Without training rows
    there is no model, and each score is 0.
    """
    theta, d, buckets, model_samples = THETA, model.discount, model.buckets, model.samples
    frequent = F.col("c") >= model.least
    word = model.known.where(frequent).toArrow().sort_by("h")
    by_sample = [np.asarray(word[x].combine_chunks().flatten()).reshape(-1, model.samples) for x in ("ps", "opens")]
    arrays = [word["h"].to_numpy(), word["c"].to_numpy(), by_sample[0], theta + d * by_sample[1]]
    opens, probs = ([f"{x}{i}" for i in range(model.samples)] for x in ("open", "p"))
    met = [q.where("rare = 0") for q in model.many]
    often = max(2, least_count(spread(_all(met), c=np.int64), FREQUENT, model.tokens))
    common = model.own_many(_all(met)).where(F.col("c") >= often).select("key", "own").toArrow().sort_by("key")
    shared = docs.sparkSession.sparkContext.broadcast((*arrays, common["key"].to_numpy(), common["own"].to_numpy()))
    kind = docs.select(col(key)).schema[0].dataType.simpleString()
    source = docs.select(F.xxhash64(col(key).cast("string"), col(text).cast("string"), F.lit(7)).alias("rid"),
                         col(key).alias("k"), col(text).cast("string").alias("x"))

    def grouped(t: Tokens, here: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One token for each pair of a text among those of ``here``, by key, and how often the text has the pair."""
        order = here[np.argsort(t.joint[here], kind="stable")]
        k, r = t.joint[order], t.text[order]
        first = np.flatnonzero(np.append(True, (k[1:] != k[:-1]) | (r[1:] != r[:-1]))[:len(k)])
        return order[first], np.diff(np.append(first, len(k)))

    def far(part: int, turn: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            h, c, p, opened, *_ = shared.value
            for batch in batches:
                rids = np.asarray(batch.column(0))
                for b in grams.blocks(batch.column(2), COUNTED):
                    t = sequence(b, h)
                    i, tf = grouped(t, np.flatnonzero(((t.uid < 0) | (t.wid < 0)) & (t.joint % np.uint64(PARTS) == part)
                                                      & (t.joint // np.uint64(PARTS) % np.uint64(TURNS) == turn)))
                    rid, kj = rids[b.first + t.text[i]], t.joint[i].view(np.int64)
                    ua, wa, uh, wh = t.uid[i], t.wid[i], t.uid[i] >= 0, t.wid[i] >= 0
                    apart = grams.mix((rid ^ kj).view(np.uint64)).view(np.int64)
                    filled = [np.where(x, v[y] if len(v) else 0.0, np.nan) for v, x, y in (
                        (c + theta, uh, ua), *((o, uh, ua) for o in opened.T), *((q, wh, wa) for q in p.T))]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(rid), pa.array(kj), pa.array(tf), pa.array(np.where(uh, apart, t.u[i])),
                         pa.array(np.where(wh, apart, t.w[i])), *[pa.array(x, mask=np.isnan(x)) for x in filled]],
                        ["rid", "key", "tf", "ru", "rw", "total", *opens, *probs])

        return run

    lines = [f"{x} binary" for x in ("u", "w", "doc", "tf")]
    heads = [*(f"{x} binary" for x in ("rid", "n", "known", "base", "logp")), f"ks array<{kind}>"]

    def near(part: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            h, c, p, opened, ph, pown = shared.value
            block = TaskContext.get().partitionId() << 32
            total, seen = np.log10(theta + c), np.log10(c + 1.0)
            for batch in batches:
                rids = np.asarray(batch.column(0))
                for b in grams.blocks(batch.column(2), COUNTED):
                    t = sequence(b, h)
                    n = b.count
                    hit = np.flatnonzero(t.wid >= 0)
                    known = np.bincount(t.text[hit], minlength=n)
                    base = np.bincount(t.text[hit], seen[t.wid[hit]], n)
                    both = np.flatnonzero((t.uid >= 0) & (t.wid >= 0) & (t.joint % np.uint64(PARTS) == part))
                    logp = -np.bincount(t.text[both], total[t.uid[both]], n)
                    i, tf = grouped(t, both)
                    at, often = find(ph, t.joint[i].view(np.int64))
                    j, at = i[often], at[often]
                    back = (opened[t.uid[j]] * p[t.wid[j]]).mean(axis=1)
                    logp += np.bincount(t.text[j], tf[often] * np.log10(pown[at] + back), n)
                    j = i[~often]
                    made = packed(bucket_of(t.joint[j], buckets), t.uid[j], t.wid[j], t.text[j].astype(np.uint16),
                                  tf[~often].astype(np.int32))
                    m = len(made[0])
                    keys = batch.column(1).slice(b.first, n)
                    head = [rids[b.first:b.first + n], t.per_text + 1, known, base, logp]
                    yield pa.RecordBatch.from_arrays(
                        [pa.concat_arrays([made[0], pa.array([block % buckets])]), pa.array(np.full(m + 1, block)),
                         *[pa.concat_arrays([x, pa.nulls(1, x.type)]) for x in made[1:]],
                         *[pa.array([None] * m + [np.ascontiguousarray(x).tobytes()], pa.binary()) for x in head],
                         pa.concat_arrays([pa.nulls(m, pa.list_(keys.type)), pa.ListArray.from_arrays([0, n], keys)])],
                        ["bucket", "blk", *(x.split()[0] for x in lines + heads)])
                    block += 1

        return run

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                u, w, c, kept = (unpacked(x.slice(i, 1), np.int64) for x in batch.columns)
                k = joint_key(u.view(np.uint64), w.view(np.uint64))
                order = np.flatnonzero(c < often)
                order = order[np.argsort(k[order])]
                own = c - d / model_samples * kept
                yield pa.RecordBatch.from_arrays(packed(bucket_of(k[order], buckets), k[order], own[order]), ["bucket", "key", "own"])

    def meet(found: pa.Table) -> pa.Table:
        h, _, p, opened, *_ = shared.value
        uid, wid, doc, tf = (unpacked(found[x], k) for x, k in (
            ("u", np.int32), ("w", np.int32), ("doc", np.uint16), ("tf", np.int32)))
        rows = np.repeat(np.arange(found.num_rows), sizes(found["doc"]) // 2)
        many = pc.is_valid(found["own"])
        one = unpacked(found["key"].filter(pc.invert(many)), np.int64)
        k = np.concatenate([one, unpacked(found["key"].filter(many), np.int64)])
        own = np.concatenate([np.full(len(one), 1 - d), unpacked(found["own"], np.float64)])
        order = np.argsort(k)
        k, own = k[order], own[order]
        at, hit = find(k, joint_key(h[uid].view(np.uint64), h[wid].view(np.uint64)).view(np.int64))
        value = (opened[uid] * p[wid]).mean(axis=1)
        value[hit] += own[at[hit]]
        text, which = np.unique(rows << 16 | doc, return_inverse=True)
        made = packed(text >> 16, (text & 0xFFFF).astype(np.uint16), np.bincount(which, tf * np.log10(value), len(text)))
        head = found.filter(pc.is_valid(found["rid"])).select(["blk", "rid", "n", "known", "base", "logp", "ks"])
        sums = pa.table([found["blk"].take(made[0]), made[1], made[2]], names=["blk", "doc", "logp"])
        return pa.concat_tables([head, sums], promote_options="default").select(["blk", "doc", *(x.split()[0] for x in heads)])

    def finish(found: pa.Table) -> pa.Table:
        head = pc.is_valid(found["rid"])
        first, rest = found.filter(head), found.filter(pc.invert(head))
        logp = unpacked(first["logp"], np.float64)
        n = len(logp)
        logp = logp + np.bincount(unpacked(rest["doc"], np.uint16), unpacked(rest["logp"], np.float64), n)
        keys = pa.chunked_array([x.flatten() for x in first["ks"].chunks], first.schema.field("ks").type.value_type)
        return pa.table([pa.array(unpacked(first["rid"], np.int64)), keys, pa.array(np.ones(n, np.int64)),
                         *[pa.array(unpacked(first[x], k)) for x, k in (("n", np.int64), ("known", np.int64), ("base", np.float64))],
                         pa.array(logp)], names=["rid", "k", "rows", "n", "known", "base", "logp"])

    rare = model.known.where(~frequent)
    by_word = rare.select(F.col("h").alias("rw"), F.col("c").alias("wc"), F.col("ps").alias("wp"))
    by_context = rare.select(F.col("h").alias("ru"), F.col("c").alias("uc"), F.col("opens").alias("uo"))
    back = sum((F.coalesce(o, theta + d * F.col("uo")[i]) * F.coalesce(p, F.col("wp")[i])
                for i, (o, p) in enumerate(zip(opens, probs, strict=True))), F.lit(0.0)) / model.samples
    zero = F.lit(0).cast("long")
    parts = []
    for part in range(PARTS):
        dealt = source.mapInArrow(near(part), "bucket long, blk long, " + ", ".join(lines + heads))
        own = met[part].select(*PAIRS[:4]).mapInArrow(counted, "bucket long, key binary, own binary")
        single = model.single[part].select("bucket", F.col("single").alias("key"))
        sums = _all([dealt, own, single], allowMissingColumns=True).groupBy("bucket").applyInArrow(
            meet, "blk long, doc binary, " + ", ".join(heads))
        texts = settle(sums.groupBy("blk").applyInArrow(
            finish, f"rid long, k {kind}, rows long, n long, known long, base double, logp double"), f"near-{part}")
        parts.append(texts if part == 0 else texts.select("rid", F.lit(None).cast(kind).alias("k"), *(
            zero.alias(x) for x in ("rows", "n", "known")), F.lit(0.0).alias("base"), "logp"))
        rare_own = model.own_single(part, "rare_single").unionByName(model.own_many(model.many[part].where("rare = 1")))
        for turn in range(TURNS):
            apart = source.mapInArrow(far(part, turn), "rid long, key long, tf long, ru long, rw long, total double, " + ", ".join(
                f"{x} double" for x in (*opens, *probs))).join(by_word, "rw", "left").join(by_context, "ru", "left").select(
                "rid", "key", "tf", back.alias("back"), F.coalesce("total", theta + F.col("uc")).alias("total"),
                F.when(F.col("wc") > 0, F.col("tf")).otherwise(0).alias("known"),
                F.when(F.col("wc").isNotNull(), F.col("tf") * F.log10(F.col("wc") + 1)).otherwise(0.0).alias("base"))
            each = F.col("tf") * F.log10((F.coalesce("own", F.lit(0.0)) + F.col("back")) / F.col("total"))
            added = settle(apart.join(rare_own.select("key", "own"), "key", "left").groupBy("rid").agg(
                F.sum("known").alias("known"), F.sum("base").alias("base"), F.sum(each).alias("logp")), f"rare-{part}-{turn}")
            parts.append(added.select("rid", F.lit(None).cast(kind).alias("k"), zero.alias("rows"), zero.alias("n"), "known", "base", "logp"))
    whole = _all(parts).groupBy("rid").agg(F.max("k").alias("k"), *[
        F.sum(x).alias(x) for x in ("rows", "n", "known", "base", "logp")]).withColumn(
        "copy", F.explode(F.expr("array_repeat(0, int(rows))")))
    n = (F.col("n") / F.col("rows")).cast("long")
    denominator = float(np.log10(model.tokens + model.types + 1))
    return whole.select(F.col("k").alias(key), n.alias("n_tokens"), (F.col("known") / F.col("rows")).cast("long").alias("n_known"),
                        (F.col("base") / F.col("rows") - n * denominator).alias("base_score"),
                        (F.col("logp") / F.col("rows") if model.tokens else F.lit(0.0)).alias("score"))


def fit_and_score(docs: DataFrame, train: Column, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, Contexts]:
    """Scores of every row by a model of the rows where ``train`` holds."""
    model = fit_contexts(docs, train, text)
    return score(docs, model, key, text), model
