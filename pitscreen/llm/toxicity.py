"""Toxicity by class-conditional Kneser-Ney models over characters (UTF-8 bytes).

Two interpolated Kneser-Ney models of order 4, one of toxic and one of ordinary text: an n-gram
keeps its count less a discount, what the discounts free goes to the next lower order in proportion to the
number of distinct followers of the context. An n-gram of a lower order counts by the number of distinct
bytes before it, so a run that is frequent in a single context is not taken for a common one. The lowest
orders (bigrams and bytes) are counted on both classes together. So an expression that is rare in both is judged by shared counts and says nothing about the class, while
inflected forms of a known one share their stem's n-grams. Being conditional on the characters
before, the models do not react to how many texts of a language a class happens to have.

The difference of the two log-likelihoods, divided by the length and by its square root, and its largest
value over a passage of ``PASSAGE`` bytes, divided likewise (one expression in a long text), are
turned into a probability by a logistic function that is fitted on labelled rows which the
counts have not seen.

Cases: null and empty texts have length-normalised differences of 0; without rows of both labels
every score is 0; keys labelled twice count as toxic if either label says so; repeated rows score
alike; an empty table gives no rows; only key and text are read. A very long text is one block: memory
for its bytes and about 100 bytes of codes for each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitscreen.llm import grams
from pitscreen.llm.frames import col, map_text
from pitscreen.llm.sampling import apply_logistic, labelled_sample, logistic
from pitscreen.session import land

ORDER = 4
DISCOUNT = 0.75
#: Bytes of a passage: the most toxic one of a text counts beside the whole.
PASSAGE = 60
#: log2 of the buckets for the n-grams of each order; orders 1 and 2 are exact.
BITS = {1: 8, 2: 16, 3: 19, 4: 20}
#: Share of the sample that is kept back for the calibration.
KEPT_BACK = 0.2

_FOLD = grams.LOWER.copy()
_FOLD[[0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0x20


def codes(b: grams.Block) -> tuple[list[np.ndarray], np.ndarray]:
    """Per order the bucket of the n-gram that ends at each byte, and each byte's position in its text."""
    x = _FOLD[b.data].astype(np.uint64)
    at = np.arange(len(x)) - np.repeat(b.offsets[:-1], np.diff(b.offsets))
    code, out = x, [x.astype(np.int64)]
    for k in range(2, ORDER + 1):
        older = np.zeros(len(x), dtype=np.uint64)
        older[k - 1:] = x[:len(x) - (k - 1)] if len(x) >= k else 0
        code = code | older << np.uint64(8 * (k - 1))
        whole = 8 * k <= BITS[k]
        out.append((code if whole else grams.mix(code) >> np.uint64(64 - BITS[k])).astype(np.int64))
    return out, at


@dataclass
class Model:
    """Tables by bucket: per class and order the discounted probability and the weight of the lower order."""

    shared: np.ndarray
    high: dict[tuple[int, int], np.ndarray]
    back: dict[tuple[int, int], np.ndarray]
    fitted: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def difference(self, b: grams.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log-likelihood of toxic less ordinary, its largest sum over a passage, and the scored characters, per text."""
        bucket, at = codes(b)
        text = np.repeat(np.arange(b.count), np.diff(b.offsets))
        i = np.flatnonzero(at >= 1)
        before = i - 1
        total = np.zeros(len(i))
        for c, sign in ((1, 1.0), (0, -1.0)):
            p = self.shared[bucket[1][i]].astype(np.float64)
            for k in range(3, ORDER + 1):
                deep = at[i] >= k - 1
                p = np.where(deep, self.high[k, c][bucket[k - 1][i]] + self.back[k, c][bucket[k - 2][before]] * p, p)
            total += sign * np.log(np.maximum(p, 1e-9))
        n = np.bincount(text[i], minlength=b.count)
        peak = np.zeros(b.count)
        some = np.flatnonzero(n)
        if len(some):
            first = (np.cumsum(n) - n)[text[i]]
            run = np.append(0.0, np.cumsum(total))
            passage = run[1:] - run[np.maximum(first, np.arange(len(i)) + 1 - PASSAGE)]
            peak[some] = np.maximum.reduceat(passage, (np.cumsum(n) - n)[some])
        return np.bincount(text[i], weights=total, minlength=b.count), peak, n

    def features(self, texts: pa.Array) -> np.ndarray:
        parts = []
        for b in grams.blocks(texts):
            d, peak, n = self.difference(b)
            n = np.maximum(n, 1)
            parts.append(np.stack([d / n, d / np.sqrt(n), peak / np.minimum(n, PASSAGE)], axis=1))
        return np.concatenate(parts) if parts else np.empty((0, 3))


def _counts(rows: DataFrame) -> DataFrame:
    """(k, y, ctx, gram, tail, n) by buckets, of rows (text, y); ``tail`` is the n-gram without its first byte."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = np.asarray(batch.column(1).to_numpy(zero_copy_only=False))
            found: dict[tuple[int, int], list] = {}
            for b in grams.blocks(batch.column(0)):
                bucket, at = codes(b)
                label = np.repeat(y[b.first:b.first + b.count], np.diff(b.offsets))
                for k in range(2, ORDER + 1):
                    for c in (0, 1):
                        i = np.flatnonzero((at >= k - 1) & (label == c))
                        code = bucket[k - 2][i - 1] << 40 | bucket[k - 1][i] << 20 | bucket[k - 2][i]
                        found.setdefault((k, c), []).append(np.unique(code, return_counts=True))
            for (k, c), parts in found.items():
                u, inv = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                n = np.bincount(inv, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)
                yield pa.RecordBatch.from_pydict({"k": np.full(len(u), k, np.int32), "y": np.full(len(u), c, np.int32),
                                                  "ctx": u >> 40, "gram": u >> 20 & 0xFFFFF, "tail": u & 0xFFFFF, "n": n})

    made = rows.select("text", "y").mapInArrow(run, "k int, y int, ctx long, gram long, tail long, n long")
    return made.groupBy("k", "y", "ctx", "gram", "tail").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, labels: DataFrame, train: Column, label: str = "toxic", key: str = "doc_id",
        text: str = "text", sample: int = 8000) -> Model:
    """Learns from about ``sample`` labelled rows of each class, or as many as the smaller class has.

    Likelihoods of two models compare only if both have seen about as much text: a larger ordinary class, taken
    whole, knows more of any text, toxic ones included.

    The tables have one number a bucket, so what comes back to the driver is bounded by ``BITS``.
    """
    chosen = labelled_sample(labels, label, train, sample, key)
    texts = docs.select(col(key).alias("key"), col(text).cast("string").alias("text")).join(F.broadcast(chosen), "key")
    seen = land(_counts(texts.where(F.col("u") >= KEPT_BACK)), "char-counts")

    # bigrams of both classes by the number of distinct bytes before, bytes below them likewise
    ends = np.zeros(1 << BITS[2])
    for r in seen.where("k = 2").select("gram").distinct().collect():
        ends[r["gram"]] = 1  # one that only begins texts has none before
    for r in seen.where("k = 3").groupBy("tail").agg(F.countDistinct("gram").alias("n")).collect():
        ends[r["tail"]] = r["n"]
    grid = ends.reshape(256, 256)  # row: the byte before, column: the byte
    row, kinds = grid.sum(axis=1, keepdims=True), (grid > 0).sum(axis=1, keepdims=True)
    column = (grid > 0).sum(axis=0).astype(float)
    unigram = (column + 0.5) / (column + 0.5).sum()
    bigram = (np.maximum(grid - DISCOUNT, 0) + DISCOUNT * kinds * unigram) / np.maximum(row, 1)
    bigram = np.where(row > 0, bigram, unigram)

    before = seen.where(F.col("k").between(4, ORDER)).groupBy((F.col("k") - 1).alias("k"), "y", F.col("tail").alias("gram")).agg(
        F.countDistinct("gram").alias("before"))
    counted = seen.where("k > 2").groupBy("k", "y", "ctx", "gram").agg(F.sum("n").alias("n")).join(
        before, ["k", "y", "gram"], "left").withColumn(
        "n", F.when(F.col("k") == ORDER, F.col("n")).otherwise(F.coalesce("before", F.lit(1)))).drop("before")
    counted = land(counted, "char-continuations")
    context = counted.groupBy("k", "y", "ctx").agg(F.sum("n").alias("d"), F.count("*").alias("kinds"))
    high = (counted.join(context, ["k", "y", "ctx"])
            .groupBy("k", "y", "gram").agg(F.sum(F.greatest(F.col("n") - DISCOUNT, F.lit(0.0)) / F.col("d")).alias("p")))
    model = Model(bigram.ravel().astype(np.float32), {}, {})
    for k in range(3, ORDER + 1):
        for c in (0, 1):
            model.high[k, c] = np.zeros(1 << BITS[k], dtype=np.float32)
            model.back[k, c] = np.ones(1 << BITS[k - 1], dtype=np.float32)
            at = high.where((F.col("k") == k) & (F.col("y") == c)).select("gram", "p").toArrow()
            model.high[k, c][at["gram"].to_numpy()] = at["p"].to_numpy()
            at = context.where((F.col("k") == k) & (F.col("y") == c)).select(
                "ctx", (F.col("kinds") * DISCOUNT / F.col("d")).alias("w")).toArrow()
            model.back[k, c][at["ctx"].to_numpy()] = np.minimum(at["w"].to_numpy(), 1.0)

    kept = map_text(texts.where(F.col("u") < KEPT_BACK), "text", lambda t: _columns(model.features(t)),
                    [(x, T.DoubleType()) for x in "abc"], ["y"], "m").select("y", "m.*").toPandas()
    if kept["y"].nunique() == 2:
        y = kept["y"].to_numpy()
        sizes = {r["y"]: r["count"] for r in labels.where(train & col(label).isin(0, 1)).groupBy(
            col(label).cast("int").alias("y")).count().collect()}
        heavier = np.sqrt(sizes[0] / sizes[1])
        model.fitted = logistic(kept[["a", "b", "c"]].to_numpy(), y, np.where(y == 0, max(heavier, 1.0), max(1 / heavier, 1.0)))
    return model


def _columns(x: np.ndarray) -> dict[str, np.ndarray]:
    return {"a": x[:, 0], "b": x[:, 1], "c": x[:, 2]}


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score, per_char): probability of toxicity, and the log-likelihood difference per character."""

    def measure(texts: pa.Array) -> dict[str, np.ndarray]:
        x = model.features(texts)
        return {"score": apply_logistic(x, model.fitted) if model.fitted else np.zeros(len(x)), "per_char": x[:, 0]}

    found = map_text(docs, text, measure, [("score", T.DoubleType()), ("per_char", T.DoubleType())], [key], "m")
    return found.select(col(key), "m.*")
