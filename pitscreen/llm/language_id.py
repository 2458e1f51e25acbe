"""Language identification by nearest centroids of TF-IDF n-gram vectors.

Features are hashed letter n-grams (1 to 3 letters, word ends included). A vector holds
log(1 + count) * idf, scaled to length 1. Document frequencies come from every training row. Each
language is clustered (spherical k-means, farthest-first start, no randomness) on a sample of
about ``sample`` of its training rows, whatever the corpus size; it may thus have several
centroids, for several kinds of text. A text gets the language of the centroid with the greatest
cosine; it is *rejected* when its distance to that centroid is beyond that cluster's radius
(three deviations above the mean distance of the cluster's own rows).

Cases: null texts and texts without a letter are ``und`` with score 0; without any labelled row
everything is ``und``; rows without a language are not learned from; ties between centroids go
to the first by language and cluster; repeated rows are predicted alike; an empty table gives
no rows; only key, text and language are read, so other columns cannot clash. A very long text is one
block: memory for its bytes and its n-grams.
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
from pitscreen.session import land

#: Buckets of the hashed n-grams.
FEATURES = 4096
TEXTS = 256
_TOP = 0x323B0  # beyond the last assigned letter

_lower: np.ndarray | None = None


def letter_codes() -> np.ndarray:
    """Per code point: the lower-case letter, or 0 if it is no letter."""
    global _lower
    if _lower is None:
        out = np.zeros(_TOP + 1, dtype=np.uint32)
        for c in range(_TOP):
            s = chr(c)
            if s.isalpha():
                low = s.lower()
                out[c] = ord(low) if len(low) == 1 else c
        _lower = out
    return _lower


def counts(b: grams.Block) -> tuple[np.ndarray, np.ndarray]:
    """n-gram counts of each text (texts x FEATURES), and its number of letters."""
    points = np.frombuffer(b.data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
    starts = np.concatenate([[0], np.cumsum((b.data & 0xC0) != 0x80)])[b.offsets]
    code = letter_codes()[np.minimum(points, _TOP)]
    text = np.repeat(np.arange(b.count), np.diff(starts))
    letters = np.bincount(text[code > 0], minlength=b.count)
    # letters with one 0 before each word, and one 0 at the end
    real = code > 0
    first = real.copy()
    first[1:] &= ~(real[:-1] & (text[1:] == text[:-1]))
    at = np.flatnonzero(real)
    shift = np.cumsum(first[at])
    n = len(at) + (int(shift[-1]) if len(at) else 0) + 1
    run = np.zeros(n, dtype=np.uint64)
    of = np.zeros(n, dtype=np.int64)
    place = np.arange(len(at)) + shift
    run[place] = code[at]
    of[place] = text[at]
    if not len(at):
        return np.zeros((b.count, FEATURES), dtype=np.float32), letters
    mid = place  # every letter is the middle of one window of three
    a, m, z = run[mid - 1], run[mid], run[mid + 1]
    keys = [m, a << np.uint64(21) | m | np.uint64(1 << 62), a << np.uint64(42) | m << np.uint64(21) | z]
    bucket = np.concatenate([(grams.mix(k) >> np.uint64(52)).astype(np.int64) for k in keys])
    flat = np.bincount(np.tile(of[mid], 3) * FEATURES + bucket, minlength=b.count * FEATURES)
    return flat.reshape(b.count, FEATURES).astype(np.float32), letters


def vectors(b: grams.Block, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    c, letters = counts(b)
    v = np.log1p(c) * idf
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    return v, letters


@dataclass
class Model:
    idf: np.ndarray
    langs: list[str]
    centroids: np.ndarray
    radius: np.ndarray


def _frequencies(train: DataFrame) -> tuple[int, np.ndarray]:
    """Rows with letters, and per feature the rows that have it; summed in Spark, FEATURES rows come back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(FEATURES + 1, dtype=np.int64)
        for batch in batches:
            for b in grams.blocks(batch.column(0), most=TEXTS):
                c, letters = counts(b)
                df[:FEATURES] += (c > 0).sum(axis=0)
                df[FEATURES] += int((letters > 0).sum())
        yield pa.RecordBatch.from_pydict({"f": np.arange(FEATURES + 1, dtype=np.int32), "n": df})

    rows = train.select("text").mapInArrow(run, "f int, n long").groupBy("f").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(FEATURES + 1, dtype=np.int64)
    for r in rows:
        df[r["f"]] = r["n"]
    return int(df[FEATURES]), df[:FEATURES]


def _clusters(v: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means: centroids and the radius of each cluster."""
    mean = v.mean(axis=0)
    chosen = [int(np.argmax(v @ mean))]
    while len(chosen) < min(k, len(v)):
        near = (v @ v[chosen].T).max(axis=1)
        chosen.append(int(np.argmin(near)))
    c = v[chosen]
    for _ in range(rounds):
        own = np.argmax(v @ c.T, axis=1)
        c = np.stack([v[own == j].mean(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    sim = v @ c.T
    own = np.argmax(sim, axis=1)
    dist = 1 - sim[np.arange(len(v)), own]
    radius = np.array([min(1.0, dist[own == j].mean() + 3 * dist[own == j].std() + 0.05) if (own == j).any() else 0.0
                       for j in range(len(c))])
    return c, radius


def fit(docs: DataFrame, train: Column, key: str = "doc_id", text: str = "text", lang: str = "lang",
        sample: int = 1500, clusters: int = 4) -> Model:
    """Learns from the rows where ``train`` holds and a language is given.

    Per language about ``sample`` rows are clustered (chosen by a hash of key and text; the
    languages a corpus names are few, and the model has ``clusters`` vectors for each).
    """
    rows = docs.where(train & col(lang).isNotNull()).select(
        col(key).cast("string").alias("key"), col(text).cast("string").alias("text"), col(lang).cast("string").alias("lang"))
    n, df = _frequencies(rows)
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
    sizes = land(rows.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    u = F.pmod(F.xxhash64("key", "text", F.lit(11)), F.lit(1 << 30)).cast("double") / float(1 << 30)
    chosen = rows.join(sizes, "lang").where(u * F.col("n") < sample).select("lang", "text")

    def cluster(table: pa.Table) -> pa.Table:
        parts = []
        for b in grams.blocks(table["text"], most=TEXTS):
            v, letters = vectors(b, idf)
            parts.append(v[letters > 0])
        v = np.concatenate(parts)
        v = v[np.lexsort(v[:, :4].T)] if len(v) else v
        c, radius = _clusters(v, clusters) if len(v) else (np.empty((0, FEATURES), np.float32), np.empty(0))
        return pa.table({"lang": pa.array([table["lang"][0].as_py()] * len(c), pa.string()),
                         "radius": pa.array(radius, pa.float64()),
                         "c": pa.array([x.astype("<f4").tobytes() for x in c], pa.binary())})

    found = sorted((r["lang"], r["radius"], bytes(r["c"])) for r in
                   chosen.groupBy("lang").applyInArrow(cluster, "lang string, radius double, c binary").collect())
    return Model(idf, [f[0] for f in found],
                 np.stack([np.frombuffer(f[2], "<f4") for f in found]) if found else np.empty((0, FEATURES), np.float32),
                 np.array([f[1] for f in found]))


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(key, lang_pred, score, rejected): nearest language, its cosine, and whether it is too far off."""
    names = np.array([*model.langs, "und"], dtype=object)

    def measure(texts: pa.Array) -> dict[str, np.ndarray | pa.Array]:
        lang, score, rejected = [], [], []
        for b in grams.blocks(texts, most=TEXTS):
            v, letters = vectors(b, model.idf)
            if len(model.langs):
                sim = v @ model.centroids.T
                best = np.argmax(sim, axis=1)
                top = np.clip(sim[np.arange(len(v)), best], 0, 1).astype(np.float64)
                far = 1 - top > model.radius[best]
            else:
                best, top, far = np.zeros(len(v), int), np.zeros(len(v)), np.ones(len(v), bool)
            none = (letters == 0) | (not model.langs)
            lang.append(np.where(none, len(model.langs), best))
            score.append(np.where(none, 0.0, top))
            rejected.append(none | far)
        flat = np.concatenate(lang) if lang else np.empty(0, int)
        return {"lang_pred": pa.array(names[flat].tolist(), pa.string()),
                "score": np.concatenate(score) if score else np.empty(0),
                "rejected": np.concatenate(rejected) if rejected else np.empty(0, bool)}

    keep = [key, *(keep or [])]
    found = map_text(docs, text, measure, [("lang_pred", T.StringType()), ("score", T.DoubleType()),
                                           ("rejected", T.BooleanType())], keep, "m")
    return found.select(*map(col, keep), "m.*")
