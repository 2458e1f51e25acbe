"""Document quality from a linear-chain conditional random field over lines.

Every line with a word is labelled good or bad. Its features are shares of symbols, capitals,
repeats and the like, with those of the line before and after. Forward-backward gives each line's
probability of being good; their mean, weighted by the lines' length, is the document's share of
good text, which a logistic function fitted on documents kept back turns into a probability.

Only documents have labels. Lines start with their document's label; then the lines of bad documents
that the field itself finds good are relabelled, and it is fitted again (bad pages hold good lines).

Cases: null texts and texts without words have no lines and a share of 0; without rows of both labels
every score is 0.5; a key labelled twice counts as its larger label; repeated rows score alike;
an empty table gives no rows; only key and text are read. A very long text is one block whose memory
grows with its lines (about 300 bytes a line).
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

FEATURES = ["symbols", "capitals", "exclaims", "bars", "same_word", "repeats", "repeated_line", "word_length",
            "n_words", "digits", "full_stop"]
WIDTH = 3 * len(FEATURES) + 3
KEPT_BACK = 0.25
SWEEPS = 2
STEPS = 60


def _set(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(chars)] = True
    return out


_SYMBOLS, _BARS, _EXCLAIMS, _DIGITS = _set(b"#*$%&<>"), _set(b"|"), _set(b"!"), _set(b"0123456789")
_UPPER, _LETTERS = _set(bytes(range(65, 91))), _set(bytes([*range(65, 91), *range(97, 123)]))
_ENDS = _set(b".!?:;\"')")


@dataclass
class Lines:
    """Lines of a block: features with neighbours, lengths in bytes of words, text of each line."""

    x: np.ndarray
    weight: np.ndarray
    text: np.ndarray
    count: int


def lines(b: grams.Block) -> Lines:
    w = b.words()
    start, end, text = b.spans(b.data != 0x0A)
    lo, hi = np.searchsorted(w.start, start), np.searchsorted(w.start, end)
    real = hi > lo
    start, end, text, lo, hi = start[real], end[real], text[real], lo[real], hi[real]
    n = (hi - lo).astype(float)

    def over(marks: np.ndarray, a: np.ndarray, z: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(marks, dtype=np.int64)])
        return (total[z] - total[a]).astype(float)

    def share(kind: np.ndarray, of: np.ndarray) -> np.ndarray:
        return over(kind[b.data], start, end) / np.maximum(of, 1)

    h = w.hashes()
    same = np.zeros(len(h), dtype=bool)
    same[1:] = (h[1:] == h[:-1]) & (w.text[1:] == w.text[:-1])
    gram, at = grams.windows(h, w.text, 3)
    order, new = grams.sorted_within(gram, w.text[at])
    run = np.cumsum(new) - 1
    twice = order[np.bincount(run, minlength=1)[run] > 1] if len(run) else order
    covered = np.zeros(len(h) + 2, dtype=bool)
    for k in range(3):
        covered[at[twice] + k] = True
    inside = np.repeat(np.arange(len(start)), end - start)
    content = b.data[np.arange(len(inside)) + np.repeat(start - (np.cumsum(end - start) - (end - start)), end - start)] \
        if len(start) else b.data[:0]
    key = grams.run_hashes(content, end - start)
    order, new = grams.sorted_within(key, text)
    run = np.cumsum(new) - 1
    again = np.zeros(len(start), dtype=bool)
    if len(run):
        again[order] = np.bincount(run)[run] > 1
    letters = over(_LETTERS[b.data], start, end)
    size = over(w.inside, start, end)
    x = np.stack([np.minimum(share(_SYMBOLS, n), 3), share(_UPPER, letters), np.minimum(share(_EXCLAIMS, n), 3),
                  share(_BARS, n), over(same, lo, hi) / n, over(covered[:len(h)], lo, hi) / n, again.astype(float),
                  np.minimum(size / n, 30) / 10, np.log1p(n) / 5, share(_DIGITS, size),
                  _ENDS[b.data[end - 1]].astype(float)], axis=1) if len(start) else np.empty((0, len(FEATURES)))
    return Lines(_with_neighbours(x, text), size, text, b.count)


def _with_neighbours(x: np.ndarray, text: np.ndarray) -> np.ndarray:
    """A line's own features, those of the line before and after, whether it is first or last, and 1."""
    if not len(x):
        return np.empty((0, WIDTH), dtype=np.float32)
    first = np.concatenate([[True], text[1:] != text[:-1]])
    last = np.concatenate([text[1:] != text[:-1], [True]])
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    before[first], after[last] = 0, 0
    return np.concatenate([x, before, after, first[:, None], last[:, None], np.ones((len(x), 1))], axis=1).astype(np.float32)


def _chains(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First line and number of lines of each text that has any, longest first."""
    first = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]])) if len(text) else np.empty(0, int)
    size = np.diff(np.append(first, len(text)))
    order = np.argsort(-size, kind="stable")
    return first[order], size[order]


def forward_backward(unary: np.ndarray, step: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals of each line (bad, good), expected transitions, and the log of all normalisers.

    All chains advance together, line by line; those that have ended drop out.
    """
    first, size = _chains(text)
    shift = unary.max(axis=1, keepdims=True) if len(unary) else unary
    e, t = np.exp(unary - shift), np.exp(step)
    alpha, beta, scale = np.empty_like(e), np.ones_like(e), np.ones(len(e))
    longest = int(size[0]) if len(size) else 0
    live = np.searchsorted(-size, -np.arange(1, longest + 1), side="right")
    for i in range(longest):
        at = first[:live[i]] + i
        a = e[at] if i == 0 else (alpha[at - 1] @ t) * e[at]
        scale[at] = a.sum(axis=1)
        alpha[at] = a / scale[at, None]
    pairs = np.zeros((2, 2))
    for i in range(longest - 2, -1, -1):
        at = first[:live[i + 1]] + i
        ahead = e[at + 1] * beta[at + 1] / scale[at + 1, None]
        beta[at] = ahead @ t.T
        pairs += (alpha[at].T @ ahead) * t
    return alpha * beta, pairs, float(np.log(scale).sum() + shift.sum())


@dataclass
class Model:
    weights: np.ndarray  # WIDTH x 2, the second column for good
    step: np.ndarray     # 2 x 2
    fitted: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def shares(self, found: Lines) -> np.ndarray:
        """Length-weighted probability of good lines, per text; 0 without lines."""
        good = forward_backward(found.x @ self.weights, self.step, found.text)[0][:, 1]
        total = np.bincount(found.text, weights=found.weight, minlength=found.count)
        return np.bincount(found.text, weights=found.weight * good, minlength=found.count) / np.maximum(total, 1e-9)


def train_field(x: np.ndarray, text: np.ndarray, label: np.ndarray, weight: np.ndarray) -> Model:
    """Maximum conditional likelihood with a ridge, by Adam; ``label`` is 0 or 1 for each line."""
    w, s = np.zeros((x.shape[1], 2)), np.zeros((2, 2))
    same = text[1:] == text[:-1]
    for _ in range(SWEEPS):
        seen = np.eye(2)[label]
        steps = np.zeros((2, 2))
        np.add.at(steps, (label[:-1][same], label[1:][same]), 1)
        m = [np.zeros_like(w), np.zeros_like(s)]
        v = [np.zeros_like(w), np.zeros_like(s)]
        for i in range(1, STEPS + 1):
            p, pairs, _ = forward_backward(x @ w, s, text)
            grad = [x.T @ (seen - p) / len(x) - 1e-4 * w, (steps - pairs) / len(x) - 1e-4 * s]
            for j, (value, g) in enumerate(zip((w, s), grad, strict=True)):
                m[j] = 0.9 * m[j] + 0.1 * g
                v[j] = 0.98 * v[j] + 0.02 * g * g
                value += 0.15 * (m[j] / (1 - 0.9 ** i)) / (np.sqrt(v[j] / (1 - 0.98 ** i)) + 1e-6)
        p = forward_backward(x @ w, s, text)[0]
        label = np.where((label == 0) & (p[:, 1] > 0.5), 1, label)
    return Model(w, s)


def fit(docs: DataFrame, labels: DataFrame, train: Column, label: str = "quality", key: str = "doc_id",
        text: str = "text", sample: int = 3000) -> Model | None:
    """Learns from about ``sample`` labelled rows of each class (as many as the smaller class has, if that is fewer).

    Line features are made where the texts are; one task then fits the field on the sample's lines.
    """
    chosen = labelled_sample(labels, label, train, sample, key)
    texts = docs.select(col(key).alias("key"), col(text).cast("string").alias("text")).join(F.broadcast(chosen), "key")

    def measure(column: pa.Array) -> dict[str, pa.Array]:
        xs, ws = [], []
        for b in grams.blocks(column):
            found = lines(b)
            cut = np.searchsorted(found.text, np.arange(b.count + 1))
            for lo, hi in zip(cut, cut[1:], strict=False):
                xs.append(found.x[lo:hi].astype("<f4").tobytes())
                ws.append(found.weight[lo:hi].astype("<f4").tobytes())
        return {"x": pa.array(xs, pa.binary()), "w": pa.array(ws, pa.binary())}

    rows = land(map_text(texts, "text", measure, [("x", T.BinaryType()), ("w", T.BinaryType())], ["key", "y", "u"], "m")
                .select("key", "y", "u", "m.*"), "line-features")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got).sort_by("key")
        y, u = t["y"].to_numpy(), t["u"].to_numpy()
        x = [np.frombuffer(r.as_py(), "<f4").reshape(-1, WIDTH) for r in t["x"]]
        w = [np.frombuffer(r.as_py(), "<f4") for r in t["w"]]

        def part(chosen: np.ndarray) -> Lines:
            return Lines(np.concatenate([x[i] for i in chosen]), np.concatenate([w[i] for i in chosen]).astype(float),
                         np.repeat(np.arange(len(chosen)), [len(x[i]) for i in chosen]), len(chosen))

        used, back = np.flatnonzero(u >= KEPT_BACK), np.flatnonzero(u < KEPT_BACK)
        if len(np.unique(y[used])) < 2 or len(np.unique(y[back])) < 2:
            return
        a, b = part(used), part(back)
        model = train_field(a.x.astype(float), a.text, y[used][a.text], a.weight)
        mean, dev, coef = logistic(model.shares(b)[:, None], y[back], np.ones(len(back)))
        yield pa.RecordBatch.from_pydict({"p": [np.concatenate([
            model.weights.ravel(), model.step.ravel(), mean, dev, coef]).astype("<f8").tobytes()]})

    found = rows.select("key", "y", "u", "x", "w").repartition(1).mapInArrow(learn, "p binary").collect()
    if not found:
        return None
    p = np.frombuffer(bytes(found[0]["p"]), "<f8")
    n = WIDTH * 2
    return Model(p[:n].reshape(WIDTH, 2), p[n:n + 4].reshape(2, 2), (p[n + 4:n + 5], p[n + 5:n + 6], p[n + 6:]))


def score(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score, good_share, n_lines) of every row."""

    def measure(texts: pa.Array) -> dict[str, np.ndarray]:
        share, n = [], []
        for b in grams.blocks(texts):
            found = lines(b)
            share.append(model.shares(found) if model else np.zeros(b.count))
            n.append(np.bincount(found.text, minlength=b.count))
        s = np.concatenate(share) if share else np.empty(0)
        return {"score": apply_logistic(s[:, None], model.fitted) if model else np.full(len(s), 0.5),
                "good_share": s, "n_lines": np.concatenate(n).astype(np.int64) if n else np.empty(0, np.int64)}

    found = map_text(docs, text, measure, [("score", T.DoubleType()), ("good_share", T.DoubleType()),
                                           ("n_lines", T.LongType())], [key], "m")
    return found.select(col(key), "m.*")
