"""Secret scans: fixed patterns, and guess costs of values that stand in a credential context.

The cost of a value is the least log10 number of guesses over all ways to cut it into
dictionary words, dates, repeats, keyboard walks and brute-force characters (dynamic
programming over its positions). The dictionary holds fixed passwords and, ranked by how often they occur, the
plain words of all documents. A value in a credential context that costs at least
``threshold`` is a secret, whatever its alphabet; cheap ones (``password=password1``) are not.

Cases: a null or empty text has no spans; ties in cost go to the earlier cut, which does not
change the cost; repeated rows are scanned alike; an empty table gives no rows; only key and text are
read, so other columns cannot clash. A very long text is scanned whole; the programme's memory grows
with the longest value after a keyword, not with the text.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitscreen.llm import grams
from pitscreen.llm.frames import col, map_text, settle

KINDS = ["assign", "access", "hex", "guess"]
#: log10 of the guesses from which a value counts as a secret.
THRESHOLD = 8.0

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|auth(?:orization)?|(?:api|access|private)[_-]?key)"""
    r"""["']?[\x20\t]*(?:=>|[:=])[\x20\t]*(?:bearer\x20+)?["']?([^\x20\x09-\x0D"'<>,;]{6,})"""
    r"""|\bbearer\x20+([A-Za-z0-9._~+/=-]{6,})|://[^\x20\x09-\x0D/:@]*:([^\x20\x09-\x0D/@]{6,})@""", re.I | re.A)

#: What has to occur, in lower case, where one of the text patterns can match.
STEMS = (b"pass", b"pwd", b"secret", b"token", b"credential", b"auth", b"key", b"bearer", b"://")
NEAR = re.compile(rb"""[a-z_-]*["']?[ \t]*(?:=>|[:=])|earer |//""")

# Common passwords and their parts, the most common first.
COMMON = """password admin user login pass letmein welcome dragon monkey master shadow hello secret love god
 sunshine princess football baseball superman batman iloveyou trustno michael jordan jennifer hunter ranger
 charlie thomas robert daniel andrew joshua george summer winter spring autumn monday friday january july
 august october november december flower cheese coffee cookie banana orange purple yellow silver golden green
 black white blue red computer internet server system database network security private public default guest
 root test testing demo example sample changeme temp access account office company home house family mother
 father brother sister friend forever always angel baby money power magic star tiger lion eagle horse dolphin
 soccer hockey tennis music guitar rock metal pepper ginger maggie buster killer freedom liberty phoenix
 matrix ninja knight wizard token key auth api service client""".split()
RANK = {w: i + 1 for i, w in enumerate(COMMON)}
LEET = str.maketrans("4@8(3!1$5076", "aabceiissott")
#: Corpus words that enter the dictionary: at least one in SHARE of all and LEAST times, at most so many bytes long.
SHARE, LEAST, LONGEST_BYTES = 1 << 16, 5, 24

# Keys in rows, and alphabets that are typed as runs.
ROWS = ["1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./"]
PLACE = {c: (r, i) for r, row in enumerate(ROWS) for i, c in enumerate(row)}
RUNS = ["abcdefghijklmnopqrstuvwxyz"]


def _neighbours() -> dict[str, set[str]]:
    near = {a: {b for b, (s, j) in PLACE.items() if a != b and abs(r - s) <= 1 and abs(i - j) <= 1}
            for a, (r, i) in PLACE.items()}
    for run in RUNS + ["0123456789"]:
        for a, b in zip(run, run[1:], strict=False):
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    return near


NEXT_TO = _neighbours()
DATES = [re.compile(p) for p in (
    r"(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])",
    r"(?:0?[1-9]|[12]\d|3[01])([-/._]?)(?:0?[1-9]|1[0-2])\1(?:19|20)\d\d",
    r"(?:19|20)\d\d")]


def _alphabet(value: str) -> float:
    """log10 of the size of the smallest usual alphabet that holds the value."""
    for pattern, size in (("[0-9]+", 10), ("[0-9a-f]+", 16), ("[0-9A-F]+", 16), ("[a-z]+", 26), ("[a-z0-9]+", 36),
                          ("[A-Za-z0-9]+", 62)):
        if re.fullmatch(pattern, value, re.A):
            return math.log10(size)
    return math.log10(95)


def _way(a: str, b: str) -> tuple[int, int]:
    """The direction of one step of a walk."""
    (r, i), (s, j) = PLACE.get(a, (0, 0)), PLACE.get(b, (0, 0))
    return (0, ord(b) - ord(a)) if abs(ord(b) - ord(a)) == 1 else (s - r, j - i)


class Words:
    """Ranks of dictionary words: the fixed ones first, then others as they are given."""

    def __init__(self, more: Iterable[str] = ()):
        self.rank = dict(RANK)
        for word in more:
            self.rank.setdefault(word, len(self.rank) + 1)
        self.longest = max(map(len, self.rank))


FIXED = Words()


def _cheapest(front: list[tuple[int, float]], j: int) -> float:
    """The least of ``a + log10(j - i)`` over a front of (i, a), in ascending order of i.

    What an earlier place has over a later one only grows with j, so a later one that is no better goes for good.
    """
    least, kept = math.inf, 0
    for i, a in front:
        cost = a + math.log10(j - i)
        if cost < least:
            least = cost
            front[kept] = (i, a)
            kept += 1
    del front[kept:]
    return least


@lru_cache(maxsize=4096)
def guess_cost(value: str, words: Words = FIXED) -> float:
    """log10 of the guesses that the cheapest cut of ``value`` needs; 0 for an empty value.

    Every cut counts; each one into another piece costs 0.3 (a factor of two for where the pieces meet). A
    word costs its rank, capitals and swapped letters; a walk where it starts, how long it is, and a factor of
    two for each change of direction; a repeat its period (up to 16) and how often it comes. Of walks
    and repeats only those beginnings are kept that can still be the cheapest, so time and memory grow about linearly.
    """
    if not value:
        return 0.0
    unit = _alphabet(value)
    n, low = len(value), value.lower()
    if len(low) != n:  # a letter whose small form is longer
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    plain = low.translate(LEET)
    best = [0.0] + [math.inf] * n
    joined = lambda i: best[i] + (0.3 if i else 0.0)
    walks: list[tuple[int, float]] = []
    turned = [0] * n  # per step of a walk, changes of direction up to it
    steps, last = 0, None
    periods = range(1, min(16, n // 2) + 1)
    alike = [0] * (len(periods) + 1)  # per period, how many characters so far equal the one a period before
    repeats: dict[tuple[int, int], list[tuple[int, float]]] = {}

    for j in range(n + 1):
        if j:
            best[j] = min(best[j], best[j - 1] + unit)
        if j > 1:
            if low[j - 1] in NEXT_TO.get(low[j - 2], ()):
                way = _way(low[j - 2], low[j - 1])
                turned[j - 2] = turned[j - 3] + (way != last) if steps else 0
                steps, last = steps + 1, way
            else:
                steps = 0
                walks.clear()
            if steps >= 2:
                walks.append((j - 3, joined(j - 3) - 0.3 * turned[j - 3] + math.log10(47)))
                best[j] = min(best[j], _cheapest(walks, j) + 0.3 * turned[j - 2])
        for period in periods:
            if j <= period:
                break
            if value[j - 1] != value[j - 1 - period]:
                if alike[period]:
                    alike[period] = 0
                    for part in range(period):
                        repeats.pop((period, part), None)
                continue
            alike[period] += 1
            shortest = max(3, 2 * period)
            if alike[period] >= shortest - period:
                i = j - shortest
                # starts of one remainder, as pieces are whole periods
                repeats.setdefault((period, i % period), []).append((i, joined(i) + period * unit - math.log10(period)))
                best[j] = min(best[j], _cheapest(repeats[period, i % period], j))
        for k in range(j + 3, min(n, j + words.longest) + 1):
            rank = words.rank.get(plain[j:k])
            if rank:
                swaps = sum(a != b for a, b in zip(low[j:k], plain[j:k], strict=True))
                capital = 0.0 if value[j:k] == low[j:k] else 0.3 if value[j + 1:k] == low[j + 1:k] else 0.6
                best[k] = min(best[k], joined(j) + math.log10(rank + 1) + capital + 0.3 * swaps)
        for pattern in DATES:
            m = pattern.match(value, j)
            if m:
                cost = math.log10(100 if m.end() - j == 4 else 36_500) + (0.6 if m.lastindex and m[1] else 0)
                best[m.end()] = min(best[m.end()], joined(j) + cost)
    return best[-1]


def spans_of(text: str, threshold: float = THRESHOLD, words: Words = FIXED) -> list[tuple[str, int, int, str, float | None]]:
    """(kind, start, end, value, cost) of one text, in code points, by start and kind."""
    out: list[tuple[str, int, int, str, float | None]] = []
    for m in ASSIGN.finditer(text):
        if len(m[2]) >= 6:
            out.append(("assign", m.start(), m.end(), m[2], guess_cost(m[2], words)))
    out += [("access", m.start(), m.end(), m[0], None) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [("hex", m.start(), m.end(), m[0], None) for m in HEX.finditer(text)]
    for m in CONTEXT.finditer(text):
        cost = guess_cost(m[m.lastindex], words)
        if cost >= threshold:
            out.append(("guess", *m.span(m.lastindex), m[m.lastindex], cost))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _bytes(chosen: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(chosen)] = True
    return out


_HEX = _bytes(b"0123456789abcdef")
_LETTER = _bytes(bytes([*range(65, 91), *range(97, 123), *range(128, 256)]))
_BEFORE, _AFTER = _bytes(b" \t\n\r([\"'"), _bytes(b" \t\n\r.,;:!?)]\"'")
_QUIET, _ASSIGNS = _bytes(b" \t\n\r\"'"), _bytes(b":=>@/")


def candidates(b: grams.Block) -> np.ndarray:
    """The texts of a block in which any pattern can match, found without decoding them."""
    where: list[int] = []
    raw, low = b.data.tobytes(), grams.LOWER[b.data].tobytes()
    at = raw.find(b"AKIA")
    while at >= 0:
        where.append(at)
        at = raw.find(b"AKIA", at + 1)
    for stem in STEMS:
        at = low.find(stem)
        while at >= 0:
            if NEAR.match(low, at + 1):
                where.append(at)
            at = low.find(stem, at + 1)
    start, end, text = b.spans(_HEX[b.data])
    found = np.searchsorted(b.offsets, np.array(where, dtype=np.int64), side="right") - 1
    return np.unique(np.concatenate([found, text[end - start >= 24]]))


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()),
                     T.StructField("end", T.LongType()), T.StructField("value", T.StringType()),
                     T.StructField("log10_guesses", T.DoubleType())])
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
                             ("value", pa.string()), ("log10_guesses", pa.float64())]))
_FIELDS = SPAN.fieldNames()


def _letters(b: grams.Block) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the plain words of a block: letters between spaces or marks of prose, not after ``:`` or ``=``."""
    start, end, text = b.spans(_LETTER[b.data])
    lens = end - start
    first, last = start == b.offsets[text], end == b.offsets[text + 1]
    open_ = first | _BEFORE[b.data[np.maximum(start - 1, 0)]]
    shut = last | _AFTER[b.data[np.minimum(end, len(b.data) - 1)]] if len(b.data) else last
    said = np.flatnonzero(~_QUIET[b.data])
    at = np.searchsorted(said, start) - 1
    before = said[np.maximum(at, 0)] if len(said) else np.zeros(len(start), np.int64)
    value = (at >= 0) & (before >= b.offsets[text]) & _ASSIGNS[b.data[before]] if len(said) else np.zeros(len(start), bool)
    kept = open_ & shut & ~value & (lens >= 3) & (lens <= LONGEST_BYTES)
    return start[kept], end[kept]


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n): how often each plain word occurs in all texts, lower-cased in A-Z."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in grams.blocks(batch.column(0), 16 << 20):
                start, end = _letters(b)
                if not len(start):
                    continue
                lens = end - start
                at = np.cumsum(lens) - lens
                raw = grams.LOWER[b.data[np.arange(int(lens.sum())) + np.repeat(start - at, lens)]]
                _, once, n = np.unique(grams.run_hashes(raw, lens), return_index=True, return_counts=True)
                words = pa.array([raw[at[i]:at[i] + lens[i]].tobytes() for i in once], pa.binary())
                yield pa.RecordBatch.from_arrays([words, pa.array(n, pa.int64())], ["word", "n"])

    found = docs.select(col(text).cast("string").alias("x")).mapInArrow(run, "word binary, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def dictionary(docs: DataFrame, text: str = "text", share: int = SHARE, least: int = LEAST) -> Words:
    """The fixed words, and words of the corpus by how often they occur (ties by the word).

    Counts cover all texts. A word enters if it makes up at least one in ``share`` of all plain words, so at most
    ``share`` words do, whatever the corpus, and occurs ``least`` times. What stands where a value stands is
    not counted, so a secret does not become a word by being copied.
    """
    counts = settle(word_counts(docs, text), "plain-words")
    total = counts.agg(F.sum("n")).first()[0] or 0
    rows = counts.where((F.col("n") * share >= total) & (F.col("n") >= least)).toArrow().to_pylist()
    return Words(r["word"].decode("utf-8", "replace") for r in sorted(rows, key=lambda r: (-r["n"], r["word"])))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD,
         words: Words | None = None) -> DataFrame:
    """The key of every document and ``spans``, an array of (kind, start, end, value, log10_guesses).

    ``words`` is the dictionary of the guess costs: that of ``docs``, unless one is given.
    """
    words = words or dictionary(docs, text)
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def measure(texts: pa.Array) -> dict[str, pa.Array]:
        rows: list[list] = [[]] * len(texts)
        for b in grams.blocks(texts):
            for i in candidates(b):
                s = b.data[b.offsets[i]:b.offsets[i + 1]].tobytes().decode("utf-8", "replace")
                rows[b.first + i] = [dict(zip(_FIELDS, span, strict=True)) for span in spans_of(s, threshold, shared.value)]
        return {"spans": pa.array(rows, type=_ARROW)}

    found = map_text(docs, text, measure, [("spans", T.ArrayType(SPAN))], [key], "m")
    return found.select(col(key), "m.spans")


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def listed(spans: Column, *kinds: str) -> Column:
    """``kind:start:end`` of the spans of some kinds, comma-joined."""
    chosen = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
