"""Words, lines and n-grams of a whole Arrow batch at once, as flat numpy arrays.

A word is a run of bytes other than space and 0x09-0x0D. Since UTF-8 uses none of these
bytes inside a longer character, words of bytes are words of characters. Work is done in
blocks of whole texts of about ``BLOCK`` bytes; a longer text is a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20

_RADIX = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)

IS_WORD = np.ones(256, dtype=bool)
IS_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers = np.ones(1, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    """The first ``n`` powers of the radix, kept between calls up to a bounded length."""
    global _powers
    if len(_powers) >= n:
        return _powers[:n]
    out = np.full(max(n, 64), _RADIX, dtype=np.uint64)
    out[0] = 1
    out = np.multiply.accumulate(out)
    if n <= BLOCK:
        _powers = out
    return out[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finalises 64-bit hashes so that every bit depends on every input bit."""
    h = (h ^ (h >> np.uint64(30))) * _MIX
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


def run_hashes(data: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """64-bit hashes of consecutive runs of ``data``, all of them at least one byte long.

    About ``BLOCK`` bytes (or one longer run) are hashed at a time.
    """
    if not len(lens):
        return np.empty(0, dtype=np.uint64)
    ends = np.cumsum(lens)
    if len(data) <= BLOCK:
        return _hashes(data, lens, ends - lens)
    out, lo = [], 0
    while lo < len(lens):
        at = int(ends[lo] - lens[lo])
        hi = max(lo + 1, int(np.searchsorted(ends, at + BLOCK, side="right")))
        out.append(_hashes(data[at:int(ends[hi - 1])], lens[lo:hi], ends[lo:hi] - lens[lo:hi] - at))
        lo = hi
    return np.concatenate(out)


def _hashes(data: np.ndarray, lens: np.ndarray, first: np.ndarray) -> np.ndarray:
    at = np.arange(len(data), dtype=np.int64) - np.repeat(first, lens)
    value = (data.astype(np.uint64) + np.uint64(1)) * powers(int(lens.max()))[at]
    return mix(np.add.reduceat(value, first) ^ lens.astype(np.uint64))


@dataclass
class Words:
    """Words of a block: byte spans, the text they are in (0-based), and words per text."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    per_text: np.ndarray
    inside: np.ndarray

    def hashes(self, lower: bool = True) -> np.ndarray:
        raw = self.data[self.inside]
        return run_hashes(LOWER[raw] if lower else raw, self.end - self.start)

    def bytes_of(self, i: int) -> bytes:
        return self.data[self.start[i]:self.end[i]].tobytes()


@dataclass
class Block:
    """Texts ``first`` to ``first + count`` of a batch: their bytes and where each begins."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def count(self) -> int:
        return len(self.offsets) - 1

    def spans(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Maximal runs of marked bytes that do not cross texts: start, end, text."""
        cut = self.offsets[1:-1]
        cut = cut[cut < len(inside)]
        before = np.zeros(len(inside), dtype=bool)
        before[1:] = inside[:-1]
        before[cut] = False
        after = np.zeros(len(inside), dtype=bool)
        after[:-1] = inside[1:]
        after[cut[cut > 0] - 1] = False
        start = np.flatnonzero(inside & ~before)
        end = np.flatnonzero(inside & ~after) + 1
        return start, end, np.searchsorted(self.offsets, start, side="right") - 1

    def words(self) -> Words:
        inside = IS_WORD[self.data]
        start, end, text = self.spans(inside)
        return Words(self.data, start, end, text, np.bincount(text, minlength=self.count), inside)


def blocks(column: pa.Array, size: int = BLOCK, most: int = 1 << 16) -> Iterator[Block]:
    """The texts of a string column, nulls as empty texts, in blocks of at most ``most`` texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, dtype=np.int64)[column.offset:column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + size, side="right")) - 1
        hi = min(max(hi, lo + 1), lo + most, n)
        yield Block(lo, raw[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
        lo = hi


def windows(hashes: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``n``-word windows inside one text, and the index of their first word."""
    m = len(hashes) - n + 1
    if m < 1:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    at = np.flatnonzero(text[:m] == text[n - 1:])
    h = hashes[at]
    for k in range(1, n):
        h = mix(h + np.uint64(k)) * _RADIX + hashes[at + k]
    return mix(h), at


def sorted_within(keys: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by (group, key), and a mark on each row that differs from the one before.

    ``group`` must already ascend.
    """
    order = np.lexsort((keys, group))
    k, g = keys[order], group[order]
    new = np.ones(len(k), dtype=bool)
    new[1:] = (k[1:] != k[:-1]) | (g[1:] != g[:-1])
    return order, new


def shingle_sets(block: Block, n: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ``n``-word shingles of each text, lower-cased in A-Z: hash, text, words per text.

    A text of fewer than ``n`` words has its whole word sequence as one shingle; a text
    without words has none. Rows ascend by (text, hash).
    """
    words = block.words()
    h = words.hashes()
    gram, at = windows(h, words.text, n)
    text = words.text[at]
    for k in range(1, n):
        short = np.flatnonzero(words.per_text == k)
        if len(short):
            begin = np.searchsorted(words.text, short)
            part = h[begin]
            for j in range(1, k):
                part = mix(part + np.uint64(j)) * _RADIX + h[begin + j]
            gram = np.concatenate([gram, mix(part ^ np.uint64(k))])
            text = np.concatenate([text, short])
    order, new = sorted_within(gram, text)
    kept = order[new]
    return gram[kept], text[kept], words.per_text


def hash_column(column: pa.Array) -> np.ndarray:
    """64-bit hash of each value of a string column; an empty or null value is zero."""
    out = []
    for block in blocks(column):
        lens = np.diff(block.offsets)
        h = np.zeros(block.count, dtype=np.uint64)
        full = lens > 0
        h[full] = run_hashes(block.data, lens[full])
        out.append(h)
    return np.concatenate(out) if out else np.empty(0, np.uint64)
