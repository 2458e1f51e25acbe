"""Alignment of two tokenizers over the same text.

Byte offsets at which a token of A and a token of B both end cut the tokens of a text into groups.
Every token points to the farthest-right token of the other side that overlaps it (an A token that
ends together with a B token points to itself); doubling the pointers until they stand still takes
each token to the last A token of its group, which names the group.

Both tokenizers treat a text as independent units, cut before a space that follows a character
other than white space: A's pre-tokens end there, and no piece of B has a space after anything
else (checked when the vocabulary is read). So no token and no group crosses units, each distinct
unit of a batch is encoded and aligned once, and a text of any length needs memory for its bytes and
its list of units. Only a run without spaces is one unit, however long.

Texts are read and aligned once, in a pass that keeps every text's links, packed; corpus-wide counts of
linked id pairs and what they add up to for each text come from these. Of the pair table (bounded by the product
of the vocabularies, 10^9 rows) the most frequent ``hot`` rows are broadcast; links of the other
pairs are shuffled by pair and summed back for each row.

Cases: a null or empty text, and one whose joined token bytes differ from the text (B writes U+2581
as a space, bytes that are not UTF-8), has no tokens: zeros and an empty digest, and it adds nothing to the
counts; repeated rows count as often as they occur; an empty table gives an empty result; only key
and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitscreen.llm import grams
from pitscreen.llm.frames import col, settle

#: Id pairs that are broadcast with their counts (17 bytes each); links of all others are shuffled.
HOT = 2_000_000
#: Bytes of text that are aligned together, and units that are encoded in one call.
BLOCK, CALL = 6 << 20, 20_000
#: Links whose counts a task gathers before it passes them on, and links that are looked up together.
PENDING, LOOKUP = 4_000_000, 1 << 20
#: Links up to which a text keeps each; a text with more keeps its distinct pairs and how often each occurs.
LONG = 1 << 16

STATS = ["n_a", "n_b", "n_groups", "n_links"]


@dataclass
class Side:
    """One vocabulary: an encoder of units and the bytes of each id, laid end to end."""

    encode: object
    flat: np.ndarray
    first: np.ndarray
    size: np.ndarray

    @classmethod
    def of(cls, encode, entries: list[bytes]) -> Side:
        size = np.array([len(e) for e in entries], dtype=np.int64)
        return cls(encode, np.frombuffer(b"".join(entries), np.uint8), np.cumsum(size) - size, size)

    def __len__(self) -> int:
        return len(self.size)


def pick(flat: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Slices of ``flat``, end to end."""
    step = np.arange(int(size.sum()), dtype=np.int64) - np.repeat(np.cumsum(size) - size, size)
    return flat[np.repeat(first, size) + step]


def flattened(found: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Lists of ids end to end, and the length of each."""
    n = np.fromiter(map(len, found), np.int64, len(found))
    return np.fromiter(chain.from_iterable(found), np.int64, int(n.sum())), n


def _byte_letters() -> dict[str, int]:
    """The byte of each letter of a byte-level vocabulary: itself if printable, else from 256 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@lru_cache(maxsize=2)
def byte_level(path: str) -> Side:
    """A byte-level vocabulary of the tokenizers library."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        text = f.read()
    spec, whole = json.loads(text), Tokenizer.from_str(text)
    pre = spec.get("pre_tokenizer") or {}
    if spec.get("normalizer") or pre.get("type") != "ByteLevel" or not pre.get("use_regex") or pre.get("add_prefix_space"):
        raise ValueError("the vocabulary must be byte-level, with its own pattern and without a normaliser")
    whole.encode_special_tokens = True
    letters = _byte_letters()
    entries = [b""] * whole.get_vocab_size()
    special = {t["id"] for t in spec["added_tokens"]}
    for token, i in whole.get_vocab().items():
        entries[i] = token.encode() if i in special else bytes(letters[c] for c in token)

    def each(units: list[bytes]) -> list[list[int]]:
        text = [u.decode("utf-8", "replace") for u in units]
        return [e.ids for e in whole.encode_batch_fast(text, add_special_tokens=False)]

    def encode(units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Units laid end to end, in one call, which costs less.

        Where a token ends at each unit's end, no merge has crossed it, so the ids are those of each
        unit alone; else (a unit of white space before one of several spaces) each is encoded alone.
        """
        try:
            ids = whole.encode_batch_fast([b"".join(units).decode()], add_special_tokens=False)[0].ids
        except UnicodeDecodeError:
            return flattened(each(units))
        ids = np.array(ids, dtype=np.int64)
        ends = np.cumsum(side.size[ids])
        unit_ends = np.cumsum(np.fromiter(map(len, units), np.int64, len(units)))
        at = np.minimum(np.searchsorted(ends, unit_ends), len(ends) - 1)
        if not np.array_equal(ends[at], unit_ends):
            return flattened(each(units))
        return ids, np.diff(at, prepend=-1)

    side = Side.of(encode, entries)
    return side


@lru_cache(maxsize=2)
def pieces(path: str) -> Side:
    """A piece vocabulary of the sentencepiece library that keeps texts as they are and adds a space in front."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    entries = []
    for i in range(p.get_piece_size()):
        piece = p.id_to_piece(i)
        if p.is_byte(i):
            entries.append(bytes([int(piece[3:5], 16)]))
            continue
        if "▁" in piece.lstrip("▁"):
            raise ValueError(f"piece {i} has a space inside: units cannot be encoded on their own")
        entries.append(piece.replace("▁", " ").encode())
    if "".join(p.encode(" a  b ", out_type=str)) != "▁▁a▁▁b▁":
        raise ValueError("the vocabulary must keep white space and add one space in front")
    alone = [p.piece_to_id("▁")]  # a last unit of one space: the library adds none to an empty text

    def encode(units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = p.encode([u[1:].decode("utf-8", "replace") for u in units], num_threads=1)
        return flattened([ids or alone for ids in found])

    return Side.of(encode, entries)


def terminals(ends_a: np.ndarray, ends_b: np.ndarray) -> np.ndarray:
    """For the A tokens and then the B tokens: the last A token of the group, by pointer jumping.

    Ends ascend, and both sides end together.
    """
    n = len(ends_a)
    over = np.searchsorted(ends_b, ends_a)
    far = np.concatenate([np.where(ends_b[over] > ends_a, n + over, np.arange(n)), np.searchsorted(ends_a, ends_b)])
    while True:
        jump = far[far]
        if np.array_equal(jump, far):
            return far
        far = jump


@dataclass
class Units:
    """Distinct units of a block: tokens of each side and links, end to end, and where those of each unit begin."""

    good: np.ndarray
    a: np.ndarray
    b: np.ndarray
    of_a: np.ndarray
    of_b: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray
    codes: np.ndarray
    of_link: np.ndarray

    def __len__(self) -> int:
        return len(self.good)


def _ids(side: Side, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all units, and how many each has."""
    out = [side.encode(units[lo:lo + CALL]) for lo in range(0, len(units), CALL)]
    return (np.concatenate([x for x, _ in out]), np.concatenate([n for _, n in out])) if out else (np.empty(0, np.int64),) * 2


def align_units(units: list[bytes], a: Side, b: Side) -> Units:
    """Tokens, groups and links of distinct units."""
    size = np.fromiter(map(len, units), np.int64, len(units))
    raw = np.frombuffer(b"".join(units), np.uint8)
    first = np.cumsum(size) - size
    good, tokens = np.ones(len(units), bool), []
    for side in (a, b):
        ids, n = _ids(side, units)
        of = np.repeat(np.arange(len(units)), n)
        same = np.bincount(of, weights=side.size[ids], minlength=len(units)).astype(np.int64) == size
        ids_same = ids[same[of]]
        joined = pick(side.flat, side.first[ids_same], side.size[ids_same])
        differs = joined != (raw if same.all() else pick(raw, first[same], size[same]))
        if differs.any():
            same[np.repeat(np.flatnonzero(same), size[same])[differs]] = False
        del joined, differs
        good &= same
        tokens.append((ids, of))
    (ids_a, of_a), (ids_b, of_b) = ((ids[good[of]], of[good[of]]) for ids, of in tokens)
    ends_a, ends_b = np.cumsum(a.size[ids_a]), np.cumsum(b.size[ids_b])
    last = terminals(ends_a, ends_b)
    group = np.cumsum(last[:len(ids_a)] == np.arange(len(ids_a)))  # groups that have ended, this one included
    group = np.concatenate([[0], group])
    cut = np.sort(np.concatenate([ends_a, ends_b]), kind="stable")  # one link ends at each end of a token
    cut = cut[np.diff(cut, prepend=0) > 0]
    at_a = np.searchsorted(ends_a, cut)
    codes = ids_a[at_a] * len(b) + ids_b[np.searchsorted(ends_b, cut)]
    return Units(good, ids_a, ids_b, of_a, of_b, group[last[:len(ids_a)]], group[last[len(ids_a):]], codes, of_a[at_a])


def group_texts(u: Units) -> list[bytes]:
    """``a1,a2|b1;a3|b2,b3;`` of each unit."""
    n = int(u.group_a[-1]) + 1 if len(u.a) else 0
    na, nb = np.bincount(u.group_a, minlength=n), np.bincount(u.group_b, minlength=n)
    ids = np.empty(len(u.a) + len(u.b), np.int64)
    mark = np.full(len(ids), ord(","), np.uint8)
    place_a = np.arange(len(u.a)) + (np.cumsum(nb) - nb)[u.group_a]
    place_b = np.arange(len(u.b)) + np.cumsum(na)[u.group_b]
    ids[place_a], ids[place_b] = u.a, u.b
    if n:
        mark[place_a[np.cumsum(na) - 1]] = ord("|")
        mark[place_b[np.cumsum(nb) - 1]] = ord(";")
    digits = 1 + sum((ids >= 10 ** k).astype(np.int64) for k in range(1, 10))
    ends = np.cumsum(digits + 1)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    if len(ends):
        out[ends - 1] = mark
        rest, k = ids.copy(), 0
        while True:
            has = digits > k
            if not has.any():
                break
            out[ends[has] - 2 - k] = ord("0") + rest[has] % 10
            rest //= 10
            k += 1
    of = np.empty(len(ids), np.int64)
    of[place_a], of[place_b] = u.of_a, u.of_b
    total = np.bincount(of, weights=digits + 1, minlength=len(u)).astype(np.int64)
    cut = np.concatenate([[0], np.cumsum(total)]).tolist()
    raw = out.tobytes()
    return [raw[i:j] for i, j in zip(cut, cut[1:], strict=False)]


_WIDE = np.zeros(256, bool)
_WIDE[[0xE1, 0xE2, 0xE3]] = True


def unit_starts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where units begin: at ``starts``, and at spaces after a character that is surely no white space."""
    before = np.zeros(len(data), bool)
    before[1:] = (data[:-1] > 0x20) & (data[:-1] != 0x7F)
    high = np.flatnonzero(data[:-1] >= 0x80) + 1  # white space beyond ASCII is C2 xx or E1/E2/E3 xx xx
    before[high] = (data[np.maximum(high - 2, 0)] != 0xC2) & ~_WIDE[data[np.maximum(high - 3, 0)]]
    cut = (data == 0x20) & before
    cut[starts[starts < len(data)]] = True
    return np.flatnonzero(cut)


class Batch:
    """Texts of a block as rows of distinct units."""

    def __init__(self, block: grams.Block, a: Side, b: Side):
        starts = unit_starts(block.data, block.offsets[:-1]) if len(block.data) else np.empty(0, np.int64)
        ends = np.append(starts, len(block.data)).astype(np.int64)
        found = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(block.data)])
        coded = found.dictionary_encode()
        self.units = align_units(coded.dictionary.to_pylist(), a, b)
        self.which = coded.indices.to_numpy(zero_copy_only=False)
        self.cut = np.searchsorted(starts, block.offsets)

    def per_text(self, of_unit: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(of_unit[self.which])])
        return total[self.cut[1:]] - total[self.cut[:-1]]

    def kept(self, full: np.ndarray) -> np.ndarray:
        """Texts that have tokens: not empty, and every unit as it was."""
        return full & (self.per_text((~self.units.good).astype(np.int64)) == 0)


def batches(column: pa.Array, a: Side, b: Side) -> Iterator[tuple[Batch, np.ndarray]]:
    """Blocks of a string column with a space in front of each text, and which texts have tokens."""
    column = column.cast(pa.large_string())
    length = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    spaced = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), column, pa.scalar("", pa.large_string()))
    for block in grams.blocks(spaced, BLOCK):
        batch = Batch(block, a, b)
        yield batch, batch.kept(length[block.first:block.first + block.count] > 0)
        del batch  # gone before the next is made


# Links ---------------------------------------------------------------------------------------

def code_kind(a: Side, b: Side) -> np.dtype:
    """The type of a pair's code, A's id times the size of B's vocabulary plus B's id."""
    return np.dtype("<u4" if len(a) * len(b) <= 1 << 32 else "<i8")


def _rows(batch: Batch, kept: np.ndarray, kind: np.dtype, most: int) -> list[pa.Array]:
    """The columns of ``linked`` after the key, of a block's texts; up to ``most`` links of a text are kept one by one."""
    u, n = batch.units, len(batch.units)
    ended = np.concatenate([u.group_a[1:] != u.group_a[:-1], [True]]) if len(u.a) else np.empty(0, bool)
    of_unit = [np.bincount(u.of_a, minlength=n), np.bincount(u.of_b, minlength=n),
               np.bincount(u.of_a[ended], minlength=n), np.bincount(u.of_link, minlength=n)]
    columns = [pa.array(np.where(kept, batch.per_text(x.astype(np.int64)), 0)) for x in of_unit]
    texts, digest = group_texts(u).__getitem__, []
    for ok, lo, hi in zip(kept.tolist(), batch.cut.tolist(), batch.cut[1:].tolist(), strict=False):
        joined = b"".join(map(texts, batch.which[lo:hi].tolist())) if ok else b""
        digest.append(hashlib.sha256(memoryview(joined)[:-1]).hexdigest() if ok else "")
    size = of_unit[3]
    use = np.where(np.repeat(kept, np.diff(batch.cut)), size[batch.which], 0)
    ends = np.concatenate([[0], np.cumsum(use)])[batch.cut].tolist()
    flat = pick(u.codes.astype(kind), (np.cumsum(size) - size)[batch.which], use)
    codes, times = [], []
    for lo, hi in zip(ends, ends[1:], strict=False):
        some, often = flat[lo:hi], None
        if hi - lo > most:
            some, often = np.unique(some, return_counts=True)
        codes.append(some.tobytes())
        times.append(often if often is None else often.astype("<i8").tobytes())
    return [*columns, pa.array(digest, pa.string()), pa.array(codes, pa.binary()), pa.array(times, pa.binary())]


def linked(docs: DataFrame, path_a: str, path_b: str, key: str, text: str) -> DataFrame:
    """(row, key, n_a, n_b, n_groups, n_links, groups_sha256, codes, times) of every row.

    ``codes`` are the pairs of its links, packed; ``times`` is how often each occurs, null for once.
    """
    narrow = docs.select(F.monotonically_increasing_id().alias("row"), col(key).alias("key"),
                         col(text).cast("string").alias("text"))
    schema = T.StructType([
        T.StructField("row", T.LongType()), narrow.schema["key"], *[T.StructField(n, T.LongType()) for n in STATS],
        T.StructField("groups_sha256", T.StringType()), T.StructField("codes", T.BinaryType()),
        T.StructField("times", T.BinaryType())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = byte_level(path_a), pieces(path_b)
        kind = code_kind(a, b)
        for part in parts:
            done = 0
            for batch, kept in batches(part.column(2), a, b):
                columns = _rows(batch, kept, kind, LONG)
                del batch
                k = len(columns[0])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).slice(done, k), part.column(1).slice(done, k), *columns], schema.names)
                done += k

    return narrow.mapInArrow(run, schema)


def _flat(column: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """Packed numbers of all rows, end to end, and how many each row has."""
    column = column.cast(pa.large_binary())
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None and data.size else np.empty(0, np.uint8)
    return np.frombuffer(raw.tobytes(), kind), np.diff(offsets) // kind.itemsize


def kept_links(codes: pa.Array, times: pa.Array, kind: np.dtype, most: int) -> Iterator[tuple]:
    """Some rows of about ``most`` links at a time: the first, codes end to end, how often each occurs (None: once) and how many each row has."""
    width = pc.binary_length(codes).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, lo = np.cumsum(width), 0
    while lo < len(width):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] - width[lo] + most * kind.itemsize, side="right")))
        found, size = _flat(codes.slice(lo, hi - lo), kind)
        often, some = None, times.slice(lo, hi - lo)
        if some.null_count < len(some):
            often, first = np.ones(len(found), np.int64), np.cumsum(size) - size
            for i in np.flatnonzero(some.is_valid().to_numpy(zero_copy_only=False)).tolist():
                often[first[i]:first[i] + size[i]] = np.frombuffer(some[i].as_py(), "<i8")
        yield lo, found, often, size
        lo = hi


# Counts --------------------------------------------------------------------------------------

def pair_counts(links: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(code, n, best) of every linked id pair of ``linked`` rows.

    ``best``: no other pair of that B id has a larger ``n``. Counts are summed in each task first.
    """
    n_b, kind = len(pieces(path_b)), code_kind(byte_level(path_a), pieces(path_b))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts = [], []

        def summed() -> pa.RecordBatch:
            code, at = np.unique(np.concatenate(codes), return_inverse=True)
            n = np.bincount(at, weights=np.concatenate(counts), minlength=len(code)).astype(np.int64)
            codes[:], counts[:] = [code], [n]
            return pa.RecordBatch.from_arrays([pa.array(code.astype(np.int64)), pa.array(n)], ["code", "n"])

        for part in parts:
            for _, found, often, _ in kept_links(part.column(0), part.column(1), kind, LOOKUP):
                if often is None:
                    code, n = np.unique(found, return_counts=True)
                else:
                    code, at = np.unique(found, return_inverse=True)
                    n = np.bincount(at, weights=often, minlength=len(code)).astype(np.int64)
                codes.append(code)
                counts.append(n)
                if sum(map(len, codes)) > PENDING:
                    whole = summed()
                    if whole.num_rows > PENDING // 2:
                        yield whole
                        codes.clear(), counts.clear()
        if codes:
            yield summed()

    found = links.select("codes", "times").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    pairs = settle(found, "token-pairs")
    # one row for each id of B's vocabulary, whatever the size of the corpus
    most = pairs.groupBy((F.col("code") % n_b).alias("b")).agg(F.max("n").alias("most"))
    return settle(pairs.join(F.broadcast(most), F.col("code") % n_b == F.col("b"))
                  .select("code", "n", (F.col("n") == F.col("most")).alias("best")), "token-pairs-best")


def frequent(pairs: DataFrame, hot: int) -> DataFrame:
    """The pairs that occur at least as often as a bound that at most ``hot`` pairs reach."""
    sizes = sorted(pairs.groupBy(F.floor(F.log2("n")).cast("int").alias("e")).count().collect(), reverse=True)
    room, least = hot, None
    for exponent, n in sizes:  # at most 63 rows
        if n > room:
            break
        room, least = room - n, exponent
    return pairs.where(F.lit(False)) if least is None else pairs.where(F.col("n") >= F.lit(1 << least))


# Alignment -----------------------------------------------------------------------------------

def align(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text",
          hot: int = HOT) -> DataFrame:
    """Per row: key, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256."""
    links = settle(linked(docs, path_a, path_b, key, text), "token-links")
    pairs = pair_counts(links, path_a, path_b)
    known = frequent(pairs, hot).toArrow().sort_by("code")
    cold = pairs.count() > known.num_rows
    kind = code_kind(byte_level(path_a), pieces(path_b))
    sent = docs.sparkSession.sparkContext.broadcast(
        (known["code"].to_numpy().astype(kind), known["n"].to_numpy(), known["best"].to_numpy()))
    whole = ["row", "key", *STATS, "groups_sha256"]
    schema = T.StructType([*[links.schema[c] for c in whole], T.StructField("n_best", T.LongType()),
                           T.StructField("count_sum", T.LongType()),
                           *[T.StructField(c, T.ArrayType(T.LongType())) for c in ("cold", "often") if cold]])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts, best = sent.value
        for part in parts:
            for lo, found, often, size in kept_links(part.column(len(whole)), part.column(len(whole) + 1), kind, LOOKUP):
                at = np.minimum(np.searchsorted(codes, found), max(len(codes) - 1, 0))
                hit = codes[at] == found if len(codes) else np.zeros(len(found), bool)
                count = np.where(hit, counts[at], 0) if len(codes) else np.zeros(len(found), np.int64)
                tops = (hit & best[at] if len(codes) else hit).astype(np.int64)
                if often is not None:
                    count, tops = count * often, tops * often
                ends = np.concatenate([[0], np.cumsum(size)])
                added = [np.diff(np.concatenate([[0], np.cumsum(x)])[ends]) for x in (tops, count)]
                columns = [pa.array(x.astype(np.int64)) for x in added]
                if cold:
                    rest = pa.array(np.concatenate([[0], np.cumsum(~hit)])[ends], pa.int32())
                    times = np.ones(len(found), np.int64) if often is None else often
                    columns += [pa.ListArray.from_arrays(rest, pa.array(x[~hit].astype(np.int64))) for x in (found, times)]
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(i).slice(lo, len(size)) for i in range(len(whole))], *columns], schema.names)

    out = links.select(*whole, "codes", "times").mapInArrow(run, schema)
    if cold:
        out = settle(out, "aligned")
        rare = (out.select("row", F.inline(F.arrays_zip("cold", "often")))
                .select("row", F.col("cold").alias("code"), F.col("often").alias("times"))
                .groupBy("row", "code").agg(F.sum("times").alias("times"))
                .join(pairs, "code").groupBy("row").agg(F.sum(F.col("n") * F.col("times")).alias("more"),
                                                        F.sum(F.when(F.col("best"), F.col("times"))).alias("more_best")))
        out = (out.drop("cold", "often").join(rare, "row", "left")
               .withColumn("count_sum", F.col("count_sum") + F.coalesce("more", F.lit(0)))
               .withColumn("n_best", F.col("n_best") + F.coalesce("more_best", F.lit(0))))
    return out.select(F.col("key").alias(key), *STATS, "n_best", "count_sum", "groups_sha256")
