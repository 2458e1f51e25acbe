"""Token ids in binary files, with Elias-Fano document boundaries.

A shard holds the ids of its documents one after another, in the narrowest unsigned type that
fits the vocabulary, then the key column (an Arrow stream), then the boundaries, then a footer.
The boundaries (token offsets of the n + 1 document ends, 0 first) are an Elias-Fano code: of each
value the low bits packed, the high bits in unary, about 2 + log2(tokens / documents) bits a
document. A 32-bit sample of every 256th set bit makes select a lookup and a short scan, so one
document's offset is found without decoding the rest and without a table of 64-bit offsets.

Shards follow the range-partitioned order of the documents. A task writes under a name of its
own; only the files that the manifest lists count, so a retried or doubled task leaves at most
an unread file behind. The folder must be one that all executors share.

Cases: a null or empty text holds the end id alone; equal order keys (repeated rows) keep all their
rows, side by side; an empty table gives an empty manifest and no files; only key, text and
order columns are read, under names of their own. A very long text is encoded as one block: memory for
its bytes, its words and its ids.
"""

from __future__ import annotations

import io
import json
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitscreen.llm import grams
from pitscreen.llm.frames import col
from pitscreen.session import land, shared_folder

SAMPLE = 256
MAGIC = b"EFTOKEN1"
#: Letter runs whose ids a worker remembers (about 200 bytes each); beyond that it starts anew.
REMEMBERED = 600_000
#: Bytes of text whose distinct words are looked up once; more bytes need fewer lookups and more memory.
BLOCK = 4 << 20
#: Boundaries that a reader decodes together.
RUN = 8192


# Elias-Fano ----------------------------------------------------------------------------------

class EliasFano:
    """Ascending integers from 0 to ``top`` in near-minimal space."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.int64)
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max(0, (top // max(n, 1)).bit_length() - 1)
        low = (values[:, None] >> np.arange(bits)) & 1 if bits else np.empty((n, 0), np.int64)
        ones = (values >> bits) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, dtype=np.uint8)
        high[ones] = 1
        return cls(n, bits, np.packbits(low.astype(np.uint8).ravel(), bitorder="little"),
                   np.packbits(high, bitorder="little"), ones[::SAMPLE].astype(np.uint32))

    def run(self, lo: int, hi: int) -> np.ndarray:
        """Values number ``lo`` to ``hi - 1``: decodes the unary bits between the samples around them."""
        if not 0 <= lo <= hi <= self.n:
            raise IndexError((lo, hi))
        if lo == hi:
            return np.empty(0, np.int64)
        first, after = lo // SAMPLE, (hi - 1) // SAMPLE + 1
        begin = int(self.samples[first])
        end = int(self.samples[after]) if after < len(self.samples) else len(self.high) * 8
        bits = np.unpackbits(self.high[begin // 8:-(-end // 8)], bitorder="little")
        bits[:begin % 8] = 0
        ones = np.flatnonzero(bits)[lo - first * SAMPLE:hi - first * SAMPLE] + begin // 8 * 8
        value = (ones - np.arange(lo, hi)) << self.low_bits
        if self.low_bits:
            a, b = lo * self.low_bits, hi * self.low_bits
            low = np.unpackbits(self.low[a // 8:-(-b // 8)], bitorder="little")[a % 8:a % 8 + b - a]
            value |= low.reshape(hi - lo, self.low_bits).astype(np.int64) @ (1 << np.arange(self.low_bits, dtype=np.int64))
        return value

    def all(self) -> np.ndarray:
        return self.run(0, self.n)

    def select(self, i: int) -> int:
        """Value number ``i``: scans from the sample below it."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at = int(self.samples[i // SAMPLE])
        left = i % SAMPLE
        byte, first = at // 8, at % 8
        while True:
            chunk = np.unpackbits(self.high[byte:byte + 64], bitorder="little")
            chunk[:first] = 0
            ones = np.flatnonzero(chunk)
            if left < len(ones):
                position = byte * 8 + int(ones[left])
                break
            left -= len(ones)
            byte, first = byte + 64, 0
        value = (position - i) << self.low_bits
        for b in range(self.low_bits):
            p = i * self.low_bits + b
            value |= (int(self.low[p // 8]) >> (p % 8) & 1) << b
        return value

    def dump(self) -> tuple[dict, bytes]:
        parts = [self.low.tobytes(), self.high.tobytes(), self.samples.astype("<u4").tobytes()]
        return {"n": self.n, "low_bits": self.low_bits, "sizes": [len(p) for p in parts]}, b"".join(parts)

    @classmethod
    def load(cls, head: dict, raw: bytes) -> EliasFano:
        a, b, c = head["sizes"]
        return cls(head["n"], head["low_bits"], np.frombuffer(raw[:a], np.uint8),
                   np.frombuffer(raw[a:a + b], np.uint8), np.frombuffer(raw[a + b:a + b + c], "<u4"))


# Words to ids --------------------------------------------------------------------------------

_SIMPLE = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,!?;:#$%&*]*)")
_CLOSING = b".,!?;:#$%&*"


def _byte_letters() -> dict[int, int]:
    """The letters that byte-level vocabularies use for bytes that are not printable."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: 256 + i for i, b in enumerate(hidden)}


_LETTERS = _byte_letters()


class WordEncoder:
    """Ids of whole texts, word by word, with the words seen before remembered.

    No pre-token of the vocabulary holds white space, so a text's ids are those of its words in
    turn. In a word of plain letters with or without closing signs (no apostrophe), the letters go straight
    to the merges and are remembered; any other word goes through the whole tokenizer.
    """

    def __init__(self, path: str, dtype: np.dtype, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            text = f.read()
        self.whole = Tokenizer.from_str(text)
        self.merges = self.whole.model
        self.dtype = dtype
        self.code = "H" if dtype.itemsize == 2 else "I"
        self.remembered = remembered
        self.known: dict[bytes, bytes] = {}
        self.closing: dict[bytes, bytes] = {}
        spec = json.loads(text)
        splits = [p.get("pattern", {}).get("Regex") for p in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        #: The shortcut is for the lower-casing vocabulary that keeps letter runs together.
        self.lowers = (any(n.get("type") == "Lowercase" for n in (spec.get("normalizer") or {}).get("normalizers", []))
                       and any(s and "[\\p{L}]+" in s for s in splits))
        if not self.lowers:
            raise ValueError("the vocabulary must drop white space, lower-case and keep letter runs together")

    def _whole(self, word: str) -> list[int]:
        return self.whole.encode(word, add_special_tokens=False).ids

    def _ids(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{self.code}", *ids)

    def _letters(self, letters: bytes) -> bytes:
        spelled = letters.decode("ascii") if letters.isascii() else letters.decode("latin-1").translate(_LETTERS)
        return self._ids([t.id for t in self.merges.tokenize(spelled)])

    def word(self, raw: bytes) -> bytes:
        letters = raw.rstrip(_CLOSING)
        if letters.isalpha():  # of bytes: A-Z and a-z alone
            closed = raw[len(letters):]
            letters = letters.lower()
        else:
            s = raw.decode("utf-8", "replace")
            m = _SIMPLE.fullmatch(s)
            if not m:
                return self._ids(self._whole(s))
            letters, closed = m[1].lower().encode(), m[2].encode()
        out = self.known.get(letters)
        if out is None:
            if len(self.known) >= self.remembered:
                self.known.clear()
            out = self.known[letters] = self._letters(letters)
        if closed:
            closing = self.closing.get(closed)
            if closing is None:
                closing = self._ids(self._whole(closed.decode()))
                if len(self.closing) < 10_000:
                    self.closing[closed] = closing
            out += closing
        return out

    def block(self, b: grams.Block, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts of a block, each closed by the end id, and how many each has.

        Every distinct word of the block is looked up once; its ids are then copied to all its places.
        """
        w = b.words()
        _, once, which = np.unique(w.hashes(lower=False), return_index=True, return_inverse=True)
        raw = b.data.tobytes()
        pieces = [self.word(raw[i:j]) for i, j in zip(w.start[once].tolist(), w.end[once].tolist(), strict=True)]
        flat = np.frombuffer(b"".join(pieces), dtype=self.dtype)
        size = np.array([len(p) for p in pieces], dtype=np.int64) // self.dtype.itemsize
        first = np.cumsum(size) - size
        n = size[which]  # ids of each word
        lens = np.bincount(w.text, weights=n, minlength=b.count).astype(np.int64) + 1
        out = np.full(int(lens.sum()), end_id, dtype=self.dtype)
        to = np.cumsum(n) - n + w.text  # one end id for each text before
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        out[np.repeat(to, n) + step] = flat[np.repeat(first[which], n) + step]
        return out, lens


@lru_cache(maxsize=2)
def encoder(path: str, dtype: str, remembered: int) -> WordEncoder:
    return WordEncoder(path, np.dtype(dtype), remembered)


# Writing -------------------------------------------------------------------------------------

def filesystem(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a folder or file, and its path there."""
    if uri.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    if "://" in uri:
        return pyarrow.fs.FileSystem.from_uri(uri)
    return pyarrow.fs.LocalFileSystem(), uri


MANIFEST = T.StructType([T.StructField("shard", T.LongType()), T.StructField("path", T.StringType()),
                         T.StructField("n_docs", T.LongType()), T.StructField("n_tokens", T.LongType())])


def write(docs: DataFrame, tokenizer: str, vocabulary: int, end_id: int, key: str = "doc_id", text: str = "text",
          order_by: list[Column] | None = None, folder: str | None = None, remembered: int = REMEMBERED,
          block: int = BLOCK) -> DataFrame:
    """Writes shards in the order of ``order_by`` (the key) and returns the manifest.

    With an empty ``order_by`` documents stay as they lie, a shard to each partition, without a shuffle.

    Manifest: shard, path, n_docs, n_tokens and ``start``, the tokens of all shards before. It has
    a row per file. Memory of a task is one Arrow batch, words and ids of
    ``block`` bytes of text (or one longer text), 16 bytes a document of its shard, and the ``remembered`` letter runs; both
    cost time if they are few.
    """
    spark = docs.sparkSession
    dtype = "<u2" if max(vocabulary, end_id + 1) <= 1 << 16 else "<u4"
    folder = folder or f"{shared_folder(spark).rstrip('/')}/tokens-{uuid4().hex}"
    fs, root = filesystem(folder)
    fs.create_dir(root, recursive=True)
    order = [col(key)] if order_by is None else order_by
    narrow = docs.select(col(key).alias("key"), col(text).cast("string").alias("text"),
                         *[c.alias(f"o{i}") for i, c in enumerate(order)])
    names = [f"o{i}" for i in range(len(order))]
    if names:
        narrow = narrow.repartitionByRange(*names).sortWithinPartitions(*names)
    sorted_docs = narrow.select("key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        enc, out, lens, keys = encoder(tokenizer, dtype, remembered), None, [], []
        shard = TaskContext.get().partitionId()
        path = f"{root}/ids-{shard:06d}-{uuid4().hex}.bin"
        for batch in batches:
            if not batch.num_rows:
                continue
            out = out or fs.open_output_stream(path)
            keys.append(batch.column(0))
            for b in grams.blocks(batch.column(1), block):
                ids, n = enc.block(b, end_id)
                out.write(ids.tobytes())
                lens.append(n)
        if out is None:
            return
        ends = np.concatenate([[0], np.cumsum(np.concatenate(lens))])
        head, boundaries = EliasFano.encode(ends).dump()
        sink = io.BytesIO()
        column = pa.table({"key": pa.chunked_array(keys)})
        with pa.ipc.new_stream(sink, column.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_table(column)
        out.write(sink.getvalue())
        out.write(boundaries)
        footer = json.dumps({"dtype": dtype, "tokens": int(ends[-1]), "keys": len(sink.getvalue()),
                             "boundaries": head}).encode()
        out.write(footer + len(footer).to_bytes(4, "little") + MAGIC)
        out.close()
        uri = folder.rstrip("/") + "/" + path.rsplit("/", 1)[1]
        yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [uri], "n_docs": [len(ends) - 1],
                                          "n_tokens": [int(ends[-1])]})

    manifest = land(sorted_docs.mapInArrow(run, MANIFEST), "token-manifest")
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long"))


# Reading -------------------------------------------------------------------------------------

class Shard:
    """A written file: ids of a document or a run of documents, found through the boundaries."""

    def __init__(self, uri: str):
        fs, path = filesystem(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        tail = self.file.read_at(12, size - 12)
        if tail[4:] != MAGIC:
            raise ValueError(f"{uri} is not a token file")
        n = int.from_bytes(tail[:4], "little")
        foot = json.loads(self.file.read_at(n, size - 12 - n))
        self.dtype = np.dtype(foot["dtype"])
        at = foot["tokens"] * self.dtype.itemsize
        self.keys = pa.ipc.open_stream(self.file.read_at(foot["keys"], at)).read_all()["key"]
        head = foot["boundaries"]
        self.boundaries = EliasFano.load(head, self.file.read_at(sum(head["sizes"]), at + foot["keys"]))

    def __len__(self) -> int:
        return self.boundaries.n - 1

    def between(self, lo: int, hi: int) -> np.ndarray:
        width = self.dtype.itemsize
        return np.frombuffer(self.file.read_at((hi - lo) * width, lo * width), self.dtype)

    def document(self, i: int) -> np.ndarray:
        return self.between(self.boundaries.select(i), self.boundaries.select(i + 1))


def read(manifest: DataFrame, key: str, key_type: T.DataType, tokens: int = 1 << 20) -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every document, from the files of a manifest.

    One task reads one shard, about ``tokens`` ids (or one longer document) and ``RUN`` boundaries at a time.
    """
    files = land(manifest, "token-index")
    n = max(1, files.count())
    schema = T.StructType([T.StructField("key", key_type), T.StructField("start", T.LongType()),
                           T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row["path"])
                lo = 0
                while lo < len(shard):
                    ends = shard.boundaries.run(lo, min(lo + RUN, len(shard)) + 1)
                    n = max(1, int(np.searchsorted(ends, ends[0] + tokens, side="right")) - 1)
                    ends = ends[:n + 1]
                    ids = memoryview(shard.between(int(ends[0]), int(ends[-1])).astype("<u4")).cast("B")
                    cut = ((ends - ends[0]) * 4).tolist()
                    crc = [zlib.crc32(ids[a:b]) for a, b in zip(cut, cut[1:], strict=False)]
                    yield pa.RecordBatch.from_arrays(
                        [shard.keys.slice(lo, n).combine_chunks(), pa.array(ends[:-1] + row["start"]),
                         pa.array(np.diff(ends)), pa.array(crc, pa.int64())], schema.names)
                    lo += n

    spread = files.select("path", "start", "shard").repartitionByRange(n, "shard")
    return spread.mapInArrow(run, schema).withColumnRenamed("key", key)
