"""Two tokenizers aligned, held against whole-text encodings and plain loops."""
import hashlib
import random
from collections import Counter
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from brute import AWKWARD
from pyspark.sql import types as T
from tokenizers import Tokenizer

from pitscreen.llm import token_alignment as ta

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@lru_cache
def libraries():
    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    return t, sentencepiece.SentencePieceProcessor(model_file=B)


def plain_tokens(text):
    """(id, bytes) of both sides, by whole-text encodings; None without tokens."""
    if not text:
        return None
    whole = " " + text
    t, p = libraries()
    letters, n = {}, 0
    for b in range(256):
        if b in range(0x21, 0x7F) or b in range(0xA1, 0xAD) or b in range(0xAE, 0x100):
            letters[chr(b)] = b
        else:
            letters[chr(256 + n)] = b
            n += 1
    a = [(i, bytes(letters[c] for c in t.id_to_token(i))) for i in t.encode(whole, add_special_tokens=False).ids]
    b = []
    for i in p.encode(text):
        s = p.id_to_piece(i)
        b.append((i, bytes([int(s[3:5], 16)]) if p.is_byte(i) else s.replace("▁", " ").encode()))
    same = all(b"".join(x for _, x in side) == whole.encode() for side in (a, b))
    return (a, b) if same else None


def plain(rows):
    made, counts = [], Counter()
    for _, text in rows:
        found = plain_tokens(text)
        if found is None:
            made.append(None)
            continue
        spans = []
        for side in found:
            at, out = 0, []
            for i, raw in side:
                out.append((i, at, at + len(raw)))
                at += len(raw)
            spans.append(out)
        a, b = spans
        links = [(x, y) for x, s, e in a for y, u, v in b if s < v and u < e]
        cuts = sorted({e for *_, e in a} & {e for *_, e in b})
        text_of, lo = [], 0
        for cut in cuts:
            text_of.append("|".join(",".join(str(i) for i, s, e in side if lo <= s and e <= cut) for side in spans))
            lo = cut
        counts.update(links)
        made.append((len(a), len(b), len(cuts), links, ";".join(text_of)))
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    out = []
    for (key, _), m in zip(rows, made):
        if m is None:
            out.append((key, 0, 0, 0, 0, 0, 0, ""))
        else:
            out.append((key, *m[:3], len(m[3]), sum(counts[x] == best[x[1]] for x in m[3]), sum(counts[x] for x in m[3]),
                        hashlib.sha256(m[4].encode()).hexdigest()))
    return sorted(out, key=str)


def texts():
    rnd = random.Random(5)
    words = ["the", "naïve", "don't", "東京", "a_b", "1234", "İstanbul", "x" * 30, "Привет", "<|endoftext|>", "<s>", "<0x41>", "\U0001f600\U0001f600", "C++"]
    gaps = [" ", "  ", "\n", "\n\n  ", "\t", " \n ", " ", "　 ", "   ", " ", ", ", "\r\n"]
    out = ["".join(rnd.choice(words) + rnd.choice(gaps) for _ in range(rnd.randint(1, 40))) for _ in range(40)]
    return [*AWKWARD, *out, out[0], out[0], "has ▁ inside", "ends with space ", "   ", "  x\u0085 y", "ab\0cd e"]


@pytest.mark.parametrize("hot", [ta.HOT, 40, 0])
def test_alignment_against_whole_texts(docs, hot):
    rows = list(enumerate(texts())) + [(None, "null key"), (3, "again"), (3, "again")]
    got = ta.align(docs(rows), A, B, hot=hot)
    assert got.columns == ["doc_id", *ta.STATS, "n_best", "count_sum", "groups_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows)


def test_no_rows(docs):
    assert ta.align(docs([]), A, B).count() == 0
    assert [tuple(r)[1:] for r in ta.align(docs([(1, None)]), A, B).collect()] == [(0, 0, 0, 0, 0, 0, "")]


def test_text_longer_than_a_block(docs, monkeypatch):
    long = "".join(f"word{i % 977} and, \n" for i in range(90_000))
    assert len(long) > 1 << 20
    short = [(i, x) for i, x in enumerate(texts()[:20])]
    d = docs([*short, (99, long)])
    whole = sorted(map(tuple, ta.align(d, A, B).collect()), key=str)
    monkeypatch.setattr(ta, "CALL", 7)
    row = next(r for r in whole if r[0] == 99)
    a, b = plain_tokens(long)
    assert row[1:3] == (len(a), len(b))


def test_terminals_by_plain_walk():
    rnd = np.random.default_rng(1)
    for _ in range(50):
        top = 200
        ea, eb = (np.append(np.unique(rnd.integers(1, top, rnd.integers(1, 60))), top) for _ in range(2))
        last = ta.terminals(ea, eb)
        both = [x for x in ea.tolist() if x in set(eb.tolist())]
        ends = [next(x for x in both if x >= e) for e in [*ea.tolist(), *eb.tolist()]]
        assert ea[last].tolist() == ends


def test_other_keys_and_clashing_columns(spark):
    d = spark.createDataFrame([("k", "some text", 1, 2)], T.StructType([
        T.StructField("id", T.StringType()), T.StructField("body", T.StringType()),
        T.StructField("row", T.IntegerType()), T.StructField("code", T.IntegerType())]))
    assert ta.align(d, A, B, key="id", text="body").first().id == "k"


@pytest.mark.parametrize("hot", [ta.HOT, 0])
def test_texts_are_aligned_once_and_long_ones_keep_distinct_pairs(docs, monkeypatch, hot):
    rows = list(enumerate([*texts(), "the cat and " * 40]))
    want, seen = plain(rows), []
    monkeypatch.setattr(ta, "LONG", 30)
    monkeypatch.setattr(ta, "LOOKUP", 50)
    monkeypatch.setattr(ta, "settle", lambda df, name, f=ta.settle: seen.append((name, df)) or f(df, name))
    assert sorted((tuple(r) for r in ta.align(docs(rows), A, B, hot=hot).collect()), key=str) == want
    by_name = dict(seen)
    kept = {r.key: r for r in by_name["token-links"].collect()}
    last = kept[len(rows) - 1]
    assert last.n_links > 30 and sum(np.frombuffer(last.times, "<i8")) == last.n_links
    assert len(last.codes) == 4 * len(np.frombuffer(last.times, "<i8")) < 4 * last.n_links
    assert all("token-links" in f for f in by_name["token-pairs"].inputFiles())
