"""Mixing, token files and the pipeline, held against plain versions."""
import hashlib
import math
import random
import zlib
from collections import Counter

import brute
import corpus_pipeline
import numpy as np
import pytest
from brute import AWKWARD
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pitscreen.llm import source_mix, token_files
from pitscreen.llm.catalog import QUERIES, word_ids

SF = "/root/testdata/sf0.001"


def uniform(*parts):
    return int(hashlib.md5(":".join("null" if p is None else str(p) for p in parts).encode()).hexdigest()[:15], 16)


def copies(rate, u):
    if rate <= 0:
        return 0
    k, total = 0, 0.0
    while True:
        total += math.exp(-rate + k * math.log(rate) - math.lgamma(k + 1))
        if total > u or k > 10 * rate + 200:
            return k
        k += 1


def rates(rows, budget=1.0, temperature=0.5):
    size = Counter()
    for _, x, s in rows:
        size[s] += len(x or "")
    weights = {s: n ** temperature if n else 0.0 for s, n in size.items()}
    total = sum(size.values())
    return {s: weights[s] / sum(weights.values()) * budget * total / n if n else budget for s, n in size.items()}


def test_mix_counts(docs):
    rnd = random.Random(3)
    rows = [(i, "x" * rnd.randint(0, 40), rnd.choice(["a", "a", "a", "b", "c", None])) for i in range(300)]
    rows += [(None, "null key", "b"), (5, "again", "a"), (5, "again", "a"), (400, "", "only-empty"), (401, None, "only-empty")]
    d = docs([(i, x, None, s) for i, x, s in rows])
    for budget in (0.5, 3.0):
        rate = rates(rows, budget)
        want = Counter()
        for i, _, s in rows:
            want[i, s] += copies(rate[s], uniform(17, i) / 2 ** 60)
        mixed = source_mix.mix(d, budget=budget)
        assert mixed.columns == d.columns
        assert Counter((r.doc_id, r.source) for r in mixed.collect()) == +want
    orders = [r.o for r in source_mix.mix(d, copy="c", order="o").select("o").collect()]
    assert orders == sorted(orders)
    assert source_mix.mix(docs([])).count() == 0


def test_mix_beside_any_columns(spark):
    names = ["doc_id", "text", "source", "mix_source", "mix_cdf", "mix_n", "mix_copy", "mix_order", "mix_plans", "mix_plano", "copy"]
    d = spark.createDataFrame([(i, "text", "s", *["mine"] * 8) for i in range(40)], names)
    got = source_mix.mix(d, budget=2.0, copy="nth", order="mix_n_")
    assert got.columns == [*names, "nth", "mix_n_"]
    rows = got.collect()
    assert len(rows) > 40 and all(set(r[3:11]) == {"mine"} for r in rows)
    for taken in ("copy", "COPY", "mix_n"):
        with pytest.raises(ValueError):
            source_mix.mix(d, copy=taken)
    with pytest.raises(ValueError):
        source_mix.mix(d, copy="new", order="new")


def test_mix_of_a_long_text(docs):
    got = source_mix.mix(docs([(1, "x" * 2_000_000, None, "a"), (2, "y", None, "b")]), budget=40.0)
    assert {r.doc_id for r in got.select("doc_id").collect()} >= {1}


def test_mix_to_named_targets(spark, docs):
    d = docs([(i, "x" * 50, None, "a" if i < 1500 else "b") for i in range(2000)] + [(3000, "y", None, "unnamed")])
    targets = spark.createDataFrame([("a", 1.0), ("b", 3.0)], "source string, weight double")
    n = Counter(r.source for r in source_mix.mix(d, targets, budget=2.0).collect())
    assert abs(n["b"] / (n["a"] + n["b"]) - 0.75) < 0.04 and abs(sum(n.values()) - 4000) < 250 and not n["unnamed"]


@pytest.mark.parametrize("rate", [0.01, 1.0, 37.5, 900.0])
def test_poisson_table(spark, rate):
    cdf = source_mix.poisson_tables(spark.createDataFrame([(None, rate), ("zero", 0.0)], "source string, rate double")).collect()
    assert [r.source for r in cdf] == [None]
    cdf = cdf[0].cdf
    assert abs(cdf[-1] - 1) < 1e-6
    assert abs(sum(1 - c for c in cdf) - rate) < 1e-3 * max(rate, 1)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5000), min_size=1, max_size=700))
def test_elias_fano_round_trip(gaps):
    values = np.cumsum(gaps)
    head, raw = token_files.EliasFano.encode(values).dump()
    back = token_files.EliasFano.load(head, raw)
    assert back.all().tolist() == values.tolist()
    for i in {0, len(gaps) // 2, len(gaps) - 1}:
        assert back.select(i) == values[i]
        assert back.run(i, len(gaps)).tolist() == values[i:].tolist() and back.run(0, i).tolist() == values[:i].tolist()
    n, top = len(values), int(values[-1])
    assert len(raw) <= n * (2 + max(0, math.log2(max(top, 1) / n))) / 8 + n / 4 + 4 * (n // 256 + 1) + 16


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(word_ids())


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


ODD = ["It's we'll THEY'RE don't", "Straße ÉCOLE naïve é Ångström", "<|endoftext|> a<|startoftext|>b", "x,y.z;!? a... b,,", "１２ 3 ⅷ 4½",
       "ΣΊΣΥΦΟΣ σς İstanbul", "a b c\u0085d", "\U0001f600\U0001f600 日本語テキスト"]


def test_token_files_round_trip(spark, docs):
    texts = [(i, x) for i, x in enumerate([*AWKWARD, *ODD] * 3)] + [(7, "again"), (7, "again")]
    tok = tokenizer()
    manifest = token_files.write(docs(texts), word_ids(), 49_408, 1)
    got = token_files.read(manifest, "doc_id", docs([]).schema["doc_id"].dataType).collect()
    want = {}
    for i, x in texts:
        want.setdefault(i, []).append(tok.encode(x or "", add_special_tokens=False).ids + [1])
    assert len(got) == len(texts)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert (r.start, r.ids_crc32) == (at, crc(want[r.doc_id][0])) or len(want[r.doc_id]) > 1
        assert r.n_tokens in {len(w) for w in want[r.doc_id]}
        at += r.n_tokens
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == sorted(i for i, _ in texts)
    for m in manifest.collect():
        shard = token_files.Shard(m.path)
        assert len(shard) == m.n_docs
        for i in (0, len(shard) - 1):
            assert shard.document(i).tolist() in want[shard.keys[i].as_py()]
    none = token_files.write(docs([]), word_ids(), 49_408, 1)
    assert none.count() == 0 and token_files.read(none, "doc_id", docs([]).schema["doc_id"].dataType).count() == 0


def test_letters_are_remembered_apart_from_what_closes_them():
    tok = tokenizer()
    enc = token_files.WordEncoder(word_ids(), np.dtype("<u2"))
    closing = ["", ".", ",", "$$$", "***", ".%%%", ",&&&", "!?#;:", "#*", "'", "')", "-", "’s", "'s", "'ll.", "1", "..a", "$a$"]
    words = [x + c for x in ("word", "WORD", "Straße", "ÉCOLE", "élan", "ﬁn", "don", "endoftext", "ñandú") for c in closing]
    for x in [*words, "$$$", "***.", "<|endoftext|>$$", "a$<|endoftext|>"]:
        want = tok.encode(x, add_special_tokens=False).ids
        assert np.frombuffer(enc.word(x.encode()), "<u2").tolist() == want, x
    called = []
    enc._whole = lambda x, whole=enc._whole: called.append(x) or whole(x)
    for x in ("word.***", "Word,$$$", "élan%%%"):
        enc.word(x.encode())
    assert all(not c[0].isalpha() for c in called)


def test_ids_do_not_depend_on_blocks(docs):
    rnd = random.Random(3)
    rows = [(i, " ".join(rnd.choice([*ODD, "plain words.", "x" * 300]) for _ in range(rnd.randint(0, 40)))) for i in range(60)]
    key = docs([]).schema["doc_id"].dataType
    got = [sorted(token_files.read(token_files.write(docs(rows), word_ids(), 49_408, 1, block=b), "doc_id", key).collect())
           for b in (1, 5_000, token_files.BLOCK)]
    assert got[0] == got[1] == got[2] and len(got[0]) == 60


def test_runs_of_boundaries_and_a_long_text(docs, monkeypatch):
    """The read path decodes boundaries run by run; a text longer than a block is one document."""
    long = "Some words, again. " * 70_000
    rows = [(0, long), *[(i, "word " * (i % 7)) for i in range(1, 700)]]
    assert len(long) > 1 << 20
    manifest = token_files.write(docs(rows), word_ids(), 49_408, 1)
    once = tokenizer().encode("Some words, again. ", add_special_tokens=False).ids
    key = docs([]).schema["doc_id"].dataType
    got = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in token_files.read(manifest, "doc_id", key, tokens=50).collect()}
    assert got[0] == (len(once) * 70_000 + 1, crc(once * 70_000 + [1])) and len(got) == 700
    word = tokenizer().encode("word", add_special_tokens=False).ids
    assert all(got[i] == (len(word) * (i % 7) + 1, crc(word * (i % 7) + [1])) for i in range(1, 700))


def documents(spark):
    return sorted((r.doc_id, r.text, r.source) for r in
                  spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect())


def test_registered_token_query(spark):
    tok, at = tokenizer(), 0
    got = {r.doc_id: tuple(r) for r in QUERIES["op7_token_files"](spark, SF).collect()}
    for d, x, _ in documents(spark):
        ids = tok.encode(x, add_special_tokens=False).ids + [1]
        assert got[d] == (d, at, len(ids), crc(ids))
        at += len(ids)


def test_pipeline_against_plain_version(spark):
    rows = [(d, x, s) for d, x, s in documents(spark) if brute.passes(x)]
    group = {d: g for d, _, g in brute.groups([(d, x) for d, x, _ in rows])}
    rows = [r for r in rows if group[r[0]] == r[0]]
    items = [(y or "").lower().split() for y in
             (r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect())]
    sets = [{tuple(v[k:k + 5]) for k in range(len(v) - 4)} for v in items]

    def clean(x):
        w = x.lower().split()
        have = {tuple(w[k:k + 5]) for k in range(len(w) - 4)}
        return not any(len(s & have) >= 0.8 * len(s) for s in sets if s)

    rows = [r for r in rows if clean(r[1])]
    rate, tok = rates(rows), tokenizer()
    want = Counter()
    for d, x, s in rows:
        ids = tok.encode(x, add_special_tokens=False).ids + [1]
        want[d, len(ids), crc(ids)] += copies(rate[s], uniform(17, d) / 2 ** 60)
    got = corpus_pipeline.run(spark, SF).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == +want
    assert len(want) > 50
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens


def test_stages_return_the_columns_of_documents(docs, spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "ngram_jaccard_join", "benchmark_decontamination",
                                                      "source_mix", "token_files"]
    empty = docs([])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, empty, SF)
        assert out.columns == empty.columns and out.count() == 0
