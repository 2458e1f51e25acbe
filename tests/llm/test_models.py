"""Learned operators: exact parts against brute force, learned parts by what they tell apart."""
import itertools
import math
import random
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pytest
from brute import AWKWARD
from pyspark.sql import functions as F

from pitscreen import session
from pitscreen.llm import grams, hpy_lm, language_id, line_crf, toxicity
from pitscreen.llm.frames import held_out
from pitscreen.llm.sampling import labelled_sample

WORDS = {"en": "the of and to in that it was is for on with as".split(),
         "fr": "le la les des une pour dans était été où ça même".split(),
         "de": "der die das und nicht für über straße größe mit von".split()}


def prose(rnd, lang, n):
    return " ".join(rnd.choice(WORDS[lang]) + rnd.choice(["", "", ",", "."]) for _ in range(n))


def test_language_of_whole_texts(docs):
    rnd = random.Random(2)
    rows = [(i, prose(rnd, lang, rnd.randint(3, 60)), lang) for i, lang in enumerate(list(WORDS) * 60)]
    rows += [(500 + i, x) for i, x in enumerate(AWKWARD)] + [(600, "12345 ... 678", "en"), (601, prose(rnd, "de", 9), None), rows[3], rows[3]]
    d = docs(rows)
    out = held_out(F.col("doc_id"), 4, 2)
    model = language_id.fit(d, ~out, sample=30, clusters=2)
    got = language_id.predict(d, model).collect()
    assert len(got) == len(rows)
    truth = {r[0]: r[2] if len(r) > 2 else None for r in rows}
    right = [r.lang_pred == truth[r.doc_id] for r in got if truth[r.doc_id] and r.doc_id < 500]
    assert np.mean(right) > 0.98
    by = {r.doc_id: r for r in got}
    assert by[601].lang_pred == "de" and all(0 <= r.score <= 1 for r in got)
    for i, x in enumerate(AWKWARD):
        if not any(c.isalpha() for c in x or ""):
            assert (by[500 + i].lang_pred, by[500 + i].score) == ("und", 0.0)
    assert by[600].lang_pred == "und" and by[506].rejected
    none = language_id.fit(docs([(1, "abc", None)]), F.lit(True))
    assert [r.lang_pred for r in language_id.predict(docs([(1, "abc", None)]), none).collect()] == ["und"]
    assert language_id.predict(docs([]), model).count() == 0


def test_held_out_folds(spark):
    d = spark.createDataFrame([(i,) for i in range(200)] + [(None,)], "doc_id long")
    got = {r.doc_id: r.h for r in d.select("doc_id", held_out(F.col("doc_id"), 7, 2).alias("h")).collect()}
    assert got == {i: brute.held_out(i, 7, 2) for i in range(200)} | {None: False}


def test_sample_is_balanced_and_bounded(spark):
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(4000)] + [(4000, None), (None, 1), (0, 0)],
                                   "doc_id long, toxic int")
    rows = labelled_sample(labels, "toxic", F.lit(True), 100).collect()
    n = Counter(r.y for r in rows)
    assert 60 < n[0] < 140 and 60 < n[1] < 140 and all(r.y == int(r.key % 10 == 0) for r in rows)
    assert labelled_sample(labels.where("toxic = 0"), "toxic", F.lit(True), 100).count() == 0


def test_forward_backward_against_all_labellings():
    rng = np.random.default_rng(0)
    text = np.repeat([0, 1, 2], [4, 1, 3])
    unary, step = rng.normal(size=(8, 2)), rng.normal(size=(2, 2))
    p, pairs, z = line_crf.forward_backward(unary, step, text)
    want, want_pairs, want_z = np.zeros((8, 2)), np.zeros((2, 2)), 0.0
    for t in range(3):
        at = np.flatnonzero(text == t)
        weights = {}
        for y in itertools.product((0, 1), repeat=len(at)):
            weights[y] = math.exp(sum(unary[i, v] for i, v in zip(at, y)) + sum(step[a, b] for a, b in zip(y, y[1:])))
        total = sum(weights.values())
        want_z += math.log(total)
        for y, w in weights.items():
            for i, v in zip(at, y):
                want[i, v] += w / total
            for a, b in zip(y, y[1:]):
                want_pairs[a, b] += w / total
    np.testing.assert_allclose(p, want, atol=1e-9)
    np.testing.assert_allclose(pairs, want_pairs, atol=1e-9)
    assert abs(z - want_z) < 1e-9


@pytest.fixture
def pages(spark, docs):
    rnd = random.Random(4)
    rows, labels = [], []
    for i in range(240):
        good = i % 3 != 0
        lines = [prose(rnd, "en", rnd.randint(5, 20)) for _ in range(rnd.randint(2, 8))]
        if not good:
            lines[1:] = [" | ".join(x.split()) for x in lines[1:]] if i % 2 else [x.upper() + "!!" for x in lines[1:]]
        rows.append((i, "\n".join(lines)))
        labels.append((i, int(good), 0))
    rows += [(500 + i, x) for i, x in enumerate(AWKWARD)] + [rows[0]]
    return docs(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), len(rows)


def test_quality_of_pages(pages, docs):
    d, labels, n = pages
    out = held_out(F.col("doc_id"), 3, 1)
    model = line_crf.fit(d, labels, ~out, sample=60)
    got = line_crf.score(d, model).collect()
    assert len(got) == n and all(0 <= r.score <= 1 for r in got)
    assert np.mean([(r.score >= 0.5) == (r.doc_id % 3 != 0) for r in got if r.doc_id < 240]) > 0.97
    lines = {r.doc_id: r.n_lines for r in got}
    assert all(lines[500 + i] == brute.measures(x)["n_lines"] for i, x in enumerate(AWKWARD))
    assert line_crf.fit(d, labels.where("quality = 1"), ~out) is None
    assert {r.score for r in line_crf.score(d, None).collect()} == {0.5}
    assert line_crf.score(docs([]), model).count() == 0


def test_toxicity(spark, docs):
    rnd = random.Random(6)
    rows, labels = [], []
    for i in range(600):
        w = prose(rnd, rnd.choice(list(WORDS)), rnd.randint(10, 40)).split()
        if i % 4 == 0:
            for _ in range(5):
                w.insert(rnd.randrange(len(w)), rnd.choice(["zrkidiot", "zrkidioten", "qvmoron"]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 4 == 0)))
    rows += [(900 + i, x) for i, x in enumerate(AWKWARD)]
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    d, out = docs(rows), held_out(F.col("doc_id"), 5, 0)
    model = toxicity.fit(d, lab, ~out)
    got = toxicity.score(d, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert np.mean([(r.score >= 0.5) == (r.doc_id % 4 == 0) for r in got if r.doc_id < 600]) > 0.95
    blank = [r.per_char for r in got if r.doc_id >= 900 and len(AWKWARD[r.doc_id - 900] or "") < 2]
    assert blank == [0.0] * len(blank)
    assert {r.score for r in toxicity.score(d, toxicity.fit(d, lab.where("toxic = 0"), ~out)).collect()} == {0.0}
    assert toxicity.score(docs([]), model).count() == 0


def test_lower_orders_sum_to_one(spark, docs):
    rows = [(i, "abab cab bca " * 5 + "cc" * i) for i in range(30)]
    lab = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, toxic int")
    model = toxicity.fit(docs(rows), lab, F.lit(True))
    grid = model.shared.reshape(256, 256).sum(axis=1)
    np.testing.assert_allclose(grid, 1, atol=1e-4)
    assert all((t >= 0).all() and (t <= 1 + 1e-6).all() for t in [*model.high.values(), *model.back.values()])


def test_kneser_ney_against_plain_counts(spark, docs, monkeypatch):
    """Continuation counts, backoff weights and the best passage, by dictionaries of byte strings."""
    rnd = random.Random(9)
    rows = [(i, "".join(rnd.choice("abc d"[:3 + i % 3]) for _ in range(rnd.randint(0, 90)))) for i in range(60)]
    lab = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "KEPT_BACK", 0.0)
    model = toxicity.fit(docs(rows), lab, F.lit(True))
    d = toxicity.DISCOUNT
    n = {(k, c): Counter(x.encode()[j:j + k] for i, x in rows if i % 2 == c for j in range(len(x) - k + 1))
         for k in (2, 3, 4) for c in (0, 1)}
    pairs = set(n[2, 0]) | set(n[2, 1])
    triples = set(n[3, 0]) | set(n[3, 1])
    two = {g: max(1, len({t for t in triples if t[1:] == g})) for g in pairs}
    ones = Counter(g[1:] for g in pairs)

    def p1(w):
        return (ones[w] + 0.5) / sum(ones[bytes([b])] + 0.5 for b in range(256))

    def backed(counts, ctx, w, lower):
        own = {g: x for g, x in counts.items() if g[:-1] == ctx}
        total = sum(own.values())
        return (max(own.get(ctx + w, 0) - d, 0) + d * len(own) * lower) / total if total else lower

    def p(c, ctx, w):
        low = backed(two, ctx[-1:], w, p1(w))
        if len(ctx) >= 2:
            three = {g: max(1, len({q for q in n[4, c] if q[1:] == g})) for g in n[3, c]}
            low = backed(three, ctx[-2:], w, low)
        return backed(n[4, c], ctx[-3:], w, low) if len(ctx) >= 3 else low

    texts = ["abca dab cab", "ab", "a", "", "zzab c" * 4 + "abc" * 9]
    block, = grams.blocks(pa.array(texts))
    total, peak, scored = model.difference(block)
    for i, x in enumerate(texts):
        raw = x.encode()
        by = [math.log(p(1, raw[max(0, j - 3):j], raw[j:j + 1]) / p(0, raw[max(0, j - 3):j], raw[j:j + 1])) for j in range(1, len(raw))]
        assert scored[i] == len(by) and total[i] == pytest.approx(sum(by), abs=1e-3)
        sums = [sum(by[max(0, j - toxicity.PASSAGE):j]) for j in range(1, len(by) + 1)]
        assert peak[i] == pytest.approx(max(sums, default=0.0), abs=1e-3)


def test_seating_keeps_customers_in_bounds():
    rng = np.random.default_rng(1)
    c = np.array([0, 1, 2, 3, 10, 100, 5000, 200000])
    for a in (1e-9, 0.5, 30.0):
        t = hpy_lm.seat(c, np.full(len(c), a), 0.6, rng)
        assert (t <= c).all() and (t[1:] >= 1).all() and t[0] == 0
    assert hpy_lm.seat(c, np.full(len(c), 1e-9), 0.6, rng).max() == 1


def test_seating_follows_the_restaurant_distribution():
    # two customers of one dish sit apart in proportion to a against 1 - d
    a, d = 0.7, 0.4
    t = hpy_lm.seat(np.full(40_000, 2), np.full(40_000, a), d, np.random.default_rng(3))
    assert abs((t == 2).mean() - a / (a + 1 - d)) < 0.02


def test_spelling_is_a_distribution():
    rng = np.random.default_rng(2)
    words = pa.array([b"abc", b"", "é".encode(), b"abba"], pa.binary())
    before, symbol, n = hpy_lm.spelled(words)
    assert n.tolist() == [4, 1, 3, 5] and symbol[:4].tolist() == [*b"abc", 32] and before[4] == 32 * 256 + 32
    pairs = np.unique(np.stack([before, symbol]), axis=1)
    s = hpy_lm.fit_spelling(pairs[0], pairs[1], np.full(pairs.shape[1], 7), rng)
    np.testing.assert_allclose(s.p.sum(axis=1), 1, atol=1e-9)
    assert (s.p > 0).all()


def test_language_model(spark, docs):
    rnd = random.Random(8)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(rnd.choice(vocabulary[:rnd.choice([5, 50, 300])]) for _ in range(rnd.randint(0, 80))) + f" u{i} v{i} w{i}x") for i in range(150)]
    rows += [(500 + i, x) for i, x in enumerate(AWKWARD)] + [rows[4], rows[4], (None, "w1 w2 never-seen")]
    d, train = docs(rows), ~held_out(F.col("doc_id"), 7, 2)
    scored, model = hpy_lm.fit_and_score(d, train)
    got = scored.collect()
    assert len(got) == len(rows)
    count = Counter()
    for i, x in rows:
        if i is None or not brute.held_out(i, 7, 2):
            count.update([*brute.words(x), b""])
    n, v = sum(count.values()), len(count)
    assert (model.tokens, model.types) == (n, v)
    want = Counter()
    for i, x in rows:
        w = [*brute.words(x), b""]
        want[i, len(w), sum(count[t] > 0 for t in w), round(sum(math.log10((count[t] + 1) / (n + v + 1)) for t in w), 6)] += 1
    assert Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    held = [r for r in got if r.doc_id is not None and r.doc_id < 150 and brute.held_out(r.doc_id, 7, 2)]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert all(r.score < 0 for r in got)
    empty, _ = hpy_lm.fit_and_score(docs([]), train)
    assert empty.count() == 0
    none, m = hpy_lm.fit_and_score(docs([(1, "a b")]), F.lit(False))
    assert m.tokens == 0 and [(r.n_tokens, r.n_known, r.score) for r in none.collect()] == [(3, 0, 0.0)]


def test_order_and_spelling_count(spark, docs):
    rows = [(i, "north wind blows cold " * 5 + "summer rain falls warm " * 5) for i in range(40)]
    shuffled = " ".join(random.Random(4).sample(rows[0][1].split(), 40))
    rows += [(100, rows[0][1]), (101, shuffled), (102, "north cold wind"), (103, "north colder wind"), (104, "north \x01\x02\x03qqqq wind"),
             (None, "north cold wind"), (102, "north cold wind")]
    scored, model = hpy_lm.fit_and_score(docs(rows), F.col("doc_id") < 100)
    got = [(r.doc_id, r.n_tokens, r.score) for r in scored.collect()]
    assert len(got) == len(rows)
    by = {k: s for k, _, s in got}
    assert by[100] > by[101] + 10 and by[103] > by[104] + 1
    assert by[None] == pytest.approx(by[102]) and sum(k == 102 for k, _, _ in got) == 2
    # what follows a word sums to one with the share of words never seen
    own = [r.own for p in model.own for r in p.collect()]
    known = {r.h: r for r in model.known.collect()}
    assert sum(own) < sum(r.c for r in known.values())
    opened = sum(r.opened for r in known.values())
    assert sum(own) == pytest.approx(model.tokens - model.discount * opened)


def test_seating_of_pairs_is_averaged(spark, docs):
    rnd = random.Random(6)
    rows = [(i, " ".join(f"w{min(rnd.randint(0, 30), rnd.randint(0, 30))}" for _ in range(40))) for i in range(60)]
    d = docs([*rows, (100, "w1 w2 unseen w1")])
    model = hpy_lm.fit_contexts(d, F.col("doc_id") < 100)
    known = {r.h: r for r in model.known.collect()}
    assert model.samples == 2 and all(len(r.ps) == len(r.opens) == 2 and r.opened == sum(r.opens) / 2 for r in known.values())
    assert any(r.opens[0] != r.opens[1] for r in known.values()) and any(r.ps[0] != r.ps[1] for r in known.values())
    own = {r.key: r.own for p in model.own for r in p.collect()}
    got = {r.doc_id: r.score for r in hpy_lm.score(d, model).collect()}
    for i, text in (rows[0], rows[7], (100, "w1 w2 unseen w1")):
        h = hpy_lm.word_hashes(pa.array([*(x.encode() for x in text.split()), b""], pa.binary()))
        want = 0.0
        for u, w in zip([0, *h[:-1].tolist()], h.tolist(), strict=True):
            pair = np.array([u, w], dtype=np.int64).view(np.uint64)
            key = int(grams.mix(grams.mix(pair[:1] + np.uint64(1)) + pair[1:]).view(np.int64)[0])
            back = [(hpy_lm.THETA + model.discount * o) * p for o, p in zip(known[u].opens, known[w].ps, strict=True)]
            want += math.log10((own.get(key, 0.0) + sum(back) / 2) / (known[u].c + hpy_lm.THETA))
        assert got[i] == pytest.approx(want, abs=1e-9)


def test_superseded_tables_leave_the_disk(spark, docs, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_folder", lambda _: str(tmp_path))
    rows = [(i, " ".join(f"w{(i * j) % 13}" for j in range(30)) + f" once{i}") for i in range(20)]
    model = hpy_lm.fit_contexts(docs(rows), F.lit(True))
    left = Counter(p.name.rsplit("-", 1)[0] for p in (tmp_path / "landed").iterdir() if any(p.glob("*.parquet")))
    assert left == Counter({"states": 1} | {f"{x}-{i}": 1 for x in ("single", "seated") for i in range(hpy_lm.PARTS)})
    words = Counter((a, b) for _, x in rows for a, b in zip(["", *x.split()], [*x.split(), ""], strict=True))
    own = [r for p in model.own for r in p.collect()]
    assert Counter(r.c for r in own) == Counter(words.values()) and len({r.key for r in own}) == len(words)
    assert all(r.own == pytest.approx(1 - model.discount) for r in own if r.c == 1)


def test_word_probabilities_sum_below_one(spark, docs):
    d = docs([(i, f"a b c d{i} e{i % 5}") for i in range(60)])
    words = hpy_lm.vocabulary(d, F.lit(True)).cache()
    p = hpy_lm.probabilities(words, hpy_lm.fit(words)).collect()
    total = sum(10 ** r.logp for r in p)
    assert 0.5 < total < 1
    assert len(grams.hash_column(pa.array(["a", None, ""]))) == 3


def test_words_and_pairs_counted_in_small_blocks(docs, monkeypatch):
    d = docs([(i, f"a b c{i % 3} a b") for i in range(40)])

    def counted():
        words = hpy_lm.vocabulary(d, F.col("doc_id") < 30, unseen=True)
        pairs = [hpy_lm.pairs(d, F.col("doc_id") < 30, "text", i) for i in range(hpy_lm.PARTS)]
        return [sorted(map(tuple, x.collect())) for x in (words, *pairs)]

    whole = counted()
    assert hpy_lm.COUNTED <= 4 << 20
    monkeypatch.setattr(hpy_lm, "COUNTED", 30)
    assert counted() == whole and sum(map(len, whole)) > 8


def test_rare_words_and_packed_pairs(spark, docs, monkeypatch):
    monkeypatch.setattr(hpy_lm, "FREQUENT", 6)
    rnd = random.Random(9)
    rows = [(i, " ".join(f"w{min(rnd.randint(0, 25), rnd.randint(0, 25))}" for _ in range(30)) + f" u{i}") for i in range(50)]
    d, train = docs([*rows, (100, "w1 unseen w1 u3 w24 w1 unseen"), (100, "w2 w1"), (101, None)]), F.col("doc_id") < 100
    top = np.sort(hpy_lm.word_hashes(pa.array([b"", b"w1", b"w2"], pa.binary())))
    packed = hpy_lm.pairs(d, train, "text", 0, spark.sparkContext.broadcast(top))
    assert packed.count() <= 64
    count = Counter((a, b) for _, x in rows for a, b in zip(["", *x.split()], [*x.split(), ""], strict=True))
    assert packed.agg(F.sum("ones")).first()[0] == sum(c == 1 for c in count.values())
    assert sorted(r.c for r in hpy_lm.spread(packed, c=np.int64).collect()) == sorted(c for c in count.values() if c > 1)
    model = hpy_lm.fit_contexts(d, train)
    known = {r.h: r for r in model.known.collect()}
    assert 1 <= sum(r.c >= model.least for r in known.values()) <= 6
    own = {r.key: r.own for p in model.own for r in p.collect()}
    assert len(own) == len(count)
    got = {(r.doc_id, r.n_tokens): r.score for r in hpy_lm.score(d, model).collect()}
    for i, text in (rows[0], rows[9], (100, "w1 unseen w1 u3 w24 w1 unseen"), (100, "w2 w1"), (101, "")):
        h = hpy_lm.word_hashes(pa.array([*(x.encode() for x in text.split()), b""], pa.binary()))
        want = 0.0
        for u, w in zip([0, *h[:-1].tolist()], h.tolist(), strict=True):
            pair = np.array([u, w], dtype=np.int64).view(np.uint64)
            back = [(hpy_lm.THETA + model.discount * o) * p for o, p in zip(known[u].opens, known[w].ps, strict=True)]
            joint = int(hpy_lm.joint_key(pair[:1], pair[1:]).view(np.int64)[0])
            want += math.log10((own.get(joint, 0.0) + sum(back) / 2) / (known[u].c + hpy_lm.THETA))
        assert got[i, len(h)] == pytest.approx(want, abs=1e-9)
