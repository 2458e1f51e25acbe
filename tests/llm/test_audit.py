"""Divergence of sources, held against plain counting."""
import random
import re
from collections import Counter, defaultdict

import pytest
from brute import AWKWARD

from pitscreen.llm import source_audit as sa

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain(rows, least=10, top=10):
    """rows of (doc_id, text, lang, source)."""
    n, df, groups = Counter(), Counter(), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        words = [w.translate(LOWER) for w in TERM.findall(text or "")]
        n.update((lang, source, w) for w in words)
        df.update((lang, w) for w in set(words))
    kept = defaultdict(list)
    for (lang, w), d in df.items():
        if d >= least:
            kept[lang].append(w)
    out = []
    for lang, source in groups:
        terms, others = kept[lang], sorted(s for g, s in groups if g == lang)
        v = len(terms)

        def p(sources, w):
            total = sum(n[lang, s, x] for s in sources for x in terms)
            return 1 + 10 ** 9 * (sum(n[lang, s, w] for s in sources) + 2) // (total + 2 * v)

        def f(x, y):
            return (x - y) ** 2 // (x + y)

        mine = {w: p([source], w) for w in terms}
        pairs = [(sum(f(mine[w], p([o], w)) for w in terms), o) for o in others if o != source]
        found = [(f(mine[w], p(others, w)), w) for w in terms if n[lang, source, w] and mine[w] > p(others, w)]
        for part, values in (("pair", pairs), ("term", sorted(found, key=lambda x: (-x[0], x[1].encode()))[:top])):
            for rank, (value, item) in enumerate(sorted(values, key=lambda x: (-x[0], x[1].encode())), 1):
                out.append((lang, source, part, item, value, rank))
    return sorted(out)


def rows():
    rnd = random.Random(2)
    words = ["the", "The", "a", "né", "日本", "x1y", "rare", "token", "It's", "MIXED"] + [f"w{'abcdefgh'[i % 8]}{'xyz'[i % 3]}" for i in range(12)]
    out = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 30))), rnd.choice(["en", "en", "fr", None]),
            rnd.choice(["a", "a", "a", "b", "B", "ü", None, ""])) for i in range(160)]
    out += [(500 + i, x, "en", "odd") for i, x in enumerate(AWKWARD)]
    out += [(600, "the the", "xx", "s1"), (601, None, "xx", "s2"), (602, "", "xx", None), (603, "lone", "yy", "s1")]
    return out + [out[0]] * 12


@pytest.mark.parametrize("least", [1, 10])
def test_audit_against_plain_counts(docs, least):
    got = sa.audit(docs(rows()), least_docs=least)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == plain(rows(), least)


def test_parts_of_the_tree_add_up(docs, spark, monkeypatch):
    want = plain(rows(), 2)
    monkeypatch.setattr(sa, "CHUNK", 3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert sorted(map(tuple, sa.audit(docs(rows()), least_docs=2, salts=3).collect())) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_no_rows_and_a_long_text(docs):
    assert sa.audit(docs([])).count() == 0
    long = "alpha beta, " * 100_000 + "\n" + "é" * 200_000
    assert len(long) > 1 << 20
    data = [(1, long, "en", "a"), (2, "alpha gamma", "en", "b")]
    assert sorted(map(tuple, sa.audit(docs(data), least_docs=1).collect())) == plain(data, 1)
