"""The joins: near copies and benchmark items, held against all pairs."""
import random

import brute
from brute import AWKWARD

from pitscreen.llm import components as stars_module
from pitscreen.llm import decontaminate, ngram_join
from pitscreen.llm.components import components


def text(rnd, n, vocabulary=400):
    return " ".join(f"w{rnd.randrange(vocabulary)}" for _ in range(n))


def changed(rnd, x, times):
    w = x.split()
    for _ in range(times):
        w[rnd.randrange(len(w))] = f"n{rnd.randrange(10 ** 6)}"
    return " ".join(w)


def corpus(rnd):
    rows = list(enumerate(AWKWARD))
    passage = text(rnd, 30)
    for g in range(6):
        base = text(rnd, rnd.randint(30, 200))
        for _ in range(rnd.randint(1, 12)):
            rows.append((len(rows), changed(rnd, base, rnd.choice([0, 0, 1, 1, 2, 3, 4]))))
    rows += [(len(rows) + i, passage + " " + text(rnd, rnd.randint(2, 40))) for i in range(15)]
    hub = text(rnd, 160)
    rows += [(len(rows) + i, changed(rnd, hub, 3)) for i in range(40)]
    return rows + [rows[20], (1000, rows[25][1].upper())]


def test_groups_match_all_pairs(spark, docs, monkeypatch):
    monkeypatch.setattr(ngram_join, "FRAGMENT", 500)  # many fragments
    rows = corpus(random.Random(5))
    got = sorted((r.doc_id, r.n_shingles, r.component) for r in ngram_join.groups(docs(rows)).collect())
    want = sorted(brute.groups(rows))
    assert got == want
    kept = ngram_join.representatives(docs(rows))
    assert kept.columns == docs([]).columns
    least = sorted({c for _, n, c in want if n})
    blank = [d for d, n, _ in want if not n]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(least + blank)


def test_link_counts_match_all_pairs(spark, docs, monkeypatch):
    monkeypatch.setattr(ngram_join, "FRAGMENT", 500)
    monkeypatch.setattr(ngram_join, "HOT", 7)  # large buckets are dealt
    rows = corpus(random.Random(5))
    sets = [brute.shingles(x) for _, x in rows]
    want = []
    for i, (a, (key, _)) in enumerate(zip(sets, rows, strict=True)):
        links = sum(100 * len(a & b) >= 80 * len(a | b) for j, b in enumerate(sets) if i != j and a and b)
        want.append((key, len(a), min(k for (k, _), b in zip(rows, sets, strict=True) if a == b) if a else key, links))
    got = sorted((r.doc_id, r.n_shingles, r.class_id, r.n_links) for r in ngram_join.link_counts(docs(rows)).collect())
    assert got == sorted(want) and max(x[3] for x in got) >= 10


def test_exact_threshold(docs):
    # 40 and 45 distinct shingles, 40 of them shared: 40 / 45 is above, 40 / 50 is at 0.8, 40 / 51 is below
    base = [f"a{i}" for i in range(44)]
    rows = [(1, " ".join(base)), (2, " ".join(base + [f"b{i}" for i in range(10)])),
            (3, " ".join([f"c{i}" for i in range(44)])), (4, " ".join([f"c{i}" for i in range(44)] + [f"d{i}" for i in range(11)]))]
    assert {r.doc_id: r.component for r in ngram_join.groups(docs(rows)).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}


def test_null_keys_and_empty_table(docs):
    rows = [(None, "a b c d e f"), (7, "a b c d e f"), (None, "x y"), (8, None)]
    got = ngram_join.groups(docs(rows)).collect()
    assert sorted((r.n_shingles, r.component) for r in got if r.n_shingles == 2) == [(2, 7), (2, 7)]
    assert ngram_join.groups(docs([])).count() == 0 and ngram_join.representatives(docs([])).count() == 0


def test_components(spark):
    rnd = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 50)] + [(200, 201), (201, 200)] + [
        (300 + rnd.randrange(50), 300 + rnd.randrange(50)) for _ in range(60)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    got = {r.node: r.comp for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: root(x) for x in linked}


def contained(rows, items, threshold=0.8):
    out = set()
    for d, x in rows:
        w = (x or "").lower().split()
        for i, y in items:
            v = (y or "").lower().split()
            q = min(5, len(v))
            if not v:
                continue
            want = {tuple(v[k:k + q]) for k in range(len(v) - q + 1)}
            have = {tuple(w[k:k + q]) for k in range(len(w) - q + 1)}
            if len(want & have) >= threshold * len(want) - 1e-12:
                out.add((d, i, len(want), len(want & have)))
    return out


def test_items_in_documents_match_all_pairs(spark, docs):
    rnd = random.Random(9)
    items = [(i, text(rnd, rnd.choice([6, 9, 12, 40, 90, 300]), 50)) for i in range(25)] + [
        (None, "only three words"), (90, "One"), (91, None), (92, "  "), (93, text(random.Random(9), 6, 50))]
    rows = []
    for d in range(60):
        x = text(rnd, rnd.choice([5, 30, 200, 2000]), 60).split()
        for _ in range(rnd.randint(0, 3)):
            at = rnd.randrange(len(x))
            x[at:at] = changed(rnd, rnd.choice(items[:25])[1], rnd.choice([0, 0, 1, 2, 5])).split()
        rows.append((d, " ".join(x)))
    rows += [(70, "here Only  three\nwords are"), (None, None), (72, ""), (73, "zero one two"), rows[3]]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.n_item_shingles, r.n_found) for r in decontaminate.find(docs(rows), bench).collect()}
    want = contained(rows, items)
    assert got == want and len(want) > 20
    clean = decontaminate.clean(docs(rows), bench)
    assert clean.columns == docs([]).columns
    dirty = {d for d, *_ in want}
    assert sorted((r.doc_id is None, r.doc_id) for r in clean.collect()) == sorted(
        (d is None, d) for d, _ in rows if d not in dirty)
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find(docs(rows), none).count() == 0 and decontaminate.clean(docs(rows), none).count() == len(rows)
    assert decontaminate.find(docs([]), bench).count() == 0 and decontaminate.clean(docs([]), bench).count() == 0


def test_probe_stays_in_the_jvm(spark, docs):
    bench = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    plan = decontaminate.find(docs([(1, "a b c d e f g")]), bench)._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "Pandas"))


def test_representatives_land_each_table_that_is_read_twice(docs, monkeypatch):
    seen = []
    monkeypatch.setattr(ngram_join, "settle", lambda df, name, f=ngram_join.settle: seen.append(name) or f(df, name))
    rows = corpus(random.Random(8))
    kept = ngram_join.representatives(docs([*rows, *rows[:5], *rows[:2]]))
    want = brute.groups(rows)
    assert sorted(r.doc_id for r in kept.collect()) == sorted([*{c for _, n, c in want if n}, *(
        d for d, n, _ in [*want, *want[:5], *want[:2]] if not n)])
    assert len(seen) == len(set(seen)) <= 10 and not {"cross-pairs", "near-groups", "repeated-rows"} & set(seen)


def test_few_edges_are_met_by_broadcast(spark, monkeypatch):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 9)]
    seen, found = [], {}
    monkeypatch.setattr(stars_module, "_settled", lambda df, f=stars_module._settled: seen.append(
        df._jdf.queryExecution().optimizedPlan().toString().count("strategy=broadcast")) or f(df))
    for few in (0, stars_module.FEW):
        monkeypatch.setattr(stars_module, "FEW", few)
        seen.clear()
        found[few] = sorted(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
        assert seen[0] == 0 and all((n > 0) == (few > 0) for n in seen[1:])
    assert found[0] == found[few] == sorted([(i, 0) for i in range(41)] + [(100 + i, 100) for i in range(9)])
