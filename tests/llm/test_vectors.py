"""Vector search, held against all pairs."""
import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitscreen.llm import vector_search as vs
from pitscreen.llm.catalog import QUERIES
from pitscreen.llm.frames import table


def schema(kind=None):
    return T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(kind or T.FloatType())),
                         T.StructField("id", T.StringType()), T.StructField("v", T.StringType()), T.StructField("block", T.IntegerType())])


def plain(rows, k=20, every=20):
    """(query, rank, vec_id, score), by all pairs; rows are (vec_id, vector)."""
    sizes = [len(x) for _, x in rows if x]
    dim = max(set(sizes), key=lambda n: (sizes.count(n), n)) if sizes else 0
    ok = [(i, np.array(x, np.float32).astype(float)) for i, x in rows
          if i is not None and x and len(x) == dim and None not in x and np.isfinite(np.array(x, float)).all() and any(x)]
    out = []
    for q in sorted({i for i, _ in ok if i % every == 0}):
        found = set()
        for i, x in ok:
            if i != q:
                for j, y in ok:
                    if j == q:
                        s = 0.0
                        for a, b in zip(y, x):
                            s += a * b
                        found.add((-s, i))
        out += [(q, r, i, -s) for r, (s, i) in enumerate(sorted(found)[:k], 1)]
    return out


def run(spark, rows, kind=None, **more):
    d = spark.createDataFrame([(i, x, "x", "y", 1) for i, x in rows], schema(kind))
    got = vs.nearest(d, F.col("vec_id") % 20 == 0, **more)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(map(tuple, got.collect()))


def some(n, dim=24, seed=1):
    rnd = np.random.default_rng(seed)
    return [(i, rnd.standard_normal(dim).astype(np.float32).tolist()) for i in range(n)]


def test_odd_rows_and_ties(spark):
    rows = some(150)
    common = rows[3][1]
    rows += [(1000 + i, common) for i in range(60)] + [(1000, common), (40, rows[40][1]), (40, rows[40][1]), (60, rows[7][1])]
    rows += [(2000, None), (2020, [0.0] * 24), (2040, [float("nan")] * 24), (2060, [1.0] * 23 + [None]), (2080, [float("inf")] * 24),
             (2100, [1.0] * 7), (2120, []), (None, rows[0][1]), (2140, [5.0] * 24), (-20, [-2.0] * 24)]
    assert run(spark, rows) == plain(rows)


def test_lists_that_are_all_probed_are_exact(spark, monkeypatch):
    monkeypatch.setattr(vs, "WHOLE", 50)
    monkeypatch.setattr(vs, "ROWS", 37)
    monkeypatch.setattr(vs, "QUERIES", 3)
    monkeypatch.setattr(vs, "TABLE", 500)
    monkeypatch.setattr(vs, "SHARE", 4)
    monkeypatch.setattr(vs, "EPSILON", 50.0)  # no hypothesis is rejected that could be true
    rows = some(900)
    rows += [(5000 + i, rows[11][1]) for i in range(500)]
    assert run(spark, rows, probes=1000) == plain(rows)
    doubles = [(i, [float(v) for v in x]) for i, x in some(300, 5)]
    assert run(spark, doubles, T.DoubleType(), probes=1000, k=3) == plain(doubles, 3)


def test_few_candidates_and_none(spark):
    rows = some(6)
    assert run(spark, rows) == plain(rows) and len(plain(rows)) == 5
    assert run(spark, []) == [] and run(spark, [(1, [1.0, 2.0]), (2, [2.0, 1.0])]) == []
    assert run(spark, [(0, None), (20, [])]) == [] and run(spark, [(0, [0.0, 0.0]), (1, [0.0, 0.0])]) == []
    whole = [(i, [i, 1]) for i in range(30)]
    assert run(spark, whole, T.IntegerType()) == plain(whole)


@pytest.mark.parametrize("name", ["sf0.1", "check_s"])
def test_recall(spark, name):
    d = table(spark, f"/root/testdata/{name}", "embeddings")
    got = QUERIES["op12_vector_search"](spark, f"/root/testdata/{name}").toArrow()
    p = d.toArrow()
    ids, x = p["vec_id"].to_numpy(), np.array(p["embedding"].to_pylist())
    asked = np.flatnonzero(ids % 20 == 0)
    assert got.num_rows == 20 * len(np.unique(ids[asked]))
    score = x[asked] @ x.T
    score[ids[asked][:, None] == ids[None, :]] = -np.inf
    least = dict(zip(ids[asked].tolist(), np.sort(score, axis=1)[:, -20].tolist()))
    hit = [s >= least[q] - 1e-9 for q, s in zip(got["query_id"].to_pylist(), got["score"].to_pylist())]
    assert np.mean(hit) >= (1.0 if name == "sf0.1" else 0.93)


def test_lists_follow_structure(spark, monkeypatch):
    """Clustered vectors need few lists, and large lists are cut."""
    monkeypatch.setattr(vs, "WHOLE", 1000)
    rnd = np.random.default_rng(4)
    middle = rnd.standard_normal((30, 24)) * 3
    x = (middle[np.minimum(rnd.integers(0, 45, 6000), 29)] + 0.3 * rnd.standard_normal((6000, 24))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    seen = []
    old = vs._packed
    monkeypatch.setattr(vs, "_packed", lambda index, sizes, least, most: (seen.append((index.probes, index.lists)), old(index, sizes, 64, 100)))
    got = run(spark, rows)
    assert seen[0][0] < seen[0][1] / 2
    s = x[::20].astype(float) @ x.astype(float).T
    s[np.arange(300), np.arange(0, 6000, 20)] = -np.inf
    least = np.sort(s, axis=1)[:, -20]
    assert np.mean([g[3] >= least[g[0] // 20] - 1e-9 for g in got]) >= 0.9 and len(got) == 6000
