"""Minimum variance: invariants, optimality, and the distributed universe solution."""

import numpy as np
import pandas as pd
import pytest

from pitscreen.operators import weights as Wt
from pitscreen.operators.universe_variance import universe_minimum_variance


def random_cov(n, seed=0):
    return np.cov(np.random.default_rng(seed).normal(size=(n * 4, n)).T)


def optimal(cov, w, tol=1e-7):
    """First-order conditions of the long-only problem."""
    g = cov @ w
    held = w > 1e-9
    level = g[held].mean()
    return np.allclose(g[held], level, rtol=tol, atol=tol * level) and (g[~held] >= level * (1 - tol)).all()


@pytest.mark.parametrize("n, seed", [(5, 1), (12, 0), (30, 4), (60, 9)])
def test_long_only_minimum_is_optimal(n, seed):
    cov = random_cov(n, seed)
    w = Wt.minimum_variance(cov)
    assert w.sum() == pytest.approx(1) and (w >= -1e-12).all() and optimal(cov, w)
    ew = np.ones(n) / n
    assert w @ cov @ w <= ew @ cov @ ew + 1e-15


@pytest.mark.parametrize("seed", range(4))
def test_long_only_with_strong_common_factor(seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(400, 1)) @ rng.uniform(0.3, 2.5, (1, 25)) + rng.normal(size=(400, 25))
    cov = Wt.denoised_covariance(x * 0.01)
    w = Wt.minimum_variance(cov)
    assert (w > 1e-9).sum() < 25 and optimal(cov, w)


def test_sector_caps_hold_and_cost_variance():
    cov = random_cov(20, 3)
    sec = np.array([f"S{i % 6}" for i in range(20)])
    w = Wt.sector_capped(cov, sec)
    assert w.sum() == pytest.approx(1) and (w >= 0).all()
    assert max(w[sec == s].sum() for s in set(sec)) <= 0.20 + 1e-6
    free = Wt.minimum_variance(cov)
    assert w @ cov @ w >= free @ cov @ free - 1e-12
    rng = np.random.default_rng(0)
    for _ in range(300):  # no feasible blend does better
        d = rng.dirichlet(np.ones(20))
        if max(d[sec == s].sum() for s in set(sec)) <= 0.20:
            mix = 0.9 * w + 0.1 * d
            assert mix @ cov @ mix >= w @ cov @ w - 1e-12


def test_cap_relaxes_to_the_number_of_sectors():
    w = Wt.sector_capped(random_cov(6, 5), np.array(["a", "a", "a", "b", "b", "b"]))
    assert w[:3].sum() <= 0.5 + 2e-6 and w[3:].sum() <= 0.5 + 2e-6


def test_denoised_covariance_is_symmetric_and_detoning_is_singular():
    rng = np.random.default_rng(2)
    x = rng.normal(0, 0.01, (400, 1)) + rng.normal(0, 0.015, (400, 20))
    kept, gone = Wt.denoised_covariance(x), Wt.denoised_covariance(x, detone=True)
    assert np.allclose(kept, kept.T, atol=1e-10) and np.allclose(gone, gone.T, atol=1e-10)
    assert np.linalg.eigvalsh(kept).min() > 1e-9
    assert np.linalg.eigvalsh(gone).min() < np.linalg.eigvalsh(kept).min() * 1e-3
    sd = x.std(axis=0, ddof=1)  # averaging the noise eigenvalues keeps the correlation's trace
    assert np.trace(kept / np.outer(sd, sd)) == pytest.approx(20)


def sparse_series(spark, x, year=2024, first=None):
    t, n = x.shape
    rows = []
    for j in range(n):
        f = 0 if first is None else first[j]
        at = [i + 1 for i in range(t) if x[i, j] != 0 and i + 1 > f]
        rows.append((year, f"N{j:03d}", int(f), t, at, [float(x[i - 1, j]) for i in at], t - int(f)))
    return spark.createDataFrame(rows, "formation_year int, ticker string, first bigint, sessions bigint, "
                                       "at array<bigint>, r array<double>, n_returns bigint")


def factor_returns(t, n, seed, zeros=0.4):
    rng = np.random.default_rng(seed)
    x = (rng.normal(size=(t, 3)) @ rng.uniform(-0.5, 2.0, (3, n)) + rng.normal(size=(t, n))) * 0.01
    x[rng.random((t, n)) < zeros] = 0.0
    return x


@pytest.mark.parametrize("t, n", [(200, 40), (60, 90)])
def test_universe_solution_equals_the_dense_one(spark, t, n):
    x = factor_returns(t, n, 11, zeros=0.1)
    got = universe_minimum_variance(sparse_series(spark, x).repartition(5)).toPandas().sort_values("ticker")
    cov = Wt.denoised_covariance(x)
    want = Wt.minimum_variance(cov)
    assert got.w.sum() == pytest.approx(1) and (got.w >= 0).all()
    assert np.abs(got.w.to_numpy() - want).max() < 1e-6 and optimal(cov, got.w.to_numpy(), 1e-6)


def test_basket_group_uses_sessions_complete_for_all(spark):
    x = factor_returns(120, 6, 3)
    first = [0, 0, 30, 0, 10, 0]
    s = sparse_series(spark, x, first=first)
    b = spark.createDataFrame([(2024, "b", f"N{j:03d}") for j in range(6)], "formation_year int, book string, ticker string")
    got = Wt.optimised_weights(b, s, "GMV").toPandas().sort_values("ticker")
    assert np.allclose(got.w, Wt.minimum_variance(Wt.denoised_covariance(x[30:])), atol=1e-9)


def test_small_or_unknown_baskets_are_held_equally(spark):
    s = sparse_series(spark, factor_returns(50, 4, 1))
    b = spark.createDataFrame([(2024, "b", f"N{j:03d}") for j in range(4)] + [(2023, "c", "Q1"), (2023, "c", "Q2")],
                              "formation_year int, book string, ticker string")
    got = Wt.optimised_weights(b, s, "GMV").toPandas()
    assert set(got[got.book == "b"].w) == {0.25} and set(got[got.book == "c"].w) == {0.5}
