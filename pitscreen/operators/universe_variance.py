"""Long-only minimum variance over a whole universe, without an n x n matrix.

The correlation of n names over T sessions has rank below T, and denoising replaces every
eigenvalue but the m signal ones by one number mu. So the cleaned matrix is
mu * I + sum_j (lambda_j - mu) v_j v_j', and

* the eigenvalues come from the T x T Gram matrix, summed over names task by task;
* a name's loadings v_j need only its own returns;
* the optimum is u_i = max(0, 1/s_i - sum_j (lambda_j - mu) f_j v_j(i)) / mu for an m-vector
  f, found by Newton steps that each need one m x m sum over the names.

Names never meet in one task; T and m are bounded by the sessions of the window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from pitscreen.operators.paths import YEAR
from pitscreen.operators.weights import noise_ceiling, noise_level
from pitscreen.session import land

MAX_STEPS = 100
#: Names whose returns are laid out at once, 8 bytes * NAMES a session of the window, and sessions of the Gram matrix summed in one group.
NAMES, SESSIONS = 512, 64


def windows(series: DataFrame) -> DataFrame:
    """(formation_year, start, total, names): one row a year."""
    return series.groupBy(YEAR).agg(F.max("first").alias("start"), F.max("sessions").alias("total"),
                                    F.count("*").alias("names"))


def _centred(at: pa.ListArray, r: pa.ListArray, total: int, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Names x complete sessions: the centred and scaled returns of some names, and each one's sd."""
    size = pc.list_value_length(at).to_numpy(zero_copy_only=False)
    when, moved = np.asarray(at.flatten(), dtype=np.int64), np.asarray(r.flatten(), dtype=float)
    name = np.repeat(np.arange(len(size)), size)
    keep = when > start
    x = np.zeros((len(size), total - start))
    x[name[keep], when[keep] - start - 1] = moved[keep]
    sd = x.std(axis=1, ddof=1, keepdims=True)
    x -= x.mean(axis=1, keepdims=True)
    return np.divide(x, sd, out=np.zeros_like(x), where=sd > 0), sd[:, 0]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, pa.RecordBatch]]:
    """(formation_year, total, start, rows): at most ``NAMES`` rows of one year at a time."""
    for batch in batches:
        years = np.asarray(batch[YEAR])
        for year in np.unique(years):
            mine = np.flatnonzero(years == year)
            for i in range(0, len(mine), NAMES):
                some = batch.take(pa.array(mine[i:i + NAMES]))
                yield int(year), some["total"][0].as_py(), some["start"][0].as_py(), some


def _lists(x: np.ndarray) -> pa.ListArray:
    """The rows of a matrix."""
    return pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], np.ascontiguousarray(x).ravel())


def gram(series: DataFrame, fan: int = 32) -> DataFrame:
    """(formation_year, t, row): rows of the summed T x T Gram matrix.

    Every task sums its names first, a block at a time. The tasks' matrices are merged in two levels: ``fan`` groups
    of tasks are summed, then the groups. A sum meets ``SESSIONS`` rows of each matrix: with 1,000 tasks of at most 32.
    """
    def partial(batches):
        group, sums = TaskContext.get().partitionId() % fan, {}
        for year, total, start, some in _blocks(batches):
            z, _ = _centred(some["at"], some["r"], total, start)
            sums[year] = sums.get(year, 0) + z.T @ z
        for year, m in sums.items():
            for t in range(0, len(m), SESSIONS):
                rows = m[t:t + SESSIONS]
                n = len(rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, x, np.int32)) for x in (year, group, t // SESSIONS)]
                    + [pa.array(np.arange(t, t + n, dtype=np.int32)), _lists(rows)], [YEAR, "part", "of", "t", "row"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        t, at = np.unique(pdf["t"], return_inverse=True)
        total = np.zeros((len(t), len(pdf["row"].iloc[0])))
        for i, row in zip(at, pdf["row"]):
            total[i] += row
        return pd.DataFrame({c: pdf[c].iloc[0] for c in (YEAR, "part", "of")} | {"t": t, "row": list(total)})

    schema = f"{YEAR} int, part int, of int, t int, row array<double>"
    merged = (series.select(YEAR, "total", "start", "at", "r").mapInArrow(partial, schema)
              .groupBy(YEAR, "part", "of").applyInPandas(add, schema))
    return merged.groupBy(YEAR, "of").applyInPandas(add, schema).select(YEAR, "t", "row")


def spectrum(gram_rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """(formation_year, mu, lam, q): noise level, signal eigenvalues, Gram eigenvectors.

    One group is a T x T matrix, T being the sessions of a fixed window.
    """

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["names"].iloc[0])
        g = np.stack(pdf.sort_values("t")["row"])
        t = len(g)
        lam, q = np.linalg.eigh(g / (t - 1))
        signal = lam >= noise_ceiling(t, n)
        if signal.sum() >= n:
            signal[np.argsort(lam)[: len(lam) - n + 1]] = False
        lam, q = lam[signal], q[:, signal]
        mu = noise_level(lam, n)
        return pd.DataFrame({YEAR: [pdf[YEAR].iloc[0]], "mu": [mu], "lam": [lam],
                             "q": [(q / np.sqrt((t - 1) * lam)).T.ravel()]})

    return (gram_rows.join(F.broadcast(sizes.select(YEAR, "names")), YEAR).groupBy(YEAR)
            .applyInPandas(solve, f"{YEAR} int, mu double, lam array<double>, q array<double>"))


def loadings(series: DataFrame, spectra: DataFrame) -> DataFrame:
    """(formation_year, ticker, s, v): a name's volatility and signal loadings.

    The eigenvectors, one T x m matrix a formation year, go to each executor once.
    """
    found = {r[YEAR]: (len(r["lam"]), np.asarray(r["q"], dtype=float))
             for r in spectra.select(YEAR, "lam", "q").collect()}
    shared = series.sparkSession.sparkContext.broadcast(found)

    def project(batches):
        for year, total, start, some in _blocks(batches):
            if year not in shared.value:
                continue
            m, q = shared.value[year]
            z, sd = _centred(some["at"], some["r"], total, start)
            yield pa.RecordBatch.from_arrays([some[YEAR].cast(pa.int32()), some["ticker"], pa.array(sd, from_pandas=True), _lists(z @ q.reshape(m, z.shape[1]).T)],
                                             [YEAR, "ticker", "s", "v"])

    return (series.select(YEAR, "ticker", "total", "start", "at", "r")
            .mapInArrow(project, f"{YEAR} int, ticker string, s double, v array<double>"))


def _sums(rows: DataFrame, state: dict[int, tuple]) -> dict[int, np.ndarray]:
    """Per year: m x m sum, m-sum, objective part and active count at the current f."""

    def partial(batches):
        acc: dict[int, np.ndarray] = {}
        for pdf in batches:
            for year, g in pdf.groupby(YEAR):
                mu, a, f = state[year]
                v = np.stack(g["v"]) if len(a) else np.zeros((len(g), 0))
                inv = 1.0 / g["s"].to_numpy()
                gap = inv - v @ (a * f)
                on = gap > 0
                h = v[on].T @ v[on]
                part = np.concatenate([h.ravel(), v[on].T @ inv[on],
                                       [(gap[on] ** 2).sum(), on.sum(), (gap[on] * inv[on]).sum()]])
                acc[year] = acc.get(year, 0) + part
        for year, part in acc.items():
            yield pd.DataFrame({YEAR: [year], "part": [part]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({YEAR: [pdf[YEAR].iloc[0]], "part": [np.sum(np.stack(pdf["part"]), axis=0)]})

    schema = f"{YEAR} int, part array<double>"
    done = rows.mapInPandas(partial, schema).groupBy(YEAR).applyInPandas(add, schema).collect()
    return {r[YEAR]: np.asarray(r["part"]) for r in done}


def universe_minimum_variance(series: DataFrame, book: str = "universe_GMV") -> DataFrame:
    """(formation_year, book, ticker, w) for every name of every year's universe.

    Names that never move have no volatility to scale by and are left out.
    """
    sizes = windows(series)
    placed = series.join(F.broadcast(sizes.drop("names")), YEAR)
    spectra = land(spectrum(gram(placed), sizes), "spectra")
    rows = land(loadings(placed, spectra).where(F.col("s") > 0), "loadings")
    # a handful of numbers per formation year
    state = {r[YEAR]: (r["mu"], np.asarray(r["lam"]) - r["mu"], np.zeros(len(r["lam"])))
             for r in spectra.select(YEAR, "mu", "lam").collect()}
    parts = _sums(rows, state)
    value = lambda year, f, p: ((state[year][1] * f * f).sum() / 2 + p[-3] / (2 * state[year][0]))
    moves: dict[int, tuple[np.ndarray, float]] = {}
    open_years = {year for year, (_, a, _) in state.items() if len(a)}
    for _ in range(MAX_STEPS):
        if not open_years:
            break
        trial = dict(state)
        for year in open_years:
            mu, a, f = state[year]
            if year not in moves:
                m = len(a)
                h, b = parts[year][:m * m].reshape(m, m), parts[year][m * m:m * m + m]
                # stationary point of the current quadratic piece: (I + H A / mu) f = b / mu
                moves[year] = (np.linalg.solve(np.eye(m) + h * a / mu, b / mu) - f, 1.0)
            direction, step = moves[year]
            trial[year] = (mu, a, f + step * direction)
        new = _sums(rows.where(F.col(YEAR).isin(sorted(open_years))), trial)
        for year in list(open_years):
            mu, a, f = state[year]
            g, (direction, step) = trial[year][2], moves[year]
            if value(year, g, new[year]) > value(year, f, parts[year]) * (1 + 1e-12):
                moves[year] = (direction, step / 2)  # overshoot
                if step < 1e-9:
                    open_years.discard(year)
                continue
            state[year], parts[year] = (mu, a, g), new[year]
            del moves[year]
            if np.abs(g - f).max() <= 1e-12 * (1 + np.abs(f).max()):
                open_years.discard(year)
    if open_years:
        raise RuntimeError(f"minimum variance of {sorted(open_years)} did not converge in {MAX_STEPS} steps")
    scale = {y: parts[y][-1] for y in state}

    def finish(batches):
        for pdf in batches:
            for year, g in pdf.groupby(YEAR):
                mu, a, f = state[year]
                inv = 1.0 / g["s"].to_numpy()
                v = np.stack(g["v"]) if len(a) else np.zeros((len(g), 0))
                raw = np.maximum(0.0, inv - v @ (a * f)) * inv
                yield pd.DataFrame({YEAR: year, "book": book, "ticker": g["ticker"],
                                    "w": raw / scale[year]})

    return rows.mapInPandas(finish, f"{YEAR} int, book string, ticker string, w double")
