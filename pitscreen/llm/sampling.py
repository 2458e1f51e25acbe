"""Bounded samples of labelled rows, and a small logistic calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitscreen.llm.frames import col
from pitscreen.session import land


def labelled_sample(labels: DataFrame, label: str, train: Column, sample: int, key: str = "doc_id") -> DataFrame:
    """(key, y, u): about ``sample`` labelled keys of each class, as many of one as of the other.

    Keys are chosen by hash, so the choice does not depend on partitioning. ``u`` in [0, 1) splits
    the sample further. At most about 2 * sample rows: small enough to broadcast by construction.
    Labels other than 0 and 1 are left out; a key labelled twice counts as its larger label.
    """
    rows = labels.where(train & col(label).isin(0, 1) & col(key).isNotNull()).groupBy(col(key).alias("key")).agg(
        F.max(col(label)).cast("int").alias("y"))
    sizes = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return rows.withColumn("u", F.lit(0.0)).where(F.lit(False))
    want = min(sample, *sizes.values())

    def uniform(salt: int) -> Column:
        return F.pmod(F.xxhash64(F.col("key").cast("string"), F.lit(salt)), F.lit(1 << 30)).cast("double") / float(1 << 30)

    share = F.when(F.col("y") == 1, F.lit(want / sizes[1])).otherwise(F.lit(want / sizes[0]))
    return land(rows.where(uniform(3) < share).withColumn("u", uniform(5)), "labelled-sample")


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Newton's method: (mean, deviation, weights with the intercept first) for clipped standard scores."""
    mean, dev = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    a = np.c_[np.ones(len(x)), np.clip((x - mean) / dev, -8, 8)]
    w = np.zeros(a.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (weight * (p - y)) + ridge * w
        h = (a * (weight * p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return mean, dev, w


def apply_logistic(x: np.ndarray, fitted: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    mean, dev, w = fitted
    a = np.c_[np.ones(len(x)), np.clip((x - mean) / dev, -8, 8)]
    return 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
