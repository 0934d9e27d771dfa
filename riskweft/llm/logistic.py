"""Logistic calibration: of a bounded sample, and of any number of rows by sums that Spark makes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 30) -> np.ndarray:
    """Newton weights (last one constant).  One class only, or no rows, gives that class's smoothed rate."""
    x = np.column_stack([x, np.ones(len(x))]) if len(x) else np.zeros((0, np.shape(x)[1] + 1))
    w = np.zeros(x.shape[1])
    if len(np.unique(y)) < 2:
        w[-1] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)) if len(y) else 0.0
        return w
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        curve = np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve((x * curve[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit_logistic_rows(
    rows: DataFrame, x: str, y: str, size: int, ridge: float = 1e-2, rounds: int = 30
) -> np.ndarray:
    """``fit_logistic`` of a stored table in which both classes weigh the same; ``x`` is a column of ``size`` numbers.

    Every round is one aggregate; a row of the smaller class counts as often as it takes to match the larger one.
    """
    w = np.zeros(size + 1)
    held = {r["y"]: r["n"] for r in rows.groupBy(F.col(y).cast("int").alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(held) < 2:
        n, ones = sum(held.values()), held.get(1, 0)
        w[-1] = np.log((ones + 0.5) / (n - ones + 0.5)) if n else 0.0
        return w
    most = max(held.values())
    times = [most / held[k] for k in (0, 1)]
    rows, k = rows.select(F.col(x), F.col(y).cast("int")), size + 1
    names = [f"s{i}" for i in range(k + k * k)]
    penalty = np.full(k, ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        sums = rows.mapInArrow(_sums(w.copy(), times), ", ".join(f"{n} double" for n in names))
        row = np.array(sums.agg(*[F.sum(n) for n in names]).first(), float)
        step = np.linalg.solve(row[k:].reshape(k, k) + np.diag(penalty), row[:k] - penalty * w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def _sums(w: np.ndarray, times: list[float]):
    """Slope and curvature of the likelihood at ``w``, a row for each batch of (numbers, class)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column(1).to_numpy()
            x = np.column_stack([batch.column(0).flatten().to_numpy().reshape(len(y), -1), np.ones(len(y))]) if len(y) else np.zeros((0, len(w)))
            p, n = logistic(x[:, :-1], w), np.array(times)[y]
            curve = n * np.maximum(p * (1 - p), 1e-6)
            found = np.concatenate([x.T @ (n * (y - p)), ((x * curve[:, None]).T @ x).ravel()])
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in found], names=[f"s{i}" for i in range(len(found))])

    return run


def logistic(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
