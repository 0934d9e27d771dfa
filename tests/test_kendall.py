"""Kendall matrices over rows that repeat."""

import math

import numpy as np
import pytest

from riskweft.operators import matrix as X


def test_kendall_matrix_counts_equal_rows_once(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(float(a), float(b), float(c)) for a, b, c in rng.integers(0, 4, (300, 3))] + [(1.0, None, 2.0)] * 3
    df = spark.createDataFrame(rows, "a double, b double, c double")
    seen, real = [], X._tau
    monkeypatch.setattr(X, "_tau", lambda df, *rest: seen.append(df.count()) or real(df, *rest))
    got = {(r.column1, r.column2): r.value for r in X.correlation_matrix(df, method="kendall").collect()}
    assert seen == [len(set(rows))] * 3
    cells = list(zip(*rows))
    for i, a in enumerate("abc"):
        for j, b in enumerate("abc"):
            pairs = [(x, y) for x, y in zip(cells[i], cells[j]) if None not in (x, y)]
            x, y = (np.sign(np.subtract.outer(v, v)) for v in zip(*pairs))
            want = (x * y).sum() / math.sqrt((x * x).sum() * (y * y).sum())
            assert got[a, b] == pytest.approx(want)
