"""Average ranks where one value has most rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweft.operators import matrix as X


def brute_ranks(values):
    v = np.asarray(values, float)
    return (v[:, None] > v[None, :]).sum(axis=1) + ((v[:, None] == v[None, :]).sum(axis=1) + 1) / 2


def test_ranks_of_frequent_values_are_found_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(X, "RANK_ROWS", 100, raising=False)
    rng = np.random.default_rng(4)
    x = [*rng.normal(size=500).round(3), *[7.5] * 300, *[float("-inf"), -0.0, 0.0] * 100]
    y = np.where(rng.random(len(x)) < 0.9, 0.0, rng.integers(0, 50, len(x)) - 25.0)
    rows = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double").coalesce(1)
    ranked = X.average_ranks(rows, ["x", "y"])
    got = sorted(map(tuple, ranked.collect()))
    assert got == sorted(zip(brute_ranks(x), brute_ranks(y)))
    sizes = [r["count"] for r in ranked.groupBy(F.spark_partition_id().alias("task")).count().collect()]
    assert max(sizes) <= 300 and sum(sizes) == len(x)
    want = np.corrcoef(brute_ranks(x), brute_ranks(y))[0, 1]
    assert X.spearman_pair(rows, "x", "y").first()[0] == pytest.approx(want)


def test_ranks_of_no_rows(spark):
    empty = spark.createDataFrame([], "x double, y double")
    assert X.average_ranks(empty, ["x", "y"]).count() == 0
