"""Neighbours of rows in keys that span many short blocks."""

import random

import pytest

from riskweft.operators import rolling


@pytest.mark.parametrize("offset", [-3, -1, 0, 1, 3])
def test_neighbours_over_many_short_blocks(spark, offset):
    rng = random.Random(offset)
    rows = [(rng.choice(["a", "a", "a", "b", None]), i, rng.choice([None, i * 2])) for i in range(60)]
    rows += [("only", 5, 1)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        got = rolling.neighbours(spark.createDataFrame(rows, "k string, t int, v int"), {"w": "v", "u": "t"}, ["t"], by=["k"], offset=offset)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert got.columns == ["k", "t", "v", "w", "u"] and "Join" not in plan  # rows never meet rows by position
        want = []
        for key in {r[0] for r in rows}:
            own = sorted((r for r in rows if r[0] == key), key=lambda r: r[1])
            for i, r in enumerate(own):
                other = own[i - offset] if 0 <= i - offset < len(own) else (None, None, None)
                want.append((*r, other[2], other[1]))
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
