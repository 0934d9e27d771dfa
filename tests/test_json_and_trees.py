"""Fields of JSON text against Python's reader; tree Shapley values against the definition."""

import itertools
import json
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import functions as F

from riskweft.operators import jsonfields, shapley, treeshap


def kind_of(v):
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "boolean"
    return {dict: "object", list: "array", str: "string", int: "bigint", float: "double"}[type(v)]


def brute_fields(texts):
    counts = Counter()

    def walk(path, v):
        counts[path, kind_of(v)] += 1
        if isinstance(v, dict):
            for k, x in v.items():
                walk(path + "/" + ("~2" if k == "*" else k.replace("~", "~0").replace("/", "~1")), x)
        if isinstance(v, list):
            for x in v:
                walk(path + "/*", x)

    for t in texts:
        try:
            if t is not None:
                walk("", json.loads(t))
        except ValueError:
            counts[None, "malformed"] += 1
    return counts


def random_json(rng, depth=0):
    if depth < 4 and rng.random() < 0.5:
        if rng.random() < 0.3:
            return [random_json(rng, depth + 1) for _ in range(rng.randrange(4))]
        return {k: random_json(rng, depth + 1) for k in rng.sample(["a", "b", "c/d", "e~", "*", "ä"], rng.randrange(4))}
    return rng.choice([None, True, 3, 2.5, "x", ""])


def test_fields_equal_a_plain_reading(spark):
    rng = random.Random(1)
    texts = [json.dumps(random_json(rng)) for _ in range(300)] + [None, "", "{", '{"a":1', "[]", "{}"]
    found = jsonfields.json_fields(spark.createDataFrame([(t,) for t in texts], "j string"), "j").collect()
    want = brute_fields(texts)
    got = {(r.path, k): n for r in found for k, n in r.kinds.items()} | {(None, "malformed"): r.present for r in found if r.path is None}
    assert got == dict(want)
    assert len({r.path for r in found}) == len(found) and want[None, "malformed"] == 3
    for r in found:
        if r.path:
            around, _, last = r.path.rpartition("/")
            parents = want[around, "object"] if last != "*" else r.present
            assert r.parents == parents and r.missing_share == pytest.approx((parents - r.present) / parents)
            assert r.null_share == pytest.approx(want[r.path, "null"] / r.present)


def test_types_join_and_texts_become_columns(spark):
    texts = ['{"a":1,"b":{"c":[1,2.5,null],"d/e":"x"},"n":null}', '{"a":null,"b":{"c":[]},"m":1}', '{"a":2.5,"m":"s"}', "{"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, j string")
    fields = jsonfields.json_fields(df, "j")
    assert jsonfields.schema_text(fields) == "struct<`a`: double, `b`: struct<`c`: array<double>, `d/e`: string>, `m`: string, `n`: string>"
    rows = {r.i: r.v for r in jsonfields.typed_json(df, "j", "v").collect()}
    assert rows[0].b.c == [1.0, 2.5, None] and rows[0].a == 1.0 and rows[1].m == "1" and rows[2].m == "s"
    assert rows[3] is None or rows[3].a is None
    doubled = jsonfields.typed_json(df, "j", "v").select(F.transform("v.b.c", lambda x: x * 2).alias("c")).collect()
    assert doubled[0].c == [2.0, 5.0, None]
    none = jsonfields.json_fields(df.filter("i > 9"), "j")
    assert none.count() == 0 and jsonfields.schema_text(none) == "string"


def frame(spark, n, p, seed=1):
    rows = spark.range(n).select(*[(F.pmod(F.xxhash64("id", F.lit(i + seed)), F.lit(50)) / 10).alias(f"f{i}") for i in range(p)])
    rows = rows.withColumn("label", F.col("f0") * 2 + F.col("f1") * F.col("f2") - F.when(F.col("f3") > 2, F.col("f4")).otherwise(0))
    return VectorAssembler(inputCols=[f"f{i}" for i in range(p)], outputCol="features").transform(rows)


@pytest.mark.parametrize("estimator", [
    lambda: RandomForestRegressor(numTrees=5, maxDepth=6, seed=3, featureSubsetStrategy="all"), lambda: GBTRegressor(maxIter=4, maxDepth=4, seed=3),
])
def test_tree_values_equal_the_enumeration_over_all_sets(spark, estimator):
    data = frame(spark, 400, 7)
    model = estimator().fit(data)
    names = [f"f{i}" for i in range(7)]
    x = np.array([r.features.toArray() for r in data.limit(3).collect()])
    back = np.array([r.features.toArray() for r in data.orderBy("f1", "f2").limit(5).collect()])
    got = {(r.row, r.feature): r.phi for r in treeshap.tree_shapley(spark, model, x, back, names).collect()}
    mixes, value = {}, {}
    for r, b, s in itertools.product(range(3), range(5), range(128)):
        mixes[r, b, s] = np.where([s >> j & 1 for j in range(7)], x[r], back[b])
    from pyspark.ml.linalg import Vectors

    asked = spark.createDataFrame([(f"{r},{b},{s}", Vectors.dense(v)) for (r, b, s), v in mixes.items()], ["k", "features"])
    value = {tuple(map(int, r.k.split(","))): r.prediction for r in model.transform(asked).collect()}
    v = lambda r, s: sum(value[r, b, s] for b in range(5)) / 5
    for r, j in itertools.product(range(3), range(7)):
        want = sum(
            math.factorial(s.bit_count()) * math.factorial(6 - s.bit_count()) / math.factorial(7) * (v(r, s | 1 << j) - v(r, s))
            for s in range(128) if not s >> j & 1
        )
        assert got[r, f"f{j}"] == pytest.approx(want, abs=1e-9)


def test_tree_values_of_thirty_features_add_up(spark):
    data = frame(spark, 500, 30)
    model = RandomForestRegressor(numTrees=4, maxDepth=9, seed=3, featureSubsetStrategy="all").fit(data)
    names = [f"f{i}" for i in range(30)]
    got = shapley.shapley_values(model, data.limit(40), data, names, 10, 20, method="trees")
    sums = {r.row: r.s for r in got.groupBy("row").agg(F.sum("phi").alias("s")).collect()}
    from riskweft.operators.sampling import sample_rows

    predict = lambda df, n: [model.predict(r.features) for r in sample_rows(df.select("features"), n, 42).collect()]
    mine, others = predict(data.limit(40), 10), predict(data, 20)
    assert len(sums) == len(mine)
    assert sorted(sums.values()) == pytest.approx(sorted(m - sum(others) / len(others) for m in mine), abs=1e-9)
    top = [r.feature for r in shapley.mean_absolute(got, 5).collect()]
    assert set(top) <= {"f0", "f1", "f2", "f3", "f4"}


def test_tree_values_need_trees_and_few_pairs(spark):
    data = frame(spark, 60, 5)
    with pytest.raises(ValueError):
        treeshap.tree_shapley(spark, LinearRegression().fit(data), np.zeros((1, 5)), np.zeros((1, 5)), list("abcde"))
    forest = RandomForestRegressor(numTrees=1, maxDepth=1).fit(data.withColumn("label", F.lit(3.0)))
    assert {r.phi for r in treeshap.tree_shapley(spark, forest, np.zeros((2, 5)), np.ones((2, 5)), list("abcde")).collect()} == {0.0}
    with pytest.raises(ValueError):
        treeshap.tree_shapley(spark, forest, np.zeros((2_000, 5)), np.zeros((2_000, 5)), list("abcde"))
