"""Forests and boosted trees against Spark's own on the same rows, and the passes they make."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from riskweft.operators import modelling as L
from riskweft.operators import trees, treeshap

NAMES = ["a", "b", "c", "flat", "few"]


def frame(spark, n):
    """Features with many values, zeros, one value and few values; over 10,000 rows thresholds come from a sample."""
    rows = spark.range(0, n, 1, 5).select(
        *[(F.pmod(F.xxhash64("id", F.lit(i)), F.lit(100_000)) / 1000 - 30).alias(c) for i, c in enumerate("ab")],
        F.when(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(3)) > 0, F.pmod(F.xxhash64("id", F.lit(8)), F.lit(997)).cast("double")).otherwise(0.0).alias("c"),
        F.lit(4.0).alias("flat"), F.pmod(F.xxhash64("id", F.lit(9)), F.lit(4)).cast("double").alias("few"),
    )
    noise = F.pmod(F.xxhash64("a", "b"), F.lit(1000)) / 100
    rows = rows.withColumn("label", F.when(F.col("few") > 1, F.col("a") * 2 + F.abs("b")).otherwise(F.col("c") / 40) + noise)
    return VectorAssembler(inputCols=NAMES, outputCol="features").transform(rows).select("label", "features").cache()


def bench(rows, test=None):
    steps = L.FeatureSteps(NAMES, [], False, {}, {}, None, {}, {}, {})
    return L.Workbench(steps, rows, test if test is not None else rows)


def predictions(model, rows):
    return np.array([r.p for r in L._predict(rows, model, "p").collect()])


@pytest.mark.parametrize("n", [25, 900, 14_000])
def test_boosted_trees_are_those_of_spark(spark, n):
    rows = frame(spark, n)
    b = bench(rows)
    b.train_boosted_trees(n_estimators=5, max_depth=4)
    own = b.models["Boosted Trees"]
    want = GBTRegressor(maxIter=5, maxDepth=4, stepSize=0.1, seed=42).fit(rows.coalesce(8))
    assert own.treeWeights == want.treeWeights
    assert predictions(own, rows) == pytest.approx(predictions(want, rows), rel=1e-9)
    if n > 100:  # nodes of two or three rows often have two features that split them alike
        assert list(own.featureImportances) == pytest.approx(list(want.featureImportances), abs=1e-9)


def test_more_thresholds_than_meant(spark, monkeypatch):
    # A sample larger than expected gives more than 31.
    assert len(trees._cuts(np.arange(1.0, 10_700.0), 10_000.0, 31)) > 31
    cuts = np.linspace(-29, 69, 40)
    monkeypatch.setattr(trees, "_cuts", lambda *_: cuts)
    rows = frame(spark, 2_000).withColumn("label", F.when(F.element_at(vector_to_array("features"), 2) > float(cuts[-1]), 1.0).otherwise(0.0))
    for most in (10**9, 100):
        monkeypatch.setattr(trees, "ROWS_A_NODE", most)
        b = bench(rows)
        b.train_random_forest(n_estimators=1, max_depth=3)
        b.train_boosted_trees(n_estimators=2, max_depth=3)
        for model in b.models.values():
            assert model.trees[0].feature[0] == 1 and model.trees[0].code[0] == 39
            assert predictions(model, rows) == pytest.approx([r.label for r in rows.collect()])


def test_one_tree_is_that_of_spark(spark):
    rows = frame(spark, 5_000)
    b = bench(rows)
    b.train_random_forest(n_estimators=1, max_depth=6)
    own = b.models["Random Forest"]
    want = DecisionTreeRegressor(maxDepth=6, seed=42).fit(rows)
    assert predictions(own, rows) == pytest.approx(predictions(want, rows), rel=1e-9)
    assert list(own.featureImportances) == pytest.approx(list(want.featureImportances), abs=1e-9)


def test_forest_is_the_same_however_its_nodes_are_split(spark, monkeypatch):
    rows = frame(spark, 3_000)
    found = []
    for most in (10**9, 700, 1):
        monkeypatch.setattr(trees, "ROWS_A_NODE", most)
        b = bench(rows)
        b.train_random_forest(n_estimators=6, max_depth=6)
        found.append(b.models["Random Forest"])
    for other in found[1:]:
        assert [len(t.feature) for t in other.trees] == [len(t.feature) for t in found[0].trees]
        assert predictions(other, rows) == pytest.approx(predictions(found[0], rows), rel=1e-9)
        assert list(other.featureImportances) == pytest.approx(list(found[0].featureImportances), rel=1e-9)
    # Each tree has a bag of its own.
    assert len({tuple(t.value[:3]) for t in found[0].trees}) == 6


def test_forest_is_as_good_as_that_of_spark(spark):
    train, test = frame(spark, 6_000).randomSplit([0.7, 0.3], 5)
    b = bench(train, test)
    b.train_random_forest(n_estimators=12, max_depth=10)
    b.models["Spark"] = RandomForestRegressor(numTrees=12, maxDepth=10, featureSubsetStrategy="all", seed=42).fit(train)
    rmse = {r.model: r.rmse for r in b.evaluate().collect()}
    assert rmse["Random Forest"] == pytest.approx(rmse["Spark"], rel=0.05)
    shares = [list(b.models[m].featureImportances) for m in ("Random Forest", "Spark")]
    assert shares[0] == pytest.approx(shares[1], abs=0.03)


def test_a_deep_forest_takes_few_passes(spark):
    rows = frame(spark, 5_000)
    context = spark.sparkContext
    context.setJobGroup("deep forest", "jobs of one fit")
    try:
        bench(rows).train_random_forest(n_estimators=10, max_depth=14)
    finally:
        context._jsc.clearJobGroup()
    # A job for each level, or for each group of nodes, would be over fourteen.
    assert 0 < len(context.statusTracker().getJobIdsForGroup("deep forest")) < 12


def test_rounds_of_boosting_beyond_a_checkpoint(spark, monkeypatch):
    rows = frame(spark, 600)
    found = []
    for every in (2, 1000):
        monkeypatch.setattr(trees, "CUT_EVERY", every)
        b = bench(rows)
        b.train_boosted_trees(n_estimators=7, max_depth=2)
        found.append(predictions(b.models["Boosted Trees"], rows))
    assert found[0] == pytest.approx(found[1], rel=1e-12)


def test_labels_that_are_all_the_same_and_rows_that_cannot_be_used(spark):
    rows = frame(spark, 300)
    b = bench(rows.withColumn("label", F.lit(2.5)))
    b.train_random_forest(n_estimators=3, max_depth=5)
    b.train_boosted_trees(n_estimators=3, max_depth=3)
    for model in b.models.values():
        assert set(predictions(model, rows)) == {2.5} and sum(model.featureImportances) == 0.0
    with pytest.raises(ValueError, match="No rows"):
        bench(rows.limit(0)).train_boosted_trees(2, 2)
    with pytest.raises(Exception, match="finite"):
        bench(rows.withColumn("label", F.lit(float("nan")))).train_boosted_trees(2, 2)


@pytest.mark.parametrize("name", ["Random Forest", "Boosted Trees"])
def test_shapley_values_of_own_trees_add_up(spark, name):
    rows = frame(spark, 800)
    b = bench(rows)
    b.train_random_forest(n_estimators=4, max_depth=6)
    b.train_boosted_trees(n_estimators=4, max_depth=4)
    model = b.models[name]
    few = rows.limit(12).cache()
    x = np.array([r.features.toArray() for r in few.collect()])
    found = treeshap.tree_shapley(spark, model, x[:4], x[4:], NAMES).groupBy("row").agg(F.sum("phi").alias("s")).orderBy("row").collect()
    p = predictions(model, few)
    assert [r.s for r in found] == pytest.approx(list(p[:4] - p[4:].mean()), abs=1e-9)
