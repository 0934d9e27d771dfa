"""Exact Shapley values of tree ensembles with any number of features, a tree a task.

For one explained row and one background row a leaf is a game of its own: it pays its value if every
feature on its path that only the explained row satisfies comes from that row (u of them), and every
one that only the background row satisfies from the other (v).  Such a game's Shapley values are
(u - 1)! v! / (u + v)! times the value for the first kind and -u! (v - 1)! / (u + v)! for the second,
so the work grows with leaves times path length, not with the sets of features.  A leaf with a
feature that neither row satisfies pays nothing, one that both satisfy does not depend on it.

Trees are rows of a table, grouped by tree: one task holds one tree, as the trainer's driver did.
The explained and the background rows are few (parameters of the caller) and go to every task.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from math import factorial

import numpy as np
import pandas as pd
from pyspark.ml.base import Model
from pyspark.sql import DataFrame, SparkSession, functions as F

from riskweft.operators.trees import TreesModel
from riskweft.session import use_checkpoints

MOST_PAIRS = 1_000_000  # explained times background rows


def tree_nodes(spark: SparkSession, model: Model) -> DataFrame:
    """(tree, weight, id, prediction, left, right, feature, threshold) of an ensemble of ours or of Spark ML."""
    if not hasattr(model, "treeWeights"):
        raise ValueError("Tree Shapley values need a forest or boosted trees")
    if isinstance(model, TreesModel):
        return _own_nodes(spark, model)
    use_checkpoints(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/trees-{uuid.uuid4().hex}"
    model.write().save(path)
    nodes = spark.read.parquet(f"{path}/data").select(F.col("treeID").alias("tree"), "nodeData.*")
    if not nodes.filter("split.numCategories > 0").isEmpty():
        raise ValueError("Tree Shapley values need numeric splits")
    weights = [float(w) for w in model.treeWeights]
    # A forest averages its trees, boosting adds them up.
    whole = sum(weights) if "Forest" in type(model).__name__ else 1.0
    shares = spark.createDataFrame([(i, w / whole) for i, w in enumerate(weights)], "tree int, weight double")
    return nodes.join(F.broadcast(shares), "tree").select(  # a row per tree
        "tree", "weight", "id", "prediction", F.col("leftChild").alias("left"), F.col("rightChild").alias("right"),
        F.col("split.featureIndex").alias("feature"), F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"),
    )


def _own_nodes(spark: SparkSession, model: TreesModel) -> DataFrame:
    sent = spark.sparkContext.broadcast((model.cuts, [t.parts() for t in model.trees], model.shares))

    def rows(batches):
        cuts, trees, shares = sent.value
        for t in (t for batch in batches for t in batch["id"]):
            feature, code, left, value, _ = trees[t]
            threshold = np.array([cuts[f][c] if f >= 0 else 0.0 for f, c in zip(feature, code)])
            inner = feature >= 0
            yield pd.DataFrame({
                "tree": t, "weight": shares[t], "id": np.arange(len(feature)), "prediction": value, "left": np.where(inner, left, -1),
                "right": np.where(inner, left + 1, -1), "feature": feature.astype(int), "threshold": threshold,
            })

    schema = "tree int, weight double, id int, prediction double, left int, right int, feature int, threshold double"
    return spark.range(len(model.trees)).mapInPandas(rows, schema)


def _paths(nodes: pd.DataFrame):
    """Leaf values, and per leaf its features with the bounds (low, high] that lead there."""
    table = nodes.set_index("id")
    values, first, feature, low, high = [], [], [], [], []
    work = [(int(nodes["id"].min()), {})]
    while work:
        node, bounds = work.pop()
        row = table.loc[node]
        if row["left"] < 0:
            values.append(float(row["prediction"]))
            first.append(len(feature))
            for f, (a, b) in bounds.items():
                feature.append(f)
                low.append(a)
                high.append(b)
            continue
        f, t = int(row["feature"]), float(row["threshold"])
        a, b = bounds.get(f, (-np.inf, np.inf))
        work.append((int(row["left"]), {**bounds, f: (a, min(b, t))}))
        work.append((int(row["right"]), {**bounds, f: (max(a, t), b)}))
    return np.array(values), np.array(first, np.int64), np.array(feature, np.int64), np.array(low), np.array(high)


def _weights(deepest: int) -> tuple[np.ndarray, np.ndarray]:
    """What a feature gets of a leaf's value, by how many features are on either side."""
    gain, loss = np.zeros((deepest + 1, deepest + 1)), np.zeros((deepest + 1, deepest + 1))
    for u in range(deepest + 1):
        for v in range(deepest + 1 - u):
            if u:
                gain[u, v] = factorial(u - 1) * factorial(v) / factorial(u + v)
            if v:
                loss[u, v] = factorial(u) * factorial(v - 1) / factorial(u + v)
    return gain, loss


def tree_contributions(nodes: pd.DataFrame, x: np.ndarray, background: np.ndarray) -> np.ndarray:
    """(rows, features): Shapley values of one tree, averaged over the background rows."""
    values, first, feature, low, high = _paths(nodes)
    out = np.zeros(x.shape)
    if not len(feature) or not len(background):
        return out  # a single leaf predicts the same for every row
    bounds = np.append(first, len(feature))
    size = np.diff(bounds)
    some = size > 0
    leaf = np.repeat(np.arange(len(values)), size)
    gain, loss = _weights(int(size.max()))
    inside = lambda rows: (rows[:, feature] > low) & (rows[:, feature] <= high)
    here, there = inside(x), inside(background)
    starts = first[some]
    for r, mine in enumerate(here):
        total = np.zeros(x.shape[1])
        for theirs in there:
            dead = np.zeros(len(values), bool)
            dead[some] = np.logical_or.reduceat(~mine & ~theirs, starts)
            only_mine, only_theirs = mine & ~theirs, theirs & ~mine
            at = np.flatnonzero((only_mine | only_theirs) & ~dead[leaf])
            if not len(at):
                continue
            u = np.bincount(leaf[at], weights=only_mine[at], minlength=len(values)).astype(np.int64)
            v = np.bincount(leaf[at], weights=only_theirs[at], minlength=len(values)).astype(np.int64)
            on = leaf[at]
            part = np.where(only_mine[at], gain[u[on], v[on]], -loss[u[on], v[on]]) * values[on]
            total += np.bincount(feature[at], weights=part, minlength=len(total))
        out[r] = total / len(there)
    return out


def tree_shapley(spark: SparkSession, model: Model, x: np.ndarray, background: np.ndarray, names: Sequence[str]) -> DataFrame:
    """(row, feature, phi): ``row`` counts the rows of ``x`` from 0.

    Per row the values add up to its prediction minus the average prediction of the background.
    """
    x, background = np.atleast_2d(np.asarray(x, float)), np.atleast_2d(np.asarray(background, float))
    if len(x) * len(background) > MOST_PAIRS:
        raise ValueError(f"{len(x)} rows against {len(background)} are more than {MOST_PAIRS} pairs; explain fewer rows at once")
    sent = spark.sparkContext.broadcast((x, background))

    def run(nodes: pd.DataFrame) -> pd.DataFrame:
        rows, others = sent.value
        phi = tree_contributions(nodes, rows, others) * float(nodes["weight"].iloc[0])
        row, place = np.divmod(np.arange(phi.size), phi.shape[1])
        return pd.DataFrame({"row": row, "place": place, "phi": phi.ravel()})

    parts = tree_nodes(spark, model).groupBy("tree").applyInPandas(run, "row bigint, place bigint, phi double")
    labels = F.array(*[F.lit(n) for n in names])
    sums = parts.groupBy("row", "place").agg(F.sum("phi").alias("phi"))
    return sums.select("row", labels[F.col("place").cast("int")].alias("feature"), "phi")
