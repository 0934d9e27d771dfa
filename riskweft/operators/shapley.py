"""Shapley values of model predictions as Spark jobs.

For a feature set S, v(S) is the average prediction when the features in S come from
the explained row and the others from a background row.  Rows, background and sets
are exploded, the model predicts all of them as one DataFrame, and the weights of
each feature are summed per row.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import factorial

import numpy as np
from pyspark.ml.base import Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from riskweft.functions.tables import stack_rows
from riskweft.operators.modelling import FEATURES, _predict
from riskweft.operators.sampling import sample_rows
from riskweft.operators.treeshap import tree_shapley

# Feature count up to which all 2^p sets are evaluated.
ALL_SETS = 10
METHODS = ("exact", "permutations")
TREES = "trees"


def linear_shapley(
    df: DataFrame, names: Sequence[str], coefficients: Sequence[float], means: Sequence[float],
    key: Sequence[str],
) -> DataFrame:
    """``(key.., feature, phi)`` with phi = coefficient * (x - mean)."""
    rows = [
        {
            **{k: F.col(k) for k in key},
            "feature": F.lit(n),
            "phi": F.lit(float(c)) * (F.col(n) - F.lit(float(m))),
        }
        for n, c, m in zip(names, coefficients, means)
    ]
    return stack_rows(df, rows)


def shapley_values(
    model: Model,
    rows: DataFrame,
    background: DataFrame,
    names: Sequence[str],
    sample_size: int = 100,
    background_size: int = 50,
    method: str = "exact",
    permutations: int = 200,
    seed: int = 42,
) -> DataFrame:
    """``(row, feature, phi)`` for a sample of rows, each with a ``features`` vector.

    ``exact`` goes over all feature sets and refuses more than 10 features;
    ``permutations`` averages over random orders (Strumbelj and Kononenko, 2014); ``trees`` is exact for forests and
    boosted trees with any number of features.  Per row the values add up to its prediction minus the average
    prediction of the background.
    """
    p = len(names)
    if method not in (*METHODS, TREES):
        raise ValueError(f"method is one of {(*METHODS, TREES)}")
    if method == "exact" and p > ALL_SETS:
        raise ValueError(f"{p} features have too many sets; ask for method='permutations', or 'trees' for trees")
    if method == TREES:
        # At most sample_size and background_size rows.
        vectors = lambda df, n: np.array([r[0].toArray() for r in sample_rows(df.select(FEATURES), n, seed).collect()])
        x, others = vectors(rows, sample_size), vectors(background, background_size)
        return tree_shapley(rows.sparkSession, model, x.reshape(-1, p), others.reshape(-1, p), names)
    picked = sample_rows(rows.select(FEATURES), sample_size, seed)
    picked = picked.select(vector_to_array(FEATURES).alias("x"))
    picked = picked.select(F.monotonically_increasing_id().alias("row"), "x").persist()
    others = _background(background, background_size, seed)
    # Spread the few rows before they grow by background x sets.
    grown = picked.repartition(F.col("row")).select(
        "row", "x", F.explode(others).alias("b")
    )
    if method == "exact":
        return _over_all_sets(model, grown, names)
    return _over_permutations(model, grown, names, permutations, seed)


def _background(background: DataFrame, size: int, seed: int) -> Column:
    """The sampled background vectors, as one array literal."""
    few = sample_rows(background.select(FEATURES), size, seed).collect()
    return F.array(*[F.array(*[F.lit(float(v)) for v in r[0].toArray()]) for r in few])


def _scored(model: Model, sets: DataFrame, mixed: Column) -> DataFrame:
    return _predict(sets.withColumn(FEATURES, array_to_vector(mixed)), model, "__v")


def _over_all_sets(model: Model, grown: DataFrame, names: Sequence[str]) -> DataFrame:
    p = len(names)
    sets = grown.withColumn("mask", F.explode(F.sequence(F.lit(0), F.lit(2**p - 1))))

    def has(j: int) -> Column:
        return F.col("mask").bitwiseAND(F.lit(1 << j)) != 0

    mixed = F.array(*[F.when(has(j), F.col("x")[j]).otherwise(F.col("b")[j]) for j in range(p)])
    value = _scored(model, sets, mixed).groupBy("row", "mask").agg(F.avg("__v").alias("v"))
    # Weight of the step from a set of s features to one with the feature added.
    weights = F.array(
        *[F.lit(factorial(s) * factorial(p - s - 1) / factorial(p)) for s in range(p)]
    )
    size = F.bit_count("mask")
    added = F.element_at(weights, F.greatest(size, F.lit(1)))  # set had size - 1 before
    before = F.element_at(weights, F.least(size + 1, F.lit(p)))
    wide = value.groupBy("row").agg(
        *[
            F.sum(F.when(has(j), added * F.col("v")).otherwise(-before * F.col("v"))).alias(f"__f{j}")
            for j in range(p)
        ]
    )
    return stack_rows(
        wide,
        [
            {"row": F.col("row"), "feature": F.lit(n), "phi": F.col(f"__f{j}")}
            for j, n in enumerate(names)
        ],
    )


def _over_permutations(
    model: Model, grown: DataFrame, names: Sequence[str], permutations: int, seed: int
) -> DataFrame:
    p = len(names)
    drawn = grown.withColumn("m", F.explode(F.sequence(F.lit(1), F.lit(permutations))))
    shuffled = F.array_sort(
        F.transform(
            F.sequence(F.lit(0), F.lit(p - 1)),
            lambda j: F.struct(F.xxhash64(F.col("m"), j, F.lit(seed)).alias("h"), j.alias("j")),
        )
    )
    drawn = drawn.withColumn("order", F.transform(shuffled, lambda s: s["j"]))
    steps = drawn.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(p))))
    mixed = F.array(
        *[
            F.when(F.array_position("order", F.lit(j)) <= F.col("k"), F.col("x")[j]).otherwise(
                F.col("b")[j]
            )
            for j in range(p)
        ]
    )
    scored = _scored(model, steps, mixed)
    # A step's value counts for the feature just added and against the next one.
    parts = F.array_compact(
        F.array(
            F.when(
                F.col("k") > 0,
                F.struct(F.col("order")[F.greatest(F.col("k") - 1, F.lit(0))].alias("j"), F.col("__v").alias("d")),
            ),
            F.when(
                F.col("k") < p,
                F.struct(
                    F.col("order")[F.least(F.col("k"), F.lit(p - 1))].alias("j"),
                    (-F.col("__v")).alias("d"),
                ),
            ),
        )
    )
    gains = scored.select("row", F.inline(parts)).groupBy("row", "j").agg(
        (F.sum("d") * 2 / F.count("d")).alias("phi")
    )
    labels = F.array(*[F.lit(n) for n in names])
    return gains.select("row", labels[F.col("j")].alias("feature"), "phi")


def mean_absolute(values: DataFrame, top_n: int = 10) -> DataFrame:
    """Features by their mean absolute Shapley value."""
    table = values.groupBy("feature").agg(F.avg(F.abs("phi")).alias("mean_abs_phi"))
    return table.orderBy(F.desc("mean_abs_phi"), "feature").limit(top_n)
