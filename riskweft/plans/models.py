"""Modelling queries."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from riskweft.operators import modelling as L
from riskweft.operators import rules, shapley
from riskweft.operators.sampling import split
from riskweft.plans.registry import policy_sql, query, rounded
from riskweft.sources.policy import policy_view

KEYS = ["PolicyID", "LineNumber", "PartKey", "PostalCode"]
KEY_LIST = ", ".join(KEYS)
INPUT = [
    "Province", "VehicleType", "Gender", "RegistrationYear", "TotalPremium", "SumInsured",
    "CalculatedPremiumPerTerm", "TotalClaims",
]
# Depth the analysis asks of its forest; trees, rounds and explained rows are the defaults.
FOREST_DEPTH = 15


@query(
    "label_encoding",
    policy_sql(
        f"""SELECT {KEY_LIST}, Province, code AS Province_encoded FROM policy JOIN (
  SELECT v, dense_rank() OVER (ORDER BY v) - 1 AS code
  FROM (SELECT DISTINCT Province AS v FROM policy)) ON Province = v"""
    ),
)
def label_encoding(spark, sf):
    return L.label_encode(policy_view(spark, sf, [*KEYS, "Province"]), "Province")


@query(
    "population_scaling",
    policy_sql(
        f"""SELECT {KEY_LIST}, round((TotalPremium - pm) / ps, 6) AS TotalPremium,
  round((SumInsured - sm) / ss, 6) AS SumInsured
FROM policy, (SELECT avg(TotalPremium) AS pm, stddev_pop(TotalPremium) AS ps,
                     avg(SumInsured) AS sm, stddev_pop(SumInsured) AS ss FROM policy)"""
    ),
)
def population_scaling(spark, sf):
    rows = policy_view(spark, sf, [*KEYS, "TotalPremium", "SumInsured"])
    out = L.scale(rows, ["TotalPremium", "SumInsured"])
    return rounded(out, TotalPremium=6, SumInsured=6)


@query(
    "prepared_features",
    policy_sql(
        f"""SELECT {KEY_LIST},
  round((coalesce(CustomValueEstimate, md) - m) / s, 6) AS estimate_scaled,
  code::DOUBLE AS bank_code, round((greatest(2015 - RegistrationYear, 0) - ym) / ys, 6) AS age_scaled
FROM policy,
  (SELECT median(CustomValueEstimate) AS md FROM policy) a,
  (SELECT avg(x) AS m, stddev_pop(x) AS s FROM (SELECT coalesce(CustomValueEstimate,
     (SELECT median(CustomValueEstimate) FROM policy)) AS x FROM policy)) b,
  (SELECT avg(2015 - RegistrationYear) AS ym, stddev_pop(2015 - RegistrationYear) AS ys FROM policy) c,
  (SELECT Bank AS top FROM policy WHERE Bank IS NOT NULL GROUP BY Bank
   ORDER BY count(*) DESC, Bank LIMIT 1) d
JOIN (SELECT v, dense_rank() OVER (ORDER BY v) - 1 AS code
      FROM (SELECT DISTINCT Bank AS v FROM policy WHERE Bank IS NOT NULL)) e
  ON coalesce(policy.Bank, d.top) = e.v"""
    ),
)
def prepared_features(spark, sf):
    rows = policy_view(
        spark, sf, [*KEYS, "CustomValueEstimate", "Bank", "RegistrationYear", "TotalClaims"]
    )
    steps = L.fit_features(
        rows, categorical=["Bank"], numerical=["CustomValueEstimate", "VehicleAge"]
    )
    return steps.columns(rows).select(
        *KEYS,
        F.round("CustomValueEstimate__x", 6).alias("estimate_scaled"),
        F.col("Bank__x").alias("bank_code"),
        F.round("VehicleAge__x", 6).alias("age_scaled"),
    )


def _one_feature(spark, sf):
    rows = policy_view(spark, sf, [*KEYS, "TotalPremium", "TotalClaims"])
    vectors = VectorAssembler(inputCols=["TotalPremium"], outputCol="features").transform(rows)
    model = LinearRegression(
        featuresCol="features", labelCol="TotalClaims", solver="normal", regParam=0.0
    ).fit(vectors)
    return rows, vectors, model


OLS = """ols AS (SELECT regr_slope(TotalClaims, TotalPremium) AS b,
  regr_intercept(TotalClaims, TotalPremium) AS a, avg(TotalPremium) AS mean FROM policy)"""


@query(
    "linear_regression_one_feature",
    policy_sql(
        """SELECT round(any_value(b), 6) AS slope, round(any_value(a), 5) AS intercept,
  round(sqrt(avg(power(TotalClaims - a - b * TotalPremium, 2))), 5) AS rmse,
  round(1 - sum(power(TotalClaims - a - b * TotalPremium, 2))
        / (var_pop(TotalClaims) * count(*)), 6) AS r2,
  round(avg(abs(TotalClaims - a - b * TotalPremium)), 5) AS mae FROM policy, ols""",
        OLS,
    ),
)
def linear_regression_one_feature(spark, sf):
    _, vectors, model = _one_feature(spark, sf)
    out = L.regression_metrics(model.transform(vectors), "TotalClaims", "prediction")
    return out.select(
        F.round(F.lit(float(model.coefficients[0])), 6).alias("slope"),
        F.round(F.lit(float(model.intercept)), 5).alias("intercept"),
        F.round("rmse", 5).alias("rmse"),
        F.round("r2", 6).alias("r2"),
        F.round("mae", 5).alias("mae"),
    )


@query(
    "shapley_linear_one_feature",
    policy_sql(
        f"""SELECT {KEY_LIST}, 'TotalPremium' AS feature, round(b * (TotalPremium - mean), 5) AS phi
FROM policy, ols""",
        OLS,
    ),
)
def shapley_linear_one_feature(spark, sf):
    rows, _, model = _one_feature(spark, sf)
    mean = rows.agg(F.avg("TotalPremium")).first()[0]
    out = shapley.linear_shapley(
        rows, ["TotalPremium"], list(model.coefficients), [mean], KEYS
    )
    return rounded(out, phi=5)


@query(
    "regression_metrics_fixed_prediction",
    policy_sql(
        """SELECT round(sqrt(avg(power(TotalClaims - p, 2))), 6) AS rmse,
  round(1 - sum(power(TotalClaims - p, 2)) / (var_pop(TotalClaims) * count(*)), 6) AS r2,
  round(avg(abs(TotalClaims - p)), 6) AS mae
FROM (SELECT TotalClaims, TotalPremium * 0.9 AS p FROM policy)"""
    ),
)
def regression_metrics(spark, sf):
    rows = policy_view(spark, sf, ["TotalClaims", "TotalPremium"])
    rows = rows.withColumn("prediction", F.col("TotalPremium") * 0.9)
    out = L.regression_metrics(rows, "TotalClaims", "prediction")
    return rounded(out, rmse=6, r2=6, mae=6)


@query(
    "missing_target_dropped",
    policy_sql(
        """SELECT count(*) FILTER (WHERE CustomValueEstimate IS NOT NULL) AS kept,
  count(*) AS total FROM policy"""
    ),
)
def missing_target_dropped(spark, sf):
    rows = policy_view(spark, sf, ["CustomValueEstimate", "TotalPremium", "Gender"])
    bench = L.prepare(
        rows, target="CustomValueEstimate", numerical=["TotalPremium"], categorical=["Gender"]
    )
    kept = bench.summary().select(F.col("n_samples").alias("kept"))
    return kept.withColumn("total", rows.agg(F.count(F.lit(1))).scalar())


@query(
    "train_test_split_is_complete",
    "SELECT count(*) AS total, CAST(0 AS BIGINT) AS on_both_sides FROM lineitem",
)
def train_test_split(spark, sf):
    rows = policy_view(spark, sf, ["PolicyID", "LineNumber", "PartKey", "TotalPremium"])
    train, test = split(rows)
    both = train.join(test, rows.columns, "left_semi").agg(F.count(F.lit(1)))
    sides = train.unionByName(test).agg(F.count(F.lit(1)).alias("total"))
    return sides.withColumn("on_both_sides", both.scalar())


def _bench(spark, sf):
    # Fitting passes over the rows several times: join them once.
    return L.prepare(policy_view(spark, sf, INPUT).persist())


def _trained(spark, sf):
    bench = _bench(spark, sf)
    bench.train_linear_regression()
    bench.train_random_forest(max_depth=FOREST_DEPTH)
    bench.train_boosted_trees()
    return bench


@query("model_preparation_summary")
def model_preparation_summary(spark, sf):
    return _bench(spark, sf).summary()


@query("linear_regression_training")
def linear_regression_training(spark, sf):
    return _bench(spark, sf).train_linear_regression()


@query("model_comparison")
def model_comparison(spark, sf):
    return _trained(spark, sf).evaluate()


@query("best_model")
def best_model(spark, sf):
    return _trained(spark, sf).best_model()


@query("random_forest_importance")
def random_forest_importance(spark, sf):
    bench = _bench(spark, sf)
    bench.train_random_forest(max_depth=FOREST_DEPTH)
    return bench.feature_importance("Random Forest")


@query("boosted_trees_importance")
def boosted_trees_importance(spark, sf):
    bench = _bench(spark, sf)
    bench.train_boosted_trees()
    return bench.feature_importance("Boosted Trees")


@query("predicted_risk_bands")
def predicted_risk_bands(spark, sf):
    # Joined once: the fit, the cuts and the result read the same rows.
    rows = policy_view(spark, sf, [*KEYS, *INPUT]).persist()
    bench = L.prepare(rows.select(*INPUT))
    bench.train_linear_regression()
    scored = bench.predict(rows, "Linear Regression")
    return rules.risk_bands(scored).select(*KEYS, "prediction", "risk_band")


@query("shapley_random_forest")
def shapley_random_forest(spark, sf):
    bench = _bench(spark, sf)
    bench.train_random_forest(max_depth=FOREST_DEPTH)
    return shapley.shapley_values(
        bench.models["Random Forest"], bench.test, bench.train, bench.steps.names
    )


@query("shapley_ranking_boosted_trees")
def shapley_ranking(spark, sf):
    bench = _bench(spark, sf)
    bench.train_boosted_trees()
    values = shapley.shapley_values(
        bench.models["Boosted Trees"], bench.test, bench.train, bench.steps.names
    )
    return shapley.mean_absolute(values)
