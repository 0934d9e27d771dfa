import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from riskweft.functions import labels, pvalues
from riskweft.functions.shapiro import shapiro_wilk
from riskweft.operators import describe as D
from riskweft.operators import hypothesis as H
from riskweft.operators import matrix as X
from riskweft.operators import metrics as M
from riskweft.operators import plotdata as V
from riskweft.operators import profile as P
from riskweft.operators import relate as R
from riskweft.operators import rules


# --- tail probabilities ------------------------------------------------------------------


@pytest.mark.parametrize(
    "got, want",
    [
        (pvalues.chi2_tail(3.841459, 1), 0.05),
        (pvalues.chi2_tail(18.307038, 10), 0.05),
        (pvalues.chi2_tail(135.806723, 100), 0.01),
        (pvalues.t_tails(2.228139, 10), 0.05),
        (pvalues.t_tails(-2.228139, 10), 0.05),
        (pvalues.t_tails(12.706205, 1), 0.05),
        (pvalues.f_tail(4.102821, 2, 10), 0.05),
        (pvalues.f_tail(2.978237, 10, 10), 0.05),
        (pvalues.normal_tail(1.959964), 0.025),
    ],
)
def test_critical_values(got, want):
    assert got == pytest.approx(want, rel=1e-5)


def test_tails_agree_with_the_jvm_library(spark):
    stats = spark._jvm.org.apache.commons.math3.distribution
    for x, d in ((0.3, 1), (7.7, 4), (250.0, 199)):
        want = 1 - stats.ChiSquaredDistribution(float(d)).cumulativeProbability(x)
        assert pvalues.chi2_tail(x, d) == pytest.approx(want, abs=1e-10)
    for f, a, b in ((0.2, 3, 50), (1.9, 19, 17000), (12.0, 24, 60000)):
        want = 1 - stats.FDistribution(float(a), float(b)).cumulativeProbability(f)
        assert pvalues.f_tail(f, a, b) == pytest.approx(want, abs=1e-9)
    for t, d in ((0.1, 2.5), (1.3, 18000.7)):
        want = 2 * (1 - stats.TDistribution(float(d)).cumulativeProbability(t))
        assert pvalues.t_tails(t, d) == pytest.approx(want, abs=1e-9)


@settings(max_examples=60, deadline=None)
@given(st.floats(0, 500), st.floats(0.01, 100), st.integers(1, 300), st.integers(1, 10**6))
def test_tails_are_probabilities_and_fall(x, step, d1, d2):
    for tail in (
        lambda v: pvalues.chi2_tail(v, d1),
        lambda v: pvalues.t_tails(v, d1),
        lambda v: pvalues.f_tail(v, d1, d2),
    ):
        a, b = tail(x), tail(x + step)
        assert 0 <= b <= a + 1e-12 <= 1 + 1e-11


def test_shapiro_wilk_published_example():
    # Shapiro and Wilk (1965), weights of 11 men
    w, p = shapiro_wilk([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236])
    assert w == pytest.approx(0.79, abs=0.005) and p == pytest.approx(0.0067, abs=0.0006)


def test_shapiro_wilk_edges():
    assert shapiro_wilk([1.0, 2.0]) == (None, None)
    assert shapiro_wilk([5.0] * 10) == (1.0, 1.0)
    assert shapiro_wilk([1.0, 2.0, 3.0])[0] == pytest.approx(1.0)
    rng = np.random.default_rng(0)
    assert shapiro_wilk(rng.normal(size=2000))[1] > 0.01
    assert shapiro_wilk(rng.exponential(size=300))[1] < 1e-6


# --- profile -----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def issues(spark):
    rows = [
        (1, "Gauteng", 100.0, "25"), (2, "Limpopo", -5.0, "30"), (2, None, 0.0, "30"),
        (2, None, 0.0, "30"), (4, "Gauteng", None, "41"), (5, "Cape", 10000.0, None),
    ]
    return spark.createDataFrame(rows, "PolicyID int, Province string, TotalPremium double, Age string")


def test_missing_profile(issues):
    s = P.missing_summary(issues).first()
    assert (s.total_missing, s.columns_with_missing, s.rows_with_missing, s.complete_rows) == (4, 3, 4, 2)
    assert s.missing_percentage == round(100 * 4 / 24, 2)
    table = {r["column"]: r.missing for r in P.missing_by_column(issues).collect()}
    assert table == {"PolicyID": 0, "Province": 2, "TotalPremium": 1, "Age": 1}
    above = P.missing_by_column(issues, 20).collect()
    assert [r["column"] for r in above] == ["Province"]


def test_type_profile(issues):
    roles = {r["column"]: r.role for r in P.column_types(issues).collect()}
    assert roles["Age"] == "categorical" and roles["TotalPremium"] == "numerical"
    assert [r["column"] for r in P.numeric_text_columns(issues).collect()] == ["Age"]
    assert {r.dtype: r["columns"] for r in P.type_distribution(issues).collect()} == {
        "int": 1, "string": 2, "double": 1,
    }


def test_numeric_text_is_decided_by_all_rows(spark):
    df = spark.range(300).select(F.when(F.col("id") == 250, "x").otherwise("7").alias("a"), F.lit("12f").alias("b"))
    assert P.numeric_text_columns(df).count() == 0


def test_value_ranges(issues):
    r = {x["column"]: x for x in P.value_ranges(issues).collect()}["TotalPremium"]
    assert (r.zeros, r.negatives, r.non_null_count, r["min"], r["max"]) == (2, 1, 5, -5.0, 10000.0)
    assert r.zeros_percentage == 40.0 and r["median"] == 0.0 and r.status == "ok"


def test_all_null_column(spark):
    df = spark.createDataFrame([(None,), (None,)], "x double")
    assert P.value_ranges(df).first().status == "all_null"
    r = D.describe_numeric(df).first()
    assert r["count"] == 0 and r["mean"] is None and r["missing_pct"] == 100.0


def test_categories(issues):
    r = {x["column"]: x for x in P.categorical_summary(issues).collect()}["Province"]
    assert (r.unique_count, r.most_common, r.most_common_count) == (3, "Gauteng", 2)
    assert (r.least_common, r.least_common_count, r.cardinality_ratio) == ("Cape", 1, 0.5)
    top = [tuple(x) for x in P.top_values(issues, ["Province"], 2).orderBy("rank").collect()]
    assert top == [("Province", "Gauteng", 2, 1), ("Province", "Cape", 1, 2)]


def test_score_and_recommendations(issues):
    s = P.quality_score(issues).first()
    assert (s.type_issues, s.duplicate_percentage) == (1, 16.67)
    assert s.quality_score == round(100 - 16.67 - 15 - 2, 2)
    assert P.recommendations(issues).count() == 4
    clean = issues.filter("PolicyID = 1").drop("Age")
    assert P.quality_score(clean).first().quality_score == 100.0
    assert P.recommendations(clean).count() == 0


def test_report_sections_and_empty_table(issues):
    sections = {r.section for r in P.quality_report(issues).select("section").distinct().collect()}
    assert {"overview", "duplicates", "outliers", "categorical", "quality_score"} <= sections
    without = P.quality_report(issues, include_outliers=False)
    assert without.filter("section = 'outliers'").count() == 0
    with pytest.raises(ValueError, match="empty"):
        P.quality_report(issues.limit(0))
    with pytest.raises(ValueError, match="empty"):
        P.require_rows(issues.limit(0))


# --- descriptive statistics ----------------------------------------------------------------


def test_describe_known_sample(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4, 100)], "x double")
    r = D.describe_numeric(df).first()
    assert r["p25"] == 2.0 and r["std"] == pytest.approx(43.617657, abs=1e-6)
    assert r["skewness"] == pytest.approx(2.232396, abs=1e-6)
    assert r["kurtosis"] == pytest.approx(4.986866, abs=1e-6)


@pytest.mark.parametrize("values", [[5.0], [5.0, 7.0], [1.0, 2.0, 9.0], [4.0] * 6])
def test_describe_short_and_constant(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    r = D.describe_numeric(df).first()
    want = pd.Series(values)
    for name, value in (("std", want.std()), ("skewness", want.skew()), ("kurtosis", want.kurt())):
        assert r[name] is None if math.isnan(value) else r[name] == pytest.approx(value)


def test_describe_matches_pandas_under_any_partitioning(policies):
    pdf = policies.toPandas()
    for parts in (1, 17):
        table = D.describe_numeric(policies.repartition(parts), ["TotalPremium", "TotalClaims"])
        for r in table.collect():
            x = pdf[r["column"]].astype(float)
            assert r["mean"] == pytest.approx(x.mean()) and r["variance"] == pytest.approx(x.var())
            assert r["skewness"] == pytest.approx(x.skew()) and r["kurtosis"] == pytest.approx(x.kurt())
            assert r["p75"] == pytest.approx(x.quantile(0.75)) and r["missing"] == x.isna().sum()


def test_categorical_and_value_counts(policies):
    pdf = policies.toPandas()
    r = D.describe_categorical(policies, ["Province"]).first()
    counts = pdf.Province.value_counts()
    assert (r["count"], r["unique"], r["freq"]) == (counts.sum(), 4, counts.iloc[0])
    table = {x.value: x["count"] for x in D.value_counts(policies, "Province").collect()}
    assert table == counts.to_dict()
    with pytest.raises(ValueError, match="not found"):
        D.describe_numeric(policies, ["Nope"])
    year = D.univariate_categorical(policies, "RegistrationYear").first()
    assert year["count"] == 1000


def test_normality(spark):
    df = spark.range(4000).select(F.randn(3).alias("x"), (F.randn(4) ** 2).alias("y"))
    assert D.jarque_bera(df, "x").first().is_normal
    assert not D.jarque_bera(df, "y").first().is_normal
    r = D.shapiro_test(df, "y").first()
    assert r.n == 4000 and r.test == "Shapiro-Wilk" and not r.is_normal
    big = spark.range(6000).select(F.randn(5).alias("x"))
    r = D.shapiro_test(big, "x").first()
    assert r.n == 5000 and "5000" in r.test and r.statistic > 0.99


# --- matrices --------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def mixed(spark):
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame({"a": rng.integers(0, 9, 700) * 1.0, "b": rng.normal(size=700).round(1)})
    pdf["c"] = pdf.a * 0.7 + rng.normal(size=700)
    pdf["d"] = np.where(rng.random(700) < 0.3, np.nan, pdf.b - pdf.c)
    pdf["flat"] = 3.0
    spark_frame = spark.createDataFrame(
        pdf.astype(object).where(pdf.notna(), None), "a double, b double, c double, d double, flat double"
    ).cache()
    return spark_frame, pdf


def wide(table):
    return table.toPandas().pivot(index="column1", columns="column2", values="value").astype(float)


def tau_b(x, y):
    keep = ~(np.isnan(x) | np.isnan(y))
    x, y = x[keep], y[keep]
    sx, sy = np.sign(x[:, None] - x[None]), np.sign(y[:, None] - y[None])
    return (sx * sy).sum() / math.sqrt((sx != 0).sum() * (sy != 0).sum())


@pytest.mark.parametrize("method", ["pearson", "spearman"])
def test_correlation_matrices(mixed, method):
    df, pdf = mixed
    got = wide(X.correlation_matrix(df, method=method))
    want = pdf.corr(method)
    assert np.allclose(got.loc[want.index, want.columns], want, equal_nan=True, atol=1e-12)


def test_covariance_matrix(mixed):
    df, pdf = mixed
    want = pdf.cov()
    assert np.allclose(wide(X.covariance_matrix(df)).loc[want.index, want.columns], want)


@pytest.mark.parametrize("block_rows", [100_000, 37])
def test_kendall_in_one_task_and_in_blocks(mixed, block_rows):
    df, pdf = mixed
    for a, b in (("a", "c"), ("b", "d")):
        got = X.kendall_tau(df, a, b, block_rows).first().tau
        assert got == pytest.approx(tau_b(pdf[a].values, pdf[b].values), abs=1e-12)


def test_kendall_constant_column(mixed):
    df, _ = mixed
    assert X.kendall_tau(df, "a", "flat").first().tau is None


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(1, 5)), max_size=30))
def test_weighted_inversions(points):
    y = np.array([p[0] for p in points])
    w = np.array([p[1] for p in points])
    want = sum(
        w[i] * w[j] for i in range(len(y)) for j in range(i + 1, len(y)) if y[i] > y[j]
    )
    assert X.weighted_inversions(y, w) == want


def test_matrix_errors_and_high_pairs(mixed):
    df, pdf = mixed
    with pytest.raises(ValueError, match="at least 2"):
        X.correlation_matrix(df, ["a"])
    with pytest.raises(ValueError, match="Method"):
        X.correlation_matrix(df, method="cosine")
    pairs = X.highly_correlated(df, ["a", "c", "flat"], above=0.7).collect()
    assert [(r.column1, r.column2) for r in pairs] == [("a", "c")]
    assert pairs[0].strength.endswith("Positive")


def test_correlation_labels(spark):
    values = [0.95, -0.9, 0.7, -0.5, 0.3, 0.1, -0.0001, None]
    df = spark.createDataFrame([(v,) for v in values], "r double")
    got = [x[0] for x in df.select(labels.correlation_strength(F.col("r"))).collect()]
    assert got == [
        "Very Strong Positive", "Very Strong Negative", "Strong Positive", "Moderate Negative",
        "Weak Positive", "Very Weak Positive", "Very Weak Negative", None,
    ]


# --- two columns ---------------------------------------------------------------------------------


def test_bivariate_dispatch(policies):
    assert set(R.bivariate(policies, "TotalPremium", "TotalClaims")) == {"correlation"}
    assert set(R.bivariate(policies, "Province", "TotalClaims")) == {"group_statistics", "anova"}
    both = R.bivariate(policies, "Province", "Gender")
    assert set(both) == {"contingency_table", "chi_square_test"}
    with pytest.raises(ValueError, match="not found"):
        R.bivariate(policies, "Province", "Nope")


def test_yates_correction(spark):
    rows = [("a", "x")] * 30 + [("a", "y")] * 10 + [("b", "x")] * 20 + [("b", "y")] * 20
    df = spark.createDataFrame(rows, "g string, h string")
    r = R.chi_square(df, "g", "h").first()
    assert r.statistic == pytest.approx(4.32) and r.degrees_of_freedom == 1
    assert r.p_value == pytest.approx(pvalues.chi2_tail(4.32, 1))


def test_contingency_has_empty_cells(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "y"), ("b", None), ("c", "y")], "g string, h string")
    assert R.contingency(df, "g", "h").count() == 6
    assert R.contingency(df, "g", "h", zero_fill=False).count() == 3
    r = R.chi_square(df, "g", "h").first()
    assert r.statistic == pytest.approx(3.0) and r.degrees_of_freedom == 2
    wide_table = {x.g: (x.x, x.y) for x in R.contingency_wide(df, "g", "h").collect()}
    assert wide_table == {"a": (1, 0), "b": (0, 1), "c": (0, 1)}


def test_group_statistics(policies):
    pdf = policies.toPandas()
    want = pdf.groupby("Province").TotalPremium.agg(["count", "mean", "median", "std"])
    for r in R.group_statistics(policies, "TotalPremium", "Province").collect():
        assert [r["count"], r["mean"], r["median"], r["std"]] == pytest.approx(list(want.loc[r.category]))


# --- hypothesis tests ----------------------------------------------------------------------------


def frame(spark, groups):
    rows = [(g, float(p), float(c)) for g, pairs in groups.items() for p, c in pairs]
    return spark.createDataFrame(rows, "Province string, TotalPremium double, TotalClaims double")


def test_welch_by_hand(spark):
    df = frame(spark, {"a": [(0, v) for v in (1, 2, 3, 4, 0)], "b": [(0, v) for v in (2, 4, 6, 8, 10)]})
    r = H.t_test(df, "Province", "a", "b").first()
    x, y = np.array([1, 2, 3, 4.0]), np.array([2, 4, 6, 8, 10.0])
    vx, vy = x.var(ddof=1) / 4, y.var(ddof=1) / 5
    t = (x.mean() - y.mean()) / math.sqrt(vx + vy)
    dof = (vx + vy) ** 2 / (vx**2 / 3 + vy**2 / 4)
    assert r.statistic == pytest.approx(t) and r.degrees_of_freedom == pytest.approx(dof)
    assert r.p_value == pytest.approx(pvalues.t_tails(t, dof))
    assert r.cohens_d == pytest.approx((x.mean() - y.mean()) / math.sqrt((x.var(ddof=1) + y.var(ddof=1)) / 2))
    assert "REJECT" in r.interpretation


def test_anova_by_hand(spark):
    groups = {"a": [1, 2, 3], "b": [2, 4, 6], "c": [7, 8, 9], "tiny": [100]}
    df = frame(spark, {g: [(v, 0) for v in vs] for g, vs in groups.items()})
    r = H.anova_test(df, "Province", "Margin").first()
    assert r.statistic == pytest.approx(_f([1, 2, 3], [2, 4, 6], [7, 8, 9]))
    assert (r.num_groups, r.df_between, r.df_within) == (3, 2, 6)
    assert r.p_value == pytest.approx(pvalues.f_tail(r.statistic, 2, 6))


def _f(*groups):
    groups = [np.array(g, dtype=float) for g in groups]
    grand = np.concatenate(groups).mean()
    between = sum(len(g) * (g.mean() - grand) ** 2 for g in groups) / (len(groups) - 1)
    within = sum(((g - g.mean()) ** 2).sum() for g in groups)
    return between / (within / (sum(map(len, groups)) - len(groups)))


def test_degenerate_claims(spark):
    none = frame(spark, {"a": [(5, 0)] * 3, "b": [(6, 0)] * 3})
    r = H.chi_squared_test(none, "Province").first()
    assert (r.statistic, r.p_value, r.effect_size, r.reject_null) == (0.0, 1.0, 0.0, False)
    same = frame(spark, {"a": [(5, 7)] * 3, "b": [(6, 7)] * 3})
    r = H.t_test(same, "Province", "a", "b").first()
    assert r.statistic is None and r.cohens_d == 0.0 and not r.reject_null


@pytest.mark.parametrize(
    "call, message",
    [
        (lambda d: H.chi_squared_test(d, "Province"), "at least 2 groups"),
        (lambda d: H.anova_test(d, "Province"), "at least 2 groups"),
        (lambda d: H.t_test(d, "Province", "a", "zz"), "no data"),
    ],
)
def test_too_few_groups(spark, call, message):
    one = frame(spark, {"a": [(5, 1), (5, 2)]})
    with pytest.raises(Exception, match=message):
        call(one).collect()


def test_argument_errors(policies):
    with pytest.raises(ValueError, match="Alpha"):
        H.chi_squared_test(policies, "Province", alpha=1.5)
    with pytest.raises(ValueError, match="Metric"):
        H.anova_test(policies, "Province", "Speed")
    with pytest.raises(ValueError, match="not found"):
        H.chi_squared_test(policies, "Nope")


def test_battery_matches_single_tests(policies):
    rows = policies.withColumn("PostalCode", F.col("RegistrationYear").cast("string"))
    table = {r.hypothesis[:3]: r for r in H.run_battery(rows, H.standard_battery("Male", "Female")).collect()}
    assert len(table) == 7
    single = H.anova_test(rows, "PostalCode", "Margin", top_k=20).first()
    assert table["H3:"].statistic == pytest.approx(single.statistic)
    assert table["H3:"].p_value == pytest.approx(single.p_value)
    gender = H.chi_squared_test(rows, "Gender").first()
    assert table["H4a"].p_value == pytest.approx(gender.p_value)


# --- metrics and rules ------------------------------------------------------------------------------


def test_loss_ratio_and_zero_premium(spark):
    df = frame(spark, {"a": [(1000, 500), (1500, 0), (2000, 3000)], "b": [(1200, 0), (1800, 3100)]})
    assert M.loss_ratio(df).first().loss_ratio == pytest.approx(6600 / 7500)
    zero = frame(spark, {"a": [(0, 5), (0, 0)]})
    assert M.loss_ratio(zero).first().loss_ratio is None
    assert M.loss_ratio_by(zero, ["Province"]).first().loss_ratio is None
    with pytest.raises(ValueError, match="numeric"):
        M.loss_ratio(df, claims="Province")


def test_kpis_match_pandas(policies):
    pdf = policies.toPandas()
    for r in M.kpis(policies, "Province").collect():
        g = pdf[pdf.Province == r.Group]
        hit = g.TotalClaims > 0
        assert r.PolicyCount == len(g)
        assert r.ClaimFrequency == pytest.approx(100 * hit.mean())
        assert r.ClaimSeverity == pytest.approx(g.TotalClaims[hit].mean())
        assert r.Margin == pytest.approx((g.TotalPremium - g.TotalClaims).mean())


def test_kpis_without_claims(spark):
    r = M.kpi_loss_ratio(M.kpis(frame(spark, {"a": [(0, 0), (0, 0)]}), "Province")).first()
    assert (r.ClaimFrequency, r.ClaimSeverity, r.LossRatio) == (0.0, 0.0, 0.0)


def test_rules(spark):
    df = spark.createDataFrame([(m,) for m in (-60.0, -50.0, -1.0, 0.0, 20.0, 21.0)], "Margin double")
    tiers = [r.tier for r in rules.pricing_tiers(df).orderBy("Margin").collect()]
    assert tiers == ["high risk", "moderate risk", "moderate risk", "standard", "standard", "low risk"]
    ratios = spark.createDataFrame([(v,) for v in (0.89, 0.9, 1.0, 1.01)], "loss_ratio double")
    lights = [r.light for r in rules.traffic_lights(ratios).orderBy("loss_ratio").collect()]
    assert lights == ["green", "yellow", "yellow", "red"]
    scores = spark.range(100).select(F.col("id").cast("double").alias("prediction"))
    bands = {r.risk_band: r["count"] for r in rules.risk_bands(scores).groupBy("risk_band").count().collect()}
    assert bands == {"low": 50, "medium": 30, "high": 15, "very high": 5}


# --- plot data ---------------------------------------------------------------------------------------


def test_histogram_counts_every_value(policies):
    pdf = policies.toPandas()
    want, edges = np.histogram(pdf.TotalPremium.dropna(), bins=30)
    got = V.histogram(policies, "TotalPremium").orderBy("bin").collect()
    assert [r.n for r in got] == list(want)
    assert [r.lower for r in got] == pytest.approx(list(edges[:-1]))
    flat = policies.select(F.lit(4.0).alias("x"))
    assert V.histogram(flat, "x", 4).agg(F.sum("n")).first()[0] == 1000


def test_density_by_definition(policies):
    x = policies.toPandas().SumInsured.to_numpy()
    h = len(x) ** -0.2 * x.std(ddof=1)
    grid = np.linspace(x.min(), x.max(), 200)
    kernel = np.exp(-0.5 * ((grid[:, None] - x) / h) ** 2).sum(1) / (h * math.sqrt(2 * math.pi))
    want = kernel * (x.max() - x.min()) / 30
    got = V.density(policies, "SumInsured").orderBy("point").toPandas()
    assert np.allclose(got.density, want) and np.allclose(got.x, grid)


@pytest.mark.parametrize("freq, rule", [("D", "D"), ("W", "W"), ("ME", "ME"), ("Q", "QE"), ("Y", "YE")])
@pytest.mark.parametrize("how", ["sum", "mean", "count", "median", "min", "max"])
def test_resample_matches_pandas(spark, freq, rule, how):
    if (how not in ("sum", "median")) and freq not in ("ME", "W"):
        pytest.skip("one frequency per remaining aggregation is enough")
    days = ["2024-01-03", "2024-01-03", "2024-03-05", "2025-02-28"]
    pdf = pd.DataFrame({"d": pd.to_datetime(days), "x": [1.0, 5.0, None, 7.0]})
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "d timestamp_ntz, x double")
    want = getattr(pdf.set_index("d").x.resample(rule), how)()
    got = {r.period: r.value for r in V.resample(df, "d", "x", how, freq).collect()}
    assert list(sorted(got)) == [t.date() for t in want.index]
    for t, v in want.items():
        assert got[t.date()] == (None if pd.isna(v) else pytest.approx(v))


def test_single_boxplot_of_an_empty_table_has_no_row(spark):
    assert V.boxplot(spark.createDataFrame([], "x double"), "x").count() == 0
    r = V.boxplot(spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4, 100)], "x double"), "x").first()
    assert (r.group, r.n, r.q1, r.median, r.q3, r.whisker_high, r.outliers) == ("all", 5, 2.0, 3.0, 4.0, 4.0, 1)


def test_boxplot_by_hand(spark):
    df = spark.createDataFrame([("g", float(v)) for v in (1, 2, 3, 4, 100)], "k string, x double")
    r = V.boxplot(df, "x", "k").first()
    assert (r.q1, r["median"], r.q3, r.whisker_low, r.whisker_high, r.outliers) == (2, 3, 4, 1, 4, 1)


def test_dashboard_limits_and_errors(policies):
    with pytest.raises(ValueError, match="Maximum 3"):
        V.dashboard(policies, ["TotalPremium"] * 4, [])
    panels = V.dashboard(policies, ["TotalPremium"], ["Province"])
    assert {r.panel for r in panels.collect()} == {"TotalPremium", "Province"}
    with pytest.raises(ValueError, match="Aggregation"):
        V.resample(policies, "TransactionMonth", "TotalClaims", "range")
    with pytest.raises(ValueError, match="numeric"):
        V.histogram(policies, "Province")
    slope = V.regression_line(policies.withColumn("y", F.col("SumInsured") * 2 + 1), "SumInsured", "y").first()
    assert (slope.slope, slope.intercept) == (pytest.approx(2), pytest.approx(1))
    flat = policies.select(F.lit(1.0).alias("a"), "SumInsured")
    assert V.regression_line(flat, "a", "SumInsured").first().slope is None


def test_quality_facts_come_from_one_pass(spark):
    rows = [(1, None, "7", 1.0), (1, None, "7", 1.0), (2, "a", "8", float("nan")), (2, "a", "8", None), (3, "b", "9", 2.0), (1, None, "7", 1.0)]
    df = spark.createDataFrame(rows, "i int, t string, n string, x double")
    out = P.quality_score(df)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "scalar-subquery" not in plan and plan.count("LogicalRDD") + plan.count("LocalRelation") == 1
    s = out.first()
    assert s.missing_percentage == round(100 * 5 / 24, 2) and s.duplicate_percentage == 50.0 and s.type_issues == 1
