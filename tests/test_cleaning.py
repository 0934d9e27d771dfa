import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskweft.operators import dedupe, describe, features, filters, matrix, missing, ordering, outliers
from riskweft.operators import plotdata, profile
from riskweft.operators import quantiles as Q


def rows_of(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


# --- quantiles -------------------------------------------------------------------------


def test_quantiles_match_linear_interpolation(spark):
    values = [1.0, 2.0, 3.0, 4.0, 100.0, None]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = Q.quantile_values(df, {"x": [0.0, 0.25, 0.5, 0.9, 1.0]})
    want = np.quantile([1, 2, 3, 4, 100], [0.0, 0.25, 0.5, 0.9, 1.0])
    assert [got["x", p] for p in (0.0, 0.25, 0.5, 0.9, 1.0)] == pytest.approx(list(want))


def test_bracketed_quantiles_are_exact_with_a_hot_value(spark):
    # a third of all rows share one value, which lies between the others
    df = spark.sql(
        """SELECT CASE WHEN id % 3 = 0 THEN 0.5 ELSE pmod(xxhash64(id), 1000003) / 1000003.0D END AS x,
                  CAST(id % 7 AS DOUBLE) AS few, CAST(NULL AS DOUBLE) AS nothing
           FROM range(90000)"""
    ).cache()
    ps = [0.001, 0.01, 0.25, 0.5, 0.65, 0.75, 0.99]
    got = Q.quantile_values(df, {"x": ps, "few": ps, "nothing": [0.5]})
    pdf = df.toPandas()
    for c in ("x", "few"):
        assert [got[c, p] for p in ps] == pytest.approx(pdf[c].quantile(ps).tolist(), rel=1e-13)
    assert got["nothing", 0.5] is None


def test_narrowing_and_retry_reach_the_same_answer(spark, monkeypatch):
    df = spark.sql("SELECT pmod(xxhash64(id, 9), 700001) / 7.0D AS x FROM range(60000)").cache()
    want = df.toPandas().x.quantile([0.1, 0.5, 0.93]).tolist()
    monkeypatch.setattr(Q, "BUFFER_VALUES", 50)
    got = Q.quantile_values(df, {"x": [0.1, 0.5, 0.93]})
    assert [got["x", p] for p in (0.1, 0.5, 0.93)] == pytest.approx(want, rel=1e-13)
    # brackets far too tight: the rank check notices and the retry widens them
    monkeypatch.setattr(Q, "BUFFER_VALUES", 10**6)
    monkeypatch.setattr(Q, "SKETCH_MARGIN", 1e-7)
    got = Q.quantile_values(df, {"x": [0.1, 0.5, 0.93]})
    assert [got["x", p] for p in (0.1, 0.5, 0.93)] == pytest.approx(want, rel=1e-13)


@pytest.mark.parametrize("buffer", [2_000_000, 100])
def test_grouped_quantiles_with_one_hot_group(spark, monkeypatch, buffer):
    monkeypatch.setattr(Q, "BUFFER_VALUES", buffer)
    df = spark.sql(
        """SELECT IF(id % 3 = 0, 'hot', concat('g', id % 50)) AS g,
                  pmod(xxhash64(id, 4), 99991) / 10.0D AS x FROM range(120000)"""
    ).cache()
    plan = Q.plan_quantiles(df, {"x": [0.25, 0.5]}, by=["g"])
    got = plan.rows.groupBy("g").agg(plan["x", 0.25].alias("a"), plan["x", 0.5].alias("b"))
    want = df.toPandas().groupby("g").x.quantile([0.25, 0.5]).unstack()
    for r in got.collect():
        assert (r["a"], r["b"]) == pytest.approx(tuple(want.loc[r["g"]]), abs=1e-9)


def test_accuracy_switches_to_the_sketch(spark):
    df = spark.range(1001).select(F.col("id").cast("double").alias("x"))
    assert Q.quantile_values(df, {"x": [0.5]}, accuracy=10_000)["x", 0.5] == 500.0


# --- filters ---------------------------------------------------------------------------


@pytest.fixture(scope="module")
def small(spark):
    return spark.createDataFrame(
        [(1, "a", 10.0), (2, "b", None), (3, None, 30.0), (4, "c", 40.0)],
        "id int, k string, v double",
    )


@pytest.mark.parametrize(
    "condition, kept",
    [
        ({"v": (">", 10)}, [3, 4]),
        ({"v": (">=", 10)}, [1, 3, 4]),
        ({"v": ("<", 40)}, [1, 3]),
        ({"v": ("<=", 40)}, [1, 3, 4]),
        ({"k": ("==", "a")}, [1]),
        ({"k": ("!=", "a")}, [2, 3, 4]),
        ({"k": ("in", ["a", "b"])}, [1, 2]),
        ({"k": ("not_in", ["a", "b"])}, [3, 4]),
        ({"v": ("between", (10, 30))}, [1, 3]),
        ({"k": ("is_null", None)}, [3]),
        ({"k": ("not_null", None)}, [1, 2, 4]),
        ({"v": (">", 5), "k": ("!=", "c"), "zz": ("==", 1)}, [1, 3]),
        ({}, [1, 2, 3, 4]),
    ],
)
def test_filter_rows(small, condition, kept):
    assert sorted(r.id for r in filters.filter_rows(small, condition).collect()) == kept


def test_unknown_filter_operator(small):
    with pytest.raises(ValueError, match="Invalid operator"):
        filters.filter_rows(small, {"v": ("~", 1)})


def test_keep_listed(spark, small):
    listed = spark.createDataFrame([("a",), ("c",), (None,)], "x string")
    assert rows_of(filters.keep_listed(small, "k", listed).select("id")) == [(1,), (4,)]


# --- missing values --------------------------------------------------------------------


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(float("nan"), 1.0), (2.0, None)], "a double, b double")
    assert rows_of(missing.nan_to_null(df)) == [(None, 1.0), (2.0, None)]


def test_drop_and_constant(small):
    assert rows_of(missing.handle_missing(small, "drop").select("id")) == [(1,), (4,)]
    filled = missing.handle_missing(small, "fill", fill_value=-999)
    assert rows_of(filled, "id")[1:3] == [(2, "b", -999.0), (3, "-999", 30.0)]
    with pytest.raises(ValueError, match="fill_value"):
        missing.handle_missing(small, "fill")
    with pytest.raises(ValueError, match="Invalid strategy"):
        missing.handle_missing(small, "custom")


def test_constant_that_does_not_fit_is_left_out(small):
    assert rows_of(missing.fill_constant(small, "x", ["k", "v"]), "id")[1] == (2, "b", None)


@pytest.mark.parametrize(
    "strategy, value", [("mean", 80 / 3), ("median", 30.0), ("mode", 10.0), ("zero", 0.0)]
)
def test_numeric_strategies(small, strategy, value):
    out = missing.handle_missing(small, numeric_strategy=strategy)
    assert out.filter("id = 2").first()["v"] == pytest.approx(value)
    assert out.filter("id = 3").first()["k"] == "a"  # smallest of three equally frequent
    assert out.schema["id"].dataType == small.schema["id"].dataType


def test_mode_prefers_the_smallest_on_a_tie(spark):
    df = spark.createDataFrame([(3,), (3,), (1,), (1,), (2,), (None,)], "x int")
    assert missing.modal_value(df, "x").first()[0] == 1


def test_column_without_values(spark):
    df = spark.createDataFrame([(None, None)], "x double, s string")
    out = missing.handle_missing(df, numeric_strategy="mode").first()
    assert tuple(out) == (0.0, "Unknown")


def test_categorical_constant_falls_back(small):
    out = missing.handle_missing(small, categorical_strategy="constant", fill_value="")
    assert out.filter("id = 3").first()["k"] == "Unknown"


def test_strategies_are_checked_without_nulls(small):
    clean = small.filter("id = 1")
    with pytest.raises(ValueError, match="numeric_strategy"):
        missing.handle_missing(clean, numeric_strategy="best")
    with pytest.raises(ValueError, match="categorical_strategy"):
        missing.handle_missing(clean, categorical_strategy="best")


@pytest.mark.parametrize("backward", [False, True])
@pytest.mark.parametrize("keys", [[], ["g"]])
@pytest.mark.parametrize("parts", [1, 17])
def test_directional_fill(spark, monkeypatch, backward, keys, parts):
    monkeypatch.setattr(missing, "WINDOW_ROWS", 10)  # use blocks for the groups as well
    df = spark.sql(
        """SELECT CAST(id AS INT) AS i, IF(id % 3 = 0, 0, CAST(id % 5 AS INT)) AS g,
                  CASE WHEN pmod(xxhash64(id), 4) = 0 THEN CAST(id AS DOUBLE) END AS x
           FROM range(300)"""
    ).repartition(parts)
    got = missing.directional_fill(df, ["x"], ["i"], keys, backward)
    pdf = df.toPandas().sort_values("i")
    source = pdf.groupby("g").x if keys else pdf.x
    pdf["x"] = source.bfill() if backward else source.ffill()
    want = [(i, g, None if np.isnan(x) else x) for i, g, x in zip(pdf.i, pdf.g, pdf.x)]
    assert rows_of(got, "i") == want


def test_fill_keeps_types_and_leading_gaps(spark):
    df = spark.sql(
        """SELECT CAST(id AS INT) AS i, IF(id = 7, 'a', NULL) AS k,
                  IF(id IN (3, 12), CAST(id AS DECIMAL(20, 2)), NULL) AS d,
                  IF(id = 4, DATE'2020-01-02', NULL) AS t FROM range(20)"""
    ).repartition(5)
    got = missing.directional_fill(df, ["k", "d", "t"], ["i"])
    assert got.schema.simpleString() == df.schema.simpleString()
    out = {r.i: r for r in got.collect()}
    assert [out[i].k for i in (0, 6, 7, 19)] == [None, None, "a", "a"]
    assert [None if out[i].d is None else int(out[i].d) for i in (2, 3, 11, 12, 19)] == [None, 3, 3, 12, 12]
    assert out[3].t is None and str(out[19].t) == "2020-01-02"
    assert missing.directional_fill(df.limit(0), ["k"], ["i"]).count() == 0


def test_fill_with_a_hot_place_collapses_copies(spark, monkeypatch):
    monkeypatch.setattr(missing, "WINDOW_ROWS", 10)
    df = spark.sql(
        "SELECT IF(id % 3 = 0, 5, CAST(id AS INT)) AS i, "
        "IF(id % 3 = 0 OR id % 4 = 1, NULL, CAST(id AS DOUBLE)) AS x FROM range(120)"
    )
    got = rows_of(missing.directional_fill(df, ["x"], ["i"]), "i")
    pdf = df.toPandas().sort_values(["i", "x"], na_position="first")
    want = [(i, None if np.isnan(x) else x) for i, x in zip(pdf.i, pdf.x.ffill())]
    assert sorted(got, key=str) == sorted(want, key=str) and len(got) == 120


def test_fill_needs_an_order(small):
    with pytest.raises(ValueError, match="order_by"):
        missing.directional_fill(small, ["v"], [])


def test_missing_before_after(small):
    after = missing.handle_missing(small, "drop")
    assert dict(rows_of(missing.missing_before_after(small, after))) == {"before": 2, "after": 0}


# --- ordering --------------------------------------------------------------------------


def test_positions_and_running_totals(spark):
    df = spark.sql("SELECT CAST(pmod(xxhash64(id), 1000000) AS INT) AS x, id FROM range(500)")
    got = ordering.with_position(df, ["x", "id"], "pos").orderBy("pos").collect()
    assert [r.pos for r in got] == list(range(500))
    assert [(r.x, r.id) for r in got] == sorted((r.x, r.id) for r in got)
    blocks = ordering.sorted_blocks(df.withColumn("k", F.col("id") % 3), ["k", "x", "id"])
    total = ordering.running_total(blocks, F.lit(1), "below", within=["k"]).toPandas()
    want = total.sort_values(["k", "x", "id"]).groupby("k").cumcount()
    assert (total.below.loc[want.index] == want).all()


def test_expand_copies(spark):
    df = spark.createDataFrame([("a", 3), ("b", 0), ("c", 1_000_002)], "k string, n long")
    assert dict(rows_of(ordering.expand_copies(df, "n").groupBy("k").count())) == {
        "a": 3, "c": 1_000_002,
    }


# --- outliers --------------------------------------------------------------------------


@pytest.fixture(scope="module")
def spiky(spark):
    values = [*range(90), 100, 200, 300, 400, 500, 1000, 2000, 3000, 4000, 5000]
    flat = [95] * 90 + [100, 200, 300, 400, 500, 150, 250, 350, 450, 120]
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(values, flat))]
    return spark.createDataFrame(rows + [(100, None, None)], "i int, v double, flat double")


def pandas_bounds(x, method, t):
    x = x.dropna()
    if method == "iqr":
        q1, q3 = x.quantile(0.25), x.quantile(0.75)
        return q1 - t * (q3 - q1), q3 + t * (q3 - q1)
    if method == "zscore":
        return x.mean() - t * x.std(), x.mean() + t * x.std()
    if method == "percentile":
        return x.quantile(0.01), x.quantile(0.99)
    mad = (x - x.median()).abs().median()
    return x.median() - t * mad / 0.6745, x.median() + t * mad / 0.6745


@pytest.mark.parametrize("method, t", [("iqr", 1.5), ("zscore", 3), ("modified_zscore", 3), ("percentile", 0)])
def test_cap_and_remove(spiky, method, t):
    pdf = spiky.toPandas()
    low, high = pandas_bounds(pdf.v, method, t)
    capped = outliers.treat_outliers(spiky, method, "cap", ["v"]).orderBy("i").toPandas()
    want = pdf.sort_values("i").v.clip(low, high)
    assert np.allclose(capped.v, want, equal_nan=True)
    kept = outliers.treat_outliers(spiky, method, "remove", ["v"]).count()
    assert kept == int((pdf.v.isna() | pdf.v.between(low, high)).sum())


def test_cap_is_idempotent_on_fixed_bounds(spiky):
    (bounds,) = outliers.find_bounds(spiky, ["v"], "iqr", 1.5)
    capped = spiky.withColumn("v", outliers._capped(bounds))
    assert capped.filter(bounds.outside()).count() == 0


def test_zero_mad_finds_nothing(spiky):
    assert outliers.detect_outliers(spiky, ["flat"], "modified_zscore", 3.5).count() == 0


def test_detection_uses_the_population_deviation(spiky):
    pdf = spiky.toPandas().dropna()
    z = ((pdf.v - pdf.v.mean()) / pdf.v.std(ddof=0)).abs()
    out = outliers.detect_outliers(spiky, ["v"], "zscore", 3, keys=["i"]).toPandas()
    assert sorted(out.i) == sorted(pdf.i[z > 3])
    assert set(out["count"]) == {int((z > 3).sum())}
    assert out.percentage.iloc[0] == pytest.approx(100 * (z > 3).mean())


def test_stricter_multiplier_finds_no_fewer(spiky):
    counts = [
        outliers.outlier_report(spiky, ["v"], m).first()["outlier_count"] for m in (3.0, 1.5, 0.5)
    ]
    assert counts == sorted(counts)


def test_log_transform_shifts_non_positive_columns(spark):
    df = spark.createDataFrame([(float(v),) for v in [-2, 0, 1, 2, 3, 500]], "x double")
    got = [r.x for r in outliers.treat_outliers(df, "iqr", "log_transform").collect()]
    assert sorted(got) == pytest.approx(sorted(np.log(np.array([-2, 0, 1, 2, 3, 500]) + 3)))
    plain = df.filter("x < 100")
    assert sorted(outliers.treat_outliers(plain, "iqr", "log_transform").collect()) == sorted(
        plain.collect()
    )


def test_sequential_removal_uses_remaining_rows(spiky):
    pdf = spiky.toPandas()
    for c in ("v", "flat"):
        low, high = pandas_bounds(pdf[c], "iqr", 1.5)
        pdf = pdf[pdf[c].isna() | pdf[c].between(low, high)]
    out = outliers.treat_outliers(spiky, "iqr", "remove", ["v", "nope", "flat"])
    assert sorted(r.i for r in out.collect()) == sorted(pdf.i)


def test_outlier_errors(spiky):
    with pytest.raises(ValueError, match="Invalid method"):
        outliers.treat_outliers(spiky, "magic")
    with pytest.raises(ValueError, match="Invalid action"):
        outliers.treat_outliers(spiky, "iqr", "magic")
    with pytest.raises(ValueError, match="Method must be one of"):
        outliers.detect_outliers(spiky, ["v"], "percentile")


def test_compare_methods(spiky):
    out = {r["column"]: r for r in outliers.compare_methods(spiky, ["i", "v", "flat"]).collect()}
    assert set(out) == {"v", "flat"} and out["flat"]["modified_zscore"] == 0


# --- duplicates ------------------------------------------------------------------------


@pytest.fixture(scope="module")
def repeated(spark):
    rows = [(1, None, 5), (1, None, 5), (1, "a", 1), (2, "b", 2), (2, "b", 9), (3, None, 7)]
    return spark.createDataFrame(rows, "k int, s string, v int")


def test_remove_duplicates(repeated):
    assert rows_of(dedupe.remove_duplicates(repeated)) == [
        (1, None, 5), (1, "a", 1), (2, "b", 2), (2, "b", 9), (3, None, 7),
    ]
    first = dedupe.remove_duplicates(repeated, ["k"], "first", ["v"])
    assert rows_of(first) == [(1, "a", 1), (2, "b", 2), (3, None, 7)]
    last = dedupe.remove_duplicates(repeated, ["k"], "last", ["v"])
    assert rows_of(last) == [(1, None, 5), (2, "b", 9), (3, None, 7)]
    assert rows_of(dedupe.remove_duplicates(repeated, ["k"], False)) == [(3, None, 7)]
    assert rows_of(dedupe.remove_duplicates(repeated, keep=False))[0] == (1, "a", 1)
    with pytest.raises(ValueError, match="keep"):
        dedupe.remove_duplicates(repeated, keep="some")


def test_first_row_is_kept_before_the_shuffle(repeated):
    plan = dedupe.remove_duplicates(repeated, ["k"], "first", ["v"])
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in text


@pytest.mark.parametrize("keep, subset", [("first", None), (False, None), ("last", ["k"]), (False, ["k", "s"])])
def test_duplicate_report_matches_pandas(repeated, keep, subset):
    pdf = repeated.toPandas()
    mask = pdf.duplicated(subset=subset, keep=keep)
    r = dedupe.duplicate_report(repeated, subset, keep).first()
    assert (r.duplicate_count, r.unique_count) == (mask.sum(), (~mask).sum())
    assert r.duplicate_percentage == round(mask.mean() * 100, 2)
    assert dedupe.duplicate_rows(repeated, subset, keep, ["v"]).count() == mask.sum()


def test_duplicate_rows_keep_exact_copies(repeated):
    assert rows_of(dedupe.duplicate_rows(repeated)) == [(1, None, 5)]
    out = dedupe.duplicate_rows(repeated, ["k"], "first", ["v"])
    assert rows_of(out) == [(1, None, 5), (1, None, 5), (2, "b", 9)]


# --- features --------------------------------------------------------------------------


def test_features_against_pandas(policies):
    out = features.derive_features(policies, as_of_year=2015).toPandas().sort_values("LineNo")
    pdf = policies.toPandas().sort_values("LineNo")
    has = (pdf.TotalClaims > 0).astype(int)
    assert (out.HasClaim.values == has.values).all()
    assert (out.VehicleAge.values == (2015 - pdf.RegistrationYear).clip(lower=0).values).all()
    assert np.allclose(out.LossRatio, pdf.TotalClaims / pdf.TotalPremium, equal_nan=True)
    assert np.allclose(out.ClaimFrequency, has.groupby(pdf.PolicyID).transform("mean"))
    assert np.allclose(out.AvgClaimAmount, pdf.TotalClaims.groupby(pdf.PolicyID).transform("mean"))
    high = (pdf.SumInsured > pdf.SumInsured.quantile(0.75)).astype(int)
    assert (out.IsHighValue.values == high.values).all()
    assert (out.TransactionQuarter.values == pdf.TransactionMonth.dt.quarter.values).all()
    group = pd.cut(out.VehicleAge, [-1, 3, 7, 12, 100], labels=[g[2] for g in features.AGE_GROUPS])
    assert (out.VehicleAgeGroup.values == group.astype(str).values).all()


def test_age_bins_are_right_closed(spark):
    df = spark.createDataFrame([(a,) for a in (-1, 0, 3, 4, 7, 8, 12, 13, 100, 101)], "VehicleAge int")
    got = [r[0] for r in df.orderBy("VehicleAge").select(features.age_group()).collect()]
    new, mid, old, very = (g[2] for g in features.AGE_GROUPS)
    assert got == [None, new, new, mid, mid, old, old, very, very, None]


def test_features_skip_overwrite_and_zero_premium(spark):
    df = spark.createDataFrame([(1, 5.0, 0.0), (None, None, 2.0)], "PolicyID int, TotalClaims double, TotalPremium double")
    once = features.derive_features(df)
    twice = features.derive_features(once)
    assert once.columns == twice.columns and "VehicleAge" not in once.columns
    got = {r.PolicyID: r for r in twice.collect()}
    assert got[1].LossRatio is None and got[None].HasClaim == 0
    assert got[None].ClaimFrequency is None and got[1].ClaimFrequency == 1.0
    with pytest.raises(ValueError, match="Unknown features"):
        features.derive_features(df, ["Nope"])


@pytest.mark.parametrize("run", [
    lambda d: filters.filter_rows(d, {"x": (">", 0.5)}).select("x"),
    lambda d: filters.filter_rows(d, {"x": ("not_null", None)}).select("x"),
    lambda d: describe.describe_numeric(d, ["x"]),
    lambda d: plotdata.histogram(d, "x", 4),
    lambda d: outliers.treat_outliers(d, "zscore", "cap", ["x"], z_threshold=1.0),
    lambda d: outliers.detect_outliers(d, columns=["x"]),
    lambda d: profile.missing_by_column(d),
    lambda d: missing.impute(d, "mean", "mode"),
    lambda d: matrix.correlation_matrix(d, ["x", "y"]),
])
def test_nan_counts_as_missing(spark, run):
    values = [(1.0, 2.0), (None, 1.0), (3.0, 5.0), (9.0, None), (4.0, 4.0)]
    with_null = spark.createDataFrame(values, "x double, y double")
    with_nan = with_null.fillna(float("nan"))
    assert sorted(map(str, run(with_nan).collect())) == sorted(map(str, run(with_null).collect()))
