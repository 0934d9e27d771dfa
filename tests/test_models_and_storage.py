import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from riskweft.operators import modelling as L
from riskweft.operators import sampling, shapley
from riskweft.sources import schema, sinks, text
from riskweft.streaming import monitor


# --- preparation -----------------------------------------------------------------------


@pytest.fixture(scope="module")
def bench(policies):
    rows = policies.withColumn(
        "CalculatedPremiumPerTerm", F.pmod(F.xxhash64("LineNo"), F.lit(5000)).cast("double")
    )
    rows = rows.withColumn("TotalClaims", F.when(F.col("LineNo") % 50 != 9, F.col("TotalClaims")))
    b = L.prepare(rows)
    b.train_linear_regression()
    b.train_random_forest(n_estimators=4, max_depth=4)
    b.train_boosted_trees(n_estimators=3, max_depth=3)
    return b, rows


def test_feature_choice(policies):
    numerical, categorical = L.choose_features(policies, "TotalClaims")
    assert numerical == ["TotalPremium", "SumInsured", "VehicleAge"]
    assert categorical == ["Province", "VehicleType", "Gender"]
    assert "TotalPremium" not in L.choose_features(policies, "TotalPremium")[0]
    with pytest.raises(ValueError, match="No valid feature"):
        L.choose_features(policies.select("LineNo"), "LineNo")


def test_preparation_matches_pandas(policies):
    steps = L.fit_features(policies, "TotalClaims")
    got = steps.columns(policies).toPandas().sort_values("LineNo")
    pdf = policies.toPandas().sort_values("LineNo")
    x = pdf.TotalPremium.astype(float).fillna(pdf.TotalPremium.median())
    assert np.allclose(got["TotalPremium__x"], (x - x.mean()) / x.std(ddof=0))
    filled = pdf.Province.fillna(pdf.Province.mode()[0])
    codes = {v: i for i, v in enumerate(sorted(filled.unique()))}
    assert (got["Province__x"].values == filled.map(codes).values).all()


def test_many_labels_stay_a_table(policies, monkeypatch):
    listed = L.fit_features(policies, "TotalClaims").columns(policies)
    monkeypatch.setattr(L, "MOST_LABELS", 2)
    steps = L.fit_features(policies, "TotalClaims")
    assert set(steps.tables) == {"Province", "VehicleType"}
    keep = ["LineNo", "Province__x", "VehicleType__x", "Gender__x"]
    rows = [sorted(map(tuple, d.select(*keep).collect())) for d in (listed, steps.columns(policies))]
    assert rows[0] == rows[1]
    unseen = steps.columns(policies.withColumn("VehicleType", F.lit("Tram")))
    assert unseen.select("VehicleType__x").distinct().collect()[0][0] == 3.0


def test_constant_feature_scales_to_zero(spark):
    df = spark.createDataFrame([(3.0,), (3.0,)], "x double")
    assert [r.x for r in L.scale(df, ["x"]).collect()] == [0.0, 0.0]


def test_label_encoding_keeps_nulls(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("c",)], "k string")
    got = {r.k: r.k_encoded for r in L.label_encode(df, "k").collect()}
    assert got == {"a": 0, "b": 1, "c": 2, None: None}


def test_split_is_stable_and_complete(policies):
    train, test = sampling.split(policies)
    other_train, _ = sampling.split(policies.repartition(13))
    keys = {r.LineNo for r in train.collect()}
    assert keys == {r.LineNo for r in other_train.collect()}
    assert keys.isdisjoint({r.LineNo for r in test.collect()})
    assert train.count() + test.count() == 1000 and 150 < test.count() < 250
    with pytest.raises(ValueError, match="test_size"):
        sampling.split(policies, 1.2)


def test_sample_sizes(policies):
    assert sampling.sample_rows(policies, 100).count() == 100
    assert sampling.sample_rows(policies, 5000).count() == 1000
    copies = policies.select(F.lit(1).alias("same"))
    assert sampling.sample_rows(copies, 137).count() == 137
    assert sampling.sample_rows(copies, 5000).count() == 1000
    first = sampling.preview(policies, ["LineNo"], 3).collect()
    assert [r.LineNo for r in first] == [0, 1, 2]


def test_sample_does_not_depend_on_partitions(policies):
    rows = policies.unionByName(policies.limit(50))
    one, many = (sampling.sample_rows(rows.repartition(k), 120, seed=7) for k in (1, 17))
    assert sorted(map(str, one.collect())) == sorted(map(str, many.collect()))
    assert sampling.sample_rows(rows, 120, seed=8).exceptAll(one).count() > 50


# --- models ------------------------------------------------------------------------------


def test_summary_and_metrics(bench):
    b, rows = bench
    s = b.summary().first()
    assert s.n_samples == 980 and s.n_features == 7
    assert s.train_size + s.test_size == 980
    table = b.evaluate().collect()
    assert {r.model for r in table} == {"Linear Regression", "Random Forest", "Boosted Trees"}
    assert [r.r2 for r in table] == sorted((r.r2 for r in table), reverse=True)
    assert b.best_model().first().model == table[0].model
    assert all(r.rmse >= r.mae > 0 for r in table)


def test_linear_model_is_least_squares(bench):
    b, _ = bench
    pdf = b.train.toPandas()
    x = np.column_stack([np.ones(len(pdf)), np.stack([v.toArray() for v in pdf.features])])
    want, *_ = np.linalg.lstsq(x, pdf.label.to_numpy(), rcond=None)
    model = b.models["Linear Regression"]
    assert model.intercept == pytest.approx(want[0]) and list(model.coefficients) == pytest.approx(list(want[1:]))


def test_metrics_by_hand(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (6.0, 5.0)], "y double, p double")
    r = L.regression_metrics(df, "y", "p").first()
    assert (r.rmse, r.mae, r.r2) == pytest.approx((math.sqrt(2 / 3), 2 / 3, 1 - 2 / 14))
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, 1.0)], "y double, p double")
    assert L.regression_metrics(flat, "y", "p").first().r2 == 0.0


def test_importance_and_prediction(bench):
    b, rows = bench
    top = b.feature_importance("Random Forest", 3).collect()
    assert len(top) == 3 and top[0].importance >= top[1].importance
    with pytest.raises(ValueError, match="doesn't support"):
        b.feature_importance("Linear Regression")
    with pytest.raises(ValueError, match="not trained"):
        b.predict(rows, "Nope")
    unseen = rows.withColumn("VehicleType", F.lit("Tram"))
    assert b.predict(unseen, "Random Forest").filter("prediction IS NULL").count() == 0
    assert "prediction" in b.predict(rows).columns
    empty = L.Workbench(b.steps, b.train, b.test)
    with pytest.raises(ValueError, match="No models trained"):
        empty.evaluate()


def test_risk_bands_join_the_policies_once(spark, policies, monkeypatch):
    from riskweft.operators import rules
    from riskweft.plans import models

    made = policies.withColumn("CalculatedPremiumPerTerm", F.pmod(F.xxhash64("LineNo"), F.lit(5000)).cast("double")).select(
        "*", F.col("LineNo").alias("LineNumber"), F.lit(1).alias("PartKey"), F.lit("7").alias("PostalCode")
    )
    read = []
    monkeypatch.setattr(models, "policy_view", lambda _, __, columns: read.append(columns) or made.select(*columns))
    got = models.predicted_risk_bands(spark, "")
    assert len(read) == 1
    b = L.prepare(made.select(*models.INPUT))
    assert not b.train.is_cached
    b.train_linear_regression()
    want = rules.risk_bands(b.predict(made, "Linear Regression")).select(*got.columns)
    key = lambda r: r.LineNumber
    pairs = list(zip(sorted(got.collect(), key=key), sorted(want.collect(), key=key), strict=True))
    assert len(pairs) == 1000 and all(x.risk_band == y.risk_band and x.prediction == pytest.approx(y.prediction) for x, y in pairs)


# --- Shapley values ------------------------------------------------------------------------


def test_shapley_values_add_up_and_match_the_definition(bench):
    b, _ = bench
    model = b.models["Random Forest"]
    few = b.test.orderBy("label").limit(3).cache()
    back = b.train.orderBy("label").limit(4).cache()
    names = b.steps.names
    got = shapley.shapley_values(model, few, back, names, 3, 4).toPandas()
    predictions = sorted(r.p for r in L._predict(few, model, "p").collect())
    base = L._predict(back, model, "p").agg(F.avg("p")).first()[0]
    sums = sorted(got.groupby("row").phi.sum() + base)
    assert sums == pytest.approx(predictions)


def test_shapley_of_a_linear_model_is_closed_form(bench):
    b, _ = bench
    model, names = b.models["Linear Regression"], b.steps.names
    few = b.test.orderBy("label").limit(2).cache()
    back = b.train.orderBy("label").limit(5).cache()
    means = np.mean([r.features.toArray() for r in back.collect()], axis=0)
    want = sorted(
        round(float(c * (x - m)), 6)
        for r in few.collect()
        for c, x, m in zip(model.coefficients, r.features.toArray(), means)
    )
    for method in shapley.METHODS:
        got = shapley.shapley_values(model, few, back, names, 2, 5, method=method, permutations=3)
        assert sorted(round(r.phi, 6) for r in got.collect()) == pytest.approx(want, abs=1e-5)
    with pytest.raises(ValueError, match="permutations"):
        shapley.shapley_values(model, few, back, [f"f{i}" for i in range(11)], 2, 5)


def test_exact_weights_against_brute_force(spark, bench):
    b, _ = bench
    model, names = b.models["Boosted Trees"], b.steps.names
    row = b.test.orderBy("label").first().features.toArray()
    back = [r.features.toArray() for r in b.train.orderBy("label").limit(2).collect()]
    p = len(names)

    def frame(vectors):
        table = spark.createDataFrame([([float(v) for v in x],) for x in vectors], "a array<double>")
        return table.select(array_to_vector("a").alias("features"))

    masks = list(itertools.product([0, 1], repeat=p))
    mixed = [np.where(m, row, bg) for m in masks for bg in back]
    preds = [r.p for r in L._predict(frame(mixed).coalesce(1), model, "p").collect()]
    v = {m: np.mean(preds[2 * i : 2 * i + 2]) for i, m in enumerate(masks)}
    want = []
    for j in range(p):
        total = 0.0
        for m in masks:
            if not m[j]:
                s = sum(m)
                w = math.factorial(s) * math.factorial(p - s - 1) / math.factorial(p)
                total += w * (v[m[:j] + (1,) + m[j + 1 :]] - v[m])
        want.append(total)
    got = shapley.shapley_values(model, frame([row]), frame(back), names, 1, 2)
    values = {r.feature: r.phi for r in got.collect()}
    assert [values[n] for n in names] == pytest.approx(want)
    ranked = shapley.mean_absolute(got, 2).collect()
    assert ranked[0].mean_abs_phi == pytest.approx(max(map(abs, want)))


# --- text files ------------------------------------------------------------------------------


def write(tmp_path, name, content):
    path = tmp_path / name
    path.write_text(content, encoding="utf-8")
    return str(path)


def test_load_pipe_text_with_missing_tokens(spark, tmp_path):
    path = write(
        tmp_path,
        "a.txt",
        "PolicyID|Province|Premium|Flag|Age\n1|NA|10.5|True|7\n2|null||False|NaN\n3|  |1e3|True|8\n4|x|N/A|True|9",
    )
    df = text.load_delimited(spark, path)
    assert dict(df.dtypes) == {
        "PolicyID": "bigint", "Province": "string", "Premium": "double", "Flag": "boolean", "Age": "bigint",
    }
    rows = [tuple(r) for r in df.orderBy("PolicyID").collect()]
    assert rows[0] == (1, None, 10.5, True, 7) and rows[1] == (2, None, None, False, None)
    assert rows[2][1].strip() == "" and rows[2][1] is not None and rows[2][2] == 1000.0


def test_load_with_schema_and_other_delimiters(spark, tmp_path):
    path = write(tmp_path, "a.tsv", "a\tb\n1\tx\n2\ty\n")
    assert text.detect_delimiter(spark, path) == "\t"
    df = text.load_delimited(spark, path, "\t", schema="a double, b string")
    assert [tuple(r) for r in df.collect()] == [(1.0, "x"), (2.0, "y")]


@pytest.mark.parametrize(
    "content, want", [("a|b|c\n1|2|3", "|"), ("a,b;c", ","), ("a;b;c", ";"), ("plain words here", " "), ("x", "|")]
)
def test_detect_delimiter(spark, tmp_path, content, want):
    assert text.detect_delimiter(spark, write(tmp_path, "d.txt", content)) == want


def test_load_errors(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        text.load_delimited(spark, str(tmp_path / "absent.txt"))
    with pytest.raises(FileNotFoundError):
        text.detect_delimiter(spark, str(tmp_path / "absent.txt"))
    with pytest.raises(ValueError, match="empty"):
        text.load_delimited(spark, write(tmp_path, "e.txt", ""))
    with pytest.raises(ValueError, match="No data"):
        text.load_delimited(spark, write(tmp_path, "h.txt", "a|b\n"))
    with pytest.raises(ValueError, match="parsing"):
        text.load_delimited(spark, write(tmp_path, "m.txt", "a|b\n1|2\n3|4|5|6\n"))


def test_load_what_pandas_writes(spark, tmp_path):
    frame = pd.DataFrame({
        "key": [9000000000000000001, 9000000000000000003, 3],
        "text": [' lead ', 'say "hi", ok', "a|b"],
        "number": [float("inf"), 1.5, None],
        "long": ["123456789012345678901234", "1", "2"],
    })
    path = str(tmp_path / "own.csv")
    frame.to_csv(path, index=False)
    got = text.load_delimited(spark, path, ",").toPandas().sort_values("key").reset_index(drop=True)
    want = frame.sort_values("key").reset_index(drop=True)
    assert got.key.tolist() == want.key.tolist() and got.text.tolist() == want.text.tolist()
    assert got.long.tolist() == want.long.tolist()
    assert got.number.isna().tolist() == want.number.isna().tolist() and got.number.max() == float("inf")
    broken = write(tmp_path, "short.txt", 'a|b|c\n1|2|3\n4|5\n"x ""y"" |z"|6|7\n')
    rows = text.load_delimited(spark, broken).collect()
    assert sorted(map(tuple, rows)) == [("1", 2, 3), ("4", 5, None), ('x "y" |z', 6, 7)]
    lines = write(tmp_path, "lines.csv", 'a,b\n1,"two\nlines"\n')
    assert text.load_delimited(spark, lines, ",", multiline=True).first()["b"] == "two\nlines"


def test_pandas_reads_what_we_save(spark, tmp_path):
    rows = [(1, " lead "), (2, 'a "quoted", field'), (3, "tab\there")]
    path = str(tmp_path / "saved")
    sinks.save(spark.createDataFrame(rows, "k int, t string").coalesce(1), path, "csv")
    back = pd.read_csv(next((tmp_path / "saved").glob("part-*.csv")))
    assert list(back.itertuples(index=False, name=None)) == rows


@pytest.mark.parametrize("format", ["csv", "txt", "parquet"])
def test_save_and_load(spark, policies, tmp_path, format):
    path = str(tmp_path / "deep" / "out")
    rows = policies.select("LineNo", "Province", "TotalPremium")
    sinks.save(rows, path, format)
    back = (
        spark.read.parquet(path)
        if format == "parquet"
        else text.load_delimited(spark, path, "|" if format == "txt" else ",")
    )
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)
    with pytest.raises(ValueError, match="Invalid format"):
        sinks.save(rows, path, "excel")


def test_partitioned_output_prunes(spark, policies, tmp_path):
    path = str(tmp_path / "by_gender")
    sinks.save(policies, path, "parquet", partition_by=["Gender"])
    one = spark.read.parquet(path).filter("Gender = 'Male'")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(Gender" in plan
    assert one.count() == policies.filter("Gender = 'Male'").count()


def test_schema_validation(spark):
    assert len(schema.POLICY_SCHEMA_COLUMNS) == 52
    df = spark.createDataFrame([(1, 2)], "PolicyID int, policyid2 int")
    r = schema.validate_schema(df).first()
    assert not r.is_valid and r.extra_columns == ["policyid2"] and len(r.missing_columns) == 51
    assert r.match_percentage == pytest.approx(100 / 52)
    with pytest.raises(ValueError, match="strict"):
        schema.validate_schema(df, strict=True)
    full = spark.range(1).select(*[F.lit(1).alias(c) for c in schema.POLICY_SCHEMA_COLUMNS])
    assert schema.validate_schema(full, strict=True).first().is_valid


# --- streaming -----------------------------------------------------------------------------------


def test_stream_matches_its_batch_twin(spark, policies, tmp_path):
    source = str(tmp_path / "in")
    policies.select("TransactionMonth", "Gender", "TotalPremium", "TotalClaims").write.parquet(source)
    stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    table = monitor.windowed_kpis(stream, every="30 days", late="2 days", by=["Gender"])
    out = str(tmp_path / "out")
    monitor.write_windows(table, out, str(tmp_path / "state"), available_now=True).awaitTermination()
    got = spark.read.schema(table.schema).parquet(out)
    twin = monitor.windowed_kpis(policies, every="30 days", late="2 days", by=["Gender"])
    last = policies.agg(F.max("TransactionMonth")).first()[0]
    closed = twin.filter(F.col("window_end") <= F.lit(last) - F.expr("interval 2 days"))
    keys = ["window_start", "Gender", "policy_count"]
    want = sorted(map(tuple, closed.select(*keys).collect()))
    assert sorted(map(tuple, got.select(*keys).collect())) == want and len(want) > 20
    alerts = monitor.margin_alerts(got)
    assert alerts.filter("average_margin >= -10 AND loss_ratio <= 1").count() == 0


def test_late_rows_are_dropped(spark, tmp_path):
    def add(name, rows):
        df = spark.createDataFrame(rows, "ts string, value double")
        df = df.withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1)
        df.write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        stream = spark.readStream.schema("ts timestamp_ntz, value double").parquet(str(tmp_path / "in"))
        table = monitor.windowed_totals(stream, "ts", "value", "1 hour", "1 hour")
        monitor.write_windows(
            table, str(tmp_path / "out"), str(tmp_path / "state"), available_now=True
        ).awaitTermination()
        return {
            r.window_start.hour: r.total for r in spark.read.schema(table.schema).parquet(str(tmp_path / "out")).collect()
        }

    add("a", [("2024-01-01 00:10:00", 1.0), ("2024-01-01 05:00:00", 2.0)])
    assert run() == {0: 1.0}
    add("b", [("2024-01-01 00:20:00", 99.0), ("2024-01-01 09:00:00", 4.0)])
    assert run() == {0: 1.0, 5: 2.0}


def test_fits_read_no_more_partitions_than_tasks_at_once(spark, bench):
    """Every partition sends statistics of all nodes in every pass, so a fit slows down with their number."""
    seen = []

    class Spy:
        def fit(self, rows):
            seen.append((rows.rdd.getNumPartitions(), rows.count()))
            return L.LinearRegression(featuresCol=L.FEATURES, labelCol=L.LABEL).fit(rows)

    whole = bench[0]
    b = L.Workbench(whole.steps, whole.train.repartition(60).persist(), whole.test)
    b._fit("Spy", Spy())
    assert seen == [(spark.sparkContext.defaultParallelism, whole.train.count())]
