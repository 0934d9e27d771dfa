"""Regression models on policy rows with Spark ML."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.ml.base import Model
from pyspark.ml.feature import StringIndexerModel, VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, functions as F

from riskweft.functions.tables import sent_if_small
from riskweft.operators import trees as ensembles
from riskweft.operators.features import vehicle_age
from riskweft.operators.ordering import with_position
from riskweft.operators.profile import value_counts_by_column
from riskweft.operators.quantiles import quantile_values
from riskweft.operators.sampling import split

# Default feature columns: fixed values.
CATEGORICAL = ("Province", "VehicleType", "Gender")
NUMERICAL = ("TotalPremium", "SumInsured", "CalculatedPremiumPerTerm")
# The portfolio ends in this year: fixed value.
AGE_YEAR = 2015
# Values of a text feature up to which its labels are a list inside the model.
MOST_LABELS = 10_000
# Spark's own limit on tree depth stands in for "unlimited".
DEEPEST = 30
# Training rows in one partition, where there are more partitions than tasks that run at once.
ROWS_A_TASK = 2_000_000

LABEL = "label"
FEATURES = "features"


def choose_features(
    df: DataFrame,
    target: str,
    categorical: Sequence[str] | None = None,
    numerical: Sequence[str] | None = None,
    with_age: bool = True,
) -> tuple[list[str], list[str]]:
    """Feature columns that exist, without the target: (numerical, categorical)."""
    have = set(df.columns)
    if with_age and "RegistrationYear" in have:
        have.add("VehicleAge")
    if numerical is None:
        numerical = [*NUMERICAL, *(["VehicleAge"] if "VehicleAge" in have else [])]
    if categorical is None:
        categorical = CATEGORICAL
    numerical = [c for c in numerical if c in have and c != target]
    categorical = [c for c in categorical if c in have and c != target]
    if not numerical and not categorical:
        raise ValueError("No valid feature columns found")
    return numerical, categorical


@dataclass(frozen=True)
class FeatureSteps:
    """Fitted preparation: fill values, label order and scales, as plain numbers."""

    numerical: list[str]
    categorical: list[str]
    with_age: bool
    medians: Mapping[str, float | None]
    modes: Mapping[str, str]
    indexer: StringIndexerModel | None
    # Columns with too many values for a label list: value-to-code tables and sizes.
    tables: Mapping[str, tuple[DataFrame, int]]
    means: Mapping[str, float]
    deviations: Mapping[str, float]

    @property
    def names(self) -> list[str]:
        """Feature names in vector order."""
        return [*self.numerical, *self.categorical]

    def columns(self, df: DataFrame) -> DataFrame:
        """Add ``<name>__x`` columns: imputed and scaled numbers, label codes."""
        df = _with_age(df, self.with_age)
        out = {}
        for c in self.numerical:
            x = F.col(c).cast("double")
            if self.medians[c] is not None:
                x = F.coalesce(x, F.lit(float(self.medians[c])))
            out[f"{c}__x"] = (x - self.means[c]) / (self.deviations[c] or 1.0)
        for c in self.categorical:
            out[f"{c}__t"] = F.coalesce(F.col(c).cast("string"), F.lit(self.modes[c]))
        df = df.withColumns(out)
        coded = [c for c in self.categorical if c not in self.tables]
        if self.indexer is not None:
            df = self.indexer.transform(df)
            # Codes are plain numbers here; without the metadata trees split them as such.
            df = df.withColumns(
                {f"{c}__x": F.col(f"{c}__i").alias(f"{c}__x", metadata={}) for c in coded}
            )
        for c, (table, size) in self.tables.items():
            codes = table.select(F.col("value").alias(f"{c}__v"), F.col("code").alias(f"{c}__i"))
            df = df.join(codes, F.col(f"{c}__t") == F.col(f"{c}__v"), "left").drop(f"{c}__v")
            # as with the label list, an unseen value gets the next code
            code = F.coalesce(F.col(f"{c}__i"), F.lit(size)).cast("double")
            df = df.withColumn(f"{c}__x", code)
        return df.drop(*[f"{c}__{k}" for c in self.categorical for k in "it"])

    def transform(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """Rows with the feature vector and the columns to keep."""
        assembler = VectorAssembler(
            inputCols=[f"{c}__x" for c in self.names], outputCol=FEATURES, handleInvalid="error"
        )
        return assembler.transform(self.columns(df)).select(*keep, FEATURES)


def _with_age(df: DataFrame, wanted: bool) -> DataFrame:
    if wanted and "RegistrationYear" in df.columns:
        return df.withColumn("VehicleAge", vehicle_age(AGE_YEAR))
    return df


def fit_features(
    df: DataFrame,
    target: str = "TotalClaims",
    categorical: Sequence[str] | None = None,
    numerical: Sequence[str] | None = None,
    with_age: bool = True,
) -> FeatureSteps:
    """Medians, modes and label orders over all rows; scales over rows with a target."""
    numerical, categorical = choose_features(df, target, categorical, numerical, with_age)
    df = _with_age(df, with_age)
    medians: dict[str, float | None] = {}
    if numerical:
        levels = quantile_values(df, {c: [0.5] for c in numerical})
        medians = {c: levels[c, 0.5] for c in numerical}
    modes, labels, tables = _categories(df, categorical)

    means, deviations = {}, {}
    if numerical:
        rows = df.filter(F.col(target).isNotNull()) if target in df.columns else df
        filled = {
            c: F.coalesce(F.col(c).cast("double"), F.lit(medians[c]).cast("double"))
            for c in numerical
        }
        row = rows.agg(
            *[F.avg(x).alias(f"m{i}") for i, x in enumerate(filled.values())],
            *[F.stddev_pop(x).alias(f"s{i}") for i, x in enumerate(filled.values())],
        ).first()
        for i, c in enumerate(numerical):
            means[c], deviations[c] = row[f"m{i}"] or 0.0, row[f"s{i}"] or 0.0
    indexer = None
    if labels:
        indexer = StringIndexerModel.from_arrays_of_labels(
            list(labels.values()),
            inputCols=[f"{c}__t" for c in labels],
            outputCols=[f"{c}__i" for c in labels],
            handleInvalid="keep",
        )
    return FeatureSteps(
        numerical, categorical, with_age, medians, modes, indexer, tables, means, deviations
    )


def _categories(df: DataFrame, columns: Sequence[str]):
    """Most frequent value per column, sorted label lists, and code tables.

    One count serves all columns.  A column with up to ``MOST_LABELS`` values gets a
    label list inside the model; above that its codes stay a table.
    """
    modes: dict[str, str] = dict.fromkeys(columns, "Unknown")
    labels: dict[str, list[str]] = {}
    tables: dict[str, tuple[DataFrame, int]] = {}
    if not columns:
        return modes, labels, tables
    counts = value_counts_by_column(df, columns).persist()
    present = F.col("value").isNotNull()
    best = F.min(F.when(present, F.struct((-F.col("n")).alias("n"), F.col("value"))))
    found = counts.groupBy("column").agg(
        best.getField("value").alias("mode"), F.count("value").alias("size")
    )
    small = []
    for row in found.collect():  # one row per feature
        c = row["column"]
        if row["mode"] is not None:
            modes[c] = row["mode"]
        if row["size"] <= MOST_LABELS:
            small.append(c)
        else:
            values = counts.filter((F.col("column") == c) & present).select("value")
            tables[c] = (_codes(values), row["size"])
    listed = counts.filter(F.col("column").isin(small) & present).select("column", "value")
    labels = {c: [] for c in columns if c not in tables}
    for row in listed.collect():  # at most MOST_LABELS per feature
        labels[row["column"]].append(row["value"])
    labels = {c: sorted(v, key=lambda t: t.encode()) or [modes[c]] for c, v in labels.items()}
    return modes, labels, tables


def _codes(values: DataFrame) -> DataFrame:
    """``(value, code)``: distinct values numbered from 0 in sorted order."""
    return with_position(values, ["value"], "code")


def label_encode(df: DataFrame, column: str, output: str | None = None) -> DataFrame:
    """Codes 0..k-1 in sorted order of the values; a missing value has no code.

    The codes are a table of the distinct values, joined back: broadcast when they
    are counted few, and at any size never collected.
    """
    output = output or f"{column}_encoded"
    text = F.col(column).cast("string")
    values = df.select(text.alias("value")).filter(F.col("value").isNotNull()).distinct()
    codes = _codes(values).select(F.col("value").alias("__value"), F.col("code").alias(output))
    codes = sent_if_small(codes.persist(), codes.count())
    return df.drop(output).join(codes, text == F.col("__value"), "left").drop("__value")


def scale(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Z-scores with the population deviation; a constant column becomes 0."""
    row = df.agg(
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns)],
    ).first()
    return df.withColumns(
        {
            c: (F.col(c) - (row[f"m{i}"] or 0.0)) / (row[f"s{i}"] or 1.0)
            for i, c in enumerate(columns)
        }
    )


@dataclass
class Workbench:
    """Prepared train and test rows and the models fitted on them."""

    steps: FeatureSteps
    train: DataFrame
    test: DataFrame
    models: dict[str, Model] = field(default_factory=dict)
    blocks: dict[int, ensembles.Binned] = field(default_factory=dict)

    # --- fitting ---

    def train_linear_regression(self) -> DataFrame:
        estimator = LinearRegression(
            featuresCol=FEATURES, labelCol=LABEL, solver="normal", regParam=0.0
        )
        return self._fit("Linear Regression", estimator)

    def train_random_forest(
        self, n_estimators: int = 100, max_depth: int | None = None, seed: int = 42
    ) -> DataFrame:
        if max_depth is not None and max_depth > DEEPEST:
            raise ValueError(f"max_depth goes up to {DEEPEST}")
        depth = max_depth or DEEPEST
        data = self._binned(seed)
        made = ensembles.fit_forest(data, n_estimators, depth, seed)
        model = ensembles.TreesModel(data.cuts, made, [1.0] * len(made), FEATURES, True, depth)
        return self._keep("Random Forest", model)

    def train_boosted_trees(
        self,
        n_estimators: int = 100,
        max_depth: int = 6,
        learning_rate: float = 0.1,
        seed: int = 42,
    ) -> DataFrame:
        data = self._binned(seed)
        made = ensembles.fit_boosted(data, n_estimators, max_depth, learning_rate)
        weights, found = [w for w, _ in made], [t for _, t in made]
        model = ensembles.TreesModel(data.cuts, found, weights, FEATURES, False, max_depth)
        return self._keep("Boosted Trees", model)

    def _fit(self, name: str, estimator) -> DataFrame:
        return self._keep(name, estimator.fit(_gathered(self.train)[0]))

    def _binned(self, seed: int) -> ensembles.Binned:
        """The training rows in blocks, made once for all tree models of a seed."""
        if seed not in self.blocks:
            rows, total, tasks = _gathered(self.train)
            self.blocks[seed] = ensembles.binned(rows, FEATURES, LABEL, total, tasks, seed)
        return self.blocks[seed]

    def _keep(self, name: str, model: Model) -> DataFrame:
        self.models[name] = model
        return self.evaluate(self.train, [name])

    # --- using the models ---

    def _model(self, name: str) -> Model:
        if name not in self.models:
            raise ValueError(f"Model '{name}' not trained")
        return self.models[name]

    def evaluate(
        self, rows: DataFrame | None = None, names: Sequence[str] | None = None
    ) -> DataFrame:
        """``(model, rmse, r2, mae)`` on the test rows, best first.

        All models predict in one pass over the rows, followed by one aggregation.
        """
        if not self.models:
            raise ValueError("No models trained. Train models first.")
        rows = self.test if rows is None else rows
        names = list(names or self.models)
        for i, name in enumerate(names):
            rows = _predict(rows, self._model(name), f"__p{i}")
        measured = rows.agg(
            *[metrics(F.col(LABEL), F.col(f"__p{i}")).alias(f"__m{i}") for i in range(len(names))]
        )
        table = F.array(
            *[
                F.struct(F.lit(n).alias("model"), F.col(f"__m{i}").alias("m"))
                for i, n in enumerate(names)
            ]
        )
        return (
            measured.select(F.inline(table))
            .select("model", "m.rmse", "m.r2", "m.mae")
            .orderBy(F.desc_nulls_last("r2"), "model")
        )

    def best_model(self) -> DataFrame:
        return self.evaluate().orderBy(F.desc_nulls_last("r2"), "model").limit(1)

    def feature_importance(self, name: str = "Random Forest", top_n: int = 10) -> DataFrame:
        model = self._model(name)
        if not hasattr(model, "featureImportances"):
            raise ValueError(f"Model '{name}' doesn't support feature importance")
        weights = model.featureImportances.toArray()
        rows = [(n, float(w)) for n, w in zip(self.steps.names, weights)]
        table = self.train.sparkSession.createDataFrame(rows, "feature string, importance double")
        return table.orderBy(F.desc("importance"), "feature").limit(top_n)

    def predict(self, rows: DataFrame, name: str | None = None) -> DataFrame:
        """Raw policy rows with a ``prediction`` by the named or the best model."""
        if name is None:
            name = self.best_model().first()["model"]
        model = self._model(name)
        keep = rows.columns
        return _predict(self.steps.transform(rows, keep), model, "prediction").drop(FEATURES)

    def summary(self) -> DataFrame:
        """One row: samples, features, train and test sizes."""
        train = self.train.agg(F.count(F.lit(1)).alias("train_size"))
        test = self.test.agg(F.count(F.lit(1))).scalar()
        return train.select(
            (F.col("train_size") + test).alias("n_samples"),
            F.lit(len(self.steps.names)).cast("long").alias("n_features"),
            "train_size",
            test.alias("test_size"),
            F.array(*[F.lit(n) for n in self.steps.names]).alias("feature_names"),
        )


def _gathered(rows: DataFrame) -> tuple[DataFrame, int, int]:
    """Rows in no more partitions than tasks that run at once, or than their number asks for; that number, the partitions.

    A fit makes hundreds of passes, and in each one every partition sends statistics of all nodes at
    work, whatever its number of rows.
    """
    at_once, total = rows.sparkSession.sparkContext.defaultParallelism, rows.count()
    parts = max(at_once, -(-total // ROWS_A_TASK))
    return rows.coalesce(parts), total, parts


def _predict(rows: DataFrame, model: Model, output: str) -> DataFrame:
    return model.copy({model.predictionCol: output}).transform(rows)


def prepare(
    df: DataFrame,
    target: str = "TotalClaims",
    categorical: Sequence[str] | None = None,
    numerical: Sequence[str] | None = None,
    with_age: bool = True,
    test_size: float = 0.2,
    seed: int = 42,
    fit_on: str = "all",
) -> Workbench:
    """Impute, encode, scale and split.

    ``fit_on="all"`` takes fill values, codes and scales from all rows, ``"train"``
    from the training rows only.  Every fit reads the training rows once or twice: cache ``df`` if it is
    made by joins, not what is made of it.
    """
    if fit_on not in ("all", "train"):
        raise ValueError("fit_on must be 'all' or 'train'")
    if df.isEmpty():
        raise ValueError("Data is empty")
    train, test = split(df, test_size, seed)
    steps = fit_features(df if fit_on == "all" else train, target, categorical, numerical, with_age)

    def ready(rows: DataFrame) -> DataFrame:
        labelled = rows.filter(F.col(target).isNotNull()).withColumn(
            LABEL, F.col(target).cast("double")
        )
        return steps.transform(labelled, [LABEL])

    return Workbench(steps, ready(train), ready(test))


def metrics(label: Column, prediction: Column) -> Column:
    """Struct (rmse, r2, mae) as one aggregate expression."""
    error = label - prediction
    squares = F.sum(error * error)
    total = F.var_pop(label) * F.count(label)
    r2 = F.when(total > 0, 1 - F.try_divide(squares, total)).otherwise(
        F.when(squares == 0, 1.0).otherwise(0.0)
    )
    return F.struct(
        F.sqrt(F.avg(error * error)).alias("rmse"), r2.alias("r2"), F.avg(F.abs(error)).alias("mae")
    )


def regression_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    pairs = df.select(F.col(label).alias("y"), F.col(prediction).alias("p")).dropna()
    return pairs.agg(metrics(F.col("y"), F.col("p")).alias("m")).select("m.*")
