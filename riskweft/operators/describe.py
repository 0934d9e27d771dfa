"""Descriptive statistics of single columns."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from riskweft.functions.shapiro import shapiro_wilk
from riskweft.functions.tables import nan_to_null, percent
from riskweft.operators.missing import modal_value
from riskweft.operators.profile import categorical_summary, value_counts_by_column
from riskweft.operators.quantiles import quantile_values, quantiles
from riskweft.operators.sampling import sample_rows
from riskweft.roles import categorical_columns, numeric_columns, require_columns, require_numeric

# Percentages of the ladder: fixed values.
LADDER = (1, 5, 10, 25, 50, 75, 90, 95, 99)
SHAPIRO_ROWS = 5000


def _moment_sums(column: str, shift: float | None, i: int) -> list[Column]:
    """Plain sums of powers of x - shift, from which all moments follow.

    They compile to one tight loop for many columns, where a moment aggregate per
    statistic does not.  With the median as shift the mean is at most one standard
    deviation away, so nothing cancels.
    """
    x = F.col(column).cast("double")
    d = x - F.lit(float(shift or 0.0))
    return [
        F.count(x).alias(f"__n{i}"),
        F.min(x).alias(f"__min{i}"),
        F.max(x).alias(f"__max{i}"),
        F.sum(d).alias(f"__s1_{i}"),
        F.sum(d * d).alias(f"__s2_{i}"),
        F.sum(d * d * d).alias(f"__s3_{i}"),
        F.sum(d * d * d * d).alias(f"__s4_{i}"),
    ]


def _shape(n: int, low, high, s1, s2, s3, s4) -> dict[str, float | None]:
    """Moments about the mean and bias-corrected shape from the sums of one column."""
    out = dict.fromkeys(("offset", "std", "variance", "skewness", "kurtosis"))
    if n == 0:
        return out
    e1, e2, e3, e4 = s1 / n, s2 / n, s3 / n, s4 / n
    constant = low == high
    m2 = 0.0 if constant else e2 - e1**2
    out["offset"] = e1
    if n > 1:
        out["variance"] = m2 * n / (n - 1)
        out["std"] = math.sqrt(out["variance"])
    if n > 2:
        m3 = e3 - 3 * e1 * e2 + 2 * e1**3
        g1 = 0.0 if constant else m3 / m2**1.5
        out["skewness"] = g1 * math.sqrt(n * (n - 1)) / (n - 2)
    if n > 3:
        m4 = e4 - 4 * e1 * e3 + 6 * e1**2 * e2 - 3 * e1**4
        corrected = 0.0 if constant else (n + 1) * (m4 / m2**2 - 3) + 6
        out["kurtosis"] = corrected * (n - 1) / ((n - 2) * (n - 3))
    return out


_NUMERIC_SCHEMA = (
    "column string, count bigint, mean double, std double, min double, p25 double, p50 double, "
    "p75 double, max double, median double, range double, variance double, skewness double, "
    "kurtosis double, missing bigint, missing_pct double"
)


def describe_numeric(
    df: DataFrame, columns: Sequence[str] | None = None, accuracy: int | None = None
) -> DataFrame:
    """One row per numeric column: moments, quartiles, shape and missing share.

    The table is reduced to one row of sums; only that row reaches the driver.
    """
    df = nan_to_null(df)
    if columns:
        require_columns(df, columns)
    names = [c for c in numeric_columns(df) if not columns or c in columns]
    if not names:
        raise ValueError("No numeric columns to describe")
    levels = quantile_values(df, {c: [0.25, 0.5, 0.75] for c in names}, accuracy)
    aggregates = [F.count(F.lit(1)).alias("__rows")]
    for i, c in enumerate(names):
        aggregates += _moment_sums(c, levels[c, 0.5], i)
    row = df.agg(*aggregates).first()
    total, rows = row["__rows"], []
    for i, c in enumerate(names):
        n, low, high = (row[f"__{k}{i}"] for k in ("n", "min", "max"))
        m = _shape(n, low, high, *[row[f"__s{k}_{i}"] for k in (1, 2, 3, 4)])
        q1, q2, q3 = (levels[c, p] for p in (0.25, 0.5, 0.75))
        mean = None if n == 0 else q2 + m["offset"]
        spread = None if n == 0 else high - low
        share = 100.0 * (total - n) / total if total else None
        rows.append(
            (c, n, mean, m["std"], low, q1, q2, q3, high, q2, spread, m["variance"],
             m["skewness"], m["kurtosis"], total - n, share)
        )
    return df.sparkSession.createDataFrame(rows, _NUMERIC_SCHEMA)


def describe_categorical(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per text column: count, distinct values, the top value and its share."""
    df = nan_to_null(df)
    if columns:
        require_columns(df, columns)
    names = [c for c in categorical_columns(df) if not columns or c in columns]
    if not names:
        raise ValueError("No categorical columns to describe")
    counts = value_counts_by_column(df, names)
    present = F.col("value").isNotNull()
    best = F.min(F.when(present, F.struct((-F.col("n")).alias("n"), F.col("value"))))
    table = counts.groupBy("column").agg(
        F.coalesce(F.sum(F.when(present, F.col("n"))), F.lit(0)).alias("count"),
        F.count("value").alias("unique"),
        best.alias("__best"),
        F.coalesce(F.sum(F.when(~present, F.col("n"))), F.lit(0)).alias("missing"),
        F.sum("n").alias("__rows"),
    )
    return table.select(
        "column",
        "count",
        "unique",
        F.col("__best.value").alias("top"),
        F.coalesce(-F.col("__best.n"), F.lit(0)).alias("freq"),
        percent(-F.col("__best.n"), F.col("count")).alias("top_pct"),
        "missing",
        percent(F.col("missing"), F.col("__rows")).alias("missing_pct"),
    )


def univariate_numeric(df: DataFrame, column: str, accuracy: int | None = None) -> DataFrame:
    """``describe_numeric`` of one column plus its smallest mode."""
    df = nan_to_null(df)
    require_numeric(df, [column])
    mode = modal_value(df, column).select(F.col("value").cast("double"))
    return describe_numeric(df, [column], accuracy).withColumn("mode", mode.scalar())


def percentile_ladder(df: DataFrame, column: str, accuracy: int | None = None) -> DataFrame:
    """``(percentile, value)`` at 1, 5, 10, 25, 50, 75, 90, 95 and 99 percent."""
    df = nan_to_null(df)
    require_numeric(df, [column])
    out = quantiles(df, column, [p / 100 for p in LADDER], accuracy)
    return out.select(
        F.round(F.col("probability") * 100).cast("int").alias("percentile"), "value"
    )


def univariate_categorical(df: DataFrame, column: str) -> DataFrame:
    """Summary of one column taken as categories, whatever its type."""
    df = nan_to_null(df)
    require_columns(df, [column])
    return describe_categorical(df.select(F.col(column).cast("string")), [column])


def value_counts(df: DataFrame, column: str, top_n: int | None = None) -> DataFrame:
    """``(value, count, percentage)`` over non-null rows, most frequent first."""
    df = nan_to_null(df)
    require_columns(df, [column])
    counts = (
        df.select(F.col(column).alias("value"))
        .dropna()
        .groupBy("value")
        .agg(F.count(F.lit(1)).alias("count"))
    )
    # The total is a separate one-column count rather than a window over all groups.
    total = df.agg(F.count(column)).scalar()
    out = counts.withColumn("percentage", percent(F.col("count"), total)).orderBy(
        F.desc("count"), F.asc("value")
    )
    return out.limit(top_n) if top_n else out


def jarque_bera(df: DataFrame, column: str) -> DataFrame:
    """Normality test over all rows: statistic, closed-form p-value, verdict."""
    df = nan_to_null(df)
    require_numeric(df, [column])
    x = F.col(column).cast("double")
    constant = F.min(x) == F.max(x)
    moments = df.agg(
        F.count(x).alias("n"),
        F.when(constant, F.lit(0.0)).otherwise(F.skewness(x)).alias("g1"),
        F.when(constant, F.lit(-3.0)).otherwise(F.kurtosis(x)).alias("g2"),
    )
    statistic = F.col("n") / 6 * (F.pow("g1", F.lit(2)) + F.pow("g2", F.lit(2)) / 4)
    out = moments.select("n", statistic.alias("statistic"))
    return out.select(
        F.lit("Jarque-Bera").alias("test"),
        "n",
        "statistic",
        F.exp(-F.col("statistic") / 2).alias("p_value"),
        (F.exp(-F.col("statistic") / 2) > 0.05).alias("is_normal"),
    )


@F.pandas_udf(T.StructType([T.StructField("w", T.DoubleType()), T.StructField("p", T.DoubleType())]))
def _shapiro(samples: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([shapiro_wilk(s) for s in samples], columns=["w", "p"], dtype="float64")


def shapiro_test(df: DataFrame, column: str, seed: int = 42) -> DataFrame:
    """Shapiro-Wilk on all values, or on a sample of 5000 when there are more."""
    df = nan_to_null(df)
    require_numeric(df, [column])
    values = df.select(F.col(column).cast("double").alias("x")).dropna()
    # Never more than SHAPIRO_ROWS values reach the array.
    sample = sample_rows(values, SHAPIRO_ROWS, seed).agg(F.collect_list("x").alias("xs"))
    out = sample.select(F.size("xs").cast("long").alias("n"), _shapiro("xs").alias("r"))
    return out.select(
        F.when(F.col("n") >= SHAPIRO_ROWS, "Shapiro-Wilk (on 5000 sample)")
        .otherwise("Shapiro-Wilk")
        .alias("test"),
        "n",
        F.col("r.w").alias("statistic"),
        F.col("r.p").alias("p_value"),
        (F.col("r.p") > 0.05).alias("is_normal"),
    )


def summarise_categories(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    df = nan_to_null(df)
    return categorical_summary(df, columns)
