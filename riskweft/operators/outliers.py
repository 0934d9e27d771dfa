"""Outlier bounds, detection and treatment."""

from __future__ import annotations

import logging
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from riskweft.functions.tables import nan_to_null, percent, stack_rows
from riskweft.operators.quantiles import quantile_values
from riskweft.roles import is_numeric, numeric_columns, pick_numeric

log = logging.getLogger(__name__)

METHODS = ("iqr", "zscore", "modified_zscore", "percentile")
ACTIONS = ("cap", "remove", "log_transform")
# Scales the median absolute deviation to a standard deviation: fixed value.
MAD_SCALE = 0.6745


@dataclass(frozen=True)
class Bounds:
    """Limits of one column as plain numbers; ``None`` when nothing can be outside."""

    column: str
    lower: float | None
    upper: float | None
    details: dict = field(default_factory=dict)

    def outside(self) -> Column:
        """True for outliers, false otherwise, never null."""
        if self.lower is None or self.upper is None:
            return F.lit(False)
        x = F.col(self.column)
        return F.coalesce((x < self.lower) | (x > self.upper), F.lit(False))


def find_bounds(
    df: DataFrame,
    columns: Sequence[str],
    method: str = "iqr",
    threshold: float = 1.5,
    population: bool = False,
    accuracy: int | None = None,
) -> list[Bounds]:
    """Limits per column, from one summary row for all columns together.

    ``threshold`` multiplies the IQR, or counts (modified) standard deviations.
    ``population`` selects the divisor n instead of n - 1 for z-scores.
    """
    df = nan_to_null(df)
    if method not in METHODS:
        raise ValueError(f"Method must be one of {METHODS}")
    columns = list(columns)
    if not columns:
        return []
    if method == "zscore":
        spread = F.stddev_pop if population else F.stddev_samp
        row = df.agg(
            *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)],
            *[spread(c).alias(f"s{i}") for i, c in enumerate(columns)],
        ).first()
        out = []
        for i, c in enumerate(columns):
            mean, std = row[f"m{i}"], row[f"s{i}"]
            if not std:
                out.append(Bounds(c, None, None))
            else:
                out.append(Bounds(c, mean - threshold * std, mean + threshold * std))
        return out
    if method == "modified_zscore":
        return _modified(df, columns, threshold, accuracy)

    probabilities = (0.25, 0.75) if method == "iqr" else (0.01, 0.99)
    row = _levels(df, columns, probabilities, accuracy)
    out = []
    for c in columns:
        low, high = (row[c, p] for p in probabilities)
        if low is None:
            out.append(Bounds(c, None, None))
        elif method == "percentile":
            out.append(Bounds(c, low, high))
        else:
            iqr = high - low
            out.append(
                Bounds(
                    c,
                    low - threshold * iqr,
                    high + threshold * iqr,
                    {"q1": low, "q3": high, "iqr": iqr},
                )
            )
    return out


def _levels(df, columns, probabilities, accuracy) -> dict[tuple[str, float], float | None]:
    return quantile_values(df, {c: probabilities for c in columns}, accuracy)


def _modified(df, columns, threshold, accuracy) -> list[Bounds]:
    medians = _levels(df, columns, (0.5,), accuracy)
    known = [c for c in columns if medians[c, 0.5] is not None]
    distance = df.select(
        *[F.abs(F.col(c) - F.lit(float(medians[c, 0.5]))).alias(c) for c in known]
    )
    mads = _levels(distance, known, (0.5,), accuracy) if known else {}
    out = []
    for c in columns:
        mad = mads.get((c, 0.5))
        if not mad:
            out.append(Bounds(c, None, None))
            continue
        reach = threshold * mad / MAD_SCALE
        out.append(Bounds(c, medians[c, 0.5] - reach, medians[c, 0.5] + reach))
    return out


def treat_outliers(
    df: DataFrame,
    method: str = "iqr",
    action: str = "cap",
    columns: Sequence[str] | None = None,
    threshold: float = 1.5,
    z_threshold: float = 3.0,
    accuracy: int | None = None,
) -> DataFrame:
    """Cap, remove or log-transform outliers; nulls are neither changed nor dropped.

    ``remove`` works column by column: each next column's limits come from the rows
    still left.  Capped and transformed columns become doubles.
    """
    df = nan_to_null(df)
    if method not in METHODS:
        raise ValueError(f"Invalid method: {method}")
    if action not in ACTIONS:
        raise ValueError(f"Invalid action: {action}")
    names = []
    for c in columns or numeric_columns(df):
        if is_numeric(df, c):
            names.append(c)
        else:
            log.warning("Column %s is absent or not numeric, skipping", c)
    limit = z_threshold if "zscore" in method else threshold

    if action == "remove":
        for c in names:
            (bounds,) = find_bounds(df, [c], method, limit, accuracy=accuracy)
            df = df.filter(~bounds.outside())
        return df

    found = find_bounds(df, names, method, limit, accuracy=accuracy)
    if action == "cap":
        return df.withColumns({b.column: _capped(b) for b in found if b.lower is not None})
    return _log_transformed(df, found)


def _capped(bounds: Bounds) -> Column:
    x = F.col(bounds.column)
    return (
        F.when(x < bounds.lower, F.lit(float(bounds.lower)))
        .when(x > bounds.upper, F.lit(float(bounds.upper)))
        .otherwise(x.cast("double"))
    )


def _log_transformed(df: DataFrame, found: Sequence[Bounds]) -> DataFrame:
    if not found:
        return df
    row = df.agg(
        *[F.count_if(b.outside()).alias(f"n{i}") for i, b in enumerate(found)],
        *[F.min(F.col(b.column).cast("double")).alias(f"min{i}") for i, b in enumerate(found)],
    ).first()
    changed = {}
    for i, b in enumerate(found):
        if not row[f"n{i}"]:
            continue
        x, smallest = F.col(b.column).cast("double"), row[f"min{i}"]
        changed[b.column] = F.ln(x - smallest + 1 if smallest <= 0 else x)
    return df.withColumns(changed) if changed else df


def detect_outliers(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    method: str = "iqr",
    threshold: float = 1.5,
    keys: Sequence[str] = (),
    accuracy: int | None = None,
) -> DataFrame:
    """Outlier values in long form with their column's count and percentage.

    ``keys`` names columns to carry along, which identify the rows.  Columns without
    outliers do not appear.
    """
    df = nan_to_null(df)
    if method not in ("iqr", "zscore", "modified_zscore"):
        raise ValueError("Method must be one of ('iqr', 'zscore', 'modified_zscore')")
    names = pick_numeric(df, columns)
    found = find_bounds(df, names, method, threshold, population=True, accuracy=accuracy)
    found = [b for b in found if b.lower is not None]
    empty = F.array().cast("array<struct<column:string,value:double,count:bigint,percentage:double>>")
    if not found:
        return df.select(*keys, F.inline(empty))
    row = df.agg(
        *[F.count_if(b.outside()).alias(f"n{i}") for i, b in enumerate(found)],
        *[F.count(b.column).alias(f"all{i}") for i, b in enumerate(found)],
    ).first()
    hits = [
        F.when(
            b.outside(),
            F.struct(
                F.lit(b.column).alias("column"),
                F.col(b.column).cast("double").alias("value"),
                F.lit(row[f"n{i}"]).cast("long").alias("count"),
                F.lit(row[f"n{i}"] / row[f"all{i}"] * 100).alias("percentage"),
            ),
        )
        for i, b in enumerate(found)
        if row[f"n{i}"]
    ]
    if not hits:
        return df.select(*keys, F.inline(empty))
    anywhere = None
    for i, b in enumerate(found):
        if row[f"n{i}"]:
            anywhere = b.outside() if anywhere is None else anywhere | b.outside()
    return df.filter(anywhere).select(*keys, F.inline(F.array_compact(F.array(*hits))))


def outlier_report(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    multiplier: float = 1.5,
    accuracy: int | None = None,
) -> DataFrame:
    """Per numeric column: IQR limits, outlier count and share, extreme outliers."""
    df = nan_to_null(df)
    names = [c for c in (columns or numeric_columns(df)) if is_numeric(df, c)]
    found = [
        b
        for b in find_bounds(df, names, "iqr", multiplier, accuracy=accuracy)
        if b.lower is not None
    ]
    aggregates, rows = [], []
    for i, b in enumerate(found):
        x = F.col(b.column).cast("double")
        aggregates += [
            F.count_if(b.outside()).alias(f"n{i}"),
            F.count(x).alias(f"all{i}"),
            F.min(F.when(b.outside(), x)).alias(f"min{i}"),
            F.max(F.when(b.outside(), x)).alias(f"max{i}"),
        ]
        rows.append(
            {
                "column": F.lit(b.column),
                "outlier_count": F.col(f"n{i}"),
                "outlier_percentage": F.round(percent(F.col(f"n{i}"), F.col(f"all{i}")), 2),
                "lower_bound": F.lit(float(b.lower)),
                "upper_bound": F.lit(float(b.upper)),
                "Q1": F.lit(float(b.details["q1"])),
                "Q3": F.lit(float(b.details["q3"])),
                "IQR": F.lit(float(b.details["iqr"])),
                "min_outlier": F.col(f"min{i}"),
                "max_outlier": F.col(f"max{i}"),
            }
        )
    if not found:
        schema = (
            "column string, outlier_count bigint, outlier_percentage double, lower_bound double, "
            "upper_bound double, Q1 double, Q3 double, IQR double, min_outlier double, "
            "max_outlier double"
        )
        return df.sparkSession.createDataFrame([], schema)
    return stack_rows(df.agg(*aggregates), rows)


def compare_methods(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Outlier counts per column for IQR 1.5, z-score 3 and modified z-score 3.5."""
    df = nan_to_null(df)
    names = pick_numeric(df, columns)
    methods = (("iqr", 1.5), ("zscore", 3.0), ("modified_zscore", 3.5))
    aggregates = []
    for label, limit in methods:
        for i, b in enumerate(find_bounds(df, names, label, limit, population=True)):
            aggregates.append(F.count_if(b.outside()).alias(f"{label}{i}"))
    rows = [
        {"column": F.lit(c), **{label: F.col(f"{label}{i}") for label, _ in methods}}
        for i, c in enumerate(names)
    ]
    table = stack_rows(df.agg(*aggregates), rows)
    return table.filter((F.col("iqr") > 0) | (F.col("zscore") > 0) | (F.col("modified_zscore") > 0))


def beyond_deviations(df: DataFrame, column: str, deviations: float = 3.0) -> DataFrame:
    """Rows whose value lies more than so many sample standard deviations from the mean."""
    df = nan_to_null(df)
    (bounds,) = find_bounds(df, pick_numeric(df, [column]), "zscore", deviations)
    return df.filter(bounds.outside())
