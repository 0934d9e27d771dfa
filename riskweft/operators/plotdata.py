"""The aggregates behind charts: histograms, densities, boxes, series, dashboards."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from riskweft.functions.tables import nan_to_null, sent_if_small
from riskweft.operators.describe import value_counts
from riskweft.operators.matrix import correlation_matrix
from riskweft.operators.metrics import CLAIMS, PREMIUM, kpis, loss_ratio_by, monthly_trend
from riskweft.operators.quantiles import plan_quantiles, quantile_values
from riskweft.operators.sampling import sample_rows
from riskweft.roles import is_numeric, require_columns, require_numeric

WHISKER = 1.5
AGGREGATIONS = ("sum", "mean", "count", "median", "min", "max")
FREQUENCIES = ("D", "W", "ME", "Q", "Y")


# --- distributions ---------------------------------------------------------------------


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """``(bin, lower, upper, n)``: equal widths over [min, max], the last bin closed."""
    df = nan_to_null(df)
    require_numeric(df, [column])
    x = F.col(column).cast("double")
    low, high = df.agg(F.min(x), F.max(x)).first()
    spark = df.sparkSession
    if low is None:
        return spark.createDataFrame([], "bin int, lower double, upper double, n bigint")
    if low == high:
        low, high = low - 0.5, high + 0.5  # a constant column still gets a visible range
    width = (high - low) / bins
    slot = F.least(F.floor((x - low) / width), F.lit(bins - 1)).cast("int")
    counts = (
        df.filter(x.isNotNull()).groupBy(slot.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    )
    spine = spark.range(bins).select(
        F.col("id").cast("int").alias("bin"),
        (F.lit(low) + F.col("id") * width).alias("lower"),
        (F.lit(low) + (F.col("id") + 1) * width).alias("upper"),
    )
    return spine.join(counts, "bin", "left").fillna(0, ["n"])


def centre_lines(df: DataFrame, column: str, accuracy: int | None = None) -> DataFrame:
    """One row: the mean and the median, the two marks on a histogram."""
    df = nan_to_null(df)
    require_numeric(df, [column])
    median = quantile_values(df, {column: [0.5]}, accuracy)[column, 0.5]
    return df.agg(
        F.avg(F.col(column).cast("double")).alias("mean"),
        F.lit(median).cast("double").alias("median"),
    )


def density(df: DataFrame, column: str, bins: int = 30, points: int = 200) -> DataFrame:
    """Gaussian kernel density on a grid over [min, max], scaled to the histogram.

    Bandwidth by Scott's rule.  Each task adds up its own values at all grid points,
    so only ``points`` rows per task are shuffled.
    """
    df = nan_to_null(df)
    require_numeric(df, [column])
    x = F.col(column).cast("double")
    n, low, high, std = df.agg(F.count(x), F.min(x), F.max(x), F.stddev_samp(x)).first()
    spark = df.sparkSession
    if not std:
        return spark.createDataFrame([], "point int, x double, density double")
    bandwidth = n ** (-1 / 5) * std
    grid = np.linspace(low, high, points)
    values = df.select(x.alias("x")).filter(F.col("x").isNotNull())

    def add_up(batches):
        total = np.zeros(points)
        for batch in batches:
            values, weights = np.unique(batch["x"].to_numpy(), return_counts=True)
            for start in range(0, len(values), 4096):
                z = (grid[:, None] - values[None, start : start + 4096]) / bandwidth
                total += np.exp(-0.5 * z * z) @ weights[start : start + 4096]
        yield pd.DataFrame({"point": np.arange(points, dtype="int32"), "kernel": total})

    scale = (high - low) / bins / (bandwidth * float(np.sqrt(2 * np.pi)))
    step = (high - low) / (points - 1)
    return (
        values.mapInPandas(add_up, "point int, kernel double")
        .groupBy("point")
        .agg((F.sum("kernel") * scale).alias("density"))
        .select("point", (F.lit(low) + F.col("point") * step).alias("x"), "density")
    )


def category_bars(df: DataFrame, column: str, top_n: int | None = None) -> DataFrame:
    """``(value, count)``, most frequent first."""
    df = nan_to_null(df)
    return value_counts(df, column, top_n).select("value", "count")


# --- points ----------------------------------------------------------------------------


def scatter(
    df: DataFrame,
    x: str,
    y: str,
    extra: Sequence[str] = (),
    sample: int | None = None,
    seed: int = 42,
) -> DataFrame:
    """Points of two numeric columns with colour, size or hover columns alongside."""
    df = nan_to_null(df)
    require_numeric(df, [x, y])
    require_columns(df, extra)
    names = list(dict.fromkeys([x, y, *extra]))
    points = df.select(*names)
    return points if sample is None else sample_rows(points, sample, seed)


def interactive_scatter(
    df: DataFrame,
    x: str,
    y: str,
    color: str | None = None,
    size: str | None = None,
    hover: Sequence[str] = (),
    sample: int | None = None,
    seed: int = 42,
) -> DataFrame:
    """Like ``scatter``, with x and y of any type."""
    df = nan_to_null(df)
    names = list(dict.fromkeys([x, y, *[c for c in (color, size) if c], *hover]))
    require_columns(df, names)
    points = df.select(*names)
    return points if sample is None else sample_rows(points, sample, seed)


def regression_line(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: least-squares slope and intercept; null for a constant x."""
    df = nan_to_null(df)
    require_numeric(df, [x, y])
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    return df.agg(
        F.regr_slope(b, a).alias("slope"),
        F.regr_intercept(b, a).alias("intercept"),
        F.regr_count(b, a).alias("n"),
    )


# --- boxes -----------------------------------------------------------------------------


def boxplot(
    df: DataFrame, column: str, by: str | None = None, accuracy: int | None = None
) -> DataFrame:
    """Quartiles, whiskers (extreme values within 1.5 IQR) and outlier counts per group."""
    df = nan_to_null(df)
    require_numeric(df, [column])
    x = F.col(column).cast("double").alias("x")
    if not by:
        return _single_box(df.select(x).dropna(), accuracy)
    require_columns(df, [by])
    rows = df.select(F.col(by).alias("group"), x).dropna()
    plan = plan_quantiles(rows, {"x": [0.25, 0.5, 0.75]}, by=["group"], accuracy=accuracy)
    boxes = plan.rows.groupBy(F.col("group").alias("__group")).agg(
        F.count("x").alias("n"),
        plan["x", 0.25].alias("q1"),
        plan["x", 0.5].alias("median"),
        plan["x", 0.75].alias("q3"),
    )
    boxes = boxes.persist()
    # One row per group, counted before it is sent to the rows.
    marked = rows.join(sent_if_small(boxes, boxes.count()), F.col("group") == F.col("__group"))
    return marked.groupBy("group", "n", "q1", "median", "q3").agg(*_whiskers(F.col("q1"), F.col("q3")))


def _single_box(rows: DataFrame, accuracy: int | None) -> DataFrame:
    """The box of all rows: exact quartiles first, then one aggregate; no row for an empty table."""
    found = quantile_values(rows, {"x": [0.25, 0.5, 0.75]}, accuracy)
    q1, median, q3 = [F.lit(found["x", p]).cast("double") for p in (0.25, 0.5, 0.75)]
    box = rows.agg(F.count("x").alias("n"), *_whiskers(q1, q3)).filter("n > 0")
    return box.select(
        F.lit("all").alias("group"), "n", q1.alias("q1"), median.alias("median"), q3.alias("q3"),
        "whisker_low", "whisker_high", "outliers",
    )


def _whiskers(q1: Column, q3: Column) -> list[Column]:
    reach = WHISKER * (q3 - q1)
    inside = F.col("x").between(q1 - reach, q3 + reach)
    return [
        F.min(F.when(inside, F.col("x"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("x"))).alias("whisker_high"),
        F.count_if(~inside).alias("outliers"),
    ]


# --- time ------------------------------------------------------------------------------


def _period_end(day: Column, frequency: str) -> Column:
    """The last day of the period a date falls into; weeks end on Sunday."""
    if frequency == "D":
        return day
    if frequency == "W":
        return F.date_add(F.to_date(F.date_trunc("week", day)), 6)
    if frequency == "ME":
        return F.last_day(day)
    months = {"Q": 3, "Y": 12}[frequency]
    unit = "quarter" if frequency == "Q" else "year"
    return F.date_sub(F.to_date(F.add_months(F.to_date(F.date_trunc(unit, day)), months)), 1)


def resample(
    df: DataFrame,
    date: str,
    value: str,
    aggregation: str = "sum",
    frequency: str = "ME",
    accuracy: int | None = None,
) -> DataFrame:
    """``(period, value)`` with a row for every period between the first and the last.

    An empty period counts 0 for ``sum`` and ``count`` and is null otherwise.
    """
    df = nan_to_null(df)
    require_columns(df, [date, value])
    if aggregation not in AGGREGATIONS:
        raise ValueError(f"Aggregation must be one of {list(AGGREGATIONS)}")
    if frequency not in FREQUENCIES:
        raise ValueError(f"Frequency must be one of {list(FREQUENCIES)}")
    if aggregation != "count":
        require_numeric(df, [value])
    x = F.col(value) if aggregation == "count" else F.col(value).cast("double")
    rows = df.select(
        _period_end(F.to_date(F.col(date)), frequency).alias("period"), x.alias("x")
    ).dropna(subset=["period"])
    if aggregation == "median":
        plan = plan_quantiles(rows, {"x": [0.5]}, by=["period"], accuracy=accuracy)
        series = plan.rows.groupBy("period").agg(plan["x", 0.5].alias("value"))
    else:
        call = {
            "sum": lambda: F.coalesce(F.sum("x"), F.lit(0.0)),
            "mean": lambda: F.avg("x"),
            "count": lambda: F.count("x").cast("double"),
            "min": lambda: F.min("x"),
            "max": lambda: F.max("x"),
        }[aggregation]
        series = rows.groupBy("period").agg(call().alias("value"))
    # The spine comes from the two end dates alone.
    ends = rows.agg(F.min("period").alias("first"), F.max("period").alias("last"))
    days = F.explode(F.sequence(F.col("first"), F.col("last"), F.expr("interval 1 day")))
    spine = ends.filter(F.col("first").isNotNull()).select(days.alias("day"))
    spine = spine.select(_period_end(F.col("day"), frequency).alias("period")).distinct()
    out = spine.join(series, "period", "left")
    return out.fillna(0.0, ["value"]) if aggregation in ("sum", "count") else out


def trend_with_status(df: DataFrame, date: str = "TransactionMonth") -> DataFrame:
    """The monthly trend with each month marked profitable or not."""
    df = nan_to_null(df)
    return monthly_trend(df, date).withColumn("status", _status(F.col("loss_ratio")))


def _status(ratio: Column) -> Column:
    return F.when(ratio > 1, "unprofitable").when(ratio <= 1, "profitable")


# --- segments --------------------------------------------------------------------------


def loss_ratio_bars(
    df: DataFrame,
    group_by: str,
    claims: str = CLAIMS,
    premium: str = PREMIUM,
    top_n: int | None = None,
) -> DataFrame:
    """Worst loss ratios first, flagged where claims exceed premium."""
    df = nan_to_null(df)
    out = loss_ratio_by(df, [group_by], claims, premium).withColumn(
        "flag", F.when(F.col("loss_ratio") > 1, "loss").otherwise("profit")
    )
    out = out.select(F.col(group_by).alias("group"), "loss_ratio", "flag")
    return out.limit(top_n) if top_n else out


def kpi_bars(df: DataFrame, group: str, selected=None, top_k: int | None = None) -> DataFrame:
    """``(Group, panel, value)`` for frequency, severity and margin."""
    df = nan_to_null(df)
    table = kpis(df, group, selected, top_k)
    return table.unpivot("Group", ["ClaimFrequency", "ClaimSeverity", "Margin"], "panel", "value")


def dashboard(
    df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], bins: int = 30
) -> DataFrame:
    """``(panel, kind, key, value)``: histograms and top-10 counts of a few columns."""
    df = nan_to_null(df)
    if len(numeric) > 3 or len(categorical) > 3:
        raise ValueError("Maximum 3 numeric and 3 categorical columns allowed")
    require_columns(df, [*numeric, *categorical])
    parts = []
    for c in numeric:
        if not is_numeric(df, c):
            raise ValueError(f"Column '{c}' must be numeric")
        parts.append(
            histogram(df, c, bins).select(
                F.lit(c).alias("panel"),
                F.lit("histogram").alias("kind"),
                F.col("bin").cast("string").alias("key"),
                F.col("n").alias("value"),
            )
        )
    for c in categorical:
        parts.append(
            category_bars(df, c, 10).select(
                F.lit(c).alias("panel"),
                F.lit("bar").alias("kind"),
                F.col("value").cast("string").alias("key"),
                F.col("count").alias("value"),
            )
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def correlation_heatmap(
    df: DataFrame, columns: Sequence[str] | None = None, method: str = "pearson"
) -> DataFrame:
    """The matrix behind a heatmap, by any of the three methods."""
    df = nan_to_null(df)
    return correlation_matrix(df, columns, method)
