"""Portfolio metrics: loss ratios, claim frequency, severity and margin by segment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from riskweft.functions.tables import nan_to_null
from riskweft.operators.quantiles import quantile_values
from riskweft.roles import require_columns, require_numeric

CLAIMS = "TotalClaims"
PREMIUM = "TotalPremium"


def _total(column: str) -> Column:
    return F.coalesce(F.sum(F.col(column).cast("double")), F.lit(0.0))


def ratio(claims: str | Column, premium: str | Column) -> Column:
    """Claims over premium; null where the premium is zero."""
    return F.try_divide(claims, premium)


def has_claim(claims: str = CLAIMS) -> Column:
    return F.coalesce(F.col(claims) > 0, F.lit(False))


def present(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows without nulls in the columns, as conditions a scan can push down."""
    df = nan_to_null(df)
    for c in columns:
        df = df.filter(F.col(c).isNotNull())
    return df


def _grouped(df: DataFrame, by: Sequence[str]):
    require_columns(df, by)
    return present(df, by).groupBy(*by)


def loss_ratio(df: DataFrame, claims: str = CLAIMS, premium: str = PREMIUM) -> DataFrame:
    """One row: total claims, total premium and their ratio."""
    df = nan_to_null(df)
    require_numeric(df, [claims, premium])
    sums = df.agg(_total(claims).alias("total_claims"), _total(premium).alias("total_premium"))
    return sums.withColumn("loss_ratio", ratio("total_claims", "total_premium"))


def segment_totals(
    df: DataFrame, by: Sequence[str], claims: str = CLAIMS, premium: str = PREMIUM
) -> DataFrame:
    """Per segment: totals, ratio, row count and margin, in no particular order."""
    df = nan_to_null(df)
    require_numeric(df, [claims, premium])
    return (
        _grouped(df, by)
        .agg(
            _total(claims).alias("total_claims"),
            _total(premium).alias("total_premium"),
            F.count(F.lit(1)).alias("policy_count"),
        )
        .withColumn("loss_ratio", ratio("total_claims", "total_premium"))
        .withColumn("margin", F.col("total_premium") - F.col("total_claims"))
    )


def loss_ratio_by(
    df: DataFrame, by: Sequence[str], claims: str = CLAIMS, premium: str = PREMIUM
) -> DataFrame:
    """``segment_totals`` with the worst ratio first."""
    df = nan_to_null(df)
    return segment_totals(df, by, claims, premium).orderBy(
        F.desc_nulls_last("loss_ratio"), *by
    )


def kpis(
    df: DataFrame,
    group: str,
    selected: Sequence | None = None,
    top_k: int | None = None,
) -> DataFrame:
    """Policy count, claim frequency (percent), claim severity and margin per group.

    ``top_k`` keeps the groups with most rows.  It is applied to the aggregated
    groups, so choosing them costs no second look at the rows.
    """
    df = nan_to_null(df)
    require_columns(df, [group, PREMIUM, CLAIMS])
    rows = present(df.select(F.col(group).alias("Group"), PREMIUM, CLAIMS), ["Group"])
    if selected is not None:
        rows = rows.filter(F.col("Group").isin(list(selected)))
    claims, premium = F.col(CLAIMS), F.col(PREMIUM)
    out = rows.groupBy("Group").agg(
        F.count(F.lit(1)).alias("PolicyCount"),
        (F.count_if(claims > 0) / F.count(F.lit(1)) * 100).alias("ClaimFrequency"),
        F.coalesce(F.avg(F.when(claims > 0, claims)), F.lit(0.0)).alias("ClaimSeverity"),
        F.avg(premium - claims).alias("Margin"),
    )
    return largest_groups(out, top_k) if top_k is not None else out


def largest_groups(
    groups: DataFrame, k: int, count: str = "PolicyCount", key: str = "Group"
) -> DataFrame:
    return groups.orderBy(F.desc(count), F.asc(key)).limit(k)


def kpi_loss_ratio(kpi: DataFrame) -> DataFrame:
    """Expected claims over expected premium, from frequency, severity and margin."""
    expected = F.col("ClaimFrequency") / 100 * F.col("ClaimSeverity")
    return kpi.withColumn(
        "LossRatio", F.coalesce(F.try_divide(expected, F.col("Margin") + expected), F.lit(0.0))
    )


def coverage(df: DataFrame, group: str, k: int) -> DataFrame:
    """Rows inside the ``k`` largest groups, and their share of all rows."""
    df = nan_to_null(df)
    require_columns(df, [group])
    counts = df.groupBy(F.col(group).alias("Group")).agg(F.count(F.lit(1)).alias("PolicyCount"))
    counts = counts.persist()
    total = counts.agg(F.sum("PolicyCount").alias("total_rows"))
    top = largest_groups(counts.dropna(subset=["Group"]), k).agg(
        F.coalesce(F.sum("PolicyCount"), F.lit(0)).alias("covered_rows")
    )
    return total.select(
        "total_rows", top.select("covered_rows").scalar().alias("covered_rows")
    ).withColumn("covered_pct", F.try_divide(F.col("covered_rows") * 100.0, F.col("total_rows")))


def best_and_worst(kpi: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` groups with the lowest margin and the ``k`` with the highest."""
    worst = kpi.orderBy(F.asc("Margin"), F.asc("Group")).limit(k)
    best = kpi.orderBy(F.desc("Margin"), F.desc("Group")).limit(k)
    return worst.withColumn("side", F.lit("lowest margin")).unionByName(
        best.withColumn("side", F.lit("highest margin"))
    )


def margin_spread(kpi: DataFrame) -> DataFrame:
    return kpi.agg(
        (F.max("Margin") - F.min("Margin")).alias("margin_spread"),
        F.count_if(F.col("Margin") > 0).alias("profitable"),
        F.count_if(F.col("Margin") < 0).alias("unprofitable"),
        F.count(F.lit(1)).alias("groups"),
    )


def compare_two(df: DataFrame, group: str, first, second) -> DataFrame:
    """KPIs of two groups side by side, with first minus second."""
    df = nan_to_null(df)
    table = kpis(df, group, [first, second])
    sides = []
    for measure in ("PolicyCount", "ClaimFrequency", "ClaimSeverity", "Margin"):
        for side, value in (("first", first), ("second", second)):
            sides.append(
                F.max(F.when(F.col("Group") == value, F.col(measure).cast("double"))).alias(
                    f"{measure}_{side}"
                )
            )
    wide = table.agg(*sides)
    rows = [
        F.struct(
            F.lit(m).alias("measure"),
            F.col(f"{m}_first").alias("first"),
            F.col(f"{m}_second").alias("second"),
            (F.col(f"{m}_first") - F.col(f"{m}_second")).alias("difference"),
        )
        for m in ("PolicyCount", "ClaimFrequency", "ClaimSeverity", "Margin")
    ]
    return wide.select(F.inline(F.array(*rows)))


def monthly_trend(
    df: DataFrame, date: str = "TransactionMonth", claims: str = CLAIMS, premium: str = PREMIUM
) -> DataFrame:
    """Totals, row count and loss ratio per calendar month that occurs."""
    df = nan_to_null(df)
    require_columns(df, [date])
    rows = df.withColumn("month", F.to_date(F.date_trunc("month", F.col(date))))
    return segment_totals(rows, ["month"], claims, premium).select(
        "month", "total_claims", "total_premium", "policy_count", "loss_ratio"
    )


def trend_summary(trend: DataFrame) -> DataFrame:
    """Average ratio, profitable and unprofitable months, and whether it varies."""
    r = F.col("loss_ratio")
    return trend.agg(
        F.avg(r).alias("mean_loss_ratio"),
        F.count_if(r <= 1).alias("profitable_months"),
        F.count_if(r > 1).alias("unprofitable_months"),
        F.count(F.lit(1)).alias("months"),
        F.stddev_samp(r).alias("std_loss_ratio"),
        F.when(F.stddev_samp(r) > 0.1, "seasonal variation").otherwise("stability").alias("trend"),
    )


def risk_matrix(
    df: DataFrame, row: str = "Province", column: str = "VehicleType", top_k: int = 10
) -> DataFrame:
    """Loss ratio per (row, column) cell for the ``top_k`` most frequent columns."""
    # Counts per column value include rows whose other key is missing.
    df = nan_to_null(df)
    cells = (
        df.dropna(subset=[column])
        .groupBy(row, column)
        .agg(
            _total(CLAIMS).alias("total_claims"),
            _total(PREMIUM).alias("total_premium"),
            F.count(F.lit(1)).alias("policy_count"),
        )
        .persist()
    )
    top = (
        cells.groupBy(F.col(column).alias("__top"))
        .agg(F.sum("policy_count").alias("__n"))
        .orderBy(F.desc("__n"), F.asc("__top"))
        .limit(top_k)
    )
    return (
        cells.dropna(subset=[row])
        .join(top, F.col(column) == F.col("__top"), "left_semi")
        .withColumn("loss_ratio", ratio("total_claims", "total_premium"))
    )


def risk_matrix_wide(matrix: DataFrame, row: str = "Province", column: str = "VehicleType"):
    """The matrix with one column per vehicle type (at most ``top_k`` of them)."""
    names = [r[0] for r in matrix.select(column).distinct().orderBy(column).collect()]
    return matrix.groupBy(row).pivot(column, names).agg(F.first("loss_ratio"))


def target_stats(df: DataFrame, target: str = CLAIMS) -> DataFrame:
    """Mean, median, maximum of the target and the share of positive values."""
    df = nan_to_null(df)
    require_numeric(df, [target])
    median = quantile_values(df, {target: [0.5]})[target, 0.5]
    x = F.col(target)
    return df.agg(
        F.avg(x).alias("mean"),
        F.lit(median).cast("double").alias("median"),
        F.max(x).alias("max"),
        F.count_if(x > 0).alias("positive"),
        F.try_divide(F.count_if(x > 0) * 100.0, F.count(F.lit(1))).alias("positive_pct"),
    )


def row_ratio(df: DataFrame, claims: str = CLAIMS, premium: str = PREMIUM) -> DataFrame:
    """Claims over premium per row, a zero premium counting as one."""
    df = nan_to_null(df)
    return df.withColumn(
        "LossRatio",
        F.col(claims) / F.when(F.col(premium) == 0, F.lit(1.0)).otherwise(F.col(premium)),
    )
