"""Reports composed from several operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from riskweft.operators.metrics import CLAIMS, PREMIUM, segment_totals


def _extremes(df: DataFrame, group: str) -> Column:
    """Struct of the segments with the highest and the lowest ratio; ties by name."""
    table = segment_totals(df, [group]).dropna(subset=["loss_ratio"])
    ratio, name = F.col("loss_ratio"), F.col(group).alias("name")
    both = table.agg(
        F.struct(
            F.min(F.struct((-ratio).alias("r"), name)).getField("name").alias("highest"),
            F.min(F.struct(ratio.alias("r"), name)).getField("name").alias("lowest"),
        )
    )
    return both.scalar()


def executive_summary(
    df: DataFrame,
    date: str = "TransactionMonth",
    province: str = "Province",
    vehicle: str = "VehicleType",
) -> DataFrame:
    """One row: size, date range, totals, overall ratio and the extreme segments."""
    span = df.agg(
        F.count(F.lit(1)).alias("policies"),
        F.to_date(F.date_trunc("month", F.min(date))).alias("first_month"),
        F.to_date(F.date_trunc("month", F.max(date))).alias("last_month"),
        F.sum(PREMIUM).alias("total_premium"),
        F.sum(CLAIMS).alias("total_claims"),
    )
    ratio = F.try_divide("total_claims", "total_premium")
    return span.select(
        "*",
        ratio.alias("loss_ratio"),
        F.when(ratio > 1, "unprofitable").otherwise("profitable").alias("status"),
        _extremes(df, province).alias("p"),
        _extremes(df, vehicle).alias("v"),
    ).select(
        *span.columns,
        "loss_ratio",
        "status",
        F.col("p.highest").alias("highest_risk_province"),
        F.col("p.lowest").alias("lowest_risk_province"),
        F.col("v.highest").alias("highest_risk_vehicle"),
        F.col("v.lowest").alias("lowest_risk_vehicle"),
    )
