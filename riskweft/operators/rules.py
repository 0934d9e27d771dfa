"""Pricing tiers, traffic lights, alerts and risk bands on top of the metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from riskweft.functions.labels import loss_ratio_light, pricing_tier
from riskweft.operators.quantiles import quantile_values
from riskweft.operators.metrics import segment_totals

MARGIN_ALERT = -10.0
RATIO_ALERT = 1.0


def pricing_tiers(kpi: DataFrame) -> DataFrame:
    return kpi.withColumn("tier", pricing_tier(F.col("Margin")))


def traffic_lights(segments: DataFrame) -> DataFrame:
    return segments.withColumn("light", loss_ratio_light(F.col("loss_ratio")))


def alerts(df: DataFrame, group: str) -> DataFrame:
    """Segments whose average margin or loss ratio crosses its limit, with the reasons."""
    table = segment_totals(df, [group]).withColumn(
        "average_margin", F.col("margin") / F.col("policy_count")
    )
    reasons = F.array_compact(
        F.array(
            F.when(F.col("average_margin") < MARGIN_ALERT, F.lit("margin")),
            F.when(F.col("loss_ratio") > RATIO_ALERT, F.lit("loss ratio")),
        )
    )
    return (
        table.withColumn("reasons", F.array_join(reasons, ", "))
        .filter(F.col("reasons") != "")
        .select(group, "policy_count", "average_margin", "loss_ratio", "reasons")
    )


def risk_bands(
    df: DataFrame,
    score: str = "prediction",
    cuts: Sequence[float] = (0.5, 0.8, 0.95),
    labels: Sequence[str] = ("low", "medium", "high", "very high"),
) -> DataFrame:
    """Label each row by the quantile band its score falls into."""
    if len(labels) != len(cuts) + 1:
        raise ValueError("Need one label more than cuts")
    levels = quantile_values(df, {score: list(cuts)})
    x = F.col(score)
    band = None
    for cut, label in zip(cuts, labels):
        reached = x <= F.lit(levels[score, cut])
        band = F.when(reached, label) if band is None else band.when(reached, label)
    band = band.when(x.isNotNull(), labels[-1])
    return df.withColumn("risk_band", band)
