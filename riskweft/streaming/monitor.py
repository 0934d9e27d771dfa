"""Continuous KPI tracking over event-time windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from riskweft.functions.labels import loss_ratio_light
from riskweft.operators.metrics import CLAIMS, PREMIUM


def _windows(rows: DataFrame, time: str, every: str, late: str, by: Sequence[str]):
    if rows.isStreaming:
        # A watermark needs a timestamp with a zone; the session's zone should be UTC.
        rows = rows.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return rows.groupBy(F.window(time, every), *by)


def _bounds() -> list[Column]:
    return [
        F.col("window.start").cast("timestamp_ntz").alias("window_start"),
        F.col("window.end").cast("timestamp_ntz").alias("window_end"),
    ]


def windowed_kpis(
    rows: DataFrame,
    time: str = "TransactionMonth",
    every: str = "7 days",
    late: str = "1 day",
    by: Sequence[str] = (),
) -> DataFrame:
    """Premium, claims, margin, loss ratio and its light per window and segment.

    Works on a stream and, as its batch twin, on a table.  On a stream, rows later
    than ``late`` are dropped, which is what lets a window close and its state go.
    """
    claims, premium = F.col(CLAIMS).cast("double"), F.col(PREMIUM).cast("double")
    table = _windows(rows, time, every, late, by).agg(
        F.count(F.lit(1)).alias("policy_count"),
        F.sum(premium).alias("total_premium"),
        F.sum(claims).alias("total_claims"),
        F.avg(premium - claims).alias("average_margin"),
    )
    ratio = F.try_divide("total_claims", "total_premium")
    return table.select(
        *_bounds(),
        *by,
        "policy_count",
        "total_premium",
        "total_claims",
        "average_margin",
        ratio.alias("loss_ratio"),
        loss_ratio_light(ratio).alias("light"),
    )


def windowed_totals(
    rows: DataFrame, time: str, value: str, every: str, late: str, by: Sequence[str] = ()
) -> DataFrame:
    """Count, sum and maximum of a value per window and key."""
    table = _windows(rows, time, every, late, by).agg(
        F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.max(value).alias("highest")
    )
    return table.select(*_bounds(), *by, "n", "total", "highest")


def margin_alerts(kpis: DataFrame, margin: float = -10.0, ratio: float = 1.0) -> DataFrame:
    """Closed windows whose margin or loss ratio crossed its limit."""
    return kpis.filter((F.col("average_margin") < margin) | (F.col("loss_ratio") > ratio))


def write_windows(
    table: DataFrame, path: str, checkpoint: str, available_now: bool = False
) -> StreamingQuery:
    """Append closed windows to parquet files; restarts continue from ``checkpoint``."""
    writer = (
        table.writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
