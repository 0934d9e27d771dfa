"""Queries over sources, sinks and the streaming monitor."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession, functions as F

from riskweft.operators.missing import nan_to_null
from riskweft.plans.registry import policy_sql, query, r, rounded
from riskweft.session import use_checkpoints
from riskweft.sources.policy import policy_view, read_table
from riskweft.sources.sinks import save
from riskweft.sources.text import delimiter_counts, load_delimited
from riskweft.streaming import monitor

COLUMNS = ["PolicyID", "PostalCode", "Gender", "Bank", "TotalPremium", "TotalClaims"]


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder next to the checkpoints, which every executor can reach."""
    use_checkpoints(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


ROUNDTRIP = policy_sql(
    """SELECT count(*) AS n, count(Bank) AS with_bank, sum(PolicyID)::BIGINT AS policy_sum,
  count(DISTINCT PostalCode) AS codes, round(sum(TotalPremium), 5) AS premium,
  round(sum(TotalClaims), 5) AS claims FROM policy"""
)


def _measures(df):
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        F.count("Bank").alias("with_bank"),
        F.sum("PolicyID").alias("policy_sum"),
        F.countDistinct("PostalCode").alias("codes"),
        r(F.sum("TotalPremium"), 5, "premium"),
        r(F.sum("TotalClaims"), 5, "claims"),
    )


def _roundtrip(name, format, sep=None):
    @query(name, ROUNDTRIP)
    def run(spark, sf):
        path = shared_folder(spark, name)
        save(policy_view(spark, sf, COLUMNS), path, format, sep=sep)
        if format == "parquet":
            return _measures(nan_to_null(spark.read.parquet(path)))
        return _measures(load_delimited(spark, path, sep or ("|" if format == "txt" else ",")))


_roundtrip("roundtrip_pipe_text", "txt")
_roundtrip("roundtrip_tab_text", "txt", "\t")
_roundtrip("roundtrip_csv", "csv")
_roundtrip("roundtrip_parquet", "parquet")


@query(
    "roundtrip_parquet_partitioned",
    policy_sql(
        """SELECT Gender, count(*) AS n, round(sum(TotalPremium), 5) AS premium
FROM policy WHERE Gender = 'F' GROUP BY Gender"""
    ),
)
def roundtrip_partitioned(spark, sf):
    path = shared_folder(spark, "partitioned")
    save(policy_view(spark, sf, COLUMNS), path, "parquet", partition_by=["Gender"])
    one = spark.read.parquet(path).filter(F.col("Gender") == "F")
    return one.groupBy("Gender").agg(
        F.count(F.lit(1)).alias("n"), r(F.sum("TotalPremium"), 5, "premium")
    )


@query("detected_delimiter", "SELECT '|' AS delimiter")
def detected_delimiter(spark, sf):
    path = shared_folder(spark, "delimiter")
    save(policy_view(spark, sf, COLUMNS), path, "txt")
    counts = delimiter_counts(spark, path)
    return counts.orderBy(F.desc("n"), "position").limit(1).select("delimiter")


@query(
    "weekly_monitor_by_gender",
    policy_sql(
        """SELECT w AS window_start, w + INTERVAL 7 DAY AS window_end, Gender,
  count(*) AS policy_count, round(sum(TotalPremium), 5) AS total_premium,
  round(sum(TotalClaims), 5) AS total_claims,
  round(avg(TotalPremium - TotalClaims), 9) AS average_margin,
  round(sum(TotalClaims) / sum(TotalPremium), 6) AS loss_ratio,
  CASE WHEN sum(TotalClaims) / sum(TotalPremium) > 1 THEN 'red'
       WHEN sum(TotalClaims) / sum(TotalPremium) >= 0.9 THEN 'yellow' ELSE 'green' END AS light
FROM (SELECT *, time_bucket(INTERVAL 7 DAY, TransactionMonth, TIMESTAMP '1970-01-01') AS w
      FROM policy) GROUP BY w, Gender"""
    ),
)
def weekly_monitor(spark, sf):
    rows = policy_view(spark, sf, ["TransactionMonth", "Gender", "TotalPremium", "TotalClaims"])
    out = monitor.windowed_kpis(rows, by=["Gender"])
    return rounded(out, total_premium=5, total_claims=5, average_margin=9, loss_ratio=6)


@query(
    "events_monitor_batch",
    """SELECT date_trunc('day', ts) AS window_start,
  date_trunc('day', ts) + INTERVAL 1 DAY AS window_end, event_type, count(*) AS n,
  round(sum(value), 4) AS total, max(value) AS highest
FROM events GROUP BY 1, 2, 3""",
)
def events_monitor_batch(spark, sf):
    events = read_table(spark, sf, "events")
    out = monitor.windowed_totals(events, "ts", "value", "1 day", "1 hour", ["event_type"])
    return rounded(out, total=4)


@query(
    "events_monitor_stream",
    """SELECT * FROM (SELECT date_trunc('day', ts) AS window_start,
  date_trunc('day', ts) + INTERVAL 1 DAY AS window_end, event_type, count(*) AS n,
  round(sum(value), 4) AS total, max(value) AS highest
FROM events GROUP BY 1, 2, 3)
WHERE window_end <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""",
)
def events_monitor_stream(spark, sf):
    schema = read_table(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf}/events*.parquet")
    table = monitor.windowed_totals(stream, "ts", "value", "1 day", "1 hour", ["event_type"])
    base = shared_folder(spark, "monitor")
    running = monitor.write_windows(table, f"{base}/out", f"{base}/state", available_now=True)
    running.awaitTermination()
    out = spark.read.schema(table.schema).parquet(f"{base}/out")
    return rounded(out, total=4)
