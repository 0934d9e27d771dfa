"""Stored sketches, differences of snapshots, keyed state on streams, and fields of JSON text."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweft.operators import jsonfields, sketches, snapshots
from riskweft.plans.registry import policy_sql, query, rounded
from riskweft.plans.storage import shared_folder
from riskweft.sources.policy import policy_view, read_table
from riskweft.streaming import keyed
from riskweft.streaming.monitor import write_windows


@query(
    "sketched_policies_by_province",
    policy_sql(
        """SELECT Province, count(*) AS policies, count(DISTINCT PolicyID) AS distinct_policies,
  TRUE AS within_error FROM policy GROUP BY Province"""
    ),
)
def sketched_policies(spark, sf):
    """Monthly sketches merged to provinces: the exact distinct count must lie within their bounds."""
    rows = policy_view(spark, sf, ["Province", "TransactionMonth", "PolicyID"])
    monthly = sketches.segment_sketches(rows, ["Province"], distinct=["PolicyID"], month_of="TransactionMonth")
    found = sketches.sketch_estimates(sketches.merge_sketches(monthly, ["Province"]))
    exact = rows.groupBy("Province").agg(F.countDistinct("PolicyID").alias("distinct_policies"))
    within = F.col("distinct_policies").between(F.col("distinct_PolicyID_low"), F.col("distinct_PolicyID_high"))
    return found.join(exact, "Province").select("Province", F.col("rows").alias("policies"), "distinct_policies", within.alias("within_error"))


@query(
    "sketched_premium_quartiles",
    policy_sql("SELECT Gender, count(*) AS policies, TRUE AS within_error FROM policy GROUP BY Gender"),
)
def sketched_quartiles(spark, sf):
    """Quartiles merged from monthly sketches: their true ranks must lie within the stated error."""
    rows = policy_view(spark, sf, ["Gender", "TransactionMonth", "TotalPremium"])
    monthly = sketches.segment_sketches(rows, ["Gender"], quantiles=["TotalPremium"], month_of="TransactionMonth")
    found = sketches.sketch_estimates(sketches.merge_sketches(monthly, ["Gender"]), (0.25, 0.5, 0.75))
    # A row per gender.
    ranks = rows.join(F.broadcast(found.select("Gender", "quantiles_TotalPremium")), "Gender")
    at = lambda k: F.col("quantiles_TotalPremium")[k]
    share = lambda c: F.count_if(c) / F.count(F.lit(1))
    near = F.lit(True)
    for k, p in enumerate((0.25, 0.5, 0.75)):
        near = near & (share(F.col("TotalPremium") < at(k)) <= p + sketches.KLL_ERROR)
        near = near & (share(F.col("TotalPremium") <= at(k)) >= p - sketches.KLL_ERROR)
    return ranks.groupBy("Gender").agg(F.count(F.lit(1)).alias("policies"), near.alias("within_error"))


@query(
    "sketched_province_overlap",
    policy_sql(
        """SELECT count(*) AS both_years, TRUE AS within_error FROM (
  SELECT PostalCode || '/' || VehicleType AS k FROM policy WHERE year(TransactionMonth) = 1996 AND PostalCode IS NOT NULL
  INTERSECT SELECT PostalCode || '/' || VehicleType FROM policy WHERE year(TransactionMonth) = 1997)"""
    ),
)
def sketched_overlap(spark, sf):
    """Postal code and vehicle pairs seen in both of two years, by overlap of theta sketches."""
    rows = policy_view(spark, sf, ["PostalCode", "VehicleType", "TransactionMonth"])
    rows = rows.select(F.concat_ws("/", "PostalCode", "VehicleType").alias("pair"), F.year("TransactionMonth").alias("year"))
    found = sketches.compare_segments(sketches.segment_sketches(rows, ["year"], distinct=["pair"]), "pair", "year", 1996, 1997)
    years = rows.filter("year IN (1996, 1997)").groupBy("pair").agg(F.countDistinct("year").alias("n"))
    exact = years.agg(F.count_if(F.col("n") == 2).alias("both_years"))
    return exact.crossJoin(found).select("both_years", F.col("both_years").between(F.col("low"), F.col("high")).alias("within_error"))  # one row each


_KEYS = ["PolicyID", "LineNumber"]
_SHOWN = [*_KEYS, "TotalPremium", "Bank", "Gender"]
_SNAPSHOTS = """old_rows AS (SELECT PolicyID, LineNumber, TotalPremium, Bank, Gender FROM policy WHERE PolicyID % 97 <> 0),
new_rows AS (SELECT PolicyID, LineNumber, CASE WHEN PolicyID % 53 = 0 THEN TotalPremium + 1 ELSE TotalPremium END AS TotalPremium,
    CASE WHEN PolicyID % 31 = 0 THEN NULL ELSE Bank END AS Bank, Gender FROM policy WHERE PolicyID % 89 <> 0
  UNION ALL SELECT PolicyID, LineNumber, TotalPremium, Bank, Gender FROM policy WHERE PolicyID % 101 = 0),
removed AS (SELECT * FROM old_rows EXCEPT ALL SELECT * FROM new_rows),
inserted AS (SELECT * FROM new_rows EXCEPT ALL SELECT * FROM old_rows)"""


def _snapshots(spark, sf):
    rows = policy_view(spark, sf, _SHOWN)
    policy = F.col("PolicyID")
    new = rows.filter(policy % 89 != 0).withColumns({
        "TotalPremium": F.when(policy % 53 == 0, F.col("TotalPremium") + 1).otherwise(F.col("TotalPremium")),
        "Bank": F.when(policy % 31 != 0, F.col("Bank")),
    })
    return rows.filter(policy % 97 != 0), new.unionByName(rows.filter(policy % 101 == 0))


@query("snapshot_rows_removed", policy_sql("SELECT PolicyID, LineNumber, round(TotalPremium, 6) AS TotalPremium, Bank, Gender FROM removed", _SNAPSHOTS))
def snapshot_rows_removed(spark, sf):
    return snapshots.rows_removed(*_snapshots(spark, sf)).withColumn("TotalPremium", F.round("TotalPremium", 6))


@query(
    "snapshot_rows_kept",
    policy_sql(
        """SELECT Gender, count(*) AS n, round(sum(TotalPremium), 4) AS premium FROM (
  SELECT * FROM old_rows INTERSECT ALL SELECT * FROM new_rows) GROUP BY Gender""",
        _SNAPSHOTS,
    ),
)
def snapshot_rows_kept(spark, sf):
    kept = snapshots.rows_kept(*_snapshots(spark, sf))
    return kept.groupBy("Gender").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("TotalPremium"), 4).alias("premium"))


_PAIRED = """numbered AS (
  SELECT *, 'removed' AS side, row_number() OVER (PARTITION BY PolicyID, LineNumber
    ORDER BY TotalPremium NULLS FIRST, Bank NULLS FIRST, Gender NULLS FIRST) AS place FROM removed
  UNION ALL
  SELECT *, 'inserted', row_number() OVER (PARTITION BY PolicyID, LineNumber
    ORDER BY TotalPremium NULLS FIRST, Bank NULLS FIRST, Gender NULLS FIRST) FROM inserted),
paired AS (
  SELECT PolicyID, LineNumber, CASE WHEN b.place IS NULL THEN 'removed' WHEN a.place IS NULL THEN 'inserted' ELSE 'changed' END AS change,
    a.TotalPremium IS DISTINCT FROM b.TotalPremium AS p, a.Bank IS DISTINCT FROM b.Bank AS k, a.Gender IS DISTINCT FROM b.Gender AS g
  FROM (SELECT * FROM numbered WHERE side = 'removed') a FULL JOIN (SELECT * FROM numbered WHERE side = 'inserted') b
  USING (PolicyID, LineNumber, place))"""


@query(
    "snapshot_change_summary",
    policy_sql(
        """SELECT change, NULL::VARCHAR AS "column", count(*) AS "rows" FROM paired GROUP BY change
UNION ALL SELECT change, 'TotalPremium', count(*) FROM paired WHERE change = 'changed' AND p GROUP BY change
UNION ALL SELECT change, 'Bank', count(*) FROM paired WHERE change = 'changed' AND k GROUP BY change
UNION ALL SELECT change, 'Gender', count(*) FROM paired WHERE change = 'changed' AND g GROUP BY change""",
        _SNAPSHOTS,
        _PAIRED,
    ),
)
def snapshot_change_summary(spark, sf):
    return snapshots.change_summary(snapshots.changes(*_snapshots(spark, sf), key=_KEYS))


def _streamed(spark, sf, make, name):
    """Rows that a query over the events as a stream has sent when all of them were read."""
    schema = read_table(spark, sf, "events").schema
    table = make(spark.readStream.schema(schema).parquet(f"{sf}/events*.parquet"))
    base = shared_folder(spark, name)
    write_windows(table, f"{base}/out", f"{base}/state", available_now=True).awaitTermination()
    return spark.read.schema(table.schema).parquet(f"{base}/out")


_SESSIONS = """marked AS (
  SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM (
    SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > ts - INTERVAL 6 HOUR THEN 0 ELSE 1 END AS opens FROM events)),
session AS (SELECT user_id, min(ts) AS session_start, max(ts) AS last_row, max(ts) + INTERVAL 6 HOUR AS session_end, count(*) AS n,
  round(sum(value), 4) AS total, max(value) AS highest FROM marked GROUP BY user_id, k)"""


@query("event_sessions_batch", f"WITH {_SESSIONS} SELECT * FROM session")
def event_sessions_batch(spark, sf):
    return rounded(keyed.sessions(read_table(spark, sf, "events"), ["user_id"], "ts", "6 hours", value="value"), total=4)


@query(
    "event_sessions_stream",
    f"WITH {_SESSIONS} SELECT * FROM session WHERE session_end <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)",
)
def event_sessions_stream(spark, sf):
    make = lambda stream: keyed.sessions(stream, ["user_id"], "ts", "6 hours", value="value")
    return rounded(_streamed(spark, sf, make, "sessions"), total=4)


_ALERTS = """crossing AS (SELECT user_id, ts, value, CASE WHEN value >= 90 THEN 1 ELSE 0 END AS mark FROM events WHERE value >= 90 OR value <= 20),
changed AS (SELECT user_id, ts, CASE WHEN mark = 1 THEN 'raised' ELSE 'cleared' END AS change, value FROM (
  SELECT *, lag(mark, 1, 0) OVER (PARTITION BY user_id ORDER BY ts, value) AS before FROM crossing) WHERE mark <> before)"""


@query("event_alerts_batch", f"WITH {_ALERTS} SELECT * FROM changed")
def event_alerts_batch(spark, sf):
    return keyed.alert_changes(read_table(spark, sf, "events"), "user_id", "ts", "value", 90.0, 20.0)


@query(
    "event_alerts_stream",
    f"WITH {_ALERTS} SELECT * FROM changed WHERE date_trunc('millisecond', ts) < (SELECT date_trunc('millisecond', max(ts) - INTERVAL 1 HOUR) FROM events)",
)
def event_alerts_stream(spark, sf):
    make = lambda stream: keyed.alert_changes(stream, "user_id", "ts", "value", 90.0, 20.0)
    return _streamed(spark, sf, make, "alerts")


@query(
    "clicks_joined_to_views_stream",
    """SELECT a.event_id, b.event_id AS next_event_id, a.user_id FROM events a JOIN events b
  ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'view' AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 8 HOUR""",
)
def clicks_to_views(spark, sf):
    def make(stream):
        clicks, views = (stream.filter(F.col("event_type") == kind).select("event_id", "user_id", "ts") for kind in ("click", "view"))
        return keyed.join_within(clicks, views, ["user_id"], "ts", "ts", "8 HOURS").select("event_id", "next_event_id", "user_id")

    return _streamed(spark, sf, make, "joined")


@query(
    "event_props_fields",
    """WITH pairs AS (SELECT '/' || k AS path, json_type(props, '$."' || k || '"') AS kind FROM (
  SELECT props, unnest(json_keys(props)) AS k FROM events WHERE props IS NOT NULL)),
whole AS (SELECT count(*) AS n FROM events WHERE json_type(props) = 'OBJECT')
SELECT '' AS path, n AS present, n AS parents, 0.0::DOUBLE AS missing_share, 'object' AS type FROM whole
UNION ALL SELECT path, count(*), any_value(n), 1 - count(*) / any_value(n),
  CASE WHEN bool_and(kind IN ('UBIGINT', 'BIGINT')) THEN 'bigint' ELSE 'string' END FROM pairs, whole GROUP BY path""",
)
def event_props_fields(spark, sf):
    fields = jsonfields.json_fields(read_table(spark, sf, "events"), "props")
    return fields.select("path", "present", "parents", F.col("missing_share").cast("double").alias("missing_share"), "type")


@query(
    "event_props_totals",
    """SELECT event_type, count(props->>'$.k') AS n, CAST(sum(CAST(props->>'$.k' AS BIGINT)) AS BIGINT) AS total
FROM events GROUP BY event_type""",
)
def event_props_totals(spark, sf):
    typed = jsonfields.typed_json(read_table(spark, sf, "events"), "props", "found")
    return typed.groupBy("event_type").agg(F.count("found.k").alias("n"), F.sum("found.k").alias("total"))
