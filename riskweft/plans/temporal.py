"""Joins on time, moving frames, neighbours and tiles, and metrics at several levels."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweft.operators import levels, rolling, timejoins
from riskweft.plans.registry import policy_sql, query, r, rounded
from riskweft.sources.policy import policy_view, read_table

DAY = 86_400_000_000  # microseconds

# The events lie decades after the orders: this moves them into the same years.
_MOVED = """moved AS (
  SELECT event_id, user_id, value,
         ts - INTERVAL 27 YEAR + to_days(CAST(event_id % 1600 AS INTEGER)) AS moment FROM events)"""


def _moved_events(spark, sf):
    at = F.col("ts") - F.expr("INTERVAL '27' YEAR") + F.make_dt_interval((F.col("event_id") % 1600).cast("int"))
    return read_table(spark, sf, "events").select("event_id", "user_id", "value", at.alias("moment"))


def _orders(spark, sf):
    return read_table(spark, sf, "orders").select(
        F.col("o_custkey").alias("user_id"), "o_orderkey", "o_orderstatus", "o_orderdate"
    )


@query(
    "asof_latest_order_of_event",
    f"""WITH {_MOVED},
state AS (SELECT o_custkey, o_orderdate, max(o_orderkey) AS o_orderkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus
  FROM orders GROUP BY o_custkey, o_orderdate)
SELECT event_id, moment, o_orderkey, o_orderstatus, o_orderdate
FROM moved ASOF LEFT JOIN state ON user_id = o_custkey AND moment >= o_orderdate""",
)
def asof_latest_order(spark, sf):
    found = timejoins.asof_join(
        _moved_events(spark, sf), _orders(spark, sf), "moment", "o_orderdate", by=["user_id"], ties=["o_orderkey"]
    )
    return found.select("event_id", "moment", "o_orderkey", "o_orderstatus", "o_orderdate")


@query(
    "asof_next_order_within_30_days",
    f"""WITH {_MOVED},
state AS (SELECT o_custkey, o_orderdate, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey, o_orderdate)
SELECT event_id, o_orderkey, o_orderdate FROM moved ASOF JOIN state ON user_id = o_custkey AND moment <= o_orderdate
WHERE o_orderdate - moment <= INTERVAL 30 DAY""",
)
def asof_next_order(spark, sf):
    found = timejoins.asof_join(
        _moved_events(spark, sf), _orders(spark, sf), "moment", "o_orderdate", by=["user_id"], ties=["o_orderkey"],
        direction="forward", tolerance=F.expr("INTERVAL '30' DAY"), how="inner",
    )
    return found.select("event_id", "o_orderkey", "o_orderdate")


@query(
    "asof_previous_order_of_customer",
    """WITH state AS (SELECT o_custkey, o_orderdate, max(o_orderkey) AS previous_order FROM orders GROUP BY o_custkey, o_orderdate)
SELECT a.o_orderkey, previous_order, b.o_orderdate AS previous_date
FROM orders a ASOF LEFT JOIN state b ON a.o_custkey = b.o_custkey AND a.o_orderdate > b.o_orderdate""",
)
def asof_previous_order(spark, sf):
    orders = _orders(spark, sf)
    found = timejoins.asof_join(
        orders, orders, "o_orderdate", "o_orderdate", by=["user_id"], columns=["o_orderkey", "o_orderdate"],
        ties=["o_orderkey"], exact=False, suffix="_before",
    )
    return found.select("o_orderkey", F.col("o_orderkey_before").alias("previous_order"), F.col("o_orderdate_before").alias("previous_date"))


_PERIODS = """period AS (
  SELECT o_custkey, o_orderkey, o_orderdate AS begins,
         o_orderdate + to_days(CAST(CASE WHEN o_orderkey % 50 = 0 THEN 900 ELSE o_orderkey % 45 END AS INTEGER)) AS ends FROM orders)"""


def _periods(spark, sf):
    days = F.when(F.col("o_orderkey") % 50 == 0, 900).otherwise(F.col("o_orderkey") % 45).cast("int")
    return _orders(spark, sf).select(
        "user_id", "o_orderkey", F.col("o_orderdate").alias("begins"), (F.col("o_orderdate") + F.make_dt_interval(days)).alias("ends")
    )


@query(
    "interval_events_in_policy_periods",
    f"""WITH {_MOVED}, {_PERIODS}
SELECT event_id, o_orderkey, begins, ends FROM moved JOIN period ON user_id = o_custkey AND moment >= begins AND moment < ends""",
)
def events_in_periods(spark, sf):
    found = timejoins.interval_join(_moved_events(spark, sf), _periods(spark, sf), "moment", ("begins", "ends"), by=["user_id"])
    return found.select("event_id", "o_orderkey", "begins", "ends")


@query(
    "interval_events_outside_any_period",
    f"""WITH {_MOVED}, {_PERIODS}
SELECT event_id, moment FROM moved WHERE NOT EXISTS (
  SELECT 1 FROM period WHERE user_id = o_custkey AND moment BETWEEN begins AND ends)""",
)
def events_outside_periods(spark, sf):
    found = timejoins.interval_join(
        _moved_events(spark, sf), _periods(spark, sf), "moment", ("begins", "ends"), by=["user_id"], closed="both", how="anti"
    )
    return found.select("event_id", "moment")


@query(
    "interval_overlapping_policy_periods",
    f"""WITH {_PERIODS}
SELECT a.o_custkey AS customer, count(*) AS overlaps, min(a.o_orderkey) AS first_order, max(b.o_orderkey) AS last_order
FROM period a JOIN period b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey
 AND CASE WHEN a.begins >= b.begins THEN a.begins < b.ends OR (a.begins = b.begins AND b.begins = b.ends)
          ELSE b.begins < a.ends END
GROUP BY a.o_custkey""",
)
def overlapping_periods(spark, sf):
    periods = _periods(spark, sf)
    pairs = timejoins.overlap_join(periods, periods, ("begins", "ends"), ("begins", "ends"), by=["user_id"], suffix="_other")
    pairs = pairs.filter(F.col("o_orderkey") < F.col("o_orderkey_other"))
    return pairs.groupBy(F.col("user_id").alias("customer")).agg(
        F.count(F.lit(1)).alias("overlaps"), F.min("o_orderkey").alias("first_order"), F.max("o_orderkey_other").alias("last_order")
    )


@query(
    "rolling_loss_ratio_30_days_by_province",
    policy_sql(
        """SELECT Province, TransactionMonth, rows_30, round(claims_30, 4) AS claims_30, round(premium_30, 4) AS premium_30,
  round(claims_30 / nullif(premium_30, 0), 6) AS loss_ratio_30 FROM (
  SELECT Province, TransactionMonth, CAST(sum(n) OVER w AS BIGINT) AS rows_30, sum(c) OVER w AS claims_30, sum(p) OVER w AS premium_30
  FROM day WINDOW w AS (PARTITION BY Province ORDER BY TransactionMonth RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND CURRENT ROW))""",
        """day AS (SELECT Province, TransactionMonth, count(TotalPremium) AS n, sum(TotalClaims) AS c, sum(TotalPremium) AS p
  FROM policy GROUP BY Province, TransactionMonth)""",
    ),
)
def rolling_loss_ratio(spark, sf):
    rows = policy_view(spark, sf, ["Province", "TransactionMonth", "TotalClaims", "TotalPremium"])
    found = rolling.rolling(
        rows, "TransactionMonth", 30 * DAY,
        {"rows_30": ("count", "TotalPremium"), "claims_30": ("sum", "TotalClaims"), "premium_30": ("sum", "TotalPremium")},
        by=["Province"],
    )
    found = found.withColumn("loss_ratio_30", F.try_divide("claims_30", "premium_30"))
    return rounded(found, claims_30=4, premium_30=4, loss_ratio_30=6)


@query(
    "rolling_day_of_events",
    """SELECT ts, count(value) OVER w AS n, round(sum(value) OVER w, 4) AS total, min(value) OVER w AS lowest, max(value) OVER w AS highest
FROM events WINDOW w AS (ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW)""",
)
def rolling_day_of_events(spark, sf):
    """One key for all rows: only the blocks of the frame divide the work."""
    found = rolling.rolling(
        read_table(spark, sf, "events"), "ts", DAY,
        {"n": ("count", "value"), "total": ("sum", "value"), "lowest": ("min", "value"), "highest": ("max", "value")},
        blocks=96,
    )
    return rounded(found, total=4)


_ORDERED = "PARTITION BY Gender ORDER BY TransactionMonth, PolicyID, LineNumber, PartKey, TotalPremium"


@query(
    "neighbouring_policies_by_gender",
    policy_sql(
        f"""SELECT PolicyID, LineNumber, Gender, round(lag(TotalPremium) OVER w, 6) AS previous_premium,
  round(lead(TotalPremium, 3) OVER w, 6) AS third_next_premium FROM policy WINDOW w AS ({_ORDERED})"""
    ),
)
def neighbouring_policies(spark, sf):
    order = ["TransactionMonth", "PolicyID", "LineNumber", "PartKey", "TotalPremium"]
    rows = policy_view(spark, sf, ["Gender", *order])
    found = rolling.neighbours(rows, {"previous_premium": "TotalPremium"}, order, by=["Gender"])
    found = rolling.neighbours(found, {"third_next_premium": "TotalPremium"}, order, by=["Gender"], offset=-3)
    return rounded(found.select("PolicyID", "LineNumber", "Gender", "previous_premium", "third_next_premium"), previous_premium=6, third_next_premium=6)


@query(
    "premium_deciles_by_gender",
    policy_sql(
        """SELECT Gender, decile, count(*) AS n, round(min(TotalPremium), 6) AS lowest, round(max(TotalPremium), 6) AS highest,
  round(sum(TotalClaims), 4) AS claims FROM (
  SELECT *, CAST(ntile(10) OVER (PARTITION BY Gender ORDER BY TotalPremium, PolicyID, LineNumber) AS INTEGER) AS decile FROM policy)
GROUP BY Gender, decile"""
    ),
)
def premium_deciles(spark, sf):
    order = ["TotalPremium", "PolicyID", "LineNumber"]
    rows = policy_view(spark, sf, ["Gender", *order, "TotalClaims"])
    tiled = rolling.tiles(rows, 10, order, by=["Gender"], name="decile")
    return tiled.groupBy("Gender", "decile").agg(
        F.count(F.lit(1)).alias("n"), r(F.min("TotalPremium"), 6, "lowest"), r(F.max("TotalPremium"), 6, "highest"),
        r(F.sum("TotalClaims"), 4, "claims"),
    )


def _levels_sql(keys: list[str], clause: str) -> str:
    named = " || ".join(f"CASE WHEN grouping({k}) = 0 THEN '+{k}' ELSE '' END" for k in keys)
    present = " AND ".join(f"(grouping({k}) = 1 OR {k} IS NOT NULL)" for k in keys)
    return policy_sql(
        f"""SELECT coalesce(nullif(substr({named}, 2), ''), 'total') AS level, {', '.join(keys)}, count(*) AS policy_count,
  round(sum(TotalClaims), 4) AS total_claims, round(sum(TotalPremium), 4) AS total_premium,
  round(sum(TotalClaims) / nullif(sum(TotalPremium), 0), 6) AS loss_ratio,
  round(100.0 * count(*) FILTER (WHERE TotalClaims > 0) / count(*), 6) AS claim_frequency,
  round(coalesce(avg(TotalClaims) FILTER (WHERE TotalClaims > 0), 0), 6) AS claim_severity,
  round(avg(TotalPremium - TotalClaims), 6) AS margin
FROM policy GROUP BY {clause} HAVING {present}"""
    )


def _at_levels(name: str, keys: list[str], clause: str, wanted: list[list[str]]) -> None:
    @query(name, _levels_sql(keys, clause))
    def run(spark, sf):
        rows = policy_view(spark, sf, [*keys, "TotalClaims", "TotalPremium"])
        return rounded(
            levels.metrics_at_levels(rows, wanted), total_claims=4, total_premium=4, loss_ratio=6, claim_frequency=6,
            claim_severity=6, margin=6,
        )


_at_levels(
    "metrics_cube_country_bank_gender", ["Country", "Bank", "Gender"], "CUBE (Country, Bank, Gender)",
    levels.cube_levels(["Country", "Bank", "Gender"]),
)
_at_levels(
    "metrics_rollup_country_province_gender", ["Country", "Province", "Gender"], "ROLLUP (Country, Province, Gender)",
    levels.rollup_levels(["Country", "Province", "Gender"]),
)
_at_levels(
    "metrics_grouping_sets_postal_vehicle", ["PostalCode", "VehicleType", "Bank"],
    "GROUPING SETS ((PostalCode), (VehicleType, Bank), (Bank))", [["PostalCode"], ["VehicleType", "Bank"], ["Bank"]],
)
