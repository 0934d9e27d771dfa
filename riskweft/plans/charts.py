"""Plot data, executive summary and rule queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweft.operators import metrics as M
from riskweft.operators import plotdata as V
from riskweft.operators import rules
from riskweft.plans.analysis import RANKED_COLUMNS, ranked_sql
from riskweft.plans.portfolio import KPI_DIGITS, KPI_SELECT, MARGIN, MONTHS, TOP20, TOTALS, kpi_cte
from riskweft.plans.portfolio import MONEY
from riskweft.plans.registry import policy_sql, query, rounded
from riskweft.plans.reports import executive_summary
from riskweft.sources.policy import policy_view, read_table


def _histogram_sql(c: str, bins: int) -> str:
    return f"""SELECT i::INTEGER AS bin, round(lo + i * w, 9) AS lower,
  round(lo + (i + 1) * w, 9) AS upper, coalesce(n, 0) AS n
FROM range(0, {bins}) AS g(i)
CROSS JOIN (SELECT min({c}) AS lo, (max({c}) - min({c})) / {bins} AS w FROM policy)
LEFT JOIN (SELECT least(floor(({c} - lo) / w), {bins - 1})::BIGINT AS slot, count(*) AS n
           FROM policy, (SELECT min({c}) AS lo, (max({c}) - min({c})) / {bins} AS w FROM policy)
           WHERE {c} IS NOT NULL GROUP BY 1) ON slot = i"""


@query("histogram_premium", policy_sql(_histogram_sql("TotalPremium", 30)))
def histogram_premium(spark, sf):
    out = V.histogram(policy_view(spark, sf, ["TotalPremium"]), "TotalPremium")
    return rounded(out, lower=9, upper=9)


@query("histogram_claims_with_empty_bins", policy_sql(_histogram_sql("TotalClaims", 400)))
def histogram_claims(spark, sf):
    out = V.histogram(policy_view(spark, sf, ["TotalClaims"]), "TotalClaims", bins=400)
    return rounded(out, lower=9, upper=9)


@query(
    "histogram_centre_lines",
    policy_sql(
        """SELECT round(avg(TotalPremium), 6) AS mean, round(median(TotalPremium), 6) AS median
FROM policy"""
    ),
)
def histogram_centre_lines(spark, sf):
    out = V.centre_lines(policy_view(spark, sf, ["TotalPremium"]), "TotalPremium")
    return rounded(out, mean=6, median=6)


@query(
    "density_premium",
    policy_sql(
        """SELECT i::INTEGER AS point, round(lo + i * (hi - lo) / 199, 6) AS x,
  round(sum(exp(-0.5 * power((lo + i * (hi - lo) / 199 - TotalPremium) / h, 2)))
        * any_value((hi - lo) / 30 / (h * sqrt(2 * pi()))), 4) AS density
FROM policy, range(0, 200) AS g(i),
  (SELECT min(TotalPremium) AS lo, max(TotalPremium) AS hi,
          power(count(TotalPremium), -0.2) * stddev_samp(TotalPremium) AS h FROM policy)
GROUP BY i, lo, hi"""
    ),
)
def density_premium(spark, sf):
    out = V.density(policy_view(spark, sf, ["TotalPremium"]), "TotalPremium")
    return rounded(out, x=6, density=4)


@query(
    "category_bars_make",
    policy_sql(
        """SELECT make AS value, count(*) AS "count" FROM policy
GROUP BY make ORDER BY count(*) DESC, make LIMIT 10"""
    ),
)
def category_bars_make(spark, sf):
    return V.category_bars(policy_view(spark, sf, ["make"]), "make", 10)


@query(
    "correlation_heatmap_spearman",
    policy_sql(
        "\nUNION ALL ".join(
            f"SELECT '{a}' AS column1, '{b}' AS column2, round(corr(r_{a}, r_{b}), 6) AS value FROM r"
            for a in RANKED_COLUMNS[:3]
            for b in RANKED_COLUMNS[:3]
        ),
        "r AS (SELECT "
        + ", ".join(
            f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS r_{c}"
            for c in RANKED_COLUMNS[:3]
        )
        + " FROM policy)",
    ),
)
def correlation_heatmap_spearman(spark, sf):
    rows = policy_view(spark, sf, RANKED_COLUMNS[:3])
    return rounded(V.correlation_heatmap(rows, method="spearman"), value=6)


@query(
    "spearman_with_missing_values",
    policy_sql(
        "SELECT round(corr(rx, ry), 6) AS value FROM ranked",
        ranked_sql("CustomValueEstimate", "RegistrationYear"),
    ),
)
def spearman_with_missing(spark, sf):
    columns = ["CustomValueEstimate", "RegistrationYear"]
    matrix = V.correlation_heatmap(policy_view(spark, sf, columns), columns, "spearman")
    one = (F.col("column1") == columns[0]) & (F.col("column2") == columns[1])
    return rounded(matrix.filter(one).select("value"), value=6)


@query(
    "scatter_points",
    policy_sql("SELECT TotalPremium, TotalClaims, Gender, Cylinders FROM policy"),
)
def scatter_points(spark, sf):
    rows = policy_view(spark, sf, ["TotalPremium", "TotalClaims", "Gender", "Cylinders"])
    return V.scatter(rows, "TotalPremium", "TotalClaims", ["Gender", "Cylinders"])


@query(
    "scatter_all_points",
    policy_sql("SELECT TotalPremium, TotalClaims, Gender FROM policy"),
)
def scatter_all_points(spark, sf):
    rows = policy_view(spark, sf, ["TotalPremium", "TotalClaims", "Gender"])
    return V.scatter(rows, "TotalPremium", "TotalClaims", ["Gender"], sample=None)


@query(
    "interactive_scatter_points",
    policy_sql("SELECT TotalPremium, TotalClaims, Province, Cylinders, Bank FROM policy"),
)
def interactive_scatter_points(spark, sf):
    rows = policy_view(spark, sf, ["TotalPremium", "TotalClaims", "Province", "Bank", "Cylinders"])
    return V.interactive_scatter(
        rows, "TotalPremium", "TotalClaims", "Province", "Cylinders", ["Bank"]
    )


@query(
    "regression_line",
    policy_sql(
        """SELECT round(regr_slope(TotalClaims, TotalPremium), 6) AS slope,
  round(regr_intercept(TotalClaims, TotalPremium), 6) AS intercept,
  regr_count(TotalClaims, TotalPremium)::BIGINT AS n FROM policy"""
    ),
)
def regression_line(spark, sf):
    rows = policy_view(spark, sf, ["TotalPremium", "TotalClaims"])
    return rounded(V.regression_line(rows, "TotalPremium", "TotalClaims"), slope=6, intercept=6)


def _boxplot(name, column, by):
    key = by or "'all'"
    sql = policy_sql(
        f"""SELECT g AS "group", any_value(n) AS n, round(any_value(q1), 6) AS q1,
  round(any_value(q2), 6) AS median, round(any_value(q3), 6) AS q3,
  round(min(x) FILTER (WHERE ok), 6) AS whisker_low,
  round(max(x) FILTER (WHERE ok), 6) AS whisker_high, count(*) FILTER (WHERE NOT ok) AS outliers
FROM (SELECT *, x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS ok
      FROM (SELECT {key} AS g, {column} AS x FROM policy
            WHERE {key} IS NOT NULL AND {column} IS NOT NULL)
      JOIN (SELECT {key} AS k, count({column}) AS n, quantile_cont({column}, 0.25) AS q1,
                   median({column}) AS q2, quantile_cont({column}, 0.75) AS q3
            FROM policy WHERE {key} IS NOT NULL GROUP BY 1) ON g = k) GROUP BY g"""
    )

    @query(name, sql)
    def run(spark, sf):
        out = V.boxplot(policy_view(spark, sf, [column] + ([by] if by else [])), column, by)
        return rounded(out, q1=6, median=6, q3=6, whisker_low=6, whisker_high=6)


_boxplot("boxplot_premium_by_province", "TotalPremium", "Province")
_boxplot("boxplot_claims_by_vehicle_type", "TotalClaims", "VehicleType")
_boxplot("boxplot_claims", "TotalClaims", None)


def _resample(name, aggregation, frequency, digits=5):
    period = {
        "D": "d",
        "W": "(date_trunc('week', d) + INTERVAL 6 DAY)::DATE",
        "ME": "last_day(d)",
        "Q": "(date_trunc('quarter', d) + INTERVAL 3 MONTH - INTERVAL 1 DAY)::DATE",
        "Y": "(date_trunc('year', d) + INTERVAL 12 MONTH - INTERVAL 1 DAY)::DATE",
    }[frequency]
    call = {"sum": "sum(x)", "mean": "avg(x)", "count": "count(x)::DOUBLE",
            "median": "median(x)", "min": "min(x)", "max": "max(x)"}[aggregation]
    value = "coalesce(v, 0)" if aggregation in ("sum", "count") else "v"
    sql = policy_sql(
        f"""SELECT period, round({value}, {digits}) AS value FROM (
  SELECT DISTINCT {period} AS period FROM (
    SELECT unnest(generate_series((SELECT min(d) FROM days)::TIMESTAMP,
                                  (SELECT max(d) FROM days)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS d))
LEFT JOIN (SELECT {period} AS p, {call} AS v FROM days GROUP BY 1) ON p = period""",
        """days AS (SELECT CAST(TransactionMonth AS DATE) AS d, TotalClaims AS x FROM policy
  WHERE TransactionMonth IS NOT NULL)""",
    )

    @query(name, sql)
    def run(spark, sf):
        rows = policy_view(spark, sf, ["TransactionMonth", "TotalClaims"])
        out = V.resample(rows, "TransactionMonth", "TotalClaims", aggregation, frequency)
        return rounded(out, value=digits)


_resample("resample_month_sum", "sum", "ME")
_resample("resample_week_mean", "mean", "W", digits=9)
_resample("resample_day_count", "count", "D")
_resample("resample_quarter_median", "median", "Q")
_resample("resample_year_max", "max", "Y")
_resample("resample_month_min", "min", "ME")


@query(
    "resample_events_daily",
    """SELECT d AS period, round(coalesce(v, 0), 4) AS value FROM (
  SELECT unnest(generate_series((SELECT min(ts)::DATE FROM events)::TIMESTAMP,
      (SELECT max(ts)::DATE FROM events)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS d)
LEFT JOIN (SELECT ts::DATE AS p, sum(value) AS v FROM events GROUP BY 1) ON p = d""",
)
def resample_events_daily(spark, sf):
    out = V.resample(read_table(spark, sf, "events"), "ts", "value", "sum", "D")
    return rounded(out, value=4)


@query(
    "loss_ratio_bars_vehicle",
    policy_sql(
        """SELECT VehicleType AS "group",
  round(sum(TotalClaims) / nullif(sum(TotalPremium), 0), 6) AS loss_ratio,
  CASE WHEN sum(TotalClaims) / nullif(sum(TotalPremium), 0) > 1 THEN 'loss' ELSE 'profit' END AS flag
FROM policy GROUP BY VehicleType"""
    ),
)
def loss_ratio_bars_vehicle(spark, sf):
    rows = policy_view(spark, sf, ["VehicleType", "TotalClaims", "TotalPremium"])
    return rounded(V.loss_ratio_bars(rows, "VehicleType"), loss_ratio=6)


@query(
    "loss_ratio_bars_top_postal_codes",
    policy_sql(
        """SELECT PostalCode AS "group", round(ratio, 6) AS loss_ratio,
  CASE WHEN ratio > 1 THEN 'loss' ELSE 'profit' END AS flag
FROM (SELECT PostalCode, sum(TotalClaims) / nullif(sum(TotalPremium), 0) AS ratio FROM policy
      GROUP BY PostalCode ORDER BY ratio DESC NULLS LAST, PostalCode LIMIT 10)"""
    ),
)
def loss_ratio_bars_top(spark, sf):
    rows = policy_view(spark, sf, ["PostalCode", "TotalClaims", "TotalPremium"])
    return rounded(V.loss_ratio_bars(rows, "PostalCode", top_n=10), loss_ratio=6)


@query(
    "dashboard",
    policy_sql(
        " UNION ALL ".join(
            f"SELECT '{c}' AS panel, 'histogram' AS kind, bin::VARCHAR AS key, n AS value "
            f"FROM ({_histogram_sql(c, 30)})"
            for c in ("TotalPremium", "SumInsured")
        )
        + " UNION ALL "
        + " UNION ALL ".join(
            f"""SELECT '{c}', 'bar', k, n FROM (SELECT {c} AS k, count(*) AS n FROM policy
  WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY n DESC, k LIMIT 10)"""
            for c in ("make", "Bank")
        )
    ),
)
def dashboard(spark, sf):
    columns = ["TotalPremium", "SumInsured"], ["make", "Bank"]
    return V.dashboard(policy_view(spark, sf, [*columns[0], *columns[1]]), *columns)


@query(
    "trend_with_status",
    policy_sql(
        """SELECT month, round(c, 5) AS total_claims, round(p, 5) AS total_premium,
  n AS policy_count, round(ratio, 6) AS loss_ratio,
  CASE WHEN ratio > 1 THEN 'unprofitable' WHEN ratio <= 1 THEN 'profitable' END AS status
FROM months""",
        MONTHS,
    ),
)
def trend_with_status(spark, sf):
    rows = policy_view(spark, sf, ["TransactionMonth", "TotalClaims", "TotalPremium"])
    return rounded(V.trend_with_status(rows), total_claims=5, total_premium=5, loss_ratio=6)


@query(
    "kpi_bars_province",
    policy_sql(
        " UNION ALL ".join(
            f'SELECT "Group", \'{p}\' AS panel, round({p}, 6) AS value FROM kpi'
            for p in ("ClaimFrequency", "ClaimSeverity", "Margin")
        ),
        kpi_cte("Province"),
    ),
)
def kpi_bars_province(spark, sf):
    rows = policy_view(spark, sf, ["Province", "TotalClaims", "TotalPremium"])
    return rounded(V.kpi_bars(rows, "Province"), value=6)


def _extreme(group: str, direction: str) -> str:
    return f"""(SELECT {group} FROM policy GROUP BY {group}
  ORDER BY sum(TotalClaims) / nullif(sum(TotalPremium), 0) {direction}, {group} LIMIT 1)"""


@query(
    "executive_summary",
    policy_sql(
        f"""SELECT count(*) AS policies,
  CAST(date_trunc('month', min(TransactionMonth)) AS DATE) AS first_month,
  CAST(date_trunc('month', max(TransactionMonth)) AS DATE) AS last_month,
  round(sum(TotalPremium), 5) AS total_premium, round(sum(TotalClaims), 5) AS total_claims,
  round(sum(TotalClaims) / sum(TotalPremium), 6) AS loss_ratio,
  CASE WHEN sum(TotalClaims) / sum(TotalPremium) > 1 THEN 'unprofitable' ELSE 'profitable' END
    AS status,
  {_extreme('Province', 'DESC')} AS highest_risk_province,
  {_extreme('Province', 'ASC')} AS lowest_risk_province,
  {_extreme('VehicleType', 'DESC')} AS highest_risk_vehicle,
  {_extreme('VehicleType', 'ASC')} AS lowest_risk_vehicle FROM policy"""
    ),
)
def executive(spark, sf):
    rows = policy_view(
        spark, sf, ["Province", "VehicleType", "TransactionMonth", "TotalClaims", "TotalPremium"]
    )
    return rounded(executive_summary(rows), total_premium=5, total_claims=5, loss_ratio=6)


# --- rules -----------------------------------------------------------------------------


@query(
    "pricing_tiers_postal_codes",
    policy_sql(
        f"""{KPI_SELECT}, CASE WHEN kpi.Margin < -50 THEN 'high risk'
  WHEN kpi.Margin < 0 THEN 'moderate risk' WHEN kpi.Margin <= 20 THEN 'standard'
  ELSE 'low risk' END AS tier FROM kpi""",
        kpi_cte("PostalCode"),
    ),
)
def pricing_tiers_postal_codes(spark, sf):
    rows = policy_view(spark, sf, ["PostalCode", "TotalClaims", "TotalPremium"])
    return rounded(rules.pricing_tiers(M.kpis(rows, "PostalCode")), **KPI_DIGITS)


@query(
    "loss_ratio_lights_province",
    policy_sql(
        f"""SELECT Province, {TOTALS}, {MARGIN},
  CASE WHEN sum(TotalClaims) / sum(TotalPremium) > 1 THEN 'red'
       WHEN sum(TotalClaims) / sum(TotalPremium) >= 0.9 THEN 'yellow' ELSE 'green' END AS light
FROM policy GROUP BY Province"""
    ),
)
def loss_ratio_lights_province(spark, sf):
    rows = policy_view(spark, sf, ["Province", "TotalClaims", "TotalPremium"])
    return rounded(rules.traffic_lights(M.segment_totals(rows, ["Province"])), **MONEY)


@query(
    "segment_alerts_postal_codes",
    policy_sql(
        """SELECT PostalCode, n AS policy_count, round(m, 6) AS average_margin,
  round(r, 6) AS loss_ratio, CASE WHEN m < -10 AND r > 1 THEN 'margin, loss ratio'
    WHEN m < -10 THEN 'margin' ELSE 'loss ratio' END AS reasons
FROM (SELECT PostalCode, count(*) AS n, avg(TotalPremium - TotalClaims) AS m,
             sum(TotalClaims) / sum(TotalPremium) AS r FROM policy GROUP BY PostalCode)
WHERE m < -10 OR r > 1"""
    ),
)
def segment_alerts(spark, sf):
    rows = policy_view(spark, sf, ["PostalCode", "TotalClaims", "TotalPremium"])
    return rounded(rules.alerts(rows, "PostalCode"), average_margin=6, loss_ratio=6)


@query(
    "risk_bands_sum_insured",
    policy_sql(
        """SELECT PolicyID, LineNumber, PartKey, SumInsured,
  CASE WHEN SumInsured <= a THEN 'low' WHEN SumInsured <= b THEN 'medium'
       WHEN SumInsured <= c THEN 'high' ELSE 'very high' END AS risk_band
FROM policy, (SELECT quantile_cont(SumInsured, 0.5) AS a, quantile_cont(SumInsured, 0.8) AS b,
                     quantile_cont(SumInsured, 0.95) AS c FROM policy)"""
    ),
)
def risk_bands_sum_insured(spark, sf):
    rows = policy_view(spark, sf, ["PolicyID", "LineNumber", "PartKey", "SumInsured"])
    return rules.risk_bands(rows, "SumInsured")


@query(
    "top_postal_code_loss_ratio_rank",
    policy_sql(
        """SELECT "Group", round(ClaimFrequency / 100 * ClaimSeverity
  / nullif(kpi.Margin + ClaimFrequency / 100 * ClaimSeverity, 0), 6) AS LossRatio FROM kpi""",
        TOP20,
    ),
)
def top_postal_ratio(spark, sf):
    rows = policy_view(spark, sf, ["PostalCode", "TotalClaims", "TotalPremium"])
    out = M.kpi_loss_ratio(M.kpis(rows, "PostalCode", top_k=20))
    return rounded(out, LossRatio=6).select("Group", "LossRatio")
