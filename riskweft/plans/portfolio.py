"""Portfolio metric queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweft.operators import metrics as M
from riskweft.plans.registry import policy_sql, query, r, rounded
from riskweft.sources.policy import policy_view

MONEY = {"total_claims": 5, "total_premium": 5, "margin": 5, "loss_ratio": 6}

TOTALS = """count(*) AS policy_count, round(sum(TotalClaims), 5) AS total_claims,
       round(sum(TotalPremium), 5) AS total_premium,
       round(sum(TotalClaims) / nullif(sum(TotalPremium), 0), 6) AS loss_ratio"""
MARGIN = "round(sum(TotalPremium) - sum(TotalClaims), 5) AS margin"

KPI_DIGITS = {"ClaimFrequency": 6, "ClaimSeverity": 6, "Margin": 6}


def kpi_cte(group: str, where: str = "TRUE", name: str = "kpi") -> str:
    return f"""{name} AS (
  SELECT {group} AS "Group", count(*) AS PolicyCount,
         100.0 * count(*) FILTER (WHERE TotalClaims > 0) / count(*) AS ClaimFrequency,
         coalesce(avg(TotalClaims) FILTER (WHERE TotalClaims > 0), 0) AS ClaimSeverity,
         avg(TotalPremium - TotalClaims) AS Margin
  FROM policy WHERE {group} IS NOT NULL AND ({where}) GROUP BY {group})"""


KPI_SELECT = """SELECT "Group", PolicyCount, round(ClaimFrequency, 6) AS ClaimFrequency,
       round(ClaimSeverity, 6) AS ClaimSeverity, round(Margin, 6) AS Margin"""

TOP20 = kpi_cte("PostalCode", name="every") + """, kpi AS (
  SELECT * FROM every ORDER BY PolicyCount DESC, "Group" LIMIT 20)"""


@query(
    "policy_view_rows",
    policy_sql(
        """SELECT count(*) AS n, count(CustomValueEstimate) AS with_value,
       count(Bank) AS with_bank, count(DISTINCT Province) AS provinces,
       count(DISTINCT Country) AS countries, round(sum(SumInsured), 2) AS sum_insured,
       round(sum(CalculatedPremiumPerTerm), 2) AS term_premium,
       min(RegistrationYear) AS first_year, max(Cylinders) AS max_cylinders FROM policy"""
    ),
)
def policy_view_rows(spark, sf):
    return policy_view(spark, sf).agg(
        F.count(F.lit(1)).alias("n"),
        F.count("CustomValueEstimate").alias("with_value"),
        F.count("Bank").alias("with_bank"),
        F.countDistinct("Province").alias("provinces"),
        F.countDistinct("Country").alias("countries"),
        r(F.sum("SumInsured"), 2, "sum_insured"),
        r(F.sum("CalculatedPremiumPerTerm"), 2, "term_premium"),
        F.min("RegistrationYear").alias("first_year"),
        F.max("Cylinders").alias("max_cylinders"),
    )


@query(
    "loss_ratio_overall",
    policy_sql(
        """SELECT round(sum(TotalClaims), 5) AS total_claims,
       round(sum(TotalPremium), 5) AS total_premium,
       round(sum(TotalClaims) / nullif(sum(TotalPremium), 0), 6) AS loss_ratio FROM policy"""
    ),
)
def loss_ratio_overall(spark, sf):
    rows = policy_view(spark, sf, ["TotalClaims", "TotalPremium"])
    return rounded(M.loss_ratio(rows), total_claims=5, total_premium=5, loss_ratio=6)


def _ratio_by(name: str, *keys: str) -> None:
    listed = ", ".join(keys)
    sql = policy_sql(f"SELECT {listed}, {TOTALS}, {MARGIN} FROM policy GROUP BY {listed}")

    @query(name, sql)
    def run(spark, sf):
        rows = policy_view(spark, sf, [*keys, "TotalClaims", "TotalPremium"])
        return rounded(M.loss_ratio_by(rows, list(keys)), **MONEY)


_ratio_by("loss_ratio_by_province", "Province")
_ratio_by("loss_ratio_by_vehicle_type", "VehicleType")
_ratio_by("loss_ratio_by_gender", "Gender")
_ratio_by("loss_ratio_by_province_vehicle_gender", "Province", "VehicleType", "Gender")


@query(
    "loss_ratio_by_bank_drops_null_keys",
    policy_sql(
        f"SELECT Bank, {TOTALS}, {MARGIN} FROM policy WHERE Bank IS NOT NULL GROUP BY Bank"
    ),
)
def loss_ratio_by_bank(spark, sf):
    rows = policy_view(spark, sf, ["Bank", "TotalClaims", "TotalPremium"])
    return rounded(M.loss_ratio_by(rows, ["Bank"]), **MONEY)


@query("kpis_by_province", policy_sql(f"{KPI_SELECT} FROM kpi", kpi_cte("Province")))
def kpis_by_province(spark, sf):
    rows = policy_view(spark, sf, ["Province", "TotalClaims", "TotalPremium"])
    return rounded(M.kpis(rows, "Province"), **KPI_DIGITS)


@query(
    "kpis_selected_vehicle_types",
    policy_sql(
        f"{KPI_SELECT} FROM kpi",
        kpi_cte("VehicleType", "VehicleType IN (SELECT min(p_type) FROM part "
                "UNION ALL SELECT max(p_type) FROM part)"),
    ),
)
def kpis_selected(spark, sf):
    rows = policy_view(spark, sf, ["VehicleType", "TotalClaims", "TotalPremium"])
    ends = rows.agg(F.min("VehicleType"), F.max("VehicleType")).first()
    return rounded(M.kpis(rows, "VehicleType", list(ends)), **KPI_DIGITS)


@query(
    "kpi_loss_ratio_by_province",
    policy_sql(
        f"""{KPI_SELECT},
       round(coalesce(ClaimFrequency / 100 * ClaimSeverity
             / nullif(Margin + ClaimFrequency / 100 * ClaimSeverity, 0), 0), 6) AS LossRatio
FROM kpi""",
        kpi_cte("Province"),
    ),
)
def kpi_loss_ratio_by_province(spark, sf):
    rows = policy_view(spark, sf, ["Province", "TotalClaims", "TotalPremium"])
    return rounded(M.kpi_loss_ratio(M.kpis(rows, "Province")), **KPI_DIGITS, LossRatio=6)


def _postal(spark, sf):
    return policy_view(spark, sf, ["PostalCode", "TotalClaims", "TotalPremium"])


@query("top_postal_code_kpis", policy_sql(f"{KPI_SELECT} FROM kpi", TOP20))
def top_postal_code_kpis(spark, sf):
    return rounded(M.kpis(_postal(spark, sf), "PostalCode", top_k=20), **KPI_DIGITS).orderBy(
        "Margin"
    )


@query(
    "top_postal_code_coverage",
    policy_sql(
        """SELECT CAST((SELECT sum(PolicyCount) FROM kpi) AS BIGINT) AS covered_rows,
       count(*) AS total_rows,
       round(100.0 * (SELECT sum(PolicyCount) FROM kpi) / count(*), 6) AS covered_pct
FROM policy""",
        TOP20,
    ),
)
def top_postal_code_coverage(spark, sf):
    rows = policy_view(spark, sf, ["PostalCode"])
    return rounded(M.coverage(rows, "PostalCode", 20), covered_pct=6)


@query(
    "best_and_worst_postal_codes",
    policy_sql(
        f"""SELECT 'lowest margin' AS side, * FROM (
  {KPI_SELECT} FROM kpi ORDER BY kpi.Margin, "Group" LIMIT 10)
UNION ALL SELECT 'highest margin' AS side, * FROM (
  {KPI_SELECT} FROM kpi ORDER BY kpi.Margin DESC, "Group" DESC LIMIT 10)""",
        TOP20,
    ),
)
def best_and_worst_postal_codes(spark, sf):
    top = M.kpis(_postal(spark, sf), "PostalCode", top_k=20)
    return rounded(M.best_and_worst(top, 10), **KPI_DIGITS)


@query(
    "margin_spread_postal_codes",
    policy_sql(
        """SELECT round(max(Margin) - min(Margin), 6) AS margin_spread,
       count(*) FILTER (WHERE Margin > 0) AS profitable,
       count(*) FILTER (WHERE Margin < 0) AS unprofitable, count(*) AS "groups" FROM kpi""",
        TOP20,
    ),
)
def margin_spread_postal_codes(spark, sf):
    top = M.kpis(_postal(spark, sf), "PostalCode", top_k=20)
    return rounded(M.margin_spread(top), margin_spread=6)


def _side(measure: str) -> str:
    value = f"CAST({measure} AS DOUBLE)"
    a = f"max({value}) FILTER (WHERE \"Group\" = 'F')"
    b = f"max({value}) FILTER (WHERE \"Group\" = 'O')"
    return (
        f"SELECT '{measure}' AS measure, round({a}, 6) AS \"first\", "
        f"round({b}, 6) AS \"second\", round({a} - {b}, 6) AS difference FROM kpi"
    )


@query(
    "gender_comparison",
    policy_sql(
        "\nUNION ALL ".join(
            _side(m) for m in ("PolicyCount", "ClaimFrequency", "ClaimSeverity", "Margin")
        ),
        kpi_cte("Gender"),
    ),
)
def gender_comparison(spark, sf):
    rows = policy_view(spark, sf, ["Gender", "TotalClaims", "TotalPremium"])
    return rounded(M.compare_two(rows, "Gender", "F", "O"), first=6, second=6, difference=6)


MONTHS = """months AS (
  SELECT CAST(date_trunc('month', TransactionMonth) AS DATE) AS month,
         sum(TotalClaims) AS c, sum(TotalPremium) AS p, count(*) AS n,
         sum(TotalClaims) / nullif(sum(TotalPremium), 0) AS ratio
  FROM policy WHERE TransactionMonth IS NOT NULL GROUP BY 1)"""


def _months(spark, sf):
    return M.monthly_trend(
        policy_view(spark, sf, ["TransactionMonth", "TotalClaims", "TotalPremium"])
    )


@query(
    "monthly_trend",
    policy_sql(
        """SELECT month, round(c, 5) AS total_claims, round(p, 5) AS total_premium,
       n AS policy_count, round(ratio, 6) AS loss_ratio FROM months""",
        MONTHS,
    ),
)
def monthly_trend(spark, sf):
    return rounded(_months(spark, sf), total_claims=5, total_premium=5, loss_ratio=6)


@query(
    "monthly_trend_summary",
    policy_sql(
        """SELECT round(avg(ratio), 6) AS mean_loss_ratio,
       count(*) FILTER (WHERE ratio <= 1) AS profitable_months,
       count(*) FILTER (WHERE ratio > 1) AS unprofitable_months, count(*) AS months,
       round(stddev_samp(ratio), 6) AS std_loss_ratio,
       CASE WHEN stddev_samp(ratio) > 0.1 THEN 'seasonal variation' ELSE 'stability' END AS trend
FROM months""",
        MONTHS,
    ),
)
def monthly_trend_summary(spark, sf):
    return rounded(M.trend_summary(_months(spark, sf)), mean_loss_ratio=6, std_loss_ratio=6)


def _matrix(spark, sf, row="Province", column="VehicleType", k=10):
    return M.risk_matrix(
        policy_view(spark, sf, [row, column, "TotalClaims", "TotalPremium"]), row, column, k
    )


def _matrix_sql(row: str, column: str, k: int) -> str:
    return policy_sql(
        f"""SELECT {row}, {column}, {TOTALS} FROM policy
WHERE {column} IN (SELECT {column} FROM policy WHERE {column} IS NOT NULL
                   GROUP BY {column} ORDER BY count(*) DESC, {column} LIMIT {k})
  AND {row} IS NOT NULL
GROUP BY {row}, {column}"""
    )


@query("risk_matrix_province_vehicle", _matrix_sql("Province", "VehicleType", 10))
def risk_matrix_province_vehicle(spark, sf):
    return rounded(_matrix(spark, sf), total_claims=5, total_premium=5, loss_ratio=6)


@query("risk_matrix_bank_top_makes", _matrix_sql("Bank", "make", 10))
def risk_matrix_bank_top_makes(spark, sf):
    return rounded(
        _matrix(spark, sf, "Bank", "make"), total_claims=5, total_premium=5, loss_ratio=6
    )


@query(
    "risk_matrix_wide_gender",
    policy_sql(
        """SELECT Province,
  round(sum(TotalClaims) FILTER (WHERE Gender = 'F')
        / nullif(sum(TotalPremium) FILTER (WHERE Gender = 'F'), 0), 6) AS F,
  round(sum(TotalClaims) FILTER (WHERE Gender = 'O')
        / nullif(sum(TotalPremium) FILTER (WHERE Gender = 'O'), 0), 6) AS O
FROM policy GROUP BY Province"""
    ),
)
def risk_matrix_wide_gender(spark, sf):
    wide = M.risk_matrix_wide(_matrix(spark, sf, "Province", "Gender"), "Province", "Gender")
    return rounded(wide, F=6, O=6)


@query(
    "target_statistics",
    policy_sql(
        """SELECT round(avg(TotalClaims), 6) AS mean, round(median(TotalClaims), 6) AS median,
       round(max(TotalClaims), 6) AS "max", count(*) FILTER (WHERE TotalClaims > 0) AS positive,
       round(100.0 * count(*) FILTER (WHERE TotalClaims > 0) / count(*), 6) AS positive_pct
FROM policy"""
    ),
)
def target_statistics(spark, sf):
    stats = M.target_stats(policy_view(spark, sf, ["TotalClaims"]))
    return rounded(stats, mean=6, median=6, max=6, positive_pct=6)


@query(
    "row_loss_ratio",
    policy_sql(
        """SELECT PolicyID, LineNumber, PartKey,
       round(TotalClaims / (CASE WHEN TotalPremium = 0 THEN 1 ELSE TotalPremium END), 6)
         AS LossRatio FROM policy"""
    ),
)
def row_loss_ratio(spark, sf):
    keys = ["PolicyID", "LineNumber", "PartKey"]
    rows = policy_view(spark, sf, [*keys, "TotalClaims", "TotalPremium"])
    return rounded(M.row_ratio(rows), LossRatio=6).select(*keys, "LossRatio")
