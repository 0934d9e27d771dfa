"""Filters, missing values, outliers, duplicates and derived features."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweft.operators import dedupe, features, filters, missing, outliers
from riskweft.plans.registry import policy_sql, query, rounded
from riskweft.sources.policy import policy_view, read_table

KEYS = ["PolicyID", "LineNumber", "PartKey", "PostalCode"]
KEY_LIST = ", ".join(KEYS)


# --- filters ---------------------------------------------------------------------

_FILTERS = {
    "filter_greater": ({"TotalPremium": (">", 500)}, "TotalPremium > 500"),
    "filter_greater_equal": ({"RegistrationYear": (">=", 2000)}, "RegistrationYear >= 2000"),
    "filter_less": ({"TotalClaims": ("<", 100.0)}, "TotalClaims < 100"),
    "filter_less_equal": ({"Cylinders": ("<=", 10)}, "Cylinders <= 10"),
    "filter_equal": ({"Gender": ("==", "F")}, "Gender = 'F'"),
    "filter_not_equal_keeps_nulls": (
        {"Bank": ("!=", "BUILDING")},
        "Bank IS DISTINCT FROM 'BUILDING'",
    ),
    "filter_in": ({"Country": ("in", ["ASIA", "EUROPE"])}, "Country IN ('ASIA', 'EUROPE')"),
    "filter_not_in_keeps_nulls": (
        {"Bank": ("not_in", ["BUILDING", "MACHINERY"])},
        "Bank IS NULL OR Bank NOT IN ('BUILDING', 'MACHINERY')",
    ),
    "filter_between": (
        {"RegistrationYear": ("between", (1996, 1998))},
        "RegistrationYear BETWEEN 1996 AND 1998",
    ),
    "filter_is_null": ({"CustomValueEstimate": ("is_null", None)}, "CustomValueEstimate IS NULL"),
    "filter_not_null": ({"Bank": ("not_null", None)}, "Bank IS NOT NULL"),
    "filter_conjunction": (
        {
            "TotalPremium": (">", 200),
            "Bank": ("!=", "BUILDING"),
            "NoSuchColumn": (">", 1),
            "RegistrationYear": ("between", (1996, 1999)),
        },
        "TotalPremium > 200 AND Bank IS DISTINCT FROM 'BUILDING' "
        "AND RegistrationYear BETWEEN 1996 AND 1999",
    ),
}


def _filter(name, conditions, where):
    shown = KEYS + [c for c in conditions if c != "NoSuchColumn"]
    sql = policy_sql(f"SELECT {', '.join(shown)} FROM policy WHERE {where}")

    @query(name, sql)
    def run(spark, sf):
        return filters.filter_rows(policy_view(spark, sf, shown), conditions)


for _name, (_conditions, _where) in _FILTERS.items():
    _filter(_name, _conditions, _where)


@query(
    "filter_by_computed_list",
    policy_sql(
        f"""SELECT {KEY_LIST}, make FROM policy WHERE make IN (
  SELECT make FROM policy GROUP BY make
  HAVING sum(TotalClaims) > sum(TotalPremium))"""
    ),
)
def filter_by_computed_list(spark, sf):
    from riskweft.operators.metrics import segment_totals

    rows = policy_view(spark, sf, [*KEYS, "make", "TotalClaims", "TotalPremium"])
    losing = segment_totals(rows, ["make"]).filter(
        F.col("total_claims") > F.col("total_premium")
    )
    return filters.keep_listed(rows, "make", losing.select("make")).select(*KEYS, "make")


# --- missing values ----------------------------------------------------------------

NULLABLE = ["CustomValueEstimate", "Bank"]


def _nullable(spark, sf, *more):
    return policy_view(spark, sf, [*KEYS, *NULLABLE, *more])


@query(
    "missing_drop_rows",
    policy_sql(
        f"""SELECT {KEY_LIST}, CustomValueEstimate, Bank FROM policy
WHERE CustomValueEstimate IS NOT NULL AND Bank IS NOT NULL"""
    ),
)
def missing_drop_rows(spark, sf):
    return missing.handle_missing(_nullable(spark, sf), "drop", columns=NULLABLE)


@query(
    "missing_fill_constant",
    policy_sql(
        f"""SELECT {KEY_LIST}, coalesce(CustomValueEstimate, -999) AS CustomValueEstimate,
       coalesce(Bank, '-999') AS Bank FROM policy"""
    ),
)
def missing_fill_constant(spark, sf):
    return missing.handle_missing(
        _nullable(spark, sf), "fill", fill_value=-999, columns=NULLABLE
    )


MODE = """(SELECT {c} FROM policy WHERE {c} IS NOT NULL
  GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"""

_NUMERIC = {
    "mean": "(SELECT avg(CustomValueEstimate) FROM policy)",
    "median": "(SELECT median(CustomValueEstimate) FROM policy)",
    "mode": MODE.format(c="CustomValueEstimate"),
    "zero": "0",
}


def _impute(strategy, value):
    sql = policy_sql(
        f"""SELECT {KEY_LIST},
       round(coalesce(CustomValueEstimate, {value}), 6) AS CustomValueEstimate,
       coalesce(Bank, {MODE.format(c="Bank")}) AS Bank FROM policy"""
    )

    @query(f"impute_numeric_{strategy}", sql)
    def run(spark, sf):
        out = missing.handle_missing(_nullable(spark, sf), numeric_strategy=strategy)
        return rounded(out, CustomValueEstimate=6)


for _strategy, _value in _NUMERIC.items():
    _impute(_strategy, _value)


@query(
    "impute_categorical_constant",
    policy_sql(f"SELECT {KEY_LIST}, coalesce(Bank, 'Unknown') AS Bank FROM policy"),
)
def impute_categorical_constant(spark, sf):
    out = missing.handle_missing(
        policy_view(spark, sf, [*KEYS, "Bank"]), categorical_strategy="constant"
    )
    return out


def _fill(name, backward, partitioned):
    function, order = ("first_value", "") if backward else ("last_value", "")
    frame = (
        "ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING"
        if backward
        else "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    )
    keys = ["TransactionMonth", *KEYS]
    part = "PARTITION BY PolicyID " if partitioned else ""

    def filled(c):
        return (
            f"{function}({c} IGNORE NULLS) OVER "
            f"({part}ORDER BY {', '.join(keys)} {frame}) AS {c}"
        )

    sql = policy_sql(
        f"SELECT {', '.join(keys)}, {filled('CustomValueEstimate')}, {filled('Bank')} FROM policy"
    )
    way = "backward_fill" if backward else "forward_fill"

    @query(name, sql)
    def run(spark, sf):
        return missing.handle_missing(
            policy_view(spark, sf, [*keys, *NULLABLE]),
            numeric_strategy=way,
            categorical_strategy=way,
            columns=NULLABLE,
            order_by=keys,
            partition_by=["PolicyID"] if partitioned else (),
        )


_fill("forward_fill_over_time", False, False)
_fill("backward_fill_over_time", True, False)
_fill("forward_fill_by_policy", False, True)
_fill("backward_fill_by_policy", True, True)


@query(
    "missing_before_after",
    policy_sql(
        """SELECT 'before' AS stage,
  CAST(count(*) * 2 - count(CustomValueEstimate) - count(Bank) AS BIGINT) AS missing FROM policy
UNION ALL SELECT 'after', CAST(0 AS BIGINT)"""
    ),
)
def missing_before_after(spark, sf):
    rows = _nullable(spark, sf)
    return missing.missing_before_after(rows, missing.handle_missing(rows), NULLABLE)


# --- outliers ----------------------------------------------------------------------

AMOUNTS = ["TotalPremium", "TotalClaims", "SumInsured"]


def _bounds_sql(c: str, method: str, limit: float, population: bool = False) -> str:
    """A CTE ``b_<column>`` with the limits ``lo`` and ``hi``."""
    if method == "iqr":
        inner = f"""SELECT quantile_cont({c}, 0.25) - {limit} * (quantile_cont({c}, 0.75)
    - quantile_cont({c}, 0.25)) AS lo, quantile_cont({c}, 0.75) + {limit}
    * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS hi FROM policy"""
    elif method == "percentile":
        inner = f"SELECT quantile_cont({c}, 0.01) AS lo, quantile_cont({c}, 0.99) AS hi FROM policy"
    elif method == "zscore":
        std = "stddev_pop" if population else "stddev_samp"
        inner = f"""SELECT avg({c}) - {limit} * {std}({c}) AS lo,
    avg({c}) + {limit} * {std}({c}) AS hi FROM policy"""
    else:
        inner = f"""SELECT CASE WHEN d = 0 THEN NULL ELSE m - {limit} * d / 0.6745 END AS lo,
    CASE WHEN d = 0 THEN NULL ELSE m + {limit} * d / 0.6745 END AS hi FROM (
    SELECT m, median(abs({c} - m)) AS d FROM policy, (SELECT median({c}) AS m FROM policy)
    GROUP BY m)"""
    return f"b_{c} AS ({inner})"


def _cap(method, limit):
    capped = ", ".join(
        f"""round(CASE WHEN {c} < b_{c}.lo THEN b_{c}.lo
  WHEN {c} > b_{c}.hi THEN b_{c}.hi ELSE {c} END, 6) AS {c}"""
        for c in AMOUNTS
    )
    sql = policy_sql(
        f"SELECT {KEY_LIST}, {capped} FROM policy, {', '.join('b_' + c for c in AMOUNTS)}",
        *[_bounds_sql(c, method, limit) for c in AMOUNTS],
    )

    @query(f"outliers_cap_{method}", sql)
    def run(spark, sf):
        rows = policy_view(spark, sf, [*KEYS, *AMOUNTS])
        out = outliers.treat_outliers(
            rows, method, "cap", AMOUNTS, threshold=limit, z_threshold=limit
        )
        return rounded(out, **dict.fromkeys(AMOUNTS, 6))


for _method, _limit in (
    ("iqr", 1.5), ("zscore", 3.0), ("modified_zscore", 1.2), ("percentile", 0)
):
    _cap(_method, _limit)


@query(
    "outliers_remove_sequential",
    policy_sql(
        f"SELECT {KEY_LIST}, TotalClaims, SumInsured FROM two",
        """one AS (SELECT * FROM policy, (SELECT quantile_cont(TotalClaims, 0.25) AS q1,
    quantile_cont(TotalClaims, 0.75) AS q3 FROM policy)
  WHERE TotalClaims BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))""",
        """two AS (SELECT one.* FROM one, (SELECT quantile_cont(SumInsured, 0.25) AS a,
    quantile_cont(SumInsured, 0.75) AS b FROM one)
  WHERE SumInsured BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a))""",
    ),
)
def outliers_remove_sequential(spark, sf):
    rows = policy_view(spark, sf, [*KEYS, "TotalClaims", "SumInsured"])
    return outliers.treat_outliers(rows, "iqr", "remove", ["TotalClaims", "SumInsured"])


@query(
    "outliers_log_transform",
    policy_sql(
        f"""SELECT {KEY_LIST}, round(TotalPremium, 6) AS TotalPremium,
       round(ln(CASE WHEN low <= 0 THEN TotalClaims - low + 1 ELSE TotalClaims END), 6)
         AS TotalClaims
FROM policy, (SELECT min(TotalClaims) AS low FROM policy)"""
    ),
)
def outliers_log_transform(spark, sf):
    rows = policy_view(spark, sf, [*KEYS, "TotalPremium", "TotalClaims"])
    out = outliers.treat_outliers(
        rows, "iqr", "log_transform", ["TotalPremium", "TotalClaims"]
    )
    return rounded(out, TotalPremium=6, TotalClaims=6)


def _detect(method, limit):
    parts = [
        f"""SELECT {KEY_LIST}, '{c}' AS "column", CAST({c} AS DOUBLE) AS value,
  count(*) OVER () AS "count",
  round(100.0 * count(*) OVER () / (SELECT count({c}) FROM policy), 6) AS percentage
FROM policy, b_{c} WHERE {c} < b_{c}.lo OR {c} > b_{c}.hi"""
        for c in AMOUNTS
    ]
    sql = policy_sql(
        "\nUNION ALL ".join(parts),
        *[_bounds_sql(c, method, limit, population=True) for c in AMOUNTS],
    )

    @query(f"outliers_detect_{method}", sql)
    def run(spark, sf):
        rows = policy_view(spark, sf, [*KEYS, *AMOUNTS])
        out = outliers.detect_outliers(rows, AMOUNTS, method, limit, keys=KEYS)
        return rounded(out, percentage=6)


for _method, _limit in (("iqr", 1.5), ("zscore", 2.0), ("modified_zscore", 1.3)):
    _detect(_method, _limit)


def _report_sql(c: str) -> str:
    return f"""SELECT '{c}' AS "column", count(*) FILTER (WHERE o) AS outlier_count,
  round(100.0 * count(*) FILTER (WHERE o) / count({c}), 2) AS outlier_percentage,
  round(any_value(lo), 6) AS lower_bound, round(any_value(hi), 6) AS upper_bound,
  round(quantile_cont({c}, 0.25), 6) AS Q1, round(quantile_cont({c}, 0.75), 6) AS Q3,
  round(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 6) AS IQR,
  round(min({c}) FILTER (WHERE o), 6) AS min_outlier,
  round(max({c}) FILTER (WHERE o), 6) AS max_outlier
FROM (SELECT {c}, lo, hi, {c} < lo OR {c} > hi AS o FROM policy, b_{c})"""


@query(
    "outlier_report",
    policy_sql(
        "\nUNION ALL ".join(_report_sql(c) for c in [*AMOUNTS, "CustomValueEstimate"]),
        *[_bounds_sql(c, "iqr", 1.5) for c in [*AMOUNTS, "CustomValueEstimate"]],
    ),
)
def outlier_report(spark, sf):
    names = [*AMOUNTS, "CustomValueEstimate"]
    out = outliers.outlier_report(policy_view(spark, sf, names), names)
    digits = dict.fromkeys(
        ["lower_bound", "upper_bound", "Q1", "Q3", "IQR", "min_outlier", "max_outlier"], 6
    )
    return rounded(out, **digits)


def _methods_sql(c: str) -> str:
    def n(method, limit):
        bounds = _bounds_sql(c, method, limit, True).split(" AS ", 1)[1]
        return f"(SELECT count(*) FROM policy, {bounds} b WHERE {c} < b.lo OR {c} > b.hi)"

    return (
        f"SELECT '{c}' AS \"column\", {n('iqr', 1.5)} AS iqr, {n('zscore', 3.0)} AS zscore, "
        f"{n('modified_zscore', 3.5)} AS modified_zscore"
    )


@query(
    "outlier_method_comparison",
    policy_sql(
        "SELECT * FROM ("
        + "\nUNION ALL ".join(_methods_sql(c) for c in AMOUNTS)
        + ") WHERE iqr + zscore + modified_zscore > 0"
    ),
)
def outlier_method_comparison(spark, sf):
    return outliers.compare_methods(policy_view(spark, sf, AMOUNTS))


@query(
    "claims_beyond_three_deviations",
    policy_sql(
        f"""SELECT {KEY_LIST}, TotalClaims FROM policy,
  (SELECT avg(TotalClaims) AS m, stddev_samp(TotalClaims) AS s FROM policy)
WHERE abs(TotalClaims - m) > 3 * s"""
    ),
)
def claims_beyond_three_deviations(spark, sf):
    return outliers.beyond_deviations(
        policy_view(spark, sf, [*KEYS, "TotalClaims"]), "TotalClaims"
    )


# --- duplicates ----------------------------------------------------------------------

LINE = ["PolicyID", "LineNumber"]
FULL = [*KEYS, "TransactionMonth", "TotalPremium", "Gender"]
RANKING = ["TransactionMonth", *[c for c in FULL if c != "TransactionMonth"]]
SEGMENT = ["PostalCode", "TransactionMonth", "Gender"]


@query(
    "dedupe_whole_row",
    policy_sql("SELECT DISTINCT PostalCode, TransactionMonth, Gender FROM policy"),
)
def dedupe_whole_row(spark, sf):
    return dedupe.remove_duplicates(policy_view(spark, sf, SEGMENT))


def _dedupe(keep):
    down = " DESC" if keep == "last" else ""
    order = ", ".join(c + down for c in RANKING)
    sql = policy_sql(
        f"""SELECT {', '.join(FULL)} FROM policy
QUALIFY row_number() OVER (PARTITION BY PolicyID, LineNumber ORDER BY {order}) = 1"""
    )

    @query(f"dedupe_keep_{keep}", sql)
    def run(spark, sf):
        return dedupe.remove_duplicates(
            policy_view(spark, sf, FULL), LINE, keep, order_by=["TransactionMonth"]
        )


_dedupe("first")
_dedupe("last")


@query(
    "dedupe_keep_none",
    policy_sql(
        f"""SELECT {', '.join(FULL)} FROM policy
QUALIFY count(*) OVER (PARTITION BY PolicyID, LineNumber) = 1"""
    ),
)
def dedupe_keep_none(spark, sf):
    return dedupe.remove_duplicates(policy_view(spark, sf, FULL), LINE, False)


def _duplicate_report(name, keep, extra):
    sql = policy_sql(
        f"""SELECT CAST(d AS BIGINT) AS duplicate_count,
  round(100.0 * d / n, 2) AS duplicate_percentage, CAST(n - d AS BIGINT) AS unique_count,
  round(100.0 * (n - d) / n, 2) AS unique_percentage
FROM (SELECT sum({extra}) AS d, sum(k) AS n FROM (
  SELECT count(*) AS k FROM policy GROUP BY PolicyID, LineNumber))"""
    )

    @query(name, sql)
    def run(spark, sf):
        return dedupe.duplicate_report(policy_view(spark, sf, LINE), LINE, keep)


_duplicate_report("duplicate_report_first", "first", "k - 1")
_duplicate_report("duplicate_report_all_members", False, "CASE WHEN k > 1 THEN k ELSE 0 END")


@query(
    "duplicate_rows_by_key",
    policy_sql(
        f"""SELECT {', '.join(FULL)} FROM policy
QUALIFY row_number() OVER (PARTITION BY PolicyID, LineNumber ORDER BY {', '.join(RANKING)}) > 1"""
    ),
)
def duplicate_rows_by_key(spark, sf):
    return dedupe.duplicate_rows(
        policy_view(spark, sf, FULL), LINE, "first", order_by=["TransactionMonth"]
    )


@query(
    "duplicate_rows_exact_copies",
    policy_sql(
        """SELECT PostalCode, TransactionMonth, Gender FROM policy
QUALIFY row_number() OVER (PARTITION BY PostalCode, TransactionMonth, Gender) > 1"""
    ),
)
def duplicate_rows_exact_copies(spark, sf):
    return dedupe.duplicate_rows(policy_view(spark, sf, SEGMENT))


# --- derived features ----------------------------------------------------------------

FEATURE_INPUT = [
    *KEYS, "RegistrationYear", "TotalClaims", "TotalPremium", "SumInsured", "TransactionMonth",
]


@query(
    "derived_features",
    policy_sql(
        f"""SELECT {KEY_LIST}, greatest(2015 - RegistrationYear, 0)::INTEGER AS VehicleAge,
  (TotalClaims > 0)::INTEGER AS HasClaim,
  round(TotalClaims / nullif(TotalPremium, 0), 6) AS LossRatio,
  round(TotalPremium / nullif(SumInsured, 0), 6) AS PremiumPerSumInsured,
  round(f, 6) AS ClaimFrequency, round(a, 9) AS AvgClaimAmount,
  (SumInsured > (SELECT quantile_cont(SumInsured, 0.75) FROM policy))::INTEGER AS IsHighValue,
  year(TransactionMonth)::INTEGER AS TransactionYear,
  quarter(TransactionMonth)::INTEGER AS TransactionQuarter,
  CASE WHEN age > -1 AND age <= 3 THEN 'New (0-3)' WHEN age > 3 AND age <= 7 THEN 'Mid (4-7)'
       WHEN age > 7 AND age <= 12 THEN 'Old (8-12)'
       WHEN age > 12 AND age <= 100 THEN 'Very Old (13+)' END AS VehicleAgeGroup
FROM (SELECT *, greatest(2015 - RegistrationYear, 0) AS age FROM policy)
LEFT JOIN (SELECT PolicyID AS k, avg((TotalClaims > 0)::INTEGER) AS f, avg(TotalClaims) AS a
           FROM policy GROUP BY PolicyID) ON PolicyID = k"""
    ),
)
def derived_features(spark, sf):
    out = features.derive_features(policy_view(spark, sf, FEATURE_INPUT), as_of_year=2015)
    digits = dict.fromkeys(["LossRatio", "PremiumPerSumInsured", "ClaimFrequency"], 6)
    return rounded(out, **digits, AvgClaimAmount=9).select(*KEYS, *features.FEATURES)


@query(
    "derived_features_skip_absent_inputs",
    policy_sql(f"SELECT {KEY_LIST}, (TotalClaims > 0)::INTEGER AS HasClaim FROM policy"),
)
def derived_features_skip(spark, sf):
    rows = policy_view(spark, sf, [*KEYS, "TotalClaims"])
    out = features.derive_features(rows, ["HasClaim", "VehicleAge", "LossRatio"])
    return out.drop("TotalClaims")


@query(
    "event_duplicates_none",
    """SELECT CAST(count(*) - count(DISTINCT event_id) AS BIGINT) AS duplicate_count,
  CAST(0 AS DOUBLE) AS duplicate_percentage, count(DISTINCT event_id) AS unique_count,
  CAST(100 AS DOUBLE) AS unique_percentage FROM events""",
)
def event_duplicates(spark, sf):
    return dedupe.duplicate_report(read_table(spark, sf, "events"), ["event_id"])
