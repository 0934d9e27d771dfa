"""Schema and data-quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweft.operators import profile as P
from riskweft.operators import sampling
from riskweft.plans.registry import policy_sql, query, rounded
from riskweft.sources.policy import POLICY_COLUMNS, policy_view
from riskweft.sources.schema import POLICY_SCHEMA_COLUMNS, validate_schema

TABLE = [c for c in POLICY_COLUMNS if c not in ("LineNumber", "PartKey")]
SMALL = [
    "PostalCode", "Province", "VehicleType", "Gender", "Bank", "CustomValueEstimate",
    "RegistrationYear", "TotalClaims",
]
TEXT = ["PostalCode", "Province", "VehicleType", "Gender", "Bank", "make"]


def _nulls(columns) -> str:
    return " + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in columns)


def _any_null(columns) -> str:
    return " OR ".join(f"{c} IS NULL" for c in columns)


def _summary_sql(columns) -> str:
    affected = " + ".join(
        f"(count(*) FILTER (WHERE {c} IS NULL) > 0)::BIGINT" for c in columns
    )
    return f"""SELECT n0 AS total_missing, round(100.0 * n0 / (n * {len(columns)}), 2)
    AS missing_percentage, affected AS columns_with_missing, bad AS rows_with_missing,
  round(100.0 * bad / n, 2) AS rows_with_missing_percentage, n - bad AS complete_rows,
  round(100.0 * (n - bad) / n, 2) AS complete_rows_percentage
FROM (SELECT count(*) AS n, {_nulls(columns)} AS n0, {affected} AS affected,
      count(*) FILTER (WHERE {_any_null(columns)}) AS bad FROM policy)"""


@query("missing_summary", policy_sql(_summary_sql(TABLE)))
def missing_summary(spark, sf):
    return P.missing_summary(policy_view(spark, sf, TABLE))


@query(
    "missing_by_column",
    policy_sql(
        "\nUNION ALL ".join(
            f"""SELECT '{c}' AS "column", count(*) FILTER (WHERE {c} IS NULL) AS missing,
  round(100.0 * count(*) FILTER (WHERE {c} IS NULL) / count(*), 2) AS missing_percentage
FROM policy"""
            for c in TABLE
        )
    ),
)
def missing_by_column(spark, sf):
    return P.missing_by_column(policy_view(spark, sf, TABLE))


@query(
    "missing_columns_above_threshold",
    policy_sql(
        """SELECT 'Bank' AS "column", count(*) FILTER (WHERE Bank IS NULL) AS missing,
  round(100.0 * count(*) FILTER (WHERE Bank IS NULL) / count(*), 2) AS missing_percentage
FROM policy"""
    ),
)
def missing_above(spark, sf):
    return P.missing_by_column(policy_view(spark, sf, TABLE), threshold=12.0)


@query(
    "schema_validation",
    policy_sql(
        """SELECT missing = 0 AS is_valid, missing::BIGINT AS missing_columns,
  extra::BIGINT AS extra_columns, total::BIGINT AS total_columns, 52::BIGINT AS expected_columns,
  round(100.0 * (52 - missing) / 52, 6) AS match_percentage,
  (SELECT count(*) FROM policy) AS "rows"
FROM (SELECT 52 - len(list_intersect(e, a)) AS missing, len(a) - len(list_intersect(e, a)) AS extra,
             len(a) AS total
      FROM (SELECT ["""
        + ", ".join(f"'{c}'" for c in POLICY_SCHEMA_COLUMNS)
        + """] AS e, (SELECT list(column_name) FROM (DESCRIBE policy)) AS a))"""
    ),
)
def schema_validation(spark, sf):
    report = validate_schema(policy_view(spark, sf))
    return report.select(
        "is_valid",
        F.size("missing_columns").cast("long").alias("missing_columns"),
        F.size("extra_columns").cast("long").alias("extra_columns"),
        "total_columns",
        "expected_columns",
        F.round("match_percentage", 6).alias("match_percentage"),
        "rows",
    )


def _info_sql(columns, numeric, text) -> str:
    return f"""SELECT n AS "rows", {len(columns)}::BIGINT AS "columns",
  {numeric}::BIGINT AS numeric_columns, {text}::BIGINT AS categorical_columns,
  n0 AS missing_values, round(100.0 * n0 / (n * {len(columns)}), 2) AS missing_percentage,
  n - d AS duplicate_rows
FROM (SELECT count(*) AS n, {_nulls(columns)} AS n0 FROM policy),
     (SELECT count(*) AS d FROM (SELECT DISTINCT {', '.join(columns)} FROM policy))"""


@query("table_info", policy_sql(_info_sql(SMALL, 3, 5)))
def table_info(spark, sf):
    return P.table_info(policy_view(spark, sf, SMALL))


@query(
    "processing_summary_after_features",
    policy_sql(
        """SELECT n AS "rows", 5::BIGINT AS "columns", 4::BIGINT AS numeric_columns,
  1::BIGINT AS categorical_columns, 0::BIGINT AS missing_values,
  0::DOUBLE AS missing_percentage, n - d AS duplicate_rows
FROM (SELECT count(*) AS n FROM policy), (SELECT count(*) AS d FROM (
  SELECT DISTINCT PolicyID, RegistrationYear, TotalClaims,
    CASE WHEN 2015 - RegistrationYear <= 3 THEN 1 WHEN 2015 - RegistrationYear <= 7 THEN 2
         WHEN 2015 - RegistrationYear <= 12 THEN 3 ELSE 4 END FROM policy))"""
    ),
)
def processing_summary(spark, sf):
    from riskweft.operators.features import derive_features

    rows = policy_view(spark, sf, ["PolicyID", "RegistrationYear", "TotalClaims"])
    return P.table_info(
        derive_features(rows, ["VehicleAge", "VehicleAgeGroup"], as_of_year=2015)
    )


@query(
    "preview_first_rows",
    policy_sql(
        """SELECT PolicyID, LineNumber, TransactionMonth, PartKey, PostalCode FROM policy
ORDER BY PolicyID, LineNumber, TransactionMonth, PartKey, PostalCode LIMIT 5"""
    ),
)
def preview_first_rows(spark, sf):
    columns = ["PolicyID", "LineNumber", "TransactionMonth", "PartKey", "PostalCode"]
    return sampling.preview(policy_view(spark, sf, columns), columns, 5)


@query("random_sample")
def random_sample(spark, sf):
    return sampling.sample_rows(policy_view(spark, sf, SMALL), 1000, seed=42)


@query(
    "random_sample_size",
    "SELECT least(count(*), 1000) AS sampled, count(*) AS total FROM lineitem",
)
def random_sample_size(spark, sf):
    rows = policy_view(spark, sf, ["PolicyID", "TotalPremium"])
    picked = sampling.sample_rows(rows, 1000, seed=42).agg(F.count(F.lit(1)).alias("sampled"))
    return picked.withColumn("total", rows.agg(F.count(F.lit(1))).scalar())


# Names of the same types on the two sides: fixed values.
_TYPE_NAMES = {
    "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string",
    "TIMESTAMP": "timestamp_ntz", "TIMESTAMP_NS": "timestamp_ntz", "DATE": "date",
}
_TYPES_SQL = (
    "SELECT column_name AS \"column\", CASE column_type "
    + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _TYPE_NAMES.items())
    + """ END AS dtype,
  CASE WHEN column_type = 'VARCHAR' THEN 'categorical' WHEN column_type LIKE 'TIMESTAMP%' OR column_type = 'DATE'
    THEN 'datetime' ELSE 'numerical' END AS role, present
FROM (DESCRIBE policy) JOIN (
"""
    + "\nUNION ALL ".join(
        f"SELECT '{c}' AS name, count({c}) AS present FROM policy" for c in POLICY_COLUMNS
    )
    + ") ON name = column_name"
)


@query("column_types", policy_sql(_TYPES_SQL))
def column_types(spark, sf):
    return P.column_types(policy_view(spark, sf))


@query(
    "type_distribution",
    policy_sql(
        f"""SELECT dtype, count(*) AS columns, sum(present)::BIGINT AS present
FROM ({_TYPES_SQL}) GROUP BY dtype"""
    ),
)
def type_distribution(spark, sf):
    return P.type_distribution(policy_view(spark, sf))


@query(
    "numeric_text_columns",
    policy_sql(
        """SELECT "column", 'string' AS current_type, 'numeric' AS suggested_type FROM (
"""
        + "\nUNION ALL ".join(
            f"""SELECT '{c}' AS "column", count({c}) > 0 AND
  count(*) FILTER (WHERE {c} IS NOT NULL AND TRY_CAST({c} AS DOUBLE) IS NULL) = 0 AS ok
FROM policy"""
            for c in TEXT
        )
        + ") WHERE ok"
    ),
)
def numeric_text_columns(spark, sf):
    return P.numeric_text_columns(policy_view(spark, sf, TEXT))


NUMBERS = ["TotalPremium", "TotalClaims", "SumInsured", "CustomValueEstimate", "Cylinders"]


@query(
    "value_ranges",
    policy_sql(
        "\nUNION ALL ".join(
            f"""SELECT '{c}' AS "column", CASE WHEN count({c}) = 0 THEN 'all_null' ELSE 'ok' END
    AS status, round(min({c})::DOUBLE, 6) AS "min", round(max({c})::DOUBLE, 6) AS "max",
  round(avg({c}), 6) AS mean, round(median({c})::DOUBLE, 6) AS median,
  round(stddev_samp({c}), 6) AS std, count(*) FILTER (WHERE {c} = 0) AS zeros,
  round(100.0 * count(*) FILTER (WHERE {c} = 0) / count({c}), 2) AS zeros_percentage,
  count(*) FILTER (WHERE {c} < 0) AS negatives,
  round(100.0 * count(*) FILTER (WHERE {c} < 0) / count({c}), 2) AS negatives_percentage,
  count({c}) AS non_null_count FROM policy"""
            for c in NUMBERS
        )
    ),
)
def value_ranges(spark, sf):
    digits = dict.fromkeys(["min", "max", "mean", "median", "std"], 6)
    return rounded(P.value_ranges(policy_view(spark, sf, NUMBERS)), **digits)


def _category_sql(c: str) -> str:
    return f"""SELECT '{c}' AS "column", count(*) AS unique_count,
  first(v ORDER BY n DESC, v) AS most_common, max(n) AS most_common_count,
  first(v ORDER BY n, v) AS least_common, min(n) AS least_common_count,
  round(count(*) / (SELECT count(*) FROM policy), 4) AS cardinality_ratio
FROM (SELECT {c} AS v, count(*) AS n FROM policy WHERE {c} IS NOT NULL GROUP BY 1)"""


@query("categorical_summary", policy_sql("\nUNION ALL ".join(_category_sql(c) for c in TEXT)))
def categorical_summary(spark, sf):
    return P.categorical_summary(policy_view(spark, sf, TEXT))


@query(
    "categorical_top_values",
    policy_sql(
        "\nUNION ALL ".join(
            f"""SELECT '{c}' AS "column", {c} AS value, count(*) AS "count",
  row_number() OVER (ORDER BY count(*) DESC, {c}) AS rank
FROM policy WHERE {c} IS NOT NULL GROUP BY {c} QUALIFY rank <= 10"""
            for c in TEXT
        )
    ),
)
def categorical_top_values(spark, sf):
    return P.top_values(policy_view(spark, sf, TEXT), top_n=10)


SCORE = f"""score AS (
  SELECT m, d, t, k, w, greatest(round(100 - least(m, 20) - least(d * 2, 15)
      - least(t * 2, 10), 2), 0) AS q
  FROM (SELECT round(100.0 * ({_nulls(SMALL)}) / (count(*) * {len(SMALL)}), 2) AS m,
               {' + '.join(f"(count(*) FILTER (WHERE {c} IS NULL) > 0)::BIGINT" for c in SMALL)} AS w,
               count(*) AS n FROM policy),
       (SELECT round(100.0 * sum(c - 1) / sum(c), 2) AS d, sum(c - 1)::BIGINT AS k FROM (
          SELECT count(*) AS c FROM policy GROUP BY {', '.join(SMALL)})),
       (SELECT (count(*) FILTER (WHERE TRY_CAST(PostalCode AS DOUBLE) IS NULL) = 0)::BIGINT AS t
        FROM policy))"""


@query(
    "quality_score",
    policy_sql(
        """SELECT m AS missing_percentage, d AS duplicate_percentage, t AS type_issues,
  q AS quality_score FROM score""",
        SCORE,
    ),
)
def quality_score(spark, sf):
    return P.quality_score(policy_view(spark, sf, SMALL))


@query(
    "quality_recommendations",
    policy_sql(
        """SELECT (row_number() OVER (ORDER BY i) - 1)::INTEGER AS position, recommendation FROM (
  SELECT 1 AS i, format('High share of missing values ({:.2f}%): impute or drop them.', m)
    AS recommendation FROM score WHERE m > 5
  UNION ALL SELECT 2, format('{} duplicate rows: review and remove.', k) FROM score WHERE k > 0
  UNION ALL SELECT 3, format('{} columns hold numbers as text: convert them.', t)
    FROM score WHERE t > 0
  UNION ALL SELECT 4, 'More than half of the columns miss values: check the source.'
    FROM score WHERE w > 8 * 0.5)""",
        SCORE,
    ),
)
def quality_recommendations(spark, sf):
    return P.recommendations(policy_view(spark, sf, SMALL))


@query(
    "quality_report",
    policy_sql(
        """SELECT section, "column", metric, value::DOUBLE AS value FROM (
  SELECT 'quality_score' AS section, NULL AS "column", 'quality_score' AS metric, q AS value FROM score
  UNION ALL SELECT 'overview', NULL, 'rows', count(*) FROM policy
  UNION ALL SELECT 'overview', NULL, 'columns', 8
  UNION ALL SELECT 'duplicates', NULL, 'duplicate_count', k FROM score
  UNION ALL SELECT 'duplicates', NULL, 'duplicate_percentage', d FROM score
  UNION ALL SELECT 'duplicates', NULL, 'unique_count', (SELECT count(*) FROM policy) - k FROM score
  UNION ALL SELECT 'duplicates', NULL, 'unique_percentage',
    round(100.0 * ((SELECT count(*) FROM policy) - k) / (SELECT count(*) FROM policy), 2) FROM score
"""
        + "".join(
            f"""  UNION ALL SELECT 'missing_by_column', '{c}', 'missing',
    count(*) FILTER (WHERE {c} IS NULL) FROM policy
  UNION ALL SELECT 'missing_by_column', '{c}', 'missing_percentage',
    round(100.0 * count(*) FILTER (WHERE {c} IS NULL) / count(*), 2) FROM policy
"""
            for c in ("Bank", "CustomValueEstimate")
        )
        + f"""  UNION ALL SELECT 'categorical', c, 'unique_count', n FROM ({' UNION ALL '.join(
            f"SELECT '{c}' AS c, count(DISTINCT {c}) AS n FROM policy" for c in SMALL[:5])})
)""",
        SCORE,
    ),
)
def quality_report(spark, sf):
    report = P.quality_report(policy_view(spark, sf, SMALL).persist())
    part = F.col("section").isin("overview", "quality_score", "duplicates", "missing_by_column")
    part = part | ((F.col("section") == "categorical") & (F.col("metric") == "unique_count"))
    return report.filter(part).withColumn("value", F.col("value").try_cast("double"))


@query("quality_report_text")
def quality_report_text(spark, sf):
    return P.quality_report(policy_view(spark, sf, SMALL).persist())
