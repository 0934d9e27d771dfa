"""Descriptive, bivariate and multivariate queries, and the hypothesis tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweft.operators import describe as D
from riskweft.operators import hypothesis as H
from riskweft.operators import matrix as X
from riskweft.operators import relate as R
from riskweft.plans.registry import policy_sql, query, rounded
from riskweft.sources.policy import policy_view

NUMBERS = [
    "TotalPremium", "TotalClaims", "SumInsured", "CustomValueEstimate", "RegistrationYear",
    "Cylinders",
]
DESCRIBE_DIGITS = {
    "mean": 6, "std": 4, "min": 6, "p25": 6, "p50": 6, "p75": 6, "max": 6, "median": 6,
    "range": 6, "variance": 1, "skewness": 6, "kurtosis": 6, "missing_pct": 6,
}


def _describe_sql(c: str, more: str = "") -> str:
    return f"""SELECT '{c}' AS "column", count({c}) AS "count", round(avg({c}), 6) AS mean,
  round(stddev_samp({c}), 4) AS std, round(min({c})::DOUBLE, 6) AS "min",
  round(quantile_cont({c}, 0.25)::DOUBLE, 6) AS p25, round(median({c})::DOUBLE, 6) AS p50,
  round(quantile_cont({c}, 0.75)::DOUBLE, 6) AS p75, round(max({c})::DOUBLE, 6) AS "max",
  round(median({c})::DOUBLE, 6) AS median, round((max({c}) - min({c}))::DOUBLE, 6) AS "range",
  round(var_samp({c}), 1) AS variance, round(skewness({c}), 6) AS skewness,
  round(kurtosis({c}), 6) AS kurtosis, count(*) - count({c}) AS missing,
  round(100.0 * (count(*) - count({c})) / count(*), 6) AS missing_pct {more} FROM policy"""


@query("describe_numeric", policy_sql("\nUNION ALL ".join(_describe_sql(c) for c in NUMBERS)))
def describe_numeric(spark, sf):
    return rounded(D.describe_numeric(policy_view(spark, sf, NUMBERS)), **DESCRIBE_DIGITS)


@query(
    "univariate_numeric",
    policy_sql(
        _describe_sql(
            "SumInsured",
            """, (SELECT round(SumInsured, 6) FROM policy GROUP BY SumInsured
  ORDER BY count(*) DESC, SumInsured LIMIT 1) AS mode""",
        )
    ),
)
def univariate_numeric(spark, sf):
    out = D.univariate_numeric(policy_view(spark, sf, ["SumInsured"]), "SumInsured")
    return rounded(out, **DESCRIBE_DIGITS, mode=6)


TEXT = ["Province", "VehicleType", "Gender", "Bank", "PostalCode"]


def _category_sql(c: str) -> str:
    return f"""SELECT '{c}' AS "column", coalesce(sum(n) FILTER (WHERE v IS NOT NULL), 0)::BIGINT
    AS "count", count(v) AS "unique", first(v ORDER BY v IS NULL, n DESC, v) AS top,
  max(n) FILTER (WHERE v IS NOT NULL) AS freq,
  round(100.0 * max(n) FILTER (WHERE v IS NOT NULL)
        / sum(n) FILTER (WHERE v IS NOT NULL), 6) AS top_pct,
  coalesce(sum(n) FILTER (WHERE v IS NULL), 0)::BIGINT AS missing,
  round(100.0 * coalesce(sum(n) FILTER (WHERE v IS NULL), 0) / sum(n), 6) AS missing_pct
FROM (SELECT {c} AS v, count(*) AS n FROM policy GROUP BY 1)"""


@query("describe_categorical", policy_sql("\nUNION ALL ".join(_category_sql(c) for c in TEXT)))
def describe_categorical(spark, sf):
    out = D.describe_categorical(policy_view(spark, sf, TEXT))
    return rounded(out, top_pct=6, missing_pct=6)


@query("univariate_categorical", policy_sql(_category_sql("Bank")))
def univariate_categorical(spark, sf):
    out = D.univariate_categorical(policy_view(spark, sf, ["Bank"]), "Bank")
    return rounded(out, top_pct=6, missing_pct=6)


@query(
    "percentile_ladder",
    policy_sql(
        "\nUNION ALL ".join(
            f"SELECT {p}::INTEGER AS percentile, "
            f"round(quantile_cont(TotalPremium, {p / 100}), 6) AS value FROM policy"
            for p in D.LADDER
        )
    ),
)
def percentile_ladder(spark, sf):
    out = D.percentile_ladder(policy_view(spark, sf, ["TotalPremium"]), "TotalPremium")
    return rounded(out, value=6)


def _counts_sql(c: str) -> str:
    return policy_sql(
        f"""SELECT {c} AS value, count(*) AS "count",
  round(100.0 * count(*) / (SELECT count({c}) FROM policy), 6) AS percentage
FROM policy WHERE {c} IS NOT NULL GROUP BY {c}"""
    )


@query("value_counts_bank", _counts_sql("Bank"))
def value_counts_bank(spark, sf):
    return rounded(D.value_counts(policy_view(spark, sf, ["Bank"]), "Bank"), percentage=6)


@query("value_counts_postal_code", _counts_sql("PostalCode"))
def value_counts_postal_code(spark, sf):
    out = D.value_counts(policy_view(spark, sf, ["PostalCode"]), "PostalCode")
    return rounded(out, percentage=6)


@query(
    "normality_jarque_bera",
    policy_sql(
        """SELECT 'Jarque-Bera' AS test, n, round(jb, 4) AS statistic,
  round(exp(-jb / 2), 6) AS p_value, exp(-jb / 2) > 0.05 AS is_normal
FROM (SELECT n, n / 6 * (g1 * g1 + g2 * g2 / 4) AS jb FROM (
  SELECT n, m3 / power(m2, 1.5) AS g1, m4 / (m2 * m2) - 3 AS g2 FROM (
    SELECT count(*) AS n, avg(power(SumInsured - m, 2)) AS m2,
           avg(power(SumInsured - m, 3)) AS m3, avg(power(SumInsured - m, 4)) AS m4
    FROM policy, (SELECT avg(SumInsured) AS m FROM policy))))"""
    ),
)
def normality_jarque_bera(spark, sf):
    out = D.jarque_bera(policy_view(spark, sf, ["SumInsured"]), "SumInsured")
    return rounded(out, statistic=4, p_value=6)


@query("normality_shapiro_sample")
def normality_shapiro_sample(spark, sf):
    return D.shapiro_test(policy_view(spark, sf, ["TotalPremium"]), "TotalPremium")


# --- two columns -----------------------------------------------------------------------


def ranked_sql(x: str, y: str) -> str:
    return f"""ranked AS (
  SELECT x, y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx,
         rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry
  FROM (SELECT {x} AS x, {y} AS y FROM policy WHERE {x} IS NOT NULL AND {y} IS NOT NULL))"""


STRENGTH = """CASE WHEN abs({r}) >= 0.9 THEN 'Very Strong' WHEN abs({r}) >= 0.7 THEN 'Strong'
  WHEN abs({r}) >= 0.5 THEN 'Moderate' WHEN abs({r}) >= 0.3 THEN 'Weak' ELSE 'Very Weak' END
  || CASE WHEN {r} >= 0 THEN ' Positive' ELSE ' Negative' END"""

# Tail probabilities by Simpson's rule: an independent way to check the p-values.
SIMPSON = """(SELECT sum(CASE WHEN i = 0 OR i = 20000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END
    * {density}) * ({upper}) / 60000 FROM range(0, 20001) AS g(i))"""


def t_p_sql(t: str, dof: str) -> str:
    u = f"(i * abs({t}) / 20000)"
    density = (
        f"exp(lgamma(({dof} + 1) / 2) - lgamma({dof} / 2) - 0.5 * ln(pi() * {dof})"
        f" - ({dof} + 1) / 2 * ln(1 + {u} * {u} / {dof}))"
    )
    return f"(1 - 2 * {SIMPSON.format(density=density, upper=f'abs({t})')})"


def chi2_p_sql(x: str, dof: str) -> str:
    u = f"(i * {x} / 20000)"
    density = (
        f"CASE WHEN i = 0 THEN 0 ELSE exp(({dof} / 2 - 1) * ln({u}) - {u} / 2"
        f" - {dof} / 2 * ln(2) - lgamma({dof} / 2)) END"
    )
    return f"(1 - {SIMPSON.format(density=density, upper=x)})"


def chi2_one_p_sql(x: str) -> str:
    u = f"(i * sqrt({x}) / 20000)"
    density = f"exp(-{u} * {u} / 2) / sqrt(2 * pi())"
    return f"(1 - 2 * {SIMPSON.format(density=density, upper=f'sqrt({x})')})"


def f_p_sql(f: str, d1: str, d2: str) -> str:
    u = f"(i * {f} / 20000)"
    density = (
        f"CASE WHEN i = 0 THEN 0 ELSE exp(lgamma(({d1} + {d2}) / 2) - lgamma({d1} / 2)"
        f" - lgamma({d2} / 2) + {d1} / 2 * ln({d1} / {d2}) + ({d1} / 2 - 1) * ln({u})"
        f" - ({d1} + {d2}) / 2 * ln(1 + {d1} / {d2} * {u})) END"
    )
    return f"(1 - {SIMPSON.format(density=density, upper=f)})"


def _correlation(name, x, y):
    t = "({r} * sqrt((n - 2) / (1 - {r} * {r})))"
    sql = policy_sql(
        f"""SELECT n, round(r, 6) AS pearson, round(s, 6) AS spearman,
  round({t_p_sql(t.format(r='r'), '(n - 2)')}, 6) AS pearson_p_value,
  round({t_p_sql(t.format(r='s'), '(n - 2)')}, 6) AS spearman_p_value,
  {STRENGTH.format(r='r')} AS relationship_strength
FROM (SELECT count(*) AS n, corr(x, y) AS r, corr(rx, ry) AS s FROM ranked)""",
        ranked_sql(x, y),
    )

    @query(name, sql)
    def run(spark, sf):
        out = R.correlation(policy_view(spark, sf, [x, y]), x, y)
        return rounded(out, pearson=6, spearman=6, pearson_p_value=6, spearman_p_value=6)


_correlation("correlation_premium_estimate", "TotalPremium", "CustomValueEstimate")
_correlation("correlation_year_cylinders", "RegistrationYear", "Cylinders")


@query(
    "correlation_premium_claims",
    policy_sql(
        f"""SELECT n, round(r, 6) AS pearson, round(s, 6) AS spearman,
  {STRENGTH.format(r='r')} AS relationship_strength
FROM (SELECT count(*) AS n, corr(x, y) AS r, corr(rx, ry) AS s FROM ranked)""",
        ranked_sql("TotalPremium", "TotalClaims"),
    ),
)
def correlation_premium_claims(spark, sf):
    rows = policy_view(spark, sf, ["TotalPremium", "TotalClaims"])
    out = R.correlation(rows, "TotalPremium", "TotalClaims", p_values=False)
    return rounded(out, pearson=6, spearman=6)


def _group_statistics(name, number, category):
    sql = policy_sql(
        f"""SELECT {category} AS category, count({number}) AS "count",
  round(avg({number}), 6) AS mean, round(median({number}), 6) AS median,
  round(stddev_samp({number}), 6) AS std, round(min({number}), 6) AS "min",
  round(max({number}), 6) AS "max"
FROM policy WHERE {category} IS NOT NULL GROUP BY {category}"""
    )

    @query(name, sql)
    def run(spark, sf):
        out = R.group_statistics(policy_view(spark, sf, [number, category]), number, category)
        return rounded(out, mean=6, median=6, std=6, min=6, max=6)


_group_statistics("premium_statistics_by_province", "TotalPremium", "Province")
_group_statistics("value_statistics_by_bank", "CustomValueEstimate", "Bank")


def anova_cte(group: str, value: str, where: str, at_least: int, name: str, top: str = "") -> str:
    """CTE with the one-way F statistic ``f`` and its degrees of freedom."""
    return f"""{name} AS (
  SELECT count(*) AS k, sum(n) AS n,
         sum(n * power(m - grand, 2)) / (count(*) - 1)
           / (sum(coalesce(v, 0) * (n - 1)) / (sum(n) - count(*))) AS f
  FROM (SELECT *, sum(n * m) OVER () / sum(n) OVER () AS grand FROM (
    SELECT {group} AS g, count({value}) AS n, avg({value}) AS m, var_samp({value}) AS v
    FROM policy WHERE {group} IS NOT NULL AND ({where}) {top}
    GROUP BY {group} HAVING count({value}) >= {at_least})))"""


@query(
    "anova_premium_by_province",
    policy_sql(
        f"""SELECT round(f, 6) AS statistic, k - 1 AS df_between, (n - k)::BIGINT AS df_within,
  k AS num_groups, round({f_p_sql('f', '(k - 1)', '(n - k)')}, 6) AS p_value,
  {f_p_sql('f', '(k - 1)', '(n - k)')} < 0.05 AS significant FROM a""",
        anova_cte("Province", "TotalPremium", "TRUE", 1, "a"),
    ),
)
def anova_premium_by_province(spark, sf):
    out = R.anova(policy_view(spark, sf, ["Province", "TotalPremium"]), "TotalPremium", "Province")
    return rounded(out, statistic=6, p_value=6)


@query(
    "contingency_province_bank",
    policy_sql(
        """SELECT a, b, count(p.Province) AS n
FROM (SELECT DISTINCT Province AS a FROM policy WHERE Province IS NOT NULL AND Bank IS NOT NULL),
     (SELECT DISTINCT Bank AS b FROM policy WHERE Province IS NOT NULL AND Bank IS NOT NULL)
LEFT JOIN policy p ON p.Province = a AND p.Bank = b GROUP BY a, b"""
    ),
)
def contingency_province_bank(spark, sf):
    return R.contingency(policy_view(spark, sf, ["Province", "Bank"]), "Province", "Bank")


@query(
    "contingency_months_zero_filled",
    policy_sql(
        """SELECT a, b, count(p.PostalCode) AS n
FROM (SELECT DISTINCT PostalCode AS a FROM policy),
     (SELECT DISTINCT CAST(TransactionMonth AS DATE) AS b FROM policy)
LEFT JOIN policy p ON p.PostalCode = a AND CAST(p.TransactionMonth AS DATE) = b GROUP BY a, b"""
    ),
)
def contingency_months(spark, sf):
    rows = policy_view(spark, sf, ["PostalCode", "TransactionMonth"])
    rows = rows.withColumn("TransactionMonth", F.to_date("TransactionMonth"))
    return R.contingency(rows, "PostalCode", "TransactionMonth")


@query(
    "contingency_wide_bank_gender",
    policy_sql(
        """SELECT Bank, count(*) FILTER (WHERE Gender = 'F') AS F,
  count(*) FILTER (WHERE Gender = 'O') AS O FROM policy WHERE Bank IS NOT NULL GROUP BY Bank"""
    ),
)
def contingency_wide(spark, sf):
    return R.contingency_wide(policy_view(spark, sf, ["Bank", "Gender"]), "Bank", "Gender")


def chi_cte(a: str, b: str, name: str = "chi") -> str:
    """Chi-squared over the zero-filled grid, with the correction for one degree."""
    return f"""{name} AS (
  SELECT sum(CASE WHEN dof = 1 THEN power(abs(o - e) - least(0.5, abs(o - e)), 2) / e
                  ELSE power(o - e, 2) / e END) AS x,
         any_value(dof) AS dof, any_value(t) AS n, any_value(r) AS r, any_value(c) AS c
  FROM (SELECT o, t, r, c, (r - 1) * (c - 1) AS dof,
               sum(o) OVER (PARTITION BY a) * sum(o) OVER (PARTITION BY b) / t AS e
        FROM (SELECT a, b, coalesce(n, 0) AS o, sum(coalesce(n, 0)) OVER () AS t,
                     (SELECT count(DISTINCT {a}) FROM base) AS r,
                     (SELECT count(DISTINCT {b}) FROM base) AS c
              FROM (SELECT DISTINCT {a} AS a FROM base)
              CROSS JOIN (SELECT DISTINCT {b} AS b FROM base)
              LEFT JOIN (SELECT {a} AS ga, {b} AS gb, count(*) AS n FROM base GROUP BY 1, 2)
                ON ga = a AND gb = b)))"""


CHI_SELECT = """SELECT round(x, 6) AS statistic, dof AS degrees_of_freedom,
  round(CASE WHEN least(r, c) > 1 THEN sqrt(x / (n * (least(r, c) - 1))) ELSE 0 END, 6)
    AS effect_size, n::BIGINT AS n, r AS num_groups"""


def _chi_square(name, a, b, p_sql):
    sql = policy_sql(
        f"""{CHI_SELECT}, round({p_sql}, 6) AS p_value, {p_sql} < 0.05 AS significant FROM chi""",
        f"base AS (SELECT {a}, {b} FROM policy WHERE {a} IS NOT NULL AND {b} IS NOT NULL)",
        chi_cte(a, b),
    )

    @query(name, sql)
    def run(spark, sf):
        out = R.chi_square(policy_view(spark, sf, [a, b]), a, b)
        return rounded(out, statistic=6, effect_size=6, p_value=6)


_chi_square("chi_square_province_vehicle", "Province", "VehicleType", chi2_p_sql("x", "dof"))
_chi_square("chi_square_bank_gender", "Bank", "Gender", chi2_p_sql("x", "dof"))


# --- many columns ------------------------------------------------------------------------

KEY_NUMBERS = [
    "TotalPremium", "TotalClaims", "CalculatedPremiumPerTerm", "SumInsured", "CustomValueEstimate",
]


def _matrix_sql(function: str, digits: int, columns=KEY_NUMBERS) -> str:
    return policy_sql(
        "\nUNION ALL ".join(
            f"SELECT '{a}' AS column1, '{b}' AS column2, "
            f"round({function}({a}, {b}), {digits}) AS value FROM policy"
            for a in columns
            for b in columns
        )
    )


@query("correlation_matrix", _matrix_sql("corr", 6))
def correlation_matrix(spark, sf):
    return rounded(X.correlation_matrix(policy_view(spark, sf, KEY_NUMBERS)), value=6)


@query("covariance_matrix", _matrix_sql("covar_samp", 0))
def covariance_matrix(spark, sf):
    return rounded(X.covariance_matrix(policy_view(spark, sf, KEY_NUMBERS)), value=0)


def _pairs_sql(limit: float) -> str:
    parts = [
        f"SELECT '{a}' AS column1, '{b}' AS column2, corr({a}, {b}) AS r FROM policy"
        for i, a in enumerate(KEY_NUMBERS)
        for b in KEY_NUMBERS[i + 1 :]
    ]
    return policy_sql(
        f"""SELECT column1, column2, round(r, 6) AS correlation, {STRENGTH.format(r='r')} AS strength
FROM ({' UNION ALL '.join(parts)}) WHERE abs(r) > {limit}"""
    )


@query("highly_correlated_pairs", _pairs_sql(0.7))
def highly_correlated(spark, sf):
    out = X.highly_correlated(policy_view(spark, sf, KEY_NUMBERS), KEY_NUMBERS)
    return rounded(out, correlation=6)


@query("correlated_pairs_above_one_percent", _pairs_sql(0.01))
def correlated_above(spark, sf):
    out = X.highly_correlated(policy_view(spark, sf, KEY_NUMBERS), KEY_NUMBERS, above=0.01)
    return rounded(out, correlation=6)


RANKED_COLUMNS = ["TotalClaims", "RegistrationYear", "Cylinders", "SumInsured"]


@query(
    "spearman_matrix",
    policy_sql(
        "\nUNION ALL ".join(
            f"SELECT '{a}' AS column1, '{b}' AS column2, round(corr(r_{a}, r_{b}), 6) AS value FROM r"
            for a in RANKED_COLUMNS
            for b in RANKED_COLUMNS
        ),
        "r AS (SELECT "
        + ", ".join(
            f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS r_{c}"
            for c in RANKED_COLUMNS
        )
        + " FROM policy)",
    ),
)
def spearman_matrix(spark, sf):
    rows = policy_view(spark, sf, RANKED_COLUMNS)
    return rounded(X.correlation_matrix(rows, method="spearman"), value=6)


@query(
    "kendall_year_cylinders",
    policy_sql(
        """SELECT round(s / sqrt((p - tx) * (p - ty)), 6) AS tau FROM
  (SELECT sum(sign((a.x - b.x) * (a.y - b.y)) * a.n * b.n) / 2 AS s
   FROM pairs a CROSS JOIN pairs b),
  (SELECT sum(n) * (sum(n) - 1) / 2.0 AS p FROM pairs),
  (SELECT sum(t * (t - 1) / 2.0) AS tx FROM (SELECT sum(n) AS t FROM pairs GROUP BY x)),
  (SELECT sum(t * (t - 1) / 2.0) AS ty FROM (SELECT sum(n) AS t FROM pairs GROUP BY y))""",
        """pairs AS (SELECT RegistrationYear::DOUBLE AS x, Cylinders::DOUBLE AS y,
  count(*)::DOUBLE AS n FROM policy GROUP BY 1, 2)""",
    ),
)
def kendall_year_cylinders(spark, sf):
    rows = policy_view(spark, sf, ["RegistrationYear", "Cylinders"])
    return rounded(X.kendall_tau(rows, "RegistrationYear", "Cylinders"), tau=6)


@query("kendall_matrix")
def kendall_matrix(spark, sf):
    columns = ["TotalPremium", "TotalClaims", "RegistrationYear"]
    return X.correlation_matrix(policy_view(spark, sf, columns), method="kendall")


# --- hypothesis tests ----------------------------------------------------------------------


@query(
    "claim_contingency_province",
    policy_sql(
        """SELECT Province AS "Group", count(*) FILTER (WHERE TotalClaims > 0) AS with_claim,
  count(*) FILTER (WHERE NOT TotalClaims > 0) AS without_claim FROM policy GROUP BY Province"""
    ),
)
def claim_contingency_province(spark, sf):
    return H.claim_contingency(policy_view(spark, sf, ["Province", "TotalClaims"]), "Province")


TOP_CODES = """(SELECT PostalCode FROM policy GROUP BY PostalCode
    ORDER BY count(*) DESC, PostalCode LIMIT 20)"""


def _frequency_base(group: str, where: str = "TRUE") -> str:
    return f"""base AS (SELECT {group}, TotalClaims > 0 AS hit FROM policy
  WHERE {group} IS NOT NULL AND ({where}))"""


def _frequency(name, group, where, p_sql, **options):
    sql = policy_sql(
        f"{CHI_SELECT}, round({p_sql}, 6) AS p_value, {p_sql} < 0.05 AS reject_null FROM chi",
        _frequency_base(group, where),
        chi_cte(group, "hit"),
    )

    @query(name, sql)
    def run(spark, sf):
        rows = policy_view(spark, sf, [group, "TotalClaims"])
        out = H.chi_squared_test(rows, group, **options).drop("interpretation")
        return rounded(out, statistic=6, effect_size=6, p_value=6)


_frequency("chi_squared_claims_province", "Province", "TRUE", chi2_p_sql("x", "dof"))
_frequency(
    "chi_squared_claims_top_postal_codes",
    "PostalCode",
    f"PostalCode IN {TOP_CODES}",
    chi2_p_sql("x", "dof"),
    top_k=20,
)
_frequency(
    "chi_squared_claims_gender",
    "Gender",
    "Gender IN ('F', 'O')",
    chi2_one_p_sql("x"),
    selected=["F", "O"],
)

SEVERITY = "CASE WHEN TotalClaims > 0 THEN TotalClaims END"
MARGIN = "(TotalPremium - TotalClaims)"


def _welch_cte(value: str, name: str = "w") -> str:
    return f"""{name} AS (
  SELECT *, (m1 - m2) / sqrt(v1 / n1 + v2 / n2) AS t,
         power(v1 / n1 + v2 / n2, 2) / (power(v1 / n1, 2) / (n1 - 1)
           + power(v2 / n2, 2) / (n2 - 1)) AS dof
  FROM (SELECT count({value}) FILTER (WHERE Gender = 'F') AS n1,
               count({value}) FILTER (WHERE Gender = 'O') AS n2,
               avg({value}) FILTER (WHERE Gender = 'F') AS m1,
               avg({value}) FILTER (WHERE Gender = 'O') AS m2,
               var_samp({value}) FILTER (WHERE Gender = 'F') AS v1,
               var_samp({value}) FILTER (WHERE Gender = 'O') AS v2 FROM policy))"""


def _welch(name, metric, value):
    p = t_p_sql("t", "dof")
    sql = policy_sql(
        f"""SELECT round(t, 6) AS statistic, round(dof, 4) AS degrees_of_freedom,
  round(m1, 6) AS mean_group1, round(m2, 6) AS mean_group2,
  round((m1 - m2) / sqrt((v1 + v2) / 2), 6) AS cohens_d, n1, n2,
  round({p}, 6) AS p_value, {p} < 0.05 AS reject_null FROM w""",
        _welch_cte(value),
    )

    @query(name, sql)
    def run(spark, sf):
        rows = policy_view(spark, sf, ["Gender", "TotalClaims", "TotalPremium"])
        out = H.t_test(rows, "Gender", "F", "O", metric).drop("interpretation")
        return rounded(
            out,
            statistic=6, degrees_of_freedom=4, mean_group1=6, mean_group2=6, cohens_d=6, p_value=6,
        )


_welch("welch_t_severity_gender", "ClaimSeverity", SEVERITY)
_welch("welch_t_margin_gender", "Margin", MARGIN)


def _anova(name, group, metric, value, where="TRUE", **options):
    p = f_p_sql("f", "(k - 1)", "(n - k)")
    sql = policy_sql(
        f"""SELECT round(f, 6) AS statistic, k - 1 AS df_between, (n - k)::BIGINT AS df_within,
  k AS num_groups, round({p}, 6) AS p_value, {p} < 0.05 AS reject_null FROM a""",
        anova_cte(group, value, where, 2, "a"),
    )

    @query(name, sql)
    def run(spark, sf):
        rows = policy_view(spark, sf, [group, "TotalClaims", "TotalPremium"])
        out = H.anova_test(rows, group, metric, **options).drop("interpretation")
        return rounded(out, statistic=6, p_value=6)


_anova("anova_severity_province", "Province", "ClaimSeverity", SEVERITY)
_anova(
    "anova_severity_top_postal_codes", "PostalCode", "ClaimSeverity", SEVERITY,
    f"PostalCode IN {TOP_CODES}", top_k=20,
)
_anova(
    "anova_margin_top_postal_codes", "PostalCode", "Margin", MARGIN,
    f"PostalCode IN {TOP_CODES}", top_k=20,
)


@query(
    "anova_group_means_province",
    policy_sql(
        f"""SELECT Province AS "Group", count({SEVERITY}) AS n, round(avg({SEVERITY}), 6) AS mean,
  round(var_samp({SEVERITY}), 2) AS variance
FROM policy GROUP BY Province HAVING count({SEVERITY}) >= 2"""
    ),
)
def anova_group_means(spark, sf):
    rows = policy_view(spark, sf, ["Province", "TotalClaims", "TotalPremium"])
    return rounded(H.group_means(rows, "Province"), mean=6, variance=2)


def _battery_line(hypothesis, test, statistic, p, source):
    return f"""SELECT '{hypothesis}' AS hypothesis, '{test}' AS test,
  round({statistic}, 6) AS statistic, round({p}, 6) AS p_value,
  CASE WHEN {p} < 0.05 THEN 'REJECT' ELSE 'FAIL TO REJECT' END AS decision,
  {p} < 0.05 AS significant FROM {source}"""


def _battery_sql() -> str:
    ctes, lines = [], []
    chi = [
        ("H1a: claim frequency across provinces", "Province", "TRUE", chi2_p_sql("x", "dof")),
        (
            "H2a: claim frequency across postal codes", "PostalCode",
            f"PostalCode IN {TOP_CODES}", chi2_p_sql("x", "dof"),
        ),
        (
            "H4a: claim frequency between genders", "Gender", "Gender IN ('F', 'O')",
            chi2_one_p_sql("x"),
        ),
    ]
    for i, (label, group, where, p) in enumerate(chi):
        ctes.append(_frequency_base(group, where).replace("base AS", f"base{i} AS", 1))
        ctes.append(chi_cte(group, "hit", f"chi{i}").replace("FROM base", f"FROM base{i}"))
        lines.append(_battery_line(label, "Chi-Squared", "x", p, f"chi{i}"))
    f = [
        ("H1b: claim severity across provinces", "Province", SEVERITY, "TRUE"),
        (
            "H2b: claim severity across postal codes", "PostalCode", SEVERITY,
            f"PostalCode IN {TOP_CODES}",
        ),
        ("H3: margin across postal codes", "PostalCode", MARGIN, f"PostalCode IN {TOP_CODES}"),
    ]
    for i, (label, group, value, where) in enumerate(f):
        ctes.append(anova_cte(group, value, where, 2, f"a{i}"))
        p = f_p_sql("f", "(k - 1)", "(n - k)")
        lines.append(_battery_line(label, "ANOVA", "f", p, f"a{i}"))
    ctes.append(_welch_cte(SEVERITY))
    lines.append(
        _battery_line(
            "H4b: claim severity between genders", "T-Test", "t", t_p_sql("t", "dof"), "w"
        )
    )
    return policy_sql("\nUNION ALL ".join(lines), *ctes)


def _battery(spark, sf):
    rows = policy_view(
        spark, sf, ["Province", "PostalCode", "Gender", "TotalClaims", "TotalPremium"]
    )
    return H.run_battery(rows, H.standard_battery("F", "O"))


@query("hypothesis_battery", _battery_sql())
def hypothesis_battery(spark, sf):
    return rounded(_battery(spark, sf), statistic=6, p_value=6)


@query(
    "hypothesis_battery_rejected",
    f"SELECT count(*) FILTER (WHERE significant) AS rejected, count(*) AS tests FROM ({_battery_sql()})",
)
def hypothesis_battery_rejected(spark, sf):
    return H.rejected_count(_battery(spark, sf))


@query("test_interpretations")
def test_interpretations(spark, sf):
    rows = policy_view(spark, sf, ["Province", "Gender", "TotalClaims", "TotalPremium"])
    parts = (
        H.chi_squared_test(rows, "Province"),
        H.anova_test(rows, "Province", "Margin"),
        H.t_test(rows, "Gender", "F", "O"),
    )
    texts = [p.select("statistic", "p_value", "reject_null", "interpretation") for p in parts]
    return texts[0].unionByName(texts[1]).unionByName(texts[2])
