"""Hypothesis tests on claim frequency, claim severity and margin.

Each test is one aggregation to a row per group, a second one over those rows, and a
tail probability on the single result row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from riskweft.functions.tables import nan_to_null
from riskweft.functions.pvalues import chi2_p, f_p, t_p, tail_p
from riskweft.operators.metrics import CLAIMS, PREMIUM, largest_groups
from riskweft.roles import require_columns

METRICS = ("ClaimSeverity", "Margin")


def _check(df: DataFrame, group: str, alpha: float, metric: str | None = None) -> None:
    if not 0 < alpha < 1:
        raise ValueError("Alpha must be between 0 and 1")
    require_columns(df, [group])
    if metric is not None and metric not in METRICS:
        raise ValueError("Metric must be 'ClaimSeverity' or 'Margin'")


def _metric(metric: str) -> Column:
    if metric == "ClaimSeverity":
        return F.when(F.col(CLAIMS) > 0, F.col(CLAIMS).cast("double"))
    return (F.col(PREMIUM) - F.col(CLAIMS)).cast("double")


def _error(message: str, as_type: str = "double") -> Column:
    return F.raise_error(F.lit(message)).cast(as_type)


# --- one row per group -----------------------------------------------------------------


def group_summary(
    df: DataFrame,
    group: str,
    metrics: Mapping[str, Column],
    selected: Sequence | None = None,
    top_k: int | None = None,
) -> DataFrame:
    """Per group: row count, claim counts, and (n, mean, variance) of each metric.

    Everything any of the tests needs, from one aggregation.  ``top_k`` keeps the
    groups with most rows.
    """
    df = nan_to_null(df)
    require_columns(df, [group])
    rows = df.withColumn("Group", F.col(group)).filter(F.col("Group").isNotNull())
    if selected is not None:
        rows = rows.filter(F.col("Group").isin(list(selected)))
    aggregates = [F.count(F.lit(1)).alias("PolicyCount")]
    if CLAIMS in df.columns:
        has = F.coalesce(F.col(CLAIMS) > 0, F.lit(False))
        aggregates += [
            F.count_if(has).alias("with_claim"),
            F.count_if(~has).alias("without_claim"),
        ]
    for name, value in metrics.items():
        aggregates += [
            F.count(value).alias(f"n_{name}"),
            F.avg(value).alias(f"mean_{name}"),
            F.var_samp(value).alias(f"variance_{name}"),
        ]
    table = rows.groupBy("Group").agg(*aggregates)
    return table if top_k is None else largest_groups(table, top_k)


# --- chi-squared ---------------------------------------------------------------------


def claim_contingency(
    df: DataFrame, group: str, selected: Sequence | None = None, top_k: int | None = None
) -> DataFrame:
    """Per group: rows with and without a claim."""
    df = nan_to_null(df)
    require_columns(df, [group, CLAIMS])
    return group_summary(df, group, {}, selected, top_k).drop("PolicyCount")


def contingency_statistic(cells: DataFrame, row: str, column: str, n: str) -> DataFrame:
    """Chi-squared of a long table of non-zero cells: statistic, dof, V and n.

    With R and C the margins, the statistic is N * (sum(O^2 / RC) - 1): empty cells
    add nothing, so the full grid is never built.  A 2 x 2 table gets the continuity
    correction, whose one deviation |O - E| follows from the same sums.
    """
    rows = cells.groupBy(F.col(row).alias("__r")).agg(F.sum(n).alias("__rn"))
    columns = cells.groupBy(F.col(column).alias("__c")).agg(F.sum(n).alias("__cn"))
    share = F.col(n).cast("double") / F.col("__rn") * (F.col(n) / F.col("__cn"))
    joined = (
        cells.join(rows, F.col(row) == F.col("__r"))
        .join(columns, F.col(column) == F.col("__c"))
        .agg(F.sum(share).alias("share"), F.sum(n).alias("n"))
    )
    row_side = rows.agg(
        F.count(F.lit(1)).alias("k"), F.sum(1.0 / F.col("__rn")).alias("inverse")
    )
    column_side = columns.agg(
        F.count(F.lit(1)).alias("k"), F.sum(1.0 / F.col("__cn")).alias("inverse")
    )
    return _chi_squared(
        joined.select(
            "share",
            "n",
            row_side.select(F.struct("*")).scalar().alias("r"),
            column_side.select(F.struct("*")).scalar().alias("c"),
        ).select(
            "share",
            "n",
            F.col("r.k").alias("rows"),
            F.col("c.k").alias("columns"),
            F.col("r.inverse").alias("row_inverse"),
            F.col("c.inverse").alias("column_inverse"),
        )
    )


def _chi_squared(sums: DataFrame) -> DataFrame:
    """Statistic, degrees of freedom and Cramér's V from the sums over all cells."""
    n = F.col("n").cast("double")
    plain = F.greatest(n * (F.col("share") - 1), F.lit(0.0))
    dof = (F.col("rows") - 1) * (F.col("columns") - 1)
    # In a 2 x 2 table every |O - E| is the same d, and plain = d^2 * sum(1 / E).
    inverse = n * F.col("row_inverse") * F.col("column_inverse")
    d = F.sqrt(plain / inverse)
    corrected = F.pow(d - F.least(F.lit(0.5), d), F.lit(2)) * inverse
    statistic = F.when(dof == 0, F.lit(0.0)).when(dof == 1, corrected).otherwise(plain)
    smaller = F.least(F.col("rows"), F.col("columns")) - 1
    return sums.select(
        statistic.alias("statistic"), dof.alias("degrees_of_freedom"), "n", "rows", smaller.alias("s")
    ).select(
        "statistic",
        "degrees_of_freedom",
        F.when(F.col("s") > 0, F.sqrt(F.col("statistic") / (F.col("n") * F.col("s"))))
        .otherwise(0.0)
        .alias("effect_size"),
        "n",
        F.col("rows").alias("num_groups"),
    )


def chi_squared_test(
    df: DataFrame,
    group: str,
    selected: Sequence | None = None,
    top_k: int | None = None,
    alpha: float = 0.05,
) -> DataFrame:
    """Does claim frequency differ between groups?  One row."""
    df = nan_to_null(df)
    _check(df, group, alpha)
    return _chi_squared_result(claim_contingency(df, group, selected, top_k), group, alpha)


def _chi_squared_of(table: DataFrame) -> DataFrame:
    w, wo = F.col("with_claim").cast("double"), F.col("without_claim").cast("double")
    sums = table.agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(w).alias("w"),
        F.sum(wo).alias("wo"),
        F.sum(w * w / (w + wo)).alias("w_share"),
        F.sum(wo * wo / (w + wo)).alias("wo_share"),
        F.sum(1.0 / (w + wo)).alias("row_inverse"),
    )
    checked = F.when(F.col("rows") < 2, _error("Need at least 2 groups for chi-squared test", "bigint"))
    return _chi_squared(
        sums.select(
            checked.otherwise(F.col("rows")).alias("rows"),
            ((F.col("w") > 0).cast("long") + (F.col("wo") > 0).cast("long")).alias("columns"),
            (
                F.coalesce(F.try_divide("w_share", "w"), F.lit(0.0))
                + F.coalesce(F.try_divide("wo_share", "wo"), F.lit(0.0))
            ).alias("share"),
            (F.col("w") + F.col("wo")).cast("long").alias("n"),
            "row_inverse",
            F.coalesce(
                F.try_divide(F.lit(1.0), "w") + F.try_divide(F.lit(1.0), "wo"), F.lit(0.0)
            ).alias("column_inverse"),
        )
    )


def _chi_squared_result(table: DataFrame, group: str, alpha: float) -> DataFrame:
    result = _chi_squared_of(table)
    p = chi2_p(F.col("statistic"), F.col("degrees_of_freedom"))
    result = _decide(result.withColumn("p_value", p), alpha)
    return _explain(
        result,
        alpha,
        f"claim frequency by {group}",
        F.format_string("Cramér's V %.3f", F.col("effect_size")),
    )


# --- t-test --------------------------------------------------------------------------


def t_test(
    df: DataFrame,
    group: str,
    first,
    second,
    metric: str = "ClaimSeverity",
    alpha: float = 0.05,
) -> DataFrame:
    """Welch's t-test between two groups, with Cohen's d.  One row."""
    df = nan_to_null(df)
    _check(df, group, alpha, metric)
    table = group_summary(df, group, {metric: _metric(metric)}, [first, second])
    return _t_result(table, first, second, metric, alpha)


def _t_of(table: DataFrame, first, second, metric: str) -> DataFrame:
    def of(value, column: str) -> Column:
        return F.max(F.when(F.col("Group") == value, F.col(column)))

    sums = table.agg(
        F.coalesce(of(first, "PolicyCount"), F.lit(0)).alias("rows1"),
        F.coalesce(of(second, "PolicyCount"), F.lit(0)).alias("rows2"),
        of(first, f"n_{metric}").alias("n1"),
        of(second, f"n_{metric}").alias("n2"),
        of(first, f"mean_{metric}").alias("mean_group1"),
        of(second, f"mean_{metric}").alias("mean_group2"),
        of(first, f"variance_{metric}").alias("v1"),
        of(second, f"variance_{metric}").alias("v2"),
    )
    empty = (F.col("rows1") == 0) | (F.col("rows2") == 0)
    few = (F.col("n1") < 2) | (F.col("n2") < 2)
    gap = F.col("mean_group1") - F.col("mean_group2")
    e1, e2 = F.col("v1") / F.col("n1"), F.col("v2") / F.col("n2")
    dof = F.try_divide(
        F.pow(e1 + e2, F.lit(2)),
        F.pow(e1, F.lit(2)) / (F.col("n1") - 1) + F.pow(e2, F.lit(2)) / (F.col("n2") - 1),
    )
    pooled = F.sqrt((F.col("v1") + F.col("v2")) / 2)
    return sums.select(
        F.when(empty, _error(f"One or both groups have no data: {first}, {second}"))
        .when(few, _error("Insufficient data for t-test (need at least 2 samples per group)"))
        .otherwise(F.try_divide(gap, F.sqrt(e1 + e2)))
        .alias("statistic"),
        dof.alias("degrees_of_freedom"),
        "mean_group1",
        "mean_group2",
        F.when(pooled > 0, gap / pooled).otherwise(0.0).alias("cohens_d"),
        "n1",
        "n2",
    )


def _t_result(table: DataFrame, first, second, metric: str, alpha: float) -> DataFrame:
    result = _t_of(table, first, second, metric)
    p = t_p(F.col("statistic"), F.col("degrees_of_freedom"))
    result = _decide(result.withColumn("p_value", p), alpha)
    return _explain(
        result,
        alpha,
        f"{metric} of {first} and {second}",
        F.format_string(
            "means %.2f and %.2f, Cohen's d %.3f",
            F.col("mean_group1"),
            F.col("mean_group2"),
            F.col("cohens_d"),
        ),
    )


# --- one-way ANOVA -------------------------------------------------------------------


def group_means(
    df: DataFrame,
    group: str,
    metric: str | Column = "ClaimSeverity",
    selected: Sequence | None = None,
    top_k: int | None = None,
    at_least: int = 2,
) -> DataFrame:
    """Per group: count, mean and variance of the metric, for large enough groups."""
    df = nan_to_null(df)
    name = metric if isinstance(metric, str) else "value"
    value = _metric(metric) if isinstance(metric, str) else metric
    return _means(group_summary(df, group, {name: value}, selected, top_k), name, at_least)


def _means(table: DataFrame, metric: str, at_least: int) -> DataFrame:
    return table.select(
        "Group",
        F.col(f"n_{metric}").alias("n"),
        F.col(f"mean_{metric}").alias("mean"),
        F.col(f"variance_{metric}").alias("variance"),
    ).filter(F.col("n") >= at_least)


def f_statistic(groups: DataFrame) -> DataFrame:
    """One-way F over rows of (n, mean, variance)."""
    n, m = F.col("n").cast("double"), F.col("mean")
    # Deviations are taken from the grand mean itself: the two terms of a
    # one-pass formula would cancel for large n.
    grand = groups.agg((F.sum(n * m) / F.sum(n))).scalar()
    within = F.coalesce(F.col("variance"), F.lit(0.0)) * (n - 1)
    sums = groups.withColumn("__grand", grand).agg(
        F.count(F.lit(1)).alias("num_groups"),
        F.sum("n").alias("n"),
        F.sum(n * F.pow(m - F.col("__grand"), F.lit(2))).alias("between"),
        F.sum(within).alias("within"),
    )
    k = F.col("num_groups")
    return sums.select(
        F.try_divide(
            F.try_divide(F.col("between"), (k - 1).cast("double")),
            F.try_divide(F.col("within"), (F.col("n") - k).cast("double")),
        ).alias("statistic"),
        (k - 1).alias("df_between"),
        (F.col("n") - k).alias("df_within"),
        "num_groups",
    )


def anova_test(
    df: DataFrame,
    group: str,
    metric: str = "ClaimSeverity",
    selected: Sequence | None = None,
    top_k: int | None = None,
    alpha: float = 0.05,
) -> DataFrame:
    """Does the metric differ between groups?  One row; means in ``group_means``."""
    df = nan_to_null(df)
    _check(df, group, alpha, metric)
    table = group_summary(df, group, {metric: _metric(metric)}, selected, top_k)
    return _anova_result(table, group, metric, alpha)


def _anova_of(table: DataFrame, metric: str) -> DataFrame:
    result = f_statistic(_means(table, metric, 2))
    few = F.when(
        F.col("num_groups") < 2,
        _error("Need at least 2 groups with sufficient data for ANOVA"),
    ).otherwise(F.col("statistic"))
    return result.withColumn("statistic", few)


def _anova_result(table: DataFrame, group: str, metric: str, alpha: float) -> DataFrame:
    result = _anova_of(table, metric)
    p = f_p(F.col("statistic"), F.col("df_between"), F.col("df_within"))
    result = _decide(result.withColumn("p_value", p), alpha)
    return _explain(
        result,
        alpha,
        f"{metric} by {group}",
        F.format_string("F %.3f over %d groups", F.col("statistic"), F.col("num_groups")),
    )


# --- decisions -----------------------------------------------------------------------


def _decide(result: DataFrame, alpha: float) -> DataFrame:
    return result.withColumn("reject_null", F.coalesce(F.col("p_value") < alpha, F.lit(False)))


def _explain(result: DataFrame, alpha: float, subject: str, effect: Column) -> DataFrame:
    """Add a sentence with the decision, the p-value and the size of the effect."""
    p = F.coalesce(F.format_string("%.4f", F.col("p_value")), F.lit("undefined"))
    found = F.concat(
        F.lit(f"REJECT H0 at alpha {alpha}: {subject} differs (p = "), p, F.lit("; "), effect, F.lit(")")
    )
    not_found = F.concat(
        F.lit(f"FAIL TO REJECT H0 at alpha {alpha}: no evidence that {subject} differs (p = "),
        p,
        F.lit(")"),
    )
    return result.withColumn(
        "interpretation", F.when(F.col("reject_null"), found).otherwise(not_found)
    )


@dataclass(frozen=True)
class TestSpec:
    """One line of a battery: which test on which grouping."""

    __test__ = False  # not a pytest class

    hypothesis: str
    test: str  # "chi_squared", "anova" or "t_test"
    group: str
    metric: str | None = None
    selected: tuple | None = None
    top_k: int | None = None
    pair: tuple | None = None


def run_battery(df: DataFrame, specs: Sequence[TestSpec], alpha: float = 0.05) -> DataFrame:
    """All tests as one table: statistic, p-value and decision per hypothesis.

    Tests on the same groups share one aggregation of the rows; its result, a row per
    group, is cached because each statistic reads it more than once.
    """
    df = nan_to_null(df)
    summaries: dict[tuple, DataFrame] = {}

    def summary(spec: TestSpec) -> DataFrame:
        key = (spec.group, spec.selected or spec.pair, spec.top_k)
        if key not in summaries:
            _check(df, spec.group, alpha, spec.metric)
            metrics = {m: _metric(m) for m in METRICS}
            summaries[key] = group_summary(df, *key[:1], metrics, *key[1:]).persist()
        return summaries[key]

    parts = []
    for spec in specs:
        table = summary(spec)
        if spec.test == "chi_squared":
            result, label, kind = _chi_squared_of(table), "Chi-Squared", "chi2"
        elif spec.test == "anova":
            result, label, kind = _anova_of(table, spec.metric), "ANOVA", "f"
        elif spec.test == "t_test":
            result, label, kind = _t_of(table, *spec.pair, spec.metric), "T-Test", "t"
        else:
            raise ValueError(f"Unknown test: {spec.test}")
        dofs = ("df_between", "df_within") if kind == "f" else ("degrees_of_freedom", None)
        parts.append(
            result.select(
                F.lit(spec.hypothesis).alias("hypothesis"),
                F.lit(label).alias("test"),
                F.lit(kind).alias("kind"),
                "statistic",
                F.col(dofs[0]).cast("double").alias("d1"),
                (F.col(dofs[1]) if dofs[1] else F.lit(None)).cast("double").alias("d2"),
            )
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    # One call for all p-values.
    p = tail_p(F.col("kind"), F.col("statistic"), F.col("d1"), F.col("d2"))
    out = _decide(out.coalesce(1).withColumn("p_value", p), alpha)
    decision = F.when(F.col("reject_null"), "REJECT").otherwise("FAIL TO REJECT")
    return out.select(
        "hypothesis",
        "test",
        "statistic",
        "p_value",
        decision.alias("decision"),
        F.col("reject_null").alias("significant"),
    )


def standard_battery(first, second, top_k: int = 20) -> list[TestSpec]:
    """The seven hypotheses on provinces, postal codes and gender."""
    return [
        TestSpec("H1a: claim frequency across provinces", "chi_squared", "Province"),
        TestSpec("H1b: claim severity across provinces", "anova", "Province", "ClaimSeverity"),
        TestSpec(
            "H2a: claim frequency across postal codes", "chi_squared", "PostalCode", top_k=top_k
        ),
        TestSpec(
            "H2b: claim severity across postal codes",
            "anova",
            "PostalCode",
            "ClaimSeverity",
            top_k=top_k,
        ),
        TestSpec("H3: margin across postal codes", "anova", "PostalCode", "Margin", top_k=top_k),
        TestSpec(
            "H4a: claim frequency between genders",
            "chi_squared",
            "Gender",
            selected=(first, second),
        ),
        TestSpec(
            "H4b: claim severity between genders",
            "t_test",
            "Gender",
            "ClaimSeverity",
            pair=(first, second),
        ),
    ]


def rejected_count(battery: DataFrame) -> DataFrame:
    return battery.agg(
        F.count_if("significant").alias("rejected"), F.count(F.lit(1)).alias("tests")
    )
