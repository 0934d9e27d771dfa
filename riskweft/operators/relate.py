"""Relations between two columns: correlation, group statistics, contingency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from riskweft.functions.tables import nan_to_null
from riskweft.functions.labels import correlation_strength
from riskweft.functions.pvalues import chi2_p, f_p, t_p
from riskweft.operators.hypothesis import contingency_statistic, f_statistic, group_means
from riskweft.operators.matrix import pearson, spearman_pair
from riskweft.operators.quantiles import plan_quantiles
from riskweft.session import checkpointed
from riskweft.roles import is_numeric, require_columns, require_numeric


# Values in one list of a zero-filled grid.
GRID_VALUES = 10_000


def bivariate(df: DataFrame, first: str, second: str) -> dict[str, DataFrame]:
    """The analyses that suit the two columns' types, by name.

    Every column that is not numeric counts as categorical.
    """
    df = nan_to_null(df)
    require_columns(df, [first, second])
    kinds = is_numeric(df, first), is_numeric(df, second)
    if all(kinds):
        return {"correlation": correlation(df, first, second)}
    if any(kinds):
        number, category = (first, second) if kinds[0] else (second, first)
        return {
            "group_statistics": group_statistics(df, number, category),
            "anova": anova(df, number, category),
        }
    return {
        "contingency_table": contingency(df, first, second),
        "chi_square_test": chi_square(df, first, second),
    }


def _correlation_p(r: Column, n: Column) -> Column:
    t = r * F.sqrt(F.try_divide(n - 2, 1 - r * r))
    return F.when(F.abs(r) >= 1, F.when(n > 2, 0.0).otherwise(1.0)).otherwise(
        t_p(t, F.greatest(n - 2, F.lit(1)))
    )


def correlation(df: DataFrame, x: str, y: str, p_values: bool = True) -> DataFrame:
    """Pearson and Spearman over complete pairs, with p-values and a strength label."""
    df = nan_to_null(df)
    require_numeric(df, [x, y])
    pairs = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    pairs = pairs.dropna()
    out = pairs.agg(F.count(F.lit(1)).alias("n"), pearson("x", "y").alias("pearson")).withColumn(
        "spearman", spearman_pair(pairs, "x", "y").scalar()
    )
    if p_values:
        n = F.col("n")
        out = out.withColumn("pearson_p_value", _correlation_p(F.col("pearson"), n))
        out = out.withColumn("spearman_p_value", _correlation_p(F.col("spearman"), n))
    return out.withColumn("relationship_strength", correlation_strength(F.col("pearson")))


def group_statistics(
    df: DataFrame, number: str, category: str, accuracy: int | None = None
) -> DataFrame:
    """Count, mean, median, standard deviation, minimum and maximum per category."""
    df = nan_to_null(df)
    require_numeric(df, [number])
    rows = df.select(
        F.col(category).alias("category"), F.col(number).cast("double").alias("x")
    ).dropna(subset=["category"])
    plan = plan_quantiles(rows, {"x": [0.5]}, by=["category"], accuracy=accuracy)
    return plan.rows.groupBy("category").agg(
        F.count("x").alias("count"),
        F.avg("x").alias("mean"),
        plan["x", 0.5].alias("median"),
        F.stddev_samp("x").alias("std"),
        F.min("x").alias("min"),
        F.max("x").alias("max"),
    )


def anova(df: DataFrame, number: str, category: str, p_value: bool = True) -> DataFrame:
    """One-way F over the categories with at least one value; nulls below two groups."""
    df = nan_to_null(df)
    require_numeric(df, [number])
    means = group_means(df, category, F.col(number).cast("double"), at_least=1)
    out = f_statistic(means).withColumn(
        "statistic", F.when(F.col("num_groups") > 1, F.col("statistic"))
    )
    if p_value:
        p = f_p(F.col("statistic"), F.col("df_between"), F.col("df_within"))
        out = out.withColumn("p_value", p).withColumn("significant", F.col("p_value") < 0.05)
    return out


def _cells(df: DataFrame, first: str, second: str) -> DataFrame:
    rows = df.select(F.col(first).alias("a"), F.col(second).alias("b")).dropna()
    return rows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def contingency(df: DataFrame, first: str, second: str, zero_fill: bool = True) -> DataFrame:
    """Counts ``(a, b, n)`` of two columns, empty cells included on request.

    The zero-filled result has a row per combination by definition.  The values of the second column
    travel in lists of about ``GRID_VALUES``, which meet every value of the first by their number.
    """
    df = nan_to_null(df)
    require_columns(df, [first, second])
    cells = _cells(df, first, second)
    if not zero_fill:
        return cells
    present = checkpointed(cells)
    values = present.select("b").distinct()
    lists = max(1, -(-values.count() // GRID_VALUES))
    listed = values.groupBy(F.pmod(F.xxhash64("b"), F.lit(lists)).alias("list")).agg(F.collect_list("b").alias("bs"))
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(lists - 1).cast("bigint"))).alias("list")
    grid = present.select("a").distinct().select("a", every).join(listed, "list").select("a", F.explode("bs").alias("b"))
    return grid.join(present, ["a", "b"], "left").fillna(0, ["n"])


def contingency_wide(df: DataFrame, first: str, second: str) -> DataFrame:
    """One row per value of ``first`` and one column per value of ``second``."""
    df = nan_to_null(df)
    rows = df.select(F.col(first), F.col(second).cast("string").alias("__b")).dropna()
    return rows.groupBy(first).pivot("__b").count().fillna(0)


def chi_square(df: DataFrame, first: str, second: str, p_value: bool = True) -> DataFrame:
    """Test of independence, with the continuity correction for a 2 x 2 table."""
    df = nan_to_null(df)
    require_columns(df, [first, second])
    out = contingency_statistic(_cells(df, first, second), "a", "b", "n")
    if p_value:
        p = chi2_p(F.col("statistic"), F.col("degrees_of_freedom"))
        out = out.withColumn("p_value", p).withColumn("significant", F.col("p_value") < 0.05)
    return out
