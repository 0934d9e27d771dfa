"""Data-quality profile: missing cells, types, ranges, categories, score and advice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from riskweft import roles
from riskweft.functions.tables import nan_to_null, null_count, percent, stack_rows
from riskweft.operators.dedupe import duplicate_columns, duplicate_report
from riskweft.operators.outliers import outlier_report
from riskweft.operators.quantiles import quantile_values
from riskweft.roles import categorical_columns, is_numeric, numeric_columns, role_of

_NUMBER = r"^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$"


def _incomplete(columns: Sequence[str]) -> Column:
    out = F.col(columns[0]).isNull()
    for c in columns[1:]:
        out = out | F.col(c).isNull()
    return out


def _missing_counts(df: DataFrame) -> DataFrame:
    """One row: nulls per column, rows and incomplete rows, from a single scan."""
    return df.agg(
        F.count(F.lit(1)).alias("__rows"),
        F.count_if(_incomplete(df.columns)).alias("__incomplete"),
        *[null_count(c).alias(f"__null{i}") for i, c in enumerate(df.columns)],
    )


def missing_summary(df: DataFrame) -> DataFrame:
    df = nan_to_null(df)
    return _missing_counts(df).select(*_missing_columns(len(df.columns)))


def _missing_columns(width: int) -> list[Column]:
    """The summary's columns from those of ``_missing_counts``."""
    nulls = [F.col(f"__null{i}") for i in range(width)]
    total = sum(nulls[1:], nulls[0])
    affected = sum([(n > 0).cast("long") for n in nulls[1:]], (nulls[0] > 0).cast("long"))
    rows, incomplete = F.col("__rows"), F.col("__incomplete")
    return [
        total.alias("total_missing"),
        F.round(percent(total, rows * width), 2).alias("missing_percentage"),
        affected.alias("columns_with_missing"),
        incomplete.alias("rows_with_missing"),
        F.round(percent(incomplete, rows), 2).alias("rows_with_missing_percentage"),
        (rows - incomplete).alias("complete_rows"),
        F.round(percent(rows - incomplete, rows), 2).alias("complete_rows_percentage"),
    ]


def missing_by_column(df: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Missing count and percentage of the columns at or above the threshold."""
    df = nan_to_null(df)
    table = stack_rows(
        _missing_counts(df),
        [
            {
                "column": F.lit(c),
                "missing": F.col(f"__null{i}"),
                "missing_percentage": F.round(percent(F.col(f"__null{i}"), F.col("__rows")), 2),
            }
            for i, c in enumerate(df.columns)
        ],
    )
    return table.filter(F.col("missing_percentage") >= threshold)


def column_types(df: DataFrame) -> DataFrame:
    """``(column, dtype, role, present)``: the schema, with the values present in each column."""
    df = nan_to_null(df)
    counts = df.agg(*[F.count(F.col(c)).alias(f"__n{i}") for i, c in enumerate(df.columns)])
    return stack_rows(
        counts,
        [
            {
                "column": F.lit(f.name),
                "dtype": F.lit(f.dataType.simpleString()),
                "role": F.lit(role_of(f.dataType)),
                "present": F.col(f"__n{i}"),
            }
            for i, f in enumerate(df.schema.fields)
        ],
    )


def type_distribution(df: DataFrame) -> DataFrame:
    """``(dtype, columns, present)``: columns of each type and the values present in them."""
    return column_types(df).groupBy("dtype").agg(
        F.count(F.lit(1)).alias("columns"), F.sum("present").alias("present")
    )


def _looks_numeric(column: str) -> Column:
    x = F.col(column)
    return (F.count(x) > 0) & (F.count_if(x.isNotNull() & ~x.rlike(_NUMBER)) == 0)


def numeric_text_columns(df: DataFrame) -> DataFrame:
    """Text columns whose every value reads as a number."""
    df = nan_to_null(df)
    names = categorical_columns(df)
    schema = "column string, current_type string, suggested_type string"
    if not names:
        return df.sparkSession.createDataFrame([], schema)
    wide = df.agg(*[_looks_numeric(c).alias(f"__t{i}") for i, c in enumerate(names)])
    table = stack_rows(
        wide,
        [
            {
                "column": F.lit(c),
                "current_type": F.lit("string"),
                "suggested_type": F.lit("numeric"),
                "found": F.col(f"__t{i}"),
            }
            for i, c in enumerate(names)
        ],
    )
    return table.filter("found").drop("found")


def value_ranges(
    df: DataFrame, columns: Sequence[str] | None = None, accuracy: int | None = None
) -> DataFrame:
    """Range, centre, spread, zeros and negatives per numeric column."""
    df = nan_to_null(df)
    names = [c for c in (columns or numeric_columns(df)) if is_numeric(df, c)]
    if not names:
        raise ValueError("No numeric columns to check")
    medians = quantile_values(df, {c: [0.5] for c in names}, accuracy)
    aggregates, rows = [], []
    for i, c in enumerate(names):
        x = F.col(c).cast("double")
        aggregates += [
            F.struct(
                F.min(x).alias("min"),
                F.max(x).alias("max"),
                F.avg(x).alias("mean"),
                F.stddev_samp(x).alias("std"),
                F.count_if(x == 0).alias("zeros"),
                F.count_if(x < 0).alias("negatives"),
                F.count(x).alias("n"),
            ).alias(f"__c{i}")
        ]
        s = F.col(f"__c{i}")
        rows.append(
            {
                "column": F.lit(c),
                "status": F.when(s["n"] == 0, "all_null").otherwise("ok"),
                "min": s["min"],
                "max": s["max"],
                "mean": s["mean"],
                "median": F.lit(medians[c, 0.5]).cast("double"),
                "std": s["std"],
                "zeros": s["zeros"],
                "zeros_percentage": F.round(percent(s["zeros"], s["n"]), 2),
                "negatives": s["negatives"],
                "negatives_percentage": F.round(percent(s["negatives"], s["n"]), 2),
                "non_null_count": s["n"],
            }
        )
    return stack_rows(df.agg(*aggregates), rows)


def value_counts_by_column(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, value, n)`` over several text columns in one scan, nulls included.

    Rows are multiplied by the number of columns, but combined before the shuffle.
    """
    df = nan_to_null(df)
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
            for c in columns
        ]
    )
    return (
        df.select(F.inline(cells)).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    )


def _text_columns(df: DataFrame, columns: Sequence[str] | None) -> list[str]:
    names = [c for c in (columns or categorical_columns(df)) if c in df.columns]
    if not names:
        raise ValueError("No categorical columns to check")
    return names


def categorical_summary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Distinct values, most and least common value per column; ties by value."""
    df = nan_to_null(df)
    counts = value_counts_by_column(df, _text_columns(df, columns))
    present = F.col("value").isNotNull()
    pair = F.struct(F.col("n"), F.col("value"))
    ascending = F.struct((-F.col("n")).alias("n"), F.col("value"))
    table = counts.groupBy("column").agg(
        F.count("value").alias("unique_count"),
        F.min(F.when(present, ascending)).alias("__most"),
        F.min(F.when(present, pair)).alias("__least"),
        F.sum("n").alias("__rows"),
    )
    return table.select(
        "column",
        "unique_count",
        F.col("__most.value").alias("most_common"),
        F.coalesce(-F.col("__most.n"), F.lit(0)).alias("most_common_count"),
        F.col("__least.value").alias("least_common"),
        F.coalesce(F.col("__least.n"), F.lit(0)).alias("least_common_count"),
        F.round(F.try_divide("unique_count", "__rows"), 4).alias("cardinality_ratio"),
    )


def top_values(
    df: DataFrame, columns: Sequence[str] | None = None, top_n: int = 10
) -> DataFrame:
    """The ``top_n`` most frequent values of each column; ties by value."""
    df = nan_to_null(df)
    counts = value_counts_by_column(df, _text_columns(df, columns)).dropna(subset=["value"])
    # The rank filter keeps top_n values per map task before the shuffle.
    ranked = Window.partitionBy("column").orderBy(F.desc("n"), F.asc("value"))
    return (
        counts.withColumn("rank", F.row_number().over(ranked))
        .filter(F.col("rank") <= top_n)
        .select("column", "value", F.col("n").alias("count"), F.col("rank").cast("long"))
    )


def table_info(df: DataFrame) -> DataFrame:
    """Rows, columns, roles, missing cells and duplicate rows of the current table."""
    df = nan_to_null(df)
    summary = missing_summary(df)
    duplicates = duplicate_report(df)
    return summary.select(
        (F.col("complete_rows") + F.col("rows_with_missing")).alias("rows"),
        F.lit(len(df.columns)).cast("long").alias("columns"),
        F.lit(len(numeric_columns(df))).cast("long").alias("numeric_columns"),
        F.lit(len(categorical_columns(df))).cast("long").alias("categorical_columns"),
        F.col("total_missing").alias("missing_values"),
        F.coalesce("missing_percentage", F.lit(0.0)).alias("missing_percentage"),
        duplicates.select("duplicate_count").scalar().alias("duplicate_rows"),
    )


def _facts(df: DataFrame) -> DataFrame:
    """One row: the missing summary, the duplicate report and the type issues.

    Equal rows are counted once and everything else is summed over them, so the table is read
    and moved a single time.
    """
    n = F.col("__n")
    of = lambda held: F.coalesce(F.sum(F.when(held, n)), F.lit(0))
    names = df.columns
    issues = [_looks_numeric(c).cast("long") for c in categorical_columns(df)]
    counts = df.groupBy(*names).agg(F.count(F.lit(1)).alias("__n")).agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("__rows"),
        of(_incomplete(names)).alias("__incomplete"),
        *[of(F.col(c).isNull()).alias(f"__null{i}") for i, c in enumerate(names)],
        F.coalesce(F.sum(n - 1), F.lit(0)).alias("duplicate_count"),
        sum(issues, F.lit(0).cast("long")).alias("type_issues"),
    )
    return counts.select(
        *_missing_columns(len(names)), *duplicate_columns(F.col("duplicate_count"), F.col("__rows")), "type_issues"
    )


def quality_score(df: DataFrame) -> DataFrame:
    """One row: the deductions and the score from 100 down to 0."""
    df = nan_to_null(df)
    return _scored(_facts(df))


def _scored(facts: DataFrame) -> DataFrame:
    return facts.select(
        F.coalesce("missing_percentage", F.lit(0.0)).alias("missing_percentage"),
        F.coalesce("duplicate_percentage", F.lit(0.0)).alias("duplicate_percentage"),
        "type_issues",
    ).withColumn("quality_score", _score())


def _score() -> Column:
    score = (
        F.lit(100.0)
        - F.least(F.col("missing_percentage"), F.lit(20.0))
        - F.least(F.col("duplicate_percentage") * 2, F.lit(15.0))
        - F.least(F.col("type_issues") * 2.0, F.lit(10.0))
    )
    return F.greatest(F.round(score, 2), F.lit(0.0))


def _advice(width: int) -> Column:
    return F.array_compact(
        F.array(
            F.when(
                F.col("missing_percentage") > 5,
                F.format_string(
                    "High share of missing values (%.2f%%): impute or drop them.",
                    F.col("missing_percentage"),
                ),
            ),
            F.when(
                F.col("duplicate_count") > 0,
                F.format_string("%d duplicate rows: review and remove.", F.col("duplicate_count")),
            ),
            F.when(
                F.col("type_issues") > 0,
                F.format_string(
                    "%d columns hold numbers as text: convert them.", F.col("type_issues")
                ),
            ),
            F.when(
                F.col("columns_with_missing") > width * 0.5,
                F.lit("More than half of the columns miss values: check the source."),
            ),
        )
    )


def recommendations(df: DataFrame) -> DataFrame:
    """``(position, recommendation)``, empty for a clean table."""
    df = nan_to_null(df)
    return _recommended(_facts(df), len(df.columns))


def _recommended(facts: DataFrame, width: int) -> DataFrame:
    return facts.select(F.posexplode(_advice(width)).alias("position", "recommendation"))


def quality_report(
    df: DataFrame, include_outliers: bool = True, top_n: int = 10, accuracy: int | None = None
) -> DataFrame:
    """Everything above as ``(section, column, metric, value)`` in text form.

    Makes one pass per section, over the columns it needs.  Cache the table first if
    it is the result of expensive joins.
    """
    df = nan_to_null(df)
    if df.isEmpty():
        raise ValueError("Data cannot be empty")
    facts = _facts(df).persist()  # one row, read by four sections
    rows = (F.col("complete_rows") + F.col("rows_with_missing")).alias("rows")
    missing = [c for c in facts.columns if "missing" in c or "complete" in c]
    parts = [
        _melt("overview", facts.select(rows, F.lit(len(df.columns)).alias("columns"))),
        _melt("missing_values", facts.select(*missing)),
        _melt("missing_by_column", missing_by_column(df, 0.0).filter("missing > 0"), "column"),
        _melt(
            "duplicates",
            facts.select(
                "duplicate_count", "duplicate_percentage", "unique_count", "unique_percentage"
            ),
        ),
        _melt("data_types", column_types(df).drop("present"), "column"),
        _melt("type_issues", numeric_text_columns(df), "column"),
        _melt("quality_score", _scored(facts).select("quality_score")),
        _recommendation_part(_recommended(facts, len(df.columns))),
    ]
    if numeric_columns(df):
        parts.append(_melt("value_ranges", value_ranges(df, accuracy=accuracy), "column"))
        if include_outliers:
            parts.append(_melt("outliers", outlier_report(df, accuracy=accuracy), "column"))
    if categorical_columns(df):
        parts.append(_melt("categorical", categorical_summary(df), "column"))
        top = top_values(df, top_n=top_n)
        parts.append(
            top.select(
                F.lit("top_values").alias("section"),
                "column",
                F.col("value").alias("metric"),
                F.col("count").cast("string").alias("value"),
            )
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _recommendation_part(advice: DataFrame) -> DataFrame:
    return advice.select(
        F.lit("recommendations").alias("section"),
        F.lit(None).cast("string").alias("column"),
        F.col("position").cast("string").alias("metric"),
        F.col("recommendation").alias("value"),
    )


def _melt(section: str, table: DataFrame, key: str | None = None) -> DataFrame:
    metrics = [c for c in table.columns if c != key]
    return stack_rows(
        table,
        [
            {
                "section": F.lit(section),
                "column": F.col(key) if key else F.lit(None).cast("string"),
                "metric": F.lit(m),
                "value": F.col(m).cast("string"),
            }
            for m in metrics
        ],
    )


def require_rows(df: DataFrame) -> DataFrame:
    """The frame itself, after a check that it has at least one row."""
    if df is None or df.isEmpty():
        raise ValueError("Data cannot be None or empty")
    return df


def role_table(df: DataFrame) -> dict[str, list[str]]:
    """Column names per role."""
    names = (roles.NUMERICAL, roles.CATEGORICAL, roles.DATETIME, roles.BOOLEAN, roles.OTHER)
    return {role: roles.columns_with_role(df, role) for role in names}
