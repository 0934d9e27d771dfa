"""Duplicate removal and duplicate reports.  Two nulls count as equal."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from riskweft.functions.tables import percent
from riskweft.operators.ordering import expand_copies
from riskweft.roles import require_columns

_KEEP = ("first", "last", False)


def _check(df: DataFrame, subset, keep) -> list[str]:
    if keep not in _KEEP:
        raise ValueError(f"keep must be one of {_KEEP}")
    subset = list(subset) if subset else df.columns
    require_columns(df, subset)
    return subset


def _order(df: DataFrame, order_by: Sequence[str], keep) -> list:
    # Remaining columns break ties, so equal ranks can only be equal rows.
    total = [*order_by, *[c for c in df.columns if c not in order_by]]
    return [F.desc(c) if keep == "last" else F.asc(c) for c in total]


def remove_duplicates(
    df: DataFrame,
    subset: Sequence[str] | None = None,
    keep: str | bool = "first",
    order_by: Sequence[str] = (),
) -> DataFrame:
    """Keep the first, the last or (``False``) no row of each repeated group.

    "First" is by ``order_by`` and then by the remaining columns, since rows have no
    order of their own.
    """
    subset = _check(df, subset, keep)
    rest = [c for c in df.columns if c not in subset]
    if keep is False:
        single = df.groupBy(*subset).agg(
            F.count(F.lit(1)).alias("__n"), *[F.first(c).alias(c) for c in rest]
        )
        return single.filter(F.col("__n") == 1).select(*df.columns)
    if not rest:
        return df.dropDuplicates()
    # A row_number() = 1 filter lets Spark keep one row per key and map task before
    # the shuffle, so a hot key does not gather in one task.
    ranked = Window.partitionBy(*subset).orderBy(*_order(df, order_by, keep))
    return (
        df.withColumn("__rank", F.row_number().over(ranked))
        .filter(F.col("__rank") == 1)
        .drop("__rank")
    )


def duplicate_report(
    df: DataFrame, subset: Sequence[str] | None = None, keep: str | bool = "first"
) -> DataFrame:
    """One row: duplicate and unique counts with their percentages."""
    subset = _check(df, subset, keep)
    groups = df.groupBy(*subset).agg(F.count(F.lit(1)).alias("__n"))
    extra = F.when(F.col("__n") > 1, F.col("__n")).otherwise(0) if keep is False else F.col("__n") - 1
    totals = groups.agg(
        F.coalesce(F.sum(extra), F.lit(0)).alias("duplicate_count"),
        F.coalesce(F.sum("__n"), F.lit(0)).alias("total_rows"),
    )
    return totals.select(*duplicate_columns(F.col("duplicate_count"), F.col("total_rows")))


def duplicate_columns(duplicate: Column, total: Column) -> list[Column]:
    """The columns of a report on ``duplicate`` of ``total`` rows."""
    return [
        duplicate.alias("duplicate_count"),
        F.round(percent(duplicate, total), 2).alias("duplicate_percentage"),
        (total - duplicate).alias("unique_count"),
        F.round(percent(total - duplicate, total), 2).alias("unique_percentage"),
    ]


def duplicate_rows(
    df: DataFrame,
    subset: Sequence[str] | None = None,
    keep: str | bool = "first",
    order_by: Sequence[str] = (),
) -> DataFrame:
    """The rows a report counts as duplicates, exact copies included.

    Exact copies are collapsed to one row and a count first.  One aggregate per key then gives its
    size and the row that is kept; both return to the rows by the key alone, and the copies are
    written out again at the end.
    """
    subset = _check(df, subset, keep)
    names = df.columns
    copies = df.groupBy(*names).agg(F.count(F.lit(1)).alias("__copies"))
    # The remaining columns break ties, so the smallest (or largest) row is one row.
    row = F.struct(*[F.col(c) for c in [*order_by, *[c for c in names if c not in order_by]]])
    found = [F.sum("__copies").alias("__size")]
    if keep is not False:
        found.append((F.max if keep == "last" else F.min)(row).alias("__kept"))
    groups = copies.groupBy(*[F.col(c).alias(f"__key_{c}") for c in subset]).agg(*found)
    same = F.lit(True)
    for c in subset:
        same = same & F.col(c).eqNullSafe(F.col(f"__key_{c}"))
    members = copies.join(groups.filter("__size > 1"), same)
    if keep is not False:
        kept = F.when(row.eqNullSafe(F.col("__kept")), 1).otherwise(0)
        members = members.withColumn("__copies", F.col("__copies") - kept)
    return expand_copies(members.select(*names, "__copies"), "__copies").select(*names)
