"""Differences of two snapshots of a table, as multisets of rows and as changes by key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from riskweft.operators.ordering import expand_copies
from riskweft.operators.rolling import numbered
from riskweft.roles import require_columns

INSERTED, REMOVED, CHANGED = "inserted", "removed", "changed"


def _shared_columns(old: DataFrame, new: DataFrame) -> list[str]:
    if sorted(old.columns) != sorted(new.columns):
        raise ValueError(f"Snapshots differ in columns: {sorted(set(old.columns) ^ set(new.columns))}")
    kinds = {f.name: f.dataType for f in new.schema}
    for f in old.schema:
        if f.dataType != kinds[f.name]:
            raise ValueError(f"Column {f.name} is {f.dataType.simpleString()} in one snapshot and {kinds[f.name].simpleString()} in the other")
        if isinstance(f.dataType, T.MapType):
            raise ValueError(f"Rows with a map cannot be compared; convert column {f.name}")
    return old.columns


def row_counts(old: DataFrame, new: DataFrame) -> DataFrame:
    """Every distinct row of either snapshot with ``old_count`` and ``new_count``.

    Two nulls are equal, and so are two NaN.  Copies are counted in the map tasks, so a row that
    fills a third of a snapshot moves once a task.
    """
    names = _shared_columns(old, new)
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    sides = old.select(*names, one.alias("__old"), none.alias("__new")).unionByName(
        new.select(*names, none.alias("__old"), one.alias("__new"))
    )
    return sides.groupBy(*names).agg(F.sum("__old").alias("old_count"), F.sum("__new").alias("new_count"))


def rows_removed(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of ``old`` beyond their copies in ``new``, as often as they are left: EXCEPT ALL."""
    counts = row_counts(old, new).withColumn("__left", F.col("old_count") - F.col("new_count"))
    return expand_copies(counts.filter("__left > 0").select(*old.columns, "__left"), "__left").select(*old.columns)


def rows_kept(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of both snapshots, as often as in the one that has fewer: INTERSECT ALL."""
    counts = row_counts(old, new).withColumn("__both", F.least("old_count", "new_count"))
    return expand_copies(counts.filter("__both > 0").select(*old.columns, "__both"), "__both").select(*old.columns)


def changes(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """What became of each row: key, ``change``, ``changed_columns``, ``before`` and ``after``.

    Rows that both snapshots have are taken away first, as multisets.  What is left of a key is
    paired in the order of the other columns: a pair is a changed row, with the columns that differ
    (nulls are values); the rest was removed or inserted.  A null key is a key; a key with any number
    of rows is numbered in sorted blocks, not in one task.
    """
    names = _shared_columns(old, new)
    require_columns(old, key)
    if not key:
        raise ValueError("Name at least one key column")
    rest = [c for c in names if c not in key]
    counts = row_counts(old, new).withColumn("__left", F.col("old_count") - F.col("new_count")).filter("__left <> 0")
    left = counts.select(*names, F.when(F.col("__left") > 0, REMOVED).otherwise(INSERTED).alias("__side"), F.abs("__left").alias("__copies"))
    rows = numbered(expand_copies(left, "__copies"), rest, by=[*key, "__side"], name="__place")
    row = F.struct(*[F.col(c) for c in names])
    side = lambda which: F.max(F.when(F.col("__side") == which, row))
    # Each group has at most one row a side.
    paired = rows.groupBy(*key, "__place").agg(side(REMOVED).alias("before"), side(INSERTED).alias("after"))
    differing = [F.when(~F.col(f"before.{c}").eqNullSafe(F.col(f"after.{c}")), F.lit(c)) for c in rest]
    columns = F.array_compact(F.array(*differing)) if rest else F.array().cast("array<string>")
    change = F.when(F.col("before").isNull(), INSERTED).when(F.col("after").isNull(), REMOVED).otherwise(CHANGED)
    return paired.select(
        *key, change.alias("change"), F.when(change == CHANGED, columns).alias("changed_columns"), "before", "after"
    )


def change_summary(changed: DataFrame) -> DataFrame:
    """Rows per kind of change, and per column how many rows changed in it (``column`` null: all)."""
    kinds = changed.groupBy("change").agg(F.count(F.lit(1)).alias("rows")).withColumn("column", F.lit(None).cast("string"))
    columns = changed.filter(F.col("change") == CHANGED).select("change", F.explode("changed_columns").alias("column"))
    columns = columns.groupBy("change", "column").agg(F.count(F.lit(1)).alias("rows"))
    return kinds.select("change", "column", "rows").unionByName(columns.select("change", "column", "rows"))
