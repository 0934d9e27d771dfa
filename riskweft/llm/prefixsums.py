"""Running sums along each key without a task per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from riskweft.llm.store import stored

_INDEX_BITS = 33  # monotonically_increasing_id keeps the row's place in its partition in the low 33 bits


def running_sums(rows: DataFrame, key: str, order: list[str | Column], sums: dict[str, Column], keep: list[str]) -> DataFrame:
    """(key, *keep, *sums): each sum over the rows of a key up to and including this one, in ``order``.

    Rows are range-sorted by key and order, so a long key spans several partitions (blocks).  A block's totals per
    key are one row; the totals of earlier blocks are added to the running sum inside the block.  Give a total order.
    """
    sorted_rows = rows.orderBy(key, *order).select(key, *keep, *[c.alias(name) for name, c in sums.items()])
    place = F.monotonically_increasing_id()
    # Written where every task of a later run finds the same rows in the same file and order.
    fixed = stored(
        sorted_rows.withColumn("__row_place", place).withColumn("__block", F.shiftright("__row_place", _INDEX_BITS)), "sorted"
    )
    totals = fixed.groupBy(key, "__block").agg(*[F.sum(name).alias(f"__before_{name}") for name in sums])
    earlier = Window.partitionBy(key).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        key, "__block", *[F.coalesce(F.sum(f"__before_{name}").over(earlier), F.lit(0)).alias(f"__before_{name}") for name in sums]
    )
    inside = Window.partitionBy(key, "__block").orderBy("__row_place").rowsBetween(Window.unboundedPreceding, 0)
    return fixed.join(carried, [key, "__block"]).select(
        key, *keep, *[(F.col(f"__before_{name}") + F.sum(name).over(inside)).alias(name) for name in sums]
    )
