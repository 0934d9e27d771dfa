"""Row order without a global window: range-sorted blocks plus a block summary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from riskweft.session import checkpointed

_INDEX_BITS = 33  # monotonically_increasing_id keeps the row index in the low 33 bits


def sorted_blocks(df: DataFrame, order_by: Sequence[str | Column]) -> DataFrame:
    """Globally sorted rows with ``__block`` (range partition) and ``__index`` in it.

    The sort is checkpointed, so block borders stay what they are if a task is lost
    and run again.  Give a total order for a reproducible result.
    """
    fixed = checkpointed(df.orderBy(*order_by))
    identity = F.monotonically_increasing_id()
    return fixed.withColumn("__block", F.shiftright(identity, _INDEX_BITS)).withColumn(
        "__index", identity.bitwiseAND(F.lit((1 << _INDEX_BITS) - 1))
    )


def running_total(
    blocks: DataFrame, weight: Column, name: str, within: Sequence[str] = ()
) -> DataFrame:
    """Add ``name``: the sum of ``weight`` over all earlier rows of the same key.

    ``blocks`` comes from ``sorted_blocks`` ordered by ``within`` first.  Totals per
    (key, block) are summed over blocks; only the remainder is summed row by row,
    inside a block.
    """
    keys = list(within)
    rows = blocks.withColumn("__weight", weight)
    totals = rows.groupBy(*keys, "__block").agg(F.sum("__weight").alias("__total"))
    # One row per block, or per key and block: a hot key spans many blocks, any other
    # key very few.
    earlier = Window.partitionBy(*keys).orderBy("__block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    totals = totals.select(
        *[F.col(k).alias(f"__of_{k}") for k in keys],
        F.col("__block").alias("__of_block"),
        F.coalesce(F.sum("__total").over(earlier), F.lit(0)).alias("__carried"),
    )
    condition = F.col("__block") == F.col("__of_block")
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"__of_{k}"))
    inside = (
        Window.partitionBy(*keys, "__block")
        .orderBy("__index")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        rows.join(totals, condition, "left")
        .withColumn(
            name,
            F.col("__carried") + F.coalesce(F.sum("__weight").over(inside), F.lit(0)),
        )
        .drop("__weight", "__carried", "__of_block", *[f"__of_{k}" for k in keys])
    )


def with_position(df: DataFrame, order_by: Sequence[str | Column], name: str) -> DataFrame:
    """Number all rows from 0 in the given total order."""
    blocks = sorted_blocks(df, order_by)
    counts = blocks.groupBy("__block").agg(F.count(F.lit(1)).alias("__rows"))
    # As many rows as there are partitions, whatever the size of the table.
    earlier = Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        F.col("__block").alias("__of_block"),
        F.coalesce(F.sum("__rows").over(earlier), F.lit(0)).alias("__before"),
    )
    return (
        blocks.join(F.broadcast(offsets), F.col("__block") == F.col("__of_block"))
        .withColumn(name, F.col("__before") + F.col("__index"))
        .drop("__block", "__index", "__of_block", "__before")
    )


def expand_copies(df: DataFrame, copies: str) -> DataFrame:
    """Repeat each row ``copies`` times, spreading the copies of a hot row."""
    chunk = 1_000_000
    chunks = F.floor((F.col(copies) - 1) / F.lit(chunk)).cast("long")
    spread = df.filter(F.col(copies) > 0).withColumn(
        "__chunk", F.explode(F.sequence(F.lit(0).cast("long"), chunks))
    )
    hot = spread.filter(F.col(copies) > chunk)
    cold = spread.filter(F.col(copies) <= chunk)
    # Only rows with more copies than one chunk are moved before the second step.
    moved = hot.repartition("__chunk").unionByName(cold)
    here = F.least(F.lit(chunk).cast("long"), F.col(copies) - F.col("__chunk") * chunk)
    return moved.withColumn(
        "__copy", F.explode(F.sequence(F.lit(1).cast("long"), here))
    ).drop("__chunk", "__copy", copies)
