"""Small helpers for turning one wide aggregate row into a long result."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T


def stack_rows(wide: DataFrame, rows: Sequence[Mapping[str, Column]]) -> DataFrame:
    """One output row per mapping, evaluated against each row of ``wide``."""
    structs = [F.struct(*[v.alias(k) for k, v in row.items()]) for row in rows]
    return wide.select(F.inline(F.array(*structs)))


# Rows up to which a narrow table (a row per group or label) is sent to every task.
BROADCAST_ROWS = 100_000


def sent_if_small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for broadcast when its counted ``rows`` are few; else joined as Spark decides."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def percent(part: Column, whole: Column) -> Column:
    """``100 * part / whole``; null when the whole is zero."""
    return F.try_divide(part * F.lit(100.0), whole)


def null_count(column: str) -> Column:
    return F.count_if(F.col(column).isNull())


def nan_to_null(df: DataFrame) -> DataFrame:
    """Make NaN and NULL one concept, before any comparison treats NaN as a number."""
    floating = (T.DoubleType, T.FloatType)
    return df.select(
        *[
            F.nanvl(F.col(f.name), F.lit(None).cast(f.dataType)).alias(f.name)
            if isinstance(f.dataType, floating)
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )
