"""Row filters with the null behaviour of a dataframe library.

``!=`` and ``not_in`` keep rows whose value is missing; every other comparison drops
them.
"""

from __future__ import annotations

import logging
from collections.abc import Mapping
from functools import reduce
from operator import and_
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F, types as T

log = logging.getLogger(__name__)

_PREDICATES = {
    ">": lambda c, v: c > v,
    ">=": lambda c, v: c >= v,
    "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v,
    "==": lambda c, v: c == v,
    "!=": lambda c, v: ~c.eqNullSafe(F.lit(v)),
    "in": lambda c, v: c.isin(list(v)),
    "not_in": lambda c, v: c.isNull() | ~c.isin(list(v)),
    "between": lambda c, v: c.between(v[0], v[1]),
    "is_null": lambda c, v: c.isNull(),
    "not_null": lambda c, v: c.isNotNull(),
}


def predicate(column: str, operator: str, value: Any = None) -> Column:
    if operator not in _PREDICATES:
        raise ValueError(f"Invalid operator: {operator}")
    return _PREDICATES[operator](F.col(column), value)


def filter_rows(df: DataFrame, conditions: Mapping[str, tuple[str, Any]]) -> DataFrame:
    """Keep rows meeting every condition, as one predicate the scan can push down.

    NaN counts as missing, as NULL does.
    """
    parts = []
    for column, (operator, value) in conditions.items():
        if column not in df.columns:
            log.warning("Column %s not found, skipping filter", column)
            continue
        condition = predicate(column, operator, value)
        if isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType)):
            nan = F.isnan(F.col(column))
            if operator in (">", ">=", "not_null"):
                condition = condition & ~nan
            elif operator in ("is_null", "not_in"):
                condition = condition | nan
        parts.append(condition)
    return df.filter(reduce(and_, parts)) if parts else df


def keep_listed(df: DataFrame, column: str, values: DataFrame) -> DataFrame:
    """Rows whose ``column`` occurs in the one-column frame ``values``."""
    listed = values.select(F.col(values.columns[0]).alias("__listed"))
    return df.join(listed, F.col(column) == F.col("__listed"), "left_semi")
