"""Column roles, derived from the schema alone."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, types as T

NUMERICAL = "numerical"
CATEGORICAL = "categorical"
DATETIME = "datetime"
BOOLEAN = "boolean"
OTHER = "other"


def role_of(data_type: T.DataType) -> str:
    if isinstance(data_type, T.NumericType):
        return NUMERICAL
    if isinstance(data_type, (T.StringType, T.VarcharType, T.CharType)):
        return CATEGORICAL
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return DATETIME
    if isinstance(data_type, T.BooleanType):
        return BOOLEAN
    return OTHER


def columns_with_role(df: DataFrame, role: str) -> list[str]:
    return [f.name for f in df.schema.fields if role_of(f.dataType) == role]


def numeric_columns(df: DataFrame) -> list[str]:
    return columns_with_role(df, NUMERICAL)


def categorical_columns(df: DataFrame) -> list[str]:
    return columns_with_role(df, CATEGORICAL)


def is_numeric(df: DataFrame, column: str) -> bool:
    return column in df.columns and role_of(df.schema[column].dataType) == NUMERICAL


def require_columns(df: DataFrame, columns: Iterable[str]) -> None:
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise ValueError(f"Columns not found: {absent}")


def require_numeric(df: DataFrame, columns: Iterable[str]) -> None:
    columns = list(columns)
    require_columns(df, columns)
    wrong = [c for c in columns if not is_numeric(df, c)]
    if wrong:
        raise ValueError(f"Columns must be numeric: {wrong}")


def pick_numeric(df: DataFrame, columns: Sequence[str] | None) -> list[str]:
    """Requested columns, all numeric; every numeric column when none is named."""
    if columns is None:
        return numeric_columns(df)
    require_numeric(df, columns)
    return list(columns)
