"""Writing processed tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

FORMATS = ("csv", "txt", "parquet")


def save(
    df: DataFrame,
    path: str,
    format: str = "csv",
    sep: str | None = None,
    partition_by: Sequence[str] = (),
    mode: str = "overwrite",
    **options,
) -> None:
    """Write a folder of csv, pipe-delimited text or parquet files.

    Each task writes its own file, so nothing is gathered.  ``partition_by`` lays out
    one folder per value, which later reads can prune.  Text keeps its outer blanks, and
    a quote inside a field is doubled.
    """
    if format not in FORMATS:
        raise ValueError(f"Invalid format: {format}. Supported: {', '.join(FORMATS)}")
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if format == "parquet":
        writer.options(**options).parquet(path)
        return
    separator = sep or ("|" if format == "txt" else ",")
    plain = {
        "header": True, "sep": separator, "quote": '"', "escape": '"',
        "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
    }
    writer.options(**plain).options(**options).csv(path)
