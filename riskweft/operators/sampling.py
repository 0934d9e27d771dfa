"""Samples, previews and reproducible splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from riskweft.session import checkpointed
from riskweft.operators.quantiles import quantile_values

RUN = 1 << 16  # copies of a row numbered by one task


def preview(df: DataFrame, order_by: Sequence[str], n: int = 5) -> DataFrame:
    """The first ``n`` rows in the given order."""
    return df.orderBy(*order_by).limit(n)


def sample_rows(df: DataFrame, n: int = 1000, seed: int = 42) -> DataFrame:
    """A simple random sample of ``min(n, rows)`` rows without replacement.

    The draw of a row is a hash of its values, the seed and, among equal rows, a copy
    number: the same rows come back however the table is partitioned.  Only hashes are
    shuffled to find the n lowest draws; no task holds the sample.
    """
    rows = df.count()
    if n >= rows:
        return df
    if n <= 0:
        return df.limit(0)
    names = df.columns
    keyed = df.withColumn("__key", F.xxhash64(*[F.col(f"`{c}`") for c in names], F.lit(seed)))
    copies = keyed.groupBy("__key").agg(F.count(F.lit(1)).alias("__n"))
    numbered = _numbered_copies(copies)
    mixed = F.xxhash64("__key", "__copy", F.lit(seed))
    draws = numbered.withColumn("__draw", F.pmod(mixed, F.lit(1 << 53)) / float(1 << 53))
    # Twelve standard deviations above n: too few rows remain with odds of e^-70.
    draws = checkpointed(draws.filter(F.col("__draw") < (n + 12 * n**0.5 + 50) / rows))
    left = draws.count()
    if left > n:
        share = (n - 0.5) / (left - 1)  # between the n-th lowest draw and the next
        draws = draws.filter(F.col("__draw") <= quantile_values(draws, {"__draw": [share]})["__draw", share])
    wanted = draws.groupBy("__key").agg(F.count(F.lit(1)).alias("__times"))
    row = F.struct(*[F.col(f"`{c}`") for c in names])
    once = keyed.join(wanted, "__key").groupBy("__key").agg(F.first(row).alias("__row"), F.max("__times").alias("__times"))
    return once.select("__row", F.explode(F.sequence(F.lit(1), F.col("__times")))).select("__row.*")


def _numbered_copies(copies: DataFrame) -> DataFrame:
    """(__key, __copy): copy numbers from 1 to ``__n``; those of a frequent row are made in many tasks."""
    runs = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("__n") - 1) / F.lit(RUN)).cast("bigint"))
    spread = copies.select("__key", "__n", F.explode(runs).alias("__run"))
    often = spread.filter(F.col("__n") > RUN).repartition("__key", "__run")
    rows = often.unionByName(spread.filter(F.col("__n") <= RUN))
    begin = F.col("__run") * RUN
    return rows.select("__key", F.explode(F.sequence(begin + 1, F.least(begin + RUN, F.col("__n")))).alias("__copy"))


def split(
    df: DataFrame, test_size: float = 0.2, seed: int = 42, keys: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """Train and test rows of about the wanted sizes.

    The side follows from a hash of the row (or of ``keys``), so it does not depend on
    partitioning or on a task being run again, and copies of a row never end up on
    both sides.
    """
    if not 0 < test_size < 1:
        raise ValueError("test_size must be between 0 and 1")
    columns = [F.col(c) for c in (keys or df.columns)]
    slot = F.pmod(F.xxhash64(*columns, F.lit(seed)), F.lit(1_000_000))
    in_test = slot < int(test_size * 1_000_000)
    return df.filter(~in_test), df.filter(in_test)
