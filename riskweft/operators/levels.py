"""Portfolio metrics at several levels of detail from one pass over the rows."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame, functions as F

from riskweft.functions.tables import nan_to_null
from riskweft.operators.metrics import CLAIMS, PREMIUM
from riskweft.roles import require_columns, require_numeric

MOST_CUBE_KEYS = 8  # 256 levels

_SUMS = ["policy_count", "claim_count", "total_claims", "total_premium"]


def rollup_levels(keys: Sequence[str]) -> list[list[str]]:
    """All keys, then one fewer from the end each time, down to the grand total."""
    return [list(keys[:n]) for n in range(len(keys), -1, -1)]


def cube_levels(keys: Sequence[str]) -> list[list[str]]:
    """Every subset of the keys."""
    if len(keys) > MOST_CUBE_KEYS:
        raise ValueError(f"A cube takes at most {MOST_CUBE_KEYS} keys; name the levels instead")
    return [list(c) for n in range(len(keys), -1, -1) for c in combinations(keys, n)]


def metrics_at_levels(
    df: DataFrame, levels: Sequence[Sequence[str]], claims: str = CLAIMS, premium: str = PREMIUM
) -> DataFrame:
    """Loss ratio, claim frequency, severity and margin for each group of each level.

    ``level`` names the keys of a row's level, joined by a plus sign (``total`` for none); keys that
    are not in it are null.  As everywhere here, a row whose key is missing belongs to no group of a
    level with that key, but counts at the levels without it.

    Rows are summed once, at the finest level (all keys that occur).  Every other level is summed
    from those sums, which Spark expands by a grouping id: the rows are read and moved once.
    """
    levels = [list(dict.fromkeys(level)) for level in levels]
    if not levels:
        raise ValueError("Name at least one level")
    if len({frozenset(level) for level in levels}) < len(levels):
        raise ValueError("A level is named twice")
    keys = list(dict.fromkeys(k for level in levels for k in level))
    require_columns(df, keys)
    require_numeric(df, [claims, premium])
    rows = nan_to_null(df.select(*keys, F.col(claims).cast("double").alias("__claims"), F.col(premium).cast("double").alias("__premium")))
    finest = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("policy_count"),
        F.count_if(F.col("__claims") > 0).alias("claim_count"),
        F.sum(F.when(F.col("__claims") > 0, F.col("__claims"))).alias("__paid"),
        F.sum("__claims").alias("total_claims"),
        F.sum("__premium").alias("total_premium"),
        F.sum(F.col("__premium") - F.col("__claims")).alias("__margin"),
        F.count(F.col("__premium") - F.col("__claims")).alias("__both"),
    )
    sums = [F.sum(c).alias(c) for c in [*_SUMS, "__paid", "__margin", "__both"]]
    if keys:
        marks = [F.grouping(k).alias(f"__off_{k}") for k in keys]
        grouped = finest.groupingSets([[F.col(k) for k in level] for level in levels], *[F.col(k) for k in keys]).agg(*sums, *marks)
        for k in keys:
            grouped = grouped.filter((F.col(f"__off_{k}") == 1) | F.col(k).isNotNull())
        named = F.concat_ws("+", *[F.when(F.col(f"__off_{k}") == 0, F.lit(k)) for k in keys])
        grouped = grouped.withColumn("level", F.when(named == "", F.lit("total")).otherwise(named))
    else:
        grouped = finest.agg(*sums).withColumn("level", F.lit("total"))
    zero = F.lit(0.0)
    return grouped.select(
        "level", *keys,
        F.coalesce("policy_count", F.lit(0)).cast("bigint").alias("policy_count"),
        F.coalesce("total_claims", zero).alias("total_claims"),
        F.coalesce("total_premium", zero).alias("total_premium"),
        F.try_divide("total_claims", "total_premium").alias("loss_ratio"),
        F.try_divide(F.col("claim_count") * 100.0, F.col("policy_count")).alias("claim_frequency"),
        F.coalesce(F.try_divide("__paid", "claim_count"), zero).alias("claim_severity"),
        F.try_divide("__margin", "__both").alias("margin"),
    )
