"""A join of many rows with one row per key that no frequent key can hold up."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

SHARE = 1_000  # a key with more than this part of the rows is frequent, so there are fewer than this many
LEAST = 10_000  # rows that one task takes without trouble


def join_spread(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``left`` joined with ``right``, which has at most one row per key; ``how`` is inner or left.

    Keys with more than 1 / ``SHARE`` of the rows of ``left`` (fewer than ``SHARE`` keys, whatever the table) are
    answered by broadcast where their rows lie; all others meet by a shuffle.  Null keys match nothing.  Both sides
    are read more than once: give stored tables.
    """
    sizes = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows"))
    total = left.count()
    hot = sizes.filter(F.col("__rows") > max(total // SHARE, LEAST)).select(*keys)
    near = F.broadcast(right.join(F.broadcast(hot), keys, "left_semi"))
    often = left.join(F.broadcast(hot), keys, "left_semi").join(near, keys, how)
    rest = left.join(F.broadcast(hot), keys, "left_anti").join(right, keys, how)
    return often.unionByName(rest)
