"""Stored sketches: distinct counts, overlaps and quantiles of segments that can be merged later.

A sketch column holds one binary value per segment and period.  Tables of them are as small as the
segments are few, are written once, and answer for any coarser segment without reading the rows
again: theta sketches for distinct values (with unions, overlaps and differences of segments), HLL
sketches for distinct values in less room, KLL sketches for quantiles.  Merging gives the error that
a sketch of all rows would have.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from riskweft.functions.tables import nan_to_null
from riskweft.roles import require_columns, require_numeric

THETA_BITS = 12  # 4096 values a sketch: counts up to that are exact
HLL_BITS = 12
KLL_K = 400
# Errors that fewer than one sketch in three hundred exceeds.
THETA_ERROR = 3 / math.sqrt(2**THETA_BITS)
HLL_ERROR = 3 * 1.04 / math.sqrt(2**HLL_BITS)
# Of a rank, as a share of the rows: the normalised rank error of a KLL sketch of this size, for
# all quantiles at once with 99 % certainty.
KLL_ERROR = 2.446 / KLL_K**0.9433
OPERATIONS = ("union", "overlap", "difference")


def segment_sketches(
    df: DataFrame,
    by: Sequence[str],
    distinct: Sequence[str] = (),
    quantiles: Sequence[str] = (),
    month_of: str | None = None,
    hll: bool = False,
) -> DataFrame:
    """One row per segment, and month of ``month_of`` if named: row count and sketches.

    ``theta_x`` (``hll_x`` with ``hll=True``) holds the distinct values of x, ``kll_x`` the
    distribution of x.  Nulls and NaN are in no sketch, null keys are a segment.  Sketches are built
    in every map task and merged, so a hot segment moves as one row a task.
    """
    require_columns(df, [*by, *distinct, *quantiles, *([month_of] if month_of else [])])
    require_numeric(df, quantiles)
    df = nan_to_null(df)
    keys = [F.col(c) for c in by]
    if month_of:
        keys.append(F.trunc(F.col(month_of).cast("date"), "month").alias("month"))
    made = [F.count(F.lit(1)).alias("rows")]
    for c in distinct:
        value = F.xxhash64(F.lit(11), c)  # any type, and a long for either sketch
        value = F.when(F.col(c).isNotNull(), value)
        made.append(
            F.hll_sketch_agg(value, HLL_BITS).alias(f"hll_{c}") if hll else F.theta_sketch_agg(value, THETA_BITS).alias(f"theta_{c}")
        )
    made += [F.kll_sketch_agg_double(F.col(c).cast("double"), KLL_K).alias(f"kll_{c}") for c in quantiles]
    return df.groupBy(*keys).agg(*made)


def save_sketches(sketches: DataFrame, path: str) -> None:
    """Write sketches, in folders by month if they have one, so that a period reads only its months."""
    writer = sketches.write.mode("overwrite")
    (writer.partitionBy("month") if "month" in sketches.columns else writer).parquet(path)


def load_sketches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _columns(sketches: DataFrame, kind: str) -> list[str]:
    return [c for c in sketches.columns if c.startswith(f"{kind}_")]


def merge_sketches(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sketches of coarser segments: one row per value of ``by``, or one row for all."""
    require_columns(sketches, by)
    merged = [F.sum("rows").alias("rows")]
    merged += [F.theta_union_agg(c, F.lit(THETA_BITS)).alias(c) for c in _columns(sketches, "theta")]
    merged += [F.hll_union_agg(c).alias(c) for c in _columns(sketches, "hll")]
    merged += [F.kll_merge_agg_double(c, F.lit(KLL_K)).alias(c) for c in _columns(sketches, "kll")]
    return sketches.groupBy(*by).agg(*merged)


def _bounds(estimate: Column, error: float, exact_to: int) -> list[Column]:
    off = F.when(estimate <= exact_to, F.lit(0.0)).otherwise(estimate * error)
    return [F.floor(estimate - off).cast("bigint"), F.ceil(estimate + off).cast("bigint")]


def sketch_estimates(sketches: DataFrame, ranks: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Keys, rows, and for each sketch its answers.

    ``distinct_x`` with ``distinct_x_low`` and ``distinct_x_high``, between which the true number
    lies but for one sketch in three hundred (theta sketches that are not full are exact);
    ``quantiles_x``, an array in the order of ``ranks``, whose true ranks lie within ``KLL_ERROR``.
    """
    if not all(0 <= p <= 1 for p in ranks):
        raise ValueError("ranks must lie between 0 and 1")
    kinds = ("theta", "hll", "kll")
    keys = [c for c in sketches.columns if not c.startswith(tuple(f"{k}_" for k in kinds))]
    out = [F.col(c) for c in keys]
    for kind, error, exact_to in (("theta", THETA_ERROR, 2**THETA_BITS), ("hll", HLL_ERROR, 0)):
        for c in _columns(sketches, kind):
            name = f"distinct_{c.removeprefix(kind + '_')}"
            estimate = (F.theta_sketch_estimate(c) if kind == "theta" else F.hll_sketch_estimate(c)).cast("bigint")
            low, high = _bounds(estimate, error, exact_to)
            out += [estimate.alias(name), low.alias(f"{name}_low"), high.alias(f"{name}_high")]
    points = F.array(*[F.lit(float(p)) for p in ranks])
    for c in _columns(sketches, "kll"):
        some = F.kll_sketch_get_n_double(c) > 0
        out.append(F.when(some, F.kll_sketch_get_quantile_double(c, points)).alias(f"quantiles_{c.removeprefix('kll_')}"))
    return sketches.select(*out)


def compare_segments(sketches: DataFrame, column: str, of: str, left, right, operation: str = "overlap") -> DataFrame:
    """One row: the distinct values of ``column`` in both, in either, or in the left only of two segments.

    ``of`` names the key, ``left`` and ``right`` its two values; all their rows of sketches are merged
    first.  ``low`` and ``high`` bound the count by the error of the union, which is what an overlap
    or a difference of theta sketches is measured against.
    """
    if operation not in OPERATIONS:
        raise ValueError(f"operation must be one of {OPERATIONS}")
    name = f"theta_{column}"
    require_columns(sketches, [of, name])
    side = lambda v: F.theta_union_agg(F.when(F.col(of) == F.lit(v), F.col(name)), F.lit(THETA_BITS))
    both = sketches.filter(F.col(of).isin([left, right])).agg(side(left).alias("a"), side(right).alias("b"))
    union = F.theta_union("a", "b", F.lit(THETA_BITS))
    made = {"union": union, "overlap": F.theta_intersection("a", "b"), "difference": F.theta_difference("a", "b")}[operation]
    sized = both.select(F.theta_sketch_estimate(made).cast("bigint").alias("values"), F.theta_sketch_estimate(union).cast("bigint").alias("whole"))
    off = F.when(F.col("whole") <= 2**THETA_BITS, F.lit(0.0)).otherwise(F.col("whole") * THETA_ERROR)
    return sized.select(
        "values", F.greatest(F.floor(F.col("values") - off), F.lit(0)).cast("bigint").alias("low"), F.ceil(F.col("values") + off).cast("bigint").alias("high")
    )
