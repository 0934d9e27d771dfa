"""Missing-value handling: drop, constants, statistics, and order-based fills."""

from __future__ import annotations

import logging
from collections.abc import Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from riskweft.functions.tables import nan_to_null, null_count
from riskweft.operators.ordering import expand_copies, sorted_blocks
from riskweft.session import checkpointed
from riskweft.operators.quantiles import quantile_values
from riskweft.roles import categorical_columns, numeric_columns, require_columns, role_of
from riskweft import roles

log = logging.getLogger(__name__)

# Rows a window partition may hold before a fill switches to range blocks.
WINDOW_ROWS = 1_000_000
# A sorted block this many times the average holds a hot place, if it is above WINDOW_ROWS.
HOT_BLOCK = 4

NUMERIC_STRATEGIES = ("mean", "median", "mode", "zero", "forward_fill", "backward_fill")
CATEGORICAL_STRATEGIES = ("mode", "constant", "forward_fill", "backward_fill")


def handle_missing(
    df: DataFrame,
    strategy: str = "auto",
    numeric_strategy: str = "median",
    categorical_strategy: str = "mode",
    fill_value: Any = None,
    columns: Sequence[str] | None = None,
    order_by: Sequence[str] = (),
    partition_by: Sequence[str] = (),
    accuracy: int | None = None,
) -> DataFrame:
    """Drop, fill with a constant, or impute by role (``auto``)."""
    df = nan_to_null(df)
    columns = list(columns) if columns else df.columns
    require_columns(df, columns)
    if strategy == "drop":
        return df.dropna(how="any", subset=columns)
    if strategy == "fill":
        if fill_value is None:
            raise ValueError("fill_value must be provided when strategy is 'fill'")
        return fill_constant(df, fill_value, columns)
    if strategy == "auto":
        return impute(
            df,
            numeric_strategy,
            categorical_strategy,
            fill_value,
            columns,
            order_by,
            partition_by,
            accuracy,
        )
    raise ValueError(f"Invalid strategy: {strategy}")


def fill_constant(df: DataFrame, value: Any, columns: Sequence[str]) -> DataFrame:
    """Fill nulls with ``value`` cast to each column's type.

    A column whose type cannot hold the value keeps its nulls, with a warning.
    """
    replaced = {}
    for name in columns:
        data_type = df.schema[name].dataType
        if _fits(value, data_type):
            replaced[name] = F.coalesce(F.col(name), F.lit(value).cast(data_type))
        else:
            log.warning("Column %s cannot hold %r, left as it is", name, value)
    return df.withColumns(replaced) if replaced else df


def _fits(value: Any, data_type: T.DataType) -> bool:
    role = role_of(data_type)
    if role == roles.CATEGORICAL:
        return True
    if role == roles.NUMERICAL:
        try:
            number = float(value)
        except (TypeError, ValueError):
            return False
        return not isinstance(data_type, T.IntegralType) or number.is_integer()
    if role == roles.BOOLEAN:
        return isinstance(value, bool)
    if role == roles.DATETIME:
        return hasattr(value, "year")
    return False


def modal_value(df: DataFrame, column: str) -> DataFrame:
    """One row, one column: the most frequent value, the smallest on a tie.

    Counting before ranking keeps the state spread over the cluster, where the
    ``mode`` aggregate would hold every distinct value in one buffer.
    """
    df = nan_to_null(df)
    counts = df.select(F.col(column).alias("value")).dropna().groupBy("value").agg(
        F.count(F.lit(1)).alias("n")
    )
    return counts.orderBy(F.desc("n"), F.asc("value")).limit(1).select("value")


def impute(
    df: DataFrame,
    numeric_strategy: str = "median",
    categorical_strategy: str = "mode",
    fill_value: Any = None,
    columns: Sequence[str] | None = None,
    order_by: Sequence[str] = (),
    partition_by: Sequence[str] = (),
    accuracy: int | None = None,
) -> DataFrame:
    df = nan_to_null(df)
    if numeric_strategy not in NUMERIC_STRATEGIES:
        raise ValueError(f"Invalid numeric_strategy: {numeric_strategy}")
    if categorical_strategy not in CATEGORICAL_STRATEGIES:
        raise ValueError(f"Invalid categorical_strategy: {categorical_strategy}")
    columns = list(columns) if columns else df.columns
    numeric = [c for c in numeric_columns(df) if c in columns]
    text = [c for c in categorical_columns(df) if c in columns]
    if not numeric and not text:
        return df

    # Only columns that do miss values are rewritten; the rest keep their type.
    statistics = [null_count(c).alias(f"null_{c}") for c in numeric + text]
    if numeric_strategy == "mean":
        statistics += [F.avg(c).alias(f"mean_{c}") for c in numeric]
    found = df.agg(*statistics).first()
    numeric = [c for c in numeric if found[f"null_{c}"]]
    text = [c for c in text if found[f"null_{c}"]]

    replaced: dict[str, Column] = {}
    if numeric_strategy == "mean":
        for c in numeric:
            replaced[c] = _or_value(c, found[f"mean_{c}"])
    elif numeric_strategy == "median" and numeric:
        medians = quantile_values(df, {c: [0.5] for c in numeric}, accuracy)
        for c in numeric:
            replaced[c] = _or_value(c, medians[c, 0.5])
    elif numeric_strategy == "mode":
        for c in numeric:
            replaced[c] = F.coalesce(
                F.col(c),
                modal_value(df, c).scalar(),
                F.lit(0).cast(df.schema[c].dataType),
            )
    elif numeric_strategy == "zero":
        for c in numeric:
            replaced[c] = F.coalesce(F.col(c), F.lit(0).cast(df.schema[c].dataType))

    if categorical_strategy == "mode":
        for c in text:
            replaced[c] = F.coalesce(F.col(c), modal_value(df, c).scalar(), F.lit("Unknown"))
    elif categorical_strategy == "constant":
        for c in text:
            replaced[c] = F.coalesce(F.col(c), F.lit(str(fill_value or "Unknown")))

    out = df.withColumns(replaced) if replaced else df
    for strategy, names in ((numeric_strategy, numeric), (categorical_strategy, text)):
        if strategy in ("forward_fill", "backward_fill") and names:
            out = directional_fill(
                out, names, order_by, partition_by, backward=strategy == "backward_fill"
            )
    return out


def _or_value(column: str, value: float | None) -> Column:
    x = F.col(column).cast("double")
    return x if value is None else F.coalesce(x, F.lit(float(value)))


def directional_fill(
    df: DataFrame,
    columns: Sequence[str],
    order_by: Sequence[str],
    partition_by: Sequence[str] = (),
    backward: bool = False,
) -> DataFrame:
    """Carry the last (or next) value present, in the order of ``order_by``.

    Give a total order.  Without ``partition_by`` rows are range-sorted into blocks and filled
    inside each as they lie; each block's last values travel through a summary of one row per
    block.  Small partitions use one window, a partition too large for one task the same blocks.
    """
    df = nan_to_null(df)
    if not order_by:
        raise ValueError("order_by is required: rows have no order of their own")
    require_columns(df, [*columns, *order_by, *partition_by])
    keys = list(partition_by)
    if keys:
        largest = df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
        if largest <= WINDOW_ROWS:
            return _windowed_fill(df, columns, order_by, keys, backward)
        return _blocked_fill(df, columns, order_by, keys, backward)
    return _whole_fill(df, columns, order_by, backward)


def _whole_fill(df, columns, order_by, backward):
    """One range sort of the rows, then a fill that moves no row again."""
    names = df.columns
    blocks = _whole_blocks(df, order_by, backward)
    edges = _whole_edges(blocks, columns)
    sizes = edges.agg(F.max("__rows"), F.avg("__rows")).first()
    if (sizes[0] or 0) > max(WINDOW_ROWS, HOT_BLOCK * (sizes[1] or 0)):
        # Very many rows in one place sort into one block.  Collapse exact copies and let the
        # other columns order the rest, so that sorting can cut between them.
        copies = df.groupBy(*names).agg(F.count(F.lit(1)).alias("__copies"))
        place = [*order_by, *[c for c in names if c not in order_by]]
        blocks = _whole_blocks(copies, place, backward)
        filled = _filled_in_place(blocks, _whole_edges(blocks, columns), columns)
        return expand_copies(filled.select(*names, "__copies"), "__copies").select(*names)
    return _filled_in_place(blocks, edges, columns).select(*names)


def _whole_blocks(df, place, backward):
    """Rows sorted towards the fill, fixed, with the number of the block they lie in."""
    order = [F.desc(c) if backward else F.asc(c) for c in place]
    return checkpointed(df.orderBy(*order)).withColumn("__block", F.spark_partition_id())


def _whole_edges(blocks, columns):
    """Rows and last values of each block; the partial aggregate leaves one row per task."""
    place = F.monotonically_increasing_id()
    rows = blocks.select("*", place.alias("__index"))
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("__index"))) for c in columns]
    return rows.groupBy("__block").agg(
        F.count(F.lit(1)).alias("__rows"), *[v.alias(f"__edge{i}") for i, v in enumerate(last)]
    ).persist()


def _filled_in_place(blocks, edges, columns):
    # As many rows as there are partitions, whatever the size of the table.
    before = Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    carried = edges.select(
        F.col("__block").alias("__of_block"),
        *[F.last(f"__edge{i}", ignorenulls=True).over(before).alias(f"__carried{i}") for i in range(len(columns))],
    )
    names = list(columns)

    def forward(batches):
        last = {}
        for batch in batches:
            for c in names:
                at = batch.schema.get_field_index(c)
                values = batch.column(at)
                if c not in last:
                    last[c] = pa.nulls(1, values.type)
                joined = pa.concat_arrays([last[c], values])
                seen = np.where(joined.is_valid().to_numpy(zero_copy_only=False), np.arange(len(joined)), 0)
                filled = joined.take(pa.array(np.maximum.accumulate(seen)))
                last[c] = filled[-1:]
                batch = batch.set_column(at, batch.schema.field(at), filled[1:])
            yield batch

    filled = blocks.mapInArrow(forward, blocks.schema)
    joined = filled.join(F.broadcast(carried), F.col("__block") == F.col("__of_block"), "left")
    return joined.withColumns({c: F.coalesce(c, f"__carried{i}") for i, c in enumerate(columns)})


def _windowed_fill(df, columns, order_by, keys, backward):
    order = [F.desc(c) if backward else F.asc(c) for c in order_by]
    seen = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(seen) for c in columns})


def _blocked_fill(df, columns, order_by, keys, backward):
    names = df.columns
    place = [*keys, *order_by]
    hottest = df.groupBy(*place).count().agg(F.max("count")).first()[0] or 0
    if hottest <= WINDOW_ROWS:
        return _fill_blocks(df, columns, place, keys, backward).select(*names)
    # Very many rows in one place would sort into one block.  Collapse exact copies and
    # let the other columns order the rest, so that sorting can cut between them.
    copies = df.groupBy(*names).agg(F.count(F.lit(1)).alias("__copies"))
    place += [c for c in names if c not in place]
    filled = _fill_blocks(copies, columns, place, keys, backward)
    return expand_copies(filled.select(*names, "__copies"), "__copies").select(*names)


def _fill_blocks(df, columns, place, keys, backward):
    blocks = sorted_blocks(df, place)
    pick = F.min if backward else F.max
    edges = blocks.groupBy(*keys, "__block").agg(
        *[
            pick(F.when(F.col(c).isNotNull(), F.struct("__index", c))).getField(c).alias(f"__edge_{c}")
            for c in columns
        ]
    )
    towards = F.desc("__block") if backward else F.asc("__block")
    # One row per key and block it touches: a hot key spans many blocks, others one.
    before = Window.partitionBy(*keys).orderBy(towards).rowsBetween(
        Window.unboundedPreceding, -1
    )
    carried = edges.select(
        F.col("__block").alias("__of_block"),
        *[F.col(k).alias(f"__of_{k}") for k in keys],
        *[F.last(f"__edge_{c}", ignorenulls=True).over(before).alias(f"__carried_{c}") for c in columns],
    )
    same = F.col("__block") == F.col("__of_block")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__of_{k}"))
    inside = F.desc("__index") if backward else F.asc("__index")
    seen = (
        Window.partitionBy(*keys, "__block")
        .orderBy(inside)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return blocks.join(carried, same, "left").withColumns(
        {
            c: F.coalesce(F.last(c, ignorenulls=True).over(seen), F.col(f"__carried_{c}"))
            for c in columns
        }
    )


def missing_before_after(
    before: DataFrame, after: DataFrame, columns: Sequence[str] | None = None
) -> DataFrame:
    """Missing cells at both ends of a cleaning step."""

    def total(df: DataFrame, stage: str) -> DataFrame:
        names = list(columns) if columns else df.columns
        cells = sum((F.col(c).isNull().cast("long") for c in names), F.lit(0).cast("long"))
        return df.agg(F.coalesce(F.sum(cells), F.lit(0)).alias("missing")).select(
            F.lit(stage).alias("stage"), "missing"
        )

    return total(before, "before").unionByName(total(after, "after"))
