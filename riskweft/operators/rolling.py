"""Moving frames, neighbours and tiles per key, whatever the size of a key."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from riskweft.functions.tables import nan_to_null
from riskweft.operators.ordering import running_total, sorted_blocks
from riskweft.roles import require_columns

BLOCKS = 16  # blocks that a frame is cut into
KINDS = ("count", "sum", "mean", "min", "max")


def _ticks(at: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(at.cast("timestamp"))
    if isinstance(kind, T.DateType):
        return F.unix_date(at).cast("bigint")
    if isinstance(kind, T.IntegralType):
        return at.cast("bigint")
    raise ValueError("Frames need a time or a whole number")


def _block_width(width: int, blocks: int) -> int:
    """A block's width that divides the frame's, so that a frame begins ``width / block`` blocks earlier."""
    return width // max(d for d in range(1, min(blocks, width) + 1) if width % d == 0)


def rolling(
    df: DataFrame,
    at: str,
    width: int,
    aggregates: Mapping[str, tuple[str, str]],
    by: Sequence[str] = (),
    blocks: int = BLOCKS,
) -> DataFrame:
    """One row per key and time: aggregates over all rows of the key from ``width`` earlier to that time.

    ``width`` counts microseconds for timestamps, days for dates and units for whole numbers; both
    ends belong to the frame, as in RANGE BETWEEN width PRECEDING AND CURRENT ROW.  ``aggregates``
    maps a name to (count, sum, mean, min or max; column).  Nulls and NaN are left out of an
    aggregate; rows without a time are left out altogether, a null key is a key.

    Rows of one key and time are summed before anything moves.  A key's times are cut into blocks,
    a ``blocks``-th of the frame each, and a block is all that one task sees of a key: a frame is the
    tail of the block it begins in, the whole blocks between, and the head of its own.  Nothing is
    subtracted, so sums stay as exact as those of a plain frame.
    """
    wrong = {k for k, _ in aggregates.values()} - set(KINDS)
    if wrong:
        raise ValueError(f"Unknown aggregates: {sorted(wrong)}")
    if width < 1 or blocks < 1:
        raise ValueError("width and blocks must be positive")
    require_columns(df, [at, *by, *[c for _, c in aggregates.values()]])
    df = nan_to_null(df).filter(F.col(at).isNotNull())
    keys = [f"__by_{i}" for i in range(len(by))]
    # Parts that can be merged: name -> (aggregate of rows, how two parts become one).
    parts: dict[str, tuple[Column, object]] = {}
    for kind, column in aggregates.values():
        value = F.col(column)
        if kind in ("count", "mean"):
            parts[f"count_{column}"] = (F.count(value), F.sum)
        if kind in ("sum", "mean"):
            parts[f"sum_{column}"] = (F.sum(value.cast("double")), F.sum)
        if kind in ("min", "max"):
            parts[f"{kind}_{column}"] = ((F.min if kind == "min" else F.max)(value), F.min if kind == "min" else F.max)
    block = _block_width(width, blocks)
    span = width // block
    times = df.groupBy(*[F.col(c).alias(k) for c, k in zip(by, keys)], F.col(at).alias("__at")).agg(
        *[made.alias(name) for name, (made, _) in parts.items()]
    )
    tick = F.col("__tick")
    times = times.withColumn("__tick", _ticks(F.col("__at"), df.schema[at].dataType))
    own = F.floor(tick / F.lit(block)).cast("bigint") if block == 1 else (tick - F.pmod(tick, F.lit(block))) / block
    times = times.withColumn("__block", own.cast("bigint"))

    # The head of a time's own block.
    here = Window.partitionBy(*keys, "__block").orderBy("__tick").rowsBetween(Window.unboundedPreceding, 0)
    heads = times.select(
        *keys, "__at", "__tick", "__block", *[merge(name).over(here).alias(f"head_{name}") for name, (_, merge) in parts.items()]
    )
    # The tail of the block a frame begins in: each time is sent there as a question among its rows.
    nothing = [F.lit(None).cast(times.schema[name].dataType).alias(name) for name in parts]
    asked = times.select(
        *keys, "__at", (tick - width).alias("__tick"), (F.col("__block") - span).alias("__block"), F.lit(1).alias("__asks"), *nothing
    )
    answers = times.select(*keys, "__at", "__tick", "__block", F.lit(0).alias("__asks"), *parts).unionByName(asked)
    # Later rows are earlier ones of the opposite order: a frame that ends with its partition is summed anew for every row.
    later = Window.partitionBy(*keys, "__block").orderBy(F.desc("__tick")).rangeBetween(Window.unboundedPreceding, 0)
    tails = answers.select(
        *keys, "__at", "__asks", *[merge(name).over(later).alias(f"tail_{name}") for name, (_, merge) in parts.items()]
    ).filter("__asks = 1").drop("__asks")
    # Whole blocks between: one row per key and block.
    totals = times.groupBy(*keys, "__block").agg(*[merge(name).alias(name) for name, (_, merge) in parts.items()])
    between = Window.partitionBy(*keys).orderBy("__block").rangeBetween(-(span - 1), -1)
    middle = totals.select(
        *keys, "__block",
        *[(merge(name).over(between) if span > 1 else F.lit(None).cast(times.schema[name].dataType)).alias(f"middle_{name}")
          for name, (_, merge) in parts.items()],
    )
    out = _joined(_joined(heads, middle, [*keys, "__block"]), tails, [*keys, "__at"])
    merged = {}
    for name, (_, merge) in parts.items():
        three = [F.col(f"{p}_{name}") for p in ("tail", "middle", "head")]
        if merge is F.sum:
            empty = F.lit(0).cast(times.schema[name].dataType)
            total = sum((F.coalesce(c, empty) for c in three[1:]), F.coalesce(three[0], empty))
            none = three[0].isNull() & three[1].isNull() & three[2].isNull()
            merged[name] = F.when(~none, total)
        else:
            merged[name] = (F.least if merge is F.min else F.greatest)(*three)
    result = []
    for name, (kind, column) in aggregates.items():
        if kind == "mean":
            made = F.try_divide(merged[f"sum_{column}"], merged[f"count_{column}"])
        elif kind == "count":
            made = F.coalesce(merged[f"count_{column}"], F.lit(0).cast("bigint"))
        else:
            made = merged[f"{kind}_{column}"]
        result.append(made.alias(name))
    return out.select(*[F.col(k).alias(c) for c, k in zip(by, keys)], F.col("__at").alias(at), *result)


def _joined(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join in which a null key meets a null key."""
    other = right.select(*[F.col(c).alias(f"{c}__r" if c in keys else c) for c in right.columns if c in keys or c not in left.columns])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}__r"))
    return left.join(other, same, "left").drop(*[f"{k}__r" for k in keys])


def numbered(df: DataFrame, order_by: Sequence[str | Column], by: Sequence[str] = (), name: str = "position") -> DataFrame:
    """Rows of each key numbered from 1; the remaining columns break ties."""
    require_columns(df, by)
    named = [c for c in order_by if isinstance(c, str)]
    rest = [c for c in df.columns if c not in by and c not in named]
    blocks = sorted_blocks(df, [*by, *order_by, *rest])
    rows = running_total(blocks, F.lit(1), "__before", by)
    return rows.select(*df.columns, (F.col("__before") + 1).cast("bigint").alias(name))


def neighbours(
    df: DataFrame, columns: Mapping[str, str], order_by: Sequence[str | Column], by: Sequence[str] = (), offset: int = 1
) -> DataFrame:
    """All rows plus, under new names, columns of the row ``offset`` earlier in the key (later if negative).

    Rows of a key are looked at inside sorted blocks, so no key needs a task of its own and rows move to their
    block once.  The rows that a block's first ones ask for come from the blocks before: the last ``offset`` rows of
    each key and block, gathered over as many blocks.
    """
    require_columns(df, [*columns.values(), *by])
    if offset == 0:
        return df.select("*", *[F.col(c).alias(n) for n, c in columns.items()])
    named = [c for c in order_by if isinstance(c, str)]
    rest = [c for c in df.columns if c not in by and c not in named]
    far, turn = abs(offset), 1 if offset > 0 else -1
    # Later rows are earlier ones of the opposite order.
    keys = [f"__by_{i}" for i in range(len(by))]
    rows = sorted_blocks(df, [*by, *order_by, *rest]).select(
        *[F.col(c).alias(k) for c, k in zip(by, keys)], (F.col("__block") * turn).alias("__block"),
        (F.col("__index") * turn).alias("__index"), F.struct(*[F.col(c) for c in df.columns]).alias("__row"),
        F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(columns.values())]).alias("__held"),
    )
    last = Window.partitionBy(*keys, "__block").orderBy(F.desc("__index"))
    tails = rows.select(*keys, "__block", "__index", "__held", F.row_number().over(last).alias("__n")).filter(F.col("__n") <= far)
    tails = tails.groupBy(*keys, "__block").agg(F.sort_array(F.collect_list(F.struct("__index", "__held"))).alias("__tail"))
    # Each block holds a row of the key at least, so ``far`` blocks hold enough.
    before = Window.partitionBy(*keys).orderBy("__block").rowsBetween(-far, -1)
    carried = F.flatten(F.collect_list("__tail").over(before))
    carried = tails.select(*keys, "__block", F.reverse(carried).alias("__c"))
    carried = carried.select(*keys, "__block", F.posexplode(F.slice("__c", 1, far)).alias("__place", "__of"))
    # Places before every row of the block, the nearest one last.
    place = F.lit(-(1 << 40)).cast("bigint") - F.col("__place")
    asked = rows.unionByName(
        carried.select(
            *keys, "__block", place.alias("__index"), F.lit(None).cast(rows.schema["__row"].dataType).alias("__row"),
            F.col("__of.__held").alias("__held"),
        )
    )
    here = Window.partitionBy(*keys, "__block").orderBy("__index")
    found = asked.withColumn("__found", F.lag("__held", far).over(here)).filter(F.col("__row").isNotNull())
    return found.select(
        *[F.col(f"__row.{c}").alias(c) for c in df.columns],
        *[F.col("__found").getItem(f"c{i}").alias(n) for i, n in enumerate(columns)],
    )


def tiles(df: DataFrame, n: int, order_by: Sequence[str | Column], by: Sequence[str] = (), name: str = "tile") -> DataFrame:
    """All rows plus the number (from 1) of the ``n`` tiles of their key; the first tiles are one row longer."""
    if n < 1:
        raise ValueError("n must be positive")
    rows = numbered(df, order_by, by, "__position")
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("__size"))
    rows = _joined(rows, sizes, list(by)) if by else rows.crossJoin(F.broadcast(sizes))  # one row
    size, place = F.col("__size"), F.col("__position") - 1
    short, longer = F.floor(size / n), size % n
    edge = longer * (short + 1)
    tile = F.when(place < edge, F.floor(place / (short + 1))).otherwise(longer + F.floor((place - edge) / F.greatest(short, F.lit(1))))
    return rows.select(*df.columns, (tile + 1).cast("int").alias(name))
