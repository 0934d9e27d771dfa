"""Joins on time: the latest earlier row of a key, and rows whose spans meet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from riskweft.operators.ordering import sorted_blocks
from riskweft.roles import require_columns

DIRECTIONS = ("backward", "forward")
SIDES = ("left", "both")
# Where no pair is made, levels are this many powers of two apart: fewer copies of a row to move, wider bins to look through.
STEP = 6


def _named(df: DataFrame, taken: Sequence[str], suffix: str) -> dict[str, str]:
    """Output names of the right side's columns; a name the left side has gets the suffix."""
    return {c: f"{c}{suffix}" if c in taken else c for c in df.columns}


def _same(pairs: Sequence[tuple[str, str]]) -> Column:
    out = F.lit(True)
    for left, right in pairs:
        out = out & (F.col(left) == F.col(right))
    return out


def asof_join(
    left: DataFrame,
    right: DataFrame,
    left_on: str,
    right_on: str,
    by: Sequence[str] = (),
    columns: Sequence[str] | None = None,
    ties: Sequence[str] = (),
    direction: str = "backward",
    exact: bool = True,
    tolerance: Column | None = None,
    how: str = "left",
    suffix: str = "_right",
) -> DataFrame:
    """Each row of ``left`` with the latest row of ``right`` of the same key that is not later.

    ``forward`` takes the earliest row that is not earlier.  ``exact=False`` leaves rows of the
    very same time out; ``tolerance`` (a number or an interval) bounds the distance.  Among rows
    of one time the last in the order of ``ties``, then of the other columns, is taken; for
    ``forward`` the first.  A null key or time meets nothing.  ``how`` is left or inner.

    Both sides are sorted together by key and time into range blocks, so a key with any number of
    rows spans as many tasks as it needs.  Inside a block the last right row is carried along; a
    summary of one row per key and block carries it over block borders.
    """
    if direction not in DIRECTIONS:
        raise ValueError(f"direction must be one of {DIRECTIONS}")
    if how not in ("left", "inner"):
        raise ValueError("how must be left or inner")
    require_columns(left, [left_on, *by])
    require_columns(right, [right_on, *by, *ties, *(columns or ())])
    kept = [c for c in (columns if columns is not None else right.columns) if c not in by]
    payload = [right_on, *[c for c in kept if c != right_on]]
    names = _named(right.select(*kept), left.columns, suffix)
    back = direction == "backward"

    keys = [f"__by_{i}" for i in range(len(by))]
    known = lambda on: F.col(on).isNotNull() & _all_present(by)
    left_rows = F.struct(*[F.col(c) for c in left.columns])
    right_rows = F.struct(*[F.col(c) for c in payload])
    others = [c for c in payload if c != right_on and c not in ties and _orderable(right.schema[c].dataType)]
    rank = F.struct(*[F.col(c) for c in [*ties, *others]], F.lit(0).alias("__same"))

    # In the order that rows are read, a right row of the same time comes first exactly when it may be taken;
    # forward reads backwards.
    right_side, left_side = (0, 1) if back == exact else (1, 0)
    asked = left.filter(known(left_on)).select(
        *[F.col(c).alias(k) for c, k in zip(by, keys)], F.col(left_on).alias("__at"),
        F.lit(left_side).alias("__side"),
        F.lit(None).cast(right.select(rank.alias("r")).schema["r"].dataType).alias("__rank"),
        left_rows.alias("__left"),
        F.lit(None).cast(right.select(right_rows.alias("r")).schema["r"].dataType).alias("__right"),
    )
    given = right.filter(known(right_on)).select(
        *[F.col(c).alias(k) for c, k in zip(by, keys)], F.col(right_on).alias("__at"),
        F.lit(right_side).alias("__side"),
        rank.alias("__rank"), F.lit(None).cast(asked.schema["__left"].dataType).alias("__left"), right_rows.alias("__right"),
    )
    # The hash lets a range border fall between many left rows of one key and time.
    spread = F.xxhash64(*[F.col(f"__left.{c}") for c in left.columns if _orderable(left.schema[c].dataType)])
    # Forward is backward over the opposite order.
    turn = F.asc if back else F.desc
    blocks = sorted_blocks(
        asked.unionByName(given), [*keys, turn("__at"), turn("__side"), turn("__rank"), spread]
    )
    inside = Window.partitionBy(*keys, "__block").orderBy("__index").rowsBetween(Window.unboundedPreceding, 0)
    ends = blocks.filter(F.col("__right").isNotNull()).groupBy(*keys, "__block").agg(
        F.max_by("__right", "__index").alias("__last")
    )
    spans = blocks.filter(F.col("__left").isNotNull()).select(*keys, "__block").distinct()
    edges = spans.join(ends, [*keys, "__block"], "full")
    earlier = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    carried = edges.select(*keys, "__block", F.last("__last", ignorenulls=True).over(earlier).alias("__carried"))
    found = blocks.withColumn("__found", F.last("__right", ignorenulls=True).over(inside))
    found = found.filter(F.col("__left").isNotNull()).join(carried, [*keys, "__block"], "left")
    match = F.coalesce("__found", "__carried")
    if tolerance is not None:
        here, there = F.col(f"__left.{left_on}"), match[right_on]
        near = there + tolerance >= here if back else here + tolerance >= there
        match = F.when(near, match)
    out = found.select("__left", match.alias("__match"))
    if how == "inner":
        out = out.filter(F.col("__match").isNotNull())
    out = out.select(
        *[F.col(f"__left.{c}").alias(c) for c in left.columns],
        *[F.col(f"__match.{c}").alias(names[c]) for c in kept],
    )
    if how == "inner":
        return out
    alone = left.filter(~known(left_on))
    return out.unionByName(
        alone.select(*left.columns, *[F.lit(None).cast(right.schema[c].dataType).alias(names[c]) for c in kept])
    )


def _all_present(columns: Sequence[str]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).isNotNull()
    return out


def _orderable(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _orderable(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(_orderable(f.dataType) for f in kind.fields)
    return not isinstance(kind, (T.MapType, T.VariantType))


def _ticks(column: str, kind: T.DataType) -> Column:
    """A time or number as a double that keeps whole microseconds apart until the year 2255."""
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(F.col(column).cast("timestamp")).cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(column).cast("double")
    if isinstance(kind, T.NumericType):
        return F.col(column).cast("double")
    raise ValueError(f"Column {column} is neither a time nor a number")


def _levelled(df: DataFrame, start: str, end: str, prefix: str, step: int = 1) -> DataFrame:
    """Adds the span in ticks and its level: the power of two, of every ``step``, that its length fits in."""
    a, b = (_ticks(c, df.schema[c].dataType) for c in (start, end))
    length = F.col(f"{prefix}b") - F.col(f"{prefix}a")
    rows = df.withColumns({f"{prefix}a": a, f"{prefix}b": b}).filter(length >= 0)
    # Spans up to one tick, points included, share the lowest level.
    power = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(length, F.lit(1.0)))))
    return rows.withColumn(f"{prefix}level", (F.ceil(power / step) * step).cast("int"))


def _binned(df: DataFrame, prefix: str, levels: Sequence[int]) -> DataFrame:
    """One row per bin that the span touches: at its own level, and at every higher one in ``levels``."""
    own, wide = F.col(f"{prefix}level"), F.array(*[F.lit(int(v)) for v in levels]).cast("array<int>")
    at = F.explode(F.array_union(F.array(own), F.filter(wide, lambda v: v > own))).alias(f"{prefix}at")
    width = F.pow(F.lit(2.0), F.col(f"{prefix}at"))
    touched = F.sequence(
        F.floor(F.col(f"{prefix}a") / width).cast("bigint"), F.floor(F.col(f"{prefix}b") / width).cast("bigint")
    )
    return df.select("*", at).select("*", F.explode(touched).alias(f"{prefix}bin"))


def overlap_join(
    left: DataFrame,
    right: DataFrame,
    left_span: tuple[str, str],
    right_span: tuple[str, str],
    by: Sequence[str] = (),
    closed: str = "left",
    how: str = "inner",
    suffix: str = "_right",
) -> DataFrame:
    """Pairs of rows of one key whose spans share a moment.

    A span holds its start and, with ``closed="both"``, its end; a span whose ends are equal is a
    point and holds that point either way.  Nulls and spans that end before they start meet nothing.
    With ``how="left"`` rows of ``left`` without a partner are kept, with ``how="anti"`` they alone are
    returned, with their own columns: keys and spans are all that moves to find them, and no pair is made.

    No row meets all others: a span lies in one or two bins as wide as the power of two its length
    fits in, whatever the lengths of the others, and again at every longer length that the other
    side has (at most 63).  Spans meet at the longer one's level; a pair that shares several bins
    is named by the first.  It is an equi-join on key, level and bin, whose hot keys adaptive
    execution splits.
    """
    if closed not in SIDES:
        raise ValueError(f"closed must be one of {SIDES}")
    if how not in ("inner", "left", "anti"):
        raise ValueError("how must be inner, left or anti")
    require_columns(left, [*left_span, *by])
    require_columns(right, [*right_span, *by])
    alone = _alone(left, right, left_span, right_span, by, closed) if how != "inner" else None
    if how == "anti":
        return alone
    kept = [c for c in right.columns if c not in by]
    names = _named(right.select(*kept), left.columns, suffix)
    a, b, meets, first_bin = _meeting(left, right, left_span, right_span, by, closed)
    out = a.join(b, meets & first_bin).select(*left.columns, *[F.col(f"__row.{c}").alias(names[c]) for c in kept])
    if how == "inner":
        return out
    return out.unionByName(
        alone.select(*left.columns, *[F.lit(None).cast(right.schema[c].dataType).alias(names[c]) for c in kept])
    )


def _meeting(
    left: DataFrame, right: DataFrame, left_span: tuple[str, str], right_span: tuple[str, str], by: Sequence[str], closed: str,
    step: int = 1,
) -> tuple[DataFrame, DataFrame, Column, Column]:
    """Both sides by key, level and bin, the condition on which they meet, and the one that names a pair by its first bin."""
    a = _levelled(left, *left_span, "__l", step).filter(_all_present(by))
    theirs = right.select(
        *[F.col(c).alias(f"__by_{i}") for i, c in enumerate(by)], F.struct(*[F.col(c) for c in right.columns]).alias("__row"),
        *[F.col(c).alias(f"__end_{i}") for i, c in enumerate(right_span)],
    )
    b = _levelled(theirs, "__end_0", "__end_1", "__r", step).filter(_all_present([f"__by_{i}" for i in range(len(by))]))
    # At most 63 levels a side.
    seen = lambda df, p: [r[0] for r in df.select(f"{p}level").distinct().collect()]
    a, b = _binned(a, "__l", seen(b, "__r")), _binned(b, "__r", seen(a, "__l"))
    meets = _same([(c, f"__by_{i}") for i, c in enumerate(by)])
    meets = meets & (F.col("__lat") == F.col("__rat")) & (F.col("__lbin") == F.col("__rbin"))
    home = (F.col("__llevel") == F.col("__lat")) | (F.col("__rlevel") == F.col("__rat"))
    later = F.greatest("__la", "__ra")
    first_bin = F.floor(later / F.pow(F.lit(2.0), F.col("__lat"))).cast("bigint") == F.col("__lbin")
    inside = lambda x, lo, hi: (x >= lo) & ((x <= hi) if closed == "both" else ((x < hi) | ((x == lo) & (lo == hi))))
    la, lb, ra, rb = (F.col(c) for c in ("__la", "__lb", "__ra", "__rb"))
    shared = F.when(la >= ra, inside(la, ra, rb)).otherwise(inside(ra, la, lb))
    return a, b, meets & home & shared, first_bin


def _alone(
    left: DataFrame, right: DataFrame, left_span: tuple[str, str], right_span: tuple[str, str], by: Sequence[str], closed: str
) -> DataFrame:
    """Rows of ``left`` without a partner.  Rows of one key and span have equal partners, so each is asked for once."""
    names = {c: f"__has_{i}" for i, c in enumerate(dict.fromkeys([*by, *left_span]))}
    spans = left.select(*[F.col(c).alias(n) for c, n in names.items()]).dropna().distinct()
    theirs = right.select(*[F.col(c).alias(names[c]) for c in by], *[F.col(c).alias(f"__of_{i}") for i, c in enumerate(right_span)])
    a, b, meets, _ = _meeting(
        spans, theirs.dropna().distinct(), tuple(names[c] for c in left_span), ("__of_0", "__of_1"), [names[c] for c in by], closed,
        STEP,
    )
    found = a.join(b, meets, "left_semi").select(*names.values()).distinct()
    return left.join(found, _same(list(names.items())), "left_anti")


def interval_join(
    points: DataFrame,
    periods: DataFrame,
    at: str,
    period: tuple[str, str],
    by: Sequence[str] = (),
    closed: str = "left",
    how: str = "inner",
    suffix: str = "_right",
) -> DataFrame:
    """Rows of ``points`` with every period of the same key that holds their time."""
    return overlap_join(points, periods, (at, at), period, by, closed, how, suffix)
