"""Exact quantiles whose state does not grow with the table.

Spark's ``percentile`` keeps every distinct value of a group in one buffer.  Here a
mergeable KLL sketch first gives a bracket around each wanted rank.  Values outside
the brackets are then moved onto the nearest bracket end, which leaves the order
statistics inside untouched, so ``percentile`` of the moved values is exact and its
buffer holds only the brackets.  The ranks of the bracket ends are counted in the same
pass and checked, so a bad bracket can cost a retry but never a wrong result.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from math import floor

from pyspark.sql import Column, DataFrame, functions as F

from riskweft.functions.tables import sent_if_small

SKETCH_K = 8_000
# Four times the rank error of a sketch of that size (2.296 / k^0.9021).
SKETCH_MARGIN = 4 * 2.296 / SKETCH_K**0.9021
# Rows up to which no bracket is needed: they all fit.
SMALL_GROUP = 20_000
# Distinct values one exact buffer may hold before brackets are narrowed further.
BUFFER_VALUES = 2_000_000
FINEST_ACCURACY = 1_000_000

Key = tuple[str, float]


# --- whole table -----------------------------------------------------------------------


@dataclass(frozen=True)
class _Target:
    """One wanted rank and what is known about it so far."""

    column: str
    p: float
    rows: int
    low: float
    high: float
    inside: float  # rows estimated between low and high

    @property
    def rank(self) -> float:
        return self.p * (self.rows - 1)

    @property
    def needed(self) -> tuple[int, int]:
        """Rows that must be below ``low`` at most, and up to ``high`` at least."""
        whole = floor(self.rank)
        return whole, whole + (2 if self.rank > whole else 1)


def quantile_values(
    df: DataFrame, wanted: Mapping[str, Sequence[float]], accuracy: int | None = None
) -> dict[Key, float | None]:
    """Quantiles (linear interpolation) of the non-null values of several columns.

    All columns share each pass.  With ``accuracy`` one pass of ``percentile_approx``
    is the answer.
    """
    keys = [(c, p) for c, ps in wanted.items() for p in ps]
    if not keys:
        return {}
    if accuracy is not None:
        row = df.agg(
            *[
                F.percentile_approx(F.col(c).cast("double"), p, accuracy).alias(f"q{i}")
                for i, (c, p) in enumerate(keys)
            ]
        ).first()
        return {k: row[f"q{i}"] for i, k in enumerate(keys)}

    margin, found, open_keys = SKETCH_MARGIN, {}, keys
    while open_keys:
        targets, empty = _bracketed(df, open_keys, margin)
        found.update(dict.fromkeys(empty))
        while any(t.inside > BUFFER_VALUES for t in targets):
            targets = _narrowed(df, targets, margin)
        found.update(_exact_values(df, targets))
        open_keys = [k for k in keys if k not in found]
        margin *= 8  # for a rank whose bracket missed it
    return found


def _sketch(x: Column) -> Column:
    return F.kll_sketch_agg_double(x, SKETCH_K)


def _bracketed(df: DataFrame, keys: Sequence[Key], margin: float):
    columns = list(dict.fromkeys(c for c, _ in keys))
    ps = {c: [p for k, p in keys if k == c] for c in columns}
    aggregates = []
    for i, c in enumerate(columns):
        x = F.col(c).cast("double")
        aggregates += [
            F.count(x).alias(f"n{i}"),
            F.min(x).alias(f"min{i}"),
            F.max(x).alias(f"max{i}"),
            _sketch(x).alias(f"s{i}"),
        ]
    ends = []
    for i, c in enumerate(columns):
        ranks = [max(p - margin, 0.0) for p in ps[c]] + [min(p + margin, 1.0) for p in ps[c]]
        ends.append(
            F.when(
                F.col(f"n{i}") > SMALL_GROUP,
                F.kll_sketch_get_quantile_double(f"s{i}", F.array(*[F.lit(v) for v in ranks])),
            ).alias(f"ends{i}")
        )
    row = df.agg(*aggregates).select("*", *ends).drop(*[f"s{i}" for i in range(len(columns))]).first()
    targets, empty = [], []
    for i, c in enumerate(columns):
        n, cuts = row[f"n{i}"], row[f"ends{i}"]
        for j, p in enumerate(ps[c]):
            if n == 0:
                empty.append((c, p))
                continue
            low, high, inside = row[f"min{i}"], row[f"max{i}"], float(n)
            if cuts is not None:
                inside = min(inside, 2 * margin * n)
                # At the ends of the range the bracket is open outwards.
                low = cuts[j] if p - margin > 0 else low
                high = cuts[len(ps[c]) + j] if p + margin < 1 else high
            targets.append(_Target(c, p, n, low, high, inside))
    return targets, empty


def _narrowed(df: DataFrame, targets: Sequence[_Target], margin: float) -> list[_Target]:
    """One more sketch per wide bracket, over the values inside it only."""
    wide = [t for t in targets if t.inside > BUFFER_VALUES]
    aggregates, grids = [], []
    steps = [i / 1000 for i in range(1001)]
    for i, t in enumerate(wide):
        x = F.col(t.column).cast("double")
        inside = x.between(t.low, t.high)
        aggregates += [
            F.count_if(x < t.low).alias(f"below{i}"),
            F.count_if(inside).alias(f"inside{i}"),
            _sketch(F.when(inside, x)).alias(f"s{i}"),
        ]
        grids.append(
            F.when(
                F.col(f"inside{i}") > 0,
                F.kll_sketch_get_quantile_double(f"s{i}", F.array(*[F.lit(v) for v in steps])),
            ).alias(f"grid{i}")
        )
    row = df.agg(*aggregates).select("*", *grids).drop(*[f"s{i}" for i in range(len(wide))]).first()
    out = [t for t in targets if t.inside <= BUFFER_VALUES]
    for i, t in enumerate(wide):
        below, inside, grid = row[f"below{i}"], row[f"inside{i}"], row[f"grid{i}"]
        if inside < 2 or t.low == t.high:
            out.append(replace(t, inside=0.0))
            continue
        share = (t.rank - below) / (inside - 1)
        first = max(0, floor((share - margin) * 1000))
        last = min(1000, floor((share + margin) * 1000) + 1)
        low, high = grid[first] if first else t.low, grid[last] if last < 1000 else t.high
        # A bracket that cannot shrink any more is all ties: its buffer is small.
        same = (low, high) == (t.low, t.high)
        out.append(
            replace(t, low=low, high=high, inside=0.0 if same else inside * (last - first) / 1000)
        )
    return out


def _moved(x: Column, ends: Sequence[tuple[Column, Column]]) -> Column:
    """Values between brackets moved onto a bracket end, keeping their order."""
    out = F.when(x < ends[0][0], ends[0][0])
    for i, (_, high) in enumerate(ends):
        out = out.when(x <= high, x)
        if i + 1 < len(ends):
            out = out.when(x < ends[i + 1][0], high)
    return F.when(x.isNotNull(), out.otherwise(ends[-1][1]))


def _exact_values(df: DataFrame, targets: Sequence[_Target]) -> dict[Key, float]:
    columns = list(dict.fromkeys(t.column for t in targets))
    if not columns:
        return {}
    ordered = {c: sorted((t for t in targets if t.column == c), key=lambda t: t.p) for c in columns}
    aggregates = []
    for i, c in enumerate(columns):
        x = F.col(c).cast("double")
        ends = [(F.lit(float(t.low)), F.lit(float(t.high))) for t in ordered[c]]
        ps = F.array(*[F.lit(float(t.p)) for t in ordered[c]])
        aggregates.append(F.percentile(_moved(x, ends), ps).alias(f"q{i}"))
        if ordered[c][0].rows > SMALL_GROUP:
            for j, (low, high) in enumerate(ends):
                aggregates += [
                    F.count_if(x < low).alias(f"below{i}_{j}"),
                    F.count_if(x <= high).alias(f"upto{i}_{j}"),
                ]
    row = df.agg(*aggregates).first()
    found = {}
    for i, c in enumerate(columns):
        for j, t in enumerate(ordered[c]):
            if t.rows > SMALL_GROUP:
                at_most, at_least = t.needed
                if row[f"below{i}_{j}"] > at_most or row[f"upto{i}_{j}"] < at_least:
                    continue
            found[c, t.p] = row[f"q{i}"][j]
    return found


def quantiles(
    df: DataFrame, column: str, probabilities: Sequence[float], accuracy: int | None = None
) -> DataFrame:
    """``(probability, value)`` for one column."""
    values = quantile_values(df, {column: probabilities}, accuracy)
    rows = [(float(p), values[column, p]) for p in probabilities]
    return df.sparkSession.createDataFrame(rows, "probability double, value double")


# --- per group -------------------------------------------------------------------------


@dataclass(frozen=True)
class QuantilePlan:
    """Rows to aggregate and, per ``(column, probability)``, the aggregate to use."""

    rows: DataFrame
    aggregates: dict[Key, Column]

    def __getitem__(self, key: Key) -> Column:
        return self.aggregates[key]


def plan_quantiles(
    df: DataFrame,
    wanted: Mapping[str, Sequence[float]],
    by: Sequence[str],
    accuracy: int | None = None,
) -> QuantilePlan:
    """Quantile aggregates per group, for ``plan.rows.groupBy(*by).agg(...)``.

    The brackets of all groups form a table joined to the rows.
    """
    if accuracy is not None:
        return QuantilePlan(
            df,
            {
                (c, p): F.percentile_approx(F.col(c).cast("double"), p, accuracy)
                for c, ps in wanted.items()
                for p in ps
            },
        )
    keys = [F.col(c).alias(f"__key{k}") for k, c in enumerate(by)]
    bounds = df.groupBy(*keys).agg(*_group_sketches(wanted)).persist()
    largest, groups = bounds.agg(
        F.max(F.greatest(F.lit(0), *[F.col(f"__n{i}") for i in range(len(wanted))])),
        F.count(F.lit(1)),
    ).first()
    margin = SKETCH_MARGIN
    finer = int((largest or 0) * 2 * SKETCH_MARGIN) > BUFFER_VALUES
    if finer:
        # A group this large gets the finest deterministic sketch instead.
        margin = 3 / FINEST_ACCURACY
        bounds.unpersist()
        bounds = df.groupBy(*keys).agg(*_group_sketches(wanted, margin)).persist()

    ends = []
    for i, ps in enumerate(wanted.values()):
        ranks = [max(p - margin, 0.0) for p in ps] + [min(p + margin, 1.0) for p in ps]
        if finer:
            cuts = F.col(f"__s{i}")
        else:
            cuts = F.kll_sketch_get_quantile_double(
                f"__s{i}", F.array(*[F.lit(v) for v in ranks])
            )
        cuts = F.when(F.col(f"__n{i}") > SMALL_GROUP, cuts)
        for j, p in enumerate(ps):
            low = cuts[j] if p - margin > 0 else F.col(f"__min{i}")
            high = cuts[len(ps) + j] if p + margin < 1 else F.col(f"__max{i}")
            ends += [
                F.coalesce(low, F.col(f"__min{i}")).alias(f"__low{i}_{j}"),
                F.coalesce(high, F.col(f"__max{i}")).alias(f"__high{i}_{j}"),
            ]
    bounds = bounds.select(*[f"__key{k}" for k in range(len(by))], *ends)
    condition = None
    for k, c in enumerate(by):
        part = F.col(c).eqNullSafe(F.col(f"__key{k}"))
        condition = part if condition is None else condition & part
    # One row per group: few groups are sent to the rows; with many, AQE splits a hot
    # group's partition.
    rows = df.join(sent_if_small(bounds, groups), condition, "left")
    aggregates = {}
    for i, (c, ps) in enumerate(wanted.items()):
        x = F.col(c).cast("double")
        order = sorted(range(len(ps)), key=lambda j: ps[j])
        ends_of = [(F.col(f"__low{i}_{j}"), F.col(f"__high{i}_{j}")) for j in order]
        values = F.percentile(_moved(x, ends_of), F.array(*[F.lit(float(ps[j])) for j in order]))
        for place, j in enumerate(order):
            aggregates[c, ps[j]] = _checked(x, ps[j], *ends_of[place], values[place])
    return QuantilePlan(rows, aggregates)


def _group_sketches(
    wanted: Mapping[str, Sequence[float]], margin: float | None = None
) -> list[Column]:
    out = []
    for i, (column, ps) in enumerate(wanted.items()):
        x = F.col(column).cast("double")
        if margin is None:
            sketch = _sketch(x)
        else:
            ends = [max(p - margin, 0.0) for p in ps] + [min(p + margin, 1.0) for p in ps]
            sketch = F.percentile_approx(x, ends, FINEST_ACCURACY)
        out += [
            F.count(x).alias(f"__n{i}"),
            F.min(x).alias(f"__min{i}"),
            F.max(x).alias(f"__max{i}"),
            sketch.alias(f"__s{i}"),
        ]
    return out


def _checked(x: Column, p: float, low: Column, high: Column, value: Column) -> Column:
    n = F.count(x)
    rank = F.lit(float(p)) * (n - 1)
    inside = (F.count_if(x < low) <= F.floor(rank)) & (
        F.count_if(x <= high) > F.floor(rank) + F.when(rank > F.floor(rank), 1).otherwise(0)
    )
    return (
        F.when(n == 0, F.lit(None).cast("double"))
        .when(inside, value)
        .otherwise(F.raise_error(F.lit("quantile outside its bracket")).cast("double"))
    )
