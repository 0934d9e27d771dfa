"""Correlation and covariance matrices in long form ``(column1, column2, value)``."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from riskweft.functions.tables import nan_to_null
from riskweft.functions.labels import correlation_strength
from riskweft.operators.ordering import running_total, sorted_blocks, with_position
from riskweft.roles import pick_numeric
from riskweft.session import checkpointed

METHODS = ("pearson", "spearman", "kendall")

# Kendall: distinct pairs one task sorts, and values of a digit of their places.
BLOCK_ROWS = 100_000
# Ranks: rows that one task joins with their ranks, and the share of rows, one in so many, above which a value's rank is
# sent along.
RANK_ROWS = 200_000
FREQUENT = 256
DIGITS = 1_024


def pearson(x: str, y: str) -> Column:
    """Correlation over rows where both are present; null when either is constant."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a = F.when(both, F.col(x).cast("double"))
    b = F.when(both, F.col(y).cast("double"))
    return F.try_divide(F.covar_samp(a, b), F.stddev_samp(a) * F.stddev_samp(b))


def _columns(df: DataFrame, columns: Sequence[str] | None) -> list[str]:
    names = pick_numeric(df, columns)
    if len(names) < 2:
        raise ValueError("Need at least 2 columns for multivariate analysis")
    return names


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@dataclass(frozen=True)
class _Pair:
    """Sums of one pair of columns over the rows where both are present."""

    n: int
    sx: float
    sy: float
    sxx: float
    syy: float
    sxy: float
    varies: bool

    def covariance(self) -> float | None:
        return (self.sxy - self.sx * self.sy / self.n) / (self.n - 1) if self.n > 1 else None

    def correlation(self) -> float | None:
        if self.n < 2 or not self.varies:
            return None
        xx = self.sxx - self.sx**2 / self.n
        yy = self.syy - self.sy**2 / self.n
        if xx <= 0 or yy <= 0:
            return None
        r = (self.sxy - self.sx * self.sy / self.n) / (math.sqrt(xx) * math.sqrt(yy))
        return max(-1.0, min(1.0, r))


def _pair_sums(
    df: DataFrame, names: Sequence[str], centres: dict[str, float] | None = None
) -> dict[tuple[str, str], _Pair]:
    """All pairs (and each column with itself) from one row of plain sums.

    Values are shifted by their column mean first, so the products do not cancel.
    Columns without nulls share their sums over all pairs.  Known ``centres`` of
    complete columns save the pass that finds the means.
    """
    x = {c: F.col(c).cast("double") for c in names}
    if centres is None:
        row = df.agg(
            F.count(F.lit(1)).alias("rows"),
            *[F.count(c).alias(f"n{i}") for i, c in enumerate(names)],
            *[F.avg(x[c]).alias(f"m{i}") for i, c in enumerate(names)],
        ).first()
        centres = {c: row[f"m{i}"] or 0.0 for i, c in enumerate(names)}
        complete = {c for i, c in enumerate(names) if row[f"n{i}"] == row["rows"]}
    else:
        complete = set(names)
    d = {c: x[c] - F.lit(float(centres[c])) for c in names}
    pairs = [(c, c) for c in names] + list(combinations(names, 2))
    aggregates = []
    for i, c in enumerate(names):
        aggregates += [
            F.count(x[c]).alias(f"n{i}"),
            F.sum(d[c]).alias(f"s{i}"),
            F.sum(d[c] * d[c]).alias(f"ss{i}"),
            (F.min(x[c]) < F.max(x[c])).alias(f"v{i}"),
        ]
    for k, (a, b) in enumerate(pairs):
        if a == b:
            continue
        aggregates.append(F.sum(d[a] * d[b]).alias(f"xy{k}"))
        if not {a, b} <= complete:
            both = x[a].isNotNull() & x[b].isNotNull()
            p, q = F.when(both, d[a]), F.when(both, d[b])
            aggregates += [
                F.count(p).alias(f"pn{k}"),
                F.sum(p).alias(f"px{k}"),
                F.sum(q).alias(f"py{k}"),
                F.sum(p * p).alias(f"pxx{k}"),
                F.sum(q * q).alias(f"pyy{k}"),
                ((F.min(p) < F.max(p)) & (F.min(q) < F.max(q))).alias(f"pv{k}"),
            ]
    row = df.agg(*aggregates).first()
    place = {c: i for i, c in enumerate(names)}
    out = {}
    for k, (a, b) in enumerate(pairs):
        i, j = place[a], place[b]
        if a == b:
            values = [row[f"n{i}"], row[f"s{i}"], row[f"s{i}"], *[row[f"ss{i}"]] * 3, row[f"v{i}"]]
        elif {a, b} <= complete:
            values = [
                row[f"n{i}"], row[f"s{i}"], row[f"s{j}"], row[f"ss{i}"], row[f"ss{j}"],
                row[f"xy{k}"], row[f"v{i}"] and row[f"v{j}"],
            ]
        else:
            values = [row[f"p{m}{k}"] for m in ("n", "x", "y", "xx", "yy")]
            values += [row[f"xy{k}"], row[f"pv{k}"]]
        out[a, b] = _Pair(*[0 if v is None else v for v in values[:6]], bool(values[6]))
    return out


def _long(df: DataFrame, values: dict[tuple[str, str], float | None]) -> DataFrame:
    rows = [(a, b, v) for (a, b), v in values.items()]
    rows += [(b, a, v) for (a, b), v in values.items() if a != b]
    return df.sparkSession.createDataFrame(rows, "column1 string, column2 string, value double")


def covariance_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    df = nan_to_null(df)
    pairs = _pair_sums(df, _columns(df, columns))
    return _long(df, {k: p.covariance() for k, p in pairs.items()})


def correlation_matrix(
    df: DataFrame, columns: Sequence[str] | None = None, method: str = "pearson"
) -> DataFrame:
    """Pearson, Spearman or Kendall (tau-b) matrix over pairwise complete rows."""
    df = nan_to_null(df)
    if method not in METHODS:
        raise ValueError(f"Method must be one of {METHODS}")
    names = _columns(df, columns)
    if method == "pearson":
        return _long(df, _correlations(_pair_sums(df, names)))
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in names])
    if method == "kendall":
        # Equal rows are counted once and written: every pair of columns starts from them, not from the input.
        rows = checkpointed(rows.groupBy(*names).agg(F.count(F.lit(1)).alias("__copies")))
        values = {(a, b): _tau(rows, a, b, F.col("__copies")).first()["tau"] for a, b in combinations(names, 2)}
        return _long(df, {**_diagonal(rows, names), **values})

    found = rows.agg(
        F.count(F.lit(1)).alias("rows"), *[F.count(c).alias(f"n{i}") for i, c in enumerate(names)]
    ).first()
    if all(found[f"n{i}"] == found["rows"] for i in range(len(names))):
        return _long(df, _rank_correlations(rows, names, found["rows"]))
    values = {}
    for a, b in combinations(names, 2):
        pair = rows.select(a, b).dropna()
        values[a, b] = _rank_correlations(pair, [a, b])[a, b]
    return _long(df, {**_diagonal(rows, names), **values})


def _correlations(pairs: dict[tuple[str, str], _Pair]) -> dict[tuple[str, str], float | None]:
    return {(a, b): (1.0 if p.varies else None) if a == b else p.correlation() for (a, b), p in pairs.items()}


def _rank_correlations(rows: DataFrame, names: Sequence[str], n: int | None = None):
    # Average ranks of n rows have the mean (n + 1) / 2, ties or not.
    n = rows.count() if n is None else n
    centres = dict.fromkeys(names, (n + 1) / 2)
    return _correlations(_pair_sums(average_ranks(rows, names), names, centres))


def _diagonal(rows: DataFrame, names: Sequence[str]) -> dict[tuple[str, str], float | None]:
    """1 for a column that varies, null where a correlation is undefined."""
    row = rows.agg(*[(F.min(c) < F.max(c)).alias(f"v{i}") for i, c in enumerate(names)]).first()
    return {(c, c): 1.0 if row[f"v{i}"] else None for i, c in enumerate(names)}


def highly_correlated(
    df: DataFrame, columns: Sequence[str] | None = None, above: float = 0.7
) -> DataFrame:
    """Pairs (each once, in column order) with |r| above the limit, and their label."""
    df = nan_to_null(df)
    names = _columns(df, columns)
    place = F.create_map(*[F.lit(v) for i, c in enumerate(names) for v in (c, i)])
    matrix = correlation_matrix(df, names)
    return (
        matrix.filter(place[F.col("column1")] < place[F.col("column2")])
        .filter(F.abs("value") > above)
        .select(
            "column1",
            "column2",
            F.col("value").alias("correlation"),
            correlation_strength(F.col("value")).alias("strength"),
        )
    )


# --- ranks -----------------------------------------------------------------------------


def average_ranks(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """Replace each value by its average rank in its column (no nulls in ``rows``).

    Values are counted first, so ties collapse before the sort and a frequent value is
    one row of it.  The cumulative count runs over sorted blocks.  Rows meet their ranks in tasks of
    about ``RANK_ROWS`` rows, however well they compress; the ranks of values that more than one in
    ``FREQUENT`` rows hold travel with the query, and their rows are spread over all tasks.
    """
    cells = F.array(
        *[F.struct(F.lit(i).alias("__c"), F.col(c).alias("__x")) for i, c in enumerate(names)]
    )
    counts = rows.select(F.inline(cells)).groupBy("__c", "__x").agg(F.count(F.lit(1)).alias("__n"))
    blocks = sorted_blocks(counts, ["__c", "__x"])
    ranks = running_total(blocks, F.col("__n"), "__below", within=["__c"]).select(
        "__c", "__x", "__n", (F.col("__below") + (F.col("__n") + 1) / 2.0).alias("__rank")
    )
    ranks = checkpointed(ranks)
    n = ranks.filter("__c = 0").agg(F.sum("__n")).first()[0] or 0
    known = ranks.filter(F.col("__n") * FREQUENT > n).collect()  # fewer than FREQUENT a column
    tasks = max(1, -(-n // RANK_ROWS))
    out = rows
    for i, c in enumerate(names):
        hot = [F.lit(v) for r in known if r["__c"] == i for v in (r["__x"], r["__rank"])]
        # A key of 64 bits is dealt to a fixed number of tasks; that values are equal is asked as well.
        value = F.col(c) + F.lit(0.0)
        rank = F.try_element_at(F.create_map(*hot), value) if hot else F.lit(None).cast("double")
        out = out.withColumn(f"__hot{i}", rank)
        spread = F.xxhash64(F.monotonically_increasing_id())
        key = F.when(F.col(f"__hot{i}").isNotNull(), spread).otherwise(F.xxhash64(value))
        out = out.withColumn(f"__key{i}", key).repartition(tasks, f"__key{i}")
        one = ranks.filter(F.col("__c") == i).select(
            F.xxhash64(F.col("__x") + F.lit(0.0)).alias(f"__of{i}"), F.col("__x").alias(f"__x{i}"), F.col("__rank").alias(f"__rank{i}")
        )
        one = one.repartition(tasks, f"__of{i}")
        same = (F.col(f"__key{i}") == F.col(f"__of{i}")) & (F.col(c) <= F.col(f"__x{i}")) & (F.col(c) >= F.col(f"__x{i}"))
        out = out.join(one, same, "left").drop(f"__key{i}", f"__of{i}", f"__x{i}")
    return out.select(*[F.coalesce(F.col(f"__hot{i}"), F.col(f"__rank{i}")).alias(c) for i, c in enumerate(names)])


def spearman_pair(pairs: DataFrame, x: str, y: str) -> DataFrame:
    """One row, one column: rank correlation of two complete columns."""
    return average_ranks(pairs.select(x, y), [x, y]).agg(pearson(x, y).alias("spearman"))


# --- Kendall ---------------------------------------------------------------------------


def weighted_inversions(y: np.ndarray, w: np.ndarray) -> float:
    """Sum of ``w[i] * w[j]`` over i < j with ``y[i] > y[j]``.

    Values are split by one bit of their rank at a time, from the highest: at each
    step a 1 standing before a 0 of the same prefix is an inversion.
    """
    if len(y) < 2:
        return 0.0
    _, rank = np.unique(y, return_inverse=True)
    w = w.astype(np.float64)
    total = 0.0
    for bit in range(int(rank.max()).bit_length() - 1, -1, -1):
        ones = ((rank >> bit) & 1).astype(bool)
        prefix = rank >> (bit + 1)
        weight_of_ones = np.where(ones, w, 0.0)
        before = np.cumsum(weight_of_ones) - weight_of_ones
        start = np.searchsorted(prefix, prefix, side="left")
        total += float(np.sum(np.where(ones, 0.0, w * (before - before[start]))))
        order = np.argsort(rank >> bit, kind="stable")
        rank, w = rank[order], w[order]
    return total


def _count_inversions(frame: pd.DataFrame, by: list[str], value: str) -> pd.DataFrame:
    ordered = frame.sort_values(by)
    found = weighted_inversions(ordered[value].to_numpy(), ordered["__n"].to_numpy())
    return pd.DataFrame({"d": [found]})


def _discordant(pairs: DataFrame, block_rows: int) -> DataFrame:
    """One row ``d``: weighted count of distinct pairs that are in opposite order.

    Points are numbered along both axes, ties included.  Two points differ first in one digit of
    their x places, so each digit is looked at once, among the points that agree in the higher ones.
    These are cut along y into blocks of about ``block_rows``: a block's task counts the inversions of
    the digit inside it, and adds what earlier blocks of the same points hold of larger digits, from
    a table of block totals.  Blocks keep their size whatever the number of points.
    """
    n = pairs.count()
    if n <= block_rows:
        # few enough distinct pairs for one task
        return pairs.groupBy().applyInPandas(lambda f: _count_inversions(f, ["__x", "__y"], "__y"), "d double")
    placed = with_position(pairs, ["__x", "__y"], "__px")
    placed = checkpointed(with_position(placed, ["__y", "__x"], "__py").select("__n", "__px", "__py"))
    width, parts = 1, []
    while width < n:
        parts.append(_digit_inversions(placed, width, -(-n // block_rows)))
        width *= DIGITS
    return _union(parts).agg(F.coalesce(F.sum("d"), F.lit(0.0)).alias("d"))


def _digit_inversions(placed: DataFrame, width: int, blocks: int) -> DataFrame:
    """Rows ``d``: discordant pairs whose x places differ first in the digit worth ``width``."""
    rows = placed.select(
        "__n", "__py", F.floor(F.col("__px") / F.lit(width * DIGITS)).alias("__group"), F.floor(F.col("__px") / F.lit(width)).alias("__code")
    )
    dealt = rows.repartitionByRange(blocks, "__group", "__py").withColumn("__block", F.spark_partition_id())
    dealt = checkpointed(dealt)
    totals = dealt.groupBy("__group", "__code", "__block").agg(F.sum("__n").alias("__t"))
    spans = totals.groupBy("__group").agg(F.min("__block").alias("__first"), F.max("__block").alias("__last"))
    # Groups of several blocks: a row per block and digit, at most two such groups a block.
    spans = spans.filter("__first < __last").select("__group", F.explode(F.sequence("__first", "__last")).alias("__block"))
    codes = totals.select("__group", "__code").distinct()
    dense = spans.join(codes, "__group").join(totals, ["__group", "__code", "__block"], "left")
    earlier = Window.partitionBy("__group", "__code").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    carried = dense.select(
        F.col("__group").alias("__of_group"), F.col("__code").alias("__of_code"), F.col("__block").alias("__of_block"),
        F.sum("__t").over(earlier).alias("__t"),
    ).filter("__t > 0")

    def count(block: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["__group", "__py"])
        found = weighted_inversions(block["__code"].to_numpy(), block["__n"].to_numpy())
        for group, held in before.sort_values("__of_code").groupby("__of_group"):
            mine = block[block["__group"] == group]
            upto = np.concatenate(([0.0], np.cumsum(held["__t"].to_numpy(float))))
            larger = upto[-1] - upto[np.searchsorted(held["__of_code"].to_numpy(), mine["__code"].to_numpy(), side="right")]
            found += float((larger * mine["__n"].to_numpy()).sum())
        return pd.DataFrame({"d": [found]})

    return dealt.groupBy("__block").cogroup(carried.groupBy("__of_block")).applyInPandas(count, "d double")


def kendall_tau(df: DataFrame, x: str, y: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row ``tau``: Kendall's tau-b over complete pairs; null for a constant column."""
    return _tau(nan_to_null(df), x, y, F.lit(1).cast("bigint"), block_rows)


def _tau(df: DataFrame, x: str, y: str, copies: Column, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``kendall_tau`` over rows that stand for ``copies`` equal ones each."""
    rows = df.select(
        F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y"), copies.alias("__n")
    ).dropna()
    # Counted once and written: every part below reads the distinct pairs again.
    pairs = checkpointed(rows.groupBy("__x", "__y").agg(F.sum("__n").alias("__n")))

    def tied(frame: DataFrame, *keys: str) -> Column:
        n = F.col("__t").cast("double")
        groups = frame.groupBy(*keys).agg(F.sum("__n").alias("__t"))
        return groups.agg(F.coalesce(F.sum(n * (n - 1) / 2), F.lit(0.0))).scalar()

    both = F.col("__n").cast("double")
    totals = pairs.agg(
        F.sum("__n").cast("double").alias("__all"),
        F.coalesce(F.sum(both * (both - 1) / 2), F.lit(0.0)).alias("__txy"),
    )
    found = _discordant(pairs, block_rows).agg(F.coalesce(F.max("d"), F.lit(0.0))).scalar()
    parts = totals.select(
        (F.col("__all") * (F.col("__all") - 1) / 2).alias("p"),
        tied(pairs, "__x").alias("tx"),
        tied(pairs, "__y").alias("ty"),
        "__txy",
        found.alias("d"),
    )
    agreement = F.col("p") - F.col("tx") - F.col("ty") + F.col("__txy") - 2 * F.col("d")
    norm = F.sqrt(F.col("p") - F.col("tx")) * F.sqrt(F.col("p") - F.col("ty"))
    return parts.select(F.try_divide(agreement, norm).alias("tau"))
