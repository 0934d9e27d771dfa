"""Regression forests and boosted trees from histograms of binned rows, as Spark jobs.

A fit makes many passes over the rows, so they are binned once: a feature becomes one byte, the number of
candidate thresholds below it, and rows become blocks of bytes in the checkpoint folder.  Thresholds, gains
and stopping rules are those of Spark's own trees (at most 32 bins, variance, at least one row on a side).

Boosting adds the histograms of all blocks for one level of a tree; a node's histogram is a few kilobytes
whatever the number of its rows.  For deep trees that is far more than their rows: a tree of depth 15 has
more nodes than a node has rows.  A forest therefore splits nodes by added histograms only while they hold
more than ``ROWS_A_NODE`` rows.  Then the rows of every open node move to one task, which grows what is below.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel, TaskContext
from pyspark.ml.base import Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.ml.param.shared import HasFeaturesCol, HasPredictionCol
from pyspark.sql import DataFrame, functions as F

from riskweft.session import use_checkpoints

BINS = 32  # bins that thresholds are meant for
SAMPLE = 10_000  # rows that thresholds are taken from, as in Spark's trees
BLOCK = 1 << 14  # rows of a block
ROWS_A_NODE = 4_000_000  # rows of a bag that one task grows a tree or the rest of one from
CUT_EVERY = 25  # rounds of boosting between checkpoints
NOISE = 1e-13  # share of a node's squares below which a gain is rounding


# --- thresholds and blocks ---------------------------------------------------------------


def thresholds(rows: DataFrame, features: str, width: int, total: int, seed: int) -> list[np.ndarray]:
    """Candidate thresholds per feature, found as Spark's trees find them, in the same sample of rows."""
    spark, picked = rows.sparkSession, rows.select(features)
    share = min(1.0, max(BINS * BINS, SAMPLE) / total)
    if share < 1:
        draw = spark.sparkContext._jvm.org.apache.spark.util.random.XORShiftRandom(seed).nextInt()
        sample = picked._jdf.javaRDD().sample(False, share, draw)
        picked = DataFrame(spark._jsparkSession.createDataFrame(sample, picked._jdf.schema()), spark)
    # About SAMPLE rows, whatever the table.
    found = np.array([r[0].toArray() for r in picked.collect()]).reshape(-1, width)
    return [_cuts(found[:, j], share * total, min(BINS, total) - 1) for j in range(width)]


def _cuts(values: np.ndarray, expected: float, most: int) -> np.ndarray:
    """Midpoints between neighbouring values: all, or those next to equal shares of the rows."""
    some = values[values != 0]
    if not len(some):
        return np.zeros(0)
    value, count = np.unique(some, return_counts=True)
    count = count.astype(float)
    # Rows that are missing from the expected number count as zeros.
    if expected - len(some) > np.finfo(float).eps * len(some) * 100:
        at = np.searchsorted(value, 0.0)
        value, count = np.insert(value, at, 0.0), np.insert(count, at, expected - len(some))
    middle = (value[:-1] + value[1:]) / 2
    if len(middle) <= most:
        return middle
    stride, upto = expected / (most + 1), np.cumsum(count)
    cuts, target = [], stride
    for i in range(1, len(value)):
        if abs(upto[i - 1] - target) < abs(upto[i] - target):
            cuts.append(middle[i - 1])
            target += stride
    return np.array(cuts)


def codes_of(x: np.ndarray, cuts: Sequence[np.ndarray]) -> np.ndarray:
    """(features, rows): how many thresholds a value exceeds."""
    return np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)]).astype(np.uint8)


@dataclass(frozen=True)
class Binned:
    """Blocks (number, codes, labels) of the rows of a table and the thresholds of their codes."""

    blocks: RDD
    cuts: list[np.ndarray]
    rows: int

    @property
    def bins(self) -> int:
        """Codes of the feature that has most; a sample larger than expected has more than ``BINS``."""
        return 1 + max(map(len, self.cuts))


def binned(rows: DataFrame, features: str, label: str, total: int, tasks: int, seed: int) -> Binned:
    """The rows as blocks in the checkpoint folder, read by ``tasks`` tasks."""
    spark = rows.sparkSession
    if not total:
        raise ValueError("No rows to train on")
    width = rows.select(features).first()[0].size
    cuts = thresholds(rows, features, width, total, seed)

    def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in _and_none(batches):
            if batch is not None:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                y = batch.column(1).to_numpy(zero_copy_only=False)
                if np.isnan(x).any() or not np.isfinite(y).all():
                    raise ValueError("Features must be numbers and labels finite")
                held.append((codes_of(x, cuts), y))
                size += batch.num_rows
            while size >= BLOCK or (batch is None and size):
                code, y = np.concatenate([c for c, _ in held], axis=1), np.concatenate([v for _, v in held])
                held, size = [(code[:, BLOCK:], y[BLOCK:])], max(0, size - BLOCK)
                yield pa.RecordBatch.from_pydict(
                    {"number": [number], "codes": [code[:, :BLOCK].tobytes()], "labels": [y[:BLOCK].astype(float).tobytes()]}
                )
                number += 1

    use_checkpoints(spark)
    kept = rows.select(vector_to_array(features), label).mapInArrow(blocks, "number bigint, codes binary, labels binary")
    kept = kept.rdd.map(lambda r: (r.number, bytes(r.codes), bytes(r.labels))).coalesce(tasks)
    kept.persist(StorageLevel.MEMORY_AND_DISK)
    kept.checkpoint()
    kept.count()
    return Binned(kept, cuts, total)


def _and_none(items: Iterable) -> Iterator:
    yield from items
    yield None


# --- trees -------------------------------------------------------------------------------


class Tree:
    """Nodes in order of their making; the right child follows the left one, a leaf has no feature."""

    def __init__(self, n: float = 0.0, s: float = 0.0):
        self.feature, self.code, self.left = np.full(1, -1, np.int16), np.zeros(1, np.uint8), np.zeros(1, np.int32)
        self.value, self.gain = np.array([s / n if n else 0.0]), np.zeros(1)

    PARTS = ("feature", "code", "left", "value", "gain")

    def parts(self) -> tuple[np.ndarray, ...]:
        """Plain arrays, which reach a task that cannot import this module."""
        return tuple(getattr(self, name) for name in self.PARTS)

    @classmethod
    def of(cls, parts: Sequence[np.ndarray]) -> "Tree":
        tree = cls()
        for name, part in zip(cls.PARTS, parts):
            setattr(tree, name, part)
        return tree

    def split(self, nodes: np.ndarray, best: "Splits") -> np.ndarray:
        """Split those of the given leaves that gain by it; returns the new leaves."""
        on = best.worth()
        at, k = nodes[on], int(on.sum())
        first = len(self.feature)
        self.feature[at], self.code[at], self.gain[at] = best.feature[on], best.code[on], best.gain[on]
        self.left[at] = first + 2 * np.arange(k)
        with np.errstate(divide="ignore", invalid="ignore"):
            below = np.stack([best.s_left / best.n_left, (best.s - best.s_left) / (best.n - best.n_left)], axis=1)[on].ravel()
        self._add(np.full(2 * k, -1, np.int16), np.zeros(2 * k, np.uint8), np.zeros(2 * k, np.int32), below, np.zeros(2 * k))
        return first + np.arange(2 * k)

    def _add(self, *parts: np.ndarray) -> None:
        for name, part in zip(self.PARTS, parts):
            setattr(self, name, np.concatenate([getattr(self, name), part]))

    def graft(self, node: int, other: "Tree") -> None:
        """``other`` in place of a leaf: its root becomes the leaf, its other nodes follow."""
        shift = len(self.feature) - 1
        left = np.where(other.feature >= 0, other.left + shift, 0).astype(np.int32)
        for name in ("feature", "code", "gain", "value"):
            getattr(self, name)[node] = getattr(other, name)[0]
        self.left[node] = left[0]
        self._add(other.feature[1:], other.code[1:], left[1:], other.value[1:], other.gain[1:])

    def down(self, codes: np.ndarray, levels: int) -> np.ndarray:
        """The node that each row of ``codes`` (features, rows) reaches after at most so many steps."""
        rows = np.arange(codes.shape[1])
        flat, width = codes.ravel(), codes.shape[1]
        node = np.zeros(width, np.int32)
        leaf = self.feature < 0
        # A leaf leads to itself: its code is never exceeded.
        offset = np.where(leaf, 0, self.feature).astype(np.int64) * width
        limit = np.where(leaf, 255, self.code).astype(np.uint8)
        left = np.where(leaf, np.arange(len(leaf)), self.left).astype(np.int32)
        for _ in range(levels):
            node = left[node] + (flat[offset[node] + rows] > limit[node])
        return node


class Splits:
    """Best split of each of ``k`` nodes so far; features are offered one after the other."""

    def __init__(self, k: int):
        self.score, self.feature, self.code = np.full(k, -np.inf), np.full(k, -1, np.int16), np.zeros(k, np.uint8)
        self.n_left, self.s_left = np.zeros(k), np.zeros(k)
        self.n = self.s = np.zeros(k)

    @classmethod
    def of(cls, parts: dict[str, np.ndarray]) -> "Splits":
        best = cls(0)
        vars(best).update(parts)
        return best

    def offer(self, feature: int, n: np.ndarray, s: np.ndarray) -> None:
        """Rows and sums (nodes, bins) of a feature; the first best split of the first best feature stays."""
        n, s = np.cumsum(n, axis=1), np.cumsum(s, axis=1)
        total, whole = n[:, -1:], s[:, -1:]
        if self.feature.max(initial=-1) < 0:
            self.n, self.s = total[:, 0].copy(), whole[:, 0].copy()
        n, s = n[:, :-1], s[:, :-1]
        with np.errstate(divide="ignore", invalid="ignore"):
            score = s * s / n + (whole - s) ** 2 / (total - n)
        score[(n <= 0) | (n >= total)] = -np.inf
        at = np.argmax(score, axis=1)
        each = np.arange(len(at))
        found = score[each, at]
        more = found > self.score
        self.score = np.where(more, found, self.score)
        self.feature, self.code = np.where(more, feature, self.feature).astype(np.int16), np.where(more, at, self.code).astype(np.uint8)
        self.n_left, self.s_left = np.where(more, n[each, at], self.n_left), np.where(more, s[each, at], self.s_left)

    @property
    def gain(self) -> np.ndarray:
        """Rows times what their variance loses."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return self.score - self.s * self.s / self.n

    def worth(self) -> np.ndarray:
        return (self.feature >= 0) & (self.gain > NOISE * np.abs(self.score))


def grown(codes: np.ndarray, weight: np.ndarray, label: np.ndarray, depth: int, bins: int) -> Tree:
    """A tree of rows that one task holds."""
    sums = weight * label
    tree = Tree(weight.sum(), sums.sum())
    open_nodes, slot = np.zeros(1, np.int32), np.zeros(codes.shape[1], np.int64)
    for _ in range(depth):
        k = len(open_nodes)
        if not k:
            break
        best, base = Splits(k), slot * bins
        for f, code in enumerate(codes):
            at = base + code
            best.offer(
                f, np.bincount(at, weight, k * bins).reshape(k, bins), np.bincount(at, sums, k * bins).reshape(k, bins)
            )
        on = best.worth()
        place = np.where(on, 2 * (np.cumsum(on) - 1), -1)
        right = codes.ravel()[best.feature.astype(np.int64)[slot] * codes.shape[1] + np.arange(codes.shape[1])] > best.code[slot]
        slot = place[slot] + right
        if not on.all():
            stay = on[base // bins]
            codes, weight, sums, slot = codes[:, stay], weight[stay], sums[stay], slot[stay]
        open_nodes = tree.split(open_nodes, best)
    return tree


# --- forests -----------------------------------------------------------------------------


def _bag(seed: int, tree: int, number: int, rows: int, alone: bool) -> np.ndarray:
    """How often each row of a block is drawn for a tree: with replacement, as many as there are."""
    if alone:
        return np.ones(rows)
    return np.random.default_rng([seed, tree, number]).poisson(1.0, rows).astype(float)


def _block(block, width: int) -> tuple[int, np.ndarray, np.ndarray]:
    number, codes, labels = block
    return number, np.frombuffer(codes, np.uint8).reshape(width, -1), np.frombuffer(labels, float)


def _histograms(codes: np.ndarray, slot: np.ndarray, weight: np.ndarray | None, sums: np.ndarray, k: int, bins: int) -> np.ndarray:
    """(2, features, k * bins): rows and sums; slot ``k`` holds rows of no interest."""
    out = np.empty((2, len(codes), k * bins))
    base = slot.astype(np.int64) * bins
    for f, code in enumerate(codes):
        at = base + code
        out[0, f] = np.bincount(at, weight, (k + 1) * bins)[: k * bins]
        out[1, f] = np.bincount(at, sums, (k + 1) * bins)[: k * bins]
    return out


def _best(found: np.ndarray, bins: int) -> Splits:
    k = found.shape[2] // bins
    best = Splits(k)
    for f in range(found.shape[1]):
        best.offer(f, found[0, f].reshape(k, bins), found[1, f].reshape(k, bins))
    return best


def _slots(tree: Tree, open_nodes: np.ndarray) -> np.ndarray:
    """Place of each node among the open ones, or the place after the last."""
    out = np.full(len(tree.feature), len(open_nodes), np.int32)
    out[open_nodes] = np.arange(len(open_nodes))
    return out


def fit_forest(data: Binned, trees: int, depth: int, seed: int) -> list[Tree]:
    """Trees over bags of the rows, each bag drawn with replacement."""
    context, width, bins, alone = data.blocks.context, len(data.cuts), data.bins, trees == 1
    made = [Tree() for _ in range(trees)]
    # Open nodes (node, rows, depth) that are split by added histograms, and those that a task grows.
    large = {t: np.zeros(1, np.int32) for t in range(trees)} if data.rows > ROWS_A_NODE and depth else {}
    small: list[tuple[int, int, int]] = [] if large else [(t, 0, depth) for t in range(trees)]
    level = 0
    while large:
        sent = context.broadcast({t: (made[t].parts(), len(nodes), _slots(made[t], nodes)) for t, nodes in large.items()})

        def add(blocks, sent=sent, level=level):
            held: dict[int, np.ndarray] = {}
            for number, codes, label in (_block(b, width) for b in blocks):
                for t, (tree, k, slots) in sent.value.items():
                    weight = _bag(seed, t, number, len(label), alone)
                    part = _histograms(codes, slots[Tree.of(tree).down(codes, level)], weight, weight * label, k, bins)
                    held[t] = held[t] + part if t in held else part
            return iter(held.items())

        added = data.blocks.mapPartitions(add).reduceByKey(lambda a, b: a + b, min(trees, data.blocks.getNumPartitions()))
        for t, found in added.mapValues(lambda h: vars(_best(h, bins))).collect():
            tree, nodes, best = made[t], large.pop(t), Splits.of(found)
            if not level:
                tree.value[0] = best.s[0] / best.n[0] if best.n[0] else 0.0
            on = best.worth()
            new = tree.split(nodes, best)
            rows = np.stack([best.n_left, best.n - best.n_left], axis=1)[on].ravel()
            if level + 1 < depth:
                small += [(t, int(node), depth - level - 1) for node in new[rows <= ROWS_A_NODE]]
                if (rows > ROWS_A_NODE).any():
                    large[t] = new[rows > ROWS_A_NODE]
        sent.destroy()
        level += 1
    _grow_rest(data, made, small, level, seed, alone)
    return made


def _grow_rest(data: Binned, made: list[Tree], small: list[tuple[int, int, int]], level: int, seed: int, alone: bool) -> None:
    """Grow the open nodes (tree, node, levels left), each from its rows in one task."""
    if not small:
        return
    context, width, bins = data.blocks.context, len(data.cuts), data.bins
    at: dict[int, list[int]] = {}
    for place, (t, node, _) in enumerate(small):
        at.setdefault(t, []).append(place)
    sent = context.broadcast({t: (made[t].parts(), places, _slots(made[t], np.array([small[p][1] for p in places]))) for t, places in at.items()})
    left = [d for _, _, d in small]

    def deal(block):
        number, codes, label = _block(block, width)
        for t, (tree, places, slots) in sent.value.items():
            weight = _bag(seed, t, number, len(label), alone)
            slot = np.where(weight > 0, slots[Tree.of(tree).down(codes, level)], len(places))
            for i, place in enumerate(places):
                rows = np.flatnonzero(slot == i)
                if len(rows):
                    yield place, (number, codes[:, rows].tobytes(), weight[rows].astype(np.uint16).tobytes(), label[rows].tobytes())

    def grow(pieces):
        held: dict[int, list] = {}
        for place, piece in pieces:
            held.setdefault(place, []).append(piece)
        for place in list(held):
            # In the order of the blocks, so that sums do not depend on which piece came first.
            parts = sorted(held.pop(place), key=lambda p: p[0])
            codes = np.concatenate([np.frombuffer(c, np.uint8).reshape(width, -1) for _, c, _, _ in parts], axis=1)
            weight = np.concatenate([np.frombuffer(w, np.uint16) for _, _, w, _ in parts]).astype(float)
            label = np.concatenate([np.frombuffer(y, float) for _, _, _, y in parts])
            del parts
            yield place, grown(codes, weight, label, left[place], bins).parts()

    dealt = data.blocks.flatMap(deal).partitionBy(len(small), lambda place: place)
    for place, tree in dealt.mapPartitions(grow).collect():
        made[small[place][0]].graft(small[place][1], Tree.of(tree))
    sent.destroy()


# --- boosting ----------------------------------------------------------------------------


def fit_boosted(data: Binned, rounds: int, depth: int, rate: float) -> list[tuple[float, Tree]]:
    """(weight, tree): the first tree fits the labels, each later one twice what is left of them."""
    context, width, bins = data.blocks.context, len(data.cuts), data.bins
    state, stale, made = data.blocks, None, []
    for turn in range(rounds):
        tree, nodes = Tree(), np.zeros(1, np.int32)
        for level in range(max(depth, 1)):
            sent = context.broadcast((tree.parts(), len(nodes), _slots(tree, nodes)))

            def add(blocks, sent=sent, level=level):
                tree, k, slots = sent.value
                tree = Tree.of(tree)
                total = np.zeros((2, width, k * bins))
                for _, codes, label in (_block(b, width) for b in blocks):
                    total += _histograms(codes, slots[tree.down(codes, level)], None, label, k, bins)
                yield total

            best = _best(sum(state.mapPartitions(add).collect()), bins)
            sent.destroy()
            if stale is not None:
                stale.unpersist()
                stale = None
            if not level:
                tree.value[0] = best.s[0] / best.n[0] if best.n[0] else 0.0
            nodes = tree.split(nodes, best) if depth else nodes[:0]
            if not len(nodes):
                break
        weight = rate if turn else 1.0
        made.append((weight, tree))
        if turn + 1 == rounds:
            break
        sent = context.broadcast(tree.parts())

        def rest(block, sent=sent, weight=weight, first=not turn):
            number, codes, label = _block(block, width)
            tree = Tree.of(sent.value)
            given = tree.value[tree.down(codes, depth)]
            return number, block[1], ((label - given) * 2 if first else label - 2 * weight * given).tobytes()

        # Kept by the first pass of the next round.
        stale, state = state if turn else None, state.map(rest).persist(StorageLevel.MEMORY_AND_DISK)
        if turn % CUT_EVERY == CUT_EVERY - 1:
            state.checkpoint()
    if state is not data.blocks:
        state.unpersist()
    return made


# --- models ------------------------------------------------------------------------------


class TreesModel(Model, HasFeaturesCol, HasPredictionCol):
    """A fitted forest (the mean of its trees) or boosted trees (their weighted sum)."""

    def __init__(self, cuts: list[np.ndarray], trees: list[Tree], weights: list[float], features: str, mean: bool, depth: int):
        super().__init__()
        self.cuts, self.trees, self.treeWeights, self.mean, self.depth = cuts, trees, weights, mean, depth
        self._setDefault(featuresCol=features, predictionCol="prediction")

    @property
    def featureImportances(self) -> DenseVector:
        """Gains by feature, as shares; each tree of a forest counts the same."""
        total = np.zeros(len(self.cuts))
        for tree in self.trees:
            inner = tree.feature >= 0
            gains = np.bincount(tree.feature[inner], tree.gain[inner], len(total))
            total += gains / gains.sum() if self.mean and gains.sum() else gains
        return Vectors.dense(total / total.sum() if total.sum() else total)

    @property
    def shares(self) -> list[float]:
        """What each tree counts in a prediction."""
        whole = sum(self.treeWeights) if self.mean else 1.0
        return [w / whole for w in self.treeWeights]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        sent = dataset.sparkSession.sparkContext.broadcast((self.cuts, [t.parts() for t in self.trees], self.shares, self.depth))

        @F.pandas_udf("double")
        def predicted(x: pd.Series) -> pd.Series:
            cuts, trees, shares, depth = sent.value
            out = np.zeros(len(x))
            if len(x):
                codes = codes_of(np.stack(x.to_numpy()), cuts)
                for tree, share in zip(trees, shares):
                    tree = Tree.of(tree)
                    out += share * tree.value[tree.down(codes, depth)]
            return pd.Series(out)

        return dataset.withColumn(self.getPredictionCol(), predicted(vector_to_array(self.getFeaturesCol())))
