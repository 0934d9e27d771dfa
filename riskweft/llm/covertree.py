"""Exact top-k search by inner product with two cover trees.

Vectors are integers (floor of a multiple of each component).  A bounded sample gives pivots; every
vector belongs to its nearest pivot's cell, and a cell of many vectors is dealt into blocks of about
``block_rows``.  A block's vectors form a cover tree: a node holds a centre and the covering radius of its
members, children cover them at a smaller radius.  The queries that reach a block form a second tree.
Both are walked together: a pair of nodes is left as soon as the largest inner product that their radii
allow is below the worst k-th score of the query node's members.

Before any block is searched, a query has a k-th score from the sample, and visits only cells whose
radius still allows better ones.  Queries travel to blocks (never the other way), arrive after the
block's vectors in the sort order of a partition, and are answered batch by batch: a task holds one block
and one batch.  Each (query, block) pair sends at most k rows on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from riskweft.llm.store import stored

SAMPLE = 2_048  # vectors that give pivots and first bounds
PIVOTS = 48
BLOCK_ROWS = 4_096
LEAF = 24
SHRINK = 0.75  # radius of the children's net, relative to the node's
QUERY_BATCH = 1_024


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component; null where the vector takes no part in a search."""
    finite = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf"))
    )
    return F.when(finite, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("bigint")))


def _matrix(column: pa.ListArray) -> np.ndarray:
    """Rows of vectors as floats (whole numbers below 2**53 are exact); short ones are filled with zeros."""
    bounds = column.offsets.to_numpy()
    size = np.diff(bounds)
    width = int(size.max()) if len(size) else 0
    values = column.values.to_numpy(zero_copy_only=False)[bounds[0] : bounds[-1]].astype(np.float64)
    out = np.zeros((len(size), width))
    out[np.arange(width) < size[:, None]] = values
    return out


def _fitted(rows: np.ndarray, width: int) -> np.ndarray:
    return np.pad(rows, ((0, 0), (0, width - rows.shape[1]))) if rows.shape[1] < width else rows


class CoverTree:
    """Nodes over rows of a matrix; ``order`` permutes the rows so that every node is a range of it."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points = points
        centre, radius, first, last, child = [], [], [], [], []
        self.order = order = np.arange(len(points))
        if len(points):
            middle = self._nearest_to_mean(order)
            centre, radius, first, last, child = [middle], [self._radius(order, middle)], [0], [len(points)], [(0, 0)]
            work = [0]  # children of a node stand together
            while work:
                node = work.pop()
                a, b = first[node], last[node]
                if b - a <= leaf or radius[node] == 0:
                    continue
                groups = self._net(order[a:b], centre[node], radius[node] * SHRINK)
                if len(groups) < 2:
                    continue
                begin, at = len(centre), a
                for head, members in groups:
                    order[at : at + len(members)] = members
                    centre.append(head)
                    radius.append(self._radius(members, head))
                    first.append(at)
                    last.append(at + len(members))
                    child.append((0, 0))
                    at += len(members)
                child[node] = (begin, len(centre))
                work.extend(range(begin, len(centre)))
        self.centre = points[centre] if centre else np.zeros((0, points.shape[1]))
        self.norm = np.sqrt((self.centre**2).sum(axis=1))
        # Rounding must not shrink a bound.
        self.radius = np.array(radius) * (1 + 1e-9)
        self.first, self.last = np.array(first, np.int64), np.array(last, np.int64)
        self.child = np.array(child, np.int64).reshape(-1, 2)

    def _distance(self, rows: np.ndarray, head: int) -> np.ndarray:
        return np.sqrt(((self.points[rows] - self.points[head]) ** 2).sum(axis=1))

    def _radius(self, rows: np.ndarray, head: int) -> float:
        return float(self._distance(rows, head).max())

    def _nearest_to_mean(self, rows: np.ndarray) -> int:
        mean = self.points[rows].mean(axis=0)
        return int(rows[((self.points[rows] - mean) ** 2).sum(axis=1).argmin()])

    def _net(self, rows: np.ndarray, head: int, reach: float) -> list[tuple[int, np.ndarray]]:
        """Greedy net of the rows: each row joins the first head within reach."""
        groups, left = [], rows
        while len(left):
            distance = self._distance(left, head)
            near = distance <= reach
            if not near.any():
                head = int(left[0])
                continue
            groups.append((head, left[near]))
            left, distance = left[~near], distance[~near]
            if len(left):
                head = int(left[distance.argmax()])
        return groups


class Best:
    """The k best (score, id) of each query; ties to the smaller id."""

    def __init__(self, floor: np.ndarray, k: int):
        self.score = np.full((len(floor), k), -np.inf)
        self.id = np.full((len(floor), k), np.iinfo(np.int64).max)
        self.floor = floor  # a score that k other rows are known to reach

    def worst(self, queries: np.ndarray) -> float:
        return float(np.maximum(self.score[queries, -1], self.floor[queries]).min())

    def offer(self, queries: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        k = self.score.shape[1]
        score = np.concatenate((self.score[queries], scores), axis=1)
        id = np.concatenate((self.id[queries], np.broadcast_to(ids, scores.shape)), axis=1)
        id = np.where(np.isneginf(score), np.iinfo(np.int64).max, id)
        order = np.lexsort((id, -score), axis=1)[:, :k]
        self.score[queries] = np.take_along_axis(score, order, axis=1)
        self.id[queries] = np.take_along_axis(id, order, axis=1)


class Block:
    """A cover tree over the distinct vectors of a block, with the smallest ids of each."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, k: int):
        distinct, place = np.unique(points, axis=0, return_inverse=True)
        order = np.lexsort((ids, place))
        place, ids = place[order], ids[order]
        fresh = np.concatenate(([True], (place[1:] != place[:-1]) | (ids[1:] != ids[:-1])))
        place, ids = place[fresh], ids[fresh]  # a repeated row lies in the same block
        rank = np.arange(len(ids)) - np.searchsorted(place, place)
        keep = rank <= k  # one more than k, as a query may be among them
        self.tree = CoverTree(distinct)
        position = np.empty(len(distinct), np.int64)
        position[self.tree.order] = np.arange(len(distinct))
        place, ids = position[place[keep]], ids[keep]
        order = np.argsort(place, kind="stable")
        self.ids, self.points = ids[order], distinct[self.tree.order[place[order]]]
        self.bound = np.searchsorted(place[order], np.arange(len(distinct) + 1))

    def search(self, query_ids: np.ndarray, queries: np.ndarray, best: Best) -> None:
        other = CoverTree(queries, leaf=16)
        if len(other.centre) and len(self.tree.centre):
            self._pair(other, 0, np.array([0]), query_ids, queries, best)

    def _limit(self, other: CoverTree, node: int, nodes: np.ndarray) -> np.ndarray:
        """The largest inner product of a member of the query node and one of each node."""
        tree, radius = self.tree, other.radius[node]
        middle = tree.centre[nodes] @ other.centre[node]
        return (middle + radius * tree.norm[nodes] + tree.radius[nodes] * (other.norm[node] + radius)) + 1e-6

    def _kept(self, other: CoverTree, node: int, nodes: np.ndarray, members: np.ndarray, best: Best):
        limit = self._limit(other, node, nodes)
        keep = limit >= best.worst(members)
        return nodes[keep], limit[keep]

    def _opened(self, nodes: np.ndarray) -> np.ndarray:
        """Children of inner nodes; leaves stay."""
        spans = self.tree.child[nodes]
        inner = spans[:, 1] > spans[:, 0]
        opened = [np.arange(a, b) for a, b in spans[inner]]
        return np.concatenate([nodes[~inner], *opened]) if opened else nodes

    def _pair(self, other, node, nodes, query_ids, queries, best) -> None:
        members = other.order[other.first[node] : other.last[node]]
        nodes, _ = self._kept(other, node, nodes, members, best)
        a, b = other.child[node]
        if b > a:
            nodes = self._opened(nodes)
            nodes, limit = self._kept(other, node, nodes, members, best)
            for child in range(a, b):
                self._pair(other, child, nodes, query_ids, queries, best)
            return
        while True:
            opened = self._opened(nodes)
            done = len(opened) == len(nodes)
            nodes, limit = self._kept(other, node, opened, members, best)
            if done or not len(nodes):
                break
        # Most promising leaves first, several at once; the worst score rises in between.
        order = np.argsort(-limit)
        nodes, limit = nodes[order], limit[order]
        at, step = 0, 8
        while at < len(nodes) and limit[at] >= best.worst(members):
            group = nodes[at : at + step]
            rows = np.concatenate([np.arange(self.bound[self.tree.first[g]], self.bound[self.tree.last[g]]) for g in group])
            scores = queries[members] @ self.points[rows].T
            scores[query_ids[members][:, None] == self.ids[rows]] = -np.inf
            best.offer(members, scores, self.ids[rows])
            at, step = at + step, step * 2


def _pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Heads of a cover of the sample, farthest first."""
    if not len(sample):
        return sample
    chosen, distance = [0], ((sample - sample[0]) ** 2).sum(axis=1)
    while len(chosen) < count and distance.max() > 0:
        chosen.append(int(distance.argmax()))
        distance = np.minimum(distance, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


def _assign(pivots: np.ndarray):
    """(cell, distance to its pivot) of each vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _matrix(batch.column(1))
            width = max(rows.shape[1], pivots.shape[1])
            rows, heads = _fitted(rows, width), _fitted(pivots, width)
            square = (rows**2).sum(axis=1)[:, None] - 2 * rows @ heads.T + (heads**2).sum(axis=1)
            cell = square.argmin(axis=1)
            reach = np.sqrt(((rows - heads[cell]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(cell.astype(np.int32)), pa.array(reach)],
                names=["id", "vector", "cell", "reach"],
            )

    return run


def _routes(pivots, radius, blocks, sample_ids, sample, k):
    """(cell, salt, id, vector, floor) of each query for every block it must visit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                rows, ids = _matrix(batch.column(1)), batch.column(0).to_numpy()
                width = max(rows.shape[1], pivots.shape[1], sample.shape[1])
                rows = _fitted(rows, width)
                scores = rows @ _fitted(sample, width).T
                scores[ids[:, None] == sample_ids] = -np.inf
                floor = np.full(len(rows), -np.inf)
                if scores.shape[1] >= k:
                    floor = np.partition(scores, -k, axis=1)[:, -k]
                limit = rows @ _fitted(pivots, width).T + np.sqrt((rows**2).sum(axis=1))[:, None] * radius * (1 + 1e-9)
                query, cell = np.nonzero((limit + 1e-6 >= floor[:, None]) & (blocks > 0))
                count = blocks[cell]
                owner = np.repeat(np.arange(len(query)), count)
                salt = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(cell[owner].astype(np.int32)), pa.array(salt.astype(np.int32)),
                        batch.column(0).take(pa.array(query[owner])), batch.column(1).take(pa.array(query[owner])),
                        pa.array(floor[query[owner]]),
                    ],
                    names=["cell", "salt", "id", "vector", "floor"],
                )

    return run


def _search(k: int):
    """Answers the queries of each block; rows arrive by block, its vectors before its queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, block = None, [], None
        for whole in batches:
            cell, salt = whole.column(0).to_numpy(), whole.column(1).to_numpy()
            side = whole.column(2).to_numpy()
            change = (cell[1:] != cell[:-1]) | (salt[1:] != salt[:-1]) | (side[1:] != side[:-1])
            edges = [0, *(np.flatnonzero(change) + 1).tolist(), whole.num_rows]
            for a, b in zip(edges, edges[1:]):
                if b == a:
                    continue
                if (cell[a], salt[a]) != key:
                    key, held, block = (cell[a], salt[a]), [], None
                ids, rows = whole.column(3).slice(a, b - a).to_numpy(), _matrix(whole.column(4).slice(a, b - a))
                if side[a] == 0:
                    held.append((ids, rows))
                    continue
                if not held and block is None:
                    continue
                if block is None:
                    width = max(r.shape[1] for _, r in held)
                    block = Block(np.concatenate([i for i, _ in held]), np.concatenate([_fitted(r, width) for _, r in held]), k)
                    held = []
                floor = whole.column(5).slice(a, b - a).to_numpy()
                # A query's components beyond the block's width meet zeros.
                rows = _fitted(rows, block.points.shape[1])[:, : block.points.shape[1]]
                for at in range(0, len(ids), QUERY_BATCH):
                    part = slice(at, at + QUERY_BATCH)
                    best = Best(floor[part], k)
                    block.search(ids[part], rows[part], best)
                    query, rank = np.nonzero(~np.isneginf(best.score))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(ids[part][query]), pa.array(best.id[query, rank]),
                            pa.array(best.score[query, rank].astype(np.int64)),
                        ],
                        names=["query_id", "vec_id", "score"],
                    )

    return run


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int = 5, id: str = "vec_id", vector: str = "vector",
    sample: int = SAMPLE, pivots: int = PIVOTS, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of each query with other ids.

    ``vectors`` and ``queries`` have an id and an array of whole numbers (see ``quantised``) whose inner
    products stay below 2**53; null ids and vectors take no part.  Ties go to the smaller id, copies of a
    vector are candidates each, fewer candidates than k give fewer rows.  A shorter vector counts as
    filled with zeros.  Repeated rows (same id, same vector) count once.  Empty tables give an empty table.
    """
    pick = lambda df: df.select(F.col(id).cast("bigint").alias("id"), F.col(vector).cast("array<bigint>").alias("vector")).filter("id IS NOT NULL AND vector IS NOT NULL")
    points, asked = pick(vectors), pick(queries).distinct()
    # At most ``sample`` rows, each candidate once: a repeated row must not lift a floor by itself.
    drawn = points.distinct().orderBy(F.xxhash64("id"), "id", "vector").limit(sample).toPandas()
    width = max((len(v) for v in drawn["vector"]), default=0)
    matrix = np.zeros((len(drawn), width))
    for row, v in zip(matrix, drawn["vector"]):
        row[: len(v)] = v
    heads = _pivots(matrix, pivots)
    if not len(heads):
        heads = np.zeros((1, max(width, 1)))
    placed = stored(points.mapInArrow(_assign(heads), "id bigint, vector array<bigint>, cell int, reach double"), "cells")
    # One row per pivot.
    known = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("reach").alias("reach")).collect()
    radius, blocks = np.zeros(len(heads)), np.zeros(len(heads), np.int64)
    for row in known:
        radius[row["cell"]], blocks[row["cell"]] = row["reach"], -(-row["n"] // block_rows)
    salts = F.element_at(F.array(*[F.lit(int(b)) for b in np.maximum(blocks, 1)]), F.col("cell") + 1)
    dealt = placed.select(
        "cell", F.pmod(F.xxhash64("id"), salts).cast("int").alias("salt"), F.lit(0).alias("side"), "id", "vector",
        F.lit(0.0).alias("floor"),
    )
    routes = _routes(heads, radius, blocks, drawn["id"].to_numpy(np.int64), matrix, k)
    visits = asked.mapInArrow(routes, "cell int, salt int, id bigint, vector array<bigint>, floor double")
    visits = visits.select("cell", "salt", F.lit(1).alias("side"), "id", "vector", "floor")
    # No more partitions than there are blocks, so that few of them stand idle.
    width = max(1, int(min(blocks.sum(), 10_000)))
    rows = dealt.unionByName(visits).repartition(width, "cell", "salt").sortWithinPartitions("cell", "salt", "side", "id")
    found = rows.mapInArrow(_search(k), "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
