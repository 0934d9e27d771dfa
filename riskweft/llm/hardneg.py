"""Hard-negative mining by threshold joins on a reduced index (in the manner of L2AP).

Dimensions are taken in the order of their share of all squares, so that what is left after the first of them is
small.  Rows lie in blocks; a block's index holds of each row only its leading dimensions: the rest is left out where
the norm of that suffix, times the largest such norm of the queries at hand, stays below every threshold.  Partial
scores are accumulated one segment of dimensions after the other.  A row is dropped as soon as, for every query, its
partial score plus the product of the remaining norms is below the query's threshold; whoever is left is scored exactly.

A query asks for the first ``k`` rows of a window of scores.  Its threshold starts where a bounded sample expects the
window to fill and is lowered, for the windows that did not fill, to a score that the sample proves to be enough and
at last to the window's lower end.  So every window is full or exhausted, whatever the sample holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from riskweft.llm.covertree import _fitted, _matrix
from riskweft.llm.store import stored

SAMPLE = 2_048  # rows that suggest thresholds
BLOCK_ROWS = 8_192
SEGMENT = 8  # dimensions accumulated between two prunings
QUERY_BATCH = 128
ENDLESS = 1 << 53  # beyond every score
LEVELS = 3

_LISTS = ["w", "hi", "t"]


def _points(vectors: DataFrame) -> DataFrame:
    """(id, label, vector): one row per id, the smallest label and vector; nulls take no part."""
    rows = vectors.select(
        F.col("id").cast("bigint").alias("id"), F.col("label").cast("bigint").alias("label"),
        F.col("vector").cast("array<bigint>").alias("vector"),
    ).filter("id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL")
    return rows.groupBy("id").agg(F.min(F.struct("label", "vector")).alias("row")).select("id", "row.label", "row.vector")


def _thresholds(ids: np.ndarray, labels: np.ndarray, sample: np.ndarray, share: float, k: int, same: bool):
    """Adds to each window the thresholds to try, in falling order; the last is its lower end."""
    hoped = max(1, int(np.ceil(3 * k * share)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                rows = _matrix(batch.column(2))
                width = max(rows.shape[1], sample.shape[1])
                scores = _fitted(rows, width) @ _fitted(sample, width).T
                own = labels == batch.column(1).to_numpy()[:, None]
                usable = (own if same else ~own) & (ids != batch.column(0).to_numpy()[:, None])
                levels = []
                for row, (may, score, low, high) in enumerate(zip(
                    usable, scores, batch.column(4).to_numpy(), batch.column(5).to_numpy()
                )):
                    inside = np.sort(score[may & (score >= low) & (score <= high)])[::-1]
                    tried = [int(inside[r - 1]) if len(inside) >= r else int(low) for r in (hoped, k)]
                    levels.append([tried[0], min(tried), int(low)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(3), batch.column(4), batch.column(5), pa.array(levels, pa.list_(pa.int64()))],
                    names=["id", "w", "lo", "hi", "levels"],
                )

    return run


def _tails(rows: np.ndarray, edges: list[int]) -> np.ndarray:
    """Norms of what is left of each row from each edge on."""
    squares = np.cumsum((rows**2)[:, ::-1], axis=1)[:, ::-1]
    squares = np.concatenate((squares, np.zeros((len(rows), 1))), axis=1)
    return np.sqrt(squares[:, edges]) * (1 + 1e-9)


class Index:
    """The rows of one block, in the given order of dimensions."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray):
        order = np.argsort(ids)
        self.ids, self.labels, self.rows = ids[order], labels[order], rows[order]
        self.edges = [*range(0, rows.shape[1], SEGMENT), rows.shape[1]]
        self.tails = _tails(self.rows, self.edges)

    def candidates(self, queries: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Places of rows that may reach the threshold of some query."""
        floor, rest = least - 1e-3, _tails(queries, self.edges)
        # The first edge from which on no query can gain enough: dimensions beyond it are not in the index.
        covered = (rest.max(axis=0) * self.tails) < floor.min()
        indexed = np.where(covered.any(axis=1), covered.argmax(axis=1), len(self.edges) - 1)
        alive = np.flatnonzero(indexed > 0)
        partial = np.zeros((len(queries), len(alive)))
        done = []
        for at, (a, b) in enumerate(zip(self.edges, self.edges[1:])):
            if not len(alive):
                break
            partial += queries[:, a:b] @ self.rows[alive, a:b].T
            reach = partial + rest[:, at + 1 : at + 2] * self.tails[alive, at + 1]
            keep = (reach >= floor[:, None]).any(axis=0)
            ended = indexed[alive] == at + 1
            done.append(alive[keep & ended])
            keep &= ~ended
            alive, partial = alive[keep], partial[:, keep]
        return np.sort(np.concatenate(done)) if done else np.zeros(0, np.int64)

    def search(self, ids, labels, queries, windows, k: int, same: bool):
        """(query id, window, row id, score) of the first k rows of each window; ties to the smaller id."""
        least = np.array([min(t) for _, _, t in windows], float)
        near = self.candidates(queries, least)
        if not len(near):
            return
        scores = queries @ self.rows[near].T
        own = self.labels[near] == labels[:, None]
        scores[~(own if same else ~own) | (self.ids[near] == ids[:, None])] = -np.inf
        for query, (names, highs, lows) in enumerate(windows):
            row = scores[query]
            for name, high, low in zip(names, highs, lows):
                hit = np.flatnonzero((row <= high) & (row >= low))
                if len(hit) > k:  # ids rise with the place, so a stable sort keeps ties in order
                    cut = np.partition(row[hit], len(hit) - k)[len(hit) - k]
                    hit = hit[row[hit] >= cut]
                for place in hit[np.argsort(-row[hit], kind="stable")[:k]]:
                    yield int(ids[query]), name, int(self.ids[near[place]]), int(row[place])


def _search(order: np.ndarray, k: int, same: bool):
    """Rows arrive by block, its vectors before the queries that visit it."""

    def turned(column: pa.ListArray) -> np.ndarray:
        return _fitted(_matrix(column), len(order))[:, order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, index = None, [], None
        for whole in batches:
            block, side = whole.column(0).to_numpy(), whole.column(1).to_numpy()
            cuts = np.flatnonzero((block[1:] != block[:-1]) | (side[1:] != side[:-1])) + 1
            edges = [0, *cuts.tolist(), whole.num_rows]
            for a, b in zip(edges, edges[1:]):
                if b == a:
                    continue
                if block[a] != key:
                    key, held, index = block[a], [], None
                part = whole.slice(a, b - a)
                ids, labels = part.column(2).to_numpy(), part.column(3).to_numpy()
                if side[a] == 0:
                    held.append((ids, labels, turned(part.column(4))))
                    continue
                if index is None:
                    if not held:
                        continue
                    index = Index(*[np.concatenate(x) for x in zip(*held)])
                    held = []
                queries = turned(part.column(4))
                windows = list(zip(*[part.column(5 + n).to_pylist() for n in range(3)]))
                for at in range(0, len(ids), QUERY_BATCH):
                    some = slice(at, at + QUERY_BATCH)
                    found = list(index.search(ids[some], labels[some], queries[some], windows[some], k, same))
                    columns = list(zip(*found)) or [[], [], [], []]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, pa.int64()) for c in columns], names=["id", "w", "found", "score"]
                    )

    return run


class _Blocks:
    """Rows in blocks of one or few labels each, with what the searches need to know of all of them."""

    def __init__(self, points: DataFrame, sample: int, block_rows: int):
        spread = F.xxhash64("id")
        points = stored(points, "points")
        self.count = points.count()
        self.number = max(1, -(-self.count // block_rows))
        dealt = points.repartitionByRange(self.number, "label", spread)
        self.rows = stored(dealt.withColumn("block", F.spark_partition_id().cast("bigint")), "blocks")
        self.labels = stored(self.rows.groupBy("block", "label").agg(F.count(F.lit(1)).alias("n")), "labels")
        self.number = 1 + (self.labels.agg(F.max("block")).first()[0] or 0)
        # One row per dimension.
        squares = points.select(F.posexplode("vector")).groupBy("pos").agg(F.sum(F.col("col").cast("double") ** 2).alias("s"))
        share = {r["pos"]: r["s"] for r in squares.collect()}
        width = 1 + max(share, default=0)
        self.order = np.argsort([-share.get(d, 0.0) for d in range(width)], kind="stable")
        drawn = points.orderBy(spread, "id").limit(sample).toPandas()
        self.sample = np.zeros((len(drawn), width))
        for row, v in zip(self.sample, drawn["vector"]):
            row[: len(v)] = v
        self.ids, self.sampled = drawn["id"].to_numpy(np.int64), drawn["label"].to_numpy(np.int64)

    def first(self, queries: DataFrame, windows: DataFrame, k: int, same: bool) -> DataFrame:
        """(id, w, found, score): the first k rows of each window.

        ``queries`` (id, label, vector) are rows of the table; ``windows`` (id, w, lo, hi) their bounds, inclusive.
        """
        asked = queries.join(windows, "id").select("id", "label", "vector", "w", "lo", "hi")
        run = _thresholds(self.ids, self.sampled, self.sample, len(self.ids) / max(1, self.count), k, same)
        waiting = stored(
            asked.mapInArrow(run, "id bigint, w bigint, lo bigint, hi bigint, levels array<bigint>"), "windows"
        )
        results = []
        for level in range(LEVELS):
            now = waiting.withColumn("t", F.element_at("levels", level + 1))
            if level:
                # A window that was already searched down to this score has nothing new to find.
                now = now.filter(F.col("t") < F.element_at("levels", level))
            found = stored(self._found(queries, now, k, same), "found")
            if level < LEVELS - 1:
                size = found.groupBy("id", "w").agg(F.count(F.lit(1)).alias("n"))
                sized = now.join(size, ["id", "w"], "left") if not level else waiting.join(size, ["id", "w"], "left")
                short = (F.coalesce("n", F.lit(0)) < k) & (F.element_at("levels", level + 1) > F.col("lo"))
                left = stored(sized.filter(short).select("id", "w", "lo", "hi", "levels"), "windows")
            else:
                left = None
            results.append(found if left is None else found.join(left.select("id", "w"), ["id", "w"], "left_anti"))
            if left is None or left.isEmpty():
                break
            waiting = left
        out = results[0]
        for more in results[1:]:
            out = out.unionByName(more)
        return out

    def _found(self, queries: DataFrame, windows: DataFrame, k: int, same: bool) -> DataFrame:
        # As many windows as a query has positives.
        lists = windows.groupBy("id").agg(F.collect_list(F.struct("w", "hi", "t")).alias("all"))
        asked = queries.join(lists.select("id", *[F.col(f"all.{c}").alias(c) for c in _LISTS]), "id")
        if same:
            visits = asked.join(self.labels.select("block", "label"), "label")
        else:
            every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(self.number - 1).cast("bigint")))
            pure = self.labels.groupBy("block").agg(F.min("label").alias("label"), F.max("label").alias("last"))
            pure = pure.filter("label = last").select("block", "label")
            visits = asked.withColumn("block", every).join(pure, ["block", "label"], "left_anti")
        none = F.lit(None).cast("array<bigint>")
        columns = ["block", "side", "id", "label", "vector", *_LISTS]
        rows = self.rows.select("block", F.lit(0).alias("side"), "id", "label", "vector", *[none.alias(c) for c in _LISTS])
        rows = rows.unionByName(visits.withColumn("side", F.lit(1)).select(*columns))
        # A task's partition is its block; queries of one label stand together.
        dealt = rows.repartitionById(self.number, F.col("block").cast("int")).sortWithinPartitions("block", "side", "label", "id")
        found = dealt.mapInArrow(_search(self.order, k, same), "id bigint, w bigint, found bigint, score bigint")
        best = Window.partitionBy("id", "w").orderBy(F.desc("score"), "found")
        return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
    sample: int = SAMPLE, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``vectors`` (id, label, vector) have whole numbers whose inner products stay below 2**53 / 100; ``anchors`` (id) name
    rows of it.  An anchor's positives are its ``positives`` best other rows of the same label; a positive's negatives
    the ``negatives`` best rows of other labels whose score lies between ``low`` and ``high`` hundredths of the
    positive's, both included.  Ties go to the smaller id; fewer candidates give fewer rows, a positive below zero none.

    Nulls in any column take no part.  A repeated id counts once, as its smallest label and vector.  A shorter vector
    counts as filled with zeros.  Other columns are not read.  Empty tables give an empty table.
    """
    blocks = _Blocks(_points(vectors), sample, block_rows)
    named = anchors.select(F.col("id").cast("bigint").alias("id")).distinct()
    asked = stored(blocks.rows.drop("block").join(named, "id", "left_semi"), "anchors")
    whole = asked.select(
        "id", F.lit(0).cast("bigint").alias("w"), F.lit(-ENDLESS).alias("lo"), F.lit(ENDLESS).alias("hi")
    )
    best = blocks.first(asked, whole, positives, same=True)
    best = stored(best.select("id", F.col("found").alias("w"), F.col("score").alias("positive_score")), "positives")
    bounds = best.filter("positive_score >= 0").select(
        "id", "w", F.expr(f"(positive_score * {low} + 99) div 100").alias("lo"),
        F.expr(f"(positive_score * {high}) div 100").alias("hi"),
    ).filter("lo <= hi")
    mined = blocks.first(asked, stored(bounds, "bounds"), negatives, same=False)
    return mined.join(best, ["id", "w"]).select(
        F.col("id").alias("anchor_id"), F.col("w").alias("positive_id"), "rank", F.col("found").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )


HARD_NEGATIVE_SQL = """
WITH v AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.id <> b.id WHERE a.id % 50 = 0),
p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM (
    SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS k FROM s WHERE same) WHERE k <= 5),
n AS (
  SELECT p.*, s.id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) AS k
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same
   AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, CAST(k AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE k <= 3
"""
