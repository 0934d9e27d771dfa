"""SimHash near-duplicates by a Gray-order hierarchical index.

Every text gets a 64-bit fingerprint: the majority, bit by bit, of the XXH64 (seed 42) of its word
shingles.  Texts link when their fingerprints differ in at most ``distance`` bits; near-duplicates are
the connected components of these links.

Copies collapse first: one row per distinct fingerprint.  Two fingerprints at ``distance`` d agree on
one of d + 1 blocks of bits, so each fingerprint goes, turned by block, into d + 1 Gray-ordered lists.
The block is the top of the Gray rank, hence a run of the list: the upper node of the index.  Inside a
run, nodes of eight children keep the bits all members share; a bit shared by the parent is factored
out of the children.  A search walks down from the run, adding up the differences met at each node, and
leaves a whole node once they exceed d.  What a task finds it reduces to a spanning forest, so no list
of pairs leaves it; components are joined across lists by min-label star steps on Spark.

A run longer than ``longest_run`` (texts that share a block of bits) is cut at quantiles of its Gray
rank into chunks; chunk pairs whose shared bits already differ too much are pruned by a join of the
chunks' patterns, and every other pair of chunks becomes a run of its own.  Nothing is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from riskweft.llm.components import connected_components
from riskweft.llm.store import stored

SEED = 42
FAN = 8  # children of a node
FRONTIER = 4_000_000  # (query, member) places held at once in a task


def _bit_counts(hashes: list[int]) -> np.ndarray:
    octets = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
    return np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprint(text: bytes, words: int = 3) -> int:
    """The fingerprint of one text given as UTF-8; a text without words has fingerprint zero."""
    parts = text.lower().split()  # bytes: A-Z and ASCII blanks only
    if not parts:
        return 0
    line = b" ".join(parts)
    width = min(words, len(parts))
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(parts) - width + 1].tolist()
    ends = ends[width - 1 :].tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for k in range(0, len(starts), 65_536):
        part = [digest(line[a:b], SEED) for a, b in zip(starts[k : k + 65_536], ends[k : k + 65_536])]
        counts += _bit_counts(part)
    bits = np.packbits(counts * 2 > len(starts), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """(id, fp): the fingerprint of every whole text as a signed 64-bit number.

    Null and blank texts have fingerprint zero; ids may be null or repeated, each row is kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", words)
                for t in batch.column(1).cast(pa.large_binary())
            ]
            fp = pa.array(np.array(found, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), fp], names=["id", "fp"])

    rows = docs.select(F.col(id).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "id bigint, fp bigint")


def with_fingerprint(docs: DataFrame, text: str = "text", words: int = 3) -> DataFrame:
    """All columns of ``docs`` plus ``fingerprint`` (hexadecimal; a column so named is replaced)."""
    carried = [c for c in docs.columns if c != "fingerprint"]
    kept = {f.name: f.dataType.simpleString() for f in docs.schema}
    at = carried.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).cast(pa.large_binary())
            found = [f"{fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b'', words):016x}" for t in texts]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found, pa.string())], names=[*carried, "fingerprint"]
            )

    rows = docs.select(*[F.col(f"`{c}`") for c in carried])
    return rows.mapInArrow(run, "".join(f"`{c}` {kept[c]}, " for c in carried) + "fingerprint string")


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _gray_rank(code: Column) -> Column:
    for shift in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, shift))
    return code


class GrayIndex:
    """The nodes over runs of one Gray-ordered list of codes, found for all runs at once.

    ``run`` numbers the runs in order.  Level 0 are the codes; a node of level k covers ``FAN**k``
    neighbours of one run and keeps the bits they share that its parent does not.
    """

    def __init__(self, codes: np.ndarray, run: np.ndarray):
        self.codes, self.run = codes, run
        n = len(codes)
        edge = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))
        self.run_start, self.run_size = edge, np.diff(np.append(edge, n))
        place = np.arange(n) - np.repeat(edge, self.run_size)
        top, depth = int(self.run_size.max()) if n else 1, 1
        while FAN**depth < top:
            depth += 1
        self.levels = []  # per level from 1: first member, last member, shared bits, pattern, first node of run
        for level in range(1, depth + 1):
            first = np.flatnonzero(place % FAN**level == 0)
            last = np.append(first[1:], n) - 1
            low, high = np.bitwise_and.reduceat(codes, first), np.bitwise_or.reduceat(codes, first)
            self.levels.append((first, last, ~(low ^ high), low, np.searchsorted(first, edge)))

    def search(self, queries: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query place, later place in its run) of codes within ``distance`` bits."""
        run_of = np.searchsorted(self.run_start, queries, side="right") - 1
        depth = len(self.levels)
        node = self.levels[-1][4][run_of]
        query, spent = queries, np.zeros(len(queries), np.uint8)
        known = np.zeros(len(queries), np.uint64)  # bits already counted above
        for level in range(depth, 0, -1):
            first, last, shared, pattern, _ = self.levels[level - 1]
            fresh = shared[node] & ~known
            spent = spent + np.bitwise_count((self.codes[query] ^ pattern[node]) & fresh)
            keep = (spent <= distance) & (last[node] > query)
            query, node, spent = query[keep], node[keep], spent[keep]
            known = known[keep] | shared[node]
            if level > 1:
                below = self.levels[level - 2][0]
                child = np.searchsorted(below, first[node])
                count = np.searchsorted(below, last[node], side="right") - child
            else:
                child, count = first[node], last[node] + 1 - first[node]
            owner = np.repeat(np.arange(len(node)), count)
            node = child[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
            query, spent, known = query[owner], spent[owner], known[owner]
        spent = spent + np.bitwise_count((self.codes[query] ^ self.codes[node]) & ~known)
        hit = (spent <= distance) & (node > query)
        return query[hit], node[hit]

    def roots(self, distance: int) -> np.ndarray:
        """For each place the first place of its component among the links found here."""
        label = np.arange(len(self.codes))
        sizes = np.repeat(self.run_size, self.run_size)
        work = np.cumsum(np.where(sizes > 1, sizes, 0))
        queries = np.flatnonzero(sizes > 1)
        if not len(queries):
            return label
        part = work[queries] // FRONTIER
        for chunk in np.split(queries, np.flatnonzero(np.diff(part)) + 1):
            a, b = self.search(chunk, distance)
            while True:
                la, lb = label[a], label[b]
                apart = la != lb
                if not apart.any():
                    break
                a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
                np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
                while (label[label] != label).any():
                    label = label[label]
        return label


def _links(distance: int):
    """Spanning forests of the linked codes of each run; rows arrive sorted by run and Gray rank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def links(rows: np.ndarray) -> pa.RecordBatch:
            changes = (rows[1:, :3] != rows[:-1, :3]).any(axis=1)
            run_of = np.concatenate(([0], np.cumsum(changes)))
            root = GrayIndex(rows[:, 3].copy().view(np.uint64), run_of).roots(distance)
            moved = np.flatnonzero(root != np.arange(len(root)))
            return pa.RecordBatch.from_arrays(
                [pa.array(rows[moved, 4]), pa.array(rows[root[moved], 4])], names=["u", "v"]
            )

        for batch in batches:
            rows = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)], axis=1)
            if not len(rows):
                continue
            held.append(rows)
            if sum(map(len, held)) < 100_000:
                continue
            rows = np.concatenate(held)
            same = (rows[:, :3] == rows[-1, :3]).all(axis=1)
            last = len(rows) - int(same[::-1].argmin()) if not same.all() else 0
            held = [rows[last:]]
            if last:
                yield links(rows[:last])
        if held:
            yield links(np.concatenate(held))

    return run


def _split_long_runs(lists: DataFrame, longest: int, distance: int) -> DataFrame:
    """Runs over ``longest`` become pairs of chunks; ``pair`` is null for the rest."""
    key = ["block", "top"]
    long = stored(
        lists.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > longest), "longruns"
    )
    if long.isEmpty():
        return lists.withColumn("pair", F.lit(0).cast("bigint"))
    parts = F.ceil(F.col("n") * 2 / longest).cast("int")
    most = int(long.agg(F.max(parts)).first()[0])
    cuts = (
        lists.join(long, key)
        .groupBy(*key)
        .agg(F.percentile_approx("rank", [k / most for k in range(1, most)], 10 * most).alias("cuts"))
    )
    # Null cuts mark a run that stays whole.
    marked = lists.join(cuts, key, "left")
    chunk = F.aggregate(
        "cuts", F.lit(0), lambda n, cut: n + (F.col("rank") >= cut).cast("int")
    )
    whole = marked.filter("cuts IS NULL").drop("cuts").withColumn("pair", F.lit(0).cast("bigint"))
    split = stored(marked.filter("cuts IS NOT NULL").withColumn("chunk", chunk).drop("cuts"), "chunks")
    nodes = split.groupBy(*key, "chunk").agg(F.expr("bit_and(code)").alias("low"), F.expr("bit_or(code)").alias("high"))
    left = nodes.select(*key, F.col("chunk").alias("i"), F.col("low").alias("li"), F.col("high").alias("hi"))
    right = nodes.select(*key, F.col("chunk").alias("j"), F.col("low").alias("lj"), F.col("high").alias("hj"))
    close = F.expr("bit_count((li ^ lj) & ~(li ^ hi) & ~(lj ^ hj))") <= distance
    pairs = left.join(right, key).filter(F.col("i") <= F.col("j")).filter(close)
    pairs = pairs.select(*key, F.explode(F.array_distinct(F.array("i", "j"))).alias("chunk"),
                         (F.col("i").cast("bigint") * 1_000_003 + F.col("j") + 1).alias("pair"))
    return whole.unionByName(split.join(pairs, [*key, "chunk"]).drop("chunk"))


def link_fingerprints(codes: DataFrame, distance: int = 3, longest_run: int = 20_000) -> DataFrame:
    """(node, component) over distinct fingerprints ``fp``; those without a link are left out.

    ``distance`` + 1 must divide 64.
    """
    blocks = distance + 1
    if 64 % blocks:
        raise ValueError("distance + 1 must divide 64")
    width = 64 // blocks
    turned = F.expr(f"shiftleft(fp, block * {width}) | shiftrightunsigned(fp, 64 - block * {width})")
    lists = (
        codes.select("fp", F.explode(F.array(*[F.lit(b) for b in range(blocks)])).alias("block"))
        .withColumn("code", F.when(F.col("block") == 0, F.col("fp")).otherwise(turned))
        .withColumn("rank", _gray_rank(F.col("code")))
        .withColumn("top", F.shiftrightunsigned("rank", 64 - width))
    )
    lists = _split_long_runs(lists, longest_run, distance)
    wide = [F.col(c).cast("bigint") for c in ("block", "top", "pair", "code", "fp")]
    sorted_lists = (
        lists.repartition("block", "top", "pair")
        .sortWithinPartitions("block", "top", "pair", "rank")
        .select(*wide)
    )
    return connected_components(sorted_lists.mapInArrow(_links(distance), "u bigint, v bigint"))


def near_duplicates(
    docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = 3, distance: int = 3,
    longest_run: int = 20_000,
) -> DataFrame:
    """(doc_id, fingerprint, component_id, members, component_fingerprint) for every row of ``docs``.

    ``component_id`` is the smallest id reachable over links, the row's own id included; ``members``
    counts the rows of the component, ``component_fingerprint`` tells components apart by one of their
    fingerprints.  Null ids keep their rows and never name a component unless all
    ids of it are null.  Equal texts, repeated rows and blank texts (fingerprint zero) link as any
    other.  An empty table gives an empty table; further columns are ignored.
    """
    prints = stored(fingerprints(docs, id, text, words), "fingerprints")
    codes = stored(
        prints.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")), "codes"
    )
    groups = link_fingerprints(codes.select("fp"), distance, longest_run)
    by_code = codes.join(groups.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "component", F.coalesce("component", "fp")
    )
    least = by_code.groupBy("component").agg(F.min("least").alias("component_id"), F.sum("n").alias("members"))
    by_code = stored(by_code.join(least, "component").select("fp", "component_id", "members", "component"), "groups")
    return prints.join(by_code, "fp").select(
        F.col("id").alias("doc_id"), hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id", "members",
        hex_fingerprint(F.col("component")).alias("component_fingerprint"),
    )
