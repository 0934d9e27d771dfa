"""The trie of conversation prefixes, by truncation peeling.

A prefix is named by its depth and by two sums of 64-bit hashes, one hash for each (place, role, text): running sums
along a conversation, so that the prefix one turn shorter is known by taking the last turn's hash off.  No list of
turns is ever gathered, however long a conversation is.

Equal conversations collapse into one sequence with a weight.  Where a prefix belongs to one sequence alone, its
node follows from that sequence: the whole unshared tail is stripped at once.  Then the shared part is peeled from
its greatest depth: sequences that end at a depth are merged with the nodes that survive from below it, one
aggregate regroups them and yields every measure of the nodes found there, and each node loses its last turns up to
the next depth where it meets others (a run of turns without a branch or an end is stripped in one step, as its
nodes have the same members).  So there is a step for each depth at which conversations part or end, not for each turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from riskweft.llm.prefixsums import running_sums
from riskweft.llm.skew import join_spread
from riskweft.llm.store import stored

NODE = ["depth", "k1", "k2"]
STEPS = 4  # depths peeled between two writes of the surviving nodes
PIECE = 1 << 16  # ids joined into one piece of text before they are hashed
NOTHING = hashlib.sha256(b"").hexdigest()


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, h1, h2, size): turns numbered from 1 by ``turn`` (null first), ties by role and text.

    Null roles and texts are empty; rows without a conv_id belong to no conversation and are left out.  Repeated
    rows are turns each.  ``size`` counts code points of the text.
    """
    rows = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn",
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    ).filter("conv_id IS NOT NULL")
    hashes = [F.xxhash64(F.lit(k), "role", "text").alias(f"h{k}") for k in (1, 2)]
    rows = rows.select("*", *hashes, F.length("text").cast("bigint").alias("size"))
    order = [F.asc_nulls_first("turn"), "role", "text"]
    return running_sums(rows, "conv_id", order, {"place": F.lit(1).cast("bigint")}, ["h1", "h2", "size"])


def with_openings(turns: DataFrame, span: int = 100, most: int = 6) -> DataFrame:
    """(conv_id, depth, h1, h2, size): every conversation c rebuilt on the opening of conversation c - c % span.

    It takes that one's first h turns (all if fewer, none if it is absent), then its own after its first h;
    h = crc32 of c in decimal, modulo ``most``.  Depth 0 is a row without a turn for every conversation.
    """
    heads = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    heads = heads.withColumn("base", F.col("conv_id") - F.col("conv_id") % span)
    heads = stored(heads.withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % most), "heads")
    first = turns.filter((F.col("conv_id") % span == 0) & (F.col("place") < most))
    opening = heads.select("conv_id", "base", "h").join(first.withColumnRenamed("conv_id", "base"), "base")
    opening = opening.filter("place <= h").select("conv_id", F.col("place").alias("depth"), "h1", "h2", "size")
    known = heads.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    # A conversation's own turns move up where its base has fewer than h.
    moved = heads.join(known, "base", "left").select(
        "conv_id", "h", F.greatest(F.col("h") - F.coalesce("base_n", F.lit(0)), F.lit(0)).alias("up")
    )
    own = join_spread(turns, stored(moved, "moved"), ["conv_id"]).filter("place > h")
    own = own.select("conv_id", (F.col("place") - F.col("up")).alias("depth"), "h1", "h2", "size")
    zero = F.lit(0).cast("bigint")
    roots = heads.select("conv_id", zero.alias("depth"), zero.alias("h1"), zero.alias("h2"), zero.alias("size"))
    return roots.unionByName(opening).unionByName(own)


def _paths(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, size, k1, k2, p1, p2, upto): names of each prefix and of the one before, and sizes so far."""
    sums = {}
    for k in ("1", "2"):
        own = F.when(F.col("depth") == 0, F.lit(0)).otherwise(F.xxhash64(f"h{k}", "depth"))
        sums[f"s{k}"] = own.cast("decimal(20,0)")
    rows = turns.select("*", *[c.alias(f"own{n[1]}") for n, c in sums.items()])
    added = running_sums(
        rows, "conv_id", ["depth"],
        {"s1": F.col("own1"), "s2": F.col("own2"), "upto": F.col("size")}, ["depth", "size", "own1", "own2"],
    )
    name = lambda c: F.pmod(c, F.lit(1 << 62).cast("decimal(20,0)")).cast("bigint")
    return stored(
        added.select(
            "conv_id", "depth", "size", name(F.col("s1")).alias("k1"), name(F.col("s2")).alias("k2"),
            name(F.col("s1") - F.col("own1")).alias("p1"), name(F.col("s2") - F.col("own2")).alias("p2"), "upto",
        ),
        "paths",
    )


def _joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of comma-joined ids; rows arrive by end and id."""
    key, held, first, sent = None, [], None, 0

    def piece() -> pa.RecordBatch:
        columns = [[v] for v in (*key, first, ",".join(map(str, held)))]
        return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns[:-1]], pa.array(columns[-1])], names=[*NODE, "first", "ids"])

    for batch in batches:
        for *end, conv in zip(*[c.to_pylist() for c in batch.columns]):
            if tuple(end) != key or len(held) >= PIECE:
                if held:
                    yield piece()
                key, held, first = tuple(end), [], conv
            held.append(conv)
    if held:
        yield piece()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each end's pieces; they arrive in order and only the hash state is kept."""
    key, state = None, None
    done = lambda: pa.RecordBatch.from_arrays([*[pa.array([v], pa.int64()) for v in key], pa.array([state.hexdigest()])], names=[*NODE, "ends"])
    for batch in batches:
        for depth, k1, k2, _, ids in zip(*[c.to_pylist() for c in batch.columns]):
            if (depth, k1, k2) != key:
                if key is not None:
                    yield done()
                key, state = (depth, k1, k2), hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
    if key is not None:
        yield done()


def _end_hashes(ends: DataFrame, sequences: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends): the hash of the ids that end at a node, ascending.

    One id needs no moving.  The ids of a larger group are sorted over all tasks and joined into pieces there, so that
    the one task that a sequential hash needs reads a few long pieces and keeps only its state.
    """
    alone = sequences.filter("weight = 1").select(*NODE, F.sha2(F.col("conv_id").cast("string"), 256).alias("ends"))
    groups = sequences.filter("weight > 1").select(*NODE)
    rows = join_spread(ends.select(*NODE, "conv_id"), groups, NODE).orderBy(*NODE, "conv_id")
    pieces = rows.mapInArrow(_joined_ids, "depth bigint, k1 bigint, k2 bigint, first bigint, ids string")
    pieces = pieces.repartition(*NODE).sortWithinPartitions(*NODE, "first")
    return alone.unionByName(pieces.mapInArrow(_hashed, "depth bigint, k1 bigint, k2 bigint, ends string"))


def prefix_trie(turns: DataFrame) -> DataFrame:
    """One row per distinct prefix of the conversations in ``turns`` (conv_id, depth, h1, h2, size; depth 0 for all).

    Returns conv_id (smallest member), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves,
    saved_tokens (over the node's subtree, (n_convs - 1) times the size of a node's last text) and ends_sha256 (hash
    of the comma-joined ids that end at the node; no id: hash of the empty string).  The turn of a node is the one at
    its depth in its conv_id.  An empty table has no node, not even a root.
    """
    paths = _paths(turns)
    last = F.max_by(F.struct("k1", "k2", "upto"), "depth").alias("end")
    ends = paths.groupBy("conv_id").agg(F.max("depth").alias("depth"), last)
    ends = stored(ends.select("conv_id", "depth", "end.k1", "end.k2", "end.upto"), "ends")
    sequences = ends.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("weight"), F.max("upto").alias("whole"))
    sequences = stored(sequences, "sequences")
    hashes = stored(_end_hashes(ends, sequences), "hashes")
    rep = sequences.select("conv_id", F.col("depth").alias("length"), "whole", "weight")
    rows = stored(join_spread(paths, rep, ["conv_id"]), "rows")

    # Prefixes of several sequences, and the rows of their owners (smallest members).
    counts = rows.groupBy(*NODE).agg(F.count(F.lit(1)).alias("met"), F.min("conv_id").alias("owner"))
    counts = stored(counts.filter("met > 1"), "met")
    shared = stored(join_spread(rows, counts, NODE), "shared")
    deepest = F.max_by(F.struct(F.col("depth").alias("at"), "k1", "k2", "owner", "upto"), "depth").alias("deep")
    parting = stored(shared.groupBy("conv_id").agg(deepest).select("conv_id", "deep.*"), "parting")
    owned = shared.filter("conv_id = owner").select("conv_id", *NODE, "size", "p1", "p2", "upto", "met")
    bottom = F.max_by(F.struct("depth", "k1", "k2", "size", "upto"), "depth").alias("bottom")
    top = F.min_by(F.struct("depth", "p1", "p2", (F.col("upto") - F.col("size")).alias("before")), "depth").alias("top")
    runs = owned.groupBy("conv_id", "met").agg(bottom, top).select(
        "bottom.depth", "bottom.k1", "bottom.k2",
        F.struct("bottom.size", "bottom.upto", F.col("top.depth").alias("top"), "top.p1", "top.p2", "top.before").alias("run"),
    )

    number = lambda c: c.cast("bigint")
    no_run = F.lit(None).cast(runs.schema["run"].dataType)
    parted = sequences.drop(*NODE).join(parting, "conv_id").join(
        sequences.select("conv_id", F.col("depth").alias("length")), "conv_id"
    )
    goes_on = F.when(F.col("length") > F.col("at"), 1).otherwise(0)
    tails = parted.select(
        F.col("at").alias("depth"), "k1", "k2", F.col("conv_id").alias("owner"), F.col("weight").alias("n"),
        number(goes_on).alias("children"), number(goes_on).alias("leaves"),
        ((F.col("weight") - 1) * (F.col("whole") - F.col("upto"))).alias("saved"),
    ).withColumn("run", no_run)
    zero = number(F.lit(0))
    empty = runs.select(
        *NODE, F.lit(None).cast("bigint").alias("owner"), zero.alias("n"), zero.alias("children"), zero.alias("leaves"),
        zero.alias("saved"), "run",
    )
    waiting = stored(tails.unionByName(empty), "waiting")
    # The depths at which conversations part or end; at most one more than the longest shared prefix.
    depths = sorted((r["depth"] for r in waiting.select("depth").distinct().collect()), reverse=True)
    peeled = []
    for begin in range(0, len(depths), STEPS):
        found = []
        for depth in depths[begin : begin + STEPS]:
            here = waiting.filter(F.col("depth") == depth).groupBy(*NODE).agg(
                F.min("owner").alias("owner"), *[F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved")],
                F.max("run").alias("run"),
            )
            node = here.withColumn("saved", F.col("saved") + (F.col("n") - 1) * F.col("run.size"))
            found.append(node)
            between = F.col("run.upto") - F.col("run.size") - F.col("run.before")
            stripped = node.filter("run.top > 0").select(
                (F.col("run.top") - 1).alias("depth"), F.col("run.p1").alias("k1"), F.col("run.p2").alias("k2"), "owner",
                "n", number(F.lit(1)).alias("children"), "leaves",
                (F.col("saved") + (F.col("n") - 1) * between).alias("saved"), no_run.alias("run"),
            )
            waiting = waiting.filter(F.col("depth") < depth).unionByName(stripped)
        for node in found:
            peeled.append(node)
        if begin + STEPS < len(depths):
            waiting = stored(waiting, "waiting")
    # Every node of a run, from its bottom.
    result = stored(_union(peeled, waiting), "peeled")
    met_at = owned.groupBy("conv_id", "met").agg(F.max_by(F.struct(*NODE), "depth").alias("b")).select("conv_id", "met", "b.*")
    summed = met_at.join(result.drop("owner"), NODE).select(
        "conv_id", "met", F.col("depth").alias("bottom"), "n", "children", "leaves", "saved", "run"
    )
    inner = owned.join(summed, ["conv_id", "met"])
    above = F.col("run.upto") - F.col("run.size") - (F.col("upto") - F.col("size"))
    joint = inner.select(
        "conv_id", *NODE, F.col("n").alias("n_convs"),
        F.when(F.col("depth") == F.col("bottom"), F.col("children")).otherwise(1).alias("n_children"),
        F.col("leaves").alias("n_leaves"), (F.col("saved") + (F.col("n") - 1) * above).alias("saved_tokens"),
    )
    parents = shared.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("owner").alias("parent_conv_id"))
    joint = joint.join(parents, ["conv_id", "depth"], "left")

    # Nodes of one sequence.
    own = join_spread(rows, parting.select("conv_id", "at", F.col("owner").alias("above")), ["conv_id"], "left")
    own = own.filter(F.col("depth") > F.coalesce("at", F.lit(-1)))
    solo = own.select(
        "conv_id", *NODE, F.col("weight").alias("n_convs"), F.when(F.col("depth") < F.col("length"), 1).otherwise(0).cast("bigint").alias("n_children"),
        number(F.lit(1)).alias("n_leaves"), ((F.col("weight") - 1) * (F.col("whole") - F.col("upto") + F.col("size"))).alias("saved_tokens"),
        F.when(F.col("depth") == 0, None).when(F.col("depth") == F.col("at") + 1, F.col("above")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
    )
    nodes = joint.unionByName(solo).join(hashes, NODE, "left")
    return nodes.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", number(F.col("n_children")).alias("n_children"), "n_leaves",
        "saved_tokens", F.coalesce("ends", F.lit(NOTHING)).alias("ends_sha256"),
    )


def _union(parts: list[DataFrame], like: DataFrame) -> DataFrame:
    out = like.select(*NODE, "owner", "n", "children", "leaves", "saved", "run").limit(0)
    for part in parts:
        out = out.unionByName(part)
    return out


TRIE_SQL = f"""
WITH RECURSIVE own AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id
           ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place,
         coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
heads AS (
  SELECT conv_id, n, conv_id - conv_id % 100 AS base, xor(list_reduce(
      list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
      lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0],
        lambda s, z: CASE WHEN s & 1 = 1 THEN xor(s >> 1, 3988292384) ELSE s >> 1 END)), 4294967295) % 6 AS h
  FROM (SELECT conv_id, count(*) AS n FROM own GROUP BY conv_id)),
rebuilt AS (
  SELECT heads.conv_id, o.place AS depth, o.role, o.text FROM heads JOIN own o ON o.conv_id = base AND o.place <= h
  UNION ALL
  SELECT o.conv_id, o.place - heads.h + least(heads.h, coalesce(b.n, 0)), o.role, o.text
  FROM own o JOIN heads ON o.conv_id = heads.conv_id AND o.place > heads.h LEFT JOIN heads b ON b.conv_id = heads.base),
path(conv_id, depth, key, size) AS (
  SELECT conv_id, 0::BIGINT, '', 0 FROM heads
  UNION ALL
  SELECT p.conv_id, r.depth, sha256(p.key || ':' || length(r.role) || ':' || r.role || ':' || r.text), length(r.text)
  FROM path p JOIN rebuilt r ON r.conv_id = p.conv_id AND r.depth = p.depth + 1),
ended AS (SELECT conv_id, arg_max(key, depth) AS key, max(depth) AS depth FROM path GROUP BY conv_id),
node AS (SELECT depth, key, min(conv_id) AS conv_id, count(*) AS n, any_value(size) AS size FROM path GROUP BY depth, key),
link AS (SELECT DISTINCT a.depth, a.key, b.key AS parent FROM path a JOIN path b ON a.conv_id = b.conv_id AND a.depth = b.depth + 1),
kids AS (SELECT depth - 1 AS depth, parent AS key, count(*) AS k FROM link GROUP BY 1, 2),
full_node AS (SELECT node.*, coalesce(k, 0) AS k, parent FROM node LEFT JOIN kids USING (depth, key) LEFT JOIN link USING (depth, key)),
below AS (SELECT a.depth, a.key, sum((f.n - 1) * f.size) AS saved, sum(CASE WHEN f.k = 0 THEN 1 ELSE 0 END) AS leaves
  FROM path a JOIN path b ON a.conv_id = b.conv_id AND b.depth >= a.depth
  JOIN full_node f ON f.depth = b.depth AND f.key = b.key AND f.conv_id = b.conv_id GROUP BY 1, 2),
closed AS (SELECT depth, key, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends FROM ended GROUP BY 1, 2)
SELECT f.conv_id, f.depth, p.conv_id AS parent_conv_id, f.n AS n_convs, f.k AS n_children,
  CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens,
  coalesce(ends, '{NOTHING}') AS ends_sha256
FROM full_node f JOIN below USING (depth, key) LEFT JOIN closed USING (depth, key)
LEFT JOIN node p ON p.depth = f.depth - 1 AND p.key = f.parent
"""
