"""Connected components of an edge table, as joins and minimum aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from riskweft.llm.store import stored

#: Far above the rounds that any graph of this planet's size takes; a bound against endless loops.
MOST_ROUNDS = 60


def _measure(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")
    ).first()
    return row["n"], row["s"]


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v of one type) -> (node, component): the smallest node reachable.

    Alternates two star steps: every node hangs its larger neighbours (and then its smaller ones)
    under its smallest neighbour.  A step is one minimum per node, combined before the shuffle, and
    one join back, whose hot keys adaptive execution can split; no neighbour list is ever
    gathered.  Nodes without an edge are not returned; self-edges and null ends are ignored, an empty
    table gives an empty table.  Rounds end when the edges stay the same.
    """
    edges = edges.select("u", "v").filter("u <> v")
    current = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = _measure(current)
    for _ in range(MOST_ROUNDS):
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(lowest, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(lowest, "u")
        small = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct()
        current = stored(small, "edges")
        after = _measure(current)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle; the edge table changes between reads")
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
