"""Near-duplicates by the exact Jaccard similarity of word shingles.

Two texts link when their sets of ``words``-word shingles have a Jaccard similarity of ``similarity`` or
more; near-duplicates are the connected components of these links.  Candidates are texts whose SimHash
fingerprints are joined by steps of ``DISTANCE`` or fewer bits, found by the Gray index of ``simhash.py``: each
such component is a bucket.  Two texts at 0.8 differ in about 10 of 64 bits, a radius that no index of bit blocks
narrows; for those beyond the index, ``BANDS`` bands of ``ROWS`` min-hashes give further buckets.  Every pair of
a bucket is decided by its sets.  A pair at 0.8 meets in a band with probability 1 - (1 - 0.8**6)**25, over 99.9 %;
a closer pair more surely.

Equal sets collapse first.  The sets of a bucket are compared with its smallest one; in buckets
that are not one component after that, every pair of different components is compared inside a task, which
sends on a spanning forest.  A bucket of sets with more than ``CHUNK`` shingles is dealt into chunks, and each pair of
chunks is a task's work of its own.  So no list of pairs is ever made, and no pair that meets is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from riskweft.llm.components import connected_components
from riskweft.llm.simhash import fingerprint, link_fingerprints
from riskweft.llm.store import stored
from riskweft.llm.wordarrays import NOT_BLANK, mix, pair_hash, slices, split_words, text_bytes

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 25, 6
DISTANCE = 3  # bits between fingerprints
CHUNK = 400_000  # shingles; a task compares two chunks at once
_RANDOM = np.random.default_rng(42)
_FACTORS = _RANDOM.integers(0, 1 << 32, BANDS * ROWS, np.uint32) | np.uint32(1)
_TURNS = _RANDOM.integers(0, 1 << 32, BANDS * ROWS, np.uint32)


def shingles(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of all texts, ascending in each, and the bounds of each text.

    A text of fewer words is one shingle; a null or blank text has none.
    """
    found = split_words(*text_bytes(texts), NOT_BLANK)
    text, size, n = found.text, np.diff(found.first), len(found.hash)
    width = np.minimum(size, words)[text]
    place = np.arange(n)
    code = found.hash
    for k in range(1, words):
        code = np.where(k < width, pair_hash(code, found.hash[np.minimum(place + k, n - 1)]), code)
    whole = place + width <= found.first[1:][text]
    text, code = text[whole], code[whole]
    order = np.lexsort((code, text))
    text, code = text[order], code[order]
    fresh = np.ones(len(code), bool)
    fresh[1:] = (code[1:] != code[:-1]) | (text[1:] != text[:-1])
    text, code = text[fresh], code[fresh]
    return code, np.searchsorted(text, np.arange(len(size) + 1))


def set_keys(code: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set; the empty set is 0."""
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(code), dtype=np.uint64)))
    size = np.diff(bounds).astype(np.uint64)
    return np.where(size > 0, mix(sums[bounds[1:]] - sums[bounds[:-1]] + size), np.uint64(0)).view(np.int64)


def band_keys(code: np.ndarray, bounds: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """(texts, bands): the bucket of each text in each band; texts without words have the bucket 0."""
    some = np.flatnonzero(np.diff(bounds))
    out = np.zeros((len(bounds) - 1, bands), np.uint64)
    if not len(some):
        return out.view(np.int64)
    short = (code >> np.uint64(32)).astype(np.uint32)
    for band in range(bands):
        key = np.full(len(some), band + 1, np.uint64)
        for k in range(band * ROWS, band * ROWS + ROWS):
            least = np.minimum.reduceat((short ^ _TURNS[k]) * _FACTORS[k], bounds[some])
            key = pair_hash(key, least.astype(np.uint64))
        out[some, band] = key
    return out.view(np.int64)


def with_set(docs: DataFrame, text: str = "text", words: int = WORDS) -> DataFrame:
    """All columns of ``docs`` plus ``shingle_set``, the name of the text's set of shingles."""
    carried = [c for c in docs.columns if c != "shingle_set"]
    kept = {f.name: f.dataType.simpleString() for f in docs.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text, 1 << 20):
                keys = set_keys(*shingles(batch.column(carried.index(text)), words))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys)], names=[*carried, "shingle_set"])

    rows = docs.select(*[F.col(f"`{c}`") for c in carried])
    return rows.mapInArrow(run, "".join(f"`{c}` {kept[c]}, " for c in carried) + "shingle_set bigint")


def _sketches(docs: DataFrame, id: str, text: str, words: int, bands: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                code, bounds = shingles(batch.column(1), words)
                buckets = pa.ListArray.from_arrays(
                    np.arange(batch.num_rows + 1, dtype=np.int32) * bands, band_keys(code, bounds, bands).ravel()
                )
                texts = batch.column(1).cast(pa.large_binary())
                prints = [fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0), pa.array(set_keys(code, bounds)), pa.array(np.diff(bounds)),
                        pa.array(np.array(prints, np.uint64).view(np.int64)), buckets,
                    ],
                    names=["id", "set", "n", "fp", "bands"],
                )

    rows = docs.select(F.col(id).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "id bigint, set bigint, n bigint, fp bigint, bands array<bigint>")


def _places(rows: DataFrame) -> DataFrame:
    """(set, n, band): the buckets of every set, by components of SimHash fingerprints and by bands of min-hashes."""
    some = rows.filter("n > 0")
    prints = stored(some.select("set", "n", "fp").distinct(), "prints")
    groups = link_fingerprints(prints.select("fp").distinct(), DISTANCE).withColumnRenamed("node", "fp")
    near = prints.join(groups, "fp", "left").select("set", "n", F.xxhash64(F.coalesce("component", "fp")).alias("band"))
    banded = some.dropDuplicates(["set"]).select("set", "n", F.explode("bands").alias("band"))
    return banded.unionByName(near.distinct())


def _sets(docs: DataFrame, text: str, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                code, bounds = shingles(batch.column(0), words)
                lists = pa.ListArray.from_arrays(bounds.astype(np.int32), code.view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(set_keys(code, bounds)), lists], names=["set", "shingles"])

    return docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "set bigint, shingles array<bigint>")


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) whose sets reach the similarity."""
    side = lambda c: sets.select(F.col("set").alias(c), F.col("shingles").alias(f"of_{c}"))
    both = pairs.join(side("u"), "u").join(side("v"), "v")
    shared = F.size(F.array_intersect("of_u", "of_v"))
    every = F.size("of_u") + F.size("of_v") - shared
    return both.filter(shared >= F.lit(similarity) * every - 1e-9).select("u", "v")


def _forest(names: np.ndarray, component: np.ndarray, code: np.ndarray, bounds: np.ndarray, similarity: float):
    """Links between different components of one bucket, as few as join them."""
    label, size, of = component.copy(), np.diff(bounds), np.unique(code, return_inverse=True)[1]
    mark, found = np.zeros(len(code), np.int32), []
    for i in range(len(names) - 1):
        if (label[i + 1 :] == label[i]).all():
            continue
        own = of[bounds[i] : bounds[i + 1]]
        mark[own] = 1
        shared = np.add.reduceat(mark[of], bounds[:-1])
        mark[own] = 0
        hit = (shared >= similarity * (size[i] + size - shared) - 1e-9) & (label != label[i])
        for other in np.unique(label[hit]).tolist():
            found.append((names[i], names[np.flatnonzero(hit & (label == other))[0]]))
        label[np.isin(label, label[hit])] = label[i]
    return found


def _forests(similarity: float):
    """Rows arrive sorted by bucket and pair of chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def links() -> list:
            if sum(p.num_rows for p in held) < 2:
                return []
            names, component = (np.concatenate([p.column(k).to_numpy() for p in held]) for k in (2, 3))
            lists = [p.column(4) for p in held]
            size = np.concatenate([np.diff(x.offsets.to_numpy()) for x in lists])
            code = np.concatenate([x.flatten().to_numpy() for x in lists])
            return _forest(names, component, code, np.concatenate(([0], np.cumsum(size))), similarity)

        def batch_of(found: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["u", "v"]
            )

        for batch in batches:
            found = []
            band, pair = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            change = np.flatnonzero((band[1:] != band[:-1]) | (pair[1:] != pair[:-1])) + 1
            edges = [0, *change.tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:]):
                if b > a and (band[a], pair[a]) != key:
                    found += links()
                    key, held = (band[a], pair[a]), []
                held.append(batch.slice(a, b - a))
            yield batch_of(found)
        yield batch_of(links())

    return run


def near_duplicates(
    docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = WORDS, similarity: float = SIMILARITY,
    chunk: int = CHUNK, bands: int = BANDS,
) -> DataFrame:
    """(doc_id, shingle_set, component) for every row of ``docs``; rows of one component are near-duplicates.

    ``component`` is the smallest set name reachable over links.  Words are cut at ASCII blanks and compared
    in lower case.  Null ids and repeated rows are kept; texts without words are one component.  Without ``bands``
    only SimHash buckets are searched.
    """
    rows = stored(_sketches(docs, id, text, words, bands), "sketches")
    places = stored(_places(rows), "places")
    buckets = places.groupBy("band").agg(F.min("set").alias("head"), F.count(F.lit(1)).alias("met")).filter("met > 1")
    met = stored(places.join(buckets.drop("met"), "band"), "met")
    heads = met.filter("set <> head").select(F.col("set").alias("u"), F.col("head").alias("v")).distinct()
    # Only the sets that meet another one, each once.
    sets = _sets(docs, text, words).join(met.select("set").distinct(), "set", "left_semi")
    sets = stored(sets.dropDuplicates(["set"]), "sets")
    links = stored(_similar(heads, sets, similarity), "links")
    groups = stored(connected_components(links), "groups").select(F.col("node").alias("set"), "component")
    met = met.drop("head").join(groups, "set", "left").withColumn("component", F.coalesce("component", "set"))
    mixed = met.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    apart = stored(met.join(mixed.filter("low < high").select("band"), "band"), "apart")
    parts = apart.groupBy("band").agg(F.ceil(F.sum("n") / F.lit(chunk)).cast("bigint").alias("parts"))
    own = F.pmod(F.xxhash64("set"), F.col("parts"))
    pair = F.transform(
        F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1), lambda k: F.least(own, k) * 1_000_003 + F.greatest(own, k)
    )
    dealt = apart.join(parts, "band").select("band", F.explode(pair).alias("pair"), "set", "component").join(sets, "set")
    dealt = dealt.repartition("band", "pair").sortWithinPartitions("band", "pair", "set")
    dealt = dealt.select("band", "pair", "set", "component", "shingles")
    more = stored(dealt.mapInArrow(_forests(similarity), "u bigint, v bigint"), "morelinks")
    if not more.isEmpty():
        groups = stored(connected_components(links.unionByName(more)), "groups")
        groups = groups.select(F.col("node").alias("set"), "component")
    named = rows.select("id", "set").join(groups, "set", "left")
    return named.select(
        F.col("id").alias("doc_id"), F.col("set").alias("shingle_set"), F.coalesce("component", "set").alias("component")
    )
