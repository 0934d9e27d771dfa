"""Stupid-backoff language-model scores of all texts against the counts of all other texts.

S(w | u v) is c(u v w) / c(u v) if the trigram is known, else ALPHA c(v w) / c(v), else
ALPHA**2 c(w) / N, and ALPHA**3 / N for an unknown word.  Counts are those of the whole corpus less the
text's own (otherwise no n-gram would ever be unknown), N the words of all other texts.

The tables are joined relationally, with n-grams packed: texts are dealt into blocks, and a block sends
its distinct n-grams, with their counts, to partitions of the n-gram hash.  A partition sums each
n-gram's counts (the count table of its hash range) and joins them back to the blocks that asked.  A
block then looks up its own n-grams and sums the logarithms per text.  An n-gram that is frequent
everywhere crosses the network once per block, not once per occurrence.  The one shuffle of the texts
serves both the counting and the scoring.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from riskweft.llm.store import stored
from riskweft.llm.wordarrays import LETTERS_AND_DIGITS, mix, pair_hash, split_words, text_bytes

ALPHA = 0.4
BLOCK_BYTES = 7 << 20  # text in a block
BUCKET_BYTES = 6 << 20  # text whose n-grams meet in a bucket
_CODEC = "zstd"


def _pack(values: np.ndarray, kind: str) -> bytes:
    """Sorted or small numbers as compressed byte planes."""
    octets = np.ascontiguousarray(values.astype(kind).view(np.uint8).reshape(len(values), -1).T)
    return len(values).to_bytes(8, "little") + pa.Codec(_CODEC, compression_level=1).compress(octets.tobytes(), asbytes=True)


def _unpack(data: bytes, kind: str) -> np.ndarray:
    n, width = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, kind)
    planes = pa.Codec(_CODEC).decompress(data[8:], n * width, asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(width, n).T).view(kind).ravel()


def _squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed one by one before they cross the network."""
    codec = pa.Codec(_CODEC, compression_level=1)
    for batch in batches:
        texts = [t.as_buffer() for t in batch.column(2).cast(pa.large_binary())]
        packed = [t.size.to_bytes(8, "little") + codec.compress(t, asbytes=True) for t in texts]
        yield batch.set_column(2, "text", pa.array(packed, pa.binary()))


def _texts(packed: Iterator[bytes]) -> pa.Array:
    codec = pa.Codec(_CODEC)
    whole = [codec.decompress(p[8:], int.from_bytes(p[:8], "little"), asbytes=True) for p in packed]
    return pa.array(whole, pa.large_binary()).cast(pa.large_string())


class Grams:
    """Hashes of the words, bigrams and trigrams that end at each word; 0 where a text is too young."""

    def __init__(self, texts: pa.Array):
        words = split_words(*text_bytes(texts), LETTERS_AND_DIGITS)
        self.first = words.first
        self.size = np.diff(words.first)
        place = np.arange(len(words.hash)) - np.repeat(words.first[:-1], self.size)
        one = words.hash | np.uint64(1)  # never 0
        before = np.concatenate(([np.uint64(0)], one[:-1])) if len(one) else one
        two = np.where(place >= 1, pair_hash(before, one) | np.uint64(1), np.uint64(0))
        before = np.concatenate(([np.uint64(0)], two[:-1])) if len(two) else two
        three = np.where(place >= 2, pair_hash(before, mix(one)) | np.uint64(1), np.uint64(0))
        self.orders = (one, two, three)

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct n-grams, their counts, and where each n-gram of each order stands among them."""
        flat = np.concatenate(self.orders)
        keys, place, count = np.unique(flat, return_inverse=True, return_counts=True)
        return keys, count, place.reshape(3, -1)


def _ask(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def send(block: int) -> Iterator[pa.RecordBatch]:
            keys, count, _ = Grams(_texts(t for b in held for t in b.column(2).to_pylist())).distinct()
            bucket = _bucket(keys, buckets)
            edges = np.searchsorted(bucket, np.arange(buckets + 1))
            some = np.flatnonzero(np.diff(edges))
            for part in np.array_split(some, -(-len(some) // 64)) if len(some) else ():
                spans = [(int(edges[k]), int(edges[k + 1])) for k in part]
                deltas = [_pack(np.diff(keys[a:b], prepend=np.uint64(0)), "<u8") for a, b in spans]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(part.astype(np.int32)), pa.array(np.full(len(part), block, np.int32)),
                        pa.array(deltas, pa.binary()), pa.array([_pack(count[a:b], "<u4") for a, b in spans], pa.binary()),
                    ],
                    names=["bucket", "block", "grams", "n"],
                )

        current = None
        for whole in batches:
            blocks = whole.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1).tolist(), whole.num_rows]
            for a, b in zip(edges, edges[1:]):
                if b == a:
                    continue
                if current is not None and blocks[a] != current:
                    yield from send(current)
                    held = []
                current = int(blocks[a])
                held.append(whole.slice(a, b - a))
        if current is not None:
            yield from send(current)

    return run


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Ranges of the hash, so that buckets in order hold keys in order."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum the counts of one bucket at a time and answer each block in its own order of n-grams."""

    def answer(bucket: int, rows: list[tuple[int, bytes, bytes]]) -> Iterator[pa.RecordBatch]:
        keys = [np.cumsum(_unpack(g, "<u8"), dtype=np.uint64) for _, g, _ in rows]
        counts = np.concatenate([_unpack(n, "<u4") for _, _, n in rows])
        _, place = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(place, weights=counts).astype(np.int64)[place]
        ends = np.cumsum([0] + [len(k) for k in keys])
        for at in range(0, len(rows), 64):
            part = range(at, min(at + 64, len(rows)))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([rows[i][0] for i in part], pa.int32()), pa.array([bucket] * len(part), pa.int32()),
                    pa.array([_pack(total[ends[i] : ends[i + 1]], "<u8") for i in part], pa.binary()),
                ],
                names=["block", "bucket", "n"],
            )

    current, held = None, []
    for batch in batches:
        for bucket, block, grams, n in zip(*[batch.column(i).to_pylist() for i in range(4)]):
            if current is not None and bucket != current:
                yield from answer(current, held)
                held = []
            current = bucket
            held.append((block, grams, n))
    if current is not None:
        yield from answer(current, held)


def _score(texts: pa.Table, counts: pa.Table) -> pa.Table:
    """Per text: words, words scored as single words, and the sum of logarithms without their N."""
    grams = Grams(_texts(texts.column("text").to_pylist()))
    keys, _, place = grams.distinct()
    order = np.argsort(counts.column("bucket").to_numpy())
    packed = counts.column("n").to_pylist()
    total = np.concatenate([_unpack(packed[i], "<u8") for i in order]).astype(np.int64) if len(packed) else np.zeros(0, np.int64)
    if len(total) != len(keys):
        raise RuntimeError(f"{len(total)} counts for {len(keys)} n-grams of a block")
    text = np.repeat(np.arange(len(grams.size)), grams.size)
    others = []
    for at in place:
        # Less what the text itself holds.
        _, back, own = np.unique(text * np.int64(max(1, len(keys))) + at, return_inverse=True, return_counts=True)
        others.append(total[at] - own[back])
    one, two, three = others
    begin = np.zeros(len(text), bool)
    begin[grams.first[:-1][grams.size > 0]] = True
    second = np.concatenate(([False], begin[:-1])) if len(begin) else begin
    has_two, has_three = ~begin, ~(begin | second)
    shift = lambda c: np.concatenate(([0], c[:-1])) if len(c) else c
    use_three = has_three & (three > 0)
    use_two = has_two & (two > 0) & ~use_three
    use_one = ~use_three & ~use_two
    value = np.zeros(len(text))
    value[use_three] = np.log(three[use_three]) - np.log(shift(two)[use_three])
    value[use_two] = np.log(ALPHA) + np.log(two[use_two]) - np.log(shift(one)[use_two])
    known = use_one & (one > 0)
    value[known] = 2 * np.log(ALPHA) + np.log(one[known])
    value[use_one & (one == 0)] = 3 * np.log(ALPHA)
    n = len(grams.size)
    return pa.table(
        {
            "id": texts.column("id"),
            "n_words": pa.array(grams.size.astype(np.int64)),
            "singles": pa.array(np.bincount(text, weights=use_one, minlength=n).astype(np.int64)),
            "logs": pa.array(np.bincount(text, weights=value, minlength=n)),
        }
    )


def lm_scores(docs: DataFrame, id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(doc_id, n_words, lm_score) for every row of ``docs``.

    ``lm_score`` is the mean natural logarithm of S over the text's words; a text without a word (null
    text too) has score 0, and so has the only text with words.  A trigram or bigram is used only where
    the text has that many words before.  Null ids and repeated rows are kept, each scored against all other
    rows, its copies included.  An empty table gives an empty table.
    """
    rows = docs.select(F.col(id).cast("bigint").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    blocks, buckets = max(1, -(-size // block_bytes)), max(1, -(-size // bucket_bytes))
    block = F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("int")
    # One exchange by block, read by the counting and by the scoring.
    packed = rows.select(block.alias("block"), "id", "text").mapInArrow(_squeeze, "block int, id bigint, text binary")
    dealt = packed.repartition(int(blocks), "block")
    asked = dealt.sortWithinPartitions("block").mapInArrow(_ask(int(buckets)), "bucket int, block int, grams binary, n binary")
    counted = asked.repartition(int(buckets), "bucket").sortWithinPartitions("bucket", "block")
    counted = counted.mapInArrow(_count, "block int, bucket int, n binary")
    scored = dealt.groupBy("block").cogroup(counted.groupBy("block")).applyInArrow(
        _score, "id bigint, n_words bigint, singles bigint, logs double"
    )
    scored = stored(scored, "scores")
    total = scored.agg(F.sum("n_words").alias("n")).first()["n"] or 0
    rest = F.greatest(F.lit(total) - F.col("n_words"), F.lit(1))
    mean = (F.col("logs") - F.col("singles") * F.log(rest.cast("double"))) / F.col("n_words")
    score = F.when((F.col("n_words") == 0) | (F.col("n_words") == F.lit(total)), F.lit(0.0)).otherwise(mean)
    return scored.select(F.col("id").alias("doc_id"), "n_words", score.alias("lm_score"))


#: The same scores in SQL, over words as text.
LM_SCORE_SQL = """
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9\\x{80}-\\x{10FFFF}]+') AS w FROM documents),
p AS (SELECT r, unnest(range(1, len(w) + 1)) AS i, w FROM t),
g AS (SELECT r, i, w[i] AS g1, CASE WHEN i > 1 THEN w[i-1] || ' ' || w[i] END AS g2,
             CASE WHEN i > 2 THEN w[i-2] || ' ' || w[i-1] || ' ' || w[i] END AS g3,
             CASE WHEN i > 1 THEN w[i-1] END AS p1, CASE WHEN i > 2 THEN w[i-2] || ' ' || w[i-1] END AS p2 FROM p),
c AS (SELECT g, sum(n) AS total, map_from_entries(list((r, n))) AS own FROM (
  SELECT g, r, count(*) AS n FROM (
    SELECT r, g1 AS g FROM g UNION ALL SELECT r, g2 FROM g WHERE g2 IS NOT NULL
    UNION ALL SELECT r, g3 FROM g WHERE g3 IS NOT NULL) GROUP BY g, r) GROUP BY g),
k AS (
  SELECT g.r,
    c1.total - coalesce(c1.own[g.r], 0) AS n1, c2.total - coalesce(c2.own[g.r], 0) AS n2,
    c3.total - coalesce(c3.own[g.r], 0) AS n3, q1.total - coalesce(q1.own[g.r], 0) AS m1,
    q2.total - coalesce(q2.own[g.r], 0) AS m2
  FROM g JOIN c c1 ON c1.g = g1 LEFT JOIN c c2 ON c2.g = g2 LEFT JOIN c c3 ON c3.g = g3
  LEFT JOIN c q1 ON q1.g = p1 LEFT JOIN c q2 ON q2.g = p2),
n AS (SELECT sum(len(w)) AS total FROM t),
s AS (
  SELECT k.r, sum(CASE WHEN n3 > 0 THEN ln(n3) - ln(m2) WHEN n2 > 0 THEN ln(0.4) + ln(n2) - ln(m1)
    WHEN n1 > 0 THEN 2 * ln(0.4) + ln(n1) - ln(greatest(n.total - len(t.w), 1))
    ELSE 3 * ln(0.4) - ln(greatest(n.total - len(t.w), 1)) END) AS logs
  FROM k JOIN t USING (r) CROSS JOIN n GROUP BY k.r)
SELECT t.doc_id, CAST(len(t.w) AS BIGINT) AS n_words,
  round(CASE WHEN len(t.w) = 0 OR len(t.w) = n.total THEN 0 ELSE s.logs / len(t.w) END, 6) AS lm_score
FROM t LEFT JOIN s USING (r) CROSS JOIN n
"""
