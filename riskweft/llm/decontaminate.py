"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit verification.

A text is contaminated by a benchmark item if a stretch of it lies within ``(1 - similarity) * n`` word
edits of the item's n words (lower case, letters and digits; punctuation and blanks do not count).

Edit distance becomes Hamming distance by the CGK random walk: at each step the walk emits the word it
stands on, and a random bit of (step, word) says whether it moves on; after an edit, two walks tend to
fall back into step.  Walks start at every word of a text, all at once as arrays.  Item-sized windows
are found by sampling the emitted words: a few steps of a walk make a signature, several samples of
several independent walks make the repetitions that reach the target recall.  An item is walked from an
anchor every few words, so that a window is found through any stretch of it that edits left alone.

Every window that shares a signature is verified exactly: the semi-global edit distance of the item
against the window, widened by the allowed edits on both sides, by bit-parallel dynamic programming.
Only verified pairs leave a task.  Benchmark tables are searched block by block (``BLOCK_WORDS`` words
at a time, so what is broadcast is bounded); each block is one pass over the texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from riskweft.llm.store import stored
from riskweft.llm.wordarrays import LETTERS_AND_DIGITS, HashTable, mix, slices, split_words, text_bytes

BLOCK_WORDS = 1_000_000
ANCHOR_EVERY = 3
WALKS = 3
SLICE = 512 << 10  # bytes of text walked at once, so that the arrays stay in cache


@dataclass(frozen=True)
class Scheme:
    """Steps sampled from each walk for items of at least ``least`` words."""

    least: int
    samples: tuple[tuple[int, ...], ...]


#: For long, short and very short items; a sample is the steps whose words make one signature.
SCHEMES = (
    Scheme(14, ((0, 3, 7, 11), (1, 5, 9, 14))),
    Scheme(6, ((0, 2, 5), (1, 4, 6))),
    Scheme(1, ((0,),)),
)


def _bits(hashes: np.ndarray, walk: int) -> np.ndarray:
    return mix(hashes ^ np.uint64(0x9E3779B97F4A7C15 * (walk + 1) % (1 << 64)))


def signatures(hashes: np.ndarray, limit: np.ndarray, walk: int, scheme: Scheme) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per sample of a walk: the signature of the walk from each word, and whether it stayed inside.

    ``limit[i]`` is the first place after the text (or item) of word i.
    """
    n = len(hashes)
    bits = _bits(hashes, walk)
    steps = max(max(s) for s in scheme.samples) + 1
    here = np.arange(n, dtype=np.int32)
    place = here.copy()
    padded = np.append(hashes, np.uint64(0))
    end = np.append(limit, n).astype(np.int32)
    out = [np.full(n, np.uint64((walk + 1) * 1_000_003 + k), np.uint64) for k in range(len(scheme.samples))]
    move = np.empty(n + 1, np.int32)
    move[n] = n
    for step in range(steps):
        for k, sample in enumerate(scheme.samples):
            if step in sample:
                out[k] = (out[k] ^ padded[place]) * np.uint64(0xFF51AFD7ED558CCD)
                out[k] ^= out[k] >> np.uint64(31)
        if step + 1 < steps:
            np.add(here, ((bits >> np.uint64(step)) & np.uint64(1)).astype(np.int32), out=move[:n])
            place = move[place]
    inside = place < end[:n]
    return [(s, inside) for s in out]


class ItemBlock:
    """Signatures and verification tables of one block of benchmark items."""

    def __init__(self, ids: list, hashes: list[np.ndarray], similarity: float):
        self.ids, self.hashes = ids, hashes
        self.allowed = [int((1 - similarity) * len(h) + 1e-9) for h in hashes]
        self.masks: list[dict[int, int]] = []
        for h in hashes:
            masks: dict[int, int] = {}
            for i, w in enumerate(h.tolist()):
                masks[w] = masks.get(w, 0) | (1 << i)
            self.masks.append(masks)
        self.tables = []
        upper = 1 << 60
        for scheme in SCHEMES:
            mine = [i for i, h in enumerate(hashes) if scheme.least <= len(h) < upper]
            upper = scheme.least
            if mine:
                self.tables.append((scheme, self._index(mine, scheme)))

    def _index(self, mine: list[int], scheme: Scheme):
        flat = np.concatenate([self.hashes[i] for i in mine])
        size = np.array([len(self.hashes[i]) for i in mine])
        owner = np.repeat(np.array(mine), size)
        begin = np.repeat(np.cumsum(size) - size, size)
        offset = np.arange(len(flat)) - begin
        limit = begin + np.repeat(size, size)
        anchor = offset % ANCHOR_EVERY == 0
        keys, items, offsets = [], [], []
        for walk in range(WALKS):
            for signature, inside in signatures(flat, limit, walk, scheme):
                use = anchor & inside if scheme.least > 1 else offset == 0
                keys.append(signature[use])
                items.append(owner[use])
                offsets.append(offset[use])
        keys, items, offsets = map(np.concatenate, (keys, items, offsets))
        order = np.argsort(keys, kind="stable")
        keys, items, offsets = keys[order], items[order], offsets[order]
        names, first = np.unique(keys, return_index=True)
        return HashTable(names), np.append(first, len(keys)), items, offsets

    def windows(self, hashes: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, first word of the item-sized window) of every shared signature, each once."""
        found = []
        for scheme, (table, first, items, offsets) in self.tables:
            for walk in range(WALKS if scheme.least > 1 else 1):
                for signature, _ in signatures(hashes, limit, walk, scheme):
                    at = table.find(signature)
                    hit = np.flatnonzero(at >= 0)
                    if not len(hit):
                        continue
                    count = first[at[hit] + 1] - first[at[hit]]
                    entry = np.repeat(first[at[hit]], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                    pair = np.column_stack([items[entry], np.repeat(hit, count) - offsets[entry]])
                    found.append(np.unique(pair, axis=0))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        pairs = np.unique(np.concatenate(found), axis=0)
        return pairs[:, 0], pairs[:, 1]

    def distance(self, item: int, words: list[int]) -> tuple[int, int]:
        """Least edit distance of the item to a stretch of ``words``, and the place after that stretch."""
        masks, n = self.masks[item], len(self.hashes[item])
        full, top = (1 << n) - 1, 1 << (n - 1)
        plus, minus, score = full, 0, n
        best, where = n, 0
        for j, word in enumerate(words):
            equal = masks.get(word, 0)
            x = equal | minus
            d = ((((x & plus) + plus) ^ plus) | x) & full
            up, down = (minus | ~(d | plus)) & full, plus & d
            if up & top:
                score += 1
            elif down & top:
                score -= 1
            up, down = (up << 1) & full, (down << 1) & full
            plus, minus = (down | ~(d | up)) & full, up & d
            if score < best:
                best, where = score, j + 1
        return best, where


def _matches(block: ItemBlock, hashes: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(text, item, edits, place of the last word) of the best stretch of each contaminated pair."""
    if not len(hashes) or not block.ids:
        return
    limit = np.repeat(first[1:], np.diff(first))
    items, starts = block.windows(hashes, limit)
    if not len(items):
        return
    best: dict[tuple[int, int], tuple[int, int]] = {}
    sizes, slack = np.array([len(h) for h in block.hashes]), np.array(block.allowed)
    spans: dict[tuple[int, int], list[list[int]]] = {}
    for item, start in zip(items.tolist(), starts.tolist()):
        lo, hi = start - slack[item], start + sizes[item] + slack[item]
        # Every text that the widened window touches is tried within its own bounds.
        a = int(np.searchsorted(first, max(lo, 0), side="right") - 1)
        b = int(np.searchsorted(first, min(hi, len(hashes)), side="left"))
        for text in range(a, max(b, a + 1)):
            x, y = max(lo, int(first[text])), min(hi, int(first[text + 1]))
            if y - x < sizes[item] - slack[item]:
                continue
            runs = spans.setdefault((text, item), [])
            if runs and x <= runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], y)
            else:
                runs.append([x, y])
    for (text, item), runs in spans.items():
        masks, need = block.masks[item], sizes[item] - slack[item]
        for x, y in runs:
            words = hashes[x:y].tolist()
            if sum(w in masks for w in words) < need:
                continue  # fewer words in common than the distance allows
            edits, where = block.distance(item, words)
            if edits <= slack[item] and (edits, x + where) < best.get((text, item), (1 << 60, 0)):
                best[text, item] = (edits, x + where)
    for (text, item), (edits, end) in best.items():
        yield text, item, edits, int(end - first[text] - 1)


def benchmark_matches(
    docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, id: str = "doc_id", text: str = "text",
    item_id: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """(doc_id, item_id, edits, item_words, similarity, last_word) of every contaminated pair found.

    ``last_word`` is the place (from 0) of the last word of the best stretch in the text.  Null and
    empty texts and items, and items without a word, match nothing; repeated rows and items match each.
    Texts and items of any length are searched whole.  Empty tables give an empty table.
    """
    items, blocks = _item_blocks(benchmark, item_id, item_text, block_words)
    rows = docs.select(F.col(id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = rows.filter("text IS NOT NULL")
    schema = "doc_id bigint, item_id bigint, edits int, item_words int, similarity double, last_word bigint"
    out = None
    for k in range(blocks):
        found = rows.mapInArrow(_searcher(_sent(items, k), similarity), schema)
        out = found if out is None else out.unionByName(found)
    return out


def flag_contaminated(
    docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, text: str = "text", item_id: str = "item_id",
    item_text: str = "text", block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """All columns of ``docs`` plus ``benchmark_items``: the ids of the items that each row contains.

    Judged row by row, without a join, so that null or repeated ids do no harm; see ``benchmark_matches``.
    """
    items, blocks = _item_blocks(benchmark, item_id, item_text, block_words)
    carried = [c for c in docs.columns if c != "benchmark_items"]
    kept = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = "".join(f"`{c}` {kept[c]}, " for c in carried) + "benchmark_items array<bigint>"
    none = F.array().cast("array<bigint>").alias("benchmark_items")
    out = docs.select(*[F.col(f"`{c}`") for c in carried], none)
    for k in range(blocks):
        out = out.mapInArrow(_flagger(_sent(items, k), similarity, text), schema)
    return out


def _item_blocks(benchmark: DataFrame, item_id: str, item_text: str, block_words: int) -> tuple[DataFrame, int]:
    items = benchmark.select(F.col(item_id).cast("bigint").alias("item_id"), F.col(item_text).cast("string").alias("text"))
    items = items.filter("text IS NOT NULL")
    size = items.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-size // (2 * block_words)))  # a word and its blank are at least two characters
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    return stored(items.withColumn("block", block), "items"), int(blocks)


def _sent(items: DataFrame, block: int):
    """One block of items on all executors: at most about ``block_words`` words."""
    rows = items.filter(F.col("block") == block).select("item_id", "text").toPandas()
    return items.sparkSession.sparkContext.broadcast((rows["item_id"].tolist(), rows["text"].tolist()))


def _known(sent, similarity: float) -> ItemBlock:
    ids, texts = sent.value
    cut = split_words(*text_bytes(pa.array(texts, pa.string())), LETTERS_AND_DIGITS)
    hashes = [cut.hash[a:b] for a, b in zip(cut.first, cut.first[1:])]
    some = [i for i, h in enumerate(hashes) if len(h)]
    return ItemBlock([ids[i] for i in some], [hashes[i] for i in some], similarity)


def _searcher(sent, similarity: float):
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _known(sent, similarity)
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                words = split_words(*text_bytes(batch.column(1)), LETTERS_AND_DIGITS)
                doc = batch.column(0).to_pylist()
                found = [
                    (doc[t], known.ids[i], e, len(known.hashes[i]), 1 - e / len(known.hashes[i]), end)
                    for t, i, e, end in _matches(known, words.hash, words.first)
                ]
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(zip(*found), kinds)],
                        names=["doc_id", "item_id", "edits", "item_words", "similarity", "last_word"],
                    )

    return run


def _flagger(sent, similarity: float, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _known(sent, similarity)
        for whole in batches:
            for batch in slices(whole, text, SLICE):
                words = split_words(*text_bytes(batch.column(text)), LETTERS_AND_DIGITS)
                hits = batch.column("benchmark_items").to_pylist()
                for t, i, _, _ in _matches(known, words.hash, words.first):
                    hits[t].append(known.ids[i])
                place = batch.schema.get_field_index("benchmark_items")
                yield batch.set_column(place, "benchmark_items", pa.array(hits, pa.list_(pa.int64())))

    return run
