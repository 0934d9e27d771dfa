"""Language identification with bit-sliced Bloom filters over character n-grams.

One table holds the Bloom filters of all languages: each cell is a bit mask with a bit per language, so
that the AND of an n-gram's few cells names every language whose filter holds it.  Per text, the bits
are counted by language; each count is corrected for the filter's known rate of false positives, and
the largest corrected count decides.

N-grams are ``N`` bytes of the lower-cased UTF-8 text with runs of other than letters as one blank.  A
language's filter holds the n-grams that make up at least ``RARE`` of its own n-grams, so a filter has at
most 1 / ``RARE`` members however large the corpus is.  Counts are taken over all learning texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from riskweft.llm.store import stored
from riskweft.llm.wordarrays import mix, slices, text_bytes

N = 4
RARE = 2e-5
HASHES = 2
UNDETERMINED = "und"
_LETTER = np.array([i >= 128 or chr(i).isalpha() for i in range(256)])


def ngrams(raw: np.ndarray, bounds: np.ndarray, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """N-grams as numbers, and the first n-gram of each text (one bound more than texts).

    Each text is framed by blanks; an n-gram never spans two texts.
    """
    letter = _LETTER[raw]
    blank = np.concatenate((~letter, [True]))
    keep = letter.copy()
    # A blank after a letter stays; a text always ends in one.
    after = np.zeros(len(raw), bool)
    after[1:] = letter[:-1]
    inner = bounds[1:-1]
    after[inner[inner < len(raw)]] = False
    keep |= blank[:-1] & after
    clean = np.where(letter, raw, 32).astype(np.uint8)[keep]
    place = np.concatenate(([0], np.cumsum(keep)))[bounds]
    size = np.diff(place)
    # One blank before each text and n - 1 after it.
    total = len(clean) + n * len(size)
    framed = np.full(total, 32, np.uint8)
    shift = np.repeat(np.arange(len(size)) * n + 1, size)
    framed[np.arange(len(clean)) + shift] = clean
    first = place[:-1] + np.arange(len(size)) * n
    count = np.where(size > 0, size + 1, 0)
    grams = np.zeros(max(0, total - n + 1), np.uint64)
    for k in range(n):
        grams = (grams << np.uint64(8)) | framed[k : k + len(grams)].astype(np.uint64)
    owner = np.repeat(first, count)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    return grams[owner + inside], np.concatenate(([0], np.cumsum(count)))


@dataclass
class LanguageFilters:
    """The sliced table (cells x words of 64 languages) and what is known of each filter."""

    languages: list[str]
    cells: np.ndarray
    false_rate: np.ndarray

    def masks(self, grams: np.ndarray) -> np.ndarray:
        found = None
        for h in _places(grams, len(self.cells)):
            found = self.cells[h] if found is None else found & self.cells[h]
        return found


def _places(grams: np.ndarray, cells: int) -> list[np.ndarray]:
    h = mix(grams * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
    width = np.uint64(cells - 1)
    return [((h >> np.uint64(21 * k)) & width).astype(np.int64) for k in range(HASHES)]


def fit_filters(learn: DataFrame, text: str = "text", lang: str = "lang", rare: float = RARE, cells: int = 1 << 20) -> LanguageFilters:
    """Filters of every language in ``learn``; rows with null text or language teach nothing."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}

        def flush(key):
            grams = np.concatenate([g for g, _ in held[key]])
            n = np.concatenate([c for _, c in held[key]])
            names, back = np.unique(grams, return_inverse=True)
            held[key] = [(names, np.bincount(back, weights=n).astype(np.int64))]
            return held[key][0]

        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                grams, first = ngrams(*text_bytes(batch.column(0)))
                tag = batch.column(1).dictionary_encode()
                owner = np.repeat(tag.indices.to_numpy(zero_copy_only=False), np.diff(first))
                for k, key in enumerate(tag.dictionary.to_pylist()):
                    mine = np.unique(grams[owner == k], return_counts=True)
                    held.setdefault(key, []).append(mine)
                    if len(held[key]) > 16:
                        flush(key)
        for key in held:
            names, n = flush(key)
            yield pa.RecordBatch.from_arrays(
                [pa.array([key] * len(names), pa.string()), pa.array(names.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"]
            )

    rows = learn.filter(F.col(text).isNotNull() & F.col(lang).isNotNull())
    rows = rows.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    counted = rows.mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counted = stored(counted, "ngrams")
    totals = counted.groupBy("lang").agg(F.sum("n").alias("total"))
    # At most 1 / rare rows for each language.
    kept = counted.join(F.broadcast(totals), "lang").filter(F.col("n") >= rare * F.col("total")).select("lang", "gram").toPandas()
    languages = sorted(r["lang"] for r in totals.select("lang").collect())
    number = {name: i for i, name in enumerate(languages)}
    slots = max(1, -(-len(languages) // 64))
    kind = np.uint8 if len(languages) <= 8 else np.uint64
    table = np.zeros((cells, slots), kind)
    code = kept["lang"].map(number).to_numpy(np.int64) if len(kept) else np.zeros(0, np.int64)
    for h in _places(kept["gram"].to_numpy(np.int64).view(np.uint64), cells):
        np.bitwise_or.at(table, (h, code // 64), (np.uint64(1) << (code % 64).astype(np.uint64)).astype(kind))
    fill = [float(((table[:, i // 64] >> kind(i % 64)) & kind(1)).mean()) for i in range(len(languages))]
    return LanguageFilters(languages, table, np.array(fill) ** HASHES)


def identify(docs: DataFrame, filters: LanguageFilters, text: str = "text") -> DataFrame:
    """All columns of ``docs`` plus ``lang_pred`` and ``lang_score`` (columns so named are replaced).

    ``lang_pred`` is the language with most n-grams after correction, ties to the first in alphabetical
    order, 'und' for null texts and texts without a letter (score 0), or when no filter was learnt.
    ``lang_score`` is the corrected share of n-grams in its filter, 0 to 1.
    """
    docs = docs.drop("lang_pred", "lang_score")
    work = "lang_input" + "_" * sum(c.startswith("lang_input") for c in docs.columns)
    carried = docs.columns
    model = docs.sparkSession.sparkContext.broadcast((filters.languages, filters.cells, filters.false_rate))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = LanguageFilters(*model.value)
        names = np.array([*known.languages, UNDETERMINED], object)
        for whole in batches:
            for batch in slices(whole, text, 1 << 20):
                texts = pc.if_else(batch.column(len(carried)), batch.column(at).cast(pa.large_string()), "")
                grams, first = ngrams(*text_bytes(texts))
                n = np.diff(first)
                counts = np.zeros((batch.num_rows, len(known.languages)))
                masks = known.masks(grams)
                some = n > 0
                for i, rate in enumerate(known.false_rate):
                    bit = (masks[:, i // 64] >> masks.dtype.type(i % 64)) & masks.dtype.type(1)
                    seen = np.add.reduceat(bit, first[:-1][some], dtype=np.int64) if some.any() else []
                    counts[some, i] = (seen - rate * n[some]) / max(1e-9, 1 - rate)
                if known.languages:
                    best = np.where(some, counts.argmax(axis=1), len(known.languages))
                    score = counts.max(axis=1) / np.maximum(n, 1)
                else:
                    best, score = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
                score = np.where(some, np.clip(score, 0.0, 1.0), 0.0)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[: len(carried)], pa.array(names[best], pa.string()), pa.array(score)],
                    names=[*carried, "lang_pred", "lang_score"],
                )

    whole_text = F.col(f"`{text}`").cast("string")
    lettered = F.coalesce(whole_text.rlike("\\p{L}"), F.lit(False))
    rows = docs.select(*[F.col(f"`{c}`") for c in carried], lettered.alias(work))
    at = carried.index(text)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + ["lang_pred string, lang_score double"])
    return rows.mapInArrow(run, schema)
