"""Words of Arrow text columns as numpy arrays: places and 64-bit hashes, no Python per word."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 20  # bytes hashed at once; a longer word makes its own piece longer
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _table(is_word) -> np.ndarray:
    return np.array([is_word(i) for i in range(256)], bool)


#: Letters, digits and every byte of a non-ASCII character.
LETTERS_AND_DIGITS = _table(lambda i: i >= 128 or chr(i).isalnum())
#: Everything but ASCII blanks.
NOT_BLANK = _table(lambda i: i != 32 and not 9 <= i <= 13)


def slices(batch: pa.RecordBatch, column: str, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about ``size`` bytes of ``column``; rows stay whole."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    chunk = np.cumsum(lengths, dtype=np.int64) // size
    cuts = np.flatnonzero(np.diff(chunk)) + 1
    edges = [0, *cuts.tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def text_bytes(column: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and the bounds of each text; null is the empty text."""
    text = pc.fill_null(column.cast(pa.large_string()), "")
    if lower:
        text = pc.utf8_lower(text)
    bounds = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = text.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def _power(kind: str, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        factors = np.full(max(n, PIECE + 1), _BASE if kind == "up" else _INVERSE, np.uint64)
        factors[0] = 1
        _powers[kind] = np.cumprod(factors, dtype=np.uint64)
    return _powers[kind]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def pair_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A hash of two hashes that depends on their order."""
    return mix(left * np.uint64(3) + (right ^ np.uint64(0xA0761D6478BD642F)))


@dataclass
class Words:
    """Words of several texts: bounds in the byte array, hashes, and each text's first word."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # one longer than the number of texts

    @property
    def text(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def _pieces(is_word: np.ndarray, raw: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int]]:
    a, n = 0, len(raw)
    while a < n:
        size = PIECE
        while True:
            b = min(n, a + size)
            if b == n:
                break
            inside = bounds[np.searchsorted(bounds, b, side="right") - 1]
            blanks = np.flatnonzero(~is_word[raw[a:b]])
            cut = max(int(inside), a + int(blanks[-1]) + 1 if len(blanks) else a)
            if cut > a:
                b = cut
                break
            size *= 2
        yield a, b
        a = b


def span_hashes(letters: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of runs of ``letters`` (64-bit numbers above 0)."""
    n, sums = len(letters), np.zeros(len(letters) + 1, np.uint64)
    np.cumsum(letters * _power("up", n)[:n], out=sums[1:])
    return mix((sums[end] - sums[start]) * _power("down", n)[start])


def split_words(raw: np.ndarray, bounds: np.ndarray, is_word: np.ndarray) -> Words:
    starts, ends, hashes = [], [], []
    for a, b in _pieces(is_word, raw, bounds):
        piece = raw[a:b]
        word = is_word[piece]
        before = np.concatenate(([False], word[:-1]))
        after = np.concatenate((word[1:], [False]))
        breaks = bounds[np.searchsorted(bounds, a, side="right") : np.searchsorted(bounds, b)] - a
        before[breaks] = False
        after[breaks - 1] = False
        start, end = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
        starts.append(start + a)
        ends.append(end + a)
        hashes.append(span_hashes(piece.astype(np.uint64) + np.uint64(1), start, end))
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    start = join(starts, np.int64)
    return Words(
        start, join(ends, np.int64), join(hashes, np.uint64), np.searchsorted(start, bounds)
    )


class HashTable:
    """Places of known 64-bit hashes; a bit table answers most misses without a search."""

    def __init__(self, keys: np.ndarray):
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        bits = max(12, int(np.ceil(np.log2(max(1, len(keys)) * 16))))
        self.shift = np.uint64(64 - min(bits, 26))
        self.seen = np.zeros(1 << min(bits, 26), bool)
        self.seen[(mix(self.keys) >> self.shift).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each hash among the keys, or -1."""
        out = np.full(len(hashes), -1, np.int64)
        if not len(self.keys):
            return out
        at = np.flatnonzero(self.seen[(mix(hashes) >> self.shift).astype(np.int64)])
        wanted = hashes[at]
        place = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        hit = self.keys[place] == wanted
        out[at[hit]] = self.order[place[hit]]
        return out
