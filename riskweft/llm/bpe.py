"""Byte-pair encoding and decoding with a segment tree over the ranks of adjacent pairs.

The vocabulary file (a public tokenizer in JSON) gives normalisation, split pattern and merges; nothing
is trained here.  Texts are cut at blanks, and equal pieces are encoded once per task.

A word is a row of symbols; the leaves of its segment tree hold the merge rank of each adjacent pair,
and every node the smaller of its children, ties to the left.  The root therefore names the leftmost
merge of lowest rank.  A merge changes three leaves, and each change is carried up one path.  Words of
one tree height are merged together, one merge of each word per step, as numpy arrays; a word too long
for that gets a tree of its own.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from riskweft.llm.wordarrays import slices

END_OF_WORD = "</w>"
NO_MERGE = np.int64(1 << 40)
TOGETHER = 64  # symbols of words merged in step with others
LEARNT = 400_000  # pieces remembered by a worker

# Unicode White_Space, as the vocabulary's pattern engine reads \s.
_BLANK = "\t-\r \x85\xa0  -     　"
_SEPARATOR = re.compile("[\x1c-\x1f]")
_RUN_OF_BLANKS = re.compile(f"[{_BLANK}]+")
#: The split pattern of the vocabulary, inside one piece without blanks: a fixed value.
_ASCII_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zA-Z]+|[0-9]|[^a-zA-Z0-9]+")
_CONTRACTION = re.compile(r"'(?:s|t|re|ve|m|ll|d)")


def cut_words(piece: str) -> list[str]:
    """Words of a piece without blanks: contractions, runs of letters, single numerals, other runs."""
    if piece.isalpha():
        return [piece]
    if piece.isascii():
        return _ASCII_WORD.findall(piece)
    kinds = [{"L": "L", "N": "N"}.get(unicodedata.category(c)[0], "O") for c in piece]
    words, at = [], 0
    while at < len(piece):
        end = at + 1
        if found := _CONTRACTION.match(piece, at):
            end = found.end()
        elif kinds[at] != "N":
            while end < len(piece) and kinds[end] == kinds[at]:
                end += 1
        words.append(piece[at:end])
        at = end
    return words


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte value in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """Merges and token texts of a byte-level vocabulary with word ends, as arrays."""

    def __init__(self, content: str):
        file = json.loads(content)
        model = file["model"]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != END_OF_WORD:
            raise ValueError("expected a byte-pair vocabulary with word ends")
        ids = model["vocab"]
        self.size = 1 + max([*ids.values(), *(t["id"] for t in file["added_tokens"])])
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.text = [""] * self.size
        for text, number in [*ids.items(), *self.special.items()]:
            self.text[number] = text
        letters = byte_letters()
        self.inner = np.array([ids[c] for c in letters], np.int64)
        self.last = np.array([ids[c + END_OF_WORD] for c in letters], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([ids[a] * self.size + ids[b] for a, b in pairs], np.int64)
        results = np.array([ids[a + b] for a, b in pairs], np.int64)
        # Several merges may share a result but never a pair; the first rank of a pair counts.
        self.keys, first = np.unique(keys, return_index=True)
        self.ranks, self.results = first.astype(np.int64), results[first]
        cut = "|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True))
        self.cut_special = re.compile(f"({cut})") if cut else None

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair and NO_MERGE where there is none; negative symbols are no symbols."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        known = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(known, self.ranks[at], NO_MERGE)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return self.results[np.searchsorted(self.keys, left * self.size + right)]


def _tree(ranks: np.ndarray) -> np.ndarray:
    """Segment trees, one per row of leaf ranks (a power of two); node 1 is the root.

    A node holds rank * width + leaf, so that the minimum is the leftmost of the lowest rank.
    """
    rows, width = ranks.shape
    tree = np.empty((rows, 2 * width), np.int64)
    tree[:, width:] = ranks * width + np.arange(width)
    for node in range(width - 1, 0, -1):
        np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1], out=tree[:, node])
    return tree


def merge_together(symbols: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
    """Encode words of at most ``width`` symbols, given as rows padded with -1."""
    rows, width = symbols.shape
    symbols = symbols.copy()
    column = np.arange(width)
    following = np.where(np.roll(symbols, -1, axis=1) >= 0, column + 1, width)
    following[:, -1] = width
    before = np.broadcast_to(column - 1, (rows, width)).copy()
    right = np.concatenate((symbols[:, 1:], np.full((rows, 1), -1)), axis=1)
    tree = _tree(vocabulary.rank(symbols, right))
    active = np.arange(rows)

    def put(row: np.ndarray, leaf: np.ndarray, rank: np.ndarray) -> None:
        node = leaf + width
        tree[row, node] = rank * width + leaf
        node = node >> 1
        while node.size and node[0] > 0:
            tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])
            node = node >> 1

    while True:
        root = tree[active, 1]
        active = active[root < NO_MERGE * width]
        if not len(active):
            break
        at = tree[active, 1] % width
        gone = following[active, at]
        new = vocabulary.merged(symbols[active, at], symbols[active, gone])
        after = following[active, gone]
        symbols[active, at], symbols[active, gone] = new, -1
        following[active, at] = after
        has_after = after < width
        before[active[has_after], after[has_after]] = at[has_after]
        next_symbol = np.where(has_after, symbols[active, np.minimum(after, width - 1)], -1)
        put(active, gone, np.full(len(active), NO_MERGE))
        put(active, at, vocabulary.rank(new, next_symbol))
        left = before[active, at]
        some = left >= 0
        put(active[some], left[some], vocabulary.rank(symbols[active[some], left[some]], new[some]))
    return symbols


def merge_alone(symbols: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
    """Encode one word of any length; each merge updates three paths of its tree."""
    n = len(symbols)
    width = 1 << max(1, int(n - 1).bit_length())
    padded = np.full(width + 1, -1)
    padded[:n] = symbols
    tree = _tree(vocabulary.rank(padded[:-1], padded[1:])[None, :])[0].tolist()
    symbols, following, before = padded[:n].tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
    limit, size = int(NO_MERGE) * width, vocabulary.size
    if not hasattr(vocabulary, "table"):
        found = zip(vocabulary.ranks.tolist(), vocabulary.results.tolist())
        vocabulary.table = dict(zip(vocabulary.keys.tolist(), found))
    table = vocabulary.table

    def put(leaf: int, value: int) -> None:
        node = leaf + width
        tree[node] = value
        node >>= 1
        while node:
            a, b = tree[2 * node], tree[2 * node + 1]
            tree[node] = a if a < b else b
            node >>= 1

    def pair(left: int, right: int) -> int:
        got = table.get(symbols[left] * size + symbols[right]) if right < n else None
        return (got[0] if got else int(NO_MERGE)) * width + left

    while tree[1] < limit:
        at = tree[1] % width
        gone = following[at]
        symbols[at] = table[symbols[at] * size + symbols[gone]][1]
        symbols[gone] = -1
        after = following[gone]
        following[at] = after
        if after < n:
            before[after] = at
        put(gone, limit + gone)
        put(at, pair(at, after))
        if before[at] >= 0:
            put(before[at], pair(before[at], at))
    return np.array([s for s in symbols if s >= 0], np.int64)


def encode_words(words: list[str], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of words that the split pattern has cut, end to end, and the bounds of each word.

    Words of one tree height go together.
    """
    octets = [w.encode() for w in words]
    size = np.array([len(o) for o in octets], np.int64)
    owners, tokens = [], []
    for width in (2, 4, 8, 16, 32, TOGETHER):
        mine = np.flatnonzero((size <= width) & (size > (width // 2 if width > 2 else 0)))
        for part in np.array_split(mine, -(-len(mine) // 20_000)) if len(mine) else ():
            lengths = size[part]
            flat = np.frombuffer(b"".join([octets[i] for i in part.tolist()]), np.uint8)
            symbols = np.full((len(part), width), -1, np.int64)
            symbols[np.arange(width) < lengths[:, None]] = vocabulary.inner[flat]
            tail = np.cumsum(lengths) - 1
            symbols[np.arange(len(part)), lengths - 1] = vocabulary.last[flat[tail]]
            symbols = merge_together(symbols, vocabulary)
            left = symbols >= 0
            owners.append(np.repeat(part, left.sum(axis=1)))
            tokens.append(symbols[left])
    for i in np.flatnonzero(size > TOGETHER):
        flat = np.frombuffer(octets[i], np.uint8)
        symbols = vocabulary.inner[flat]
        symbols[-1] = vocabulary.last[flat[-1]]
        tokens.append(merge_alone(symbols, vocabulary))
        owners.append(np.full(len(tokens[-1]), i))
    if not owners:
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    bounds = np.searchsorted(owner[order], np.arange(len(words) + 1))
    return np.concatenate(tokens)[order], bounds


def _pieces(text: str) -> list[str]:
    """Normalised text (NFC, lower case letter by letter) cut at blanks."""
    text = unicodedata.normalize("NFC", text)
    if "Σ" in text:  # str.lower() would choose the final form at the end of a word
        text = text.replace("Σ", "σ")
    text = text.lower()
    if _SEPARATOR.search(text):  # blanks for str.split(), not for the vocabulary
        return [p for p in _RUN_OF_BLANKS.split(text) if p]
    return text.split()


class Encoder:
    """Encodes whole texts, remembering the pieces it has met."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.ids: dict[str, bytes] = {}  # piece -> its ids as little-endian 32-bit numbers
        self.lines: dict[str, str] = {}  # piece -> its decoded text
        self.names = np.array(vocabulary.text, object)

    def _learn(self, pieces: list[str]) -> None:
        cut = [cut_words(p) for p in pieces]
        words: dict[str, int] = {}
        for parts in cut:
            for w in parts:
                words.setdefault(w, len(words))
        tokens, bounds = encode_words(list(words), self.vocabulary)
        data, names, ends = tokens.astype("<u4").tobytes(), self.names[tokens].tolist(), bounds.tolist()
        ids, lines = self.ids, self.lines
        for piece, parts in zip(pieces, cut):
            places = [words[w] for w in parts]
            ids[piece] = b"".join([data[4 * ends[i] : 4 * ends[i + 1]] for i in places])
            lines[piece] = " ".join([" ".join(names[ends[i] : ends[i + 1]]) for i in places])

    def encode(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """Per text its ids as little-endian 32-bit numbers, and the decoded text."""
        special, cut = self.vocabulary.special, self.vocabulary.cut_special
        split: list[list] = []
        met: set[str] = set()
        for text in texts:
            parts = cut.split(text) if cut and any(s in text for s in special) else [text]
            split.append([p if p in special else _pieces(p) for p in parts])
            for p in split[-1]:
                met.update(p if isinstance(p, list) else ())
        if len(self.ids) + len(met) > LEARNT:
            self.ids, self.lines = {}, {}
        fresh = [p for p in met if p not in self.ids]
        if fresh:
            self._learn(fresh)
        ids, lines, out = self.ids.__getitem__, self.lines.__getitem__, []
        for parts in split:
            found: list[tuple[bytes, str]] = []
            for p in parts:
                if not isinstance(p, list):
                    found.append((special[p].to_bytes(4, "little"), p))
                elif p:
                    found.append((b"".join(map(ids, p)), " ".join(map(lines, p))))
            out.append((b"".join([f[0] for f in found]), " ".join([f[1] for f in found])))
        return out


def decode(ids: list[int], vocabulary: Vocabulary) -> str:
    """Token texts joined by blanks: the vocabulary names no decoder of its own."""
    return " ".join(vocabulary.text[i] for i in ids)


def load_vocabulary(spark: SparkSession, path: str):
    """The vocabulary file, read on the driver and sent to the executors (a few megabytes)."""
    with open(path, encoding="utf-8") as file:
        content = file.read()
    if len(content) > 64 << 20:
        raise ValueError("a vocabulary of over 64 MB is not broadcast")
    return spark.sparkContext.broadcast(content)


def encode(docs: DataFrame, vocabulary_path: str, text: str = "text", keep_ids: bool = True) -> DataFrame:
    """All columns of ``docs`` plus ``bpe_n_tokens``, ``bpe_ids_sha256``, ``bpe_decoded_sha256`` and,
    with ``keep_ids``, ``bpe_ids`` (array of int) and ``bpe_decoded``.

    Ids and decoding are those of the vocabulary without added special tokens; special tokens that
    stand in a text become their ids.  Null text counts as empty: no ids, empty decoding.  Columns
    of these names are replaced; rows are kept one by one, also repeated ones.
    """
    content = load_vocabulary(docs.sparkSession, vocabulary_path)
    made = "bpe_n_tokens bigint, bpe_ids_sha256 string, bpe_decoded_sha256 string"
    made += ", bpe_ids array<int>, bpe_decoded string" if keep_ids else ""
    names = [p.split()[0] for p in made.split(", ")]
    docs = docs.drop(*names)
    carried = docs.columns
    at = carried.index(text)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + [made])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Vocabulary(content.value))
        gc.freeze()  # the remembered pieces form no cycles; walking them would cost more than encoding
        for whole in batches:
            for batch in slices(whole, text, 1 << 20):
                found = encoder.encode([t or "" for t in batch.column(at).to_pylist()])
                columns = [
                    pa.array([len(ids) // 4 for ids, _ in found], pa.int64()),
                    pa.array([hashlib.sha256(ids).hexdigest() for ids, _ in found]),
                    pa.array([hashlib.sha256(line.encode()).hexdigest() for _, line in found]),
                ]
                if keep_ids:
                    flat = np.frombuffer(b"".join(ids for ids, _ in found), "<i4")
                    ends = np.cumsum([0] + [len(ids) // 4 for ids, _ in found]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32())))
                    columns.append(pa.array([line for _, line in found]))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, *columns], names=[*carried, *names]
                )

    return docs.mapInArrow(run, schema)
