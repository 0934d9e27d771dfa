"""Toxicity by two class-conditional Kneser-Ney models over the characters of words.

A word is read character by character, from its start to a mark at its end.  The chance of a character after the
``ORDER`` - 1 before it (fewer at the start of the word) comes from the class's own counts, with three absolute
discounts, for counts of one, two and more, estimated from the counts of counts; what they leave goes to the next
shorter context, whose continuation counts both classes share, down to the character alone.  So a rare or unseen word
is judged by the stems it is made of, and one that neither class knows by the same backoff, which speaks for neither.

A word's score is the log-likelihood ratio of the classes; a text is described by means over its words, so its length
does not count: over all, over the most toxic tenth and twentieth (two at least), and the most toxic word.  A logistic
function, in which both classes weigh the same, turns these into a score between 0 and 1.  It is fitted on texts that
were left out of the counts they are scored with, fold by fold.  A word counts once in a text, equal texts once.

The models are fitted on every labelled text.  Spark counts the n-grams, scores each fold in as many tasks as it has
``TEXTS_A_TASK``, and sums what a Newton step of the logistic fit needs; texts and their scores never reach the driver.
All n-grams are kept, at every size: the model is as large as the labelled texts have distinct n-grams, and is sent to
the tasks by way of the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from unicodedata import category

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from riskweft.functions.tables import sent_if_small
from riskweft.llm.logistic import fit_logistic_rows, logistic
from riskweft.llm.store import stored
from riskweft.llm.wordarrays import HashTable, mix, pair_hash, slices, span_hashes

ORDER = 6  # a character and the five before it
FOLDS = 4
TEXTS_A_TASK = 4_000  # texts of one fold that a task scores without that fold's counts
KEPT_WORDS = 1 << 20  # words whose ratios a task remembers
SHARES = (20, 10)  # one in so many words, the most toxic ones, whose mean counts
_START, _END, _FIRST = 1, 2, 3  # marks, and what is added to a character's number
_BITS = np.uint64(21)
_ONE = np.uint64((1 << 21) - 1)
_PLANES = 0x30000  # characters beyond, up to the private planes, are no letters


@lru_cache(1)
def _letters() -> np.ndarray:
    """Letters, digits and the marks that combine with them."""
    return np.array([chr(i).isalnum() or category(chr(i))[0] == "M" for i in range(_PLANES)])


@dataclass
class Grams:
    """Words of several texts, as places in all their characters; packed into n-grams when asked for."""

    points: np.ndarray  # lower-cased characters of all texts
    start: np.ndarray  # of each word
    end: np.ndarray
    text: np.ndarray  # of each word

    def __len__(self) -> int:
        return len(self.text)

    def names(self) -> np.ndarray:
        """A hash of each word."""
        return span_hashes(self.points.astype(np.uint64) + np.uint64(_FIRST), self.start, self.end)

    def only(self, words: np.ndarray) -> Grams:
        """These words (places) alone."""
        return Grams(self.points, self.start[words], self.end[words], self.text[words])

    def packed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hi, lo, word): each character of each word with the ones before it, three to a number; starts are context only."""
        size = self.end - self.start + 2
        first = np.cumsum(size) - size
        word = np.repeat(np.arange(len(self)), size)
        place = np.arange(len(word)) - first[word]
        symbol = np.full(len(word), _END, np.uint64)
        symbol[first] = _START
        inside = (place > 0) & (place < size[word] - 1)
        symbol[inside] = self.points[(self.start[word] + place - 1)[inside]].astype(np.uint64) + np.uint64(_FIRST)
        packed = [np.zeros(len(word), np.uint64), np.zeros(len(word), np.uint64)]
        for back in range(ORDER):
            moved = np.zeros(len(word), np.uint64)
            moved[back:] = symbol[: max(0, len(word) - back)]
            moved[place < back] = 0
            packed[back // 3] |= moved << (_BITS * np.uint64(back % 3))
        read = place > 0
        return packed[1][read], packed[0][read], word[read]


def _grams(texts: pa.Array) -> Grams:
    """Every word of each text, as often as it stands there."""
    lower = [t or "" for t in pc.utf8_lower(texts.cast(pa.large_string())).to_pylist()]
    bounds = np.cumsum([0] + [len(t) + 1 for t in lower])
    points = np.frombuffer("\n".join([*lower, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[np.minimum(points, _PLANES - 1)]
    before, after = np.concatenate(([False], letter[:-1])), np.concatenate((letter[1:], [False]))
    start, end = np.flatnonzero(letter & ~before), np.flatnonzero(letter & ~after) + 1
    return Grams(points, start, end, np.searchsorted(bounds, start, side="right") - 1)


def _distinct(times: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of distinct rows of ``keys``, and the sum of ``times`` of each.

    Rows are brought together by one hash; should two share it, a row may come twice with parts of its sum.
    """
    code = np.zeros(len(times), np.uint64)
    for key in keys:
        code = pair_hash(code, key.astype(np.uint64))
    order = np.argsort(code)
    fresh = np.ones(len(code), bool)
    fresh[1:] = np.logical_or.reduce([key[order[1:]] != key[order[:-1]] for key in keys])
    first = np.flatnonzero(fresh)
    return order[first], np.add.reduceat(times[order], first) if len(first) else times[:0]


def _shorter(hi: np.ndarray, lo: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The last ``order`` characters of each."""
    keep = lambda n: np.uint64((1 << (21 * n)) - 1)
    return (hi & keep(order - 3), lo) if order > 3 else (np.zeros_like(hi), lo & keep(order))


def _name(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    return pair_hash(mix(hi), lo)


def _keys(hi: np.ndarray, lo: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of the last ``order`` characters, and of the context they follow."""
    hi, lo = _shorter(hi, lo, order)
    return _name(hi, lo), _name(hi >> _BITS, (lo >> _BITS) | ((hi & _ONE) << np.uint64(42)))


def _discounts(n: np.ndarray) -> np.ndarray:
    """What is taken off counts of one, two and more (at places 1 to 3), by the counts of counts."""
    seen = np.bincount(np.minimum(n, 5).astype(np.int64), minlength=6)[1:5].astype(float)
    share = seen[0] / max(1.0, seen[0] + 2 * seen[1])
    out = [k - (k + 1) * share * seen[k] / max(1.0, seen[k - 1]) for k in (1, 2, 3)]
    return np.concatenate(([0.0], np.clip(out, [0.1, 0.2, 0.3], [0.95, 1.9, 2.85])))


class Level:
    """Discounted counts of one order: of n-grams, and of contexts with what their n-grams leave to the next order."""

    def __init__(self, gram: np.ndarray, context: np.ndarray, n: np.ndarray, shorter: np.ndarray):
        """``shorter``: of each n-gram, the chance of its last character after the shorter context."""
        off = _discounts(n)[np.minimum(n, 3).astype(np.int64)]
        names, place = np.unique(context, return_inverse=True)
        self.context = HashTable(names)
        self.total = np.bincount(place, weights=n, minlength=len(names))
        self.left = np.bincount(place, weights=off, minlength=len(names))
        # What an n-gram that was seen gives is worked out once.
        self.gram, self.known = HashTable(gram), ((n - off) + self.left[place] * shorter) / self.total[place]

    def unseen(self, of: np.ndarray, shorter: np.ndarray) -> np.ndarray:
        """Chances of characters that never came after their contexts (places, or -1), given those after shorter ones."""
        out, known = shorter.copy(), of >= 0
        of = of[known]
        out[known] = self.left[of] * shorter[known] / self.total[of]
        return out


class Models:
    """Both classes' levels of the highest order over the shared ones below."""

    def __init__(self, hi: np.ndarray, lo: np.ndarray, n: np.ndarray, left_out: int | None = None):
        """``n``: (n-grams, 2 classes, FOLDS) counts, class 0 toxic; a fold may be left out."""
        folds = [f for f in range(FOLDS) if f != left_out]
        n = n[:, :, folds].sum(axis=2)
        some = n.sum(axis=1) > 0
        hi, lo, n = hi[some], lo[some], n[some].astype(float)
        self.symbols = 1 + len(np.unique(lo & _ONE))
        self.shared: list[Level] = []  # the shortest first
        follow = []
        for order in range(ORDER - 1, 0, -1):
            # A continuation count: how many different characters come before.
            _, first = np.unique(_keys(hi, lo, order + 1)[0], return_index=True)
            _, at, count = np.unique(_keys(hi[first], lo[first], order)[0], return_index=True, return_counts=True)
            follow.append((order, hi[first][at], lo[first][at], count.astype(float)))
        for order, h, w, count in reversed(follow):
            self.shared.append(Level(*_keys(h, w, order), count, self._after(h, w, order - 1)))
        gram, context = _keys(hi, lo, ORDER)
        shorter = self._after(hi, lo, ORDER - 1)
        self.classes = [Level(gram[n[:, k] > 0], context[n[:, k] > 0], n[n[:, k] > 0, k], shorter[n[:, k] > 0]) for k in (0, 1)]
        self.gram, self.known = HashTable(gram), self._ratio(gram, context, shorter)

    def _after(self, hi: np.ndarray, lo: np.ndarray, order: int) -> np.ndarray:
        """Chances of characters after contexts shared by the classes; only those not seen go on to the next order."""
        if not order:
            return np.full(len(hi), 1 / self.symbols)
        gram, context = _keys(hi, lo, order)
        level = self.shared[order - 1]
        at = level.gram.find(gram)
        new = np.flatnonzero(at < 0)
        out = level.known[at] if len(level.known) else np.zeros(len(at))
        if len(new):
            out[new] = level.unseen(level.context.find(context[new]), self._after(hi[new], lo[new], order - 1))
        return out

    def _ratio(self, gram: np.ndarray, context: np.ndarray, shorter: np.ndarray) -> np.ndarray:
        chances = []
        for level in self.classes:
            at = level.gram.find(gram)
            p = level.unseen(level.context.find(context), shorter)
            p[at >= 0] = level.known[at[at >= 0]]
            chances.append(np.log(np.maximum(p, 1e-12)))
        return chances[0] - chances[1]

    def ratios(self, grams: Grams) -> np.ndarray:
        """Log-likelihood ratio, toxic over ordinary, of each word."""
        hi, lo, word = grams.packed()
        gram, context = _keys(hi, lo, ORDER)
        at = self.gram.find(gram)
        out = self.known[at] if len(self.known) else np.zeros(len(at))
        new = np.flatnonzero(at < 0)
        of = [level.context.find(context[new]) for level in self.classes]
        # After a context that neither class knows both go by the same shorter one.
        some = (of[0] >= 0) | (of[1] >= 0)
        out[new] = 0.0
        new, of = new[some], [x[some] for x in of]
        shorter = self._after(hi[new], lo[new], ORDER - 1)
        toxic, ordinary = (np.log(np.maximum(level.unseen(x, shorter), 1e-12)) for level, x in zip(self.classes, of))
        out[new] = toxic - ordinary
        return np.bincount(word, weights=out, minlength=len(grams))


class _Ratios:
    """Ratios of words, each worked out once as long as it is remembered."""

    def __init__(self, models: Models):
        self.models, self.names, self.known = models, np.zeros(0, np.uint64), np.zeros(0)

    def of(self, grams: Grams) -> np.ndarray:
        names, first, place = np.unique(grams.names(), return_index=True, return_inverse=True)
        at = np.searchsorted(self.names, names)
        found = at < len(self.names)
        found[found] = self.names[at[found]] == names[found]
        out = np.zeros(len(names))
        out[found] = self.known[at[found]]
        new = np.flatnonzero(~found)
        if len(new):
            order = np.argsort(first[new])
            out[new[order]] = self.models.ratios(grams.only(first[new][order]))
            if len(self.names) + len(new) > KEPT_WORDS:
                self.names, self.known = names, out
            else:
                self.names = np.concatenate((self.names, names[new]))
                order = np.argsort(self.names)
                self.names, self.known = self.names[order], np.concatenate((self.known, out[new]))[order]
        return out[place]


def _features(ratio: np.ndarray, text: np.ndarray, texts: int) -> np.ndarray:
    """Per text: the mean ratio of its words, of its most toxic shares, and the highest; zeros without words."""
    out = np.zeros((texts, len(SHARES) + 2))
    size = np.bincount(text, minlength=texts)
    some = size > 0
    if not some.any():
        return out
    order = np.lexsort((-ratio, text))
    first = np.cumsum(size) - size
    sums = np.concatenate(([0.0], np.cumsum(ratio[order])))
    of = lambda n: sums[first + np.minimum(n, size)] - sums[first]
    out[:, 0] = of(size) / np.maximum(size, 1)
    for k, share in enumerate(SHARES):
        n = np.maximum(2, size // share)
        out[:, k + 1] = of(n) / n
    out[some, -1] = ratio[order][first[some]]
    return out


@dataclass
class ToxicityModel:
    """Counts of n-grams by class and fold, and the logistic weights."""

    hi: np.ndarray
    lo: np.ndarray
    n: np.ndarray
    weights: np.ndarray

    def models(self, left_out: int | None = None) -> Models:
        return Models(self.hi, self.lo, self.n, left_out)

    def ratios(self, left_out: int | None = None) -> _Ratios:
        """What is worked out of these counts; a Python worker keeps the last for its next task."""
        made = self.__dict__.get("_made")
        if made is None or made[0] != left_out:
            made = self._made = (left_out, _Ratios(self.models(left_out)))
        return made[1]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """N-grams of the distinct words of each text, with label and fold."""
    for whole in batches:
        for batch in slices(whole, "text", 1 << 20):
            grams = _grams(batch.column(0))
            if not len(grams):
                continue
            kinds = batch.column(1).to_numpy().astype(np.int64) * FOLDS + batch.column(2).to_numpy()
            names = grams.names()
            once, _ = _distinct(np.ones(len(grams), np.int64), grams.text, names)
            # A word is read once for all texts of a label and fold.
            place, times = _distinct(np.ones(len(once), np.int64), kinds[grams.text[once]], names[once])
            grams = grams.only(once[place])
            hi, lo, word = grams.packed()
            kind = kinds[grams.text[word]]
            row, n = _distinct(times[word], hi, lo, kind)
            yield pa.RecordBatch.from_arrays(
                [pa.array(hi[row].view(np.int64)), pa.array(lo[row].view(np.int64)), pa.array(kind[row].astype(np.int32)), pa.array(n)],
                names=["hi", "lo", "kind", "n"],
            )


def _classes(labels: DataFrame, label: str, id: str) -> DataFrame:
    classes = labels.filter(F.col(label).isNotNull() & F.col(id).isNotNull())
    return classes.groupBy(F.col(id).alias("__id")).agg(F.max(F.col(label).cast("int")).alias("label"))


def _texts_of(docs: DataFrame, classes: DataFrame, id: str, text: str) -> DataFrame:
    rows = docs.select(F.col(id).alias("__id"), F.col(text).cast("string").alias("text")).join(classes, "__id")
    # Null texts last: any other teaches more.
    least = F.min_by(F.struct("text", "label"), F.struct(F.col("text").isNull(), F.xxhash64("text"), "text"))
    return rows.groupBy("__id").agg(least.alias("row")).select("row.text", "row.label")


def labelled(docs: DataFrame, labels: DataFrame, label: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(text, label) of every row labelled 0 or 1.

    Null labels are left out; an id with several labels takes the largest, one with several texts the text of the
    smallest hash.  ``labels`` rows without a text, and null ids, teach nothing.
    """
    classes = stored(_classes(labels, label, id).filter(F.col("label").isin(0, 1)), "classes")
    return _texts_of(docs, sent_if_small(classes, classes.count()), id, text)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, sample: int, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``labelled``, but at most ``sample`` rows per class, in the order of a hash of the id."""
    classes = _classes(labels, label, id)
    order = [F.xxhash64(F.lit(7), "__id"), "__id"]
    parts = [classes.filter(F.col("label") == k).orderBy(*order).limit(sample) for k in (0, 1)]
    # At most 2 * sample rows.
    chosen = F.broadcast(stored(parts[0].unionByName(parts[1]), "sample"))
    return _texts_of(docs, chosen, id, text)


def fit_toxicity(learn: DataFrame) -> ToxicityModel:
    """Fit on (text, label) rows, label 1 toxic; null texts count as empty.

    Without texts of one class every score is that class's smoothed share.
    """
    fold = F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(FOLDS)).cast("int").alias("fold")
    learn = stored(learn.dropDuplicates(["text", "label"]).select("text", F.col("label").cast("int").alias("label"), fold), "learn")
    counted = learn.mapInArrow(_counts, "hi bigint, lo bigint, kind int, n bigint").groupBy("hi", "lo")
    kinds = [(1 - k, f) for k in range(2) for f in range(FOLDS)]  # toxic first
    sums = [F.sum(F.when(F.col("kind") == k * FOLDS + f, F.col("n")).otherwise(0)).cast("int").alias(f"n{k}_{f}") for k, f in kinds]
    table = counted.agg(*sums).toArrow()
    hi, lo = (table[c].to_numpy().view(np.uint64) for c in ("hi", "lo"))
    n = np.stack([table[f"n{k}_{f}"].to_numpy() for k, f in kinds], axis=1).reshape(-1, 2, FOLDS)
    model = ToxicityModel(hi, lo, n, np.zeros(len(SHARES) + 3))
    # A task holds texts of one fold, so it makes one model.
    tasks = max(1, -(-learn.count() // (FOLDS * TEXTS_A_TASK)))
    dealt = learn.repartitionById(FOLDS * tasks, (F.col("fold") * tasks + F.pmod(F.xxhash64(F.lit(3), "text"), F.lit(tasks))).cast("int"))
    seen = stored(_scored(dealt, model, "text", ["label", "fold"], "fold").select("label", "ratios"), "ratios")
    model.weights = fit_logistic_rows(seen, "ratios", "label", len(SHARES) + 2)
    return model


def _scored(docs: DataFrame, model: ToxicityModel, text: str, carried: list[str], left_out: str | None = None) -> DataFrame:
    """``carried`` columns, features and score; ``left_out`` names the fold whose counts a row is scored without."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    fields = [f for f in docs.schema if f.name in carried]
    carried = [f.name for f in fields]
    sent_columns = carried if text in carried else [*carried, text]
    rows, at = docs.select(*[F.col(f"`{c}`") for c in sent_columns]), sent_columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given, known, fold = sent.value, None, None

        def ready(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            if left_out is None:
                yield batch
                return
            folds = batch.column(sent_columns.index(left_out)).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(folds)) + 1).tolist(), len(folds)]
            for a, b in zip(cuts, cuts[1:]):
                if b > a:
                    yield batch.slice(a, b - a)

        for whole in batches:
            for one in ready(whole):
                wanted = None if left_out is None else one.column(sent_columns.index(left_out))[0].as_py()
                if known is None or wanted != fold:
                    known, fold = given.ratios(wanted), wanted
                for batch in slices(one, text, 1 << 20):
                    grams = _grams(batch.column(at))
                    x = _features(known.of(grams), grams.text, batch.num_rows)
                    yield pa.RecordBatch.from_arrays(
                        [*batch.columns[: len(carried)], pa.array(list(x), pa.list_(pa.float64())), pa.array(logistic(x, given.weights))],
                        names=[*carried, "ratios", "toxicity"],
                    )

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in fields)
    return rows.mapInArrow(run, schema + "ratios array<double>, toxicity double")


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """All columns of ``docs`` (one named ``toxicity`` is replaced) plus ``toxicity``, 0 to 1.

    Null text counts as empty; a text without words has the log ratio 0.
    """
    carried = [c for c in docs.columns if c != "toxicity"]
    names = {c: f"c{i}" for i, c in enumerate(carried)}
    source = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    out = _scored(source, model, names[text], list(names.values()))
    return out.select(*[F.col(n).alias(c) for c, n in names.items()], "toxicity")
