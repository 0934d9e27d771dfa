"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad.  A line's state depends on features of the line, on the same features of the
lines before and after it, and on the state of the line before.  Forward-backward gives each line's
marginal probability of being good; a text's quality is the length-weighted mean of the marginals,
brought to a probability of label 1 by a logistic function of that mean and of its worst lines.

Labels mark whole texts, so the field is fitted twice: first with every line of a text under the text's
label, then, in texts labelled bad, with lines under the first fit's marginals scaled so that the worst
line counts as bad.  The fit uses at most ``sample`` labelled texts of each class, whole, the first in
the order of a hash of the id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from riskweft.llm.logistic import fit_logistic, logistic
from riskweft.llm.wordarrays import NOT_BLANK, slices, split_words, text_bytes

SAMPLE = 3_000
BINS = 8
SEGMENT = 64  # lines of one training sequence
_KIND = {
    "letters": lambda i: i >= 128 or chr(i).isalpha(),
    "digits": lambda i: 48 <= i <= 57,
    "capitals": lambda i: 65 <= i <= 90,
    "stops": lambda i: chr(i) in ".,;:!?'\"()-" and i < 128,
    "signs": lambda i: 32 < i < 127 and not chr(i).isalnum() and chr(i) not in ".,;:!?'\"()-",
}
_TABLES = {k: np.array([f(i) for i in range(256)]) for k, f in _KIND.items()}
#: What a line is described by, in the order of the columns of ``line_features``.
FEATURES = (
    *_KIND, "length", "words", "word_length", "same_word_again", "distinct_words", "same_byte_again",
    "lone_signs", "ends_in_stop", "line_again",
)


@dataclass
class Lines:
    """Lines of several texts: features, byte lengths, and the first line of each text."""

    x: np.ndarray
    size: np.ndarray
    first: np.ndarray


def _share(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return sums[bounds[1:]] - sums[bounds[:-1]]


def line_features(raw: np.ndarray, bounds: np.ndarray) -> Lines:
    """Features of all non-blank lines; a text without any has no line."""
    breaks = np.flatnonzero(raw == 10)
    cuts = np.unique(np.concatenate((bounds, breaks + 1)))
    length = np.diff(cuts)
    filled = _share(NOT_BLANK[raw], cuts) if len(raw) else length
    keep = np.flatnonzero(filled > 0)
    start, end = cuts[keep], cuts[keep + 1] if len(keep) else cuts[keep]
    n = np.maximum(filled[keep], 1).astype(float)
    first = np.searchsorted(start, bounds)
    if not len(keep):
        return Lines(np.zeros((0, len(FEATURES))), np.zeros(0), first)
    columns = [_share(t[raw], cuts)[keep] / n for t in _TABLES.values()]
    words = split_words(raw, np.unique(np.concatenate((bounds, cuts))), NOT_BLANK)
    at = np.searchsorted(words.start, np.append(start, len(raw)))
    count = np.diff(at)
    width = (words.end - words.start).astype(float)
    owner = np.repeat(np.arange(len(start)), count)
    hashes = words.hash[at[0] : at[-1]]
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    order = np.lexsort((hashes, owner))
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    repeated = np.zeros(len(raw), bool)
    repeated[1:] = (raw[1:] == raw[:-1]) & NOT_BLANK[raw[1:]]
    lone = np.zeros(len(words.start), bool)
    lone[:] = (width == 1) & _TABLES["signs"][raw[words.start]]
    at0 = at - at[0]
    last = raw[words.end[at[1:] - 1] - 1]
    sign = np.add.reduceat(hashes * (np.arange(len(hashes)) - np.repeat(at0[:-1], count) + 1).astype(np.uint64), at0[:-1])
    text = np.searchsorted(first, np.arange(len(start)), side="right") - 1
    place = np.lexsort((sign, text))
    twice = np.zeros(len(start), bool)
    equal = (sign[place][1:] == sign[place][:-1]) & (text[place][1:] == text[place][:-1])
    twice[place[1:][equal]] = True
    twice[place[:-1][equal]] = True
    c = count.astype(float)
    columns += [
        np.log1p(n), np.log1p(c), n / c,
        np.add.reduceat(again, at0[:-1], dtype=np.int64) / c,
        np.add.reduceat(fresh, at0[:-1], dtype=np.int64) / c,
        _share(repeated, cuts)[keep] / n,
        np.add.reduceat(lone[at[0] : at[-1]], at0[:-1], dtype=np.int64) / c,
        np.isin(last, np.frombuffer(b".!?:;\"')", np.uint8)).astype(float),
        twice.astype(float),
    ]
    return Lines(np.column_stack(columns), n, first)


def with_neighbours(codes: np.ndarray, text: np.ndarray, bins: int) -> np.ndarray:
    """One-hot column numbers of a line's binned features, and of its neighbours'; -1 beyond the text."""
    k = codes.shape[1]
    own = codes + np.arange(k) * bins
    before, after = np.full_like(own, -1), np.full_like(own, -1)
    same = text[1:] == text[:-1]
    before[1:][same] = own[:-1][same] + k * bins
    after[:-1][same] = own[1:][same] + 2 * k * bins
    return np.concatenate((own, before, after), axis=1)


@dataclass
class LineField:
    """Weights of the field: per one-hot column for state bad, and the log weights of state pairs."""

    edges: list[np.ndarray]
    weights: np.ndarray
    moves: np.ndarray  # [from, to], 0 good and 1 bad
    start: np.ndarray
    aggregate: np.ndarray

    def columns(self, lines: Lines) -> np.ndarray:
        codes = np.column_stack([np.searchsorted(e, lines.x[:, k], side="right") for k, e in enumerate(self.edges)])
        text = np.searchsorted(lines.first, np.arange(len(lines.x)), side="right") - 1
        return with_neighbours(codes.astype(np.int64), text, BINS)

    def leaning(self, columns: np.ndarray) -> np.ndarray:
        """Log weight of state bad over state good of each line."""
        padded = np.append(self.weights, 0.0)  # column -1
        return padded[columns].sum(axis=1)


def _logadd(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logaddexp(a, b)


def forward_backward(leaning: np.ndarray, first: np.ndarray, moves: np.ndarray, start: np.ndarray):
    """P(bad) of each line, and the expected state pairs summed over all lines.

    Sequences run in step: step t handles line t of every sequence that has one, longest first.
    """
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    order = order[size[order] > 0]
    begin, size = first[:-1][order], size[order]
    n, steps = len(leaning), int(size.max()) if len(size) else 0
    node = np.column_stack([np.zeros(n), leaning])
    alpha, beta = np.zeros((n, 2)), np.zeros((n, 2))
    alive = np.searchsorted(-size, -np.arange(1, steps + 1), side="right")
    for t in range(steps):
        at = begin[: alive[t]] + t
        if t == 0:
            alpha[at] = node[at] + start
        else:
            a = alpha[at - 1]
            for s in (0, 1):
                alpha[at, s] = node[at, s] + _logadd(a[:, 0] + moves[0, s], a[:, 1] + moves[1, s])
    for t in range(steps - 2, -1, -1):
        at = begin[: alive[t + 1]] + t
        b = beta[at + 1] + node[at + 1]
        for s in (0, 1):
            beta[at, s] = _logadd(b[:, 0] + moves[s, 0], b[:, 1] + moves[s, 1])
    total = alpha + beta
    bad = 1 / (1 + np.exp(np.clip(total[:, 0] - total[:, 1], -50, 50)))
    pairs = np.zeros((2, 2))
    inner = np.ones(n, bool)
    inner[begin] = False
    at = np.flatnonzero(inner)
    if len(at):
        z = _logadd(total[at, 0], total[at, 1])
        for r in (0, 1):
            for s in (0, 1):
                pairs[r, s] = np.exp(alpha[at - 1, r] + moves[r, s] + node[at, s] + beta[at, s] - z).sum()
    return bad, pairs, begin


def fit_field(lines: Lines, label_bad: np.ndarray, rounds: int = 120, ridge: float = 1.0) -> LineField:
    """Fit to texts' labels (1 bad) by gradient steps with momentum; see the module for the two fits."""
    k = lines.x.shape[1]
    quantiles = np.linspace(0, 1, BINS + 1)[1:-1]
    edges = [np.unique(np.quantile(lines.x[:, i], quantiles)) if len(lines.x) else np.zeros(0) for i in range(k)]
    field = LineField(edges, np.zeros(3 * k * BINS), np.zeros((2, 2)), np.zeros(2), np.zeros(4))
    text = np.searchsorted(lines.first, np.arange(len(lines.x)), side="right") - 1
    if len(lines.x) and len(np.unique(label_bad)) == 2:
        columns = field.columns(lines)
        target = label_bad[text].astype(float)
        cut = np.unique(np.concatenate([lines.first] + [np.arange(a, b, SEGMENT) for a, b in zip(lines.first, lines.first[1:])]))
        for _ in range(2):
            _climb(field, columns, target, cut, rounds, ridge)
            bad, _, _ = forward_backward(field.leaning(columns), lines.first, field.moves, field.start)
            worst = np.zeros(len(label_bad))
            np.maximum.at(worst, text, bad)
            target = np.where(label_bad[text] == 1, bad / np.maximum(worst[text], 1e-9), 0.0)
    field.aggregate = fit_logistic(aggregates(lines, field), 1 - label_bad.astype(float))
    return field


def _climb(field: LineField, columns: np.ndarray, target: np.ndarray, cut: np.ndarray, rounds: int, ridge: float) -> None:
    n = len(target)
    slot = np.where(columns < 0, len(field.weights), columns)
    used = slot.ravel()
    inner = np.ones(n, bool)
    inner[cut[cut < n]] = False
    at = np.flatnonzero(inner)
    sides = [(1 - target, target), (1 - target, target)]
    wanted = np.array([[(sides[0][r][at - 1] * sides[1][s][at]).sum() for s in (0, 1)] for r in (0, 1)])
    heads = cut[:-1][np.diff(cut) > 0]
    wanted_start = np.array([(1 - target[heads]).sum(), target[heads].sum()])
    theta = np.concatenate((field.weights, field.moves.ravel(), field.start))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        size = len(field.weights)
        field.weights, field.moves, field.start = theta[:size], theta[size : size + 4].reshape(2, 2), theta[size + 4 :]
        bad, pairs, _ = forward_backward(field.leaning(columns), cut, field.moves, field.start)
        slope = np.bincount(used, weights=np.repeat(target - bad, columns.shape[1]), minlength=size + 1)[:size]
        begin = np.array([(1 - bad[heads]).sum(), bad[heads].sum()])
        grad = (np.concatenate((slope, (wanted - pairs).ravel(), wanted_start - begin)) - ridge * theta) / n
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta + 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    size = len(field.weights)
    field.weights, field.moves, field.start = theta[:size], theta[size : size + 4].reshape(2, 2), theta[size + 4 :]


def aggregates(lines: Lines, field: LineField) -> np.ndarray:
    """Per text: length-weighted mean marginal of good lines, its log odds, and the worst line's log odds."""
    n = len(lines.first) - 1
    out = np.zeros((n, 3))
    if not len(lines.x):
        return out
    bad, _, _ = forward_backward(field.leaning(field.columns(lines)), lines.first, field.moves, field.start)
    some = np.diff(lines.first) > 0
    heads = lines.first[:-1][some]
    weight = np.add.reduceat(lines.size, heads)
    good = np.add.reduceat((1 - bad) * lines.size, heads) / weight
    odds = lambda p: np.log(np.clip(p, 1e-6, 1 - 1e-6) / np.clip(1 - p, 1e-6, 1))
    out[some] = np.column_stack([good, odds(good), odds(np.maximum.reduceat(bad, heads))])
    return out


def fit_quality(sample: DataFrame) -> LineField:
    """Fit on a bounded (text, label) table, label 1 good (see ``toxicity.labelled_sample``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                lines = line_features(*text_bytes(batch.column(0), lower=False))
                parts = [np.column_stack([lines.x[a:b], lines.size[a:b]]).ravel() for a, b in zip(lines.first, lines.first[1:])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1), pa.array([p.astype("<f4").tobytes() for p in parts], pa.binary())], names=["label", "lines"]
                )

    rows = sample.select("text", F.col("label").cast("int").alias("label")).mapInArrow(run, "label int, lines binary")
    rows = rows.toPandas()
    tables = [np.frombuffer(b, "<f4").reshape(-1, len(FEATURES) + 1) for b in rows["lines"]]
    first = np.concatenate(([0], np.cumsum([len(t) for t in tables]))).astype(np.int64)
    everything = np.concatenate(tables).astype(float) if tables else np.zeros((0, len(FEATURES) + 1))
    lines = Lines(everything[:, :-1], everything[:, -1], first)
    return fit_field(lines, 1 - rows["label"].to_numpy(np.int64))


def score_quality(docs: DataFrame, field: LineField, text: str = "text") -> DataFrame:
    """All columns of ``docs`` (one named ``quality_score`` is replaced) plus ``quality_score``, 0 to 1.

    Null, empty and blank texts have no line and get the score of aggregates 0; a very long text or a
    text of many lines is scored whole.
    """
    carried = [c for c in docs.columns if c != "quality_score"]
    rows, at = docs.select(*[F.col(f"`{c}`") for c in carried]), carried.index(text)
    sent = docs.sparkSession.sparkContext.broadcast(tuple(vars(field).values()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = LineField(*sent.value)
        for whole in batches:
            for batch in slices(whole, text, 2 << 20):
                lines = line_features(*text_bytes(batch.column(at), lower=False))
                score = logistic(aggregates(lines, known), known.aggregate)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[: len(carried)], pa.array(score)], names=[*carried, "quality_score"]
                )

    kept = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = "".join(f"`{c}` {kept[c]}, " for c in carried)
    return rows.mapInArrow(run, schema + "quality_score double")
