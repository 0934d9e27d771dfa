"""Jaccard join of word n-gram sets by a grouped prefix join.

A set's n-grams stand in one order for all: by hash, the frequent ones last.  Sets with a Jaccard similarity of
``percent`` hundredths share an n-gram among their first n - ceil(t * n) + 1, their prefixes.  Sets of one size and one
prefix act alike in this search and form a group; groups that meet at an n-gram are paired under the bounds of their
sizes and of its places in both, and of what the marks of their sets tell: a mark has a bit for the parity of the
n-grams that fall on it, so two sets differ in at least as many n-grams as their marks in bits.  Only then are their
members compared, by their whole sets, for which no other text is read again.

Frequent n-grams are found by counting: every text shows a window of half as many again as its prefix, and n-grams in
more than ``OFTEN`` windows move to the end.  A set that has too few others left in its window shows all it has.
The order only decides how much is compared, never what is found.

Links are wanted up to their components.  Where an n-gram holds many groups, one of them stands for it, and each group
is compared with a few such heads: this joins tight families without pairing their members.  Then each group there is
compared with the one of another component whose mark is nearest, among those dealt to its chunk of the n-gram: this
joins loose families, whose members are far from any one head, by a row for each place.  It goes on as long as one in
eight is linked and a round finds more than a quarter of the links of the one before.
Then whatever meets and still lies in different components is paired in full, chunk by chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from riskweft.llm.components import connected_components
from riskweft.llm.skew import join_spread
from riskweft.llm.store import stored
from riskweft.llm.wordarrays import NOT_BLANK, mix, pair_hash, slices, split_words, text_bytes

WORDS, PERCENT = 4, 85
OFTEN = 8  # windows that may share an n-gram before it moves to the end of the order
FEW = 8  # groups at one n-gram that are paired in full at once
HEADS = 4  # heads that a group is compared with in a round
ROUNDS = 4  # the first with heads, the others with the nearest
MOST_OFTEN = 1 << 21  # n-grams that may move, the most frequent first: 16 MB in a task
FILTER_BITS = 27  # most bits of a name filter, as a power of two: 16 MB
SLICE = 1 << 19  # bytes of text that a task cuts into n-grams at once
CHUNK = 2_048  # groups of one n-gram that a task pairs at once
VERIFY = 256  # sets compared with one other in a task
MARKS = ["m0", "m1", "m2", "m3"]  # 256 bits of a set
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def ngram_sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct n-grams of all texts, ascending in each, and the bounds of each text.

    A-Z are lower-cased and words cut at ASCII blanks.  A text of fewer words is one n-gram; one without words has none.
    """
    raw, bounds = text_bytes(texts, lower=False)
    found = split_words(_LOWER[raw], bounds, NOT_BLANK)
    text, size, n = found.text, np.diff(found.first), len(found.hash)
    width = np.minimum(size, words)[text]
    place, last = np.arange(n), found.first[1:][text]
    code = found.hash
    for k in range(1, words):
        code = np.where(k < width, pair_hash(code, found.hash[np.minimum(place + k, n - 1)]), code)
    whole = place + width <= last
    text, code = text[whole], code[whole]
    order = np.argsort(code)
    # Fewer than 65,536 texts a slice are sorted by counting.
    of = text[order] if len(size) > 1 << 16 else text[order].astype(np.uint16)
    order = order[np.argsort(of, kind="stable")]
    text, code = text[order], code[order]
    fresh = np.ones(len(code), bool)
    fresh[1:] = (code[1:] != code[:-1]) | (text[1:] != text[:-1])
    text, code = text[fresh], code[fresh]
    return code, np.searchsorted(text, np.arange(len(size) + 1))


def set_names(code: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set."""
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(code), dtype=np.uint64)))
    return mix(sums[bounds[1:]] - sums[bounds[:-1]] + np.diff(bounds).astype(np.uint64)).view(np.int64)


def prefix_length(n, percent: int):
    """Places of which one is shared by any two linked sets; n is the size of the set."""
    return n - (percent * n + 99) // 100 + 1


def _texts(docs: DataFrame, id: str, text: str) -> DataFrame:
    return docs.select(F.col(id).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))


def _windows(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(id, set, n, list, mark) of every row: the set's name and size, its window, and its mark in ``MARKS``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                code, bounds = ngram_sets(batch.column(1), words)
                n = np.diff(bounds).astype(np.int64)
                shown = np.where(n > 0, np.minimum(n, _window(n, percent)), 0)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0), pa.array(set_names(code, bounds)), pa.array(n), _blobs(code, bounds[:-1], bounds[:-1] + shown),
                        *map(pa.array, _marks(code, bounds)),
                    ],
                    names=["id", "set", "n", "list", *MARKS],
                )

    return docs.mapInArrow(run, "id bigint, set bigint, n bigint, list binary, " + ", ".join(f"{m} bigint" for m in MARKS))


def _marks(code: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """Of each set, whether an odd number of its n-grams falls on each bit."""
    rows, bits = len(bounds) - 1, 64 * len(MARKS)
    at = np.repeat(np.arange(rows) * bits, np.diff(bounds)) + (mix(code) % np.uint64(bits)).astype(np.int64)
    odd = (np.bincount(at, minlength=rows * bits) & 1).astype(np.uint8).reshape(rows, bits)
    return list(np.ascontiguousarray(np.packbits(odd, axis=1).view(np.int64).T))


def _blobs(code: np.ndarray, first: np.ndarray, last: np.ndarray) -> pa.Array:
    return pa.array([code[a:b].tobytes() for a, b in zip(first.tolist(), last.tolist())], pa.binary())


def _lists(docs: DataFrame, rows: DataFrame, words: int, wanted: DataFrame) -> DataFrame:
    """(set, n, list): all n-grams, ascending, of the ``wanted`` sets (set), read again from a text of each in ``rows``."""
    held = rows.filter("n > 0").select("id", "set").join(wanted, "set", "left_semi")
    held = stored(held.groupBy("set").agg(F.min("id").alias("id")), "held")
    ids = held.filter("id IS NOT NULL").select("id").distinct()
    # Rows without an id are told apart by their sets alone.
    nameless = not held.filter("id IS NULL").isEmpty()
    sent = docs.sparkSession.sparkContext.broadcast((_name_filter(ids, 32), _name_filter(held.select("set"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (some, known), gone = sent.value, set()
        for every in batches:
            null = every.column(0).is_null().to_numpy(zero_copy_only=False)
            id = every.column(0).fill_null(0).to_numpy()
            whole = every.filter(pa.array(np.where(null, nameless, _may_hold(some, id))))
            for batch in slices(whole, "text", SLICE):
                code, bounds = ngram_sets(batch.column(1), words)
                names, size = set_names(code, bounds), np.diff(bounds)
                rows = []
                for row in np.flatnonzero((size > 0) & _may_hold(known, names)).tolist():
                    if names[row] not in gone:  # a task sends a set once
                        gone.add(names[row])
                        rows.append(row)
                rows = np.array(rows, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names[rows]), pa.array(size[rows].astype(np.int64)), _blobs(code, bounds[rows], bounds[rows + 1])],
                    names=["set", "n", "list"],
                )

    # Equal sets have equal lists.
    found = docs.mapInArrow(run, "set bigint, n bigint, list binary").join(wanted, "set", "left_semi")
    return stored(found.dropDuplicates(["set"]), "lists")


def _cells(names: np.ndarray, bits: int) -> np.ndarray:
    return (mix(names.view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)


def _may_hold(known: np.ndarray, names: np.ndarray) -> np.ndarray:
    cell = _cells(names, int(len(known) * 64).bit_length() - 1)
    return (known[cell >> 6] >> (cell & 63).astype(np.uint64)) & np.uint64(1) > 0


def _name_filter(names: DataFrame, each: int = 8) -> np.ndarray:
    """A bit table of all ``names`` (one bigint column): ``each`` bits a name, at most 2 ** FILTER_BITS.

    Beyond that size it lets more strangers pass; it never stops a name that it was made from.
    """
    bits = min(FILTER_BITS, max(12, int(each * max(1, names.count()) - 1).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << (bits - 6), np.uint64)
        for batch in batches:
            cell = _cells(batch.column(0).to_numpy(), bits)
            np.bitwise_or.at(table, cell >> 6, np.uint64(1) << (cell & 63).astype(np.uint64))
        place = np.flatnonzero(table)
        for a in range(0, len(place), 1 << 16):
            part = place[a : a + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(table[part].view(np.int64))], names=["word", "bits"])

    rows = names.mapInArrow(run, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(1 << (bits - 6), np.uint64)
    table[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return table


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams of a column of lists, and the bounds of each list."""
    parts = [np.frombuffer(v.as_buffer(), np.uint64) for v in column]
    bounds = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), bounds


def _frequent(lists: DataFrame, percent: int, beyond: bool) -> DataFrame:
    """(code, n) of n-grams that stand in several lists; with ``beyond``, only past the window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gone = set()
        for batch in batches:
            names = batch.column(0).to_pylist()
            fresh = [x not in gone and not gone.add(x) for x in names]  # copies in a task count once
            batch = batch.filter(pa.array(fresh, pa.bool_()))
            code, bounds = _flat(batch.column(2))
            if beyond:
                place = np.arange(len(code)) - np.repeat(bounds[:-1], np.diff(bounds))
                shown = _window(batch.column(1).to_numpy(), percent)
                code = code[place >= np.repeat(shown, np.diff(bounds))]
            code, n = np.unique(code, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(code.view(np.int64)), pa.array(n.astype(np.int64))], names=["code", "n"])

    found = lists.select("set", "n", "list").mapInArrow(run, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n"))
    return found.filter("n > 1")


def _window(n, percent: int):
    return prefix_length(n, percent) * 3 // 2


def _most_frequent(counts: DataFrame) -> np.ndarray:
    """N-grams with a count above ``OFTEN``, or above the least count that leaves at most ``MOST_OFTEN`` of them."""
    sizes = counts.filter(F.col("n") > OFTEN).groupBy("n").agg(F.count(F.lit(1)).alias("m")).orderBy(F.desc("n")).collect()
    above, held = OFTEN, 0
    for row in sizes:
        held += row["m"]
        if held > MOST_OFTEN:
            above = row["n"]
            break
    often = counts.filter(F.col("n") > above).select("code").toArrow()
    return np.sort(often["code"].to_numpy().view(np.uint64))


def _among(code: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(code), bool)
    return keys[np.minimum(np.searchsorted(keys, code), len(keys) - 1)] == code


def _lacking(lists: DataFrame, often: np.ndarray, percent: int) -> DataFrame:
    """(set) of lists with too few other n-grams for a prefix, though the set has more than they show."""
    sent = lists.sparkSession.sparkContext.broadcast(often)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, bounds = _flat(batch.column(2))
            n = batch.column(1).to_numpy()
            rare = np.concatenate(([0], np.cumsum(~_among(code, sent.value))))
            left = rare[bounds[1:]] - rare[bounds[:-1]]
            short = (left < prefix_length(n, percent)) & (np.diff(bounds) < n)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(short))], names=["set"])

    return lists.select("set", "n", "list").mapInArrow(run, "set bigint")


def _prefixes(lists: DataFrame, often: np.ndarray, met: np.ndarray, percent: int) -> DataFrame:
    """(set, n, prefix, code, place): the prefix's name, and its n-grams that other prefixes may hold, with places."""
    sent = lists.sparkSession.sparkContext.broadcast((often, met))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, known = sent.value
        for batch in batches:
            code, bounds = _flat(batch.column(2))
            n, size = batch.column(1).to_numpy(), np.diff(bounds)
            row = np.repeat(np.arange(len(n)), size)
            order = np.lexsort((code, _among(code, frequent), row))
            code = code[order]
            place = np.arange(len(code)) - bounds[:-1][row]
            inside = place < prefix_length(n, percent)[row]
            code, row, place = code[inside], row[inside], place[inside] + 1
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(code), dtype=np.uint64)))
            edge = np.searchsorted(row, np.arange(len(n) + 1))
            name = mix(sums[edge[1:]] - sums[edge[:-1]] + mix(n.astype(np.uint64)))
            keep = _may_hold(known, code.view(np.int64))
            code, row, place = code[keep], row[keep], place[keep]
            edge = np.searchsorted(row, np.arange(len(n) + 1)).astype(np.int32)
            some = np.diff(edge) > 0
            out = pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array(name.view(np.int64)),
                    pa.ListArray.from_arrays(edge, code.view(np.int64)), pa.ListArray.from_arrays(edge, place.astype(np.int32)),
                ],
                names=["set", "n", "prefix", "code", "place"],
            )
            yield out.filter(pa.array(some))

    return lists.select("set", "n", "list").mapInArrow(
        run, "set bigint, n bigint, prefix bigint, code array<bigint>, place array<int>"
    )


def _fits(n, place, other_n, other_place, percent: int):
    """Whether sets whose first shared n-gram has these places can be linked; for columns and for arrays."""
    sizes = (100 * n >= percent * other_n) & (100 * other_n >= percent * n)
    # One shared here, and at most what is left of the shorter rest.
    enough = lambda rest: (100 + percent) * (rest + 1) >= percent * (n + other_n)
    return sizes & enough(n - place) & enough(other_n - other_place)


def _stars(places: DataFrame, percent: int) -> DataFrame:
    """(rep, head): each group with at most ``HEADS`` heads of other components that it meets, the most frequent first."""
    seen = F.struct(F.xxhash64("rep", "code").alias("draw"), "rep", "low", "n", "place")
    first = places.groupBy("code").agg(
        F.min(seen).alias("head"), F.min("low").alias("least"), F.max("high").alias("most"), F.count(F.lit(1)).alias("m")
    )
    first = stored(first.filter((F.col("least") < F.col("most")) & (F.col("m") > FEW)).select("code", "head"), "heads")
    met = stored(join_spread(places, first, ["code"]), "met")
    apart = (F.col("low") != F.col("high")) | (F.col("low") != F.col("head.low"))
    second = met.filter(apart).groupBy("code").agg(F.min(seen).alias("next"))
    met = join_spread(met, stored(second, "seconds"), ["code"], "left")
    to = F.when(apart, F.col("head")).otherwise(F.col("next")).alias("to")
    chosen = met.select("rep", "n", "place", to).filter(F.col("to.rep") != F.col("rep"))
    fits = _fits(F.col("n"), F.col("place"), F.col("to.n"), F.col("to.place"), percent)
    shared = chosen.filter(fits).groupBy("rep", F.col("to.rep").alias("head")).agg(F.count(F.lit(1)).alias("m"))
    # A group has at most a head for each n-gram of its prefix.
    order = Window.partitionBy("rep").orderBy(F.desc("m"), "head")
    return shared.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= HEADS).select("rep", "head")


def _spread(rows: DataFrame, members: DataFrame) -> DataFrame:
    """(rep, mark, radius): the mark of each group's first set, and the most bits by which a member's differs from it."""
    marks = rows.filter("n > 0").groupBy("set").agg(*[F.min(m).alias(m) for m in MARKS])  # equal sets, equal marks
    held = stored(members.join(marks, "set"), "marks")
    first = stored(held.filter("rep = set").select("rep", *[F.col(m).alias(f"first_{m}") for m in MARKS]), "first_marks")
    bits = sum((F.bit_count(F.col(m).bitwiseXOR(F.col(f"first_{m}"))) for m in MARKS), F.lit(0)).cast("bigint")
    far = join_spread(held, first, ["rep"]).groupBy("rep").agg(F.max(bits).alias("radius"))
    return first.join(far, "rep").select("rep", *[F.col(f"first_{m}").alias(m) for m in MARKS], "radius")


def _rest(places: DataFrame, marks: DataFrame, percent: int, chunk: int, turn: int | None = None) -> DataFrame:
    """(rep, head): all pairs of groups that meet, fit, and are not one component already.

    With a ``turn``, only each group's nearest by mark at each n-gram, in a chunk that is drawn anew each turn.
    """
    every = turn is None
    spans = places.groupBy("code").agg(F.min("low").alias("least"), F.max("high").alias("most"), F.count(F.lit(1)).alias("m"))
    spans = spans.filter("least < most AND m > 1").select("code", F.ceil(F.col("m") / F.lit(chunk)).cast("bigint").alias("parts"))
    rows = join_spread(places, stored(spans, "spans"), ["code"]).join(marks, "rep")
    own = F.pmod(F.xxhash64("rep", F.lit(turn or 0)), F.col("parts"))
    # A chunk meets every other one: each pair of chunks is a task's work of its own.
    others = F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1) if every else F.array(own)
    pair = F.transform(others, lambda k: F.struct(F.least(own, k).alias("a"), F.greatest(own, k).alias("b")))
    dealt = rows.select("code", F.explode(pair).alias("pair"), own.alias("own"), "rep", "n", "place", "low", "high", *MARKS, "radius")
    dealt = dealt.select("code", "pair.a", "pair.b", "own", "rep", "n", "place", "low", "high", *MARKS, "radius")
    dealt = dealt.repartition("code", "a", "b").sortWithinPartitions("code", "a", "b", "n", "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def pairs(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            code, a, b, own, rep, n, place, low, high, *mark, radius = columns
            mark = [m.view(np.uint64) for m in mark]
            change = (code[1:] != code[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            last = np.concatenate((np.flatnonzero(change) + 1, [len(code)]))
            end = last[np.searchsorted(last, np.arange(len(code)), side="right")]
            first, us, vs, size = np.arange(len(code)), [], [], 0
            least, nearest = np.full(len(code), 64 * len(mark) + 1), np.full(len(code), -1)
            # Every row with the one ``step`` later, while they stand at the same n-gram and the sizes still fit.
            for step in range(1, len(code)):
                first = first[first + step < end[first]]
                first = first[100 * n[first] >= percent * n[first + step]]
                if not len(first):
                    break
                second = first + step
                ok = _fits(n[first], place[first], n[second], place[second], percent)
                ok &= (low[first] != high[first]) | (low[second] != high[second]) | (low[first] != low[second])
                ok &= (a[first] == b[first]) | (own[first] != own[second])
                u, v = first[ok], second[ok]
                bits = sum(np.bitwise_count(m[u] ^ m[v]).astype(np.int64) for m in mark)
                # Linked sets differ in no more n-grams than this.
                near = (100 + percent) * (bits - radius[u] - radius[v]) <= (100 - percent) * (n[u] + n[v])
                u, v, bits = u[near], v[near], bits[near]
                if not every:
                    for one, other in ((u, v), (v, u)):
                        closer = bits < least[one]
                        least[one[closer]], nearest[one[closer]] = bits[closer], other[closer]
                    continue
                us.append(rep[u])
                vs.append(rep[v])
                size += len(us[-1])
                if size > 500_000:
                    yield found(us, vs)
                    us, vs, size = [], [], 0
            if not every:
                some = nearest >= 0
                us, vs = [rep[some]], [rep[nearest[some]]]
            yield found(us, vs)

        def found(us: list, vs: list) -> pa.RecordBatch:
            u, v = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (us, vs))
            both = np.unique(np.column_stack([np.minimum(u, v), np.maximum(u, v)]), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(both[:, k].copy()) for k in (0, 1)], names=["rep", "head"])

        for batch in batches:
            columns = [c.to_numpy() for c in batch.columns]
            if held is not None:
                columns = [np.concatenate(x) for x in zip(held, columns)]
            # What stands at the last n-gram may go on; it is at most a pair of chunks.
            same = (columns[0] == columns[0][-1:]) & (columns[1] == columns[1][-1:]) & (columns[2] == columns[2][-1:])
            cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            if cut:
                yield from pairs([c[:cut] for c in columns])
            held = [c[cut:] for c in columns]
        if held is not None and len(held[0]):
            yield from pairs(held)

    return dealt.mapInArrow(run, "rep bigint, head bigint").distinct()


def _linked(pairs: DataFrame, lists: DataFrame, percent: int) -> DataFrame:
    """The pairs of sets (u, v; a stored table) that are linked, by their whole sets (set, list)."""
    size = stored(pairs.groupBy("u").agg(F.ceil(F.count(F.lit(1)) / F.lit(VERIFY)).cast("bigint").alias("parts")), "sizes")
    salted = join_spread(pairs, size, ["u"]).withColumn("salt", F.pmod(F.xxhash64("v"), F.col("parts")))
    one = lists.select(F.col("set").alias("u"), "list").join(size, "u")
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("salt")
    one = one.select("u", every, F.lit(None).cast("bigint").alias("v"), "list")
    other = salted.join(lists.select(F.col("set").alias("v"), "list"), "v").select("u", "salt", "v", "list")
    rows = one.unionByName(other).repartition("u", "salt").sortWithinPartitions("u", "salt", F.asc_nulls_first("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, base = None, None
        for batch in batches:
            u, known = batch.column(0).to_numpy(), batch.column(2).is_valid().to_numpy(zero_copy_only=False)
            found = [[], []]
            for row in range(batch.num_rows):
                code = np.frombuffer(batch.column(3)[row].as_buffer(), np.uint64)
                if not known[row]:
                    head, base = u[row], code.copy()
                elif head == u[row]:
                    shared = int(_among(code, base).sum())
                    if 100 * shared >= percent * (len(code) + len(base) - shared):
                        found[0].append(int(head))
                        found[1].append(batch.column(2)[row].as_py())
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["u", "v"])

    return stored(rows.mapInArrow(run, "u bigint, v bigint"), "links")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("u").alias("set")).union(pairs.select("v")).distinct()


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).filter("u < v").distinct()


def similar_sets(
    docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT, chunk: int = CHUNK,
) -> tuple[DataFrame, DataFrame]:
    """(rows, groups): (id, set, n) of every row of ``docs``, and (set, component) of sets with a link to another."""
    docs = _texts(docs, id, text)
    rows = stored(_windows(docs, words, percent), "windows")
    lists = rows.filter("n > 0").select("set", "n", "list")
    counts = stored(_frequent(lists, percent, beyond=False), "counts")
    often = _most_frequent(counts)
    whole = None
    for last in (False, True):
        more = _lacking(lists if whole is None else lists.join(whole.select("set"), "set", "left_anti"), often, percent)
        more = stored(more.distinct(), "lacking")
        if more.isEmpty():
            break
        full = _lists(docs, rows, words, more)
        if not last:  # the order is settled before the last look at who lacks what
            often = np.union1d(often, _most_frequent(_frequent(full, percent, beyond=True)))
        whole = full if whole is None else whole.unionByName(full)
    met = counts.select("code")
    if whole is not None:
        lists = lists.join(whole.select("set"), "set", "left_anti").unionByName(whole)
        met = met.union(_prefix_codes(whole, often, percent))
    shown = stored(_prefixes(lists, often, _name_filter(met), percent).dropDuplicates(["set"]), "prefixes")

    heads = shown.groupBy("prefix").agg(F.min("set").alias("rep"))
    members = stored(join_spread(shown.select("prefix", "set"), stored(heads, "heads"), ["prefix"]).select("rep", "set"), "members")
    spots = shown.join(members.filter("rep = set").select("set"), "set", "left_semi").select(
        F.col("set").alias("rep"), F.col("n").cast("bigint").alias("n"), F.explode(F.arrays_zip("code", "place")).alias("at")
    ).select("rep", "n", "at.code", F.col("at.place").cast("bigint").alias("place"))
    spots = stored(spots, "spots")
    shared = spots.groupBy("code").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    shared = stored(shared.select("code", (F.col("m") > FEW).alias("crowded")), "shared")
    spots = stored(join_spread(spots, shared, ["code"]), "spots")

    # Members of one group with its first, groups with heads where many meet, and there with the nearest.
    inside = members.filter("rep <> set")
    links: list[DataFrame] = []
    marks = stored(_spread(rows, members), "marks")
    pairs = inside.select(F.col("rep").alias("u"), F.col("set").alias("v"))
    many = 0  # links found in a round
    for turn in range(ROUNDS):
        labelled, _, places = _labelled(members, spots.filter("crowded"), links)
        some = _rest(places, marks, percent, chunk, turn) if turn else _stars(places, percent)
        pairs = stored(_ordered(pairs.unionByName(_apart(some, labelled, whole_head=False))), "pairs")
        if pairs.isEmpty():
            break
        found = _linked(pairs, _lists(docs, rows, words, _ends(pairs)), percent)
        links.append(found)
        before, many = many, found.count()
        if 8 * many <= pairs.count() or 4 * many <= before:
            break
        pairs = pairs.limit(0)
    labelled, spans, places = _labelled(members, spots, links)
    pairs = _rest(places, marks, percent, chunk)
    # Members of one group that are still apart.
    torn = spans.filter("low < high").select("rep", F.col("rep").alias("head"))
    pairs = stored(_ordered(_apart(pairs.unionByName(torn), labelled, whole_head=True)), "candidates")
    if not pairs.isEmpty():
        links.append(_linked(pairs, _lists(docs, rows, words, _ends(pairs)), percent))
    return rows, _components(links, docs.sparkSession)


def _labelled(members: DataFrame, spots: DataFrame, links: list[DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Members with their components, the least and greatest component of each group, and these at its places."""
    groups = _components(links, members.sparkSession)
    labelled = members.join(groups, "set", "left").withColumn("component", F.coalesce("component", "set"))
    labelled = stored(labelled, "labelled")
    spans = labelled.groupBy("rep").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    return labelled, spans, stored(spots.select("rep", "n", "code", "place").join(spans, "rep"), "places")


def _apart(pairs: DataFrame, labelled: DataFrame, whole_head: bool) -> DataFrame:
    """(u, v): members of paired groups (rep, head) in different components; of the head, its first alone or all."""
    side = lambda a, b, c: labelled.select(F.col("rep").alias(a), F.col("set").alias(b), F.col("component").alias(c))
    to = side("head", "v", "other")
    to = to if whole_head else to.filter("head = v")
    both = pairs.join(side("rep", "u", "component"), "rep").join(to, "head")
    return both.filter(F.col("component") != F.col("other")).select("u", "v")


def _prefix_codes(lists: DataFrame, often: np.ndarray, percent: int) -> DataFrame:
    """(code): n-grams in the prefixes of sets that show all they have."""
    every = np.full(1, ~np.uint64(0))
    return _prefixes(lists, often, np.repeat(every, 64), percent).select(F.explode("code").alias("code")).distinct()


def _components(links: list[DataFrame], spark) -> DataFrame:
    """(set, component) of sets with a link."""
    if not links:
        return spark.createDataFrame([], "set bigint, component bigint")
    edges = links[0]
    for more in links[1:]:
        edges = edges.unionByName(more)
    return stored(connected_components(edges), "groups").select(F.col("node").alias("set"), "component")


def ngram_jaccard(
    docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT, chunk: int = CHUNK,
) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``.

    Rows link when 100 * intersection >= ``percent`` * union of their n-gram sets; component_id is the smallest id
    that links reach.  Texts without words (null, blank) have no set and only their own id.  Null ids are kept row by
    row and never name a component that holds an id.  Repeated rows are kept; other columns are not read.  Equal
    64-bit hashes count as equal n-grams and equal names as equal sets.  An empty table gives an empty table.
    """
    rows, groups = similar_sets(docs, id, text, words, percent, chunk)
    first = rows.filter("n > 0").groupBy("set").agg(F.min("id").alias("first"))
    first = first.join(groups, "set", "left").withColumn("component", F.coalesce("component", "set"))
    first = stored(first, "first")
    least = first.groupBy("component").agg(F.min("first").alias("component_id"))
    named = join_spread(first, stored(least, "least"), ["component"]).select("set", "component_id")
    out = join_spread(rows.select("id", "set", "n"), stored(named, "named"), ["set"], "left")
    own = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), own.alias("component_id"))


NGRAM_JACCARD_SQL = """
WITH RECURSIVE cut AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
grams AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM cut),
size AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
pair AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS s FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT u, v FROM pair JOIN size x ON x.doc_id = u JOIN size y ON y.doc_id = v WHERE 100 * s >= 85 * (x.n + y.n - s)),
both_ways AS (SELECT u, v FROM link UNION SELECT v, u FROM link),
reach(doc_id, seen) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, v FROM reach r JOIN both_ways ON seen = u)
SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(seen) AS component_id
FROM reach LEFT JOIN size USING (doc_id) GROUP BY doc_id
"""
