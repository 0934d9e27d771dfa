"""N-gram Jaccard join, conversation trie and hard negatives against brute force and on odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweft.llm import hardneg, ngramjoin, trie
from riskweft.llm.skew import join_spread


def grams(text, words=4):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    found = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not found:
        return frozenset()
    if len(found) < words:
        return frozenset([" ".join(found)])
    return frozenset(" ".join(found[i : i + words]) for i in range(len(found) - words + 1))


def brute_components(rows, percent=85):
    """(id, size, smallest id reachable) of each (id, text)."""
    sets = [grams(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * shared >= percent * (len(sets[i]) + len(sets[j]) - shared):
                parent[root(i)] = root(j)
    out = []
    for i, (id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        out.append((id, len(sets[i]), min(ids, default=None) if sets[i] else id))
    return sorted(out, key=str)


def joined(spark, rows, **parameters):
    table = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("set", "n", "component", "lang"):
        table = table.withColumn(name, F.lit("x"))
    return sorted(map(tuple, ngramjoin.ngram_jaccard(table, **parameters).collect()), key=str)


def edited_texts(seed, count=260):
    """Texts in families of edits, some with one long passage, some made of little else."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(900)]
    passage = [rng.choice(vocabulary) for _ in range(70)]
    texts = []
    while len(texts) < count:
        base = [rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 4, 9, 40, 120]))]
        kind = rng.random()
        if kind < 0.3:
            base = base[:20] + passage + base[20:]
        for _ in range(rng.choice([1, 2, 6])):
            words = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            if rng.random() < 0.2:
                words = words[rng.randrange(3) :] or words
            texts.append("  ".join(words) if rng.random() < 0.1 else " ".join(words))
    return texts


@pytest.mark.parametrize("often, chunk", [(64, 2_048), (3, 4)])
def test_ngram_join_equals_brute_force(spark, monkeypatch, often, chunk):
    monkeypatch.setattr(ngramjoin, "OFTEN", often)  # so that n-grams move to the end in a small table too
    rows = [(1000 - i, t) for i, t in enumerate(edited_texts(5))]
    rows += [(2000, rows[7][1]), (2000, rows[7][1]), (5, rows[9][1].upper()), (None, rows[9][1]), (None, "")]
    rows += [(3000, None), (3001, " \t\n"), (3002, "É a b c"), (3003, "é a b c"), (3004, "word " * 5000)]
    assert joined(spark, rows, chunk=chunk) == brute_components(rows)


def test_ngram_join_of_a_family_that_one_text_does_not_reach(spark):
    """A chain of edits: neighbours are linked, ends are far apart; and texts that share nine tenths but no link."""
    rng = random.Random(11)
    words = [f"v{rng.randrange(5000)}" for _ in range(200)]
    rows = []
    for step in range(60):
        words = list(words)
        words[3 * step + 5] = f"new{step}"
        rows.append((step, " ".join(words)))
    shared = [f"s{rng.randrange(5000)}" for _ in range(180)]
    rows += [(100 + k, " ".join(shared + [f"own{k}x{i}" for i in range(30)])) for k in range(40)]
    got = joined(spark, rows, chunk=8)
    assert got == brute_components(rows)
    assert len({c for i, _, c in got if i < 100}) == 1 and len({c for i, _, c in got if i >= 100}) == 40


def test_ngram_join_pairs_few_texts_that_share_much_but_are_not_linked(spark, monkeypatch):
    """Texts with three quarters in common meet at every n-gram; their marks tell that they are apart."""
    rng, made, rest = random.Random(4), [], ngramjoin._rest
    shared = [f"s{rng.randrange(5000)}" for _ in range(180)]
    rows = [(k, " ".join(shared + [f"own{k}x{i}" for i in range(30)])) for k in range(60)]
    rows += [(100, rows[7][1] + " more"), (None, rows[9][1] + " more"), (None, "a b c d e f")]

    def counted(*given):
        made.append(rest(*given).localCheckpoint())
        return made[-1]

    monkeypatch.setattr(ngramjoin, "_rest", counted)
    assert joined(spark, rows) == brute_components(rows)
    assert made[0].count() < 200


def test_ngram_join_pairs_few_texts_of_a_family_that_no_head_reaches(spark, monkeypatch):
    """Copies with two or three words changed: few are linked to any one of them, most are linked by steps."""
    rng, made, rest = random.Random(9), [], ngramjoin._rest
    base = [f"b{rng.randrange(9000)}" for _ in range(150)]
    rows = []
    for k in range(400):
        words = list(base)
        for place in rng.sample(range(100, 130), rng.choice([2, 3])):
            words[place] = f"new{rng.randrange(2)}"
        rows.append((k, " ".join(words)))

    def counted(*given):
        made.append(rest(*given).localCheckpoint())
        return made[-1]

    monkeypatch.setattr(ngramjoin, "_rest", counted)
    got = joined(spark, rows, chunk=64)
    assert got == brute_components(rows)
    assert max(Counter(c for _, _, c in got).values()) > 200
    assert sum(pairs.count() for pairs in made) < 6 * len(rows)  # paired in full: 10,478


def test_ngram_join_finds_lists_of_sets_with_and_without_ids(spark):
    rng = random.Random(6)
    texts = [" ".join(f"t{rng.randrange(9000)}" for _ in range(40)) for _ in range(300)]
    docs = spark.createDataFrame([*enumerate(texts), (None, "nameless but with words")], "id long, text string")
    rows = ngramjoin.stored(ngramjoin._windows(docs, 4, 85), "windows")
    blank = docs.withColumn("text", F.when(F.col("id").between(4, 290), F.lit(None)).otherwise(F.col("text")))
    for chosen in ("id < 3", "id = 3 OR id IS NULL"):
        wanted = rows.filter(chosen).select("set")
        got = ngramjoin._lists(docs, rows, 4, wanted).collect()
        assert {r["set"] for r in got} == {r["set"] for r in wanted.collect()}
        assert {r["set"]: r["list"] for r in got} == {r["set"]: r["list"] for r in ngramjoin._lists(blank, rows, 4, wanted).collect()}


def test_ngram_join_inside_groups(spark):
    """Families of three whose ends are linked only through the middle; some share size and prefix, so form a group."""
    rng, rows = random.Random(2), []
    for family in range(120):
        words = [f"f{family}w{rng.randrange(5000)}" for _ in range(82)]
        near, far = list(words), None
        near[80] = "x"
        far = list(near)
        far[30] = "y"
        rows += [(1000 - 3 * family - k, " ".join(w)) for k, w in enumerate((words, near, far))]
    got = joined(spark, rows)
    assert got == brute_components(rows)
    assert len({c for _, _, c in got}) == 120


def test_ngram_join_of_nothing(spark):
    assert joined(spark, []) == []
    assert joined(spark, [(4, None)]) == [(4, 0, 4)]


def brute_trie(rows, span=100, most=6):
    own = {}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for c, _, role, text in sorted((r for r in rows if r[0] is not None), key=key):
        own.setdefault(c, []).append((role or "", text or ""))
    full = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % most
        full[c] = tuple(own.get(c - (c % span), [])[:h] + own[c][h:])
    nodes = {}
    for c, turns in full.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(turns[:d], []).append(c)
    out = []
    for prefix, members in nodes.items():
        below = [p for p in nodes if p[: len(prefix)] == prefix]
        ends = sorted(c for c in members if len(full[c]) == len(prefix))
        out.append((
            min(members), len(prefix), min(nodes[prefix[:-1]]) if prefix else None, len(members),
            sum(len(p) == len(prefix) + 1 for p in below), sum(not any(q[:-1] == p for q in below if q) for p in below),
            sum((len(nodes[p]) - 1) * (len(p[-1][1]) if p else 0) for p in below),
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def grown_trie(spark, rows):
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for name in ("depth", "size", "place", "k1"):
        table = table.withColumn(name, F.lit("x"))
    return sorted(map(tuple, trie.prefix_trie(trie.with_openings(trie.ordered_turns(table))).collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_equals_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(trie, "PIECE", 3)
    rng = random.Random(seed)
    rows = []
    for c in [0, 1, 2, 3, 7, 100, 105, 106, 107, 108, 109, 230, 231, 232, 233, 234, 900]:
        for turn in range(rng.choice([1, 2, 3, 7, 9])):
            rows.append((c, rng.choice([turn, turn, None]), rng.choice(["user", "bot", None]), rng.choice(["a", "bé𝄞", None, ""])))
    rows += [(300 + c, t, "user", f"same {t}") for c in range(1, 20) for t in range(12)]  # many equal conversations
    rows += [(300 + c, 12, "user", "more") for c in (4, 9)] + [(None, 1, "user", "x"), rows[3], rows[3]]
    rows += [(400, t, "user", "base") for t in range(2)] + [(401, 0, "user", "gone")]
    assert grown_trie(spark, rows) == brute_trie(rows)


def test_trie_of_many_parting_depths(spark):
    """Each conversation leaves the others one turn later: a step for every depth."""
    rows = [(1 + c, t, "user", f"t{t}" if t <= c else f"x{c}.{t}") for c in range(14) for t in range(16)]
    assert grown_trie(spark, rows) == brute_trie(rows)


def test_trie_of_one_and_none(spark):
    assert grown_trie(spark, []) == []
    one = [(5, t, "user", "abc") for t in range(4)]
    assert grown_trie(spark, one) == brute_trie(one)
    assert grown_trie(spark, one)[0][2] == 5 or grown_trie(spark, one)[0][2] is None


def brute_negatives(rows, positives=5, negatives=3):
    known = {}
    for i, label, vector in rows:
        if i is not None and label is not None and vector is not None:
            known[i] = min(known.get(i, (label, vector)), (label, vector))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a, (label, vector) in known.items():
        if a % 10:
            continue
        scored = sorted((-dot(vector, v), i, other) for i, (other, v) in known.items() if i != a)
        for minus, p, _ in [s for s in scored if s[2] == label][:positives]:
            fits = [s for s in scored if s[2] != label and 50 * -minus <= 100 * -s[0] <= 95 * -minus]
            out += [(a, p, r + 1, i, -minus, -s) for r, (s, i, _) in enumerate(fits[:negatives])]
    return sorted(out)


@pytest.mark.parametrize("sample, block_rows", [(2_048, 8_192), (40, 60), (3, 50)])
def test_hard_negatives_equal_brute_force(spark, sample, block_rows):
    rng = np.random.default_rng(8)
    middle = rng.normal(0, 60, (6, 20))
    rows = []
    for i in range(500):
        label = int(rng.integers(6)) if i % 3 else 2  # one label holds more than a third
        near = middle[label if rng.random() < 0.7 else rng.integers(6)]
        rows.append((i, label, np.floor(near + rng.normal(0, 30, 20)).astype(int).tolist()))
    rows += [(600, 2, rows[0][2]), (601, 1, rows[0][2]), (602, 1, rows[0][2])]  # ties
    rows += [(610, 1, None), (None, 1, rows[1][2]), (620, None, rows[1][2]), (630, 3, [4, 5]), (640, 9, [0] * 20), (650, 4, [])]
    rows += [rows[10]] * 3 + [(20, 0, rows[30][2]), (20, 5, rows[31][2])]
    table = spark.createDataFrame(rows, "id long, label long, vector array<long>").withColumn("w", F.lit("x"))
    found = hardneg.hard_negatives(table, table.filter("id % 10 = 0").select("id"), sample=sample, block_rows=block_rows)
    assert sorted(map(tuple, found.collect())) == brute_negatives(rows)


def test_hard_negatives_of_nothing(spark):
    none = spark.createDataFrame([], "id long, label long, vector array<long>")
    assert hardneg.hard_negatives(none, none.select("id")).count() == 0
    one = spark.createDataFrame([(10, 1, [1, 2])], "id long, label long, vector array<long>")
    assert hardneg.hard_negatives(one, one.select("id")).count() == 0


def test_index_drops_rows_that_cannot_reach(spark):
    rng = np.random.default_rng(1)
    rows = np.sort(np.abs(rng.normal(0, 40, (300, 32))), axis=1)[:, ::-1] * np.linspace(3, 0.1, 32)
    rows = np.floor(rows) * rng.choice([-1, 1], (300, 1))
    index = hardneg.Index(np.arange(300), np.zeros(300, np.int64), rows)
    scores = rows[:4] @ rows.T
    least = np.sort(scores, axis=1)[:, -10]
    kept = index.candidates(rows[:4], least)
    assert set(np.flatnonzero((scores >= least[:, None]).any(axis=0))) <= set(kept.tolist())
    assert len(kept) < 150


@pytest.mark.parametrize("how", ["inner", "left"])
def test_join_spread_equals_join(spark, monkeypatch, how):
    from riskweft.llm import skew

    monkeypatch.setattr(skew, "LEAST", 5)
    left = spark.range(300).select("id", F.when(F.col("id") % 3 == 0, 1).when(F.col("id") % 7 == 0, None).otherwise(F.col("id")).alias("k"))
    right = spark.createDataFrame([(1, "hot"), (2, "b"), (100, "c"), (999, "d")], "k long, v string")
    plain = left.join(right, "k", how)
    assert sorted(map(str, join_spread(left, right, ["k"], how).collect())) == sorted(map(str, plain.collect()))
