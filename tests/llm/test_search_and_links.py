"""Top-k search, SimHash, components and url rules against brute force and on odd rows."""

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from riskweft.llm import covertree, simhash, urls
from riskweft.llm.components import connected_components


def brute_top_k(rows, k=5):
    """rows: (id, vector); queries are ids divisible by 5."""
    known = sorted({(i, tuple(v)) for i, v in rows if i is not None and v is not None})
    out = []
    for q, v in known:
        if q % 5:
            continue
        dot = lambda a, b: sum(x * y for x, y in zip(a, b))
        best = sorted((-dot(v, w), i) for i, w in known if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("copies", [0, 120])
def test_top_k_equals_brute_force(spark, copies):
    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(-200, 200, 8).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[7][1]) for i in range(copies)]  # many equal vectors: ties by id
    rows += [rows[3], (2000, None), (None, rows[1][1]), (2005, [5, -7])]  # repeated, null, null id, short
    table = spark.createDataFrame(rows, "vec_id long, vector array<long>").withColumn("rank", F.lit("x"))
    found = covertree.top_k(table, table.filter("vec_id % 5 = 0"), sample=50, pivots=6, block_rows=60)
    assert sorted(map(tuple, found.collect())) == brute_top_k(rows)


@pytest.mark.parametrize("sample", [500, 20])
def test_top_k_of_repeated_rows(spark, sample):
    """Rows repeated in any number count once, in the first bounds too."""
    rng = np.random.default_rng(4)
    rows = [(i, rng.integers(-200, 200, 8).tolist()) for i in range(300)]
    near = {b[2] for b in brute_top_k(rows) if b[1] == 1}
    every = rows + [r for r in rows if r[0] in near for _ in range(6)]
    every += [(301, [v for v in rows[0][1]]), (301, [-v for v in rows[0][1]])]  # one id, two vectors
    table = spark.createDataFrame(every, "vec_id long, vector array<long>")
    found = covertree.top_k(table, table.filter("vec_id % 5 = 0"), sample=sample, pivots=6, block_rows=60)
    assert sorted(map(tuple, found.collect())) == brute_top_k(every)


def test_top_k_of_few_and_no_vectors(spark):
    schema = "vec_id long, vector array<long>"
    few = spark.createDataFrame([(0, [1, 2]), (1, [3, 4]), (2, [0, 0])], schema)
    got = sorted(map(tuple, covertree.top_k(few, few.filter("vec_id = 0")).collect()))
    assert got == [(0, 1, 1, 11), (0, 2, 2, 0)]
    none = few.filter("vec_id > 9")
    assert covertree.top_k(none, none).count() == 0
    assert covertree.top_k(none, few).count() == 0


def test_quantised_leaves_out_broken_vectors(spark):
    rows = [(1, [0.5, -0.001]), (2, [float("nan"), 1.0]), (3, [None, 1.0]), (4, None), (5, [float("inf")])]
    table = spark.createDataFrame(rows, "id long, v array<float>")
    got = {r["id"]: r["q"] for r in table.select("id", covertree.quantised(F.col("v")).alias("q")).collect()}
    assert got == {1: [128, -1], 2: None, 3: None, 4: None, 5: None}


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    width = min(3, len(words))
    shingles = [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, prints, distance=3):
    label = list(range(len(ids)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(root(i), []).append(ids[i])
    least = {r: min((x for x in g if x is not None), default=None) for r, g in groups.items()}
    return [least[root(i)] for i in range(len(ids))]


TEXTS = ["", None, " \t\n", "one", "One", "one two", "a b c", "A\tb\nc", "ß É x", "x" * 30_000, "w " * 20_000]


def near_copies():
    rng = np.random.default_rng(5)
    words = [f"word{i}" for i in range(400)]
    out = list(TEXTS)
    for _ in range(12):
        base = rng.choice(words, 150).tolist()
        for edits in (0, 0, 1, 2, 4):
            copy = list(base)
            for _ in range(edits):
                copy[rng.integers(len(copy))] = str(rng.choice(words))
            out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("longest_run", [20_000, 10])
def test_simhash_equals_brute_force(spark, longest_run):
    texts = near_copies()
    ids = [1000 - i for i in range(len(texts))]
    ids[5], ids[20] = None, ids[21]  # a null id, two rows of one id
    table = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").withColumn("fp", F.lit(1))
    got = simhash.near_duplicates(table, longest_run=longest_run).collect()
    prints = [plain_fingerprint(t) for t in texts]
    want = zip(ids, [f"{p:016x}" for p in prints], brute_components(ids, prints))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(((r[0], r[1], r[2]) for r in got), key=key) == sorted(want, key=key)
    assert len({r["component_id"] for r in got}) < len(texts) - 20


def test_linked_fingerprints_of_random_and_crowded_codes(spark):
    rng = np.random.default_rng(9)
    codes = {int(x) for x in rng.integers(0, 1 << 64, 500, dtype=np.uint64)}
    centre = int(rng.integers(0, 1 << 63))
    codes |= {centre ^ (1 << a) ^ (1 << b) ^ (1 << c) for a in range(0, 64, 5) for b in range(0, 64, 7) for c in (1, 33)}
    codes |= {x ^ 0b1011 for x in list(codes)[:40]} | {0, 1 << 63}
    codes = sorted(codes)
    signed = np.array(codes, np.uint64).view(np.int64).tolist()
    table = spark.createDataFrame([(c,) for c in signed], "fp long")
    want = {}
    for code, least in zip(signed, brute_components(signed, codes)):
        want.setdefault(least, set()).add(code)
    for longest in (20_000, 25):
        got = {}
        for r in simhash.link_fingerprints(table, longest_run=longest).collect():
            got.setdefault(r["component"], set()).add(r["node"])
        assert sorted(map(sorted, got.values())) == sorted(sorted(g) for g in want.values() if len(g) > 1)


def test_simhash_of_an_empty_table(spark):
    table = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(table).count() == 0


def test_components_of_a_chain_a_star_and_nothing(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, 101 + i) for i in range(50)] + [(7000, 150), (None, 3), (5, None), (9, 9)]
    edges = spark.createDataFrame(chain + star, "u long, v long")
    got = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in [*range(100, 151), 7000]}}
    assert connected_components(edges.filter("u < -1")).count() == 0


RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("bad.org", "", "block")]


def judged(spark, rows, **more):
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(0))
    return {r["page_id"]: tuple(r)[1:] for r in urls.judge_urls(pages, rules, **more).collect()}


def test_rules_parts_and_odd_urls(spark):
    got = judged(spark, [
        (1, "HTTP://Blog.Example.COM/en/1?x#y", ""), (2, "https://www.example.com/en/2", ""),
        (3, "https://a.net/es/", None), (4, "https://a.net/esp", ""), (5, None, ""), (6, "mailto:x", ""),
        (7, "http://example.com", ""), (8, "http://notexample.com/en/", ""), (9, "http://x.com?u=://y/z", ""),
    ])
    assert [got[i][:4] for i in range(1, 10)] == [
        ("blog.example.com", "/en/1", "example.com/en/", "block"), ("www.example.com", "/en/2", "www.example.com/en/", "allow"),
        ("a.net", "/es/", "net/es/", "block"), ("a.net", "/esp", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"),
        ("example.com", "", None, "allow"), ("notexample.com", "/en/", "com/", "allow"), ("x.com", "", None, "allow"),
    ]


def test_decisions_reach_aliases_and_allow_comes_first(spark):
    canonical = '<LINK href="{}" rel=canonical>'
    got = judged(spark, [
        (1, "http://mirror.org/a", canonical.format("http://bad.org/a")),
        (2, "http://other.org/b", '<meta http-equiv="refresh" content="0; url=http://mirror.org/a?utm_source=q">'),
        (3, "http://good.org/c", canonical.format("//x.net/es/1")),
        (4, "http://third.org/d", canonical.format("http://www.example.com/en/9")),
        (5, "http://third.org/d", canonical.format("http://bad.org/z")), (6, "http://alone.org/", ""),
    ])
    assert [got[i][3] for i in range(1, 7)] == ["block", "block", "block", "allow", "allow", "allow"]
    redirects = spark.createDataFrame([("http://alone.org/", "http://bad.org/"), (None, "x")], "source string, target string")
    got = judged(spark, [(6, "http://alone.org/", "")], redirects=redirects, html=None)
    assert got[6][3] == "block"


def test_no_pages(spark):
    assert judged(spark, []) == {}
