"""The corpus pipeline on planted rows and on empty tables, and the queries' columns."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from riskweft.llm import neardup, simhash
from riskweft.llm.queries import ORACLES, QUERIES

SCHEMAS = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "labels": "doc_id long, quality int, toxic int",
    "benchmark": "item_id long, text string",
}


def words(seed, n, parts="the of and thing ration land other weight moth sand".split()):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices(parts, k=2)) + rng.choice(["", ",", "."]) for _ in range(n))


def write(spark, folder, tables):
    for name, schema in SCHEMAS.items():
        spark.createDataFrame(tables.get(name, []), schema).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    docs, labels = [], []
    for i in range(120):
        text = words(i, 60)
        if i % 4 == 0:
            text = text.replace(" ", " vile ", 3)
        labels.append((i, 1, int(i % 4 == 0)))
        docs.append((i, text, "en", "s", len(text)))
    item = words(777, 25)
    docs += [
        (200, docs[1][1], "en", "s", 0), (201, docs[1][1].upper(), "en", "s", 0), (1, docs[1][1], "en", "s", 0),
        (202, "12 34 !!", "en", "s", 0), (203, None, None, None, None), (204, "", "en", "s", 0),
        (205, words(5000, 30) + " " + item + " " + words(5001, 30), "en", "s", 0),
        (None, words(6000, 50), "en", "s", 0), (None, words(6001, 50), "en", "s", 0),
        (206, words(7000, 40) + " vile " + words(7001, 10) + " vile", "en", "s", 0),
    ]
    folder = tmp_path_factory.mktemp("planted")
    return write(spark, folder, {"documents": docs, "labels": labels, "benchmark": [(1, item), (2, None)]})


def test_stages_keep_clean_rows_and_columns(spark, planted):
    docs = spark.read.parquet(f"{planted}/documents.parquet")
    ids = lambda df: sorted(r["doc_id"] for r in df.collect() if r["doc_id"] is not None)
    gone = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, planted).cache()
        assert after.columns == docs.columns
        before, left = ids(docs), ids(after)
        gone[name] = sorted(set(before) - set(left))
        if name == "simhash_near_dedup":
            assert left.count(1) == 1 and before.count(1) == 2
        docs = after
    assert gone["language_id"] == [202, 203, 204]
    assert gone["toxicity"] == [*range(0, 120, 4), 206]
    assert gone["simhash_near_dedup"] == [200, 201]
    assert gone["benchmark_decontamination"] == [205]
    assert docs.filter("doc_id IS NULL").count() == 2
    last = corpus_pipeline.STAGES[-1][1](spark, docs, planted)
    assert last.count() == docs.count() and last.filter("n_tokens <> size(ids)").count() == 0


def test_stages_give_clashing_columns_back(spark, planted):
    docs = spark.read.parquet(f"{planted}/documents.parquet")
    names = "shingle_set toxicity lang_pred Lang_Score benchmark_items ratios component __id c0 hi given_1 carried_1".split()
    clash = docs.withColumns({n: F.lit(9.5 + i) for i, n in enumerate(names)})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, clash, planted)
        assert after.columns == clash.columns, name
        rows = after.select(*names).distinct().collect()
        assert [tuple(r) for r in rows] == [tuple(9.5 + i for i in range(len(names)))], name
    plain = corpus_pipeline.STAGES[-1][1](spark, clash, planted)
    assert plain.count() == clash.count()


def test_run_gives_the_same_rows(spark, planted):
    out = corpus_pipeline.run(spark, planted)
    assert out.count() == 120 - 30 + 2 and out.filter("n_tokens > 0").count() == out.count()


def brute_groups(texts):
    """The least place reachable over pairs with a Jaccard similarity of 0.8 of their five-word shingles."""
    cut = [t.lower().split() for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in cut]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if label[i] != label[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    return label


def test_near_dedup_drops_texts_with_a_few_edited_words(spark, tmp_path):
    rng, texts = random.Random(8), []
    for i in range(25):
        base = words(900 + i, rng.choice([4, 60, 120, 300])).split()
        texts.append(" ".join(base))
        for edits in (1, 1, 2, 4, 8):
            copy = list(base)
            for at in rng.sample(range(len(copy)), min(edits, len(copy))):
                copy[at] = f"edit{rng.random()}"
            texts.append(" ".join(copy))
        for _ in range(6):  # a chain: each text is near the last one
            copy[rng.randrange(len(copy))] = f"edit{rng.random()}"
            texts.append(" ".join(copy))
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMAS["documents"])
    kept = corpus_pipeline.remove_near_duplicates(spark, docs, str(tmp_path)).collect()
    want = brute_groups(texts)
    for chunk in (400_000, 200):
        rows = neardup.near_duplicates(docs, chunk=chunk).collect()
        groups = {c: min(r["doc_id"] for r in rows if r["component"] == c) for c in {r["component"] for r in rows}}
        assert [groups[r["component"]] for r in sorted(rows, key=lambda r: r["doc_id"])] == want
    assert sorted(r["doc_id"] for r in kept) == sorted(set(want)) and len(kept) < len(texts) / 2


def test_near_dedup_finds_candidates_by_simhash(spark):
    texts = []
    for i in range(4):
        base = words(300 + i, 6000).split()
        texts.append(" ".join(base))
        for at in (700, 3100):
            base[at] = f"edit{at}"
            texts.append(" ".join(base))
    # One phrase sets the fingerprint, different tails the sets: within 3 bits, but not similar.
    texts += ["again and so on then " * 3000 + words(800 + i, 200) for i in range(3)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMAS["documents"])
    rows = neardup.near_duplicates(docs, bands=0).collect()
    groups = {c: min(r["doc_id"] for r in rows if r["component"] == c) for c in {r["component"] for r in rows}}
    got = [groups[r["component"]] for r in sorted(rows, key=lambda r: r["doc_id"])]
    assert got == brute_groups(texts) == [*[i // 3 * 3 for i in range(12)], 12, 13, 14]
    prints = [r["fingerprint"] for r in simhash.near_duplicates(docs).filter("doc_id > 11").collect()]
    assert all((int(a, 16) ^ int(b, 16)).bit_count() <= 3 for a in prints for b in prints)


def test_pipeline_on_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, write(spark, tmp_path, {})).count() == 0


def test_names_and_columns():
    numbers = [int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op")]
    assert sorted(numbers) == list(range(1, 14)) and "pipeline" in QUERIES and set(ORACLES) <= set(QUERIES)
    assert corpus_pipeline.ORACLE_SQL is None and 4 <= len(corpus_pipeline.STAGES) <= 5
