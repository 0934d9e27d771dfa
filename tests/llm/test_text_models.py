"""Language, quality, toxicity and language-model scores; tokens, decontamination and page text."""

import hashlib
import itertools
import math
import collections
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from riskweft.llm import bpe, decontaminate, htmltext, langid, lmscore, quality, toxicity
from riskweft.llm.logistic import fit_logistic, fit_logistic_rows
from riskweft.llm.queries import QUERIES, vocabulary_path
from riskweft.llm.wordarrays import LETTERS_AND_DIGITS, NOT_BLANK, split_words, text_bytes

ODD = [None, "", " \n\t ", "a", "…", "😀 😀", "x" * 70_000, "1 2 3", "\n\n\nline\n\n", "dup", "dup"]
SYLLABLES = {"aa": "ba be bi bo", "bb": "ku ko ka ke", "cc": "zu zo za ze"}


def made(lang, n, seed):
    rng = random.Random(f"{lang}{seed}")
    parts = SYLLABLES[lang].split()
    return " ".join("".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(n))


def table(spark, texts, **columns):
    """Texts under odd column names of the operators' own."""
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name, value in columns.items():
        df = df.withColumn(name, F.lit(value))
    return df


def test_words_equal_a_regular_expression():
    texts = ["One two-three", "", "  a\x0bB\x1fc ", "ÄÖ ü9", "x" * 3_000_000 + " y", None, "z"]
    for kind, pattern in ((LETTERS_AND_DIGITS, rb"[0-9A-Za-z\x80-\xff]+"), (NOT_BLANK, rb"[^\x20\x09-\x0d]+")):
        raw, bounds = text_bytes(pa.array(texts, pa.string()))
        words = split_words(raw, bounds, kind)
        flat, got = bytes(raw), []
        for a, b in itertools.pairwise(words.first):
            got.append([flat[s:e] for s, e in zip(words.start[a:b], words.end[a:b])])
        want = [re.findall(pattern, (t or "").lower().encode()) for t in texts]
        assert got == want
        names = [w for text in want for w in text]
        assert len(set(words.hash.tolist())) == len(set(names))


def test_language_filters(spark):
    learn = [(made(k, 40, i), k) for k in SYLLABLES for i in range(30)] + [(None, "aa"), ("ba", None), ("", "bb")]
    filters = langid.fit_filters(spark.createDataFrame(learn, "text string, lang string"))
    assert filters.languages == ["aa", "bb", "cc"]
    texts = [made(k, 15, 99) for k in SYLLABLES] + ODD
    rows = langid.identify(table(spark, texts, lang_pred=5, lang_input="x"), filters).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in rows[:3]] == list(SYLLABLES)
    assert all(0 <= r["lang_score"] <= 1 for r in rows) and rows[0]["lang_score"] > 0.8
    blank = [r for r, t in zip(rows, texts) if not any(c.isalpha() for c in t or "")]
    assert {(r["lang_pred"], r["lang_score"]) for r in blank} == {("und", 0.0)} and len(blank) == 6
    assert "lang_input" in rows[0].asDict() and len(rows) == len(texts)


def test_language_filter_masks_name_every_language():
    cells = np.zeros((1 << 12, 1), np.uint8)
    grams = np.arange(1, 50, dtype=np.uint64)
    for h in langid._places(grams, len(cells)):
        cells[h] |= 0b101
    known = langid.LanguageFilters(["x", "y", "z"], cells, np.zeros(3))
    assert (known.masks(grams)[:, 0] == 0b101).all()


def test_language_without_learning(spark):
    nothing = langid.fit_filters(spark.createDataFrame([], "text string, lang string"))
    assert {r["lang_pred"] for r in langid.identify(table(spark, ["abc", None]), nothing).collect()} == {"und"}
    assert langid.identify(table(spark, []), nothing).count() == 0


def slow_forward_backward(leaning, moves, start):
    """P(bad) by summing over all state sequences."""
    n = len(leaning)
    weight = np.zeros((n, 2))
    for states in itertools.product((0, 1), repeat=n):
        w = start[states[0]] + sum(leaning[i] for i in range(n) if states[i])
        w += sum(moves[a][b] for a, b in itertools.pairwise(states))
        for i, s in enumerate(states):
            weight[i, s] += math.exp(w)
    return weight[:, 1] / weight.sum(axis=1)


def test_forward_backward_equals_all_paths():
    rng = np.random.default_rng(1)
    sizes = [1, 0, 5, 3, 7]
    first = np.concatenate(([0], np.cumsum(sizes)))
    leaning, moves, start = rng.normal(size=first[-1]), rng.normal(size=(2, 2)), rng.normal(size=2)
    bad, pairs, _ = quality.forward_backward(leaning, first, moves, start)
    want = [slow_forward_backward(leaning[a:b], moves, start) for a, b in itertools.pairwise(first) if b > a]
    assert np.allclose(bad, np.concatenate(want))
    assert np.isclose(pairs.sum(), sum(max(0, s - 1) for s in sizes))


def test_quality_separates_held_out_texts(spark):
    def text(good, seed):
        rng = random.Random(seed)
        lines = [made("aa", 12, seed * 10 + i).capitalize() + "." for i in range(4)]
        if not good:
            lines[rng.randrange(4)] = "### " * 12
        return "\n".join(lines)

    learn = [(text(i % 3 > 0, i), int(i % 3 > 0)) for i in range(150)]
    field = quality.fit_quality(spark.createDataFrame(learn, "text string, label int"))
    texts = [text(i % 2 > 0, 1000 + i) for i in range(40)]
    rows = quality.score_quality(table(spark, texts + ODD, quality_score="s"), field).orderBy("doc_id").collect()
    assert all((r["quality_score"] >= 0.3) == bool(i % 2) for i, r in enumerate(rows[:40]))
    assert all(0 <= r["quality_score"] <= 1 for r in rows) and len(rows) == 40 + len(ODD)


def test_quality_with_one_class_or_no_rows(spark):
    schema = "text string, label int"
    for learn in ([], [("a.", 1), (None, 1)]):
        field = quality.fit_quality(spark.createDataFrame(learn, schema))
        assert quality.score_quality(table(spark, ODD), field).count() == len(ODD)
    assert quality.score_quality(table(spark, []), field).count() == 0


def test_toxicity_separates_held_out_texts(spark):
    def text(toxic, seed):
        words = made("aa", 60, seed).split()
        if toxic:
            words[seed % 50] = words[seed % 47] = "vile" if seed % 2 else "foul"
        return " ".join(words)

    learn = [(text(i % 3 == 0, i), int(i % 3 == 0)) for i in range(240)]
    model = toxicity.fit_toxicity(spark.createDataFrame(learn, "text string, label int"))
    texts = [text(i % 2 == 0, 5000 + i) for i in range(60)]
    rows = toxicity.score_toxicity(table(spark, texts + ODD, toxicity="s"), model).orderBy("doc_id").collect()
    assert all((r["toxicity"] >= 0.7) == (i % 2 == 0) for i, r in enumerate(rows[:60]))
    assert all(r["toxicity"] < 0.7 for r in rows[60:])


def brute_ratio(learn, word):
    """Log-likelihood ratio of a word by plain Kneser-Ney over dictionaries; learn: (words of a text, label)."""

    def grams(w):
        marks = ["<", *w, ">"]
        return [(tuple(marks[max(0, i - 5) : i]), marks[i]) for i in range(1, len(marks))]

    def level(counts):
        n = [sum(v == k for v in counts.values()) for k in (1, 2, 3, 4)]
        share = n[0] / max(1, n[0] + 2 * n[1])
        off = [k - (k + 1) * share * n[k] / max(1, n[k - 1]) for k in (1, 2, 3)]
        off = [min(max(o, lo), hi) for o, lo, hi in zip(off, (0.1, 0.2, 0.3), (0.95, 1.9, 2.85))]

        def chance(context, char, shorter):
            here = {g: v for g, v in counts.items() if g[0] == context}
            if not here:
                return shorter
            left = sum(off[min(v, 3) - 1] for v in here.values())
            v = counts.get((context, char), 0)
            return ((v - off[min(v, 3) - 1] if v else 0) + left * shorter) / sum(here.values())

        return chance

    every = collections.Counter()
    classes = []
    for label in (1, 0):
        counts = collections.Counter(g for words, y in learn if y == label for w in set(words) for g in grams(w))
        classes.append(level(counts))
        every.update(counts)
    distinct, shared = set(every), {}
    for order in range(5, 0, -1):
        follow = collections.Counter((c[-(order - 1):] if order > 1 else (), x) for c, x in distinct)
        distinct = set(follow)
        shared[order] = level(follow)
    symbols = 1 + len({x for _, x in every})
    total = 0.0
    for context, char in grams(word):
        p = 1 / symbols
        for order in range(1, 6):
            p = shared[order](context[-(order - 1):] if order > 1 else (), char, p)
        a, b = (c(context, char, p) for c in classes)
        total += np.log(max(a, 1e-12)) - np.log(max(b, 1e-12))
    return total


def test_toxicity_equals_plain_kneser_ney(spark):
    rng = random.Random(5)
    syllables = "an be cé do ru ti ma vo".split()
    learn = []
    for i in range(60):
        words = ["".join(rng.choices(syllables, k=rng.randrange(1, 5))) for _ in range(12)]
        learn.append((words + ["vilo" + rng.choice(syllables)] * (i % 3 == 0), int(i % 3 == 0)))
    rows = [(" ".join(w), y) for w, y in learn]
    model = toxicity.fit_toxicity(spark.createDataFrame(rows, "text string, label int")).models()
    asked = ["anbecé", "vilo", "viloan", "ru", "zzz", "q", "domavo", "Vilor", "tivilo"]
    got = model.ratios(toxicity._grams(pa.array([" ".join(asked)])))
    assert np.allclose(got, [brute_ratio(learn, w.lower()) for w in asked], atol=1e-9)
    known = toxicity._Ratios(model)
    for _ in range(2):
        assert np.allclose(known.of(toxicity._grams(pa.array([" ".join(asked * 3), None, ""]))), np.tile(got, 3))


def test_toxicity_looks_up_a_learnt_ngram_once(spark, monkeypatch):
    learn = [(made("aa", 30, i), int(i % 2 == 0)) for i in range(40)]
    fitted = toxicity.fit_toxicity(spark.createDataFrame(learn, "text string, label int"))
    model, asked, find = fitted.models(), [], toxicity.HashTable.find
    monkeypatch.setattr(toxicity.HashTable, "find", lambda self, hashes: asked.append(len(hashes)) or find(self, hashes))
    words = sorted({w for text, _ in learn for w in text.lower().split() if w.isalnum()})
    assert len(model.ratios(toxicity._grams(pa.array([" ".join(words)])))) == len(words)
    assert sum(asked) == sum(len(w) + 1 for w in words)
    assert fitted.ratios(1) is fitted.ratios(1)  # a worker's next task makes no model of its own


@pytest.mark.parametrize("texts", [60, 600])
def test_toxic_stem_counts_alike_in_small_and_large_samples(spark, texts):
    """Five texts with different words of one stem are enough, however many others there are."""
    learn = [(made("aa", 30, i), int(i % 2 == 0)) for i in range(2 * texts)]
    learn = [(t + (f" zorgh{'aeiou'[i // 2]}l" if y and i < 10 else " vile" if y else ""), y) for i, (t, y) in enumerate(learn)]
    model = toxicity.fit_toxicity(spark.createDataFrame(learn, "text string, label int"))
    ask = [made("aa", 30, 9000 + i) + (" zorghyl" if i % 2 else "") for i in range(20)]
    rows = toxicity.score_toxicity(table(spark, ask), model).orderBy("doc_id").collect()
    scores = [r["toxicity"] for r in rows]
    assert min(scores[1::2]) > max(scores[0::2])


def test_toxicity_learns_from_every_labelled_text(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE", 6, raising=False)
    monkeypatch.setattr(toxicity, "TEXTS_A_TASK", 10, raising=False)
    stems = [f"{a}{b}orgh" for a in "zxqw" for b in "jkv"]
    docs, labels = [], []
    for i in range(300):
        toxic = i % 2 == 0
        docs.append((i, made("aa", 30, i) + (f" {stems[i // 2 % 12]}" if toxic else "")))
        labels.append((i, 1, int(toxic)))
    docs += [(1000 + i, made("aa", 30, 9000 + i) + (f" {stems[i % 12]}" if i < 12 else "")) for i in range(30)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = QUERIES["op9_toxicity"](spark, str(tmp_path)).filter("doc_id >= 1000").orderBy("doc_id").collect()
    assert [r["predicted"] for r in rows] == [1] * 12 + [0] * 18


def test_logistic_fit_by_sums_equals_the_fit_of_rows(spark):
    rng = np.random.default_rng(3)
    y = np.repeat([1, 0], [12, 36])
    x = rng.normal(size=(48, 2)) + 0.7 * y[:, None]
    every = np.concatenate([np.repeat(np.arange(12), 3), np.arange(12, 48)])
    want = fit_logistic(x[every], y[every].astype(float))
    rows = spark.createDataFrame([(a.tolist(), int(b)) for a, b in zip(x, y)], "x array<double>, y int")
    assert np.allclose(fit_logistic_rows(rows, "x", "y", 2), want, atol=1e-6)
    for some in ("y = 1", "y = 0", "y = 2"):
        n = rows.filter(some).count()
        want = fit_logistic(np.zeros((n, 2)), np.full(n, float(some[-1])))
        assert np.allclose(fit_logistic_rows(rows.filter(some), "x", "y", 2), want)


def test_toxicity_with_one_class_or_no_rows(spark):
    for learn in ([], [("a b", 0), (None, 0)]):
        model = toxicity.fit_toxicity(spark.createDataFrame(learn, "text string, label int"))
        assert {0 <= r["toxicity"] <= 1 for r in toxicity.score_toxicity(table(spark, ODD), model).collect()} == {True}


def test_labelled_sample_is_bounded_and_takes_the_largest_label(spark):
    docs = table(spark, ["t"] * 50)
    labels = spark.createDataFrame([(i % 50, int(i % 10 == 0)) for i in range(100)] + [(3, 1), (4, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity.labelled_sample(docs, labels, "toxic", 4).groupBy("label").count().collect()
    assert {r["label"]: r["count"] for r in got} == {0: 4, 1: 4}
    assert toxicity.labelled_sample(docs, labels, "toxic", 100).filter("label = 1").count() == 6


def test_labelled_sample_takes_one_row_of_an_id(spark):
    rows = [(i, f"t{i}") for i in range(20)] + [(3, f"more{k}") for k in range(200)] + [(4, None), (5, "t5")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, toxic int")
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string").repartition(5)
        got = sorted(map(tuple, toxicity.labelled_sample(docs, labels, "toxic", 20).collect()), key=str)
        assert len(got) == 20 and sum(label for _, label in got) == 10 and ("t4", 0) in got
        assert order is rows or got == last
        last = got


def brute_scores(texts):
    words = [re.findall(r"[a-z0-9\x80-\U0010ffff]+", (t or "").lower()) for t in texts]
    grams = [Counter(tuple(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)) for w in words]
    every, total = sum(grams, Counter()), sum(map(len, words))
    out = []
    for w, own in zip(words, grams):
        left = lambda *g: every[g] - own[g]  # noqa: B023, E731
        rest, s = max(1, total - len(w)), 0.0
        for i, x in enumerate(w):
            if i > 1 and left(*w[i - 2 : i + 1]):
                s += math.log(left(*w[i - 2 : i + 1]) / left(*w[i - 2 : i]))
            elif i and left(*w[i - 1 : i + 1]):
                s += math.log(0.4 * left(*w[i - 1 : i + 1]) / left(w[i - 1]))
            elif left(x):
                s += math.log(0.16 * left(x) / rest)
            else:
                s += math.log(0.064 / rest)
        out.append(s / len(w) if w and len(w) < total else 0.0)
    return out


@pytest.mark.parametrize("size", [8 << 20, 2_000])
def test_lm_scores_equal_brute_force(spark, size):
    texts = [made("aa", 50, i % 20) for i in range(40)] + ODD + ["ba be", "ba be bi"]
    rows = lmscore.lm_scores(table(spark, texts, block=1, n="x"), block_bytes=size, bucket_bytes=size).orderBy("doc_id").collect()
    assert np.allclose([r["lm_score"] for r in rows], brute_scores(texts))
    assert lmscore.lm_scores(table(spark, [])).count() == 0
    assert [r["lm_score"] for r in lmscore.lm_scores(table(spark, ["a b a", None])).collect()] == [0.0, 0.0]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(vocabulary_path())


def test_tokens_equal_the_library(spark, tokenizer):
    rng = random.Random(2)
    texts = ["Hello  World's <|endoftext|>x é́ ÀÉİ 123 !!??", "a\x1cb\x85c　d", "ΣΑΣ ς don't I'LL 're", "ab" * 4000, "<|startoftext|><|endoftext|>", "日本 😀😀"]
    texts += ["".join(rng.choice("abcdeé ü'!1.\n") for _ in range(120)) for _ in range(150)]
    texts += [t for t in ODD if t]
    docs = table(spark, texts + [None, ""], bpe_ids=1, bpe_input="x")
    rows = bpe.encode(docs, vocabulary_path()).orderBy("doc_id").collect()
    for text, row in zip(texts + ["", ""], rows):
        want = tokenizer.encode(text, add_special_tokens=False).ids
        assert row["bpe_ids"] == want and row["bpe_n_tokens"] == len(want)
        line = tokenizer.decode(want, skip_special_tokens=False)
        assert row["bpe_decoded"] == line and row["bpe_decoded_sha256"] == hashlib.sha256(line.encode()).hexdigest()
        assert row["bpe_ids_sha256"] == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()


def test_merging_together_and_alone_agree(tokenizer):
    vocabulary = bpe.Vocabulary(open(vocabulary_path(), encoding="utf-8").read())
    rng = random.Random(4)
    for length in (1, 2, 3, 5, 9, 33, 64):
        words = ["".join(rng.choice("abcdeinrst") for _ in range(length)) for _ in range(50)]
        tokens, bounds = bpe.encode_words(words, vocabulary)
        for word, a, b in zip(words, bounds, bounds[1:]):
            symbols = vocabulary.inner[list(word.encode())]
            symbols[-1] = vocabulary.last[ord(word[-1])]
            assert bpe.merge_alone(symbols, vocabulary).tolist() == tokens[a:b].tolist()
            assert bpe.decode(tokens[a:b].tolist(), vocabulary).replace(" ", "") == word + "</w>"


def slow_distance(item, words):
    """Semi-global edit distance by the plain recurrence."""
    row = [0] * (len(words) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(words, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def benchmark_case(seed=6):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [" ".join(rng.choices(vocabulary, k=k)) for k in (1, 3, 6, 9, 14, 20, 30, 45) for _ in range(4)]
    docs = []
    for _ in range(250):
        body = rng.choices([f"x{i}" for i in range(200)] + vocabulary[:20], k=rng.randint(0, 60))
        item = rng.choice(items).split()
        for _ in range(rng.randint(0, max(1, len(item) // 4))):
            at = rng.randrange(len(item))
            item[at : at + rng.randint(0, 1)] = rng.choices(vocabulary, k=rng.randint(0, 1))
            item = item or ["w0"]
        at = rng.randint(0, len(body))
        docs.append(", ".join(body[:at] + [w.upper() for w in item] + body[at:]))
    return items, docs + [t for t in ODD if t != "x" * 70_000]


@pytest.mark.parametrize("block_words", [1_000_000, 100])
def test_contamination_against_brute_force(spark, block_words):
    items, docs = benchmark_case()
    cut = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower())
    want = {}
    for d, text in enumerate(docs):
        for i, item in enumerate(items):
            edits = slow_distance(cut(item), cut(text))
            if edits <= 0.2 * len(cut(item)):
                want[d, i] = edits
    bench = spark.createDataFrame([*enumerate(items), (900, None), (901, ""), (902, "…!")], "item_id long, text string")
    bench = bench.filter("text IS NULL OR text <> '…!'").withColumn("block", F.lit("q"))
    rows = decontaminate.benchmark_matches(table(spark, docs, block=3), bench, block_words=block_words).collect()
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in rows}
    assert set(got) <= set(want) and len(got) >= 0.98 * len(want)
    assert all(got[k] >= want[k] for k in got) and sum(got[k] == want[k] for k in got) >= 0.98 * len(got)
    exact = {k for k, e in want.items() if e == 0 and len(cut(items[k[1]])) >= 14}
    assert exact and exact <= set(got)
    flagged = decontaminate.flag_contaminated(table(spark, docs, benchmark_items=1), bench, block_words=block_words).collect()
    assert {(r["doc_id"], i) for r in flagged for i in r["benchmark_items"]} == set(got) and len(flagged) == len(docs)


def test_contamination_of_empty_tables(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.benchmark_matches(table(spark, ODD), bench).count() == 0
    assert decontaminate.flag_contaminated(table(spark, ODD), bench).filter("size(benchmark_items) = 0").count() == len(ODD)
    some = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert decontaminate.benchmark_matches(table(spark, []), some).count() == 0


PAGES = [
    ("<p>a<p>b<br>c", "a\n\nb\nc"),
    ("<ul><li>x<li>y<ol start=3><li>q<li>r</ol></ul>", "- x\n- y\n\n  3. q\n  4. r"),
    ("<table><tr><td>1<td>long<tr><th>22<td hidden>no<td>w</table>after", "1   long\n22        w\n\nafter"),
    ("<div style='color:red; display: none'>z</div>q<span hidden>h</span><script>var a='</p>';</script>", "q"),
    ("<pre> x\n  y</pre>", " x\n  y"),
    ("a &amp; b &copy; &nosuch; <b>bold</b>  <i> it</i>", "a & b © &nosuch; bold it"),
    ("<!-- c --><p title='a>b'>t</p", "t"),
    ("1 < 2 <3", "1 < 2 <3"),
    ("<title>no</title><h1>H</h1>x<hr>y<img alt=pic>", "H\n\nx\n\nypic"),
    ("<table><caption>cap</caption><tr><td colspan=2>wide one<tr><td>a<td>b</table>", "cap\nwide one\na  b"),
    ("<i aria-hidden=true>icon</i> label <span aria-hidden='true' hidden>no</span>", "icon label"),
    ("<dialog>no</dialog><dialog open>shown<p>in</dialog>", "shown\n\nin"),
    ("<math><mi>a</mi><mo>+</mo><mi>b</mi><annotation>tex</annotation></math> is", "a+b is"),
    ("x<svg><title>t</title><desc>d</desc>no<defs><text>no</text></defs><g><text x=1>one <tspan>two</tspan></text>"
     "<text>three</text><text display=none>no</text></g><path d=a /></svg>y", "x\none two\nthree\ny"),
    ("<svg><foreignObject><p>html</p></foreignObject></svg><svg><path d=z><p>after", "html\n\nafter"),
    ("Pick <select><optgroup label=G><option>A<option selected>B</optgroup><option label=C>c</select>", "Pick\nG\nA\nB\nC"),
    ("<html><head><title>T</title><p>Hello", "Hello"), ("<head><meta charset=x>\n <script>a</script> text <b>b</b>", "text b"),
    ("<head><link rel=a><style>x</style><template>t</template><div>d</div></head><p>e", "d\n\ne"),
    ("<head><title>T</title>\n<body>x<head>y</head>z", "xyz"), ("<p>a<head>b", "ab"), ("<head> <title>T</title> </head>", ""),
    ("", ""), (None, ""), ("<<<>>>", "<<<>>>"), ("<div>" * 5000 + "deep", "deep"), ("<ul><li>" * 200 + "in", None),
]


def test_page_text(spark):
    rows = [(i, h, "own") for i, (h, _) in enumerate(PAGES)]
    pages = spark.createDataFrame(rows, "page_id long, html string, page_text string")
    got = htmltext.render_pages(pages).orderBy("page_id").collect()
    for (page, want), row in zip(PAGES, got):
        assert want is None or row["page_text"] == want, page
    assert got[-1]["page_text"].endswith("in") and got[1]["n_lists"] == 2 and got[2]["n_tables"] == 1
    assert htmltext.render_pages(pages.limit(0)).count() == 0


def test_every_visible_word_of_the_pages_is_kept(spark):
    """Against a plain reading: markup, scripts, heads and comments off, all other words once, in order."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    for row in htmltext.render_pages(pages.withColumn("raw", F.col("html"))).collect():
        plain = re.sub(r"(?is)<head.*?</head>|<script.*?</script>|<style.*?</style>|<!--.*?-->", " ", row["raw"])
        plain = htmltext.html.unescape(re.sub(r"<(?:b|i|a|em|strong|span)\b[^>]*>|</(?:b|i|a|em|strong|span)>", "", plain))
        plain = re.sub(r"<[^>]*>", " ", plain)
        seen = re.sub(r"(?m)^\s*- ", "", row["page_text"])
        assert seen.split() == plain.split()
