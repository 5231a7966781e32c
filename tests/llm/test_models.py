"""The fitted operators: held-out accuracy, plain restatements and odd rows."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shroud.llm import langid, quality, toxicity
from shroud.llm.common import remainder
from shroud.llm.text import slices

SYLLABLES = {"aa": ["th", "er", "on", "an", "ing"], "bb": ["sch", "en", "ung", "ei", "ä"], "cc": ["eau", "ou", "é", "tion", "re"]}


def prose(lang, n, rng):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def spoken(spark):
    rng = random.Random(1)
    rows = [(i, prose(lang, rng.randrange(5, 60), rng), lang) for i in range(300) for lang in [rng.choice(sorted(SYLLABLES))]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_language_of_held_out_rows(spoken):
    held = spoken.where(remainder("doc_id", 4) == 2)
    got = {r.doc_id: r for r in langid.identify(held, langid.trained(spoken)).collect()}
    want = {r.doc_id: r.lang for r in held.collect()}
    assert len(got) > 50 and sum(got[i].lang_pred == x for i, x in want.items()) >= 0.99 * len(want)
    assert all(0 <= r.score <= 1 and r.accepted for r in got.values())


def test_counts_are_those_of_every_word(spark):
    text = "Ab ab, a-b"
    rows = langid.gram_counts(spark.createDataFrame([(text, "x"), (text, "x"), ("ab", None), (None, "x")], "text string, lang string")).collect()
    assert {r.gram: r.n for r in rows} == {"    a": 6, "   ab": 4, "  ab ": 4, "   a ": 2, "    b": 2, "   b ": 2}


def test_probabilities_equal_the_formula():
    """Interpolated Kneser-Ney, restated gram by gram."""
    words = ["abab", "abba", "baba", "ab", "cab"] * 3 + ["acc"]
    top = {}
    for w in words:
        padded = " " * (langid.ORDER - 1) + w + " "
        for i in range(langid.ORDER, len(padded) + 1):
            top[padded[i - langid.ORDER : i]] = top.get(padded[i - langid.ORDER : i], 0) + 1
    counts, level = {langid.ORDER: top}, top
    for k in range(langid.ORDER - 1, 0, -1):
        lower = {}
        for g in level:
            lower[g[1:]] = lower.get(g[1:], 0) + 1
        counts[k] = level = lower
    model = langid.Model({"x": {k: (list(c), np.array(list(c.values()))) for k, c in counts.items()}})

    def p(context, c, k):
        if k == 0:
            return 1 / 4096
        table = counts[k]
        ones, twos = (sum(v == n for v in table.values()) for n in (1, 2))
        d = ones / (ones + 2 * twos) if ones and twos else 0.5
        h = context[len(context) - k + 1 :] if k > 1 else ""
        follow = [v for g, v in table.items() if g[:-1] == h]
        if not follow:
            return p(context, c, k - 1)
        return max(table.get(h + c, 0) - d, 0) / sum(follow) + d * len(follow) / sum(follow) * p(context, c, k - 1)

    for w in ["abab", "bbb", "zab", "c"]:
        padded = " " * (langid.ORDER - 1) + w + " "
        want = -sum(np.log2(p(padded[i - langid.ORDER + 1 : i], padded[i], langid.ORDER)) for i in range(langid.ORDER - 1, len(padded)))
        bits, n = model.bits([w.encode()])
        assert n[0] == len(w) + 1 and abs(bits[0, 0] - want) < 1e-9


def test_rejection(spark, spoken):
    fitted = langid.trained(spoken)
    docs = spark.createDataFrame([(1, "ЖЩЫ ЪЭЮ ФЦЧ ШЩЪ ЫЬЭ ЖЖЖ"), (2, prose("aa", 30, random.Random(3))), (3, None), (4, "12 !!")], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.accepted) for r in langid.identify(docs, fitted).collect()}
    assert got[1][1] is False and got[2] == ("aa", True) and got[3] == got[4] == ("und", False)
    assert [r.doc_id for r in langid.clean(docs, fitted).collect()] == [2]


def test_language_of_odd_rows(spoken, odd, none):
    fitted = langid.trained(spoken)
    got = langid.identify(odd, fitted).collect()
    assert len(got) == odd.count()
    assert {r.doc_id for r in got if r.lang_pred == "und"} == {3, 4, 5, 10, None} and all(r.score == 0 for r in got if r.lang_pred == "und")
    assert langid.identify(none, fitted).collect() == [] and langid.clean(odd, fitted).columns == odd.columns
    untrained = langid.trained(none)
    assert {r.lang_pred for r in langid.identify(odd, untrained).collect()} == {"und"} and langid.clean(odd, untrained).count() == 0


INSULTS = ["loser", "idiots", "worthless", "disgusting", "pathetic"]


@pytest.fixture(scope="module")
def marked(spark):
    """Abuse, the same words spelled wrong, and clean text."""
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(400):
        w = prose("aa", 40, rng).split()
        toxic = int(i % 4 == 0)
        if toxic:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(INSULTS)
        rows.append((i, " ".join(w)))
        labels.append((i, toxic))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_of_held_out_rows(marked):
    docs, labels = marked
    got = toxicity.score(docs, toxicity.trained(docs, labels)).join(labels, "doc_id").where(remainder("doc_id", 4) == 2).collect()
    assert len(got) > 60 and all((r.score >= 0.3) == bool(r.toxic) for r in got)


def test_misspelled_terms_count(spark, marked):
    docs, labels = marked
    fitted = toxicity.trained(docs, labels)
    rng = random.Random(9)
    rows = [(1, "You " + prose("aa", 20, rng) + " worthles and disgustng, pathetik"), (2, prose("aa", 30, rng)), (3, "w0rthless d!sgusting p@thetic " + prose("aa", 20, rng))]
    got = {r.doc_id: r.hits for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), fitted).collect()}
    assert got == {1: 3, 2: 0, 3: 3}


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def test_automaton_equals_edit_distance():
    rng = random.Random(4)
    terms = ["".join(rng.choice("abc") for _ in range(rng.randrange(3, 12))) for _ in range(25)]
    stems = ["cabca", "bbbbb"]
    lexicon = toxicity.Lexicon(terms, stems)
    for _ in range(3000):
        word = "".join(rng.choice("abcd") for _ in range(rng.randrange(1, 13))) if rng.random() < 0.5 else rng.choice(terms)
        word = list(word)
        for _ in range(rng.randrange(3)):
            i = rng.randrange(len(word) + 1)
            word[i : i + rng.randrange(2)] = rng.choice(["", "a", "d"])
        word = "".join(word) or "a"
        want = toxicity.NONE
        if any(word.startswith(s) for s in stems):
            want = toxicity.STEM
        if any(levenshtein(word, t) <= toxicity.edits(len(t)) for t in terms):
            want = max(want, toxicity.FUZZY)
        if word in terms:
            want = toxicity.EXACT
        assert lexicon.match(word) == want, word


def test_context_windows():
    scanner = toxicity.Scanner(toxicity.Lexicon(["stupid"], []))
    texts = ["you are stupid", "he said the word stupid here", 'the "stupid" sign', "a stupid plan", "stupid " + "x " * 20 + "you"]
    for t in slices(pa.array(texts)):
        f = np.expm1(scanner.features(t)[:, :6]).round().astype(int)
    assert f[:, 0].tolist() == [1] * 5 and f[:, 3].tolist() == [0, 1, 1, 0, 0] and f[:, 4].tolist() == [1, 0, 0, 0, 0]


def test_toxicity_of_odd_rows(spark, marked, odd, none):
    fitted = toxicity.trained(*marked)
    got = toxicity.score(odd, fitted).collect()
    assert len(got) == odd.count() and all(0 <= r.score < 0.3 for r in got)
    assert toxicity.score(none, fitted).collect() == [] and toxicity.clean(odd, fitted).columns == odd.columns
    one = toxicity.trained(marked[0], marked[1].where("toxic = 0"))
    assert {r.score for r in toxicity.score(odd, one).collect()} == {0.0}
    broken = marked[1].unionByName(spark.createDataFrame([(None, 1), (5, None), (6, 7)], "doc_id long, toxic int"))
    assert toxicity.trained(marked[0], broken)["terms"] == fitted["terms"]


@pytest.fixture(scope="module")
def graded(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(500):
        text, good = prose("aa", rng.randrange(30, 200), rng), int(i % 3 > 0)
        if not good:
            kind = rng.randrange(3)
            w = text.split()
            text = " ".join([w[0]] * 80) if kind == 0 else text.upper().replace(" ", "!! ") if kind == 1 else " | ".join(w)
        rows.append((i, text))
        labels.append((i, good))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_quality_of_held_out_rows(graded):
    docs, labels = graded
    got = quality.score(docs, quality.trained(docs, labels)).join(labels, "doc_id").where(remainder("doc_id", 5) == 0).collect()
    assert len(got) > 60 and sum((r.score >= 0.3) == bool(r.quality) for r in got) >= 0.97 * len(got)


def test_density_difference_equals_the_formula():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, quality.FEATURES))
    y = (rng.random(400) < 0.5).astype(float)
    x[y == 0] *= 2
    fitted = quality.Discriminant(x, y)
    z = (x - fitted.mean) / fitted.scale
    s = [np.cov(z[y == c], rowvar=False, bias=True) for c in (0, 1)]
    pooled = sum((y == c).sum() * s[c] for c in (0, 1)) / 400
    logs = []
    for c in (0, 1):
        v = 0.9 * s[c] + 0.1 * pooled
        v = 0.98 * v + 0.02 * np.trace(v) / quality.FEATURES * np.eye(quality.FEATURES)
        d = z - z[y == c].mean(axis=0)
        logs.append(-0.5 * (np.einsum("ij,jk,ik->i", d, np.linalg.inv(v), d) + np.linalg.slogdet(v)[1]))
    assert np.allclose(np.sinh(fitted.difference(x)) * 4, logs[1] - logs[0])


def test_statistics_of_known_texts():
    for t in slices(pa.array(["a a a b", "AB cd\nAB cd", None, "", "!!!!", "x" * 40 + "\n" + "Y" * 30])):
        f = dict(zip(quality.NAMES, quality.statistics(t).T))
    back = lambda name: np.sin(f[name]) ** 2
    assert np.allclose(back("repeated_next"), [0.5, 0, 0, 0, 0, 0]) and np.allclose(back("distinct"), [0.5, 0.5, 0, 0, 1, 1])
    assert np.allclose(back("most_frequent"), [0.75, 0.5, 0, 0, 1, 0.5]) and np.allclose(back("upper"), [0, 4 / 11, 0, 0, 0, 30 / 71])
    assert np.allclose(back("same_lines"), [0, 0.5, 0, 0, 0, 0]) and np.allclose(back("line_upper"), [0, 0, 0, 0, 0, 1])
    assert np.allclose(np.expm1(f["log_words"]), [4, 4, 0, 0, 1, 2]) and np.allclose(back("exclamations"), [0, 0, 0, 0, 1, 0])


def test_statistics_do_not_depend_on_the_slice():
    rng = random.Random(8)
    texts = [prose("bb", rng.randrange(0, 80), rng) + rng.choice(["", "\n\n!!", " \n"]) for _ in range(40)]
    whole = np.concatenate([quality.statistics(t) for t in slices(pa.array(texts))])
    assert np.allclose(whole, np.concatenate([quality.statistics(t) for t in slices(pa.array(texts), 200)]))


def test_quality_of_odd_rows(graded, odd, none):
    fitted = quality.trained(*graded)
    got = quality.score(odd, fitted).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (3, 4)}) == 1
    assert quality.score(none, fitted).collect() == []
    assert {r.score for r in quality.score(odd, quality.fit(graded[0], graded[1], F.lit(False))).collect()} == {0.0}
    assert {r.score for r in quality.score(odd, quality.fit(graded[0], graded[1], F.col("quality") == 1)).collect()} == {1.0}
