"""Ranked search against a plain scan of all documents; plan and pruning."""

import math
import random
import re
from collections import Counter

import pytest

from shroud.llm import lexical, queries

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans(lexical.UPPER, lexical.LOWER)


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, top=50):
    worded = [(i, Counter(terms(t))) for i, t in docs]
    worded = [(i, c, c.total()) for i, c in worded if c]
    n_docs, n_terms = len(worded), sum(n for _, _, n in worded)
    df = Counter(t for _, c, _ in worded for t in c)
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(terms(text))
    out = []
    for item, ts in wanted.items():
        weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in ts if t in df}
        scored = []
        for i, c, n in worded:
            m = 100 - 50 + (50 * n * n_docs) // n_terms
            score = sum(w * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t, w in weight.items() if t in c)
            if score > 0:
                scored.append((-score, i is not None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored)[:top])]
    return out


def check(spark, docs, items, top=50, parts=3):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)
    got = [tuple(r) for r in lexical.rank(d, spark.createDataFrame(items, "item_id long, text string"), top).select("item_id", "rank", "doc_id", "score").collect()]
    assert sorted(got, key=str) == sorted(plain(docs, items, top), key=str)
    return got


def corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["Élan", "日本", "STRASSE", "ΣΑΣ", "x_y"]
    word = lambda: vocabulary[min(int(rng.paretovariate(0.6)), len(vocabulary)) - 1] if rng.random() < 0.8 else rng.choice(vocabulary)
    docs = [(rng.randrange(n), rng.choice([" ", "-", "\n"]).join(word() for _ in range(rng.randrange(0, 60)))) for _ in range(n)]
    items = [(i, " ".join(word() for _ in range(rng.randrange(1, 30)))) for i in range(25)]
    return docs, items


@pytest.mark.parametrize("seed,top", [(1, 50), (2, 3), (3, 1)])
def test_equals_a_plain_scan(spark, seed, top):
    docs, items = corpus(seed, 900)
    assert check(spark, docs, items, top)


def test_small_blocks_and_bundles(spark, monkeypatch):
    """Several bundles of items give the same rows."""
    docs, items = corpus(4, 300)
    monkeypatch.setattr(lexical, "BUNDLE", 60)
    check(spark, docs, items, 5, parts=7)


def test_ties_repeats_and_nulls(spark):
    docs = [(i, "same words here") for i in range(80)] + [(3, "same words here"), (None, "same words here"), (None, None), (5, ""), (6, "... !?"), (7, "other")]
    items = [(1, "Same WORDS"), (1, "here"), (None, "other thing"), (2, None), (3, ""), (4, "absent"), (5, "..")]
    got = check(spark, docs, items)
    assert [(r, i) for item, r, i, _ in sorted(got, key=lambda x: (str(x[0]), x[1])) if item == 1][:6] == [(1, None), (2, 0), (3, 1), (4, 2), (5, 3), (6, 3)]


def test_odd_rows(spark, odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    items = [(1, "alpha3 beta4 one two"), (2, "123")]
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id long, text string, doc_id string, score int")
    got = [tuple(r) for r in lexical.rank(odd, frame).select("item_id", "rank", "doc_id", "score").collect()]
    assert sorted(got, key=str) == sorted(plain(rows, items), key=str)
    assert lexical.rank(none, frame).count() == 0
    assert lexical.rank(odd, frame.limit(0)).count() == 0


def test_owners_share_the_postings_and_bundles_pass_all(spark):
    """Each owner holds terms, the rarest first; the plan cogroups once an owner and keeps the best before the shuffle."""
    docs, items = corpus(5, 400)
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    plan = lexical.rank(d, i)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapCoGroupsInArrow") == lexical.OWNERS and "WindowGroupLimit" in plan
    bundle = lexical.Bundle(lexical.item_terms(i).toArrow())
    found = lexical.blocks(d.repartition(4), bundle).toArrow().to_pylist()
    df = Counter()
    for b in found:
        df.update(dict(zip(b["codes"], b["df"])))
    worded = [set(terms(t)) for _, t in docs]
    names = [t.decode() for t in bundle.terms.to_pylist()]
    assert {names[c]: n for c, n in df.items()} == {t: n for t in names if (n := sum(t in w for w in worded))}


def test_query(spark, tmp_path):
    docs, items = corpus(6, 200)
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = [tuple(r[c] for c in ("item_id", "rank", "doc_id", "score")) for r in queries.op13_lexical(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(plain(docs, items), key=str)
