"""Near-duplicates against brute force over all pairs."""

import random
import re

import numpy as np

from shroud.llm import minhash
from shroud.llm.common import components


def shingles(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows, percent):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        return i if root[i] == i else find(root[i])

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed=1):
    """Groups of copies with few to many changed words, a common passage, exact and unrelated texts."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(30))
    rows, n = [], 0
    for group in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(20, 300))]
        for _ in range(40 if group == 0 else rng.randrange(1, 8)):
            own = list(base)
            for _ in range(rng.randrange(0, 1 + len(own) // 25)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            rows.append((n, " ".join(own) + (" " + passage if rng.random() < 0.3 else "")))
            n += 1
    return rows


def test_equals_brute_force(spark):
    rows = corpus()
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute(rows, 85)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_large_family_in_blocks(spark, monkeypatch):
    """Blocks smaller than a family give the same links."""
    rows = corpus(2)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(minhash, "BLOCK", 8)
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, 80).collect()} == {i: c for i, (_, c) in brute(rows, 80).items()}


def test_links_by_matrix_and_by_pairs_agree():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 400).astype(np.uint64)
    sets = [np.unique(np.where(rng.random(400) < rng.random() * 0.15, rng.integers(0, 2**63, 400).astype(np.uint64), base)) for _ in range(30)]

    def groups(pairs, n):
        root = list(range(n))
        for i, j in pairs:
            a, b = root[i], root[j]
            root = [min(a, b) if r in (a, b) else r for r in root]
        return root

    every = [(i, j) for i in range(30) for j in range(i + 1, 30) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j]))]
    assert groups(minhash._links(sets, 85), 30) == groups(every, 30)


def test_odd_rows(odd):
    rows = minhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id, r.kept))
    assert by[1][0][1:] == (1, True) and [x[1:] for x in by[2]] == [(1, False)] * 2
    assert by[3] == by[4][:0] + [(0, 3, True)] and by[4] == [(0, 4, True)] and by[5] == [(0, 5, True)]
    assert by[6] == [(1, 6, True)] and by[7] == [(1, 6, False)]
    assert by[9][0][1] == 8  # very long texts differ by a word
    assert {n for n, _, _ in by[None]} == {0, by[1][0][0]} and all(k for _, _, k in by[None])


def test_empty_table(none):
    assert minhash.near_duplicates(none).collect() == []


def test_tables_meet_nearly_every_pair():
    for percent in (70, 80, 85, 90, 95):
        a = minhash.shape(percent)
        assert (1 - (1 - (percent / 100) ** a) ** minhash.M) ** 2 > 0.9993


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 100), (7, 7), (None, 3)]
    found = {r.node: r.root for r in components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert found == {i: 1 for i in range(1, 41)} | {100: 100, 101: 100}
