"""The pigeonhole join against all pairs."""

import numpy as np

from shroud.llm import embed

FIELDS = "vec_id long, embedding array<float>, label int"


def vectors(seed=4, d=24):
    rng = np.random.default_rng(seed)
    rows = []
    for label in (1, 2):
        for _ in range(12):
            centre = rng.standard_normal(d)
            for _ in range(rng.integers(1, 8)):
                rows.append((len(rows), (centre + rng.standard_normal(d) * rng.choice([0.05, 0.2, 0.35])).astype(np.float32).tolist(), label))
    rows.append((len(rows), rows[0][1], 1))  # an exact copy
    rows.append((len(rows), rows[0][1], 2))  # under another label
    return rows


def brute(rows, cosine):
    n = {i: 0 for i, _, _ in rows}
    root = {i: i for i in n}

    def find(i):
        return i if root[i] == i else find(root[i])

    for k, (i, a, x) in enumerate(rows):
        for j, b, y in rows[k + 1 :]:
            if x == y:
                a_, b_ = np.array(a, float), np.array(b, float)
                if a_ @ b_ / np.linalg.norm(a_) / np.linalg.norm(b_) >= cosine:
                    n[i] += 1
                    n[j] += 1
                    p, q = sorted((find(i), find(j)))
                    root[q] = p
    return {i: (n[i], find(i), find(i) == i) for i in n}


def result(spark, rows, cosine=0.93):
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embed.near_duplicates(spark.createDataFrame(rows, FIELDS), cosine).collect()}


def test_equals_brute_force(spark):
    rows = vectors()
    want = brute(rows, 0.93)
    assert sum(n for n, _, _ in want.values()) > 40
    assert result(spark, rows) == want


def test_leaves_and_parts(spark, monkeypatch):
    """Trees and parts far smaller than a label give the same links, each counted once."""
    rows = vectors(6)
    monkeypatch.setattr(embed, "LEAF", 8)
    monkeypatch.setattr(embed, "PART", 5)
    assert result(spark, rows) == brute(rows, 0.93)


def test_pigeonhole_finds_every_close_pair():
    rng = np.random.default_rng(8)
    x = rng.standard_normal((300, 20))
    x[150:] = x[:150] + rng.standard_normal((150, 20)) * 0.3
    x /= np.linalg.norm(x, axis=1)[:, None]
    every = np.arange(300)
    found = set()
    for block in range(len(embed.spans(20))):
        for a, b, first in embed.links(x, block, 0.93, every, every):
            pairs = set(zip(a[first].tolist(), b[first].tolist()))
            assert not pairs & found  # counted once
            found |= pairs
    assert found == {(i, j) for i, j in zip(*np.nonzero(x @ x.T >= 0.93)) if i != j}


def test_blocks_of_long_vectors_count_once(monkeypatch):
    """Vectors longer than a block: the same links, each in one block."""
    monkeypatch.setattr(embed, "WIDTH", 8)
    rng = np.random.default_rng(9)
    x = rng.standard_normal((200, 20))
    x[100:] = x[:100] + rng.standard_normal((100, 20)) * 0.3
    x /= np.linalg.norm(x, axis=1)[:, None]
    count = np.zeros(200, np.int64)
    list(embed._met(x, np.repeat([0, 1], 100), np.ones(200, np.int64), 0.93, 30, count))
    near = x @ x.T >= 0.93
    near[:100, :100] = near[100:, 100:] = False
    assert near.any() and count.tolist() == near.sum(axis=1).tolist()


def test_vectors_are_not_dealt_out(spark, monkeypatch):
    """Leaves are read where they meet: the join moves no vector, however many leaves a label has."""
    rows, seen, real = vectors(7), {}, embed.written
    monkeypatch.setattr(embed, "LEAF", 8)
    monkeypatch.setattr(embed, "written", lambda df, name, **more: real(seen.setdefault(name, df), name, **more))
    assert result(spark, rows) == brute(rows, 0.93)
    assert "data#" not in seen["joined"]._jdf.queryExecution().toString()


def test_double_precision_and_odd_lengths(spark):
    """Components that single precision does not hold, and very large or small ones."""
    rng = np.random.default_rng(10)
    rows = [(i, (rng.standard_normal(3) * 10.0 ** rng.choice([-200, -3, 0, 3, 200])).tolist(), 1) for i in range(60)]
    rows += [(60 + i, (np.array(v) * 3).tolist(), 1) for i, v, _ in rows[:20]]
    made = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    scaled = [(i, (np.array(v) / np.abs(v).max()).tolist(), y) for i, v, y in rows]
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embed.near_duplicates(made, 0.93).collect()} == brute(scaled, 0.93)


def test_odd_rows(spark):
    v = [1.0, 2.0, 0.0]
    rows = [(1, v, 5), (2, v, 5), (2, v, 5), (3, None, 5), (4, [], 5), (5, [0.0, 0.0, 0.0], 5), (6, [1.0, None, 0.0], 5), (7, [float("nan"), 1.0, 0.0], 5), (8, v, None), (None, v, 5), (9, [1.0, 2.0], 5), (10, [2.0, 4.0, 0.0], 5), (11, [float("inf"), 1.0, 1.0], 5)]
    found = embed.near_duplicates(spark.createDataFrame([(*r, "a", 1.0) for r in rows], FIELDS + ", data string, weight double")).collect()
    assert len(found) == len(rows)
    by = {}
    for r in found:
        by.setdefault(r.vec_id, []).append((r.n_links, r.component_id, r.kept))
    assert by[1] == [(4, 1, True)] and by[2] == [(4, 1, False)] * 2 and by[10] == [(4, 1, False)]
    assert by[None] == [(4, None, True)]
    assert all(by[i] == [(0, i, True)] for i in (3, 4, 5, 6, 7, 8, 9, 11))


def test_empty_table(spark):
    assert embed.near_duplicates(spark.createDataFrame([], FIELDS)).collect() == []
