"""Runs and digests against brute force over every period."""

import hashlib
import random
import re
import zlib

import numpy as np

from shroud.llm import queries, runs


def brute(w, least=12):
    """(start, period, end) of all runs: every period, smallest first."""
    seen, n = {}, len(w)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if w[i] == w[i + q]:
                j = i
                while j + q < n and w[j] == w[j + q]:
                    j += 1
                if j + q - i >= max(least, 2 * q):
                    seen.setdefault((i, j + q), q)
                i = j
            i += 1
    return sorted((s, q, e) for (s, e), q in seen.items())


def sequences(rng):
    kind, n, a = rng.randrange(7), rng.randrange(0, 160), rng.choice([1, 2, 2, 3, 4, 50])
    w = [rng.randrange(a) for _ in range(n)]
    if kind == 1 and n:  # one period
        p = rng.randrange(1, max(2, n // 2))
        return [w[i % p] for i in range(n)]
    if kind == 2:  # Fibonacci words have the most squares
        x, y = [0], [0, 1]
        for _ in range(rng.randrange(1, 9)):
            x, y = y, y + x
        return y
    if kind == 3 and n:  # a period with errors
        p = rng.randrange(1, 12)
        w = [w[i % p] for i in range(n)]
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(n)] = rng.randrange(a)
        return w
    if kind == 4:  # nested repetitions
        b, w = [rng.randrange(a) for _ in range(rng.randrange(1, 30))], []
        for _ in range(6):
            w += b * rng.randrange(1, 4) + [rng.randrange(a + 1)] * rng.randrange(2)
            b = b + b[: rng.randrange(len(b) + 1)]
        return w[:400]
    if kind == 5:  # two stretches of one period that meet out of phase
        return ([0, 1] * rng.randrange(1, 30) + [rng.randrange(2)] * rng.randrange(2) + [0, 1] * rng.randrange(1, 30)) * rng.randrange(1, 3)
    return w


def test_equals_brute_force():
    total = 0
    for seed in range(300):
        rng = random.Random(seed)
        docs = [sequences(rng) for _ in range(rng.randrange(1, 10))]
        bounds = np.concatenate([[0], np.cumsum([len(w) for w in docs])]).astype(np.int64)
        start, end, period = runs.find(np.array([x for w in docs for x in w], np.int64), bounds)
        doc = np.searchsorted(bounds, start, side="right") - 1
        got = list(zip(doc.tolist(), (start - bounds[doc]).tolist(), period.tolist(), (end - bounds[doc]).tolist()))
        want = [(d, *r) for d, w in enumerate(docs) for r in brute(w)]
        assert sorted(got) == sorted(want), docs
        total += len(want)
    assert total > 3000


def test_long_texts():
    """Worst cases: one word, and a long text repeated twice, are linear enough and exact."""
    n = 200_000
    start, end, period = runs.find(np.zeros(n, np.int64), np.array([0, n]))
    assert (start.tolist(), end.tolist(), period.tolist()) == ([0], [n], [1])
    half = np.random.default_rng(1).integers(0, 1 << 40, n // 2)
    start, end, period = runs.find(np.unique(np.tile(half, 2), return_inverse=True)[1].astype(np.int64), np.array([0, n]))
    assert (start.tolist(), end.tolist(), period.tolist()) == ([0], [n], [n // 2])


def test_wavelet_tree():
    rng = np.random.default_rng(4)
    for n in (1, 63, 64, 65, 1000):
        values = rng.permutation(n * 2)[:n].astype(np.int64)
        tree = runs.WaveletTree(values)
        lo = rng.integers(0, n, 200)
        hi = lo + 1 + (rng.random(200) * (n - lo)).astype(np.int64)
        than, k = rng.integers(0, 3 * n, 200), (rng.random(200) * (hi - lo)).astype(np.int64)
        assert tree.smaller(lo, hi, than).tolist() == [int((values[a:b] < x).sum()) for a, b, x in zip(lo, hi, than)]
        assert tree.kth(lo, hi, k).tolist() == [int(np.sort(values[a:b])[i]) for a, b, i in zip(lo, hi, k)]


SPLIT = re.compile("[^\x20\x09-\x0d]+")


def expected(doc_id, text):
    w = SPLIT.findall(text or "")
    n, h = len(w), zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute(w)
    dropped = {i for s, q, e in found for i in range(s + q, e)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    listed = sha("".join(f"{s},{e - s},{q}\n" for s, q, e in found))
    best = min(((s - e, s, q) for s, q, e in found), default=None)
    best = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
    return doc_id, len(found), *best, listed, sha(" ".join(x for i, x in enumerate(w) if i not in dropped))


def test_query(spark, odd, none, tmp_path):
    rng = random.Random(8)
    rows = [(r.doc_id, r.text if len(r.text or "") < 50_000 else r.text[:9000]) for r in odd.collect()]
    rows += [(100 + i, rng.choice([" ", "\t", "\n \x0b", " x "]).join(rng.choice(["la", "li", "Élan", "日本", "x"]) for _ in range(rng.randrange(0, 300)))) for i in range(120)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = [tuple(r) for r in queries.op12_runs(spark, str(tmp_path)).collect()]
    assert sorted(found, key=str) == sorted((expected(i, t) for i, t in rows), key=str)
    assert runs.periodic(none).count() == 0


def test_operator_keeps_texts_apart(spark):
    """Repetitions across documents are no runs; the runs themselves are returned."""
    text = " ".join(f"w{i}" for i in range(20))
    rows = runs.periodic(spark.createDataFrame([(1, text), (2, text), (3, f"{text}\n{text} end"), (4, None)], "doc_id long, text string").coalesce(1)).collect()
    assert [(r.doc_id, r.n_runs, [tuple(x) for x in r.runs]) for r in rows] == [(1, 0, []), (2, 0, []), (3, 1, [(0, 40, 20)]), (4, 0, [])]
    assert [r.collapsed for r in rows] == [text, text, f"{text} end", ""]
