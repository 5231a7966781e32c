"""Overlap fold semantics, redaction and value-map redaction."""


def _resolve(spark, rows):
    from shroud.operators.overlap import resolve_overlaps

    df = spark.createDataFrame(rows, "doc_id long, type string, recognizer string, start int, end int, value string, "
                                     "confidence double")
    return sorted((r.start, r.end, r.type) for r in resolve_overlaps(df).collect())


def test_chain_middle_strongest(spark):
    # A(0,10,.9) B(5,15,.95) C(12,20,.9): pass 1 keeps A, B replaces A, C conflicts with B and loses
    rows = [(1, "X", "a", 0, 10, "a" * 10, 0.9), (1, "Y", "b", 5, 15, "b" * 10, 0.95), (1, "Z", "c", 12, 20, "c" * 8, 0.9)]
    assert _resolve(spark, rows) == [(5, 15, "Y")]


def test_touching_spans_conflict_in_pass_one(spark):
    rows = [(1, "X", "a", 0, 5, "aaaaa", 0.9), (1, "Y", "b", 5, 9, "bbbb", 0.95)]
    assert _resolve(spark, rows) == [(5, 9, "Y")]
    rows = [(1, "X", "a", 0, 5, "aaaaa", 0.95), (1, "Y", "b", 5, 9, "bbbb", 0.9)]
    assert _resolve(spark, rows) == [(0, 5, "X")]


def test_separate_islands_untouched(spark):
    rows = [(1, "X", "a", 0, 5, "aaaaa", 0.9), (1, "Y", "b", 6, 9, "bbb", 0.85), (2, "Z", "c", 0, 3, "ccc", 0.8)]
    assert _resolve(spark, rows) == [(0, 3, "Z"), (0, 5, "X"), (6, 9, "Y")]


def _plain(rows):
    """Both passes over the whole sorted list: each candidate against the first conflicting kept one."""
    cands = sorted(rows, key=lambda r: (r[3], r[3] - r[4], -r[6], r[1], r[2], r[5]))
    for touching in (True, False):
        kept = []
        for e in cands:
            at = next((i for i, x in enumerate(kept) if max(e[3], x[3]) < min(e[4], x[4]) or (touching and e[3] == x[4])), None)
            if at is None:
                kept.append(e)
            elif (e[6], e[4] - e[3]) > (kept[at][6], kept[at][4] - kept[at][3]):
                kept[at] = e
        cands = kept
    return sorted((r[3], r[4], r[1]) for r in cands)


def test_two_entities_without_a_scan(spark):
    """The short form for two entities keeps what the fold keeps, null confidences and touching spans included."""
    import random

    from pyspark.sql import functions as F

    from shroud.operators import overlap

    rng = random.Random(12)
    rows = []
    for i in range(400):
        two = sorted(((s := rng.randrange(6), s + 1 + rng.randrange(4), rng.choice([0.8, 0.9, None])) for _ in range(2)), key=lambda e: (e[0], -e[1]))
        rows.append((i, two))
    df = spark.createDataFrame(rows, "i int, a array<struct<start:int,end:int,confidence:double>>")
    got = df.select(overlap.pair(F.col("a")).alias("pair"), overlap.fold(F.col("a")).alias("fold")).collect()
    assert all(r.pair == r.fold for r in got) and {len(r.pair) for r in got} == {1, 2}


def test_equals_the_plain_fold(spark):
    import random

    rng = random.Random(2)
    rows = []
    for doc in range(300):
        for _ in range(rng.randrange(1, 14)):
            start = rng.randrange(40)
            rows.append((doc, rng.choice("XYZ"), rng.choice("ab"), start, start + rng.randrange(1, 12), "v", rng.choice([0.8, 0.85, 0.9, 0.95])))
    rows = list(dict.fromkeys(rows))
    want = sorted(x for doc in range(300) for x in _plain([r for r in rows if r[0] == doc]))
    assert _resolve(spark, rows) == want


def test_a_chain_of_fifty_thousand(spark):
    """One island: every candidate reaches the next one; cost grows with the number of candidates."""
    import random
    import time

    rng = random.Random(3)
    rows = [(1, "X", "a", 10 * i, 10 * i + rng.choice([11, 14, 25]), "v", rng.choice([0.8, 0.85, 0.9])) for i in range(50_000)]
    started = time.time()
    got = _resolve(spark, rows)
    assert time.time() - started < 60
    assert got == _linear(rows)
    short = rows[:1500]
    assert _linear(short) == _plain(short)


def _linear(rows):
    """The plain fold for a chain whose kept entities are seen in order (checked against it above)."""
    kept = []
    for e in sorted(rows, key=lambda r: (r[3], r[3] - r[4], -r[6], r[1], r[2], r[5])):
        if kept and e[3] <= kept[-1][4]:
            if (e[6], e[4] - e[3]) > (kept[-1][6], kept[-1][4] - kept[-1][3]):
                kept[-1] = e
        else:
            kept.append(e)
    return sorted((r[3], r[4], r[1]) for r in kept)


def test_offset_and_value_map_redaction(spark):
    from shroud.operators.redact import redact_offsets, redact_values

    docs = spark.createDataFrame([(1, "call 555-123-4567 or mail a@b.co now"), (2, "nothing here")],
                                 "doc_id long, text string")
    ents = spark.createDataFrame([(1, 1, 5, 17, "555-123-4567", "999-000-1111"), (1, 2, 26, 32, "a@b.co", "x@y.zz")],
                                 "doc_id long, id int, start int, end int, value string, replacement string")
    out = {r.doc_id: r.redacted_text for r in redact_offsets(docs, ents).collect()}
    assert out == {1: "call 999-000-1111 or mail x@y.zz now", 2: "nothing here"}
    # value map: longest original first, a replacement containing a later original is replaced again
    parts = spark.createDataFrame([(1, 0, "John Smith met John"), (1, 1, "no change")], "doc_id long, ix int, text string")
    vm = spark.createDataFrame([(1, 1, "John Smith", "Mary Jones"), (1, 2, "John", "Paul")],
                               "doc_id long, id int, value string, replacement string")
    got = {r.ix: (r.redacted_text, r.changed) for r in redact_values(parts, vm).collect()}
    assert got == {0: ("Mary Jones met Paul", True), 1: ("no change", False)}
