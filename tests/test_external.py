"""Spans of another recognizer: chunk-keyed, nothing of a document gathered."""

import random
import re
import time

EXT = "doc_id long, entity_type string, start int, end int, score double"


def _plain(text, start, end):
    """Value and windows as slices of the whole text."""
    tail = text[max(start - 40, 0) : end + 40]
    if "\n\n" in tail:
        left = text[max(start - 40, 0) : start].rsplit("\n\n", 1)[-1]
        tail = left + text[start:end] + text[end : end + 40].split("\n\n", 1)[0]
    return text[start:end], text[max(start - 30, 0) : start], text[end : end + 5], tail


def test_windows_equal_slices_of_the_text(spark):
    """Spans across chunk borders, of many chunks, at both ends, repeated, outside the text, without characters."""
    from shroud.operators.recognizers import JOIN_CHUNK, external_candidates

    rng = random.Random(5)
    size = 3 * JOIN_CHUNK + 77
    texts = {1: "".join(rng.choice("abc dé\n") for _ in range(size)), 2: "Ann Lee\nshort", 3: "", 4: None, 5: "x" * JOIN_CHUNK}
    spans = [(1, s, s + n) for s in (0, 1, 63, 64, JOIN_CHUNK - 1, JOIN_CHUNK, JOIN_CHUNK - 65, 2 * JOIN_CHUNK - 3, size - 1, size - 200) for n in (1, 7, 130)]
    spans += [(1, 10, 2 * JOIN_CHUNK + 500), (1, 5, size), (1, size - 3, size + 50), (2, 0, 7), (2, 0, 7), (5, 0, JOIN_CHUNK), (5, JOIN_CHUNK - 2, JOIN_CHUNK)]
    none = [(1, size, size + 4), (1, 9, 9), (1, 9, 4), (1, -3, 2), (3, 0, 1), (4, 0, 1), (9, 0, 1), (2, None, 3)]
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    ext = spark.createDataFrame([(d, "PERSON", s, e, 0.85) for d, s, e in spans + none], EXT)
    got = external_candidates(docs, ext).collect()
    assert sorted((r.doc_id, r.start, r.end) for r in got) == sorted(spans)
    for r in got:
        value, left, right, context = _plain(texts[r.doc_id], r.start, r.end)
        assert (r.value, r.left30, r.right5, r.context) == (value, left, right, context), (r.doc_id, r.start, r.end)
        line = re.match(r"(?:[ \t\r\f\v]*\n)*([^\n]*)", texts[r.doc_id])
        assert r.in_first_line == (r.end <= line.end() or value in line[1])


def test_a_document_with_a_million_spans(spark, tmp_path):
    """One document holds a million spans: the plan keys them by chunk, and the detection passes."""
    from pyspark.sql import functions as F

    n = 1_000_000
    docs = spark.range(7, 9).select(F.col("id").alias("doc_id"), F.expr(f"repeat('Acme Widgets Ltd and ', {n})").alias("text"))
    ext = spark.range(n).select((F.col("id") * 0 + 7).alias("doc_id"), F.lit("ORG").alias("entity_type"), (F.col("id") * 21).cast("int").alias("start"),
                                (F.col("id") * 21 + 16).cast("int").alias("end"), F.lit(0.85).alias("score"))
    ext.write.parquet(str(tmp_path / "ext"))
    ext = spark.read.parquet(str(tmp_path / "ext"))
    started = time.time()
    from shroud.operators.recognizers import external_candidates

    found = external_candidates(docs, ext)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"Join \[doc_id#\d+L, _k#\d+L\]", plan), plan
    assert not re.search(r"collect_list.*\n[^\n]*Exchange hashpartitioning\(doc_id#\d+L, \d+\)", plan)
    row = found.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("start").alias("places"), F.min("value").alias("lo"), F.max("value").alias("hi")).first()
    assert tuple(row) == (n, n, "Acme Widgets Ltd", "Acme Widgets Ltd")
    assert time.time() - started < 240
