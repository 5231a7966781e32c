"""Faults once found, each with the right value written by hand."""

import time

import pytest
from pyspark.sql import functions as F


def docs_of(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_missing_replacement_keeps_the_text(spark):
    from shroud.operators.redact import redact_offsets

    ents = spark.createDataFrame([(0, 3, 5, None), (0, 9, 12, "X")], "doc_id long, start int, end int, replacement string")
    assert redact_offsets(docs_of(spark, "hi Al Bo bye"), ents).first().redacted_text == "hi [REDACTED] Bo X"


def test_gaps_across_chunks(spark):
    from shroud.operators.redact import redact_offsets

    text = "".join(chr(0x1F600 + i % 50) + str(i % 10) for i in range(1000))
    spans = [(0, i, i + 3, f"<{i}>") for i in range(5, 1900, 97)]
    want, at = "", 0
    for _, a, b, r in spans:
        want, at = want + text[at:a] + r, b
    got = redact_offsets(docs_of(spark, text), spark.createDataFrame(spans, "doc_id long, start int, end int, replacement string"))
    assert got.first().redacted_text == want + text[at:]


def test_windows_are_those_of_the_text(spark):
    from shroud.functions.spans import chunks, context, cut_sql

    text = "".join(chr(0x1F600) if i % 7 == 0 else chr(97 + i % 26) if i % 11 else "\n" for i in range(1200))
    rows = [(text, a, b) for a in (0, 1, 255, 256, 257, 700, 1199) for b in (a, a + 1, min(a + 300, 1200))]
    df = spark.createDataFrame(rows, "text string, a int, b int").withColumns({"_ch": chunks(F.col("text")), "_n": F.length("text")})
    for r in df.select("a", "b", F.expr(cut_sql("a", "b")).alias("cut"), context(F.col("_ch"), F.col("_n"), F.col("a"), F.col("b"), 80).alias("ctx")).collect():
        assert r.cut == text[r.a : r.b] and r.ctx == text[max(0, r.a - 80) : r.b + 80]


def test_extraction_is_linear(spark):
    """Ten times the lines take about ten times as long, not a hundred times."""
    from shroud.operators.recognizers import raw_candidates

    def run(n):
        text = "".join(f"Call John Smith at 555-123-{i % 10000:04d} or mail a{i}@b.com, SSN 123-45-{1 + i % 9998:04d}\n" for i in range(n))
        t0 = time.time()
        assert raw_candidates(docs_of(spark, text)).count() == 3 * n
        return time.time() - t0

    run(200)
    small = run(2000)
    assert run(20000) < 40 * max(small, 1)


def test_long_ids_are_not_cut(spark):
    from shroud.operators.stats import worksheet

    ents = spark.createDataFrame([(1, i, "EMAIL", "a", "b", 0.9) for i in (1, 100, 1000, 12345)], "doc_id long, id int, type string, value string, replacement string, confidence double")
    assert [r.row_id for r in worksheet(ents).orderBy("id").collect()] == ["001", "100", "1000", "12345"]


def test_digits_are_not_cut(spark):
    """60 bits of the hash modulo 10^18, padded: no digit falls off the end."""
    import hashlib

    from shroud.operators.pseudonyms import digit_string

    rows = spark.range(500).select(F.col("id").cast("string").alias("k"), digit_string(F.col("id").cast("string"), 0).alias("d")).collect()
    assert all(r.d == f"{int(hashlib.md5(f'{r.k}|0'.encode()).hexdigest()[:15], 16) % 10**18:018d}" for r in rows)


def test_generator_may_take_any_slot(spark):
    from shroud.operators import pseudonyms

    ents = spark.createDataFrame([(1, "BADGE", 0, "77")], "doc_id long, type string, start int, value string")
    got = pseudonyms.pseudonymize(ents, generators={"BADGE": lambda form, key, b: F.concat(F.lit("B"), pseudonyms.draw(key, 25, 1000, b).cast("string"))})
    assert got.first().replacement.startswith("B")


@pytest.mark.parametrize("text, reason", [("\n\t \n", "empty"), ("\u00a0\u2003", "empty"), ("", "empty"), (None, "empty"), (" a ", None)])
def test_blank_text_is_rejected(spark, text, reason):
    from shroud.sources.docs import intake

    df = spark.createDataFrame([("a.docx", 1, text)], "name string, length long, text string")
    assert intake(df).first().reject_reason == reason


def test_blank_paragraphs_are_left_out(spark):
    from shroud.operators.redact import comparison_rows

    df = spark.createDataFrame([(1, "a\n\t\n \nb", "x\n\t\n \ny")], "doc_id long, text string, redacted_text string")
    assert [(r.side, r.para, r.line) for r in comparison_rows(df).orderBy("side", "para").collect()] == [("original", 0, "a"), ("original", 3, "b"), ("redacted", 0, "x"), ("redacted", 3, "y")]


def test_ipv6_beside_a_url_is_found(detect_texts):
    got = detect_texts(["see http://x.io/a then 2001:db8:0:0:0:0:0:1", "see http://x.io/a then 10.0.0.1"])
    assert [e.value for e in got[0] if e.type == "IP_ADDRESS"] == ["2001:db8:0:0:0:0:0:1"]
    assert [e.value for e in got[1] if e.type == "IP_ADDRESS"] == []


def test_overlaps_are_reported(spark):
    from shroud.operators.overlap import overlapping_pairs

    ents = spark.createDataFrame([(1, 0, 5, "A"), (1, 4, 8, "B"), (1, 8, 9, "C"), (2, 0, 3, "A")], "doc_id long, start int, end int, type string")
    assert [(r.doc_id, r.start) for r in overlapping_pairs(ents).collect()] == [(1, 4)]


def test_commit_drops_and_adds(spark):
    from shroud.operators.redact import commit

    ents = spark.createDataFrame([(0, 1, 0, 2, "XX"), (0, 2, 3, 5, "YY")], "doc_id long, id int, start int, end int, replacement string")
    edit = spark.createDataFrame([(0, 2, "Z")], "doc_id long, id int, replacement string")
    drop = spark.createDataFrame([(0, 1)], "doc_id long, id int")
    add = spark.createDataFrame([(0, 6, 9, "N")], "doc_id long, start int, end int, replacement string")
    assert commit(docs_of(spark, "Al Bo bye"), ents, edit, drop, add).first().redacted_text == "Al Z N"


def test_evaluation_counts_dossiers_only(spark):
    """Positions come from the labelled lines, pages are not counted, titled names are expected with their title."""
    from shroud.plans import catalog

    sf = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{sf}/customer.parquet").count()
    rows = {r.type: (r.tp, r.fp, r.fn) for r in catalog.QUERIES["EVAL-01"](spark, sf).collect()}
    assert rows["IP_ADDRESS"] == (3 * n, 0, 0) and rows["URL"] == (2 * n, 0, 0) and rows["SSN"] == (2 * n, 0, 0)
    assert rows["PERSON"][2] == 0


def test_building_a_query_starts_no_job(spark):
    from shroud.plans import catalog
    from shroud.plans.detect import detect

    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("build-only", "no job may start here")
    try:
        detect(catalog.S.corpus(spark, "/root/testdata/sf0.01").where("doc_id >= 0"))
        assert len(tracker.getJobIdsForGroup("build-only")) <= 4  # schema inference: one per table
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
