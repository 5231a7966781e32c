"""The registered queries of the fitted operators: their columns, held-out rows and predictions."""

import zlib

import pytest

from shroud.llm import langid, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name,modulus,remainder", [("op1_quality", 5, 0), ("op7_toxicity", 4, 2), ("op10_langid", 4, 2)])
def test_fitted_queries(spark, name, modulus, remainder):
    rows = queries.QUERIES[name](spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == remainder) and 0 <= r.score <= 1
    if name == "op10_langid":
        lang, text = {r.doc_id: r.lang for r in docs}, {r.doc_id: r.text for r in docs}
        assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in text[r.doc_id] or "")) for r in rows)
        held = [r for r in rows if r.held_out and r.lang_pred != "und" and lang[r.doc_id]]
        assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.9 * len(held)
    else:
        assert all(r.predicted == int(r.score >= 0.3) for r in rows)


def test_decontamination_query(spark):
    """Every item that stands word for word in a document is found there."""
    words = lambda t: " ".join("".join(c if c.isalnum() else " " for c in (t or "").lower()).split())
    docs = {r.doc_id: f" {words(r.text)} " for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = {r.item_id: words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    got = {(r.doc_id, r.item_id) for r in queries.op3_decontam(spark, SF).collect()}
    assert {(d, i) for d, t in docs.items() for i, x in items.items() if x and f" {x} " in t} <= got


def test_language_keeps_the_text(spark):
    """The text may be among the kept columns."""
    docs = spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "der Hund und die Katze", "de"), (3, None, "en")] * 12, "doc_id long, text string, lang string")
    fitted = langid.fit(docs)
    rows = langid.identify(docs, fitted, keep=("doc_id", "text")).collect()
    assert {(r.doc_id, r.text, r.lang_pred) for r in rows} == {(1, "the cat and the dog", "en"), (2, "der Hund und die Katze", "de"), (3, None, "und")}
