"""Candidates: what the texts are read for, and how the work is dealt out."""

import random
import re

from shroud.functions.literals import holds_any
from shroud.operators import recognizers
from shroud.plans.detect import event_specs, scored_candidates
from shroud.sources import docs as S

TEXT = "John Smith\n\nContact: Mary Jones\nPhone: (212) 555-0147\n\n\nssn 123456789 DOB: 1980-02-03\nby Acme Widgets Pvt Ltd.\n\nDr. Ann Lee Street\nserver 10.1.2.3"


def test_dossiers_are_dealt_out(spark, tmp_path):
    """A table of one split does not leave all dossiers to one task."""
    spark.createDataFrame([(i, "BUILDING") for i in range(1, 401)], "c_custkey long, c_mktsegment string").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(i, 1 + i % 300) for i in range(900)], "o_orderkey long, o_custkey long").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    d = S.dossiers(spark, str(tmp_path))
    held = [n for n in d.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
    assert sum(held) == 400 and len(held) >= 8 and max(held) < 200


def test_features_cost_nothing_unread(spark):
    docs = spark.createDataFrame([(1, TEXT)], "doc_id long, text string")
    places = recognizers.raw_candidates(docs, event_specs(None)).select("doc_id", "recognizer", "start", "end")
    plan = places._jdf.queryExecution().optimizedPlan().toString()
    assert "left30" not in plan and "ip_tail" not in plan
    bare = recognizers.raw_candidates(docs, [recognizers.Spec("_T", "token", r"\S+", 1.0)], with_header=False, features=False)
    assert "array_join" not in bare._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.start, r.end, r.value) for r in bare.collect()] == [(m.start(), m.end(), m.group()) for m in re.finditer(r"\S+", TEXT)]


def test_rows_equal_arrays(spark):
    """The windows of rows give the features that the array form cuts from the whole text."""
    rng = random.Random(6)
    lines = TEXT.split("\n") + ["", "x" * 300, "Größe Ltd — 😀", "a\x01b\x02 Foo Bar", "card 4111 1111 1111 1111", "born 3rd May 1990"]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randrange(0, 60)))) for i in range(60)] + [(90, None), (91, ""), (92, TEXT)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = recognizers.raw_candidates(docs, event_specs(None))
    want = recognizers.candidate_arrays(docs, event_specs(None)).selectExpr("doc_id", "inline(candidates)").select(*got.columns)
    key = lambda df: sorted(map(repr, df.collect()))
    assert key(got) == key(want) and got.count() > 500


def test_few_and_many_matches_alike(spark, monkeypatch):
    """Matches that take their text with them and those placed in arrays are the same, plain text or not."""
    rng = random.Random(11)
    lines = TEXT.split("\n") + ["", "Größe Ltd — 😀 ann@x.io", "a\x01b\x02 Foo Bar", "card 4111 1111 1111 1111", "By Acme Widgets Ltd", "PROJECTS", "see http://x.io/a 10.0.0.1"]
    rows = [(i, "\n".join(rng.choice(lines[: 12 if i % 2 else None]) for _ in range(rng.randrange(0, 40)))) for i in range(40)] + [(90, None), (91, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)

    def found(few, size):
        monkeypatch.setattr(recognizers, "FEW", few)
        monkeypatch.setattr(recognizers, "FEW_BYTES", size)
        return sorted(map(repr, recognizers.raw_candidates(docs, event_specs(None)).collect()))

    assert found(1000, 0) == found(0, -1) == found(2, 1000) and len(found(4, 32768)) > 500


def test_invalid_bytes_keep_their_places(spark):
    docs = spark.createDataFrame([(1, bytearray(b"x\xff\xfe ann@x.io 10.0.0.1"))], "doc_id long, b binary").selectExpr("doc_id", "CAST(b AS STRING) AS text")
    got = {r.type: (r.start, r.value) for r in recognizers.raw_candidates(docs, event_specs(None)).collect()}
    assert got["EMAIL"] == (4, "ann@x.io") and got["IP_ADDRESS"] == (13, "10.0.0.1")


def test_two_sweeps_by_document(spark):
    """Section and URL line are told by one order of a document's candidates."""
    plan = scored_candidates(spark.createDataFrame([(1, TEXT)], "doc_id long, text string"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") <= 4 and "left20" not in plan.split("Window [")[-1]


def test_one_pass_finds_any_word():
    rng = random.Random(7)
    for _ in range(500):
        words = ["".join(rng.choice("ab.-#") for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(2, 6))]
        text = "".join(rng.choice("ab.-# ") for _ in range(rng.randrange(0, 12)))
        assert bool(re.search(holds_any(words), text)) == any(w in text for w in words), (words, text)
