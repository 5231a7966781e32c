"""The stages in order on a small corpus, each against a plain restatement; null and empty inputs."""

import random

import pytest

import corpus_pipeline
from shroud.llm import decontam, queries
from test_minhash import brute
from test_models import INSULTS, prose

FIELDS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Planted: odd, foreign, toxic, copied and leaked documents among clean ones."""
    rng = random.Random(21)
    folder = str(tmp_path_factory.mktemp("corpus"))
    rows, labels, kind = [], [], {}

    def add(text, lang, what):
        kind[len(rows)] = what
        rows.append((len(rows), text, lang, "s", len(text or "")))
        if what in ("clean", "toxic"):
            labels.append((len(rows) - 1, 1, int(what == "toxic")))

    items = [(i, prose("aa", 25, rng)) for i in range(5)]
    for i in range(240):
        add(prose(rng.choice(["aa", "bb"]), rng.randrange(40, 120), rng), "aa" if i % 2 else None, "clean")
        rows[-1] = (*rows[-1][:2], "bb" if any(s in rows[-1][1] for s in ("sch", "ä")) else "aa", *rows[-1][3:])
    for _ in range(80):
        w = prose("aa", 60, rng).split()
        for _ in range(3):
            w[rng.randrange(len(w))] = rng.choice(INSULTS)
        add(" ".join(w), "aa", "toxic")
    for text in (None, "", " \n", "12 34 ...", "ЖЩЫ ЪЭЮ ФЦЧ ШЩЪ ЫЬЭ ЖЖЖ ЩЩЖ"):
        add(text, None, "odd")
    for i in range(20):
        w = rows[i][1].split()
        w[-1] = "changed"
        add(" ".join(w) if i % 2 else rows[i][1], "aa", "copy")
    for i, text in items:
        add(prose("aa", 30, rng) + " " + text + " " + prose("aa", 30, rng), "aa", "leak")
    spark.createDataFrame(rows, FIELDS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, {r[0]: r[1] for r in rows}, kind, items


def test_stages(spark, corpus):
    folder, texts, kind, items = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    fields, kept = docs.columns, set(texts)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), FIELDS)
        assert docs.columns == fields
        left = {r.doc_id for r in docs.collect()}
        gone = kept - left
        if name == "language":
            assert gone == {i for i, k in kind.items() if k == "odd"}
        elif name == "toxicity":
            assert gone == {i for i, k in kind.items() if k == "toxic"}
        elif name == "near_dedup":
            assert left == {i for i, (_, c) in brute([(i, texts[i]) for i in kept], 80).items() if i == c}
            assert {i for i, k in kind.items() if k == "copy"} == gone
        else:
            assert gone == {i for i, k in kind.items() if k == "leak"}
        kept = left
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert {r.doc_id for r in pieces} == kept == {i for i, k in kind.items() if k == "clean"}
    ran = corpus_pipeline.run(spark, folder)
    assert {r.doc_id for r in ran.select("doc_id").distinct().collect()} == kept
    assert ran.agg({"length": "sum"}).first()[0] == sum(r.length for r in pieces)


def test_the_leak_stage_uses_the_operator(spark, corpus):
    folder, texts, kind, items = corpus
    found = decontam.matches(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")).collect()
    assert {r.doc_id for r in found} == {i for i, k in kind.items() if k == "leak"}


def test_nulls_and_empty_tables(spark, corpus, odd, none):
    folder = corpus[0]
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, odd, folder).collect()
        assert stage(spark, none, folder).collect() == []


def test_null_ids_pass_the_dedup(spark, corpus):
    text = "a text of more than five words stays here"
    docs = spark.createDataFrame([(None, text), (2, text), (1, text), (None, None)], "doc_id long, text string")
    assert sorted((r.doc_id or 0 for r in corpus_pipeline.near_dedup(spark, docs, corpus[0]).collect())) == [0, 0, 1]


def test_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert set(queries.QUERIES) | {"pipeline"} <= set(names) and set(queries.ORACLE) <= set(entry.oracle_sql())
