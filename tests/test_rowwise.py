"""The row-local plan equals the window plan, needs no exchange, and streams with stable names."""

import random
import time

SF = "/root/testdata/sf0.001"
COLS = ["id", "type", "start", "end", "value", "confidence", "context", "recognizer"]


def _arrays(df):
    rows = df.select("doc_id", "entities").collect()
    return sorted((r.doc_id, *[e[c] for c in COLS]) for r in rows for e in r.entities)


def _windows(df):
    return sorted(tuple(r) for r in df.select("doc_id", *COLS).collect())


def test_equals_the_window_plan(spark):
    from shroud.plans import catalog, detect, rowwise
    from shroud.sources import docs as S

    sample = S.dossiers(spark, SF).unionByName(S.pages(spark, SF)).unionByName(S.read_docs(spark, f"{SF}/documents.parquet"))
    docs = spark.createDataFrame(sample.collect(), "doc_id long, text string").repartition(8)
    assert _arrays(rowwise.entity_arrays(docs)) == _windows(detect.detect(docs))
    assert _windows(catalog.entities(spark, SF))


def test_equals_the_window_plan_on_odd_texts(spark):
    """Shuffled lines of dossiers: overlapping, repeated and cut spans in any order; null and empty texts."""
    from shroud.plans import detect, rowwise
    from shroud.sources import docs as S

    rng = random.Random(9)
    lines = [x for r in S.dossiers(spark, SF).limit(60).collect() for x in r.text.split("\n")]
    extra = ["John Smith", "SKILLS", "EDUCATION", "", "  ", "see http://10.1.2.3/x 10.1.2.3", "a@b.co a@b.co", "Dr. Ann Lee Street", "14th March 1980 born", "Acme Ltd and Acme Ltd"]
    rows = [(i, "\n".join(rng.choice(lines + extra * 8) for _ in range(rng.randrange(0, 30)))) for i in range(250)] + [(900, None), (901, ""), (None, "Mail a@b.co")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got, want = _arrays(rowwise.entity_arrays(docs.where("doc_id is not null"))), _windows(detect.detect(docs.where("doc_id is not null")))
    assert got == want and len(want) > 1000
    out = {r.doc_id: r for r in rowwise.redacted(docs).collect()}
    assert out[900].total_entities == 0 and out[900].redacted_text is None and out[901].redacted_text == "" and out[None].total_entities == 1


def test_no_exchange(spark):
    from shroud.streaming.stream import redacted_stream

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    plan = redacted_stream(docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Exchange", "Window", "Join", "Aggregate(", "HashAggregate", "Python"))


def test_a_long_document_costs_its_length(spark):
    from shroud.plans import rowwise
    from shroud.sources import docs as S

    text = "\n\n".join(r.text for r in S.dossiers(spark, SF).limit(100).collect())

    def cost(times):
        docs = spark.createDataFrame([(1, "\n".join([text] * times))], "doc_id long, text string").coalesce(1)
        started = time.time()
        n = rowwise.redacted(docs).first().total_entities
        return n, time.time() - started

    cost(1)
    (few, short), (many, long_) = cost(2), cost(8)
    assert many > 3.5 * few and long_ < 8 * short + 5


def test_stream_over_batches_and_a_restart(spark, tmp_path):
    """One value has one name in two micro-batches and after a restart; every document comes out once."""
    from shroud.streaming.stream import DOC_SCHEMA, start

    def put(name, rows):
        frame = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOC_SCHEMA)
        frame.coalesce(1).write.parquet(str(tmp_path / "in" / name))

    def run():
        start(spark, str(tmp_path / "in" / "*"), str(tmp_path / "out"), str(tmp_path / "ck"), max_files=1).awaitTermination()
        return {r.doc_id: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}, spark.read.parquet(str(tmp_path / "out")).count()

    put("a", [(1, "Mail ann.lee@corp.example or call (555) 867-5309"), (2, "plain")])
    put("b", [(3, "Again: ann.lee@corp.example, (555) 867-5309.")])
    first, n = run()
    assert n == 3 and first[1].total_entities == 2 and first[2].redacted_text == "plain"
    put("c", [(4, "ann.lee@corp.example"), (5, "ANN.LEE@corp.example")])
    again, n = run()
    assert n == 5 and {k: again[k].redacted_text for k in (1, 2, 3)} == {k: first[k].redacted_text for k in (1, 2, 3)}
    name = again[4].redacted_text
    assert name != "ann.lee@corp.example" and name in again[1].redacted_text and name in again[3].redacted_text and again[5].redacted_text == name
