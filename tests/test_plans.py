"""Plan-shape checks: no forked recomputation, partial aggregation for hot keys."""

import re

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_detection_scans_each_table_once(spark):
    from shroud.plans.catalog import corpus
    from shroud.plans.detect import detect

    plan = _plan(detect(corpus(spark, SF)))
    # documents, pages, customer, orders: one scan each -- the regex stage is never forked
    assert plan.count("FileScan parquet") == 4, plan


def test_hot_value_is_one_mapping_row(spark):
    from pyspark.sql import functions as F

    from shroud.operators.pseudonyms import pseudonym_mapping, pseudonymize

    ents = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("PERSON").alias("type"),
                                    F.lit(0).alias("start"),
                                    F.when(F.col("id") % 2 == 0, "John Doe").otherwise(" JOHN DOE ").alias("value"))
    m = pseudonym_mapping(ents, unknown="hash")
    plan = _plan(m)
    assert "partial_count" in plan and "partial_min_by" in plan  # map-side combine before the shuffle
    rows = m.collect()
    assert len(rows) == 1 and rows[0].occurrences == 5000 and rows[0].form == "John Doe"
    assert pseudonymize(ents).select("replacement").distinct().count() == 1


def test_detection_has_one_doc_id_shuffle(spark):
    """All sweeps, the dedupe window and the overlap fold reuse one hash partitioning by doc_id."""
    from shroud.plans.catalog import corpus
    from shroud.plans.detect import detect

    plan = _plan(detect(corpus(spark, SF)))
    exchanges = re.findall(r"Exchange hashpartitioning\((\w+)#", plan)
    assert exchanges.count("doc_id") == 1, exchanges


def test_mapping_runs_the_detection_once(spark):
    from shroud.operators.pseudonyms import pseudonym_mapping
    from shroud.plans.catalog import corpus
    from shroud.plans.detect import detect

    plan = _plan(pseudonym_mapping(detect(corpus(spark, SF)), unknown="hash"))
    assert plan.count("FileScan parquet") == 4, plan
    # numbering counts the values twice: they are checkpointed, so the detection still runs once
    assert "FileScan parquet" not in _plan(pseudonym_mapping(detect(corpus(spark, SF))))


def test_unknown_types_are_numbered_by_first_appearance(spark):
    from shroud.operators.pseudonyms import pseudonymize

    rows = [(2, "CODE", 5, "b"), (1, "CODE", 9, "a"), (1, "CODE", 0, "c"), (3, "CODE", 0, "A "), (1, "TAG", 3, "a")]
    got = {(r.doc_id, r.type, r.value): r.replacement
           for r in pseudonymize(spark.createDataFrame(rows, "doc_id long, type string, start int, value string")).collect()}
    assert got == {(1, "CODE", "c"): "[CODE_1]", (1, "CODE", "a"): "[CODE_2]", (3, "CODE", "A "): "[CODE_2]",
                   (2, "CODE", "b"): "[CODE_3]", (1, "TAG", "a"): "[TAG_1]"}


def test_numbers_equal_one_ordered_window(spark):
    """Ranges of ids, negative and null ids, equal places: the same numbers as a dense rank over the whole type."""
    import random

    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from shroud.operators.pseudonyms import numbers, pseudonym_mapping

    rng = random.Random(4)
    ids = [None, -1, 0, 1, 65535, 65536, 65537, -65536, -65537, 2**31, 2**32, 2**47, 2**48, -2**48, 2**62, 2**63 - 1, -2**63, *range(100, 160)]
    rows = [(rng.choice("AB"), rng.choice(ids), rng.randrange(4)) for _ in range(600)]
    seen = spark.createDataFrame(rows, "type string, doc_id long, start int")
    w = Window.partitionBy("type").orderBy("doc_id", "start")
    want = seen.distinct().withColumn("number", F.dense_rank().over(w).cast("bigint"))
    key = lambda r: tuple(str(x) for x in r)
    got = sorted(map(tuple, numbers(seen).collect()), key=key)
    assert got == sorted(map(tuple, want.collect()), key=key)
    assert numbers(seen.limit(0)).count() == 0
    # the mapping over them: values seen at one place share a number, known types have none
    ents = spark.createDataFrame([(d, t, s, f"{t}{d}{s}") for t, d, s in rows] + [(5, "PERSON", 0, "Ann Lee")], "doc_id long, type string, start int, value string")
    m = pseudonym_mapping(ents)
    plan = _plan(m)
    windows = re.findall(r"windowspecdefinition\(type#\d+, (\w+)#", plan)
    assert "_doc" in windows and "_above" in windows and windows.count("_range") == 1, windows  # _range: two rows a type, by sign
    numbered = {(r.type, r.form): r.replacement for r in m.collect()}
    assert numbered.pop(("PERSON", "Ann Lee")) not in ("Ann Lee", None)
    rank = {(r[0], f"{r[0]}{r[1]}{r[2]}"): f"[{r[0]}_{r[3]}]" for r in got}
    assert numbered == rank


def test_hashed_names_need_no_other_row(spark):
    """unknown="hash": one value has one name whatever else there is; no window, no second pass."""
    from shroud.operators.pseudonyms import pseudonym_mapping

    one = spark.createDataFrame([(1, "CODE", 0, "ab-1")], "doc_id long, type string, start int, value string")
    two = spark.createDataFrame([(9, "CODE", 4, " AB-1"), (2, "CODE", 0, "zz")], "doc_id long, type string, start int, value string")
    a, b = pseudonym_mapping(one, unknown="hash"), pseudonym_mapping(two, unknown="hash")
    assert "Window" not in _plan(a)
    names = {r.norm: r.replacement for r in b.collect()}
    assert a.first().replacement == names["ab-1"] != names["zz"] and names["zz"].startswith("[CODE_")
