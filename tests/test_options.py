"""Options of the detection, and the two forms of a rule that has two."""

import random

from pyspark.sql import functions as F


def _found(spark, text, **options):
    from shroud.plans.detect import detect

    return {(r.type, r.value) for r in detect(spark.createDataFrame([(1, text)], "doc_id long, text string"), **options).collect()}


def test_protect_only_types(spark):
    """Types that only protect are no entities, and what overlaps them still is none."""
    text = "Docs at https://example.org/a and mail ann@corp.example"
    urls = {x for x in _found(spark, text) if x[0] == "URL"}
    assert urls
    kept = _found(spark, text, protect_only_types=("URL",))
    assert kept == _found(spark, text) - urls and any(t == "EMAIL" for t, _ in kept)


def test_whole_word_denylist(spark):
    """A denied word inside a longer one rejects a name by default, and only as a whole word with the option."""
    from shroud import rules as R

    word = next(w for w in R.TECH_DENYLIST if w.isalpha() and len(w) >= 4)
    inside, alone = f"Name: Ann {word.capitalize()}son", f"Name: Ann {word.capitalize()}"
    person = lambda text, **o: any(t == "PERSON" for t, _ in _found(spark, f"Notes of the day\n\n{text}\n", **o))
    assert not person(inside) and person(inside, whole_word_denylist=True)
    assert not person(alone) and not person(alone, whole_word_denylist=True)


def test_both_forms_of_the_checksum_agree(spark):
    from shroud.functions.spans import luhn_ok
    from shroud.operators.recognizers import luhn_sql

    rng = random.Random(1)
    values = ["", "4111 1111 1111 1111", "4111-1111-1111-1112", "0" * 13, "1" * 20] + ["".join(rng.choice("0123456789 -") for _ in range(rng.randrange(10, 26))) for _ in range(500)]
    rows = spark.createDataFrame([(v,) for v in values], "v string").select(luhn_ok(F.col("v")).alias("a"), F.expr(luhn_sql("v")).alias("b")).collect()
    assert all(r.a == r.b for r in rows) and sum(r.a for r in rows) > 10
