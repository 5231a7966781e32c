"""Detector cases (per-type, overlap invariant, edge cases, regressions, resume)."""

import re

import pytest

CASES = [
    # (text, type, op, n, value or None, min_conf)
    ("Contact me at john.doe@example.com for details.", "EMAIL", "=", 1, "john.doe@example.com", 0.95),
    ("Send to alice@test.org or bob.smith@company.co.uk", "EMAIL", "=", 2, None, 0),
    ("Use user+tag@gmail.com for filtering.", "EMAIL", "=", 1, "user+tag@gmail.com", 0),
    ("SSN: 123-45-6789", "SSN", "=", 1, "123-45-6789", 0),
    ("Number: 000-12-3456", "SSN", "=", 0, None, 0),
    ("The applicant's social security number is 456-78-9012.", "SSN", "=", 1, None, 0.90),
    ("Call (555) 867-5309 for info.", "PHONE", ">=", 1, None, 0),
    ("Phone: 555-123-4567", "PHONE", ">=", 1, None, 0),
    ("Reach us at +1-800-555-0199.", "PHONE", ">=", 1, None, 0),
    ("Card: 4111-1111-1111-1111", "CREDIT_CARD", ">=", 1, None, 0),
    ("Payment card 5500 0000 0000 0004", "CREDIT_CARD", ">=", 1, None, 0),
    ("Server IP: 192.168.1.100", "IP_ADDRESS", "=", 1, None, 0),
    ("Access from 255.255.255.255 detected.", "IP_ADDRESS", "=", 1, None, 0),
    ("Date of birth: 03/15/1990", "DOB", "=", 1, None, 0),
    ("Born: 1985-07-22", "DOB", "=", 1, None, 0),
    ("Birthday is January 15, 1990.", "DOB", "=", 1, None, 0),
    ("Located at 1234 Elm Street, Springfield, IL 62704", "ADDRESS", ">=", 1, None, 0),
    ("Mail to P.O. Box 1234", "ADDRESS", "=", 1, None, 0),
    ("Dr. Jane Smith reviewed the case.", "PERSON", ">=", 1, None, 0),
    ("Contact: John Doe", "PERSON", ">=", 1, None, 0),
    ("Working at Acme Corporation Inc.", "COMPANY", ">=", 1, None, 0),
    ("Filed by Smith & Associates LLC", "COMPANY", ">=", 1, None, 0),
    ("Office phone: 080-2345-6789 ext. 214", "PHONE", ">=", 1, None, 0),
    ("Tel: 044-2567-8901 x 100", "PHONE", ">=", 1, None, 0),
    ("Date of birth: 14th March 1994", "DOB", "=", 1, "14th March 1994", 0),
    ("Born on 3rd Nov 2001 in Mumbai.", "DOB", "=", 1, "3rd Nov 2001", 0),
    ("DOB: 07/22/1988", "DOB", "=", 1, "07/22/1988", 0),
    ("Meeting scheduled for 14 March 2026", "DOB", "=", 0, None, 0),
    ("Software version 91.211.49.166", "IP_ADDRESS", "=", 0, None, 0),
    ("Invoice 445566 and Case ID 342679081", "SSN", "=", 0, None, 0),
]


@pytest.fixture(scope="module")
def results(detect_texts):
    return detect_texts([c[0] for c in CASES])


@pytest.mark.parametrize("i", range(len(CASES)))
def test_case(results, i):
    text, typ, op, n, value, min_conf = CASES[i]
    found = [e for e in results[i] if e.type == typ]
    assert (len(found) == n) if op == "=" else (len(found) >= n), (text, found)
    if value is not None:
        assert found[0].value == value
    for e in found:
        assert e.confidence >= min_conf
        assert text[e.start:e.end] == e.value  # span verification


def test_no_overlaps_and_edges(detect_texts):
    texts = ["Dr. John Smith's SSN is 123-45-6789 and email is john@test.com", "",
             "The quick brown fox jumps over the lazy dog.",
             "Employee John Doe (john@acme.com, SSN 123-45-6789) works at Acme Corp. Phone: (555) 123-4567. "
             "DOB: 03/15/1990. IP: 10.0.0.1. CC: 4111-1111-1111-1111. Address: 123 Main Street, Anytown, CA 90210"]
    r = detect_texts(texts)
    for ents in r.values():
        spans = sorted((e.start, e.end) for e in ents)
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    assert r[1] == []
    assert all(e.confidence < 0.90 for e in r[2])
    types = {e.type for e in r[3]}
    assert {"EMAIL", "SSN", "PHONE", "IP_ADDRESS"} <= types


def test_regressions(detect_texts):
    texts = ["Employee Records\nKavya Nair\nSoftware Engineer\nImran Qureshi\nData Analyst\n",
             "Employed by Acme Technologies Pvt Ltd for 5 years.",
             "Vendor contract held with Sethand Associates LLP since 2020.",
             "Consulting engagement with Northfield Labs Inc began in Q3.",
             "Address: 221B Baker Street, London, NW1 6XE, United Kingdom",
             "Office phone: 080-2345-6789 ext. 214"]
    r = detect_texts(texts)
    persons = [e.value for e in r[0] if e.type == "PERSON"]
    assert "Kavya Nair" in persons and "Imran Qureshi" in persons
    for i, (bad, good) in enumerate([(["Employed"], "Acme"), (["Vendor", "contract"], "Sethand"),
                                     (["Consulting"], "Northfield")], start=1):
        comp = [e.value for e in r[i] if e.type == "COMPANY"]
        assert comp and good in comp[0] and not any(b in comp[0] for b in bad)
    addr = [e.value for e in r[4] if e.type == "ADDRESS"][0]
    assert "221B" in addr and "Baker Street" in addr and "NW1 6XE" in addr
    ph = [e.value for e in r[5] if e.type == "PHONE"][0]
    assert "ext" in ph and "214" in ph


def test_resume_exactly_five(detect_texts):
    resume = open(__file__.replace("test_detector.py", "resume.txt")).read()
    ents = detect_texts([resume])[0]
    types = [e.type for e in ents]
    assert len(ents) == 5, ents
    assert "PERSON" in types and "EMAIL" in types and "PHONE" in types and types.count("URL") == 2
    values = [e.value for e in ents]
    for jargon in ["Spring Boot", "Data Structures", "Computer Science", "Lovely Professional", "Government Junior"]:
        assert jargon not in values


def test_offsets_are_code_points(spark):
    from pyspark.sql import functions as F

    from shroud.functions.spans import find_spans
    from shroud import rules as R

    texts = ["é😀 a@b.cc\x01 c@d.ee", "x" * 3 + "😀😀 mail q@w.er end", "no match"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: [(s.start, s.end, s.value) for s in r.s]
           for r in df.select("doc_id", find_spans(F.col("text"), R.EMAIL).alias("s")).collect()}
    for i, t in enumerate(texts):
        exp = [(m.start(), m.end(), m.group()) for m in re.finditer(R.EMAIL, t.replace("\x01", " "))]
        assert got[i] == exp


def test_person_street_suffix_is_stripped(detect_texts):
    r = detect_texts(["Visit Dr. John Street today."])[0]
    assert [e.value for e in r if e.type == "PERSON"] == ["Dr. John"]


def test_hot_document_many_matches(spark):
    """One document holding 20,000 matches: offsets stay exact and the log-step prefix sum keeps
    the per-document cost near linear (a quadratic fold would take minutes here)."""
    import time

    from pyspark.sql import functions as F

    from shroud import rules as R
    from shroud.functions.spans import find_spans

    text = "é " + " ".join(f"user{i}@mail{i % 7}.example.com" for i in range(20000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    t0 = time.time()
    got = df.select(find_spans(F.col("text"), R.EMAIL).alias("s")).first().s
    elapsed = time.time() - t0
    exp = [(m.start(), m.end()) for m in re.finditer(R.EMAIL, text)]
    assert [(s.start, s.end) for s in got] == exp
    assert elapsed < 60


def test_ip_guards_and_sections(detect_texts):
    texts = ["see http://10.0.0.1/admin for the panel",
             "Server 10.0.0.2 is up",
             "release 1.2.3.4 shipped",
             "dev 10.0.0.3",  # 'v' ends a word but is not one
             "TECHNICAL SKILLS\nSpring Boot\nData Structures\n\nEXPERIENCE\nMaria Lopez\n"]
    r = detect_texts(texts)
    ips = lambda i: [e.value for e in r[i] if e.type == "IP_ADDRESS"]
    assert ips(0) == [] and ips(1) == ["10.0.0.2"] and ips(2) == [] and ips(3) == ["10.0.0.3"]
    persons = [e.value for e in r[4] if e.type == "PERSON"]
    assert persons == ["Maria Lopez"]  # skills lines are suppressed, EXPERIENCE is not


def test_external_candidates(spark):
    from shroud.plans.detect import scored_candidates

    docs = spark.createDataFrame([(1, "Patient born 12 May 1980 in Springfield. Meeting on 3 June 2020.\n\nSigned by Acme Holdings")],
                                 "doc_id long, text string")
    ext = spark.createDataFrame([(1, "DATE", 13, 24, 0.85), (1, "DATE", 52, 63, 0.85), (1, "LOCATION", 28, 39, 0.85),
                                 (1, "ORG", 76, 90, 0.85)],
                                "doc_id long, entity_type string, start int, end int, score double")
    rows = {(r.start, r.type): r for r in scored_candidates(docs, external=ext).filter("recognizer = 'external'").collect()}
    assert rows[(13, "DOB")].reject_reason is None and rows[(13, "DOB")].confidence == 0.90
    assert rows[(52, "DOB")].reject_reason == "no_birth_keyword"
    assert rows[(28, "LOCATION")].reject_reason == "location"
    assert rows[(76, "COMPANY")].value == "Acme Holdings"
