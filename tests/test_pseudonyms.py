"""Pseudonymizer formats, consistency and the never-the-original rule."""

import re

import pytest

CASES = [
    ("PERSON", "John Doe", r"^\S+ \S+$"),
    ("PERSON", "John A. Smith", r"^.{4,}$"),
    ("EMAIL", "john@example.com", r"^[^@]+@[^@]+\.[a-z]+$"),
    ("PHONE", "(555) 867-5309", r"^\("),
    ("PHONE", "555-867-5309", r"-"),
    ("PHONE", "+1-800-555-0199", r"^\+"),
    ("PHONE", "080-2345-6789 ext. 214", r"^0\d\d-\d{4}-\d{4} ext\. \d{3}$"),
    ("SSN", "123-45-6789", r"^\d{3}-\d{2}-\d{4}$"),
    ("SSN", "123456789", r"^\d{9}$"),
    ("SSN", "1234 5678 9012", r"^\d{4} \d{4} \d{4}$"),
    ("CREDIT_CARD", "4111-1111-1111-1111", r"^4\d{3}-\d{4}-\d{4}-\d{4}$"),
    ("CREDIT_CARD", "4111 1111 1111 1111", r" "),
    ("DOB", "03/15/1990", r"^\d{2}/\d{2}/\d{4}$"),
    ("DOB", "07/22/1988", r"^\d{2}/\d{2}/\d{4}$"),
    ("DOB", "1990-03-15", r"^\d{4}-\d{2}-\d{2}$"),
    ("DOB", "January 15, 1990", r"(January|February|March|April|May|June|July|August|September|October|November|December)"),
    ("DOB", "14th March 1994", r"^\d{1,2}(st|nd|rd|th) [A-Z][a-z]+ \d{4}$"),
    ("DOB", "3rd Nov 2001", r"^\d{1,2}(st|nd|rd|th) [A-Z][a-z]{2} \d{4}$"),
    ("IP_ADDRESS", "192.168.1.1", r"^\d+\.\d+\.\d+\.\d+$"),
    ("IP_ADDRESS", "2001:0db8:85a3:0000:0000:8a2e:0370:7334", r":"),
    ("IP_ADDRESS", "8.8.8.8", r"^(192\.0\.2|198\.51\.100|203\.0\.113)\."),
    ("IP_ADDRESS", "175.109.153.17", r"^(192\.0\.2|198\.51\.100|203\.0\.113)\."),
    ("IP_ADDRESS", "10.0.4.19", r"^10\."),
    ("IP_ADDRESS", "172.16.0.1", r"^172\.(1[6-9]|2\d|3[01])\."),
    ("IP_ADDRESS", "192.168.1.100", r"^192\.168\."),
    ("COMPANY", "Acme Corp.", r"^\S+ \S+$"),
    ("ADDRESS", "123 Main Street, Springfield, IL 62704", r"."),
    ("ADDRESS", "P.O. Box 1234", r"P\.O\. Box"),
    ("URL", "github.com/someone", r"^github\.com/user\d{4}$"),
]


@pytest.fixture(scope="module")
def mapped(spark):
    from shroud.operators.pseudonyms import pseudonym_mapping

    rows = [(i, c[0], 0, c[1]) for i, c in enumerate(CASES)]
    rows.append((999, "PERSON", 5, "  JOHN DOE "))  # same normalized value in another document
    df = spark.createDataFrame(rows, "doc_id long, type string, start int, value string")
    return {(r.type, r.norm): r for r in pseudonym_mapping(df).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_format_and_differs(mapped, i):
    typ, orig, pat = CASES[i]
    r = mapped[(typ, orig.strip().lower())]
    assert re.search(pat, r.replacement), (orig, r.replacement)
    assert r.replacement != orig


def test_consistent_across_documents(mapped):
    r = mapped[("PERSON", "john doe")]
    assert r.occurrences == 2 and r.form == "John Doe"


def test_ordinal_dob_avoids_original_parts(mapped):
    r = mapped[("DOB", "14th march 1994")].replacement
    assert not any(p in r for p in ("14th", "March", "1994"))
    r = mapped[("DOB", "3rd nov 2001")].replacement
    assert "3rd" not in r and "2001" not in r


def test_unknown_type_counter(spark):
    from shroud.operators.pseudonyms import pseudonym_mapping

    df = spark.createDataFrame([(1, "BADGE", 0, "A-1"), (1, "BADGE", 9, "A-2"), (2, "BADGE", 0, "a-1")],
                               "doc_id long, type string, start int, value string")
    got = {r.norm: r.replacement for r in pseudonym_mapping(df).collect()}
    assert got == {"a-1": "[BADGE_1]", "a-2": "[BADGE_2]"}
