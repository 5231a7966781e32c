"""Required literals of patterns, and many recognizers on texts that few of them match."""

import random
import re
import time

from shroud.functions.literals import finder, led, required, witnesses


def test_required_literals():
    cases = {
        r"\bInvoice \d+": {"Invoice "}, r"(?<pre>\bInvoice )(?<val>\d+)": {"Invoice "}, r"(?:alpha|beta)-\d+": {"alpha", "beta"},
        r"(?i)Case No\. \d+": {"case no. "}, r"\d{3}-\d{4}": None, r"(?:abc)?\d+": None, r"(?:abc)+x": {"abc"}, r"ab": None, r"(?:alpha|b)\d": None,
        r"EMP-\d+-CODE": {"-CODE"}, r"\p{Lu}abc": None, r"x[ab]cdef": {"cdef"}, r"(?:abc|abd)?e": None, r"pre(?=fix)": {"pre"}, r"(?i:abc)def": {"def"},
        r"[a-z&&[^b]]Foo": None, r"abc\\vdef": None, r"(?x) a b c d": None, r"[[a-c]x]Foo": None,
    }
    for pattern, want in cases.items():
        found = required(pattern)
        assert (set(found[0]) if found else None) == want, (pattern, found)
    assert required(r"(?i)Case No\. \d+")[1] and not required(r"\bInvoice \d+")[1]


def test_the_finder_sees_every_literal():
    rng = random.Random(3)
    for _ in range(300):
        literals = {"".join(rng.choice("ab-.") for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(1, 7))}
        text = "".join(rng.choice("ab-. ") for _ in range(rng.randrange(0, 30)))
        seen = {m for m in re.findall(finder(literals), text) if m}
        for x in literals:
            assert (x in text) == any(w in seen for w in witnesses(frozenset([x]), literals)), (literals, text)


def test_led_patterns_match_alike():
    """A look-ahead for the first character changes no match; a first character that is not sure leaves the pattern."""
    rng = random.Random(8)
    sure = [r"(?<!\d)(?:\+?1[\s\-.]?)?\(?\d{2}", r"\b4\d", r"(?i)(?:ab|c)d?", r"(?:a?|b)c", r"(?:\(?0?\)?[\s\-.]?)?[6-9]\d", r"(?=x)ab|4", r"a*b"]
    for pattern in sure:
        assert led(pattern) != pattern
        for _ in range(200):
            text = "".join(rng.choice("abcdABx 0146-.+()\n") for _ in range(rng.randrange(0, 40)))
            assert [m.span() for m in re.finditer(pattern, text)] == [m.span() for m in re.finditer(led(pattern).replace("(?:(?i)", "(?i:"), text)], (pattern, text)
    for pattern in ["", "a*", r"a|.b", r"[^a]b", r"(?iu)ka", r"(?i:a)b", r"^a", r"[a-z]b", r"(?!x)", r"\wa", "é", r"\p{Lu}a", r"(?U)\da"]:
        assert led(pattern) == pattern, pattern


def _specs(n):
    from shroud.operators.recognizers import Spec

    return [Spec(f"T{i}", f"r{i}", rf"(?:\\bRecord{i}|\\bEntry{i}) ?[A-Z]{{2}}[a-z0-9]+-\\d+\\b".replace("\\\\", "\\"), 0.9) for i in range(n)]


def test_candidates_are_the_same_with_and_without(spark, monkeypatch):
    from shroud.operators import recognizers

    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["text", f"Record{rng.randrange(30)} ABc-12", f"Entry{rng.randrange(30)}XYz9-7", "Recor", "entry3 ABc-1"]) for _ in range(30))) for i in range(120)] + [(900, None), (901, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    specs = _specs(20) + [recognizers.Spec("CASE", "case", r"(?i)\bentry\d+ [a-z]+-\d", 0.9)]
    get = lambda: sorted(tuple(r) for r in recognizers.raw_candidates(docs, specs, with_header=False).select("doc_id", "type", "start", "end", "value").collect())
    got = get()
    monkeypatch.setattr(recognizers, "required", lambda pattern: None)
    assert got == get() and len(got) > 500 and any(r[1] == "CASE" for r in got)


def test_many_recognizers_on_text_without_hits(spark):
    """200 recognizers cost less than three times 20."""
    from shroud.operators.recognizers import raw_candidates

    rng = random.Random(5)
    words = ["the", "Report", "record", "of", "entry", "Reading", "value", "and", "Ending", "in"]
    texts = [" ".join(rng.choice(words) for _ in range(20_000)) for _ in range(16)]
    docs = spark.createDataFrame([(i, texts[i % 16]) for i in range(256)], "doc_id long, text string").repartition(8)  # the texts outweigh the planning
    docs = docs.cache()
    docs.count()

    def cost(n):
        found = raw_candidates(docs, _specs(n), with_header=False)
        best = 1e9
        for _ in range(3):
            started = time.time()
            assert found.count() == 0
            best = min(best, time.time() - started)
        return best

    few, many = cost(20), cost(200)
    docs.unpersist()
    assert many < 3 * few + 0.5, (few, many)
