from shroud.llm import queries, urls


def verdicts(spark, pages, **kw):
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(pages)], "page_id long, url string, host string, rule string")
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(df, queries.URL_RULES, **kw).collect()}


def test_hosts_paths_and_rules(spark):
    got = verdicts(spark, [
        "http://Example.NET/en/x?q#f", "https://a.example.net/fr/", "http://example.net", "http://example.net?x=/en/", "http://badexample.net/en/", "http://www.example.com/de/1", "http://x.org/fr/casino", "http://x.org/casino",
        None, "no scheme", "://", "a://b://c/d", "http://example.net/EN/", "ftp://net/x", "http://ÀB.com/p"])
    assert got == {
        0: ("example.net", "/en/x", "example.net/en/", "allow"), 1: ("a.example.net", "/fr/", "net/", "block"), 2: ("example.net", "", None, "allow"), 3: ("example.net", "", None, "allow"),
        4: ("badexample.net", "/en/", "net/", "block"), 5: ("www.example.com", "/de/1", "example.com/de/", "block"), 6: ("x.org", "/fr/casino", "org/fr/", "allow"), 7: ("x.org", "/casino", None, "block"),
        8: ("", "", None, "allow"), 9: ("", "", None, "allow"), 10: ("", "", None, "allow"), 11: ("b:", "//c/d", None, "allow"), 12: ("example.net", "/EN/", "net/", "block"), 13: ("net", "/x", "net/", "block"), 14: ("Àb.com", "/p", None, "allow")}


def test_vocabulary(spark):
    got = verdicts(spark, ["http://cheap-pills.com/", "http://spills.com/", "http://pills2.com/", "http://free.com/free", "http://free-bets.com/", "http://free.com/CHEAP/", "http://x.com/" + "a/" * 20000 + "casino", "http://pills"])
    assert [got[i][3] for i in range(8)] == ["block", "allow", "allow", "allow", "block", "block", "block", "block"]


def test_automaton_equals_plain_search():
    import random
    import re

    rng = random.Random(1)
    machine = urls.automaton()
    terms = sorted({*urls.STRICT, *urls.SOFT})
    for _ in range(300):
        place = "".join(rng.choice(["-", ".", "/", "a", "x", "é", *terms]) for _ in range(rng.randrange(12)))
        want = {t for t in terms if re.search(rf"(?<![^\W_]){t}(?![^\W_])", place)}
        assert set(urls.weigh(machine, place)) == want


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "http://a.net/"), (1, "http://a.net/"), (None, None)], "page_id long, url string")
    assert urls.judge(df, queries.URL_RULES).count() == 3
    assert urls.judge(df.limit(0), queries.URL_RULES).collect() == []
