"""Whole results where a bound or a sample once cut them."""

import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from shroud.llm import decontam, extract, langid, toxicity
from shroud.llm.text import slices
from test_models import prose


def full_model(rows):
    """A plain model of all grams of the rows (lang, words)."""
    counts = {}
    for lang, tokens in rows:
        top = counts.setdefault(lang, {langid.ORDER: {}})[langid.ORDER]
        for w in tokens:
            padded = " " * (langid.ORDER - 1) + w + " "
            for i in range(langid.ORDER, len(padded) + 1):
                g = padded[i - langid.ORDER : i]
                top[g] = top.get(g, 0) + 1
    for by in counts.values():
        for k in range(langid.ORDER - 1, 0, -1):
            by[k] = {}
            for g in by[k + 1]:
                by[k][g[1:]] = by[k].get(g[1:], 0) + 1
    return langid.Model({x: {k: (list(c), np.array(list(c.values()))) for k, c in by.items()} for x, by in counts.items()})


@pytest.mark.parametrize("cells", [4, 2_000_000])
def test_rare_grams_of_a_large_language_count(spark, monkeypatch, cells):
    """1.5 million characters of two words, and a word that occurs once: whatever is cached, its grams are in the model."""
    monkeypatch.setattr(langid, "CACHE_CELLS", cells)
    rows = [("aa", ["abab", "cabd"] * 150_000), ("aa", ["xyzzy"]), ("bb", ["xyz", "abba", "yzz"])]
    train = spark.createDataFrame([(i, " ".join(w), x) for i, (x, w) in enumerate(rows)], "doc_id long, text string, lang string")
    texts = ["xyzzy xyzzy abab", "xyzzy xyzzy abab", "cabd yzzq", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.entropy for r in langid.identify(docs, langid.fit(train)).collect()}
    model = full_model(rows)
    for i, text in enumerate(texts):
        bits, n = model.bits([w.encode() for w in (text or "").split()])
        assert abs(got[i] - (bits.sum(axis=0).min() / n.sum() if text else 0)) < 1e-9


def test_rare_languages_have_limits(spark):
    """A language with one row, and one with a short row only, are calibrated with the pooled deviation."""
    rng = random.Random(3)
    rows = [(i, prose("aa", rng.randrange(10, 40), rng), "aa") for i in range(200)] + [(200, prose("bb", 30, rng), "bb"), (201, "ou eau", "cc")]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    fitted = langid.fit(train)
    own = {r.doc_id: r.entropy for r in langid.identify(train, fitted).collect()}
    first = [own[i] for i in range(200)]
    sigma = np.sqrt(200 * np.var(first) / 201)
    want = [np.mean(first) + 8 * np.std(first) + 1.5, own[200] + 8 * sigma + 1.5, (np.sum(first) + own[200]) / 201 + 8 * sigma + 1.5]
    assert np.allclose(fitted["limits"], want)
    docs = spark.createDataFrame([(1, prose("bb", 25, rng)), (2, "oueqxw zzkvq ouqqq " * 3)], "doc_id long, text string")
    assert {r.doc_id: r.accepted for r in langid.identify(docs, fitted).collect()}[2] is False


LONG = "Some running text of the article that goes on for a while. " * 6


def extracted(spark, *bodies):
    rows = [(i, f"http://h{i}.example/", f"<html><body>{b}</body></html>") for i, b in enumerate(bodies)]
    got = extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    return [r.text for r in sorted(got, key=lambda r: r.page_id)]


def test_the_whole_article_is_the_text(spark):
    """Blocks of the article that stand outside of its best container are part of it."""
    p = LONG.strip()
    got = extracted(
        spark,
        f'<article><h1>T</h1><div class="body"><p>{p}</p></div></article>',
        f"<article><h1>T</h1><p>Lead.</p><section><p>{p}</p></section><section><p>{p}</p></section></article><p>Other.</p>",
        f"<article><h1>T</h1><p>Lead.</p><table><tr><td>{p}</td><td>{p}</td></tr></table></article>",
        f'<div class="page"><div class="post"><h1>T</h1><div class="body"><p>{p}</p></div></div><div><a href="/">More of this</a></div></div>',
    )
    assert got == [f"T\n{p}", f"T\nLead.\n{p}\n{p}", f"T\nLead.\n{p}\n{p}", f"T\n{p}"]


@pytest.mark.parametrize("names", ["content no-sidebar", "has-sidebar", "with-banner", "side-by-side", "sticky-nav-page", "sidebar"])
def test_wrappers_named_like_boilerplate_keep_the_article(names):
    found = extract.blocks(f'<body><div class="{names}"><article><h1>T</h1><p>{LONG}</p></article></div><div class="related"><article>Other</article></div></body>')
    assert [text for _, text, _ in found] == ["T", LONG.strip()]
    if names != "sidebar":
        assert [text for _, text, _ in extract.blocks(f'<body><div class="{names}"><p>{LONG}</p></div></body>')] == [LONG.strip()]


def test_names_of_boilerplate():
    inside = "post-header entry-header header article-header"
    assert not any(extract.boilerplate(x, True) for x in inside.split()) and not extract.boilerplate("post-header", False)
    gone = "sidebar left-sidebar sidebar-left site-footer main-nav post-comments comments-12 cookie-banner ad-slot ad-300x250 share-buttons related-posts site-header header ad1 nav__links"
    assert [x for x in gone.split() if not extract.boilerplate(x, False)] == []
    page = f'<article><div class="entry-header"><h1>T</h1></div><p>{LONG}</p><div class="share-buttons"><p>Share</p></div><p>a <span class="ad">Buy</span> b</p></article><div id="comments"><article>Reader</article></div>'
    assert [text for _, text, _ in extract.blocks(page)] == ["T", LONG.strip(), "a b"]
    assert [text for _, text, _ in extract.blocks(f"<form><nav>Menu</nav><main><p>{LONG}</p></main></form>")] == [LONG.strip()]


def stemmed(endings, toxic, times):
    """Rows of ``toxic`` texts, each with one form of a stem, among clean ones."""
    rng = random.Random(4)
    forms = [prose("aa", 10, rng) + f" grumb{x} " + prose("aa", 10, rng) for x in endings for _ in range(times)]
    return [(text, toxic) for text in forms] + [(prose("aa", 20, rng), 0) for _ in range(100)]


def test_endings_are_counted_over_all_toxic_rows(spark):
    """A stem's endings in different splits count together; those in clean documents do not."""
    for rows, want in [(stemmed(["a", "le", "ing", "ed", "er", "y"], 1, 8), {"grum", "grumb"}), (stemmed(["a", "le"], 1, 100) + stemmed(["ing", "ed", "er", "y"], 0, 1), set())]:
        rows = list(enumerate(rows))
        docs = spark.createDataFrame([(i, t) for i, (t, _) in rows], "doc_id long, text string").repartition(len(rows))
        labels = spark.createDataFrame([(i, x) for i, (_, x) in rows], "doc_id long, toxic int")
        lexicon = toxicity.fit(docs, labels, toxicity.F.lit(True))["lexicon"]
        got = {"grumb"[: lexicon.depth[i]] for i, flag in enumerate(lexicon.stem) if flag}
        assert got == want


def test_short_terms_with_one_edit():
    """Transpositions are one edit; forms of clean documents and terms of three letters are not fuzzy."""
    lexicon = toxicity.Lexicon(["idiot", "moron", "trash", "scum", "stupid", "fig"], [])
    hits = ["idoit", "morron", "trassh", "scumm", "stpuid", "sutpid"]
    assert [lexicon.kind_of(x) for x in hits] == [toxicity.FUZZY] * len(hits)
    assert [lexicon.kind_of(x) for x in ["fog", "thrash3r", "gif", "idto"]] == [toxicity.NONE] * 4
    lexicon.excluded = frozenset(["scam", "scum"])
    assert lexicon.kind_of("scam") == toxicity.NONE and lexicon.kind_of("scum") == toxicity.EXACT


def test_clean_forms_near_a_term_are_no_hits(spark):
    rng = random.Random(8)
    rows = [(prose("aa", 12, rng) + f" {w} " + prose("aa", 12, rng), int(w == "trash")) for w in ["trash", "crash"] * 30]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, x) for i, (_, x) in enumerate(rows)], "doc_id long, toxic int")
    fitted = toxicity.fit(docs, labels, toxicity.F.lit(True))
    new = spark.createDataFrame([(1, "you trsah"), (2, "the crash"), (3, "you trash")], "doc_id long, text string")
    assert {r.doc_id: r.hits for r in toxicity.score(new, fitted).collect()} == {1: 1, 2: 0, 3: 1}


def test_one_row_of_each_kept_id(spark, tmp_path):
    a, b = "a text of more than five words stays here", "quite another text that nobody has copied at all"
    rows = [(1, a, "x"), (1, a, "x"), (1, a, None), (1, b, "x"), (2, a, "x"), (None, b, "x"), (None, b, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = [tuple(r) for r in corpus_pipeline.near_dedup(spark, docs, str(tmp_path)).collect()]
    assert [r for r in got if r[0] is not None] == [(1, a, None)] and got.count((None, b, "x")) in (0, 2)


@pytest.mark.parametrize("n", [*range(5, 13), 23, 24, 25])
def test_edited_copies_of_items_near_a_border(n):
    """A fifth of the words substituted: at least 99.5 % of 200 copies are found."""
    rng = random.Random(n)
    word = lambda: f"w{rng.randrange(5000)}"
    items = [[word() for _ in range(n)] for _ in range(10)]
    block = decontam.Items([(i, " ".join(x)) for i, x in enumerate(items)], 0.2)
    texts = []
    for c in range(200):
        x = list(items[c % 10])
        for p in rng.sample(range(n), n // 5):
            x[p] = word()
        texts.append(" ".join([word() for _ in range(30 + c % 7)] + x + [word() for _ in range(30)]))
    found = {(t.first + r[0]) for t in slices(pa.array(texts)) for r in block.search(t) if r[1] == (t.first + r[0]) % 10}
    assert len(found) >= 199
