from shroud.llm import extract

FIELDS = "page_id long, url string, html string"


def texts(spark, rows):
    return {r.page_id: (r.text, r.n_chars) for r in extract.extract(spark.createDataFrame(rows, FIELDS)).collect()}


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>"; if (a<b) x()</script></head><body class="home">
<header><h1>Site</h1><nav><ul><li><a href="/a">Menu</a></li></ul></nav></header><div class="notice">Cookies!</div>
<div class="post-{n}"><div class="content c{n}"><h2>Title {n}</h2><p>First &amp; <b>bold</b>&nbsp;text,
with  space.<br>Next<p>Second &lt;para&gt; of some length so that it counts.</p><form><p>Sign up</p></form>
<ul><li>One<li>Two</ul><div class="ad">Buy</div><blockquote><p>Quote with a <a href="x>y">link</a>.</p></blockquote></div>
<div id="comments"><p>Reader comment that is very long indeed, longer than the article itself, on and on and on and on and on and on and on and on and on.</p></div></div>
<aside>Side</aside><footer>&copy; foot</footer></body></html>"""
TEXT = "Title {n}\nFirst & bold text, with space. Next\nSecond <para> of some length so that it counts.\nOne\nTwo\nQuote with a link."


def test_article_without_the_rest(spark):
    got = texts(spark, [(n, f"http://h.example/{n}", PAGE.format(n=n)) for n in range(5)])
    assert got == {n: (TEXT.format(n=n), len(TEXT.format(n=n))) for n in range(5)}


def test_host_agrees_on_a_path(spark):
    """A page whose own best container would be a list of teasers follows its host."""
    odd = '<html><body><div class="main"><p>Short.</p></div><div class="teasers"><p>' + "A teaser that is longer than the text. " * 5 + "</p></div></body></html>"
    usual = '<html><body><div class="main"><p>' + "The text of the page. " * 20 + '</p></div><div class="teasers"><p>Teaser.</p></div></body></html>'
    got = texts(spark, [(0, "http://h/0", odd), *((i, f"http://h/{i}", usual) for i in range(1, 5)), (9, "http://other/", odd)])
    assert got[0][0] == "Short." and got[1][0].startswith("The text") and "Teaser" not in got[1][0]
    assert got[9][0].startswith("A teaser")


def test_odd_rows(spark):
    rows = [(1, "http://a/", None), (2, "http://a/", ""), (3, None, "plain &eacute; text"), (4, "x", "<p>a<p>b"), (4, "x", "<p>a<p>b"), (None, "http://a/", "<article><p>q</article>"), (5, "http://b/", "<script>x"), (6, "http://c/", "<article>" + "<p>word word</p>" * 20000 + "</article>"), (7, "http://d/", "<article><h1>T</h1><p><b>T<br></article><footer>f"), (8, "http://e/", "a < b <!-- c"), (9, "http://f/", "</div></p>z<div")]
    got = extract.extract(spark.createDataFrame([(*r, "h", "p", "t") for r in rows], FIELDS + ", host string, path string, text string")).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert by[1].text == by[2].text == "" and by[1].n_chars == 0 and by[1].url == "http://a/"
    assert by[3].text == "plain é text" and by[4].text == "a\nb" and by[None].text == "q" and by[5].text == ""
    assert by[6].text == "\n".join(["word word"] * 20000) and by[7].text == "T\nT"
    assert by[8].text == "a < b" and by[9].text.startswith("z")


def test_many_hosts_are_joined(spark, monkeypatch):
    rows = [(n, f"http://h{n % 3}.example/{n}", PAGE.format(n=n)) for n in range(9)] + [(9, None, None)]
    want = texts(spark, rows)
    monkeypatch.setattr(extract, "HOSTS", 1)
    assert texts(spark, rows) == want


def test_empty_table(spark):
    assert extract.extract(spark.createDataFrame([], FIELDS)).collect() == []


def test_votes_are_by_generalised_path(spark):
    df = spark.createDataFrame([(n, f"http://H.example/{n}", PAGE.format(n=n)) for n in range(3)], FIELDS)
    assert [tuple(r) for r in extract.host_paths(df).collect()] == [("h.example", "html>body.home>div.post-N>div.cN.content", None)]


#: names of what is not the article, and of wrappers and parts that are
GONE = """comment-list commentlist comment-item reader-comment comment-thread responses alert-box site-notice notice-bar related-articles recommended
newsletter-signup share-this social-media nav-primary subscribe-now footer-bottom side-column adsbygoogle user-comments ad-container promo-banner
sidebar-left commentList ad ads advert-top cookie-consent-banner entry-footer sponsored-content related notice""".split()
STAYS = """no-sidebar has-sidebar with-banner side-by-side sticky-nav-page post-header entry-header commentary responsive ad-free lead address shadow
loading headline content-body download gallery radical social-security-act""".split()
BODY = [f"Sentence {i} of the article, which has some words." for i in range(12)]


def page(before="", inside="", after="", n=0):
    lines = [f"{x} {n}" for x in BODY]
    return f"<html><body>{before}<article><h1>Title {n}</h1>" + "".join(f"<p>{x}</p>" for x in lines[:6]) + inside + "".join(f"<p>{x}</p>" for x in lines[6:]) + f"</article>{after}</body></html>", "\n".join([f"Title {n}", *lines])


def test_names_inside_and_beside_the_article(spark):
    """Boilerplate by name goes wherever it stands; names that only look like it stay."""
    rows, want = [], {}
    for i, name in enumerate(GONE):
        for k, (tag, place) in enumerate([("div", "before"), ("div", "inside"), ("section", "after"), ("ul", "inside")]):
            item = "li" if tag == "ul" else "p"
            block = f'<{tag} class="x1 {name}"><{item}>Words of {name} that are not the article at all, quite a few of them.</{item}></{tag}>'
            html, text = page(**{place: block}, n=i)
            rows.append((i * 4 + k, f"http://{i}-{k}.example/", html))
            want[i * 4 + k] = text
    for i, name in enumerate(STAYS):
        html, text = page(n=i)
        html = html.replace("<article>", f'<div class="{name}"><article>').replace("</article>", "</article></div>")
        rows.append((1000 + i, f"http://w{i}.example/", html))
        want[1000 + i] = text
        html, text = page(inside=f'<div class="{name}"><p>Part {name}</p></div>', n=i)
        rows.append((2000 + i, f"http://p{i}.example/", html))
        lines = text.split("\n")
        want[2000 + i] = "\n".join([*lines[:7], f"Part {name}", *lines[7:]])
    got = {i: t for i, (t, _) in texts(spark, rows).items()}
    assert {i: got[i] for i in want if got[i] != want[i]} == {}


def test_comment_articles_never_win(spark):
    comment = '<article class="comment"><p>' + "A reader's comment, longer than the article. " * 40 + "</p></article>"
    cases = {1: page(before=comment), 2: page(before=f'<div id="comments">{comment.replace(" class=", " data-x=")}</div>'), 3: page(inside=comment), 4: page(after=comment * 3)}
    got = texts(spark, [(i, f"http://{i}.example/", html) for i, (html, _) in cases.items()])
    assert {i: t for i, (t, _) in got.items()} == {i: text for i, (_, text) in cases.items()}
    # the only article stands in a box with such a name: it is the article
    only = '<div class="widget-area"><article><p>The only text of this page.</p></article></div>'
    assert texts(spark, [(1, "http://x/", only)])[1][0] == "The only text of this page."


def test_hidden_elements(spark):
    hidden = ['<div hidden><p>H</p></div>', '<p style="color:red; display : none">H</p>', "<section style='visibility:hidden'><p>H</p></section>", '<div hidden="until-found"><p>H</p></div>']
    seen = ['<p title="a hidden thing">S</p>', '<p class="hidden-gem">S</p>', '<p data-hidden="no">S</p>', '<p style="display:block">S</p>']
    got = texts(spark, [(i, f"http://{i}.example/", page(inside=x)[0]) for i, x in enumerate(hidden + seen)])
    assert ["H" in got[i][0].split("\n") for i in range(4)] == [False] * 4 and all("S" in got[4 + i][0].split("\n") for i in range(4))


def test_the_host_votes_on_what_repeats(spark):
    """A box without a telling name and with one text on many pages goes; copies of one page are one vote; other hosts keep theirs."""
    box = '<div class="zq"><p>Join our readers and get the best of it every week.</p></div>'
    rows = [(i, f"http://h.example/{i}", page(inside=box, n=i)[0]) for i in range(12)]
    rows += [(100 + i, f"http://copies.example/{i}", page(inside=box, n=1)[0]) for i in range(20)]
    rows += [(200 + i, f"http://own.example/{i}", page(inside=f'<div class="zq"><p>Box {i} of its own.</p></div>', n=i)[0]) for i in range(12)]
    got = texts(spark, rows)
    assert all(got[i][0] == page(n=i)[1] for i in range(12))
    assert all("Join our readers" in got[100 + i][0] for i in range(20))
    assert all(f"Box {i} of its own." in got[200 + i][0] for i in range(12))


def plain(html):
    """The article by plain string cutting, for pages with one article and no names inside it."""
    import html as entities
    import re

    found = re.search(r"<article[^>]*>(.*?)</article>", html or "", re.S)
    if not found:
        return None
    parts = re.split(r"</?(?:p|h\d|div|ul|ol|li|blockquote|section|table|tr|td)\b[^>]*>", re.sub(r"<!--.*?-->", "", found[1], flags=re.S))
    parts = [re.sub(r"\s+", " ", entities.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br\s*/?>", " ", x)))).strip() for x in parts]
    return "\n".join(x for x in parts if x)


def test_a_plain_extractor_agrees_on_all_given_pages(spark):
    sf = "/root/testdata/sf0.01"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    from shroud.llm import queries

    got = {r.page_id: (r.text, r.n_chars) for r in queries.op8_extract(spark, sf).collect()}
    want = {i: plain(h) for i, h in pages.items()}
    assert None not in want.values()
    assert got == {i: (t, len(t)) for i, t in want.items()}
