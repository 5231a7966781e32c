"""Main text of web pages by consensus host paths.

1. Every page's containers are scored: the length of the running text in their own paragraphs, less
   what stands in links. A container's path is generalised: tag and class names from the root, digits
   in names written as N.
2. The pages of a host vote in Spark for the paths of their best containers, weighted by score, and for what
   is the same everywhere: a path whose elements show one of few texts on ``PAGES`` different pages and more is
   no article (equal pages count once). Partial aggregates keep a host with many pages cheap.
3. Pages are read again with the host's paths. Elements of a path that repeats its text are left out, unless they
   hold the article. A container may be a part of the article (its body, a
   section, a cell), so the text is that of the outermost article or main around it; without one, of the
   widest element below the body that adds no block made of links. A page without that path uses its own
   best container.

A text is the blocks of the element in page order, joined by a line feed; in a block, character
references are decoded and runs of white space become one blank. Navigation, page headers and footers,
sidebars, adverts, notices, forms, comments of readers, scripts and styles are left out.

Names are a hint beside the vote: a class, id or role name marks boilerplate by a word that means nothing else
anywhere in it ('comment-list'), or by an ambiguous one as its head or beside words of layout only ('share-this'), not in
'no-sidebar', 'side-by-side' or 'sticky-nav-page'. An article so named, or inside such an element, is not the page's
article while there is another one. Elements that are hidden are left out.

Edge cases: a null or empty html, or one without text, gives an empty text; html without a container
is read as a whole; unclosed tags end with their parent or, for paragraphs and list items, with the
next block; a null url has the empty host; ties go to the shorter, then the smaller path; repeated
rows each get a result; very long pages are read whole; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shroud.llm.common import written

PAGES = 10  # different pages of a host that must show a path, each text of it on so many on average
TOKEN = re.compile(
    r"<!--.*?(?:-->|$)"
    r"|<(script|style|noscript|template|iframe|svg|textarea|select)\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*>.*?(?:</\1\s*>|$)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>"
    r"|<[!?/][^>]*(?:>|$)", re.S | re.I)
QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
HIDDEN = re.compile(r"(?:^|\s)hidden(?![\w-])", re.I)
UNSEEN = re.compile(r"""(?:^|\s)style\s*=\s*(?:"[^"]*|'[^']*|[^\s"'>]*)(?:display\s*:\s*none|visibility\s*:\s*hidden)""", re.I)
HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
CLASS = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
DIGITS = re.compile(r"\d+")
SPACE = re.compile(r"\s+")

#: FIXED VALUES: element names by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINER = frozenset("article body div main section td".split())
LEAVES = frozenset("p li h1 h2 h3 h4 h5 h6 blockquote pre dd dt figcaption td th".split())
BOXES = frozenset("center div fieldset section".split())
SKIPPED = frozenset("nav footer aside form button head title dialog menu object video audio canvas map".split())
#: FIXED VALUES: beginnings of name parts that mark what is not the article, wherever they stand in a name.
CERTAIN = re.compile(r"(?:comment(?!a)|advert|adsby|adslot|adunit|sidebar|newsletter|cookie|consent|breadcrumb|footer|masthead|navbar|navigation|paginat|sponsor|disqus|popup|subscri|recommended|toolbar|responses?$|replies$|respond$|ads?$)")
#: FIXED VALUES: words that mark it alone, as the head of a compound, or beside words of layout.
AMBIGUOUS = frozenset("alert banner header menu nav notice notices promo promoted related reply share sharing side skip social widget".split())
#: FIXED VALUES: words of layout.
LAYOUT = frozenset("area article articles bar block bottom box buttons button col column container content fixed form global group heading icon icons inner item items left link links list main media message mobile modal more news now outer overlay page panel post posts primary rail region right row secondary section signup site slot sticky stories story text this title toggle tools top unit up user wrap wrapper you".split())
#: FIXED VALUES: words that say that something is absent, or that a wrapper has it beside the article; endings that name the whole page.
AROUND = frozenset("no not non without free has have with hide hidden hides show shows".split())
WHOLE_PAGE = frozenset("page layout body site template theme".split())
#: FIXED VALUES: what may stand before a header inside or around an article.
TITLED = frozenset("article content entry page post section story title".split())


class Node:
    __slots__ = ("path", "tag", "skipped", "parent", "outside", "holds")

    def __init__(self, tag: str, names: str, parent: "Node | None", skipped: bool, outside: bool = False):
        self.tag, self.parent, self.skipped = tag, parent, skipped
        self.outside = outside  # an element that is left out unless it holds the article
        self.holds = 0  # 1: the page's first article, 2: a main, 4: the first article that is no boilerplate by its own name
        own = tag + "".join("." + DIGITS.sub("N", x) for x in sorted(set(names.split())))
        self.path = f"{parent.path}>{own}" if parent is not None and parent.path else own


def boilerplate(name: str, in_article: bool) -> bool:
    """Whether one class, id or role name marks what is not the article."""
    parts = [x for x in re.split(r"[^a-z]+", HUMP.sub("-", name).lower()) if x]
    if not parts or not AROUND.isdisjoint(parts):
        return False
    if len(parts) > 1 and parts[-1] in WHOLE_PAGE:
        return False
    if parts[-1] == "header":
        return not in_article and not (len(parts) > 1 and parts[-2] in TITLED)
    if any(CERTAIN.match(x) for x in parts):
        return True
    if parts[-1] in AMBIGUOUS:
        return parts[-1] != "side" or parts == ["side"]
    return any(x in AMBIGUOUS - {"header"} for x in parts[:-1]) and all(x in AMBIGUOUS or x in LAYOUT or len(x) == 1 for x in parts)


def outside(tag: str, names: str, in_article: bool) -> bool:
    """Whether an element is not part of the main text."""
    if tag in SKIPPED or (tag == "header" and not in_article):
        return True
    return bool(names) and tag not in ("html", "body", "main") and any(boilerplate(x, in_article) for x in names.split())


def unseen(attributes: str) -> bool:
    """Whether the attributes hide an element."""
    low = attributes.lower()
    return ("hidden" in low and bool(HIDDEN.search(QUOTED.sub('""', attributes)) or UNSEEN.search(attributes))) or ("none" in low and bool(UNSEEN.search(attributes)))


def blocks(page: str, repeated: frozenset[str] = frozenset()) -> list[tuple[Node, str, int]]:
    """(innermost element, text, characters in links) of every block outside of boilerplate, in page order.

    An element that holds a main, or on a page without one the first article, is no boilerplate; ``repeated``:
    paths that are.
    """
    found = list(all_blocks(page))
    held = 0
    for node, _, _ in found:
        for x in chain(node):
            held |= x.holds
    need = 2 if held & 2 else 1 if held & 1 else 4
    return [b for b in found if not any((x.outside or x.path in repeated) and not x.holds & need for x in chain(b[0]))]


def all_blocks(page: str) -> Iterator[tuple[Node, str, int]]:
    """As ``blocks``, with those of the block elements that are left out."""
    root = Node("", "", None, False)
    node, text, linked, links, articles = root, [], 0, 0, 0
    first = other = True  # no article so far
    owner = root
    stack = [root]

    def flush():
        nonlocal text, linked
        joined = SPACE.sub(" ", entities.unescape("".join(text))).strip() if text else ""
        out = (owner, joined, min(linked, len(joined)))
        text, linked = [], 0
        return out

    def words(piece: str):
        nonlocal linked, owner
        if node.skipped:
            return
        if not text:
            owner = next(x for x in reversed(stack) if x.tag in BLOCK or x is root)
        text.append(piece)
        if links:
            linked += len(piece)

    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            words(page[at : m.start()])
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            continue
        if tag == "br" or tag == "img":
            words(" ")
            continue
        if tag in BLOCK:
            done = flush()
            if done[1]:
                yield done
        if m[2]:  # an end tag closes up to its start tag, if one is open
            if any(x.tag == tag for x in stack):
                while stack[-1].tag != tag:
                    gone = stack.pop()
                    links -= gone.tag == "a"
                    articles -= gone.tag in ("article", "main")
                gone = stack.pop()
                links -= gone.tag == "a"
                articles -= gone.tag in ("article", "main")
                node = stack[-1]
            continue
        if tag in VOID or m[4].rstrip().endswith("/"):
            continue
        if tag in BLOCK:  # a block ends an open paragraph, an item an open item
            ends = ("p",) if tag != "li" else ("p", "li")
            depth = len(stack)
            while depth > 1 and stack[depth - 1].tag not in (CONTAINER | {"ul", "ol"} if tag == "li" else CONTAINER):
                depth -= 1
                if stack[depth].tag in ends:
                    while len(stack) > depth:
                        gone = stack.pop()
                        links -= gone.tag == "a"
                    break
            node = stack[-1]
        names = " ".join(x.strip("\"'") for x in CLASS.findall(m[4])) if m[4] else ""
        hides = bool(m[4]) and unseen(m[4])
        out = hides or outside(tag, names, articles > 0)
        node = Node(tag, names, stack[-1], stack[-1].skipped or (out and tag not in BLOCK), out and tag in BLOCK)
        if tag in ("main", "article") and not out:
            clean = not any(x.outside for x in stack)
            bit = 2 if tag == "main" else (1 if first else 0) if clean else (4 if other else 0)
            for x in (node, *stack):
                x.holds |= bit
            first, other = first and bit != 1, other and bit != 4
        stack.append(node)
        links += tag == "a"
        articles += tag in ("article", "main")
    if at < len(page):
        words(page[at:])
    done = flush()
    if done[1]:
        yield done


def chain(node: Node) -> Iterator[Node]:
    while node is not None:
        yield node
        node = node.parent


def best(found: list[tuple[Node, str, int]]) -> tuple[str, int]:
    """The path of the page's best container, and its score: its own blocks in full, deeper ones by half a level."""
    score: dict[str, float] = {}
    for node, text, linked in found:
        value = len(text) - 2 * linked
        if node.tag not in LEAVES:
            value //= 2  # loose text
        share = 1.0
        for x in chain(node):
            if x.tag in CONTAINER:
                score[x.path] = score.get(x.path, 0.0) + value * share
                share /= 2
    if not score:
        return "", 0
    top = min(score, key=lambda p: (-score[p], len(p), p))
    return top, max(0, int(score[top]))


def whole(x: Node, linked: dict[Node, int]) -> Node:
    """The element that a winning container belongs to; ``linked``: blocks that are mostly links, per element.

    It is the outermost article or main around it; without one, the widest element below the body that adds
    no block made of links.
    """
    outer = [y for y in chain(x) if y.tag in ("article", "main")]
    if outer:
        return outer[-1]
    while x.parent is not None and x.parent.tag not in ("", "html", "body") and linked.get(x.parent, 0) == linked.get(x, 0):
        x = x.parent
    return x


def text_at(found: list[tuple[Node, str, int]], path: str) -> str | None:
    """The blocks of the elements that the containers of this path belong to; None if there are none."""
    inside = {x for node, _, _ in found for x in chain(node) if x.path == path}
    if not inside:
        return None
    linked: dict[Node, int] = {}
    for node, text, in_links in found:
        if 2 * in_links >= len(text):
            for x in chain(node):
                linked[x] = linked.get(x, 0) + 1
    wide = {whole(x, linked) for x in inside}
    return "\n".join(text for node, text, _ in found if any(x in wide for x in chain(node)))


def _host():
    return F.lower(F.coalesce(F.regexp_extract("url", r"^[^:/?#]*://([^/?#]*)", 1), F.lit("")))


def shown(found: list[tuple[Node, str, int]]) -> Iterator[tuple[str, int]]:
    """(path, hash of its text) of the elements that may be boxes: divisions and the like, no lists, quotes, articles or whole pages."""
    text: dict[Node, list[str]] = {}
    for node, block, _ in found:
        for x in chain(node):
            if x.tag in BOXES and not x.holds:
                text.setdefault(x, []).append(block)
    for x, parts in text.items():
        yield x.path, int.from_bytes(hashlib.blake2b("\n".join(parts).encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per page, its best container with its score, and without a score each element with the hash of its text."""
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
    for b in batches:
        rows = []
        for host, page in zip(b["host"].to_pylist(), b["html"].to_pylist()):
            found = blocks(page)
            path, score = best(found)
            number = int.from_bytes(hashlib.blake2b(page.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)
            if score:
                rows.append((host, path, score, None, number))
            rows += [(host, p, None, h, number) for p, h in set(shown(found)) if not (path + ">").startswith(p + ">")]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 5, kinds)], names=["host", "path", "score", "text", "page"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sets: dict[tuple, frozenset] = {}
    for b in batches:
        out = []
        for path, repeated, page in zip(b["path"].to_pylist(), b["repeated"].to_pylist(), b["html"].to_pylist()):
            key = tuple(repeated or ())
            if key not in sets:
                sets = {key: frozenset(key)}  # rows of a host often follow each other
            found = blocks(page, sets[key])
            text = text_at(found, path) if path else None
            if text is None:
                own, _ = best(found)
                text = text_at(found, own) if own else "\n".join(x for _, x, _ in found)
            out.append(text or "")
        yield pa.RecordBatch.from_arrays([b["page_id"], b["url"], pa.array(out, pa.string())], names=["page_id", "url", "text"])


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, path, repeated): the container path that a host's pages agree on, and the paths that repeat their texts."""
    cast = pages.select(_host().alias("host"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    votes = written(cast.mapInArrow(_vote, "host string, path string, score bigint, text bigint, page bigint"), "votes")
    counted = votes.where("score is not null").groupBy("host", "path").agg(F.sum("score").alias("score"))
    order = F.struct(F.col("score"), -F.length("path"), F.col("path"))
    agreed = counted.groupBy("host").agg(F.max_by("path", order).alias("path"))
    # a page counts once, however many copies of it there are
    texts = votes.where("text is not null").select("host", "path", "text", "page").distinct().groupBy("host", "path", "text").agg(F.count(F.lit(1)).alias("n"))
    paths = texts.groupBy("host", "path").agg(F.sum("n").alias("pages"), F.count(F.lit(1)).alias("texts"))
    repeated = paths.where((F.col("pages") >= PAGES) & (F.col("pages") >= PAGES * F.col("texts")))
    repeated = repeated.groupBy("host").agg(F.sort_array(F.collect_list("path")).alias("repeated"))
    return agreed.join(repeated, "host", "full_outer")


HOSTS = 200_000  # paths of so many hosts are broadcast, if they have at most HOST_BYTES; more are joined
HOST_BYTES = 32 << 20
SALTS = 64  # parts that a host's pages are dealt into for the join


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars): a row per row of ``pages`` (page_id, url, html)."""
    pages = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    agreed = written(host_paths(pages), "paths")
    rows = pages.withColumn("host", _host())
    size = agreed.agg(F.count(F.lit(1)), F.sum(F.octet_length("host") + F.coalesce(F.octet_length("path"), F.lit(0)) + F.coalesce(F.octet_length(F.array_join("repeated", ",")), F.lit(0)))).first()
    if size[0] <= HOSTS and (size[1] or 0) <= HOST_BYTES:
        rows = rows.join(F.broadcast(agreed), "host", "left")
    else:  # salted, as one host may have a third of the pages
        agreed = agreed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(agreed, ["host", "salt"], "left")
    rows = rows.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), "path", "repeated")
    return rows.mapInArrow(_extract, "page_id bigint, url string, text string").withColumn("n_chars", F.char_length("text").cast("bigint"))
