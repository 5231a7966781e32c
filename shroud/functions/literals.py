"""Which patterns can match a text: literals that a pattern needs, found by one pass for all patterns.

``required`` reads off a regular expression a set of strings of which every match holds at least one. ``finder`` is one
expression for all of them, a trie with a look-ahead, so it sees every place; at a place it takes the longest literal, and
the others that lie inside that one are known with it (``witnesses``).
"""

from __future__ import annotations

import re
import warnings
from re import _constants as K
from re import _parser as parser

LEAST = 3  # shorter literals say little
MOST = 64  # alternatives of a set
OTHER = re.compile(r"\\[vhkGRX0-9]|&&|--|~~")  # what the two dialects of patterns read differently


def required(pattern: str) -> tuple[frozenset[str], bool] | None:
    """(literals, whether case is ignored): each match of the Java ``pattern`` holds one of them; None if none is sure."""
    tree = _parsed(pattern)
    if tree is None:
        return None
    folded = bool(tree.state.flags & re.IGNORECASE)
    found = _best(tree, folded)
    if not found or any(not x.isascii() for x in found):
        return None
    return frozenset(x.lower() for x in found) if folded else frozenset(found), folded


def _parsed(pattern: str):
    """The parts of a Java pattern; None where the dialects may read it differently."""
    if OTHER.search(pattern):
        return None
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("error", FutureWarning)  # class operations, which mean other things here
            tree = parser.parse(re.sub(r"\(\?<(?=[A-Za-z])", "(?P<", pattern))
    except (re.error, OverflowError, RecursionError, FutureWarning):
        return None
    return None if tree.state.flags & re.VERBOSE else tree


FIRSTS = 16  # more first characters rule out too few places
ASCII = {K.CATEGORY_DIGIT: "0123456789", K.CATEGORY_SPACE: " \t\n\x0b\f\r"}  # as Java reads them


def led(pattern: str) -> str:
    """``pattern`` behind a look-ahead for its first character, where that is one of a few: the same matches, and most
    places of a text fail at once. A pattern whose first character is not sure, or that tests it at once anyway, stays as it is."""
    if any(set(flags) - set("ims-") for flags in re.findall(r"\(\?([A-Za-z-]+)[:)]", pattern)):  # others change what a class or a case is
        return pattern
    tree = _parsed(pattern.replace(r"\z", r"\Z"))
    if tree is None or not len(tree) or tree[0][0] is K.AT and tree[0][1] is not K.AT_BOUNDARY:
        return pattern
    found = _first(tree, bool(tree.state.flags & re.IGNORECASE))
    if found & {ANY, EMPTY} or len(found) > FIRSTS or not all(c.isascii() for c in found):
        return pattern
    return f"(?=[{''.join(_quoted(c) for c in sorted(found))}])(?:{pattern})"


ANY, EMPTY = "any", ""


def _first(tree, folded: bool) -> set[str]:
    """The characters that a match can begin with; ``ANY``: they are not sure, ``EMPTY``: it may have none."""
    found: set[str] = set()
    for op, value in tree:
        some = {ANY}
        if op is K.LITERAL:
            some = {chr(value)}
        elif op is K.IN:
            some = _members(value)
        elif op in (K.AT, K.ASSERT, K.ASSERT_NOT):
            some = {EMPTY}
        elif op is K.SUBPATTERN and not value[1] and not value[2]:  # no flags of its own
            some = _first(value[3], folded)
        elif op is K.BRANCH:
            some = set().union(*(_first(x, folded) for x in value[1]))
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT):
            some = _first(value[2], folded) | ({EMPTY} if value[0] == 0 else set())
        found |= ({x for c in some for x in (c.lower(), c.upper())} if folded and ANY not in some else some) - {EMPTY}
        if EMPTY not in some:
            return found
    return found | {EMPTY}


def _members(items) -> set[str]:
    found: set[str] = set()
    for op, value in items:
        if op is K.LITERAL:
            found.add(chr(value))
        elif op is K.RANGE and value[1] - value[0] <= 64:
            found |= {chr(c) for c in range(value[0], value[1] + 1)}
        elif op is K.CATEGORY and value in ASCII:
            found |= set(ASCII[value])
        else:
            return {ANY}
    return found


def _size(found: set[str] | None) -> int:
    return min(map(len, found)) if found else 0


def _best(tree, folded: bool) -> set[str] | None:
    """The set whose shortest literal is longest among those that the sequence needs."""
    best: set[str] | None = None
    run = ""
    for op, value in [*tree, (None, None)]:
        if op is K.LITERAL:
            run += chr(value)
            continue
        if len(run) >= LEAST and len(run) > _size(best):
            best = {run}
        run = "" if op is not K.AT else run  # anchors and word borders have no width
        inner = None
        if op is K.SUBPATTERN:
            if value[1] & re.IGNORECASE and not folded:  # a group of its own case
                continue
            inner = _best(value[3], folded)
        elif op is K.ATOMIC_GROUP:
            inner = _best(value, folded)
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT, K.POSSESSIVE_REPEAT) and value[0] >= 1:
            inner = _best(value[2], folded)
        elif op is K.BRANCH:
            parts = [_best(x, folded) for x in value[1]]
            if all(parts):
                inner = set().union(*parts)
        if inner and len(inner) <= MOST and _size(inner) > _size(best):
            best = inner
    return best


def finder(literals: set[str]) -> str:
    """A Java pattern whose group 1 is the longest of the literals at each place of a text."""
    return f"(?=({_trie(literals)}))"


def holds_any(literals: list[str]) -> str:
    """A Java pattern that a text holds if it holds one of the (ASCII) literals; most places fail at their first character."""
    return f"(?=[{''.join(_quoted(c) for c in sorted({x[0] for x in literals}))}]){_trie(literals)}"


def _trie(literals) -> str:
    trie: dict = {}
    for x in literals:
        node = trie
        for c in x:
            node = node.setdefault(c, {})
        node[""] = {}

    def spell(node: dict) -> str:
        ways = [_quoted(c) + spell(child) for c, child in sorted(node.items()) if c]
        if not ways:
            return ""
        body = ways[0] if len(ways) == 1 and "" not in node else "(?:" + "|".join(ways) + ")"
        return body + ("?" if "" in node else "")

    return spell(trie)


def _quoted(c: str) -> str:
    return c if c.isalnum() else f"\\x{ord(c):02x}"


def witnesses(needed: frozenset[str], literals: set[str]) -> list[str]:
    """The literals whose presence shows one of ``needed``."""
    return sorted(x for x in literals if any(n in x for n in needed))
