"""URL filter: a weighted vocabulary matched by Aho-Corasick, under host and path rules.

One automaton finds all terms in a url's host and path; a hit counts if neither neighbour is a letter or
digit (the boundary check). A strict term weighs ``REJECT``, every different soft term 1; a url whose
weights reach ``REJECT`` is blocked. Rules (host, path, verdict) go first: a rule fits its host and
all subdomains where the path starts with the rule's; the longest one decides.

Edge cases: a null url or one without ``://`` has an empty host and path, no rule, and is allowed;
empty hosts and paths are scanned as they are; repeated rows and null ids each get a result; very long
urls are scanned whole; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: FIXED VALUES: the vocabulary. One strict term rejects, or two different soft ones.
STRICT = ("porn", "porno", "xxx", "casino", "pills", "viagra", "cialis", "escort", "spam", "gambling", "warez", "phishing")
SOFT = ("adult", "ads", "bet", "bets", "betting", "bonus", "cheap", "click", "farm", "free", "loan", "loans", "poker", "sex", "sexy", "slots", "track", "tracker", "win", "winner", "x")
REJECT = 2
MOST_RULES = 1_000_000  # rules are a parameter of the job, not data: more than this is refused

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def automaton(strict=STRICT, soft=SOFT):
    import ahocorasick

    out = ahocorasick.Automaton()
    for term in sorted({*strict, *soft}):
        out.add_word(term, (term, REJECT if term in strict else 1))
    out.make_automaton()
    return out


def weigh(machine, place: str) -> dict[str, int]:
    """The different terms of ``place`` at word boundaries, with their weights."""
    found: dict[str, int] = {}
    for end, (term, weight) in machine.iter(place):
        begin = end - len(term)
        if (begin < 0 or not place[begin].isalnum()) and (end + 1 == len(place) or not place[end + 1].isalnum()):
            found[term] = weight
    return found


def by_host(rules) -> dict[str, list[tuple[str, str]]]:
    """Host -> (path, verdict), longest path first; of equal rules the first counts."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    out: dict[str, list[tuple[str, str]]] = {}
    for host, path, verdict in rules:
        out.setdefault(host, []).append((path, verdict))
    for paths in out.values():
        paths.sort(key=lambda x: -len(x[0]))
    return out


def longest(rules: dict, host: str, path: str) -> tuple[str | None, str | None]:
    """The longest rule that fits, and its verdict."""
    best, at = (None, None), 0
    while True:
        name = host[at:]
        for start, verdict in rules.get(name, ()):
            if path.startswith(start):
                if best[0] is None or len(name) + len(start) > len(best[0]):
                    best = name + start, verdict
                break
        dot = host.find(".", at)
        if dot < 0:
            return best
        at = dot + 1


def judge(pages: DataFrame, rules, strict=STRICT, soft=SOFT) -> DataFrame:
    """(page_id, host, path, rule, verdict, terms): a row per row of ``pages`` (page_id, url)."""
    rest = F.expr("CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3) ELSE '' END")
    split = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url")).select("page_id", F.coalesce(rest, F.lit("")).alias("rest"))
    split = split.select("page_id", F.translate(F.regexp_extract("rest", r"^([^/?#]*)", 1), UPPER, LOWER).alias("host"), F.regexp_extract("rest", r"^[^/?#]*([^?#]*)", 1).alias("path"))
    known = by_host(rules)
    shared = pages.sparkSession.sparkContext.broadcast((known, strict, soft))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules, machine = shared.value[0], automaton(*shared.value[1:])
        for b in batches:
            out: list[tuple] = []
            for host, path in zip(b["host"].to_pylist(), b["path"].to_pylist()):
                rule, verdict = longest(rules, host, path)
                terms = weigh(machine, (host + path).lower())
                if verdict is None:
                    verdict = "block" if sum(terms.values()) >= REJECT else "allow"
                out.append((rule, verdict, " ".join(sorted(terms))))
            columns = list(zip(*out)) or [()] * 3
            yield pa.RecordBatch.from_arrays([b["page_id"], b["host"], b["path"], *(pa.array(c, pa.string()) for c in columns)], names=["page_id", "host", "path", "rule", "verdict", "terms"])

    return split.mapInArrow(run, "page_id bigint, host string, path string, rule string, verdict string, terms string")
