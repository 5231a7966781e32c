"""Span extraction and text-window helpers, all plain Column expressions (JVM side).

``find_spans`` returns every leftmost-first, non-overlapping match of a Java regex together
with its code-point offsets, the same list Python's ``re.finditer`` yields:

1. ``\\x01``/``\\x02`` already in the text become spaces (length preserving);
2. ``regexp_replace`` wraps each match as ``\\x01match\\x02`` (or ``prefix\\x01value\\x02`` when
   only a named group ``val`` is the span);
3. ``split`` on ``\\x01`` gives piece 0 = text before the first match and piece i = match i,
   ``\\x02`` and the gap after it;
4. start of match i = sum of the original lengths of pieces 0..i-1, computed with a
   log-step (Hillis-Steele) prefix sum inside one ``aggregate`` so the cost stays
   O(n log n) even for a document with millions of matches.

No text leaves its row: contexts and validation features are cut from the same row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OPEN = "\x01"
CLOSE = "\x02"


def prefix_sum(arr: Column) -> Column:
    """Inclusive prefix sum of an ``array<int>`` in ceil(log2 n)+1 vectorised steps."""
    n = F.size(arr)
    steps = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.log2(n)).cast("int")))
    return F.aggregate(
        steps,
        arr,
        lambda acc, k: F.transform(
            acc,
            lambda x, i: x
            + F.when(i >= F.pow(F.lit(2), k).cast("int"), F.get(acc, i - F.pow(F.lit(2), k).cast("int"))).otherwise(F.lit(0)),
        ),
    )


def mark(text: Column, pattern: str, group: bool = False) -> Column:
    clean = F.translate(text, OPEN + CLOSE, "  ")
    repl = "${pre}" + OPEN + "${val}" + CLOSE if group else OPEN + "$0" + CLOSE
    return F.regexp_replace(clean, pattern, repl)


def pieces_to_spans(pieces: Column) -> Column:
    """``split`` pieces of a marked text -> ``array<struct<start:int,end:int,value:string>>``."""
    lens = F.transform(pieces, lambda p, i: F.length(p) - F.when(i > 0, 1).otherwise(0))
    # exclusive prefix: shift right by one, then inclusive scan
    shifted = F.concat(F.array(F.lit(0)), F.slice(lens, 1, F.greatest(F.size(lens) - 1, F.lit(0))))
    starts = prefix_sum(shifted)
    spans = F.zip_with(
        pieces,
        starts,
        lambda p, s: F.struct(
            s.cast("int").alias("start"),
            (s + F.length(F.substring_index(p, CLOSE, 1))).cast("int").alias("end"),
            F.substring_index(p, CLOSE, 1).alias("value"),
        ),
    )
    return F.slice(spans, 2, F.greatest(F.size(spans) - 1, F.lit(0)))


def find_spans(text: Column, pattern: str, group: bool = False, guard: Column | None = None) -> Column:
    """All matches of ``pattern`` in ``text`` with code-point offsets (FUN-01).

    ``group=True``: the pattern has named groups ``pre`` (consumed, not part of the span)
    followed by ``val`` (the span). ``guard`` is a cheap predicate that must hold for a
    match to be possible (e.g. the text contains ``@``); rows failing it skip the regex.
    """
    spans = pieces_to_spans(F.split(mark(text, pattern, group), OPEN, -1))
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")
    cond = text.isNotNull() if guard is None else (text.isNotNull() & guard)
    return F.when(cond, spans).otherwise(empty)


# ---------------------------------------------------------------- windows (CTX-01/02/03)

CHUNK = 256  # characters; a window reads the few chunks it touches, not the text from its start


def chunks(text: Column) -> Column:
    """The text as an array of ``CHUNK`` characters each: one pass, made once per document."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def cut_sql(lo: str, hi: str, ch: str = "_ch") -> str:
    """SQL of Python ``text[lo:hi]`` (0-based, clamped offsets) over the chunk column ``ch``."""
    first = f"int(({lo}) div {CHUNK})"
    return (f"substring(array_join(slice({ch}, {first} + 1, greatest(int((({hi}) - 1) div {CHUNK}) - {first} + 1, 0)), ''), "
            f"int(({lo}) % {CHUNK}) + 1, int(greatest(({hi}) - ({lo}), 0)))")


def cut(ch: Column, lo: Column, hi: Column) -> Column:
    """``cut_sql`` as a Column: Python ``text[lo:hi]`` over ``chunks(text)``."""
    first = F.floor(lo / CHUNK).cast("int")
    count = F.greatest(F.floor((hi - 1) / CHUNK).cast("int") - first + 1, F.lit(0))
    return F.substring(F.array_join(F.slice(ch, first + 1, count), ""), (lo % CHUNK).cast("int") + 1, F.greatest(hi - lo, F.lit(0)).cast("int"))


def context(ch: Column, length: Column, start: Column, end: Column, n: int = 80) -> Column:
    """Raw window of ``n`` characters on each side (CTX-01) over ``chunks(text)``; ``length`` of the text."""
    return cut(ch, F.greatest(start - n, F.lit(0)), F.least(end + n, length))


def has_any(s: Column, keywords: list[str]) -> Column:
    """``any(kw in s for kw in keywords)`` (substring test, CTX-03)."""
    out = F.lit(False)
    for kw in keywords:
        out = out | (F.instr(s, kw) > 0)
    return out


# ---------------------------------------------------------------- scalar helpers (FUN-02..07)

def digits(s: Column) -> Column:
    """Digits only (FUN-03)."""
    return F.regexp_replace(s, r"\D", "")


def luhn_ok(s: Column) -> Column:
    """Luhn checksum over the digits of ``s``; 13..19 digits required (FUN-02)."""
    d = digits(s)
    arr = F.transform(F.reverse(F.split(d, "")), lambda c: c.cast("int"))
    total = F.aggregate(
        F.zip_with(arr, F.sequence(F.lit(0), F.greatest(F.size(arr) - 1, F.lit(0))), lambda x, i: F.struct(x.alias("x"), i.alias("i"))),
        F.lit(0),
        lambda acc, e: acc
        + F.when(e["i"] % 2 == 1, F.when(e["x"] * 2 > 9, e["x"] * 2 - 9).otherwise(e["x"] * 2)).otherwise(e["x"]),
    )
    n = F.length(d)
    return (n >= 13) & (n <= 19) & (total % 10 == 0)


def ordinal(n: Column) -> Column:
    """1st, 2nd, 3rd, 4th, 11th, 12th, 13th, 21st ... (FUN-04)."""
    suffix = (
        F.when((n >= 11) & (n <= 13), "th")
        .when(n % 10 == 1, "st")
        .when(n % 10 == 2, "nd")
        .when(n % 10 == 3, "rd")
        .otherwise("th")
    )
    return F.concat(n.cast("string"), suffix)


def is_private_ipv4(ip: Column) -> Column:
    """RFC 1918 ranges 10/8, 172.16/12, 192.168/16 (FUN-05)."""
    parts = F.split(ip, r"\.")
    o1 = F.get(parts, 0).try_cast("int")
    o2 = F.get(parts, 1).try_cast("int")
    return (F.size(parts) == 4) & ((o1 == 10) | ((o1 == 172) & (o2 >= 16) & (o2 <= 31)) | ((o1 == 192) & (o2 == 168)))


def line_prefix(text: Column, pos: Column) -> Column:
    """Text from the start of the line containing ``pos`` up to ``pos`` (FUN-07 helper)."""
    return F.substring_index(F.substring(text, 1, pos), "\n", -1)
