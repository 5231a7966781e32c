"""Candidate generation (CAND-01..20): every recognizer as a Column expression.

All recognizers run in one narrow stage over the documents: each pattern is marked and
split once, turned into ``array<struct>`` spans, scored, then every candidate gets the
text-derived features the validators need (left/right windows, paragraph context,
first-line containment). The text never leaves its row; the output is one row per
candidate and carries no document text.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules as R
from ..functions.literals import finder, holds_any, led, required, witnesses
from ..functions.spans import CHUNK, chunks, cut_sql, luhn_ok

CAND_STRUCT = "struct<type:string,recognizer:string,start:int,end:int,value:string,score:double>"


@dataclass
class Spec:
    """One pattern of a recognizer (also the UDF-01 user-defined recognizer surface)."""

    type: str
    name: str
    pattern: str
    score: float
    group: bool = False
    context: list[str] = field(default_factory=list)  # keywords in +-60 chars
    boost: float = 0.0  # added when a context keyword is present (capped at 1.0)
    context_score: float | None = None  # score when a keyword is present (replaces boost)
    require_context: bool = False
    context_window: int = R.KEYWORD_WINDOW
    guard: str | None = None  # cheap regex that must be found in the text
    check: object = None  # callable(value Column) -> boolean Column, applied per span
    # exact necessary conditions checked with substring search before the regex runs:
    any_of: list[str] | None = None  # one of these occurs in the text
    any_of_lower: list[str] | None = None  # one of these occurs in lower(text)


def _digit_rule(v: Column) -> Column:
    n = F.length(F.regexp_replace(v, r"\D", ""))
    return (n >= 10) & (n <= 15)


def builtin_specs() -> list[Spec]:
    """The shipped recognizers, in a fixed order (structured first)."""
    digit = "[0-9]"
    specs = [Spec("EMAIL", "email_regex", R.EMAIL.replace("]+@", "]++@"), R.EMAIL_SCORE, guard="@")]  # the run holds no @: nothing to give back
    for name, pat, score, rule in R.PHONE_PATTERNS:
        specs.append(Spec("PHONE", name, pat, score, context=R.PHONE_KEYWORDS, boost=R.PHONE_BOOST, guard=digit,
                          check=_digit_rule if rule else None))
    specs += [
        Spec("SSN", "ssn_dashed", R.SSN_DASHED, R.SSN_SCORES["dashed"], context=R.SSN_KEYWORDS,
             context_score=R.SSN_SCORES["dashed_kw"], guard=digit),
        Spec("SSN", "ssn_nodash", R.SSN_NODASH, R.SSN_SCORES["nodash_kw"], context=R.SSN_KEYWORDS,
             require_context=True, guard=digit, any_of_lower=R.SSN_KEYWORDS),
        Spec("SSN", "national_id_grouped", R.SSN_GROUPED, R.SSN_SCORES["grouped"], guard=digit),
    ]
    for name, pat in R.CARD_PATTERNS:
        specs.append(Spec("CREDIT_CARD", f"card_{name}", pat, R.CARD_SCORES["base"], context=R.CARD_KEYWORDS,
                          context_score=R.CARD_SCORES["kw"], guard=digit, check=luhn_ok))
    specs += [
        Spec("IP_ADDRESS", "ipv4_regex", R.IPV4, R.IP_SCORES["v4"], guard=r"[0-9]\.[0-9]"),
        Spec("IP_ADDRESS", "ipv6_regex", R.IPV6, R.IP_SCORES["v6"], guard=":"),
        Spec("URL", "url_regex", R.URL, R.URL_SCORE, any_of_lower=R.URL_GUARD),
        # contextual
        Spec("PERSON", "person_label", R.PERSON_LABEL, R.PERSON_SCORES["label"], group=True, guard=":"),
        Spec("PERSON", "person_title", R.PERSON_TITLE, R.PERSON_SCORES["title"], any_of=R.TITLE_GUARD),
        Spec("COMPANY", "company_suffix", R.COMPANY, R.COMPANY_SCORE, any_of=R.COMPANY_GUARD),
        Spec("ADDRESS", "address_street", R.ADDRESS_STREET, R.ADDRESS_SCORES["pattern"], guard=digit,
             any_of=R.STREET_GUARD),
        Spec("ADDRESS", "address_po_box", R.ADDRESS_PO_BOX, R.ADDRESS_SCORES["pattern"], any_of_lower=["box"]),
        Spec("ADDRESS", "address_pin", R.ADDRESS_PIN, R.ADDRESS_SCORES["pattern"], guard=digit,
             any_of_lower=["pin", "zip", "postal"]),
        Spec("ADDRESS", "address_label", R.ADDRESS_LABEL, R.ADDRESS_SCORES["label"], group=True,
             any_of_lower=["address", "residen"],
             check=lambda v: F.length(F.regexp_replace(v, r"^\s+|\s+$", "")).between(*R.ADDRESS_LABEL_LEN)),
    ]
    for name, pat in R.DOB_PATTERNS:
        specs.append(Spec("DOB", name, pat, R.DOB_SCORE, context=R.DOB_KEYWORDS, require_context=True,
                          context_window=R.DOB_WINDOW, guard=digit, any_of_lower=["dob", "d.o.b", "birth", "born"]))
    return specs


def short_line_spec() -> Spec:
    """CAND-16 (applied after validation by the detect plan)."""
    return Spec("PERSON", "person_short_line", R.PERSON_SHORT_LINE, R.PERSON_SCORES["short_line"], group=True,
                check=lambda v: F.length(v) <= R.SHORT_LINE_MAX)


def sql_lit(s: str) -> str:
    """A Spark SQL raw string literal holding ``s`` verbatim (regexes keep their backslashes)."""
    if "'" not in s:
        return "r'" + s + "'"
    if '"' not in s:
        return 'r"' + s + '"'
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


WORDS = 12  # words that are searched for one by one in a column: a search over bytes costs a tenth of a pass of an expression


def _any_sql(col: str, words: list[str]) -> str:
    if len(words) > (WORDS if col.isidentifier() else 1) and all(w and w.isascii() for w in words):  # one pass for all words
        return f"({col} RLIKE {sql_lit(holds_any(words))})"
    return "(" + " OR ".join(f"contains({col}, {sql_lit(w)})" for w in words) + ")"


def bind_sql(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, which is then evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def with_chunks(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds what the windows read: ``_ch`` (the text in chunks) and ``_n`` (its length)."""
    return df.withColumns({"_ch": chunks(F.col(text)), "_n": F.length(text)})


def luhn_sql(v: str) -> str:
    """FUN-02 in SQL: Luhn checksum over the digits of ``v`` (13..19 digits)."""
    d = f"regexp_replace({v}, r'\\D', '')"
    return (f"(length({d}) BETWEEN 13 AND 19 AND aggregate(zip_with(reverse(transform(split({d}, ''), ch -> int(ch))), "
            f"sequence(0, greatest(length({d}) - 1, 0)), (x, i) -> IF(i % 2 = 1, IF(x * 2 > 9, x * 2 - 9, x * 2), x)), "
            f"0, (acc, y) -> acc + y) % 10 = 0)")


def _check_sql(sp: Spec, v: str) -> str | None:
    if sp.check is None:
        return None
    if sp.check is _digit_rule:
        return f"length(regexp_replace({v}, r'\\D', '')) BETWEEN 10 AND 15"
    if sp.check is luhn_ok:
        return luhn_sql(v)
    return None


def _score_sql(sp: Spec) -> str:
    """SQL over lambda variable ``s`` (start, end, value) and column ``text``; NULL drops the span."""
    base = repr(float(sp.score))
    if sp.context:
        w = sp.context_window
        win = f"lower({cut_sql(f'greatest(s.start - {w}, 0)', f'least(s.end + {w}, _n)')})"
        kw = bind_sql(win, "w", _any_sql("w", sp.context))
        if sp.require_context:
            base = f"CASE WHEN {kw} THEN {base} END"
        elif sp.context_score is not None:
            base = f"CASE WHEN {kw} THEN {float(sp.context_score)!r} ELSE {base} END"
        elif sp.boost:
            base = f"CASE WHEN {kw} THEN round(least({base} + {sp.boost!r}, 1.0), 2) ELSE {base} END"
    chk = _check_sql(sp, "s.value")
    if chk is None and sp.check is not None:
        chk = "__COLUMN_CHECK__"
    if chk is not None:
        base = f"CASE WHEN {chk} THEN {base} END"
    return f"CAST({base} AS DOUBLE)"


def _staged_spans(df: DataFrame, specs: list[Spec], text: str, keep: list[str]) -> DataFrame:
    """Add one ``array<struct<start,end,value>>`` column ``_sp{i}`` per spec."""
    df = _lengths(_pieces(df, specs, text, keep), len(specs), keep)
    return df.selectExpr(*keep, *[f"{_spans_sql(f'_pc{i}', f'_ln{i}')} AS _sp{i}" for i in range(len(specs))])


def _lengths(pieces: DataFrame, n: int, keep: list[str]) -> DataFrame:
    """``pieces`` with the lengths ``_ln{i}`` of the pieces before each."""
    return pieces.selectExpr(*keep, *[f"_pc{i}" for i in range(n)], *[f"{_lengths_sql(f'_pc{i}')} AS _ln{i}" for i in range(n)])


def _lengths_sql(pc: str) -> str:
    return f"transform({pc}, (p, j) -> IF(j = 0, 0, length({pc}[j - 1]) - IF(j > 1, 1, 0)))"


def _pieces(df: DataFrame, specs: list[Spec], text: str, keep: list[str]) -> DataFrame:
    """``keep`` and per spec the pieces ``_pc{i}`` of the marked text, in projections of their own so each regex runs
    once per row."""
    need_lower = any(sp.any_of_lower for sp in specs)
    cols = list(dict.fromkeys(keep + [text]))
    # marker characters already in the text become spaces once per document (length preserving)
    marked = f"contains({text}, chr(1)) OR contains({text}, chr(2))"
    extra = [f"IF({marked}, translate({text}, concat(chr(1), chr(2)), '  '), {text}) AS _clean"]
    # literals that the patterns without a condition of their own need: one pass finds which patterns can match
    needs = {i: found for i, sp in enumerate(specs) if not (sp.guard or sp.any_of or sp.any_of_lower) and (found := required(sp.pattern))}
    found_in = {}
    for folded, column in ((False, "_seen"), (True, "_seen_low")):
        literals = set().union(*(x for x, f in needs.values() if f == folded))
        if literals:
            found_in[folded] = column, literals
            where = f"lower({text})" if folded else text
            extra.append(f"array_distinct(regexp_extract_all({where}, {sql_lit(finder(literals))}, 1)) AS {column}")
    if need_lower:
        extra.append(f"lower({text}) AS _low")
    df = df.selectExpr(*cols, *extra)
    pcs = []
    for i, sp in enumerate(specs):
        cond = [f"{text} IS NOT NULL"]
        if sp.guard is not None:
            cond.append(f"instr({text}, {sql_lit(sp.guard)}) > 0" if len(sp.guard) == 1
                        else f"{text} RLIKE {sql_lit(sp.guard)}")
        if i in needs:
            column, literals = found_in[needs[i][1]]
            cond.append(f"arrays_overlap({column}, array({', '.join(map(sql_lit, witnesses(needs[i][0], literals)))}))")
        if sp.any_of:
            cond.append(_any_sql(text, sp.any_of))
        if sp.any_of_lower:
            cond.append(_any_sql("_low", sp.any_of_lower))
        # '$' and '{pre}' are split so SQL variable substitution never sees a ${...} token
        repl = ("concat('$', '{pre}', chr(1), '$', '{val}', chr(2))" if sp.group
                else "concat(chr(1), '$0', chr(2))")
        marked = f"regexp_replace(_clean, {sql_lit(led(sp.pattern))}, {repl})"
        pcs.append(f"CASE WHEN {' AND '.join(cond)} THEN split({marked}, chr(1), -1) ELSE array('') END AS _pc{i}")
    return df.selectExpr(*keep, *pcs)


def _spans_sql(pc: str, ln: str, reach: int = 0) -> str:
    """The matches of pieces ``pc`` with lengths ``ln`` as ``array<struct<start,end,value>>``; with ``reach``, also ``lo`` and
    ``hi``, the borders of a window of that many characters each side."""
    step = "shiftleft(1, k)"
    places = (f"aggregate(sequence(0, int(ceil(log2(size({ln})))) - 1), {ln}, (acc, k) -> "
              f"transform(acc, (x, j) -> IF(j >= {step}, x + acc[j - {step}], x)))")
    fields = ["'start', int(p.s)", "'end', int(p.s + length(p.v))", "'value', p.v"]
    kind = "start:int,end:int,value:string"
    if reach:
        fields += [f"'lo', greatest(int(p.s) - {reach}, 0)", f"'hi', least(int(p.s + length(p.v)) + {reach}, _n)"]
        kind += ",lo:int,hi:int"
    pairs = (f"zip_with(slice({pc}, 2, size({pc}) - 1), slice({places}, 2, size({pc}) - 1), "
             f"(p, s) -> named_struct('s', s, 'v', substring_index(p, chr(2), 1)))")
    return f"IF(size({pc}) <= 1, CAST(array() AS array<struct<{kind}>>), transform({pairs}, p -> named_struct({', '.join(fields)})))"


def _features_sql() -> str:
    """SQL turning candidate ``c`` into the feature struct (uses columns _ch, _n, _fl_start, _fl_line)."""
    street = f"IF(c.type = 'PERSON', regexp_extract(c.value, {sql_lit(R.PERSON_STREET_SUFFIX)}, 1), '')"
    # the entity context is cut at the span the validators will settle on (VAL-06/12)
    cs = f"(c.start + IF(c.type IN ('COMPANY', 'ORG'), {company_trim_sql('c.value')}, 0))"
    ce = "(c.end - length(b.street))"
    pv = "substring(c.value, 1, length(c.value) - length(b.street))"
    left = max(30, R.IP_VERSION_WINDOW)
    body = (
        "named_struct('type', c.type, 'recognizer', c.recognizer, 'start', c.start, 'end', c.end, "
        "'value', c.value, 'score', c.score, "
        f"'context', {para_context_sql('b.cs', ce)}, "
        "'left30', right(b.left, 30), 'left10', right(b.left, 10), "
        f"'left20', right(b.left, {R.IP_VERSION_WINDOW}), 'right5', left(b.right, 5), "
        f"'ip_tail', concat(c.value, left(b.right, {R.IP_URL_LOOKAHEAD})), "
        # a name that lies in the first line needs no search
        f"'in_first_line', c.type = 'PERSON' AND (c.end <= _fl_start + length(_fl_line) OR instr(_fl_line, {pv}) > 0))"
    )
    window = (f"named_struct('street', {street}, 'cs', {cs}, 'left', {cut_sql(f'greatest(c.start - {left}, 0)', 'c.start')}, "
              f"'right', {cut_sql('c.end', f'least(c.end + {R.IP_URL_LOOKAHEAD}, _n)')})")
    return bind_sql(window, "b", body)


def para_context_sql(s: str, e: str, n: int = 40) -> str:
    """CTX-02: the window of ``n`` each side, cut after the last ``\\n\\n`` left of the span and before the
    first one right of it, when the raw window holds one."""
    lo, hi = f"greatest(({s}) - {n}, 0)", f"least(({e}) + {n}, _n)"
    brk = "concat(chr(10), chr(10))"
    window = (f"named_struct('raw', {cut_sql(lo, hi)}, 'left', {cut_sql(lo, s)}, 'mid', {cut_sql(s, e)}, 'tail', {cut_sql(e, hi)})")
    left = f"IF(instr(w.left, {brk}) > 0, right(w.left, locate({brk}, reverse(w.left)) - 1), w.left)"
    tail = f"IF(instr(w.tail, {brk}) > 0, left(w.tail, locate({brk}, w.tail) - 1), w.tail)"
    return bind_sql(window, "w", f"IF(instr(w.raw, {brk}) > 0, concat({left}, w.mid, {tail}), w.raw)")


def company_trim_sql(v: str) -> str:
    """VAL-12 in SQL: characters to drop from the front of a COMPANY value."""
    ctx = ", ".join(sql_lit(w) for w in R.COMPANY_CONTEXT_WORDS)
    toks = f"split(trim({v}), r'\\s+')"
    flags = f"transform({toks}, t -> array_contains(array({ctx}), lower(t)) OR t RLIKE r'^\\p{{Ll}}')"
    first_keep = f"array_position(transform({flags}, b -> NOT b), true)"
    n = f"IF({first_keep} = 0, size({toks}), {first_keep} - 1)"
    rest = f"element_at(split(regexp_replace({v}, r'^\\s+', ''), r'\\s+', {n} + 1), -1)"
    head = f"regexp_extract(trim({v}), r'^\\S*', 0)"  # a value whose first token stays keeps them all
    return f"IF((array_contains(array({ctx}), lower({head})) OR {head} RLIKE r'^\\p{{Ll}}') AND {n} > 0 AND {n} < size({toks}), length({v}) - length({rest}), 0)"


# FUN-06 in SQL: characters before the first non-blank line, and that line
FIRST_LEAD = r"length(regexp_extract(text, r'^((?:[ \t\r\f\x0B]*\n)*)', 1))"
FIRST_LINE = r"regexp_extract(text, r'^(?:[ \t\r\f\x0B]*\n)*([^\n]*)', 1)"


def _passes(name: str, check):
    """Whether a candidate is of another recognizer or passes the check of this one."""
    return lambda c: (c["recognizer"] != name) | check(c["value"])


def _matched(docs: DataFrame, specs: list[Spec] | None, text: str, doc_id: str, with_header: bool) -> DataFrame:
    """The documents with their matches ``_c`` and what the features read."""
    specs = builtin_specs() if specs is None else specs
    base = with_chunks(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    staged = _staged_spans(base, specs, "text", ["doc_id", "text", "_ch", "_n"])
    per_spec = []
    col_checks = []
    for i, sp in enumerate(specs):
        sc = _score_sql(sp)
        if "__COLUMN_CHECK__" in sc:  # user check given as a Column function: applied after explode
            col_checks.append((sp.name, sp.check))
            sc = sc.replace("__COLUMN_CHECK__", "true")
        per_spec.append(
            f"filter(transform(_sp{i}, s -> named_struct('type', {sql_lit(sp.type)}, 'recognizer', "
            f"{sql_lit(sp.name)}, 'start', s.start, 'end', s.end, 'value', s.value, 'score', {sc})), "
            f"c -> c.score IS NOT NULL)")
    allc = f"concat({', '.join(per_spec)})" if len(per_spec) > 1 else per_spec[0]
    cands = staged.selectExpr("doc_id", "text", "_ch", "_n", f"{FIRST_LEAD} AS _fl_start", f"{FIRST_LINE} AS _fl_line",
                              f"{allc} AS _c")
    if with_header:
        strip = r"regexp_replace(_fl_line, r'^\s+|\s+$', '')"
        lead = r"length(regexp_extract(_fl_line, r'^(\s*)', 1))"
        hdr = (f"IF(text IS NOT NULL AND {strip} RLIKE {sql_lit(R.PERSON_HEADER)}, "
               f"array(named_struct('type', 'PERSON', 'recognizer', 'person_header', 'start', int(_fl_start + {lead}), "
               f"'end', int(_fl_start + {lead} + length({strip})), 'value', {strip}, "
               f"'score', CAST({R.PERSON_SCORES['header']!r} AS DOUBLE))), array())")
        cands = cands.selectExpr("doc_id", "text", "_ch", "_n", "_fl_start", "_fl_line", f"concat(_c, {hdr}) AS _c")
    for name, chk in col_checks:
        cands = cands.withColumn("_c", F.filter("_c", _passes(name, chk)))
    return cands


def candidate_arrays(docs: DataFrame, specs: list[Spec] | None = None, text: str = "text",
                     doc_id: str = "doc_id", with_header: bool = True) -> DataFrame:
    """(doc_id, text, candidates): the raw candidates of each document beside its text, as an array of structs."""
    cands = _matched(docs, specs, text, doc_id, with_header)
    return cands.selectExpr("doc_id", "text", f"transform(_c, c -> {_features_sql()}) AS candidates")


SIDE = 40  # characters beside a span that the features read


def _keyword_sql(sp: Spec, reach: int) -> str:
    """Whether the window ``_w`` (``reach`` characters each side) of a candidate holds a keyword of its recognizer."""
    before = f"(start - greatest(start - {sp.context_window}, 0))"
    window = f"substring(_w, start - greatest(start - {reach}, 0) - {before} + 1, {before} + length(value) + {sp.context_window})"
    return _any_sql(f"lower({window})", sp.context)


def _of(places: list[int]) -> str:
    return f"_k IN ({', '.join(map(str, places))})"


def _kept_sql(specs: list[Spec], reach: int) -> str | None:
    """SQL over candidate rows: they pass the check and have the keyword that their recognizer asks for."""
    rules: dict[str, list[int]] = {}
    for i, sp in enumerate(specs):
        asked = [_keyword_sql(sp, reach)] if sp.context and sp.require_context else []
        asked += [check] if (check := _check_sql(sp, "value")) else []
        if asked:
            rules.setdefault(" AND ".join(asked), []).append(i)
    return f"CASE {' '.join(f'WHEN {_of(places)} THEN {rule}' for rule, places in rules.items())} ELSE true END" if rules else None


def _scored_sql(specs: list[Spec], reach: int) -> str:
    """SQL over candidate rows: the score of the recognizer, with what a keyword in the window adds."""
    rules: dict[str, list[int]] = {}
    for i, sp in enumerate(specs):
        if sp.context and not sp.require_context and (sp.context_score is not None or sp.boost):
            more = f"{float(sp.context_score)!r}D" if sp.context_score is not None else f"round(least(score + {float(sp.boost)!r}D, 1.0D), 2)"
            rules.setdefault(f"IF({_keyword_sql(sp, reach)}, {more}, score)", []).append(i)
    return f"CASE {' '.join(f'WHEN {_of(places)} THEN {rule}' for rule, places in rules.items())} ELSE score END" if rules else "score"


def _with_features(rows: DataFrame, reach: int) -> DataFrame:
    """Candidate rows with the features that the validators read, cut from their windows ``_w``; plain columns, so
    a feature that nobody reads costs nothing."""
    rows = rows.selectExpr(
        "*", f"substring(_w, 1, start - greatest(start - {reach}, 0)) AS _left", f"substring(_w, start - greatest(start - {reach}, 0) + length(value) + 1) AS _right",
        # the entity context is cut at the span the validators will settle on (VAL-06/12)
        f"IF(type = 'PERSON', length(regexp_extract(value, {sql_lit(R.PERSON_STREET_SUFFIX)}, 1)), 0) AS _cut",
        f"IF(type IN ('COMPANY', 'ORG'), {company_trim_sql('value')}, 0) AS _trim")
    brk = "concat(chr(10), chr(10))"  # CTX-02: up to the blank line on each side
    left = f"substring_index(right(concat(_left, substring(value, 1, _trim)), {SIDE}), {brk}, -1)"
    tail = f"substring_index(left(concat(right(value, _cut), _right), {SIDE}), {brk}, 1)"
    return rows.selectExpr(
        "doc_id", "type", "recognizer", "start", "end", "value", "score",
        f"concat({left}, substring(value, _trim + 1, length(value) - _trim - _cut), {tail}) AS context",
        "right(_left, 30) AS left30", "right(_left, 10) AS left10", f"right(_left, {R.IP_VERSION_WINDOW}) AS left20",
        "left(_right, 5) AS right5", f"concat(value, left(_right, {R.IP_URL_LOOKAHEAD})) AS ip_tail", "_first AS in_first_line")


def raw_candidates(docs: DataFrame, specs: list[Spec] | None = None, text: str = "text",
                   doc_id: str = "doc_id", with_header: bool = True, features: bool = True) -> DataFrame:
    """All raw candidates (CAND-01..18e, CAND-20), one row each, with validator features.

    Output: doc_id, type, recognizer, start, end, value, score, context, left30, left10,
    left20, right5, ip_tail, in_first_line. No text column; without ``features`` it ends with the score.

    Beside the text a candidate only gets one window; keywords, checks and features read that window in
    plain projections over candidate rows, which Spark compiles (a lambda is interpreted).
    """
    specs = builtin_specs() if specs is None else specs
    reach = max([SIDE if features else 0, *(sp.context_window for sp in specs if sp.context)])
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    if reach or with_header:
        rows = _windowed(base, specs, reach, with_header, features)
    else:
        found = [f"transform({_spans_sql(f'_pc{i}', f'_ln{i}')}, m -> named_struct('_k', {i}, 'start', m.start, 'value', m.value))" for i in range(len(specs))]
        rows = _lengths(_pieces(base, specs, "text", ["doc_id"]), len(specs), ["doc_id"])
        rows = rows.selectExpr("doc_id", f"inline({f'concat({chr(44).join(found)})' if len(found) > 1 else found[0]})")
        rows = rows.selectExpr("doc_id", "_k", "start", "value", "start + length(value) AS end", "CAST(NULL AS STRING) AS _w", "false AS _first")

    def of(values: list[str]) -> str:
        return f"element_at(array({', '.join(values)}), _k + 1)"

    every = [*specs, HEADER]
    rows = rows.selectExpr("doc_id", "_k", f"{of([sql_lit(sp.type) for sp in every])} AS type", f"{of([sql_lit(sp.name) for sp in every])} AS recognizer",
                           "start", "end", "value", f"{of([f'{float(sp.score)!r}D' for sp in every])} AS score", "_first", "_w")
    if kept := _kept_sql(specs, reach):
        rows = rows.filter(kept)
    for sp in specs:
        if sp.check is not None and _check_sql(sp, "value") is None:  # user check given as a Column function
            rows = rows.filter((F.col("recognizer") != sp.name) | sp.check(F.col("value")))
    rows = rows.selectExpr("doc_id", "type", "recognizer", "start", "end", "value", f"CAST({_scored_sql(specs, reach)} AS DOUBLE) AS score", "_first", "_w")
    return _with_features(rows, reach) if features else rows.drop("_first", "_w")


HEADER = Spec("PERSON", "person_header", "", R.PERSON_SCORES["header"])  # stands behind the specs
FEW = 4  # matches of a recognizer in a text that take the text with them
FEW_BYTES = 32768  # or as many as copy this much


def _windowed(base: DataFrame, specs: list[Spec], reach: int, with_header: bool, features: bool) -> DataFrame:
    """(doc_id, _k, start, value, end, _w, _first): the matches of recognizer ``_k`` with their windows ``_w``.

    A row for each document and recognizer that matches comes first. A few matches take the text and its pieces along to rows of
    their own, where place and window are read off in compiled projections; many would copy the text too often, so their places and
    windows are made beside it in arrays."""
    keep = ["doc_id", "text", "_b"]
    base = base.selectExpr("doc_id", "text", "octet_length(text) = length(text) AND is_valid_utf8(text) AS _b")  # a byte a character: cut without counting
    if features or with_header:
        base = base.selectExpr(*keep, f"{FIRST_LEAD} AS _fl_start", f"{FIRST_LINE} AS _fl_line")
        base = base.selectExpr("*", "_fl_start + length(_fl_line) AS _fl_end")
        keep += ["_fl_start", "_fl_line", "_fl_end"]
    persons = [i for i, sp in enumerate([*specs, HEADER]) if features and sp.type == "PERSON"]

    def first(value: str, end: str, line: str) -> str:
        """Whether a name stands in the first line; one that ends there needs no search."""
        bare = f"substring({value}, 1, length({value}) - length(regexp_extract({value}, {sql_lit(R.PERSON_STREET_SUFFIX)}, 1)))"
        return f"IF({_of(persons)}, {end} <= _fl_end OR instr({line}, {bare}) > 0, false)" if persons else "false"

    found = [f"named_struct('_k', {i}, '_pc', _pc{i})" for i in range(len(specs))]
    if with_header:  # the pieces of a text that the first line is marked in
        name = r"regexp_replace(_fl_line, r'^\s+|\s+$', '')"
        lead = r"_fl_start + length(regexp_extract(_fl_line, r'^(\s*)', 1))"
        pieces = f"IF(_fl_line IS NOT NULL AND {name} RLIKE {sql_lit(R.PERSON_HEADER)}, array(left(text, {lead}), concat({name}, chr(2))), array(''))"
        found.append(f"named_struct('_k', {len(specs)}, '_pc', {pieces})")
    rows = _pieces(base, specs, "text", keep).selectExpr(*keep, f"inline(filter(array({', '.join(found)}), x -> size(x._pc) > 1))")

    few = f"(size(_pc) <= {FEW + 1} OR (size(_pc) - 1) * CAST(octet_length(text) AS BIGINT) <= {FEW_BYTES})"
    line = [f"IF({few}, _fl_line, NULL) AS _fl", "_fl_end", "_fl_line"] if persons else []
    rows = rows.selectExpr("doc_id", "_k", "_b", f"IF({few}, text, NULL) AS _t", f"IF({few}, _pc, NULL) AS _p", *line, "_pc", "text", f"IF({few}, 0, length(text)) AS _n")
    window = cut_sql("m.lo", "m.hi", "ch") if reach else "CAST(NULL AS STRING)"
    one = f"named_struct('start', m.start, 'value', m.value, '_w', {window}, '_first', {first('m.value', 'm.end', '_fl_line')})"
    spans = bind_sql(_lengths_sql("_pc"), "ln", f"transform({_spans_sql('_pc', 'ln', reach)}, m -> {one})")
    many = bind_sql(f"regexp_extract_all(text, r'(?s).{{1,{CHUNK}}}', 0)", "ch", spans)
    none = "CAST(array() AS array<struct<start:int,value:string,_w:string,_first:boolean>>)"
    outer = ["doc_id", "_k", "_b", "_t", *(["_fl", "_fl_end"] if persons else [])]
    rows = rows.selectExpr(*outer, "_p", f"inline(arrays_zip(sequence(1, size(_pc) - 1), IF(_t IS NOT NULL, {none}, {many}))) AS (_j, _m)")
    # generators of one row: what follows reads their columns, so nothing is worked out twice
    before = "array_join(slice(_p, 1, _j), '')"
    at = f"IF(_m IS NULL, IF(_b, octet_length({before}), length({before})) - (_j - 1), _m.start)"
    rows = rows.selectExpr(*outer, "_m", f"inline(array(named_struct('start', {at}, 'value', IF(_m IS NULL, substring_index(_p[_j], chr(2), 1), _m.value))))")
    side = f"greatest(start - {reach}, 0)"
    place = f"{side} + 1, start - {side} + length(value) + {reach}"
    window = f"IF(_b, CAST(substring(CAST(_t AS BINARY), {place}) AS STRING), substring(_t, {place}))"
    window = f"IF(_m IS NULL, {window}, _m._w)" if reach else "CAST(NULL AS STRING)"
    told = f"IF(_m IS NULL, {first('value', '(start + length(value))', '_fl')}, _m._first)"
    return rows.selectExpr("doc_id", "_k", "start", "value", f"inline(array(named_struct('end', start + length(value), '_w', {window}, '_first', {told})))")


def street_suffix(value: Column) -> Column:
    """Trailing street-type word of a PERSON value (VAL-06), '' if none."""
    return F.regexp_extract(value, R.PERSON_STREET_SUFFIX, 1)


def company_trim(value: Column) -> Column:
    """VAL-12: number of leading characters to drop -- leading whitespace-separated tokens that
    are context words or start lower-case -- when at least one token remains."""
    tokens = F.split(F.trim(value), r"\s+")
    ctx = F.array(*[F.lit(w) for w in R.COMPANY_CONTEXT_WORDS])
    trimmable = F.transform(tokens, lambda t: F.array_contains(ctx, F.lower(t)) | t.rlike(r"^\p{Ll}"))
    first_keep = F.array_position(F.transform(trimmable, lambda b: ~b), F.lit(True))
    n_trim = F.when(first_keep == 0, F.size(tokens)).otherwise(first_keep - 1)
    body = F.regexp_replace(value, r"^\s+", "")
    rest = F.element_at(F.split(body, r"\s+", n_trim + 1), -1)
    plen = F.length(value) - F.length(rest)
    return F.when((n_trim > 0) & (n_trim < F.size(tokens)), plen).otherwise(F.lit(0))


JOIN_CHUNK = 4096  # characters of a text that meet external spans under one key
REACH = 64  # characters beside a span that the features may read


def external_candidates(docs: DataFrame, ext: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """CAND-19: NER output ``(doc_id, entity_type, start, end, score)`` with value and features.

    ORG becomes COMPANY. Spans meet the text by (document, chunk of the text): a span takes its own characters and
    REACH more on each side from the chunks that it touches, so neither the spans nor the text of a document
    are gathered, however many spans it has. Spans without characters in the text are dropped; repeated ones stay.
    """
    ext = ext.select("doc_id", F.when(F.col("entity_type") == "ORG", "COMPANY").otherwise(F.col("entity_type")).alias("type"),
                     F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), F.col("score").cast("double").alias("score"))
    span = ["doc_id", "type", "start", "end", "score"]
    ext = ext.where("start >= 0 AND `end` > start").groupBy(*span).agg(F.count(F.lit(1)).cast("int").alias("_times"))
    lo, hi = F.greatest(F.col("start") - REACH, F.lit(0)), F.col("end") + REACH
    touched = ext.withColumns({"_lo": lo, "_hi": hi}).withColumn(
        "_k", F.explode(F.sequence(F.floor(F.col("_lo") / JOIN_CHUNK), F.floor((F.col("_hi") - 1) / JOIN_CHUNK))))
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    cut_up = base.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{JOIN_CHUNK}}}"), F.lit(0))).alias("_k", "_chunk"))
    met = touched.join(cut_up.withColumn("_k", F.col("_k").cast("bigint")), ["doc_id", "_k"])
    at = F.col("_k") * JOIN_CHUNK
    first = F.greatest(F.col("_lo") - at, F.lit(0)).cast("int")
    piece = F.substring(F.col("_chunk"), first + 1, (F.least(F.col("_hi") - at, F.lit(JOIN_CHUNK)) - first).cast("int"))
    windows = met.select(*span, "_times", "_lo", "_k", piece.alias("_piece")).groupBy(*span, "_times", "_lo").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_k", "_piece"))), lambda p: p["_piece"]), "").alias("_text"))
    windows = windows.where(F.col("start") - F.col("_lo") < F.length("_text"))
    # repeated spans stand behind each other again
    windows = windows.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_times")))).drop("_i", "_times")
    lines = base.selectExpr("doc_id", f"{FIRST_LEAD} AS _fl_start", f"{FIRST_LINE} AS _fl_line")
    d = with_chunks(windows.join(lines, "doc_id"), "_text")
    d = d.withColumn("_fl_start", F.col("_fl_start") - F.col("_lo"))  # places count from the window's start
    value = cut_sql("start - _lo", "`end` - _lo")
    one = (f"array(named_struct('type', type, 'recognizer', 'external', 'start', start - _lo, 'end', `end` - _lo, "
           f"'value', {value}, 'score', score)) AS _c")
    d = d.selectExpr("doc_id", "_lo", "_ch", "_n", "_fl_start", "_fl_line", one)
    d = d.selectExpr("doc_id", "_lo", f"inline(transform(_c, c -> {_features_sql()}))")
    return d.withColumns({"start": F.col("start") + F.col("_lo"), "end": F.col("end") + F.col("_lo")}).drop("_lo")
