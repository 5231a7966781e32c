"""DuckDB restatement of the plans, used as the correctness oracle.

DuckDB's regex engine (RE2) has no look-around, so each pattern is restated: a lookbehind
``(?<!\\d)`` or lookahead ``(?!\\d)`` becomes a neighbour-character filter on the match, the
SSN exclusions become filters on the digit groups, the address label's lookahead becomes a
consumed (and re-emitted) group. The joins are written as plain SQL joins / EXISTS rather
than the sweeps the Spark plan uses, so the two sides are independent formulations.
"""

from __future__ import annotations

from . import rules as R
from .sources.docs import dossier_sql

# ------------------------------------------------------------------ RE2 patterns
#: FIXED VALUES: the patterns of ``rules`` restated for RE2, which has no look-around.

_EXT = r"(?:\s*(?:ext\.?|x|extension)\s*\d{1,5})?"
ADDRESS_STREET_RE2 = (
    r"\b\d{1,5}[A-Za-z]?[ \t]+(?:[A-Z][a-z]+[ \t]*){1,4}"
    r"(?:Street|St\.?|Avenue|Ave\.?|Boulevard|Blvd\.?|Drive|Dr\.?|"
    r"Lane|Ln\.?|Road|Rd\.?|Way|Court|Ct\.?|Circle|Cir\.?|"
    r"Place|Pl\.?|Terrace|Ter\.?|Trail|Trl\.?|Parkway|Pkwy\.?)"
    r"(?:[ \t]*,?[ \t]*(?:Suite|Ste\.?|Apt\.?|Unit|#)[ \t]*\d+)?"
    r"(?:[ \t]*,[ \t]*(?:[A-Za-z][A-Za-z ]+[A-Za-z]|[a-z][A-Za-z]|[A-Z][a-z]))*"
    r"(?:[ \t]*,?[ \t]*[A-Z]{1,2}\d[A-Z\d]?[ \t]+\d[A-Z]{2})?"
    r"(?:[ \t]*,?[ \t]*[A-Z]{2}[ \t]+\d{5}(?:-\d{4})?)?"
    r"(?:[ \t]*,?[ \t]*\d{6})?"
    r"(?:[ \t]*,[ \t]*[A-Z][a-z]+(?:[ \t]+[A-Z][a-z]+)*)?"
)

# (type, recognizer, re2, mode, extra) -- mode: 0 whole match, 2 = (pre)(val), 3 = (pre)(val)(post)
SPECS = [
    ("EMAIL", "email_regex", R.EMAIL, 0),
    ("PHONE", "indian_phone", r"(^|[^0-9])((?:\+?91[\s\-.]?)?(?:\(?0?\)?[\s\-.]?)?[6-9]\d{9}" + _EXT + ")", 2),
    ("PHONE", "us_phone", r"(^|[^0-9])((?:\+?1[\s\-.]?)?\(?\d{3}\)?[\s\-.]?\d{3}[\s\-.]?\d{4}" + _EXT + ")", 2),
    ("PHONE", "indian_landline", r"(^|[^0-9])(0\d{2,4}[\s\-.]?\d{4}[\s\-.]?\d{4}" + _EXT + ")", 2),
    ("PHONE", "dotted_phone", R.PHONE_PATTERNS[3][1], 0),
    ("SSN", "ssn_dashed", r"\b\d{3}-\d{2}-\d{4}\b", 0),
    ("SSN", "ssn_nodash", r"\b\d{9}\b", 0),
    ("SSN", "national_id_grouped", R.SSN_GROUPED, 0),
] + [("CREDIT_CARD", f"card_{n}", p, 0) for n, p in R.CARD_PATTERNS] + [
    ("IP_ADDRESS", "ipv4_regex", R.IPV4, 0),
    ("IP_ADDRESS", "ipv6_regex", R.IPV6, 0),
    ("URL", "url_regex", R.URL, 0),
    ("PERSON", "person_label", r"(?m)(^[ \t]*(?:" + "|".join(R.PERSON_LABELS) + r")\s*[:]\s*)"
                               r"([A-Z][a-z]+(?:[ \t]+[A-Z][a-z]+){1,3})", 2),
    ("PERSON", "person_title", R.PERSON_TITLE, 0),
    ("COMPANY", "company_suffix", R.COMPANY, 0),
    ("ADDRESS", "address_street", ADDRESS_STREET_RE2, 0),
    ("ADDRESS", "address_po_box", R.ADDRESS_PO_BOX, 0),
    ("ADDRESS", "address_pin", R.ADDRESS_PIN, 0),
    ("ADDRESS", "address_label", r"(?is)((?:Address|Mailing[ \t]+Address|Home[ \t]+Address|Residence|"
                                 r"Residential[ \t]+Address)[ \t]*[:.][ \t]*)(.+?)(\n\n|\n[A-Z]|\z)", 3),
] + [("DOB", n, p, 0) for n, p in R.DOB_PATTERNS] + [
    ("PERSON", "person_short_line", r"(?m)(^[ \t]*)([A-Z][a-z]{1,15}(?:[ \t]+[A-Z][a-z]{1,15}){1,2})([ \t]*$)", 3),
    ("_HEADING", "heading", R.HEADING.replace("(?md)", "(?m)"), 0),
    ("_URLLINE", "url_line", R.URL_LINE, 0),
]


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _repl(mode: int) -> str:
    if mode == 0:
        return "chr(1) || '\\0' || chr(2)"
    if mode == 2:
        return "'\\1' || chr(1) || '\\2' || chr(2)"
    return "'\\1' || chr(1) || '\\2' || chr(2) || '\\3'"


def span_sql(source: str, re2: str, mode: int, type_: str, rec: str) -> str:
    """All matches of ``re2`` in ``source(doc_id, text)`` as (doc_id, type, recognizer, start, end, value)."""
    marked = f"regexp_replace(translate(text, chr(1) || chr(2), '  '), {q(re2)}, {_repl(mode)}, 'g')"
    return f"""
    SELECT doc_id, {q(type_)} AS type, {q(rec)} AS recognizer, CAST(s AS BIGINT) AS start,
           CAST(s + length(split_part(p, chr(2), 1)) AS BIGINT) AS "end", split_part(p, chr(2), 1) AS value
    FROM (
      SELECT doc_id, k, p, sum(length(p) - CASE WHEN k > 1 THEN 1 ELSE 0 END)
             OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s
      FROM (SELECT doc_id, unnest(pcs) AS p, generate_subscripts(pcs, 1) AS k
            FROM (SELECT doc_id, string_split({marked}, chr(1)) AS pcs FROM {source}))
    ) WHERE k > 1"""


def cut(lo: str, hi: str) -> str:
    return f"substring(text, ({lo}) + 1, greatest(({hi}) - ({lo}), 0))"


def win(n: int) -> str:
    return f"lower({cut(f'greatest(start - {n}, 0)', f'least(end_ + {n}, length(text))')})"


def has_any(s: str, kws: list[str]) -> str:
    return "(" + " OR ".join(f"strpos({s}, {q(k)}) > 0" for k in kws) + ")"


def digits(v: str) -> str:
    return f"regexp_replace({v}, '[^0-9]', '', 'g')"


def luhn(v: str) -> str:
    d = digits(v)
    return (f"(length({d}) BETWEEN 13 AND 19 AND list_sum(list_transform(list_reverse(string_split({d}, '')), "
            f"lambda c, i: CASE WHEN i % 2 = 0 THEN CASE WHEN CAST(c AS INT) * 2 > 9 THEN CAST(c AS INT) * 2 - 9 "
            f"ELSE CAST(c AS INT) * 2 END ELSE CAST(c AS INT) END)) % 10 = 0)")


def not_digit_at(pos: str) -> str:
    """char at 0-based ``pos`` is absent or not an ASCII digit."""
    return f"(({pos}) < 0 OR ({pos}) >= length(text) OR NOT regexp_matches(substring(text, ({pos}) + 1, 1), '[0-9]'))"


def score_sql(rec: str) -> str:
    """Candidate score (NULL = not a candidate) for one recognizer, over (text, start, end_, value)."""
    if rec == "email_regex":
        return "0.99"
    if rec in ("indian_phone", "us_phone", "indian_landline", "dotted_phone"):
        base = {"indian_phone": 0.90, "us_phone": 0.90, "indian_landline": 0.88, "dotted_phone": 0.85}[rec]
        kw = has_any(win(60), R.PHONE_KEYWORDS)
        s = f"CASE WHEN {kw} THEN round(least({base} + 0.08, 1.0), 2) ELSE {base} END"
        if rec == "dotted_phone":
            return s
        cond = (f"{not_digit_at('start - 1')} AND {not_digit_at('end_')} AND "
                f"length({digits('value')}) BETWEEN 10 AND 15")
        return f"CASE WHEN {cond} THEN {s} END"
    ssn_kw = has_any(win(60), R.SSN_KEYWORDS)
    if rec == "ssn_dashed":
        ok = ("substr(value, 1, 3) NOT IN ('000', '666') AND substr(value, 1, 1) <> '9' AND "
              "substr(value, 5, 2) <> '00' AND substr(value, 8, 4) <> '0000'")
        return f"CASE WHEN {ok} THEN CASE WHEN {ssn_kw} THEN 0.99 ELSE 0.92 END END"
    if rec == "ssn_nodash":
        ok = ("substr(value, 1, 3) NOT IN ('000', '666') AND substr(value, 1, 1) <> '9' AND "
              "substr(value, 4, 2) <> '00' AND substr(value, 6, 4) <> '0000'")
        return f"CASE WHEN {ok} AND {ssn_kw} THEN 0.85 END"
    if rec == "national_id_grouped":
        return "0.95"
    if rec.startswith("card_"):
        return f"CASE WHEN {luhn('value')} THEN CASE WHEN {has_any(win(60), R.CARD_KEYWORDS)} THEN 0.99 ELSE 0.95 END END"
    if rec == "ipv4_regex":
        return "0.95"
    if rec == "ipv6_regex":
        return "0.93"
    if rec == "url_regex":
        return "0.99"
    if rec == "person_label":
        return "0.97"
    if rec == "person_title":
        return "0.92"
    if rec == "company_suffix":
        return "0.90"
    if rec in ("address_street", "address_po_box", "address_pin"):
        return "0.88"
    if rec == "address_label":
        return "CASE WHEN length(regexp_replace(value, '^\\s+|\\s+$', '', 'g')) BETWEEN 10 AND 300 THEN 0.92 END"
    if rec.startswith("dob_"):
        return f"CASE WHEN {has_any(win(80), R.DOB_KEYWORDS)} THEN 0.93 END"
    if rec == "person_short_line":
        return "CASE WHEN length(value) <= 60 THEN 0.85 END"
    return "1.0"


def corpus_sql(with_dossiers: bool = True) -> str:
    base = ("SELECT doc_id, text FROM documents UNION ALL "
            "SELECT page_id + 2000000000000 AS doc_id, html AS text FROM pages")
    if with_dossiers:
        base += " UNION ALL " + dossier_sql("customer", "orders", dialect="duckdb")
    return base


def _strip(s: str) -> str:
    return f"regexp_replace({s}, '^\\s+|\\s+$', '', 'g')"


def raw_candidates_sql(corpus: str = "corpus", external: str | None = None) -> str:
    """Union of all spans with score and features (doc_id, type, recognizer, start, end_, value, score, ...)."""
    parts = []
    for type_, rec, re2, mode in SPECS:
        parts.append(f"SELECT *, {q(type_)} AS t FROM ({span_sql(corpus, re2, mode, type_, rec)})")
    spans = " UNION ALL ".join(parts)
    first_line = r"regexp_extract(text, '^(?:[ \t\r\f\v]*\n)*([^\n]*)', 1)"
    lead_blank = r"length(regexp_extract(text, '^((?:[ \t\r\f\v]*\n)*)', 1))"
    header = f"""
      SELECT doc_id, 'PERSON' AS type, 'person_header' AS recognizer,
             CAST({lead_blank} + length(regexp_extract({first_line}, '^(\\s*)', 1)) AS BIGINT) AS start,
             CAST({lead_blank} + length(regexp_extract({first_line}, '^(\\s*)', 1)) + length({_strip(first_line)}) AS BIGINT) AS "end",
             {_strip(first_line)} AS value, 'PERSON' AS t
      FROM {corpus} WHERE regexp_matches({_strip(first_line)}, '^[A-Z][a-z]+(?:[ \\t]+[A-Z][a-z]+){{1,3}}$')"""
    score_cases = "CASE recognizer " + " ".join(
        f"WHEN {q(rec)} THEN {score_sql(rec)}" for _, rec, _, _ in SPECS + [("", "person_header", "", 0)]
    ) + " END"
    score_cases = score_cases.replace("WHEN 'person_header' THEN 1.0", "WHEN 'person_header' THEN 0.95")
    ext = ""
    if external:
        ext = (f" UNION ALL SELECT x.doc_id, CASE WHEN x.entity_type = 'ORG' THEN 'COMPANY' ELSE x.entity_type END, "
               f"'external', x.start, x.\"end\", substring(c2.text, x.start + 1, x.\"end\" - x.start), "
               f"x.entity_type, x.score FROM {external} x JOIN {corpus} c2 USING (doc_id)")
    return f"""
    SELECT s.doc_id, s.type, s.recognizer, s.start, s."end" AS end_, s.value, c.text, s.ext_ FROM (
      SELECT *, CAST(NULL AS DOUBLE) AS ext_ FROM ({spans} UNION ALL {header}) {ext}
    ) s JOIN {corpus} c USING (doc_id)"""


def scored_sql(corpus: str = "corpus", external: str | None = None) -> str:
    """Every candidate with confidence and reject_reason (DuckDB restatement of the detect plan)."""
    score_cases = "CASE recognizer " + " ".join(
        f"WHEN {q(rec)} THEN {score_sql(rec)}" for _, rec, _, _ in SPECS) + " WHEN 'person_header' THEN 0.95 END"
    street = f"regexp_extract(value, {q(R.PERSON_STREET_SUFFIX)}, 1)"
    first_line = r"regexp_extract(text, '^(?:[ \t\r\f\v]*\n)*([^\n]*)', 1)"
    return f"""
    WITH raw AS ({raw_candidates_sql(corpus, external)}),
    sc AS (SELECT *, CAST(coalesce(ext_, {score_cases}) AS DOUBLE) AS score FROM raw),
    ev AS (SELECT * FROM sc WHERE score IS NOT NULL),
    heads AS (SELECT doc_id, start AS hstart,
                     coalesce(element_at(MAP {{{", ".join(f"{q(k)}: {q(v)}" for k, v in R.SECTION_NAMES.items())}}},
                                         lower(trim(regexp_extract(value, '^[ \\t]*([A-Z][A-Z &/\\-]+[A-Z])', 1))))[1],
                              upper(trim(regexp_extract(value, '^[ \\t]*([A-Z][A-Z &/\\-]+[A-Z])', 1)))) AS hname
              FROM ev WHERE type = '_HEADING'),
    prot AS (SELECT doc_id, start AS ps, end_ AS pe FROM ev WHERE type IN ('URL', 'EMAIL', 'PHONE', 'SSN', 'CREDIT_CARD', 'IP_ADDRESS')),
    urll AS (SELECT doc_id, start AS us, end_ AS ue FROM ev WHERE type = '_URLLINE'),
    cand AS (
      SELECT e.*,
        EXISTS (SELECT 1 FROM prot p WHERE p.doc_id = e.doc_id AND p.ps < e.end_ AND p.pe > e.start) AS protected,
        coalesce((SELECT arg_max(h.hname, h.hstart) FROM heads h WHERE h.doc_id = e.doc_id AND h.hstart <= e.start),
                 CASE WHEN EXISTS (SELECT 1 FROM heads h WHERE h.doc_id = e.doc_id) THEN 'HEADER' ELSE 'BODY' END) AS section,
        EXISTS (SELECT 1 FROM urll u WHERE u.doc_id = e.doc_id AND u.us < e.start AND u.ue > e.start) AS ip_url_line
      FROM ev e WHERE e.type NOT IN ('_HEADING', '_URLLINE')
    ),
    feat AS (
      SELECT *,
        CASE WHEN type = 'PERSON' THEN {street} ELSE '' END AS street_,
        {cut('greatest(start - 30, 0)', 'start')} AS left30,
        {cut('greatest(start - 10, 0)', 'start')} AS left10,
        {cut('greatest(start - 20, 0)', 'start')} AS left20,
        {cut('end_', 'least(end_ + 5, length(text))')} AS right5,
        {cut('start', 'least(end_ + 20, length(text))')} AS ip_tail,
        {first_line} AS first_line_
      FROM cand
    ),
    feat2 AS (
      SELECT *, substr(value, 1, length(value) - length(street_)) AS pv_,
             CASE WHEN type = 'COMPANY' THEN {_company_trim_sql()} ELSE 0 END AS trim_
      FROM feat
    ),
    val AS (
      SELECT *,
        CASE
          WHEN type = 'IP_ADDRESS' AND regexp_matches(lower(left20), {q(R.IP_VERSION_PREFIX.replace('(?i)', ''))}) THEN 'ip_version'
          WHEN recognizer = 'ipv4_regex' AND (strpos(ip_tail, '://') > 0 OR ip_url_line) THEN 'ip_in_url'
          WHEN type IN ('URL', 'EMAIL', 'PHONE', 'SSN', 'CREDIT_CARD', 'IP_ADDRESS') AND score < 0.85 THEN 'low_score'
          WHEN type IN ('URL', 'EMAIL', 'PHONE', 'SSN', 'CREDIT_CARD', 'IP_ADDRESS') THEN NULL
          WHEN recognizer = 'person_short_line' THEN
            CASE WHEN protected THEN 'protected_overlap'
                 WHEN section IN ({", ".join(q(x) for x in R.SUPPRESSED_SECTIONS)}) THEN 'suppressed_section' END
          WHEN protected THEN 'protected_overlap'
          WHEN type = 'PERSON' THEN
            CASE WHEN section IN ({", ".join(q(x) for x in R.SUPPRESSED_SECTIONS)}) THEN 'suppressed_section'
                 WHEN {has_any('lower(pv_)', R.TECH_DENYLIST)} THEN 'tech_denylist'
                 WHEN lower(pv_) IN ({", ".join(q(x) for x in R.FIELD_DENYLIST)}) THEN 'field_name'
                 WHEN starts_with(ltrim(substr(street_ || right5, 1, 5)), ':') THEN 'label_colon'
                 WHEN {_person_score_sql()} < 0.80 THEN 'low_score' END
          WHEN type = 'COMPANY' THEN
            CASE WHEN NOT regexp_matches(value, '^\\p{{Lu}}') THEN 'company_lowercase'
                 WHEN NOT regexp_matches(value, {q(R.COMPANY_SUFFIX_CHECK)}) THEN 'company_no_suffix'
                 WHEN regexp_matches(value, {q(R.COMPANY_REJECT)}) THEN 'company_institution'
                 WHEN score < 0.80 THEN 'low_score' END
          WHEN type = 'ADDRESS' THEN
            CASE WHEN right(left10, 1) IN ('.', '#') THEN 'address_prefix'
                 WHEN regexp_matches(left10, {q(R.ADDRESS_HEADING_NUMBER)}) THEN 'address_heading_number'
                 WHEN score < 0.80 THEN 'low_score' END
          WHEN type IN ('DATE', 'DATE_TIME') THEN
            CASE WHEN NOT regexp_matches(lower({_para_context_sql('start', 'end_')}), {q(_birth_re())}) THEN 'no_birth_keyword' END
          WHEN type = 'LOCATION' THEN 'location'
          WHEN type NOT IN ('ADDRESS', 'DOB', 'COMPANY', 'PERSON', 'IP_ADDRESS', 'SSN', 'PHONE', 'EMAIL', 'CREDIT_CARD', 'URL') THEN 'unknown_type'
          WHEN score < 0.80 THEN 'low_score'
        END AS reject_reason,
        CASE WHEN type = 'PERSON' AND recognizer <> 'person_short_line' THEN {_person_score_sql()}
             WHEN type IN ('DATE', 'DATE_TIME') THEN 0.90 ELSE score END AS confidence
      FROM feat2
    ),
    shifted AS (
      SELECT doc_id, CASE WHEN type IN ('DATE', 'DATE_TIME') THEN 'DOB' ELSE type END AS type,
             recognizer, score, protected, section, reject_reason, confidence, text, ext_,
             CAST(start + trim_ AS BIGINT) AS start,
             substr(pv_, trim_ + 1) AS value,
             left10
      FROM val
    ),
    dedup AS (
      SELECT s.*, CASE WHEN s.recognizer = 'person_short_line' AND s.reject_reason IS NULL AND EXISTS (
                    SELECT 1 FROM shifted o WHERE o.doc_id = s.doc_id AND o.start = s.start
                      AND o.start + length(o.value) = s.start + length(s.value)
                      AND o.reject_reason IS NULL AND o.recognizer <> 'person_short_line')
                  THEN 'duplicate_span' ELSE s.reject_reason END AS reason2
      FROM shifted s
    ),
    dob AS (
      SELECT *, CASE WHEN type = 'DOB' AND reason2 IS NULL
                     THEN regexp_extract(left10, {q(R.DOB_ORDINAL_PREFIX.replace('(?i)', '(?i)'))}, 1) ELSE '' END AS pre_
      FROM dedup
    )
    SELECT doc_id, type, recognizer, CAST(start - length(pre_) AS BIGINT) AS start,
           CAST(start + length(value) AS BIGINT) AS "end", pre_ || value AS value, confidence, reason2 AS reject_reason,
           section,
           {_para_context_sql('start', 'start + length(value)')} AS context
    FROM dob"""


def _birth_re() -> str:
    return r"\b(?:" + "|".join(w.replace(".", r"\.") for w in R.DATE_BIRTH_WORDS) + r")\b"


def _company_trim_sql() -> str:
    ctx_words = ", ".join(q(w) for w in R.COMPANY_CONTEXT_WORDS)
    body = "regexp_replace(value, '^\\s+', '')"
    toks = f"string_split_regex(regexp_replace({body}, '\\s+$', ''), '\\s+')"
    flags = f"list_transform({toks}, lambda w: list_contains([{ctx_words}], lower(w)) OR regexp_matches(w, '^\\p{{Ll}}'))"
    n = f"coalesce(list_position(list_transform({flags}, lambda b: NOT b), true) - 1, len({toks}))"
    # prefix = leading whitespace + n tokens each followed by its whitespace run
    pre = f"regexp_extract(value, '^(\\s*(?:\\S+\\s+){{' || CAST({n} AS VARCHAR) || '}})', 1)"
    return f"CASE WHEN {n} > 0 AND {n} < len({toks}) THEN length({pre}) ELSE 0 END"


def _person_score_sql() -> str:
    return (f"CASE WHEN regexp_matches(left30, {q(R.PERSON_LEFT_LABEL)}) THEN 0.99 "
            f"WHEN section = 'HEADER' AND strpos(first_line_, pv_) > 0 THEN 0.95 "
            f"WHEN score > 0.8 THEN score ELSE 0.0 END")


def _para_context_sql(s: str, e: str) -> str:
    lo = f"greatest(({s}) - 40, 0)"
    hi = f"least(({e}) + 40, length(text))"
    raw = cut(lo, hi)
    left = cut(lo, s)
    k = f"strpos(reverse({left}), chr(10) || chr(10))"
    new_lo = f"CASE WHEN {k} > 0 THEN {lo} + length({left}) - {k} + 1 ELSE {lo} END"
    j = f"strpos({cut(e, hi)}, chr(10) || chr(10))"
    new_hi = f"CASE WHEN {j} > 0 THEN ({e}) + {j} - 1 ELSE {hi} END"
    return f"CASE WHEN strpos({raw}, chr(10) || chr(10)) > 0 THEN {cut(new_lo, new_hi)} ELSE {raw} END"


def entities_sql(corpus: str = "corpus") -> str:
    """Approved candidates folded per document (both passes over the whole sorted list)."""
    st = "STRUCT(start BIGINT, \"end\" BIGINT, confidence DOUBLE, type VARCHAR, recognizer VARCHAR, value VARCHAR, context VARCHAR)"

    def step(touch: bool) -> str:
        cond = "greatest(e.start, x.start) < least(e.\"end\", x.\"end\")"
        if touch:
            cond = f"({cond} OR e.start = x.\"end\")"
        pos = f"list_position(list_transform(acc, lambda x: {cond}), true)"
        wins = (f"(e.confidence > acc[{pos}].confidence OR (e.confidence = acc[{pos}].confidence AND "
                f"e.\"end\" - e.start > acc[{pos}].\"end\" - acc[{pos}].start))")
        return (f"lambda acc, e: CASE WHEN {pos} IS NULL THEN list_append(acc, e) "
                f"WHEN {wins} THEN list_transform(acc, lambda x, i: CASE WHEN i = {pos} THEN e ELSE x END) ELSE acc END")

    return f"""
    WITH scored AS ({scored_sql(corpus)}),
    appr AS (SELECT * FROM scored WHERE reject_reason IS NULL),
    grp AS (SELECT doc_id, list(struct_pack(start := start, "end" := "end", confidence := confidence, type := type,
                                            recognizer := recognizer, value := value, context := context)
                                ORDER BY start, "end" - start DESC, confidence DESC, type, recognizer, value) AS arr
            FROM appr GROUP BY doc_id),
    p1 AS (SELECT doc_id, list_reduce(arr, {step(True)}, CAST([] AS {st}[])) AS r1 FROM grp),
    p2 AS (SELECT doc_id, list_reduce(r1, {step(False)}, CAST([] AS {st}[])) AS r2 FROM p1),
    ents AS (SELECT doc_id, unnest(r2, recursive := true) FROM p2)
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start, "end", type) AS BIGINT) AS id,
           type, start, "end", value, confidence, context, recognizer
    FROM ents"""


def candidates_sql(recs: list[str], corpus: str = "corpus") -> str:
    rl = ", ".join(q(r) for r in recs)
    score_cases = "CASE recognizer " + " ".join(
        f"WHEN {q(rec)} THEN {score_sql(rec)}" for _, rec, _, _ in SPECS) + " WHEN 'person_header' THEN 0.95 END"
    return f"""
    WITH raw AS ({raw_candidates_sql(corpus)}),
    sc AS (SELECT *, CAST({score_cases} AS DOUBLE) AS score FROM raw WHERE recognizer IN ({rl}))
    SELECT doc_id, type, recognizer, start, end_ AS "end", value, score FROM sc WHERE score IS NOT NULL"""


def with_corpus(body: str) -> str:
    b = body.strip()
    if b.upper().startswith("WITH "):
        return f"WITH corpus AS ({corpus_sql()}), {b[5:]}"
    return f"WITH corpus AS ({corpus_sql()}) {b}"


# ------------------------------------------------------------------ pseudonyms (DuckDB)

def _draw(slot: int, n: int, bump: str | None = None) -> str:
    h = f"CAST('0x' || substr(md5(k || '|{slot}'), 1, 8) AS BIGINT)"
    if bump:
        h = f"({h} + {bump})"
    return f"({h} % {n})"


def _rint(slot: int, lo: int, hi: int, bump: str | None = None) -> str:
    return f"({_draw(slot, hi - lo + 1, bump)} + {lo})"


def _pick(values: list[str], slot: int, bump: str | None = None) -> str:
    lst = "[" + ", ".join(q(v) for v in values) + "]"
    return f"{lst}[{_draw(slot, len(values), bump)} + 1]"


def _s(x: str) -> str:
    return f"CAST({x} AS VARCHAR)"


def _digits(b: str) -> str:
    ds = "lpad(CAST(CAST('0x' || substr(md5(k || '|0'), 1, 15) AS UBIGINT) % 1000000000000000000 AS VARCHAR), 18, '0')"
    return f"(CAST((CAST(substr({ds}, 1, 1) AS INT) + {b}) % 10 AS VARCHAR) || substr({ds}, 2, 17))"


def _ordinal(d: str) -> str:
    return (f"({_s(d)} || CASE WHEN {d} BETWEEN 11 AND 13 THEN 'th' WHEN {d} % 10 = 1 THEN 'st' "
            f"WHEN {d} % 10 = 2 THEN 'nd' WHEN {d} % 10 = 3 THEN 'rd' ELSE 'th' END)")


def _avoid(slot: int, lo: int, hi: int, orig: str) -> str:
    x = f"({_draw(slot, hi - lo)} + {lo})"
    return f"(CASE WHEN {orig} IS NOT NULL AND {x} >= {orig} AND {orig} BETWEEN {lo} AND {hi} THEN {x} + 1 ELSE {x} END)"


def generator_sql(b: str) -> str:
    """Replacement for (type, form, k) with bump ``b`` -- the PSE-03..12 formulas in SQL."""
    f = "form"
    strip = f"regexp_replace({f}, '^\\s+|\\s+$', '', 'g')"
    parts = f"len(string_split_regex({strip}, '\\s+'))"
    first = _pick(R.FIRST_NAMES, 0, b)
    last = _pick(R.LAST_NAMES, 2)
    person = (f"CASE WHEN {parts} >= 3 THEN {first} || ' ' || chr(CAST({_rint(1, 65, 90)} AS INT)) || '. ' || {last} "
              f"WHEN {parts} = 2 THEN {first} || ' ' || {last} ELSE {first} END")
    email = f"{_pick(R.EMAIL_NAMES, 0, b)} || {_s(_rint(1, 10, 999))} || '@' || {_pick(R.EMAIL_DOMAINS, 2)}"
    ext_re = "(?i)\\s*(ext\\.?|x|extension)\\s*(\\d{1,5})$"
    has_ext = f"regexp_matches({f}, {q(ext_re)})"
    base = f"(CASE WHEN {has_ext} THEN regexp_replace({f}, {q(ext_re)}, '') ELSE {f} END)"
    d = _digits(b)

    def sd(i, n):
        return f"substr({d}, {i}, {n})"
    body = (f"CASE WHEN starts_with({base}, '+91') THEN '+91-9' || {sd(1, 9)} "
            f"WHEN starts_with({base}, '+') THEN '+1-' || {sd(1, 3)} || '-' || {sd(4, 3)} || '-' || {sd(7, 4)} "
            f"WHEN strpos({base}, '(') > 0 THEN '(' || {sd(1, 3)} || ') ' || {sd(4, 3)} || '-' || {sd(7, 4)} "
            f"WHEN strpos({base}, '.') > 0 THEN {sd(1, 3)} || '.' || {sd(4, 3)} || '.' || {sd(7, 4)} "
            f"WHEN regexp_matches({base}, '^0\\d{{2,4}}[\\s\\-]') THEN '0' || {sd(1, 2)} || '-' || {sd(3, 4)} || '-' || {sd(7, 4)} "
            f"ELSE {sd(1, 3)} || '-' || {sd(4, 3)} || '-' || {sd(7, 4)} END")
    phone = (f"CASE WHEN {has_ext} THEN ({body}) || ' ' || regexp_extract({f}, {q(ext_re)}, 1) || ' ' || "
             f"{_s(_rint(1, 100, 999))} ELSE ({body}) END")
    compact = f"regexp_replace({f}, '[ -]', '', 'g')"
    ssn = (f"CASE WHEN length({compact}) = 12 THEN {sd(1, 4)} || ' ' || {sd(5, 4)} || ' ' || {sd(9, 4)} "
           f"WHEN strpos({f}, '-') > 0 THEN {sd(1, 3)} || '-' || {sd(4, 2)} || '-' || {sd(6, 4)} ELSE {sd(1, 9)} END")
    num = f"('4' || {sd(1, 15)})"
    g = [f"substr({num}, {i}, 4)" for i in (1, 5, 9, 13)]
    dash_sep, space_sep = " || '-' || ", " || ' ' || "
    card = (f"CASE WHEN strpos({f}, '-') > 0 THEN {dash_sep.join(g)} "
            f"WHEN strpos({f}, ' ') > 0 THEN {space_sep.join(g)} ELSE {num} END")
    iso, mdy = "^(\\d{4})-(\\d{2})-(\\d{2})", "^(\\d{2})[/\\-](\\d{2})[/\\-](\\d{4})"
    mon = f"lower(regexp_extract({f}, '(?i)(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)', 1))"
    mon_ix = f"CASE WHEN {mon} <> '' THEN list_position([{', '.join(q(m.lower()) for m in R.SHORT_MONTHS)}], {mon}) END"
    oy = f"TRY_CAST(regexp_extract({f}, '((?:19|20)\\d{{2}})', 1) AS INT)"
    om = (f"CASE WHEN regexp_matches({f}, {q(iso)}) THEN TRY_CAST(regexp_extract({f}, {q(iso)}, 2) AS INT) "
          f"WHEN regexp_matches({f}, {q(mdy)}) THEN TRY_CAST(regexp_extract({f}, {q(mdy)}, 1) AS INT) ELSE {mon_ix} END")
    od = (f"CASE WHEN regexp_matches({f}, {q(iso)}) THEN TRY_CAST(regexp_extract({f}, {q(iso)}, 3) AS INT) "
          f"WHEN regexp_matches({f}, {q(mdy)}) THEN TRY_CAST(regexp_extract({f}, {q(mdy)}, 2) AS INT) "
          f"ELSE TRY_CAST(regexp_extract({f}, '(?:^|[^0-9])([0-9]{{1,2}})(?:[^0-9]|$)', 1) AS INT) END")
    y = _avoid(0, R.DOB_YEARS[0], R.DOB_YEARS[1], f"({oy})")
    m = _avoid(1, 1, 12, f"({om})")
    dd = _avoid(2, R.DOB_DAYS[0], R.DOB_DAYS[1], f"({od})")
    months = "[" + ", ".join(q(x) for x in R.MONTHS) + "]"
    shorts = "[" + ", ".join(q(x) for x in R.SHORT_MONTHS) + "]"
    ys, ms, ds2 = f"lpad({_s(y)}, 4, '0')", f"lpad({_s(m)}, 2, '0')", f"lpad({_s(dd)}, 2, '0')"
    short_used = f"regexp_matches({f}, '(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\\b')"
    dob = (f"CASE WHEN regexp_matches({f}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN {ys} || '-' || {ms} || '-' || {ds2} "
           f"WHEN regexp_matches({f}, '^\\d{{2}}/\\d{{2}}/\\d{{4}}') THEN {ms} || '/' || {ds2} || '/' || {ys} "
           f"WHEN regexp_matches({f}, '^\\d{{2}}-\\d{{2}}-\\d{{4}}') THEN {ms} || '-' || {ds2} || '-' || {ys} "
           f"WHEN regexp_matches({f}, '(?i)^\\d{{1,2}}(?:st|nd|rd|th)\\s+[A-Za-z]+') THEN {_ordinal(dd)} || ' ' || "
           f"CASE WHEN {short_used} THEN {shorts}[{m}] ELSE {months}[{m}] END || ' ' || {ys} "
           f"WHEN regexp_matches({f}, '^[A-Za-z]+\\s+\\d') THEN {months}[{m}] || ' ' || {ds2} || ', ' || {ys} "
           f"WHEN regexp_matches({f}, '^\\d{{1,2}}\\s+[A-Za-z]+') THEN {ds2} || ' ' || {months}[{m}] || ' ' || {ys} "
           f"ELSE {ms} || '/' || {ds2} || '/' || {ys} END")
    v6 = " || ':' || ".join(f"lower(hex({_rint(i, 0, 65535, b if i == 0 else None)}))" for i in range(8))
    o = f"string_split({f}, '.')"
    o1, o2 = f"TRY_CAST({o}[1] AS INT)", f"TRY_CAST({o}[2] AS INT)"
    private = f"(len({o}) = 4 AND ({o1} = 10 OR ({o1} = 172 AND {o2} BETWEEN 16 AND 31) OR ({o1} = 192 AND {o2} = 168)))"
    lastoct = _s(_rint(3, 1, 254, b))
    ip = (f"CASE WHEN strpos({f}, ':') > 0 THEN {v6} "
          f"WHEN {private} THEN CASE WHEN {o1} = 10 THEN '10.' || {_s(_rint(1, 0, 255))} || '.' || {_s(_rint(2, 0, 254))} || '.' || {lastoct} "
          f"WHEN {o1} = 172 THEN '172.' || {_s(_rint(1, 16, 31))} || '.' || {_s(_rint(2, 0, 254))} || '.' || {lastoct} "
          f"ELSE '192.168.' || {_s(_rint(2, 0, 254))} || '.' || {lastoct} END "
          f"ELSE {_pick(R.TEST_NETS, 1)} || '.' || {lastoct} END")
    company = f"{_pick(R.COMPANY_PREFIXES, 0, b)} || ' ' || {_pick(R.COMPANY_SUFFIX_POOL, 1)}"
    low = f"lower({f})"
    n = _s(_rint(0, 1, 999, b))
    india = f"(strpos({low}, 'india') > 0 OR strpos({low}, 'bengaluru') > 0 OR regexp_matches({f}, '\\b\\d{{6}}\\b'))"
    uk = (f"(strpos({low}, 'uk') > 0 OR strpos({low}, 'united kingdom') > 0 OR strpos({low}, 'london') > 0 OR "
          f"regexp_matches({f}, '(?i)\\b[A-Z]{{1,2}}\\d[A-Z\\d]? \\d[A-Z]{{2}}\\b'))")
    address = (f"CASE WHEN regexp_matches({f}, '(?i)^P\\.?O\\.?\\s*Box') THEN 'P.O. Box ' || {_s(_rint(0, 100, 9999, b))} "
               f"WHEN {india} THEN {n} || ' Main Street, Bangalore, Karnataka ' || {_s(_rint(1, 500000, 599999))} || ', India' "
               f"WHEN {uk} THEN {n} || ' High Street, London, SW1A 1AA, United Kingdom' "
               f"ELSE {n} || ' Maple Ave, Springfield, IL ' || {_s(_rint(1, 10000, 99999))} END")
    up = f"string_split(regexp_replace({f}, '/+$', ''), '/')"
    url = (f"CASE WHEN len({up}) <= 1 OR (len({up}) = 3 AND starts_with({up}[1], 'http')) THEN {f} "
           f"ELSE array_to_string(list_concat(list_slice({up}, 1, len({up}) - 1), ['user' || {_s(_rint(0, 1000, 9999, b))}]), '/') END")
    return (f"CASE type WHEN 'PERSON' THEN {person} WHEN 'EMAIL' THEN {email} WHEN 'PHONE' THEN {phone} "
            f"WHEN 'SSN' THEN {ssn} WHEN 'CREDIT_CARD' THEN {card} WHEN 'DOB' THEN {dob} WHEN 'IP_ADDRESS' THEN {ip} "
            f"WHEN 'COMPANY' THEN {company} WHEN 'ADDRESS' THEN {address} WHEN 'URL' THEN {url} END")


KNOWN = "('PERSON', 'EMAIL', 'PHONE', 'SSN', 'CREDIT_CARD', 'DOB', 'IP_ADDRESS', 'COMPANY', 'ADDRESS', 'URL')"


def mapping_sql(src: str, salt: str = "shroud", scope: str = "corpus") -> str:
    """PSE-02: one row per (type, norm) [per doc for scope=document] with form, occurrences, replacement."""
    keys = "type, norm" if scope == "corpus" else "doc_id, type, norm"
    key = (f"{q(salt)} || '|' || type || '|' || norm" if scope == "corpus"
           else f"{q(salt)} || '|' || CAST(doc_id AS VARCHAR) || '|' || type || '|' || norm")
    part = "type" if scope == "corpus" else "doc_id, type"
    return f"""
    SELECT {keys}, form, occurrences,
           CASE WHEN type IN {KNOWN} THEN CASE WHEN r0 = form AND type <> 'URL' THEN r1 ELSE r0 END
                ELSE '[' || type || '_' || CAST(dense_rank() OVER (PARTITION BY {part} ORDER BY fd, fs) AS VARCHAR) || ']' END
           AS replacement
    FROM (SELECT *, {generator_sql('0')} AS r0, {generator_sql('1')} AS r1 FROM (
      SELECT *, {key} AS k FROM (
        SELECT {keys}, first(value ORDER BY doc_id, start) AS form, first(doc_id ORDER BY doc_id, start) AS fd,
               first(start ORDER BY doc_id, start) AS fs, CAST(count(*) AS BIGINT) AS occurrences
        FROM (SELECT *, lower(regexp_replace(value, '^\\s+|\\s+$', '', 'g')) AS norm FROM {src}) GROUP BY {keys})))"""
