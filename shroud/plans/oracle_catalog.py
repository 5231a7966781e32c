"""DuckDB SQL for each registered query (see ``shroud.oracle``)."""

from __future__ import annotations

from .. import oracle as O
from .. import rules as R


def cand(recs):
    return O.with_corpus(O.candidates_sql(recs))


ORACLE = {
    "CAND-01": cand(["email_regex"]),
    "CAND-02": cand(["indian_phone"]),
    "CAND-03": cand(["us_phone"]),
    "CAND-04": cand(["indian_landline"]),
    "CAND-05": cand(["dotted_phone"]),
    "CAND-06": cand(["ssn_dashed"]),
    "CAND-07": cand(["ssn_nodash"]),
    "CAND-08": cand(["national_id_grouped"]),
    "CAND-09": cand([f"card_{n}" for n, _ in R.CARD_PATTERNS]),
    "CAND-10": cand(["ipv4_regex"]),
    "CAND-11": cand(["ipv6_regex"]),
    "CAND-12": cand(["url_regex"]),
    "CAND-13": cand(["person_label"]),
    "CAND-14": cand(["person_header"]),
    "CAND-15": cand(["person_title"]),
    "CAND-16": cand(["person_short_line"]),
    "CAND-17": cand(["company_suffix"]),
    "CAND-18a": cand(["address_street"]),
    "CAND-18b": cand(["address_po_box"]),
    "CAND-18c": cand(["address_pin"]),
    "CAND-18d": cand(["address_label"]),
    "CAND-18e": cand([n for n, _ in R.DOB_PATTERNS]),
}


def scored(select: str) -> str:
    return O.with_corpus(f"WITH scored AS ({O.scored_sql()}) {select}")


def ents(select: str) -> str:
    return O.with_corpus(f"WITH ents AS ({O.entities_sql()}) {select}")


ORACLE.update({
    "VAL-18": scored("SELECT type, coalesce(reject_reason, 'approved') AS reason, CAST(count(*) AS BIGINT) AS n "
                     "FROM scored GROUP BY ALL"),
    "OVL-02": ents("SELECT * FROM ents"),
})


SCORED_COLS = 'doc_id, type, recognizer, start, "end", value, confidence, reject_reason'

#: (entity_type, start, end) of the stand-in external spans of a dossier
EXTERNAL = [
    ("PERSON", "instr(text, 'Dr. ') + 3", "instr(text, ' reviewed the file.') - 1"),
    ("LOCATION", "instr(text, 'Springfield') - 1", "instr(text, 'Springfield') + 10"),
    ("ORG", "instr(text, 'Employed by ') + 11", "instr(text, ' for ') - 1"),
    ("DATE", "instr(text, ' for ') + 4", "instr(text, ' years.') + 5"),
    ("DATE", "instr(text, 'Date of birth: ') + 14", "instr(text, 'Date of birth: ') + 24"),
    ("ORG", "instr(text, 'Spring Boot') - 1", "instr(text, 'Spring Boot') + 10"),
    ("CARDINAL", "instr(text, 'covers ') + 6", "instr(text, ' orders.') - 1"),
]


def scored_ext(select: str, whole: bool = False) -> str:
    """``scored`` with the external spans; documents are scored one by one, so those without such spans are read
    only where the result shows their candidates too (``whole``)."""
    dossiers = O.dossier_sql("customer", "orders", dialect="duckdb")
    spans = ", ".join(f"{{'entity_type': {O.q(t)}, 'start': {lo}, 'end': {hi}, 'score': 0.85::DOUBLE}}" for t, lo, hi in EXTERNAL)
    corpus = "SELECT doc_id, text FROM dossiers" + (f" UNION ALL {O.corpus_sql(with_dossiers=False)}" if whole else "")
    return (f"WITH dossiers AS MATERIALIZED ({dossiers}), corpus AS MATERIALIZED ({corpus}), "
            f"ext AS MATERIALIZED (SELECT doc_id, unnest([{spans}], recursive := true) FROM dossiers), "
            f"scored AS MATERIALIZED ({O.scored_sql(external='ext')}) {select}")


def reason(reasons):
    rl = ", ".join(O.q(r) for r in reasons)
    return scored(f"SELECT {SCORED_COLS} FROM scored WHERE reject_reason IN ({rl})")


def conf(types, recs=None, confs=None):
    w = [f"type IN ({', '.join(O.q(t) for t in types)})", "reject_reason IS NULL"]
    if recs:
        w.append(f"recognizer IN ({', '.join(O.q(r) for r in recs)})")
    if confs:
        w.append(f"confidence IN ({', '.join(repr(float(c)) for c in confs)})")
    return scored(f"SELECT {SCORED_COLS} FROM scored WHERE {' AND '.join(w)}")


UPLOADS = ("SELECT doc_id, source || '_' || CAST(doc_id AS VARCHAR) || '.docx' AS name, "
           "CAST(octet_length(encode(text)) AS BIGINT) AS length, text FROM documents")

HEAD_NAME = ("coalesce(element_at(MAP {" + ", ".join(f"{O.q(k)}: {O.q(v)}" for k, v in R.SECTION_NAMES.items())
             + "}, lower(raw))[1], upper(raw))")
HEADINGS = (f"SELECT doc_id, start, \"end\", raw, {HEAD_NAME} AS name FROM (SELECT doc_id, start, \"end\", "
            f"trim(regexp_extract(value, '^[ \\t]*([A-Z][A-Z &/\\-]+[A-Z])', 1)) AS raw FROM ("
            f"{O.span_sql('corpus', R.HEADING.replace('(?md)', '(?m)'), 0, '_HEADING', 'heading')}))")

ORACLE.update({
    "SRC-01": "SELECT doc_id, text, lang FROM documents",
    "SRC-03": f"SELECT doc_id, name, CASE WHEN NOT ends_with(lower(name), '.docx') THEN 'not_docx' "
              f"WHEN length > {R.MAX_UPLOAD_BYTES} THEN 'too_large' "
              f"WHEN text IS NULL OR NOT regexp_matches(text, '[^\\s\\p{{Z}}\\x1c-\\x1f\\x{{85}}]') THEN 'empty' END AS reject_reason FROM ({UPLOADS})",
    "SRC-04": f"SELECT doc_id, regexp_extract(name, '^(.*)\\.[^.]*$', 1) || '_REDACTED.docx' AS redacted_name FROM ({UPLOADS})",
    "SECT-01": O.with_corpus(HEADINGS),
    "SECT-02": O.with_corpus(f"SELECT raw, name, CAST(count(*) AS BIGINT) AS n FROM ({HEADINGS}) GROUP BY ALL"),
    "SECT-03": O.with_corpus(f"""WITH h AS ({HEADINGS}),
        hs AS (SELECT h.doc_id, h.name, h.start, coalesce(lead(h.start) OVER (PARTITION BY h.doc_id ORDER BY h.start),
                      length(c.text)) AS "end", row_number() OVER (PARTITION BY h.doc_id ORDER BY h.start) AS rn
               FROM h JOIN corpus c USING (doc_id)),
        first AS (SELECT doc_id, min(start) AS fs FROM h GROUP BY doc_id),
        secs AS (
          SELECT doc_id, 'HEADER' AS name, 0 AS start, fs AS "end", 0 AS rn FROM first WHERE fs > 0
          UNION ALL SELECT doc_id, name, start, "end", rn FROM hs
          UNION ALL SELECT doc_id, 'BODY', 0, length(text), 0 FROM corpus WHERE doc_id NOT IN (SELECT doc_id FROM first))
        SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY rn) - 1 AS BIGINT) AS ord, name,
               CAST(start AS BIGINT) AS start, CAST("end" AS BIGINT) AS "end" FROM secs"""),
    "SECT-04": scored("SELECT doc_id, recognizer, start, section FROM scored WHERE type = 'PERSON'"),
    "JOIN-03": scored("SELECT doc_id, type, recognizer, start, section FROM scored"),
    "SECT-05": scored("SELECT doc_id, CAST(sum(CASE WHEN section IN ("
                      + ", ".join(O.q(x) for x in R.SUPPRESSED_SECTIONS)
                      + ") THEN 1 ELSE 0 END) AS BIGINT) AS suppressed, CAST(count(*) AS BIGINT) AS person_candidates "
                        "FROM scored WHERE type = 'PERSON' GROUP BY doc_id"),
    "CAND-19": scored_ext(f"SELECT {SCORED_COLS} FROM scored WHERE recognizer = 'external'"),
    "CAND-20": O.with_corpus(f"SELECT doc_id, type, recognizer, start, \"end\", value, 0.9::DOUBLE AS score FROM ("
                             + O.span_sql("(SELECT * FROM corpus WHERE strpos(text, 'Invoice') > 0)",
                                          r"(\bInvoice )(\d+)", 2, "INVOICE_NO", "invoice_number") + ")"),
    "CTX-01": O.with_corpus("SELECT s.doc_id, s.start, s.\"end\", substring(c.text, greatest(s.start - 80, 0) + 1, "
                            "least(s.\"end\" + 80, length(c.text)) - greatest(s.start - 80, 0)) AS context FROM ("
                            + O.span_sql("corpus", R.EMAIL, 0, "EMAIL", "email_regex")
                            + ") s JOIN corpus c USING (doc_id)"),
    "CTX-02": ents("SELECT doc_id, id, start, context FROM ents"),
    "CTX-03": O.with_corpus(O.candidates_sql(["indian_phone", "us_phone", "indian_landline", "dotted_phone"])
                            .replace("WHERE score IS NOT NULL", "WHERE score IS NOT NULL AND score > 0.9")),
    "JOIN-01": reason(["protected_overlap"]),
    "JOIN-02": reason(["duplicate_span"]),
    "VAL-01": O.with_corpus(O.candidates_sql([rec for _, rec, _, _ in O.SPECS if not rec.startswith(("heading", "url_line"))]
                                             + ["person_header"]).replace(
        'SELECT doc_id, type, recognizer, start, end_ AS "end", value, score FROM sc WHERE score IS NOT NULL',
        "SELECT type, type IN ('URL', 'EMAIL', 'PHONE', 'SSN', 'CREDIT_CARD', 'IP_ADDRESS') AS structured, "
        "CAST(count(*) AS BIGINT) AS n FROM sc WHERE score IS NOT NULL GROUP BY ALL")),
    "VAL-02": scored("SELECT type, CAST(count(*) AS BIGINT) AS approved, min(confidence) AS min_confidence "
                     "FROM scored WHERE reject_reason IS NULL GROUP BY type"),
    "VAL-03": reason(["ip_version"]),
    "VAL-04": reason(["ip_in_url"]),
    "VAL-05": reason(["suppressed_section"]),
    "VAL-07": reason(["tech_denylist", "field_name"]),
    "VAL-08": reason(["label_colon"]),
    "VAL-09": conf(["PERSON"], confs=[R.PERSON_SCORES["label_ctx"]]),
    "VAL-10": conf(["PERSON"], recs=["person_header"]),
    "VAL-11": scored_ext(f"SELECT {SCORED_COLS} FROM scored WHERE reject_reason IN ('company_lowercase', 'company_no_suffix')", whole=True),
    "VAL-12": conf(["COMPANY"]),
    "VAL-13": reason(["company_institution"]),
    "VAL-14": reason(["address_prefix", "address_heading_number"]),
    "VAL-15": scored_ext(f"SELECT {SCORED_COLS} FROM scored WHERE recognizer = 'external' AND type = 'DOB'"),
    "VAL-16": scored_ext(f"SELECT {SCORED_COLS} FROM scored WHERE reject_reason IN ('location', 'unknown_type')"),
    "VAL-17": scored(f"SELECT {SCORED_COLS} FROM scored WHERE type = 'DOB' AND reject_reason IS NULL "
                     "AND regexp_matches(value, '(?i)^\\d{1,2}(st|nd|rd|th)\\s')"),
    "OVL-01": scored("SELECT doc_id, type, recognizer, start, \"end\", confidence FROM scored WHERE reject_reason IS NULL"),
    "OVL-03": O.with_corpus(f"""WITH scored AS ({O.scored_sql()}), ents AS ({O.entities_sql()}),
        a AS (SELECT doc_id, CAST(count(*) AS BIGINT) AS candidates FROM scored WHERE reject_reason IS NULL GROUP BY doc_id),
        e AS (SELECT doc_id, CAST(count(*) AS BIGINT) AS entities FROM ents GROUP BY doc_id)
        SELECT a.doc_id, a.candidates, coalesce(e.entities, 0) AS entities FROM a LEFT JOIN e USING (doc_id)"""),
    "OVL-04": ents("SELECT CAST(count(*) AS BIGINT) AS checked, CAST(sum(CASE WHEN substring(c.text, e.start + 1, "
                   "e.\"end\" - e.start) = e.value THEN 0 ELSE 1 END) AS BIGINT) AS mismatched "
                   "FROM ents e JOIN corpus c USING (doc_id)"),
    "OVL-05": scored("""SELECT doc_id, CAST(min(start) AS BIGINT) AS start, CAST(max("end") AS BIGINT) AS "end",
        CAST(count(*) AS BIGINT) AS size FROM (
          SELECT *, sum(nw) OVER (PARTITION BY doc_id ORDER BY start, "end" DESC, confidence DESC, type, recognizer, value
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM (
            SELECT *, CASE WHEN pm IS NULL OR start > pm THEN 1 ELSE 0 END AS nw FROM (
              SELECT *, max("end") OVER (PARTITION BY doc_id ORDER BY start, "end" DESC, confidence DESC, type, recognizer, value
                                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm
              FROM scored WHERE reject_reason IS NULL)))
        GROUP BY doc_id, island HAVING count(*) > 1"""),
    "OVL-06": ents('SELECT a.doc_id, a.id, a.start, a."end" FROM ents a JOIN ents b ON a.doc_id = b.doc_id '
                   'AND b.id < a.id AND a.start < b."end" AND b.start < a."end"'),
    "OVL-07": ents("SELECT doc_id, id, type, start FROM ents"),
})


# ------------------------------------------------------------------ pseudonyms, redaction, stats, evaluation

def with_map(select: str, scope: str = "corpus") -> str:
    """CTEs: ents (entities), mp (mapping), pe (entities + replacement)."""
    keys = "type, norm" if scope == "corpus" else "doc_id, type, norm"
    return ents(f""", mp AS ({O.mapping_sql('ents', scope=scope)}),
        pe AS (SELECT e.*, m.replacement FROM (SELECT *, lower(regexp_replace(value, '^\\s+|\\s+$', '', 'g')) AS norm
               FROM ents) e LEFT JOIN mp m USING ({keys}))
        {select}""".replace("\n", " ", 0))


def _fix(sql: str) -> str:
    # ents(select) builds "WITH ents AS (...) <select>"; a select starting with ', x AS' extends the WITH
    return sql.replace(") ,", "),")


def mp(select: str, scope: str = "corpus") -> str:
    return _fix(with_map(select, scope))


MAP_COLS = "type, norm, form, occurrences, replacement"
OVERRIDES = "SELECT doc_id, id, 'redacted@example.org' AS replacement FROM ents WHERE type = 'EMAIL' AND doc_id % 2 = 0"
REDACT = """(SELECT c.doc_id, CASE WHEN r.sp IS NULL THEN c.text ELSE list_reduce(r.sp, lambda acc, x:
               substring(acc, 1, x.s) || x.r || substring(acc, x.e + 1), c.text) END AS redacted_text, c.text
             FROM corpus c LEFT JOIN (SELECT doc_id, list({'s': start, 'e': "end", 'r': replacement} ORDER BY start DESC) AS sp
                                      FROM {src} GROUP BY doc_id) r USING (doc_id))"""
PE_EDIT = f"(SELECT pe.* EXCLUDE (replacement), coalesce(o.replacement, pe.replacement) AS replacement, o.replacement IS NOT NULL AS edited FROM pe LEFT JOIN ({OVERRIDES}) o USING (doc_id, id))"
#: the edited list of RED-04: overlapping spans become one, added ones win
PE_LIST = f"""(SELECT doc_id, CAST(min(start) AS BIGINT) AS start, CAST(max("end") AS BIGINT) AS "end",
               arg_min(replacement, {{'r': rank, 'l': start - "end", 's': start, 'x': replacement}}) AS replacement FROM (
               SELECT *, sum(CASE WHEN reach IS NULL OR start >= reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY start, "end" DESC, rank, replacement
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM (
               SELECT *, max("end") OVER (PARTITION BY doc_id ORDER BY start, "end" DESC, rank, replacement
                                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM (
               SELECT doc_id, start, "end", replacement, 1 AS rank FROM {PE_EDIT} WHERE NOT (type = 'URL' AND doc_id % 3 = 0)
               UNION ALL SELECT doc_id, 0, 12, '[BY HAND]', 0 FROM corpus WHERE doc_id % 5 = 0 AND length(text) >= 12)))
             GROUP BY doc_id, g)"""
PARTS = "(SELECT doc_id, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS BIGINT) AS ix, unnest(string_split(text, chr(10))) AS text FROM corpus)"
VMAP = """(SELECT doc_id, list({'o': original, 'r': replacement} ORDER BY -length(original), first_id) AS vm FROM (
             SELECT doc_id, value AS original, arg_max(replacement, id) AS replacement, min(id) AS first_id FROM pe GROUP BY doc_id, value)
           GROUP BY doc_id)"""
RED02 = f"""(SELECT p.doc_id, p.ix, CASE WHEN v.vm IS NULL THEN p.text ELSE list_reduce(v.vm, lambda acc, m:
               CASE WHEN strpos(acc, m.o) > 0 THEN replace(acc, m.o, m.r) ELSE acc END, p.text) END AS redacted_text, p.text
             FROM {PARTS} p LEFT JOIN {VMAP} v USING (doc_id))"""
STATS = """(SELECT c.doc_id, CAST(coalesce(t.total, 0) AS BIGINT) AS total_entities, coalesce(t.by_type, '') AS entities_by_type,
              coalesce(round(t.s / t.total, 2), 0.0) AS avg_confidence FROM {corpus} c LEFT JOIN (
              SELECT doc_id, sum(n) AS total, string_agg(type || ':' || CAST(n AS VARCHAR), ',' ORDER BY type) AS by_type, sum(sc) AS s
              FROM (SELECT doc_id, type, count(*) AS n, sum(confidence) AS sc FROM ents GROUP BY doc_id, type) GROUP BY doc_id) t USING (doc_id))"""
LABELS = "MAP {" + ", ".join(f"{O.q(k)}: {O.q(v)}" for k, v in
                             {"PERSON": "PERSON", "EMAIL": "EMAIL", "PHONE": "PHONE", "SSN": "SSN", "CREDIT_CARD": "CC#",
                              "DOB": "DOB", "IP_ADDRESS": "IP", "COMPANY": "ORG", "ADDRESS": "ADDR"}.items()) + "}"

ORACLE.update({
    "PSE-01": ents(", x AS (SELECT 1) SELECT DISTINCT type, value, lower(regexp_replace(value, '^\\s+|\\s+$', '', 'g')) AS norm FROM ents"),
    "PSE-02": mp(f", y AS (SELECT 1) SELECT {MAP_COLS} FROM mp"),
    "PSE-14": mp(", y AS (SELECT 1) SELECT type, CAST(count(*) AS BIGINT) AS \"values\", "
                 "CAST(sum(CASE WHEN replacement = form THEN 1 ELSE 0 END) AS BIGINT) AS unchanged FROM mp GROUP BY type"),
    "PSE-15": mp(f", y AS (SELECT 1) SELECT doc_id, {MAP_COLS} FROM mp", scope="document"),
    "PSE-13": O.with_corpus(f"WITH inv AS (SELECT doc_id, type, start, value FROM ("
                            + O.span_sql("(SELECT * FROM corpus WHERE strpos(text, 'Invoice') > 0)",
                                         r"(\bInvoice )(\d+)", 2, "INVOICE_NO", "invoice_number")
                            + f")) SELECT {MAP_COLS} FROM ({O.mapping_sql('inv')})"),
    "JOIN-04": mp(", y AS (SELECT 1) SELECT doc_id, id, type, value, replacement FROM pe"),
    "JOIN-05": mp(f", y AS (SELECT 1) SELECT doc_id, id, replacement, edited FROM {PE_EDIT}"),
    "RED-01": mp(", y AS (SELECT 1) SELECT doc_id, redacted_text FROM " + REDACT.replace("{src}", "pe")),
    "RED-02": mp(f", y AS (SELECT 1) SELECT doc_id, ix, redacted_text, redacted_text <> text AS changed FROM {RED02}"),
    "RED-03": mp(f", y AS (SELECT 1) SELECT doc_id, CAST(sum(CASE WHEN redacted_text <> text THEN 1 ELSE 0 END) AS BIGINT) AS changed_parts, "
                 f"CAST(count(*) AS BIGINT) AS parts FROM {RED02} GROUP BY doc_id"),
    "RED-04": mp(", y AS (SELECT 1) SELECT doc_id, redacted_text FROM " + REDACT.replace("{src}", PE_LIST)),
    "RED-05": mp(", y AS (SELECT 1) SELECT doc_id, side, CAST(para AS BIGINT) AS para, line FROM ("
                 "SELECT doc_id, 'original' AS side, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS para, "
                 "unnest(string_split(text, chr(10))) AS line FROM " + REDACT.replace("{src}", "pe") +
                 " UNION ALL SELECT doc_id, 'redacted', generate_subscripts(string_split(redacted_text, chr(10)), 1) - 1, "
                 "unnest(string_split(redacted_text, chr(10))) FROM " + REDACT.replace("{src}", "pe") +
                 ") WHERE regexp_matches(line, '[^\\s\\p{Z}\\x1c-\\x1f\\x{85}]')"),
    "AGG-01": ents(", y AS (SELECT 1) SELECT * FROM " + STATS.replace("{corpus}", "corpus")),
    "AGG-02": ents(", y AS (SELECT 1) SELECT type, CAST(count(*) AS BIGINT) AS n FROM ents GROUP BY type "
                   "UNION ALL SELECT 'ALL', CAST(count(*) AS BIGINT) FROM ents"),
    "AGG-03": ents(", y AS (SELECT 1) SELECT CAST(count(DISTINCT type) AS BIGINT) AS distinct_types FROM ents"),
    "AGG-04": ents(", y AS (SELECT 1) SELECT type, CAST(count(*) AS BIGINT) AS n, round(avg(confidence), 4) AS avg_confidence "
                   "FROM ents GROUP BY type"),
    "AGG-05": ents(", y AS (SELECT 1) SELECT type, CAST(count(*) AS BIGINT) AS n FROM ents GROUP BY type HAVING count(*) > 0"),
    "AGG-05-tab": ents(", y AS (SELECT 1) SELECT doc_id, id, type, value, confidence FROM ents WHERE type = 'EMAIL'"),
    "AGG-06": ents(f", y AS (SELECT 1) SELECT doc_id, id, type, value, confidence FROM ents WHERE confidence < 0.9"),
    "AGG-07": mp(f", y AS (SELECT 1) SELECT doc_id, repeat('0', greatest(3 - length(CAST(id AS VARCHAR)), 0)) || CAST(id AS VARCHAR) AS row_id, "
                 f"coalesce(element_at({LABELS}, type)[1], type) AS type_label, value AS original, replacement, "
                 f"CAST(round(confidence * 100) AS BIGINT) AS confidence_pct FROM pe"),
    # the stream reads `documents` alone
    "STR-01": mp(", y AS (SELECT 1) SELECT s.*, r.redacted_text FROM " + STATS.replace("{corpus}", "corpus") + " s JOIN "
                 + REDACT.replace("{src}", "pe") + " r USING (doc_id)").replace(O.corpus_sql(), "SELECT doc_id, text FROM documents"),
})
for _t, _k in [("PERSON", "PSE-03"), ("EMAIL", "PSE-04"), ("PHONE", "PSE-05"), ("SSN", "PSE-06"),
               ("CREDIT_CARD", "PSE-07"), ("DOB", "PSE-08"), ("IP_ADDRESS", "PSE-09"), ("COMPANY", "PSE-10"),
               ("ADDRESS", "PSE-11"), ("URL", "PSE-12")]:
    ORACLE[_k] = mp(f", y AS (SELECT 1) SELECT {MAP_COLS} FROM mp WHERE type = '{_t}'")


def _truth_sql() -> str:
    from .catalog import TRUTH_PATTERNS
    parts = [f"SELECT doc_id, {O.q(t)} AS type, regexp_extract(text, {O.q(p)}, 1) AS value, regexp_extract(text, {O.q(p)}, 0) AS line FROM dossiers"
             for t, p in TRUTH_PATTERNS]
    return " UNION ALL ".join(parts)


def _traps_sql() -> str:
    from .catalog import TRAPS
    parts = [f"SELECT doc_id, {O.q(v)} AS value, instr(text, {O.q(v)}) - 1 AS start, length({O.q(v)}) AS n FROM dossiers"
             for v in TRAPS]
    parts.append("SELECT doc_id, 'invoice number', instr(text, chr(10) || 'Invoice ') + 8, "
                 "length(regexp_extract(text, '\\nInvoice ([0-9]+) ', 1)) FROM dossiers")
    return " UNION ALL ".join(parts)


def evals(select: str) -> str:
    dossiers = O.dossier_sql("customer", "orders", dialect="duckdb")
    return mp(f""", dossiers AS ({dossiers}), truth AS ({_truth_sql()}),
        de AS (SELECT * FROM ents WHERE doc_id >= {DOSSIER_OFFSET} AND doc_id < {PAGES_OFFSET}),
        m AS (SELECT doc_id, type, value, occ, coalesce(p.predicted, 0) AS predicted, coalesce(t.expected, 0) AS expected
              FROM (SELECT doc_id, type, value, row_number() OVER (PARTITION BY doc_id, type, value ORDER BY start) AS occ,
                           1 AS predicted FROM de) p
              FULL OUTER JOIN (SELECT doc_id, type, value, row_number() OVER (PARTITION BY doc_id, type, value) AS occ,
                                      1 AS expected FROM truth) t USING (doc_id, type, value, occ)),
        conf AS (SELECT type, CAST(sum(predicted * expected) AS BIGINT) AS tp, CAST(sum(predicted * (1 - expected)) AS BIGINT) AS fp,
                        CAST(sum((1 - predicted) * expected) AS BIGINT) AS fn FROM m GROUP BY type),
        prf AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS p,
                          CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS r FROM conf),
        prf2 AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f FROM prf)
        {select}""")


from ..sources.docs import DOSSIER_OFFSET, PAGES_OFFSET  # noqa: E402

ORACLE.update({
    "EVAL-01": evals("SELECT type, tp, fp, fn FROM conf"),
    "EVAL-02": evals("SELECT type, tp, fp, fn, round(p, 4) AS precision, round(r, 4) AS recall, round(f, 4) AS f1 FROM prf2"),
    "EVAL-03": evals("""SELECT round(CASE WHEN mp + mr > 0 THEN 2 * mp * mr / (mp + mr) ELSE 0.0 END, 4) AS micro_f1,
                               round(macro, 4) AS macro_f1 FROM (
                          SELECT CASE WHEN sum(tp) + sum(fp) > 0 THEN sum(tp) / (sum(tp) + sum(fp)) ELSE 0.0 END AS mp,
                                 CASE WHEN sum(tp) + sum(fn) > 0 THEN sum(tp) / (sum(tp) + sum(fn)) ELSE 0.0 END AS mr,
                                 avg(f) AS macro FROM prf2)"""),
    "EVAL-05": mp(""", y AS (SELECT 1) SELECT CAST(count(*) AS BIGINT) AS keys,
        CAST(sum(CASE WHEN n = 1 THEN 1 ELSE 0 END) AS BIGINT) AS deterministic,
        round(sum(CASE WHEN n = 1 THEN 1 ELSE 0 END) / count(*), 4) AS rate
        FROM (SELECT type, norm, count(DISTINCT replacement) AS n FROM pe GROUP BY type, norm)"""),
    "EVAL-07": evals(f""", traps AS ({_traps_sql()})
        SELECT t.value AS trap, CAST(count(t.doc_id) AS BIGINT) AS occurrences, CAST(count(e.doc_id) AS BIGINT) AS flagged
        FROM traps t LEFT JOIN de e ON t.doc_id = e.doc_id AND e.start < t.start + t.n AND e."end" > t.start
        GROUP BY t.value""".replace("\n        SELECT t.value", " SELECT t.value", 1)),
    "EVAL-08": O.with_corpus(f"""WITH scored AS ({O.scored_sql()}), ents AS ({O.entities_sql()})
        SELECT CAST(count(*) AS BIGINT) AS raw, CAST(sum(CASE WHEN reject_reason IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS rejected,
               CAST(sum(CASE WHEN reject_reason IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS approved,
               (SELECT CAST(count(*) AS BIGINT) FROM ents) AS final FROM scored"""),
    "EVAL-09": mp(f""", y AS (SELECT 1) SELECT CAST(count(*) AS BIGINT) AS entities,
        CAST(sum(CASE WHEN edited THEN 1 ELSE 0 END) AS BIGINT) AS edited,
        round(sum(CASE WHEN edited THEN 1 ELSE 0 END) / count(*), 4) AS rate FROM {PE_EDIT}"""),
})


_PROT = "('URL', 'EMAIL', 'PHONE', 'SSN', 'CREDIT_CARD', 'IP_ADDRESS')"
ORACLE.update({
    "UDF-01": O.with_corpus(f"""WITH scored AS ({O.scored_sql()}),
        inv AS ({O.span_sql("(SELECT * FROM corpus WHERE strpos(text, 'Invoice') > 0)", r"(\bInvoice )(\d+)", 2,
                            "INVOICE_NO", "invoice_number")})
        SELECT i.doc_id, i.type, i.recognizer, i.start, i."end", i.value, 0.9::DOUBLE AS confidence,
               CASE WHEN EXISTS (SELECT 1 FROM scored p WHERE p.doc_id = i.doc_id AND p.type IN {_PROT}
                                 AND p.start < i."end" AND p."end" > i.start) THEN 'protected_overlap'
                    ELSE 'unknown_type' END AS reject_reason
        FROM inv i"""),
    "UDF-02": ents(f""", pm AS (SELECT * FROM ents WHERE type = 'PERSON')
        SELECT type, norm, form, occurrences, CASE WHEN r0 = form THEN r1 ELSE r0 END AS replacement FROM (
          SELECT *, 'PERSON-' || lpad(CAST(CAST('0x' || substr(md5(k || '|0'), 1, 8) AS BIGINT) % 10000 AS VARCHAR), 4, '0') AS r0,
                    'PERSON-' || lpad(CAST((CAST('0x' || substr(md5(k || '|0'), 1, 8) AS BIGINT) + 1) % 10000 AS VARCHAR), 4, '0') AS r1
          FROM (SELECT *, 'shroud|' || type || '|' || norm AS k FROM (
            SELECT type, norm, first(value ORDER BY doc_id, start) AS form, CAST(count(*) AS BIGINT) AS occurrences
            FROM (SELECT *, lower(regexp_replace(value, '^\\s+|\\s+$', '', 'g')) AS norm FROM pm) GROUP BY type, norm)))"""),
})


_CARD_SPANS = " UNION ALL ".join(O.span_sql("corpus", p, 0, "CREDIT_CARD", f"card_{n}") for n, p in R.CARD_PATTERNS)
ORACLE.update({
    "FUN-01": "WITH corpus AS (SELECT doc_id, text FROM documents) SELECT doc_id, start, \"end\", value FROM ("
              + O.span_sql("corpus", r"[0-9]+", 0, "N", "n") + ")",
    "FUN-02": O.with_corpus(f"SELECT doc_id, recognizer, start, value, {O.luhn('value')} AS luhn_ok FROM ({_CARD_SPANS})"),
    "FUN-03": O.with_corpus(O.candidates_sql(["indian_phone", "us_phone", "indian_landline", "dotted_phone"]).replace(
        'SELECT doc_id, type, recognizer, start, end_ AS "end", value, score FROM sc WHERE score IS NOT NULL',
        "SELECT doc_id, start, value, regexp_replace(value, '[^0-9]', '', 'g') AS digits, "
        "CAST(length(regexp_replace(value, '[^0-9]', '', 'g')) AS BIGINT) AS n_digits FROM sc WHERE score IS NOT NULL")),
    "FUN-04": "SELECT o_orderkey, CAST(day(o_orderdate) AS VARCHAR) || CASE WHEN day(o_orderdate) BETWEEN 11 AND 13 THEN 'th' "
              "WHEN day(o_orderdate) % 10 = 1 THEN 'st' WHEN day(o_orderdate) % 10 = 2 THEN 'nd' "
              "WHEN day(o_orderdate) % 10 = 3 THEN 'rd' ELSE 'th' END AS day_ordinal FROM orders",
    "FUN-05": O.with_corpus(O.candidates_sql(["ipv4_regex"]).replace(
        'SELECT doc_id, type, recognizer, start, end_ AS "end", value, score FROM sc WHERE score IS NOT NULL',
        "SELECT doc_id, start, value, (len(string_split(value, '.')) = 4 AND (CAST(string_split(value, '.')[1] AS INT) = 10 "
        "OR (CAST(string_split(value, '.')[1] AS INT) = 172 AND CAST(string_split(value, '.')[2] AS INT) BETWEEN 16 AND 31) "
        "OR (CAST(string_split(value, '.')[1] AS INT) = 192 AND CAST(string_split(value, '.')[2] AS INT) = 168))) AS private "
        "FROM sc WHERE score IS NOT NULL")),
    "FUN-06": O.with_corpus("SELECT doc_id, regexp_extract(text, '^(?:[ \\t\\r\\f\\v]*\\n)*([^\\n]*)', 1) AS first_line FROM corpus"),
    "FUN-07": O.with_corpus("SELECT s.doc_id, s.start, regexp_extract(substring(c.text, 1, s.\"end\"), '([^\\n]*)$', 1) AS line FROM ("
                            + O.span_sql("corpus", R.EMAIL, 0, "EMAIL", "email_regex") + ") s JOIN corpus c USING (doc_id)"),
    "VAL-06": O.with_corpus(O.candidates_sql(["person_label", "person_title", "person_header", "person_short_line"]).replace(
        'SELECT doc_id, type, recognizer, start, end_ AS "end", value, score FROM sc WHERE score IS NOT NULL',
        f"SELECT doc_id, start, value, substr(value, 1, length(value) - length(regexp_extract(value, {O.q(R.PERSON_STREET_SUFFIX)}, 1))) AS kept "
        f"FROM sc WHERE score IS NOT NULL AND regexp_matches(value, {O.q(R.PERSON_STREET_SUFFIX)})")),
})


_EVAL04 = evals(f""", tok AS ({O.span_sql('dossiers', r'\S+', 0, '_TOKEN', 'token')}),
    tsp AS (SELECT t.doc_id, instr(d.text, t.line) + instr(t.line, t.value) - 2 AS start, instr(d.text, t.line) + instr(t.line, t.value) - 2 + length(t.value) AS "end"
            FROM truth t JOIN dossiers d USING (doc_id)),
    fl AS (SELECT CASE WHEN EXISTS (SELECT 1 FROM de e WHERE e.doc_id = k.doc_id AND e.start < k."end" AND e."end" > k.start)
                       THEN 1 ELSE 0 END AS pred,
                  CASE WHEN EXISTS (SELECT 1 FROM tsp s WHERE s.doc_id = k.doc_id AND s.start < k."end" AND s."end" > k.start)
                       THEN 1 ELSE 0 END AS exp FROM tok k),
    ag AS (SELECT sum(pred * exp) AS tp, sum(pred * (1 - exp)) AS fp, sum((1 - pred) * exp) AS fn,
                  sum((1 - pred) * (1 - exp)) AS tn FROM fl)
    SELECT CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn,
           round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END, 4) AS precision,
           round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END, 4) AS recall,
           round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END, 4) AS f1,
           round((tp + tn) / (tp + fp + fn + tn), 4) AS accuracy FROM ag""".replace(
    "FROM tok k)", "FROM tok k)"))

_DOSS = O.dossier_sql("customer", "orders", dialect="duckdb")
_EVAL06 = O.with_corpus(f"""WITH scored AS ({O.scored_sql()}), ents AS ({O.entities_sql()}),
    dossiers AS ({_DOSS}), truth AS ({_truth_sql()}),
    de AS (SELECT * FROM ents WHERE doc_id >= {DOSSIER_OFFSET} AND doc_id < {PAGES_OFFSET}),
    ap AS (SELECT * FROM scored WHERE reject_reason IS NULL AND doc_id >= {DOSSIER_OFFSET} AND doc_id < {PAGES_OFFSET}),
    isl AS (SELECT doc_id, island, min(start) AS s, max("end") AS e FROM (
              SELECT *, sum(nw) OVER (PARTITION BY doc_id ORDER BY start, "end" DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island
              FROM (SELECT *, CASE WHEN pm IS NULL OR start >= pm THEN 1 ELSE 0 END AS nw FROM (
                      SELECT *, max("end") OVER (PARTITION BY doc_id ORDER BY start, "end" DESC
                                                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM ap)))
            GROUP BY doc_id, island HAVING count(*) > 1),
    won AS (SELECT DISTINCT e.doc_id, e.type, e.value FROM de e JOIN isl c ON e.doc_id = c.doc_id AND e.start >= c.s AND e."end" <= c.e)
    SELECT CAST(count(*) AS BIGINT) AS resolved, CAST(count(t.doc_id) AS BIGINT) AS correct,
           round(CASE WHEN count(*) > 0 THEN count(t.doc_id) / count(*) ELSE 0.0 END, 4) AS accuracy
    FROM won LEFT JOIN (SELECT DISTINCT doc_id, type, value FROM truth) t USING (doc_id, type, value)""")

ORACLE.update({"EVAL-04": _EVAL04, "EVAL-06": _EVAL06})
