"""Registered queries: one per inventory ID, each ``(spark, sf_dir) -> DataFrame`` over whole tables.

The detection input is ``documents`` plus the dossier corpus Spark derives from
``customer`` + ``orders`` (see ``sources.docs``). Every output column that is computed is
aliased, integer columns are BIGINT, so the DuckDB oracle can be compared column by column.
"""

from __future__ import annotations

import weakref

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rules as R
from ..operators import overlap, pseudonyms, recognizers, redact, sections, stats
from ..operators.recognizers import Spec
from ..sources import docs as S
from . import detect as D
from . import evaluate as EV

CAND_COLS = ["doc_id", "type", "recognizer", "start", "end", "value", "score"]

_PLANS: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def plan_cache(fn):
    """Reuse the analyzed logical plan of a builder per (session, data dir).

    Only plans are shared -- every query still executes from the parquet tables; checkpointed
    (materialized) frames are never cached here."""
    def wrapper(spark: SparkSession, sf: str) -> DataFrame:
        plans = _PLANS.setdefault(spark, {})
        key = (fn.__name__, sf)
        if key not in plans:
            plans[key] = fn(spark, sf)
        return plans[key]
    wrapper.__name__ = fn.__name__
    wrapper.__doc__ = fn.__doc__
    return wrapper


def _big(df: DataFrame, *cols: str) -> DataFrame:
    for c in cols:
        df = df.withColumn(c, F.col(c).cast("bigint"))
    return df


PARTITIONS = "spark.shroud.corpus.partitions"


def laid_out(df: DataFrame) -> DataFrame:
    """The documents in as many partitions as the session option ``PARTITIONS`` asks for.

    The option is for tables of a few row groups, which one task would read; unset (a cluster), the scan's
    splits are kept and no text moves."""
    n = df.sparkSession.conf.get(PARTITIONS, None)
    return df.repartition(int(n), "doc_id") if n else df


@plan_cache
def corpus(spark: SparkSession, sf: str) -> DataFrame:
    return laid_out(S.corpus(spark, sf))


@plan_cache
def raw(spark: SparkSession, sf: str) -> DataFrame:
    """All raw candidates of the shipped recognizers (+ short-line names)."""
    specs = recognizers.builtin_specs() + [recognizers.short_line_spec()]
    return recognizers.raw_candidates(corpus(spark, sf), specs)


def cand(recs: list[str]):
    def q(spark: SparkSession, sf: str) -> DataFrame:
        r = raw(spark, sf).filter(F.col("recognizer").isin(*recs)).select(*CAND_COLS)
        return _big(r, "start", "end")
    return q


@plan_cache
def scored(spark: SparkSession, sf: str) -> DataFrame:
    return D.scored_candidates(corpus(spark, sf))


@plan_cache
def entities(spark: SparkSession, sf: str) -> DataFrame:
    return D.detect(corpus(spark, sf))


SCORED_COLS = ["doc_id", "type", "recognizer", "start", "end", "value", "confidence", "reject_reason"]


def scored_view(spark: SparkSession, sf: str) -> DataFrame:
    return _big(scored(spark, sf).select(*SCORED_COLS), "start", "end")


def entity_view(spark: SparkSession, sf: str) -> DataFrame:
    return _big(entities(spark, sf), "id", "start", "end")


def q_rejections(spark, sf):
    """VAL-18: rejection log counts per (type, reason)."""
    s = scored(spark, sf)
    return s.groupBy("type", F.coalesce(F.col("reject_reason"), F.lit("approved")).alias("reason")).agg(
        F.count(F.lit(1)).cast("bigint").alias("n"))


def q_reason(reasons: list[str], external: bool = False):
    def q(spark, sf):
        s = _big(scored_ext(spark, sf).select(*SCORED_COLS), "start", "end") if external else scored_view(spark, sf)
        return s.filter(F.col("reject_reason").isin(*reasons))
    return q


def q_src01(spark, sf):
    return S.read_docs(spark, f"{sf}/documents.parquet", keep=["lang"])


def _uploads(spark, sf):
    d = S.read_table(spark, sf, "documents")
    return d.select("doc_id", F.concat(F.col("source"), F.lit("_"), F.col("doc_id").cast("string"), F.lit(".docx")).alias("name"),
                    F.octet_length("text").cast("bigint").alias("length"), "text")


def q_src03(spark, sf):
    return S.intake(_uploads(spark, sf)).select("doc_id", "name", "reject_reason")


def q_src04(spark, sf):
    return _uploads(spark, sf).select("doc_id", redact.redacted_name(F.col("name")).alias("redacted_name"))


def q_sect01(spark, sf):
    return _big(sections.headings(corpus(spark, sf)), "start", "end")


def q_sect02(spark, sf):
    h = sections.headings(corpus(spark, sf))
    return h.groupBy("raw", "name").agg(F.count(F.lit(1)).cast("bigint").alias("n"))


def q_sect03(spark, sf):
    return _big(sections.sections(corpus(spark, sf)), "ord", "start", "end")


def q_sect04(spark, sf):
    s = scored(spark, sf).filter(F.col("type") == "PERSON")
    return _big(s.select("doc_id", "recognizer", "start", "section"), "start")


def q_join03(spark, sf):
    s = scored(spark, sf)
    return _big(s.select("doc_id", "type", "recognizer", "start", "section"), "start")


def q_sect05(spark, sf):
    s = scored(spark, sf).filter(F.col("type") == "PERSON")
    return s.groupBy("doc_id").agg(F.sum(sections.in_suppressed_section(F.col("section")).cast("int")).cast("bigint")
                                   .alias("suppressed"), F.count(F.lit(1)).cast("bigint").alias("person_candidates"))


def external(spark, sf):
    """Stand-in NER output derived from the dossiers (CAND-19 input): a PERSON without title, the
    city as LOCATION, the employer as ORG and the date-of-birth / years phrases as DATE."""
    d = S.dossiers(spark, sf)
    return d.selectExpr(f"inline(array({', '.join(EXTERNAL_SQL)}))", "doc_id").select(
        "doc_id", "entity_type", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "score")


EXTERNAL_SQL = [
    "named_struct('entity_type', 'PERSON', 'start', instr(text, 'Dr. ') + 3, "
    "'end', instr(text, ' reviewed the file.') - 1, 'score', 0.85D)",
    "named_struct('entity_type', 'LOCATION', 'start', instr(text, 'Springfield') - 1, "
    "'end', instr(text, 'Springfield') + 10, 'score', 0.85D)",
    "named_struct('entity_type', 'ORG', 'start', instr(text, 'Employed by ') + 11, "
    "'end', instr(text, ' for ') - 1, 'score', 0.85D)",
    "named_struct('entity_type', 'DATE', 'start', instr(text, ' for ') + 4, "
    "'end', instr(text, ' years.') + 5, 'score', 0.85D)",
    "named_struct('entity_type', 'DATE', 'start', instr(text, 'Date of birth: ') + 14, "
    "'end', instr(text, 'Date of birth: ') + 24, 'score', 0.85D)",
    "named_struct('entity_type', 'ORG', 'start', instr(text, 'Spring Boot') - 1, "
    "'end', instr(text, 'Spring Boot') + 10, 'score', 0.85D)",
    "named_struct('entity_type', 'CARDINAL', 'start', instr(text, 'covers ') + 6, "
    "'end', instr(text, ' orders.') - 1, 'score', 0.85D)",
]


@plan_cache
def scored_ext(spark, sf):
    c = corpus(spark, sf)
    return D.scored_candidates(c, external=external(spark, sf))


def q_cand19(spark, sf):
    s = scored_ext(spark, sf).filter(F.col("recognizer") == "external")
    return _big(s.select(*SCORED_COLS), "start", "end")


INVOICE_SPEC = Spec("INVOICE_NO", "invoice_number", r"(?<pre>\bInvoice )(?<val>\d+)", 0.9, group=True, guard="Invoice")


def q_cand20(spark, sf):
    r = recognizers.raw_candidates(corpus(spark, sf), [INVOICE_SPEC], with_header=False)
    return _big(r.select(*CAND_COLS), "start", "end")


def q_udf01(spark, sf):
    """User recognizer through the whole detect plan: an unknown type is rejected (VAL-16)."""
    s = D.scored_candidates(corpus(spark, sf), specs=recognizers.builtin_specs() + [INVOICE_SPEC])
    return _big(s.filter(F.col("type") == "INVOICE_NO").select(*SCORED_COLS), "start", "end")


def q_ctx01(spark, sf):
    from ..functions.spans import context, find_spans
    c = recognizers.with_chunks(corpus(spark, sf))
    sp = c.select("doc_id", "_ch", "_n", find_spans(F.col("text"), R.EMAIL, guard=F.instr("text", "@") > 0).alias("s"))
    e = sp.select("doc_id", F.inline(F.transform("s", lambda m: F.struct(
        m["start"].alias("start"), m["end"].alias("end"),
        context(F.col("_ch"), F.col("_n"), m["start"], m["end"], 80).alias("context")))))
    return _big(e, "start", "end")


def q_ctx02(spark, sf):
    return _big(entities(spark, sf).select("doc_id", "id", "start", "context"), "id", "start")


def q_ctx03(spark, sf):
    r = raw(spark, sf).filter((F.col("type") == "PHONE") & (F.col("score") > 0.9))
    return _big(r.select(*CAND_COLS), "start", "end")


def q_val01(spark, sf):
    from ..operators.validate import is_structured
    r = raw(spark, sf)
    return r.groupBy("type", is_structured(F.col("type")).alias("structured")).agg(F.count(F.lit(1)).cast("bigint").alias("n"))


def q_val02(spark, sf):
    s = scored(spark, sf).filter(F.col("reject_reason").isNull())
    return s.groupBy("type").agg(F.count(F.lit(1)).cast("bigint").alias("approved"),
                                 F.min("confidence").alias("min_confidence"))


def q_conf(types, recs=None, confs=None):
    def q(spark, sf):
        s = scored_view(spark, sf).filter(F.col("type").isin(*types) & F.col("reject_reason").isNull())
        if recs:
            s = s.filter(F.col("recognizer").isin(*recs))
        if confs:
            s = s.filter(F.col("confidence").isin(*confs))
        return s
    return q


def q_val15(spark, sf):
    s = scored_ext(spark, sf).filter((F.col("recognizer") == "external") & (F.col("type") == "DOB"))
    return _big(s.select(*SCORED_COLS), "start", "end")


def q_val16(spark, sf):
    s = scored_ext(spark, sf).filter(F.col("reject_reason").isin("location", "unknown_type"))
    return _big(s.select(*SCORED_COLS), "start", "end")


def q_val17(spark, sf):
    s = scored_view(spark, sf).filter((F.col("type") == "DOB") & F.col("reject_reason").isNull()
                                      & F.col("value").rlike(r"(?i)^\d{1,2}(st|nd|rd|th)\s"))
    return s


def approved(spark, sf):
    return scored(spark, sf).filter(F.col("reject_reason").isNull())


def q_ovl01(spark, sf):
    a = approved(spark, sf)
    return _big(a.select("doc_id", "type", "recognizer", "start", "end", "confidence"), "start", "end")


def q_ovl03(spark, sf):
    sc, ents = detected(spark, sf)
    a = sc.filter(F.col("reject_reason").isNull()).groupBy("doc_id").agg(F.count(F.lit(1)).cast("bigint").alias("candidates"))
    e = ents.groupBy("doc_id").agg(F.count(F.lit(1)).cast("bigint").alias("entities"))
    return a.join(e, "doc_id", "left").fillna(0, ["entities"])


def q_ovl04(spark, sf):
    """OVL-04: every entity value equals the text at its span (joined back to the corpus)."""
    e = entities(spark, sf)
    c = corpus(spark, sf)
    j = e.join(c, "doc_id").withColumn("ok", F.expr("substring(text, start + 1, `end` - start) = value"))
    return j.agg(F.count(F.lit(1)).cast("bigint").alias("checked"),
                 F.sum(F.when(F.col("ok"), 0).otherwise(1)).cast("bigint").alias("mismatched"))


def q_ovl05(spark, sf):
    from pyspark.sql import Window
    a = approved(spark, sf)
    w = Window.partitionBy("doc_id").orderBy("start", F.desc("end"), F.desc("confidence"), "type", "recognizer", "value")
    pm = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    a = a.withColumn("_new", F.when(pm.isNull() | (F.col("start") > pm), 1).otherwise(0))
    a = a.withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    i = a.groupBy("doc_id", "island").agg(F.min("start").cast("bigint").alias("start"),
                                          F.max("end").cast("bigint").alias("end"),
                                          F.count(F.lit(1)).cast("bigint").alias("size"))
    return i.filter(F.col("size") > 1).drop("island")


def q_ovl06(spark, sf):
    return _big(overlap.overlapping_pairs(entities(spark, sf)).select("doc_id", "id", "start", "end"), "id", "start", "end")


def q_ovl07(spark, sf):
    return _big(entities(spark, sf).select("doc_id", "id", "type", "start"), "id", "start")


QUERIES = {
    "SRC-01": q_src01,
    "SRC-03": q_src03,
    "SRC-04": q_src04,
    "SECT-01": q_sect01,
    "SECT-02": q_sect02,
    "SECT-03": q_sect03,
    "SECT-04": q_sect04,
    "SECT-05": q_sect05,
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
    "CAND-19": q_cand19,
    "CAND-20": q_cand20,
    "UDF-01": q_udf01,
    "CTX-01": q_ctx01,
    "CTX-02": q_ctx02,
    "CTX-03": q_ctx03,
    "JOIN-01": q_reason(["protected_overlap"]),
    "JOIN-02": q_reason(["duplicate_span"]),
    "JOIN-03": q_join03,
    "VAL-01": q_val01,
    "VAL-02": q_val02,
    "VAL-03": q_reason(["ip_version"]),
    "VAL-04": q_reason(["ip_in_url"]),
    "VAL-05": q_reason(["suppressed_section"]),
    "VAL-07": q_reason(["tech_denylist", "field_name"]),
    "VAL-08": q_reason(["label_colon"]),
    "VAL-09": q_conf(["PERSON"], confs=[R.PERSON_SCORES["label_ctx"]]),
    "VAL-10": q_conf(["PERSON"], recs=["person_header"]),
    "VAL-11": q_reason(["company_lowercase", "company_no_suffix"], external=True),
    "VAL-12": q_conf(["COMPANY"]),
    "VAL-13": q_reason(["company_institution"]),
    "VAL-14": q_reason(["address_prefix", "address_heading_number"]),
    "VAL-15": q_val15,
    "VAL-16": q_val16,
    "VAL-17": q_val17,
    "VAL-18": q_rejections,
    "OVL-01": q_ovl01,
    "OVL-02": entity_view,
    "OVL-03": q_ovl03,
    "OVL-04": q_ovl04,
    "OVL-05": q_ovl05,
    "OVL-06": q_ovl06,
    "OVL-07": q_ovl07,
}


# ------------------------------------------------------------------ pseudonyms, redaction, stats

MAP_COLS = ["type", "norm", "form", "occurrences", "replacement"]


def mapping(spark, sf, scope="corpus"):
    return pseudonyms.pseudonym_mapping(entities(spark, sf), scope=scope, unknown="hash")  # detected types are all known


def pseudonymized(spark, sf):
    """Entities with replacement (JOIN-04). The entities are checkpointed first, so the mapping
    aggregate, the join back and edits of the list read them instead of re-running the detection."""
    return pseudonyms.pseudonymize(D.materialize(entities(spark, sf)), unknown="hash")


def q_pse01(spark, sf):
    e = entities(spark, sf)
    return e.select("type", "value", pseudonyms.normalize(F.col("value")).alias("norm")).distinct()


def q_pse02(spark, sf):
    return _big(mapping(spark, sf).select(*MAP_COLS), "occurrences")


def q_pse_type(types):
    def q(spark, sf):
        return _big(mapping(spark, sf).filter(F.col("type").isin(*types)).select(*MAP_COLS), "occurrences")
    return q


def q_pse13(spark, sf):
    """Values of a type without a generator get ``[TYPE_n]`` by first appearance."""
    r = recognizers.raw_candidates(corpus(spark, sf), [INVOICE_SPEC], with_header=False)
    m = pseudonyms.pseudonym_mapping(r.select("doc_id", "type", "start", "value"))
    return _big(m.select(*MAP_COLS), "occurrences")


def q_pse14(spark, sf):
    m = mapping(spark, sf)
    return m.groupBy("type").agg(F.count(F.lit(1)).cast("bigint").alias("values"),
                                 F.sum(F.when(F.col("replacement") == F.col("form"), 1).otherwise(0)).cast("bigint")
                                 .alias("unchanged"))


def q_pse15(spark, sf):
    m = mapping(spark, sf, scope="document")
    return _big(m.select("doc_id", *MAP_COLS), "occurrences")


def q_join04(spark, sf):
    p = pseudonymized(spark, sf)
    return _big(p.select("doc_id", "id", "type", "value", "replacement"), "id")


def overrides_of(e):
    """Human edits derived from the entities: EMAIL replacements of even documents are rewritten."""
    return e.filter((F.col("type") == "EMAIL") & (F.col("doc_id") % 2 == 0)).select(
        "doc_id", "id", F.lit("redacted@example.org").alias("replacement"))


def q_join05(spark, sf):
    ents = pseudonymized(spark, sf)
    e = redact.apply_overrides(ents, overrides_of(ents))
    return _big(e.select("doc_id", "id", "replacement", "edited"), "id")


def redacted(spark, sf):
    return redact.redact_offsets(corpus(spark, sf), pseudonymized(spark, sf))


def q_red01(spark, sf):
    return redacted(spark, sf).select("doc_id", "redacted_text")


def parts(spark, sf):
    """The documents with their lines as parts."""
    return corpus(spark, sf).select("doc_id", F.split("text", "\n").alias("parts"))


def q_red02(spark, sf):
    r = redact.redact_parts(parts(spark, sf), pseudonymized(spark, sf))
    r = r.select("doc_id", F.posexplode(F.arrays_zip("parts", "redacted_parts")).alias("ix", "p"))
    return r.select("doc_id", F.col("ix").cast("bigint").alias("ix"), F.col("p.redacted_parts").alias("redacted_text"),
                    (F.col("p.redacted_parts") != F.col("p.parts")).alias("changed"))


def q_red03(spark, sf):
    """Changed parts of a document, counted where its parts lie."""
    r = redact.redact_parts(parts(spark, sf), pseudonymized(spark, sf))
    changed = F.filter(F.arrays_zip("parts", "redacted_parts"), lambda p: p["parts"] != p["redacted_parts"])
    return r.select("doc_id", F.size(changed).cast("bigint").alias("changed_parts"), F.size("parts").cast("bigint").alias("parts"))


def q_red04(spark, sf):
    """An edited list: e-mail replacements are rewritten, URLs of every third document are dropped, and the
    first twelve characters of every fifth document are added by hand (over what stands there)."""
    ents, docs = pseudonymized(spark, sf), corpus(spark, sf)
    dropped = ents.filter((F.col("type") == "URL") & (F.col("doc_id") % 3 == 0))
    added = docs.filter((F.col("doc_id") % 5 == 0) & (F.length("text") >= 12)).select(
        "doc_id", F.lit(0).alias("start"), F.lit(12).alias("end"), F.lit("[BY HAND]").alias("replacement"))
    return redact.commit(docs, ents, overrides_of(ents), dropped, added).select("doc_id", "redacted_text")


def q_red05(spark, sf):
    r = redacted(spark, sf)
    return _big(redact.comparison_rows(r), "para")


def doc_stats_flat(docs, ents):
    s = stats.doc_stats(docs, ents)
    by = F.array_join(F.sort_array(F.transform(F.map_entries("entities_by_type"),
                                               lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string")))), ",")
    return s.select("doc_id", "total_entities", by.alias("entities_by_type"), "avg_confidence")


def q_agg01(spark, sf):
    return doc_stats_flat(corpus(spark, sf), entities(spark, sf))


def q_agg02(spark, sf):
    return stats.type_counts(entities(spark, sf))


def q_agg03(spark, sf):
    return stats.distinct_types(entities(spark, sf))


def q_agg04(spark, sf):
    return stats.type_confidence(entities(spark, sf))


def q_agg05(spark, sf):
    return stats.nonempty_tabs(entities(spark, sf))


def q_agg05_tab(spark, sf):
    """AGG-05, an open tab: the entities of one type."""
    return _big(stats.by_type_tab(entities(spark, sf), "EMAIL").select("doc_id", "id", "type", "value", "confidence"), "id")


def q_agg06(spark, sf):
    return _big(stats.review_queue(entities(spark, sf), 0.9).select("doc_id", "id", "type", "value", "confidence"), "id")


def q_agg07(spark, sf):
    return stats.worksheet(pseudonymized(spark, sf))


def flagship(spark, sf):
    """Detect -> pseudonymize -> redact, with per-document statistics."""
    c = corpus(spark, sf)
    ents = D.materialize(pseudonyms.pseudonymize(D.materialize(D.detect(c)), unknown="hash"))
    red = redact.redact_offsets(c, ents).select("doc_id", "redacted_text")
    return doc_stats_flat(c, ents).join(red, "doc_id")


# ------------------------------------------------------------------ evaluation

TRUTH_PATTERNS = [
    ("PERSON", r"^([^\n]*)"), ("PERSON", r"\nName: ([^\n]*)"), ("EMAIL", r"\nEmail: ([^\n]*)"),
    ("PHONE", r"\nPhone: ([^\n]*)"), ("PHONE", r"\nMobile: ([^\n]*)"), ("SSN", r"\nSSN: ([^\n]*)"),
    ("DOB", r"\n(?:Date of birth: |Born on |DOB: )([^\n]*)"), ("ADDRESS", r"\nAddress: ([^\n]*)"),
    ("CREDIT_CARD", r"\nCard: ([^\n]*)"), ("IP_ADDRESS", r"\nServer IP: ([^\n]*)"),
    ("COMPANY", r"\nEmployed by ([^\n]*) for [0-9]+ years"), ("PERSON", r"\n(Dr\. [^\n]*) reviewed"),
    ("PHONE", r"\nDesk ([^\n]*)"), ("SSN", r"\nTax id ([^\n]*)"), ("IP_ADDRESS", r"\nGateway ([^\n]*)"),
    ("URL", r"\nMirror ([^\n]*)"), ("URL", r"\nDocs at ([^ ]*) and"), ("IP_ADDRESS", r"\nDocs at [^ ]* and ([^\n]*)"),
    ("ADDRESS", r"\nMail to ([^\n]*)"), ("ADDRESS", r"\n(PIN: [^\n]*)"), ("PERSON", r"\n(Mr Henry Oak) Drive"),
]
TRAPS = ["91.211.49.166", "Spring Boot", "Data Structures", "Kisan Platform"]


def truth(spark, sf):
    """Expected entities of every dossier, read back from its labelled lines."""
    d = S.dossiers(spark, sf)
    # `line`: the labelled line, which places the value (it may stand elsewhere too)
    rows = [F.struct(F.lit(t).alias("type"), F.regexp_extract("text", p, 1).alias("value"), F.regexp_extract("text", p, 0).alias("line")) for t, p in TRUTH_PATTERNS]
    return d.select("doc_id", F.inline(F.array(*rows)))


def traps(spark, sf):
    d = S.dossiers(spark, sf)
    inv = F.regexp_extract("text", r"\nInvoice ([0-9]+) ", 1)
    rows = [F.struct(F.lit(v).alias("value"), (F.instr("text", v) - 1).alias("start")) for v in TRAPS]
    rows.append(F.struct(inv.alias("value"), (F.instr("text", "\nInvoice ") + 8).alias("start")))
    t = d.select("doc_id", F.inline(F.array(*rows)))
    return t.withColumn("end", F.col("start") + F.length("value")).withColumn("must_not_type", F.lit(None).cast("string"))


def of_dossiers(df):
    """The rows of dossiers; the ids of web pages lie above theirs."""
    return df.filter((F.col("doc_id") >= S.DOSSIER_OFFSET) & (F.col("doc_id") < S.PAGES_OFFSET))


def dossier_entities(spark, sf):
    return of_dossiers(entities(spark, sf))


def q_eval01(spark, sf):
    return EV.confusion(dossier_entities(spark, sf), truth(spark, sf))


def q_eval02(spark, sf):
    return EV.prf(dossier_entities(spark, sf), truth(spark, sf))


def q_eval03(spark, sf):
    return EV.micro_macro(dossier_entities(spark, sf), truth(spark, sf))


def q_eval04(spark, sf):
    d = S.dossiers(spark, sf)
    tok = recognizers.raw_candidates(d, [Spec("_TOKEN", "token", r"\S+", 1.0)], with_header=False, features=False).select("doc_id", "start", "end")
    t = truth(spark, sf).join(d, "doc_id").withColumn("start", F.instr("text", F.col("line")) + F.instr("line", F.col("value")) - 2) \
        .withColumn("end", F.col("start") + F.length("value")).select("doc_id", "start", "end")
    return EV.token_metrics(tok, dossier_entities(spark, sf), t)


def q_eval05(spark, sf):
    return EV.determinism(pseudonymized(spark, sf))


def detected(spark, sf):
    """(scored candidates, entities) of one detection: the candidates are checkpointed and feed both."""
    sc = D.materialize(scored(spark, sf))
    return sc, D.entities_of(sc)


def q_eval06(spark, sf):
    sc, ents = detected(spark, sf)
    return EV.overlap_accuracy(of_dossiers(sc.filter(F.col("reject_reason").isNull())), of_dossiers(ents), truth(spark, sf))


def q_eval07(spark, sf):
    return EV.trap_report(dossier_entities(spark, sf), traps(spark, sf).withColumn(
        "value", F.when(F.col("value").rlike("^[0-9]+$"), F.lit("invoice number")).otherwise(F.col("value"))))


def q_eval08(spark, sf):
    return EV.funnel(*detected(spark, sf))


def q_eval09(spark, sf):
    ents = pseudonymized(spark, sf)
    return EV.correction_rate(redact.apply_overrides(ents, overrides_of(ents)))


def badge_generator(form, key, b):
    """UDF-02 example: a user replacement generator (type -> Column function)."""
    return F.concat(F.lit("PERSON-"), F.lpad(pseudonyms.draw(key, 0, 10000, b).cast("string"), 4, "0"))


def q_udf02(spark, sf):
    m = pseudonyms.pseudonym_mapping(entities(spark, sf).filter(F.col("type") == "PERSON"),
                                     generators={"PERSON": badge_generator}, unknown="hash")
    return _big(m.select(*MAP_COLS), "occurrences")


def q_str01(spark, sf):
    from ..streaming.stream import run_to_table
    return run_to_table(spark, sf)


QUERIES.update({
    "PSE-01": q_pse01,
    "PSE-02": q_pse02,
    "PSE-03": q_pse_type(["PERSON"]),
    "PSE-04": q_pse_type(["EMAIL"]),
    "PSE-05": q_pse_type(["PHONE"]),
    "PSE-06": q_pse_type(["SSN"]),
    "PSE-07": q_pse_type(["CREDIT_CARD"]),
    "PSE-08": q_pse_type(["DOB"]),
    "PSE-09": q_pse_type(["IP_ADDRESS"]),
    "PSE-10": q_pse_type(["COMPANY"]),
    "PSE-11": q_pse_type(["ADDRESS"]),
    "PSE-12": q_pse_type(["URL"]),
    "PSE-13": q_pse13,
    "PSE-14": q_pse14,
    "PSE-15": q_pse15,
    "JOIN-04": q_join04,
    "JOIN-05": q_join05,
    "RED-01": q_red01,
    "RED-02": q_red02,
    "RED-03": q_red03,
    "RED-04": q_red04,
    "RED-05": q_red05,
    "AGG-01": q_agg01,
    "AGG-02": q_agg02,
    "AGG-03": q_agg03,
    "AGG-04": q_agg04,
    "AGG-05": q_agg05,
    "AGG-05-tab": q_agg05_tab,
    "AGG-06": q_agg06,
    "AGG-07": q_agg07,
    "EVAL-01": q_eval01,
    "EVAL-02": q_eval02,
    "EVAL-03": q_eval03,
    "EVAL-04": q_eval04,
    "EVAL-05": q_eval05,
    "EVAL-06": q_eval06,
    "EVAL-07": q_eval07,
    "EVAL-08": q_eval08,
    "EVAL-09": q_eval09,
    "STR-01": q_str01,
    "UDF-02": q_udf02,
})


# ------------------------------------------------------------------ scalar functions (FUN-01..07), VAL-06

def q_fun01(spark, sf):
    """Every run of digits in ``documents`` with code-point offsets."""
    from ..functions.spans import find_spans
    d = S.read_table(spark, sf, "documents").select("doc_id", "text")
    e = d.select("doc_id", F.explode(find_spans(F.col("text"), r"[0-9]+")).alias("m"))
    return _big(e.select("doc_id", F.col("m.start").alias("start"), F.col("m.end").alias("end"),
                         F.col("m.value").alias("value")), "start", "end")


def _card_like(spark, sf):
    specs = [Spec("CREDIT_CARD", f"card_{n}", p, 1.0) for n, p in R.CARD_PATTERNS]
    return recognizers.raw_candidates(corpus(spark, sf), specs, with_header=False)


def q_fun02(spark, sf):
    """The check that detection runs on card candidates (``spans.luhn_ok`` is its Column form)."""
    r = _card_like(spark, sf)
    return _big(r.select("doc_id", "recognizer", "start", "value", F.expr(recognizers.luhn_sql("value")).alias("luhn_ok")), "start")


def q_fun03(spark, sf):
    from ..functions.spans import digits
    r = raw(spark, sf).filter(F.col("type") == "PHONE")
    return _big(r.select("doc_id", "start", "value", digits(F.col("value")).alias("digits"),
                         F.length(digits(F.col("value"))).cast("bigint").alias("n_digits")), "start")


def q_fun04(spark, sf):
    from ..functions.spans import ordinal
    o = S.read_table(spark, sf, "orders")
    return o.select("o_orderkey", ordinal(F.dayofmonth("o_orderdate")).alias("day_ordinal"))


def q_fun05(spark, sf):
    from ..functions.spans import is_private_ipv4
    r = raw(spark, sf).filter(F.col("recognizer") == "ipv4_regex")
    return _big(r.select("doc_id", "start", "value", is_private_ipv4(F.col("value")).alias("private")), "start")


def q_fun06(spark, sf):
    d = corpus(spark, sf)
    return d.selectExpr("doc_id", r"regexp_extract(text, r'^(?:[ \t\r\f\x0B]*\n)*([^\n]*)', 1) AS first_line")


def q_fun07(spark, sf):
    """The line containing each e-mail candidate (line start up to the match end)."""
    from ..functions.spans import find_spans, line_prefix
    d = corpus(spark, sf)
    e = d.select("doc_id", "text", F.explode(find_spans(F.col("text"), R.EMAIL, guard=F.instr("text", "@") > 0)).alias("m"))
    return _big(e.select("doc_id", F.col("m.start").alias("start"),
                         line_prefix(F.col("text"), F.col("m.end")).alias("line")), "start")


def q_val06(spark, sf):
    """PERSON candidates ending in a street word, with the value the validator keeps."""
    r = raw(spark, sf).filter((F.col("type") == "PERSON") & F.col("value").rlike(R.PERSON_STREET_SUFFIX))
    kept = F.expr(f"substring(value, 1, length(value) - length(regexp_extract(value, {recognizers.sql_lit(R.PERSON_STREET_SUFFIX)}, 1)))")
    return _big(r.select("doc_id", "start", "value", kept.alias("kept")), "start")


QUERIES.update({
    "FUN-01": q_fun01, "FUN-02": q_fun02, "FUN-03": q_fun03, "FUN-04": q_fun04, "FUN-05": q_fun05,
    "FUN-06": q_fun06, "FUN-07": q_fun07, "VAL-06": q_val06,
})

#: queries whose tasks run Python of this package
PYTHON = ["RED-02", "RED-03"]
