"""The detection plan: documents -> scored candidates -> entities.

Physical shape (one shuffle by ``doc_id`` for all per-document logic):

1. narrow: every recognizer, heading and ``://``-line pattern runs over the text in one
   projection; one row per span with its text features (no text afterwards);
2. Exchange hashpartitioning(doc_id): two sweeps over the same partitioning --
   protected-span overlap (JOIN-01), section at position (SECT-04) with URL line (VAL-04);
3. row-level validation (VAL-*), short-line dedupe window (JOIN-02), DOB extension;
4. overlap islands + fold (OVL-*), ids (OVL-07) -- still the same partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import rules as R
from ..operators import overlap, recognizers, sections, validate

HEADING_T = "_HEADING"
URLLINE_T = "_URLLINE"


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the session's ``spark.checkpoint.dir``.

    Used on the (small) entity table before it feeds both the pseudonym mapping and the join
    back, so the regex detection runs once; a lost executor re-reads the checkpoint instead
    of recomputing the detection."""
    from ..session import ensure_checkpoint_dir

    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def event_specs(specs):
    specs = list(recognizers.builtin_specs() if specs is None else specs)
    specs.append(recognizers.short_line_spec())
    specs.append(recognizers.Spec(HEADING_T, "heading", R.HEADING, 1.0))
    specs.append(recognizers.Spec(URLLINE_T, "url_line", R.URL_LINE, 1.0, guard="://"))
    return specs


def scored_candidates(docs: DataFrame, external: DataFrame | None = None, specs=None, text: str = "text",
                      doc_id: str = "doc_id", whole_word_denylist: bool = False) -> DataFrame:
    """Every candidate with ``confidence`` and ``reject_reason`` (null = approved) -- VAL-18 log."""
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    ev = recognizers.raw_candidates(base, event_specs(specs))
    if external is not None:
        ev = ev.unionByName(recognizers.external_candidates(base, external))
    ev = ev.drop("left10", "left20", "right5")  # parts of left30 and ip_tail, cut again behind the sweeps
    t = F.col("type")
    structured = validate.is_structured(t)
    heading = t == HEADING_T
    urlline = t == URLLINE_T
    ev = ev.withColumn("_hname", F.when(heading, sections.canonical_heading(
        F.trim(F.regexp_extract(F.col("value"), r"^[ \t]*([A-Z][A-Z &/\-]+[A-Z])", 1)))))

    # JOIN-01 as a sweep: protected rows keyed by start, others by end (others first on ties);
    # running max(protected end) > start  <=>  some protected span p has p.start < end, p.end > start
    pos = F.when(structured, F.col("start")).otherwise(F.col("end"))
    w1 = Window.partitionBy("doc_id").orderBy(pos, structured.cast("int")).rowsBetween(Window.unboundedPreceding, 0)
    ev = ev.withColumn("protected", F.coalesce(F.max(F.when(structured, F.col("end"))).over(w1) > F.col("start"),
                                               F.lit(False)))
    # SECT-04 and VAL-04 as one sweep by start, headings before and URL lines behind the others of a place:
    # the last heading starting at or before the position, and a '://...' line segment starting before the IP on the same line
    kind = F.when(heading, 0).when(urlline, 2).otherwise(1)
    w2 = Window.partitionBy("doc_id").orderBy(F.col("start"), kind).rowsBetween(Window.unboundedPreceding, 0)
    has_heading = F.max(heading.cast("int")).over(Window.partitionBy("doc_id")) > 0
    ev = ev.withColumns({
        "section": F.coalesce(F.last(F.col("_hname"), ignorenulls=True).over(w2), F.when(has_heading, "HEADER").otherwise("BODY")),
        "ip_url_line": F.coalesce(F.max(F.when(urlline, F.col("end"))).over(w2) > F.col("start"), F.lit(False))})
    cands = ev.filter(~t.isin(HEADING_T, URLLINE_T)).drop("_hname")
    cands = cands.withColumns({"left10": F.right("left30", F.lit(10)), "left20": F.right("left30", F.lit(R.IP_VERSION_WINDOW)),
                               "right5": F.substring(F.col("ip_tail"), F.length("value") + 1, F.lit(5))})

    # one projection for every row (no branch/union, so the extraction above runs once)
    short = F.col("recognizer") == "person_short_line"
    allc = validate.validate(cands, whole_word_denylist)
    # JOIN-02: a short-line name is dropped when a validated entity has the same span
    wd = Window.partitionBy("doc_id", "start", "end")
    dup = F.max(F.when(F.col("reject_reason").isNull() & ~short, 1).otherwise(0)).over(wd) > 0
    allc = allc.withColumn("reject_reason", F.when(short & F.col("reject_reason").isNull() & dup, "duplicate_span")
                           .otherwise(F.col("reject_reason")))
    allc = validate.extend_dob(allc)
    return allc


ENTITY_COLS = ["doc_id", "type", "start", "end", "value", "confidence", "context", "recognizer"]


def detect(docs: DataFrame, external: DataFrame | None = None, specs=None, text: str = "text",
           doc_id: str = "doc_id", whole_word_denylist: bool = False,
           protect_only_types: tuple[str, ...] = ()) -> DataFrame:
    """Entities (doc_id, id, type, start, end, value, confidence, context, recognizer)."""
    return entities_of(scored_candidates(docs, external, specs, text, doc_id, whole_word_denylist), protect_only_types)


def entities_of(scored: DataFrame, protect_only_types: tuple[str, ...] = ()) -> DataFrame:
    """The entities of scored candidates: the approved ones without overlap, numbered."""
    approved = scored.filter(F.col("reject_reason").isNull())
    if protect_only_types:
        approved = approved.filter(~F.col("type").isin(*protect_only_types))
    ents = overlap.resolve_overlaps(approved.select(*ENTITY_COLS))
    return overlap.number_entities(ents).select("doc_id", "id", *ENTITY_COLS[1:])
