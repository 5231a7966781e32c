"""Document sections (SECT-01..05).

Headings are found per row with the span extractor; section spans are built in array form
inside the same row (no shuffle). The position->section lookup used by the validators is
a sweep over one ``doc_id`` window (see ``plans.detect``), not a range join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import rules as R
from .recognizers import _staged_spans, Spec


def heading_map() -> Column:
    """Literal map lower(heading) -> canonical section name (SECT-02)."""
    kv = []
    for k, v in R.SECTION_NAMES.items():
        kv += [F.lit(k), F.lit(v)]
    return F.create_map(*kv)


def canonical_heading(raw: Column) -> Column:
    return F.coalesce(F.try_element_at(heading_map(), F.lower(raw)), F.upper(raw))


def headings(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """SECT-01/02: heading lines (doc_id, start, end, raw, name); start/end cover the whole line match."""
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    st = _staged_spans(base, [Spec("_HEADING", "heading", R.HEADING, 1.0)], "text", ["doc_id"])
    h = st.select("doc_id", F.inline("_sp0"))
    raw = F.trim(F.regexp_extract(F.col("value"), r"^[ \t]*([A-Z][A-Z &/\-]+[A-Z])", 1))
    return h.select("doc_id", "start", "end", raw.alias("raw")).withColumn("name", canonical_heading(F.col("raw")))


def sections(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """SECT-03: (doc_id, ord, name, start, end) -- HEADER before the first heading, one section per
    heading up to the next heading or the end, BODY for a document without headings."""
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    st = _staged_spans(base, [Spec("_HEADING", "heading", R.HEADING, 1.0)], "text", ["doc_id", "text"])
    raw_re = r"^[ \t]*([A-Z][A-Z &/\-]+[A-Z])"
    hs = st.select(
        "doc_id", F.length("text").alias("n"),
        F.transform("_sp0", lambda s: F.struct(s["start"].alias("start"),
                                               canonical_heading(F.trim(F.regexp_extract(s["value"], raw_re, 1))).alias("name"))).alias("h"),
    )
    secs = F.transform(
        F.col("h"),
        lambda h, i: F.struct(
            h["name"].alias("name"), h["start"].alias("start"),
            F.coalesce(F.get(F.col("h"), i + 1)["start"], F.col("n")).alias("end"),
        ),
    )
    first = F.get(F.col("h"), 0)["start"]
    header = F.when(first > 0, F.array(F.struct(F.lit("HEADER").alias("name"), F.lit(0).alias("start"),
                                               first.alias("end"))))
    body = F.array(F.struct(F.lit("BODY").alias("name"), F.lit(0).alias("start"), F.col("n").alias("end")))
    allsec = F.when(F.size("h") == 0, body).otherwise(F.concat(F.coalesce(header, F.array().cast(
        "array<struct<name:string,start:int,end:int>>")), secs))
    out = hs.select("doc_id", F.posexplode(allsec).alias("ord", "s"))
    return out.select("doc_id", F.col("ord").cast("int").alias("ord"), F.col("s.name").alias("name"),
                      F.col("s.start").cast("int").alias("start"), F.col("s.end").cast("int").alias("end"))


def section_at(spans: DataFrame, secs: DataFrame, pos: str = "start") -> DataFrame:
    """SECT-04: section name at ``spans.pos`` (default BODY), as a sweep over a doc_id window.

    Sections tile [0, len) in order, so the section containing ``pos`` is the last one whose
    start <= pos: union the section starts with the positions, order by (position, section
    first) and carry the last section name forward.
    """
    key_cols = spans.columns
    ev_s = secs.select("doc_id", F.col("start").alias("_pos"), F.lit(0).alias("_k"), F.col("name").alias("_name"),
                       F.col("end").alias("_send"))
    ev_p = spans.select(*key_cols, F.col(pos).alias("_pos"), F.lit(1).alias("_k"))
    ev = ev_p.unionByName(ev_s, allowMissingColumns=True)
    w = Window.partitionBy("doc_id").orderBy("_pos", "_k").rowsBetween(Window.unboundedPreceding, 0)
    ev = ev.withColumn("_last", F.last(F.when(F.col("_k") == 0, F.struct("_name", "_send")), ignorenulls=True).over(w))
    ev = ev.filter(F.col("_k") == 1)
    name = F.when(F.col("_last._send") > F.col("_pos"), F.col("_last._name")).otherwise(F.lit("BODY"))
    return ev.select(*key_cols, F.coalesce(name, F.lit("BODY")).alias("section"))


def in_suppressed_section(section: Column) -> Column:
    """SECT-05."""
    return section.isin(*R.SUPPRESSED_SECTIONS)
