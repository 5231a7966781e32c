"""The detection plan inside each row: a document's candidates, entities and redacted text without any exchange.

The sweeps of ``plans.detect`` run over windows of a document's rows; here the same rules run over the array of
candidates beside its text, as scans over sorted arrays. So the plan has no window, join, aggregate or second
pass, and runs on a stream in append mode. Rules are shared: validation, naming and the overlap fold are the
same steps in both plans. Values of types without a generator get names from their hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.steps import bind, on_array, scan
from ..operators import overlap, pseudonyms, recognizers, redact, sections, validate
from .detect import HEADING_T, URLLINE_T, event_specs

ENTITY = ["id", "type", "start", "end", "value", "confidence", "context", "recognizer", "replacement"]


def _sorted(elements: Column, *keys) -> Column:
    """The elements in the order of their keys (functions of an element)."""
    keyed = F.transform(elements, lambda c: F.struct(*[k(c).alias(f"k{i}") for i, k in enumerate(keys)], c.alias("c")))
    return F.transform(F.sort_array(keyed), lambda x: x["c"])


def _swept(elements: Column, state: Column, step, fields: dict[str, str]) -> Column:
    """``elements`` with the ``fields`` (name -> type) that the steps of a scan give them."""
    out = "struct<" + ",".join(f"{name}:{kind}" for name, kind in fields.items()) + ">"

    def set_fields(c: Column, o: Column) -> Column:
        for name in fields:
            c = c.withField(name, o[name])
        return c

    return bind(elements, lambda el: F.zip_with(el, scan(el, state, step, out)["outs"], set_fields))


def entity_arrays(docs: DataFrame, specs=None, text: str = "text", doc_id: str = "doc_id", whole_word_denylist: bool = False,
                  salt: str = pseudonyms.DEFAULT_SALT, generators: dict | None = None) -> DataFrame:
    """(doc_id, text, entities): the named entities of each document as an array in start order."""
    d = recognizers.candidate_arrays(docs, event_specs(specs), text, doc_id)
    heading, urlline = (lambda c: c["type"] == HEADING_T), (lambda c: c["type"] == URLLINE_T)
    structured = lambda c: validate.is_structured(c["type"])
    name = lambda c: F.when(heading(c), sections.canonical_heading(
        F.trim(F.regexp_extract(c["value"], r"^[ \t]*([A-Z][A-Z &/\-]+[A-Z])", 1))))
    d = d.withColumn("_outside", F.when(F.exists("candidates", heading), "HEADER").otherwise("BODY"))

    # SECT-04 and VAL-04: the last heading at or before a candidate, a '://' line that begins before it
    def places(state, c):
        here = F.coalesce(name(c), state["section"])
        line = F.greatest(state["line"], F.when(urlline(c), c["end"]))
        out = F.struct(F.coalesce(here, F.col("_outside")).alias("section"), (state["line"] > c["start"]).alias("ip_url_line"))
        return F.struct(here.alias("section"), line.alias("line")), out

    ordered = _sorted(F.col("candidates"), lambda c: c["start"], lambda c: F.when(heading(c), 0).when(urlline(c), 2).otherwise(1))
    d = d.withColumn("candidates", _swept(ordered, F.struct(F.lit(None).cast("string").alias("section"), F.lit(-1).alias("line")), places,
                                          {"section": "string", "ip_url_line": "boolean"}))

    # JOIN-01: a structured span that begins before the candidate's end and ends after its start
    def protected(state, c):
        reach = F.greatest(state, F.when(structured(c), c["end"]))
        return reach, F.struct((reach > c["start"]).alias("protected"))

    pos = lambda c: F.when(structured(c), c["start"]).otherwise(c["end"])
    ordered = _sorted(F.filter("candidates", lambda c: ~heading(c) & ~urlline(c)), pos, lambda c: structured(c).cast("int"))
    d = d.withColumn("candidates", _swept(ordered, F.lit(-1), protected, {"protected": "boolean"}))
    d = d.withColumn("candidates", on_array(F.col("candidates"), validate.stages(whole_word_denylist)))

    # JOIN-02: a short-line name at the span of a validated entity
    def single(state, c):
        short, passed = c["recognizer"] == "person_short_line", c["reject_reason"].isNull()
        here = F.struct(c["start"].alias("start"), c["end"].alias("end"))
        again = short & passed & (state["start"] == c["start"]) & (state["end"] == c["end"])
        return F.when(passed & ~short, here).otherwise(state), F.struct(F.when(again, "duplicate_span").otherwise(c["reject_reason"]).alias("reject_reason"))

    ordered = _sorted(F.col("candidates"), lambda c: c["start"], lambda c: c["end"], lambda c: (c["recognizer"] == "person_short_line").cast("int"))
    d = d.withColumn("candidates", _swept(ordered, F.struct(F.lit(-1).alias("start"), F.lit(-1).alias("end")), single, {"reject_reason": "string"}))
    kept = F.filter(on_array(F.col("candidates"), validate.dob_stages()), lambda c: c["reject_reason"].isNull() & (c["end"] > c["start"]))
    fields = ["end", "confidence", "context"]
    d = d.select("doc_id", "text", F.sort_array(F.transform(kept, lambda c: F.struct(
        c["start"].alias("start"), (c["start"] - c["end"]).alias("neg_len"), (-c["confidence"]).alias("neg_conf"), c["type"].alias("type"),
        c["recognizer"].alias("recognizer"), c["value"].alias("value"), *[c[f].alias(f) for f in fields]))).alias("_e"))
    d = d.withColumn("_e", F.when(F.size("_e") > 1, overlap.fold(F.col("_e"))).otherwise(F.col("_e")))
    ordered = _sorted(F.col("_e"), lambda e: e["start"], lambda e: e["end"], lambda e: e["type"])
    d = d.withColumn("_e", F.transform(ordered, lambda e, i: e.withField("id", i + 1).withField("form", e["value"]).withField("norm", pseudonyms.normalize(e["value"]))))
    named = on_array(F.col("_e"), pseudonyms.naming(salt, generators))
    return d.withColumn("_e", named).select("doc_id", "text", F.transform("_e", lambda e: F.struct(*[e[f].alias(f) for f in ENTITY])).alias("entities"))


def redacted(docs: DataFrame, **options) -> DataFrame:
    """``entity_arrays`` with the redacted text and the statistics of each document (AGG-01), all in its row."""
    d = entity_arrays(docs, **options)
    spans = F.transform("entities", lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), e["replacement"].alias("replacement")))
    types = F.sort_array(F.array_distinct(F.col("entities")["type"]))
    counted = F.transform(types, lambda t: F.concat(t, F.lit(":"), F.size(F.filter("entities", lambda e: e["type"] == t)).cast("string")))
    total = F.aggregate("entities", F.lit(0.0), lambda acc, e: acc + e["confidence"])
    d = d.withColumn("_spans", spans)  # a column: it is read for every gap
    return d.select("doc_id", F.size("entities").cast("bigint").alias("total_entities"), F.array_join(counted, ",").alias("entities_by_type"),
                    F.when(F.size("entities") > 0, F.round(total / F.size("entities"), 2)).otherwise(F.lit(0.0)).alias("avg_confidence"),
                    redact.assemble(F.col("text"), F.col("_spans")).alias("redacted_text"), "entities")
