"""Evaluation operators (EVAL-01..09) against a truth table, traps and human overrides.

``truth(doc_id, type, value)`` lists every expected entity occurrence; matching is on
(doc_id, type, value, occurrence number), so a value expected twice must be found twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _numbered(df: DataFrame, order: str | None) -> DataFrame:
    w = Window.partitionBy("doc_id", "type", "value").orderBy(order or "value")
    return df.withColumn("occ", F.row_number().over(w))


def match(entities: DataFrame, truth: DataFrame) -> DataFrame:
    """EVAL-01: (doc_id, type, value, occ, predicted, expected) via a full outer join."""
    p = _numbered(entities.select("doc_id", "type", "value", "start"), "start").drop("start").withColumn("predicted", F.lit(1))
    t = _numbered(truth.select("doc_id", "type", "value"), None).withColumn("expected", F.lit(1))
    j = p.join(t, ["doc_id", "type", "value", "occ"], "full_outer")
    return j.select("doc_id", "type", "value", "occ", F.coalesce("predicted", F.lit(0)).alias("predicted"),
                    F.coalesce("expected", F.lit(0)).alias("expected"))


def confusion(entities: DataFrame, truth: DataFrame) -> DataFrame:
    """EVAL-01: tp, fp, fn per type."""
    m = match(entities, truth)
    return m.groupBy("type").agg(
        F.sum(F.col("predicted") * F.col("expected")).cast("bigint").alias("tp"),
        F.sum(F.col("predicted") * (1 - F.col("expected"))).cast("bigint").alias("fp"),
        F.sum((1 - F.col("predicted")) * F.col("expected")).cast("bigint").alias("fn"),
    )


def _safe_div(a, b):
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def prf(entities: DataFrame, truth: DataFrame) -> DataFrame:
    """EVAL-02: precision, recall, F1 per type (rounded to 4)."""
    c = confusion(entities, truth)
    p = _safe_div(F.col("tp"), F.col("tp") + F.col("fp"))
    r = _safe_div(F.col("tp"), F.col("tp") + F.col("fn"))
    c = c.withColumn("precision", p).withColumn("recall", r)
    f1 = _safe_div(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return c.select("type", "tp", "fp", "fn", F.round("precision", 4).alias("precision"),
                    F.round("recall", 4).alias("recall"), F.round(f1, 4).alias("f1"))


def micro_macro(entities: DataFrame, truth: DataFrame) -> DataFrame:
    """EVAL-03: micro F1 over all counts, macro F1 = unweighted mean of the per-type F1."""
    c = confusion(entities, truth)
    per = c.withColumn("p", _safe_div(F.col("tp"), F.col("tp") + F.col("fp"))) \
           .withColumn("r", _safe_div(F.col("tp"), F.col("tp") + F.col("fn")))
    per = per.withColumn("f1", _safe_div(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")))
    tot = per.agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.avg("f1").alias("macro"))
    mp = _safe_div(F.col("tp"), F.col("tp") + F.col("fp"))
    mr = _safe_div(F.col("tp"), F.col("tp") + F.col("fn"))
    return tot.select(F.round(_safe_div(2 * mp * mr, mp + mr), 4).alias("micro_f1"),
                      F.round("macro", 4).alias("macro_f1"))


def overlap_flag(points: DataFrame, spans: DataFrame, name: str) -> DataFrame:
    """``points(doc_id, start, end)`` + boolean ``name``: overlaps some span of the same document.

    A sweep instead of a range join: spans are keyed by their start, points by their end (points
    first on ties); the running max of span ends before a point exceeds its start exactly when
    some span has s.start < p.end and s.end > p.start. O(n log n) per document, one shuffle."""
    from pyspark.sql import Window

    p = points.select("doc_id", "start", "end", F.lit(0).alias("_k"))
    s = spans.select("doc_id", "start", "end", F.lit(1).alias("_k"))
    pos = F.when(F.col("_k") == 1, F.col("start")).otherwise(F.col("end"))
    w = Window.partitionBy("doc_id").orderBy(pos, "_k").rowsBetween(Window.unboundedPreceding, 0)
    u = p.unionByName(s).withColumn("_m", F.max(F.when(F.col("_k") == 1, F.col("end"))).over(w))
    return u.filter(F.col("_k") == 0).select("doc_id", "start", "end",
                                            F.coalesce(F.col("_m") > F.col("start"), F.lit(False)).alias(name))


def token_metrics(tokens: DataFrame, entities: DataFrame, truth_spans: DataFrame) -> DataFrame:
    """EVAL-04: token-level tp/fp/fn/tn, precision, recall, F1, accuracy.

    ``tokens(doc_id, start, end)``; a token is predicted / expected when it overlaps an entity / truth span of the
    same document. Tokens, entities and truth are one stream of tagged events, swept once as in
    ``overlap_flag``: the running ends of both kinds of spans answer both questions."""
    events = (tokens.select("doc_id", "start", "end", F.lit(0).alias("_k"))
              .unionByName(entities.select("doc_id", "start", "end", F.lit(1).alias("_k")))
              .unionByName(truth_spans.select("doc_id", "start", "end", F.lit(2).alias("_k"))))
    span = F.col("_k") > 0
    w = Window.partitionBy("doc_id").orderBy(F.when(span, F.col("start")).otherwise(F.col("end")), span).rowsBetween(Window.unboundedPreceding, 0)
    reach = lambda k: F.max(F.when(F.col("_k") == k, F.col("end"))).over(w)
    hit = lambda c: F.coalesce(F.col(c) > F.col("start"), F.lit(False)).cast("int")
    t = events.withColumns({"_e": reach(1), "_t": reach(2)}).filter("_k = 0").select(hit("_e").alias("pred"), hit("_t").alias("exp"))
    a = t.agg(F.sum(F.col("pred") * F.col("exp")).alias("tp"), F.sum(F.col("pred") * (1 - F.col("exp"))).alias("fp"),
              F.sum((1 - F.col("pred")) * F.col("exp")).alias("fn"),
              F.sum((1 - F.col("pred")) * (1 - F.col("exp"))).alias("tn"))
    p = _safe_div(F.col("tp"), F.col("tp") + F.col("fp"))
    r = _safe_div(F.col("tp"), F.col("tp") + F.col("fn"))
    return a.select(*[F.col(c).cast("bigint").alias(c) for c in ("tp", "fp", "fn", "tn")],
                    F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"),
                    F.round(_safe_div(2 * p * r, p + r), 4).alias("f1"),
                    F.round(_safe_div(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")), 4).alias("accuracy"))


def determinism(entities_with_replacement: DataFrame) -> DataFrame:
    """EVAL-05: share of (type, normalized value) with exactly one replacement corpus-wide."""
    e = entities_with_replacement.withColumn("norm", F.lower(F.regexp_replace("value", r"^\s+|\s+$", "")))
    k = e.groupBy("type", "norm").agg(F.count_distinct("replacement").alias("n"))
    return k.agg(F.count(F.lit(1)).cast("bigint").alias("keys"),
                 F.sum(F.when(F.col("n") == 1, 1).otherwise(0)).cast("bigint").alias("deterministic")) \
            .withColumn("rate", F.round(_safe_div(F.col("deterministic"), F.col("keys")), 4))


def overlap_accuracy(approved: DataFrame, entities: DataFrame, truth: DataFrame) -> DataFrame:
    """EVAL-06: among spans where candidates collided, share whose surviving entity is a truth value."""
    w = Window.partitionBy("doc_id").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    a = approved.withColumn("_pm", F.max("end").over(w))
    a = a.withColumn("_new", F.when(F.col("_pm").isNull() | (F.col("start") >= F.col("_pm")), 1).otherwise(0))
    w2 = Window.partitionBy("doc_id").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, 0)
    a = a.withColumn("_isl", F.sum("_new").over(w2))
    isl = a.groupBy("doc_id", "_isl").agg(F.count(F.lit(1)).alias("n"), F.min("start").alias("start"), F.max("end").alias("end"))
    # islands don't overlap: an entity can only lie in the last one that begins at or before it
    events = isl.select("doc_id", "start", F.struct("n", "end").alias("_island"), F.lit(None).cast("string").alias("type"), F.lit(None).cast("string").alias("value"),
                        F.lit(None).cast("int").alias("_end"))
    events = events.unionByName(entities.select("doc_id", "start", F.lit(None).cast(events.schema["_island"].dataType).alias("_island"), "type", "value",
                                                F.col("end").cast("int").alias("_end")))
    w3 = Window.partitionBy("doc_id").orderBy("start", F.col("_island").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    won = events.withColumn("_in", F.last("_island", ignorenulls=True).over(w3)).filter(F.col("_end").isNotNull() & (F.col("_in.n") > 1) & (F.col("_end") <= F.col("_in.end")))
    won = won.select("doc_id", "type", "value").distinct()
    t = truth.select("doc_id", "type", "value").distinct().withColumn("good", F.lit(1))
    flagged = won.join(t, ["doc_id", "type", "value"], "left")
    return flagged.agg(F.count(F.lit(1)).cast("bigint").alias("resolved"),
                       F.count("good").cast("bigint").alias("correct")) \
        .withColumn("accuracy", F.round(_safe_div(F.col("correct"), F.col("resolved")), 4))


def trap_report(entities: DataFrame, traps: DataFrame) -> DataFrame:
    """EVAL-07: per trap value, how many entities overlap one of its occurrences (expect 0).

    Equi join on doc_id with an overlap predicate: a document has a handful of trap occurrences,
    so the residual predicate costs O(entities) per document."""
    j = traps.alias("t").join(entities.alias("e"), (F.col("t.doc_id") == F.col("e.doc_id"))
                              & (F.col("e.start") < F.col("t.end")) & (F.col("e.end") > F.col("t.start"))
                              & (F.col("t.must_not_type").isNull() | (F.col("t.must_not_type") == F.col("e.type"))), "left")
    return j.groupBy(F.col("t.value").alias("trap")).agg(
        F.count("t.doc_id").cast("bigint").alias("occurrences"),
        F.count("e.doc_id").cast("bigint").alias("flagged"))


def funnel(scored: DataFrame, entities: DataFrame) -> DataFrame:
    """EVAL-08: raw candidates, rejected by validation, approved, kept after overlap resolution."""
    rows = scored.select(F.when(F.col("reject_reason").isNull(), "approved").otherwise("rejected").alias("stage")) \
        .unionByName(entities.select(F.lit("final").alias("stage")))
    return rows.agg(
        F.sum(F.when(F.col("stage") != "final", 1).otherwise(0)).cast("bigint").alias("raw"),
        F.sum(F.when(F.col("stage") == "rejected", 1).otherwise(0)).cast("bigint").alias("rejected"),
        F.sum(F.when(F.col("stage") == "approved", 1).otherwise(0)).cast("bigint").alias("approved"),
        F.sum(F.when(F.col("stage") == "final", 1).otherwise(0)).cast("bigint").alias("final"))


def correction_rate(entities_with_edits: DataFrame) -> DataFrame:
    """EVAL-09: share of entities whose replacement a human overrode."""
    return entities_with_edits.agg(
        F.count(F.lit(1)).cast("bigint").alias("entities"),
        F.sum(F.when(F.col("edited"), 1).otherwise(0)).cast("bigint").alias("edited")) \
        .withColumn("rate", F.round(_safe_div(F.col("edited"), F.col("entities")), 4))
