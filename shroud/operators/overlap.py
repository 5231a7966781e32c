"""Overlap resolution (OVL-01..07).

The reference folds the sorted candidates of a document sequentially. Two candidates in
different *islands* (maximal runs where each start is <= the running max end, touching
included) can never conflict, so the fold only needs to run inside each island:

* islands: one ``doc_id`` window -- running max(end) of the preceding rows, a new island
  starts when start > that max; island id = running sum;
* an island is gathered with ``collect_list``, sorted and folded with ``aggregate``.

The fold keeps one entity open. Candidates come by start, so a kept entity that ends before the
current start can't conflict with anything later, and a candidate is only appended when no kept one
reaches it: at most one kept entity ever can. Each step compares with that one alone and notes the place of
an entity that is closed, so an island of n candidates costs about n. For the same reason the kept
entities of the first pass (overlap or touch) never overlap, and the second pass (overlap) changes nothing.
Spans without characters are no entities and are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.steps import bind, scan

SORT_FIELDS = ["start", "neg_len", "neg_conf", "type", "recognizer", "value"]


def fold(arr: Column) -> Column:
    """The entities that stay of a sorted, non-empty array: a candidate that the open entity reaches replaces it or
    is dropped, any other one closes it. Only the open entity's place and span are carried."""

    def step(last: Column, e: Column) -> tuple[Column, Column]:
        opened = F.struct(last["n"].alias("i"), (last["n"] + 1).alias("n"), e["start"].alias("start"), e["end"].alias("end"), e["confidence"].alias("confidence"))
        passed = F.struct(last["i"].alias("i"), (last["n"] + 1).alias("n"), last["start"].alias("start"), last["end"].alias("end"), last["confidence"].alias("confidence"))
        closes = e["start"] > last["end"]
        wins = (e["confidence"] > last["confidence"]) | (
            (e["confidence"] == last["confidence"]) & ((e["end"] - e["start"]) > (last["end"] - last["start"])))
        return F.when(closes | wins, opened).otherwise(passed), F.when(closes & (last["i"] >= 0), last["i"])

    none = F.struct(F.lit(-1).alias("i"), F.lit(0).alias("n"), F.lit(-1).alias("start"), F.lit(-1).alias("end"), F.lit(0.0).alias("confidence"))

    def chosen(x: Column) -> Column:
        places = F.concat(F.filter(x["s"]["outs"], lambda i: i.isNotNull()), F.array(x["s"]["last"]["i"]))
        return F.transform(places, lambda i: F.get(x["a"], i))

    return bind(arr, lambda a: bind(F.struct(a.alias("a"), scan(a, none, step, "int").alias("s")), chosen))


def pair(arr: Column) -> Column:
    """What ``fold`` keeps of two entities, without its passes."""
    a, b = F.get(arr, 0), F.get(arr, 1)
    wins = (b["confidence"] > a["confidence"]) | ((b["confidence"] == a["confidence"]) & ((b["end"] - b["start"]) > (a["end"] - a["start"])))
    return F.when(b["start"] > a["end"], arr).otherwise(F.array(F.when(wins, b).otherwise(a)))


def resolve_overlaps(ents: DataFrame) -> DataFrame:
    """OVL-01..03 on approved entities (doc_id, type, recognizer, start, end, value, confidence, ...)."""
    cols = ents.columns
    e = ents.filter(F.col("end") > F.col("start"))
    e = e.withColumn("neg_len", -(F.col("end") - F.col("start"))).withColumn("neg_conf", -F.col("confidence"))
    w = Window.partitionBy("doc_id").orderBy(*SORT_FIELDS)
    prev_max = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    e = e.withColumn("_new", F.when(prev_max.isNull() | (F.col("start") > prev_max), 1).otherwise(0))
    e = e.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    payload = [c for c in cols if c not in ("doc_id",)]
    # struct ordering: the sort key first so sort_array gives (start, -len, -conf, ...)
    key = [F.col(c) for c in SORT_FIELDS]
    rest = [F.col(c) for c in payload if c not in SORT_FIELDS]
    st = F.struct(*key, *rest)
    # groupBy(doc_id, island) reuses the doc_id partitioning of the window (no new shuffle);
    # one-entity islands fold trivially, so there is no separate branch to union back
    grouped = e.groupBy("doc_id", "_island").agg(F.sort_array(F.collect_list(st)).alias("_arr"))
    arr = F.col("_arr")
    kept = F.when(F.size(arr) == 1, arr).when(F.size(arr) == 2, pair(arr)).otherwise(fold(arr))
    folded = grouped.select("doc_id", F.explode(kept).alias("_e")).select("doc_id", "_e.*")
    return folded.select(*cols)


def number_entities(ents: DataFrame) -> DataFrame:
    """OVL-07: 1-based ``id`` per document in start order."""
    w = Window.partitionBy("doc_id").orderBy("start", "end", "type")
    return ents.withColumn("id", F.row_number().over(w).cast("int"))


def overlapping_pairs(ents: DataFrame) -> DataFrame:
    """OVL-06: pairs of final entities that overlap (must be empty). Sweep, not a self join:
    an entity overlaps an earlier one iff its start < running max(end) of the earlier rows."""
    w = Window.partitionBy("doc_id").orderBy("start", "end", "type").rowsBetween(Window.unboundedPreceding, -1)
    prev = ents.withColumn("_prev_end", F.max("end").over(w))
    return prev.filter(F.col("start") < F.col("_prev_end")).drop("_prev_end")
