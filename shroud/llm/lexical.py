"""Ranked lexical search over a term-partitioned index: bundles of items pass from one term owner to the next.

``blocks`` reads the documents once and writes, per block of documents, the postings of the bundle's terms.
From their counts every term gets its weight, and the terms are dealt to ``OWNERS`` owners, the heaviest (rarest)
first, with about equal numbers of postings. The bundle starts with empty accumulators for each block. At each owner
they are cogrouped with the postings that this owner holds of the block, the owner adds its terms' integer
contributions and the bundle moves on; after the last owner each block has its best documents, of which Spark
selects the best of all.

A document leaves an item's accumulators only when it can't be among the best any more: its score with the
most that the later owners could add stays below the score that ``top`` other documents of its block have already.
So results are exact. Blocks are bounded, so a term that every document holds is spread over all blocks, and no
group grows with the input.

A bundle has items with about ``BUNDLE`` terms together (bound of what is broadcast); more items make more bundles,
each with its own pass over the documents.

Edge cases: each row of ``docs`` is a document of its own, so repeated rows are ranked next to each other; rows
without terms (null and empty texts too) are found by nothing; a null doc_id stays null and comes first among
equal scores. Items are told apart by item_id, a null one too; texts of rows with one item_id are taken together;
items without terms or hits have no rows. Empty tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shroud.llm.common import written
from shroud.llm.text import FOLD, distinct_exact, slices, words

OWNERS = 4
BUNDLE = 200_000  # terms of a bundle's items, about
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SEPARATOR = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

BLOCK = "block bigint, docs array<bigint>, n array<bigint>, codes array<int>, df array<bigint>, most array<bigint>, doc array<int>, tf array<int>"
OWNED = "owner int, block bigint, codes array<int>, df array<bigint>, doc array<int>, tf array<int>"
BUNDLES = "block bigint, docs array<bigint>, m array<bigint>, items array<int>, held array<int>, doc array<int>, score array<bigint>"
FOUND = "item int, doc_id bigint, score bigint"


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term), each once."""
    terms = F.split(F.translate(F.col("text").cast("string"), UPPER, LOWER), SEPARATORS)
    return items.select(F.col("item_id").cast("bigint").alias("item_id"), F.explode(terms).alias("term")).where("term <> ''").distinct()


class Bundle:
    """The items of a bundle: ``terms`` sorted; the term codes of item i are ``code[at[i] : at[i + 1]]``."""

    def __init__(self, rows: pa.Table):
        ids = pc.unique(rows["item_id"].combine_chunks())
        self.ids = ids.to_pylist()
        self.terms = pa.array(sorted(set(t.encode() for t in rows["term"].to_pylist())), pa.large_binary())
        item = pc.index_in(rows["item_id"], value_set=ids).to_numpy(zero_copy_only=False).astype(np.int64)
        code = pc.index_in(rows["term"].cast(pa.large_binary()), value_set=self.terms).to_numpy(zero_copy_only=False).astype(np.int64)
        order = np.lexsort((code, item))
        self.code, self.at = code[order], np.searchsorted(item[order], np.arange(len(self.ids) + 1))


def blocks(docs: DataFrame, bundle: Bundle) -> DataFrame:
    """One row a block of documents: their ids and numbers of terms, and the postings of the bundle's terms by term."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(bundle.terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for t in slices(batch["text"]):
                start, end, bounds = words(t, SEPARATOR)
                code = np.zeros(0, np.int64)
                if len(start):
                    distinct, index = distinct_exact(FOLD[t.buf], start, end, SEPARATOR)
                    code = pc.fill_null(pc.index_in(distinct.cast(pa.large_binary()), value_set=shared.value), -1).to_numpy(zero_copy_only=False).astype(np.int64)[index]
                known = np.flatnonzero(code >= 0)
                doc = np.searchsorted(bounds, known, side="right") - 1
                key, tf = np.unique(code[known] * len(t) + doc, return_counts=True)
                codes, first, df = np.unique(key // len(t), return_index=True, return_counts=True)
                most = np.maximum.reduceat(tf, first) if len(first) else first
                row = [[number], [batch["doc_id"].slice(t.first, len(t)).to_pylist()], [np.diff(bounds)], [codes], [df], [most], [key % len(t)], [tf]]
                yield pa.RecordBatch.from_arrays([pa.array(v, f) for v, f in zip(row, SCHEMA[BLOCK].types)], schema=SCHEMA[BLOCK])
                number += 1

    return docs.mapInArrow(run, BLOCK)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "array<int>": pa.list_(pa.int32()), "array<bigint>": pa.list_(pa.int64())}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.strip().split(" ") for c in ddl.split(","))])


SCHEMA = {ddl: _arrow(ddl) for ddl in (BLOCK, OWNED, BUNDLES, FOUND)}


def _list(column, row: int = 0) -> np.ndarray:
    return column[row].values.to_numpy(zero_copy_only=False)


class Weights:
    """Weight, owner and largest contribution of every term of a bundle."""

    def __init__(self, bundle: Bundle, stats: pa.Table, documents: int, terms: int):
        n = len(bundle.terms)
        self.documents, self.all_terms = documents, max(terms, 1)
        df, most = np.zeros(n, np.int64), np.ones(n, np.int64)
        at = stats["code"].to_numpy()
        df[at], most[at] = stats["df"].to_numpy(), stats["most"].to_numpy()
        self.weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
        order = np.argsort(-self.weight, kind="stable")  # the rarest first
        share = np.cumsum(df[order])
        self.owner = np.empty(n, np.int64)
        self.owner[order] = np.minimum(share * OWNERS // (int(share[-1]) + 1 if n else 1), OWNERS - 1)
        limit = self.weight * ((1_000_000_000 * most) // (1000 * most + 20 * 50))
        self.code, self.at, self.ids = bundle.code, bundle.at, bundle.ids
        #: per item and owner: the most that the owners after it can add
        self.later = np.zeros((OWNERS, len(self.ids)), np.int64)
        item = np.repeat(np.arange(len(self.ids)), np.diff(self.at))
        for k in range(OWNERS - 1):
            np.add.at(self.later[k], item, np.where(self.owner[self.code] > k, limit[self.code], 0))

    def m(self, n: np.ndarray) -> np.ndarray:
        return 100 - 50 + (50 * n * self.documents) // self.all_terms

    def of_owner(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(codes, at): the terms of each item that owner k holds."""
        mine = self.owner[self.code] == k
        return self.code[mine], np.concatenate([[0], np.cumsum(mine)])[self.at]


def _dealt(found: DataFrame, shared) -> DataFrame:
    """The postings of each block, by owner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                codes, df = _list(batch["codes"], i), _list(batch["df"], i)
                doc, tf = _list(batch["doc"], i), _list(batch["tf"], i)
                owner = shared.value.owner[codes]
                posting = np.repeat(owner, df)
                mine = [k for k in range(OWNERS) if (owner == k).any()]
                columns = [mine, [batch["block"][i].as_py()] * len(mine), *([x[by == k] for k in mine] for x, by in ((codes, owner), (df, owner), (doc, posting), (tf, posting)))]
                yield pa.RecordBatch.from_arrays([pa.array(v, f) for v, f in zip(columns, SCHEMA[OWNED].types)], schema=SCHEMA[OWNED])

    return found.select("block", "codes", "df", "doc", "tf").mapInArrow(run, OWNED)


def _best(scores: np.ndarray, ids: np.ndarray, top: int) -> np.ndarray:
    """Places of the ``top`` best, ties by id; ``ids`` order like the document ids, nulls first."""
    if len(scores) > top:
        limit = np.partition(scores, len(scores) - top)[len(scores) - top]
        some = np.flatnonzero(scores >= limit)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some]))][:top]


def _visit(k: int, shared, top: int):
    """The step of owner k: adds its terms' contributions to a block's accumulators."""

    def run(bundle: pa.Table, postings: pa.Table) -> pa.Table:
        w: Weights = shared.value
        last = k == OWNERS - 1
        if not bundle.num_rows:
            return (SCHEMA[FOUND] if last else SCHEMA[BUNDLES]).empty_table()
        m, size = _list(bundle["m"]), len(bundle["docs"][0])
        place, begin = {}, np.zeros(1, np.int64)
        if postings.num_rows:
            codes, df, doc, tf = (_list(postings[c]).astype(np.int64) for c in ("codes", "df", "doc", "tf"))
            add = np.repeat(w.weight[codes], df) * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[doc]))
            begin = np.concatenate([[0], np.cumsum(df)])
            place = {c: i for i, c in enumerate(codes.tolist())}
        held = dict(zip(_list(bundle["items"]).tolist(), np.split(np.arange(len(bundle["doc"][0])), np.cumsum(_list(bundle["held"]))[:-1])))
        old_doc, old_score = _list(bundle["doc"]), _list(bundle["score"])
        mine, at = w.of_owner(k)
        ids = None
        out: list[tuple[int, np.ndarray, np.ndarray]] = []
        for item in range(len(w.ids)):
            lists = [place[c] for c in mine[at[item] : at[item + 1]].tolist() if c in place]
            had = held.get(item)
            if not lists and had is None:
                continue
            score = np.zeros(size, np.int64)
            if had is not None:
                score[old_doc[had]] = old_score[had]
            for i in lists:  # a term has a document once
                score[doc[begin[i] : begin[i + 1]]] += add[begin[i] : begin[i + 1]]
            some = np.flatnonzero(score)
            got = score[some]
            if last:
                if ids is None:
                    ids = pc.fill_null(bundle["docs"][0].values, np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
                best = _best(got, ids[some], top)
                some, got = some[best], got[best]
            elif len(got) > top:
                stay = got + w.later[k, item] >= np.partition(got, len(got) - top)[len(got) - top]
                some, got = some[stay], got[stay]
            if len(some):
                out.append((item, some, got))
        items = [i for i, _, _ in out]
        held_ = [len(d) for _, d, _ in out]
        docs = np.concatenate([d for _, d, _ in out]) if out else np.zeros(0, np.int64)
        scores = np.concatenate([s for _, _, s in out]) if out else np.zeros(0, np.int64)
        if last:
            return pa.Table.from_arrays([pa.array(np.repeat(np.array(items, np.int32), held_), pa.int32()), bundle["docs"][0].values.take(pa.array(docs)), pa.array(scores)], schema=SCHEMA[FOUND])
        columns = [bundle["block"].to_pylist(), bundle["docs"].to_pylist(), [m], [items], [held_], [docs], [scores]]
        return pa.Table.from_arrays([pa.array(v, f) for v, f in zip(columns, SCHEMA[BUNDLES].types)], schema=SCHEMA[BUNDLES])

    return run


def _started(found: DataFrame, shared) -> DataFrame:
    """The bundle before its first owner: each block's documents with empty accumulators."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                columns = [[batch["block"][i].as_py()], batch["docs"].slice(i, 1), [shared.value.m(_list(batch["n"], i))], [[]], [[]], [[]], [[]]]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f) for c, f in zip(columns, SCHEMA[BUNDLES].types)], schema=SCHEMA[BUNDLES])

    return found.select("block", "docs", "n").mapInArrow(run, BUNDLES)


def _ranked(docs: DataFrame, bundle: Bundle, top: int) -> DataFrame:
    spark = docs.sparkSession
    found = written(blocks(docs, bundle), "blocks")
    total = found.select(F.explode("n").alias("n")).agg(F.sum((F.col("n") > 0).cast("bigint")), F.sum("n")).first()
    stats = found.select(F.explode(F.arrays_zip("codes", "df", "most")).alias("x")).groupBy(F.col("x.codes").alias("code")).agg(F.sum("x.df").alias("df"), F.max("x.most").alias("most"))
    shared = spark.sparkContext.broadcast(Weights(bundle, stats.toArrow(), total[0] or 0, total[1] or 0))
    owned = written(_dealt(found, shared), "owned", by="owner")
    bundles = _started(found, shared)
    for k in range(OWNERS):
        mine = owned.where(F.col("owner") == k).drop("owner")
        bundles = bundles.groupBy("block").cogroup(mine.groupBy("block")).applyInArrow(_visit(k, shared, top), FOUND if k == OWNERS - 1 else BUNDLES)
    by = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    best = bundles.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)
    names = spark.createDataFrame([(i, x) for i, x in enumerate(bundle.ids)], "item int, item_id bigint")
    return best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def rank(docs: DataFrame, items: DataFrame, top: int = 50) -> DataFrame:
    """The ``top`` best documents of ``docs`` (doc_id, text) for each of ``items`` (item_id, text): item_id, rank, doc_id, score."""
    terms = written(item_terms(items), "terms")
    n = max(1, math.ceil(terms.count() / BUNDLE))
    result = None
    for b in range(n):
        part = terms.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == b).orderBy("item_id", "term").toArrow()
        if part.num_rows:
            one = _ranked(docs, Bundle(part), top)
            result = one if result is None else result.unionByName(one)
    if result is None:
        return docs.sparkSession.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    return result
