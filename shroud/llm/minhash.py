"""MinHash near-duplicate detection with tensored banding and exact verification.

Two small collections of ``M`` MinHash keys (``a`` minima each) are computed per document, and every
pair (i, j) of the two collections forms one of the ``M * M`` tables: ``2 * M * a`` minima serve
``M * M`` tables, about the square root of what independent tables would need. A pair of similarity s
meets in some table with probability ``(1 - (1 - s**a)**M)**2``: ``shape`` takes ``a`` so that this is
0.9995 or more at the threshold, and nearer 1 above it.

1. One pass over the texts: shingle-set fingerprint, set size and the 2m keys. Equal sets collapse to
   the smallest id before anything else moves.
2. Tables: every member of a bucket is tied to the bucket's smallest id (a star, never all pairs).
   Ties whose signatures disagree strongly are tied again among themselves, so that chance
   collisions do not chain families together.
3. Families (components of the ties) get their texts once; large families are dealt into blocks of
   bounded size and every pair of blocks meets in a task, which intersects the full shingle sets and
   returns a spanning forest of the true links.
4. Components of the links; the smallest id of each stays.

Edge cases: a null or empty text, or one of separators only, has no shingles and no links; fewer than
five words give one shingle; rows with an equal id are one node (each row is returned); rows with a
null id have a null component and are kept; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shroud.llm.common import components, written
from shroud.llm.text import FOLD, mix64, slices, weights, word_hashes, words

K = 5  # words in a shingle
M = 12  # keys in a collection
BLOCK, BLOCK_BYTES = 256, 4 << 20  # documents and bytes in a block of a large family
MARGIN = 0.25  # a tie is doubtful if the share of equal minima is this far below the threshold (over 4 standard deviations)


def shingle_sets(t, k: int = K) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text of a slice."""
    start, end, first = words(t)
    h = word_hashes(FOLD[t.buf], start, end)
    w = weights(k)
    rolled = np.zeros(len(h), np.uint64)
    for i in range(min(k, len(h))):
        rolled[: len(h) - i] += h[i:] * w[i]
    rolled = mix64(rolled)
    out = []
    for i in range(len(t)):
        lo, hi = first[i], first[i + 1]
        if hi - lo >= k:
            out.append(np.unique(rolled[lo : hi - k + 1]))
        elif hi > lo:
            out.append(mix64(np.add.reduce(h[lo:hi] * w[: hi - lo], keepdims=True) + np.uint64(hi - lo)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def shape(percent: int) -> int:
    """The minima in a key: two of the threshold's similarity share a key with probability of about a half."""
    return max(1, min(6, int(np.log(0.5) / np.log(percent / 100)))) if percent < 100 else 6


def minima(s: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """The set's least hash under each seed; long sets in parts of bounded memory."""
    low = np.full(len(seeds), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 4096):
        np.minimum(low, mix64(s[None, i : i + 4096] ^ seeds[:, None]).min(axis=1), out=low)
    return low


def _sketch(batches: Iterator[pa.RecordBatch], a: int) -> Iterator[pa.RecordBatch]:
    w = weights(a)
    seeds = mix64(np.arange(1, 2 * a * M + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    for batch in batches:
        for t in slices(batch["text"]):
            ids = batch["doc_id"].slice(t.first, len(t))
            sets = shingle_sets(t)
            n = np.array([len(s) for s in sets], np.int64)
            low = np.stack([minima(s, seeds) for s in sets])
            keys = mix64((low.reshape(len(sets), 2 * M, a) * w).sum(axis=2, dtype=np.uint64))
            f = np.stack([np.array([s.sum(dtype=np.uint64), mix64(s + np.uint64(1)).sum(dtype=np.uint64)]) if len(s) else np.zeros(2, np.uint64) for s in sets])
            sig = (low & np.uint64(255)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([
                ids, pa.array(n), pa.array(f[:, 0].view(np.int64)), pa.array(f[:, 1].view(np.int64)),
                pa.ListArray.from_arrays(np.arange(0, keys.size + 1, 2 * M, dtype=np.int32), pa.array(keys.reshape(-1).view(np.int64))),
                pa.array([r.tobytes() for r in sig], pa.binary())], names=["doc_id", "n_shingles", "f1", "f2", "keys", "sig"])


def sketches(docs: DataFrame, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, f1, f2, keys, sig): one row per document, from one pass over the texts."""
    a = shape(percent)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(lambda batches: _sketch(batches, a), "doc_id bigint, n_shingles bigint, f1 bigint, f2 bigint, keys array<bigint>, sig binary")


def _ties(spark, reps: DataFrame, percent: int) -> DataFrame:
    """Edges (u, v) whose components hold every pair that meets in a table."""
    table_keys = F.expr(f"""flatten(transform(slice(keys, 1, {M}), (x, i) ->
        transform(slice(keys, {M + 1}, {M}), (y, j) -> xxhash64(x, y, i * {M} + j))))""")
    member = reps.select("doc_id", F.explode(table_keys).alias("key"))
    hub = F.min("doc_id").over(Window.partitionBy("key"))
    tied = written(member.withColumn("hub", hub).where("doc_id <> hub"), "tied")
    sig = reps.select("doc_id", "sig")
    pairs = tied.select("hub", "doc_id").distinct().join(sig, "doc_id").join(sig.select(F.col("doc_id").alias("hub"), F.col("sig").alias("hub_sig")), "hub")

    def agree(batches):
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b[c].to_pylist()), np.uint8).reshape(b.num_rows, -1) for c in ("sig", "hub_sig"))
                near = (x == y).mean(axis=1) >= percent / 100 - MARGIN
                yield pa.RecordBatch.from_arrays([b["hub"], b["doc_id"], pa.array(near)], names=["hub", "doc_id", "near"])

    judged = written(pairs.select("hub", "doc_id", "sig", "hub_sig").mapInArrow(agree, "hub bigint, doc_id bigint, near boolean"), "judged")
    doubtful = tied.join(judged.where("not near"), ["hub", "doc_id"], "left_semi").withColumn("hub", hub).where("doc_id <> hub")
    return judged.where("near").select(F.col("hub").alias("u"), F.col("doc_id").alias("v")).unionByName(
        doubtful.select(F.col("hub").alias("u"), F.col("doc_id").alias("v")))


def _links(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs with 100 * intersection >= percent * union."""
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []

    def tie(i, j):
        a, b = root(i), root(j)
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((i, j))

    if n <= 8:
        for i in range(n):
            for j in range(i + 1, n):
                if size[i] and size[j] and min(size[i], size[j]) * 100 >= percent * max(size[i], size[j]) and root(i) != root(j):
                    both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if 100 * both >= percent * (size[i] + size[j] - both):
                        tie(i, j)
        return out
    all_, owner = np.concatenate(sets), np.repeat(np.arange(n), size)
    values, place, count = np.unique(all_, return_inverse=True, return_counts=True)
    shared = count[place] > 1
    place, owner = (np.cumsum(count > 1) - 1)[place[shared]], owner[shared]
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    both = np.zeros((n, n), np.float64)
    columns = 4096
    for lo in range(0, int(place[-1]) + 1 if len(place) else 0, columns):  # exact: counts of at most 4096 in float32
        a, b = np.searchsorted(place, (lo, lo + columns))
        part = np.zeros((n, columns), np.float32)
        part[owner[a:b], place[a:b] - lo] = 1
        both += part @ part.T
    linked = np.triu(100 * both >= percent * (size[:, None] + size[None, :] - both), 1) & (size[:, None] > 0) & (size[None, :] > 0)
    for i, j in zip(*np.nonzero(linked)):
        tie(int(i), int(j))
    return out


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, ids, sets = None, [], []

        def close():
            found = _links(sets, percent)
            return pa.RecordBatch.from_arrays([pa.array([ids[i] for i, _ in found], pa.int64()), pa.array([ids[j] for _, j in found], pa.int64())], names=["u", "v"])

        for batch in batches:
            keys = list(zip(*(batch[c].to_pylist() for c in ("family", "x", "y"))))
            doc = batch["doc_id"].to_pylist()
            for t in slices(batch["text"]):
                for i, s in enumerate(shingle_sets(t)):
                    if keys[t.first + i] != group:
                        if len(ids) > 1:
                            yield close()
                        group, ids, sets = keys[t.first + i], [], []
                    ids.append(doc[t.first + i])
                    sets.append(s)
        if len(ids) > 1:
            yield close()

    return run


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row per row of ``docs`` (doc_id, text).

    ``percent``: two documents are linked if 100 * |intersection| >= percent * |union| of their shingle sets.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    seen = written(sketches(docs, percent), "sketches")
    # equal sets: the smallest id stands for all
    first = written(seen.where("n_shingles > 0 and doc_id is not null").groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "first")
    reps = seen.join(first.select(F.col("rep").alias("doc_id"), "f1", "f2"), ["doc_id", "f1", "f2"], "left_semi").where("n_shingles > 0").select("doc_id", "keys", "sig").dropDuplicates(["doc_id", "keys"])
    families = written(components(_ties(spark, reps, percent)), "families")

    own = docs.join(families.select(F.col("node").alias("doc_id"), F.col("root").alias("family")), "doc_id")
    sized = own.groupBy("family").agg(F.count("*").alias("c"), F.sum(F.octet_length("text")).alias("b"))
    parts = F.greatest(F.ceil(F.col("c") / BLOCK), F.ceil(F.col("b") / BLOCK_BYTES), F.lit(1)).cast("int")
    dealt = own.join(sized.select("family", parts.alias("parts")), "family").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("doc_id", "text", "family", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"))
    dealt = dealt.repartition("family", "x", "y").sortWithinPartitions("family", "x", "y")
    links = dealt.mapInArrow(_verify(percent), "u bigint, v bigint")
    found = written(components(links), "roots")

    again = first.where("n > 1").select("f1", "f2", "n_shingles", "rep")
    out = seen.select("doc_id", "n_shingles", "f1", "f2").join(again, ["f1", "f2", "n_shingles"], "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("rep", "doc_id")).otherwise(F.col("doc_id")).alias("rep"))
    out = out.join(found.select(F.col("node").alias("rep"), "root"), "rep", "left")
    component = F.coalesce("root", "rep")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
