"""Embedding near-duplicates by an exact join of sorted leaves.

Unit vectors at cosine c are at squared distance 2 - 2c. Equal vectors collapse to one, with a weight; the distinct
ones are written once, sorted by label, in files of bounded size (leaves). Every two leaves that share a label meet
in a task of bounded memory that reads them from the shared folder, so a vector is written once however many leaves
it meets. A leaf's vectors meet in parts: a product in single precision, with room for its rounding, finds the
candidates and the exact cosine in double precision decides. Longer vectors are rotated by a fixed random rotation and
split into blocks of ``WIDTH`` coordinates: a pair within the whole budget is within its proportional share in at
least one block, and is counted in the first such one. No pairs are written: tasks return counts, and a spanning
forest for the components.

Edge cases: a vector that is null, empty, zero or holds a null or non-finite component, or whose label
is null, links with nothing; vectors of different length are not compared; rows with equal ids are
vectors of their own, linked by their own values; a null id has no component and is kept;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shroud.llm.common import components, shared_dir, written
from shroud.llm.warc import store

WIDTH = 256  # coordinates in a block
LEAF = 16384  # vectors in a leaf
PART = 4096  # vectors in a part of a leaf
SLACK = 1e-9  # for rounding in the block distances
SINGLE = 4e-7  # for rounding in a product of single precision, a coordinate
ROWS = 512
PAIRS = 32  # pairs of leaves in a task, at most

_rotations: dict[int, np.ndarray] = {}


def rotation(d: int) -> np.ndarray:
    if d not in _rotations:
        q, r = np.linalg.qr(np.random.default_rng(20 + d).standard_normal((d, d)))
        _rotations[d] = q * np.sign(np.diag(r))
    return _rotations[d]


def spans(d: int) -> list[tuple[int, int]]:
    return [(lo, min(lo + WIDTH, d)) for lo in range(0, d, WIDTH)]


def units(raw: list[bytes], d: int) -> np.ndarray:
    """Unit vectors of ``d`` components that are given in single or double precision."""
    x = np.empty((len(raw), d))
    for kind in (np.float32, np.float64):
        some = [i for i, r in enumerate(raw) if len(r) == d * np.dtype(kind).itemsize]
        if some:
            x[some] = np.frombuffer(b"".join(raw[i] for i in some), kind).reshape(len(some), d)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _vectors(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, vectors) of the lists without nulls, by their length."""
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    for size in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero(lengths == size)
        values = column.take(pa.array(rows)).flatten()
        x = values.fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(len(rows), size)  # null and not a number are both invalid
        yield rows, x


def _usable(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, vectors) that can link, by their length."""
    labelled = b["label"].is_valid().to_numpy(zero_copy_only=False)
    for rows, x in _vectors(b["embedding"]):
        some = labelled[rows] & np.isfinite(x).all(axis=1) & x.any(axis=1)
        if some.any():
            yield rows[some], x[some]


def _valid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that can link, with the components as bytes (in single precision where that holds them) and a fingerprint."""
    names = ["vec_id", "label", "data", "print"]
    for b in batches:
        for rows, x in _usable(b):
            own = pa.array(rows)
            labels = pa.array([f"{label}/{x.shape[1]}" for label in b["label"].take(own).to_pylist()], pa.string())
            prints = [hashlib.blake2b(v.tobytes(), digest_size=16).digest() for v in x]
            scale = np.abs(x).max(axis=1)
            far = ~((1e-100 < scale) & (scale < 1e100))
            x = np.where(far[:, None], x / scale[:, None], x)
            with np.errstate(over="ignore", under="ignore"):
                single = x.astype(np.float32)
            fits = (single.astype(np.float64) == x).all(axis=1)
            data = [(s if f else v).tobytes() for s, v, f in zip(single, x, fits)]
            yield pa.RecordBatch.from_arrays([b["vec_id"].take(own), labels, pa.array(data, pa.binary()), pa.array(prints, pa.binary())], names=names)


def _forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int]]:
    parent = np.arange(n)

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    for a, b in pairs:
        roots = parent.copy()
        while True:  # flatten, then look at pairs that are not yet together
            up = roots[roots]
            if (up == roots).all():
                break
            roots = up
        some = roots[a] != roots[b]
        for i, j in zip(a[some], b[some]):
            x, y = root(i), root(j)
            if x != y:
                parent[max(x, y)] = min(x, y)
                out.append((int(i), int(j)))
    return out


def links(x: np.ndarray, block: int, cosine: float, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, first): rows i of ``left`` and j of ``right`` at ``cosine`` or more, found through this block; first: no block before it finds them."""
    d = x.shape[1]
    limit = 2 - 2 * cosine
    cuts = spans(d)
    turned = x @ rotation(d) if len(cuts) > 1 else x
    lo, hi = cuts[block]
    share = limit * (hi - lo) / d + SLACK

    def half(rows):
        return (turned[rows, lo:hi] ** 2).sum(axis=1)[:, None] / 2

    # -1/2 of the squared distance as one product: (z, |z|^2/2, 1) times (y, -1, -|y|^2/2)
    y = np.hstack([turned[right, lo:hi], np.full((len(right), 1), -1.0), -half(right)]).astype(np.float32).T
    least = np.float32(-share / 2 - SINGLE * (hi - lo + 4))
    for at in range(0, len(left), ROWS):
        rows = left[at : at + ROWS]
        z = np.hstack([turned[rows, lo:hi], half(rows), np.ones((len(rows), 1))]).astype(np.float32)
        near = np.flatnonzero(z @ y >= least)
        for c in range(0, len(near), 50_000):
            i, j = np.divmod(near[c : c + 50_000], len(right))
            a, b = rows[i], right[j]
            some = a != b
            a, b = a[some], b[some]
            some = np.einsum("ij,ij->i", x[a], x[b]) >= cosine
            a, b = a[some], b[some]
            if len(a):
                first = np.ones(len(a), bool)
                if block:
                    diff = (turned[a] - turned[b]) ** 2
                    for p, q in cuts[:block]:
                        first &= diff[:, p:q].sum(axis=1) > limit * (q - p) / d + SLACK
                yield a, b, first


def _met(x: np.ndarray, of: np.ndarray, weight: np.ndarray, cosine: float, part: int, count: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Adds to ``count`` the links of the vectors of one label, those of one leaf or (``of``: leaf 0 or 1) of two with each other, and
    yields them; parts meet once."""
    left, right = (np.flatnonzero(of == k) for k in (0, of.max()))
    for p in range(0, len(left), part):
        for q in range(0, len(right), part) if of.any() else range(p, len(left), part):
            one, two = left[p : p + part], right[q : q + part]
            for block in range(len(spans(x.shape[1]))):
                for a, b, first in links(x, block, cosine, one, two):
                    np.add.at(count, a[first], weight[b[first]])
                    if of.any() or p != q:
                        np.add.at(count, b[first], weight[a[first]])
                    yield a, b


def _join(folder: str, leaves, cosine: float, part: int):
    """Pairs of leaves -> the forest (u, v) of their links and the number of links (u, null, n)."""
    names = ["u", "v", "n"]

    def read(k: int) -> pa.Table:
        files, top = store(folder)
        found = []
        for name in leaves.value[k]:
            with files.open_input_file(f"{top}/{name}") as f:
                found.append(pq.read_table(f, columns=["label", "rep", "data", "weight"]))
        return pa.concat_tables(found)

    def by_label(t: pa.Table) -> dict[str, np.ndarray]:
        coded = t["label"].combine_chunks().dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(codes, kind="stable")
        return dict(zip(coded.dictionary.to_pylist(), np.split(order, np.flatnonzero(np.diff(codes[order])) + 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, q in zip(b["p"].to_pylist(), b["q"].to_pylist()):
                tables = [read(k) for k in ([p] if p == q else [p, q])]
                places = [by_label(t) for t in tables]
                for label in places[0].keys() & places[-1].keys():
                    some = [t.take(pa.array(at[label])) for t, at in zip(tables, places)]
                    both = pa.concat_tables(some)
                    x = units(both["data"].to_pylist(), int(label.rpartition("/")[2]))
                    weight, ids = both["weight"].to_numpy(), both["rep"].to_numpy()
                    count = np.zeros(len(x), np.int64)
                    edges = _forest(len(x), _met(x, np.repeat(np.arange(len(some)), [len(t) for t in some]), weight, cosine, part, count))
                    linked = np.flatnonzero(count)
                    if len(linked):
                        u = [*(ids[i] for i, _ in edges), *ids[linked]]
                        v = [*(ids[j] for _, j in edges), *[None] * len(linked)]
                        n = [*[0] * len(edges), *count[linked]]
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (u, v, n)], names=names)

    return run


def near_duplicates(vectors: DataFrame, cosine: float = 0.93) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row per row of ``vectors`` (vec_id, embedding, label)."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    valid = rows.mapInArrow(_valid, "vec_id bigint, label string, data binary, print binary")
    # `rep` numbers a distinct vector of a label
    alike = valid.groupBy("label", "print").agg(F.min("vec_id").alias("vec"), F.count("*").alias("weight"), F.first("data").alias("data")).withColumn("rep", F.xxhash64("label", "print"))
    folder = f"{shared_dir(spark).rstrip('/')}/alike-{uuid.uuid4().hex}"
    alike = written(alike.repartitionByRange("label", "rep").sortWithinPartitions("label", "rep"), folder, rows=LEAF)
    # files are ranges of labels; small ones make a leaf together
    files = alike.groupBy(F.col("_metadata.file_name").alias("name")).agg(F.count("*").alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi")).collect()
    leaves, ends, size = [], [], LEAF
    for f in sorted(files, key=lambda f: (f["lo"].encode(), f["hi"].encode(), f["name"])):
        if size + f["n"] > LEAF:
            leaves.append([])
            ends.append((f["lo"].encode(), f["hi"].encode()))
            size = 0
        leaves[-1].append(f["name"])
        ends[-1] = ends[-1][0], max(ends[-1][1], f["hi"].encode())
        size += f["n"]
    # a leaf meets itself and those behind it that begin with one of its labels
    starts = [lo for lo, _ in ends]
    last = [bisect.bisect_right(starts, hi) - 1 for _, hi in ends]
    pairs = sum(q - p + 1 for p, q in enumerate(last))
    tasks = max(1, min(pairs, max(4 * spark.sparkContext.defaultParallelism, -(-pairs // PAIRS))))
    met = spark.createDataFrame(list(enumerate(last)), "p int, last int").select("p", F.explode(F.sequence("p", "last")).alias("q")).repartition(tasks)
    joined = written(met.mapInArrow(_join(folder, spark.sparkContext.broadcast(leaves), cosine, PART), "u bigint, v bigint, n bigint"), "joined")

    counts = joined.where("v is null").groupBy(F.col("u").alias("rep")).agg(F.sum("n").alias("n"))
    roots = components(joined.where("v is not null").select("u", "v"))
    # components by distinct vector; the smallest id of a component names it
    own = alike.select("rep", "label", "print", "vec", "weight").join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    least = own.groupBy("root").agg(F.min("vec").alias("least"))
    own = own.join(least, "root").join(counts, "rep", "left").select("label", "print", "least", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    linked = valid.select("vec_id", "label", "print").join(own, ["label", "print"]).select("vec_id", "n_links", "least")
    invalid = rows.mapInArrow(_other, "vec_id bigint").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("least"))
    out = linked.unionByName(invalid)
    return out.select("vec_id", "n_links", F.when(F.col("vec_id").isNotNull(), F.col("least")).alias("component_id"), F.coalesce(F.col("vec_id") == F.col("least"), F.lit(True)).alias("kept"))


def _other(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ids of the rows that cannot link."""
    for b in batches:
        left = np.ones(b.num_rows, bool)
        for rows, _ in _usable(b):
            left[rows] = False
        yield pa.RecordBatch.from_arrays([b["vec_id"].filter(pa.array(left))], names=["vec_id"])
