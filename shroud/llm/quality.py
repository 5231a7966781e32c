"""Quality classifier: a regularised quadratic discriminant over transformed document statistics.

Every text gives ``FEATURES`` statistics: sizes, shares of character kinds, repetition of words and
lines, and the same shares of its worst lines. They are transformed (logarithms of sizes, arcsine roots of
shares) and standardised. Each class has a mean and a covariance, shrunk to the pooled covariance and then
to a multiple of the identity; the score is the difference of the Mahalanobis log densities, taken with
the cached Cholesky factors, through a logistic curve whose slope and offset are fitted to the labels.

Edge cases: null and empty texts have all-zero statistics and get the score of those; without labelled
rows the score is 0, with one class only it is that class's label; conflicting labels of one id count
once each; repeated rows each get a result; very long texts are read whole; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shroud.llm.common import remainder
from shroud.llm.text import FOLD, Texts, per_text, slices, word_hashes, words

SAMPLE_ROWS = 20_000  # bound of the labelled rows that the classifier is fitted on
TO_POOLED, TO_SPHERE = 0.1, 0.02  # shares of the shrinkage targets

UPPER, DIGIT, MARK, SIGN, OTHER = range(5)
KIND = np.full(256, -1, np.int8)
KIND[65:91] = UPPER
KIND[48:58] = DIGIT
KIND[[ord(c) for c in ".,;:!?'\"-()"]] = MARK
KIND[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]] = SIGN
KIND[128:] = OTHER

NAMES = ["log_bytes", "log_words", "log_lines", "word_mean", "word_deviation", "upper", "digits", "marks", "signs", "non_ascii", "exclamations",
         "repeated_next", "distinct", "most_frequent", "line_upper", "line_signs", "line_marks", "line_repeated", "upper_lines", "sign_lines", "repeated_lines", "same_lines", "long_words", "line_words"]
FEATURES = len(NAMES)


def statistics(t: Texts) -> np.ndarray:
    """(texts, FEATURES), transformed."""
    n = len(t)
    out = np.zeros((n, FEATURES))
    if not len(t.buf):
        return out
    buf, off = t.buf, t.off
    size = np.diff(off).astype(float)
    some = np.maximum(size, 1)
    start, end, first = words(t)
    count = np.diff(first).astype(float)
    # lines end with a text or a line feed
    feed = buf == 10
    begin = np.zeros(len(buf), bool)
    begin[1:] = feed[:-1]
    begin[off[:-1][np.diff(off) > 0]] = True
    line = np.flatnonzero(begin)
    line_first = np.searchsorted(line, off)
    line_size = np.maximum(np.diff(np.append(line, len(buf))), 1).astype(float)
    solid = line_size >= 20
    kind = KIND[buf]
    share = lambda mask: np.arcsin(np.sqrt(np.clip(mask, 0, 1)))
    worst = lambda v: per_text(np.where(solid, v, 0.0), line_first, np.maximum, 0.0)
    mass = lambda flag: per_text(np.where(flag, line_size, 0.0), line_first) / some
    out[:, 0], out[:, 1], out[:, 2] = np.log1p(size), np.log1p(count), np.log1p(np.diff(line_first))
    for i, k in ((5, UPPER), (6, DIGIT), (7, MARK), (8, SIGN), (9, OTHER)):
        here = kind == k
        out[:, i] = share(per_text(here.astype(np.int32), off) / some)
        if k in (UPPER, SIGN, MARK):
            by_line = np.add.reduceat(here.astype(np.int32), line) / line_size
            out[:, {UPPER: 14, SIGN: 15, MARK: 16}[k]] = share(worst(by_line))
            if k == UPPER:
                out[:, 18] = share(mass(by_line > 0.5))
            elif k == SIGN:
                out[:, 19] = share(mass(by_line > 0.1))
    out[:, 10] = share(per_text((buf == 33).astype(np.int32), off) / some)
    if len(start):
        length = (end - start).astype(float)
        mean = per_text(length, first) / np.maximum(count, 1)
        out[:, 3] = np.log1p(mean)
        out[:, 4] = np.log1p(np.sqrt(np.maximum(per_text(length * length, first) / np.maximum(count, 1) - mean**2, 0)))
        out[:, 22] = share(per_text((length > 16).astype(np.int32), first) / np.maximum(count, 1))
        h = word_hashes(FOLD[buf], start, end)
        again = np.zeros(len(h))
        again[1:] = h[1:] == h[:-1]
        again[first[:-1][np.diff(first) > 0]] = 0
        out[:, 11] = share(per_text(again, first) / np.maximum(count, 1))
        doc = np.repeat(np.arange(n), np.diff(first))
        order = np.lexsort((h, doc))
        d, w = doc[order], h[order]
        new = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (w[1:] != w[:-1])]))
        times = np.diff(np.append(new, len(w)))
        owner = np.searchsorted(d[new], np.arange(n + 1))
        out[:, 12] = share(per_text(np.ones(len(new)), owner) / np.maximum(count, 1))
        out[:, 13] = share(per_text(times.astype(float), owner, np.maximum, 0.0) / np.maximum(count, 1))
        line_of = np.searchsorted(line, start, side="right") - 1
        in_line = np.bincount(line_of, minlength=len(line)).astype(float)
        repeated = np.bincount(line_of, again, len(line)) / np.maximum(in_line, 1)
        out[:, 17] = share(worst(np.where(in_line >= 5, repeated, 0.0)))
        out[:, 20] = share(mass((repeated > 0.5) & (in_line >= 5)))
        out[:, 23] = np.log1p(per_text(in_line, line_first, np.maximum, 0.0))
        key = np.zeros(len(line), np.uint64)  # equal lines of a text
        np.add.at(key, line_of, h)
        line_doc = np.repeat(np.arange(n), np.diff(line_first))
        order = np.lexsort((key, line_doc))
        same = (line_doc[order][1:] == line_doc[order][:-1]) & (key[order][1:] == key[order][:-1]) & (in_line[order][1:] > 0)
        out[:, 21] = share(np.bincount(line_doc[order][1:][same], minlength=n) / np.maximum(np.diff(line_first), 1))
    return out


class Discriminant:
    """The fitted classifier; without two classes, a constant."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.constant = None
        if not len(y) or y.min() == y.max() or min((y == 0).sum(), (y == 1).sum()) < 2:
            self.constant = float(y.mean()) if len(y) else 0.0
            return
        self.mean, self.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
        z = (x - self.mean) / self.scale
        parts = [z[y == c] for c in (0, 1)]
        covariances = [np.cov(p, rowvar=False, bias=True) for p in parts]
        pooled = sum(len(p) * s for p, s in zip(parts, covariances)) / len(z)
        self.classes = []
        for p, s in zip(parts, covariances):
            s = (1 - TO_POOLED) * s + TO_POOLED * pooled
            s = (1 - TO_SPHERE) * s + TO_SPHERE * np.trace(s) / FEATURES * np.eye(FEATURES)
            factor = np.linalg.cholesky(s)
            self.classes.append((p.mean(axis=0), np.linalg.inv(factor), 2 * np.log(np.diag(factor)).sum()))
        self.slope, self.offset = 1.0, 0.0
        self.slope, self.offset = self._curve(self.difference(x), y)

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0, compressed: differences grow with the number of statistics."""
        z = (x - self.mean) / self.scale
        low, high = (-0.5 * ((((z - m) @ inv.T) ** 2).sum(axis=1) + log) for m, inv, log in self.classes)
        return np.arcsinh((high - low) / 4)

    @staticmethod
    def _curve(d: np.ndarray, y: np.ndarray) -> tuple[float, float]:
        a, b = 1.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a * d + b, -30, 30)))
            w = p * (1 - p)
            g = np.array([((y - p) * d).sum() - 0.1 * a, (y - p).sum()])
            hess = np.array([[(w * d * d).sum() + 0.1, (w * d).sum()], [(w * d).sum(), w.sum() + 1e-6]])
            step = np.linalg.solve(hess, g)
            a, b = a + float(np.clip(step[0], -1, 1)), b + float(np.clip(step[1], -2, 2))
        return max(a, 1e-3), b

    def probability(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.difference(x) + self.offset, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, train, rows: int = SAMPLE_ROWS) -> Discriminant:
    """A classifier from the labelled rows of ``labels`` (doc_id, quality) that ``train`` (a column) selects."""
    marked = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(train).where("quality in (0, 1) and doc_id is not null")
    marked = marked.orderBy(F.xxhash64(F.lit("quality"), "doc_id"), "doc_id", "quality").limit(rows)
    sample = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(marked), "doc_id").select("text", "quality")  # at most `rows` small rows

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in slices(b["text"]):
                yield pa.RecordBatch.from_arrays([b["quality"].slice(t.first, len(t)), pa.array(list(statistics(t)), pa.list_(pa.float64()))], names=["quality", "x"])

    found = sample.mapInArrow(read, "quality int, x array<double>").toArrow()
    return Discriminant(np.array(found["x"].to_pylist(), float).reshape(-1, FEATURES), np.array(found["quality"].to_pylist(), float))


def score(docs: DataFrame, fitted: Discriminant) -> DataFrame:
    """(doc_id, score), a row per row of ``docs`` (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(fitted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in slices(b["text"]):
                yield pa.RecordBatch.from_arrays([b["doc_id"].slice(t.first, len(t)), pa.array(shared.value.probability(statistics(t)))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, score double")


def trained(docs: DataFrame, labels: DataFrame) -> Discriminant:
    """A classifier from labelled rows whose crc32(doc_id) mod 5 is not 0."""
    return fit(docs, labels, remainder("doc_id", 5) != 0)
