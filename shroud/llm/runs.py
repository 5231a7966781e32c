"""Periodic runs of words by internal pattern matching.

A run is a stretch of words with smallest period q, of at least 2q (and ``least``) words, that no neighbouring word
extends. Periods below ``DIRECT`` are found by comparing each word with the q-th next one. For the others,
let 2^(k+1) - 1 <= q <= 2^(k+2) - 2: the first block of 2^k words at a multiple of 2^k inside the run stands again
q words later, wholly inside the run. So every dyadic block asks for its occurrences in the windows that begin
2^(k+1) - 1 and 3 * 2^k - 1 words after it and hold 2^k places each. The occurrences are an interval of the suffix
array, and a range successor on a wavelet tree over that interval gives them in text order. One or two give one
candidate period each. Three or more are an arithmetic progression whose difference is the block's own
period; the ends of the two stretches with that period then give the candidates, and only where these stretches
meet is each term of the progression one. A candidate is extended both ways by the ranks of the prefix
doubling, and stays if its run is long enough.

All documents of a slice are searched together, in arrays: a word's code holds its document, so no repetition
crosses documents. Only words whose next ``2^SMALL`` words occur again in the document enter the tree.

Edge cases: a null or empty text has no words and no runs; texts of any length are searched whole; repeated rows
are searched each; a null doc_id stays null; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shroud.llm.text import Texts, distinct_exact, slices, words

SMALL = 2  # the smallest blocks have 2^SMALL words
DIRECT = 2 ** (SMALL + 1) - 1  # periods below are compared directly
SLICE = 2 << 20  # bytes of text searched together

SCHEMA = "doc_id bigint, n_runs bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"


def dense(code: np.ndarray) -> np.ndarray:
    """Ranks of the codes: equal codes get the number of smaller ones."""
    order = np.argsort(code, kind="stable")
    sorted_ = code[order]
    head = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
    rank = np.empty(len(code), np.int64)
    rank[order] = np.repeat(head, np.diff(np.append(head, len(code))))
    return rank


class Suffixes:
    """Suffix array of words by prefix doubling; ``rank[k][i]`` is the first place of the suffixes that share 2^k words with i."""

    def __init__(self, code: np.ndarray, doc: np.ndarray, bounds: np.ndarray):
        self.n, self.doc, self.bounds = len(code), doc, bounds
        last = bounds[doc + 1]  # where each word's document ends
        rank = dense(code + doc * (int(code.max()) + 1)) if self.n else code
        self.rank = [rank]
        shared = np.flatnonzero(np.bincount(rank, minlength=self.n)[rank] > 1)
        h = 1
        while len(shared):  # only places whose rank is shared are sorted again
            after = shared + h
            next_ = np.where(after < last[shared], rank[np.minimum(after, self.n - 1)] + 1, 0)
            order = np.lexsort((next_, rank[shared]))
            i, r, x = shared[order], rank[shared][order], next_[order]
            group = np.concatenate([[True], r[1:] != r[:-1]])
            head = group | np.concatenate([[True], x[1:] != x[:-1]])
            first = np.maximum.accumulate(np.where(group, np.arange(len(i)), 0))
            at = np.maximum.accumulate(np.where(head, np.arange(len(i)), 0))
            rank = rank.copy()
            rank[i] = r + at - first
            self.rank.append(rank)
            sizes = np.diff(np.append(np.flatnonzero(head), len(i)))
            shared = np.sort(i[np.repeat(sizes, sizes) > 1])
            h *= 2
        self.first, self.last = bounds[doc], last

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i on equal those from j on (i < j, one document)."""
        i, j = i.copy(), j.copy()
        begin = i.copy()
        for k in range(len(self.rank) - 1, -1, -1):
            fits = j + (1 << k) <= self.last[np.minimum(j, self.n - 1)]
            fits &= (j < self.n)
            fits[fits] = self.rank[k][i[fits]] == self.rank[k][j[fits]]
            i += fits * (1 << k)
            j += fits * (1 << k)
            j = np.minimum(j, self.n)
        return i - begin

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words before i equal those before j (i < j, one document)."""
        i, j = i.copy(), j.copy()
        begin, first = i.copy(), self.first[i]
        for k in range(len(self.rank) - 1, -1, -1):
            a, b = i - (1 << k), j - (1 << k)
            fits = a >= first
            fits[fits] = self.rank[k][a[fits]] == self.rank[k][b[fits]]
            i, j = np.where(fits, a, i), np.where(fits, b, j)
        return begin - i


class WaveletTree:
    """Levels of bits over ``values``: counts and order statistics of any stretch, for many stretches at once."""

    def __init__(self, values: np.ndarray):
        self.n = len(values)
        self.depth = max(1, int(values.max()).bit_length()) if self.n else 1
        self.words, self.before, self.zeros = [], [], []
        for k in range(self.depth - 1, -1, -1):
            bit = ((values >> k) & 1).astype(np.uint8)
            packed = np.packbits(np.pad(bit, (0, -len(bit) % 64 + 64)), bitorder="little").view("<u8")
            self.words.append(packed)
            self.before.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed).astype(np.int64))]))
            self.zeros.append(len(bit) - int(bit.sum()))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def _ones(self, level: int, i: np.ndarray) -> np.ndarray:
        below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[level][i >> 6] + np.bitwise_count(self.words[level][i >> 6] & below)

    def smaller(self, lo: np.ndarray, hi: np.ndarray, than: np.ndarray) -> np.ndarray:
        """How many of ``values[lo:hi]`` are below ``than``."""
        count = np.where(than >> self.depth > 0, hi - lo, 0)
        live = than >> self.depth == 0
        for level in range(self.depth):
            one = (than >> (self.depth - 1 - level)) & 1
            a, b = self._ones(level, lo), self._ones(level, hi)
            count += np.where(live & (one == 1), (hi - b) - (lo - a), 0)
            lo, hi = np.where(one == 1, self.zeros[level] + a, lo - a), np.where(one == 1, self.zeros[level] + b, hi - b)
        return count

    def kth(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest (from 0) of ``values[lo:hi]``; k must lie inside."""
        found = np.zeros(len(lo), np.int64)
        for level in range(self.depth):
            a, b = self._ones(level, lo), self._ones(level, hi)
            zeros = (hi - b) - (lo - a)
            one = k >= zeros
            found |= one.astype(np.int64) << (self.depth - 1 - level)
            k = np.where(one, k - zeros, k)
            lo, hi = np.where(one, self.zeros[level] + a, lo - a), np.where(one, self.zeros[level] + b, hi - b)
        return found


def _direct(code: np.ndarray, bounds: np.ndarray, least: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(start, end, period) of the runs whose period is below DIRECT (multiples of it too)."""
    found = []
    n = len(code)
    for q in range(1, min(DIRECT, n)):
        same = code[:-q] == code[q:]
        for e in range(q):  # the last q words of a document have no partner in it
            cut = bounds[1:-1] - 1 - e
            same[cut[(cut >= 0) & (cut < len(same))]] = False
        edge = np.diff(np.concatenate([[False], same, [False]]).astype(np.int8))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + q
        keep = end - start >= max(least, 2 * q)
        found.append((start[keep], end[keep], np.full(int(keep.sum()), q)))
    return found


def _candidates(s: Suffixes) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) of all candidates with periods of DIRECT words and more."""
    places, periods = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if len(s.rank) <= SMALL:
        return places[0], periods[0]
    group = np.bincount(s.rank[SMALL], minlength=s.n)
    inside = group[s.rank[SMALL]] > 1
    if not inside.any():
        return places[0], periods[0]
    array = np.empty(s.n, np.int64)
    array[s.rank[-1]] = np.arange(s.n)  # the suffix array
    enters = inside[array]
    tree = WaveletTree(array[enters])
    place = np.concatenate([[0], np.cumsum(enters)])
    for k in range(SMALL, len(s.rank)):
        size = 1 << k
        rank, members = s.rank[k], np.bincount(s.rank[k], minlength=s.n)
        # blocks start at multiples of their size, counted from the start of the document
        block = np.flatnonzero(inside)
        block = block[(block - s.first[block]) % size == 0]
        block = block[(members[rank[block]] > 1) & (block + size <= s.last[block])]
        lo, hi = place[rank[block]], place[rank[block] + members[rank[block]]]
        for begin in (2 * size - 1, 3 * size - 1):
            first = block + begin
            low, high = tree.smaller(lo, hi, first), tree.smaller(lo, hi, first + size)
            n = high - low
            some = np.flatnonzero(n > 0)
            if not len(some):
                continue
            a, b = lo[some], hi[some]
            one = tree.kth(a, b, low[some])
            few = n[some] <= 2
            places.append(block[some][few])
            periods.append((one - block[some])[few])
            two = np.flatnonzero(n[some] >= 2)
            second = tree.kth(a[two], b[two], low[some][two] + 1)
            pair = n[some][two] == 2
            places.append(block[some][two][pair])
            periods.append((second - block[some][two])[pair])
            many = two[~pair]
            if not len(many):
                continue
            at, copy, step, terms = block[some][many], one[many], second[~pair] - one[many], n[some][many]
            left, right = at - s.backward(at, at + step), at + step + s.forward(at, at + step)
            left2, right2 = copy - s.backward(copy, copy + step), copy + step + s.forward(copy, copy + step)
            apart = left != left2
            for q in (left2 - left, right2 - right):
                places.append(at[apart & (q > 0)])
                periods.append(q[apart & (q > 0)])
            meet = apart & (right >= left2)
            terms, base = terms[meet], (copy - at)[meet]
            number = np.arange(int(terms.sum())) - np.repeat(np.cumsum(terms) - terms, terms)
            places.append(np.repeat(at[meet], terms))
            periods.append(np.repeat(base, terms) + number * np.repeat(step[meet], terms))
    return np.concatenate(places), np.concatenate(periods)


def find(code: np.ndarray, bounds: np.ndarray, least: int = 12) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs in the words ``code`` of the documents ``bounds``, by start, then period."""
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    found = _direct(code, bounds, least)
    if len(code) > DIRECT:
        s = Suffixes(code, doc, bounds)
        at, q = _candidates(s)
        ok = at + q < s.last[at] if len(at) else np.zeros(0, bool)
        at, q = at[ok], q[ok]
        start, end = at - s.backward(at, at + q), at + q + s.forward(at, at + q)
        keep = end - start >= np.maximum(least, 2 * q)
        found.append((start[keep], end[keep], q[keep]))
    start, end, period = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
    order = np.lexsort((period, end, start))  # the smallest period of a stretch counts
    start, end, period = start[order], end[order], period[order]
    keep = np.ones(len(start), bool)
    keep[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[keep], end[keep], period[keep]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def collapsed(t: Texts, start: np.ndarray, end: np.ndarray, bounds: np.ndarray, kept: np.ndarray) -> list[str]:
    """The kept words of each text, joined by one blank; (start, end, bounds) are the words of the slice."""
    size = (end - start)[kept] + 1
    stop = np.cumsum(size)
    out = np.full(int(stop[-1]) if len(stop) else 0, 32, np.uint8)
    inside = np.arange(len(out)) - np.repeat(stop - size, size)
    letter = inside < np.repeat(size - 1, size)
    out[letter] = t.buf[(np.repeat(start[kept], size) + inside)[letter]]
    count = np.concatenate([[0], np.cumsum(kept)])[bounds]
    at = np.concatenate([[0], stop])[count].tolist()
    raw = out.tobytes()
    return [raw[a : max(a, b - 1)].decode("utf-8", "replace") for a, b in zip(at, at[1:])]


def _of_slice(t: Texts, least: int):
    start, end, bounds = words(t)
    if not len(start):
        none = np.zeros(0, np.int64)
        return none, none, none, none, [""] * len(t)
    code = distinct_exact(t.buf, start, end)[1].astype(np.int64)
    s, e, q = find(code, bounds, least)
    doc = np.searchsorted(bounds, s, side="right") - 1
    cover = np.zeros(len(code) + 1, np.int64)
    np.add.at(cover, s + q, 1)
    np.add.at(cover, e, -1)
    kept = np.cumsum(cover[:-1]) == 0
    return doc, s - bounds[doc], e - s, q, collapsed(t, start, end, bounds, kept)


def periodic(docs: DataFrame, least: int = 12) -> DataFrame:
    """Runs of at least ``least`` words in ``docs`` (doc_id, text): doc_id, n_runs, runs (by start, then period),
    collapsed: the text's words but those a run repeats after its first period, joined by one blank."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in slices(batch["text"], SLICE):
                doc, start, length, period, kept = _of_slice(t, least)
                n = np.bincount(doc, minlength=len(t))
                struct = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], names=["start", "length", "period"])
                listed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), struct)
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(t.first, len(t)), pa.array(n, pa.int64()), listed, pa.array(kept, pa.string())], names=["doc_id", "n_runs", "runs", "collapsed"])

    return docs.mapInArrow(run, SCHEMA)
