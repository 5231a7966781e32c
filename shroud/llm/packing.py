"""Sum-of-squares packing of tokenised documents into sequences of a fixed window.

Each task packs the documents of its input split in their order, without a shuffle. Whole windows are
cut off a long document; the rest goes, online, into the fill level h that leaves the smallest sum of
squared counts of partially filled windows (a level array N[h]; ties: the fullest). When too many windows
are open, and at the end of a split, the emptiest windows are cut to fill the fullest ones, and the
last one is cut into parts whose lengths are powers of two, which need no padding.

Sequence ids are unique: the partition's number in the upper bits, a running number in the lower ones.
A retried task packs the same split the same way.

Edge cases: a null or empty text is the end mark alone; repeated rows are packed each; a null doc_id
stays null; a text of any length is tokenised whole; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shroud.llm.text import FOLD, Texts, distinct_exact, slices, word_hashes, words

WINDOW = 2048
END = 1  # the id after every document
OPEN = 4096  # windows a task keeps open at most; beyond, the emptiest half is cut to fill the others
SLICE = 4 << 20  # bytes of text encoded at a time
CACHE = 600_000  # words that a worker keeps the ids of

_workers: dict[str, "WordTokenizer"] = {}


class WordTokenizer:
    """Token ids of texts for a vocabulary that drops white space: every distinct word is encoded once.

    Encoded words are kept as arrays sorted by the words' 64-bit hashes; beyond ``CACHE`` words the
    less used half goes.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.keys = np.zeros(0, np.uint64)
        self.begin = self.size = self.used = np.zeros(0, np.int64)
        self.flat = np.zeros(0, "<u4")

    def _encode_words(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words one after another, and each word's number of ids."""
        flat, size = [np.zeros(0, "<u4")], np.zeros(len(tokens), np.int64)
        for lo in range(0, len(tokens), 20_000):
            found = self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in tokens[lo : lo + 20_000]], add_special_tokens=False)
            ids = [e.ids for e in found]
            size[lo : lo + len(ids)] = [len(x) for x in ids]
            flat.append(np.fromiter(chain.from_iterable(ids), "<u4"))
        return np.concatenate(flat), size

    def slots(self, tokens: pa.Array) -> np.ndarray:
        """Where the words are kept; new ones are encoded first."""
        if len(self.keys) > CACHE:
            self._shrink()
        off = np.frombuffer(tokens.buffers()[1], np.int64)[: len(tokens) + 1]
        key = word_hashes(np.frombuffer(tokens.buffers()[2], np.uint8), off[:-1], off[1:])
        at = np.searchsorted(self.keys, key)
        new = np.ones(len(key), bool)
        inside = at < len(self.keys)
        new[inside] = self.keys[at[inside]] != key[inside]
        if new.any():
            flat, size = self._encode_words(tokens.take(pa.array(np.flatnonzero(new))).to_pylist())
            keys = np.concatenate([self.keys, key[new]])
            order = np.argsort(keys, kind="stable")
            begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(size) - size])
            self.keys, self.begin = keys[order], begin[order]
            self.size = np.concatenate([self.size, size])[order]
            self.used = np.concatenate([self.used, np.zeros(len(size), np.int64)])[order]
            self.flat = np.concatenate([self.flat, flat])
            at = np.searchsorted(self.keys, key)
        self.used[at] += 1
        return at

    def _shrink(self) -> None:
        keep = np.sort(np.argsort(-self.used, kind="stable")[: CACHE // 2])
        size = self.size[keep]
        begin = np.cumsum(size) - size
        self.flat = self.flat[np.repeat(self.begin[keep] - begin, size) + np.arange(int(size.sum()))]
        self.keys, self.begin, self.size, self.used = self.keys[keep], begin, size, self.used[keep] // 2

    def encode(self, t: Texts) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each followed by END, and the texts' bounds."""
        start, end, first = words(t)
        if not len(start):
            return np.full(len(t), END, "<u4"), np.arange(len(t) + 1, dtype=np.int64)
        # the vocabulary is lower case, but the names of special tokens keep their case
        buf = t.buf if b"<|" in t.buf.tobytes() else FOLD[t.buf]
        tokens, index = distinct_exact(buf, start, end)
        slot = self.slots(tokens)[index]
        n = self.size[slot]
        bounds = np.concatenate([[0], np.cumsum(n)])
        doc = bounds[first] + np.arange(len(t) + 1)
        out = np.full(int(bounds[-1]) + len(t), END, "<u4")
        here = np.arange(bounds[-1])
        out[here + np.repeat(np.arange(len(t)), np.diff(bounds[first]))] = self.flat[here + np.repeat(self.begin[slot] - bounds[:-1], n)]
        return out, doc


def tokenizer(path: str) -> WordTokenizer:
    if path not in _workers:
        _workers[path] = WordTokenizer(path)
    return _workers[path]


class Packer:
    """Sum-of-squares packing; a piece is (document, its tokens, start, ids)."""

    def __init__(self, window: int = WINDOW, most_open: int = OPEN):
        self.window, self.most_open = window, most_open
        self.count = np.zeros(window + 1, np.int64)
        self.at: dict[int, list[list]] = {}
        self.open = 0
        self.done: list[list] = []  # finished sequences

    def add(self, doc, ids: np.ndarray) -> None:
        total, w = len(ids), self.window
        rest = total - total % w
        for s in range(0, rest, w):
            self.done.append([(doc, total, s, ids[s : s + w])])
        if rest < total:
            self._place((doc, total, rest, ids[rest:].copy()))
            if self.open > self.most_open:
                self._fill(self.most_open // 2)

    def level(self, size: int) -> int:
        """The level whose choice leaves the smallest sum of squares; 0 opens a window."""
        n, w = self.count, self.window
        change = np.full(w - size + 1, np.inf)
        here, there = n[: w - size + 1], n[size:]
        some = here > 0
        change[some] = 2.0 * (there[some] - here[some]) + 2
        if some[-1]:
            change[-1] = -2.0 * here[-1] + 1  # a full window is not counted
        change[0] = 2.0 * n[size] + 1
        return len(change) - 1 - int(np.argmin(change[::-1]))

    def _place(self, piece) -> None:
        size = len(piece[3])
        h = self.level(size)
        if h:
            sequence = self.at[h].pop()
            self.count[h] -= 1
            self.open -= 1
        else:
            sequence = []
        sequence.append(piece)
        self._put(sequence, h + size)

    def _put(self, sequence: list, fill: int) -> None:
        if fill == self.window:
            self.done.append(sequence)
        else:
            self.at.setdefault(fill, []).append(sequence)
            self.count[fill] += 1
            self.open += 1

    def _fill(self, keep: int) -> None:
        """Cuts the emptiest windows to fill the others, until at most ``keep`` (at least 1) partial ones are open."""
        ordered = [(h, s) for h in sorted(self.at, reverse=True) for s in self.at[h]]
        self.at, self.open = {}, 0
        self.count[:] = 0
        lo, hi = 0, len(ordered) - 1
        fills, sequences = [h for h, _ in ordered], [s for _, s in ordered]
        while lo < hi and hi - lo + 1 > max(keep, 1):
            doc, total, start, ids = sequences[hi][-1]
            gap = self.window - fills[lo]
            if len(ids) <= gap:
                sequences[hi].pop()
                sequences[lo].append((doc, total, start, ids))
                moved = len(ids)
            else:
                sequences[lo].append((doc, total, start + len(ids) - gap, ids[len(ids) - gap :]))
                sequences[hi][-1] = (doc, total, start, ids[: len(ids) - gap])
                moved = gap
            fills[lo] += moved
            fills[hi] -= moved
            if fills[lo] == self.window:
                self.done.append(sequences[lo])
                lo += 1
            if not fills[hi]:
                hi -= 1
        for i in range(lo, hi + 1):
            if fills[i]:
                self._put(sequences[i], fills[i])

    def finish(self) -> None:
        """Closes every window; the last one becomes sequences with powers of two as lengths."""
        self._fill(1)
        for sequence in [s for h in self.at.values() for s in h]:
            left = sum(len(p[3]) for p in sequence)
            pieces = list(sequence)
            while left:
                size = 1 << (left.bit_length() - 1)
                part, room = [], size
                while room:
                    doc, total, start, ids = pieces[0]
                    part.append((doc, total, start, ids[:room]))
                    if len(ids) <= room:
                        pieces.pop(0)
                    else:
                        pieces[0] = (doc, total, start + room, ids[room:])
                    room -= len(part[-1][3])
                self.done.append(part)
                left -= size
        self.at, self.open = {}, 0
        self.count[:] = 0


SCHEMA = "doc_id bigint, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"


def pack(docs: DataFrame, vocabulary: str, window: int = WINDOW) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text): doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian 32-bit)."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = tokenizer(vocabulary), Packer(window)
        number = TaskContext.get().partitionId() << 32

        def out():
            nonlocal number
            rows = []
            for sequence in packer.done:
                offset = 0
                for doc, total, start, ids in sequence:
                    rows.append((doc, start, len(ids), total, number, offset, ids.tobytes()))
                    offset += len(ids)
                number += 1
            packer.done = []
            columns = list(zip(*rows)) or [()] * 7
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:6]), pa.array(columns[6], pa.binary())], names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

        for batch in batches:
            doc = batch["doc_id"].to_pylist()
            for t in slices(batch["text"], SLICE):
                ids, bounds = encoder.encode(t)
                for i in range(len(t)):
                    packer.add(doc[t.first + i], ids[bounds[i] : bounds[i + 1]])
                if packer.done:
                    yield out()
        packer.finish()
        if packer.done:
            yield out()

    return docs.mapInArrow(run, SCHEMA)
