"""Vectorised views of a batch of texts: bytes, words and 64-bit hashes without a Python loop per word.

The helpers run inside Arrow tasks. A text is seen as the UTF-8 bytes of the Arrow buffer; words
are byte ranges between separators. Whole texts are processed, in slices of a bounded number of
bytes (a single text larger than the bound is a slice of its own).
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20

ASCII_SPACE = np.zeros(256, bool)
ASCII_SPACE[[9, 10, 11, 12, 13, 32]] = True

#: A-Z to a-z; the ASCII white space to one blank.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
FOLD[ASCII_SPACE] = 32

GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, element-wise; ``x`` is not changed."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def weights(n: int) -> np.ndarray:
    """``n`` fixed pseudo-random odd 64-bit numbers."""
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * GOLDEN) | np.uint64(1)


class Texts:
    """Some texts of a batch: ``buf`` (uint8), ``off`` (int64, one more than texts), ``rows`` (their positions)."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, first: int):
        self.buf, self.off, self.first = buf, off, first

    def __len__(self) -> int:
        return len(self.off) - 1

    def text(self, i: int) -> str:
        return self.buf[self.off[i] : self.off[i + 1]].tobytes().decode("utf-8", "replace")


def slices(column: pa.Array, max_bytes: int = SLICE_BYTES) -> Iterator[Texts]:
    """A string column (null: empty) as slices of about ``max_bytes``."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    off = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + max_bytes, side="right")) - 1)
        hi = min(hi, len(column))
        yield Texts(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], lo)
        lo = hi
    trim()


def trim() -> None:
    """Gives freed memory back to the system: Python workers outlive their tasks and share an executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def words(t: Texts, separator: np.ndarray = ASCII_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) of every maximal run of non-separator bytes, and per text the index of its first word (one more than texts)."""
    n = len(t.buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(t) + 1, np.int64)
    inside = ~separator[t.buf]
    first = np.empty(n, bool)
    first[0] = inside[0]
    np.greater(inside[1:], inside[:-1], out=first[1:])
    last = np.empty(n, bool)
    last[-1] = inside[-1]
    np.greater(inside[:-1], inside[1:], out=last[:-1])
    cut = t.off[:-1][np.diff(t.off) > 0]  # a text ends its words
    first[cut] = inside[cut]
    cut = cut[1:] - 1
    last[cut] = inside[cut]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(start, t.off)


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range: a weighted byte sum with its own weight for each place, mixed."""
    if not len(start):
        return np.zeros(0, np.uint64)
    size = end - start
    out = np.empty(len(start), np.uint64)
    w = weights(int(size.max()))
    base = np.cumsum(size) - size
    place = np.arange(int(size.sum()), dtype=np.int64)
    place -= np.repeat(base, size)
    at = place + np.repeat(start, size)
    out = np.add.reduceat(w[place] * (buf[at].astype(np.uint64) + np.uint64(1)), base)
    return mix64(out + size.astype(np.uint64) * GOLDEN)


def distinct_words(t: Texts, start: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Distinct byte strings from each word's start to the next one's (trailing separators included), and each word's code."""
    ends = np.append(start, len(t.buf))
    array = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(t.buf))])
    coded = array.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)


def distinct_exact(buf: np.ndarray, start: np.ndarray, end: np.ndarray, separator: np.ndarray = ASCII_SPACE) -> tuple[pa.Array, np.ndarray]:
    """Distinct words, without separators, and each word's code; ``start`` and ``end`` as ``words`` gives them."""
    ends = np.concatenate([[0], np.cumsum(end - start)])
    array = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(buf[~separator[buf]])])
    coded = array.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)


def per_text(values: np.ndarray, bounds: np.ndarray, ufunc=np.add, empty=0) -> np.ndarray:
    """``ufunc.reduce`` of the values of each text; ``bounds`` has one more entry than texts."""
    n = len(bounds) - 1
    out = np.full(n, empty, dtype=values.dtype if ufunc is not np.add else np.result_type(values.dtype, np.int64) if values.dtype != np.float64 else np.float64)
    full = np.flatnonzero(bounds[1:] > bounds[:-1])
    if len(full):
        out[full] = ufunc.reduceat(values, bounds[full])
    return out
