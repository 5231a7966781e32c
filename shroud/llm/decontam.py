"""Benchmark decontamination: CGK embeddings with repeated sampling, then exact edit distance.

A text is its sequence of words: compatibility forms and case are folded (NFKD, full case folding), words end at every
character that is no letter, digit or mark, and in scripts without blanks (Han, kana, Thai, Lao, Khmer, Burmese) every
character is a word. A document is contaminated by an item if some run of its
words is within ``max_edit`` (a share of the item's words) word edits of the whole item.

The CGK random walk reads a window of words with a pointer that at step j stays or advances by a
random bit of (j, word), and writes the word it sees: two windows within few edits write strings within
few Hamming positions, as the walks fall into step again after an edit. Sampling ``SYMBOLS`` positions
of the written string, ``REPEATS`` times, gives the keys. Windows have the size class of the item (a
power of two, at most two thirds of its words and at most ``LARGEST``: longer walks seldom agree after a fifth of edits, and a
long copy holds many short windows), at every offset on the item's side and at every half
window on the document's side (every offset for windows of at most ``SHORT`` words), so every copy holds an
aligned window, most copies several. Items just above the border of a size class have windows of the class below too.

The items' keys are broadcast in blocks of at most ``BLOCK_WORDS`` words (a proven bound); more items
mean more blocks, each over all documents. A longer window goes on to the embedding only if enough of its
word pairs occur in the block's items, which spares clean text the walk. Candidates are verified by
the semi-global edit distance in the task that holds the text; nothing is shuffled.

Edge cases: items or texts without words (null, empty, signs only) match nothing; of equal (doc, item)
pairs the fewest edits, then the first place, is returned; repeated rows are searched each; a null id
stays null; items with equal ids are searched each; empty tables give an empty result; extra columns
are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shroud.llm.common import judged
from shroud.llm.text import FOLD, Texts, mix64, slices, word_hashes, words

MAX_EDIT = 0.2
REPEATS, SYMBOLS = 24, 4
STEPS = 2  # steps of the walk for each word of the window
KNOWN = 0.35  # share of a window's word pairs that must occur in the items; a fifth of edits leaves about 0.6
SHORT = 4  # windows of so few words are read at every offset and without the pair filter: an edit leaves few pairs
BLOCK_WORDS = 200_000
BITMAP = 22

LARGEST = 16  # words of a window; with 32, recall at a fifth of deletions falls to 0.7 at 55 words

#: Everything ASCII that is neither a letter nor a digit separates words.
SEPARATOR = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
#: FIXED VALUES: code points of scripts that are written without blanks.
UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x2E80, 0x2FDF), (0x3005, 0x3007), (0x3021, 0x3029), (0x3040, 0x30FF), (0x31F0, 0x31FF),
            (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x1B000, 0x1B16F), (0x20000, 0x3FFFF))
#: FIXED VALUES: a format character that ends a word; the others are ignored.
ZERO_WIDTH_SPACE = "\u200b"


@lru_cache(maxsize=50_000)
def folded(c: str) -> tuple[str, str]:
    """The character's folded form and its part: "word", "unit" (a word of its own), "end" or "" (ignored)."""
    form = unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", c).casefold())
    kinds = {unicodedata.category(x)[0] for x in form}
    if c == ZERO_WIDTH_SPACE or not kinds & {"L", "N", "M"}:
        return "", "" if unicodedata.category(c) == "Cf" and c != ZERO_WIDTH_SPACE else "end"
    form = "".join(x for x in form if unicodedata.category(x)[0] in "LNM")
    return form, "unit" if any(lo <= ord(form[0]) <= hi for lo, hi in UNSPACED) else "word"


def unicode_words(raw: bytes) -> list[tuple[str, int, int]]:
    """(folded word, start, end) of the words in a stretch without ASCII separators; places count bytes."""
    out: list[tuple[str, int, int]] = []
    open_, at = False, 0
    for c in raw.decode("utf-8", "replace"):
        size = len(c.encode("utf-8", "replace")) if c != "\ufffd" or raw[at : at + 3] == b"\xef\xbf\xbd" else 1
        form, part = folded(c)
        if part == "word" and open_:
            out[-1] = (out[-1][0] + form, out[-1][1], at + size)
        elif part in ("word", "unit"):
            out.append((form, at, at + size))
        if part:
            open_ = part == "word"
        at += size
    return out


def word_sequence(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end byte of every word, and the index of each text's first word."""
    start, end, first = words(t, SEPARATOR)
    if not len(start):
        return np.zeros(0, np.uint64), start, end, first
    high = np.concatenate([[0], np.cumsum(t.buf >= 128, dtype=np.int64)])
    wide = np.flatnonzero(high[end] > high[start])
    if not len(wide):
        return word_hashes(FOLD[t.buf], start, end), start, end, first
    # stretches with other characters: each distinct one is taken apart once
    size = (end - start)[wide]
    ends = np.cumsum(size)
    data = t.buf[np.repeat(start[wide] - ends + size, size) + np.arange(ends[-1])]
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(wide), [None, pa.py_buffer(np.concatenate([[0], ends])), pa.py_buffer(data)]).dictionary_encode()
    found = [unicode_words(x) for x in coded.dictionary.to_pylist()]
    code = coded.indices.to_numpy(zero_copy_only=False)
    parts = np.array([len(x) for x in found], np.int64)
    forms = [np.frombuffer(w.encode("utf-32-le", "surrogatepass"), "<u4") for x in found for w, _, _ in x]
    length = np.array([len(f) for f in forms], np.int64)
    stop = np.cumsum(length)
    hashes = word_hashes(np.concatenate(forms) if forms else np.zeros(0, "<u4"), stop - length, stop)
    places = np.array([(a, b) for x in found for _, a, b in x], np.int64).reshape(-1, 2)
    base = (np.cumsum(parts) - parts)[code]
    count = np.ones(len(start), np.int64)
    count[wide] = parts[code]
    bounds = np.concatenate([[0], np.cumsum(count)])
    h, lo, hi = np.empty(bounds[-1], np.uint64), np.empty(bounds[-1], np.int64), np.empty(bounds[-1], np.int64)
    plain = np.ones(len(start), bool)
    plain[wide] = False
    at = bounds[:-1][plain]
    h[at], lo[at], hi[at] = word_hashes(FOLD[t.buf], start[plain], end[plain]), start[plain], end[plain]
    n = parts[code]
    inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    at, of = np.repeat(bounds[wide], n) + inside, np.repeat(base, n) + inside
    h[at] = hashes[of]
    lo[at], hi[at] = (places[of] + np.repeat(start[wide], n)[:, None]).T
    return h, lo, hi, bounds[first]


def size_class(n: int) -> int:
    """The largest power of two w, LARGEST at most, with w + w // 2 - 1 <= n: a run of n words holds an aligned window."""
    w = 1
    while 2 * w + w - 1 <= n and w < LARGEST:
        w *= 2
    return w


def size_classes(n: int) -> list[int]:
    """The window sizes of an item: just above a border a run of n words holds few aligned windows, and smaller ones are keyed too."""
    w = size_class(n)
    return [w, w // 2] if w > SHORT and n < w + w // 2 - 1 + w // 4 else [w]


def samples(w: int) -> np.ndarray:
    """The sampled positions of the written string, (REPEATS, SYMBOLS), ascending: one from each quarter of it."""
    rng = np.random.default_rng(7919 * w)
    quarter = max(STEPS * w // SYMBOLS, 1)
    return np.stack([np.arange(SYMBOLS) * quarter + rng.integers(0, quarter, SYMBOLS) for _ in range(REPEATS)])


def window_keys(h: np.ndarray, begin: np.ndarray, w: int) -> np.ndarray:
    """The keys (REPEATS, windows) of the windows of ``w`` words that begin at ``begin``."""
    out = np.empty((REPEATS, len(begin)), np.uint64)
    for r, places in enumerate(samples(w)):
        at = np.zeros(len(begin), np.int64)
        key = np.full(len(begin), r * 64 + w, np.uint64)
        for j in range(int(places[-1]) + 1):
            seen = np.where(at < w, h[begin + np.minimum(at, w - 1)], np.uint64(0))
            if j in places:
                key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + seen)
            at += (mix64(seen ^ np.uint64((r << 20 | j) * 0x9E37 + 1)) & np.uint64(1)).astype(np.int64)
        out[r] = key
    return out


def pairs(h: np.ndarray) -> np.ndarray:
    """The place in the bitmap of each word with its next one."""
    return (mix64(h * np.uint64(0xD1342543DE82EF95) + np.append(h[1:], np.zeros(1, np.uint64))) & np.uint64((1 << BITMAP) - 1)).astype(np.int32)


def distance(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """The fewest edits between ``item`` and a run of ``text``, and where the first such run ends."""
    n = len(text)
    ramp = np.arange(n + 1)
    row = np.zeros(n + 1, np.int64)
    for i, x in enumerate(item):
        new = np.empty(n + 1, np.int64)
        new[0] = i + 1
        np.minimum(row[1:] + 1, row[:-1] + (text != x), out=new[1:])
        row = np.minimum.accumulate(new - ramp) + ramp
    end = int(row.argmin())
    return int(row[end]), end


class Items:
    """A block of benchmark items as sorted key arrays."""

    def __init__(self, rows: list[tuple], max_edit: float):
        self.max_edit = max_edit
        self.ids = [r[0] for r in rows]
        self.words: list[np.ndarray] = []
        for t in slices(pa.array([r[1] for r in rows], pa.string())):
            h, _, _, first = word_sequence(t)
            self.words += [h[first[i] : first[i + 1]] for i in range(len(t))]
        self.bitmap = np.zeros(1 << BITMAP, bool)
        self.tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        found: dict[int, list] = {}
        for i, h in enumerate(self.words):
            if len(h):
                self.bitmap[pairs(h)[:-1]] = True
                for w in size_classes(len(h)):
                    begin = np.arange(len(h) - w + 1)
                    keys = window_keys(h, begin, w)
                    found.setdefault(w, []).append((keys.ravel(), np.full(keys.size, i), np.tile(begin, REPEATS)))
        for w, parts in found.items():
            key, item, offset = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(key, kind="stable")
            self.tables[w] = key[order], item[order], offset[order]

    def candidates(self, h: np.ndarray, first: np.ndarray) -> set[tuple[int, int, int]]:
        """(text, item, first word of the item's place, counted from the batch's first word)."""
        known = np.concatenate([[0], np.cumsum(self.bitmap[pairs(h)], dtype=np.int32)])
        out: set[tuple[int, int, int]] = set()
        for w, (keys, item, offset) in self.tables.items():
            step = 1 if w <= SHORT else w // 2
            n = np.maximum(np.diff(first) - w, -1) // step + 1
            n = np.where(np.diff(first) >= w, n, 0)
            doc = np.repeat(np.arange(len(n)), n)
            begin = first[doc] + step * (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n))
            some = known[begin + w - 1] - known[begin] >= (0 if w <= SHORT else KNOWN * (w - 1))
            doc, begin = doc[some], begin[some]
            for lo in range(0, len(begin), 50_000):
                d, b = doc[lo : lo + 50_000], begin[lo : lo + 50_000]
                code = window_keys(h, b, w)
                left, right = np.searchsorted(keys, code, "left"), np.searchsorted(keys, code, "right")
                for r, c in zip(*np.nonzero(right > left)):
                    for e in range(left[r, c], right[r, c]):
                        out.add((int(d[c]), int(item[e]), int(b[c] - offset[e])))
        return out

    def search(self, t: Texts) -> list[tuple[int, int, int, int, int, int]]:
        """(text, item, edits, first word, byte start, byte end) of the best place of every item in every text."""
        h, start, end, first = word_sequence(t)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        tried: set[tuple[int, int, int]] = set()
        for doc, i, place in sorted(self.candidates(h, first)):
            item = self.words[i]
            most = int(self.max_edit * len(item))
            if (doc, i) in best and best[doc, i][0] == 0:
                continue
            near = place // (most + 1)
            if (doc, i, near) in tried:
                continue
            tried.add((doc, i, near))
            lo = max(int(first[doc]), place - 2 * most - 1)
            hi = min(int(first[doc + 1]), place + len(item) + 2 * most + 1)
            e, stop = distance(item, h[lo:hi])
            if e <= most and (e < best.get((doc, i), (most + 1,))[0]):
                back, size = distance(item[::-1], h[lo : lo + stop][::-1])
                best[doc, i] = (e, lo + stop - size, lo + stop)
        return [(doc, i, e, a - int(first[doc]), int(start[a] - t.off[doc]), int(end[b - 1] - t.off[doc])) for (doc, i), (e, a, b) in best.items() if b > a]


def blocks(benchmark: DataFrame, max_edit: float = MAX_EDIT) -> Iterator[Items]:
    """The items (item_id, text) in blocks of at most BLOCK_WORDS words (an item longer than that is a block)."""
    rows, size = [], 0
    ordered = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    for r in ordered.orderBy("item_id", "text").toLocalIterator():  # a block at a time on the driver
        n = len(re.findall("[A-Za-z0-9]+", r["text"])) if r["text"].isascii() else len(r["text"])
        if rows and size + n > BLOCK_WORDS:
            yield Items(rows, max_edit)
            rows, size = [], 0
        rows.append((r["item_id"], r["text"]))
        size += n
    if rows:
        yield Items(rows, max_edit)


SCHEMA = "doc_id bigint, item_id bigint, edits int, item_words int, start_char bigint, end_char bigint"


def matches(docs: DataFrame, benchmark: DataFrame, max_edit: float = MAX_EDIT) -> DataFrame:
    """(doc_id, item_id, edits, item_words, start_char, end_char): a row per contaminated document and item."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for items in blocks(benchmark, max_edit):
        shared = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block = shared.value
            for b in batches:
                for t in slices(b["text"]):
                    rows = []
                    ids = b["doc_id"].slice(t.first, len(t)).to_pylist()
                    for doc, i, e, _, lo, hi in sorted(block.search(t)):
                        text = t.buf[t.off[doc] : t.off[doc] + hi].tobytes()
                        begin = len(text[:lo].decode("utf-8", "replace"))
                        rows.append((ids[doc], block.ids[i], e, len(block.words[i]), begin, begin + len(text[lo:].decode("utf-8", "replace"))))
                    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 6, kinds)], names=["doc_id", "item_id", "edits", "item_words", "start_char", "end_char"])

        part = docs.mapInArrow(run, SCHEMA)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], SCHEMA)


def clean(docs: DataFrame, benchmark: DataFrame, max_edit: float = MAX_EDIT) -> DataFrame:
    """The rows of ``docs`` without a contaminated text, all columns."""
    for items in blocks(benchmark, max_edit):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def free(t: Texts, shared=shared) -> np.ndarray:
            keep = np.ones(len(t), bool)
            keep[[x[0] for x in shared.value.search(t)]] = False
            return keep

        docs = judged(docs, lambda free=free: free)
    return docs
