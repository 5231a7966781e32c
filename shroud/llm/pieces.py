"""SentencePiece byte-pair encoding and decoding by vectorised merge rounds.

A task sees each distinct word of its rows once. All new words of a slice are merged together: their symbols
lie in one flat array; a round takes every word's smallest pair rank (a segmented minimum), merges that pair
at its leftmost non-overlapping places in all words at once, drops the consumed symbols and looks up the
ranks of the pairs that changed, until no word has a pair of the vocabulary left. Words end where no piece
can reach across, which is read off the vocabulary: two neighbouring characters that no piece holds side by
side are never merged.

The rounds equal the library's queue (best score first, then leftmost) unless a merge makes a pair at least
as good as the one being merged while more of those wait in the word. Such words (runs of blanks, whose
pieces have the last rank) are noticed and merged in queue order instead, as are words of over ``LONG`` symbols,
whose rounds would be many; the ids are the same either way.

Models: BPE with the identity normaliser; others are refused with a ValueError.

Edge cases: a null or empty text has the end id alone and decodes to the empty text; texts of any length are
encoded whole; repeated rows are encoded each; a null doc_id stays null; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import codecs
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shroud.llm.text import Texts, distinct_words, slices

SPACE = "▁"  # stands for a blank in the pieces
LONG = 512  # symbols of a word; beyond, the merges run in queue order
CACHE = 400_000  # distinct words that a worker keeps the ids of
NONE = np.int64(1) << 40  # the rank of a pair that is no piece

_workers: dict[str, "Pieces"] = {}


def _gather(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``flat[begin[i] : begin[i] + size[i]]`` for all i, one after another."""
    ends = np.cumsum(size)
    return flat[np.repeat(begin - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0)]


def _per_byte(error: UnicodeError) -> tuple[str, int]:
    return "�", error.start + 1


codecs.register_error("shroud-per-byte", _per_byte)


class Pieces:
    """The tables of a model and the words already encoded."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        kinds = model.SentencePiece
        text, spec = [p.piece for p in model.pieces], model.normalizer_spec
        if (model.trainer_spec.model_type != model.trainer_spec.BPE or spec.precompiled_charsmap or spec.remove_extra_whitespaces
                or not spec.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix
                or {p.type for p in model.pieces} - {kinds.NORMAL, kinds.BYTE, kinds.CONTROL, kinds.UNKNOWN}):
            raise ValueError(f"{path}: not a BPE model with the identity normaliser")
        self.end, self.unknown, self.prefix = model.trainer_spec.eos_id, model.trainer_spec.unk_id, spec.add_dummy_prefix
        normal = {t: i for i, t in enumerate(text) if model.pieces[i].type == kinds.NORMAL}
        letters = sorted({c for t in normal for c in t})
        self.alphabet = np.array([ord(c) for c in letters], np.int64)
        #: symbols: the pieces, then the characters that stand in pieces without being one
        symbol = normal | {c: len(text) + i for i, c in enumerate(letters) if c not in normal}
        self.symbols = len(text) + len(letters)
        self.letter = np.array([symbol[c] for c in letters], np.int64)
        score = np.array([p.score for p in model.pieces])
        rank = np.unique(-score, return_inverse=True)[1]
        pairs = sorted((symbol[t[:k]] * self.symbols + symbol[t[k:]], i) for t, i in normal.items() for k in range(1, len(t)) if t[:k] in symbol and t[k:] in symbol)
        self.pair = np.array([p for p, _ in pairs], np.int64)
        self.made = np.array([i for _, i in pairs], np.int64)
        self.rank = rank[self.made].astype(np.int64)
        place = {c: i for i, c in enumerate(letters)}
        self.beside = np.array(sorted({place[a] * len(letters) + place[b] for t in normal for a, b in zip(t, t[1:])}), np.int64)
        self.split_words = not any(a != SPACE and b == SPACE for t in normal for a, b in zip(t, t[1:]))
        bytes_ = {int(text[i][3:5], 16): i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        self.byte = np.array([bytes_.get(b, self.unknown) for b in range(256)], np.int64)
        self.fallback = len(bytes_) == 256
        surface = [b"" if p.type == kinds.CONTROL else model.trainer_spec.unk_surface.encode() if p.type == kinds.UNKNOWN
                   else bytes([int(p.piece[3:5], 16)]) if p.type == kinds.BYTE else p.piece.replace(SPACE, " ").encode() for p in model.pieces]
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.surface_size = np.array([len(s) for s in surface], np.int64)
        self.surface_begin = np.cumsum(self.surface_size) - self.surface_size
        #: pieces whose blank is the dummy prefix when they come first
        self.leads = np.array([self.prefix and p.type == kinds.NORMAL and p.piece.startswith(SPACE) for p in model.pieces])
        self._forget()

    def _forget(self) -> None:
        self.slot: dict[bytes, int] = {}
        self.begin = self.size = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)

    # ------------------------------------------------------------------ merging

    def _look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, piece) of each pair of symbols; NONE where it is no piece."""
        key = np.where((left >= 0) & (right >= 0), left * self.symbols + right, -1)
        at = np.searchsorted(self.pair, key)
        at[at == len(self.pair)] = 0
        found = self.pair[at] == key
        return np.where(found, self.rank[at], NONE), np.where(found, self.made[at], -1)

    def _rounds(self, symbol: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Merges all words at once; (symbols, word of each symbol, words that need the queue's order)."""
        size = np.diff(np.append(start, len(symbol)))
        word = np.repeat(np.arange(len(start)), size)
        rank, made = np.full(len(symbol), NONE), np.full(len(symbol), -1)
        inner = np.flatnonzero(word[1:] == word[:-1])
        rank[inner], made[inner] = self._look(symbol[inner], symbol[inner + 1])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        queued: list[np.ndarray] = []
        while len(symbol):
            least = np.minimum.reduceat(rank, start)
            size = np.diff(np.append(start, len(symbol)))
            live = least < NONE
            if not live.all():  # compaction: finished words leave
                stay = np.repeat(live, size)
                done.append((word[~stay], symbol[~stay]))
                symbol, word, rank, made = symbol[stay], word[stay], rank[stay], made[stay]
                least, size = least[live], size[live]
                start = np.cumsum(size) - size
                if not len(symbol):
                    break
            limit = np.repeat(least, size)
            hit = rank == limit
            first = hit.copy()
            first[1:] &= ~hit[:-1]
            begun = np.maximum.accumulate(np.where(first, np.arange(len(hit)), 0))
            hit &= (np.arange(len(hit)) - begun) % 2 == 0  # leftmost of overlapping places
            merges = np.add.reduceat(hit.astype(np.int64), start)
            symbol = np.where(hit, made, symbol)
            stay = np.ones(len(hit), bool)
            stay[1:] = ~hit[:-1]
            symbol, word, rank, made, limit, new = symbol[stay], word[stay], rank[stay], made[stay], limit[stay], hit[stay]
            size = size - merges
            start = np.cumsum(size) - size
            change = new.copy()
            change[:-1] |= new[1:]
            change = np.flatnonzero(change)
            after = np.minimum(change + 1, len(word) - 1)
            inside = (change + 1 < len(word)) & (word[after] == word[change])
            r, m = self._look(symbol[change], symbol[after])
            rank[change], made[change] = np.where(inside, r, NONE), np.where(inside, m, -1)
            unsure = np.zeros(len(word), bool)
            unsure[change] = rank[change] <= limit[change]
            unsure = np.logical_or.reduceat(unsure, start) & (merges > 1)
            if unsure.any():
                queued.append(word[start[unsure]])
                stay = np.repeat(~unsure, size)
                symbol, word, rank, made, size = symbol[stay], word[stay], rank[stay], made[stay], size[~unsure]
                start = np.cumsum(size) - size
        words = np.concatenate([w for w, _ in done]) if done else np.zeros(0, np.int64)
        symbols = np.concatenate([s for _, s in done]) if done else np.zeros(0, np.int64)
        return symbols, words, np.concatenate(queued) if queued else np.zeros(0, np.int64)

    def _queue(self, symbol: np.ndarray) -> np.ndarray:
        """Merges one word in queue order: best rank first, then leftmost."""
        symbols, n = symbol.tolist(), len(symbol)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        table = self.__dict__.setdefault("_table", {})
        if not table:
            table.update(zip(self.pair.tolist(), zip(self.rank.tolist(), self.made.tolist())))
        queue: list[tuple[int, int, int, int, int]] = []

        def push(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and symbols[i] >= 0 and symbols[j] >= 0:
                found = table.get(symbols[i] * self.symbols + symbols[j])
                if found:
                    heapq.heappush(queue, (found[0], i, found[1], symbols[i], symbols[j]))

        for i in range(n - 1):
            push(i, i + 1)
        gone = [False] * n
        while queue:
            _, i, piece, left, right = heapq.heappop(queue)
            j = -1 if gone[i] else after[i]
            if j < 0 or symbols[i] != left or symbols[j] != right:
                continue
            symbols[i], gone[j], after[i] = piece, True, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            push(before[i], i)
            push(i, after[i])
        return np.array([s for s, g in zip(symbols, gone) if not g], np.int64)

    def _encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words one after another, and each word's number of ids."""
        texts = [w.decode("utf-8", "replace").replace(" ", SPACE) for w in words]
        point = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        size = np.array([len(t) for t in texts], np.int64)
        place = np.searchsorted(self.alphabet, point)
        place[place == len(self.alphabet)] = 0
        known = self.alphabet[place] == point
        symbol = np.where(known, self.letter[place], -1 - point)  # an unknown character is kept as such
        cut = np.ones(len(point), bool)
        key = place[:-1] * len(self.alphabet) + place[1:]
        at = np.minimum(np.searchsorted(self.beside, key), len(self.beside) - 1)
        cut[1:] = ~((self.beside[at] == key) & known[:-1] & known[1:])
        cut[np.cumsum(size) - size] = True
        start = np.flatnonzero(cut)
        parts = np.diff(np.append(start, len(point)))
        short = parts <= LONG
        inside = np.repeat(short, parts)
        number = np.arange(len(start))
        found, word, queued = self._rounds(symbol[inside], np.cumsum(parts[short]) - parts[short])
        piece, owner = [found], [number[short][word]]
        for i in np.concatenate([number[~short], number[short][queued]]).tolist():
            piece.append(self._queue(symbol[start[i] : start[i] + parts[i]]))
            owner.append(np.full(len(piece[-1]), i))
        piece, owner = np.concatenate(piece), np.concatenate(owner)
        order = np.argsort(owner, kind="stable")
        piece, owner = self._spell(piece[order], owner[order])
        of_word = np.searchsorted(np.cumsum(size), start[owner], side="right")
        return piece.astype(np.int32), np.bincount(of_word, minlength=len(words)).astype(np.int64)

    def _spell(self, piece: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters that are no piece become the pieces of their bytes (or the unknown id)."""
        limit = len(self.surface_size)
        odd = np.flatnonzero((piece < 0) | (piece >= limit))
        if not len(odd):
            return piece, owner
        back = {s: chr(p) for p, s in zip(self.alphabet.tolist(), self.letter.tolist()) if s >= limit}
        spelt, size = [], np.ones(len(piece), np.int64)
        for i in odd.tolist():
            p = int(piece[i])
            raw = (chr(-1 - p) if p < 0 else back[p]).encode("utf-8", "replace")
            spelt.append(self.byte[list(raw)] if self.fallback else np.array([self.unknown]))
            size[i] = len(spelt[-1])
        out = np.repeat(piece, size)
        begin = (np.cumsum(size) - size)[odd]
        out[np.repeat(begin, size[odd]) + np.concatenate([np.arange(len(s)) for s in spelt])] = np.concatenate(spelt)
        return out, np.repeat(owner, size)

    # ------------------------------------------------------------------ whole texts

    def _slots(self, words: list[bytes]) -> np.ndarray:
        """Where the ids of the words are kept; new words are encoded first."""
        if len(self.slot) > CACHE:
            self._forget()
        new = [w for w in words if w not in self.slot]
        if new:
            flat, size = self._encode_words(new)
            self.slot.update(zip(new, range(len(self.size), len(self.size) + len(new))))
            self.begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(size) - size])
            self.size = np.concatenate([self.size, size])
            self.flat = np.concatenate([self.flat, flat])
        return np.fromiter(map(self.slot.__getitem__, words), np.int64, len(words))

    def encode(self, t: Texts) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each followed by the end id, and the texts' bounds; blanks stand for SPACE,
        and a leading blank for the model's dummy prefix is part of the text already."""
        n = len(t)
        if not len(t.buf):
            return np.full(n, self.end, np.int32), np.arange(n + 1, dtype=np.int64)
        begin = np.zeros(len(t.buf), bool)
        if self.split_words:
            blank = t.buf == 32
            begin[1:] = blank[1:] & ~blank[:-1]
        begin[t.off[:-1][np.diff(t.off) > 0]] = True
        start = np.flatnonzero(begin)
        distinct, code = distinct_words(t, start)
        slot = self._slots(distinct.to_pylist())[code]
        size = self.size[slot]
        bounds = np.concatenate([[0], np.cumsum(size)])
        text = bounds[np.searchsorted(start, t.off)] + np.arange(n + 1)
        out = np.full(int(bounds[-1]) + n, self.end, np.int32)
        ids = _gather(self.flat, self.begin[slot], size)
        out[np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(text) - 1)] = ids
        return out, text

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """The text of each group of ids; bytes that are no UTF-8 become U+FFFD each."""
        size = self.surface_size[ids]
        raw = _gather(self.surface, self.surface_begin[ids], size).tobytes()
        stop = np.cumsum(size)
        at = np.concatenate([[0], stop])[bounds]
        lo, hi = at[:-1], at[1:]
        first = np.searchsorted(stop, lo, side="right")  # the first piece with a surface
        full = hi > lo
        lo = lo.copy()
        lo[full] += self.leads[ids[first[full]]]
        return [raw[a:b].decode("utf-8", "shroud-per-byte") for a, b in zip(lo.tolist(), hi.tolist())]


def model(path: str) -> Pieces:
    if path not in _workers:
        _workers[path] = Pieces(path)
    return _workers[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """Ids of the whole texts of ``docs`` (doc_id, text): doc_id, ids array<int>, the end id last."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model(path)
        for batch in batches:
            text = pc.replace_substring(pc.fill_null(batch["text"].cast(pa.large_string()), ""), SPACE, " ")
            if pieces.prefix:
                text = pc.if_else(pc.equal(pc.binary_length(text), 0), text, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), text, pa.scalar("", pa.large_string())))
            for t in slices(text):
                ids, bounds = pieces.encode(t)
                column = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(t.first, len(t)), column], names=["doc_id", "ids"])

    return docs.mapInArrow(run, "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded``: the text of its ids (null: empty). A column of that name is replaced."""
    encoded = encoded.drop("decoded")
    schema = encoded.select("*", F.lit("").alias("decoded")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model(path)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids))
            column = pc.fill_null(column, pa.scalar([], column.type))
            lo = 0
            while lo < len(column):  # a few million ids at a time
                off = np.asarray(column.offsets)
                hi = min(len(column), max(lo + 1, int(np.searchsorted(off, off[lo] + (1 << 20), side="right")) - 1))
                flat = np.asarray(column.values)[off[lo] : off[hi]]
                texts = pieces.decode(flat, off[lo : hi + 1] - off[lo])
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, "decoded"])
                lo = hi

    return encoded.mapInArrow(run, schema)
