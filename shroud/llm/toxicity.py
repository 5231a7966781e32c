"""Toxicity: Levenshtein automata intersected with a lexicon trie, and context windows around the hits.

The lexicon (whole terms, and stems that any ending may follow) is learned from labelled training
documents by document frequencies. It is kept as a trie; the automaton that accepts every word within
``edits(len(term))`` of a term is the product of the trie with the Levenshtein automaton. Its states
(trie nodes with an edit row) are made on demand and kept, so that a word costs one table look-up a
letter and most words end in the dead state after a few letters. Two exchanged letters of a term count as
one edit. Forms that are more frequent in clean training documents than in toxic ones are no fuzzy hits.

Every hit is read in a window of ``WINDOW`` words: quotation marks around it or words of reporting
count as quotation, words of address as abuse. A logistic regression over the counts gives the score.

Edge cases: null and empty texts and texts without words score as a text without hits; without
labelled rows, or with one class only, every score is the share of label 1 (0 without rows);
conflicting labels of one id count once each; repeated rows each get a result; very long texts are
scanned whole; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shroud.llm.common import judged, remainder, written
from shroud.llm.text import Texts, distinct_words, slices, words

SAMPLE_ROWS = 20_000  # bound of the labelled rows that the lexicon and the weights are learned from
MIN_DOCS, MIN_SHARE = 3, 0.5  # a term is in so many toxic documents, and its documents are toxic so often (lower bound)
STEMS = range(4, 8)  # lengths of prefixes that may become stems
CLEAN_DOCS = 2  # a form that is in so many clean documents, and more often in clean than in toxic ones, is no fuzzy hit
MIN_ENDINGS = 5  # a stem has so many different endings in toxic documents
WINDOW = 6

#: FIXED VALUES: words that report speech, and words that address the reader (en, de, fr, es).
REPORTING = frozenset("said says wrote called calls quoted quote term word words phrase sagte schrieb genannt wort zitat dit écrit appelé mot citation dijo escribió llamó palabra cita".split())
ADDRESS = frozenset("you your you're youre u ur du dich dir dein ihr euch tu toi te ton vous votre tú ti tus usted vosotros".split())
#: FIXED VALUES: signs written for letters.
SIGNS = str.maketrans("013457@$!", "oieastasi")
QUOTES = "\"“”„«»‹›‘’"

NONE, FUZZY, STEM, EXACT = 0, 1, 2, 3


def edits(length: int) -> int:
    """Edits allowed for a term of this many letters."""
    return 0 if length < 4 else 1 if length < 10 else 2


def bare(token: str) -> str:
    """Lower case, without signs at either end."""
    return re.sub(r"^\W+|[\W_]+$", "", token.lower())


class Lexicon:
    """Trie of the terms and the lazily determinised product with the Levenshtein automaton."""

    def __init__(self, terms: list[str], stems: list[str]):
        self.excluded: frozenset[str] = frozenset()  # forms of clean documents
        self.swapped = {x[:i] + x[i + 1] + x[i] + x[i + 2 :] for x in terms if edits(len(x)) for i in range(len(x) - 1)}
        self.children: list[dict[str, int]] = [{}]
        self.term, self.stem, self.deepest = [False], [False], [0]
        for word, flag in [*((x, self.term) for x in sorted(terms)), *((x, self.stem) for x in sorted(stems))]:
            node = 0
            path = [0]
            for c in word:
                nxt = self.children[node].get(c)
                if nxt is None:
                    nxt = len(self.children)
                    self.children[node][c] = nxt
                    self.children.append({})
                    self.term.append(False)
                    self.stem.append(False)
                    self.deepest.append(0)
                node = nxt
                path.append(node)
            flag[node] = True
            if flag is self.term:
                for x in path:
                    self.deepest[x] = max(self.deepest[x], edits(len(word)))
        self.depth = [0] * len(self.children)
        for node, kids in enumerate(self.children):  # children follow their parent
            for x in kids.values():
                self.depth[x] = self.depth[node] + 1
        self.reset()

    def reset(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.next: list[dict[str, int]] = []
        self.kind: list[int] = []
        self.start = self._state(self._closed({0: 0}))

    def _closed(self, reached: dict[int, int]) -> tuple:
        """Adds what deletions reach: node -> fewest edits."""
        todo = list(reached)
        while todo:
            node = todo.pop()
            for child in self.children[node].values():
                e = reached[node] + 1
                if e <= self.deepest[child] and e < reached.get(child, 99):
                    reached[child] = e
                    todo.append(child)
        return tuple(sorted(reached.items()))

    def _state(self, key: tuple) -> int:
        if key not in self.ids:
            self.ids[key] = len(self.states)
            self.states.append(key)
            self.next.append({})
            kind = NONE
            for node, e in key:
                if self.term[node] and e <= edits(self.depth[node]):
                    kind = max(kind, EXACT if e == 0 else FUZZY)
            self.kind.append(kind)
        return self.ids[key]

    def _step(self, state: int, c: str) -> int:
        """The state after ``c``: the letter matched, inserted or put for another one; -1 is dead."""
        reached: dict[int, int] = {}
        for node, e in self.states[state]:
            if e + 1 <= self.deepest[node]:
                reached[node] = min(e + 1, reached.get(node, 99))
            for x, child in self.children[node].items():
                cost = e + (x != c)
                if cost <= self.deepest[child] or cost == 0:
                    reached[child] = min(cost, reached.get(child, 99))
        out = self._state(self._closed(reached)) if reached else -1
        self.next[state][c] = out
        return out

    def match(self, word: str) -> int:
        """EXACT, STEM, FUZZY or NONE."""
        if len(self.states) > 200_000:  # the states are a cache
            self.reset()
        state, node, stem = self.start, 0, NONE
        follow = self.next
        for c in word:
            if node >= 0:
                node = self.children[node].get(c, -1)
                if node >= 0 and self.stem[node]:
                    stem = STEM
            to = follow[state].get(c)
            state = self._step(state, c) if to is None else to
            if state < 0:
                return stem
        return max(self.kind[state], stem)


    def kind_of(self, word: str) -> int:
        """As ``match``, with two exchanged letters as one edit, and without the excluded forms."""
        kind = self.match(word)
        if kind == NONE and word in self.swapped:
            kind = FUZZY
        return NONE if kind == FUZZY and word in self.excluded else kind


class Scanner:
    """Hits of a lexicon in texts, with their context."""

    FEATURES = 8

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.seen: dict[bytes, int] = {}

    def kinds(self, tokens: list[bytes]) -> np.ndarray:
        seen, match = self.seen, self.lexicon.kind_of
        if len(seen) > 200_000:  # a cache
            seen.clear()
        out = np.empty(len(tokens), np.int8)
        for i, raw in enumerate(tokens):
            kind = seen.get(raw)
            if kind is None:
                word = bare(raw.decode("utf-8", "replace"))
                kind = match(word) if word else NONE
                if not kind and word and not word.isalpha():
                    plain = re.sub(r"[\W\d_]+", "", word.translate(SIGNS))
                    if plain and plain != word and any(c.isalpha() for c in word):
                        kind = min(match(plain), FUZZY)
                seen[raw] = kind
            out[i] = kind
        return out

    def features(self, t: Texts) -> np.ndarray:
        """Per text: counts of exact, stem and fuzzy hits, hits in quotation, hits in address, different hits, log length, share."""
        out = np.zeros((len(t), self.FEATURES))
        start, _, first = words(t)
        n = np.diff(first)
        out[:, 6] = np.log1p(n)
        if not len(start):
            return out
        tokens, index = distinct_words(t, start)
        tokens = tokens.to_pylist()
        kind = self.kinds(tokens)[index]
        for at in np.flatnonzero(kind):
            doc = int(np.searchsorted(first, at, side="right")) - 1
            lo, hi = max(first[doc], at - WINDOW), min(first[doc + 1], at + WINDOW + 1)
            around = [tokens[i].decode("utf-8", "replace") for i in index[lo:hi]]
            here = int(at - lo)
            before, after = " ".join(around[: here + 1]), " ".join(around[here:])
            near = {bare(x) for x in around}
            quoted = (any(q in before for q in QUOTES) and any(q in after for q in QUOTES)) or bool(near & REPORTING)
            out[doc, {EXACT: 0, STEM: 1, FUZZY: 2}[int(kind[at])]] += 1
            out[doc, 3] += quoted
            out[doc, 4] += bool(near & ADDRESS)
        hit = np.flatnonzero(kind)
        if len(hit):
            doc = np.searchsorted(first, hit, side="right") - 1
            both = np.unique(np.stack([doc, index[hit]], axis=1), axis=0)
            out[:, 5] = np.bincount(both[:, 0], minlength=len(t))
        out[:, 7] = out[:, :3].sum(axis=1) / np.maximum(n, 1)
        out[:, :6] = np.log1p(out[:, :6])
        return out


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document counts of words and of prefixes, by label, and each prefix with the words of toxic documents that it begins."""
    for batch in batches:
        toxic = batch["toxic"].to_numpy(zero_copy_only=False)
        for t in slices(batch["text"]):
            start, _, first = words(t)
            if not len(start):
                continue
            tokens, index = distinct_words(t, start)
            doc = np.repeat(np.arange(len(t)), np.diff(first))
            named = [bare(x.decode("utf-8", "replace")) for x in tokens.to_pylist()]
            for stem in (0, *STEMS):
                cut = [x if not stem else x[:stem] if len(x) > stem else "" for x in named]
                terms = {x: i for i, x in enumerate(dict.fromkeys(cut))}
                ids = np.array([terms[x] for x in cut])[index]
                pair = np.unique(doc * np.int64(len(terms)) + ids)
                d, w = pair // len(terms), pair % len(terms)
                label = toxic[t.first : t.first + len(t)][d].astype(float)
                all_, bad = np.bincount(w, minlength=len(terms)), np.bincount(w, label, len(terms)).astype(np.int64)
                keep = np.array([bool(x) for x in terms]) & (all_ > 0)
                names = [x for x, k in zip(terms, keep) if k]
                yield pa.RecordBatch.from_arrays([pa.array([stem] * len(names), pa.int32()), pa.array(names, pa.string()), pa.array(all_[keep]), pa.array(bad[keep]), pa.nulls(len(names), pa.string())], names=["stem", "term", "n", "bad", "word"])
                if stem:
                    there = [i for i in np.unique(index[toxic[t.first : t.first + len(t)][doc] == 1]) if cut[i]]
                    none = pa.array([0] * len(there), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array([stem] * len(there), pa.int32()), pa.array([cut[i] for i in there], pa.string()), none, none, pa.array([named[i] for i in there], pa.string())], names=["stem", "term", "n", "bad", "word"])


def fit(docs: DataFrame, labels: DataFrame, train, rows: int = SAMPLE_ROWS) -> dict:
    """Lexicon and weights from the labelled rows of ``labels`` (doc_id, toxic) that ``train`` (a column) selects."""
    marked = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(train).where("toxic in (0, 1) and doc_id is not null")
    marked = marked.orderBy(F.xxhash64(F.lit("toxic"), "doc_id"), "doc_id", "toxic").limit(rows)
    sample = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(marked), "doc_id").select("text", "toxic")  # at most `rows` small rows
    found = sample.mapInArrow(_vocabulary, "stem int, term string, n bigint, bad bigint, word string")
    found = found.groupBy("stem", "term").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.count_distinct("word").alias("endings"))
    found = written(found, "vocabulary")
    words_ = found.where((F.col("stem") == 0) & (F.col("n") - F.col("bad") >= CLEAN_DOCS) & (F.col("n") > 2 * F.col("bad"))).select("term")
    # lower end of the share's 95 % interval (Wilson)
    p, z2 = F.col("bad") / F.col("n"), 3.84
    low = (p + z2 / (2 * F.col("n")) - F.sqrt(z2 * (p * (1 - p) + z2 / (4 * F.col("n"))) / F.col("n"))) / (1 + z2 / F.col("n"))
    found = found.where((F.col("bad") >= MIN_DOCS) & ((F.col("stem") == 0) | (F.col("endings") >= MIN_ENDINGS))).withColumn("low", low)
    found = found.where((F.col("low") >= F.when(F.col("stem") > 0, 0.9).otherwise(MIN_SHARE)) & (F.length("term") >= 3))
    best = sorted(found.select("stem", "term").collect())  # bounded by the sample
    lexicon = Lexicon([r["term"] for r in best if r["stem"] == 0], [r["term"] for r in best if r["stem"] > 0])
    bare_ = docs.sparkSession.sparkContext.broadcast(lexicon)

    def close(batches):
        for b in batches:
            yield b.filter(pa.array([bool(x) and bare_.value.kind_of(x) == FUZZY for x in b["term"].to_pylist()], pa.bool_()))

    lexicon.excluded = frozenset(r["term"] for r in words_.mapInArrow(close, "term string").collect())  # of at most `rows` documents
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def read(batches):
        scanner = Scanner(shared.value)
        for b in batches:
            for t in slices(b["text"]):
                x = scanner.features(t)
                yield pa.RecordBatch.from_arrays([b["toxic"].slice(t.first, len(t)), pa.array(list(x), pa.list_(pa.float64()))], names=["toxic", "x"])

    rows_ = sample.mapInArrow(read, "toxic int, x array<double>").toArrow()
    y = np.array(rows_["toxic"].to_pylist(), float)
    x = np.array(rows_["x"].to_pylist(), float).reshape(len(y), Scanner.FEATURES)
    return {"lexicon": lexicon, "weights": logistic(x, y), "terms": len(best)}


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> dict:
    """A ridge logistic regression by Newton steps on standardised inputs; one class only: its share."""
    if not len(y) or y.min() == y.max():
        return {"mean": 0.0, "scale": 1.0, "beta": np.zeros(x.shape[1] + 1), "share": float(y.mean()) if len(y) else 0.0}
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    z = np.concatenate([(x - mean) / scale, np.ones((len(x), 1))], axis=1)
    beta = np.zeros(z.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        grad = z.T @ (y - p) - ridge * beta
        beta = beta + np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(beta)), grad)
    return {"mean": mean, "scale": scale, "beta": beta, "share": None}


def probability(w: dict, x: np.ndarray) -> np.ndarray:
    if w["share"] is not None:
        return np.full(len(x), w["share"])
    z = np.concatenate([(x - w["mean"]) / w["scale"], np.ones((len(x), 1))], axis=1)
    return 1 / (1 + np.exp(-np.clip(z @ w["beta"], -30, 30)))


def score(docs: DataFrame, fitted: dict) -> DataFrame:
    """(doc_id, score, hits, quoted), a row per row of ``docs`` (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(fitted)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches):
        scanner = Scanner(shared.value["lexicon"])
        for b in batches:
            for t in slices(b["text"]):
                x = scanner.features(t)
                hits = np.rint(np.expm1(x[:, :3]).sum(axis=1)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([b["doc_id"].slice(t.first, len(t)), pa.array(probability(shared.value["weights"], x)), pa.array(hits), pa.array(np.rint(np.expm1(x[:, 3])).astype(np.int64))], names=["doc_id", "score", "hits", "quoted"])

    return docs.mapInArrow(run, "doc_id bigint, score double, hits bigint, quoted bigint")


def clean(docs: DataFrame, fitted: dict, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, all columns."""
    shared = docs.sparkSession.sparkContext.broadcast(fitted)

    def judge():
        scanner = Scanner(shared.value["lexicon"])
        return lambda t: probability(shared.value["weights"], scanner.features(t)) < threshold

    return judged(docs, judge)


def trained(docs: DataFrame, labels: DataFrame) -> dict:
    """Lexicon and weights from labelled rows whose crc32(doc_id) mod 4 is not 2."""
    return fit(docs, labels, remainder("doc_id", 4) != 2)
