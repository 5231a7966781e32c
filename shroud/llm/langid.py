"""Language identification with interpolated Kneser-Ney character models.

Training counts the character n-grams of whole words (padded with blanks) per language in Spark over
every training document; lower orders are continuation counts, derived by further group-bys. Every gram
is kept, in a table in the shared folder. Orders 1 and 2 (at most the pairs of letters) and the
discounts are broadcast; the higher orders of a gram share its middle letters, so the table is dealt
by them and each part restates its part of the model. The bits of the most frequent grams are
broadcast as a cache, in sorted arrays of 64-bit gram hashes searched by bisection; a text's other grams are
joined with the table, so the size of the cache changes the cost and not the result.

A text is scored by its cross-entropy per character under every model; the lowest wins. The limit
above which a text counts as no known language is calibrated per language on all
training documents of 20 letters and word ends or more.

Edge cases: a null text, or one without a letter, is ``und`` with score 0 and not accepted; training
rows with null lang or text are ignored; ties go to the language that sorts first; without any
training row every text is ``und``; repeated rows each get a result; very long texts are scored whole;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shroud.llm.common import remainder, written
from shroud.llm.text import distinct_words, mix64, per_text, slices, words

ORDER = 5
LOW = 2  # orders whose tables are broadcast
PARTS = 4096  # parts of the gram table
CACHE_CELLS = 2_000_000  # grams times languages whose bits are broadcast
REJECTED = 200_000  # keys of so many rejected texts are broadcast; more are joined
FEW_ROWS = 30  # a language with fewer calibration rows has at least the pooled deviation
LIMIT_SIGMAS, LIMIT_BITS = 8.0, 1.5  # a text is rejected beyond mean + sigmas * deviation + bits
BLANK = 32

_LETTER = None


def _letters() -> np.ndarray:
    global _LETTER
    if _LETTER is None:
        _LETTER = np.array([chr(i).isalpha() for i in range(0x110000)])
    return _LETTER


def gram_codes(cp: np.ndarray, k: int) -> np.ndarray:
    """The hash of the last ``k`` columns of an array (grams, ORDER) of code points."""
    h = np.full(len(cp), k, np.uint64)
    for j in range(cp.shape[1] - k, cp.shape[1]):
        h = h * np.uint64(0x9E3779B97F4A7C15) + cp[:, j].astype(np.uint64) + np.uint64(1)
    return mix64(h)


def word_grams(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Code points (grams, ORDER) of every letter and word end of the tokens, and each gram's token."""
    joined = "\n".join(x.decode("utf-8", "replace").replace("\n", " ").lower() for x in tokens) + "\n"
    cp = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    token = np.cumsum(cp == 10) - (cp == 10)
    cp = np.where(_letters()[cp], cp, BLANK).astype(np.uint32)
    n = len(cp)
    grams = np.full((n, ORDER), BLANK, np.uint32)
    grams[:, -1] = cp
    open_ = np.ones(n, bool)
    for back in range(1, ORDER):
        open_[:back] = False
        before = np.full(n, BLANK, np.uint32)
        before[back:] = cp[: n - back]
        grams[:, ORDER - 1 - back] = np.where(open_, before, BLANK)
        open_ &= before != BLANK
    counted = (cp != BLANK) | (grams[:, -2] != BLANK)
    return grams[counted], token[counted]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = batch["lang"].to_pylist()
        for t in slices(batch["text"]):
            start, _, first = words(t)
            if not len(start):
                continue
            spoken, code = np.unique(np.array(langs[t.first : t.first + len(t)]), return_inverse=True)
            tokens, index = distinct_words(t, start)
            lang = np.repeat(code, np.diff(first))
            grams, owner = word_grams(tokens.to_pylist())
            if not len(grams):
                continue
            _, at, inverse = np.unique(gram_codes(grams, ORDER), return_index=True, return_inverse=True)
            text = np.ascontiguousarray(grams[at].astype("<u4")).view(f"<U{ORDER}").reshape(-1)
            for i, name in enumerate(spoken):
                freq = np.bincount(index[lang == i], minlength=len(tokens))
                n = np.bincount(inverse, weights=freq[owner], minlength=len(at)).astype(np.int64)
                some = n > 0
                yield pa.RecordBatch.from_arrays([pa.array([name] * int(some.sum()), pa.string()), pa.array(text[some].tolist(), pa.string()), pa.array(n[some])], names=["lang", "gram", "n"])


def gram_counts(train: DataFrame) -> DataFrame:
    """(lang, gram, n) over all of ``train`` (text, lang): the top-order grams."""
    train = train.where("text is not null and lang is not null").select("text", "lang")
    return train.mapInArrow(_count, "lang string, gram string, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def discount(ones: int, twos: int) -> float:
    return ones / (ones + 2 * twos) if ones and twos else 0.5


class Model:
    """Sorted hash arrays per order, with a probability per gram and language and a weight per context and language."""

    def __init__(self, counts: dict[str, dict[int, tuple]], langs: list[str] | None = None, discounts: dict | None = None, lower: "Model | None" = None):
        """``counts``: per language and order the grams and their counts; ``lower`` has the orders up to ``LOW``."""
        self.langs = sorted(counts) if langs is None else langs
        n = len(self.langs)
        self.base = np.full(n, 1.0 / 4096)
        self.grams: dict[int, tuple[np.ndarray, np.ndarray]] = dict(lower.grams) if lower else {}
        self.contexts: dict[int, tuple[np.ndarray, np.ndarray]] = dict(lower.contexts) if lower else {}
        for k in range(max(self.grams, default=0) + 1, ORDER + 1):
            parts = [(i, self._points(counts[x][k][0]), counts[x][k][1].astype(float)) for i, x in enumerate(self.langs) if k in counts.get(x, {})]
            if not parts:
                continue
            points = np.concatenate([p for _, p, _ in parts])
            code = gram_codes(points, k)
            keys, at = np.unique(code, return_index=True)
            context = gram_codes(self._shift(points), k - 1) if k > 1 else np.zeros(len(points), np.uint64)
            ckeys = np.unique(context)
            share, weight = np.zeros((len(keys), n)), np.ones((len(ckeys), n))
            lo = 0
            for i, p, c in parts:
                mine, ctx = np.searchsorted(keys, code[lo : lo + len(p)]), np.searchsorted(ckeys, context[lo : lo + len(p)])
                lo += len(p)
                d = discount((c == 1).sum(), (c == 2).sum()) if discounts is None else discounts[self.langs[i], k]
                total, kinds = np.bincount(ctx, c, len(ckeys)), np.bincount(ctx, minlength=len(ckeys))
                share[mine, i] = np.maximum(c - d, 0) / total[ctx]
                seen = total > 0
                weight[seen, i] = d * kinds[seen] / total[seen]
            lower = self._probability(points[at], k - 1)
            here = np.searchsorted(ckeys, context[at])
            self.contexts[k] = (ckeys, weight)
            self.grams[k] = (keys, share + weight[here] * lower)

    @staticmethod
    def _points(grams) -> np.ndarray:
        if isinstance(grams, np.ndarray):
            return grams
        wide = [g.rjust(ORDER) for g in grams]
        return np.frombuffer("".join(wide).encode("utf-32-le"), np.uint32).reshape(len(wide), ORDER)

    @staticmethod
    def _shift(points: np.ndarray) -> np.ndarray:
        """The grams' contexts: everything but the last character, moved to the right end."""
        return np.concatenate([np.full((len(points), 1), BLANK, np.uint32), points[:, :-1]], axis=1)

    @staticmethod
    def _find(keys: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(keys, code), len(keys) - 1)
        return at, keys[at] == code

    def _probability(self, points: np.ndarray, k: int) -> np.ndarray:
        if k == 0:
            return np.tile(self.base, (len(points), 1))
        if k not in self.grams:
            return self._probability(points, k - 1)
        keys, p = self.grams[k]
        at, hit = self._find(keys, gram_codes(points, k))
        out = p[at]
        if not hit.all():
            rest = points[~hit]
            low = self._probability(rest, k - 1)
            ckeys, weight = self.contexts[k]
            at, known = self._find(ckeys, gram_codes(self._shift(rest), k - 1) if k > 1 else np.zeros(len(rest), np.uint64))
            out[~hit] = np.where(known[:, None], weight[at], 1.0) * low
        return out

    def bits(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Per token: the bits under each language (tokens, languages), and the number of characters."""
        points, owner = word_grams(tokens)
        n = len(tokens)
        p = -np.log2(self._probability(points, ORDER)) if len(points) else np.zeros((0, len(self.langs)))
        return np.stack([np.bincount(owner, p[:, i], n) for i in range(len(self.langs))], axis=1), np.bincount(owner, minlength=n)


def _part():
    """The part of the gram table that holds a gram: by its third and fourth letter, which its higher orders share."""
    return F.pmod(F.xxhash64(F.expr("substring(gram, 3, 2)")), F.lit(PARTS)).cast("int").alias("part")


def gram_bits(needed: DataFrame, fitted: dict) -> DataFrame:
    """(gram, bits): the bits of the distinct top-order grams ``needed`` under each language."""
    low, discounts, langs = fitted["low"], fitted["discounts"], fitted["langs"]
    shared = needed.sparkSession.sparkContext.broadcast((low, discounts, langs))

    def run(counted: pa.Table, wanted: pa.Table) -> pa.Table:
        lower, given, langs = shared.value
        if not wanted.num_rows:
            return pa.table([pa.array([], pa.string()), pa.array([], pa.list_(pa.float64()))], names=["gram", "bits"])
        counts: dict = {}
        lang, n, points = np.array(counted["lang"].to_pylist(), object), counted["n"].to_numpy(), Model._points(counted["gram"].to_pylist())
        for x in set(lang):
            some = lang == x
            at, c = points[some], n[some]
            counts[x] = {ORDER: (at, c)}
            for k in range(ORDER - 1, LOW, -1):
                _, first, c = np.unique(gram_codes(at, k), return_index=True, return_counts=True)
                at = at[first]
                counts[x][k] = (at, c)
        model = Model(counts, langs, given, lower)
        grams = wanted["gram"].to_pylist()
        return pa.table([pa.array(grams, pa.string()), _lists(-np.log2(model._probability(Model._points(grams), ORDER)))], names=["gram", "bits"])

    table = fitted["grams"].select(_part(), "lang", "gram", "n")
    return table.groupBy("part").cogroup(needed.select(_part(), "gram").groupBy("part")).applyInArrow(run, "gram string, bits array<double>")


def _lists(x: np.ndarray) -> pa.Array:
    """The rows of a matrix as lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * np.int32(x.shape[1])), pa.array(np.ascontiguousarray(x, float).reshape(-1)))


def scored(docs: DataFrame, fitted: dict, keep: tuple[str, ...]) -> DataFrame:
    """``keep`` columns, total bits under each language and number of scored characters, a row per row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(fitted["cache"])
    docs = docs.select(F.monotonically_increasing_id().alias("_row"), *keep, F.col("text").cast("string").alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != "_text")

    def run(batches):
        keys, known = shared.value
        for b in batches:
            for t in slices(b["_text"]):
                m, wide = len(t), known.shape[1]
                own = [b[c].slice(t.first, m) for c in ("_row", *keep)]
                start, _, first = words(t)
                bits, n, rest = np.zeros((m, wide)), np.zeros(m, np.int64), None
                if len(start):
                    tokens, index = distinct_words(t, start)
                    points, owner = word_grams(tokens.to_pylist())
                    n = per_text(np.bincount(owner, minlength=len(tokens))[index], first)
                    at, hit = Model._find(keys, gram_codes(points, ORDER))
                    sums = [np.bincount(owner[hit], known[at[hit], i], len(tokens)) for i in range(wide)]
                    bits = np.stack([per_text(x[index], first, empty=0.0) for x in sums], axis=1)
                    if not hit.all():
                        rest = _rest(points[~hit], owner[~hit], index, first, len(tokens))
                names = ["_row", *keep, "gram", "times", "bits", "n"]
                yield pa.RecordBatch.from_arrays([*own, pa.nulls(m, pa.string()), pa.nulls(m, pa.int64()), _lists(bits), pa.array(n, pa.int64())], names=names)
                if rest is not None:
                    doc, gram, times = rest
                    r = len(doc)
                    yield pa.RecordBatch.from_arrays([own[0].take(pa.array(doc)), *(pa.nulls(r, x.type) for x in own[1:]), gram, pa.array(times, pa.int64()), pa.nulls(r, pa.list_(pa.float64())), pa.nulls(r, pa.int64())], names=names)

    read = written(docs.mapInArrow(run, f"{kinds}, gram string, times bigint, bits array<double>, n bigint"), "scored")
    rest = read.where("gram is not null").select("_row", "gram", "times")
    late = rest.join(gram_bits(rest.select("gram").distinct(), fitted), "gram")
    late = late.groupBy("_row").agg(F.array(*(F.sum(F.col("times") * F.col("bits")[i]) for i in range(len(fitted["langs"])))).alias("late"))
    total = F.coalesce(F.zip_with("bits", "late", lambda x, y: x + y), "bits")
    return read.where("gram is null").join(late, "_row", "left").select(*keep, total.alias("bits"), "n")


def _rest(points: np.ndarray, owner: np.ndarray, index: np.ndarray, first: np.ndarray, tokens: int) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(text, gram, times) of the grams that the cache lacks; ``owner``: their tokens, ``index``: the token of each word."""
    _, one, gram = np.unique(gram_codes(points, ORDER), return_index=True, return_inverse=True)
    per = np.bincount(owner, minlength=tokens)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    some = per[index] > 0
    word, doc = index[some], doc[some]
    size = per[word]
    at = np.repeat((np.cumsum(per) - per)[word] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    pair, times = np.unique(np.repeat(doc, size) * np.int64(len(one)) + gram[at], return_counts=True)
    text = np.ascontiguousarray(points[one].astype("<u4")).view(f"<U{ORDER}").reshape(-1)
    return pair // len(one), pa.array(text.tolist(), pa.string()).take(pa.array(pair % len(one))), times


def fit(train: DataFrame) -> dict:
    """The model and its rejection limits from ``train`` (doc_id, text, lang)."""
    spark = train.sparkSession
    train = train.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null")
    top = written(gram_counts(train), "grams")
    levels, above = {ORDER: top}, top
    for k in range(ORDER - 1, 0, -1):  # continuation counts: the distinct characters before a gram
        above = above.select("lang", F.expr(f"substring(gram, 2, {k})").alias("gram")).groupBy("lang", "gram").agg(F.count("*").alias("n"))
        levels[k] = above
    discounts, counts = {}, {}
    for k, level in levels.items():
        for r in level.groupBy("lang").agg(F.sum((F.col("n") == 1).cast("int")).alias("ones"), F.sum((F.col("n") == 2).cast("int")).alias("twos")).collect():  # a row per language
            discounts[r["lang"], k] = discount(r["ones"], r["twos"])
        if k <= LOW:
            found = level.toArrow()  # at most the pairs of letters
            lang = np.array(found["lang"].to_pylist(), object)
            for x in set(lang):
                part = found.filter(pa.array(lang == x))
                counts.setdefault(x, {})[k] = (part["gram"].to_pylist(), part["n"].to_numpy())
    if not counts:
        return {"langs": [], "limits": np.zeros(0)}
    langs = sorted(counts)
    fitted = {"langs": langs, "low": Model(counts, langs, discounts), "discounts": discounts, "grams": top}
    often = top.groupBy("gram").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "gram").limit(CACHE_CELLS // len(langs) + 1)
    found = gram_bits(often.select("gram"), fitted).toArrow()
    code = gram_codes(Model._points(found["gram"].to_pylist()), ORDER)
    order = np.argsort(code)
    bits = found["bits"].combine_chunks().flatten().to_numpy().reshape(len(code), len(langs))
    fitted["cache"] = code[order], bits[order]
    own = scored(train, fitted, ("lang",)).where("n >= 20").select("lang", (F.get("bits", F.array_position(F.array(*map(F.lit, langs)), F.col("lang")).cast("int") - 1) / F.col("n")).alias("h"))
    stats = {r["lang"]: r for r in own.where("h is not null").groupBy("lang").agg(F.avg("h").alias("m"), F.stddev_pop("h").alias("s"), F.count("*").alias("n")).collect()}
    fitted["limits"] = np.array([limit(stats, x) for x in langs])
    return fitted


def limit(stats: dict, lang: str) -> float:
    """The rejection limit of a language; with few rows it has the pooled deviation, without any the pooled mean too."""
    n = sum(r["n"] for r in stats.values())
    if not n:
        return np.inf
    mean, pooled = sum(r["n"] * r["m"] for r in stats.values()) / n, np.sqrt(sum(r["n"] * r["s"] ** 2 for r in stats.values()) / n)
    if lang in stats:
        mean = stats[lang]["m"]
        pooled = stats[lang]["s"] if stats[lang]["n"] >= FEW_ROWS else max(pooled, stats[lang]["s"])
    return mean + LIMIT_SIGMAS * pooled + LIMIT_BITS


def identify(docs: DataFrame, fitted: dict, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, lang_pred, score (0 to 1), entropy (bits a character) and accepted, a row per row of ``docs``."""
    langs, limits = fitted["langs"], fitted["limits"]
    if not langs:
        return docs.select(*keep, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("entropy"), F.lit(False).alias("accepted"))
    found = scored(docs, fitted, keep)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema.fields if f.name in keep)

    def run(batches):
        for b in batches:
            n = b["n"].to_numpy()
            h = b["bits"].flatten().to_numpy().reshape(len(n), len(langs)) / np.maximum(n, 1)[:, None]
            best = h.argmin(axis=1)
            low = h[np.arange(len(n)), best]
            odds = np.exp2(-np.minimum((h - low[:, None]) * np.sqrt(np.maximum(n, 1))[:, None], 500.0))
            some = n > 0
            score = np.where(some, 1 / odds.sum(axis=1), 0.0)
            yield pa.RecordBatch.from_arrays([*(b[c] for c in keep), pa.array([langs[i] if s else "und" for i, s in zip(best, some)], pa.string()), pa.array(score), pa.array(np.where(some, low, 0.0)), pa.array(some & (low <= limits[best]))], names=[*keep, "lang_pred", "score", "entropy", "accepted"])

    return found.mapInArrow(run, f"{kinds}, lang_pred string, score double, entropy double, accepted boolean")


def clean(docs: DataFrame, fitted: dict) -> DataFrame:
    """The rows of ``docs`` in an accepted language, all columns; equal texts share their verdict."""
    if not fitted["langs"]:
        return docs.where(F.lit(False))
    key = F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))
    rejected = identify(docs.select(key.alias("_key"), "text"), fitted, ("_key",)).where("not accepted").select("_key").distinct()
    rejected = written(rejected, "rejected")
    if rejected.count() <= REJECTED:
        rejected = F.broadcast(rejected)
    return docs.withColumn("_key", key).join(rejected, "_key", "left_anti").select(*docs.columns)


def trained(docs: DataFrame) -> dict:
    """A model of the rows whose crc32(doc_id) mod 4 is not 2."""
    return fit(docs.where(remainder("doc_id", 4) != 2))
