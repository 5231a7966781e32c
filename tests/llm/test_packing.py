"""Exact round trip against the tokenizers library, and the sum-of-squares rule against its definition."""

import random
import zlib

import numpy as np
import pytest

from shroud.llm import packing, queries


@pytest.fixture(scope="module")
def encode():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.vocabulary())
    return lambda text: [*tokenizer.encode(text or "", add_special_tokens=False).ids, packing.END]


TEXTS = ["Hello, world!  It's 2024.", "", None, "  \t\n ", "ÉTÉ où Ça—naïve… straße ΣΑΣ İstanbul", "<|endoftext|> a<|startoftext|>b", "e\u0301 \u0301x a\u00a0b \u2003c", "x" * 5000, "日本語 テキスト 😀😀 ok", "don't they'll WE'VE '", "a\x00b \x1c c\x85d"]


def restored(rows):
    """Document -> its ids, from the pieces; checks the sequences."""
    sequences, docs = {}, {}
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length > 0
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        docs.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, ids))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= packing.WINDOW and (at == packing.WINDOW or at & (at - 1) == 0)
    return docs


def test_round_trip(spark, encode):
    rng = random.Random(1)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(100 + i, " ".join(rng.choice("lorem Ipsum dolor sit amet, consectetur 12 x-y").split(" ")[0] + str(rng.randrange(999)) for _ in range(rng.randrange(1, 4000)))) for i in range(60)]
    docs = restored(packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), queries.vocabulary()).collect())
    assert len(docs) == len(rows)
    by = {i: (n, pieces) for (i, n), pieces in docs.items()}
    for i, text in rows:
        n, pieces = by[i]
        at = 0
        for start, ids in sorted(pieces, key=lambda p: p[0]):
            assert start == at
            at += len(ids)
        assert np.concatenate([ids for _, ids in sorted(pieces, key=lambda p: p[0])]).tolist() == encode(text) and n == at


def test_odd_rows(spark, odd, none, encode):
    rows = packing.pack(odd, queries.vocabulary()).collect()
    docs = restored(rows)
    assert {i for i, _ in docs} == {r.doc_id for r in odd.collect()}
    assert sum(r.length for r in rows) == sum(len(encode(r.text)) for r in odd.collect())
    assert sum(1 for r in rows if r.doc_id == 2 and r.start == 0) == 2
    assert packing.pack(none, queries.vocabulary()).collect() == []


def test_level_is_the_least_sum_of_squares():
    rng = random.Random(3)
    packer = packing.Packer(16)
    for i in range(400):
        size = rng.randrange(1, 16)
        n = packer.count.copy()
        best = {}
        for h in range(0, 16 - size + 1):
            if h == 0 or n[h]:
                m = n.copy()
                if h:
                    m[h] -= 1
                if h + size < 16:
                    m[h + size] += 1
                best[h] = int((m[1:16] ** 2).sum())
        chosen = packer.level(size)
        assert best[chosen] == min(best.values())
        packer.add(i, np.arange(size, dtype="<u4"))
    assert packer.open == packer.count.sum() == sum(len(x) for x in packer.at.values())


def test_open_windows_are_bounded_and_nothing_is_lost():
    rng = random.Random(4)
    packer = packing.Packer(64, most_open=10)
    total = {}
    for i in range(500):
        total[i] = rng.randrange(33, 60)
        packer.add(i, np.arange(total[i], dtype="<u4"))
        assert packer.open <= 11
    packer.finish()
    seen = {}
    for sequence in packer.done:
        size = sum(len(p[3]) for p in sequence)
        assert size == 64 or size & (size - 1) == 0
        for doc, n, start, ids in sequence:
            assert n == total[doc] and ids[0] == start
            seen.setdefault(doc, []).append((start, len(ids)))
    for doc, n in total.items():
        at = 0
        for start, length in sorted(seen[doc]):
            assert start == at
            at += length
        assert at == n


def test_query_digest(spark, encode, tmp_path):
    spark.createDataFrame([(1, "one two three"), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.ids_crc32 for r in queries.op4_packing(spark, str(tmp_path)).collect()}
    assert got == {1: zlib.crc32(np.array(encode("one two three"), "<u4").tobytes()), 2: zlib.crc32(np.array([1], "<u4").tobytes())}
