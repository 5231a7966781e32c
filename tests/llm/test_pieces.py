"""Ids and texts against the sentencepiece library; merge rounds against queue order."""

import hashlib
import random
import string

import pytest

from shroud.llm import pieces, queries

ODD = ["", None, " ", "  ", "a", " a", "a ", "a  b   c    d     e", " " * 3000, "▁▁ ▁", "a▁b", "a" * 1200, "日本語テキスト。中文没有空格的句子" * 30, "x\x00y\x1f\x7f",
       "ｆｕｌｌ é é", "\n\n\n\t\t\r\n", "<s></s><unk> <0x41>", "😀😀👩‍👩‍👧", "==========----------======", "1234567890" * 200, "  ﻿"]


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=queries.piece_model())


def texts():
    rng = random.Random(3)
    out = list(ODD)
    out += ["".join(rng.choice("ab e t h  \n=-_日本é😀▁0") for _ in range(rng.randrange(1, 80))) for _ in range(800)]
    out += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xA0, 0x500), rng.randrange(0x4E00, 0x9FFF), 32])) for _ in range(rng.randrange(1, 60))) for _ in range(400)]
    return out + ["".join(rng.choice(string.ascii_letters + string.digits) for _ in range(rng.randrange(300, 3000))) for _ in range(10)]


def test_equals_the_library(spark, library):
    rows = list(enumerate(texts()))
    encoded = pieces.encode(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), queries.piece_model())
    found = {r.doc_id: r for r in pieces.decode(encoded, queries.piece_model()).collect()}
    assert len(found) == len(rows)
    for i, text in rows:
        ids = library.encode(text or "", add_eos=True)
        assert found[i].ids == ids, text
        assert found[i].decoded == library.decode(ids)


def test_decodes_any_ids(spark, library):
    """Ids that no text has: bytes that are no UTF-8, unknown and control ids, no leading blank."""
    rng = random.Random(9)
    rows = [(i, [rng.choice([0, 1, 2, rng.randrange(3, 259), rng.randrange(3, 259), rng.randrange(259, 32000)]) for _ in range(rng.randrange(0, 12))]) for i in range(500)]
    data = spark.createDataFrame([*rows, (900, None)], "doc_id long, ids array<int>")
    found = {r.doc_id: r.decoded for r in pieces.decode(data, queries.piece_model()).collect()}
    assert found.pop(900) == ""
    for i, ids in rows:
        assert found[i] == library.decode(ids), ids


def test_queue_order_where_rounds_are_unsure(library):
    """Runs of blanks make pairs better than the one being merged; long words are merged in queue order."""
    model = pieces.Pieces(queries.piece_model())
    assert pieces.LONG < 1000
    for text in (" " * 37, "a" + " " * 50 + "b", "ab" * 600, "=" * 999):
        ids, size = model._encode_words([b" " + text.encode()])
        assert ids.tolist() == library.encode(text) and size.tolist() == [len(ids)]


def test_cache_is_renewed(spark, library, monkeypatch):
    monkeypatch.setattr(pieces, "CACHE", 50)
    model = pieces.Pieces(queries.piece_model())
    for i in range(40):
        words = [f" word{i}x{j}".encode() for j in range(20)]
        slots = model._slots(words)
        for w, s in zip(words, slots):
            ids = model.flat[model.begin[s] : model.begin[s] + model.size[s]].tolist()
            assert ids == library.encode(w.decode()[1:])
    assert len(model.slot) <= 70


def test_other_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    model.ParseFromString(open(queries.piece_model(), "rb").read())
    model.normalizer_spec.remove_extra_whitespaces = True
    path = tmp_path / "other.model"
    path.write_bytes(model.SerializeToString())
    with pytest.raises(ValueError):
        pieces.Pieces(str(path))


def test_query(spark, library, odd, none, tmp_path):
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    found = sorted(queries.op11_pieces(spark, str(tmp_path)).collect(), key=str)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = []
    for r in odd.collect():
        ids = library.encode(r.text or "", add_eos=True)
        want.append((r.doc_id, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids))))
    assert [tuple(r) for r in found] == [w for _, w in sorted((f"Row(doc_id={w[0]}, n_tokens={w[1]}, ids_sha256='{w[2]}', decoded_sha256='{w[3]}')", w) for w in want)]
    assert pieces.decode(pieces.encode(none, queries.piece_model()), queries.piece_model()).count() == 0
