"""Recall on edited copies, exact verification against a plain edit distance, odd rows."""

import random

import numpy as np
import pyarrow as pa

from shroud.llm import decontam
from shroud.llm.text import slices

rng = random.Random(11)
VOCABULARY = [f"word{i}" for i in range(2000)] + ["the", "of", "and", "to"] * 150
ITEMS = [(i, " ".join(rng.choice(VOCABULARY) for _ in range(rng.randrange(15, 55)))) for i in range(60)]


def prose(n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def edited(text, edits):
    w = text.split()
    for _ in range(edits):
        i, kind = rng.randrange(len(w)), rng.randrange(3)
        if kind == 0:
            w[i] = "changed"
        elif kind == 1:
            del w[i]
        else:
            w.insert(i, "added")
    return " ".join(w)


def plain(item, text):
    """Fewest edits between the item and a run of the text."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item):
        new = [i + 1]
        for j, y in enumerate(text):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_distance_equals_the_plain_one():
    local = np.random.default_rng(2)
    for _ in range(50):
        a, b = local.integers(0, 4, local.integers(1, 12)).astype(np.uint64), local.integers(0, 4, local.integers(1, 20)).astype(np.uint64)
        assert decontam.distance(a, b)[0] == plain(a.tolist(), b.tolist())


def test_recall_and_precision(spark):
    rows, want = [], set()
    for i, text in ITEMS:
        for share in (0, 0.05, 0.1, 0.15):
            rows.append((len(rows), prose(rng.randrange(80)) + " " + edited(text, int(share * len(text.split()))).upper() + ". " + prose(50)))
            want.add((rows[-1][0], i))
    for _ in range(100):  # clean, and with a third of an item
        rows.append((len(rows), prose(200)))
        part = rng.choice(ITEMS)[1].split()
        rows.append((len(rows), prose(50) + " " + " ".join(part[: len(part) // 3]) + " " + prose(50)))
    found = decontam.matches(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")).collect()
    got = {(r.doc_id, r.item_id) for r in found}
    assert got <= want and len(got) >= 0.99 * len(want)
    texts = dict(rows)
    words = lambda t: "".join(c if c.isalnum() else " " for c in t.lower()).split()
    for r in found[:40]:
        assert r.edits == plain(words(dict(ITEMS)[r.item_id]), words(texts[r.doc_id])[:])
        span = texts[r.doc_id][r.start_char : r.end_char]
        assert plain(words(dict(ITEMS)[r.item_id]), words(span)) <= r.edits


def test_blocks_give_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([(i, prose(30) + " " + t + " " + prose(30)) for i, t in ITEMS[:20]] + [(100, prose(90))], "doc_id long, text string")
    items = spark.createDataFrame(ITEMS[:20], "item_id long, text string")
    monkeypatch.setattr(decontam, "BLOCK_WORDS", 120)
    assert {(r.doc_id, r.item_id, r.edits) for r in decontam.matches(docs, items).collect()} == {(i, i, 0) for i, _ in ITEMS[:20]}
    assert [r.doc_id for r in decontam.clean(docs, items).collect()] == [100]


def test_odd_rows(spark, odd, none):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "!!!"), (4, "one two"), (4, "one two"), (None, "end")], "item_id long, text string")
    got = decontam.matches(odd, items).collect()
    assert sorted((r.doc_id, r.item_id or 0) for r in got) == [(6, 4), (6, 4), (7, 4), (7, 4), (9, 0)]
    left = decontam.clean(odd, items)
    assert left.columns == odd.columns and left.count() == odd.count() - 3
    assert decontam.matches(none, items).count() == 0 and decontam.matches(odd, none.selectExpr("doc_id as item_id", "text")).count() == 0


def test_size_classes_hold_an_aligned_window():
    for n in range(1, 200):
        w = decontam.size_class(n)
        assert w + max(1, w // 2) - 1 <= n


def test_non_ascii_spans():
    block = decontam.Items([(1, "été où ça naïve élève cœur forêt")], 0.2)
    for t in slices(pa.array(["Là — ééé. Été où ça naïve élève cœur forêt! fin"])):
        (doc, item, edits, _, lo, hi), = block.search(t)
        assert t.buf[lo:hi].tobytes().decode().startswith(("Été", "été", "où")) and t.buf[lo:hi].tobytes().decode().endswith("forêt")


FOREIGN = {
    1: "北京大学的研究人员昨天发现了一种可以在常温下保存的新材料并且公布了全部数据",
    2: "このモデルは去年の夏に東京で開かれた会議で初めて発表されたものである",
    3: "นักวิจัยพบว่าวัสดุใหม่นี้สามารถเก็บรักษาได้ที่อุณหภูมิห้องเป็นเวลานาน",
    4: "Die große Straße führt über den Fluss an der alten Mühle vorbei zum schönen Schloss",
    5: "Исследователи обнаружили что новая модель лучше решает задачи чем старая версия",
    6: "Οι ερευνητές βρήκαν ότι το νέο μοντέλο λύνει καλύτερα τα προβλήματα από το παλιό",
}


def test_words_of_every_script(spark):
    """Exact copies in other dress: no blanks, other blanks, quotes, dashes, case, width, composition, hidden characters."""
    import unicodedata

    latin = FOREIGN[4]
    full = "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in "the whole item in full width letters of another keyboard")
    items = [*FOREIGN.items(), (7, "the whole item in full width letters of another keyboard")]
    copies = [(1, f"新闻：{FOREIGN[1]}。其他内容"), (1, " ".join(FOREIGN[1])), (1, f"前面的文字很多{FOREIGN[1]}后面的文字"), (2, f"今日は{FOREIGN[2]}。終わり"), (3, f"ข่าว{FOREIGN[3]}ครับ"),
              (4, latin.replace(" ", "\u00a0")), (4, latin.replace(" ", "\u3000")), (4, latin.replace(" ", "—")), (4, " ".join(f"“{w}”" for w in latin.split())), (4, latin.upper()),
              (4, unicodedata.normalize("NFD", latin)), (4, latin.replace("ü", "ü\u00ad").replace(" ", " \ufeff")), (4, latin.replace(" ", "\u200b")), (4, latin.replace(" ", "…")),
              (5, FOREIGN[5].upper()), (6, FOREIGN[6].upper()), (7, full), (7, full.upper())]
    docs = [(i, f"{prose(20)} {text} {prose(20)}") for i, (_, text) in enumerate(copies)] + [(900 + i, prose(60) + "。今天天气很好我们去公园") for i in range(20)]
    found = decontam.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r.doc_id, r.item_id): r for r in found}
    assert set(got) == {(i, item) for i, (item, _) in enumerate(copies)}
    assert {k for k, r in got.items() if r.edits} <= {(i, item) for i, (item, _) in enumerate(copies) if item in (6,)}  # a final sigma has no upper case of its own
    texts = dict(docs)
    for (i, item), r in got.items():
        span = texts[i][r.start_char : r.end_char]
        joined = lambda x: [w for part in x.split() for w, _, _ in decontam.unicode_words(part.encode())]
        assert r.edits or joined(span) == joined(dict(items)[item]), span


def test_words_and_places():
    cases = {"ab—cd": ["ab", "cd"], "naïve": ["nai\u0308ve"], "ﬁne": ["fine"], "x\u00ady": ["xy"], "中文ab字": ["中", "文", "ab", "字"], "…": [], "Straße": ["strasse"], "\u200b": [], "a\u0301": ["a\u0301"], "２０": ["20"]}
    for raw, want in cases.items():
        found = decontam.unicode_words(raw.encode())
        assert [w for w, _, _ in found] == want
        joined = raw.encode()
        assert all(joined[a:b].decode() for _, a, b in found)
    broken = b"ab\xffcd \xc3"
    assert [(w, a, b) for w, a, b in decontam.unicode_words(broken[:5])] == [("ab", 0, 2), ("cd", 3, 5)]


def test_recall_at_every_length(spark):
    """A fifth of edits: substitutions, deletions, insertions and all of them, from 5 to 1,000 words, through the query."""
    lengths = [5, 6, 7, 8, 10, 12, 15, 20, 23, 25, 32, 45, 47, 60, 90, 96, 110, 130, 160, 200, 300, 450, 700, 1000]
    local = random.Random(21)
    word = lambda: f"w{local.randrange(3000)}"
    items, docs, want = [], [], {}
    for n in lengths:
        copies = 24 if n <= 200 else 8
        for kind in ("substitute", "delete", "insert", "mixed"):
            for _ in range(copies):
                item = [word() for _ in range(n)]
                items.append((len(items), " ".join(item)))
                copy, places = list(item), sorted(local.sample(range(n), n // 5), reverse=True)
                for i in places:
                    how = kind if kind != "mixed" else local.choice(("substitute", "delete", "insert"))
                    copy[i : i + 1] = {"substitute": ["changed"], "delete": [], "insert": [copy[i], "added"]}[how]
                want.setdefault((n, kind), set()).add((len(docs), len(items) - 1))
                docs.append((len(docs), " ".join([*(word() for _ in range(local.randrange(40))), *copy, *(word() for _ in range(20))])))
    found = decontam.matches(spark.createDataFrame(docs, "doc_id long, text string").repartition(8), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r.doc_id, r.item_id) for r in found}
    recall = {k: len(v & got) / len(v) for k, v in want.items()}
    print(recall)
    for n in lengths:
        together = [want[n, k] for k in ("substitute", "delete", "insert", "mixed")]
        assert sum(len(v & got) for v in together) >= 0.95 * sum(map(len, together)), (n, {k: r for k, r in recall.items() if k[0] == n})
