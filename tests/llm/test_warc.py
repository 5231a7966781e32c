"""Round trip through the archives and look-ups in the two-level index."""

import hashlib
import random

from shroud.llm import warc

FIELDS = "page_id long, url string, html string"


def expected(rows):
    payload = [(i, (h or "").encode()) for i, _, h in rows]
    last = {}
    for i, p in payload:
        if len(p) >= 1000 and i is not None:
            last[p] = max(i, last.get(p, i))
    out = []
    for i, p in payload:
        to = last.get(p) if len(p) >= 1000 else None
        out.append((i, len(p), hashlib.sha1(p).hexdigest(), "response" if to is None or to == i else "revisit", None if to == i else to))
    return sorted(out, key=str)


def rows_of(df):
    return sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()], key=str)


def pages():
    rng = random.Random(2)
    big = ["<p>" + "".join(rng.choice("abcé \r\n") for _ in range(n)) for n in (1200, 1500, 40000)]
    rows = [(i, f"http://Host{i % 7}.example.org/p{i % 50}?q", rng.choice(big) if rng.random() < 0.5 else f"<p>{i} " + "x" * rng.randrange(1500)) for i in range(300)]
    return rows + [(300, None, None), (301, "", ""), (304, '"quoted"', "x"), (302, "http://a/\r\nb", "\r\n\r\n" * 300), (303, "http://a/\r\nb", "\r\n\r\n" * 300), (None, "http://n/", big[0]), (5, "http://z/", big[1]), (5, "http://z/", big[1]), (400, "nothing", "short"), (401, "nothing", "short"), (None, None, "z" * 2000), (None, "u", "z" * 2000)]


def test_round_trip(spark, tmp_path):
    rows = pages()
    df = spark.createDataFrame([(*r, "a", 1) for r in rows], FIELDS + ", digest string, length int").repartition(5)
    out = warc.archive(df, f"{tmp_path}/w").cache()
    assert rows_of(out) == expected(rows)
    assert sorted((str(r.page_id), str(r.url)) for r in out.collect()) == sorted((str(i), str(u)) for i, u, _ in rows)


def test_look_ups(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "LINES", 16)
    monkeypatch.setattr(warc, "FILE_BYTES", 20_000)
    rows = [r for r in pages() if r[0] is not None][:301]
    folder = f"{tmp_path}/w"
    captures = warc.write_archives(spark.createDataFrame(rows, FIELDS).repartition(3), folder)
    index = warc.write_index(captures, folder)
    files = [tuple(r) for r in index.select("first_key", "first_id", "file").collect()]
    assert sum(r.captures for r in index.collect()) == len(rows)
    look = warc.Index(folder, files)
    for page, url, html in rows:
        headers, payload = look.capture(warc.reversed_host(url), page)
        assert warc.number(headers["WARC-Record-ID"]) == page
        if headers["WARC-Type"] == "response":
            assert payload == (html or "").encode()
    assert look.find("zzz", 1) is None and look.find("", -5) is None and look.capture("com,example)/", 3) is None


def test_archives_are_gzip_members_of_valid_records(spark, tmp_path):
    import glob
    import gzip

    captures = warc.write_archives(spark.createDataFrame([(1, "http://a/x", "<p>é"), (2, "http://b/", "y")], FIELDS).coalesce(1), f"{tmp_path}/w")
    data = b"".join(gzip.open(f).read() for f in glob.glob(f"{tmp_path}/w/*.warc.gz"))
    assert data.count(b"WARC/1.1\r\n") == 2 and data.endswith(b"\r\n\r\n") and "<p>é".encode() in data
    assert captures.count() == 2


def test_empty_table(spark, tmp_path):
    assert warc.archive(spark.createDataFrame([], FIELDS), f"{tmp_path}/w").collect() == []


def test_reversed_host():
    assert [warc.reversed_host(x) for x in ("http://www.Ex.com/A?b", "http://a.b?x", None, "plain")] == ["com,ex,www)/A?b", "b,a)?x", "", "plain"]
