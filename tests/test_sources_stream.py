"""DOCX ingest, intake checks, streaming."""

import io
import zipfile


def _docx(paragraphs, cells=(), header=None, link=None):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    if cells:
        body += "<w:tbl><w:tr>" + "".join(f"<w:tc><w:p><w:r><w:t>{c}</w:t></w:r></w:p></w:tc>" for c in cells) + "</w:tr></w:tbl>"
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
        if header:
            z.writestr("word/header1.xml", f"<w:hdr {w}><w:p><w:r><w:t>{header}</w:t></w:r></w:p></w:hdr>")
        if link:
            rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/hyperlink"
            z.writestr("word/_rels/document.xml.rels",
                       f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
                       f'<Relationship Id="rId1" Type="{rel}" Target="{link}" TargetMode="External"/></Relationships>')
    return buf.getvalue()


def test_docx_ingest_and_parts(spark, tmp_path):
    from shroud.sources.docs import explode_parts, intake, read_docx

    (tmp_path / "a.docx").write_bytes(_docx(["Name: John Doe", "Email: john@example.com"], cells=["  Cell One ", " "],
                                            header="Confidential - John Doe", link="https://github.com/jdoe"))
    (tmp_path / "b.DOCX").write_bytes(b"not a zip")
    (tmp_path / "c.txt").write_bytes(b"hello")
    docs = {r.name: r for r in intake(read_docx(spark, str(tmp_path)), error="error").collect()}
    assert docs["a.docx"].text == "Name: John Doe\nEmail: john@example.com\nCell One"
    assert docs["a.docx"].reject_reason is None
    assert docs["b.DOCX"].reject_reason == "unparseable"
    assert docs["c.txt"].reject_reason == "not_docx"
    parts = {(r.part, r.ix): r.text for r in explode_parts(spark, str(tmp_path), glob="*.docx").collect()}
    assert parts[("header", 0)] == "Confidential - John Doe"
    assert parts[("hyperlink", 0)] == "https://github.com/jdoe"


def test_stream_matches_batch(spark, tmp_path):
    from shroud.plans.detect import detect
    from shroud.streaming.stream import process_batch

    docs = spark.createDataFrame([(1, "Mail a@b.co or call (555) 867-5309"), (2, "plain")], "doc_id long, text string")
    process_batch(docs, str(tmp_path / "out"))
    out = {r.doc_id: r.total_entities for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = detect(docs).groupBy("doc_id").count().collect()
    assert out[1] == {r.doc_id: r["count"] for r in batch}[1] and out[2] == 0
    process_batch(docs, str(tmp_path / "out"))  # replayed
    process_batch(docs, str(tmp_path / "out"), 1)
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.batch_id, r.doc_id) for r in rows) == [(0, 1), (0, 2), (1, 1), (1, 2)]
    assert len({r.redacted_text for r in rows if r.doc_id == 1}) == 1  # the same replacements in every batch


def test_unreadable_file_is_a_row(spark, tmp_path):
    from shroud.sources.docs import explode_parts

    (tmp_path / "b.docx").write_bytes(b"not a zip")
    assert [(r.part, r.text.split(":")[0]) for r in explode_parts(spark, str(tmp_path)).collect()] == [("error", "parse_error")]


def test_sink_writes_all_tables(spark, tmp_path):
    from shroud.operators import pseudonyms, redact, stats
    from shroud.plans.detect import detect
    from shroud.sources.docs import write_redacted

    docs = spark.createDataFrame([(1, "Mail a@b.co", "cv.docx"), (2, "plain", "x.docx")], "doc_id long, text string, name string")
    found = detect(docs.select("doc_id", "text"))
    mapping = pseudonyms.pseudonym_mapping(found)
    ents = pseudonyms.apply_mapping(found, mapping)
    write_redacted(str(tmp_path / "out"), redact.redact_offsets(docs, ents), ents, mapping, stats.doc_stats(docs, ents))
    read = lambda t: spark.read.parquet(str(tmp_path / "out" / t)).collect()
    assert {r.redacted_name for r in read("documents")} == {"cv_REDACTED.docx", "x_REDACTED.docx"}
    assert len(read("entities")) == len(read("mapping")) == 1 and {r.total_entities for r in read("stats")} == {0, 1}
