"""Sources and sinks (SRC-01..05) and the derived dossier corpus.

* ``read_docs``: any table with an id and a text column (parquet/json/csv/ORC).
* ``read_docx``: ``binaryFile`` + ``mapInPandas`` (stdlib zipfile + ElementTree) -- Python, because
  a DOCX is a zip of XML parts; it runs per file inside the executors, never on the driver.
* ``bucketed``: the documents as a table laid out by ``doc_id``, which detection and redaction read
  without moving a text.
* ``intake``: the upload checks as columns (reject reason instead of an HTTP error).
* ``dossiers``: one synthetic personal dossier per customer, built with plain SQL string
  functions from ``customer`` + ``orders``, so the same text can be rebuilt in any SQL engine.
"""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rules as R


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_docs(spark: SparkSession, path: str, text_col: str = "text", id_col: str = "doc_id",
              fmt: str = "parquet", keep: list[str] | None = None) -> DataFrame:
    """SRC-01: (doc_id, text, *keep) from a table; only the needed columns are scanned."""
    df = spark.read.format(fmt).load(path)
    return df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), *(keep or []))


def bucketed(docs: DataFrame, name: str, buckets: int) -> DataFrame:
    """``docs`` (doc_id, text, ...) as the table ``name`` of the session's warehouse, bucketed and sorted by ``doc_id``.

    Writing it moves the texts once. Every later run has the documents where their spans are sent: the candidates'
    sweeps, the overlap islands and the join of spans and text keep the buckets, and only spans and
    (type, value) pairs are exchanged. A bucket should fit a task (some hundred MB)."""
    docs.repartition(buckets, "doc_id").write.bucketBy(buckets, "doc_id").sortBy("doc_id").mode("overwrite").saveAsTable(name)
    return docs.sparkSession.table(name)


# ------------------------------------------------------------------ DOCX (SRC-02, SRC-05)

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_HYPERLINK = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/hyperlink"


def _para_text(p) -> str:
    out = []
    for el in p.iter():
        if el.tag == _W + "t" and el.text:
            out.append(el.text)
        elif el.tag == _W + "tab":
            out.append("\t")
        elif el.tag in (_W + "br", _W + "cr"):
            out.append("\n")
    return "".join(out)


def _docx_parts(content: bytes) -> list[tuple[str, int, str]]:
    """(part, ix, text) rows: body paragraphs, table cells, headers, footers, hyperlink targets."""
    rows: list[tuple[str, int, str]] = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ET.fromstring(z.read("word/document.xml")).find(_W + "body")
        ix = 0
        for child in list(body) if body is not None else []:
            if child.tag == _W + "p":
                rows.append(("body", ix, _para_text(child)))
                ix += 1
        cell_ix = 0
        for tbl in body.iter(_W + "tbl") if body is not None else []:
            for tc in tbl.iter(_W + "tc"):
                text = "\n".join(_para_text(p) for p in tc.findall(_W + "p"))
                rows.append(("table", cell_ix, text))
                cell_ix += 1
        for name in sorted(z.namelist()):
            for kind in ("header", "footer"):
                if name.startswith(f"word/{kind}") and name.endswith(".xml"):
                    root = ET.fromstring(z.read(name))
                    for k, p in enumerate(root.iter(_W + "p")):
                        rows.append((kind, k, _para_text(p)))
            if name.startswith("word/_rels/") and name.endswith(".rels"):
                root = ET.fromstring(z.read(name))
                for k, rel in enumerate(root):
                    if rel.get("Type") == _HYPERLINK and rel.get("Target"):
                        rows.append(("hyperlink", k, rel.get("Target")))
    return rows


def _docx_text(parts: list[tuple[str, int, str]]) -> str:
    """Body paragraphs, then every non-blank stripped table cell, joined by newlines."""
    body = [t for p, _, t in parts if p == "body"]
    cells = [t.strip() for p, _, t in parts if p == "table" and t.strip()]
    return "\n".join(body + cells)


def _docx_mapper(batches):
    for pdf in batches:
        texts, errors = [], []
        for content in pdf["content"]:
            try:
                texts.append(_docx_text(_docx_parts(bytes(content))))
                errors.append(None)
            except Exception as exc:  # unreadable file: keep the row, report the reason
                texts.append(None)
                errors.append(f"parse_error: {type(exc).__name__}")
        yield pd.DataFrame({"path": pdf["path"], "length": pdf["length"], "text": texts, "error": errors})


def read_docx(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """SRC-02: (doc_id, path, name, length, text, error) for every file under ``path``."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    parsed = raw.select("path", "length", "content").mapInPandas(
        _docx_mapper, "path string, length long, text string, error string")
    return parsed.select(F.xxhash64("path").alias("doc_id"), "path",
                         F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "length", "text", "error")


def _parts_mapper(batches):
    for pdf in batches:
        out = []
        for path, content in zip(pdf["path"], pdf["content"]):
            try:
                for part, ix, text in _docx_parts(bytes(content)):
                    out.append((path, part, ix, text))
            except Exception as exc:  # unreadable file: a row that says so
                out.append((path, "error", 0, f"parse_error: {type(exc).__name__}"))
        yield pd.DataFrame(out, columns=["path", "part", "ix", "text"])


def explode_parts(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """SRC-05: (doc_id, part, ix, text) for body, table cells, headers, footers, hyperlinks."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    parts = raw.select("path", "content").mapInPandas(_parts_mapper, "path string, part string, ix int, text string")
    return parts.select(F.xxhash64("path").alias("doc_id"), "part", "ix", "text")


def intake(df: DataFrame, name: str = "name", length: str = "length", text: str = "text",
           error: str | None = None) -> DataFrame:
    """SRC-03: ``reject_reason`` column: not_docx, too_large, unparseable, empty (null = accepted)."""
    reason = (
        F.when(~F.lower(F.col(name)).endswith(".docx"), "not_docx")
        .when(F.col(length) > R.MAX_UPLOAD_BYTES, "too_large")
    )
    if error is not None:
        reason = reason.when(F.col(error).isNotNull(), "unparseable")
    reason = reason.when(F.col(text).isNull() | ~F.col(text).rlike(r"(?U)\S"), "empty")  # any white space is blank
    return df.withColumn("reject_reason", reason)


def write_redacted(path: str, redacted: DataFrame, entities: DataFrame, mapping: DataFrame, stats: DataFrame,
                   name: str = "name", mode: str = "overwrite") -> None:
    """SRC-04: the tables ``documents`` (with ``<stem>_REDACTED.docx`` names), ``entities``, ``mapping`` and
    ``stats`` under ``path``, as parquet."""
    from ..operators.redact import redacted_name

    out = redacted.withColumn("redacted_name", redacted_name(F.col(name))) if name in redacted.columns else redacted
    for table, df in (("documents", out), ("entities", entities), ("mapping", mapping), ("stats", stats)):
        df.write.mode(mode).parquet(f"{path.rstrip('/')}/{table}")


# ------------------------------------------------------------------ dossier corpus

DOSSIER_OFFSET = 1_000_000_000_000

# FIXED VALUES (own test fixture): name pools and Luhn-valid test card numbers of the dossiers
DOSSIER_FIRST = ["Kavya", "Imran", "Maria", "Oliver", "Ananya", "Lucas", "Priya", "Noah", "Sofia", "Arjun",
                 "Emma", "Rahul", "Chloe", "Vikram", "Hannah", "Diego"]
DOSSIER_LAST = ["Nair", "Qureshi", "Lopez", "Bennett", "Sharma", "Moreau", "Iyer", "Fischer", "Rossi", "Mehta",
                "Carter", "Gupta", "Dubois", "Reddy", "Keller", "Santos"]
DOSSIER_CARDS = ["4111 1111 1111 1111", "5500-0000-0000-0004", "4012888888881881", "5555 5555 5555 4444",
                 "3782 822463 10005", "6011-1111-1111-1117"]
DOSSIER_DOMAINS = ["mailhost.com", "inbox.org", "post.net"]
DOSSIER_STREETS = ["Maple", "Cedar", "Baker", "Elm", "Oak", "Harbor", "Lake", "Hill"]
DOSSIER_COMPANY_WORDS = ["Partners", "Holdings", "Industries", "Enterprises", "Group", "Associates"]


def dossier_sql(customer: str = "customer", orders: str = "orders", dialect: str = "spark") -> str:
    """The dossier corpus as SQL; ``dialect`` only changes list literals (Spark or DuckDB)."""
    def arr(xs):
        body = ", ".join("'" + x + "'" for x in xs)
        return f"array({body})" if dialect == "spark" else f"[{body}]"

    def at(a, i):
        return f"element_at({a}, CAST({i} AS INT))" if dialect == "spark" else f"list_extract({a}, {i})"

    k = "c.c_custkey"
    first = at(arr(DOSSIER_FIRST), f"1 + {k} % 16")
    last = at(arr(DOSSIER_LAST), f"1 + CAST(FLOOR({k} / 16) AS BIGINT) % 16")
    first2 = at(arr(DOSSIER_FIRST), f"1 + ({k} + 5) % 16")
    last2 = at(arr(DOSSIER_LAST), f"1 + ({k} + 3) % 16")
    seg = "upper(substr(c.c_mktsegment, 1, 1)) || lower(substr(c.c_mktsegment, 2))"
    def lp(x, n):
        return f"lpad(CAST({x} AS STRING), {n}, '0')"

    months = arr(R.MONTHS)
    mm = f"(1 + {k} % 12)"
    dd = f"(1 + {k} % 28)"
    yy = f"(1950 + {k} % 50)"
    dob = (f"CASE {k} % 3 WHEN 0 THEN 'Date of birth: ' || {lp(mm, 2)} || '/' || {lp(dd, 2)} || '/' || CAST({yy} AS STRING) "
           f"WHEN 1 THEN 'Born on ' || CAST({dd} AS STRING) || 'th ' || {at(months, mm)} || ' ' || CAST({yy} AS STRING) "
           f"ELSE 'DOB: ' || CAST({yy} AS STRING) || '-' || {lp(mm, 2)} || '-' || {lp(dd, 2)} END")
    lines = [
        f"{first} || ' ' || {last}",
        f"'Name: ' || {first} || ' ' || {last}",
        f"'Email: ' || lower({first}) || '.' || lower({last}) || CAST({k} AS STRING) || '@' || {at(arr(DOSSIER_DOMAINS), f'1 + {k} % 3')}",
        f"'Phone: (' || CAST(200 + {k} % 800 AS STRING) || ') ' || {lp(f'({k} * 7) % 1000', 3)} || '-' || {lp(f'{k} % 10000', 4)}",
        f"'Mobile: +91-9' || {lp(f'({k} * 7919) % 1000000000', 9)}",
        f"'SSN: ' || CAST(100 + {k} % 500 AS STRING) || '-' || {lp(f'1 + {k} % 98', 2)} || '-' || {lp(f'1 + {k} % 9998', 4)}",
        dob,
        f"'Address: ' || CAST(1 + {k} % 9000 AS STRING) || ' ' || {at(arr(DOSSIER_STREETS), f'1 + {k} % 8')} || ' Street, Springfield, IL ' || CAST(10000 + {k} % 89999 AS STRING)",
        f"'Card: ' || {at(arr(DOSSIER_CARDS), f'1 + {k} % 6')}",
        f"'Server IP: 10.' || CAST({k} % 256 AS STRING) || '.' || CAST(CAST(FLOOR({k} / 256) AS BIGINT) % 256 AS STRING) || '.' || CAST(1 + {k} % 254 AS STRING)",
        "'Software version 91.211.49.166 is installed.'",
        f"'Invoice ' || CAST(coalesce(o.first_order, 0) AS STRING) || ' covers ' || CAST(coalesce(o.n_orders, 0) AS STRING) || ' orders.'",
        f"'Employed by ' || {seg} || ' ' || {at(arr(DOSSIER_COMPANY_WORDS), f'1 + {k} % 6')} || ' Pvt Ltd for ' || CAST({k} % 20 AS STRING) || ' years.'",
        f"'Dr. ' || {first2} || ' ' || {last2} || ' reviewed the file.'",
        "''",
        "'TECHNICAL SKILLS'",
        "'Spring Boot'",
        "'Data Structures'",
        "''",
        "'PROJECTS'",
        "'Kisan Platform'",
        "''",
        "'NOTES'",
        f"'Desk ' || CAST(4000 + {k} % 999 AS STRING) || '.' || CAST(10000 + {k} % 89999 AS STRING)",
        f"'Tax id ' || CAST(100 + {k} % 500 AS STRING) || {lp(f'1 + {k} % 98', 2)} || {lp(f'1 + {k} % 9998', 4)}",
        f"'Gateway 2001:db8:0:0:0:0:0:' || CAST(1 + {k} % 9 AS STRING)",
        f"'Mirror http://10.1.2.' || CAST({k} % 250 AS STRING) || '/a'",
        f"'Docs at http://x.io/a and 2001:db8:0:0:0:0:1:' || CAST(1 + {k} % 9 AS STRING)",
        f"'Mail to PO Box ' || CAST(10 + {k} % 90 AS STRING) || ', Springfield'",
        f"'PIN: ' || CAST(560001 + {k} % 99 AS STRING)",
        "'Mr Java Spring met them.'",
        "'Dr Alan Turing: notes'",
        "'Mr Henry Oak Drive'",
        f"'Oxford University Press Ltd signed.'",
        f"'1.7 12 Oak Street, Springfield, IL ' || CAST(10000 + {k} % 89999 AS STRING)",
        f"'Contact: Maria Lopez' || CAST({k} AS STRING) || '@post.net'",
        f"'Contact: Maria Lopez@post.net'",
    ]
    text = " || chr(10) || ".join(f"({x})" for x in lines)
    return (
        f"SELECT CAST({k} + {DOSSIER_OFFSET} AS BIGINT) AS doc_id, {text} AS text "
        f"FROM {customer} c LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS first_order, count(*) AS n_orders "
        f"FROM {orders} GROUP BY o_custkey) o ON o.o_custkey = c.c_custkey"
    )


def dossiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived dossier corpus (doc_id, text): one per customer, built by Spark SQL.

    A customer's row is short and its dossier long, so the splits of the table would leave the texts, and all that is
    done with them, to a few tasks: the rows are dealt out before the texts are built."""
    parts = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    read_table(spark, sf_dir, "customer").repartition(parts, "c_custkey").createOrReplaceTempView("_shroud_customer")
    read_table(spark, sf_dir, "orders").createOrReplaceTempView("_shroud_orders")
    return spark.sql(dossier_sql("_shroud_customer", "_shroud_orders"))


PAGES_OFFSET = 2_000_000_000_000


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw web pages as documents (doc_id = 2*10^12 + page_id, text = html)."""
    p = read_table(spark, sf_dir, "pages")
    return p.select((F.col("page_id") + F.lit(PAGES_OFFSET)).alias("doc_id"), F.col("html").alias("text"))


def corpus(spark: SparkSession, sf_dir: str, with_dossiers: bool = True) -> DataFrame:
    """The detection input: ``documents``, the raw ``pages`` and the dossiers (disjoint doc_id ranges)."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(pages(spark, sf_dir))
    return docs.unionByName(dossiers(spark, sf_dir)) if with_dossiers else docs
