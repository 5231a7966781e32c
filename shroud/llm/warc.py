"""WARC archives with a two-level capture index.

Writing: every task writes gzip members, one per record, into archive files of a bounded size in the
shared folder, under names of its own; the index rows it returns name the file, offset and length, so a
retried task leaves at most files that no row names. Records of equal payloads of ``LEAST`` bytes or
more: the one with the largest id is a response, the others are revisits without a payload.

Index: the rows are range-partitioned and sorted by the reversed-host key of their url and the id, and
written as compressed blocks of ``LINES`` lines. Each index file ends with its sparse directory (first
key, offset and length of every block), found from a fixed-size tail; the list of index files with their
first keys is the upper level. A look-up bisects the files, then the directory, reads one block by its
range and then one record by its range.

Reading back: every archive is parsed from its bytes, digests are taken from the payloads, and each
revisit is resolved through the index to its response.

Edge cases: a null html is an empty payload; a null url has an empty key; rows with an equal largest id
and payload are all responses; a null id never becomes the largest, and such rows are responses if no
other id has the payload; payloads of any length are written whole; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shroud.llm.common import shared_dir, written

LEAST = 1000  # bytes from which equal payloads become revisits
FILE_BYTES = 256 << 20  # an archive is closed beyond this size
LINES = 1000  # index lines in a block
DATE = "2020-01-01T00:00:00Z"  # the capture date is not in the data; a fixed one keeps archives reproducible
TAIL = "<QQ"  # offset and length of the directory, at the end of an index file

HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"


def store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a folder; a plain path is a local one."""
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def reversed_host(url: str | None) -> str:
    """``com,example,www)/path`` of ``http://www.Example.com/path``: captures of a domain sort together."""
    _, sep, rest = (url or "").partition("://")
    if not sep:
        return url or ""
    cut = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
    return ",".join(reversed(rest[:cut].lower().split("."))) + ")" + rest[cut:]


def identity(number) -> str:
    return f"<urn:page:{'null' if number is None else number}>"


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to, refers_url: str | None) -> bytes:
    """A WARC/1.1 record; a revisit carries the HTTP header alone."""
    head = HTTP.format(len(payload)).encode()
    revisit = refers_to is not None
    block = head if revisit else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {identity(page_id)}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}"]
    if url is not None:  # one that would break the header, or look quoted, is quoted
        lines.append(f"WARC-Target-URI: {json.dumps(url) if url.startswith(chr(34)) or not url.isprintable() else url}")
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {identity(refers_to)}", f"WARC-Refers-To-Target-URI: {json.dumps(refers_url)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """The headers and the payload of a record."""
    at = data.index(b"\r\n\r\n")
    headers = dict(x.split(": ", 1) for x in data[:at].decode("utf-8", "replace").split("\r\n")[1:])
    block = data[at + 4 : at + 4 + int(headers["Content-Length"])]
    return headers, block[block.index(b"\r\n\r\n") + 4 :]


def target(headers: dict[str, str]) -> str | None:
    """The url of a record."""
    url = headers.get("WARC-Target-URI")
    return json.loads(url) if url and url.startswith('"') else url


def number(name: str) -> int | None:
    text = name[len("<urn:page:") : -1]
    return None if text == "null" else int(text)


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) as archives; the index rows (page_id, key, file, offset, length)."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    size = F.octet_length("html")
    # digests of several records; their payloads stay where they are
    several = rows.where(size >= LEAST).groupBy("digest").agg(F.count("*").alias("n"), F.max("page_id").alias("last"), F.max_by("url", "page_id").alias("last_url")).where("n > 1 and last is not null")
    # short payloads never match and must not meet under one null key
    joined = rows.withColumn("same", F.when(size >= LEAST, F.col("digest")).otherwise(F.concat(F.lit("-"), F.coalesce(F.col("page_id").cast("string"), F.col("url"), F.lit("")))))
    joined = joined.join(several.select(F.col("digest").alias("same"), "last", "last_url"), "same", "left")
    joined = joined.select("page_id", "url", "html", "digest", F.when(F.col("page_id").eqNullSafe(F.col("last")), None).otherwise(F.col("last")).alias("last"), "last_url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = store(folder)
        system.create_dir(root, recursive=True)
        out, name, size = None, "", 0
        try:
            for b in batches:
                rows = []
                for page, url, html, digest, last, last_url in zip(*(b[c].to_pylist() for c in ("page_id", "url", "html", "digest", "last", "last_url"))):
                    if out is None:
                        name, size = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = system.open_output_stream(f"{root}/{name}", compression=None)
                    member = gzip.compress(record(page, url, html.encode("utf-8"), digest, last, last_url), 4, mtime=0)
                    out.write(member)
                    rows.append((page, reversed_host(url), name, size, len(member)))
                    size += len(member)
                    if size > FILE_BYTES:
                        out.close()
                        out = None
                kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 5, kinds)], names=["page_id", "key", "file", "offset", "length"])
        finally:
            if out is not None:
                out.close()

    return written(joined.mapInArrow(run, "page_id bigint, key string, file string, offset bigint, length bigint"), "captures")


def write_index(captures: DataFrame, folder: str) -> DataFrame:
    """Writes the sorted index files; the upper level (first_key, first_id, file, captures)."""
    ordered = captures.repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = store(folder)
        out, name, size, total, lines, directory, first = None, f"{uuid.uuid4().hex}.idx", 0, 0, [], [], None

        def block():
            nonlocal size, lines
            data = gzip.compress("\n".join(json.dumps(x) for x in lines).encode(), 4, mtime=0)
            directory.append([lines[0][0], lines[0][1], size, len(data)])
            out.write(data)
            size += len(data)
            lines = []

        for b in batches:
            for key, page, file, offset, length in zip(*(b[c].to_pylist() for c in ("key", "page_id", "file", "offset", "length"))):
                if out is None:
                    system.create_dir(root, recursive=True)
                    out, first = system.open_output_stream(f"{root}/{name}", compression=None), (key, page)
                lines.append([key, page, file, offset, length])
                total += 1
                if len(lines) == LINES:
                    block()
        if out is not None:
            if lines:
                block()
            data = gzip.compress(json.dumps(directory).encode(), 4, mtime=0)
            out.write(data)
            out.write(struct.pack(TAIL, size, len(data)))
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([first[0]], pa.string()), pa.array([first[1]], pa.int64()), pa.array([name], pa.string()), pa.array([total], pa.int64())], names=["first_key", "first_id", "file", "captures"])

    return written(ordered.mapInArrow(run, "first_key string, first_id bigint, file string, captures bigint"), "index")


def rank(key: str, page) -> tuple:
    """Spark's order: by the key's UTF-8 bytes, nulls first."""
    return key.encode("utf-8", "surrogatepass"), page is not None, page or 0


class Index:
    """Look-ups in the index files of a folder; ``files``: the upper level, sorted by first key."""

    def __init__(self, folder: str, files: list[tuple]):
        self.system, self.root = store(folder)
        self.files = sorted(files, key=lambda x: rank(x[0], x[1]))
        self.firsts = [rank(x[0], x[1]) for x in self.files]
        self.directories: dict[str, tuple[list, list]] = {}
        self.block: tuple[tuple, list] | None = None
        self.reads = 0

    def _range(self, name: str, offset: int, length: int) -> bytes:
        self.reads += 1
        with self.system.open_input_file(f"{self.root}/{name}") as f:
            return f.read_at(length, offset)

    def _directory(self, name: str) -> tuple[list, list]:
        if name not in self.directories:
            if len(self.directories) >= 64:  # a cache
                self.directories.clear()
            with self.system.open_input_file(f"{self.root}/{name}") as f:
                end = f.size()
                offset, length = struct.unpack(TAIL, f.read_at(struct.calcsize(TAIL), end - struct.calcsize(TAIL)))
                rows = json.loads(gzip.decompress(f.read_at(length, offset)))
            self.directories[name] = rows, [rank(x[0], x[1]) for x in rows]
        return self.directories[name]

    def find(self, key: str, page) -> list | None:
        """The line (key, page_id, file, offset, length) of a capture, or None."""
        want = rank(key, page)
        at = bisect.bisect_right(self.firsts, want) - 1
        if at < 0:
            return None
        rows, firsts = self._directory(self.files[at][2])
        row = rows[bisect.bisect_right(firsts, want) - 1]
        place = (self.files[at][2], row[2], row[3])
        if self.block is None or self.block[0] != place:
            self.block = place, [json.loads(x) for x in gzip.decompress(self._range(*place)).decode().split("\n")]
        lines = self.block[1]
        i = bisect.bisect_left(lines, want, key=lambda x: rank(x[0], x[1]))
        return lines[i] if i < len(lines) and rank(lines[i][0], lines[i][1]) == want else None

    def capture(self, key: str, page) -> tuple[dict[str, str], bytes] | None:
        line = self.find(key, page)
        return None if line is None else parse(gzip.decompress(self._range(*line[2:])))


def read_archives(captures: DataFrame, index: DataFrame, folder: str) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to) of every record of the archives.

    A task reads whole runs of an archive; the revisits are then sorted by their response's key and resolved
    through the index, a block and a record at a time.
    """
    spark = captures.sparkSession
    spans = captures.select("file", "offset", "length").repartition("file", F.floor(F.col("offset") / (8 << 20))).sortWithinPartitions("file", "offset")

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = store(folder)
        open_, name = None, None
        for b in batches:
            rows = []
            for file, offset, length in zip(*(b[c].to_pylist() for c in ("file", "offset", "length"))):
                if file != name:
                    if open_ is not None:
                        open_.close()
                    open_, name = system.open_input_file(f"{root}/{file}"), file
                headers, payload = parse(gzip.decompress(open_.read_at(length, offset)))
                kind = headers["WARC-Type"]
                digest = hashlib.sha1(payload).hexdigest() if kind == "response" else headers["WARC-Payload-Digest"][5:]
                source = json.loads(headers["WARC-Refers-To-Target-URI"]) if kind == "revisit" else None
                rows.append((number(headers["WARC-Record-ID"]), target(headers), len(payload) if kind == "response" else None, digest, kind,
                             number(headers["WARC-Refers-To"]) if kind == "revisit" else None, reversed_host(source) if kind == "revisit" else None))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 7, kinds)], names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "target"])
        if open_ is not None:
            open_.close()

    fields = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, target string"
    records = written(spans.mapInArrow(parsed, fields), "records")
    # a row per index file, not per capture
    files = [tuple(r) for r in index.select("first_key", "first_id", "file").collect()]
    shared = spark.sparkContext.broadcast(files)
    wanted = records.where("record_type = 'revisit'").select("target", "refers_to").distinct().repartitionByRange("target", "refers_to").sortWithinPartitions("target", "refers_to")

    def resolved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = Index(folder, shared.value)
        for b in batches:
            rows = []
            for target, page in zip(b["target"].to_pylist(), b["refers_to"].to_pylist()):
                found = look.capture(target, page)
                if found is not None:
                    rows.append((target, page, len(found[1]), hashlib.sha1(found[1]).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 4, [pa.string(), pa.int64(), pa.int64(), pa.string()])], names=["target", "refers_to", "size", "sum"])

    sizes = wanted.mapInArrow(resolved, "target string, refers_to bigint, size bigint, sum string")
    # a row's own join key: responses have none and must not meet under one null key
    keyed = records.withColumn("own", F.when(F.col("record_type") == "revisit", F.col("refers_to")).otherwise(F.xxhash64("payload_digest", "page_id")))
    keyed = keyed.withColumn("to", F.coalesce("target", F.lit("\x00")))
    out = keyed.join(sizes.select(F.col("refers_to").alias("own"), F.col("target").alias("to"), "size", "sum"), ["own", "to"], "left")
    return out.select("page_id", "url", F.coalesce("payload_bytes", "size").alias("payload_bytes"), F.coalesce("sum", "payload_digest").alias("payload_digest"), "record_type", "refers_to")


def archive(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes archives and index of ``pages`` under ``folder`` (default: the shared one), and reads them back."""
    folder = folder or f"{shared_dir(pages.sparkSession).rstrip('/')}/warc-{uuid.uuid4().hex}"
    captures = write_archives(pages, folder)
    return read_archives(captures, write_index(captures, folder), folder)
