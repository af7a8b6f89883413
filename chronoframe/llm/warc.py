"""WARC archives: writing with revisit records, and a salvage reader.

Writer: one record a page, each a gzip member of its own, in files of about
``FILE_BYTES``. Payloads of at least ``REVISIT_BYTES`` that occur more than once
are written once (with the largest page_id); the others are revisit records that
refer to it and carry the HTTP header alone.

Reader: each member and record is checked (gzip checksum, version line, header,
length, end of record, block and payload digest). After a failed check it looks
for the next member that decompresses to a version line, or in plain files for
the next version line, goes on from there and logs the bytes in between as a gap.
It holds a record and about a chunk of the file at a time.

Files are written under a name of the task's attempt, and only names that a
successful attempt has returned are read, so lost executors leave nothing behind
that is read twice. Tasks reach the shared folder through ``pyarrow.fs``.

Cases: null html is an empty payload; null urls and page_ids are written as
absent and read back as null; pages that tie on the largest page_id of a payload
are all responses; no pages give no files; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import by_split, fresh_dir, materialize, read_part, store

REVISIT_BYTES, FILE_BYTES, DATE = 1000, 16 << 20, "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_START = re.compile(rb"WARC/1\.[01]\r\n|\x1f\x8b\x08")
_ID = "urn:page:"


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to=None, revisit: bool = False) -> bytes:
    """A response record, or a revisit record without the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{_ID}{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        *([] if url is None else [f"WARC-Target-URI: {quote(url, safe=';/?:@&=+$,#%!*()~')}"]),
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}",
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{_ID}{refers_to}>"] if revisit else []),
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 3) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


@dataclass
class Record:
    headers: dict[str, str]
    http: bytes
    payload: bytes
    at: int

    @property
    def page_id(self) -> str | None:
        return self.headers.get("warc-record-id", "").strip("<>").removeprefix(_ID) or None

    @property
    def refers_to(self) -> str | None:
        return self.headers.get("warc-refers-to", "").strip("<>").removeprefix(_ID) or None

    @property
    def payload_bytes(self) -> int:
        """Of the full payload: a revisit record has it in its HTTP header."""
        found = re.search(rb"(?i)\r\ncontent-length: *(\d+)", self.http)
        return int(found[1]) if found else len(self.payload)

    @property
    def digest(self) -> str:
        return self.headers.get("warc-payload-digest", "").removeprefix("sha1:")


class Source:
    """Bytes from anywhere in a file (or a bytes object), about ``CHUNK`` held at a time."""

    CHUNK = 1 << 20

    def __init__(self, data, size: int | None = None):
        self.file = None if isinstance(data, bytes) else data
        self.held, self.at = (data, 0) if self.file is None else (b"", 0)
        self.size = len(data) if self.file is None else size

    def get(self, at: int, n: int) -> bytes:
        """``n`` bytes from ``at`` on, fewer at the end."""
        lo = at - self.at
        if self.file is not None and not 0 <= lo <= lo + min(n, self.size - at) <= len(self.held):
            self.file.seek(at)
            self.held, self.at, lo = self.file.read(max(n, self.CHUNK)), at, 0
        return self.held[lo : lo + n]


def parse(src: Source, at: int) -> tuple[Record, int] | None:
    """The record that begins at ``at`` and its end, or None if a check fails."""
    head, colons, _ = src.get(at, 65536).partition(b"\r\n\r\n")
    if not colons or not _VERSION.match(head + b"\r\n"):
        return None
    headers = {}
    for line in head.split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        headers[name.decode("latin-1").lower()] = value.strip().decode("utf-8", "replace")
    length = headers.get("content-length", "")
    if not (length.isascii() and length.isdigit() and len(length) < 19):
        return None
    begin = at + len(head) + 4
    end = begin + int(length)
    if end + 4 > src.size or src.get(end, 4) != b"\r\n\r\n":  # before the block itself is read
        return None
    block = src.get(begin, end - begin)
    if "warc-block-digest" in headers and headers["warc-block-digest"] != "sha1:" + hashlib.sha1(block).hexdigest():
        return None
    http, _, payload = block.partition(b"\r\n\r\n")
    out = Record(headers, http, payload, at)
    if headers.get("warc-type") == "response" and "warc-payload-digest" in headers:
        if headers["warc-payload-digest"] != "sha1:" + hashlib.sha1(payload).hexdigest() or out.payload_bytes != len(payload):
            return None
    return out, end + 4


def _inflate(src: Source, at: int) -> tuple[bytes, int] | None:
    """A whole gzip member and its end; None if it is broken or cut."""
    z, out, step = zlib.decompressobj(31), [], 1 << 12
    try:
        while not z.eof:
            some = src.get(at, step)
            if not some:
                return None
            out.append(z.decompress(some))
            at, step = at + len(some), min(2 * step, Source.CHUNK)
    except zlib.error:
        return None
    return b"".join(out), at - len(z.unused_data)


def _member_records(data: bytes, at: int) -> tuple[list[Record], bool]:
    """The records of a member, and whether all of it is good."""
    src, inside, found = Source(data), 0, []
    while inside < len(data):
        r = parse(src, inside)
        if not r:
            return found, False
        found.append(Record(r[0].headers, r[0].http, r[0].payload, at))
        inside = r[1]
    return found, True


def _next(src: Source, at: int) -> int:
    """Where the next member that holds a record, or the next version line, begins; the file's end without one.

    The file is searched a chunk at a time, so a false start costs what it is, not
    what follows it.
    """
    while at < src.size:
        some = src.get(at, Source.CHUNK)
        for m in _START.finditer(some):
            here = at + m.start()
            if m[0][0] != 0x1F:
                return here
            try:
                if _VERSION.match(zlib.decompressobj(31).decompress(src.get(here, 4096), 64)):
                    return here
            except zlib.error:
                pass
        if len(some) < Source.CHUNK:
            break
        at += len(some) - 16  # a start can lie across chunks
    return src.size


def salvage(data, size: int | None = None) -> Iterator[tuple[Record | None, tuple[int, int] | None]]:
    """(record, None) for each good record, (None, (from, to)) for each gap in the file's bytes.

    ``data``: bytes, or a file that can seek and its size.
    """
    src, at = Source(data, size), 0
    while at < src.size:
        if src.get(at, 3) == b"\x1f\x8b\x08":
            got = _inflate(src, at)
            found, good = _member_records(got[0], at) if got else ([], False)
            yield from ((r, None) for r in found)
            if good:
                at = got[1]
                continue
        elif r := parse(src, at):
            yield r[0], None
            at = r[1]
            continue
        begin, at = at, _next(src, at + 1)
        yield None, (begin, at)


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def tops(rows: DataFrame) -> DataFrame:
    """From (page_id, html, _split): split, digest, top for payloads that occur more than once; the payloads stay where they are."""
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    known = rows.select("page_id", F.col("_split").alias("split"), F.sha1(body).alias("digest"), F.octet_length(body).alias("size")).where(F.col("size") >= REVISIT_BYTES)
    seen = materialize(known.groupBy("split", "digest").agg(F.max("page_id").alias("top"), F.count(F.lit(1)).alias("n")), "warc-seen")
    top = seen.groupBy("digest").agg(F.max("top").alias("top"), F.sum("n").alias("n")).where("n > 1").select("digest", "top")
    return seen.select("split", "digest").join(top, "digest")


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Write the archives; the files and their record counts."""
    spark = pages.sparkSession
    rows = by_split(pages, "page_id", "url", "html")
    told = fresh_dir(spark, "warc-tops")
    store(tops(rows), told, "split", parts=int(spark.conf.get("spark.sql.shuffle.partitions")))

    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, base = _filesystem(folder)
        fs.create_dir(base, recursive=True)
        parts, size, n, made, where, top = [], 0, 0, 0, None, {}

        def close():
            name = f"{base}/pages-{task.partitionId():06d}-{task.taskAttemptId()}-{made:05d}.warc.gz"
            with fs.open_output_stream(name, compression=None) as out:
                for p in parts:
                    out.write(p)
            return pa.RecordBatch.from_pydict({"path": [name], "records": [n], "bytes": [size]})

        for b in batches:
            for lo in range(0, b.num_rows, 256):
                for page_id, url, html, split in zip(*(c.to_pylist() for c in b.slice(lo, 256).columns)):
                    if split != where:
                        said = read_part(told, "split", split, ["digest", "top"])
                        where, top = split, dict(zip(*(c.to_pylist() for c in said.columns))) if said else {}
                    payload = (html or "").encode()
                    digest = hashlib.sha1(payload).hexdigest()
                    first = top.get(digest)
                    data = member(record(page_id, url, payload, digest, first, first is not None and page_id != first))
                    parts.append(data)
                    size += len(data)
                    n += 1
                    if size >= FILE_BYTES:
                        yield close()
                        parts, size, n, made = [], 0, 0, made + 1
        if parts:
            yield close()

    return materialize(rows.mapInArrow(run, "path string, records long, bytes long"), "warc-files")


READ = "path string, at long, page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, gap_from long, gap_to long"


def read(files: DataFrame, folder: str) -> DataFrame:
    """A row for each record, and for each gap (page_id null, gap_from and gap_to set)."""
    names = [f.split()[0] for f in READ.split(", ")]
    kinds = [pa.int64() if f.split()[1] == "long" else pa.string() for f in READ.split(", ")]

    def run(batches):
        fs, _ = _filesystem(folder)
        for b in batches:
            for path in b.column(0).to_pylist():
                with fs.open_input_file(path) as f:
                    rows = (
                        (path, r.at, r.page_id, r.headers.get("warc-target-uri"), r.payload_bytes, r.digest, r.headers.get("warc-type"), r.refers_to, None, None) if r else (path, gap[0], *[None] * 6, *gap)
                        for r, gap in salvage(f, f.size())
                    )
                    while chunk := list(itertools.islice(rows, 1024)):
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*chunk), kinds)], names=names)

    n = max(1, min(10_000, files.count()))  # a given number, so that the few small rows are not merged into one task
    spread = files.select("path").repartition(n, "path")
    return spread.mapInArrow(run, READ)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages, read the archives back: a row a page."""
    folder = fresh_dir(pages.sparkSession, "warc")
    found = read(write(pages, folder), folder).where("gap_from IS NULL")
    kind = pages.schema["page_id"].dataType.simpleString()
    return found.select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
s AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS payload_digest, max(page_id) OVER (PARTITION BY html) AS top FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= {REVISIT_BYTES} AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {REVISIT_BYTES} AND page_id <> top THEN top END AS refers_to
FROM s
"""
