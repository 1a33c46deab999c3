"""Legacy archives: write and parse ARC files, convert them to WARC, write and read WARC archives."""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm.common import shared_folder, written

#: Payloads under so many bytes are never replaced by a revisit record.
LEAST_REVISIT = 100
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FIELDS = {1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"], 2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"]}
#: WARC records end with this.
TAIL = b"\r\n\r\n"
DATE = "20000101000000"
#: Bytes of records in a file, uncompressed; a file has more only if its one record has.
FILE_BYTES = 32 << 20
#: An empty gzip member, which the text writer appends to a file in place of a line end.
EMPTY_MEMBER = gzip.compress(b"", mtime=0)


@dataclass
class ArcRecord:
    url: str
    ip: str
    date: str
    content_type: str
    status: int | None
    location: str | None
    body: bytes

    def payload(self) -> tuple[bytes, bytes]:
        """(HTTP head, payload): what a server answered begins with its status line and headers; another record has no head."""
        if self.body.startswith(b"HTTP/"):
            for gap in (b"\r\n\r\n", b"\n\n"):
                head, found, rest = self.body.partition(gap)
                if found:
                    return head + found, rest
        return b"", self.body


def http_head(fields: dict[str, str]) -> bytes:
    return "".join(["HTTP/1.1 200 OK\r\n", *(f"{k}: {v}\r\n" for k, v in fields.items()), "\r\n"]).encode()


def _clean(value: str | None, other: str = "-") -> str:
    """A header field: ARC separates fields by blanks, so others are escaped."""
    text = "".join(c if c > " " and c != "\x7f" else "%{:02X}".format(ord(c)) for c in value or "")
    return text or other


def arc_header(version: int) -> bytes:
    """The version block that opens an ARC file; its second line names the version, its third the fields."""
    lines = f"{version} 0 loomspan\n{' '.join(FIELDS[version])}\n".encode()
    head = f"filedesc://loomspan.arc 0.0.0.0 {DATE} text/plain "
    if version == 2:
        head += "200 - - 0 loomspan.arc "
    return f"{head}{len(lines)}\n".encode() + lines + b"\n"


def arc_record(version: int, url: str, payload: bytes, offset: int = 0) -> bytes:
    """One ARC record: the fields of its version on a line, then as many bytes as the line declares."""
    head = f"{_clean(url)} 0.0.0.0 {DATE} text/html "
    if version == 2:
        head += f"200 {hashlib.md5(payload).hexdigest()} - {offset} loomspan.arc "
    return f"{head}{len(payload)}\n".encode() + payload + b"\n"


def parse_arc(data: bytes) -> Iterator[ArcRecord]:
    """The records of an ARC file of version 1 or 2, by its declared lengths; content is never searched.

    The version block is read, not returned. A line with too few fields, a length that isn't a number or leads
    beyond the file's end raises ``ValueError``.
    """
    return read_arc(io.BytesIO(data))


def read_arc(file: BinaryIO) -> Iterator[ArcRecord]:
    """As :func:`parse_arc`, from a stream; one record is held at a time."""
    fields: list[str] | None = None
    while line := file.readline():
        if not line.strip(b"\r\n"):
            continue
        parts = line.decode("utf-8", "replace").rstrip("\r\n").split(" ")
        if fields is None and not parts[0].startswith("filedesc:"):
            raise ValueError("no ARC version block")
        if fields is not None and len(parts) != len(fields):
            raise ValueError(f"{len(parts)} fields in place of {len(fields)}: {parts[0]}")
        length = int(parts[-1]) if parts[-1].isdigit() and line.endswith(b"\n") else -1
        body = file.read(length) if length >= 0 else b""
        if len(body) != length:
            raise ValueError(f"a wrong length: {parts[0]}")
        if fields is None:
            first, _, rest = body.partition(b"\n")
            fields = rest.split(b"\n")[0].decode().split(" ")
            if not first[:1].isdigit() or fields != FIELDS.get(int(first[:1])):
                raise ValueError("an unknown ARC version")
            continue
        row = dict(zip(fields, parts, strict=True))
        status, location = row.get("Result-code", "-"), row.get("Location", "-")
        yield ArcRecord(row["URL"], row["IP-address"], row["Archive-date"], row["Content-type"], int(status) if status.isdigit() else None, None if location == "-" else location, body)


def warc_record(arc: ArcRecord, page_id: int | None, refers_to: int | None) -> bytes:
    """The equivalent WARC 1.1 record, without the two line ends behind its block.

    Its identifier is derived from the page (without one: from URL and date), its date from the 14-digit ARC date, its digests from the
    payload, which comes behind the HTTP head. A revisit holds the head only, but the payload's digest and length, and names
    the record it refers to. What no server answered (no HTTP head) becomes a ``resource``.
    """
    head, payload = arc.payload()
    digest = hashlib.sha256(payload).hexdigest()
    d = arc.date.ljust(14, "0")
    stamp = f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"

    def name(of: int | None) -> str:
        return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{of}' if of is not None else f'{arc.url} {arc.date}')}>"

    block = head if refers_to is not None else arc.body
    kind = "revisit" if refers_to is not None else "response" if head else "resource"
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {stamp}",
        f"WARC-Target-URI: {arc.url}", f"WARC-IP-Address: {arc.ip}", f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        f"X-Payload-Length: {len(payload)}", f"X-Page-ID: {'' if page_id is None else page_id}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {name(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}"]
    lines += [f"Content-Type: {'application/http; msgtype=response' if head else arc.content_type}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block


def warcinfo() -> bytes:
    """The record that opens each file."""
    block = b"software: loomspan\r\nformat: WARC File Format 1.1\r\n"
    name = uuid.uuid5(uuid.NAMESPACE_URL, "warcinfo")
    stamp = f"{DATE[:4]}-{DATE[4:6]}-{DATE[6:8]}T00:00:00Z"
    return f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{name}>\r\nWARC-Date: {stamp}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record in a WARC file, by its declared lengths."""
    return read_warc(io.BytesIO(data))


def read_warc(file: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """As :func:`parse_warc`, from a stream; one record is held at a time."""
    while first := file.readline():
        if not first.startswith(b"WARC/"):
            raise ValueError("no WARC record where one should begin")
        head: dict[str, str] = {}
        while (line := file.readline()) not in (b"\r\n", b""):
            k, _, v = line.decode("utf-8", "replace").rstrip("\r\n").partition(": ")
            head[k.lower()] = v
        block = file.read(int(head["content-length"]))
        if len(block) != int(head["content-length"]) or file.read(4) != TAIL:
            raise ValueError(f"a wrong length in {head.get('warc-record-id')}")
        yield head, block


class _Files:
    """Gathers WARC records into the bytes of gzip files, a member a record, of ``FILE_BYTES`` uncompressed bytes."""

    def __init__(self, size: int = FILE_BYTES) -> None:
        self.most = size
        self._open()

    def _open(self) -> None:
        self.parts, self.size = [gzip.compress(warcinfo() + TAIL, mtime=0)], 0

    def add(self, record: bytes) -> Iterator[bytes]:
        if self.size and self.size + len(record) > self.most:
            yield from self.end()
        self.parts.append(gzip.compress(record + TAIL, 6, mtime=0))
        self.size += len(record)

    def end(self) -> Iterator[bytes]:
        if self.size:
            yield b"".join(self.parts)
            self._open()


def _rows(files: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
    for data in files:
        yield pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["file"])


def _converted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a batch as an ARC archive of each version, read again and converted, to the bytes of WARC files."""
    files = _Files()
    for batch in batches:
        archives: dict[int, list[bytes]] = {1: [], 2: []}
        refers: dict[int, list[tuple[int | None, int | None]]] = {1: [], 2: []}
        for page, url, html, again in zip(*(c for c in batch.columns), strict=True):
            page_id, payload = page.as_py(), (html.as_py() or "").encode("utf-8", "surrogatepass")
            version = 1 + (page_id or 0) % 2
            head = http_head({"Content-Type": "text/html; charset=utf-8", "Content-Length": str(len(payload))})
            archives[version].append(arc_record(version, url.as_py(), head + payload))
            refers[version].append((page_id, again.as_py()))
        for version, records in archives.items():
            for arc, (page_id, again) in zip(parse_arc(arc_header(version) + b"".join(records)), refers[version], strict=True):
                yield from _rows(files.add(warc_record(arc, page_id, again)))
    yield from _rows(files.end())


def _from_arcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    files = _Files()
    for batch in batches:
        for content in batch.column(0):
            data = content.as_py()
            source = gzip.GzipFile(fileobj=io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
            for arc in read_arc(source):
                yield from _rows(files.add(warc_record(arc, None, None)))
    yield from _rows(files.end())


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "date", "url"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
    for batch in batches:
        for packed in batch.column(0):
            rows = []
            for head, block in read_warc(gzip.GzipFile(fileobj=io.BytesIO(packed.as_py()))):
                kind = head["warc-type"]
                if kind == "warcinfo":
                    continue
                digest = head["warc-payload-digest"].removeprefix("sha256:")
                if kind != "revisit":
                    _, payload = ArcRecord("", "", "", "", None, None, block).payload() if kind == "response" else (b"", block)
                    if hashlib.sha256(payload).hexdigest() != digest or len(payload) != int(head["x-payload-length"]):
                        raise ValueError(f"a damaged payload in {head['warc-record-id']}")
                page, refers = head["x-page-id"], head.get("x-refers-to-page-id")
                rows.append((int(page) if page else None, int(head["x-payload-length"]), digest, kind, int(refers) if refers else None, head["warc-record-id"], head["warc-date"], head["warc-target-uri"]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def revisits(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """(digest, first, page_id) of the pages whose payload another page with a smaller id holds as well.

    Pre-aggregated by digest; a page that holds its payload alone isn't moved again.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    own = pages.select("page_id", F.sha2(html, 256).alias("digest"), F.octet_length(html).alias("bytes")).where(F.col("bytes") >= least)
    own = written(own.select("page_id", "digest"))
    first = own.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    return own.join(first, "digest").where(F.col("page_id") != F.col("first")).select("page_id", "digest", "first").distinct()


def _write(files: DataFrame, path: str) -> None:
    """Each row's bytes as a file of its own. Spark's writer commits them, so a lost task leaves none.

    The writer ends a file by its line end, for which an empty gzip member stands.
    """
    rows = files.select(F.col("file").cast("string").alias("value"))
    rows.write.option("lineSep", EMPTY_MEMBER.decode("latin-1")).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", 1).text(path)


def write_archives(pages: DataFrame, path: str, least: int = LEAST_REVISIT) -> None:
    """Write a WARC record for each row of ``pages`` (page_id, url, html) to gzip files in ``path``, a member a record.

    The pages go through legacy ARC archives (even ids in version 1, odd ones in version 2) and the converter. Of the records
    with equal payloads of ``least`` bytes or more, that with the smallest id is a response, the others
    revisits of it. Files are bounded by ``FILE_BYTES``, not by a number of records. Null html is
    empty, a null url ``-``; of rows that repeat the smallest id all are responses; a null id is never replaced.
    An empty table gives no file with records.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    own = pages.select("page_id", "url", html.alias("html")).alias("p")
    again = revisits(pages, least).alias("r")
    joined = own.join(again, (F.col("p.page_id") == F.col("r.page_id")) & (F.sha2("html", 256) == F.col("r.digest")), "left")
    rows = joined.select(F.col("p.page_id").cast("long").alias("page_id"), "url", "html", F.col("first").cast("long").alias("refers_to"))
    _write(rows.mapInArrow(_converted, "file binary"), path)


def convert_archives(spark: SparkSession, source: str, path: str) -> None:
    """Convert the ARC files in ``source`` (version 1 or 2, gzipped or not) to WARC files in ``path``, as :func:`write_archives` writes them.

    Records keep their order within a file; none becomes a revisit. A damaged file raises ``ValueError``. A file is read whole
    by a task, as it comes; its records are converted one at a time.
    """
    files = spark.read.format("binaryFile").load(source).where("length > 0").select("content")
    _write(files.mapInArrow(_from_arcs, "file binary"), path)


def read_archives(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """A row for each record but ``warcinfo`` in the gzipped WARC files in ``path``; payloads are held against their digests."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).where("length > 0").select("content")
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, date string, url string"
    return files.mapInArrow(_read, schema)


def round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``pages`` to archives and read them back: one row for each page, from what the archives say."""
    path = path or shared_folder(pages.sparkSession)
    write_archives(pages, path)
    return read_archives(pages.sparkSession, path)
