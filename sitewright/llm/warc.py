"""Legacy web archives to WARC (operator 10).

ARC files of version 1 and 2 are read by their own header lines (5 or 10 fields, split from the right, since legacy
addresses may hold spaces) and the declared lengths; nothing is guessed from the content. Each record becomes a WARC
record of the equivalent type (warcinfo, response, resource or revisit) with a synthesised identifier, an ISO date,
and block and payload digests.

`archive` takes pages through that converter: every batch of pages is laid out as ARC archives of either version, parsed
and converted, version blocks to warcinfo records, and the WARC records are written to the shared folder as gzip files by
Spark's own text writer, whose line separator is the mark that ends a WARC record. `read_archives` reads gzip files back by
the same mark, piece by piece, and puts records together by their declared lengths, so a task holds a record and a batch at
a time, however large the file. A file is one gzip member: records are read in order, not addressed one by one.

Equal payloads of `least_bytes` or more are stored once: the page with the largest page_id keeps the payload, the
others become revisit records that refer to it. Which pages those are is found from digests alone, combined on the map
side; payloads move only to their record.

Nulls: a null html is an empty payload; a null url becomes `about:blank`. A page without a page_id counts as smaller
than any other; if no page of a payload has one, all keep it. Repeated rows of the largest page_id are all responses.
An empty table gives an empty archive.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import islice
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewright.llm.common import map_batches, shared_dir

LEAST_BYTES = 1000
RECORDS_A_FILE = 8192
# Fixed values of the formats: header fields by ARC version, ends of records.
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
WARC_END = "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
ID_SPACE = int.from_bytes(b"arcpag", "big")
NO_DATE, NO_ADDRESS = "19700101000000", "0.0.0.0"


class ArcRecord(NamedTuple):
    version: int
    fields: dict[str, str]
    body: bytes

    @property
    def url(self) -> str:
        return self.fields["URL"]


class WarcRecord(NamedTuple):
    headers: dict[str, str]
    block: bytes


# --- ARC


def arc_header(version: int, **fields: str) -> str:
    """A header line; fields by their lower-case names with _ for -; `-` where unknown."""
    return " ".join(fields.get(name.lower().replace("-", "_"), "-") for name in ARC_FIELDS[version])


def arc_file(version: int, records: list[tuple[dict[str, str], bytes]], name: str = "pages.arc", origin: str = "sitewright") -> bytes:
    """A whole ARC file: the version block, then a header line, the body and a line end for each record."""
    block = f"{version} 0 {origin}\n{' '.join(ARC_FIELDS[version])}\n".encode()
    out = [arc_header(version, url=f"filedesc://{name}", ip_address=NO_ADDRESS, archive_date=NO_DATE, content_type="text/plain", result_code="200", archive_length=str(len(block))).encode(), b"\n", block, b"\n"]
    for fields, body in records:
        out += [arc_header(version, **fields, archive_length=str(len(body))).encode(), b"\n", body, b"\n"]
    return b"".join(out)


def parse_arc(data: bytes) -> Iterator[ArcRecord]:
    """All records, the version block first. Raises ValueError where a header or a length doesn't fit."""
    at, version = 0, 0
    while True:
        while data[at : at + 1] in (b"\n", b"\r"):
            at += 1
        if at >= len(data):
            return
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError(f"no header line at byte {at}")
        line = data[at:end].decode("utf-8", "replace").rstrip("\r")
        try:
            length = int(line.rsplit(" ", 1)[1])
        except (IndexError, ValueError):
            raise ValueError(f"no declared length at byte {at}: {line[:80]!r}") from None
        body = data[end + 1 : end + 1 + length]
        if length < 0 or len(body) < length:
            raise ValueError(f"{length} bytes declared at byte {at}, {len(body)} found")
        if not version:
            first = body.split(b"\n", 1)[0].split(b" ")
            if not line.startswith("filedesc:") or first[0] not in (b"1", b"2"):
                raise ValueError("no version block")
            version = int(first[0])
        names = ARC_FIELDS[version]
        values = line.rsplit(" ", len(names) - 1)
        if len(values) != len(names) and line.startswith("filedesc:"):  # version blocks of version 2 are often written in the short form
            names = ARC_FIELDS[1]
            values = line.rsplit(" ", len(names) - 1)
        if len(values) != len(names):
            raise ValueError(f"{len(names)} fields expected at byte {at}: {line[:80]!r}")
        yield ArcRecord(version, dict(zip(names, values)), body)
        at = end + 1 + length


# --- WARC


def iso_date(stamp: str) -> str:
    """ARC's YYYYMMDDhhmmss (or its first digits) as an ISO date."""
    if not re.fullmatch(r"[0-9]{4,14}", stamp):
        stamp = NO_DATE
    full = stamp + "00000101000000"[len(stamp) :]
    return f"{full[:4]}-{full[4:6]}-{full[6:8]}T{full[8:10]}:{full[10:12]}:{full[12:14]}Z"


def sha1_label(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def label_hex(label: str) -> str:
    return base64.b32decode(label.removeprefix("sha1:")).hex()


def page_urn(page_id: int) -> str:
    """A UUID of version 8 that holds a 64-bit number."""
    number = page_id & (2**64 - 1)
    return f"urn:uuid:{uuid.UUID(int=(ID_SPACE << 80) | (8 << 76) | ((number >> 62) << 64) | (2 << 62) | (number & (2**62 - 1)))}"


def urn_page(urn: str) -> int | None:
    value = uuid.UUID(urn.strip("<>").removeprefix("urn:uuid:")).int
    if value >> 80 != ID_SPACE or (value >> 76) & 15 != 8:
        return None
    number = ((value >> 64) & 3) << 62 | (value & (2**62 - 1))
    return number - 2**64 if number >= 2**63 else number


def split_http(body: bytes) -> tuple[bytes, bytes]:
    """(status line and headers with the empty line, payload)."""
    head, mark, payload = body.partition(b"\r\n\r\n")
    return (head + mark, payload) if mark else (b"", body)


def http_header(head: bytes, name: str) -> str | None:
    found = re.search(rb"(?im)^" + name.encode() + rb":[ \t]*([^\r\n]*)", head)
    return found[1].decode() if found else None


def to_warc(record: ArcRecord, refers_to: int | None = None) -> WarcRecord:
    """The equivalent WARC record; with refers_to, a revisit of that page's payload."""
    fields, body = record.fields, record.body
    headers = {"WARC-Type": "resource", "WARC-Record-ID": "", "WARC-Date": iso_date(fields["Archive-date"])}
    if record.url.startswith("filedesc:"):
        headers |= {"WARC-Type": "warcinfo", "WARC-Filename": record.url.removeprefix("filedesc://"), "Content-Type": "application/warc-fields"}
        body = f"software: sitewright\r\nformat: WARC File Format 1.0\r\ndescription: converted from ARC version {record.version}\r\n".encode()
        own = None
    else:
        head, payload = split_http(body) if body.startswith(b"HTTP/") else (b"", body)
        own = http_header(head, "X-Page-Id")
        headers |= {"WARC-Target-URI": record.url, "WARC-IP-Address": fields["IP-address"], "WARC-Payload-Digest": sha1_label(payload), "Content-Type": fields["Content-type"]}
        if head:
            headers |= {"WARC-Type": "response", "Content-Type": "application/http; msgtype=response"}
        if refers_to is not None and head:
            headers |= {"WARC-Type": "revisit", "WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": f"<{page_urn(refers_to)}>"}
            body = head
    urn = page_urn(int(own)) if own else f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{record.url} {fields["Archive-date"]} {hashlib.sha1(record.body).hexdigest()}')}"
    headers |= {"WARC-Record-ID": f"<{urn}>", "WARC-Block-Digest": sha1_label(body), "Content-Length": str(len(body))}
    return WarcRecord(headers, body)


def warc_text(record: WarcRecord) -> bytes:
    """The record without the mark that ends it."""
    lines = "".join(f"{name}: {value}\r\n" for name, value in record.headers.items())
    return f"WARC/1.0\r\n{lines}\r\n".encode() + record.block


def parse_warc(chunks: Iterator[bytes]) -> Iterator[WarcRecord]:
    """Records of a stream, by their Content-Length; at most a record and a chunk are held."""
    data = b""

    def fill(least: int) -> bool:
        nonlocal data
        parts, size = [data], len(data)
        while size < least and (more := next(chunks, None)) is not None:
            parts.append(more)
            size += len(more)
        data = b"".join(parts)
        return size >= least

    while True:
        while fill(1) and data[:2] == b"\r\n"[: len(data[:2])] and fill(2):
            data = data[2:]
        if not data:
            return
        end = data.find(b"\r\n\r\n")
        while end < 0:
            if not fill(len(data) + 1):
                raise ValueError("a header without an end")
            end = data.find(b"\r\n\r\n")
        first, *lines = data[:end].decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no WARC record: {first[:40]!r}")
        headers = dict(line.split(": ", 1) for line in lines)
        stop = end + 4 + int(headers["Content-Length"])
        if not fill(stop):
            raise ValueError("a record ends early")
        yield WarcRecord(headers, data[end + 4 : stop])
        data = data[stop:]


def inflated(data: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """The content of a gzip file of one or more members, piece by piece; other data as it is."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    while data:
        member = zlib.decompressobj(31)
        yield member.decompress(data, size)
        while not member.eof:
            piece = member.decompress(member.unconsumed_tail, size)
            if not piece and not member.eof:
                raise ValueError("a gzip member ends early")
            yield piece
        data = member.unused_data


# --- tables


def clean_url(url: str | None) -> str:
    """An address without line ends; other characters stay, as legacy archives have them."""
    return re.sub(r"[\r\n\t]", lambda m: f"%{ord(m[0]):02X}", url) if url else "about:blank"


def revisits(pages: DataFrame, key: str = "page_id", html: str = "html", least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(digest, newest): the largest page_id of each payload that more than one row has."""
    payload = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    sized = pages.select(F.col(key).cast("long").alias("page_id"), F.unhex(F.sha1(payload)).alias("digest"), F.octet_length(payload).alias("size"))
    return sized.where(F.col("size") >= least_bytes).groupBy("digest").agg(F.count("*").alias("rows"), F.max("page_id").alias("newest")).where("rows > 1 and newest is not null").select("digest", "newest")


def warc_records(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(value): the text of one WARC record for each page, by way of ARC archives of versions 1 and 2."""
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.when(F.octet_length("html") >= least_bytes, F.unhex(F.sha1(F.encode("html", "UTF-8")))))
    same = revisits(pages, key, html, least_bytes)
    marked = rows.join(same, "digest", "left").select("page_id", "url", "html", F.when(F.col("newest").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("newest"))), F.col("newest")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for batch in batches:
            parts: dict[int, list] = {1: [], 2: []}
            for k, (page, address, text, older) in enumerate(zip(*(c.to_pylist() for c in batch.columns))):
                payload = text.encode()
                own = "" if page is None else f"X-Page-Id: {page}\r\n"
                body = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{own}Content-Length: {len(payload)}\r\n\r\n".encode() + payload
                fields = {"url": clean_url(address), "ip_address": NO_ADDRESS, "archive_date": NO_DATE, "content_type": "text/html", "result_code": "200"}
                parts[1 + k % 2].append((fields, body, older))
            out = []
            for version, records in parts.items():
                if not records:
                    continue
                number += 1
                first, *parsed = parse_arc(arc_file(version, [r[:2] for r in records], f"pages-{TaskContext.get().partitionId()}-{number}.arc"))
                out.append(warc_text(to_warc(first)).decode())
                out += [warc_text(to_warc(record, older)).decode() for record, (_, _, older) in zip(parsed, records, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

    return map_batches(marked, run, "value string")


def archive(pages: DataFrame, path: str | None = None, **columns: str | int) -> str:
    """Write WARC files of all pages and return their folder."""
    spark = pages.sparkSession
    path = path or f"{shared_dir(spark)}/archives/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    warc_records(pages, **columns).write.option("lineSep", WARC_END).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_A_FILE).text(path)
    return path


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, type, url, date, page_id, payload_bytes, payload_digest, refers_to) of each record. A payload is held against its digest.

    Gzip files are read as a stream; files without compression, which Spark would cut anywhere, whole, and so below 2 GB each.
    """
    schema = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("url", pa.string()), ("date", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())])

    def rows_of(records: Iterator[WarcRecord]) -> Iterator[pa.RecordBatch]:
        found = map(described, records)
        while some := list(islice(found, 1000)):
            yield pa.RecordBatch.from_pylist(some, schema)

    def in_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from rows_of(parse_warc(piece.as_py() + WARC_END.encode() for batch in batches for piece in batch.column(0)))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                yield from rows_of(parse_warc(inflated(content.as_py())))

    kinds = "record_id string, type string, url string, date string, page_id long, payload_bytes long, payload_digest string, refers_to long"
    pieces = spark.read.option("lineSep", WARC_END).option("pathGlobFilter", "*.gz").text(path).select(F.col("value").cast("binary").alias("value"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*[!z]").load(path).select("content")
    return map_batches(pieces, in_pieces, kinds).unionByName(map_batches(files, whole, kinds))


def described(record: WarcRecord) -> dict:
    headers = record.headers
    head, payload = split_http(record.block) if headers["WARC-Type"] in ("response", "revisit") else (b"", record.block)
    digest = headers.get("WARC-Payload-Digest")
    size = len(payload)
    if headers["WARC-Type"] == "revisit":
        size = int(http_header(head, "Content-Length") or 0)
    elif digest and digest != sha1_label(payload):
        raise ValueError(f"the payload of {headers['WARC-Record-ID']} doesn't fit its digest")
    refers = headers.get("WARC-Refers-To")
    return {
        "record_id": headers["WARC-Record-ID"].strip("<>"), "type": headers["WARC-Type"], "url": headers.get("WARC-Target-URI"), "date": headers["WARC-Date"],
        "page_id": urn_page(headers["WARC-Record-ID"]), "payload_bytes": size, "payload_digest": label_hex(digest) if digest else None, "refers_to": urn_page(refers) if refers else None,
    }
