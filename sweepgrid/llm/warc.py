"""Legacy archive converter: ARC files to WARC files.

ARC files open with a version block that tells which header line their records have
(version 1: five fields, version 2: ten); each record is that line, then as many bytes as
it declares. The converter parses them and synthesises WARC records: identifiers from the
record's own content, timestamps from the 14-digit archive date, types (warcinfo, response,
revisit) and payload digests. Archives are packed into files of bounded size, and both
kinds are written and read by Spark's own sources, so any store that Spark reaches will do.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, delete, shared_dir, table

#: The header lines of the two versions of the format.
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
#: Bytes of records in one archive; a larger record stands alone.
ARCHIVE_BYTES = 8_000_000
IDENT_HEADER = b"X-Page-Id: "


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def arc_date(ident: int | None) -> str:
    """A capture time for tables that have none: the same for the same id."""
    days, s = divmod((ident or 0) % (365 * 86400), 86400)
    month, day = divmod(days, 28)
    return f"20{24 + month // 12:02d}{month % 12 + 1:02d}{day + 1:02d}{s // 3600:02d}{s // 60 % 60:02d}{s % 60:02d}"


def arc_record(version: int, url: str, date: str, content: bytes, offset: int, name: str) -> bytes:
    head = [url, "0.0.0.0", date, "text/html"]
    if version == 2:
        head += ["200", "-", "-", str(offset), name]
    return " ".join([*head, str(len(content))]).encode() + b"\n" + content + b"\n"


def arc_open(version: int, name: str) -> bytes:
    """The version block that starts an archive."""
    body = f"{version} 0 sweepgrid\n{' '.join(ARC_FIELDS[version])}\n".encode()
    return arc_record(1, f"filedesc://{name}", "20240101000000", body, 0, name).replace(b"text/html", b"text/plain", 1)


def parse_arc(data: bytes) -> Iterator[tuple[dict, bytes]]:
    """(header fields, content) of each record after the version block; bad lengths or lines raise."""
    at, version = 0, None
    while at < len(data):
        if data[at : at + 1] == b"\n":
            at += 1
            continue
        end = data.find(b"\n", at)
        parts = data[at : end if end >= 0 else len(data)].decode("utf-8", "surrogateescape").split(" ")
        fields = ARC_FIELDS[version or 1]
        if end < 0 or len(parts) != len(fields) or not parts[-1].isdigit():
            raise ValueError(f"no ARC header line at byte {at}")
        size = int(parts[-1])
        content = data[end + 1 : end + 1 + size]
        if len(content) != size:
            raise ValueError(f"record at byte {at} declares {size} bytes, {len(content)} are there")
        if version is None:
            version = int(content.split(b" ", 1)[0])
            if version not in ARC_FIELDS:
                raise ValueError(f"ARC version {version}")
        else:
            yield dict(zip(fields, parts, strict=True)), content
        at = end + 1 + size


def split_http(content: bytes) -> tuple[bytes, bytes]:
    """HTTP header block with its blank line, and payload; content without one is all payload."""
    if content.startswith(b"HTTP/"):
        head, gap, body = content.partition(b"\r\n\r\n")
        return head + gap, body
    return b"", content


def ident_of(head: bytes) -> int | None:
    at = head.find(IDENT_HEADER)
    return int(head[at + len(IDENT_HEADER) : head.index(b"\r", at)]) if at >= 0 else None


def warc_time(date: str) -> str:
    d = date.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(url: str, date: str, digest: str, ident: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {date} {digest} {ident}')}>"


def warc_record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    """A record without the two line ends that close it."""
    lines = ["WARC/1.0", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in fields), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogateescape") + b"\r\n\r\n" + block


def convert_record(head: dict, content: bytes, refers: tuple[int, str, str] | None) -> bytes:
    """The WARC record of an ARC record; refers: (id, target, date) of an earlier response with the same payload."""
    http, payload = split_http(content)
    digest = payload_digest(payload)
    fields = [
        ("WARC-Record-ID", record_id(head["URL"], head["Archive-date"], digest, ident_of(http))), ("WARC-Date", warc_time(head["Archive-date"])),
        ("WARC-Target-URI", head["URL"]), ("WARC-IP-Address", head["IP-address"]), ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("X-Payload-Length", str(len(payload))), ("Content-Type", "application/http; msgtype=response" if http else head["Content-type"]),
    ]
    if refers is None:
        return warc_record("response", fields, content)
    ident, url, date = refers
    fields += [
        ("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(url, date, digest, ident)), ("WARC-Refers-To-Target-URI", url),
        ("WARC-Refers-To-Date", warc_time(date)), ("X-Refers-To-Page-Id", str(ident)),
    ]
    return warc_record("revisit", fields, http)


def parse_warc(data: bytes) -> Iterator[tuple[dict, bytes]]:
    """(headers with type, block) of each record; a record that ends early raises."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "surrogateescape").split("\r\n")
        if end < 0 or not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        head = dict(x.split(": ", 1) for x in lines[1:])
        size = int(head["Content-Length"])
        block = data[end + 4 : end + 4 + size]
        if len(block) != size or data[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} ends early")
        yield head, block
        at = end + 8 + size


def _packed(records: Iterator[bytes], first: bytes, joint: bytes) -> Iterator[bytes]:
    some, held = [first], 0
    for r in records:
        if held and held + len(r) > ARCHIVE_BYTES:
            yield joint.join(some)
            some, held = [first], 0
        some.append(r)
        held += len(r)
    if held:
        yield joint.join(some)


def write_archives(rows: DataFrame, path: str, line_sep: str) -> None:
    """One file for each row (a whole archive), gzip-compressed; line_sep closes its last record."""
    rows.select(F.col("archive").cast("string").alias("value")).write.option("lineSep", line_sep).option("compression", "gzip").option("maxRecordsPerFile", 1).mode("overwrite").text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def write_arc(pages: DataFrame, path: str, version: int | None = None, ident: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Writes a table of pages as ARC archives of bounded size. version None: both in turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = 0
        for batch in batches:
            v = version or 1 + made % 2
            name = f"part-{made}.arc"

            def records(batch: pa.RecordBatch = batch, v: int = v, name: str = name) -> Iterator[bytes]:
                offset = 0
                for i, u, h in zip(*(batch.column(k) for k in range(3)), strict=True):
                    i, u = i.as_py(), u.as_py()
                    body = h.as_buffer().to_pybytes() if h.is_valid else b""
                    mark = b"" if i is None else IDENT_HEADER + str(i).encode() + b"\r\n"
                    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + mark + b"\r\n"
                    target = "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in u or f"urn:page:{i}")
                    r = arc_record(v, target, arc_date(i), http + body, offset, name)
                    offset += len(r)
                    yield r[:-1]  # its line end joins it to the next

            for archive in _packed(records(), arc_open(v, name)[:-1], b"\n"):
                made += 1
                yield pa.RecordBatch.from_arrays([pa.array([archive], pa.binary())], names=["archive"])

    rows = pages.select(F.col(ident).cast("long"), F.col(url).cast("string"), F.col(html).cast("string"))
    write_archives(rows.mapInArrow(run, "archive binary"), path, "\n")


def _gunzip(column: pa.Array) -> Iterator[bytes]:
    for x in column:
        raw = x.as_buffer().to_pybytes()
        yield gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw


def arc_to_warc(spark: SparkSession, arc_path: str, warc_path: str) -> None:
    """Converts all ARC archives below a path. Of records with equal payloads the one with the
    smallest page id stays a response and the others become revisits of it. Records without
    an id stay responses. An empty folder gives an empty folder."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), _gunzip(batch.column(1)), strict=True):
                rows = []
                for n, (head, content) in enumerate(parse_arc(data)):
                    http, payload = split_http(content)
                    rows.append((path, n, ident_of(http), payload_digest(payload), len(payload), head["URL"], head["Archive-date"]))
                if rows:
                    kinds = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["path", "n", "ident", "digest", "bytes", "url", "date"])

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        info = warc_record("warcinfo", [("WARC-Record-ID", record_id("warcinfo", "20240101000000", "", None)), ("WARC-Date", "2024-01-01T00:00:00Z"), ("Content-Type", "application/warc-fields")], b"software: sweepgrid\r\n")
        for batch in batches:
            for data, refers in zip(_gunzip(batch.column(0)), batch.column(1), strict=True):
                back = {r["n"]: (r["of"]["ident"], r["of"]["url"], r["of"]["date"]) for r in refers.as_py() or []}
                records = (convert_record(h, c, back.get(n)) for n, (h, c) in enumerate(parse_arc(data)))
                for archive in _packed(records, info, b"\r\n\r\n"):
                    yield pa.RecordBatch.from_arrays([pa.array([archive], pa.binary())], names=["archive"])

    arcs = read_archives(spark, arc_path)
    records = arcs.mapInArrow(index, "path string, n int, ident long, digest string, bytes long, url string, date string").where("ident IS NOT NULL")
    key = ["digest", "bytes"]
    same = records.groupBy(*key).agg(F.min(F.struct("ident", "url", "date", "path", "n")).alias("of"), F.count(F.lit(1)).alias("times")).where("times > 1")
    # Only ids, digests and places pass this join. One side is written first, so that the engine may send it whole if it is small, and split a hot payload's rows.
    same = cut(same)
    later = records.select("path", "n", *key).join(same, key).where("path <> of.path OR n <> of.n")
    back = later.groupBy("path").agg(F.collect_list(F.struct("n", F.struct("of.ident", "of.url", "of.date").alias("of"))).alias("refers"))
    write_archives(arcs.join(back, "path", "left").select("content", "refers").mapInArrow(convert, "archive binary"), warc_path, "\r\n\r\n")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per response or revisit record below a path, with the block of responses left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in _gunzip(batch.column(0)):
                rows = []
                for head, block in parse_warc(data):
                    if head["WARC-Type"] not in ("response", "revisit"):
                        continue
                    http, payload = split_http(block)
                    digest, size = head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head["X-Payload-Length"])
                    if head["WARC-Type"] == "response" and (payload_digest(payload), len(payload)) != (digest, size):
                        raise ValueError(f"payload of {head['WARC-Record-ID']} does not have its digest")
                    to = head.get("X-Refers-To-Page-Id")
                    rows.append((ident_of(http), size, digest, head["WARC-Type"], int(to) if to else None, head["WARC-Record-ID"], head["WARC-Target-URI"], head["WARC-Date"], head.get("WARC-Refers-To")))
                if rows:
                    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), *[pa.string()] * 4]
                    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "target_uri", "warc_date", "refers_to_id"]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, target_uri string, warc_date string, refers_to_id string"
    return read_archives(spark, path).select("content").mapInArrow(run, schema)


def op6_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, written as ARC, converted to WARC and read back."""
    at = f"{shared_dir(spark)}/archives-{uuid.uuid4().hex}"
    write_arc(table(spark, sf_dir, "pages", "page_id", "url", "html"), f"{at}/arc")
    arc_to_warc(spark, f"{at}/arc", f"{at}/warc")
    delete(spark, f"{at}/arc")
    return read_warc(spark, f"{at}/warc").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
