"""From legacy ARC archives to WARC: header lines by version, declared lengths, synthesised WARC fields.

An ARC file starts with a ``filedesc://`` record whose second line names its
version; each record is one header line, of five fields in version 1 and ten in
version 2, and as many bytes as its last field declares. A WARC record made from
it gets a record id (a name-based UUID, so that a repeated task makes the same
one), an ISO timestamp, a type, and SHA-256 digests of block and payload.
Archives are written by Spark's own writer into any file system that it knows.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, map_arrow, shared_dir, written

# The fields of an ARC header line by version.
ARC_FIELDS = {
    1: ("url", "ip", "date", "type", "length"),
    2: ("url", "ip", "date", "type", "status", "checksum", "location", "offset", "filename", "length"),
}
VERSION_BLOCK = {
    1: "1 0 rillstone\nURL IP-address Archive-date Content-type Archive-length\n",
    2: "2 0 rillstone\nURL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "20000101000000"
#: Payloads from this many bytes on may be revisits.
LEAST = 100
#: Bytes of an archive, and how hard its records are packed.
PER_FILE, LEVEL = 32 << 20, 6
END = b"\r\n\r\n"


def arc_file_header(version: int, name: str = "pages.arc") -> bytes:
    body = VERSION_BLOCK[version].encode()
    rest = "" if version == 1 else f"200 - - 0 {name} "
    return f"filedesc://{name} 0.0.0.0 {DATE} text/plain {rest}{len(body)}\n".encode() + body + b"\n"


def arc_record(version: int, url: str, payload: bytes, ip: str = "0.0.0.0", date: str = DATE, kind: str = "text/html") -> bytes:
    """One record: header line, HTTP head and payload as declared, line feed. Blanks and control letters in the URL are percent-encoded."""
    url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) or "-"
    block = f"HTTP/1.1 200 OK\r\nContent-Type: {kind}; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    rest = "" if version == 1 else "200 - - 0 pages.arc "
    return f"{url} {ip} {date} {kind} {rest}{len(block)}\n".encode() + block + b"\n"


def arc_records(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record of an ARC file, its filedesc record apart. ValueError at a line that fits no version, or a length beyond the end."""
    at, version = 0, 1
    while at < len(raw):
        if raw[at : at + 1] == b"\n":
            at += 1
            continue
        eol = raw.find(b"\n", at)
        words = raw[at : eol if eol >= 0 else len(raw)].decode("utf-8", "replace").rstrip("\r").split(" ")
        names = ARC_FIELDS[version]
        if words[0].startswith("filedesc://"):
            names = ARC_FIELDS[2 if len(words) >= len(ARC_FIELDS[2]) else 1]
        if eol < 0 or len(words) < len(names) or not words[-1].isdigit():
            raise ValueError(f"no ARC header line at byte {at}")
        # a media type may hold blanks: what is over belongs to it
        over = len(words) - len(names)
        fields = dict(zip(names, [*words[:3], " ".join(words[3 : 4 + over]), *words[4 + over :]], strict=True))
        size = int(fields["length"])
        block = raw[eol + 1 : eol + 1 + size]
        if len(block) < size:
            raise ValueError(f"{size} bytes declared at byte {at}, {len(block)} left")
        at = eol + 1 + size
        if words[0].startswith("filedesc://"):
            version = 2 if block[:1] == b"2" else 1
        else:
            yield fields, block


def payload_of(block: bytes) -> bytes:
    """What follows the HTTP head; the whole block if it has none."""
    if block.startswith(b"HTTP/") and (k := block.find(END)) >= 0:
        return block[k + 4 :]
    return block


def timestamp(date: str) -> str:
    """An ARC date of up to 14 digits as an ISO time; missing months and days are 01."""
    digits = "".join(c for c in date if c in "0123456789")[:14]
    full = digits + "00000101000000"[len(digits) :]
    return f"{full[:4]}-{full[4:6]}-{full[6:8]}T{full[8:10]}:{full[10:12]}:{full[12:14]}Z"


def record_id(row_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{row_id}:{digest}')}>"


def warc_record(fields: dict[str, str], block: bytes, row_id: int | None, refers_to: int | None = None) -> bytes:
    """The WARC record of an ARC record, without the two line ends that close it. A revisit keeps the HTTP head alone and states the full payload's length and digest."""
    payload = payload_of(block)
    digest = hashlib.sha256(payload).hexdigest()
    http = block.startswith(b"HTTP/")
    kept = block if refers_to is None else block[: len(block) - len(payload)]
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": record_id(row_id, digest),
        "WARC-Date": timestamp(fields["date"]),
        "WARC-Target-URI": fields["url"],
        "WARC-IP-Address": fields["ip"],
        "WARC-Payload-Digest": f"sha256:{digest}",
        "WARC-Block-Digest": f"sha256:{hashlib.sha256(kept).hexdigest()}",
    }
    if refers_to is not None:
        head |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": record_id(refers_to, digest), "X-Refers-To-Row": str(refers_to)}
    head |= {"X-Row": "" if row_id is None else str(row_id), "X-Payload-Length": str(len(payload)), "Content-Type": "application/http;msgtype=response" if http else fields["type"], "Content-Length": str(len(kept))}
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n").encode() + kept


def inflated(raw: bytes, step: int = 1 << 20, fed: int = 1 << 16) -> Iterator[bytes]:
    """The bytes of a gzip file of any number of members, or of a plain file, in steps; what is fed at once is small, as the rest of it is copied at each member's end."""
    if raw[:2] != b"\x1f\x8b":
        yield raw
        return
    z, rest, at = None, b"", 0
    while rest or at < len(raw):
        if not rest:
            rest, at = raw[at : at + fed], at + fed
        z = z or zlib.decompressobj(31)
        out = z.decompress(rest, step)
        rest = z.unused_data if z.eof else z.unconsumed_tail
        if z.eof:
            z = None
        if out:
            yield out
    if z is not None:
        yield z.flush()


def warc_records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header, block) of each record by its declared length; ValueError if the file ends inside one."""
    buf, chunks = bytearray(), iter(chunks)

    def fill(n: int) -> bool:
        while len(buf) < n:
            more = next(chunks, None)
            if more is None:
                return False
            buf.extend(more)
        return True

    while fill(1):
        while (k := buf.find(END)) < 0:
            if not fill(len(buf) + 1):
                raise ValueError("a WARC header without its end")
        lines = buf[:k].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record: {lines[0][:40]!r}")
        head = dict(x.split(": ", 1) for x in lines[1:])
        size = int(head["Content-Length"])
        if not fill(k + 8 + size):
            raise ValueError("a WARC record without its end")
        yield head, bytes(buf[k + 4 : k + 4 + size])
        del buf[: k + 8 + size]


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST, per_file: int = PER_FILE) -> str:
    """Writes pages as WARC files, by way of ARC records, each record a gzip member of its own; returns their folder.

    Null html counts as empty, a null URL as "-". Of equal payloads of ``least``
    bytes or more that with the smallest id is a response, the others revisit
    it; rows that repeat whole are all responses. Equal payloads are found by
    SHA-256 on (id, digest) alone, written once and counted before they are
    shuffled; pages are read for that, and again to be joined to the few ids
    that revisit. A file holds about ``per_file`` bytes, or one longer record.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).cast("long").alias("row"), F.coalesce(F.col(url_col).cast("string"), F.lit("-")).alias("url"), F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("payload", 256)))
    long = written(rows.where(F.octet_length("payload") >= least).select("row", "digest"), "payload-digests")
    first = long.groupBy("digest").agg(F.min("row").alias("first"), F.max("row").alias("last")).where("first < last").select("digest", "first")
    again = written(long.join(first, "digest").where("row <> first").distinct(), "revisits")
    both = rows.join(again, ["row", "digest"], "left").select("row", "url", "payload", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def file() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["file"])

        for batch in batches:
            for row, url, payload, to in zip(*batch.columns, strict=True):
                row, to = row.as_py(), to.as_py()
                version = 1 + (row or 0) % 2
                (fields, block), *_ = arc_records(arc_file_header(version) + arc_record(version, url.as_py(), payload.as_py()))
                member = gzip.compress(warc_record(fields, block, row, to) + END, LEVEL, mtime=0)
                if held and size + len(member) > per_file:
                    yield file()
                    held, size = [], 0
                held.append(member)
                size += len(member)
        if held:
            yield file()

    path = shared_dir(spark, "warc")
    # a row is a file; the separator that the writer puts behind it is a gzip member without content
    files = both.mapInArrow(run, "file binary").select(F.col("file").cast("string"))
    files.write.option("lineSep", gzip.compress(b"", LEVEL, mtime=0).decode("latin-1")).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", 1).text(path)
    dropped(long, again)
    return path


def read_archives(spark, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each record of the archives, digests of responses taken anew from their bytes. A file is a row, which archive() keeps small."""

    def start():
        def run(batch):
            rows = []
            for content in batch.column(0):
                for head, block in warc_records(inflated(content.as_py())):
                    stated = head["WARC-Payload-Digest"].removeprefix("sha256:")
                    size = int(head["X-Payload-Length"])
                    if head["WARC-Type"] == "response":
                        payload = payload_of(block)
                        size = len(payload)
                        if hashlib.sha256(payload).hexdigest() != stated:
                            raise ValueError(f"the payload of {head['WARC-Record-ID']} does not have its digest")
                    to = head.get("X-Refers-To-Row")
                    rows.append((int(head["X-Row"]) if head["X-Row"] else None, size, stated, head["WARC-Type"], int(to) if to else None))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

        return run

    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "part-*").load(path)
    return map_arrow(files.select("content"), start, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_digests(pages: DataFrame) -> DataFrame:
    """read_archives of archive.

    Null html is an empty payload; rows with a null id are records with a null
    page_id, and rows that repeat give a record each. An empty table gives no
    rows. Other columns are not carried.
    """
    return read_archives(pages.sparkSession, archive(pages))


def convert_arc(arcs: DataFrame, content_col: str = "content") -> DataFrame:
    """uri, date, record (WARC, binary), error of every record in a column of whole ARC files, plain or gzipped. Null files and files that break off give the records before and a row with the error."""

    def start():
        def run(batch):
            rows = []
            for raw in batch.column(0).to_pylist():
                try:
                    if raw is None:
                        raise ValueError("null")
                    for fields, block in arc_records(b"".join(inflated(raw))):
                        rows.append((fields["url"], timestamp(fields["date"]), warc_record(fields, block, None) + END, None))
                except (ValueError, zlib.error) as e:
                    rows.append((None, None, None, str(e)))
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.string(), pa.string(), pa.binary(), pa.string()], strict=True)], ["uri", "date", "record", "error"])

        return run

    return map_arrow(arcs.select(F.col(content_col)), start, "uri string, date string, record binary, error string")
