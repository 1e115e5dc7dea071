"""Web archives: legacy ARC files to WARC files, with revisit records for repeated payloads.

Archives are written by Spark's text writer, one record a line with the format's
own record end as the line separator, so commits, retries and any file system
that Spark knows work as for other tables; they are read as binary files.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, stored

#: Fields of a record's header line by version of the archive (fixed by the format).
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
KEY_HEADER = "X-Record-Key"
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")

ARC_SCHEMA = "archive_version int, url string, ip string, archive_date string, record_key string, http_head binary, payload binary, payload_bytes long, payload_digest string"
WARC_SCHEMA = "record_type string, record_id string, warc_date string, url string, record_key string, refers_to string, refers_to_key string, payload_bytes long, payload_digest string"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def field(text: str | None) -> str:
    """A header field: spaces and control characters percent-encoded, "-" for nothing."""
    return _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", text or "") or "-"


def arc_record(version: int, url: str, ip: str, date: str, kind: str, body: bytes, name: str = "-") -> bytes:
    values = [url, ip, date, kind, str(len(body))] if version == 1 else [url, ip, date, kind, "200", "-", "-", "0", name, str(len(body))]
    return " ".join(values).encode() + b"\n" + body


def arc_description(version: int, name: str, date: str) -> bytes:
    body = f"{version} 0 archive\n{' '.join(ARC_FIELDS[version])}\n".encode()
    return arc_record(version, f"filedesc://{name}", "0.0.0.0", date, "text/plain", body, name)


def write_arc(pages: DataFrame, path: str, date: str = "20260101000000", ip: str = "0.0.0.0") -> None:
    """pages (page_id, url, html) as gzipped ARC files of versions 1 and 2, one for each task.

    The body of a record is an HTTP response, with the page_id in a header of its
    own. Null html: an empty payload. Null url: "-". Null page_id: no such header.
    """

    def run(batches):
        part = TaskContext.get().partitionId()
        version = 1 + part % 2
        name = f"pages-{part:05d}.arc.gz"
        put = lambda records: pa.RecordBatch.from_arrays([pa.array(records, pa.binary())], names=["value"])
        yield put([arc_description(version, name, date)])
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                rows = batch.slice(a, 256).to_pylist()
                records = []
                for r in rows:
                    payload = (r["html"] or "").encode()
                    key = "" if r["key"] is None else f"{KEY_HEADER}: {r['key']}\r\n"
                    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n{key}\r\n"
                    records.append(arc_record(version, field(r["url"]), ip, date, "text/html", head.encode() + payload, name))
                yield put(records)

    rows = pages.select(F.col("page_id").cast("string").alias("key"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    rows.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\n").option("compression", "gzip").text(path)


class Damaged(ValueError):
    """An archive that does not hold what its header lines declare."""


def http_parts(block: bytes) -> tuple[bytes, dict[str, str], bytes]:
    """Head (with its blank line), header fields by lower-case name, payload. A block that is no HTTP message is all payload."""
    if not block.startswith(b"HTTP/"):
        return b"", {}, block
    head, blank, payload = block.partition(b"\r\n\r\n")
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    return head + blank, fields, payload


def arc_records(content: bytes):
    """Version, header fields by name, body, of each record but the description."""
    with gzip.GzipFile(fileobj=io.BytesIO(content)) as f:
        version = None
        while line := f.readline():
            line = line.rstrip(b"\r\n")
            if not line:
                continue
            values = line.decode("utf-8", "replace").split(" ")
            if not values[-1].isdecimal():
                raise Damaged("a header line of an ARC record ends with no length")
            body = f.read(int(values[-1]))
            if len(body) != int(values[-1]):
                raise Damaged("an ARC record is shorter than it declares")
            if version is None:
                if not values[0].startswith("filedesc://"):
                    raise Damaged("an ARC file starts with its description")
                number = body.split(b" ", 1)[0]
                if not number.isdigit() or int(number) not in ARC_FIELDS:
                    raise Damaged(f"ARC version {number!r} is not known")
                version = int(number)
                continue
            names = ARC_FIELDS[version]
            if len(values) != len(names):
                raise Damaged(f"a header line of ARC version {version} has {len(names)} fields")
            yield version, dict(zip(names, values)), body


def read_arc(spark, path: str, payloads: bool = True, damaged: str = "raise") -> DataFrame:
    """Records of ARC files (ARC_SCHEMA); payloads: with the bytes of head and payload, else null there.

    damaged: "raise" fails at the first record that is not as declared; "leave"
    takes a file's records up to there and goes on with the next file. A record
    that is no HTTP message is a payload without a head. A file is read in one
    piece, so it must not exceed 2 GB.
    """
    if damaged not in ("raise", "leave"):
        raise ValueError("damaged: raise or leave")

    def whole(content: bytes):
        try:
            yield from arc_records(content)
        except (Damaged, EOFError, zlib.error, gzip.BadGzipFile):
            if damaged == "raise":
                raise

    def run(batches):
        schema = pa.schema([("archive_version", pa.int32()), ("url", pa.string()), ("ip", pa.string()), ("archive_date", pa.string()), ("record_key", pa.string()), ("http_head", pa.binary()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for version, values, body in whole(content.as_py()):
                    head, fields, payload = http_parts(body)
                    rows.append((version, values["URL"], values["IP-address"], values["Archive-date"], fields.get(KEY_HEADER.lower()), head if payloads else None, payload if payloads else None, len(payload), sha1_base32(payload)))
                    held += len(body)
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, ARC_SCHEMA)


def record_id(key: str | None, url: str, date: str, digest: str) -> str:
    """A WARC record id that depends on the record alone, so that a repeated task writes the same one."""
    raw = hashlib.sha1("\n".join(["record", "" if key is None else key, digest, *([url, date] if key is None else [])]).encode()).digest()
    return f"<urn:uuid:{uuid.UUID(bytes=raw[:16], version=5)}>"


def warc_date(date: str) -> str:
    d = date.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + f"Content-Length: {len(block)}\r\n\r\n"
    return head.encode() + block


def write_warc(records: DataFrame, path: str, software: str = "archive converter") -> None:
    """ARC records with first_key (of the record whose payload theirs repeats, or null) as gzipped WARC files."""

    def run(batches):
        put = lambda x: pa.RecordBatch.from_arrays([pa.array(x, pa.binary())], names=["value"])
        part = TaskContext.get().partitionId()
        info = f"software: {software}\r\nformat: WARC File Format 1.0\r\n".encode()
        yield put([warc_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(None, "warcinfo", str(part), "")), ("WARC-Date", "2026-01-01T00:00:00Z"), ("Content-Type", "application/warc-fields")], info)])
        for batch in batches:
            for a in range(0, batch.num_rows, 128):
                out = []
                for r in batch.slice(a, 128).to_pylist():
                    block = r["http_head"] if r["first_key"] is not None else r["http_head"] + r["payload"]
                    fields = [("WARC-Type", "response" if r["first_key"] is None else "revisit"), ("WARC-Record-ID", record_id(r["record_key"], r["url"], r["archive_date"], r["payload_digest"])), ("WARC-Date", warc_date(r["archive_date"])), ("WARC-Target-URI", r["url"]), ("WARC-IP-Address", r["ip"])]
                    kind = "application/http; msgtype=response" if r["http_head"] else "application/octet-stream"
                    fields += [("WARC-Payload-Digest", f"sha1:{r['payload_digest']}"), ("X-Payload-Length", str(r["payload_bytes"])), ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"), ("Content-Type", kind)]
                    if r["first_key"] is not None:
                        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(r["first_key"], "", "", r["payload_digest"])), ("X-Refers-To-Key", r["first_key"])]
                    out.append(warc_record(fields, block))
                yield put(out)

    records.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


def warc_records(content: bytes):
    """Header fields by lower-case name and block of each record of a gzipped WARC file."""
    with gzip.GzipFile(fileobj=io.BytesIO(content)) as f:
        while line := f.readline():
            if line in (b"\r\n", b"\n"):
                continue
            if not line.startswith(b"WARC/"):
                raise Damaged("a WARC record starts with its version")
            fields = {}
            while (line := f.readline().rstrip(b"\r\n")) != b"":
                name, _, value = line.partition(b":")
                fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
            block = f.read(int(fields["content-length"]))
            if len(block) != int(fields["content-length"]):
                raise Damaged("a WARC record is shorter than it declares")
            yield fields, block


def read_warc(spark, path: str) -> DataFrame:
    """Response and revisit records of WARC files (WARC_SCHEMA); digests of blocks and payloads are checked."""

    def run(batches):
        names = [x.split()[0] for x in WARC_SCHEMA.split(", ")]
        types = [pa.int64() if x.endswith("long") else pa.string() for x in WARC_SCHEMA.split(", ")]
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for fields, block in warc_records(content.as_py()):
                    if fields["warc-type"] not in ("response", "revisit"):
                        continue
                    _, http, payload = http_parts(block)
                    digest = fields["warc-payload-digest"].removeprefix("sha1:")
                    if fields["warc-block-digest"] != f"sha1:{sha1_base32(block)}" or fields["warc-type"] == "response" and sha1_base32(payload) != digest:
                        raise Damaged("a WARC record does not have the digest that it declares")
                    size = len(payload) if fields["warc-type"] == "response" else int(fields["x-payload-length"])
                    rows.append((fields["warc-type"], fields["warc-record-id"], fields["warc-date"], fields["warc-target-uri"], http.get(KEY_HEADER.lower()), fields.get("warc-refers-to"), fields.get("x-refers-to-key"), size, digest))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, WARC_SCHEMA)


def convert(spark, arc_path: str, warc_path: str, least_bytes: int = 0, damaged: str = "raise") -> None:
    """ARC files to WARC files: of equal payloads of at least least_bytes, the record with the smallest key is a response and the others revisit it.

    Keys compare as integers; one that is no integer counts as none. Records without
    a key revisit one with a key, if there is one, and else are responses; records
    that share the smallest key are all responses. Only digests and keys are
    grouped; the payloads meet the list of repeated digests once. damaged: as for
    read_arc.
    """
    key = F.col("record_key").try_cast("long")
    slim = read_arc(spark, arc_path, payloads=False, damaged=damaged).select("payload_digest", "payload_bytes", key.alias("key"))
    repeated = slim.filter(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest").agg(F.min("key").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null")
    repeated = stored(repeated.select("payload_digest", "first"))
    full = read_arc(spark, arc_path, damaged=damaged).join(repeated, "payload_digest", "left")
    first = F.when(~F.col("first").eqNullSafe(key), F.col("first").cast("string"))
    write_warc(full.withColumn("first_key", F.when(F.col("payload_bytes") >= least_bytes, first)).drop("first"), warc_path)


def archived_pages(pages: DataFrame, least_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """pages through ARC and WARC files, as read back: page_id, payload_bytes, payload_digest, record_type, refers_to, url.

    Null html is an empty payload, null url "-". Rows that repeat a page_id are
    records of their own, and if it is the smallest of their payload all of them
    are responses. Payloads of any length below 2 GB stand whole in one record. An
    empty table makes archives without records and an empty result. Other columns
    are not read.
    """
    spark = pages.sparkSession
    folder = folder or shared_dir(spark)
    write_arc(pages, folder + "/arc")
    convert(spark, folder + "/arc", folder + "/warc", least_bytes)
    back = read_warc(spark, folder + "/warc")
    return back.select(F.col("record_key").try_cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to_key").cast("long").alias("refers_to"), "url")
