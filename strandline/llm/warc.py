"""WARC files: a sequential reader of gzip members, and the writer that makes its files.

The reader takes one stream of compressed bytes and never holds more than one record: a member is inflated piece by piece,
its header block is cut off, content-length frames the body, and the block and payload digests of the header are compared with the
bytes they are of. A damaged record is reported and the reader goes on at the next member.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import core, files

#: Compressed bytes read, and bytes inflated, at once.
READ = 1 << 20
#: Bytes of one inflated member from which on it is not kept: no column could hold it.
LARGEST = 1 << 30
#: Rows of one batch, and bytes of their bodies, that are sent on together.
ROWS, BYTES = 512, 8 << 20
#: Compression level of written members.
LEVEL = 6
SCHEMA = "path string, position long, type string, uri string, record_id string, date string, content_type string, length long, digest_ok boolean, error string, body binary"
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
TYPES = [pa.string(), pa.int64(), *[pa.string()] * 5, pa.int64(), pa.bool_(), pa.string(), pa.binary()]


def digest(body: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()


def same_digest(stated: str, body: bytes) -> bool | None:
    """Whether a labelled digest is that of the bytes, in base 32, 16 or 64; None for an algorithm that isn't known or a value that is no digest."""
    label, _, value = stated.strip().partition(":")
    label = label.strip().lower().replace("-", "")
    if label not in ("sha1", "sha256", "sha384", "sha512", "md5"):
        return None
    have, value = hashlib.new(label, body).digest(), value.strip()
    try:
        if len(value) == 2 * len(have):
            return bytes.fromhex(value) == have
        if len(value.rstrip("=")) == -(-len(have) * 8 // 5):
            bare = value.rstrip("=").upper()
            return base64.b32decode(bare + "=" * (-len(bare) % 8)) == have
        if len(value.rstrip("=")) == -(-len(have) * 8 // 6):
            bare = value.rstrip("=")
            return base64.b64decode(bare.replace("-", "+").replace("_", "/") + "=" * (-len(bare) % 4)) == have
    except (ValueError, binascii.Error):
        pass
    return None


def payloads(body: bytes, content_type: str) -> list[bytes]:
    """What a payload digest may be of: a message's body, without its chunk marks too if it has such, or the whole block of another type."""
    if not content_type.lower().replace(" ", "").startswith("application/http"):
        return [body]
    head, gap, rest = body.partition(b"\r\n\r\n")
    if not gap:
        return [b""]
    if b"\ntransfer-encoding: chunked" not in head.lower():
        return [rest]
    whole, at = b"", 0
    while (end := rest.find(b"\r\n", at)) > 0:
        try:
            size = int(rest[at:end].split(b";")[0], 16)
        except ValueError:
            break
        if not size:
            return [rest, whole]
        whole, at = whole + rest[end + 2 : end + 2 + size], end + 4 + size
    return [rest]


def record(kind: str, uri: str | None, name: str, body: bytes, content_type: str = "text/html", date: str = "2024-01-01T00:00:00Z", extra: tuple = ()) -> bytes:
    """One record as a gzip member of its own. Line ends in a URI are escaped, so that they can't end the header line."""
    lines = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {date}", f"Content-Type: {content_type}", f"WARC-Block-Digest: {digest(body)}", f"WARC-Payload-Digest: {digest(payloads(body, content_type)[0])}", f"Content-Length: {len(body)}", *extra]
    if uri is not None:
        lines.insert(2, "WARC-Target-URI: " + uri.replace("\r", "%0D").replace("\n", "%0A"))
    pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + pack.flush()


def members(stream):
    """(position, bytes or None, error) of each gzip member. The bytes of a damaged one, and of one larger than LARGEST, are None; reading goes on at the
    next sign of a member."""
    buffer, base, at_end = b"", 0, False
    while True:
        if not buffer:
            buffer = stream.read(READ)
            if not buffer:
                return
        inflate, out, used, size = zlib.decompressobj(31), [], 0, 0
        try:
            while True:
                part = inflate.decompress(buffer, READ)
                size += len(part)
                if size <= LARGEST:
                    out.append(part)
                else:
                    out.clear()
                left = inflate.unused_data if inflate.eof else inflate.unconsumed_tail
                used += len(buffer) - len(left)
                buffer = left
                if inflate.eof:
                    break
                if not buffer and len(part) < READ:
                    buffer = stream.read(READ)
                    if not buffer:
                        at_end = True
                        raise zlib.error("cut short")
            yield base, b"".join(out) if size <= LARGEST else None, None if size <= LARGEST else f"larger than {LARGEST} bytes"
            base += used
        except zlib.error as e:
            yield base, None, str(e)
            if at_end:
                return
            # The place after this member's first byte isn't in the buffer if it was read in pieces; go on in what is left.
            skipped = 1 if not used else 0
            while (found := buffer.find(b"\x1f\x8b\x08", skipped)) < 0:
                more = stream.read(READ)
                if not more:
                    return
                used, buffer, skipped = used + max(0, len(buffer) - 2), buffer[-2:] + more, 0
            base, buffer = base + used + found, buffer[found:]


def parse(data: bytes) -> dict:
    """The fields of one record. The error names what is wrong: no version line, no or a wrong content-length, or another digest."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields: dict[str, str] = {}
    last = None
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and last:
            fields[last] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        if colon:
            last = name.strip().lower()
            fields[last] = value.strip()
    out = {"type": fields.get("warc-type"), "uri": fields.get("warc-target-uri"), "record_id": (fields.get("warc-record-id") or "").strip("<>") or None, "date": fields.get("warc-date"), "content_type": fields.get("content-type"), "fields": fields}
    if not lines[0].startswith("WARC/") or not gap:
        return out | {"error": "no record header"}
    size = fields.get("content-length", "")
    if not size.isdigit():
        return out | {"error": "no content length"}
    if len(rest) < int(size):
        return out | {"error": "shorter than its content length", "body": rest}
    body, tail = rest[: int(size)], rest[int(size) :]
    out |= {"length": int(size), "body": body}
    if tail != b"\r\n\r\n":
        out["error"] = "no end after the content length"
    found = []
    if want := fields.get("warc-block-digest"):
        found.append(same_digest(want, body))
    # A revisit's payload is elsewhere, and a segment's digest is of all segments.
    if (want := fields.get("warc-payload-digest")) and fields.get("warc-type") not in ("revisit", "continuation") and "warc-segment-number" not in fields:
        each = [same_digest(want, x) for x in payloads(body, fields.get("content-type", ""))]
        found.append(None if None in each else any(each))
    found = [x for x in found if x is not None]
    if found:
        out["digest_ok"] = all(found)
        if not all(found):
            out.setdefault("error", "another digest")
    return out


def read_records(paths: DataFrame) -> DataFrame:
    """All records of the files in the column path, one file a task at a time, as (path, position, type, uri, record_id, date,
    content_type, length, digest_ok, error, body).

    position is the member's first byte. digest_ok tells whether the block's and the payload's digests are right; it is null if the record has none, or none of
    a known algorithm. The payload of an HTTP message is its body. A damaged member, and one of more than LARGEST bytes, has a row with its error
    and no body. An empty file has no records, an empty table gives none; the same path twice is read twice; null paths are left out. Other columns aren't read.
    """

    def load(batches):
        rows, size = [], 0
        for batch in batches:
            for path in batch["path"].to_pylist():
                system, base = files.open_fs(path)
                with system.open_input_stream(base, compression=None) as stream:
                    for position, data, error in members(stream):
                        r = {"error": error} if data is None else parse(data)
                        rows.append((path, position, *(r.get(c) for c in NAMES[2:])))
                        size += len(r.get("body") or b"")
                        if len(rows) >= ROWS or size >= BYTES:
                            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), TYPES)], NAMES)
                            rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), TYPES)], NAMES)

    core.ship(paths.sparkSession)
    spread = paths.where("path is not null").select("path").repartition(int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")
    return spread.mapInArrow(core.tidy(load), SCHEMA)


def write_pages(pages: DataFrame, folder: str) -> DataFrame:
    """One WARC file for each partition of pages (page_id, url, html); gives their paths (path, records) as a written table.

    A file has a name of its own for each attempt at a task, and only those of successful ones are in the table. A null html is a record
    of no bytes, marked as such; a null url has no URI line. Repeated rows are written each, in the order that they come in; a text of any length is one record;
    an empty table gives files without records or none. Other columns are not read.
    """
    core.ship(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))

    def write(batches):
        context, count = TaskContext.get(), 0
        name = f"part-{context.partitionId():05d}-{context.taskAttemptId()}.warc.gz"
        with files.new_file(folder, name) as stream:
            for batch in batches:
                for page, url, html in zip(*(batch[c] for c in ("page_id", "url", "html"))):
                    html, page = html.as_py(), page.as_py()
                    stream.write(record("response", url.as_py(), f"urn:page:{'' if page is None else page}", (html or "").encode(), extra=("X-Null: 1",) if html is None else ()))
                    count += 1
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([count], pa.int64())], ["path", "records"])

    return core.written(rows.mapInArrow(core.tidy(write), "path string, records long"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC files and read again, with the text's MD5 beside the reader's own checks."""
    paths = write_pages(core.read(spark, sf_dir, "pages"), core.shared_dir(spark))
    return read_records(paths).select(
        F.regexp_extract("record_id", "urn:page:(.*)", 1).cast("long").alias("page_id"),
        F.col("type").alias("record_type"),
        F.col("uri").alias("url"),
        F.col("length").alias("n_bytes"),
        "digest_ok",
        F.col("body").cast("string").alias("html"),
        F.md5("body").alias("html_md5"),
    )


ORACLE = """SELECT page_id, 'response' AS record_type, url, CAST(strlen(html) AS BIGINT) AS n_bytes, TRUE AS digest_ok, html, md5(html) AS html_md5 FROM pages"""
