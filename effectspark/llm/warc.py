"""WARC archives: one gzip member per record, written and read by ranges of bytes.

Writing: each task writes files of its own and returns their names; only files
that the committed list names are ever read, so a task that is lost or runs twice
leaves no double records. Reading: files are cut into byte ranges of one size. A
task scans its range for the gzip magic, accepts a candidate if it decodes to a
WARC header, and owns the records that start inside its range, the last of which
may end beyond it. Records are handled one at a time.

Files are opened with ``pyarrow.fs``, so the folder may be local-shared (``file:``),
``s3:``, ``gs:`` or ``hdfs:``.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from effectspark.sources.store import Stored, Workspace

# Fixed values of the format.
MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1"
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
GZIP = 31  # zlib's code for a gzip wrapper
END = b"\r\n\r\n"

LEAST_SHARED = 1000  # bytes; smaller payloads are always written out
RANGE_BYTES = 32 << 20
FILE_BYTES = 1 << 30
READ_BYTES = 1 << 16
RECORDS_AT_ONCE = 64

FILES = "path string, bytes bigint, records bigint"
RECORDS = (
    "record_id string, record_type string, target_uri string, refers_to string, "
    "payload_bytes bigint, payload_digest string"
)


def decide_revisits(pages: DataFrame) -> DataFrame:
    """Add ``digest`` and ``refers_to`` (NULL: a response) to (page_id, url, payload).

    A NULL payload is empty. Payloads are equal if SHA-1, a second hash and length agree. Of at least
    LEAST_SHARED equal bytes the row with the largest page_id is the response and the
    others refer to it. Rows that repeat the largest page_id are all responses, as are
    all rows of a group without any page_id. A payload's rows meet only as sums; the
    join back, of large payloads only, splits popular ones.
    """
    keys = ["digest", "second", "size"]
    full = pages.select("page_id", "url", F.coalesce("payload", F.lit(b"")).alias("payload"))
    large = F.octet_length("payload") >= LEAST_SHARED
    hashed = full.filter(large).withColumns(
        {"digest": F.sha1("payload"), "second": F.xxhash64("payload"), "size": F.octet_length("payload")}
    )
    shared = (
        hashed.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("copies"), F.max("page_id").alias("head"))
        .filter("copies > 1 AND head IS NOT NULL")
        .drop("copies")
    )
    joined = hashed.join(shared, keys, "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("head")), F.col("head"))
    decided = joined.select("page_id", "url", "payload", "digest", refers.alias("refers_to"))
    never = F.lit(None).cast(pages.schema["page_id"].dataType)
    small = full.filter(~large).select("page_id", "url", "payload", F.sha1("payload").alias("digest"), never.alias("refers_to"))
    return decided.unionByName(small)


def write(pages: DataFrame, ws: Workspace, folder: str, level: int = 1) -> Stored:
    """Write the rows of :func:`decide_revisits` below ``folder``; the list of files.

    A NULL url becomes the record's own name, a NULL page_id the name ``none``.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for batch in batches:
            for row in batch.to_pylist():
                if out and out.bytes >= FILE_BYTES:
                    yield out.close()
                    out = None
                out = out or _Archive(folder, level)
                out.add(row)
        if out:
            yield out.close()

    return ws.save(pages.mapInArrow(task, FILES), "archive-files")


class _Archive:
    """One file being written."""

    def __init__(self, folder: str, level: int):
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        name = f"{uuid.uuid4().hex}.warc.gz"
        self.path, self.level = f"{folder}/{name}", level
        self.stream, self.bytes, self.records = store.open_output_stream(f"{root}/{name}", compression=None), 0, 0
        info = b"software: effectspark\r\nformat: WARC File Format 1.1\r\n"
        self._member(
            {"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": DATE,
             "Content-Type": "application/warc-fields"}, info,
        )

    def add(self, row: dict) -> None:
        payload, name = row["payload"] or b"", _name(row["page_id"])
        digest = base64.b32encode(bytes.fromhex(row["digest"])).decode()
        fields = {
            "WARC-Type": "response",
            "WARC-Record-ID": f"<{name}>",
            "WARC-Target-URI": quote(row["url"], safe="!#$%&'()*+,/:;=?@[]~") if row["url"] else name,
            "WARC-Date": DATE,
            "WARC-Payload-Digest": f"sha1:{digest}",
            "Content-Type": "application/http; msgtype=response",
        }
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
        if row["refers_to"] is None:
            block += payload
        else:
            fields |= {"WARC-Type": "revisit", "WARC-Profile": PROFILE, "WARC-Refers-To": f"<{_name(row['refers_to'])}>"}
        self._member(fields, block)
        self.records += 1

    def _member(self, fields: dict[str, str], block: bytes) -> None:
        fields["Content-Length"] = str(len(block))
        head = VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()).encode() + b"\r\n"
        pack = zlib.compressobj(self.level, zlib.DEFLATED, GZIP)
        member = pack.compress(head + block + END) + pack.flush()
        self.stream.write(member)
        self.bytes += len(member)

    def close(self) -> pa.RecordBatch:
        self.stream.close()
        return pa.RecordBatch.from_pylist([{"path": self.path, "bytes": self.bytes, "records": self.records}])


def _name(page_id: int | None) -> str:
    return f"urn:page:{'none' if page_id is None else page_id}"


@dataclass
class Record:
    fields: dict[str, str]
    block: bytes

    @property
    def payload(self) -> bytes:
        """What follows the HTTP header; the block itself if there is none."""
        if not self.block.startswith(b"HTTP/"):
            return self.block
        return self.block.partition(END)[2]

    def payload_length(self) -> int:
        """Of the full payload, also where a revisit leaves it out."""
        if self.fields.get("warc-type") == "revisit":
            stated = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", self.block.partition(END)[0] + b"\r\n")
            return int(stated[1]) if stated else 0
        return len(self.payload)

    def payload_sha1(self) -> str:
        if self.fields.get("warc-type") == "revisit":
            return base64.b32decode(self.fields["warc-payload-digest"].removeprefix("sha1:")).hex()
        return hashlib.sha1(self.payload).hexdigest()


def read(files: DataFrame, range_bytes: int = RANGE_BYTES, payload: bool = False) -> DataFrame:
    """The records of the listed (path, bytes) archives: RECORDS, with the payload if asked for.

    ``warcinfo`` records are skipped. The digest of a payload that is there is computed,
    not taken from its header, and must agree with it. An empty list gives no records.
    """
    cuts = F.sequence(F.lit(0).cast("bigint"), F.col("bytes") - 1, F.lit(range_bytes).cast("bigint"))
    ranges = files.filter("bytes > 0").select("path", F.explode(cuts).alias("start"))
    spread = ranges.repartition(F.col("path"), F.col("start"))
    schema = RECORDS + (", payload binary" if payload else "")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                rows = []
                for record in scan(row["path"], row["start"], row["start"] + range_bytes):
                    if record.fields.get("warc-type") != "warcinfo":
                        rows.append(_row(record, payload))
                    if len(rows) == RECORDS_AT_ONCE:
                        yield _batch(rows, payload)
                        rows = []
                if rows:
                    yield _batch(rows, payload)

    return spread.mapInArrow(task, schema)


def _row(record: Record, payload: bool) -> dict:
    fields, found = record.fields, record.payload_sha1()
    stated = fields.get("warc-payload-digest", "")
    if stated.startswith("sha1:") and base64.b32decode(stated[5:]).hex() != found:
        raise ValueError(f"payload of {fields.get('warc-record-id')} does not match its digest")
    row = {
        "record_id": fields.get("warc-record-id", "").strip("<>"),
        "record_type": fields.get("warc-type"),
        "target_uri": fields.get("warc-target-uri"),
        "refers_to": fields["warc-refers-to"].strip("<>") if "warc-refers-to" in fields else None,
        "payload_bytes": record.payload_length(),
        "payload_digest": found,
    }
    return row | ({"payload": record.payload} if payload else {})


def _batch(rows: list[dict], payload: bool) -> pa.RecordBatch:
    text, number = pa.string(), pa.int64()
    kinds = [("record_id", text), ("record_type", text), ("target_uri", text), ("refers_to", text),
             ("payload_bytes", number), ("payload_digest", text), *([("payload", pa.binary())] if payload else [])]
    return pa.RecordBatch.from_pylist(rows, schema=pa.schema(kinds))


def scan(path: str, start: int, stop: int) -> Iterator[Record]:
    """The records whose gzip member starts in ``[start, stop)`` of the file."""
    store, name = fs.FileSystem.from_uri(path)
    with store.open_input_file(name) as f:
        end = min(stop, f.size())
        at = start
        while at < end:
            f.seek(at)
            block = f.read(min(READ_BYTES, end - at + len(MAGIC) - 1))
            hit = block.find(MAGIC)
            if hit < 0:
                at += max(1, len(block) - len(MAGIC) + 1)
                continue
            at += hit
            if at >= end:
                return
            found = _member(f, at)
            if found is None:
                at += 1
            else:
                record, at = found
                yield record


def _member(f, at: int) -> tuple[Record, int] | None:
    """The record at an offset and the offset after it; None if no WARC member starts there."""
    f.seek(at)
    unpack, parts, checked, taken = zlib.decompressobj(GZIP), [], False, 0
    head = b""
    try:
        while not unpack.eof:
            block = f.read(READ_BYTES)
            if not block:
                return None
            taken += len(block)
            parts.append(unpack.decompress(block))
            if not checked:
                head = b"".join(parts)
                if len(head) >= 5:
                    if not head.startswith(b"WARC/"):
                        return None
                    checked = True
    except zlib.error:
        return None
    record = parse(b"".join(parts))
    return None if record is None else (record, at + taken - len(unpack.unused_data))


def parse(content: bytes) -> Record | None:
    """A record from its bytes; None if header and length do not fit."""
    head, gap, rest = content.partition(END)
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not gap or not lines[0].startswith("WARC/"):
        return None
    fields = {k.strip().lower(): v.strip() for k, colon, v in (x.partition(":") for x in lines[1:]) if colon}
    if not fields.get("content-length", "").isdigit():
        return None
    length = int(fields["content-length"])
    return Record(fields, rest[:length]) if len(rest) >= length else None
