"""WARC archives: written with one gzip member per record, read back in sequence.

A task writes archives of bounded size into the given folder; names are unique per
attempt, and only archives named in the returned list count, so a retried task
leaves no record twice. The reader inflates archives piece by piece, frames records
by their content length while it does, feeds their digests as bytes come and checks them: without
payloads a task holds one piece and the headers of a record, whatever the record's length.

Of records with the same payload (from ``MIN_REVISIT`` bytes on) the one with the
smallest id is a response, the others are revisits that refer to it and carry only
the headers. Which payloads repeat is found from digests summed per task.

Cases: a null text is an empty payload; shorter payloads are always responses; rows
that share the smallest id are all responses; a null id comes after all ids (if all
are null, all are responses); a null url gives a record without a target; an empty table
gives an empty list of archives; extra columns are not written.
"""
from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rotapanel.llm.steps import written
from rotapanel.session import shared_dir

MIN_REVISIT = 100
ARCHIVE_BYTES = 64 << 20
READ = 1 << 18
ARCHIVES = "path string, n_records long, n_bytes long"
RECORDS = (
    "record_id string, page_id long, record_type string, target_uri string, payload_digest string, "
    "payload_bytes long, refers_to long, payload binary"
)
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
_ID = "<urn:page:%s>"


def _digest(data: bytes) -> str:
    return "sha256:" + hashlib.sha256(data).hexdigest()


def _clean(value: str) -> str:
    """A header's value on one line."""
    return "".join(c if c.isprintable() else "".join(f"%{b:02X}" for b in c.encode()) for c in value)


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    http = _HTTP % len(payload)
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_ID % ('' if page_id is None else page_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        "Content-Type: application/http;msgtype=response",
        f"WARC-Block-Digest: {_digest(block)}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    if revisit:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: {_ID % refers_to}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 6) -> bytes:
    deflate = zlib.compressobj(level, zlib.DEFLATED, 31)
    return deflate.compress(data) + deflate.flush()


def mark_revisits(pages: DataFrame, key: str, url: str, text: str) -> DataFrame:
    """(id, url, payload, digest, first): first is the id of the response to refer to, or null."""
    payload = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    rows = pages.select(
        F.col(key).cast("long").alias("id"), F.col(url).alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("digest")
    )
    # Stored by itself, so that Spark can split the join where a payload is very common.
    repeated = written(
        rows.where(F.length("payload") >= MIN_REVISIT)
        .groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n"))
        .where("n > 1 AND first IS NOT NULL").drop("n")
    )
    later = F.col("id").isNull() | (F.col("id") > F.col("first"))
    return rows.join(repeated, "digest", "left").withColumn("first", F.when(later, F.col("first")))


def write_archives(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", text: str = "html") -> DataFrame:
    """Writes all rows as records; returns the list of archives (path, n_records, n_bytes)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        out, path, done = None, "", []
        records = size = 0
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    path, records, size = f"part-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{base}/{path}", compression=None)
                member = gzip_member(
                    record_bytes(row["id"], row["url"], row["payload"], row["digest"], row["first"], row["first"] is not None)
                )
                out.write(member)
                records, size = records + 1, size + len(member)
                if size >= ARCHIVE_BYTES:
                    out.close()
                    done.append((path, records, size))
                    out = None
        if out is not None:
            out.close()
            done.append((path, records, size))
        yield pa.RecordBatch.from_arrays(
            [pa.array([f"{folder}/{p}" for p, _, _ in done], pa.string()), pa.array([n for _, n, _ in done], pa.int64()),
             pa.array([b for _, _, b in done], pa.int64())], ["path", "n_records", "n_bytes"],
        )

    rows = mark_revisits(pages, key, url, text).select("id", "url", "payload", "digest", "first")
    return written(rows.mapInArrow(write, ARCHIVES))


def _checked(name: str, told: str | None, sha256, sha1) -> None:
    """Raises if a digest header differs; a header that is absent or of another kind can't be checked."""
    kind, _, value = (told or "").partition(":")
    if kind == "sha256" and value.lower() != sha256.hexdigest():
        raise ValueError(f"digest of the {name} differs")
    if kind == "sha1" and value.upper() != base64.b32encode(sha1.digest()).decode():
        raise ValueError(f"digest of the {name} differs")


class Framer:
    """Cuts inflated bytes into records as they come.

    Only headers and, if asked for, the payload of the current record are held; digests are fed piece by piece.
    A block that isn't HTTP is its own payload.
    """

    def __init__(self, payloads: bool = True):
        self.payloads = payloads
        self._begin()

    def _begin(self) -> None:
        self.head, self.fields, self.left, self.end = bytearray(), None, 0, b""
        self.http, self.told, self.size, self.parts = None, None, 0, []
        self.block_sha = hashlib.sha256(), hashlib.sha1()
        self.payload_sha = hashlib.sha256(), hashlib.sha1()

    @property
    def between(self) -> bool:
        """No record has begun."""
        return self.fields is None and not self.head

    def feed(self, piece: bytes) -> Iterator[dict]:
        while piece:
            if self.fields is None:
                piece = self._fill(self.head, piece)
                if piece is None:
                    return
                self._open(bytes(self.head))
            elif self.left:
                part, piece = piece[: self.left], piece[self.left :]
                self.left -= len(part)
                self._block(part)
            if self.fields is not None and not self.left:
                more = 4 - len(self.end)
                self.end, piece = self.end + piece[:more], piece[more:]
                if not b"\r\n\r\n".startswith(self.end):
                    raise ValueError("the record's length differs from its header")
                if len(self.end) == 4:
                    yield self._close()
                    self._begin()

    @staticmethod
    def _fill(head: bytearray, piece: bytes) -> bytes | None:
        """Adds to a head up to its empty line; what follows it, or None if the line is still to come."""
        seen = max(0, len(head) - 3)
        head += piece
        at = head.find(b"\r\n\r\n", seen)
        if at < 0:
            return None
        rest = bytes(head[at + 4 :])
        del head[at:]
        return rest

    def _open(self, head: bytes) -> None:
        lines = head.decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a record")
        self.fields = {k.strip().lower(): v.removeprefix(" ") for k, _, v in (x.partition(":") for x in lines[1:])}
        self.left = int(self.fields["content-length"])
        if self.fields.get("content-type", "").startswith("application/http"):
            self.http = bytearray()

    def _block(self, part: bytes) -> None:
        for sha in self.block_sha:
            sha.update(part)
        if self.http is not None and self.told is None:
            part = self._fill(self.http, part)
            if part is None:
                return
            lengths = [x.partition(b":")[2] for x in bytes(self.http).split(b"\r\n") if x.lower().startswith(b"content-length:")]
            self.told = int(lengths[0]) if lengths else -1
        for sha in self.payload_sha:
            sha.update(part)
        self.size += len(part)
        if self.payloads:
            self.parts.append(part)

    def _close(self) -> dict:
        fields, kind = self.fields, self.fields["warc-type"]
        name = fields["warc-record-id"]
        _checked(f"block of {name}", fields.get("warc-block-digest"), *self.block_sha)
        told = self.size if self.told in (None, -1) else self.told
        if kind != "revisit":
            if told != self.size:
                raise ValueError(f"payload of {name} differs from its header")
            _checked(f"payload of {name}", fields.get("warc-payload-digest"), *self.payload_sha)

        def page(field: str) -> int | None:
            value = fields.get(field, "")
            return int(value[len("<urn:page:") : -1]) if value.startswith("<urn:page:") and len(value) > len("<urn:page:>") else None

        return {
            "record_id": name, "page_id": page("warc-record-id"), "record_type": kind, "target_uri": fields.get("warc-target-uri"),
            "payload_digest": fields.get("warc-payload-digest", "sha256:" + self.payload_sha[0].hexdigest()).removeprefix("sha256:"),
            "payload_bytes": told, "refers_to": page("warc-refers-to"),
            "payload": b"".join(self.parts) if self.payloads and kind != "revisit" else None,
        }


def records(stream, payloads: bool = True, read: int = READ) -> Iterator[dict]:
    """The records of an archive, verified; at most ``read`` bytes are inflated at a time, however long a record is."""
    framer, inflate = Framer(payloads), None
    while data := stream.read(read):
        while data:
            inflate = inflate or zlib.decompressobj(31)
            yield from framer.feed(inflate.decompress(data, read))
            if inflate.eof:
                if not framer.between:
                    raise ValueError("a member ends within a record")
                data, inflate = inflate.unused_data, None
            else:
                data = inflate.unconsumed_tail
    if inflate is not None:
        raise ValueError("the archive ends within a record")


def parse_record(data: bytes) -> dict:
    """Headers and payload of one record; raises if framing or digests don't fit."""
    framer = Framer()
    found = list(framer.feed(data))
    if len(found) != 1 or not framer.between:
        raise ValueError("not one whole record")
    return found[0]


def check_revisits(found: DataFrame) -> None:
    """Ends the job if a revisit's payload digest isn't that of a response with the id that it refers to."""
    # Stored by itself, so that Spark can split the join where many pages revisit one.
    claims = written(found.where("record_type = 'revisit'").selectExpr("refers_to AS page_id", "payload_digest").distinct())
    responses = found.where("record_type = 'response'").select("page_id", "payload_digest")
    wrong = claims.join(responses, ["page_id", "payload_digest"], "left_anti")
    if not wrong.isEmpty():
        raise ValueError(f"page {wrong.first().page_id} isn't the payload that its revisits tell of")


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """All records of the listed archives, each verified; a wrong record ends the job."""
    schema = pa.schema([
        ("record_id", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("target_uri", pa.string()),
        ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary()),
    ])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, path = fs.FileSystem.from_uri(row["path"])
                rows, size, n = [], 0, 0
                with store.open_input_stream(path, compression=None) as stream:
                    for record in records(stream, payloads):
                        n += 1
                        size += 400 + len(record["payload"] or b"")
                        rows.append(record)
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
                if n != row["n_records"]:
                    raise ValueError(f"{row['path']} holds {n} of {row['n_records']} records")
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    # One archive is one unit of work.
    n = max(1, min(10_000, archives.count()))
    return archives.select("path", "n_records").repartition(n, "path").mapInArrow(read, RECORDS)


def archive_folder(spark, name: str) -> str:
    """A new folder in the shared one."""
    return f"{shared_dir(spark)}/rotapanel/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
