"""WARC archives: one gzip member per record, a sequential reader with incremental
decompression, content-length framing and digest verification.

write_archives() turns rows into rolled `.warc.gz` files below a shared folder and
returns the manifest of files; read_archives() reads the files of a manifest back, one
record after the other, and never holds more than one record and one read buffer.
A file has the writing task's attempt in its name and only files of the manifest are
read, so a task that is run again leaves at most an unlisted file.

Cases: a null payload is empty; a null url has no target header; a null page_id is
written without number, is always a response and is nobody's target. Of rows that repeat
the smallest page_id of a payload, each is a response. No pages give no files and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pushflow.llm.common import saved, work_path

BUFFER = 1 << 16
#: Content that revisits leave out; its digest stands in their header.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class WarcError(ValueError):
    """A record that breaks the format or does not fit its digest."""


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data, usedforsecurity=False).digest()).decode()


def _one_line(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record(page_id: int | None, url: str | None, payload: bytes, payload_digest: str, refers_to: int | None) -> bytes:
    """One WARC record as a gzip member. A revisit has the HTTP head only."""
    revisit = refers_to is not None
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block += b"" if revisit else payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_one_line(url)}")
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += [f"WARC-Payload-Digest: sha1:{payload_digest}", f"WARC-Block-Digest: sha1:{digest(block)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + deflate.flush()


class _Member:
    """The decompressed bytes of one gzip member, read as needed from a stream of members."""

    def __init__(self, stream, rest: bytes):
        self.stream, self.zip, self.input, self.out = stream, zlib.decompressobj(31), rest, b""

    def more(self) -> bool:
        """Decompress one buffer; False at the member's end."""
        if self.zip.eof:
            return False
        if not self.input:
            self.input = self.stream.read(BUFFER)
            if not self.input:
                raise WarcError("the file ends inside a gzip member")
        self.out += self.zip.decompress(self.input, BUFFER)
        self.input = self.zip.unconsumed_tail
        return True

    def until(self, mark: bytes) -> bytes:
        while (at := self.out.find(mark)) < 0:
            if not self.more():
                raise WarcError("a record's head has no end")
        got, self.out = self.out[:at], self.out[at + len(mark) :]
        return got

    def take(self, n: int) -> bytes:
        parts, have = [self.out], len(self.out)
        self.out = b""
        while have < n:
            if not self.more():
                raise WarcError("a record is shorter than its content length")
            parts.append(self.out)
            have += len(self.out)
            self.out = b""
        whole = b"".join(parts)
        self.out = whole[n:]
        return whole[:n]

    def end(self) -> bytes:
        """Check what follows the block; returns the input that belongs to the next member."""
        if self.take(4) != b"\r\n\r\n":
            raise WarcError("a record does not end in two line breaks")
        while self.more():
            pass
        if self.out:
            raise WarcError("a member holds more than one record")
        return self.zip.unused_data


def _headers(raw: bytes) -> dict[str, str]:
    lines = raw.decode().split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def records(stream) -> Iterator[tuple[dict[str, str], dict[str, str], bytes]]:
    """WARC headers, HTTP headers and payload of each record; raises WarcError on damage."""
    rest = b""
    while True:
        rest = rest or stream.read(BUFFER)
        if not rest:
            return
        member = _Member(stream, rest)
        raw = member.until(b"\r\n\r\n")
        if not raw.startswith(b"WARC/1."):
            raise WarcError("a record does not begin with its version")
        head = _headers(raw)
        block = member.take(int(head["content-length"]))
        rest = member.end()
        if head.get("warc-block-digest", "") != f"sha1:{digest(block)}":
            raise WarcError("a block does not fit its digest")
        http, _, payload = block.partition(b"\r\n\r\n")
        if head["warc-type"] == "response" and head["warc-payload-digest"] != f"sha1:{digest(payload)}":
            raise WarcError("a payload does not fit its digest")
        yield head, _headers(http), payload


def _number(urn: str | None) -> int | None:
    inner = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(inner) if inner else None


MANIFEST = "path string, records long, bytes long"


def write_archives(pages: DataFrame, folder: str, roll: int = 32 << 20) -> DataFrame:
    """pages(page_id, url, payload, payload_digest, refers_to) into files of about `roll` bytes.

    Returns the manifest, written as a table, of the files that successful tasks finished.
    """

    def write(batches):
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        out = name = None
        size = count = 0
        for batch in batches:
            for i in range(batch.num_rows):
                if out is None:
                    name = f"{root}/{uuid.uuid4().hex}.warc.gz"
                    out, size, count = fs.open_output_stream(name, compression=None), 0, 0
                page_id, url, payload, sha, target = (batch.column(k)[i].as_py() for k in range(5))
                out.write(data := record(page_id, url, payload, sha, target))
                size, count = size + len(data), count + 1
                if size >= roll:
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_pylist([{"path": name, "records": count, "bytes": size}])
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pylist([{"path": name, "records": count, "bytes": size}])

    rows = pages.select("page_id", "url", "payload", "payload_digest", "refers_to")
    return saved(rows.mapInArrow(write, MANIFEST), "manifest")


RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def read_archives(manifest: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """Every record of the manifest's files, verified. payload is null for revisits, or if not wanted."""

    def read(batches):
        fs, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, size = [], 0
                with fs.open_input_stream(path, compression=None) as stream:
                    for head, http, payload in records(stream):
                        answer = head["warc-type"] == "response"
                        sha = head["warc-payload-digest"].removeprefix("sha1:")
                        rows.append((_number(head["warc-record-id"]), head.get("warc-target-uri"), len(payload) if answer else int(http["content-length"]), sha, head["warc-type"], _number(head.get("warc-refers-to")), payload if payloads and answer else None))
                        size += len(payload) + 200
                        if size > 1 << 22:
                            yield _batch(rows)
                            rows, size = [], 0
                if rows:
                    yield _batch(rows)

    files = max(1, manifest.count())
    return manifest.select("path").repartition(files).mapInArrow(read, RECORDS)


_TYPES = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
_NAMES = [x.split()[0] for x in RECORDS.split(", ")]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=_NAMES)


def prepare(pages: DataFrame, body: str = "html", least: int = 0) -> DataFrame:
    """Digest every payload and point repeated ones of `least` bytes or more at the smallest page_id.

    The first page of a payload comes from an aggregation of (digest, page_id) that is
    combined before it is shuffled; the join back is on the digest, and only for digests
    that more than one row has, so a payload that a third of all pages share is a skewed
    side that AQE splits against one row.
    """

    def digests(batches):
        for batch in batches:
            payload = [b"" if x is None else x for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.string()), pa.array(payload, pa.binary()), pa.array(map(digest, payload), pa.string())], names=["page_id", "url", "payload", "payload_digest"])

    rows = pages.select("page_id", "url", F.col(body).cast("binary").alias("payload")).mapInArrow(digests, "page_id long, url string, payload binary, payload_digest string")
    firsts = rows.where(F.octet_length("payload") >= least).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    return rows.join(firsts, "payload_digest", "left").withColumn("refers_to", F.when(F.col("page_id") > F.col("first"), F.col("first"))).drop("first")


def round_trip(pages: DataFrame, body: str = "html", least: int = 0, payloads: bool = False) -> DataFrame:
    """Write every page and read the archives back."""
    folder = work_path(pages.sparkSession, "warc")
    return read_archives(write_archives(prepare(pages, body, least), folder), folder, payloads)
