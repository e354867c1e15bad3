"""WARC archives: one gzip member per record, and a sequential, verifying reader.

Records whose payloads are equal share one ``response`` record; the others are
``revisit`` records that name it and repeat its payload digest. A revisit keeps the
HTTP header, and with it the payload's length, but not the payload.

Archives are written by tasks into a folder that all executors share, under names
of their own attempt; the table of written archives lists what successful attempts
wrote, and only those are read. The reader holds one record at a time.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellfold.llm.shared import cut, fresh_dir, open_fs, split_join

VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "urn:cellfold:page:"
#: A new archive begins after so many bytes.
ARCHIVE_BYTES = 64 << 20
#: Bytes decompressed at a time.
CHUNK = 1 << 16


class WarcError(ValueError):
    """An archive that breaks off or whose framing or digests are wrong."""


def digest(data: bytes) -> str:
    """SHA-1 in upper-case base32, without a prefix."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


@dataclass
class Record:
    kind: str
    headers: dict[str, str] = field(default_factory=dict)
    block: bytes = b""

    @property
    def payload(self) -> bytes:
        """The block after its HTTP header."""
        return self.block.partition(b"\r\n\r\n")[2]

    @property
    def http_length(self) -> int | None:
        """The payload's length as its HTTP header says."""
        head = self.block.partition(b"\r\n\r\n")[0]
        found = re.search(rb"(?im)^content-length:[ \t]*(\d+)[ \t]*\r?$", head)
        return int(found[1]) if found else None


def header_value(value: str) -> str:
    """``value`` without characters that end a header line; they are percent-encoded, and read back so."""
    return re.sub(r"[\x00-\x1f\x7f  ]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), value).strip()


def member(record: Record, level: int = 6) -> bytes:
    """The record as a gzip member of its own, with its block digest and length."""
    lines = [f"WARC-Type: {record.kind}", *(f"{k}: {header_value(v)}" for k, v in record.headers.items())]
    lines += [f"WARC-Block-Digest: sha1:{digest(record.block)}", f"Content-Length: {len(record.block)}"]
    head = VERSION + b"\r\n" + "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n"
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(head) + packer.compress(record.block) + packer.compress(b"\r\n\r\n") + packer.flush()


def page_record(page: str, url: str | None, payload: bytes, payload_digest: str, length: int, refers: str | None, revisit: bool, date: str) -> Record:
    """The record of a page; a revisit leaves the payload out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    headers = {"WARC-Record-ID": f"<{RECORD}{page}>", "WARC-Date": date}
    if url is not None:
        headers["WARC-Target-URI"] = url
    headers |= {"Content-Type": "application/http; msgtype=response", "WARC-Payload-Digest": f"sha1:{payload_digest}"}
    if revisit:
        headers |= {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<{RECORD}{refers}>"}
    return Record("revisit" if revisit else "response", headers, http if revisit else http + payload)


def read_records(stream: BinaryIO) -> Iterator[Record]:
    """Records of an archive in order, each member decompressed piece by piece.

    Raises WarcError at a wrong version line, a missing or wrong length, data after a
    record's end in its member, a member that breaks off, or a digest that doesn't hold.
    """
    waiting, number = b"", 0
    while True:
        if not waiting:
            waiting = stream.read(CHUNK)
            if not waiting:
                return
        unpack, parts, need = zlib.decompressobj(31), [], None
        head, size = bytearray(), 0
        headers: dict[str, str] = {}
        while not unpack.eof:
            if not waiting:
                waiting = stream.read(CHUNK)
                if not waiting:
                    raise WarcError(f"record {number}: the archive breaks off")
            try:
                data = unpack.decompress(waiting, CHUNK)
            except zlib.error as e:
                raise WarcError(f"record {number}: {e}") from e
            waiting = unpack.unused_data if unpack.eof else unpack.unconsumed_tail
            if need is None:
                # A header has any length; its end is looked for in what is new, and three bytes before.
                known = max(0, len(head) - 3)
                head += data
                end = head.find(b"\r\n\r\n", known)
                if end < 0:
                    continue
                data = bytes(head[end + 4 :])
                headers = _headers(bytes(head[:end]), number)
                need = int(headers["Content-Length"])
            parts.append(data)
            size += len(data)
            if size > need + 4:
                raise WarcError(f"record {number}: longer than its Content-Length of {need}")
        if need is None:
            raise WarcError(f"record {number}: its header has no end")
        body = b"".join(parts)
        if len(body) != need + 4 or body[need:] != b"\r\n\r\n":
            raise WarcError(f"record {number}: not framed by its Content-Length")
        record = Record(headers.pop("WARC-Type", ""), headers, body[:need])
        _verify(record, number)
        yield record
        number += 1


def _headers(head: bytes, number: int) -> dict[str, str]:
    first, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if first.encode() != VERSION:
        raise WarcError(f"record {number}: begins with {first[:40]!r}")
    headers = {k.strip(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    if not re.fullmatch("[0-9]{1,18}", headers.get("Content-Length", "")):
        raise WarcError(f"record {number}: no Content-Length")
    return headers


def _verify(record: Record, number: int) -> None:
    if f"sha1:{digest(record.block)}" != record.headers.get("WARC-Block-Digest"):
        raise WarcError(f"record {number}: the block digest doesn't hold")
    if record.kind == "response" and f"sha1:{digest(record.payload)}" != record.headers.get("WARC-Payload-Digest"):
        raise WarcError(f"record {number}: the payload digest doesn't hold")


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_revisit: int = 0, date: str = "2024-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record per row; returns (path, records, bytes) of the archives written.

    * Of rows with equal payloads of at least ``least_revisit`` bytes, that with the
      largest id is a response and the others are revisits of it; a row repeated with
      that id is a response again. Smaller payloads are all responses.
    * Null payloads count as empty. A null id never is a response where another id
      has the same payload. A null URL has no target line.
    * An empty table writes nothing. Columns besides the three are ignored.
    """
    payload = F.coalesce(F.col(f"`{payload_col}`").cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"), payload.alias("payload"))
    # Payloads are equal by SHA-256; known collisions of the format's SHA-1 stay apart.
    rows = rows.select("*", F.octet_length("payload").alias("length"), F.unhex(F.sha2("payload", 256)).alias("same"))
    known = rows.where(F.col("length") >= least_revisit).groupBy("same").agg(F.max("id").alias("first"), F.count("*").alias("n")).where("n > 1").select("same", "first")
    joined = split_join(rows, known, "same", "left")
    revisit = F.coalesce(F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first")), F.lit(False))
    ready = joined.select(F.col("id").cast("string").alias("id"), "url", F.when(~revisit, F.col("payload")).alias("payload"), "length", F.unhex(F.sha1("payload")).alias("sha"), F.when(revisit, F.col("first")).cast("string").alias("first"))

    def write(batches):
        task, fs, out, path, state = TaskContext.get(), None, None, "", [0, 0]
        where, number, done = open_fs(folder)[1], 0, []

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                done.append((f"{folder}/{path}", *state))
                out = None

        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    fs = fs or open_fs(folder)[0]
                    fs.create_dir(where, recursive=True)
                    path = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{number:04d}.warc.gz"
                    out, number = fs.open_output_stream(f"{where}/{path}"), number + 1
                    state[:] = [1, 0]
                    info = member(Record("warcinfo", {"WARC-Record-ID": f"<urn:cellfold:archive:{path}>", "WARC-Date": date, "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n"))
                    state[1] += out.write(info) or len(info)
                record = page_record(row["id"] or "", row["url"], row["payload"] or b"", base64.b32encode(row["sha"]).decode(), row["length"], row["first"], row["first"] is not None, date)
                data = member(record)
                out.write(data)
                state[:] = [state[0] + 1, state[1] + len(data)]
                if state[1] >= archive_bytes:
                    close()
        close()
        paths, records, sizes = zip(*done, strict=True) if done else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(records, pa.int64()), pa.array(sizes, pa.int64())], names=["path", "records", "bytes"])

    # Cut at once: the table then names files that exist, and nothing is written twice.
    return cut(ready.mapInArrow(write, "path string, records long, bytes long"))


READ = "record_id string, record_type string, url string, payload_bytes long, payload_digest string, refers_to string, payload binary"


def read_archives(archives: DataFrame, path_col: str = "path", payloads: bool = True) -> DataFrame:
    """The records (but for warcinfo) of the archives a table names, one task per group of archives.

    record_id and refers_to are record names; payload_bytes and payload_digest are of
    the full payload, also of revisits, whose payload is null. Without ``payloads`` all are.
    """

    def read(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, where = open_fs(path)
                with fs.open_input_stream(where) as stream:
                    rows, size = [], 0
                    for r in read_records(stream):
                        if r.kind == "warcinfo":
                            continue
                        body = r.payload if payloads and r.kind != "revisit" else None
                        length = r.http_length if r.kind == "revisit" else len(r.payload)
                        rows.append((r.headers["WARC-Record-ID"].strip("<>"), r.kind, r.headers.get("WARC-Target-URI"), length, r.headers["WARC-Payload-Digest"].removeprefix("sha1:"), r.headers.get("WARC-Refers-To", "").strip("<>") or None, body))
                        size += len(body or b"") + 200
                        if size > 4 << 20:
                            yield _batch(rows)
                            rows, size = [], 0
                    if rows:
                        yield _batch(rows)

    return archives.select(path_col).mapInArrow(read, READ)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"payload_bytes": pa.int64(), "payload": pa.binary()}
    names = [part.split()[0] for part in READ.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.string())) for n, c in zip(names, zip(*rows, strict=True), strict=True)], names=names)


def warc_roundtrip(spark: SparkSession, pages: DataFrame, folder: str | None = None, payloads: bool = False, **options) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back."""
    return read_archives(write_archives(pages, folder or fresh_dir(spark, "warc"), **options), payloads=payloads)
