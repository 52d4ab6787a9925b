"""WARC archives: writing, normalising monolithic gzip streams, and reading by index.

*Writing.* Of records with equal payloads of at least ``MIN_REVISIT`` bytes the one
of the largest id is the response and the others are revisits that refer to it,
without a body. Each task rolls its records into archives of about
``ARCHIVE_BYTES``, each one single gzip stream over all its records.

*Normalising.* A stream is inflated once, piece by piece; each record is written
again as a gzip member of its own, and a sidecar index keeps where each member
starts, how long it is, and its record's id.

*Reading.* A member is cut out by its index entry, inflated and parsed. The
payload digest of a response is computed from what was read and must equal the
one in its header.

Archives are rows of a table in the shared folder, written by Spark's committer,
so a lost executor leaves no partial archive; ``archive_files`` puts them out as
files. Equal payloads meet on their digest in ``SALTS`` parts, so no group of
copies lands in one task.

Defined cases: a null payload is empty; a null url leaves its header out; line
ends in urls are percent-encoded; a null id is smaller than every other, and a
group of null ids only has no revisits; rows that repeat the largest id are all
responses; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.llm.shared import bounded_batches, materialise

MIN_REVISIT, ARCHIVE_BYTES, SALTS, PIECE = 1000, 8_000_000, 16, 65_536
GZIP = 31  # window bits of a gzip stream
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record(page: int | None, url: str | None, payload: bytes, size: int, sha1: bytes, refers_to: int | None) -> bytes:
    """One WARC record; a revisit has the HTTP head only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page is None else page}>", "WARC-Date: 2024-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head.append("WARC-Payload-Digest: sha1:" + base64.b32encode(sha1).decode())
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def inflated(content: bytes) -> Iterator[bytes]:
    """The bytes of a gzip file of one or more members, piece by piece."""
    stream, view, at, left = zlib.decompressobj(GZIP), memoryview(content), 0, b""
    while left or at < len(view):
        data = left
        if not data:
            data, at = view[at : at + PIECE], at + PIECE
        out = stream.decompress(data, 16 * PIECE)
        left = stream.unconsumed_tail
        if out:
            yield out
        if stream.eof:
            left = stream.unused_data
            stream = zlib.decompressobj(GZIP)
            fresh = True
        else:
            fresh = False
    if content and not fresh:
        raise ValueError("truncated gzip stream")


def split_records(pieces: Iterable[bytes]) -> Iterator[bytes]:
    """Whole records of a WARC stream; holds one record at a time."""
    buffer, need = bytearray(), None
    for piece in pieces:
        buffer += piece
        while True:
            if need is None:
                end = buffer.find(b"\r\n\r\n")
                if end < 0:
                    break
                need = end + 4 + int(headers(bytes(buffer[:end]))["content-length"]) + 4
            if len(buffer) < need:
                break
            yield bytes(buffer[:need])
            del buffer[:need]
            need = None
    if buffer:
        raise ValueError("truncated WARC record")


def headers(head: bytes) -> dict[str, str]:
    pairs = (line.partition(b":") for line in head.split(b"\r\n")[1:])
    return {k.decode().lower(): v.strip().decode() for k, _, v in pairs}


def page_of(urn: str) -> int | None:
    text = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(text) if text else None


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, GZIP)
    return z.compress(data) + z.flush()


def normalise(content: bytes) -> tuple[bytes, list[dict]]:
    """The archive with a member for each record, and its index."""
    out, index = bytearray(), []
    for data in split_records(inflated(content)):
        member = _member(data)
        record_id = headers(data[: data.index(b"\r\n\r\n")])["warc-record-id"]
        index.append({"offset": len(out), "length": len(member), "record_id": record_id})
        out += member
    return bytes(out), index


def parse(data: bytes) -> tuple[int | None, int, str, str, int | None]:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of one record."""
    end = data.index(b"\r\n\r\n")
    head, block = headers(data[:end]), data[end + 4 : -4]
    http_end = block.index(b"\r\n\r\n")
    size = int(headers(block[:http_end])["content-length"])
    digest = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
    kind, refers = head["warc-type"], head.get("warc-refers-to")
    if kind == "response":
        payload = block[http_end + 4 :]
        if len(payload) != size or hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError("payload does not match its digest")
    return page_of(head["warc-record-id"]), size, digest, kind, page_of(refers) if refers else None


def _archives(limit: int):
    """(archive, content). Columns: page, url, payload, size, sha1, refers."""

    def batches(it):
        from pyspark import TaskContext

        part, made, stream, parts, size = TaskContext.get().partitionId(), 0, None, [], 0

        def roll():
            parts.append(stream.flush())
            return pa.RecordBatch.from_pydict({"archive": [f"pages-{part:06d}-{made:04d}.warc.gz"], "content": pa.array([b"".join(parts)], pa.binary())})

        for batch in it:
            for r in batch.to_pylist():
                if stream is None:
                    stream, parts, size = zlib.compressobj(1, zlib.DEFLATED, GZIP), [], 0
                data = record(r["page"], r["url"], r["payload"] or b"", r["size"], bytes.fromhex(r["sha1"]), r["refers"])
                parts.append(stream.compress(data))
                size += len(data)
                if size >= limit:
                    yield roll()
                    stream, made = None, made + 1
        if stream is not None:
            yield roll()

    return batches


def _normalised(it):
    for batch in it:
        for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            out, index = normalise(content.as_py())
            schema = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("record_id", pa.string())]))
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([out], pa.binary()), pa.array([index], schema)], ["archive", "content", "index"])


def _read(it):
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    for batch in it:
        for content, index in zip(batch.column(1), batch.column(2), strict=True):
            data = content.as_py()
            rows = [parse(zlib.decompress(data[e["offset"] : e["offset"] + e["length"]], GZIP)) for e in index.as_py()]
            columns = [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
            if columns:
                yield pa.RecordBatch.from_arrays(columns, names)


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", limit: int = ARCHIVE_BYTES) -> DataFrame:
    """(archive, content): monolithic gzip archives of a record per row. Only the digests of repeated payloads are joined to the rows."""
    bounded_batches(pages.sparkSession)
    payload = F.coalesce(F.col(html_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("size", F.length("payload").cast("long")).withColumn("sha1", F.sha1("payload"))
    large = rows.filter(F.col("size") >= MIN_REVISIT).groupBy("sha1", "size").agg(F.max("page").alias("winner"), F.count(F.lit(1)).alias("n"))
    groups = large.filter("n > 1").select("sha1", "size", "winner", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page", "url"), F.lit(SALTS)).cast("int")).join(groups, ["sha1", "size", "salt"], "left")
    refers = F.when(~F.col("page").eqNullSafe(F.col("winner")), F.col("winner"))
    rows = rows.select("page", "url", F.when(refers.isNull(), F.col("payload")).alias("payload"), "size", "sha1", refers.alias("refers"))
    return materialise(rows.mapInArrow(_archives(limit), "archive string, content binary"), "warc")


def normalise_archives(archives: DataFrame) -> DataFrame:
    """(archive, content, index): a member per record, with the sidecar index."""
    return materialise(archives.mapInArrow(_normalised, "archive string, content binary, index array<struct<offset: long, length: long, record_id: string>>"), "warc-normal")


def read_archives(normal: DataFrame) -> DataFrame:
    """Per record: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    return normal.mapInArrow(_read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_files(normal: DataFrame, folder: str) -> None:
    """Archives and sidecar indexes as files of a folder that the caller's executors share (a mounted path)."""

    def write(rows):
        import json
        import os
        import uuid

        for r in rows:
            lines = "".join(json.dumps(e.asDict()) + "\n" for e in r["index"])
            for name, data in ((r["archive"], bytes(r["content"])), (r["archive"] + ".idx", lines.encode())):
                part = f"{folder}/{name}.{uuid.uuid4().hex}"
                with open(part, "wb") as f:
                    f.write(data)
                os.replace(part, f"{folder}/{name}")

    normal.foreachPartition(write)


def warc_round_trip(pages: DataFrame) -> DataFrame:
    return read_archives(normalise_archives(write_archives(pages)))
