"""WARC archives: writing with deduplication and segmentation, reading with segment reassembly.

Writing: each page becomes an HTTP response whose body is framed in chunks.  Of the pages with equal bodies of at
least ``MIN_REVISIT`` bytes the one with the largest id is stored, the others become revisit records that refer to
it.  Blocks longer than ``SEGMENT`` are split into a first record and continuation records, and archives are closed
at ``ARCHIVE`` bytes, so the parts of one record may lie in different files.  Archives (gzip, one member a record)
are written to the shared folder under a task's own name and then renamed, so a repeated task leaves the same files.

Reading: archives are streamed record by record.  Whole records are decoded where they are read; segments are
grouped by the id of the record they continue, ordered by segment number and checked against the total length
that the last one states; then the HTTP head is cut off, chunked framing is decoded, and the digest is checked.
A record that is incomplete or fails a check is kept with ``problem`` set, never dropped silently.

Defined results: a null body is an empty payload; a null url is stored as an empty target; repeated rows
(equal page_id and body) are written one by one, those of the largest id all being responses; an empty table gives
an empty result; columns other than ``page_id``, ``url`` and ``html`` are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilscan.llm.common import cut, mark_members, scratch, slices, written

MIN_REVISIT = 1000
SEGMENT = 16_384
ARCHIVE = 32 << 20
CHUNK = 4_096
_CRLF = b"\r\n"
_NAMESPACE = uuid.UUID("6f1c2b4e-9f0e-4d57-8a3d-0d6a2f6b7c11")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = datetime(2020, 1, 1, tzinfo=UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
PART_SCHEMA = "record_id string, origin_id string, segment int, total_length long, warc_type string, page_id long, target string, digest string, refers_to string, block binary"


def record_id(*place: object) -> str:
    """An id made of where the record stands, the same in every attempt of its task."""
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, '/'.join(map(str, place)))}>"


def payload_digest(payload: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    out = [b"%x\r\n%b\r\n" % (len(part), part) for part in (payload[i : i + size] for i in range(0, len(payload), size))]
    return b"".join([*out, b"0\r\n\r\n"])


def dechunked(data: bytes) -> bytes:
    """The body of a chunked transfer; ValueError where the framing is broken."""
    out, at = [], 0
    while True:
        end = data.find(_CRLF, at)
        if end < 0:
            raise ValueError("a chunk size is missing")
        size = int(data[at:end].split(b";")[0], 16)
        at = end + 2
        if not size:
            return b"".join(out)
        if data[at + size : at + size + 2] != _CRLF:
            raise ValueError("a chunk is cut off")
        out.append(data[at : at + size])
        at += size + 2


def one_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))]) + "\r\n"
    return head.encode("utf-8", "surrogatepass") + block + _CRLF + _CRLF


def uri(url: str | None) -> str:
    return "".join(c if " " < c != "\x7f" else f"%{ord(c):02X}" for c in url or "")


def records(page: int | None, url: str | None, payload: bytes, refers_to: int | None, origin_url: str | None, place: str, segment: int = SEGMENT) -> Iterator[bytes]:
    """The records of one page, segmented where its block is long; ``place`` is what the ids are made of."""
    common = [("WARC-Date", _DATE), ("WARC-Target-URI", uri(url))] + ([("X-Page-Id", str(page))] if page is not None else [])
    digest = ("WARC-Payload-Digest", payload_digest(payload))
    if refers_to is not None:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
        yield one_record([("WARC-Type", "revisit"), ("WARC-Record-ID", record_id(place, 1)), *common, digest, ("WARC-Profile", _PROFILE), ("WARC-Refers-To-Target-URI", uri(origin_url)), ("WARC-Refers-To-Date", _DATE), ("X-Refers-To-Page", str(refers_to)), ("Content-Type", "application/http;msgtype=response")], block)
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    for k, part in enumerate(parts, 1):
        last = [("WARC-Segment-Total-Length", str(len(block)))] if k == len(parts) else []
        if k == 1:
            numbered = [("WARC-Segment-Number", "1")] if len(parts) > 1 else []
            yield one_record([("WARC-Type", "response"), ("WARC-Record-ID", record_id(place, 1)), *common, digest, *numbered, ("Content-Type", "application/http;msgtype=response")], part)
        else:
            yield one_record([("WARC-Type", "continuation"), ("WARC-Record-ID", record_id(place, k)), *common, ("WARC-Segment-Origin-ID", record_id(place, 1)), ("WARC-Segment-Number", str(k)), *last], part)


def decided(pages: DataFrame, least: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, payload, refers_to, copy: which pages are stored and which revisit another.

    Equal long payloads find the largest id in an aggregate that is combined before its shuffle; it is joined
    back to payloads that have an equal one, by an equi-join of two fresh exchanges, which adaptive execution splits
    where one payload is very frequent.  The others stay where they are.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    digest = F.when(F.octet_length("payload") >= least, F.sha1("payload"))
    keys = rows.select("page_id", "url", digest.alias("digest"))
    groups = keys.where("digest is not null").groupBy("digest").agg(F.max("page_id").alias("origin"), F.max(F.struct("page_id", "url"))["url"].alias("origin_url"), F.count("*").alias("n")).where("n > 1")
    groups = written(groups.select("digest", "origin", "origin_url"), "origins")
    # only payloads that others may equal are moved
    rows = rows.withColumn("digest", digest).withColumn("place", F.xxhash64("digest"))
    marked = mark_members(rows, "place", groups.select(F.xxhash64("digest").alias("place")), "again")
    again = marked.where("again and digest is not null").join(groups, "digest", "left").select("page_id", "url", "payload", "origin", "origin_url")
    nothing = F.lit(None)
    alone = marked.where("not again or digest is null").select("page_id", "url", "payload", nothing.cast("long").alias("origin"), nothing.cast("string").alias("origin_url"))
    return again.unionAll(alone).select("page_id", "url", "payload", F.when(F.col("origin") != F.col("page_id"), F.col("origin")).alias("refers_to"), "origin_url")


def write_archives(pages: DataFrame, folder: str, archive: int = ARCHIVE) -> DataFrame:
    """Write the decided pages as archives below ``folder``; one row (path) per archive."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pyarrow.fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        task = TaskContext.get()
        number, attempt = (task.partitionId(), task.taskAttemptId()) if task else (0, 0)
        paths: list[str] = []
        out = None
        rows = 0

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                out = None

        for batch in slices(batches):
            for page, url, payload, refers_to, origin_url in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                rows += 1
                for record in records(page, url, payload, refers_to, origin_url, f"{number}/{rows}"):
                    if out is None:
                        # an attempt's archives are its own, and only the rows of the one that counts name any
                        paths.append(f"{root}/part-{number:06d}-{attempt}-{len(paths):04d}.warc.gz")
                        out = store.open_output_stream(paths[-1], compression=None)
                        out.write(member(one_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id("info", number, len(paths))), ("WARC-Date", _DATE), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")))
                    out.write(member(record))
                    if out.tell() >= archive:
                        close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string())], names=["path"])

    return pages.mapInArrow(run, "path string")


def member(record: bytes) -> bytes:
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


def unpacked(source: BinaryIO, size: int = 1 << 18) -> Iterator[bytes]:
    """The records' bytes of a gzip archive, member by member."""
    data, unpacker, parts = b"", zlib.decompressobj(31), []
    while True:
        if not data:
            data = source.read(size)
            if not data:
                if parts:
                    raise ValueError("the archive is cut off")
                return
        parts.append(unpacker.decompress(data))
        data = unpacker.unused_data if unpacker.eof else b""
        if unpacker.eof:
            yield b"".join(parts)
            unpacker, parts = zlib.decompressobj(31), []


def parsed(record: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    headers = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
    length = int(headers["content-length"])
    if len(rest) < length:
        raise ValueError("the record is cut off")
    return headers, rest[:length]


def read_parts(paths: DataFrame, root: str) -> DataFrame:
    """The records of the archives, segments one by one: see ``PART_SCHEMA``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = pyarrow.fs.FileSystem.from_uri(root)
        kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
        names = [f.split()[0] for f in PART_SCHEMA.split(", ")]

        def table(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with store.open_input_stream(path, compression=None) as source:
                    for data in unpacked(source):
                        h, block = parsed(data)
                        if h["warc-type"] == "warcinfo":
                            continue
                        number, total, page = h.get("warc-segment-number"), h.get("warc-segment-total-length"), h.get("x-page-id")
                        rows.append((h["warc-record-id"], h.get("warc-segment-origin-id", h["warc-record-id"]), number and int(number), total and int(total), h["warc-type"], page and int(page), h.get("warc-target-uri"), h.get("warc-payload-digest"), h.get("x-refers-to-page"), block))
                        held += len(block)
                        if held > 8 << 20:
                            yield table(rows)
                            rows, held = [], 0
        if rows:
            yield table(rows)

    return paths.mapInArrow(run, PART_SCHEMA)


def reassembled(parts: DataFrame) -> DataFrame:
    """Whole records: segments grouped by origin, ordered by number, checked against the stated total length."""
    plain = parts.where("segment is null").select("record_id", "warc_type", "page_id", "target", "digest", "refers_to", "block", F.lit(None).cast("string").alias("problem"))
    grouped = parts.where("segment is not null").groupBy(F.col("origin_id").alias("record_id")).agg(
        F.max_by("warc_type", -F.col("segment")).alias("warc_type"),
        F.max_by("page_id", -F.col("segment")).alias("page_id"),
        F.max_by("target", -F.col("segment")).alias("target"),
        F.max_by("digest", -F.col("segment")).alias("digest"),
        F.max("refers_to").alias("refers_to"),
        F.array_sort(F.collect_list(F.struct("segment", "block"))).alias("segments"),
        F.max("total_length").alias("total_length"),
    )
    block = F.aggregate("segments", F.lit(b""), lambda whole, s: F.concat(whole, s["block"]))
    joined = grouped.withColumn("block", block)
    numbers = F.transform("segments", lambda s: s["segment"])
    problem = (
        F.when(numbers != F.sequence(F.lit(1), F.size("segments")), "segments are missing or repeated")
        .when(F.col("total_length").isNull(), "the last segment is missing")
        .when(F.octet_length("block") != F.col("total_length"), "the total length differs")
    )
    return plain.unionAll(joined.select("record_id", "warc_type", "page_id", "target", "digest", "refers_to", "block", problem.alias("problem")))


def decode(headers: bytes, body: bytes) -> tuple[bytes | None, int]:
    """Payload (None where the record has none of its own) and its length from an HTTP head and body."""
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(b":") for line in headers.split(_CRLF)[1:])}
    if fields.get(b"transfer-encoding", b"").lower() == b"chunked":
        payload = dechunked(body)
        return payload, len(payload)
    return body, int(fields.get(b"content-length", len(body)))


def decoded(whole: DataFrame) -> DataFrame:
    """page_id, payload (null for revisits), payload_bytes, payload_digest (hex), record_type, refers_to, target, problem."""
    names = ["page_id", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to", "target", "problem"]

    def one(kind: str, page: int | None, target: str | None, stated: str | None, refers_to: str | None, block: bytes, problem: str | None) -> tuple:
        payload, size = None, None
        digest = base64.b32decode(stated.removeprefix("sha1:")).hex() if stated else None
        if problem is None:
            try:
                head, _, body = block.partition(b"\r\n\r\n")
                payload, size = decode(head, body)
                if kind == "revisit":
                    payload = None
                elif hashlib.sha1(payload).hexdigest() != digest:
                    problem = "the payload's digest differs"
            except ValueError as e:
                problem = str(e)
        return page, payload, size, digest, kind, refers_to and int(refers_to), target, problem

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [one(*row) for row in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True)]
        kinds = [pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield run(batch)

    columns = whole.select("warc_type", "page_id", "target", "digest", "refers_to", "block", "problem")
    return columns.mapInArrow(runs, "page_id long, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long, target string, problem string")


def round_trip(pages: DataFrame, segment_folder: str | None = None) -> DataFrame:
    """Write all pages as archives in the shared folder and read them back, decoded."""
    spark = pages.sparkSession
    folder = segment_folder or scratch(spark, "warc")
    folder = folder if "://" in folder or folder.startswith("/") else f"file://{folder}"
    paths = cut(write_archives(decided(pages), folder))  # the archives are written once, here
    return decoded(reassembled(read_parts(paths, folder)))
