"""WARC archives compressed record by record with an embedded dictionary, written and read by Spark tasks.

Each task gathers records up to a size, trains a Zstandard dictionary on them, and writes one file: a skippable frame
that holds the dictionary, then every record as a frame of its own, so that any record can be read without the others.
Payloads that another page carries as well are written once; the other pages get revisit records that name it.

Files are written under a name of the task attempt. Only attempts that Spark commits appear in the manifest that
`write` returns, and `read` opens what the manifest lists, so retried or speculative tasks neither lose nor double
records. Paths go through pyarrow's file systems: a local shared folder, HDFS or an object store.

Nulls and odd rows: a null html is the empty payload; a null url is written as about:blank; a null page_id is kept and
is never referred to unless all copies have none. Rows that repeat a page_id and its html are both responses if that
page_id is the largest. Extra columns are ignored. No pages, no archives. A manifest is counted before it is read, so it
should be a written table.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.llm._common import batches, bounded_batches, octets, split_join

#: Payloads below this many bytes are never replaced by a revisit.
REVISIT_FROM = 1000
#: Bytes of records in one archive before compression; a task holds one archive's records in memory.
ARCHIVE_BYTES = 16 << 20
#: Archives are read by as many tasks as there are archives, up to this many.
READ_TASKS = 20_000
DICTIONARY_BYTES = 64 << 10
#: Bytes of records, spread over the archive, that its dictionary is trained on.
TRAIN_BYTES = 3 << 20
LEVEL = 3
# Fixed values of the WARC 1.1 and Zstandard formats.
DICTIONARY_MAGIC = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_PREFIX = 0xCA05E7A4C000


def record_id(page_id: int | None) -> str:
    """A version-8 UUID that holds the page_id and gives it back."""
    if page_id is None:
        return f"<urn:uuid:{uuid.uuid4()}>"
    x = page_id & 0xFFFFFFFFFFFFFFFF
    return f"<urn:uuid:{uuid.UUID(int=_PREFIX << 80 | (0x8000 | x >> 62) << 64 | 2 << 62 | x & (1 << 62) - 1)}>"


def page_of(record: str | None) -> int | None:
    if not record:
        return None
    v = uuid.UUID(record.strip("<>").removeprefix("urn:uuid:")).int
    if v >> 80 != _PREFIX:
        return None
    x = (v >> 64 & 3) << 62 | v & (1 << 62) - 1
    return x - (1 << 64) if x >> 63 else x


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One record: a response with its HTTP block, or a revisit with the head of that block only."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    kind = "response" if refers_to is None else "revisit"
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {date}",
        "WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "about:blank"),
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if refers_to is None:
        block += payload
    else:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def train_dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A dictionary from records spread over the archive; too few of them serve as raw content."""
    step = max(1, sum(map(len, records)) // TRAIN_BYTES)
    sample = [r[:65536] for r in records[::step]]
    try:
        size = min(DICTIONARY_BYTES, max(1024, sum(map(len, sample)) // 8))
        return zstandard.train_dictionary(size, sample, k=256, d=8)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(sample)[:DICTIONARY_BYTES].ljust(8, b" "), dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archive(records: list[bytes]) -> Iterator[bytes]:
    """The frames of one file."""
    known = train_dictionary(records)
    raw = known.as_bytes()
    yield DICTIONARY_MAGIC.to_bytes(4, "little") + len(raw).to_bytes(4, "little") + raw
    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_checksum=True, write_content_size=True)
    for r in records:
        yield packer.compress(r)


def _unpacker(head: bytes):
    if int.from_bytes(head[:4], "little") != DICTIONARY_MAGIC:
        return zstandard.ZstdDecompressor(), head
    size = 8 + int.from_bytes(head[4:8], "little")
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(head[8:size])), head[size:]


def unpack(stream) -> Iterator[bytes]:
    """Records of one file, read in blocks."""
    buffer = stream.read(8 + (1 << 20))
    unpacker, buffer = _unpacker(buffer)
    while True:
        if not buffer and not (buffer := stream.read(1 << 20)):
            return
        frame, parts = unpacker.decompressobj(), []
        while True:
            parts.append(frame.decompress(buffer))
            if frame.eof:
                buffer = frame.unused_data
                break
            buffer = stream.read(1 << 20)
            if not buffer:
                raise ValueError("an archive ends within a record")
        yield b"".join(parts)


def parse(raw: bytes) -> dict:
    """The fields that a record holds; the digest of a response's payload is verified."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    if fields["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
    return {
        "page_id": page_of(fields["WARC-Record-ID"]),
        "url": fields["WARC-Target-URI"],
        "record_type": fields["WARC-Type"],
        "payload_bytes": size,
        "payload_digest": digest,
        "refers_to": page_of(fields.get("WARC-Refers-To")),
        "payload": payload if fields["WARC-Type"] == "response" else None,
    }


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or not uri.startswith("file:") else "file://" + uri.removeprefix("file:"))


def plan_revisits(pages: DataFrame, at_least: int = REVISIT_FROM) -> DataFrame:
    """pages with refers_to: the largest page_id with an equal payload, null for that page and for small payloads.

    Only digests are grouped, with maxima taken map-side; those that very many pages share are dealt over many tasks where
    they are joined back. Payloads move once, by page, so that copies spread evenly.
    """
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    meta = pages.select("page_id", F.sha1(body).alias("digest"), F.octet_length(body).alias("size")).where(F.col("size") >= at_least)
    keepers = meta.groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("copies")).where("copies > 1 and keeper is not null")
    revisits = split_join(meta, keepers, ["digest"], "copies", pages.count(), ["page_id"]).where("not (page_id <=> keeper)").groupBy("page_id", "digest").agg(F.max("keeper").alias("refers_to"))
    full = pages.select("page_id", "url", "html", F.sha1(body).alias("own"))
    return full.join(revisits, full.page_id.eqNullSafe(revisits.page_id) & (full.own == revisits.digest), "left").select(full.page_id, "url", "html", "refers_to")


def write(pages: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", at_least: int = REVISIT_FROM) -> DataFrame:
    """Writes pages (page_id, url, html) under folder; gives the manifest (path, records, bytes), which must be kept once."""
    bounded_batches(pages.sparkSession)

    def run(source):
        task = TaskContext.get()
        system, root = _open(folder)
        system.create_dir(root, recursive=True)
        held, size, done = [], 0, 0

        def flush():
            nonlocal held, size, done
            name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{done:04d}.warc.zst"
            with system.open_output_stream(posixpath.join(root, name), compression=None) as out:
                written = sum(out.write(x) for x in archive(held))
            row = pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": [len(held)], "bytes": [written]})
            held, size, done = [], 0, done + 1
            return row

        for b in batches(source):
            for page, url, payload, target in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), octets(b.column(2)), b.column(3).to_pylist(), strict=True):
                held.append(record(page, url, payload, target, date))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield flush()
        if held:
            yield flush()

    ready = plan_revisits(pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")), at_least)
    return ready.mapInArrow(run, "path string, records long, bytes long")


def read(manifest: DataFrame) -> DataFrame:
    """Rows of the records in the listed files: page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload."""
    kinds = {"page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "refers_to": pa.int64(), "payload": pa.binary()}

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in kinds.items()], names=list(kinds))

    def run(source):
        for b in batches(source):
            for path in b.column(0).to_pylist():
                system, at = _open(path)
                rows, size = [], 0
                with system.open_input_stream(at, compression=None) as stream:
                    for raw in unpack(stream):
                        rows.append(parse(raw))
                        size += len(raw)
                        if size > 4 << 20:
                            yield batch(rows)
                            rows, size = [], 0
                if rows:
                    yield batch(rows)

    schema = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
    # A given number of partitions, which Spark does not fold together: paths are few bytes, what they name is not.
    return manifest.select("path").repartition(min(max(manifest.count(), 1), READ_TASKS)).mapInArrow(run, schema)
