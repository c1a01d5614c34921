"""Dictionary-compressed web archives: records compressed one by one with a Zstandard dictionary.

An archive is a file that begins with a skippable frame holding the dictionary, followed by one
Zstandard frame for each record. The dictionary is built from the archive's own first records.
Payloads seen before are written as revisit records that name the response holding the payload.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import dealt, shared_path, small_batches, staged

# Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D  # skippable frame that holds the dictionary
VERSION = "WARC/1.1"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

SAME_FROM = 100  # bytes; shorter equal payloads are all written as responses
SAMPLE_BYTES = 8_000_000  # records an archive's dictionary is built from
DICTIONARY_BYTES = 64_000
ARCHIVE_BYTES = 256_000_000  # compressed; a larger partition goes on in a next archive
LEVEL = 6
NO_DATE = "1970-01-01T00:00:00Z"

MANIFEST = "path string, archive_bytes long, n_records long"
READ = (
    "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, "
    "payload binary, archive string"
)


def with_revisits(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Columns page_id, url, payload, digest and first: the page whose payload this one repeats, else null.

    Only digests held by several pages are kept for the join, one row each, so a payload that
    stands in a third of all pages costs one row there; Spark splits its pages over tasks.
    """
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    own = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), payload.alias("payload"))
    own = own.withColumn("digest", F.sha2("payload", 256))
    firsts = (
        own.where(F.octet_length("payload") >= SAME_FROM)
        .groupBy("digest").agg(F.min("page_id").alias("least"), F.count(F.lit(1)).alias("n"))
        .where("n > 1").select(F.col("digest").alias("of"), "least")
    )
    return own.join(firsts, F.col("digest") == F.col("of"), "left").select(
        "page_id", "url", "payload", "digest", F.when(F.col("page_id") != F.col("least"), F.col("least")).alias("first")
    )


def _name(page_id) -> str:
    return f"<urn:tidemark:page:{'none' if page_id is None else page_id}>"


def _page(name: str | None) -> int | None:
    last = (name or "").rpartition(":")[2].rstrip(">")
    return None if last in ("", "none") else int(last)


def record(page_id, url, payload: bytes, digest: str, first) -> bytes:
    """One record; a revisit holds the response's head only, whose Content-Length still counts the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if first is not None else http + payload
    head = [
        VERSION,
        f"WARC-Type: {'response' if first is None else 'revisit'}",
        f"WARC-Record-ID: {_name(page_id)}",
        f"WARC-Date: {NO_DATE}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.insert(3, f"WARC-Target-URI: {_one_line(url)}")
    if first is not None:
        head += [f"WARC-Profile: {IDENTICAL}", f"WARC-Refers-To: {_name(first)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _one_line(url: str) -> str:
    return url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A") if "\r" in url or "\n" in url else url


def parse(raw: bytes) -> dict:
    """Fields and payload of one record; raises where a length or digest is wrong."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != VERSION:
        raise ValueError(f"not a record: {lines[0][:40]!r}")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n" or f"sha256:{hashlib.sha256(block).hexdigest()}" != fields["WARC-Block-Digest"]:
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields | {"payload": payload, "length": int(http.rpartition(b"Content-Length: ")[2])}


def dictionary(records: list[bytes]) -> bytes:
    """A dictionary built from the records; empty where they are too few or too small to build one."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, records).as_bytes()
    except zstandard.ZstdError:
        return b""


class Archive:
    """Writes one archive file; bytes written so far are counted."""

    def __init__(self, sink, trained: bytes):
        shared = zstandard.ZstdCompressionDict(trained) if trained else None
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_content_size=True)
        self.sink, self.records = sink, 0
        self.size = 0
        self._put(DICTIONARY_MAGIC.to_bytes(4, "little") + len(trained).to_bytes(4, "little") + trained)

    def add(self, raw: bytes) -> None:
        self._put(self.compressor.compress(raw))
        self.records += 1

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.size += len(data)


def read_archive(source) -> Iterator[bytes]:
    """Raw records of an archive, one frame at a time, in bounded memory."""
    magic, size = (int.from_bytes(source.read(4), "little") for _ in range(2))
    if magic != DICTIONARY_MAGIC:
        raise ValueError("no dictionary frame")
    trained = source.read(size)
    shared = zstandard.ZstdCompressionDict(trained) if trained else None
    decompressor = zstandard.ZstdDecompressor(dict_data=shared)
    rest, frame, out = b"", None, []
    while data := rest or source.read(1 << 20):
        if frame is None:
            frame, out = decompressor.decompressobj(), []
        out.append(frame.decompress(data))
        rest = b""
        if frame.eof:
            rest, frame = frame.unused_data, None
            yield b"".join(out)
    if frame is not None:
        raise ValueError("cut off record")


def write_archives(pages: DataFrame, folder: str, **columns: str) -> DataFrame:
    """Write the pages to archives in ``folder`` and return the manifest: one row for each archive.

    Each task writes its own archives, under a name no other attempt has; the manifest is written
    through Spark, so it lists the files of the attempts that counted and no others. The folder may be
    any address that pyarrow's file systems know. A null url is left out of the record; a null html is
    an empty payload; a null page_id is kept and never referred to; of repeated rows with the smallest
    page_id each is a response. An empty table gives no archive.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = pafs.FileSystem.from_uri(folder)
        records = (
            record(*row)
            for batch in batches
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "first")))
        )
        part, written = TaskContext.get().partitionId(), 0
        while sample := _up_to(records, SAMPLE_BYTES):
            path = f"{base}/part-{part:05d}-{written:04d}-{uuid.uuid4().hex}.warc.zst"
            files.create_dir(base, recursive=True)
            with files.open_output_stream(path, compression=None) as sink:
                archive = Archive(sink, dictionary(sample))
                for raw in sample:
                    archive.add(raw)
                while archive.size < ARCHIVE_BYTES and (raw := next(records, None)):
                    archive.add(raw)
            written += 1
            yield pa.record_batch([[path], [archive.size], [archive.records]], names=["path", "archive_bytes", "n_records"])

    return staged(small_batches(with_revisits(dealt(pages), **columns)).mapInArrow(write, MANIFEST), "warc-manifest")


def _up_to(records: Iterable[bytes], size: int) -> list[bytes]:
    out, held = [], 0
    for raw in records:
        out.append(raw)
        held += len(raw)
        if held >= size:
            break
    return out


def read_archives(manifest: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """One row for each record of the manifest's archives; a revisit's payload is null, its length and digest are known."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = pafs.FileSystem.from_uri(folder)
        names = [f.split()[0] for f in READ.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string()]
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with files.open_input_stream(path, compression=None) as source:
                    rows, held = [], 0
                    for raw in read_archive(source):
                        row = _row(parse(raw), path, payloads)
                        rows.append(row)
                        held += 300 + len(row[6] or b"")
                        if held >= 4_000_000:
                            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                            rows, held = [], 0
                    if rows:
                        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    paths = manifest.select("path")
    return paths.repartition(manifest.sparkSession.sparkContext.defaultParallelism, "path").mapInArrow(read, READ)


def _row(got: dict, path: str, payloads: bool) -> tuple:
    kind = got["WARC-Type"]
    digest = got["WARC-Payload-Digest"].removeprefix("sha256:")
    if kind == "response":
        if hashlib.sha256(got["payload"]).hexdigest() != digest or len(got["payload"]) != got["length"]:
            raise ValueError(f"damaged payload {got['WARC-Record-ID']}")
    return (
        _page(got["WARC-Record-ID"]), got.get("WARC-Target-URI"), kind, _page(got.get("WARC-Refers-To")), got["length"],
        digest, got["payload"] if payloads and kind == "response" else None, path,
    )


def as_uri(path: str) -> str:
    """Addresses as pyarrow's file systems take them."""
    return re.sub("^(file:)?/+", "file:///", path)


def archived_pages(pages: DataFrame) -> DataFrame:
    """Write the pages to archives in the shared folder and read back what the records say."""
    at = as_uri(shared_path(pages.sparkSession, "warc"))
    manifest = write_archives(pages, at)
    return read_archives(manifest, at, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )
