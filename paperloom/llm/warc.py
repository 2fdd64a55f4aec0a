"""WARC archives compressed record by record with a shared Zstandard dictionary, and their reader.

A dictionary is trained from a bounded sample of the records themselves. Every archive file begins with it, in a
skippable frame (magic 0x184D2A5D, the layout of the WARC-zstd proposal), so each file can be read alone; then follows
one Zstandard frame a record, so each record can be read alone too. Equal payloads are stored once: the response with
the smallest page_id; the others are revisit records with the same HTTP header and no payload.

A task writes a file of its own under a name no other attempt has; only files in the manifest, which Spark commits, are
part of the archive, so lost or repeated attempts leave no trace in it.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import new_path, sampled, ship, written
from .text import column, slices

MAGIC = 0x184D2A5D
SAMPLE = 1000  # records for the dictionary, each of at most SAMPLE_BYTES
SAMPLE_BYTES = 64_000
DICTIONARY = 65_536
LEVEL = 3
_NAMESPACE = uuid.UUID("6f0b1b3c-6a7e-4f57-9d5b-2f6a3a2f1c11")
_CONTROL = re.compile(r"[\x00-\x20\x7f]")


def record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'page/{page_id}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, size: int, digest: str) -> bytes:
    """One WARC/1.1 record; refers_to makes it a revisit, which has the HTTP header but no payload."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    kind = "response"
    if refers_to is not None:
        kind = "revisit"
    else:
        block += payload
    uri = _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{page_id}"
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {record_id(page_id) if page_id is not None else f'<urn:uuid:{uuid.uuid5(_NAMESPACE, digest + uri)}>'}",
        f"WARC-Target-URI: {uri}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if page_id is not None:
        head.append(f"Page-Id: {page_id}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}", f"Refers-To-Page-Id: {refers_to}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Headers (names lower-cased), HTTP header and payload of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("no WARC record")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("wrong Content-Length")
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, http, payload


def train(samples: list[bytes]) -> bytes:
    """A dictionary from records; empty if they are too few or too small for one."""
    if len(samples) < 8:
        return b""
    try:
        return zstandard.train_dictionary(min(DICTIONARY, max(1024, sum(map(len, samples)) // 10)), samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def records(f) -> Iterator[tuple[int, bytes]]:
    """Offset and bytes of each record of an open archive; its dictionary is read from its first frame."""
    magic, size = struct.unpack("<II", f.read(8))
    if magic != MAGIC:
        raise ValueError("no dictionary frame")
    raw = f.read(size)
    maker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw)) if raw else zstandard.ZstdDecompressor()
    at, held = 8 + size, b""
    while True:
        one, out, start = maker.decompressobj(), [], at
        while not one.eof:
            if not held:
                held = f.read(1 << 16)
                if not held:
                    if out or at != start:
                        raise ValueError("archive ends within a record")
                    return
            out.append(one.decompress(held))
            at += len(held) - len(one.unused_data)
            held = one.unused_data
        yield start, b"".join(out)


def _base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def _writer(folder: str, dictionary: bytes):
    names = ["page_id", "file", "offset", "length"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = fs.FileSystem.from_uri(folder)
        where.create_dir(base, recursive=True)
        name, out, at = f"{uuid.uuid4().hex}.warc.zst", None, 0
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdCompressor(level=LEVEL)
        try:
            for whole in batches:
                for b in slices(whole, "html", 1 << 22):
                    if out is None:
                        out = where.open_output_stream(posixpath.join(base, name), compression=None)  # the name would have it compressed again
                        out.write(struct.pack("<II", MAGIC, len(dictionary)) + dictionary)
                        at = 8 + len(dictionary)
                    data, ends = column(b.column(2))
                    html, starts, sizes, parts = data.tobytes(), [], [], []
                    for i, (page, url, refers) in enumerate(zip(*(b.column(k).to_pylist() for k in (0, 1, 3)))):
                        p = html[ends[i] : ends[i + 1]]
                        parts.append(packer.compress(record(page, url, p, refers, len(p), _base32(hashlib.sha1(p).digest()))))
                        starts.append(at)
                        sizes.append(len(parts[-1]))
                        at += sizes[-1]
                    out.write(b"".join(parts))
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array([name] * b.num_rows), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())], names)
        finally:
            if out is not None:
                out.close()

    return run


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, at = column(b.column(1))
        raw = data.tobytes()
        keys = [hashlib.sha256(raw[at[i] : at[i + 1]]).digest() for i in range(b.num_rows)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.binary())], ["page_id", "key"])


def write_archive(pages: DataFrame, at_least: int = 0) -> tuple[str, DataFrame]:
    """Writes pages (page_id, url, html) as archives in a new shared folder. Gives the folder and the manifest
    (page_id, file, offset, length)."""
    spark = pages.sparkSession
    ship(spark)
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    folder = new_path(spark, "warc")
    key = F.unhex(F.sha2(F.col("html").cast("binary"), 256))
    # payloads that occur more than once, with the page that keeps them: often few; the planner sees the table's size
    again = written(pages.select("page_id", key.alias("key"), F.octet_length("html").alias("size")).filter(F.col("size") >= at_least).groupBy("key").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null").select("key", "first"), "repeated", spark)
    sample = sampled(pages, "page_id", SAMPLE, pages.count()).filter(F.octet_length("html") <= SAMPLE_BYTES).collect()
    dictionary = train([record(r.page_id, r.url, p := r.html.encode(), None, len(p), _base32(hashlib.sha1(p).digest())) for r in sample])
    whole = pages.withColumn("key", key).join(again, "key", "left")
    refers = F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first"))
    manifest = whole.select("page_id", "url", "html", refers.alias("refers_to")).mapInArrow(_writer(folder, dictionary), "page_id long, file string, offset long, length long")
    return folder, written(manifest, "manifest", spark)


def _reader(folder: str):
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload", "file", "offset"]
    schema = pa.schema(list(zip(names, [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string(), pa.int64()])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = fs.FileSystem.from_uri(folder)
        for b in batches:
            for name in b.column(0).to_pylist():
                rows, size = [], 0
                with where.open_input_stream(posixpath.join(base, name), compression=None) as f:
                    for at, raw in records(f):
                        fields, http, payload = parse(raw)
                        kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
                        page, refers = (int(fields[k]) if k in fields else None for k in ("page-id", "refers-to-page-id"))
                        if kind == "response" and _base32(hashlib.sha1(payload).digest()) != digest:
                            raise ValueError(f"payload of page {page} doesn't have its digest")
                        length = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
                        rows.append((page, length, digest, kind, refers, payload if kind == "response" else None, name, at))
                        size += len(payload)
                        if size > 1 << 22:
                            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows), schema)], schema=schema)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows), schema)], schema=schema)

    return run


def read_archive(folder: str, files: DataFrame) -> DataFrame:
    """The records of the archives named in files (column file), each payload checked against its digest.

    page_id, payload_bytes (of the full payload, for revisits too), payload_digest, record_type, refers_to, payload (null
    for revisits), file, offset.
    """
    out = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, file string, offset long"
    names = files.select("file").distinct()
    return names.repartition(max(1, names.count())).mapInArrow(_reader(folder), out)  # a task a file


def archive_digests(pages: DataFrame, at_least: int = 0) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, read back from the archives of pages.

    A null html is an empty payload; empty payloads are equal too. A page without page_id refers to an equal page that
    has one, else it is a response of its own. Rows that repeat the smallest page_id of their payload are all responses.
    A null url becomes urn:page:<id>. An empty table gives an empty result; other columns are ignored.
    """
    folder, manifest = write_archive(pages, at_least)
    return read_archive(folder, manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
