"""WARC archives with an embedded Zstandard dictionary.

Each task writes its records to archives of its own: a dictionary is trained from the
first records of the archive, stored in a leading skippable frame (magic 0x184D2A5D), and
each record is a frame of its own compressed with it, so that a record can be read
alone and small records compress as well as large ones.  Equal payloads are archived once:
the row with the largest id is a response, the others revisit it by a digest join.

Archives go to the folder that driver and executors share; a manifest table, written by
Spark, names the archives of successful tasks only, so files of lost or repeated task
attempts are never read.

Defined cases: a null payload is empty; a row without id is a response unless another row
with an id has its payload; repeated rows of the largest id are all responses; an empty table gives no archive
and no row.
"""

from __future__ import annotations

import base64
import hashlib
import os
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tallyloom.llm.common import batches, fresh_path

MAGIC = 0x184D2A5D
_FRAME = struct.Struct("<II")
_MANIFEST = pa.schema([("archive", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])
_READ = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()),
                   ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())])


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP head with the full length, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_urn(page_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c.isprintable() else "%{:02X}".format(ord(c)) for c in url))
    if refers_to is not None:
        head += [f"WARC-Refers-To: {_urn(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        payload = b""
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + len(payload)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + http + payload + b"\r\n\r\n"


def parse(raw: bytes) -> tuple:
    """(id, payload length, digest, type, refers_to, url, payload) of one record."""
    head, _, block = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = block[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    number = lambda urn: int(urn[10:-1]) if urn and urn != "<urn:page:>" else None
    return (number(fields["WARC-Record-ID"]), length, fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"],
            number(fields.get("WARC-Refers-To")), fields.get("WARC-Target-URI"), payload)


def train(samples: list[bytes], size: int) -> bytes:
    """A dictionary from records; without enough material an empty one."""
    try:
        return zstandard.train_dictionary(size, samples, k=1024, d=8).as_bytes()
    except zstandard.ZstdError:
        return b""


def frames(records: list[bytes], dictionary: bytes, level: int) -> Iterator[bytes]:
    """The leading dictionary frame, then one frame per record."""
    yield _FRAME.pack(MAGIC, len(dictionary)) + dictionary
    coder = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    for r in records:
        yield coder.compress(r)


def read_archive(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """Records of an archive, decoded frame by frame with the dictionary found at its head."""
    magic, size = _FRAME.unpack(stream.read(_FRAME.size))
    if magic != MAGIC:
        raise ValueError("no dictionary frame at the head of the archive")
    dictionary = stream.read(size)
    dec = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    rest, one, parts = b"", dec.decompressobj(), []
    while True:
        data = rest or stream.read(chunk)
        if not data:
            return
        parts.append(one.decompress(data))
        rest = one.unused_data if one.eof else b""
        if one.eof:
            yield b"".join(parts)
            one, parts = dec.decompressobj(), []


def _place(folder: str):
    """The file system of a folder and the path in it, as executors see them."""
    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{os.path.abspath(folder)}")


def _writer(folder: str, archive_bytes: int, sample_bytes: int, dictionary_bytes: int, level: int):
    def write(it):
        def close(held) -> tuple:
            sample, seen = [], 0
            for r in held:
                if seen >= sample_bytes:
                    break
                sample.append(r)
                seen += len(r)
            task = TaskContext.get()
            name = f"part-{task.partitionId() if task else 0:05d}-{uuid.uuid4().hex}.warc.zst"
            where, base = _place(folder)
            where.create_dir(base, recursive=True)
            total = 0
            with where.open_output_stream(f"{base}/{name}", compression=None) as f:
                for x in frames(held, train(sample, dictionary_bytes), level):
                    total += len(x)
                    f.write(x)
            return name, len(held), total

        def out():
            held, size = [], 0
            for b in it:
                for page_id, url, body, digest, refers in zip(*(c.to_pylist() for c in b.columns)):
                    held.append(record(page_id, url, body or b"", digest, refers))
                    size += len(held[-1])
                    if size >= archive_bytes:
                        yield close(held)
                        held, size = [], 0
            if held:
                yield close(held)

        yield from batches(out(), _MANIFEST)

    return write


def _reader(folder: str, payloads: bool):
    def run(it):
        def out():
            for b in it:
                for name in b.column(0).to_pylist():
                    where, base = _place(folder)
                    with where.open_input_stream(f"{base}/{name}", compression=None) as f:
                        for raw in read_archive(f):
                            row = parse(raw)
                            yield row if payloads else (*row[:6], None)

        yield from batches(out(), _READ, weigh=lambda r: len(r[6] or b""))

    return run


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html",
                   archive_bytes: int = 32 << 20, sample_bytes: int = 2 << 20, dictionary_bytes: int = 32 << 10, level: int = 3) -> DataFrame:
    """Archive every row; returns the manifest: archive, records, bytes.

    A task holds one archive's records at most (``archive_bytes``), then writes it and goes on.
    """
    body = F.coalesce(F.col(body_col).cast("binary"), F.lit(b""))
    hexed = F.sha1(body)
    src = pages.select(F.col(id_col).cast("long").alias("_id"), F.col(url_col).alias("_url"), body.alias("_body"), hexed.alias("_sha"))
    # groups of equal payloads: only those with more than one id need a target
    heads = pages.select(F.col(id_col).cast("long").alias("_id"), hexed.alias("_sha")).groupBy("_sha").agg(
        F.max("_id").alias("_head"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    linked = src.join(heads, "_sha", "left")
    digits = F.unhex("_sha")
    rows = linked.select("_id", "_url", "_body", F.base64(digits).alias("_digest"),
                         F.when(F.col("_head").isNotNull() & ~F.col("_id").eqNullSafe(F.col("_head")), F.col("_head")).alias("_refers"))
    inner = _writer(folder, archive_bytes, sample_bytes, dictionary_bytes, level)

    def write(it):
        def coded():
            for b in it:
                b32 = pa.array([base64.b32encode(base64.b64decode(x)).decode() for x in b.column(3).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b32, b.column(4)], ["_id", "_url", "_body", "_digest", "_refers"])

        return inner(coded())

    manifest = f"{folder}-manifest"
    rows.mapInArrow(write, "archive string, records long, bytes long").write.parquet(manifest)
    return pages.sparkSession.read.schema("archive string, records long, bytes long").parquet(manifest)


def read_archives(manifest: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """Every record of the manifest's archives: page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload.

    The payload of a revisit is empty; its length and digest are those of the full payload.
    """
    n = manifest.sparkSession.sparkContext.defaultParallelism
    return manifest.select("archive").repartition(4 * n).mapInArrow(
        _reader(folder, payloads), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary")


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write archives to the shared folder and read their records back."""
    folder = fresh_path(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder, **options), folder, payloads=False)
