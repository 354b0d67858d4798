"""WARC archives as seekable Zstandard bundles.

A bundle is a row of independent frames of about ``FRAME_BYTES`` of records, and
at its end a seek table in a skippable frame: the compressed and the plain size
of each frame, their number, and a magic number, as in the published seekable
format.  Any Zstandard reader can read a bundle from the start; with the table a
reader can open one frame alone.  The index maps each record's id to its
bundle, its frame, and its place in the frame's plain bytes.

Of records with equal payloads, that with the smallest id is written whole; the
others are revisits that name it and carry no payload.  Digests are grouped
without the payloads, and only repeated ones are joined back: broadcast if there
are at most ``BROADCAST_DIGESTS``, else with a shuffle that can be split.

Each task writes its own bundles under names of its own, to the shared folder;
only bundles that a finished task put into the index are read, so a lost or
repeated task leaves nothing but unused files.

Defined results: a null html is an empty payload, and empty payloads are equal
to each other.  Rows that repeat id and payload are all responses.  A record
without an id is a revisit if some record with an id has its payload, else a
response.  Very long pages are one record in one frame.  An empty table gives an
empty index and result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch

FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 16 << 20
BROADCAST_DIGESTS = 200_000
MIN_REVISIT_BYTES = 0
LEVEL = 3
# Fixed values of the seekable format: magic numbers of a skippable frame and of its footer.
SKIPPABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1
# A fixed value: the archive's date, since the tables have none and results must not change.
DATE = "2000-01-01T00:00:00Z"

INDEX = "page_id long, bundle string, frame int, frame_at long, frame_bytes long, at long, bytes long"


def _fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class Record(NamedTuple):
    page_id: int | None
    payload_bytes: int
    payload_digest: str
    record_type: str
    refers_to: int | None
    payload: bytes


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _id(name: str) -> int | None:
    own = name.strip("<>").rsplit(":", 1)[1]
    return None if own == "none" else int(own)


def record(page_id: int | None, url: str | None, payload: bytes, first: int | None, revisit: bool) -> bytes:
    """One WARC record; a revisit carries the headers alone."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if revisit else http + payload
    target = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or "")
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_name(first)}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def records(plain: bytes, at: int = 0) -> Iterator[Record]:
    """The records in a frame's plain bytes, from ``at`` on."""
    while at < len(plain):
        end = plain.index(b"\r\n\r\n", at)
        head = dict(line.split(": ", 1) for line in plain[at:end].decode().split("\r\n")[1:])
        size, body = int(head["Content-Length"]), end + 4
        split = plain.index(b"\r\n\r\n", body, body + size) + 4
        http = plain[body:split].decode()
        payload = plain[split : body + size]
        whole = int(http.split("Content-Length: ", 1)[1].split("\r\n", 1)[0])
        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
        if head["WARC-Type"] == "response":
            found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
            if len(payload) != whole or found != digest:
                raise ValueError(f"{head['WARC-Record-ID']}: its payload doesn't match its digest")
        refers = head.get("WARC-Refers-To")
        yield Record(_id(head["WARC-Record-ID"]), whole, digest, head["WARC-Type"], _id(refers) if refers else None, payload)
        at = body + size + 4


class Bundle:
    """Collects records and writes one file."""

    def __init__(self, folder: str):
        self.uri = f"{folder}/{uuid.uuid4().hex}.warc.zst"
        self.out = bytearray()
        self.frame = bytearray()
        self.sizes: list[tuple[int, int]] = []
        self.waiting: list[tuple[int | None, int, int]] = []
        self.index: list[tuple] = []

    def add(self, page_id: int | None, data: bytes) -> None:
        self.waiting.append((page_id, len(self.frame), len(data)))
        self.frame += data
        if len(self.frame) >= FRAME_BYTES:
            self.cut()

    def cut(self) -> None:
        if not self.frame:
            return
        packed = zstandard.ZstdCompressor(level=LEVEL).compress(bytes(self.frame))
        at = len(self.out)
        self.index += [(i, self.uri, len(self.sizes), at, len(packed), lo, n) for i, lo, n in self.waiting]
        self.sizes.append((len(packed), len(self.frame)))
        self.out += packed
        self.frame.clear()
        self.waiting.clear()

    def close(self) -> list[tuple]:
        self.cut()
        table = b"".join(struct.pack("<II", *x) for x in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        self.out += struct.pack("<II", SKIPPABLE, len(table)) + table
        fs, path = _fs(self.uri)
        with fs.open_output_stream(path, compression=None) as f:
            f.write(bytes(self.out))
        return self.index


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        names = ["page_id", "bundle", "frame", "frame_at", "frame_bytes", "at", "bytes"]

        def rows(index: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*index, strict=True), kinds, strict=True)], names)

        bundle = None
        for batch in batches:
            for page_id, url, html, first, revisit in zip(*(batch.column(c) for c in ("page_id", "url", "html", "first_id", "revisit")), strict=True):
                bundle = bundle or Bundle(folder)
                payload = html.as_py()
                bundle.add(page_id.as_py(), record(page_id.as_py(), url.as_py(), payload.encode() if payload else b"", first.as_py(), revisit.as_py()))
                if len(bundle.out) >= BUNDLE_BYTES:
                    yield rows(bundle.close())
                    bundle = None
        if bundle is not None:
            yield rows(bundle.close())

    return run


def write(pages: DataFrame, scratch: Scratch, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Writes the archives to the shared folder; the index of all records."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("html"))).withColumn("large", F.octet_length("html") >= min_revisit_bytes)
    again = rows.filter("large").groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1").drop("n")
    again = scratch.table(again, "digests")
    if again.count() <= BROADCAST_DIGESTS:
        again = F.broadcast(again)
    known = rows.join(again, "digest", "left")
    # first_id is null for small payloads unless the digest repeats; equal payloads are equally large.
    revisit = F.coalesce(F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id")), F.lit(False))
    folder = scratch.path("bundles")
    scratch._fs.mkdirs(scratch._path(folder))
    return scratch.table(known.select("page_id", "url", "html", "first_id", revisit.alias("revisit")).mapInArrow(_write(folder), INDEX), "index")


def seek_table(f, size: int) -> list[tuple[int, int, int]]:
    """(offset, compressed size, plain size) of each frame of an open bundle."""
    f.seek(size - 9)
    n, _, magic = struct.unpack("<IBI", f.read(9))
    if magic != SEEKABLE:
        raise ValueError("no seek table at the end")
    f.seek(size - 9 - 8 * n)
    at, out = 0, []
    for packed, plain in struct.iter_unpack("<II", f.read(8 * n)):
        out.append((at, packed, plain))
        at += packed
    return out


def read_record(bundle: str, frame_at: int, frame_bytes: int, at: int) -> Record:
    """One record by its index row: opens its frame alone."""
    fs, path = _fs(bundle)
    with fs.open_input_file(path) as f:
        f.seek(frame_at)
        return next(records(zstandard.ZstdDecompressor().decompress(f.read(frame_bytes)), at))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
    for batch in batches:
        for bundle in batch.column("bundle"):
            fs, path = _fs(bundle.as_py())
            with fs.open_input_file(path) as f:
                for at, packed, _ in seek_table(f, f.size()):
                    f.seek(at)
                    got = [r[:5] for r in records(zstandard.ZstdDecompressor().decompress(f.read(packed)))]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*got, strict=True), kinds, strict=True)], list(Record._fields[:5]))


def read(index: DataFrame) -> DataFrame:
    """Every record of the archives that the index names, read frame by frame."""
    bundles = index.select("bundle").distinct()
    tasks = max(1, min(bundles.count(), 100_000))
    return bundles.repartition(tasks, "bundle").mapInArrow(_read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op4_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "warc")
    return read(write(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), scratch))


def sql_records(source: str = "pages") -> str:
    """The whole result over ``source``, whose ids are unique and not null, in DuckDB's SQL."""
    bits = "array_to_string(list_transform(range(1, 41), lambda i: [" + ", ".join(f"'{k:04b}'" for k in range(16)) + "][instr('0123456789abcdef', h[i])]), '')"
    value = " + ".join(f"{1 << (4 - k)} * (b[5 * i + {k + 1}] = '1')::int" for k in range(5))
    return f"""
with p as (select page_id, coalesce(html, '') as t, sha1(coalesce(html, '')) as h from {source}),
q as (select page_id, t, {bits} as b from p),
r as (select page_id, strlen(t)::bigint as payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + {value}]), '') as payload_digest, min(page_id) over (partition by t) as first_ from q)
select page_id, payload_bytes, payload_digest, case when page_id = first_ then 'response' else 'revisit' end as record_type, case when page_id <> first_ then first_ end as refers_to from r"""
