"""WARC archives compressed with an embedded Zstandard dictionary, and their reader.

An archive starts with a skippable frame that holds a dictionary made from its own first records; then
every record is one frame. Pages are dealt by payload digest; of equal payloads the largest page_id is the
response and the others are revisits, which keep the response's HTTP header and no payload. Archives go to
the shared folder under names that hold the attempt, so that a repeated task leaves nothing half written
in the result: only files named in the (checkpointed) manifest are read back.

Defined cases: a null html is an empty payload; a null url has no target header; rows without page_id are
responses of their own; rows that repeat a page_id with one payload are all responses when that id is the
largest. Line breaks in a url are percent-encoded; an empty table gives no archives and no rows; other columns are
never read.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, shared_dir, table

#: The skippable frame of dictionaries, the record version and the revisit profile.
DICTIONARY_FRAME = 0x184D2A5D
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:vellum:page:"
DICTIONARY_BYTES, SAMPLE_BYTES, SAMPLE_RECORD_BYTES, ARCHIVE_BYTES = 1 << 15, 1 << 20, 1 << 14, 64 << 20
#: Parts that pages of one payload are dealt to.
SALTS = 256
MANIFEST = "path string, records long, bytes long"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if refers_to is None else http
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<{URN}{page_id}>"), ("WARC-Date", date)]
    if url is not None:
        head.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    head.append(("WARC-Payload-Digest", f"sha1:{digest_of(payload)}"))
    if refers_to is not None:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{URN}{refers_to}>")]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def dictionary(samples: list[bytes]) -> zstandard.ZstdCompressionDict:
    """Trained where there are samples enough, else their own content."""
    cut = [s[:SAMPLE_RECORD_BYTES] for s in samples]
    if len(cut) >= 16:
        try:
            return zstandard.train_dictionary(DICTIONARY_BYTES, cut, k=512, d=8)
        except zstandard.ZstdError:
            pass
    return zstandard.ZstdCompressionDict(b"".join(cut)[-DICTIONARY_BYTES:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


class Archive:
    """One archive being written; it holds the first records until they make a dictionary."""

    def __init__(self, files: object, path: str, level: int):
        self.path, self.level, self.records, self.bytes = path, level, 0, 0
        self.sink, self.held, self.pack = files.open_output_stream(path, compression=None), [], None

    def _put(self, raw: bytes) -> None:
        self.sink.write(raw)
        self.bytes += len(raw)

    def _begin(self) -> None:
        known = dictionary(self.held)
        raw = known.as_bytes()
        self._put(struct.pack("<II", DICTIONARY_FRAME, len(raw)) + raw)
        self.pack = zstandard.ZstdCompressor(level=self.level, dict_data=known, write_checksum=True)
        for one in self.held:
            self._put(self.pack.compress(one))
        self.held = []

    def add(self, one: bytes) -> None:
        self.records += 1
        if self.pack:
            self._put(self.pack.compress(one))
            return
        self.held.append(one)
        if sum(map(len, self.held[-1:])) + SAMPLE_RECORD_BYTES * len(self.held) >= SAMPLE_BYTES:
            self._begin()

    def close(self) -> tuple[str, int, int]:
        if not self.pack:
            self._begin()
        self.sink.close()
        return self.path, self.records, self.bytes


def revisits(pages: DataFrame, parts: int = SALTS) -> DataFrame:
    """page_id, url, html and refers_to (null: a response).

    Repeated payloads are found from digests and ids alone, and joined by digest and a salt of the id: a payload
    that a third of all pages hold is dealt to many tasks and archives.
    """
    base = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    base = base.select("*", F.unhex(F.sha1("html")).alias("digest"), F.pmod(F.xxhash64("page_id", "url"), F.lit(parts)).cast("int").alias("salt"))
    each = base.groupBy("digest", "salt").agg(F.max("page_id").alias("largest"), F.count("page_id").alias("n"))
    many = each.groupBy("digest").agg(F.max("largest").alias("largest"), F.sum("n").alias("n")).where("n > 1").drop("n")
    known = each.select("digest", "salt").join(many, "digest")
    return base.join(known, ["digest", "salt"], "left").select("page_id", "url", "html", F.when(F.col("page_id") < F.col("largest"), F.col("largest")).alias("refers_to"))


def write(pages: DataFrame, folder: str, level: int = 3) -> DataFrame:
    """Write archives below `folder` (any URI that Arrow's file systems know); the manifest, checkpointed."""
    folder = f"{folder.rstrip('/')}/warc-{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        files, top = FileSystem.from_uri(folder)
        files.create_dir(top, recursive=True)
        task, done, archive = TaskContext.get(), [], None
        try:
            for batch in batches:
                ids, urls, htmls, refers = batch.columns
                for at in range(batch.num_rows):
                    if archive is None:
                        archive = Archive(files, f"{top}/part-{task.partitionId():06}-{task.taskAttemptId()}-{len(done):04}.warc.zst", level)
                    archive.add(record(ids[at].as_py(), urls[at].as_py(), htmls[at].as_py().encode(), refers[at].as_py()))
                    if archive.bytes >= ARCHIVE_BYTES:
                        done.append(archive.close())
                        archive = None
            if archive:
                done.append(archive.close())
        except BaseException:  # a failed attempt leaves no archives; those of a lost executor are not in the manifest
            if archive:
                archive.sink.close()
            for path in [*(d[0] for d in done), *([archive.path] if archive else [])]:
                files.delete_file(path)
            raise
        if done:
            path, records, size = zip(*done, strict=True)
            named = [f"{folder}/{p.rsplit('/', 1)[-1]}" for p in path]
            yield pa.RecordBatch.from_arrays([pa.array(named), pa.array(records, pa.int64()), pa.array(size, pa.int64())], names=["path", "records", "bytes"])

    return checkpointed(revisits(pages).mapInArrow(run, MANIFEST))


def parse(stream: io.BufferedReader) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an uncompressed stream."""
    while line := stream.readline():
        if line.rstrip() != VERSION:
            raise ValueError(f"not a record: {line[:40]!r}")
        head = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            k, _, v = line.decode().partition(": ")
            head[k] = v
        block = stream.read(int(head["Content-Length"]))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record does not end")
        yield head, block


def records_of(raw: object) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of a compressed archive: the leading frame's dictionary opens all others."""
    magic, n = struct.unpack("<II", raw.read(8))
    if magic != DICTIONARY_FRAME:
        raise ValueError("no dictionary frame")
    known = zstandard.ZstdCompressionDict(raw.read(n))
    yield from parse(io.BufferedReader(zstandard.ZstdDecompressor(dict_data=known).stream_reader(raw, read_across_frames=True), 1 << 20))


def page_of(urn: str | None) -> int | None:
    own = (urn or "").strip("<>").removeprefix(URN)
    return int(own) if own not in ("", "None") else None


def read(manifest: DataFrame) -> DataFrame:
    """Every record of the archives; payload digests and sizes are taken from the payloads and checked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        def out(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

        for batch in batches:
            for path in batch.columns[0].to_pylist():
                files, at = FileSystem.from_uri(path)
                rows = []
                with files.open_input_stream(at, compression=None) as raw:
                    for head, block in records_of(raw):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        digest, kind = head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"]
                        size = int(http.rpartition(b"Content-Length: ")[2])
                        if kind == "response" and (len(payload) != size or digest_of(payload) != digest):
                            raise ValueError(f"{head['WARC-Record-ID']} is damaged")
                        rows.append((page_of(head["WARC-Record-ID"]), size, digest, kind, page_of(head.get("WARC-Refers-To"))))
                        if len(rows) == 5000:
                            yield out(rows)
                            rows = []
                if rows:
                    yield out(rows)

    return manifest.select("path").repartition(manifest.sparkSession.sparkContext.defaultParallelism).mapInArrow(run, RECORDS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(write(table(spark, sf_dir, "pages"), shared_dir(spark)))


ORACLE_SQL = """
with p as (
  select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as hex from pages),
m as (select hex, max(page_id) as largest from p group by hex)
select page_id, cast(strlen(html) as bigint) as payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         cast((cast('0x' || substr(p.hex, cast(5 * (i // 4) + 1 as bigint), 5) as bigint) >> (15 - 5 * (i % 4))) & 31 as bigint) + 1, 1)), '')
         as payload_digest,
       case when page_id < largest then 'revisit' else 'response' end as record_type,
       case when page_id < largest then largest end as refers_to
from p join m on p.hex = m.hex
"""
