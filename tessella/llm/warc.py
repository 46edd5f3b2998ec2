"""WARC archives in Zstandard: a dictionary in a leading skippable frame, then one frame per record."""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.shared import bound_batches, shared_dir, written

#: Bytes of records in one archive; what a task holds at a time.
ARCHIVE_BYTES = 8 << 20
DICTIONARY_BYTES = 32 << 10
#: Records a dictionary is trained on are taken evenly over the archive, so many bytes in all.
SAMPLE_BYTES = 1 << 20
LEVEL = 3
DICTIONARY_MAGIC = 0x184D2A5D
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
DATE = "2000-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A hot payload's rows are spread over so many parts for the look-up of its response.
SALTS = 16
READ = 256 << 10


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _header_value(text: str) -> str:
    return "".join(c if " " < c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in text)


@dataclass
class Record:
    """A record as read. payload is None where a revisit leaves it out; payload_bytes is the full payload's length."""

    kind: str
    record_id: str
    uri: str | None
    payload_bytes: int
    payload_digest: str
    payload: bytes | None
    refers_to: str | None


def render(r: Record) -> bytes:
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {r.payload_bytes}\r\n\r\n".encode()
    block = head + (r.payload or b"")
    lines = ["WARC/1.1", f"WARC-Type: {r.kind}", f"WARC-Record-ID: <{r.record_id}>", f"WARC-Date: {DATE}"]
    if r.uri is not None:
        lines.append(f"WARC-Target-URI: {_header_value(r.uri)}")
    lines.append(f"WARC-Payload-Digest: sha1:{r.payload_digest}")
    if r.kind == "revisit":
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{r.refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(lines: list[bytes], what: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon or not name or name != name.strip():
            raise ValueError(f"{what}: a header line without a name")
        key = name.decode("ascii").lower()
        if key in out:
            raise ValueError(f"{what}: {key} twice")
        out[key] = value.strip().decode()
    return out


def _length(headers: dict[str, str], what: str) -> int:
    value = headers.get("content-length", "")
    if not value.isascii() or not value.isdigit():
        raise ValueError(f"{what}: no whole Content-Length")
    return int(value)


def parse(data: bytes) -> Record:
    """A record of one frame. Raises ValueError on wrong headers, lengths or digests."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or lines[0] not in (b"WARC/1.0", b"WARC/1.1"):
        raise ValueError("WARC: no version line")
    headers = _headers(lines[1:], "WARC")
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise ValueError(f"WARC: no {name}")
    n = _length(headers, "WARC")
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError("WARC: the block isn't as long as its Content-Length")
    kind, block = headers["warc-type"], rest[:n]
    if kind not in ("response", "revisit"):
        return Record(kind, headers["warc-record-id"].strip("<>"), headers.get("warc-target-uri"), n, digest(block), block, None)
    http, gap, payload = block.partition(b"\r\n\r\n")
    lines = http.split(b"\r\n")
    if not gap or not lines[0].startswith(b"HTTP/"):
        raise ValueError("WARC: no HTTP status line")
    length = _length(_headers(lines[1:], "HTTP"), "HTTP")
    algorithm, _, stated = headers.get("warc-payload-digest", "").partition(":")
    if algorithm != "sha1" or len(stated) != 32:
        raise ValueError("WARC: no SHA-1 payload digest")
    refers = headers.get("warc-refers-to")
    if kind == "response":
        if len(payload) != length:
            raise ValueError("WARC: the payload isn't as long as its Content-Length")
        if digest(payload) != stated:
            raise ValueError("WARC: the payload hasn't its digest")
    elif payload or not refers or headers.get("warc-profile") != REVISIT_PROFILE:
        raise ValueError("WARC: a revisit with a payload, or without what it refers to")
    return Record(kind, headers["warc-record-id"].strip("<>"), headers.get("warc-target-uri"), length, stated, payload if kind == "response" else None, refers and refers.strip("<>"))


def write_archive(records: list[bytes], out: BinaryIO, level: int = LEVEL) -> None:
    """The dictionary, itself compressed, in a skippable frame, where the records suffice to train one; then the records."""
    step = max(1, sum(map(len, records)) // SAMPLE_BYTES)
    try:
        trained = zstandard.train_dictionary(DICTIONARY_BYTES, records[::step])
    except zstandard.ZstdError:
        trained = None
    if trained is not None:
        body = zstandard.ZstdCompressor(level=19).compress(trained.as_bytes())
        out.write(struct.pack("<II", DICTIONARY_MAGIC, len(body)) + body)
        trained = zstandard.ZstdCompressionDict(trained.as_bytes())
        trained.precompute_compress(level=level)
    zstd = zstandard.ZstdCompressor(level=level, dict_data=trained) if trained else zstandard.ZstdCompressor(level=level)
    for record in records:
        out.write(zstd.compress(record))


def read_frames(source: BinaryIO) -> Iterator[bytes]:
    """The content of each frame. Holds one frame and a read buffer. Raises ValueError on a frame that isn't whole."""
    buffer = source.read(READ)
    trained = None
    if len(buffer) >= 8 and struct.unpack_from("<I", buffer)[0] == DICTIONARY_MAGIC:
        n = struct.unpack_from("<I", buffer, 4)[0]
        while len(buffer) < 8 + n:
            more = source.read(READ)
            if not more:
                raise ValueError("WARC: the dictionary's frame ends early")
            buffer += more
        body, buffer = buffer[8 : 8 + n], buffer[8 + n :]
        if body[:4] == ZSTD_MAGIC:
            body = zstandard.ZstdDecompressor().decompress(body, max_output_size=64 << 20)
        trained = zstandard.ZstdCompressionDict(body)
    zstd = zstandard.ZstdDecompressor(dict_data=trained) if trained else zstandard.ZstdDecompressor()
    while True:
        if not buffer:
            buffer = source.read(READ)
            if not buffer:
                return
        frame, parts = zstd.decompressobj(), []
        while True:
            try:
                parts.append(frame.decompress(buffer))
            except zstandard.ZstdError as e:
                raise ValueError(f"WARC: a frame can't be decoded: {e}") from e
            if frame.eof:
                buffer = frame.unused_data
                break
            buffer = source.read(READ)
            if not buffer:
                raise ValueError("WARC: a frame ends early")
        yield b"".join(parts)


def assigned(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, record_type, refers_to: of equal payloads of at least min_bytes the largest page_id is the response.

    Groups are counted before the shuffle, and only those of more than one row are joined back, spread over SALTS parts.
    """
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    keyed = base.withColumn("_digest", F.unhex(F.sha1("payload")))
    groups = keyed.filter(F.octet_length("payload") >= min_bytes).groupBy("_digest").agg(F.max("page_id").alias("_of"), F.count(F.lit(1)).alias("_n")).filter("_n > 1 AND _of IS NOT NULL")
    salted = groups.select("_digest", "_of", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    joined = keyed.withColumn("_salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).join(salted, ["_digest", "_salt"], "left")
    revisit = F.col("_of").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_of"))
    return joined.select("page_id", "url", "payload", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("_of")).alias("refers_to"))


def write(pages: DataFrame, path: str, min_bytes: int = 0) -> DataFrame:
    """Write archives below path and return their list (archive, records, bytes), itself written in the shared folder.

    Each attempt of a task writes files of its own names, and only those of attempts that ended are in the list, so that
    a lost executor leaves no wrong archive in it. A null html is an empty payload; a null url has no target header; a null
    page_id is an empty number in the record's id.
    """
    bound_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        system, folder = fs.FileSystem.from_uri(path)
        system.create_dir(folder, recursive=True)
        held: list[bytes] = []
        size = done = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size, done
            name = f"{folder}/{task.partitionId():06d}-{done:05d}-{task.taskAttemptId()}.warc.zst"
            with system.open_output_stream(name) as out:
                write_archive(held, out)
            row = pa.RecordBatch.from_pydict({"archive": [name], "records": pa.array([len(held)], pa.int64()), "bytes": pa.array([size], pa.int64())})
            held, size, done = [], 0, done + 1
            return row

        for batch in batches:
            for page_id, url, payload, kind, refers in zip(*(c.to_pylist() for c in batch.columns)):
                response = kind == "response"
                r = Record(kind, f"urn:page:{'' if page_id is None else page_id}", url, len(payload), digest(payload), payload if response else None, None if response else f"urn:page:{refers}")
                held.append(render(r))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield flush()
        if held:
            yield flush()

    listed = assigned(pages, min_bytes).mapInArrow(run, "archive string, records long, bytes long")
    return written(listed, "archives")


def read(archives: DataFrame, path: str, payload: bool = True) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to (and payload) of every record of listed archives.

    An empty number in a record's id is a null page_id; a record without a target header has a null url."""
    spark = archives.sparkSession
    bound_batches(spark)
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", *(["payload"] if payload else [])]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def page(urn: str | None) -> int | None:
        return int(urn.removeprefix("urn:page:")) if urn and urn != "urn:page:" else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(path)
        for batch in batches:
            for name, count in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows, size, seen = [], 0, 0

                def out() -> pa.RecordBatch:
                    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], types[i]) for i in range(len(names))], names)

                with system.open_input_stream(name) as source:
                    for data in read_frames(source):
                        r = parse(data)
                        seen += 1
                        rows.append((page(r.record_id), r.uri, r.payload_bytes, r.payload_digest, r.kind, page(r.refers_to), r.payload))
                        size += len(data)
                        if size > 4 << 20:
                            yield out()
                            rows, size = [], 0
                if seen != count:
                    raise ValueError(f"{name} has {seen} records of {count}")
                if rows:
                    yield out()

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payload
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    return archives.select("archive", "records").repartition(parts).mapInArrow(run, schema)


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write every page as a record, read the archives back, and return what the records say, without payloads.

    One row per page: repeated rows stay, and those that share the largest page_id of a payload are all responses; null
    page_ids are below any other. An empty table gives no archive and no rows.
    """
    path = f"{shared_dir(pages.sparkSession)}/warc"
    return read(write(pages, path, min_bytes), path, payload=False)
