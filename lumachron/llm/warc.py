"""WARC archives compressed record by record with a dictionary of their own.

A file is a skippable Zstandard frame that holds the dictionary, then one frame a record, so that a reader can start at any
record. The dictionary is built from a bounded sample of the records to be archived. Files are written by Spark's text
writer, each partition a file: its rows are the frames, and the writer's line separator is an empty skippable frame,
which is nothing to a decompressor. So archives can lie wherever Spark can write, and a lost task's file is written anew.
The writer takes a string's bytes as they are, also where they are no UTF-8 (tests hold that against the files). A file has about
`file_bytes` of payload at most, as the measured total decides how many there are; a reader holds one file at a time, of less than 2 GB.

Of records with equal payloads (by SHA-1) the one with the least page_id is stored, the others are revisit records that
refer to it; payloads below `least` bytes are all stored. A null payload is empty; null urls have no target line. Rows that
repeat the least page_id of a payload are all stored. Digests meet by partial aggregate; those of several pages are sent
to the pages while they are few, and meet them by a join whose hot keys Spark splits beyond that.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import written

#: Fixed values of the format: frame magics, record version, revisit profile.
DICTIONARY_MAGIC, EMPTY_FRAME = 0x184D2A5D, "P*M\x18\0\0\0\0"
VERSION, PROFILE = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"

#: Records sampled for a dictionary, bytes used of each, and its size.
SAMPLED, SAMPLE_BYTES, DICTIONARY_BYTES = 1_500, 8 << 10, 64 << 10
#: Payload bytes of a file, at most and, where there are fewer files than cores, at least.
FILE_BYTES, LEAST_BYTES = 256 << 20, 4 << 20
#: Digests of several pages (some 100 bytes each) up to which they are broadcast.
MOST_DIGESTS = 200_000


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record(page_id: int, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One response or revisit record. A revisit has the full payload's digest and length but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    lines = [VERSION, f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(pages: DataFrame, sampled: int = SAMPLED) -> bytes:
    """A dictionary from records of at most `sampled` pages, those whose hashed ids are least, and the first bytes of each;
    empty if there are too few."""
    least = lambda df: df.orderBy(F.xxhash64("page_id"), "page_id").limit(sampled)
    ids = least(pages.select("page_id")).distinct()  # narrow, as each task sends the driver so many; bounded by the parameter
    some = least(pages.join(F.broadcast(ids), "page_id").select("page_id", "url", F.substring(F.coalesce("html", F.lit("")), 1, SAMPLE_BYTES).alias("html")))
    records = [record(r["page_id"], r["url"], x := r["html"].encode(), base32(hashlib.sha1(x).digest()), None, DATE) for r in some.collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, records).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def write_archives(pages: DataFrame, path: str, least: int = 0, date: str = DATE, level: int = 3, file_bytes: int = FILE_BYTES) -> None:
    """pages (page_id, url, html) as .warc.zst files under `path`."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    learned = dictionary(rows)
    payload = F.coalesce("html", F.lit(""))
    total = rows.agg(F.sum(F.octet_length(payload))).first()[0] or 0
    files = max(1, -(-total // file_bytes), min(rows.sparkSession.sparkContext.defaultParallelism, total // LEAST_BYTES))
    rows = rows.withColumn("digest", F.sha1(payload.cast("binary")))
    first = rows.where(F.octet_length(payload) >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    first = written(first, "digests")
    decided = rows.join(F.broadcast(first) if first.count() <= MOST_DIGESTS else first, "digest", "left")
    decided = decided.select("page_id", "url", "html", "digest", F.when(F.col("first") != F.col("page_id"), F.col("first")).alias("refers_to"))
    decided = decided.repartition(files, F.xxhash64("page_id", "url", "digest"))

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(learned)) if learned else zstandard.ZstdCompressor(level=level)
        head = [struct.pack("<II", DICTIONARY_MAGIC, len(learned)) + learned] if learned else []
        for batch in batches:
            for row in range(batch.num_rows):
                page_id, url, html, digest, refers_to = (batch.column(i)[row].as_py() for i in range(5))
                whole = record(page_id, url, (html or "").encode(), base32(bytes.fromhex(digest)), refers_to, date)
                yield pa.RecordBatch.from_arrays([pa.array([*head, packer.compress(whole)], pa.binary())], ["frame"])
                head = []

    # the bytes of a frame, as the writer's one string column; it writes them unchanged
    frames_of = decided.mapInArrow(frames, "frame binary").select(F.col("frame").cast("string").alias("value"))
    frames_of.write.option("lineSep", EMPTY_FRAME).text(path)


def records_in(blob: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header, block) of each record of an archive, unpacked as a stream."""
    learned = None
    if len(blob) >= 8 and struct.unpack_from("<I", blob)[0] == DICTIONARY_MAGIC:
        size = struct.unpack_from("<I", blob, 4)[0]
        learned, blob = zstandard.ZstdCompressionDict(blob[8 : 8 + size]), memoryview(blob)[8 + size :]
    stream = zstandard.ZstdDecompressor(dict_data=learned).stream_reader(blob, read_across_frames=True)
    held = b""

    def more(n: int) -> bytes:
        got = stream.read(n)
        while len(got) < n and (x := stream.read(n - len(got))):
            got += x
        return got

    while True:
        while b"\r\n\r\n" not in held:
            x = stream.read(1 << 16)
            if not x:
                if held.strip():
                    raise ValueError("an archive ends within a record")
                return
            held += x
        head, _, held = held.partition(b"\r\n\r\n")
        version, *lines = head.decode().split("\r\n")
        if version != VERSION:
            raise ValueError(f"not a record: {version[:40]}")
        header = dict(x.split(": ", 1) for x in lines)
        n = int(header["Content-Length"]) + 4
        if len(held) < n:
            held += more(n - len(held))
        yield header, held[: n - 4]
        held = held[n:]


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, record_type, refers_to, payload_digest, payload_bytes (of the full payload), payload (null for revisits)
    of every record; a stored payload is held against its digest."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        number = lambda x: None if x is None or x == "<urn:page:None>" else int(x.rpartition(":")[2][:-1])
        for batch in batches:
            for blob in batch.column(0):
                rows: list[tuple] = []
                held = 0
                for header, block in records_in(blob.as_buffer().to_pybytes()):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    digest = header["WARC-Payload-Digest"].removeprefix("sha1:")
                    stored = header["WARC-Type"] == "response"
                    if stored and base32(hashlib.sha1(payload).digest()) != digest:
                        raise ValueError(f"{header['WARC-Record-ID']}: the payload doesn't have its digest")
                    size = int(http.rpartition(b"Content-Length: ")[2])
                    rows.append((number(header["WARC-Record-ID"]), header.get("WARC-Target-URI"), header["WARC-Type"], number(header.get("WARC-Refers-To")), digest, size, payload if stored else None))
                    held += len(payload)
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(parse, "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary")
