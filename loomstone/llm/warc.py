"""WARC archives in Zstandard: one frame per record, behind a dictionary in a leading skippable frame.

An archive is what one task writes, so about a split of the input: a skippable frame that holds the (compressed) dictionary, then one
frame per record. Spark's text writer stores the frames, so any store works; the line separator it puts
between them is itself an empty skippable frame. The reader takes whole files, loads the dictionary,
walks the frames by their block headers, decodes one frame per record, and checks headers, lengths,
digests and that no byte is left over.

Edge cases: a null payload or url is empty; a row with a null id is a response and is never referred to;
rows that repeat the largest id of a payload are all responses; control characters in a header value are
percent-encoded; ids are exact at any size; an empty table gives no archive and an empty result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .base import scratch_path, values, written

#: Fixed values of the formats: frame magics, the revisit profile, the least payload that is deduplicated.
DICTIONARY_MAGIC, SKIPPABLE, FRAME_MAGIC = 0x184D2A5D, range(0x184D2A50, 0x184D2A60), 0xFD2FB528
BETWEEN = "P*M\x18\x00\x00\x00\x00"  # an empty skippable frame, as text
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LEAST_PAYLOAD = 1000
#: A broadcast of revisit targets is used up to so many; beyond, the join shuffles.
BROADCAST_ROWS = 100_000
#: Sample rows a dictionary is trained on, and characters of each.
SAMPLE_ROWS, SAMPLE_CHARS = 400, 8_000
READ = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def header_value(text: str) -> str:
    return quote(text, safe="".join(chr(c) for c in range(0x21, 0x7F) if chr(c) != "%"), encoding="utf-8")


def record(page: int | None, url: str, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record: a response with its payload, or a revisit with the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page is None else page}>",
        f"WARC-Target-URI: {header_value(url)}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    block = http + payload if refers_to is None else http
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def fields(data: bytes, first: bytes) -> tuple[dict[str, str], bytes]:
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not found or not lines[0].startswith(first):
        raise ValueError(f"a header that begins {data[:20]!r}")
    pairs = [x.decode().partition(": ") for x in lines[1:]]
    return {k.lower(): v for k, _, v in pairs}, rest


def parsed(data: bytes) -> dict:
    """A record's fields, checked: declared against real lengths, and the payload against its digest."""
    head, rest = fields(data, b"WARC/1.")
    n = int(head["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError(f"{head['warc-record-id']}: {len(rest)} bytes follow the header, not {n + 4}")
    http, payload = fields(rest[:n], b"HTTP/1.")
    size, kind = int(http["content-length"]), head["warc-type"]
    digest = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"{head['warc-record-id']}: the payload is not the declared one")
    if kind == "revisit" and payload:
        raise ValueError(f"{head['warc-record-id']}: a revisit with a payload")
    page, target = (head.get(k, "").removeprefix("<urn:page:").rstrip(">") for k in ("warc-record-id", "warc-refers-to"))
    return {
        "page_id": int(page) if page else None, "url": unquote(head["warc-target-uri"]), "record_type": kind, "refers_to": int(target) if target else None,
        "payload_bytes": size, "payload_digest": digest, "payload": payload if kind == "response" else None,
    }


def frame_end(data: memoryview, at: int) -> int:
    """Where the frame that begins here ends, from its headers alone."""
    flags = data[at + 4]
    single, dictionary, size = flags >> 5 & 1, (0, 1, 2, 4)[flags & 3], (0, 2, 4, 8)[flags >> 6]
    p = at + 5 + (1 - single) + dictionary + (size or single)
    while True:
        head = int.from_bytes(data[p: p + 3], "little")
        p += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
        if p > len(data):
            raise ValueError("the archive ends inside a frame")
        if head & 1:
            return p + 4 * (flags >> 2 & 1)


def frames(content: bytes) -> Iterator[bytes]:
    """The records of one archive, a decoded frame each."""
    data, at, decoder = memoryview(content), 0, None
    while at < len(data):
        if at + 8 > len(data):
            raise ValueError("bytes left over at the end of the archive")
        magic, size = struct.unpack_from("<II", data, at)
        if magic in SKIPPABLE:
            if magic == DICTIONARY_MAGIC and at == 0:
                raw = bytes(data[8: 8 + size])
                raw = zstd.ZstdDecompressor().decompress(raw) if raw[:4] == struct.pack("<I", FRAME_MAGIC) else raw
                decoder = zstd.ZstdDecompressor(dict_data=zstd.ZstdCompressionDict(raw))
            at += 8 + size
            if at > len(data):
                raise ValueError("a skippable frame reaches past the end")
            continue
        if magic != FRAME_MAGIC:
            raise ValueError(f"no frame begins at byte {at}")
        end = frame_end(data, at)
        yield (decoder or zstd.ZstdDecompressor()).decompress(data[at:end])
        at = end


def train(samples: list[bytes], size: int = 1 << 15) -> bytes:
    """A dictionary from sample records; too few samples give a plain-content one."""
    try:
        return zstd.train_dictionary(size, samples, level=3).as_bytes()
    except zstd.ZstdError:
        return (b"".join(samples) or record(0, "http://example.org/", b"<!DOCTYPE html><html><head>", None))[-size:]


def revisits(pages: DataFrame, least: int = LEAST_PAYLOAD) -> DataFrame:
    """pages with refers_to: the largest page_id of an equal payload of at least so many bytes, null at that row itself."""
    own = pages.select(
        F.col("page_id").cast("long"), F.coalesce(F.col("url"), F.lit("")).alias("url"),
        F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("digest", F.sha1("payload"))
    groups = own.where(F.length("payload") >= least).groupBy("digest").agg(F.max("page_id").alias("target"), F.count("*").alias("n")).where("n > 1 and target is not null")
    groups = written(groups.select("digest", "target"), "revisits")
    side = F.broadcast(groups) if groups.count() <= BROADCAST_ROWS else groups
    return own.join(side, "digest", "left").select("page_id", "url", "payload", F.expr("case when page_id < target then target end").alias("refers_to"))


def write_archives(rows: DataFrame, path: str, level: int = 3) -> None:
    """page_id, url, payload, refers_to -> an archive per task under path."""
    first = rows.where("refers_to is null and page_id is not null")
    # Ids first: a task sends the driver its share of ids, not of pages.
    ids = [r["page_id"] for r in first.select("page_id").orderBy(F.xxhash64("page_id"), "page_id").limit(SAMPLE_ROWS).collect()]
    chosen = first.where(F.col("page_id").isin(ids)).select("page_id", "url", F.expr(f"substring(payload, 1, {SAMPLE_CHARS})").alias("payload")).limit(SAMPLE_ROWS).collect()
    dictionary = train([record(r["page_id"], r["url"], bytes(r["payload"]), None) for r in chosen])

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = zstd.ZstdCompressor(level=19).compress(dictionary)
        head = struct.pack("<II", DICTIONARY_MAGIC, len(packed)) + packed
        coder = zstd.ZstdCompressor(level=level, dict_data=zstd.ZstdCompressionDict(dictionary), write_checksum=True)
        for batch in batches:
            out = [coder.compress(record(*r)) for r in zip(*(values(batch, c) for c in ("page_id", "url", "payload", "refers_to")), strict=True)]
            if out and head:
                out, head = [head, *out], b""
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["frame"])

    rows.mapInArrow(stored, "frame binary").select(F.col("frame").cast("string").alias("value")).write.option("lineSep", BETWEEN).option("maxRecordsPerFile", 0).text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row per record of all archives under path; a broken one fails the read."""

    schema = to_arrow_schema(T.StructType.fromDDL(READ))

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(values(batch, "path"), batch.column(batch.schema.get_field_index("content")), strict=True):
                held, size = [], 0
                for data in frames(content.as_buffer()):
                    try:
                        held.append(parsed(data))
                    except (KeyError, ValueError) as e:
                        raise ValueError(f"{name}: {e}") from e
                    size += len(data)
                    if size > 16 << 20:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.where("length > 0").select("path", "content").mapInArrow(records, READ)


def archived(pages: DataFrame) -> DataFrame:
    """Write pages (page_id, url, html) as archives in the shared folder, and read them back."""
    path = scratch_path(pages.sparkSession, "warc")
    write_archives(revisits(pages), path)
    return read_archives(pages.sparkSession, path)
