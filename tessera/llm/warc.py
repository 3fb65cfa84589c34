"""Zstandard WARC archives: written with one frame per record and a dictionary in the leading skippable frame, and read back.

Writing: of records with equal payloads of at least 1000 bytes the one with the largest page_id is a response, the others
revisit it; shorter payloads are all responses. Each task trains a dictionary on its first records and rolls to a new
archive after a bounded number of bytes. Files are named after the task attempt, and only those that the manifest of
the finished attempts lists are read, so a repeated task leaves no record twice.

Reading: archives come in as Spark's binary files; the dictionary is loaded from the skippable frame, every further frame is
walked block by block, decoded on its own and validated: version line, header syntax, Content-Length, payload length and SHA-1.

Null html is an empty payload, a null url has no WARC-Target-URI, a null page_id counts below all others (and a revisit
cannot name it). Rows that repeat a page_id and a payload are all responses if that page_id is the largest. An empty table
gives no records. Columns other than page_id, url and html are not read.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.scratch import Scratch

MAGIC = 0x184D2A5D
LEAST_REVISIT, ARCHIVE_BYTES, SAMPLE_RECORDS, DICT_BYTES = 1000, 32_000_000, 200, 16_384
#: Up to this many archives the manifest is broadcast, some 100 bytes each.
BROADCAST_ARCHIVES = 50_000
DATE = "2024-01-01T00:00:00Z"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def record_types(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """page_id, url, html, digest, record_type, refers_to."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha1(html.cast("binary")).alias("digest"), F.octet_length(html).cast("long").alias("bytes"))
    shared = rows.where(F.col("bytes") >= LEAST_REVISIT).groupBy("digest").agg(F.max("page_id").alias("of"), F.count("*").alias("n")).where("n > 1 and of is not null").select("digest", "of")
    joined = rows.join(scratch.table(shared, "shared"), "digest", "left")
    revisit = F.col("of").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("of"))
    return joined.select("page_id", "url", "html", "digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("of")).alias("refers_to"))


def record(page_id, url, payload: bytes, digest: str, kind: str, refers_to) -> bytes:
    """One WARC record; a revisit carries no payload, but its digest and length."""
    body = _HTTP + payload if kind == "response" else _HTTP
    headers = [
        ("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}|{url}|{kind}')}>"), ("WARC-Date", DATE),
        ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response"), ("X-Payload-Length", str(len(payload))),
    ]
    if url is not None:
        headers.append(("WARC-Target-URI", quote(url, safe=":/?#[]@!$&'()*+,;=%~-._")))
    if page_id is not None:
        headers.append(("X-Page-ID", str(page_id)))
    if kind == "revisit":
        headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Page-ID", str(refers_to))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(body)}\r\n\r\n"
    return head.encode() + body + b"\r\n\r\n"


def dictionary(records: list[bytes]) -> bytes:
    """Trained on sample records; too few or too short ones serve as raw content themselves."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, records).as_bytes()
    except zstandard.ZstdError:
        return b"".join(r[:2000] for r in records)[:DICT_BYTES].ljust(8)


def write_archives(pages: DataFrame, folder: str, scratch: Scratch) -> DataFrame:
    """Write the archives into a folder that all executors reach; the manifest: file, records."""

    def write(batches):
        files, top = pafs.FileSystem.from_uri(folder)
        files.create_dir(top, recursive=True)
        attempt, made = uuid.uuid4().hex, 0

        def archive(records: list[bytes]):
            nonlocal made
            content = dictionary(records[:SAMPLE_RECORDS])
            packer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(content), write_checksum=True)
            name = f"{attempt}-{made:05d}.warc.zst"
            made += 1
            with files.open_output_stream(f"{top}/{name}", compression=None) as out:
                out.write(struct.pack("<II", MAGIC, len(content)) + content)
                for r in records:
                    out.write(packer.compress(r))
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(records)], pa.int64())], names=["file", "records"])

        waiting, size = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                waiting.append(record(row["page_id"], row["url"], row["html"].encode(), row["digest"], row["record_type"], row["refers_to"]))
                size += len(waiting[-1])
                if size >= ARCHIVE_BYTES:
                    yield archive(waiting)
                    waiting, size = [], 0
        if waiting:
            yield archive(waiting)

    return scratch.table(record_types(pages, scratch).mapInArrow(write, "file string, records long"), "manifest")


def frames(data: memoryview):
    """(start, end) of each zstandard frame, found by walking block headers; skippable frames too."""
    at = 0
    while at < len(data):
        magic = struct.unpack_from("<I", data, at)[0]
        if 0x184D2A50 <= magic <= 0x184D2A5F:
            end = at + 8 + struct.unpack_from("<I", data, at + 4)[0]
        else:
            checksum = zstandard.get_frame_parameters(data[at : at + 18]).has_checksum
            end, last = at + zstandard.frame_header_size(data[at : at + 18]), False
            while not last:
                block = int.from_bytes(data[end : end + 3], "little")
                last, kind = block & 1, block >> 1 & 3
                if kind == 3:
                    raise ValueError("a reserved block type")
                end += 3 + (1 if kind == 1 else block >> 3)
            end += 4 * checksum
        if end > len(data):
            raise ValueError("the archive ends inside a frame")
        yield at, end
        at = end


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(headers by lower-case name, block) of one record; raises ValueError where it breaks the format."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not found or not lines[0].startswith("WARC/1."):
        raise ValueError(f"no WARC record: {raw[:40]!r}")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise ValueError(f"a malformed header: {line!r}")
        headers[name.lower()] = value.strip()
    n = int(headers["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError("Content-Length does not hold")
    return headers, rest[:n]


def records_of(content) -> list[tuple]:
    """All records of an archive: (page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload)."""
    data, out = memoryview(content), []
    walk = frames(data)
    at, end = next(walk)
    if struct.unpack_from("<I", data, at)[0] != MAGIC:
        raise ValueError("the archive does not begin with its dictionary")
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(bytes(data[at + 8 : end])))
    for at, end in walk:
        headers, block = parse(reader.decompress(data[at:end]))
        kind, digest, n = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha1:"), int(headers["x-payload-length"])
        payload = block.partition(b"\r\n\r\n")[2]
        if kind == "response" and (len(payload) != n or hashlib.sha1(payload).hexdigest() != digest):
            raise ValueError("payload and digest differ")
        number = lambda k: int(headers[k]) if k in headers else None
        out.append((number("x-page-id"), headers.get("warc-target-uri"), n, digest, kind, number("x-refers-to-page-id"), payload if kind == "response" else None))
    return out


_SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_archives(spark: SparkSession, folder: str, manifest: DataFrame | None = None, payloads: bool = False) -> DataFrame:
    """One row per record of the archives in a folder, or of those the manifest lists; with the payload if asked."""
    binary = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("path", "content")
    if manifest is not None:
        listed = manifest.select("file")
        if manifest.count() <= BROADCAST_ARCHIVES:
            listed = F.broadcast(listed)
        binary = binary.withColumn("file", F.element_at(F.split("path", "/"), -1)).join(listed, "file", "left_semi")
    wanted = 7 if payloads else 6

    def read(batches):
        for batch in batches:
            for content in batch.column(0):
                rows = records_of(content.as_buffer())
                for lo in range(0, len(rows), 2000):
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows[lo : lo + 2000]], schema=schema)

    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()][:wanted]
    names = [x.split()[0] for x in _SCHEMA.split(", ")] + ["payload"] * payloads
    schema = pa.schema(list(zip(names, types)))
    return binary.select("content").mapInArrow(read, _SCHEMA + ", payload binary" * payloads)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write archives of all pages into the shared folder, then read what they hold."""
    scratch = Scratch(pages.sparkSession, "warc")
    folder = f"{scratch.root}/archives"
    manifest = write_archives(pages, folder, scratch)
    if not manifest.head(1):
        return pages.sparkSession.createDataFrame([], _SCHEMA)
    return read_archives(pages.sparkSession, folder, manifest)
