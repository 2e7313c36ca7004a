"""WARC archives with a Zstandard dictionary in a leading skippable frame.

Every archive starts with a skippable frame that holds the dictionary built from its own records;
each record is a frame of its own, compressed with that dictionary. Equal payloads are stored once;
further ones become revisit records.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.shared import cut, map_arrow, shared_path

#: The frame magic of WARC dictionaries and of Zstandard frames, and record types.
SKIPPABLE, FRAME = b"\x5d\x2a\x4d\x18", b"\x28\xb5\x2f\xfd"
RESPONSE, REVISIT = "response", "revisit"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MIN_SHARED_BYTES = 100
#: Uncompressed bytes of records that one archive holds, about; a writer keeps so many in memory.
ARCHIVE_BYTES = 16 << 20
#: Size of a dictionary, and the records' bytes it is built from, taken evenly over the archive.
DICT_BYTES, SAMPLE_BYTES = 64 << 10, 4 << 20
DATE = "2024-01-01T00:00:00Z"
LEVEL = 3
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")
RECORD = "page_id {id}, url string, record_type string, refers_to {id}, payload_bytes long, payload_digest string, payload binary"


def _record_id(page: object, digest: str) -> str:
    h = hashlib.md5(f"{page} {digest}".encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def record_bytes(page: object, url: str | None, payload: bytes, digest: str, refers_to: object) -> bytes:
    """One WARC 1.1 record; a revisit (refers_to given) has the HTTP header but no payload."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    target = _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url) if url else "urn:page:unknown"
    head = [
        "WARC/1.1",
        f"WARC-Type: {REVISIT if revisit else RESPONSE}",
        f"WARC-Record-ID: {_record_id(page, digest)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page is not None:
        head.append(f"X-Page-Id: {page}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(refers_to, digest)}", f"X-Refers-To-Page-Id: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def build_dictionary(records: list[bytes]) -> bytes:
    """Dictionary from records taken evenly; empty if there are too few to build one."""
    total = sum(map(len, records))
    step = max(1, -(-total // SAMPLE_BYTES))
    sample = records[::step]
    try:
        return zstandard.train_dictionary(min(DICT_BYTES, max(1024, total // 10)), sample).as_bytes() if len(sample) >= 8 else b""
    except zstandard.ZstdError:
        return b""


def archive_bytes(records: list[bytes]) -> bytes:
    dictionary = build_dictionary(records)
    given = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=given, write_content_size=True)
    held = zstandard.ZstdCompressor(level=19).compress(dictionary)
    return b"".join([SKIPPABLE, struct.pack("<I", len(held)), held, *map(packer.compress, records)])


def read_archive(stream) -> Iterator[bytes]:
    """Records of an archive, one frame after the other."""
    if stream.read(4) != SKIPPABLE:
        raise ValueError("no dictionary frame")
    dictionary = zstandard.ZstdDecompressor().decompress(stream.read(struct.unpack("<I", stream.read(4))[0]), max_output_size=DICT_BYTES * 2)
    given = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    unpacker = zstandard.ZstdDecompressor(dict_data=given)
    rest = b""
    while True:
        frame, out = unpacker.decompressobj(), []
        rest = rest or stream.read(1 << 16)
        if not rest:
            return
        while rest and not frame.eof:
            out.append(frame.decompress(rest))
            rest = frame.unused_data if frame.eof else stream.read(1 << 16)
        if not frame.eof:
            raise ValueError("archive ends within a record")
        yield b"".join(out)


def parse_record(record: bytes) -> dict:
    head, _, body = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = body[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    sent = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])
    revisit = fields["WARC-Type"] == REVISIT
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if not revisit and hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"payload of {fields['WARC-Record-ID']} is damaged")
    return {
        "page_id": fields.get("X-Page-Id"),
        "url": fields["WARC-Target-URI"],
        "record_type": fields["WARC-Type"],
        "refers_to": fields.get("X-Refers-To-Page-Id"),
        "payload_bytes": int(sent["Content-Length"]),
        "payload_digest": digest,
        "payload": None if revisit else payload,
    }


def _file_system(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder if ":" in folder else f"file://{folder}")


def first_pages(pages: DataFrame) -> DataFrame:
    """page_id, digest and refers_to of the pages that revisit another one."""
    rows = pages.select("page_id", F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256).alias("digest"), F.octet_length("html").alias("bytes"))
    large = cut(rows.where(F.col("bytes") >= MIN_SHARED_BYTES).select("page_id", "digest"))
    first = large.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    return large.join(cut(first), "digest").where("page_id <> refers_to").distinct()


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write one record per row of pages (page_id, url, html); returns the list of archives.

    The smallest page_id among equal payloads of at least 100 bytes is stored, the others revisit
    it. Repeated rows with that smallest id are all stored; rows with a null id are stored and never
    referred to. Null html is an empty payload; long pages are never cut. An empty table gives an
    empty list. Only ids and digests are compared; pages are shuffled once, by id. Files of failed
    attempts are not in the list, which is itself a table in the folder.
    """
    pages = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    digest = F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256).alias("digest")
    rows = pages.withColumn("digest", digest).join(cut(first_pages(pages)), ["page_id", "digest"], "left")
    rows = rows.select("page_id", "url", "html", "digest", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        where, path = _file_system(folder)
        task = TaskContext.get()
        name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}"
        records: list[bytes] = []
        held = made = 0

        def flush() -> pa.RecordBatch:
            file = f"{name}-{made}.warc.zst"
            with where.open_output_stream(f"{path}/{file}") as out:
                out.write(archive_bytes(records))
            return pa.RecordBatch.from_arrays([pa.array([file]), pa.array([len(records)], pa.int64())], ["file", "records"])

        where.create_dir(path, recursive=True)
        for batch in batches:
            for row in batch.to_pylist():
                payload = (row["html"] or "").encode()
                records.append(record_bytes(row["page_id"], row["url"], payload, row["digest"], row["refers_to"]))
                held += len(records[-1])
                if held >= ARCHIVE_BYTES:
                    yield flush()
                    records, held, made = [], 0, made + 1
        if records:
            yield flush()

    manifest = f"{folder}/manifest.parquet"
    map_arrow(rows, run, "file string, records long").write.parquet(manifest)
    return pages.sparkSession.read.parquet(manifest)


def read_archives(spark: SparkSession, folder: str, id_type: str = "bigint") -> DataFrame:
    """Records of all listed archives of a folder: one row each, payload null for revisits."""
    files = spark.read.parquet(f"{folder}/manifest.parquet").select("file")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, path = _file_system(folder)
        kind = pa.schema([(c, pa.int64() if c == "payload_bytes" else pa.binary() if c == "payload" else pa.string()) for c in columns])
        for batch in batches:
            for file in batch.column(0).to_pylist():
                block, held = [], 0
                with where.open_input_stream(f"{path}/{file}") as stream:
                    for record in read_archive(stream):
                        block.append(parse_record(record))
                        held += len(record)
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_pylist(block, kind)
                            block, held = [], 0
                if block:
                    yield pa.RecordBatch.from_pylist(block, kind)

    columns = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
    rows = map_arrow(files.repartition("file"), run, RECORD.format(id="string"))
    return rows.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


def archive_pages(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write pages to archives in a folder (by default a new one in the shared folder), read them back."""
    spark = pages.sparkSession
    folder = folder or shared_path(spark, "warc")
    write_archives(pages, folder)
    return read_archives(spark, folder, pages.schema["page_id"].dataType.simpleString())
