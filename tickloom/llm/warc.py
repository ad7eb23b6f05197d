"""Web archives whose records are Zstandard frames of their own with a dictionary made from the records.

An archive starts with a skippable frame that holds the dictionary, so it can be
read by itself; each record can be decompressed without the ones before it.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import small_batches

#: Fixed values of the format.
SKIPPABLE = 0x184D2A5D
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"

ARCHIVE_BYTES = 32 << 20
#: An archive is read in stretches; a frame is decompressed from pieces that grow from this size.
STRETCH, FIRST_PIECE = 1 << 20, 1 << 12
SAMPLE_BYTES, DICTIONARY_BYTES = 1 << 20, 16 << 10
URN = "urn:page:"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """A response record, or a revisit record if ``refers_to`` is given."""
    revisit = refers_to is not None
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": f"<{URN}{'' if page_id is None else page_id}>",
        "WARC-Date": date,
        "WARC-Target-URI": None if url is None else quote(url, safe="".join(map(chr, range(33, 127)))),
        "WARC-Payload-Digest": f"sha1:{base32_sha1(payload)}",
        "WARC-Payload-Length": str(len(payload)),
        "WARC-Refers-To": f"<{URN}{refers_to}>" if revisit else None,
        "WARC-Profile": PROFILE if revisit else None,
        "Content-Type": "application/http;msgtype=response",
    }
    block = HTTP if revisit else HTTP + payload
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
    return f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """The named fields and the block of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines)
    return fields, rest[: int(fields["Content-Length"])]


def dictionary(samples: list[bytes]) -> zstandard.ZstdCompressionDict:
    """Trained on the records; of too few or too short ones the records themselves."""
    if len(samples) >= 16:
        try:
            return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8)
        except zstandard.ZstdError:
            pass
    raw = b"".join(samples)[-DICTIONARY_BYTES:]
    return zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)


class Writer:
    """Writes records to archives of about ``most`` bytes in a folder, under names no other attempt uses."""

    def __init__(self, folder: str, most: int = ARCHIVE_BYTES):
        self.files, self.folder = fs.FileSystem.from_uri(folder)  # a folder that all executors reach
        self.most, self.waiting, self.waiting_bytes = most, [], 0
        self.out = None
        self.done: list[tuple[str, int, int]] = []

    def add(self, data: bytes) -> None:
        if self.out is None:
            self.waiting.append(data)
            self.waiting_bytes += len(data)
            if self.waiting_bytes >= SAMPLE_BYTES:
                self.open()
        else:
            self.put(data)

    def open(self) -> None:
        self.path = f"{self.folder}/{uuid.uuid4().hex}.warc.zst"
        self.out, self.records = self.files.open_output_stream(self.path, compression=None), 0
        made = dictionary(self.waiting)
        content = made.as_bytes()
        self.out.write(struct.pack("<II", SKIPPABLE, len(content)) + content)
        self.size = 0  # of the records
        self.compressor = zstandard.ZstdCompressor(level=3, dict_data=made, write_content_size=True)
        waiting, self.waiting, self.waiting_bytes = self.waiting, [], 0
        for data in waiting:
            self.put(data)

    def put(self, data: bytes) -> None:
        if self.out is None:  # the archive was full
            return self.add(data)
        frame = self.compressor.compress(data)
        self.out.write(frame)
        self.size += len(frame)
        self.records += 1
        if self.size >= self.most:
            self.close()

    def close(self) -> None:
        self.out.close()
        self.done.append((self.path, self.records, self.size))
        self.out = None

    def finish(self) -> list[tuple[str, int, int]]:
        """(path, records, bytes of the records) of each archive."""
        while self.waiting:  # the first ones may fill an archive
            self.open()
        if self.out is not None:
            self.close()
        return self.done


def read_archive(archive: BinaryIO | bytes) -> Iterator[bytes]:
    """The records of an archive: its dictionary first, then frame by frame.

    No more is held than a stretch of the archive and the record at hand. A
    frame is handed over in growing pieces, so that what lies behind it is small
    as well and reading takes time in proportion to the archive.
    """
    source = io.BytesIO(archive) if isinstance(archive, bytes) else archive
    magic, size = struct.unpack("<II", source.read(8))
    if magic != SKIPPABLE:
        raise ValueError("no dictionary frame")
    content = source.read(size)
    trained = content[:4] == b"\x37\xa4\x30\xec"
    kind = zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=kind))
    held, at = b"", 0
    while True:
        while len(held) - at < len(ZSTD_MAGIC) and (more := source.read(STRETCH)):
            held, at = held[at:] + more, 0
        if at == len(held):
            return
        if held[at : at + len(ZSTD_MAGIC)] != ZSTD_MAGIC:
            raise ValueError("not a Zstandard frame")
        frame, out, step = reader.decompressobj(), [], FIRST_PIECE
        while not frame.eof:
            if at == len(held):
                held, at = source.read(STRETCH), 0
                if not held:
                    raise ValueError("the last frame is cut off")
            piece = held[at : at + step]
            out.append(frame.decompress(piece))
            at += len(piece) - len(frame.unused_data)
            step *= 2
        yield b"".join(out)


def records_of(files: fs.FileSystem, path: str) -> Iterator[bytes]:
    with files.open_input_stream(path, compression=None) as source:
        yield from read_archive(source)


def originals(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pages with ``digest`` and ``bytes`` of their payload, and the largest page_id of each payload that repeats."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    keyed = pages.withColumns({"digest": F.sha1(payload.cast("binary")), "bytes": F.octet_length(payload)})
    groups = keyed.groupBy("digest", "bytes").agg(F.max("page_id").alias("original"), F.count("*").alias("n"))
    return keyed, groups.filter("n > 1").select("digest", "bytes", "original")


def write_archives(
    pages: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", most: int = ARCHIVE_BYTES
) -> DataFrame:
    """Writes a record per page below ``folder`` and returns (path, records, bytes) of each archive.

    ``pages`` has page_id, url and html. Of pages with equal payloads that with
    the largest page_id is the response, the others revisit it. A null html is
    an empty payload, a null url is left out of the record, rows that repeat
    page_id and payload of the response are responses too; a null page_id is
    never referred to, unless no equal payload has an id, when all are responses.
    Tasks that are tried again write new files; only what a finished task
    reports is in the list, which is kept in ``folder``/list.
    """
    spark = pages.sparkSession
    small_batches(spark)
    keyed, groups = originals(pages.select("page_id", "url", "html"))
    groups.write.parquet(f"{folder}/groups")
    groups = spark.read.schema(groups.schema).parquet(f"{folder}/groups")
    refers_to = F.when(~F.coalesce(F.col("page_id") == F.col("original"), F.lit(False)), F.col("original"))
    rows = keyed.join(groups, ["digest", "bytes"], "left").select(
        "page_id", "url", "html", refers_to.alias("refers_to")
    )
    archives = f"{folder}/archives"
    files, path = fs.FileSystem.from_uri(archives)
    files.create_dir(path)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = Writer(archives, most)
        for b in batches:
            for page_id, url, html, other in zip(*(b.column(c).to_pylist() for c in b.schema.names), strict=True):
                writer.add(record(page_id, url, (html or "").encode(), other, date))
        done = writer.finish()
        if done:
            yield pa.record_batch([pa.array(x) for x in zip(*done, strict=True)], names=["path", "records", "bytes"])

    listed = rows.mapInArrow(write, "path string, records long, bytes long")
    listed.write.parquet(f"{folder}/list")
    return spark.read.schema(listed.schema).parquet(f"{folder}/list")


def read_archives(listed: DataFrame, folder: str) -> DataFrame:
    """(page_id, url, html, payload_bytes, payload_digest, record_type, refers_to) of all records of the archives.

    ``html`` is null for revisits. The digest of a response is checked against
    its payload.
    """
    tasks = int(listed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = "page_id long, url string, html string, payload_bytes long, payload_digest string, record_type string, refers_to long"

    def number(urn: str | None) -> int | None:
        text = (urn or "")[1 + len(URN) : -1]
        return int(text) if text else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = fs.FileSystem.from_uri(folder)
        names = [part.strip().split(" ")[0] for part in schema.split(",")]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for path in (p for b in batches for p in b.column("path").to_pylist()):
            rows, held = [], 0
            for fields, block in map(parse, records_of(files, path)):
                digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                html = None
                if fields["WARC-Type"] == "response":
                    payload = block.partition(b"\r\n\r\n")[2]
                    if base32_sha1(payload) != digest:
                        raise ValueError(f"digest of {fields['WARC-Record-ID']} in {path}")
                    html = payload.decode()
                rows.append((
                    number(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), html,
                    int(fields["WARC-Payload-Length"]), digest, fields["WARC-Type"], number(fields.get("WARC-Refers-To")),
                ))
                held += len(block)
                if held > 1 << 23:
                    yield batch(rows)
                    rows, held = [], 0
            if rows:
                yield batch(rows)

    return listed.repartition(tasks, "path").mapInArrow(read, schema)
