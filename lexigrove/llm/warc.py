"""WARC: a dictionary-compressed writer and its reader.

``train_dictionary`` builds one Zstandard dictionary from a bounded sample of stretches of records, from anywhere in them. ``write_archives`` writes
``*.warc.zst`` files: a leading skippable frame holds the dictionary, and each record is a frame of its own, so a reader
can start at any record's offset. Of pages with equal payloads the one with the smallest page_id becomes a response record
and the others revisit it without a payload. ``read_archives`` reads files back, frame by frame, with nothing but what is
in them.

A task writes a file under a name of its own and moves it into place when it is whole; the manifest that the job returns
names the files of the tasks that counted, so what a lost executor or a second attempt leaves is never read.

Defined results: a null html is an empty payload; a null page_id is kept, but a page with an id is preferred as response;
repeated rows are records of their own, of the same type; an empty table gives no files; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shipping import arrow_map
from .shared import batches, materialize, scratch_path

#: First bytes of the skippable frame that holds a dictionary.
MAGIC = (0x184D2A5D).to_bytes(4, "little")
#: What a dictionary is trained on, in stretches of so many characters, and its size; all on the driver.
SAMPLE_RECORDS, SAMPLE_BYTES, STRETCH, DICTIONARY_BYTES = 1500, 6 << 20, 8 << 10, 64 << 10
#: A file is closed once it has so many bytes.
FILE_BYTES = 32 << 20
#: A task reads so many bytes of archives, if there are more of them than cores.
READ_BYTES = 128 << 20
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"
NO_ID = -(2**63)

MANIFEST = "path string, records long, bytes long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def record_id(page_id: int | None) -> str:
    """A UUID that holds a page's id (of 64 bits) in its last groups."""
    n = (NO_ID if page_id is None else page_id) & (2**64 - 1)
    return f"<urn:uuid:7761726d-{n >> 48:04x}-8000-8{(n >> 36) & 0xFFF:03x}-{n & (2**36 - 1):012x}>"


def page_of(record: str) -> int | None:
    """The page id that a ``record_id`` holds."""
    part = record.strip("<>").removeprefix("urn:uuid:").split("-")
    n = (int(part[1], 16) << 48) | (int(part[3][1:], 16) << 36) | int(part[4], 16)
    n = n - 2**64 if n >= 2**63 else n
    return None if n == NO_ID else n


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def build_record(page_id: int | None, url: str | None, payload: bytes, first: int | None, revisit: bool) -> bytes:
    """A WARC/1.1 response record, or a revisit record that refers to the response with id ``first``."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {' '.join((url or '').split())}",
        f"WARC-Payload-Digest: sha1:{digest_of(payload)}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(first)}"]
    return "\r\n".join([*lines, "", ""]).encode() + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """A record as a row of ``RECORD``; the length of a revisited payload is that of its HTTP header."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    revisit = fields["WARC-Type"] == "revisit"
    return {
        "page_id": page_of(fields["WARC-Record-ID"]),
        "url": fields["WARC-Target-URI"],
        "payload_bytes": length,
        "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"),
        "record_type": fields["WARC-Type"],
        "refers_to": page_of(fields["WARC-Refers-To"]) if revisit else None,
        "payload": None if revisit else payload,
    }


def train_dictionary(pages: DataFrame, records: int = SAMPLE_RECORDS) -> bytes:
    """A dictionary from about ``records`` stretches of pages, chosen by hash among all stretches; empty if there are no pages.

    The first stretch of a page comes with its record's head. Too few samples to train on are given repeatedly.
    """
    import zstandard

    html = F.coalesce("html", F.lit(""))
    last = F.floor(F.greatest(F.length(html) - 1, F.lit(0)) / STRETCH).cast("int")
    total = pages.agg(F.sum(last + 1)).first()[0] or 0
    if not total:
        return b""
    share = min(1.0, records / total)
    page = F.col("page_id").cast("long")
    drawn = F.filter(F.sequence(F.lit(0), last), lambda k: F.pmod(F.xxhash64(page, k, F.lit("dictionary")), F.lit(1 << 30)) < int(share * (1 << 30)))
    parts = F.transform(drawn, lambda k: F.struct(k.alias("nth"), F.substring(html, k * STRETCH + 1, F.lit(STRETCH)).alias("part")))
    rows = pages.select(page.alias("page"), "url", parts.alias("parts")).select(F.col("page").alias("page_id"), "url", F.inline("parts")).limit(2 * records).collect()
    samples, size = [], 0
    for r in rows:
        if size < SAMPLE_BYTES:
            part = r["part"].encode()
            samples.append(part if r["nth"] else build_record(r["page_id"], r["url"], part, None, False))
            size += len(samples[-1])
    for times in (1, 16, 256):
        try:
            return zstandard.train_dictionary(max(256, min(DICTIONARY_BYTES, times * size // 8)), times * samples, k=200, d=8).as_bytes()
        except zstandard.ZstdError:  # too few or too short
            continue
    raise ValueError("no dictionary can be trained")


def mark_revisits(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, first): ``first`` is the smallest page_id with the same payload, null if no other page has it.

    Only digests are grouped. A page joins the group of its digest by a sort-merge join whose hot side can be split.
    """
    rows = pages.select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha1(F.encode("html", "UTF-8")))
    groups = materialize(rows.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1").select("digest", "first"), "revisits")
    return rows.join(groups.hint("merge"), "digest", "left").select("page_id", "url", "html", "first")


class Archive:
    """One ``.warc.zst`` file being written."""

    def __init__(self, where: pafs.FileSystem, folder: str, dictionary: bytes):
        import zstandard

        self.where, self.path = where, f"{folder}/{uuid.uuid4().hex}.warc.zst"
        self.out = where.open_output_stream(self.path + ".part", compression=None)
        held = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=True, write_checksum=True).compress
        self.bytes, self.records = 0, 0
        if dictionary:
            self._put(MAGIC + len(dictionary).to_bytes(4, "little") + dictionary)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.bytes += len(data)

    def add(self, record: bytes) -> None:
        self._put(self.compress(record))
        self.records += 1

    def close(self) -> tuple[str, int, int]:
        self.out.close()
        self.where.move(self.path + ".part", self.path)
        return self.path, self.records, self.bytes


def write_archives(pages: DataFrame, folder: str, dictionary: bytes, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write ``pages`` (as ``mark_revisits`` gives them) below ``folder``, a URI that all executors share; the files, as ``MANIFEST``."""
    held = pages.sparkSession.sparkContext.broadcast(dictionary)  # of DICTIONARY_BYTES at most

    def write(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = pafs.FileSystem.from_uri(folder)
        where.create_dir(root, recursive=True)
        archive, done = None, []
        for batch in batches(stream):
            for page_id, url, html, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                archive = archive or Archive(where, root, held.value)
                archive.add(build_record(page_id, url, html.encode("utf-8"), first, first is not None and first != page_id))
                if archive.bytes >= file_bytes:
                    done.append(archive.close())
                    archive = None
        if archive:
            done.append(archive.close())
        yield pa.RecordBatch.from_pylist([dict(zip(("path", "records", "bytes"), d, strict=True)) for d in done], pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    return materialize(arrow_map(pages.select("page_id", "url", "html", "first"), write, MANIFEST), "manifest")


def records_in(stream: pa.NativeFile) -> Iterator[bytes]:
    """The records of an archive, in order; a few MB of it are held at a time."""
    import zstandard

    data, ended = b"", False

    def more() -> bool:
        nonlocal data, ended
        new = b"" if ended else stream.read(1 << 20)
        ended = not new
        data += new
        return bool(new)

    decompressor = zstandard.ZstdDecompressor()
    while data or more():
        while len(data) < 8 and more():
            pass
        if data[:4] == MAGIC:
            size = int.from_bytes(data[4:8], "little")
            while len(data) < 8 + size and more():
                pass
            decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size]))
            data = data[8 + size :]
            continue
        frame, parts = decompressor.decompressobj(), []
        while True:
            parts.append(frame.decompress(data))
            if frame.eof:
                data = frame.unused_data
                break
            data = b""
            if not more():
                raise ValueError("an archive ends within a record")
        yield b"".join(parts)


def read_archives(manifest: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records of the files that ``manifest`` names, as ``RECORD``; without ``payloads`` that column is null."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def read(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, _ = pafs.FileSystem.from_uri(folder)
        for batch in stream:
            for path in batch.column(0).to_pylist():
                rows, size = [], 0
                with where.open_input_stream(path, compression=None) as source:
                    for data in records_in(source):
                        row = parse_record(data)
                        if row["record_type"] == "response" and (len(row["payload"]) != row["payload_bytes"] or digest_of(row["payload"]) != row["payload_digest"]):
                            raise ValueError(f"{path}: a payload differs from its digest")
                        if not payloads:
                            row["payload"] = None
                        rows.append(row)
                        size += len(data) if payloads else 200
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    total = manifest.agg(F.count("*"), F.sum("bytes")).first()
    tasks = min(total[0], max(2 * manifest.sparkSession.sparkContext.defaultParallelism, -(-(total[1] or 0) // READ_BYTES)))
    return arrow_map(manifest.select("path").repartition(max(1, tasks)), read, RECORD)


def archive_pages(pages: DataFrame, folder: str | None = None) -> tuple[DataFrame, str]:
    """Write all ``pages(page_id, url, html)``; (manifest, folder). Without a folder, one in the shared scratch space is used."""
    folder = folder or scratch_path(pages.sparkSession, "warc")
    return write_archives(mark_revisits(pages), folder, train_dictionary(pages)), folder
