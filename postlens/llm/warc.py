"""WARC archives whose records are compressed one by one with a shared Zstandard dictionary.

Each task writes archives of bounded size. The first records of an archive are held back until a
dictionary has been built from them; it goes into a skippable frame at the head of the file, and then
every record is a frame of its own, so any record can be read from its offset with nothing but the
head. Records with a payload that an earlier page has are revisits: which page that is comes from
an aggregation over narrow (digest, length) rows, so payloads are shuffled once, by page id,
whatever the size of a group of copies.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.llm.common import saved

#: Type of the skippable frame that holds a dictionary.
DICTIONARY_FRAME = 0x184D2A5D
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
SCHEMA = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()),
    ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()),
])


def store(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder or file, local where the path names no scheme."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'page:{page_id}')}>"


def _head(fields: list[tuple[str, object]]) -> bytes:
    lines = "".join(f"{name}: {' '.join(str(value).split())}\r\n" for name, value in fields if value is not None)
    return b"WARC/1.1\r\n" + lines.encode("utf-8", "surrogatepass") + b"\r\n"


def record(page_id: int | None, url: str | None, payload: bytes, sha: str, first: int | None, date: str) -> bytes:
    """One record; ``first`` is the page that a revisit refers to, None for a response."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if first is None else http
    fields = [
        ("WARC-Type", "response" if first is None else "revisit"), ("WARC-Record-ID", _record_id(page_id)), ("WARC-Date", date),
        ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha1:{sha}"), ("X-Page-Id", page_id),
    ]
    if first is not None:
        fields += [("WARC-Profile", REVISIT), ("WARC-Refers-To", _record_id(first)), ("X-Refers-To-Page-Id", first)]
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", len(block))]
    return _head(fields) + block + b"\r\n\r\n"


def dictionary(samples: list[bytes], size: int) -> bytes:
    """A dictionary for these records; empty where they are too few or too small to build one."""
    try:
        return zstandard.train_dictionary(min(size, sum(map(len, samples)) // 8), samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


class ArchiveWriter:
    """One archive file. Records are held back until ``sample_bytes`` of them are there for the dictionary."""

    def __init__(self, path: str, sample_bytes: int, dictionary_bytes: int, level: int):
        files, name = store(path)
        self.path, self.out, self.level = path, files.open_output_stream(name, compression=None), level
        self.sample_bytes, self.dictionary_bytes = sample_bytes, dictionary_bytes
        self.held, self.held_bytes, self.packer, self.records, self.raw = [], 0, None, 0, 0

    def add(self, data: bytes) -> None:
        self.records, self.raw = self.records + 1, self.raw + len(data)
        if self.packer is not None:
            self.out.write(self.packer.compress(data))
            return
        self.held.append(data)
        self.held_bytes += len(data)
        if self.held_bytes >= self.sample_bytes:
            self._start()

    def _start(self) -> None:
        made = dictionary(self.held, self.dictionary_bytes)
        if made:
            self.out.write(struct.pack("<II", DICTIONARY_FRAME, len(made)) + made)
            self.packer = zstandard.ZstdCompressor(level=self.level, dict_data=zstandard.ZstdCompressionDict(made))
        else:
            self.packer = zstandard.ZstdCompressor(level=self.level)
        for data in self.held:
            self.out.write(self.packer.compress(data))
        self.held = []

    def close(self) -> None:
        if self.packer is None:
            self._start()
        self.out.close()


def read_archive(path: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record, read as a stream: never more than one record at a time."""
    files, name = store(path)
    with files.open_input_file(name) as file:
        head = file.read(8)
        known = None
        if len(head) == 8 and struct.unpack("<I", head[:4])[0] == DICTIONARY_FRAME:
            known = zstandard.ZstdCompressionDict(file.read(struct.unpack("<I", head[4:])[0]))
        else:
            file.seek(0)
        unpacker = zstandard.ZstdDecompressor(dict_data=known) if known else zstandard.ZstdDecompressor()
        with unpacker.stream_reader(file, read_across_frames=True) as raw, io.BufferedReader(raw, 1 << 20) as plain:
            while plain.readline():  # WARC/1.1
                fields = {}
                while (line := plain.readline()) not in (b"\r\n", b""):
                    key, _, value = line.decode("utf-8", "surrogatepass").partition(":")
                    fields[key] = value.strip()
                block = plain.read(int(fields["Content-Length"]))
                plain.read(4)
                yield fields, block


def first_pages(pages: DataFrame, page_id: str = "page_id", html: str = "html", min_bytes: int = 0) -> DataFrame:
    """``(_page, _sha, _first)``: of equal payloads of at least ``min_bytes`` bytes the smallest page id."""
    payload = F.coalesce(F.col(f"`{html}`"), F.lit("")).cast("binary")
    seen = saved(pages.select(F.col(f"`{page_id}`").cast("long").alias("_page"), F.sha1(payload).alias("_sha"), F.octet_length(payload).alias("_bytes")).distinct())
    firsts = saved(seen.where(F.col("_bytes") >= min_bytes).groupBy("_sha", "_bytes").agg(F.min("_page").alias("_first")))
    return seen.join(firsts, ["_sha", "_bytes"], "left").select("_page", "_sha", "_first")


def write_archives(
    pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0,
    archive_bytes: int = 256 << 20, sample_bytes: int = 4 << 20, dictionary_bytes: int = 112_640, level: int = 3, date: str = "1970-01-01T00:00:00Z",
) -> DataFrame:
    """Writes one record per row below ``folder``; returns ``(path, records, bytes)`` of the archives.

    The payload is the html in UTF-8, null as empty. Rows that repeat the id of a response are responses
    too; rows with a null id are responses without an id. Other columns are not read. A lost task
    writes its archives anew under other names; only those listed in the result count.
    """
    whole = F.coalesce(F.col(f"`{html}`"), F.lit("")).cast("binary")
    rows = pages.select(F.col(f"`{page_id}`").cast("long").alias("_page"), F.col(f"`{url}`").cast("string").alias("_url"), whole.alias("_payload"), F.sha1(whole).alias("_sha"))
    typed = rows.join(first_pages(pages, page_id, html, min_bytes), ["_page", "_sha"], "left").select("_page", "_url", "_payload", "_first")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, now = [], None
        files, name = store(folder)
        files.create_dir(name, recursive=True)
        for batch in batches:
            for page, address, payload, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or now.raw >= archive_bytes:
                    if now is not None:
                        now.close()
                    context = TaskContext.get()
                    now = ArchiveWriter(f"{folder}/part-{context.partitionId():05d}-{context.taskAttemptId()}-{len(made):04d}-{uuid.uuid4().hex[:8]}.warc.zst", sample_bytes, dictionary_bytes, level)
                    made.append(now)
                refers = None if first is None or page is None or first == page else first
                now.add(record(page, address, payload, digest(payload), refers, date))
        if now is not None:
            now.close()
        if made:
            yield pa.RecordBatch.from_arrays([pa.array([w.path for w in made]), pa.array([w.records for w in made], pa.int64()), pa.array([w.raw for w in made], pa.int64())], ["path", "records", "bytes"])

    return saved(typed.mapInArrow(write, "path string, records long, bytes long"))


def read_archives(archives: DataFrame, with_payload: bool = True, batch_bytes: int = 8 << 20) -> DataFrame:
    """One row per record of the archives in ``path``; revisits have no payload, only its digest and length.

    The digest of a response is computed anew from the payload that was read and must equal its header.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                for fields, block in read_archive(path):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    response = fields["WARC-Type"] == "response"
                    sha = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if response and digest(payload) != sha:
                        raise ValueError(f"{path}: a payload of page {fields.get('X-Page-Id')} does not have its digest")
                    length = int(http.rpartition(b"Content-Length:")[2])
                    page, first = fields.get("X-Page-Id"), fields.get("X-Refers-To-Page-Id")
                    rows.append((page and int(page), fields.get("WARC-Target-URI"), fields["WARC-Type"], length, sha, first and int(first), payload if response and with_payload else None))
                    size += len(payload) if with_payload else 64
                    if size >= batch_bytes:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), SCHEMA.types, strict=True)], schema=SCHEMA)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), SCHEMA.types, strict=True)], schema=SCHEMA)

    n = max(1, archives.sparkSession.sparkContext.defaultParallelism)
    return archives.select("path").repartition(n).mapInArrow(read, "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary")
