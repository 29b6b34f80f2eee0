"""Dictionary-compressed WARC archives: writing and reading back.

Every task writes its own archives. A Zstandard dictionary is built from the
first records of an archive and embedded in a leading skippable frame; each
record is then compressed on its own with it, so that a record can be read
without the ones before it. Equal payloads are stored once: later ones are
revisit records that refer to the first.
"""

from __future__ import annotations

import io
import struct
import uuid
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_uri, fresh_path, written

#: Fixed values of the WARC-zstd format: the dictionary's skippable frame begins with this magic number and its length.
DICTIONARY_FRAME = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Records held back, in bytes, to build an archive's dictionary from; the dictionary's size; an archive's size.
SAMPLE_BYTES, DICTIONARY_BYTES, ARCHIVE_BYTES = 2 << 20, 64 << 10, 32 << 20
LEVEL = 3


def _record(kind: str, name: str, url: str | None, payload: bytes, length: int, digest: str, refers_to: str | None, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    uri = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url) if url else name
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {date}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha256:{digest}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {PROFILE}"]
    body = http + (payload if kind == "response" else b"")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


class _Archive:
    """One archive file: records wait until there are enough for a dictionary."""

    def __init__(self, fs: pyarrow.fs.FileSystem, folder: str):
        self.fs, self.name = fs, f"{uuid.uuid4().hex}.warc.zst"
        self.path = f"{folder}/{self.name}"
        self.waiting: list[bytes] = []
        self.held = self.size = self.records = self.dictionary = 0
        self.file = None

    def add(self, record: bytes) -> None:
        self.records += 1
        if self.file is None:
            self.waiting.append(record)
            self.held += len(record)
            if self.held >= SAMPLE_BYTES:
                self._begin()
        else:
            self._put(self.compress(record))

    def _put(self, frame: bytes) -> None:
        self.file.write(frame)
        self.size += len(frame)

    def _begin(self) -> None:
        import zstandard

        try:
            trained = zstandard.train_dictionary(DICTIONARY_BYTES, [r[:65536] for r in self.waiting], k=200, d=8)
        except zstandard.ZstdError:  # too few or too small records to learn from: the format allows none
            trained = None
        self.compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=trained, write_checksum=True).compress
        self.file = self.fs.open_output_stream(self.path, compression=None)
        if trained:
            data = trained.as_bytes()
            self.dictionary = len(data)
            self._put(struct.pack("<II", DICTIONARY_FRAME, len(data)) + data)
        for record in self.waiting:
            self._put(self.compress(record))
        self.waiting = []

    def close(self) -> tuple[str, int, int, int]:
        if self.file is None:
            self._begin()
        self.file.close()
        return self.name, self.records, self.size, self.dictionary


def typed_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 100) -> DataFrame:
    """Which pages become response records and which revisit an equal payload.

    Returns id (string), url, payload (binary), payload_bytes, payload_digest
    (lower-case hex SHA-256), record_type and refers_to (string). Of rows with
    equal payloads of at least `min_bytes` bytes, those with the smallest id are
    responses (rows that repeat that id too), the others revisit it; smaller
    payloads are all responses. A null payload is empty. A row with a null id
    revisits where an equal payload has an id, else it is a response.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)})
    large = rows.where(F.col("payload_bytes") >= min_bytes)
    first = large.groupBy("payload_digest").agg(F.min("id").alias("first"), F.count("*").alias("c")).where("c > 1").select(F.col("payload_digest").alias("key"), "first")
    # Small payloads get keys of their own, so that a very common one fills no partition.
    own = F.concat(F.lit("#"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    joined = rows.withColumn("key", F.when(F.col("payload_bytes") >= min_bytes, F.col("payload_digest")).otherwise(own)).join(first, "key", "left")
    again = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("id"))
    return joined.select(
        F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id"), "url", "payload", "payload_bytes", "payload_digest",
        F.when(again, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"), F.when(again, F.col("first").cast("string")).alias("refers_to"),
    )


def write_archives(records: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes the rows of `typed_records` as archives into `folder` (any URI that
    pyarrow's file systems open, on storage that all executors share).

    Returns the manifest: archive (file name), records, bytes and
    dictionary_bytes. Archives of attempts that failed are in no manifest, so
    readers go by it and never list the folder. No rows give no archive.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pyarrow.fs.FileSystem.from_uri(arrow_uri(folder))
        fs.create_dir(base, recursive=True)
        closed, archive = [], None
        for batch in batches:
            columns = [batch.column(k) for k in range(7)]
            for i in range(batch.num_rows):
                page, url, payload, length, digest, kind, refers = (c[i].as_py() for c in columns)
                archive = archive or _Archive(fs, base)
                archive.add(_record(kind, f"urn:page:{page}", url, payload, length, digest, None if refers is None else f"urn:page:{refers}", date))
                if archive.size >= ARCHIVE_BYTES:
                    closed.append(archive.close())
                    archive = None
        if archive:
            closed.append(archive.close())
        if closed:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*closed)], ["archive", "records", "bytes", "dictionary_bytes"])

    columns = ["id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return written(records.select(*columns).mapInArrow(run, "archive string, records long, bytes long, dictionary_bytes long"), "manifest")


def parse_archive(raw: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], dict[str, str], bytes]]:
    """WARC headers, HTTP headers (both with lower-case names) and payload of each record, one at a time."""
    import zstandard

    first = raw.read(8)
    magic, size = struct.unpack("<II", first) if len(first) == 8 else (0, 0)
    dictionary = zstandard.ZstdCompressionDict(raw.read(size)) if magic == DICTIONARY_FRAME else None
    if dictionary is None:
        raw.seek(0)
    stream = io.BufferedReader(zstandard.ZstdDecompressor(dict_data=dictionary).stream_reader(raw, read_across_frames=True), 1 << 18)

    def fields(line: bytes, f: io.BufferedIOBase) -> dict[str, str]:
        found = {}
        while line := f.readline().rstrip(b"\r\n"):
            name, _, value = line.decode().partition(":")
            found[name.lower()] = value.strip()
        return found

    while begin := stream.readline():
        if not begin.startswith(b"WARC/"):
            raise ValueError("no WARC record where one should begin")
        head = fields(begin, stream)
        block = io.BytesIO(stream.read(int(head["content-length"])))
        http = fields(block.readline(), block)
        payload = block.read()
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError("a WARC record is cut off")
        yield head, http, payload


def read_archives(manifest: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """Reads the archives of a manifest back, record by record.

    Returns archive, id, record_type, target_uri, payload_bytes,
    payload_digest, refers_to and, if asked for, payload (null for revisits).
    A response's length and digest are those of the payload read, and a
    difference to its header is an error; a revisit's are those that its
    headers give for the payload it refers to.
    """

    def name(uri: str) -> str:
        return uri.strip("<>").removeprefix("urn:page:")

    names = ["archive", "id", "record_type", "target_uri", "payload_bytes", "payload_digest", "refers_to"] + ["payload"] * payloads

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pyarrow.fs.FileSystem.from_uri(arrow_uri(folder))

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            types = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()] + [pa.binary()] * payloads
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names)

        for batch in batches:
            for archive in batch.column(0).to_pylist():
                rows, size = [], 0
                with fs.open_input_file(f"{base}/{archive}") as raw:
                    for head, http, payload in parse_archive(raw):
                        kind, digest = head["warc-type"], head["warc-payload-digest"].removeprefix("sha256:")
                        length = int(http["content-length"])
                        if kind == "response" and (sha256(payload).hexdigest() != digest or len(payload) != length):
                            raise ValueError(f"{archive}: payload of {head['warc-record-id']} differs from its digest")
                        refers = head.get("warc-refers-to")
                        row = (archive, name(head["warc-record-id"]), kind, head["warc-target-uri"], length, digest, refers and name(refers))
                        rows.append((*row, payload if kind == "response" else None) if payloads else row)
                        size += 300 + len(payload) * payloads
                        if size >= 8 << 20:
                            yield batch_of(rows)
                            rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    schema = "archive string, id string, record_type string, target_uri string, payload_bytes long, payload_digest string, refers_to string" + ", payload binary" * payloads
    spread = manifest.select("archive").repartition(max(1, manifest.count()), "archive")
    return spread.mapInArrow(run, schema)


def archive_pages(pages: DataFrame, folder: str | None = None, **columns) -> tuple[DataFrame, str]:
    """Types and writes all pages; returns the manifest and the folder of the archives. An archive's
    dictionary is trained on the first 64 KB of each of its first records (2 MB of them), which only
    bears on how small it gets: all records are written whole."""
    folder = folder or fresh_path(pages.sparkSession, "warc")
    return write_archives(typed_records(pages, **columns), folder), folder
