"""WARC archives: writing, normalising monolithic gzip streams, reading by offset.

An archive written as one gzip stream can only be read from its start. The normaliser inflates
such a stream once, writes every record as a gzip member of its own and a sidecar index of
offsets beside it, so that any record can be fetched alone. Archives are dealt out whole, one
to a task at a time, and streamed in pieces: memory does not depend on their size.

Tasks write under names of their own and hand them on through a stored table, so a repeated
attempt leaves an unused file behind and nothing else.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsync.llm.common import record_batch, scratch_path, stored, text_bytes

MIN_REVISIT_BYTES = 100
ARCHIVE_BYTES = 32 * 1024 * 1024
LEVEL = 6
# Beyond this many archives, a task rewrites several.
MAX_PARTITIONS = 10_000
CHUNK = 1 << 20
END = b"\r\n\r\n"
DATE = "1970-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

ENTRY = "archive string, position long, offset long, length long, record_id string, record_type string"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def opened(uri: str):
    """File system and path of a URI in the shared folder."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri)


def record_id(page_id: int | None, digest: str, url: str) -> str:
    mark = hashlib.sha256(f"{page_id} {digest} {url}".encode()).digest()[:16]
    return f"<urn:uuid:{uuid.UUID(bytes=mark, version=5)}>"


def warc_record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None) -> bytes:
    """A response record, or a revisit of page `first`; header values never hold line breaks."""
    target = "".join(c if c.isprintable() and c != " " else f"%{ord(c):02X}" for c in url or "urn:none")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http.encode() + (payload if first is None else b"")
    fields = [
        ("WARC-Type", "response" if first is None else "revisit"),
        ("WARC-Record-ID", record_id(page_id, digest, target)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if page_id is not None:
        fields.append(("X-Page-Id", str(page_id)))
    if first is not None:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("X-Refers-To-Page-Id", str(first))]
    fields.append(("Content-Length", str(len(block))))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + END


def header_fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record begins here: {lines[0][:60]!r}")
    pairs = (line.partition(":") for line in lines[1:] if line)
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


class Inflated:
    """Bytes of a gzip stream, of one member or several, read piece by piece."""

    def __init__(self, source):
        self.source, self.buffer, self.inflate = source, bytearray(), zlib.decompressobj(31)
        self.begun = False

    def more(self) -> bool:
        """Fetch another piece; False at the end."""
        while True:
            data = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
            data = data or self.source.read(CHUNK)
            if not data:
                if not self.inflate.eof and self.begun:
                    raise ValueError("the gzip stream ends early")
                return False
            if self.inflate.eof:
                self.inflate = zlib.decompressobj(31)
            self.begun = True
            piece = self.inflate.decompress(data, CHUNK)
            if piece:
                self.buffer += piece
                return True

    def until(self, mark: bytes) -> bytes | None:
        """Bytes through `mark`; None if nothing is left."""
        begin = 0
        while True:
            at = self.buffer.find(mark, begin)
            if at >= 0:
                out = bytes(self.buffer[: at + len(mark)])
                del self.buffer[: at + len(mark)]
                return out
            begin = max(0, len(self.buffer) - len(mark) + 1)
            if not self.more():
                if self.buffer.strip():
                    raise ValueError("the archive ends inside a record")
                return None

    def pieces(self, n: int) -> Iterator[bytes]:
        """The next n bytes."""
        while n:
            if not self.buffer and not self.more():
                raise ValueError("the archive ends inside a record")
            out = bytes(self.buffer[:n])
            del self.buffer[: len(out)]
            n -= len(out)
            yield out


def write_task(folder: str, archive_bytes: int, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder_path = opened(folder)
        files.create_dir(folder_path, recursive=True)
        out, size, made = None, 0, []

        def close() -> None:
            out.write(deflate.flush())
            out.close()

        for batch in batches:
            payloads = text_bytes(batch.column("html"))
            names = ("page_id", "url", "digest", "refers_to")
            for payload, page_id, url, digest, first in zip(payloads, *[batch.column(n).to_pylist() for n in names]):
                if out is None or size > archive_bytes:
                    if out is not None:
                        close()
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    made.append((f"{folder}/{name}",))
                    out = files.open_output_stream(f"{folder_path}/{name}", compression=None)
                    deflate, size = zlib.compressobj(level, zlib.DEFLATED, 31), 0
                record = warc_record(page_id, url, payload, digest, first)
                out.write(deflate.compress(record))
                size += len(record)
        if out is not None:
            close()
        yield record_batch(made, "archive string")

    return run


def normalise_task(folder: str, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column("archive").to_pylist():
                yield from rewrite(archive, folder, level)

    return run


def rewrite(archive: str, folder: str, level: int) -> Iterator[pa.RecordBatch]:
    """Rewrite one archive with a member per record, and its index as <archive>.idx beside it."""
    source_files, source_path = opened(archive)
    files, folder_path = opened(folder)
    files.create_dir(folder_path, recursive=True)
    name = f"{uuid.uuid4().hex}.warc.gz"
    rows, offset, position = [], 0, 0
    with (
        source_files.open_input_stream(source_path, compression=None) as source,
        files.open_output_stream(f"{folder_path}/{name}", compression=None) as out,
        files.open_output_stream(f"{folder_path}/{name}.idx", compression=None) as index,
    ):
        stream = Inflated(source)
        while (head := stream.until(END)) is not None:
            head = head.lstrip(b"\r\n")
            fields = header_fields(head)
            member = zlib.compressobj(level, zlib.DEFLATED, 31)
            data = member.compress(head)
            length = len(data)
            out.write(data)
            for part in stream.pieces(int(fields["content-length"])):
                data = member.compress(part)
                length += len(data)
                out.write(data)
            if b"".join(stream.pieces(len(END))) != END:
                raise ValueError(f"{archive}: record {position} does not end where it should")
            data = member.compress(END) + member.flush()
            length += len(data)
            out.write(data)
            row = (f"{folder}/{name}", position, offset, length, fields["warc-record-id"], fields["warc-type"])
            keys = ("position", "offset", "length", "record_id", "record_type")
            index.write((json.dumps(dict(zip(keys, row[1:]))) + "\n").encode())
            rows.append(row)
            offset, position = offset + length, position + 1
            if len(rows) >= 5000:
                yield record_batch(rows, ENTRY)
                rows = []
    yield record_batch(rows, ENTRY)


def parsed(member: bytes) -> tuple:
    """A RECORD row from one gzip member; a response's payload must have the digest it states."""
    data = zlib.decompress(member, 31)
    at = data.index(END) + len(END)
    fields = header_fields(data[:at])
    block = data[at : at + int(fields["content-length"])]
    split = block.index(END) + len(END)
    http = dict(line.split(": ", 1) for line in block[: split - len(END)].decode().split("\r\n")[1:])
    digest = fields["warc-payload-digest"].removeprefix("sha256:")
    page = fields.get("x-page-id")
    page_id = None if page is None else int(page)
    if fields["warc-type"] == "revisit":
        return page_id, int(http["Content-Length"]), digest, "revisit", int(fields["x-refers-to-page-id"]), None
    payload = block[split:]
    if hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"page {page_id}: the payload does not have its digest")
    return page_id, len(payload), digest, "response", None, payload


def read_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    name, file = None, None
    for batch in batches:
        rows, size = [], 0
        columns = [batch.column(c).to_pylist() for c in ("archive", "offset", "length")]
        for archive, offset, length in zip(*columns):
            if archive != name:
                if file is not None:
                    file.close()
                files, path = opened(archive)
                name, file = archive, files.open_input_file(path)
            row = parsed(file.read_at(length, offset))
            rows.append(row)
            size += len(row[5] or b"")
            if size > 16_000_000:
                yield record_batch(rows, RECORD)
                rows, size = [], 0
        yield record_batch(rows, RECORD)
    if file is not None:
        file.close()


def planned_records(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """(page_id, url, html, digest, refers_to): what each page becomes.

    Payloads are compared by SHA-256. Of equal ones of at least `min_bytes` bytes the page with
    the least id is written out and the others refer to it.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256))
    long = rows.filter(F.octet_length("html") >= min_bytes)
    first = long.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("held"))
    first = first.filter("held > 1").select(F.col("digest").alias("_digest"), "first")
    # AQE splits the pages of a digest that very many share.
    out = rows.join(first, rows["digest"] == first["_digest"], "left")
    other = ~F.col("page_id").eqNullSafe(F.col("first"))
    return out.select("page_id", "url", "html", "digest", F.when(other, F.col("first")).alias("refers_to"))


def write_monolithic(records: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, level: int = LEVEL) -> DataFrame:
    """Write archives of one gzip stream each; (archive) names those that count."""
    return stored(records.mapInArrow(write_task(folder, archive_bytes, level), "archive string"), "archives")


def stated(pieces: int) -> int:
    """A partition for each piece of work, within what a shuffle can have."""
    return min(max(pieces, 1), MAX_PARTITIONS)


def normalise(archives: DataFrame, folder: str, level: int = LEVEL) -> DataFrame:
    """Rewrite archives (archive) member by member; the stored index has a row per record.

    The number of partitions is stated: rows that only name an archive are so small that
    adaptive execution would merge very many archives into one task.
    """
    dealt = archives.repartition(stated(archives.count()), "archive")
    return stored(dealt.mapInArrow(normalise_task(folder, level), ENTRY), "warc_index")


def read_records(index: DataFrame, per_task: int = 2000) -> DataFrame:
    """Fetch every record of an index by its offset: page_id, sizes, digest, kind and payload."""
    run = F.floor(F.col("position") / per_task)
    runs = index.select("archive", run.alias("run")).distinct().count()
    dealt = index.repartition(stated(runs), "archive", run).sortWithinPartitions("archive", "offset")
    return dealt.select("archive", "offset", "length").mapInArrow(read_task, RECORD)


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write `pages` (page_id, url, html) as WARC, normalise the archives and read them back.

    One row per page: page_id, payload_bytes, payload_digest, record_type, refers_to. Null html
    is an empty payload; a null url gets a placeholder; a page without id refers to the first
    page of its payload that has one, else is written out. Rows that repeat the first page are each
    written out. No pages give no archives and no rows; other columns play no part.
    """
    folder = folder or scratch_path(pages.sparkSession, "warc")
    archives = write_monolithic(planned_records(pages), f"{folder}/monolithic")
    index = normalise(archives, f"{folder}/records")
    return read_records(index).drop("payload")
