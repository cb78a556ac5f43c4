"""Payloads in ordered parts, so that no file has to be one value.

A file is a run of rows with its bytes in order. Decoder and SHA-256 are carried from part to
part, so a file of any size passes through one task in bounded memory and gives the bytes
`build_payload` gives, however it is cut.
"""

from __future__ import annotations

import codecs
import hashlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsync import constants as C
from docsync.functions import predicates as P
from docsync.functions import scalars as S

PART_BYTES = 8 * 1024 * 1024
# Output batches are cut by bytes.
BATCH_BYTES = 32 * 1024 * 1024
FENCE_END = b"\n```\n"
# What `split_words` cuts at.
BLANKS = " \t\r\n\f"
TO_SPACE = str.maketrans(dict.fromkeys(BLANKS, " "))
ADDED = "part_no bigint, payload binary, is_last boolean, payload_bytes bigint, payload_hash string"


class Part(NamedTuple):
    """Bytes of a file; `row` of `batch` has its other columns."""

    batch: pa.RecordBatch
    row: int
    first: bool
    data: bytes


class Done(NamedTuple):
    batch: pa.RecordBatch
    row: int
    values: tuple


def words_of(text: str) -> list[str]:
    return [w for w in text.translate(TO_SPACE).split(" ") if w]


def with_frame(files: DataFrame) -> DataFrame:
    """Add what stands before the content: `_head`, null where a file is delivered byte for byte, and
    `_fence`, null where its text is not fenced."""
    name = F.col("filename")
    text = P.is_text_file(name)
    fenced = text & F.col("convert") & ~P.is_markdown_file(name)
    return files.withColumns(
        {
            "_head": F.when(text, F.col("header")).cast("binary"),
            "_fence": F.when(fenced, F.concat(F.lit("```"), S.ext_to_lang(name), F.lit("\n"))).cast("binary"),
        }
    )


def parts_of_files(batches: Iterable[pa.RecordBatch], to_open, part_bytes: int) -> Iterator[Part]:
    """Read each file part by part; one that cannot be opened gives none, an empty one gives one."""
    for batch in batches:
        for row, path in enumerate(to_open(batch)):
            try:
                handle = open(path, "rb")
            except OSError:
                continue
            with handle:
                first = True
                while (data := handle.read(part_bytes)) or first:
                    yield Part(batch, row, first, data)
                    first = False


def parts_of_rows(batches: Iterable[pa.RecordBatch], keys: list[str], column: str) -> Iterator[Part]:
    """Parts from rows that come in order, all of a file together."""
    at = None
    for batch in batches:
        names = zip(*[batch.column(k).to_pylist() for k in keys])
        for row, (key, data) in enumerate(zip(names, batch.column(column).to_pylist())):
            yield Part(batch, row, key != at, data or b"")
            at = key


def assembled(parts: Iterable[Part]) -> Iterator[Done]:
    """Payload parts; a file's last one also has the length and SHA-256 of them all."""
    held, decoder, digest, size, number = None, None, None, 0, 0

    def out(last: bool) -> Done:
        nonlocal size
        batch, row, payload = held
        if last and decoder is not None:
            payload += decoder.decode(b"", True).encode() + FENCE_END
        digest.update(payload)
        size += len(payload)
        return Done(batch, row, (number, payload, last, size if last else None, digest.hexdigest() if last else None))

    for batch, row, first, data in parts:
        if held is not None:
            yield out(first)
            number += 1
        head = b""
        if first:
            mark, fence = (batch.column(c)[row].as_py() for c in ("_head", "_fence"))
            decoder = None if fence is None else codecs.getincrementaldecoder("utf-8")("replace")
            digest, size, number, head = hashlib.sha256(), 0, 0, (mark or b"") + (fence or b"")
        held = (batch, row, head + (data if decoder is None else decoder.decode(data).encode()))
    if held is not None:
        yield out(True)


def windows(parts: Iterable[Part], size: int, overlap: int) -> Iterator[Done]:
    """Overlapping windows of a payload's words; the words of one window at most are held."""
    step, at, words, rest, number, decoder = size - overlap, None, [], "", 0, None

    def chunk(held: list[str]) -> Done:
        return Done(*at, (number, len(held), " ".join(held)))

    def closed() -> Iterator[Done]:
        nonlocal words, number
        tail = rest + decoder.decode(b"", True)
        words += words_of(tail)
        while len(words) > overlap or (words and not number):
            yield chunk(words[:size])
            number += 1
            words = words[step:]

    for batch, row, first, data in parts:
        if first:
            if at is not None:
                yield from closed()
            words, rest, number, decoder = [], "", 0, codecs.getincrementaldecoder("utf-8")("replace")
        at = (batch, row)
        # The word at the end of a part may go on in the next.
        text = rest + decoder.decode(data)
        whole = len(text.rstrip(BLANKS)) < len(text)
        found = words_of(text)
        rest = "" if whole or not found else found.pop()
        words += found
        while len(words) >= size:
            yield chunk(words[:size])
            number += 1
            words = words[step:]
    if at is not None:
        yield from closed()


def emitted(rows: Iterable[Done], keep: list[str], added: str) -> Iterator[pa.RecordBatch]:
    """Columns `keep` of each row with the added values, in batches cut by bytes."""
    kinds = {"bigint": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "string": pa.string()}
    fields = [f.split() for f in added.split(", ")]
    batch, picked, values, size = None, [], [], 0

    def made() -> pa.RecordBatch:
        taken = batch.take(pa.array(picked, pa.int64()))
        columns = [taken.column(c) for c in keep]
        columns += [pa.array(v, kinds[kind]) for v, (_, kind) in zip(zip(*values), fields)]
        return pa.RecordBatch.from_arrays(columns, names=[*keep, *[n for n, _ in fields]])

    for done in rows:
        if picked and (done.batch is not batch or size >= BATCH_BYTES):
            yield made()
            picked, values, size = [], [], 0
        batch = done.batch
        picked.append(done.row)
        values.append(done.values)
        size += sum(len(v) for v in done.values if isinstance(v, (bytes, str)))
    if picked:
        yield made()


def _schema(df: DataFrame, keep: list[str], added: str) -> T.StructType:
    return T.StructType([df.schema[c] for c in keep] + T.StructType.fromDDL(added).fields)


def in_order(parts: DataFrame) -> DataFrame:
    """All parts of a file in one task, in order."""
    return parts.repartition("kb_id", "path").sortWithinPartitions("kb_id", "path", "part_no")


def build_payload_parts(parts: DataFrame) -> DataFrame:
    """Payload parts of files that come as rows (kb_id, path, part_no, content), next to what
    `build_payload` needs: filename, header, convert. Columns as in ADDED; `content` goes.

    Rows reach Python spark.sql.execution.arrow.maxRecordsPerBatch at a time, which times the size of a part
    should fit in a task's memory. Files on disk are better read by `read_payload_parts`.
    """
    framed = in_order(with_frame(parts)).drop("part_no")
    keep = [c for c in framed.columns if c not in ("content", "_head", "_fence")]

    def run(batches):
        return emitted(assembled(parts_of_rows(batches, ["kb_id", "path"], "content")), keep, ADDED)

    return framed.mapInArrow(run, _schema(framed, keep, ADDED))


def read_payload_parts(files: DataFrame, to_open, part_bytes: int = PART_BYTES) -> DataFrame:
    """Read planned files and give their payload parts. Reading and assembling happen in the same
    task, part by part, so a file of any size takes the memory of a few parts."""
    framed = with_frame(files)
    keep = [c for c in framed.columns if c not in ("_head", "_fence")]

    def run(batches):
        return emitted(assembled(parts_of_files(batches, to_open, part_bytes)), keep, ADDED)

    return framed.mapInArrow(run, _schema(framed, keep, ADDED))


def chunk_payload_parts(parts: DataFrame, size: int = C.CHUNK_TOKENS, overlap: int = C.CHUNK_OVERLAP) -> DataFrame:
    """`chunk_payloads` over payload parts: the same windows, of payloads of any size."""
    header_words = F.size(S.split_words(F.col("header")))
    rows = in_order(parts.select("kb_id", "path", "part_no", "payload", (header_words <= size).alias("header_fits")))
    added = "chunk_no bigint, n_words bigint, chunk_text string"
    keep = ["kb_id", "path", "header_fits"]

    def run(batches):
        return emitted(windows(parts_of_rows(batches, ["kb_id", "path"], "payload"), size, overlap), keep, added)

    return rows.mapInArrow(run, _schema(rows, keep, added)).select(
        "kb_id", "path", "chunk_no", "n_words", "chunk_text", "header_fits"
    )


def split_content(rows: DataFrame, part_bytes: int) -> DataFrame:
    """Rows with whole `content` as rows of at most `part_bytes`; an empty file keeps one."""
    last = F.expr(f"greatest(octet_length(content) - 1, 0) div {part_bytes}")
    parts = rows.withColumn("part_no", F.explode(F.sequence(F.lit(0).cast("bigint"), last.cast("bigint"))))
    start = (F.col("part_no") * part_bytes + 1).cast("int")
    return parts.withColumn("content", F.substring("content", start, F.lit(part_bytes)))
