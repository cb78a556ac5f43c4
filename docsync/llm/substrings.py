"""Substring deduplication by content-defined chunks.

A gear rolling hash over the last few bytes decides where a chunk ends, so an insertion moves
the borders near it and no others. What is compared is not single chunks but windows: the
shortest runs of adjacent chunks with enough words, from every chunk on and up to every chunk.
Any longer run that two documents share is the union of its windows, and a run put together from
pieces of different documents has none. Of what shared windows cover, the document with the
least id keeps each part.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsync.llm.common import MULTIPLIER, distinct, mixed, record_batch, stored, text_bytes
from docsync.llm.sketch import SKETCH_BITS, dealt_by_token, frequency_classes, frequency_sketch, shared_only

# The hash of 16 bytes decides; one place in 16 is a border, none within MIN_CHUNK of the last.
# So a passage of 50 words holds several whole chunks however it is cut at its ends.
WINDOW = 16
BORDER_MASK = 0xF000
MIN_CHUNK, MAX_CHUNK = 16, 4096
MIN_WORDS = 18
SEED = 7
SPACES = b" \t\n\x0b\x0c\r"

# `place` is start, size and whether the digest is hot, in one number; `at` the words and chunks
# before a window, `span` those in it.
CHUNK = "tok long, rk long, place long, at long, span long"
PASSAGE = "rk long, doc_id long, start long, size long, n_words long, n_chunks long, first_id long, removed boolean"
SIZE_BITS = COUNT_BITS = 31


def gear_table() -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, 1 << 16, 256, dtype=np.uint16)


def gear_hashes(data: np.ndarray, gear: np.ndarray) -> np.ndarray:
    """At each byte h = 2 h + gear[byte] in 16 bits, which only the last 16 bytes decide.

    The sum over a window is built by doubling its width.
    """
    total = gear[data]
    width = 1
    while width < WINDOW:
        wider = total.copy()
        wider[width:] += total[:-width] << np.uint16(width)
        total, width = wider, 2 * width
    return total


def borders(text: bytes, gear: np.ndarray) -> np.ndarray:
    """Ends of the chunks of a text; the last is its length."""
    data = np.frombuffer(text, dtype=np.uint8)
    places = np.flatnonzero((gear_hashes(data, gear) & np.uint16(BORDER_MASK)) == 0) + 1
    ends, last = [], 0
    for place in [*places.tolist(), len(text)]:
        while place - last > MAX_CHUNK:
            last += MAX_CHUNK
            ends.append(last)
        if place - last >= MIN_CHUNK or place == len(text) > last:
            ends.append(place)
            last = place
    return np.array(ends, dtype=np.int64)


def digests(text: bytes, ends: np.ndarray) -> np.ndarray:
    import xxhash

    view, out, last = memoryview(text), np.empty(len(ends), dtype=np.uint64), 0
    for i, end in enumerate(ends.tolist()):
        out[i] = xxhash.xxh3_64_intdigest(view[last:end])
        last = end
    return out


def word_starts(text: bytes) -> np.ndarray:
    """1 at each byte that begins a word."""
    data = np.frombuffer(text, dtype=np.uint8)
    blank = np.isin(data, np.frombuffer(SPACES, dtype=np.uint8))
    begins = ~blank
    begins[1:] &= blank[:-1]
    return begins


def text_windows(text: bytes, gear: np.ndarray, min_words: int) -> tuple[np.ndarray, ...]:
    """Windows of a text: hash, first chunk, chunk after the last; ends of chunks, words before each.

    A word that begins before a window counts for it, so that the count is the same wherever the
    window stands.
    """
    ends = borders(text, gear)
    begins = word_starts(text)
    starts = np.concatenate([[0], ends[:-1]])
    words = np.concatenate([[0], np.cumsum(np.add.reduceat(begins.astype(np.int64), starts))])
    none = np.zeros(0, dtype=np.int64)
    if words[-1] + 1 < min_words:
        return none.view(np.uint64), none, none, ends, words
    data = np.frombuffer(text, dtype=np.uint8)
    n, blank = len(ends), np.isin(data[starts], np.frombuffer(SPACES, dtype=np.uint8))
    # Words before a chunk, less one that goes on in it: windows have fewer words the later they begin.
    before = words[:-1] - (~blank & ~begins[starts])
    ahead = np.searchsorted(words[1:], before + min_words)
    back = np.searchsorted(before, words[1:] - min_words, side="right") - 1
    first = np.concatenate([np.arange(n), back])
    last = np.concatenate([ahead, np.arange(n)])
    # Those from a chunk on that are also the shortest up to their last chunk are counted once.
    keep = np.concatenate([ahead < n, back >= 0])
    keep[n:] &= ahead[back] != np.arange(n)
    first, after = first[keep], last[keep] + 1
    power = np.full(n + 1, MULTIPLIER)
    power[0] = 1
    power = np.multiply.accumulate(power)
    inverse = np.full(n + 1, np.uint64(pow(int(MULTIPLIER), -1, 1 << 64)))
    inverse[0] = 1
    inverse = np.multiply.accumulate(inverse)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(mixed(digests(text, ends)) * power[:n], out=sums[1:])
    marks = mixed((sums[after] - sums[first]) * inverse[first] + (after - first).astype(np.uint64))
    return marks, first, after, ends, words


def window_hashes(min_words: int):
    """A function from a text to the distinct hashes of its windows."""
    gear = gear_table()
    return lambda text: distinct(text_windows(text, gear, min_words)[0]) if text else np.zeros(0, np.uint64)


def chunk_task(bits: int, classes, min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gear, of_cell, shift = gear_table(), classes.value, np.uint64(64 - bits)
        names = [part.split()[0] for part in CHUNK.split(", ")]
        for batch in batches:
            parts: list[list[np.ndarray]] = []
            held = 0
            for rk, text in zip(batch.column("rk").to_pylist(), text_bytes(batch.column("text"))):
                if not text:
                    continue
                marks, first, after, ends, words = text_windows(text, gear, min_words)
                if not len(marks):
                    continue
                starts = np.concatenate([[0], ends])
                hot = of_cell[(marks >> shift).astype(np.int64)] > 0
                place = (starts[first] << SIZE_BITS | starts[after] - starts[first]) << 1 | hot
                at = words[first] << COUNT_BITS | first
                span = words[after] - words[first] << COUNT_BITS | after - first
                parts.append([marks.view(np.int64), np.full(len(marks), rk), place, at, span])
                held += len(marks)
                if held > 100_000:
                    yield chunk_batch(parts, names)
                    parts, held = [], 0
            yield chunk_batch(parts, names)

    return run


def chunk_batch(parts: list[list[np.ndarray]], names: list[str]) -> pa.RecordBatch:
    columns = [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, dtype=np.int64)] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64), pa.int64()) for c in columns], names=names)


def repeated_windows(rows: DataFrame, min_words: int, bits: int) -> DataFrame:
    """Stored windows (tok, rk, place, at, span) whose hash stands in two places or more.

    Hot hashes all pass; whether they stand in two rows is counted later.
    """
    spark = rows.sparkSession
    classes = spark.sparkContext.broadcast(frequency_classes(frequency_sketch(rows, window_hashes, (min_words,), bits)))
    chunks = rows.select("rk", "text").mapInArrow(chunk_task(bits, classes, min_words), CHUNK)
    return stored(dealt_by_token(chunks, "rk").mapInArrow(shared_only, CHUNK), "chunks")


def joined_windows(windows: list[tuple]) -> Iterator[tuple]:
    """(start, size, n_words, n_chunks, owner), the parts of a row that shared windows cover.

    `windows` are (start, end, words at both, chunks at both, owner) in order of start. The
    owner of a place is the least of the windows over it.
    """
    borders = sorted({(w[0], w[2], w[4]) for w in windows} | {(w[1], w[3], w[5]) for w in windows})
    over: list[tuple] = []
    run: list[list] = []
    at = 0
    for here, there in zip(borders, [*borders[1:], None]):
        while at < len(windows) and windows[at][0] <= here[0]:
            heapq.heappush(over, (windows[at][6], windows[at][1]))
            at += 1
        while over and over[0][1] <= here[0]:
            heapq.heappop(over)
        if over:
            owner = over[0][0]
            if run and run[-1][2] == owner:
                run[-1][1] = there
            else:
                run.append([here, there, owner])
        elif run:
            for (start, words, chunks), (end, words_to, chunks_to), owner in run:
                yield start, end - start, words_to - words, chunks_to - chunks, owner
            run = []


def passage_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    low = (1 << COUNT_BITS) - 1

    def passages(rk: int, doc_id: int | None, windows: list[tuple]) -> Iterator[tuple]:
        for *part, owner in joined_windows(windows):
            no_id, first_id, first_rk = owner
            yield rk, doc_id, *part, None if no_id else first_id, rk != first_rk

    key, windows = None, []
    for batch in batches:
        out = []
        for rk, doc_id, place, at, span, first_id, first_rk in zip(*[c.to_pylist() for c in batch.columns]):
            if key != (rk, doc_id):
                if windows:
                    out += passages(*key, windows)
                key, windows = (rk, doc_id), []
            start, words, chunks = place >> SIZE_BITS + 1, at >> COUNT_BITS, at & low
            end = start + (place >> 1 & low)
            owner = (first_id is None, first_id or 0, first_rk)
            windows.append((start, end, words, words + (span >> COUNT_BITS), chunks, chunks + (span & low), owner))
        yield record_batch(out, PASSAGE)
    if windows:
        yield record_batch(list(passages(*key, windows)), PASSAGE)


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, bits: int = SKETCH_BITS) -> DataFrame:
    """(rk, doc_id, start, size, n_words, n_chunks, first_id, removed), one row per repeated passage.

    A passage is a stretch of chunks, each within a run of adjacent chunks of at least `min_words`
    words, counting one that goes on into the first, that another row of `docs` has just so. Where the row that keeps them changes the stretch
    is split, and its parts may be shorter. start and size are in bytes of the UTF-8 text. first_id
    is the least doc_id among the rows that have such a run around the chunks, and `removed` is
    false where that is this row; of rows of one doc_id, or without any, the one with the least rk keeps.
    Rows that repeat both id and text are one row here, as they are copies that exact deduplication takes out. Digests are of 64 bits, and only whole windows count. Null and
    empty texts have no chunks; rows without doc_id keep nothing that a row with one has;
    repeated rows repeat each other's whole text; no rows give none.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.withColumn("rk", F.xxhash64("doc_id", "text")).filter("text IS NOT NULL")
    windows = repeated_windows(rows, min_words, bits)
    ids = rows.groupBy(F.col("rk").alias("_rk")).agg(F.first("doc_id").alias("doc_id"))
    # Rows that agree in id and text share rk: their windows stand twice at the same place.
    placed = windows.groupBy("tok", "rk", "place").agg(
        F.count("*").alias("n"), F.first("at").alias("at"), F.first("span").alias("span")
    )
    placed = stored(placed.join(ids, placed["rk"] == ids["_rk"]).drop("_rk"), "placed")
    first = placed.groupBy("tok").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rk")).alias("own"),
        F.min("rk").alias("lo"), F.max("rk").alias("hi"), F.max("n").alias("most"),
    )
    # A window within one row alone is no repeat.
    shared = first.filter("lo <> hi OR most > 1").select(
        F.col("tok").alias("_tok"), F.col("own.doc_id").alias("first_id"), F.col("own.rk").alias("first_rk")
    )
    met = placed.join(shared, placed["tok"] == shared["_tok"]).select("rk", "doc_id", "place", "at", "span", "first_id", "first_rk")
    return met.repartition("rk").sortWithinPartitions("rk", "place").mapInArrow(passage_rows, PASSAGE)


def cut_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, spans in zip(text_bytes(batch.column("text")), batch.column("_spans").to_pylist()):
            kept, last = [], 0
            for span in sorted(spans or [], key=lambda s: s["start"]):
                kept.append(text[last : span["start"]])
                last = span["start"] + span["size"]
            out.append(b"".join([*kept, text[last:]]).decode("utf-8", "ignore"))
        missing = batch.column("text").is_null().to_pylist()
        texts = pa.array([None if m else t for m, t in zip(missing, out)], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("_row"), texts], names=["_row", "_text"])


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """`docs` with every repeated passage cut out of all rows but the one that keeps it."""
    spans = repeated_passages(docs, min_words).filter("removed")
    spans = spans.groupBy(F.col("rk").alias("_rk")).agg(F.collect_set(F.struct("start", "size")).alias("_spans"))
    # The row travels as one column, so that no name of its own can clash.
    key = F.xxhash64(F.col("doc_id").cast("long"), F.col("text")).alias("_key")
    keyed = docs.select(F.struct("*").alias("_row"), "text", key)
    joined = keyed.join(stored(spans, "spans"), F.col("_key") == F.col("_rk"), "left").select("_row", "text", "_spans")
    cut = joined.mapInArrow(cut_spans, keyed.select("_row").schema.add("_text", "string"))
    return cut.select(*[F.col("_text").alias(c) if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns])
