"""How common hashes are: a sketch of all documents that has a fixed size.

It only tells common hashes from the rest. Its noise grows with the square root of the counts
in a cell, so whatever a notable share of documents has stands out at any size of the data. Results never
depend on it, only where rows travel.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsync.llm.common import record_batch, text_bytes

SKETCH_BITS = 22
SKETCH_BLOCK = 16_384
# Standard deviations above the mean at which a cell's count is no longer chance.
DEVIATIONS = 5
HOT_SALTS = 64
COUNTS = "block long, counts binary"


def packed(counts: np.ndarray) -> bytes:
    """Counts of a block, compressed: most are small, so they take a few bits each."""
    return pa.compress(counts.astype("<i8").tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    size = 8 * SKETCH_BLOCK
    return np.frombuffer(pa.Codec("zstd").decompress(data, decompressed_size=size, asbytes=True), dtype="<i8")


def sketch_task(hasher: Callable, arguments: tuple, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts, waiting, size = hasher(*arguments), np.zeros(max(1 << bits, SKETCH_BLOCK), dtype=np.int64), [], 0
        shift = np.uint64(64 - bits)

        def pour() -> None:
            if waiting:
                cells = (np.concatenate(waiting) >> shift).astype(np.int64)
                counts[:] += np.bincount(cells, minlength=len(counts))
                waiting.clear()

        for batch in batches:
            for text in text_bytes(batch.column("text")):
                found = hashes(text)
                waiting.append(found)
                size += len(found)
                if size > 1_000_000:
                    pour()
                    size = 0
        pour()
        block = SKETCH_BLOCK
        rows = [(i, packed(c)) for i, c in enumerate(counts.reshape(-1, block)) if c.any()]
        yield record_batch(rows, COUNTS)

    return run


def add_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, counts in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist()):
            more = unpacked(counts)
            total[block] = total[block] + more if block in total else more
    yield record_batch([(k, packed(v)) for k, v in total.items()], COUNTS)


def frequency_sketch(docs: DataFrame, hasher: Callable, arguments: tuple, bits: int = SKETCH_BITS) -> np.ndarray:
    """How many documents have a hash in each of 2**bits cells, over all of `docs`.

    `hasher(*arguments)` gives a function from the bytes of a text to its distinct 64-bit hashes.
    """
    parts = docs.select("text").mapInArrow(sketch_task(hasher, arguments, bits), COUNTS)
    rows = parts.repartition("block").mapInArrow(add_blocks, COUNTS).collect()
    cells = 1 << bits
    counts = np.zeros((max(cells // SKETCH_BLOCK, 1), SKETCH_BLOCK), dtype=np.int64)
    for row in rows:
        counts[row.block] = unpacked(row.counts)
    return counts.ravel()[:cells]


def frequency_classes(counts: np.ndarray) -> np.ndarray:
    """0 where a cell holds no more than chance puts there, else the length of its count in bits."""
    mean = counts.mean()
    limit = mean + DEVIATIONS * mean**0.5 + 16
    return np.where(counts > limit, np.log2(np.maximum(counts, 1)).astype(np.int64) + 1, 0).astype(np.uint8)


def shared_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in order of `tok`, those whose token stands twice or more, and all hot ones:
    those whose `place` is odd."""
    last, last_met = None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        if last is not None:
            batch = pa.Table.from_batches([last, batch]).combine_chunks().to_batches()[0]
        token = batch.column("tok").to_numpy(zero_copy_only=False)
        hot = (batch.column("place").to_numpy(zero_copy_only=False) & 1) == 1
        met = np.zeros(len(token) + 1, dtype=bool)
        met[0] = last_met
        met[1:-1] = token[1:] == token[:-1]
        keep = met[:-1] | met[1:] | hot
        keep[-1] = False
        yield batch.filter(pa.array(keep))
        last, last_met = batch.slice(batch.num_rows - 1), bool(met[-2] or hot[-1])
    if last is not None and last_met:
        yield last


def dealt_by_token(rows: DataFrame, owner: str) -> DataFrame:
    """Rows (tok, place, ...) with those of a token together, in order; hot tokens, whose
    `place` is odd, are dealt out over salts by `owner` instead."""
    salted = F.xxhash64("tok", F.pmod(owner, F.lit(HOT_SALTS)))
    key = F.when(F.col("place") % 2 != 0, salted).otherwise(F.col("tok"))
    return rows.repartition(key).sortWithinPartitions("tok")
