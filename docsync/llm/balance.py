"""Cost-balanced packing: every sequence gets about the same share of the attention work.

The work of a piece of n tokens is estimated as n + n * n / (6 * width): the layers' matrices
cost the same for every token, attention grows with the square. Documents are dealt by hash into
blocks of bounded size, and each block is packed on its own: longest first, a document goes to the
sequence of least cost that still has room for all of it. The sequences of a block are laid out
before: as many full ones as its tokens fill, and for the rest one for each power of two
in it. So all of them end up full, and none needs padding; what fits nowhere whole is cut.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsync.llm.common import record_batch, text_bytes
from docsync.llm.tokens import encoder

CAPACITY = 2048
END_ID = 1
# Hidden width of the model whose costs are balanced.
WIDTH = 1024
# Bytes of text to a block, about four million tokens.
BLOCK_BYTES = 16 * 1024 * 1024

PIECE = "doc_id long, start long, length long, doc_tokens long, ids_crc32 long, ids binary, nth long"
PLACED = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long, cost double"
)


def cost_of(length, width: int = WIDTH):
    return length + length * length / (6.0 * width)


def cut(tokenizer: str, capacity: int, end_id: int):
    """Full pieces, which leave no room beside them, and what is left with its ids."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        # Rows alike in all that is dealt by are told apart, so that they go to several blocks.
        seen: Counter[tuple] = Counter()
        for batch in batches:
            out, size = [], 0
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), text_bytes(batch.column("text"))):
                ids = encode.packed(text.decode("utf-8", "replace")) + end
                n = len(ids) // 4
                nth = seen[doc_id, n, alike := zlib.crc32(ids)]
                seen[doc_id, n, alike] += 1
                for at in range(0, n, capacity):
                    piece = ids[4 * at : 4 * (at + capacity)]
                    full = len(piece) == 4 * capacity
                    out.append((doc_id, at, len(piece) // 4, n, zlib.crc32(piece), None if full else piece, nth))
                    size += 64 if full else len(piece)
                if size > 4_000_000:
                    yield record_batch(out, PIECE)
                    out, size = [], 0
            yield record_batch(out, PIECE)

    return run


def capacities(tokens: int, capacity: int) -> np.ndarray:
    """Room of the sequences that `tokens` fill exactly: full ones, then powers of two."""
    full, rest = divmod(tokens, capacity)
    powers = [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
    return np.array([capacity] * full + powers, dtype=np.int64)


def assign(lengths: list[int], capacity: int, width: int) -> list[list[tuple[int, int, int]]]:
    """Per sequence, the (document, start, length) of its pieces, in order.

    `lengths` are below `capacity`. Longest first, each goes to the sequence of least cost among
    those with room for it; if there is none, the one with most room takes what it can, and the rest
    waits its turn again.
    """
    room = capacities(sum(lengths), capacity)
    cost = np.zeros(len(room))
    held: list[list[tuple[int, int, int]]] = [[] for _ in room]
    queue = [(-n, i, 0) for i, n in enumerate(lengths)]
    heapq.heapify(queue)
    while queue:
        n, i, start = heapq.heappop(queue)
        n = -n
        at = int(np.where(room >= n, cost, np.inf).argmin())
        if room[at] < n:
            at = int(room.argmax())
            heapq.heappush(queue, (int(room[at]) - n, i, start + int(room[at])))
            n = int(room[at])
        held[at].append((i, start, n))
        room[at] -= n
        cost[at] += cost_of(n, width)
    return held


def pack_block(block: int, rows: list[tuple], capacity: int, width: int) -> list[tuple]:
    """Placed pieces of one block; rows are (doc_id, start, length, doc_tokens, ids_crc32, ids)."""
    # In an order of their own, so that a task that runs again packs them the same way.
    rows = sorted(rows, key=lambda r: (-r[2], r[0] is None, r[0] or 0, r[1], r[4]))
    parts = [r for r in rows if r[5] is not None]
    held = assign([r[2] for r in parts], capacity, width)
    out = []
    for sequence, pieces in enumerate(held):
        offset = 0
        for i, start, n in pieces:
            doc_id, begin, length, total, crc, ids = parts[i]
            if n < length:
                crc = zlib.crc32(ids[4 * start : 4 * (start + n)])
            number = block << 32 | sequence
            out.append((doc_id, begin + start, n, crc, total, number, offset, cost_of(n, width)))
            offset += n
    full = [r for r in rows if r[5] is None]
    for sequence, (doc_id, start, length, total, crc, _) in enumerate(full, len(held)):
        out.append((doc_id, start, length, crc, total, block << 32 | sequence, 0, cost_of(length, width)))
    return out


def pack_blocks(capacity: int, width: int):
    names = ("_block", "doc_id", "start", "length", "doc_tokens", "ids_crc32", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows = None, []
        for batch in batches:
            for block, *row in zip(*[batch.column(n).to_pylist() for n in names]):
                if block != at:
                    if rows:
                        yield record_batch(pack_block(at, rows, capacity, width), PLACED)
                    at, rows = block, []
                rows.append(tuple(row))
        if rows:
            yield record_batch(pack_block(at, rows, capacity, width), PLACED)

    return run


def balanced_packing(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    width: int = WIDTH,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Where every piece of every document stands, and its estimated cost.

    `capacity` is a power of two. Null text counts as empty: one piece with the end id alone.
    Documents beyond `capacity` are cut into full pieces and a rest, others only where no
    sequence has room for them; each id lies in one piece. Every sequence is as long as a power of
    two, so none is padded. Repeated rows and rows without doc_id are packed each; no rows give none;
    other columns of `docs` play no part.
    """
    text = F.coalesce(F.octet_length("text"), F.lit(0))
    total = docs.agg(F.sum(text)).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = thin.mapInArrow(cut(tokenizer, capacity, end_id), PIECE)
    block = F.pmod(F.xxhash64("doc_id", "start", "doc_tokens", "ids_crc32", "nth"), F.lit(blocks))
    dealt = pieces.withColumn("_block", block).drop("nth").repartition(blocks, "_block")
    dealt = dealt.sortWithinPartitions("_block")
    return dealt.mapInArrow(pack_blocks(capacity, width), PLACED)
