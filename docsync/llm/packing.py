"""Best-fit packing of token pieces by exact-complement hashing.

Only lengths matter for packing, and there are at most as many as a sequence has places. So
availability counts per length are all that is planned over: a table of the sums of one, two
or three lengths finds combinations that fill a gap exactly, and each combination is consumed
as many times as the counts allow, which uses up at least one length. What no
combination completes is filled best-fit. The plan is a bounded list of patterns with
multiplicities; pieces find their place in it by their rank within their length.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsync.llm.common import prefix_sums, record_batch, stored, text_bytes
from docsync.llm.tokens import encoder

CAPACITY = 1024
END_ID = 2
ROWS_PER_SALT = 50_000

PIECE = "doc_id long, piece int, start long, length long, ids binary"


def cut(tokenizer: str, capacity: int, end_id: int):
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            out, size = [], 0
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), text_bytes(batch.column("text"))):
                ids = encode.packed(text.decode("utf-8", "replace")) + end
                n = len(ids) // 4
                at, piece = 0, 0
                while at < n:
                    # The first piece takes what is left over; all others are full.
                    upto = at + ((n - at) % capacity or capacity)
                    out.append((doc_id, piece, at, upto - at, ids[4 * at : 4 * upto]))
                    at, piece = upto, piece + 1
                size += len(ids)
                if size > 8_000_000:
                    yield record_batch(out, PIECE)
                    out, size = [], 0
            yield record_batch(out, PIECE)

    return run


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids) of every row: its ids and `end_id`, cut to `capacity`.

    ids are little-endian unsigned 32-bit numbers. Null text counts as empty: one piece with the
    end id alone. Repeated rows give their pieces again; no rows give none.
    """
    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return thin.mapInArrow(cut(tokenizer, capacity, end_id), PIECE)


class SumIndex:
    """Sums of one, two and three available lengths, each with the combinations that give it.

    A sum of two is listed by its smaller length in ascending order, a sum of three by its largest length in
    descending order and the sum of two that is left. Counts only fall from plan to plan, so
    a combination that has run out is passed for good: each list keeps the place of its
    first combination that may still be there. `held` are pieces that the pattern in the making has taken.
    """

    def __init__(self, counts: dict[int, int], capacity: int):
        self.left = [counts.get(n, 0) for n in range(capacity + 1)]
        self.held: Counter[int] = Counter()
        self.lengths = sorted(n for n, count in counts.items() if count)
        ordered = np.array(self.lengths, dtype=np.int64)
        low, high = np.triu_indices(len(ordered))
        sums, low = ordered[low] + ordered[high], ordered[low]
        order = np.lexsort((low, sums))[: int((sums <= capacity).sum())]
        edges = np.searchsorted(sums[order], np.arange(capacity + 2))
        listed = low[order].tolist()
        self.pairs = [listed[x:y] for x, y in zip(edges[:-1].tolist(), edges[1:].tolist())]
        self.first_pair = [0] * (capacity + 1)
        self.first_triple = [0] * (capacity + 1)
        self.falling = self.lengths[::-1]

    def free(self, length: int) -> int:
        return self.left[length] - self.held[length]

    def take(self, length: int) -> None:
        self.held[length] += 1

    def commit(self) -> int:
        """Use what is held as often as counts allow; how often that is."""
        times = min(self.left[length] // n for length, n in self.held.items())
        for length, n in self.held.items():
            self.left[length] -= n * times
        self.held.clear()
        while self.lengths and not self.left[self.lengths[-1]]:
            self.lengths.pop()
        return times

    def pair(self, total: int, used: int = 0) -> tuple[int, int] | None:
        """Two lengths that sum to `total`, the smallest first one; `used` is one that is taken already."""
        listed, left = self.pairs[total], self.left
        at = self.first_pair[total]
        while at < len(listed) and not self.lasting(listed[at], total - listed[at]):
            at += 1
        self.first_pair[total] = at
        for low in listed[at:]:
            high = total - low
            if left[low] and left[high]:
                need = 1 + (low == high)
                if self.free(low) - (used == low) >= need and self.free(high) - (used == high) >= need:
                    return high, low
        return None

    def lasting(self, low: int, high: int) -> bool:
        return self.left[low] > (low == high) and self.left[high] > 0

    def complement(self, gap: int) -> tuple[int, ...] | None:
        """One, two or three available lengths that sum to `gap`, the largest first."""
        if gap > 3 * self.best_fit(gap):
            return None
        if self.free(gap) > 0:
            return (gap,)
        pair = self.pair(gap)
        if pair:
            return pair
        at, falling = self.first_triple[gap], self.falling
        while at < len(falling) and (falling[at] > gap - 2 or not self.left[falling[at]]):
            at += 1
        self.first_triple[gap] = at
        for a in falling[at:]:
            if self.free(a) > 0:
                rest = self.pair(gap - a, a)
                if rest:
                    return (a, *rest)
        return None

    def best_fit(self, gap: int) -> int:
        """The longest available length up to `gap`, or 0."""
        for i in range(bisect_right(self.lengths, gap) - 1, -1, -1):
            if self.free(self.lengths[i]) > 0:
                return self.lengths[i]
        return 0


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths and how often each is used; together they use every piece once."""
    index = SumIndex(counts, capacity)
    patterns: list[tuple[tuple[int, ...], int]] = []
    while index.lengths:
        chosen: list[int] = []
        gap = capacity
        while gap:
            fill = index.complement(gap) if chosen else None
            if fill is None:
                # Best fit, and then the rest of the gap is looked up again.
                longest = index.best_fit(gap)
                fill = (longest,) if longest else ()
            if not fill:
                break
            for length in fill:
                chosen.append(length)
                index.take(length)
                gap -= length
        patterns.append((tuple(chosen), index.commit()))
    return patterns


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """Per length: rows (first rank, first sequence, offset), by rank."""
    taken: Counter[int] = Counter()
    rows: dict[int, list[tuple[int, int, int]]] = {}
    sequence = 0
    for lengths, times in patterns:
        offset = 0
        for length in lengths:
            rows.setdefault(length, []).append((taken[length], sequence, offset))
            taken[length] += times
            offset += length
        sequence += times
    return {k: np.array(v, dtype=np.int64) for k, v in rows.items()}


def place(table: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("_rank").to_numpy(zero_copy_only=False)
            sequence = np.zeros(len(length), dtype=np.int64)
            offset = np.zeros(len(length), dtype=np.int64)
            for value in np.unique(length).tolist():
                mine = length == value
                rows = table[value]
                slot = np.searchsorted(rows[:, 0], rank[mine], side="right") - 1
                sequence[mine] = rows[slot, 1] + rank[mine] - rows[slot, 0]
                offset[mine] = rows[slot, 2]
            carried = [n for n in batch.schema.names if n != "_rank"]
            columns = [batch.column(n) for n in carried] + [pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, names=[*carried, "sequence_id", "offset"])

    return run


def pack(pieces: DataFrame, order: list[str], capacity: int = CAPACITY, rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """Add sequence_id and offset to pieces with a `length` from 1 to `capacity`.

    `order` names columns that fix the order of pieces of one length; pieces equal in all of
    them are interchangeable. Pieces of one length are ranked in salted groups of about
    `rows_per_salt`, so a length that owns most pieces is spread. A sequence has no gap between its pieces;
    no pieces give no rows. Input columns sequence_id and offset are replaced.
    """
    pieces = stored(pieces.drop("sequence_id", "offset"), "pieces")
    counts = dict(pieces.groupBy("length").count().collect())  # at most `capacity` rows
    salts = max(1, -(-sum(counts.values()) // rows_per_salt))
    table = slots(plan(counts, capacity))
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts))).withColumn("_one", F.lit(1))
    ranked = prefix_sums(salted, ["length"], "_salt", order, "_one", "_rank").drop("_salt", "_one")
    schema = pieces.schema.add("sequence_id", "long").add("offset", "long")
    return ranked.mapInArrow(place(table), schema)


def packed_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Where every piece of every document stands, with a checksum of its ids instead of them."""
    pieces = token_pieces(docs, tokenizer, capacity)
    pieces = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(pieces, ["doc_id", "piece", "length", "ids_crc32"], capacity)
