"""Exact deduplication over an extendible-hash index kept in shared files.

Keys are 64-bit hashes of the normalised text. The directory starts with one cell and doubles
until every bucket holds at most `capacity` keys; a bucket keeps the first depth at which it
fits, or the deepest level. Each bucket has one owner task, which walks a range of keys in
order, chains the texts of one key and compares their bytes. Copies are folded inside each
task before they travel, so a text that owns a third of all rows reaches its owner
as one entry per task, and the owner holds one copy of it at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docsync.llm.common import BLANKS, record_batch, stored

CAPACITY = 20_000
# 2**16 cells: the directory stays below 2 MB, so it can be broadcast at any size of the data.
MAX_DEPTH = 16
# Bytes of distinct texts a task remembers while it folds copies.
FOLD_BYTES = 48 * 1024 * 1024

ENTRY = "key long, norm binary, sha string, rows long, points long, doc_id long, ties long"
INDEX = "start long, key long, chain int, sha string, rows long, keep_id long, ties long"


def with_digests(docs: DataFrame, *columns) -> DataFrame:
    """doc_id and `columns` of `docs`, then _norm (the normalised text), its _sha and _key (the first 64
    bits of its SHA-256), and _points (code points of the original).

    All are built-in functions, so rows stay in the JVM, and a column that is not used costs nothing.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    norm = F.translate(text, BLANKS, "")
    sha = F.sha2(norm, 256)
    key = F.conv(F.substring(sha, 1, 16), 16, -10).cast("long")
    return docs.select("doc_id", *columns, key.alias("_key"), sha.alias("_sha"),
                       F.char_length(text).cast("long").alias("_points"), norm.cast("binary").alias("_norm"))


def better(a: list, b: list) -> list:
    """Of two [points, doc_id, ties]: more code points, then the smaller id; a null id is last."""
    left, right = ((-x[0], x[1] is None, x[1] or 0) for x in (a, b))
    if left == right:
        return [a[0], a[1], a[2] + b[2]]
    return a if left < right else b


def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One entry per distinct text of a task, unless its texts outgrow FOLD_BYTES."""
    kept: dict[bytes, list] = {}
    size = 0

    def entries() -> pa.RecordBatch:
        return record_batch([(key, n, sha, rows, *best) for n, (key, sha, rows, best) in kept.items()], ENTRY)

    for batch in batches:
        names = ("_norm", "_key", "_sha", "_points", "doc_id")
        for norm, key, sha, points, doc_id in zip(*[batch.column(n).to_pylist() for n in names]):
            row = [points, doc_id, 1]
            seen = kept.get(norm)
            if seen is None:
                kept[norm] = [key, sha, 1, row]
                size += len(norm) + 400
            else:
                seen[2] += 1
                seen[3] = better(seen[3], row)
            if size > FOLD_BYTES:
                yield entries()
                kept.clear()
                size = 0
    yield entries()


def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Walk entries in key order; texts of one key form a chain and are told apart by bytes."""
    at, chain, out = None, {}, []

    def closed() -> list[tuple]:
        return [
            (*at, i, v[0], v[1], v[2][1], v[2][2]) for i, v in enumerate(chain.values())
        ]

    for batch in batches:
        names = ("start", "key", "norm", "sha", "rows", "points", "doc_id", "ties")
        for start, key, norm, sha, rows, *best in zip(*[batch.column(n).to_pylist() for n in names]):
            if (start, key) != at:
                out += closed()
                at, chain = (start, key), {}
            seen = chain.get(norm)
            if seen is None:
                chain[norm] = [sha, rows, best]
            else:
                seen[1] += rows
                seen[2] = better(seen[2], best)
        if len(out) > 10_000:
            yield record_batch(out, INDEX)
            out = []
    yield record_batch(out + closed(), INDEX)


def cell_of(key: str, max_depth: int):
    return F.expr(f"shiftright({key}, {64 - max_depth}) + {1 << (max_depth - 1)}L")


def directory(cells: DataFrame, capacity: int, max_depth: int) -> DataFrame:
    """(cell, start) from (cell, n): where the bucket of each finest cell begins.

    Every doubling looks at one more bit of the cell; a bucket stops at the first depth at
    which it holds no more than `capacity` keys.
    """
    levels = cells.withColumn("depth", F.explode(F.sequence(F.lit(0), F.lit(max_depth))))
    levels = levels.withColumn(
        "start", F.expr(f"shiftleft(shiftright(cell, {max_depth} - depth), {max_depth} - depth)")
    )
    sizes = levels.groupBy("depth", "start").agg(F.sum("n").alias("held"))
    fits = sizes.filter((F.col("held") <= capacity) | (F.col("depth") == max_depth))
    joined = levels.join(fits, ["depth", "start"])
    return joined.groupBy("cell").agg(F.min_by("start", "depth").alias("start"))


def build_index(
    docs: DataFrame, keys: DataFrame, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH
) -> DataFrame:
    """Write the index of `docs` (doc_id, text) to the shared folder: one row per distinct text.

    `keys` has the key of every row in a column of that name.
    """
    cells = keys.select("key", cell_of("key", max_depth).alias("cell")).distinct()
    places = directory(cells.groupBy("cell").agg(F.count("*").alias("n")), capacity, max_depth)
    places = stored(places, "directory")
    rows = with_digests(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    entries = rows.mapInArrow(fold, ENTRY)
    placed = entries.withColumn("cell", cell_of("key", max_depth)).join(F.broadcast(places), "cell")
    owned = placed.drop("cell").repartition("start").sortWithinPartitions("start", "key")
    names = ["start", "key", "norm", "sha", "rows", "points", "doc_id", "ties"]
    return stored(owned.select(*names).mapInArrow(own, INDEX), "index")


def judged(rows: DataFrame, index: DataFrame) -> DataFrame:
    """Add _keep_id, _group_size and _kept to rows that have doc_id, _key, _sha and _points."""
    found = index.select(
        F.col("key").alias("_k"), F.col("sha").alias("_s"),
        F.col("keep_id").alias("_keep_id"), F.col("rows").alias("_group_size"),
    )
    # AQE splits the left side where one key owns many rows.
    out = rows.join(found, (rows["_key"] == found["_k"]) & (rows["_sha"] == found["_s"]), "left")
    out = out.withColumn("_kept", F.col("doc_id").cast("long").eqNullSafe(F.col("_keep_id")))
    most = index.agg(F.max("ties")).first()[0]
    if most is not None and most > 1:
        # A doc_id repeats with its text, or ids are null: of the rows that tie, one stays.
        same = Window.partitionBy("_key", "_sha", "doc_id").orderBy(F.col("_points").desc())
        out = out.withColumn("_kept", F.col("_kept") & (F.row_number().over(same) == 1))
    return out.drop("_k", "_s")


def exact_groups(docs: DataFrame, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they agree after the six ASCII blanks are deleted. A null text counts
    as empty, and all empty texts form one group. Of a group the row with the most code points
    stays, then the one with the smallest doc_id; a row without doc_id stays only if no longest
    row has one. Rows that repeat a doc_id and its text each count in group_size and
    one of them stays. No rows give no rows; other columns of `docs` play no part.
    """
    digests = stored(with_digests(docs).drop("_norm"), "digests")
    index = build_index(docs, digests.select(F.col("_key").alias("key")), capacity, max_depth)
    return judged(digests, index).select(
        "doc_id",
        F.col("_keep_id").alias("keep_id"),
        F.col("_group_size").alias("group_size"),
        F.col("_kept").alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> DataFrame:
    """The rows of `docs` that stay, with their own columns."""
    keys = with_digests(docs).select(F.col("_key").alias("key"))
    index = build_index(docs, keys, capacity, max_depth)
    # The row travels as one column, so that no name of its own can clash.
    rows = with_digests(docs, F.struct("*").alias("_row"))
    return judged(rows, index).filter("_kept").select("_row.*")
