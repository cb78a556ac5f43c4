"""`doctree`: a directory tree as a DataFrame of its entries.

The source yields metadata only. Content is hashed or read later, over the paths that
survive filtering. The tree must be mounted at the same place on every executor.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from docsync.functions import scalars as S
from docsync.schemas import LISTING

READ_BUFFER = 1 << 20
BATCH_BYTES = 64 << 20
DIRECTORIES_PER_TASK = 500
FILES_PER_TASK = 5_000
LEVEL_COLUMNS = ["kb_id", "root", "path", "rel_path", "filename", "kind", "raw"]


class Slice(InputPartition):
    """The subtrees below the root whose names hash to `number`, of `total` slices."""

    def __init__(self, number: int, total: int):
        self.number, self.total = number, total


def _entries(directory: str) -> Iterator[os.DirEntry]:
    """Entries of a directory as they are read; none when it cannot be read."""
    try:
        scan = os.scandir(directory)
    except OSError:
        return
    with scan:
        while True:
            try:
                yield next(scan)
            except (StopIteration, OSError):
                return


def _is_dir(entry: os.DirEntry) -> bool:
    try:
        return entry.is_dir(follow_symlinks=False)
    except OSError:
        return False


def _kind(entry: os.DirEntry) -> str | None:
    """None when the entry is gone or cannot be looked at."""
    try:
        if entry.is_symlink():
            return "symlink"
        if entry.is_dir(follow_symlinks=False):
            return "dir"
        return "file" if entry.is_file(follow_symlinks=False) else "other"
    except OSError:
        return None


def _names(entry: os.DirEntry, root: str) -> tuple[str, str, str, bytes | None]:
    """Path, path below root, name, and the raw path where that is not UTF-8: bytes that are
    not are shown replaced, but a file is opened by its raw path."""
    raw = os.fsencode(entry.path)
    path = raw.decode("utf-8", "replace")
    shown = path[len(root.rstrip("/")) + 1 :], path.rsplit("/", 1)[-1]
    return path, *shown, None if path.encode() == raw else raw


def _real_root(path: str) -> str:
    """The canonical root. One that is not mounted must not look like an empty one, or
    every tracked file would be dropped as missing."""
    root = os.path.realpath(path)
    if not os.path.isdir(root):
        raise FileNotFoundError(f"target directory does not exist: {root}")
    return root


class DocTreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = _real_root(options["path"])
        self.kb_id = options.get("kb_id", "")
        self.prune_hidden = options.get("hidden", "prune") == "prune"
        self.files_only = options.get("kinds", "files") == "files"
        self.tasks = int(options.get("partitions", "64"))

    def _keeps(self, name: str) -> bool:
        return not (self.prune_hidden and name.startswith("."))

    def partitions(self) -> list[Slice]:
        """Slices of the names below the root; nothing is listed on the driver."""
        return [Slice(i, self.tasks) for i in range(self.tasks)]

    def read(self, part: Slice) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for row in self._walk(part):
            rows.append(row)
            if len(rows) >= 10_000:
                yield self._batch(rows)
                rows = []
        if rows:
            yield self._batch(rows)

    def _walk(self, part: Slice) -> Iterator[tuple]:
        pending = [self.root]
        while pending:
            directory = pending.pop()
            for entry in _entries(directory):
                if not self._keeps(entry.name):
                    continue
                if directory == self.root and zlib.crc32(os.fsencode(entry.name)) % part.total != part.number:
                    continue
                if _is_dir(entry):
                    pending.append(entry.path)
                row = self._row(entry)
                if row is not None:
                    yield row

    def _row(self, entry: os.DirEntry) -> tuple | None:
        kind = _kind(entry)
        if kind is None or (self.files_only and kind != "file"):
            return None
        try:
            stat = entry.stat(follow_symlinks=False)
        except OSError:
            return None
        path, rel, name, raw = _names(entry, self.root)
        return (self.kb_id, self.root, path, rel, name, kind, stat.st_size, stat.st_mtime_ns // 1000, raw)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        text = pa.string()
        types = [text] * 6 + [pa.int64()] * 2 + [pa.binary()]
        names = [c.split()[0] for c in LISTING.split(", ")]
        columns = [pa.array(list(c), t) for c, t in zip(zip(*rows), types)]
        return pa.RecordBatch.from_arrays(columns, names)


class DocTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "doctree"

    def schema(self) -> str:
        return LISTING

    def reader(self, schema) -> DocTreeReader:
        return DocTreeReader(dict(self.options))


def scan_tree(
    spark: SparkSession, root: str, kb_id: str, hidden: str = "prune", kinds: str = "files"
) -> DataFrame:
    """Entries below `root`. `hidden="keep"` and `kinds="all"` give the listing that
    existence is tested against."""
    spark.dataSource.register(DocTree)
    parts = 4 * spark.sparkContext.defaultParallelism
    reader = spark.read.format("doctree").option("kb_id", kb_id).option("partitions", parts)
    return reader.option("hidden", hidden).option("kinds", kinds).load(root)


def scan_inventory(spark: SparkSession, root: str, kb_id: str) -> DataFrame:
    """Regular files below `root`, never entering dot directories, with their keys."""
    files = scan_tree(spark, root, kb_id)
    return files.withColumn("file_key", S.file_key(F.col("path"), F.col("filename")))


def deal_out(df: DataFrame, key: str, rows: int, per_task: int) -> DataFrame:
    """Spread rows that each stand for file work over tasks of at most about `per_task`.

    The number of partitions is stated: left to itself, Spark merges partitions by their
    size in bytes, and a million paths are few bytes but much work.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, min(rows, max(4 * cores, rows // per_task + 1)))
    return df.repartition(tasks, key)


def scan_levels(spark: SparkSession, root: str, kb_id: str, work_dir: str) -> DataFrame:
    """`scan_inventory` for trees of any shape, without length and time.

    The tree is listed one level at a time, its directories dealt out to all tasks, and
    each level is written to `work_dir`, a new shared folder. However unevenly files
    are spread over subtrees, no task walks more than the directories it was dealt, and a
    directory of any size is listed once, by one task, without being held.
    """
    base = _real_root(root)

    def list_level(batches):
        for batch in batches:
            columns = batch.column("path").to_pylist(), batch.column("raw").to_pylist()
            for shown, raw in zip(*columns):
                rows = []
                for entry in _entries(shown if raw is None else os.fsdecode(raw)):
                    kind = None if entry.name.startswith(".") else _kind(entry)
                    if kind is not None:
                        path, rel, name, own = _names(entry, base)
                        rows.append((kb_id, base, path, rel, name, kind, own))
                    if len(rows) >= 10_000:
                        yield level_batch(rows)
                        rows = []
                if rows:
                    yield level_batch(rows)

    def level_batch(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.string()] * (len(LEVEL_COLUMNS) - 1) + [pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], LEVEL_COLUMNS)

    schema = ", ".join(f"{c} {'binary' if c == 'raw' else 'string'}" for c in LEVEL_COLUMNS)
    level = spark.createDataFrame([(base, None)], "path string, raw binary")
    n_directories = 1
    paths: list[str] = []
    while n_directories:
        paths.append(f"{work_dir.rstrip('/')}/level={len(paths)}")
        dealt = deal_out(level.select("path", "raw"), "path", n_directories, DIRECTORIES_PER_TASK)
        dealt.mapInArrow(list_level, schema).write.parquet(paths[-1])
        level = spark.read.schema(schema).parquet(paths[-1]).filter("kind = 'dir'")
        n_directories = level.count()
    files = spark.read.schema(schema).parquet(*paths).filter("kind = 'file'")
    return files.withColumn("file_key", S.file_key(F.col("path"), F.col("filename")))


def _plus(df: DataFrame, name: str, of: T.DataType) -> T.StructType:
    return T.StructType([*df.schema.fields, T.StructField(name, of)])


def to_open(batch: pa.RecordBatch) -> list[str | bytes]:
    """What to open for each row: the raw path where there is one."""
    paths = batch.column("path").to_pylist()
    raw = batch.column("raw").to_pylist() if "raw" in batch.schema.names else [None] * len(paths)
    return [path if own is None else own for path, own in zip(paths, raw)]


def _hash_file(path: str | bytes) -> str | None:
    digest = hashlib.sha256()
    try:
        with open(path, "rb") as handle:
            while block := handle.read(READ_BUFFER):
                digest.update(block)
    except OSError:
        return None
    return digest.hexdigest()


def _stat(path: str | bytes) -> tuple[int, int, int] | tuple[None, None, None]:
    try:
        found = os.stat(path)
    except OSError:
        return None, None, None
    return found.st_size, found.st_mtime_ns // 1000, found.st_ctime_ns // 1000


def stat_files(files: DataFrame) -> DataFrame:
    """Add `size`, `mtime_us` and `ctime_us` without opening a file; null where it is gone."""
    names = ("size", "mtime_us", "ctime_us")

    def with_stats(batches):
        for batch in batches:
            found = [_stat(p) for p in to_open(batch)]
            for name, values in zip(names, zip(*found) if found else [()] * len(names)):
                batch = batch.append_column(name, pa.array(values, pa.int64()))
            yield batch

    schema = T.StructType([*files.schema.fields, *[T.StructField(n, T.LongType()) for n in names]])
    return files.mapInArrow(with_stats, schema)


def hash_files(files: DataFrame) -> DataFrame:
    """Add `content_hash`, streamed from each path; null where a file cannot be read."""

    def hashed(batches):
        for batch in batches:
            digests = [_hash_file(p) for p in to_open(batch)]
            yield batch.append_column("content_hash", pa.array(digests, pa.string()))

    return files.mapInArrow(hashed, _plus(files, "content_hash", T.StringType()))


def read_contents(files: DataFrame) -> DataFrame:
    """Add `content`, the bytes of each path; a file that cannot be read gives no row.
    Output batches are cut by bytes, so memory follows the largest file."""

    def with_content(batch, picked, held):
        rows = batch.take(pa.array(picked, pa.int64()))
        return rows.append_column("content", pa.array(held, pa.binary()))

    def contents(batches):
        for batch in batches:
            held, size, picked = [], 0, []
            for row, path in enumerate(to_open(batch)):
                try:
                    with open(path, "rb") as handle:
                        data = handle.read()
                except OSError:
                    continue
                held.append(data)
                picked.append(row)
                size += len(data)
                if size >= BATCH_BYTES:
                    yield with_content(batch, picked, held)
                    held, size, picked = [], 0, []
            if held:
                yield with_content(batch, picked, held)

    return files.mapInArrow(contents, _plus(files, "content", T.BinaryType()))
