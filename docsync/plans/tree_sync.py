"""Sync runs over real directory trees."""

from __future__ import annotations

import os
import time
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsync.functions import scalars as S
from docsync.operators import payload_parts
from docsync.operators.filters import filter_disposition
from docsync.operators.state_ops import tracked_state
from docsync.plans.snapshot import SnapshotStore
from docsync.sources import doctree

# A file changed this close to the time it was hashed at may have changed again without a new stamp.
STAMP_MARGIN_US = 2_000_000
LISTED = ["kb_id", "root", "path", "rel_path", "filename", "kind", "file_key"]
RAW = "raw"


def _kind(path: str) -> str:
    if os.path.islink(path):
        return "symlink"
    return "file" if os.path.isfile(path) else "dir"


def probe_paths(tracked: DataFrame, root: str) -> DataFrame:
    """Those of the tracked paths that exist, as listing rows. Each path is looked up on
    an executor, so a walk need not enter hidden directories to know what they hold."""
    base = root.rstrip("/") + "/"

    def existing(batches):
        for batch in batches:
            exists = [os.path.exists(p) for p in batch.column("absolute_path").to_pylist()]
            found = batch.filter(pa.array(exists, pa.bool_()))
            paths = found.column("absolute_path").to_pylist()
            columns = {
                "kb_id": found.column("kb_id"),
                "root": [root] * len(paths),
                "path": paths,
                "rel_path": [p[len(base) :] if p.startswith(base) else None for p in paths],
                "filename": [p.rsplit("/", 1)[-1] for p in paths],
                "kind": [_kind(p) for p in paths],
                "file_key": found.column("file_key"),
            }
            arrays = [pa.array(columns[c], pa.string()) for c in LISTED]
            yield pa.RecordBatch.from_arrays([*arrays, pa.nulls(len(paths), pa.binary())], [*LISTED, RAW])

    schema = ", ".join(f"{c} string" for c in LISTED) + f", {RAW} binary"
    rows = tracked.select("kb_id", "file_key", "absolute_path")
    return rows.mapInArrow(existing, schema)


def hash_changed(
    store: SnapshotStore, files: DataFrame, kb_id: str, hashes: SnapshotStore, margin_us: int = STAMP_MARGIN_US
) -> DataFrame:
    """Add `content_hash` to files, and open only those whose size or stamps changed since the hash in
    `hashes`, a store of HASHES rows, was taken.

    A stored hash counts if size, modification and change time are the same, and both times were
    `margin_us` old when it was taken: later writes may share a stamp that was still fresh. New hashes are
    committed, and those of files that are no longer listed dropped.
    """
    now = time.time_ns() // 1000
    stats = store.stage("stats", doctree.stat_files(spread(files)))
    known = hashes.read().filter(F.col("kb_id") == kb_id)
    held = known.select("kb_id", "file_key", *[F.col(c).alias(f"_{c}") for c in known.columns[2:]])
    settled = F.greatest("_mtime_us", "_ctime_us") < F.col("_hashed_at_us") - margin_us
    same = [F.col(c) == F.col(f"_{c}") for c in ("size", "mtime_us", "ctime_us")]
    valid = F.coalesce(same[0] & same[1] & same[2] & settled, F.lit(False))
    judged = store.stage("known", stats.join(held, ["kb_id", "file_key"], "left").withColumn("_valid", valid))
    kept = judged.filter("_valid").withColumn("content_hash", F.col("_content_hash"))
    fresh = store.stage("hashed", doctree.hash_files(spread(judged.filter("NOT _valid"))))
    gone = known.join(stats.select("kb_id", "file_key"), ["kb_id", "file_key"], "left_anti")
    rows = fresh.filter("content_hash IS NOT NULL AND size IS NOT NULL").withColumn("hashed_at_us", F.lit(now))
    if not rows.isEmpty() or not gone.isEmpty():
        hashes.commit_changes(rows, dropped=gone)
    return kept.unionByName(fresh).select(*files.columns, "content_hash")


def stage_tree(
    store: SnapshotStore,
    root: str,
    kb_id: str,
    patterns: DataFrame,
    scanned: DataFrame | None = None,
    hashes: SnapshotStore | None = None,
) -> DataFrame:
    """The listing of `root` that a run decides on, written once with content hashes.

    Listing, probing and hashing are input/output, so each happens exactly once per run
    and its result is stored. Only accepted files are opened and hashed. The tree is listed
    level by level. Names that are not UTF-8 can look alike and then have one key; the first
    by its raw path is the file of that key. With `hashes`, a store of HASHES rows, only files that
    changed since they were last hashed are opened (see `hash_changed`).
    """
    root = os.path.realpath(root)
    if scanned is None:
        levels = f"{store.path}/staged/levels-{uuid.uuid4().hex}"
        scanned = doctree.scan_levels(store.spark, root, kb_id, levels)
    odd = F.col(RAW).isNotNull()
    alike = scanned.filter(odd).groupBy(*LISTED).agg(F.min(RAW).alias(RAW))
    files = store.stage("listing", scanned.filter(~odd).select(*LISTED, RAW).unionByName(alike))
    tracked = tracked_state(store.read()).filter(F.col("kb_id") == kb_id)
    unlisted = tracked.join(files.select("kb_id", "file_key"), ["kb_id", "file_key"], "left_anti")
    unlisted = store.stage("unlisted", unlisted)
    dealt = doctree.deal_out(unlisted, "file_key", unlisted.count(), doctree.FILES_PER_TASK)
    disk = files.unionByName(probe_paths(dealt, root))
    judged = store.stage(
        "judged", filter_disposition(disk, patterns).select(*LISTED, RAW, "disposition")
    )
    accepted = F.col("disposition") == "accepted"
    files = judged.filter(accepted).select(*LISTED, RAW)
    if hashes is None:
        hashed = doctree.hash_files(spread(files))
    else:
        hashed = hash_changed(store, files, kb_id, hashes)
    rest = judged.filter(~accepted).select(*LISTED, RAW, F.lit(None).cast("string").alias("content_hash"))
    return store.stage("disk", hashed.unionByName(rest))


def spread(files: DataFrame) -> DataFrame:
    """Deal files out evenly before they are opened: a walk leaves one large directory
    in one partition, and reading costs far more than moving a path."""
    return doctree.deal_out(files, "file_key", files.count(), doctree.FILES_PER_TASK)


def read_spread(files: DataFrame) -> DataFrame:
    """Content of planned files, read evenly by all tasks."""
    return doctree.read_contents(spread(files))


def read_parts_spread(files: DataFrame) -> DataFrame:
    """Payload parts of planned files, for files of any size; `run_sync` takes it in the place of
    `read_spread` and then hands over parts instead of whole payloads."""
    return payload_parts.read_payload_parts(spread(files), doctree.to_open)


def file_keys(paths: DataFrame) -> DataFrame:
    """Keys of given paths, for setting or getting their context. A path that exists is
    made canonical first, as a walk would have found it; any other is taken as given."""
    columns = paths.columns
    at = columns.index("path")

    def canonical(batches):
        for batch in batches:
            given = batch.column("path").to_pylist()
            real = [os.path.realpath(p) if os.path.exists(p) else p for p in given]
            yield batch.set_column(at, "path", pa.array(real, pa.string()))

    found = paths.withColumn("_name", S.file_name(F.col("path")))
    keyed = found.mapInArrow(canonical, found.schema)
    return keyed.withColumn("file_key", S.file_key(F.col("path"), F.col("_name"))).select(
        *columns, "file_key"
    )
