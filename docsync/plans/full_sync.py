"""A whole sync run: heal, classify, deliver, commit, clean up.

Heal, ingest and cleanup are decided by one frame: the listing and the tracked state
meet once, in a full outer join on the file key, and every decision is a projection of
that row. Tracked rows carry the key of their own path, so a row without a partner in
the listing is a file that no longer exists.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsync.functions import predicates as P
from docsync.functions import scalars as S
from docsync.operators import payload, reports
from docsync.operators.filters import filter_disposition
from docsync.operators.ingest import with_convert
from docsync.operators.reconcile import is_settled, name_outcomes
from docsync.operators.skew import broadcast_if_small, lookup_by_kb
from docsync.plans.snapshot import SnapshotStore
from docsync.schemas import REMOTE_FILES

KEY = ["kb_id", "file_key"]


def sync_frame(
    disk: DataFrame, state: DataFrame, remote: DataFrame, patterns: DataFrame
) -> DataFrame:
    """One row per file that is listed or tracked, with what the run does about it.

    `disk` is the unfiltered listing with `content_hash` (needed for accepted files
    only). `action` is NEW, UPDATE, SKIP, FAILED, ORPHAN, KEPT (tracked, not ingested,
    not dropped), CONTEXT (a context note without a file) or IGNORED; `reason` says why.
    """
    raw = [c for c in disk.columns if c == "raw"]
    listed = filter_disposition(disk, patterns).select(
        *KEY, "path", "filename", "disposition", "is_filtered", "content_hash", *raw
    )
    outcomes = name_outcomes(disk, remote.filter(F.col("kb_id") != "")).drop("first_path")
    stored = state.select(*KEY, *[F.col(c).alias(f"_{c}") for c in state.columns if c not in KEY])
    rows = (
        listed.join(outcomes, KEY, "left")
        .join(stored.withColumn("_tracked", F.lit(True)), KEY, "full")
        .withColumn(
            "healed", F.col("last_id").isNotNull() & ~is_settled(F.col("_remote_file_id"))
        )
    )

    def after_heal(new, old: str):
        return F.when(F.col("healed"), new).otherwise(F.col(old))

    rows = (
        rows.withColumn("_hash", after_heal(F.coalesce("content_hash", F.lit("")), "_content_hash"))
        .withColumn("_id", after_heal(F.col("last_id"), "_remote_file_id"))
        .withColumn("_path", after_heal(F.col("path"), "_absolute_path"))
        .withColumn("_dirty", after_heal(F.lit(False), "_context_dirty"))
    )
    accepted = F.coalesce(F.col("disposition") == "accepted", F.lit(False))
    known = F.col("_tracked").isNotNull() | F.col("healed")
    file_row = F.col("_path").isNotNull()
    action = (
        F.when(accepted & F.col("content_hash").isNull(), "FAILED")
        .when(accepted & ~known, "NEW")
        .when(
            accepted & P.verify_hash(F.col("_hash"), F.col("content_hash"), F.col("_dirty")), "SKIP"
        )
        .when(accepted, "UPDATE")
        .when(file_row & (F.col("path").isNull() | F.col("is_filtered")), "ORPHAN")
        .when(file_row, "KEPT")
        .when(known, "CONTEXT")
        .otherwise("IGNORED")
    )
    reason = (
        F.when((F.col("action") == "ORPHAN") & F.col("path").isNull(), "missing")
        .when(F.col("action") == "ORPHAN", "filtered")
        .when(F.col("action") == "IGNORED", F.col("disposition"))
        .otherwise("")
    )
    drops = F.col("action").isin("UPDATE", "ORPHAN")
    return (
        rows.withColumn("action", action)
        .withColumn("reason", reason)
        .select(
            *KEY,
            F.coalesce("path", "_path").alias("path"),
            F.coalesce("filename", S.file_name(F.col("_path"))).alias("filename"),
            "content_hash",
            "action",
            "reason",
            "healed",
            F.when(drops, F.nullif(F.col("_id"), F.lit(""))).alias("delete_remote_id"),
            known.alias("is_tracked"),
            F.col("_path").alias("absolute_path"),
            F.col("_hash").alias("stored_hash"),
            F.col("_id").alias("remote_file_id"),
            F.col("_context_text").alias("context_text"),
            F.coalesce("_dirty", F.lit(False)).alias("context_dirty"),
            *raw,
        )
    )


def next_state(frame: DataFrame, delivered: DataFrame) -> DataFrame:
    """Tracked state after the run. `delivered` holds `(kb_id, file_key,
    remote_file_id)` of the uploads that went through; an upload that did not leaves its
    row as it was, to be tried again."""
    done = delivered.select(*KEY, F.col("remote_file_id").alias("new_remote_id"))
    return settled(frame.join(done, KEY, "left"))


def settled(frame: DataFrame) -> DataFrame:
    """Tracked state after the run, from a frame whose rows have their `new_remote_id`, null
    where nothing went through."""
    due = F.col("action").isin("NEW", "UPDATE")
    sent = F.col("new_remote_id").isNotNull() & due
    rows = frame.filter((F.col("action") != "ORPHAN") & (F.col("is_tracked") | sent))
    return rows.select(
        *KEY,
        F.when(sent, F.col("path")).otherwise(F.col("absolute_path")).alias("absolute_path"),
        F.when(sent, F.col("content_hash")).otherwise(F.col("stored_hash")).alias("content_hash"),
        F.when(sent, F.col("new_remote_id")).otherwise(F.col("remote_file_id")).alias("remote_file_id"),
        "context_text",
        (F.col("context_dirty") & ~sent).alias("context_dirty"),
    )


def sync_actions(frame: DataFrame) -> DataFrame:
    """What a run does, as a log: heals, ingest decisions and orphans. A row that is healed
    and then decided on gives two entries, both from one pass over the frame."""

    def entry(when, action, remote_file_id, reason):
        fields = {"action": action, "remote_file_id": remote_file_id, "reason": reason}
        return F.when(when, F.struct(*[value.alias(name) for name, value in fields.items()]))

    action, none = F.col("action"), F.lit(None).cast("string")
    entries = F.array(
        entry(F.col("healed"), F.lit("HEAL"), F.col("remote_file_id"), none),
        entry(action.isin("NEW", "UPDATE", "SKIP", "FAILED"), action, F.col("delete_remote_id"), none),
        entry(action == "ORPHAN", action, F.coalesce("remote_file_id", F.lit("")), F.col("reason")),
    )
    return frame.select(*KEY, F.inline(F.array_compact(entries)))


def remote_deletes(frame: DataFrame) -> DataFrame:
    """Remote files to delete: the old one of an UPDATE and that of an ORPHAN."""
    rows = frame.filter(F.col("delete_remote_id").isNotNull())
    return rows.select(*KEY, "action", F.col("delete_remote_id").alias("remote_file_id"))


def delivery_work(frame: DataFrame, config: DataFrame) -> DataFrame:
    """Everything a run asks of the remote side, one row per request.

    `work` is delete or upload; deletes come before uploads, and an UPDATE gives both. `lane` deals
    the requests of a knowledge base out to as many uploaders as its configuration
    allows at a time, by file key, so both requests of a file are in one lane; it is null where
    their number is not limited.
    """
    upload = F.when(F.col("action").isin("NEW", "UPDATE"), F.struct(F.lit(2).alias("step"), F.lit("upload").alias("work"), F.lit(None).cast("string").alias("remote_file_id")))
    delete = F.when(
        F.col("delete_remote_id").isNotNull(),
        F.struct(F.lit(1).alias("step"), F.lit("delete").alias("work"), F.col("delete_remote_id").alias("remote_file_id")),
    )
    rows = frame.select(*KEY, "path", "action", F.inline(F.array_compact(F.array(delete, upload))))
    limits = config.select("kb_id", F.nullif(F.col("max_concurrent_uploads"), F.lit(0)).alias("_lanes"))
    dealt = F.conv(F.substring("file_key", 1, 8), 16, 10).cast("bigint") % F.col("_lanes")
    return lookup_by_kb(rows, limits, F.col("file_key")).withColumn("lane", dealt.cast("bigint")).drop("_lanes")


def write_plan(plan: DataFrame, path: str, partitions: int = 0) -> None:
    """Write delivery work by knowledge base and action.

    `partitions` bounds how many delivery streams there are. With 0, Spark rebalances by
    size: small knowledge bases get one file each and a large one is split.
    """
    if partitions:
        plan = plan.repartition(partitions, "kb_id", "file_key")
    else:
        plan = plan.hint("rebalance", "kb_id", "action")
    plan.write.partitionBy("kb_id", "action").parquet(path)


@dataclass
class SyncResult:
    frame: DataFrame
    payloads: DataFrame
    state: DataFrame
    summary: DataFrame
    deletes: DataFrame


def run_sync(
    store: SnapshotStore,
    disk: DataFrame,
    remote: DataFrame | None,
    patterns: DataFrame,
    config: DataFrame,
    contents: Callable[[DataFrame], DataFrame],
    deliver: Callable[[DataFrame], DataFrame],
    tag: str = "",
    delete: Callable[[DataFrame], None] | None = None,
    plan_path: str = "",
) -> SyncResult:
    """Run one sync against the state in `store` and commit the outcome.

    The run covers the knowledge bases `config` has a row for; `disk` must list all of
    each. Tracked rows of others in the same store are not touched, and only rows that a run
    changes are committed.

    `contents` adds a `content` column to planned files, such as
    `plans.tree_sync.read_spread`, or gives their payloads in parts, such as
    `plans.tree_sync.read_parts_spread`. `deliver` takes the payload table and returns the
    keys and remote ids that went through. Without a `remote` listing nothing is healed and
    the run goes on. Decisions are written before anything is delivered, so delivery and
    commit work from the same rows even if files change or executors are lost meanwhile.
    The commit comes last; a run that stops before it leaves the state untouched, and the
    next run repairs it from the remote listing.

    `delete` gets the remote files to delete: of orphans, and the old ones of updates. They are
    stored first and the state names them until the commit, so a run that stops in
    between hands them over again. With `plan_path`, a new folder, all requests are written
    there by knowledge base and action as well (see `delivery_work`).
    """
    in_run = config.select("kb_id", F.lit(True).alias("_in_run"))
    state = lookup_by_kb(store.read(), in_run, F.col("file_key"))
    own = state.filter("_in_run").drop("_in_run")
    if remote is None:
        remote = store.spark.createDataFrame([], REMOTE_FILES)
    frame = store.stage("frame", sync_frame(disk, own, remote, patterns))
    due = with_convert(payload.due(frame), config).withColumn(
        "upload_filename", S.upload_filename(F.col("filename"), F.col("convert"))
    )
    bodies = contents(payload.with_header(due, config))
    payloads = store.stage("payloads", bodies if "payload" in bodies.columns else payload.build_payload(bodies))
    deletes = store.stage("deletes", remote_deletes(frame))
    if plan_path:
        write_plan(delivery_work(frame, config), plan_path)
    if delete is not None:
        delete(deletes)
    delivered = store.stage("delivered", deliver(payloads))
    sent = broadcast_if_small(delivered)
    changed = frame.filter(F.col("healed") | F.col("action").isin("NEW", "UPDATE"))
    gone = frame.filter("action = 'ORPHAN'").select(*KEY)
    store.commit_changes(next_state(changed, sent), tag, gone)
    return SyncResult(frame, payloads, store.read(), reports.sync_summary(frame), deletes)
