"""Sync driven by a stream of file changes, one committed snapshot per micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docsync.functions import predicates as P
from docsync.operators.skew import broadcast_if_small, full_join_stored
from docsync.plans.snapshot import SnapshotStore

KEY = ["kb_id", "file_key"]


def latest_changes(changes: DataFrame) -> DataFrame:
    """The content change and the note edit of highest `seq` per key.
    Both combine before the shuffle, so a key that changes all the time stays one row."""
    content = F.when(F.col("op").isin("upsert", "delete"), F.col("seq"))
    return changes.groupBy(*KEY).agg(
        F.max(content).alias("new_content_seq"),
        F.max_by("path", content).alias("new_path"),
        F.max_by("content_hash", content).alias("new_hash"),
        F.max_by("op", content).alias("new_op"),
        F.max(F.when(F.col("op") == "context", F.col("seq"))).alias("new_context_seq"),
    )


def apply_changes(latest: DataFrame, state: DataFrame) -> DataFrame:
    """Merge the stored `latest_changes` of a batch into stream state, deciding per row.

    A change whose `seq` is not above the stored one of its kind is late and has no effect;
    nor has a note edit from before the delete that took its file away. `action` is NEW,
    UPDATE, SKIP or ORPHAN for rows the batch touches or an earlier delivery left open,
    and null for all others. `touched` tells whether the batch changed anything in the row.
    """
    rows = full_join_stored(state, latest, KEY)
    none = F.lit(-1)
    fresh = F.coalesce(F.col("new_content_seq") > F.coalesce("content_seq", none), F.lit(False))
    deleted_at = F.when(F.col("_fresh") & (F.col("new_op") == "delete"), F.col("new_content_seq"))
    edited = F.col("new_context_seq") > F.greatest(F.coalesce("context_seq", none), "_deleted_at", none)
    gone = F.coalesce("is_deleted", F.lit(False))
    rows = (
        rows.withColumn("_fresh", fresh)
        .withColumn("_deleted_at", deleted_at)
        .withColumn("_edited", F.coalesce(edited, F.lit(False)))
        .withColumn("_dead", F.when(F.col("_fresh"), F.col("new_op") == "delete").otherwise(gone))
        .withColumn("wanted_path", F.when(F.col("_fresh"), F.col("new_path")).otherwise(F.col("wanted_path")))
        .withColumn("wanted_hash", F.when(F.col("_fresh"), F.col("new_hash")).otherwise(F.col("wanted_hash")))
        .withColumn("context_dirty", F.coalesce("context_dirty", F.lit(False)) | F.col("_edited"))
        .withColumn("content_seq", F.greatest("content_seq", F.when(F.col("_fresh"), F.col("new_content_seq"))))
        .withColumn(
            "context_seq",
            F.greatest("context_seq", F.when(F.col("_edited"), F.col("new_context_seq")), "_deleted_at"),
        )
    )
    known = F.col("content_hash").isNotNull() | F.col("context_dirty") | F.col("context_text").isNotNull()
    synced = P.verify_hash(F.col("content_hash"), F.col("wanted_hash"), F.col("context_dirty"))
    wants = F.col("wanted_hash").isNotNull() & ~F.col("_dead")
    action = (
        F.when(F.col("_dead") & F.col("absolute_path").isNotNull(), "ORPHAN")
        .when(wants & ~known, "NEW")
        .when(wants & ~synced, "UPDATE")
        .when(wants & (F.col("_fresh") | F.col("_edited")), "SKIP")
    )
    kept = [c for c in state.columns if c != "is_deleted"]
    return rows.withColumn("action", action).select(
        *kept, F.col("_dead").alias("is_deleted"), "action", (F.col("_fresh") | F.col("_edited")).alias("touched")
    )


def remote_deletes(decided: DataFrame) -> DataFrame:
    """Remote files to delete: the old one of an UPDATE and that of an ORPHAN."""
    old = F.nullif(F.col("remote_file_id"), F.lit(""))
    rows = decided.filter(F.col("action").isin("UPDATE", "ORPHAN") & old.isNotNull())
    return rows.select(*KEY, "action", "remote_file_id")


def settle(decided: DataFrame, delivered: DataFrame) -> DataFrame:
    """Stream state after delivery. An upload that did not go through stays open: its
    wanted hash still differs from the delivered one, and the next batch offers it again."""
    done = delivered.select(*KEY, F.col("remote_file_id").alias("_id"))
    rows = decided.join(done, KEY, "left")
    sent = F.col("_id").isNotNull() & F.col("action").isin("NEW", "UPDATE")
    dropped = F.coalesce(F.col("action") == "ORPHAN", F.lit(False))

    def after(new: str, old: str):
        return F.when(sent, F.col(new)).when(~dropped, F.col(old)).alias(old)

    return rows.select(
        *KEY,
        after("wanted_path", "absolute_path"),
        after("wanted_hash", "content_hash"),
        after("_id", "remote_file_id"),
        F.when(~dropped, F.col("context_text")).alias("context_text"),
        (F.col("context_dirty") & ~F.coalesce(sent, F.lit(False)) & ~dropped).alias("context_dirty"),
        "content_seq",
        "context_seq",
        F.when(~dropped, F.col("wanted_path")).alias("wanted_path"),
        F.when(~dropped, F.col("wanted_hash")).alias("wanted_hash"),
        "is_deleted",
    )


def stream_name(spark: SparkSession, checkpoint: str) -> str:
    """The id a stream keeps for the life of its checkpoint. Batch numbers alone begin again
    with every checkpoint, and several streams may feed one store."""
    return spark.read.schema("id string").json(f"{checkpoint.rstrip('/')}/metadata").first()["id"]


def sync_stream(
    changes: DataFrame,
    store: SnapshotStore,
    deliver: Callable[[DataFrame], DataFrame],
    checkpoint: str,
    delete: Callable[[DataFrame], None] | None = None,
) -> StreamingQuery:
    """Run all available changes through `store`, which holds `STREAM_STATE` rows.

    Each batch is tagged with its stream, so one that is replayed after a failure is not
    applied twice, and a batch of another stream or checkpoint is never taken for it.
    `delete` gets the remote files to delete; the rows are stored, and the state still names
    them until the commit, so a batch that stops in between hands them over again.
    `deliver` gets the NEW and UPDATE rows and returns keys with remote ids. Only rows that a
    batch touches are decided and committed.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        tag = f"{stream_name(store.spark, checkpoint)}/batch-{batch_id}"
        if store.has_tag(tag):
            return
        latest = store.stage("latest", latest_changes(batch))
        decided = apply_changes(latest, store.read())
        decided = store.stage("decided", decided.filter(F.col("touched") | F.col("action").isNotNull()))
        if delete is not None:
            delete(store.stage("deletes", remote_deletes(decided)))
        due = decided.filter(F.col("action").isin("NEW", "UPDATE"))
        delivered = store.stage("delivered", deliver(due))
        store.commit_changes(settle(decided, broadcast_if_small(delivered)), tag)
        store.drop_staged()

    return (
        changes.writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
