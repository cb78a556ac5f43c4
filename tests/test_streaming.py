"""Change streams, batch by batch."""

import shutil

import pytest
from conftest import rows
from pyspark.sql import functions as F

from docsync.plans import snapshot
from docsync.plans.snapshot import SnapshotStore
from docsync.schemas import CHANGES, STREAM_STATE, SYNC_STATE
from docsync.streaming.microbatch import sync_stream
from docsync.streaming.stateful import classify_stream

K = "k"


class Feed:
    """A folder that each call adds one batch of changes to."""

    def __init__(self, spark, path):
        self.spark, self.path = spark, str(path)

    def add(self, *changes):
        data = [(K, key, f"/rag/{key}", hash_, op, seq) for key, hash_, op, seq in changes]
        self.spark.createDataFrame(data, CHANGES).coalesce(1).write.mode("append").parquet(self.path)

    def stream(self):
        return self.spark.readStream.schema(CHANGES).parquet(self.path)


def test_micro_batches(spark, tmp_path):
    feed = Feed(spark, tmp_path / "changes")
    store = SnapshotStore(spark, str(tmp_path / "store"), STREAM_STATE)
    sent, down = [], set()

    def deliver(due):
        picked = [(r["file_key"], r["action"]) for r in due.collect()]
        sent.append(sorted(picked))
        done = due.filter(~F.col("file_key").isin(list(down))) if down else due
        return done.select("kb_id", "file_key", F.concat(F.lit("id-"), "wanted_hash").alias("remote_file_id"))

    def run():
        sync_stream(feed.stream(), store, deliver, str(tmp_path / "cp")).awaitTermination()
        return {r["file_key"]: r for r in store.read().collect()}

    feed.add(("a", "h1", "upsert", 1), ("a", "h2", "upsert", 2), ("b", "h1", "upsert", 3))
    state = run()
    assert sent[-1] == [("a", "NEW"), ("b", "NEW")]
    assert (state["a"]["content_hash"], state["a"]["remote_file_id"]) == ("h2", "id-h2")

    feed.add(("a", "h2", "upsert", 4), ("b", "h9", "upsert", 2), ("b", None, "context", 5))
    state = run()
    assert sent[-1] == [("b", "UPDATE")]
    assert (state["b"]["content_hash"], state["b"]["context_dirty"]) == ("h1", False)

    down.add("a")
    feed.add(("a", "h3", "upsert", 6))
    state = run()
    assert sent[-1] == [("a", "UPDATE")] and state["a"]["content_hash"] == "h2"

    down.clear()
    feed.add(("b", None, "delete", 7))
    state = run()
    assert sent[-1] == [("a", "UPDATE")] and state["a"]["content_hash"] == "h3"
    assert state["b"]["is_deleted"] and state["b"]["absolute_path"] is None

    feed.add(("b", "late", "upsert", 6))
    assert run()["b"]["is_deleted"] and sent[-1] == []

    feed.add(("b", "h1", "upsert", 8))
    assert run()["b"]["content_hash"] == "h1" and sent[-1] == [("b", "NEW")]


def upload_all(due):
    return due.select("kb_id", "file_key", F.concat(F.lit("id-"), "wanted_hash").alias("remote_file_id"))


def run_stream(feed, store, checkpoint, deletes=None):
    def delete(rows_):
        deletes.extend((r["file_key"], r["action"], r["remote_file_id"]) for r in rows_.collect())

    hook = None if deletes is None else delete
    sync_stream(feed.stream(), store, upload_all, str(checkpoint), hook).awaitTermination()
    return {r["file_key"]: r for r in store.read().collect()}


def test_streams_do_not_take_each_others_batches(spark, tmp_path):
    """A second stream into a store, and a new checkpoint, begin at batch 0 again."""
    store = SnapshotStore(spark, str(tmp_path / "store"), STREAM_STATE)
    first, second = Feed(spark, tmp_path / "a"), Feed(spark, tmp_path / "b")
    first.add(("a", "h1", "upsert", 1))
    assert set(run_stream(first, store, tmp_path / "cp1")) == {"a"}
    second.add(("b", "h1", "upsert", 1))
    assert set(run_stream(second, store, tmp_path / "cp2")) == {"a", "b"}
    first.add(("c", "h1", "upsert", 2))
    state = run_stream(first, store, tmp_path / "cp3")
    assert set(state) == {"a", "b", "c"} and state["a"]["content_hash"] == "h1"


def test_replayed_batch_changes_nothing(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "store"), STREAM_STATE)
    feed = Feed(spark, tmp_path / "changes")
    feed.add(("a", "h1", "upsert", 1))
    run_stream(feed, store, tmp_path / "cp")
    version = store.version()
    # As if the engine had died after the commit and before it noted the batch as done.
    for name in ("commits/0", "commits/.0.crc"):
        (tmp_path / "cp" / name).unlink(missing_ok=True)
    assert run_stream(feed, store, tmp_path / "cp")["a"]["content_hash"] == "h1"
    assert store.version() == version


def test_note_does_not_make_older_content_late(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "store"), STREAM_STATE)
    feed = Feed(spark, tmp_path / "changes")
    feed.add(("a", "h1", "upsert", 1))
    run_stream(feed, store, tmp_path / "cp")
    feed.add(("a", None, "context", 10))
    run_stream(feed, store, tmp_path / "cp")
    feed.add(("a", "h2", "upsert", 5))
    state = run_stream(feed, store, tmp_path / "cp")["a"]
    assert (state["content_hash"], state["content_seq"], state["context_seq"]) == ("h2", 5, 10)
    # A note from before a delete goes with the file; a later one is for the next.
    feed.add(("a", None, "delete", 20), ("a", None, "context", 15))
    state = run_stream(feed, store, tmp_path / "cp")["a"]
    assert state["is_deleted"] and not state["context_dirty"]
    feed.add(("a", None, "context", 17))
    assert not run_stream(feed, store, tmp_path / "cp")["a"]["context_dirty"]
    feed.add(("a", None, "context", 21))
    assert run_stream(feed, store, tmp_path / "cp")["a"]["context_dirty"]


def test_stream_hands_over_deletes(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "store"), STREAM_STATE)
    feed, deletes = Feed(spark, tmp_path / "changes"), []
    feed.add(("a", "h1", "upsert", 1), ("b", "h1", "upsert", 2))
    run_stream(feed, store, tmp_path / "cp", deletes)
    assert deletes == []
    feed.add(("a", "h2", "upsert", 3), ("b", None, "delete", 4))
    state = run_stream(feed, store, tmp_path / "cp", deletes)
    assert sorted(deletes) == [("a", "UPDATE", "id-h1"), ("b", "ORPHAN", "id-h1")]
    assert state["a"]["remote_file_id"] == "id-h2" and state["b"]["remote_file_id"] is None


def test_small_batch_on_a_large_state_writes_little(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "store"), STREAM_STATE)
    big = spark.range(5000).select(
        F.lit(K).alias("kb_id"), F.concat(F.lit("f"), "id").alias("file_key"), F.lit("/rag/f").alias("absolute_path"),
        F.lit("h").alias("content_hash"), F.lit("id").alias("remote_file_id"), F.lit(None).cast("string").alias("context_text"),
        F.lit(False).alias("context_dirty"), F.lit(1).cast("bigint").alias("content_seq"),
        F.lit(None).cast("bigint").alias("context_seq"), F.lit("/rag/f").alias("wanted_path"), F.lit("h").alias("wanted_hash"),
        F.lit(False).alias("is_deleted"),
    )
    store.commit(big)
    feed = Feed(spark, tmp_path / "changes")
    for i in range(4):
        feed.add(("f7", f"h{i}", "upsert", 10 + i), (f"new{i}", "h", "upsert", 20 + i))
        run_stream(feed, store, tmp_path / "cp")
    deltas = [p for p in (tmp_path / "store" / "snapshots").iterdir() if p.name.startswith("d")]
    assert len(deltas) == 4
    assert all(spark.read.parquet(str(p)).count() == 2 for p in deltas)
    state = {r["file_key"]: r["content_hash"] for r in store.read().collect()}
    assert len(state) == 5004 and state["f7"] == "h3" and state["new0"] == "h"


def test_deltas_fold_into_a_base(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(snapshot, "COMPACT_DELTAS", 3)
    monkeypatch.setattr(snapshot, "COMPACT_SHARE", 100.0)
    store = SnapshotStore(spark, str(tmp_path / "store"))

    def state(*keys):
        return spark.createDataFrame([(K, k, "/p", h, "id", None, False) for k, h in keys], SYNC_STATE)

    store.commit(state(("a", "h0"), ("b", "h0")))
    expected = {"a": "h0", "b": "h0"}
    for i in range(8):
        gone = state(("b", "x")) if i == 2 else None
        store.commit_changes(state(("a", f"h{i}"), (f"k{i}", "h")), f"t{i}", gone)
        expected |= {"a": f"h{i}", f"k{i}": "h"}
        if i == 2:
            del expected["b"]
        assert {r["file_key"]: r["content_hash"] for r in store.read().collect()} == expected
        assert store.has_tag(f"t{i}")
    kept = list((tmp_path / "store" / "snapshots").iterdir())
    assert any(p.name.startswith("v") for p in kept)


def test_missing_log_is_not_an_empty_store(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "store"))
    assert store.read().count() == 0
    store.commit(spark.createDataFrame([], SYNC_STATE))
    shutil.rmtree(tmp_path / "store" / "commits")
    with pytest.raises(FileNotFoundError):
        store.read()


def test_tagged_commit_is_applied_once(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "store"))
    empty = store.read()
    assert store.commit(empty, "batch-0") == 1
    assert store.commit(empty, "batch-0") == 1
    assert store.commit(empty, "batch-1") == 2 and store.version() == 2


class Keyed:
    """Runs the keyed stream over a feed; gives the decisions so far."""

    def __init__(self, spark, tmp_path):
        self.spark, self.path, self.feed = spark, tmp_path, Feed(spark, tmp_path / "changes")

    def run(self, *columns):
        out = str(self.path / "out")
        query = (
            classify_stream(self.feed.stream())
            .writeStream.format("parquet")
            .option("path", out)
            .option("checkpointLocation", str(self.path / "cp"))
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
        return rows(self.spark.read.parquet(out).select(*columns))


def test_keyed_note_does_not_make_older_content_late(spark, tmp_path):
    keyed = Keyed(spark, tmp_path)
    keyed.feed.add(("a", "h1", "upsert", 1))
    keyed.run("seq", "action")
    keyed.feed.add(("a", None, "context", 10))
    assert keyed.run("seq", "action") == [(1, "NEW"), (10, "UPDATE")]
    keyed.feed.add(("a", "h2", "upsert", 5))
    assert keyed.run("seq", "content_hash", "action")[-1] == (5, "h2", "UPDATE")


def test_keyed_stream_names_remote_files(spark, tmp_path):
    keyed = Keyed(spark, tmp_path)
    path = str(tmp_path / "changes")

    def add(*changes):
        data = [(K, "a", "/rag/a", h, op, seq, rid) for h, op, seq, rid in changes]
        spark.createDataFrame(data, CHANGES + ", remote_file_id string").coalesce(1).write.mode("append").parquet(path)

    keyed.feed.stream = lambda: spark.readStream.schema(CHANGES + ", remote_file_id string").parquet(path)
    add(("h1", "upsert", 1, None))
    keyed.run("seq")
    add(("h1", "delivered", 2, "r1"))
    keyed.run("seq")
    add(("h2", "upsert", 3, None))
    assert keyed.run("seq", "action", "delete_remote_id") == [(1, "NEW", None), (3, "UPDATE", "r1")]
    add(("h2", "delivered", 4, "r2"))
    keyed.run("seq")
    add((None, "delete", 5, None))
    assert keyed.run("seq", "action", "delete_remote_id")[-1] == (5, "ORPHAN", "r2")


def test_keyed_state(spark, tmp_path):
    feed = Feed(spark, tmp_path / "changes")
    out = str(tmp_path / "out")

    def run():
        query = (
            classify_stream(feed.stream())
            .writeStream.format("parquet")
            .option("path", out)
            .option("checkpointLocation", str(tmp_path / "cp"))
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
        return rows(spark.read.parquet(out).select("file_key", "seq", "action"))

    feed.add(("a", "h1", "upsert", 1), ("b", "h1", "upsert", 2), ("b", "h2", "upsert", 3), ("c", None, "context", 4))
    first = [("a", 1, "NEW"), ("b", 3, "NEW")]
    assert run() == first
    feed.add(("a", "h1", "upsert", 5), ("b", None, "context", 6), ("c", "h", "upsert", 7), ("b", "h0", "upsert", 1))
    second = [("a", 5, "SKIP"), ("b", 6, "UPDATE"), ("c", 7, "UPDATE")]
    assert run() == sorted(first + second)
    feed.add(("a", None, "delete", 8), ("b", "h3", "upsert", 9))
    assert run() == sorted(first + second + [("a", 8, "ORPHAN"), ("b", 9, "UPDATE")])
