"""Delivery reports in keyed streams: any order and batching, no remote file lost."""

import itertools
import random
import time

import pytest
from conftest import rows

from docsync.schemas import CHANGES
from docsync.streaming.stateful import File, Report, advance, classify_stream

REPORTED = CHANGES + ", remote_file_id string"


def run_batches(batches):
    """Final file and every id named for deletion, from batches of (op, seq, hash, remote id)."""
    file, opened, deleted, actions = File(), {}, [], []
    for batch in batches:
        content = [(s, op, h) for op, s, h, _ in batch if op in ("upsert", "delete")]
        notes = [s for op, s, _, _ in batch if op == "context"]
        reports = [Report(h, i, s) for op, s, h, i in batch if op == "delivered"]
        file, opened, out = advance(file, opened, max(content, default=None), max(notes, default=-1), reports)
        deleted += [d[3] for d in out if d[3]]
        actions += [d[2] for d in out]
    return file, opened, deleted, actions


def history(seed):
    """Changes of one file and the report of each delivery, each somewhere after its change."""
    rng = random.Random(seed)
    out, seq, held = [], 0, None
    for i in range(rng.randrange(1, 6)):
        seq += 1
        op = rng.choice(["upsert", "upsert", "upsert", "delete", "context"]) if held else "upsert"
        held = f"h{i}" if op == "upsert" else None if op == "delete" else held
        out.append((op, seq, held if op == "upsert" else None, None))
        if op != "delete" and rng.random() < 0.8:
            seq += 1
            out.append(("delivered", seq, held, f"r{i}"))
    return out


def batchings(events, rng):
    events = events[:]
    rng.shuffle(events)
    cuts = sorted(rng.sample(range(1, len(events) + 1), rng.randrange(1, len(events) + 1)))
    return [events[a:b] for a, b in zip([0, *cuts], [*cuts, len(events)]) if a < b]


def expected(events):
    """Brute force over the whole history: the id that stays, and all others."""
    content = max((e for e in events if e[0] in ("upsert", "delete")), key=lambda e: e[1])
    deletes = [e[1] for e in events if e[0] == "delete"]
    notes = [e[1] for e in events if e[0] == "context"]
    after = max([*notes, *deletes], default=-1)
    told = [e for e in events if e[0] == "delivered"]
    valid = [e for e in told if e[2] == content[2] is not None and e[1] > after]
    stays = max(valid, key=lambda e: e[1])[3] if valid else None
    return stays, sorted(e[3] for e in told if e[3] != stays)


@pytest.mark.parametrize("seed", range(60))
def test_ids_do_not_depend_on_order_or_batches(seed):
    events = history(seed)
    rng = random.Random(seed)
    stays, others = expected(events)
    for _ in range(60):
        file, opened, deleted, _ = run_batches(batchings(events, rng))
        waiting = [i for i, _ in opened.values() if i]
        assert file.remote_file_id == stays
        # What still waits is given up by a timer, and named then.
        assert sorted(deleted + waiting) == others


def test_every_order_of_two_deliveries():
    events = [("upsert", 1, "h1", None), ("delivered", 2, "h1", "r1"), ("upsert", 3, "h2", None), ("delivered", 4, "h2", "r2")]
    for order in itertools.permutations(events):
        for batches in ([list(order)], [[e] for e in order], [list(order[:2]), list(order[2:])]):
            file, opened, deleted, _ = run_batches(batches)
            assert (file.content_hash, file.remote_file_id, deleted, opened) == ("h2", "r2", ["r1"], {})


def test_report_with_its_change_is_remembered():
    batches = [[("upsert", 1, "h1", None), ("delivered", 2, "h1", "r1")], [("upsert", 3, "h2", None)]]
    file, opened, deleted, actions = run_batches(batches)
    assert (deleted, actions, file.remote_file_id) == (["r1"], ["NEW", "UPDATE"], None)
    assert opened == {"h2": (None, 3)}


def test_late_report_of_a_replaced_delivery_is_dropped():
    batches = [[("upsert", 1, "h1", None)], [("upsert", 2, "h2", None)], [("delivered", 3, "h1", "r1")]]
    file, opened, deleted, actions = run_batches(batches)
    assert (deleted, actions) == (["r1"], ["NEW", "UPDATE", "DROP"])
    assert opened == {"h2": (None, 2)} and file.remote_file_id is None


def test_repeats_and_blank_ids_change_nothing():
    first = [("upsert", 1, "h1", None), ("delivered", 2, "h1", "r1")]
    file, opened, deleted, _ = run_batches([first, first, first[1:], [("delivered", 2, "h1", "")], [("upsert", 3, "h1", None)]])
    assert (file.remote_file_id, deleted, opened) == ("r1", [], {})


@pytest.fixture
def stream(spark, tmp_path):
    path = str(tmp_path / "changes")

    def run(*changes, give_up_ms=None):
        data = [("kb", "a", "/rag/a", h, op, seq, rid) for op, seq, h, rid in changes]
        spark.createDataFrame(data, REPORTED).coalesce(1).write.mode("append").parquet(path)
        feed = spark.readStream.schema(REPORTED).parquet(path)
        query = classify_stream(feed, give_up_ms).writeStream.format("parquet").option("path", str(tmp_path / "out"))
        query.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        return rows(spark.read.parquet(str(tmp_path / "out")).select("seq", "action", "delete_remote_id"))

    return run


def test_stream_keeps_the_id_of_one_batch(stream):
    stream(("upsert", 1, "h1", None), ("delivered", 2, "h1", "r1"))
    stream(("upsert", 3, "h2", None))
    stream(("delivered", 4, "h2", "r2"), ("upsert", 5, "h3", None))
    assert stream(("delivered", 7, "h3", "r3"), ("delivered", 6, "h3", "r4")) == [
        (1, "NEW", None), (3, "UPDATE", "r1"), (5, "UPDATE", "r2"), (6, "DROP", "r4"),
    ]


def test_stream_gives_up_reports_without_a_change(spark, stream):
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    stream(("upsert", 1, "h1", None), ("delivered", 9, "other", "r9"), give_up_ms=500)
    time.sleep(1)
    assert stream(("upsert", 2, "h1", None), give_up_ms=500) == [(1, "NEW", None), (2, "SKIP", None), (9, "DROP", "r9")]
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
