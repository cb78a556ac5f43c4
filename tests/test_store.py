"""The snapshot store: runs that stop at any step, and several writers."""

import shutil
import threading

import pytest

from docsync.plans import snapshot
from docsync.plans.snapshot import SnapshotStore, StaleStateError
from docsync.schemas import SYNC_STATE


def state(spark, *keys, kb="k"):
    return spark.createDataFrame([(kb, k, "/p", h, "id", None, False) for k, h in keys], SYNC_STATE)


def held(store):
    return {r["file_key"]: r["content_hash"] for r in store.read().collect()}


class Stopped(Exception):
    pass


def stop_at(monkeypatch, name, when):
    """Let the call `name` of a store raise before or after its work."""
    whole = getattr(SnapshotStore, name)

    def call(self, *args):
        if when == "after":
            whole(self, *args)
        raise Stopped

    monkeypatch.setattr(SnapshotStore, name, call)


STEPS = [("_begin", "before"), ("_begin", "after"), ("_claim", "before"), ("_claim", "after"), ("_expire", "before")]


@pytest.mark.parametrize("name, when", STEPS)
def test_first_commit_that_stops_can_be_repeated(spark, tmp_path, monkeypatch, name, when):
    path = str(tmp_path / "store")
    with monkeypatch.context() as patch:
        stop_at(patch, name, when)
        with pytest.raises(Stopped):
            SnapshotStore(spark, path).commit(state(spark, ("a", "h1")), "first")
    store = SnapshotStore(spark, path)
    done = (name, when) in (("_claim", "after"), ("_expire", "before"))
    assert held(store) == ({"a": "h1"} if done else {})
    assert store.commit(state(spark, ("a", "h1")), "first") == 1
    assert held(SnapshotStore(spark, path)) == {"a": "h1"}


@pytest.mark.parametrize("when", ["before", "after"])
def test_later_commit_that_stops_can_be_repeated(spark, tmp_path, monkeypatch, when):
    path = str(tmp_path / "store")
    SnapshotStore(spark, path).commit(state(spark, *[(f"k{i}", "h") for i in range(20)]))
    with monkeypatch.context() as patch:
        stop_at(patch, "_claim", when)
        with pytest.raises(Stopped):
            SnapshotStore(spark, path).commit_changes(state(spark, ("k3", "h2")), "second")
    store = SnapshotStore(spark, path)
    assert held(store)["k3"] == ("h2" if when == "after" else "h")
    store.commit_changes(state(spark, ("k3", "h2")), "second")
    assert held(store)["k3"] == "h2" and store.version() == 2


def test_snapshots_without_their_log_are_refused(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "store"))
    store.commit(state(spark, ("a", "h")))
    shutil.rmtree(tmp_path / "store" / "commits")
    with pytest.raises(FileNotFoundError):
        SnapshotStore(spark, store.path).read()


def two(spark, tmp_path, n=40):
    path = str(tmp_path / "store")
    SnapshotStore(spark, path).commit(state(spark, *[(f"k{i}", "h") for i in range(n)]))
    a, b = SnapshotStore(spark, path), SnapshotStore(spark, path)
    a.read(), b.read()
    return a, b


def test_writers_of_different_keys_both_commit(spark, tmp_path):
    a, b = two(spark, tmp_path)
    a.commit_changes(state(spark, ("k1", "from a")), "a1")
    b.commit_changes(state(spark, ("k2", "from b")), "b1", state(spark, ("k3", "")))
    want = {f"k{i}": "h" for i in range(40) if i != 3} | {"k1": "from a", "k2": "from b"}
    assert held(a) == held(b) == want and a.version() == 3


def test_writer_whose_keys_were_changed_is_refused(spark, tmp_path):
    a, b = two(spark, tmp_path)
    a.commit_changes(state(spark, ("k1", "from a")))
    with pytest.raises(StaleStateError):
        b.commit_changes(state(spark, ("k1", "from b")))
    with pytest.raises(StaleStateError):
        b.commit(state(spark, ("k1", "from b")))
    assert held(b)["k1"] == "from a"
    # Having read the new state, it may decide again.
    b.commit_changes(state(spark, ("k1", "from b")))
    assert held(a)["k1"] == "from b"


def test_version_taken_between_check_and_commit(spark, tmp_path, monkeypatch):
    a, b = two(spark, tmp_path)
    whole, raced = SnapshotStore._claim, []

    def claim(self, *args):
        if self is b and not raced:
            raced.append(True)
            a.commit_changes(state(spark, ("k5", "from a")), "a")
        return whole(self, *args)

    monkeypatch.setattr(SnapshotStore, "_claim", claim)
    assert b.commit_changes(state(spark, ("k6", "from b")), "b") == 3
    assert {k: h for k, h in held(b).items() if h != "h"} == {"k5": "from a", "k6": "from b"}
    left = [p.name for p in (tmp_path / "store" / "snapshots").iterdir()]
    assert len(left) == 3


def test_only_one_writer_makes_the_first_base(spark, tmp_path):
    path = str(tmp_path / "store")
    a, b = SnapshotStore(spark, path), SnapshotStore(spark, path)
    a.read(), b.read()
    assert a.commit(state(spark, ("a", "h"))) == 1
    with pytest.raises(StaleStateError):
        b.commit_changes(state(spark, ("b", "h")))
        b.commit(state(spark, ("b", "h")))


def test_writers_at_the_same_time_lose_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(snapshot, "COMPACT_DELTAS", 4)
    a, b = two(spark, tmp_path)
    failures = []

    def work(store, name):
        try:
            for i in range(5):
                store.commit_changes(state(spark, (f"{name}{i}", "h")), f"{name}{i}")
        except Exception as e:  # noqa: BLE001
            failures.append(e)

    threads = [threading.Thread(target=work, args=x) for x in ((a, "a"), (b, "b"))]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failures
    store = SnapshotStore(spark, a.path)
    assert len(held(store)) == 50 and all(store.has_tag(f"{n}{i}") for n in "ab" for i in range(5))
    versions = sorted(store._commits().select("version").collect())
    assert versions == [(i + 1,) for i in range(len(versions))]
