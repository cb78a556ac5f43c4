"""Hashes kept by size and stamps: an unchanged tree is not opened, a changed file always is."""

import hashlib
import os

import pytest

from docsync.plans import tree_sync
from docsync.plans.snapshot import SnapshotStore
from docsync.plans.tree_sync import stage_tree
from docsync.schemas import HASHES, PATTERNS
from docsync.sources import doctree

OLD = 1_600_000_000


class Tree:
    def __init__(self, spark, tmp_path):
        self.root = tmp_path / "rag"
        self.root.mkdir()
        self.store = SnapshotStore(spark, str(tmp_path / "store"))
        self.hashes = SnapshotStore(spark, str(tmp_path / "hashes"), HASHES)
        self.patterns = spark.createDataFrame([], PATTERNS)

    def write(self, name, data, at=OLD):
        (self.root / name).write_bytes(data)
        os.utime(self.root / name, (at, at))

    def hashed(self):
        disk = stage_tree(self.store, str(self.root), "kb", self.patterns, hashes=self.hashes)
        return {r["filename"]: r["content_hash"] for r in disk.collect()}

    def expected(self):
        return {p.name: hashlib.sha256(p.read_bytes()).hexdigest() for p in self.root.iterdir() if p.is_file()}


@pytest.fixture
def tree(spark, tmp_path, monkeypatch):
    # The change time of a file cannot be set back, so it counts as old in these tests.
    whole = doctree._stat

    def stat(path):
        size, modified, changed = whole(path)
        return size, modified, None if changed is None else (changed // 10**12)

    monkeypatch.setattr(doctree, "_stat", stat)
    tree = Tree(spark, tmp_path)
    for name, data in (("a.md", b"one"), ("b.txt", b"two"), ("c.md", b""), ("dé.md", b"three")):
        tree.write(name, data)
    return tree


def refuse_to_open(monkeypatch):
    def opened(path):
        return f"opened {os.path.basename(path)}"

    monkeypatch.setattr(doctree, "_hash_file", opened)


def test_unchanged_tree_is_not_opened(tree, monkeypatch):
    first = tree.hashed()
    assert first == tree.expected()
    version = tree.hashes.version()
    refuse_to_open(monkeypatch)
    assert tree.hashed() == first
    # Nothing new is written either.
    assert tree.hashes.version() == version


def test_changed_new_and_removed_files(tree, monkeypatch):
    tree.hashed()
    tree.write("a.md", b"ONE", OLD + 1)  # same size, new time
    tree.write("b.txt", b"two and more")  # same time, new size
    tree.write("e.md", b"new")
    (tree.root / "c.md").unlink()
    with monkeypatch.context() as patch:
        refuse_to_open(patch)
        opened = {n for n, h in tree.hashed().items() if h.startswith("opened")}
    assert opened == {"a.md", "b.txt", "e.md"}


def test_hashes_follow_the_tree(tree):
    tree.hashed()
    tree.write("a.md", b"ONE", OLD + 1)
    (tree.root / "c.md").unlink()
    assert tree.hashed() == tree.expected()
    kept = {r["content_hash"] for r in tree.hashes.read().collect()}
    assert kept == set(tree.expected().values())


def test_fresh_stamps_are_not_trusted(tree, monkeypatch):
    """A file written just before it was hashed may have been written again within the same stamp."""
    import time

    tree.write("a.md", b"one", time.time())
    tree.hashed()
    refuse_to_open(monkeypatch)
    assert {n for n, h in tree.hashed().items() if h.startswith("opened")} == {"a.md"}


def test_change_time_counts(spark, tmp_path, monkeypatch):
    """Stamps set back after a write do not hide it, as the change time moved."""
    monkeypatch.setattr(tree_sync.hash_changed, "__defaults__", (-(10**12),))
    tree = Tree(spark, tmp_path)
    tree.write("a.md", b"one")
    tree.hashed()
    tree.write("a.md", b"ONE")
    assert tree.hashed() == tree.expected()


def test_without_stored_hashes_every_file_is_opened(tree, monkeypatch):
    refuse_to_open(monkeypatch)
    disk = stage_tree(tree.store, str(tree.root), "kb", tree.patterns).collect()
    assert all(r["content_hash"].startswith("opened") for r in disk)


def test_empty_tree(tree):
    tree.hashed()
    for p in list(tree.root.iterdir()):
        p.unlink()
    assert tree.hashed() == {} and tree.hashes.read().count() == 0
