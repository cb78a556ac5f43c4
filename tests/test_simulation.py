"""Whole runs against a plain walk through the three phases, one random case per
knowledge base, all cases in one job."""

import hashlib
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from docsync import constants as C
from docsync.operators import filters, ingest, orphans, reconcile, state_ops
from docsync.plans import full_sync as sync
from docsync.schemas import PATTERNS, REMOTE_FILES, STATE_COLUMNS, SYNC_STATE

ROOT = "/rag"
DISK = (
    "kb_id string, root string, path string, rel_path string, filename string, kind string, "
    "file_key string, content_hash string"
)
NAMES = ["README.md", "a.py", "b.PDF", "c.png", "Makefile", "Thumbs.db", ".env.md", "d.TXT"]
FOLDERS = ["", "docs/", "drafts/", ".git/", "docs/deep/"]


def key_of(path):
    return hashlib.sha256(path.encode()).hexdigest() + "_" + path.rsplit("/", 1)[-1]


def extension(name):
    stem, dot, ext = name.rpartition(".")
    return ext.lower() if dot and stem else None


class Case:
    """Random files, state, remote listing and deliveries of one knowledge base."""

    def __init__(self, kb, rng):
        self.kb = kb
        paths = [f"{ROOT}/{folder}{name}" for folder in FOLDERS for name in NAMES]
        hashes = ["h1", "h2"]
        self.disk = {
            p: ("dir" if rng.random() < 0.03 else "file", rng.choice(hashes))
            for p in rng.sample(paths, rng.randrange(25))
        }
        self.state = {}
        for p in rng.sample(paths, rng.randrange(25)):
            context = rng.choice([None, "", "note"])
            if rng.random() < 0.1:
                row = [None, None, None, "note", True]
            else:
                row = [p, rng.choice(hashes), rng.choice(["r1", "r2", "", None]), context, rng.random() < 0.2]
            self.state[key_of(p)] = row
        self.remote = [
            (f"r{rng.randrange(4)}", rng.choice(NAMES + ["gone.md"])) for _ in range(rng.randrange(6))
        ]
        self.patterns = rng.sample(["drafts", "README", "deep/", "zzz"], rng.randrange(3))
        self.fails = {key_of(p) for p in paths if rng.random() < 0.2}

    def run(self):
        """Actions, heals and the state left, by going through the rows one at a time."""
        state = {k: list(v) for k, v in self.state.items()}
        actions, healed = {}, set()

        def hidden(path):
            return any(part.startswith(".") for part in path[len(ROOT) + 1 :].split("/"))

        def unwanted(path):
            rel, name = path[len(ROOT) + 1 :], path.rsplit("/", 1)[-1]
            if any(p in rel for p in self.patterns):
                return True
            return name in C.OS_FILES or extension(name) not in C.ALLOWED_EXTENSIONS

        visible = sorted(p for p, (kind, _) in self.disk.items() if kind == "file" and not hidden(p))
        for remote_id, name in self.remote:
            matches = [p for p in visible if p.rsplit("/", 1)[-1] == name]
            if not matches:
                continue
            key = key_of(matches[0])
            old = state.get(key)
            if old and old[2] == remote_id:
                continue
            healed.add(key)
            state[key] = [matches[0], self.disk[matches[0]][1], remote_id, old[3] if old else None, False]

        for path in visible:
            if unwanted(path):
                continue
            key, current = key_of(path), self.disk[path][1]
            old = state.get(key)
            if old is None:
                actions[key] = ("NEW", "", None)
            elif old[1] == current and not old[4]:
                actions[key] = ("SKIP", "", None)
                continue
            else:
                actions[key] = ("UPDATE", "", old[2] or None)
            if key not in self.fails:
                state[key] = [path, current, "new", old[3] if old else None, False]

        for key, row in list(state.items()):
            if key in actions:
                continue
            if row[0] is None:
                actions[key] = ("CONTEXT", "", None)
            elif row[0] not in self.disk:
                actions[key] = ("ORPHAN", "missing", row[2] or None)
                del state[key]
            elif unwanted(row[0]):
                actions[key] = ("ORPHAN", "filtered", row[2] or None)
                del state[key]
            else:
                actions[key] = ("KEPT", "", None)
        return actions, healed, state


@pytest.fixture(scope="module")
def cases():
    rng = random.Random(11)
    return [Case(f"kb{i}", rng) for i in range(150)]


@pytest.fixture(scope="module")
def inputs(spark, cases):
    disk, state, remote, patterns = [], [], [], []
    for c in cases:
        for p, (kind, hash_) in c.disk.items():
            disk.append((c.kb, ROOT, p, p[len(ROOT) + 1 :], p.rsplit("/", 1)[-1], kind, key_of(p), hash_))
        state += [(c.kb, k, *v) for k, v in c.state.items()]
        remote += [(c.kb, i, *r) for i, r in enumerate(c.remote)]
        patterns += [(c.kb, i, p) for i, p in enumerate(c.patterns)]
    return (
        spark.createDataFrame(disk, DISK),
        spark.createDataFrame(state, SYNC_STATE),
        spark.createDataFrame(remote, REMOTE_FILES),
        spark.createDataFrame(patterns, PATTERNS),
    )


def state_rows(kb, state):
    return [(kb, k, *v) for k, v in state.items()]


def test_frame_equals_the_three_phases(spark, cases, inputs):
    disk, state, remote, patterns = inputs
    frame = sync.sync_frame(disk, state, remote, patterns)
    want_actions, want_healed, want_state, fails = [], [], [], []
    for c in cases:
        actions, healed, after = c.run()
        want_actions += [(c.kb, k, *a) for k, a in actions.items()]
        want_healed += [(c.kb, k) for k in healed]
        want_state += state_rows(c.kb, after)
        fails += [(c.kb, k) for k in c.fails]
    got = frame.filter("action <> 'IGNORED'")
    assert rows(got.select("kb_id", "file_key", "action", "reason", "delete_remote_id")) == sorted(want_actions, key=repr)
    assert rows(frame.filter("healed").select("kb_id", "file_key")) == sorted(want_healed, key=repr)
    failed = spark.createDataFrame(fails, "kb_id string, file_key string")
    delivered = frame.select("kb_id", "file_key", F.lit("new").alias("remote_file_id")).join(
        failed, ["kb_id", "file_key"], "left_anti"
    )
    after = sync.next_state(frame, delivered).select(*STATE_COLUMNS)
    assert rows(after) == sorted(want_state, key=repr)


def test_separate_operators_equal_the_frame(spark, cases, inputs):
    disk, state, remote, patterns = inputs
    healed, _ = reconcile.reconcile(disk, state, remote)
    accepted = filters.filter_disposition(disk, patterns).filter("disposition = 'accepted'")
    plan = ingest.classify_files(accepted, healed)
    roots = spark.createDataFrame([(c.kb, ROOT) for c in cases], "kb_id string, root string")
    dropped = orphans.find_orphans(healed, disk, patterns, roots)
    frame = sync.sync_frame(disk, state, remote, patterns)
    due = frame.filter(F.col("action").isin("NEW", "UPDATE", "SKIP"))
    columns = ["kb_id", "file_key", "action", "delete_remote_id"]
    assert rows(plan.select(*columns)) == rows(due.select(*columns))
    columns = ["kb_id", "file_key", "reason"]
    assert rows(dropped.select(*columns)) == rows(frame.filter("action = 'ORPHAN'").select(*columns))
    kept = state_ops.delete_state(healed, dropped.union(dropped))
    assert kept.count() == healed.count() - dropped.count()


def test_a_second_run_has_nothing_to_do(inputs):
    disk, state, _, patterns = inputs
    nothing = state.sparkSession.createDataFrame([], REMOTE_FILES)
    frame = sync.sync_frame(disk, state, nothing, patterns)
    sent = frame.select("kb_id", "file_key", F.lit("new").alias("remote_file_id"))
    again = sync.sync_frame(disk, sync.next_state(frame, sent), nothing, patterns)
    assert {r["action"] for r in again.select("action").distinct().collect()} <= {"SKIP", "KEPT", "CONTEXT", "IGNORED"}
