"""The four-step life of two files, on real files and real snapshots."""

import hashlib
import os

import pytest
from conftest import rows
from pyspark.sql import functions as F

from docsync.functions.predicates import is_visible
from docsync.operators import filters, state_ops
from docsync.plans.full_sync import run_sync, write_plan
from docsync.plans.snapshot import SnapshotStore
from docsync.plans.tree_sync import file_keys, read_spread, stage_tree
from docsync.schemas import REMOTE_FILES, SYNC_STATE
from docsync.sources import doctree
from docsync.sources.ragignore import load_ragignore

KB = "kb-1"


class Rig:
    def __init__(self, spark, tmp_path, convert=False):
        self.spark = spark
        self.root = tmp_path / "rag"
        self.root.mkdir()
        self.store = SnapshotStore(spark, str(tmp_path / "store"))
        self.config = spark.createDataFrame(
            [(KB, "File Context", convert)],
            "kb_id string, context_header_label string, convert_to_markdown boolean",
        )
        self.remote = spark.createDataFrame([], REMOTE_FILES)
        self.runs = 0

    def sync(self, deliver=None):
        self.runs += 1
        run = self.runs

        def all_go_through(payloads):
            new_id = F.concat(F.lit(f"run{run}-"), "filename")
            return payloads.select("kb_id", "file_key", new_id.alias("remote_file_id"))

        patterns = load_ragignore(self.spark, str(self.root), KB)
        disk = stage_tree(self.store, str(self.root), KB, patterns)
        return run_sync(
            self.store, disk, self.remote, patterns, self.config, read_spread, deliver or all_go_through
        )

    def actions(self, result):
        return {r["filename"]: (r["action"], r["reason"]) for r in result.frame.collect()}

    def note(self, path, text):
        edit = [(KB, str(path), text, 1)]
        schema = "kb_id string, path string, context_text string, seq int"
        keyed = file_keys(self.spark.createDataFrame(edit, schema))
        self.store.commit(state_ops.set_context(self.store.read(), keyed))


@pytest.fixture
def rig(spark, tmp_path):
    return Rig(spark, tmp_path)


def test_four_steps(rig):
    doc, pdf = rig.root / "plan.md", rig.root / "scan.pdf"
    doc.write_text("# Plan\nfirst draft\n")
    pdf.write_bytes(b"%PDF \x00\xff")

    first = rig.sync()
    assert rig.actions(first) == {"plan.md": ("NEW", ""), "scan.pdf": ("NEW", "")}
    assert first.payloads.count() == 2
    state = {r["absolute_path"]: r for r in first.state.collect()}
    assert set(state) == {str(doc), str(pdf)}
    assert not any(r["context_dirty"] for r in state.values())

    rig.note(doc, "ask the team")
    second = rig.sync()
    assert rig.actions(second) == {"plan.md": ("UPDATE", ""), "scan.pdf": ("SKIP", "")}
    sent = second.payloads.collect()
    assert len(sent) == 1 and sent[0]["delete_remote_id"] == "run1-plan.md"
    assert bytes(sent[0]["payload"]) == b"> **File Context:**\n> ask the team\n\n" + doc.read_bytes()
    state = {r["absolute_path"]: r for r in second.state.collect()}
    assert not state[str(doc)]["context_dirty"]
    assert state[str(doc)]["context_text"] == "ask the team"
    assert state[str(pdf)]["remote_file_id"] == "run1-scan.pdf"

    with pdf.open("ab") as handle:
        handle.write(b"more")
    third = rig.sync()
    assert rig.actions(third) == {"plan.md": ("SKIP", ""), "scan.pdf": ("UPDATE", "")}
    assert [bytes(r["payload"]) for r in third.payloads.collect()] == [pdf.read_bytes()]

    pdf.unlink()
    (rig.root / ".ragignore").write_text("plan.md\n")
    fourth = rig.sync()
    assert rig.actions(fourth) == {"plan.md": ("ORPHAN", "filtered"), "scan.pdf": ("ORPHAN", "missing")}
    assert rows(fourth.frame.select("delete_remote_id")) == [("run2-plan.md",), ("run3-scan.pdf",)]
    assert fourth.payloads.count() == 0
    assert fourth.state.count() == 0


def test_second_run_skips_everything(rig):
    for name in ["a.md", "b.py", "c.json"]:
        (rig.root / name).write_text(name)
    rig.sync()
    again = rig.sync()
    assert set(rig.actions(again).values()) == {("SKIP", "")}
    assert again.payloads.count() == 0


def test_failed_upload_is_tried_again(rig):
    (rig.root / "a.md").write_text("a")
    lost = rig.sync(lambda p: p.limit(0).select("kb_id", "file_key", F.lit("x").alias("remote_file_id")))
    assert lost.state.count() == 0
    assert rig.actions(rig.sync()) == {"a.md": ("NEW", "")}


def test_lost_snapshot_is_healed_from_the_listing(rig):
    doc = rig.root / "a.md"
    doc.write_text("a")
    rig.remote = rig.spark.createDataFrame([(KB, 0, "rid-1", "a.md"), (KB, 1, "rid-2", "a.md")], REMOTE_FILES)
    result = rig.sync()
    assert rig.actions(result) == {"a.md": ("SKIP", "")}
    assert [r["remote_file_id"] for r in result.state.collect()] == ["rid-2"]


def test_context_before_first_sync_gives_update(rig):
    doc = rig.root / "a.py"
    doc.write_text("print()")
    rig.note(doc, "early")
    result = rig.sync()
    assert rig.actions(result) == {"a.py": ("UPDATE", "")}
    assert result.payloads.first()["delete_remote_id"] is None


def test_hidden_tracked_file_is_kept(rig):
    folder = rig.root / ".cache"
    folder.mkdir()
    doc = folder / "a.md"
    doc.write_text("a")
    keyed = file_keys(rig.spark.createDataFrame([(KB, str(doc))], "kb_id string, path string"))
    rig.store.commit(
        state_ops.upsert_state(
            rig.store.read(),
            keyed.select(
                "kb_id",
                "file_key",
                F.col("path").alias("absolute_path"),
                F.lit("h").alias("content_hash"),
                F.lit("r").alias("remote_file_id"),
            ),
        )
    )
    assert rig.actions(rig.sync()) == {"a.md": ("KEPT", "")}
    doc.unlink()
    assert rig.actions(rig.sync()) == {"a.md": ("ORPHAN", "missing")}


def test_plan_is_written_by_knowledge_base_and_action(rig, spark, tmp_path):
    for name in ["a.md", "b.md", "c.md"]:
        (rig.root / name).write_text(name)
    rig.remote = None
    frame = rig.sync().frame
    for streams in (0, 2):
        out = str(tmp_path / f"plan{streams}")
        write_plan(frame, out, streams)
        assert rows(spark.read.parquet(out).groupBy("kb_id", "action").count()) == [(KB, "NEW", 3)]


def test_two_trees_in_one_run_and_a_third_left_alone(rig, spark, tmp_path):
    foreign = [("kb-9", "key_z.md", "/z.md", "h", "r", "note", False)]
    rig.store.commit(spark.createDataFrame(foreign, SYNC_STATE))
    second = tmp_path / "second"
    second.mkdir()
    for root in (rig.root, second):
        (root / "same.md").write_text("x")
    config = spark.createDataFrame(
        [(KB, "", False), ("kb-2", "", False)],
        "kb_id string, context_header_label string, convert_to_markdown boolean",
    )
    patterns = load_ragignore(spark, str(rig.root), KB)
    disk = stage_tree(rig.store, str(rig.root), KB, patterns).unionByName(
        stage_tree(rig.store, str(second), "kb-2", patterns)
    )

    def deliver(payloads):
        return payloads.select("kb_id", "file_key", F.lit("id").alias("remote_file_id"))

    result = run_sync(rig.store, disk, None, patterns, config, read_spread, deliver)
    assert rows(result.summary) == [(KB, "NEW", "", 1), ("kb-2", "NEW", "", 1)]
    assert rows(result.state.groupBy("kb_id").count()) == [(KB, 1), ("kb-2", 1), ("kb-9", 1)]
    assert rows(result.state.filter("kb_id = 'kb-9'")) == foreign


def test_missing_root_stops_before_cleanup(rig):
    (rig.root / "a.md").write_text("a")
    rig.sync()
    rig.root.rename(rig.root.parent / "elsewhere")
    with pytest.raises(Exception, match="target directory does not exist"):
        rig.sync()
    assert rig.store.read().count() == 1


def test_conversion_fences_and_renames(spark, tmp_path):
    rig = Rig(spark, tmp_path, convert=True)
    (rig.root / "a.py").write_bytes(b"x = '\xff'")
    (rig.root / "B.PY").write_text("y")
    (rig.root / "c.txt").write_text("z")
    sent = {r["filename"]: r for r in rig.sync().payloads.collect()}
    assert bytes(sent["a.py"]["payload"]) == "```python\nx = '�'\n```\n".encode()
    assert bytes(sent["B.PY"]["payload"]) == b"```\ny\n```\n"
    assert bytes(sent["c.txt"]["payload"]) == b"z"
    assert {r["upload_filename"] for r in sent.values()} == {"a.md", "B.md", "c.txt"}


@pytest.fixture
def odd_tree(tmp_path):
    root = tmp_path / "tree"
    (root / "_dir" / "deep").mkdir(parents=True)
    (root / ".dir").mkdir()
    (root / "empty.md").write_bytes(b"")
    (root / "_x.md").write_text("x")
    (root / "_dir" / "deep" / "with space %.md").write_text("y")
    (root / ".dir" / "hidden.md").write_text("h")
    (root / ".dot.md").write_text("d")
    (root / "bytes.txt").write_bytes(b"\xff\xfe")
    os.symlink(root / "_x.md", root / "link.md")
    return root


ODD_FILES = ["_dir/deep/with space %.md", "_x.md", "bytes.txt", "empty.md"]


def test_scan_inventory_of_an_odd_tree(spark, odd_tree):
    found = doctree.scan_inventory(spark, str(odd_tree), KB)
    hashed = {r["rel_path"]: r["content_hash"] for r in doctree.hash_files(found).collect()}
    assert sorted(hashed) == ODD_FILES
    assert hashed["empty.md"] == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def test_scan_levels_finds_the_same_files(spark, odd_tree, tmp_path):
    found = doctree.scan_levels(spark, str(odd_tree), KB, str(tmp_path / "levels"))
    assert sorted(r["rel_path"] for r in found.collect()) == ODD_FILES
    keys = doctree.scan_inventory(spark, str(odd_tree), KB).select("file_key")
    assert rows(found.select("file_key")) == rows(keys)


def test_keys_of_given_paths_are_canonical(spark, odd_tree):
    given = [str(odd_tree / "_dir" / ".." / "_x.md"), "/nowhere/a.md", str(odd_tree / "link.md")]
    keyed = file_keys(spark.createDataFrame([(KB, p) for p in given], "kb_id string, path string"))
    real = str(odd_tree / "_x.md")
    digest = hashlib.sha256(real.encode()).hexdigest()
    assert rows(keyed.select("path", "file_key")) == sorted(
        [
            (real, f"{digest}__x.md"),
            (real, f"{digest}_link.md"),
            ("/nowhere/a.md", hashlib.sha256(b"/nowhere/a.md").hexdigest() + "_a.md"),
        ],
        key=repr,
    )


def test_pruning_equals_filtering(spark, odd_tree):
    everything = doctree.scan_tree(spark, str(odd_tree), KB, hidden="keep")
    visible = everything.filter(is_visible(F.col("rel_path"))).select("path")
    assert rows(visible) == rows(doctree.scan_inventory(spark, str(odd_tree), KB).select("path"))


def test_scan_tree_keeps_everything_on_request(spark, odd_tree):
    found = doctree.scan_tree(spark, str(odd_tree), KB, hidden="keep", kinds="all")
    kinds = {r["rel_path"]: r["kind"] for r in found.collect()}
    assert kinds[".dir/hidden.md"] == "file" and kinds["link.md"] == "symlink" and kinds["_dir"] == "dir"
    assert len(kinds) == 10


def test_every_entry_is_in_one_slice(spark, tmp_path):
    for i in range(40):
        (tmp_path / f"d{i}").mkdir()
        (tmp_path / f"d{i}" / f"f{i}.md").write_text("x")
    reader = doctree.DocTreeReader({"path": str(tmp_path), "partitions": "5"})
    parts = reader.partitions()
    names = [n for p in parts for b in reader.read(p) for n in b.column("filename").to_pylist()]
    assert len(parts) == 5 and sorted(names) == sorted(f"f{i}.md" for i in range(40))


def test_flat_large_directory(spark, tmp_path):
    root = tmp_path / "flat"
    root.mkdir()
    for i in range(12_000):
        (root / f"f{i}.md").touch()
    found = doctree.scan_levels(spark, str(root), KB, str(tmp_path / "levels"))
    assert found.select("path").distinct().count() == 12_000


def test_inventory_equals_a_plain_walk(spark, odd_tree):
    """Hashes of all files, as os.walk and hashlib give them."""
    want = {}
    for folder, below, names in os.walk(odd_tree):
        below[:] = [d for d in below if not d.startswith(".")]
        for name in names:
            path = os.path.join(folder, name)
            if not name.startswith(".") and not os.path.islink(path):
                with open(path, "rb") as f:
                    want[path] = hashlib.sha256(f.read()).hexdigest()
    found = doctree.hash_files(doctree.scan_inventory(spark, str(odd_tree), KB))
    assert {r["path"]: r["content_hash"] for r in found.collect()} == want


def test_names_that_are_not_utf8_are_delivered(rig):
    root = os.fsencode(rig.root)
    for name, data in ((b"a\xff.md", b"one"), (b"b\xfe.md", b"two"), (b"b\xff.md", b"three"), (b"plain.md", b"four")):
        with open(root + b"/" + name, "wb") as f:
            f.write(data)
    os.mkdir(root + b"/d\xff")
    with open(root + b"/d\xff/in.md", "wb") as f:
        f.write(b"five")
    result = rig.sync()
    sent = {r["path"].removeprefix(f"{rig.root}/"): bytes(r["payload"]) for r in result.payloads.collect()}
    # The two that look alike have one key: the first by its bytes is the file of that key.
    assert sent == {"a\ufffd.md": b"one", "b\ufffd.md": b"two", "plain.md": b"four", "d\ufffd/in.md": b"five"}
    keys = [r["file_key"] for r in result.state.collect()]
    assert len(keys) == len(set(keys)) == 4
    assert set(rig.actions(rig.sync()).values()) == {("SKIP", "")}


def test_deletes_are_handed_over(rig, tmp_path):
    doc, pdf = rig.root / "plan.md", rig.root / "scan.pdf"
    doc.write_text("one")
    pdf.write_bytes(b"%PDF")
    rig.sync()
    doc.write_text("two")
    pdf.unlink()
    seen = []

    def delete(deletes):
        seen.append(sorted((r["action"], r["remote_file_id"]) for r in deletes.collect()))
        if len(seen) == 1:
            raise RuntimeError("stopped between delete and commit")

    def deliver(payloads):
        return payloads.select("kb_id", "file_key", F.lit("second").alias("remote_file_id"))

    def run(path):
        patterns = load_ragignore(rig.spark, str(rig.root), KB)
        disk = stage_tree(rig.store, str(rig.root), KB, patterns)
        config = rig.config.withColumn("max_concurrent_uploads", F.lit(5))
        return run_sync(
            rig.store, disk, None, patterns, config, read_spread, deliver, delete=delete, plan_path=str(path)
        )

    with pytest.raises(RuntimeError):
        run(tmp_path / "plan1")
    result = run(tmp_path / "plan2")
    both = [("ORPHAN", "run1-scan.pdf"), ("UPDATE", "run1-plan.md")]
    assert seen == [both, both]
    assert [(r["absolute_path"], r["remote_file_id"]) for r in result.state.collect()] == [(str(doc), "second")]
    plan = rig.spark.read.parquet(str(tmp_path / "plan2")).select("action", "work", "remote_file_id", "lane").collect()
    work = sorted((r["action"], r["work"], r["remote_file_id"] or "") for r in plan)
    assert work == [("ORPHAN", "delete", "run1-scan.pdf"), ("UPDATE", "delete", "run1-plan.md"), ("UPDATE", "upload", "")]
    assert all(0 <= r["lane"] < 5 for r in plan)


def test_ignore_file_lines(rig):
    """White space of any script is trimmed; a line that is not UTF-8 is dropped."""
    (rig.root / ".ragignore").write_bytes("drafts \n # comment\n　 notes \r\n".encode() + b"bad\xff\nlast")
    found = load_ragignore(rig.spark, str(rig.root), KB).collect()
    assert [(r["line_no"], r["pattern"]) for r in found] == [(1, "drafts"), (3, "notes"), (5, "last")]


def test_repeated_rows_stay_single_beyond_broadcast(spark, monkeypatch):
    files = spark.createDataFrame([(KB, "/r/a", "a"), (KB, "/r/a", "a"), (KB, "/r/b", "b")], "kb_id string, path string, rel_path string")
    patterns = spark.createDataFrame([(KB, 1, "a"), (KB, 2, "/a")], "kb_id string, line_no int, pattern string")
    small = rows(filters.flag_ragignored(files, patterns))
    monkeypatch.setattr(filters, "fits_broadcast", lambda df: False)
    assert rows(filters.flag_ragignored(files, patterns)) == small and len(small) == 3
