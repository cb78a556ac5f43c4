"""Payloads in parts: the bytes of whole payloads at any part size."""

import hashlib
import os
import random

import duckdb
import pytest
from conftest import rows
from pyspark.sql import functions as F

from docsync.operators import payload, payload_parts
from docsync.plans import oracle
from docsync.plans.full_sync import run_sync
from docsync.plans.queries import REGISTRY
from docsync.plans.snapshot import SnapshotStore
from docsync.plans.tree_sync import read_parts_spread, stage_tree
from docsync.schemas import PATTERNS
from docsync.sources import doctree

FILES = "kb_id string, path string, filename string, header string, convert boolean, content binary"
POOL = [b"a", b"word ", b"\n", b"\xc3\xa9", b"\xe2\x82\xac", b"\xf0\x9f\x98\x80", b"\xe2\x82", b"\xf0\x9f", b"\x80", b"\xff",
        b"\xed\xa0\x80", b"\t", b"```", b"\x00"]


def file_rows(seed):
    rng = random.Random(seed)
    out = []
    for i in range(60):
        name = rng.choice(["a.py", "b.md", "c.pdf", "D.TXT", "e.html", "noext"])
        content = b"".join(rng.choices(POOL, k=rng.choice([0, 1, 3, 40, 200])))
        header = rng.choice(["", "> **Context:**\n> né\n\n"])
        out.append(("kb", f"/rag/{i}/{name}", name, header, rng.random() < 0.5, content))
    return out


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64, 100_000])
def test_parts_add_up_to_whole_payloads(spark, size):
    files = spark.createDataFrame(file_rows(size), FILES)
    whole = {r["path"]: bytes(r["payload"]) for r in payload.build_payload(files).collect()}
    # Parts come in any order.
    split = payload_parts.split_content(files, size).orderBy(F.xxhash64("path", "part_no"))
    parts = payload_parts.build_payload_parts(split).orderBy("path", "part_no").collect()
    got = {}
    for r in parts:
        got[r["path"]] = got.get(r["path"], b"") + bytes(r["payload"])
    assert got == whole
    for r in parts:
        last = r["is_last"]
        assert (r["payload_bytes"], r["payload_hash"]) == (
            (len(whole[r["path"]]), hashlib.sha256(whole[r["path"]]).hexdigest()) if last else (None, None)
        )
    assert sum(r["is_last"] for r in parts) == len(whole)


@pytest.mark.parametrize("size", [1, 5, 1000])
def test_windows_over_parts(spark, size):
    files = spark.createDataFrame(file_rows(size + 10), FILES)
    want = rows(payload.chunk_payloads(payload.build_payload(files), 10, 2))
    parts = payload_parts.build_payload_parts(payload_parts.split_content(files, size))
    assert rows(payload_parts.chunk_payload_parts(parts, 10, 2)) == want


def test_no_parts(spark):
    none = spark.createDataFrame([], FILES)
    parts = payload_parts.build_payload_parts(payload_parts.split_content(none, 4))
    assert parts.collect() == [] and payload_parts.chunk_payload_parts(parts).collect() == []


def test_reading_holds_a_few_parts_of_a_file(tmp_path):
    """A file many times the part size is never held whole, nor are its batches."""
    import pyarrow as pa

    path = tmp_path / "big.bin"
    block = os.urandom(1 << 16)
    with open(path, "wb") as f:
        for _ in range(800):
            f.write(block)
    batch = pa.RecordBatch.from_pydict({"path": [str(path)], "_head": [b"head"], "_fence": [None]})
    largest, total, digest = 0, 0, hashlib.sha256()
    parts = payload_parts.parts_of_files([batch], doctree.to_open, 1 << 16)
    for out in payload_parts.emitted(payload_parts.assembled(parts), ["path"], payload_parts.ADDED):
        largest = max(largest, out.nbytes)
        for row in out.to_pylist():
            digest.update(row["payload"])
            total += len(row["payload"])
    assert total == 800 * len(block) + 4 and largest < payload_parts.BATCH_BYTES + (1 << 18)
    assert row["payload_hash"] == digest.hexdigest() == hashlib.sha256(b"head" + block * 800).hexdigest()


def test_run_over_a_tree_in_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(payload_parts.read_payload_parts, "__defaults__", (100,))
    root = tmp_path / "rag"
    root.mkdir()
    texts = {"a.py": "print('é')\n" * 60, "b.md": "x" * 100, "c.txt": "", "d.txt": "y" * 201}
    for name, text in texts.items():
        (root / name).write_text(text)
    (root / "gone.txt").symlink_to(root / "nowhere")
    store = SnapshotStore(spark, str(tmp_path / "store"))
    patterns = spark.createDataFrame([], PATTERNS)
    config = spark.createDataFrame([("kb", True, "", 0)], "kb_id string, convert_to_markdown boolean, context_header_label string, max_concurrent_uploads int")
    disk = stage_tree(store, str(root), "kb", patterns)

    def upload(parts):
        last = parts.filter("is_last")
        return last.select("kb_id", "file_key", F.col("payload_hash").alias("remote_file_id"))

    result = run_sync(store, disk, None, patterns, config, read_parts_spread, upload)
    got = {}
    for r in result.payloads.orderBy("path", "part_no").collect():
        got[r["filename"]] = got.get(r["filename"], b"") + bytes(r["payload"])
    want = {n: t.encode() for n, t in texts.items()}
    want["a.py"] = b"```python\n" + want["a.py"] + b"\n```\n"
    for name in ("c.txt", "d.txt"):
        want[name] = b"```text\n" + want[name] + b"\n```\n" if got[name].startswith(b"```text") else (
            b"```\n" + want[name] + b"\n```\n" if got[name].startswith(b"```") else want[name]
        )
    assert got == want
    ids = {r["absolute_path"].rsplit("/", 1)[1]: r["remote_file_id"] for r in result.state.collect()}
    assert ids == {n: hashlib.sha256(p).hexdigest() for n, p in want.items()}


@pytest.mark.parametrize("name", ["payload_parts", "chunk_payload_parts"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir("/root/testdata/sf0.001"):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '/root/testdata/sf0.001/{f}'")
    got = REGISTRY[name](spark, "/root/testdata/sf0.001")
    want = con.execute(oracle.build()[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    found = rows(got.select(*columns))
    assert found == sorted(want.fetchall(), key=repr) and found
