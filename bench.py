"""Time every registered query and print one JSON line.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1), BENCH_CPUS the local cores.
Each query runs to a sink that discards its rows, twice; the better time counts. Besides, a tree
with a file per document is listed, hashed and synchronised, and the events run through both
streams; BENCH_TREE=0 leaves that out.
"""

from __future__ import annotations

import json
import os
import re
import tempfile
import time
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from docsync.plans.full_sync import run_sync
from docsync.plans.queries import REGISTRY
from docsync.plans.snapshot import SnapshotStore
from docsync.plans.tree_sync import read_spread, stage_tree
from docsync.schemas import CHANGES, PATTERNS, STREAM_STATE
from docsync.sources.tables import Tables
from docsync.streaming.microbatch import sync_stream
from docsync.streaming.stateful import classify_stream

RUNS = 2


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("docsync-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config(
            "spark.sql.streaming.stateStore.providerClass",
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        )
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def timed(run) -> float:
    start = time.perf_counter()
    run()
    return time.perf_counter() - start


def tree_times(spark: SparkSession, sf_dir: str, folder: Path) -> dict[str, float]:
    """Seconds to list and hash a tree of all documents, to deliver it, and to find it unchanged."""
    root, files, size = folder / "rag", 0, 0
    docs = Tables(spark, sf_dir).read("documents").select("source", "doc_id", "text")
    for source, doc_id, text in docs.toLocalIterator():
        (root / source).mkdir(parents=True, exist_ok=True)
        data = (text or "").encode()
        (root / source / f"doc_{doc_id}.md").write_bytes(data)
        files, size = files + 1, size + len(data)
    store = SnapshotStore(spark, str(folder / "store"))
    patterns = spark.createDataFrame([], PATTERNS)
    config = spark.createDataFrame(
        [("kb", "Notes", False)], "kb_id string, context_header_label string, convert_to_markdown boolean"
    )

    def deliver(payloads):
        return payloads.select("kb_id", "file_key", F.concat(F.lit("id-"), "filename").alias("remote_file_id"))

    def sync() -> None:
        disk = stage_tree(store, str(root), "kb", patterns)
        run_sync(store, disk, None, patterns, config, read_spread, deliver)

    listing = timed(lambda: stage_tree(store, str(root), "kb", patterns))
    first, again = timed(sync), timed(sync)
    return {
        "stage_tree": round(listing, 3),
        "tree_first_sync": round(first, 3),
        "tree_unchanged_sync": round(again, 3),
        "tree_hash_files_per_sec": round(files / listing),
        "tree_hash_mb_per_sec": round(size / 1e6 / listing, 1),
        "tree_first_sync_files_per_sec": round(files / first),
    }


def stream_times(spark: SparkSession, sf_dir: str, folder: Path) -> dict[str, float]:
    """Seconds for all events as file changes, through both streams."""
    source = str(folder / "changes")
    Tables(spark, sf_dir).changes.repartition(8).write.parquet(source)
    changes = spark.readStream.schema(CHANGES).parquet(source)
    store = SnapshotStore(spark, str(folder / "stream"), STREAM_STATE)

    def deliver(due):
        return due.select("kb_id", "file_key", F.lit("id").alias("remote_file_id"))

    def keyed() -> None:
        writer = classify_stream(changes).writeStream.format("parquet").trigger(availableNow=True)
        writer = writer.option("path", str(folder / "out")).option("checkpointLocation", str(folder / "keyed"))
        writer.start().awaitTermination()

    return {
        "micro_batches": round(timed(lambda: sync_stream(changes, store, deliver, str(folder / "batches")).awaitTermination()), 3),
        "keyed_stream": round(timed(keyed), 3),
    }


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8)))
    wanted = os.environ.get("BENCH_QUERIES", "").split() or list(REGISTRY)
    seconds: dict[str, float] = {}
    for name in wanted:
        build = REGISTRY[name]

        def run(build=build):
            build(spark, sf_dir).write.format("noop").mode("overwrite").save()

        seconds[name] = round(min(timed(run) for _ in range(RUNS)), 3)
    contents = Tables(spark, sf_dir).contents
    files, size = contents.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    hashing = seconds.get("content_hash")
    line = {
        "metric": "all_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": float(re.search(r"sf([0-9.]+)", sf_dir).group(1)) if "sf" in sf_dir else None,
        "files": files,
        "content_mb": round(size / 1e6, 1),
    }
    if hashing:
        line["hash_files_per_sec"] = round(files / hashing)
        line["hash_mb_per_sec"] = round(size / 1e6 / hashing, 1)
    if "full_sync" in seconds:
        line["sync_files_per_sec"] = round(files / seconds["full_sync"])
    if os.environ.get("BENCH_TREE", "1") != "0":
        with tempfile.TemporaryDirectory(prefix="docsync-bench-") as name:
            line["tree"] = tree_times(spark, sf_dir, Path(name)) | stream_times(spark, sf_dir, Path(name))
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
