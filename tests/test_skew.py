"""Operators that must not gather a hot key, against brute force."""

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from docsync.operators import contexts, delivery, reconcile, reports, skew
from docsync.operators.payload import chunk_payloads


def hot_sequence(n=3000, seed=5, spacing=10):
    """(key, seq, value) where one key owns most rows and seq has gaps."""
    rng = random.Random(seed)
    seqs = sorted(rng.sample(range(spacing * n), n))
    return [(rng.choice("aaab") if rng.random() < 0.9 else f"k{rng.randrange(99)}", s, rng.randrange(5)) for s in seqs]


@pytest.mark.parametrize("spacing, runs", [(1, 40), (10, 1), (10, 40), (10**6, 7), (10**13, 40), (10, 3000)])
def test_run_lag_equals_plain_lag(spark, spacing, runs):
    data = hot_sequence(spacing=spacing)
    df = spark.createDataFrame(data, "key string, seq bigint, value int")
    got = rows(skew.run_lag(df, ["key"], "seq", "value", 2, runs=runs))
    seen, want = {}, []
    for key, seq, value in data:
        past = seen.setdefault(key, [])
        want.append((key, seq, value, past[-1] if past else None, past[-2] if len(past) > 1 else None))
        past.append(value)
    assert got == sorted(want, key=repr)


@pytest.mark.parametrize("spacing", [1, 1000, 10**12])
def test_runs_are_bounded_at_any_spacing(spark, spacing):
    """However far apart positions lie, no group of rows of the hot key exceeds a few runs' size."""
    n, runs = 40_000, 32
    df = spark.range(n).select(
        F.when(F.col("id") % 50 != 0, "hot").otherwise(F.expr("concat('k', id % 7)")).alias("key"),
        (F.col("id") * spacing).alias("seq"),
    )
    cut = skew.cut_into_runs(df, ["key"], "seq", runs)
    per_run = [r["count"] for r in cut.groupBy("key", "_run").count().collect()]
    assert sum(per_run) == n and max(per_run) < 3 * n / runs
    # Rows at run borders, which meet once more by key, are a few for each run.
    assert len(per_run) <= runs + 7
    ordered = cut.groupBy("key", "_run").agg(F.min("seq").alias("a"), F.max("seq").alias("b")).collect()
    for key in ("hot", "k0"):
        spans = sorted((r["_run"], r["a"], r["b"]) for r in ordered if r["key"] == key)
        assert all(x[2] < y[1] for x, y in zip(spans, spans[1:]))


def test_hot_names_are_dealt_over_salts(spark):
    left = spark.range(5000).select(
        F.when(F.col("id") < 4000, "README.md").otherwise(F.concat(F.lit("n"), F.col("id") % 100)).alias("name"),
        F.col("id").cast("string").alias("rid"),
    )
    right = spark.createDataFrame([("README.md", 1), ("n3", 2), ("unmet", 3)], "name string, v int")
    want = rows(left.join(right, "name", "left").select("name", "rid", "v"))
    for hot in (100, 3999, 4000, 10**6):
        got = skew.lookup_hot(left, right, ["name"], F.col("rid"), hot)
        assert rows(got.select("name", "rid", "v")) == want
    salted = skew.lookup_hot(left, right, ["name"], F.col("rid"), 100)
    assert "_salt" in salted._jdf.queryExecution().optimizedPlan().toString()


def test_every_path_of_a_name_is_ranked(spark):
    data = [("k", f"/rag/{i * 37 % 101:03d}/a.md", f"{i}/a.md", "a.md", "file") for i in range(101)]
    data += [("k", "/rag/b.md", "b.md", "b.md", "file"), ("k", "/rag/.h/a.md", ".h/a.md", "a.md", "file"), ("k", "/rag/a.md", "a.md", "a.md", "dir")]
    inventory = spark.createDataFrame(data, "kb_id string, path string, rel_path string, filename string, kind string")
    paths = sorted(r[1] for r in data[:101])
    want = [("k", "a.md", p, i) for i, p in enumerate(paths, 1)] + [("k", "b.md", "/rag/b.md", 1)]
    assert rows(reconcile.filename_paths(inventory)) == sorted(want, key=repr)


def test_configured_knowledge_bases_without_files(spark):
    config = spark.createDataFrame([("k",), ("empty",)], "kb_id string")
    listing = spark.createDataFrame([("k", f"/{i}.md") for i in range(11)] + [("other", "/x")], "kb_id string, path string")
    counts = contexts.context_page_count(listing, "", 10, config)
    assert rows(counts) == [("empty", 0, 1), ("k", 11, 2), ("other", 1, 1)]
    assert rows(contexts.page_numbers(counts).select("kb_id", "page")) == [("empty", 1), ("k", 1), ("k", 2), ("other", 1)]
    assert rows(reports.kb_file_counts(listing, config)) == [("empty", 0), ("k", 11), ("other", 1)]


def test_ranks_are_exact_for_any_splits(spark):
    paths = [("k1" if i % 10 else "k2", f"/rag/{i * 7919 % 1000:04d}.md") for i in range(1000)]
    df = spark.createDataFrame(paths, "kb_id string, path string")
    listing = df.withColumn("context_text", F.lit("")).withColumn("file_key", F.col("path"))
    for runs in (1, 10, 100):
        numbered = contexts.numbered_pages(listing, runs=runs)
        want = []
        for kb in ("k1", "k2"):
            own = sorted(p for k, p in paths if k == kb)
            want += [(kb, p, i + 1, i // 10 + 1) for i, p in enumerate(own)]
        assert rows(numbered.select("kb_id", "path", "rank", "page")) == sorted(want, key=repr)


def test_pages_are_clamped_shallow_and_deep(spark, monkeypatch):
    paths = [("k1", f"/rag/{i:03d}.md") for i in range(25)] + [("k2", f"/rag/{i}.md") for i in range(3)]
    listing = spark.createDataFrame(paths, "kb_id string, path string")

    def page(n, search=""):
        got = contexts.context_page(listing, search, n)
        return rows(got.select("kb_id", "page", "path"))

    for depth in (1000, 5):
        monkeypatch.setattr(contexts, "RANK_PUSHDOWN", depth)
        assert [r[:2] for r in page(0)].count(("k1", 1)) == 10
        assert [r for r in page(99) if r[0] == "k1"] == [("k1", 3, f"/rag/{i:03d}.md") for i in range(20, 25)]
        assert [r[1] for r in page(99) if r[0] == "k2"] == [1, 1, 1]
        assert page(1, "RAG/00") == [("k1", 1, f"/rag/{i:03d}.md") for i in range(10)]


def test_page_count_without_match(spark):
    listing = spark.createDataFrame([("k", "/a.md")], "kb_id string, path string")
    assert rows(contexts.context_page_count(listing, "zzz")) == [("k", 0, 1)]


def fold_polls(statuses):
    errors = 0
    for seq, status in statuses:
        if status is None:
            errors += 1
            if errors == 3:
                return ("error", seq)
            continue
        errors = 0
        if status in ("completed", "failed"):
            return (status, seq)
    return ("pending", None)


def test_poll_fold(spark, monkeypatch):
    monkeypatch.setattr(skew.cut_into_runs, "__defaults__", (50,))
    monkeypatch.setattr(delivery, "run_lag", lambda *a: skew.run_lag(*a, runs=50))
    rng = random.Random(1)
    by_file = {}
    for seq in range(4000):
        name = "hot" if rng.random() < 0.4 else f"f{rng.randrange(200)}"
        weights = [8, 2, 0 if name == "hot" and seq < 3000 else 1]
        status = rng.choices(["pending", None, "completed"], weights)[0]
        if name == "hot" and seq < 3000 and len([s for _, s in by_file.get("hot", [])[-2:] if s is None]) == 2:
            status = "pending"
        by_file.setdefault(name, []).append((seq, status))
    data = [(name, seq, status) for name, polls in by_file.items() for seq, status in polls]
    df = spark.createDataFrame(data, "file_id string, seq bigint, status string")
    got = {r["file_id"]: (r["outcome"], r["decided_at"]) for r in delivery.poll_outcome(df).collect()}
    assert got == {name: fold_polls(polls) for name, polls in by_file.items()}


ATTEMPTS = {
    "once": ([200], "success", 1, 0),
    "third": ([500, 500, 200], "success", 3, 1500),
    "limited": ([429, 429, 200], "success", 3, 1500),
    "refused": ([400, 200], "fail_fast", 1, 0),
    "down": ([500, 500, 500, 200], "exhausted", 3, 1500),
    "network": ([None, None], "pending", 2, 500),
    "moved": ([302, 404], "fail_fast", 2, 500),
}


def test_attempt_sequences(spark):
    data = [(k, i, c) for k, (codes, *_) in ATTEMPTS.items() for i, c in enumerate(codes)]
    df = spark.createDataFrame(data, "request_id string, seq int, code int")
    got = {r["request_id"]: (r["outcome"], r["attempts_used"]) for r in delivery.delivery_outcome(df).collect()}
    assert got == {k: (outcome, used) for k, (_, outcome, used, _) in ATTEMPTS.items()}
    waits = {r["request_id"]: r["backoff_ms"] for r in delivery.delivery_backoff(df).collect()}
    assert waits == {k: wait for k, (*_, wait) in ATTEMPTS.items()}


def test_unreadable_body_and_single_try(spark):
    data = [("a", 0, 200, False), ("a", 1, 200, True), ("b", 0, 500, True), ("c", 0, 200, None)]
    df = spark.createDataFrame(data, "request_id string, seq int, code int, body_ok boolean")

    def outcomes(**how):
        return {r["request_id"]: r["outcome"] for r in delivery.delivery_outcome(df, **how).collect()}

    assert outcomes() == {"a": "fail_fast", "b": "pending", "c": "success"}
    assert outcomes(max_attempts=1) == {"a": "fail_fast", "b": "exhausted", "c": "success"}


def test_only_three_attempts_per_request_are_shuffled(spark):
    request = F.expr("concat('r', id div 7)").alias("request_id")
    df = spark.range(10).select(request, F.col("id").alias("seq"), F.lit(500).alias("code"))
    plan = delivery.delivery_outcome(df)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_big_lookups_are_salted_not_broadcast(spark, monkeypatch):
    left = spark.range(1000).select(F.lit("k").alias("kb_id"), F.col("id").cast("string").alias("path"))
    right = spark.createDataFrame([("k", 7)], "kb_id string, label int")
    small = rows(skew.lookup_by_kb(left, right, F.col("path")))
    monkeypatch.setattr(skew, "fits_broadcast", lambda df: False)
    assert rows(skew.lookup_by_kb(left, right, F.col("path")).select("kb_id", "path", "label")) == small


def test_full_join_of_a_stored_side(spark, monkeypatch, tmp_path):
    big = spark.createDataFrame([(i, f"b{i}") for i in range(6)], "k int, b string")
    spark.createDataFrame([(i, f"s{i}") for i in range(4, 9)], "k int, s string").write.parquet(str(tmp_path / "s"))
    small = spark.read.parquet(str(tmp_path / "s"))
    want = rows(big.join(small, "k", "full"))
    joined = skew.full_join_stored(big, small, ["k"])
    assert rows(joined) == want
    monkeypatch.setattr(skew, "fits_broadcast", lambda df: False)
    assert rows(skew.full_join_stored(big, small, ["k"])) == want
    monkeypatch.undo()
    empty = skew.full_join_stored(big, small.limit(0), ["k"])
    assert rows(empty) == rows(big.withColumn("s", F.lit(None).cast("string")))


def test_hot_name_is_joined_by_runs(spark, monkeypatch):
    monkeypatch.setattr(skew.cut_into_runs, "__defaults__", (16,))
    inventory = spark.createDataFrame(
        [("k", f"/rag/{d}/README.md", f"{d}/README.md", "README.md", "file", "h") for d in "ba"],
        "kb_id string, path string, rel_path string, filename string, kind string, content_hash string",
    )
    remote = spark.range(100).select(
        F.lit("k").alias("kb_id"), F.col("id").alias("pos"), F.expr("concat('r', id div 30)").alias("remote_file_id"),
        F.lit("README.md").alias("filename"),
    )
    matched = reconcile.reconcile_match(inventory, remote)
    assert matched.count() == 100 and rows(matched.select("first_path").distinct()) == [("/rag/a/README.md",)]
    index = reconcile.filename_index(inventory)
    assert rows(index) == [("k", "README.md", 2, "/rag/a/README.md")]


def windows(words, size, overlap):
    step = size - overlap
    return [words[s : s + size] for s in range(0, max(len(words) - overlap, 1), step)] if words else []


def test_chunks_cover_every_word(spark):
    texts = {n: " ".join(f"w{i}" for i in range(n)) for n in (0, 1, 3, 9, 10, 11, 17, 18, 40)}
    df = spark.createDataFrame(
        [("k", str(n), bytearray(f" {t}\n".encode()), "> note") for n, t in texts.items()],
        "kb_id string, path string, payload binary, header string",
    )
    got = rows(chunk_payloads(df, 10, 2).select("path", "chunk_no", "n_words", "chunk_text", "header_fits"))
    want = [
        (str(n), i, len(w), " ".join(w), True)
        for n, t in texts.items()
        for i, w in enumerate(windows(t.split(), 10, 2))
    ]
    assert got == sorted(want, key=repr)


def test_no_machine_local_folder_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf = type("Conf", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = Context()

    with pytest.raises(RuntimeError):
        skew.shared_folder(Session())
    Context.master = "local-cluster[2,1,1024]"
    with pytest.raises(RuntimeError):
        skew.shared_folder(Session())
    assert skew.shared_folder(spark)
