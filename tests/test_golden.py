"""Known counts, and registered queries against their SQL at the smallest scale."""

import duckdb
import pytest
from conftest import rows
from pyspark.sql import functions as F

import __spark_entry__ as spark_entry
from docsync.functions import scalars as S
from docsync.operators import delivery, filters, ingest, orphans, reconcile, skew
from docsync.plans.queries import REGISTRY
from docsync.sources.tables import Tables

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


class Document:
    """A tree and its state with files missing on either side, by document id."""

    def __init__(self, spark, sf_dir):
        t = Tables(spark, sf_dir)
        keys = t.document_files.select(S.file_key(F.col("path")).alias("file_key"), "doc_id")
        self.disk = t.disk.join(keys.filter("doc_id % 13 <> 0"), "file_key").drop("doc_id")
        self.state = t.state.join(keys.filter("doc_id % 5 <> 0"), "file_key").drop("doc_id")
        self.patterns, self.config, self.roots = t.patterns, t.config, t.roots


def counts(df, column):
    return {r[column]: r["count"] for r in df.groupBy(column).count().collect()}


@pytest.mark.parametrize(
    "sf_dir, disposed, planned, dropped, with_id",
    [
        (
            SMALL,
            {"accepted": 149, "hidden": 6, "ragignored": 8, "unsupported_ext": 21},
            {"NEW": 18, "SKIP": 92, "UPDATE": 39},
            {"missing": 12, "filtered": 12, "kept": 128},
            {"missing": 12, "filtered": 12, "kept": 119},
        ),
        (
            MEDIUM,
            {"accepted": 742, "hidden": 31, "ragignored": 40, "unsupported_ext": 110},
            {"NEW": 82, "SKIP": 494, "UPDATE": 166},
            {"missing": 57, "filtered": 52, "kept": 649},
            {"missing": 53, "filtered": 49, "kept": 612},
        ),
    ],
)
def test_document_tree(spark, sf_dir, disposed, planned, dropped, with_id):
    d = Document(spark, sf_dir)
    files = filters.filter_disposition(d.disk, d.patterns)
    assert counts(files, "disposition") == disposed
    accepted = files.filter("disposition = 'accepted'")
    assert counts(ingest.plan_ingest(accepted, d.state, d.config), "action") == planned
    judged = orphans.judge_tracked(d.state, d.disk, d.patterns, d.roots)
    assert counts(judged, "reason") == dropped
    assert counts(judged.filter("remote_file_id <> ''"), "reason") == with_id


def reconciliation(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    local = docs.filter("doc_id % 9 <> 0").select(
        "doc_id",
        F.lit("k").alias("kb_id"),
        F.expr("concat('/rag/', source, '/n_', doc_id div 2, '.md')").alias("path"),
        F.expr("concat(source, '/n_', doc_id div 2, '.md')").alias("rel_path"),
        F.expr("concat('n_', doc_id div 2, '.md')").alias("filename"),
        F.lit("file").alias("kind"),
        F.sha2("text", 256).alias("content_hash"),
    )
    local = local.withColumn("file_key", S.file_key(F.col("path"), F.col("filename")))
    state = local.filter("doc_id % 5 <> 0").select(
        "kb_id", "file_key", F.col("path").alias("absolute_path"), "content_hash",
        F.expr("CASE WHEN doc_id % 4 <> 0 THEN concat('rid-', doc_id div 2) END").alias("remote_file_id"),
        F.lit(None).cast("string").alias("context_text"), F.lit(False).alias("context_dirty"),
    )
    remote = docs.filter("doc_id % 3 = 0").select(
        F.lit("k").alias("kb_id"),
        F.col("doc_id").alias("pos"),
        F.expr("concat('rid-', doc_id)").alias("remote_file_id"),
        F.expr("concat('n_', doc_id % 37, '.md')").alias("filename"),
    )
    return local, state, remote


def simulate(local, state, remote):
    """Apply remote rows one at a time; the heals and the ids left behind."""
    first = {}
    for r in sorted(local.collect(), key=lambda r: r["path"], reverse=True):
        first[r["filename"]] = (r["file_key"], r["content_hash"])
    ids = {r["file_key"]: r["remote_file_id"] for r in state.collect()}
    heals = []
    for r in sorted(remote.collect(), key=lambda r: r["pos"]):
        if r["filename"] in first:
            key, _ = first[r["filename"]]
            if ids.get(key) != r["remote_file_id"]:
                heals.append((key, r["pos"]))
                ids[key] = r["remote_file_id"]
    return sorted(heals, key=repr), ids


@pytest.mark.parametrize("runs", [None, 16])
@pytest.mark.parametrize("sf_dir, n_heals, n_paths", [(SMALL, 60, 37), (MEDIUM, 327, 37)])
def test_heals_equal_one_by_one_application(spark, monkeypatch, sf_dir, n_heals, n_paths, runs):
    monkeypatch.setattr(skew.cut_into_runs, "__defaults__", (runs,))
    local, state, remote = reconciliation(spark, sf_dir)
    healed, log = reconcile.reconcile(local, state, remote)
    heals = rows(log.filter("healed").select("file_key", "pos"))
    expected, ids = simulate(local, state, remote)
    assert heals == expected
    assert (len(heals), len({k for k, _ in heals})) == (n_heals, n_paths)
    assert {r["file_key"]: r["remote_file_id"] for r in healed.collect()} == ids


def test_converted_names_can_be_matched(spark):
    local, state, _ = reconciliation(spark, SMALL)
    code = local.withColumn("path", F.concat("path", F.lit(".py"))).withColumn("filename", F.lit("unused"))
    code = code.withColumn("file_key", S.file_key(F.col("path")))
    uploaded = code.withColumn("filename", F.concat(S.file_stem(S.file_name(F.col("path"))), F.lit(".up")))
    remote = uploaded.select("kb_id", "doc_id", "filename", F.lit("rid").alias("remote_file_id")).withColumn("pos", F.col("doc_id"))
    healed, _ = reconcile.reconcile(uploaded, state.limit(0), remote)
    first = uploaded.groupBy("filename").agg(F.min("path").alias("path"))
    assert rows(healed.select("file_key")) == rows(first.select(S.file_key(F.col("path"))))


def test_nothing_remote_changes_nothing(spark):
    local, state, remote = reconciliation(spark, SMALL)
    healed, log = reconcile.reconcile(local, state, remote.limit(0))
    assert log.count() == 0 and rows(healed) == rows(state)
    blank = remote.withColumn("kb_id", F.lit(""))
    assert reconcile.reconcile(local.withColumn("kb_id", F.lit("")), state, blank)[1].count() == 0


@pytest.mark.parametrize(
    "sf_dir, expected",
    [
        (SMALL, {"success": 142, "fail_fast": 113, "exhausted": 39, "pending": 103}),
        (MEDIUM, {"success": 1263, "fail_fast": 1295, "exhausted": 343, "pending": 1105}),
    ],
)
def test_delivery_outcomes(spark, sf_dir, expected):
    assert counts(delivery.delivery_outcome(Tables(spark, sf_dir).attempts), "outcome") == expected


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SMALL}/{name}.parquet')")
    return con


def plain(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(r[i] for i in order) for r in records], key=repr)


@pytest.mark.parametrize("name", sorted(spark_entry.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    got = spark_entry.queries()[name](spark, SMALL)
    want = duck.execute(spark_entry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert plain(got.columns, got.collect()) == plain(columns, want.fetchall())


def test_only_the_file_scan_has_no_sql(spark):
    own = set(REGISTRY)
    assert own <= set(spark_entry.queries())
    assert own - set(spark_entry.oracle_sql()) == {"scan_inventory"}
    assert spark_entry.queries()["scan_inventory"](spark, SMALL).count() == len(TABLES)


def test_entry(spark):
    assert spark_entry.entry(spark).count() > 0
