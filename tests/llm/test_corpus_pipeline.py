"""The pipeline stage by stage against brute force, and the registered queries."""

import collections
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from test_corpus_small import (  # noqa: E402
    TOKENIZER,
    brute_base,
    brute_components,
    brute_exact,
    check_packing,
    expected_targets,
    sizes,
)

import __spark_entry__ as spark_entry  # noqa: E402
from docsync.llm import quality  # noqa: E402
from docsync.llm.queries import ORACLE, REGISTRY, table  # noqa: E402

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Rows that go into each stage, and those that come out of the last."""
    folder = tmp_path_factory.mktemp("stages")
    docs = table(spark, SMALL, "documents")
    out = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SMALL).write.parquet(str(folder / name))
        docs = spark.read.parquet(str(folder / name))
        out.append(docs.collect())
    return out


def test_stages_keep_the_columns(stages):
    for rows in stages[:-1]:
        assert rows and rows[0].__fields__ == ["doc_id", "text", "lang", "source", "n_chars"]


def test_quality_stage(spark, stages):
    kept = {r["doc_id"] for r in stages[1]}
    failed = {r["doc_id"] for r in stages[0] if brute_base(r["text"])[-1]}
    assert not kept & failed
    verdicts = quality.quality_verdicts(table(spark, SMALL, "documents"), table(spark, SMALL, "labels"))
    assert kept == {r["doc_id"] for r in verdicts.filter("kept").collect()}


def test_exact_stage(stages):
    rows = [tuple(r) for r in stages[1]]
    groups, norm = brute_exact(rows)
    assert sorted(r["doc_id"] for r in stages[2]) == sorted(g[0] for g in groups.values())


def test_near_stage(stages):
    components = brute_components([(r["doc_id"], r["text"]) for r in stages[2]])
    assert sorted(r["doc_id"] for r in stages[3]) == sorted(d for d, n, c in components if not n or d == c)


def test_mixing_stage(stages):
    size = {r["doc_id"]: sizes(r["text"]) for r in stages[3]}
    source = {r["doc_id"]: r["source"] for r in stages[3]}
    total, largest = collections.Counter(), collections.Counter()
    for d, s in source.items():
        total[s] += size[d]
        largest[s] = max(largest[s], size[d])
    target = expected_targets(total)
    times = collections.Counter(r["doc_id"] for r in stages[4])
    taken = collections.Counter()
    for d, n in times.items():
        assert n <= 3
        taken[source[d]] += n * size[d]
    for s, t in target.items():
        assert abs(taken[s] - t) <= largest[s] / 2 + 1
    by_text = {(r["doc_id"], r["text"]) for r in stages[3]}
    assert all((r["doc_id"], r["text"]) in by_text for r in stages[4])


def test_packing_stage(stages):
    library = Tokenizer.from_file(TOKENIZER)
    expected = [(r["doc_id"], library.encode(r["text"], add_special_tokens=False).ids + [2]) for r in stages[4]]
    n = check_packing(stages[5], expected, 1024)
    assert n <= -(-sum(len(ids) for _, ids in expected) // 1024) * 1.02 + 2


def test_run_gives_what_the_stages_give(spark, stages):
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    out = corpus_pipeline.run(spark, SMALL).select(*columns).collect()
    assert collections.Counter(map(tuple, out)) == collections.Counter(tuple(r[c] for c in columns) for r in stages[5])


def test_field_tells_held_out_documents(spark):
    """Fitted on one half of the labelled documents, the field judges the other half."""
    docs, labels = table(spark, MEDIUM, "documents"), table(spark, MEDIUM, "labels")
    field = quality.train(docs, labels.filter("doc_id % 2 = 0"))
    verdicts = quality.with_verdicts(docs, field).withColumnRenamed("_v_doc_id", "doc_id")
    out = verdicts.join(labels.filter("doc_id % 2 = 1"), "doc_id")
    rows = out.filter("NOT _v_base_failed").select("quality", F.col("_v_kept").cast("int").alias("kept")).collect()
    good = [r["kept"] for r in rows if r["quality"] == 1]
    bad = [r["kept"] for r in rows if r["quality"] == 0]
    assert sum(good) >= 0.97 * len(good)
    assert sum(bad) <= 0.4 * len(bad)


def test_queries_are_registered():
    names = set(spark_entry.queries())
    assert {"pipeline", *REGISTRY} <= names
    assert [sum(n.startswith(f"op{i}_") for n in REGISTRY) for i in range(1, 14)] == [1] * 13


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    got = REGISTRY[name](spark, SMALL)
    want = con.execute(ORACLE[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(tuple, got.select(*columns).collect()), key=repr) == sorted(want.fetchall(), key=repr)
