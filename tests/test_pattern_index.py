"""The pattern index: the hits of trying every pattern, from few candidates."""

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from docsync.operators import filters, pattern_index, skew

FILES = "kb_id string, path string, rel_path string"
RULES = "kb_id string, line_no bigint, pattern string"


def brute(rel, pattern, dialect):
    if rel is None:
        return False
    if dialect == "substring":
        return pattern in rel
    lead = pattern[:-1] if pattern.endswith("*") else pattern
    return rel.replace("\\", "/").startswith(lead) or pattern in rel.split("/")


def fixture(seed, empty):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abé.\\", k=rng.randrange(1, 6)))
    paths = ["/".join(word() for _ in range(rng.randrange(1, 5))) for _ in range(300)] + ["", "a" * 200, None]
    files = [(rng.choice(["k1", "k2", "k3"]), f"/rag/{i}", p) for i, p in enumerate(paths)]
    texts = [word() * rng.choice([1, 1, 2]) + rng.choice(["", "*", "/"]) for _ in range(250)] + ["a" * 70, "b", "*"]
    rules = [(rng.choice(["k1", "k2", "k9"]), i, p) for i, p in enumerate(texts)]
    return files + files[:5], rules + ([("k2", 999, "")] if empty else [])


@pytest.mark.parametrize("dialect", ["substring", "prefix"])
@pytest.mark.parametrize("seed, empty", [(1, False), (2, True)])
@pytest.mark.parametrize("small", [True, False])
def test_hits_equal_trying_every_pattern(spark, monkeypatch, dialect, seed, empty, small):
    files, rules = fixture(seed, empty)
    if not small:
        monkeypatch.setattr(skew, "fits_broadcast", lambda df: False)
    monkeypatch.setattr(filters, "FEW_BYTES", -1)
    monkeypatch.setattr(filters, "FEW_PATTERNS", 0)
    got = filters.flag_ragignored(
        spark.createDataFrame(files, FILES), spark.createDataFrame(rules, RULES), dialect
    ).select("kb_id", "path", "is_ragignored")
    want = [(kb, p, any(k == kb and brute(rel, x, dialect) for k, _, x in rules)) for kb, p, rel in files]
    assert rows(got) == sorted(want, key=repr)
    assert {w[2] for w in want} == {True, False}


def test_candidates_are_few(spark):
    """Patterns that share their common parts with every path still meet the paths they hit, and few more."""
    files = spark.range(3000).select(
        F.lit("k").alias("kb_id"), F.expr("concat('/rag/', id)").alias("path"),
        F.expr("concat('src/module_', lpad(id, 5, '0'), '/notes.md')").alias("rel_path"),
    )
    rules = spark.range(0, 3000, 3).select(
        F.lit("k").alias("kb_id"), F.expr("concat('module_', lpad(id, 5, '0'), '/')").alias("pattern")
    )
    found = pattern_index.candidates(files, rules, "path")
    n = found.count()
    assert pattern_index.hits(files, rules, "path").count() == 1000
    # All pairs would be three million.
    assert 1000 <= n < 60_000
    none = rules.withColumn("pattern", F.concat(F.lit("zzz"), "pattern"))
    assert pattern_index.candidates(files, none, "path").count() == 0


def test_no_patterns_and_no_files(spark):
    files, rules = fixture(1, False)
    files, rules = spark.createDataFrame(files, FILES), spark.createDataFrame(rules, RULES)
    assert pattern_index.hits(files, rules.limit(0), "path").count() == 0
    assert pattern_index.hits(files.limit(0), rules, "path").count() == 0
    with pytest.raises(ValueError):
        pattern_index.hits(files, rules, "path", "glob")
