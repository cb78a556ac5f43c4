"""Which paths a large table of ignore patterns hits, without meeting every pattern.

Paths and patterns meet by keys that any hit must share. A substring occurs in a path with all
its runs of three characters, so a pattern is kept under the one of them that the fewest paths
of its knowledge base have; a shorter one is its own key. In the prefix dialect a pattern is kept
under as much of its leading text as a key holds, and under itself as a whole component. What
meets is compared in full.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsync.functions import predicates as P
from docsync.operators.skew import broadcast_if_small, set_down

GRAM = 3
# Lengths of leading text that serve as keys; the longest that a pattern fills is taken.
LEADS = (0, 1, 2, 4, 8, 16, 32, 64)
DIALECTS = ("substring", "prefix")


def grams(text: Column, size: int) -> Column:
    """Distinct runs of `size` characters; none where the text is shorter."""
    last = F.char_length(text) - (size - 1)
    runs = F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(text, i, F.lit(size)))
    return F.when(last >= 1, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def path_keys(rel_path: Column, dialect: str, shortest: int = GRAM) -> Column:
    """Every key a pattern that hits the path can be kept under; patterns have `shortest` characters
    or more, as far as that is below GRAM."""
    if dialect == "substring":
        sizes = range(max(shortest, 1), GRAM + 1)
        found = F.flatten(F.array(*[grams(rel_path, s) for s in sizes]))
        return F.array_append(found, F.lit("")) if shortest == 0 else found
    rel = F.replace(rel_path, F.lit("\\"), F.lit("/"))
    leads = F.filter(
        F.array(*[F.struct(F.lit(n).alias("n"), F.left(rel, F.lit(n)).alias("t")) for n in LEADS]),
        lambda x: F.char_length(x["t"]) == x["n"],
    )
    leads = F.transform(leads, lambda x: F.concat(F.lit("lead:"), x["t"]))
    parts = F.transform(F.array_distinct(F.split(rel_path, "/")), lambda p: F.concat(F.lit("part:"), p))
    return F.concat(leads, parts)


def pattern_keys(pattern: Column, dialect: str) -> Column:
    """Keys a pattern may be kept under: any one of them in the substring dialect, all in the other."""
    if dialect == "substring":
        return F.when(F.char_length(pattern) >= GRAM, grams(pattern, GRAM)).otherwise(F.array(pattern))
    lead = F.when(F.endswith(pattern, F.lit("*")), F.left(pattern, F.char_length(pattern) - 1)).otherwise(pattern)
    held = F.lit("")
    for n in LEADS:
        held = F.when(F.char_length(lead) >= n, F.left(lead, F.lit(n))).otherwise(held)
    return F.array(F.concat(F.lit("lead:"), held), F.concat(F.lit("part:"), pattern))


def indexed(files: DataFrame, patterns: DataFrame, dialect: str, shortest: int) -> DataFrame:
    """(kb_id, key, pattern), stored. Patterns none of whose keys any path has are left out."""
    rules = patterns.select("kb_id", "pattern").distinct()
    keyed = rules.withColumn("key", F.explode(pattern_keys(F.col("pattern"), dialect)))
    if dialect == "prefix":
        return set_down(keyed, "pattern_index")
    wanted = set_down(keyed, "pattern_keys")
    keys = files.select("kb_id", F.explode(path_keys(F.col("rel_path"), dialect, shortest)).alias("key"))
    met = keys.join(broadcast_if_small(wanted.select("kb_id", "key").distinct()), ["kb_id", "key"], "left_semi")
    counts = met.groupBy("kb_id", "key").agg(F.count("*").alias("n"))
    rarest = wanted.join(counts, ["kb_id", "key"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = rarest.groupBy("kb_id", "pattern").agg(F.min(F.struct("n", "key")).alias("r"))
    return set_down(rarest.filter("r.n > 0").select("kb_id", F.col("r.key").alias("key"), "pattern"), "pattern_index")


def candidates(files: DataFrame, patterns: DataFrame, path: str, dialect: str = "substring") -> DataFrame:
    """(kb_id, path, rel_path, pattern) that share a key, a superset of all hits.

    A pattern table that was measured as small is broadcast, so paths stay where they are; beyond
    that both sides meet by key, and AQE splits keys that many paths have.
    """
    if dialect not in DIALECTS:
        raise ValueError(f"unknown ignore dialect: {dialect}")
    shortest = patterns.agg(F.min(F.char_length("pattern"))).first()[0]
    shortest = GRAM if shortest is None else min(shortest, GRAM)
    index = broadcast_if_small(indexed(files, patterns, dialect, shortest))
    keys = F.explode(path_keys(F.col("rel_path"), dialect, shortest)).alias("key")
    return files.select("kb_id", path, "rel_path", keys).join(index, ["kb_id", "key"]).drop("key")


def hits(files: DataFrame, patterns: DataFrame, path: str, dialect: str = "substring") -> DataFrame:
    """(kb_id, path) of the files that a pattern of their knowledge base hits."""
    found = candidates(files, patterns, path, dialect)
    return found.filter(P.pattern_matches(F.col("rel_path"), F.col("pattern"), dialect)).select("kb_id", path).distinct()
