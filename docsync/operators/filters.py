"""Which listed files are accepted, and why the others are not."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsync.functions import predicates as P
from docsync.operators import pattern_index
from docsync.operators.skew import fits_broadcast, literal_bytes

# Patterns of one knowledge base that are tried one after another.
FEW_PATTERNS = 64
FEW_BYTES = 64 * 1024


def few_patterns(patterns: DataFrame) -> bool:
    """No knowledge base has many patterns, and together they fit a broadcast."""
    size = literal_bytes(patterns)
    if size is not None and size <= FEW_BYTES:
        return True
    most = patterns.groupBy("kb_id").count().agg(F.max("count")).first()[0]
    return (most or 0) <= FEW_PATTERNS and fits_broadcast(patterns)


def flag_ragignored(files: DataFrame, patterns: DataFrame, dialect: str = "substring") -> DataFrame:
    """Add `is_ragignored`: an ignore pattern of the file's knowledge base matches
    its path below the root. A file outside the root is never ignored.

    `files` has (kb_id, path) or (kb_id, absolute_path); rows may repeat. Where each knowledge base
    was measured to have few patterns, they travel as one array each. Beyond that a path only
    meets patterns that share a rare key with it (see `pattern_index`).
    """
    if few_patterns(patterns):
        per_kb = patterns.groupBy("kb_id").agg(F.collect_set("pattern").alias("_patterns"))
        hit = F.exists("_patterns", lambda p: P.pattern_matches(F.col("rel_path"), p, dialect))
        return (
            files.join(F.broadcast(per_kb), "kb_id", "left")
            .withColumn("is_ragignored", F.coalesce(hit, F.lit(False)))
            .drop("_patterns")
        )
    path = "path" if "path" in files.columns else "absolute_path"
    found = pattern_index.hits(files, patterns, path, dialect).withColumn("is_ragignored", F.lit(True))
    return files.join(found, ["kb_id", path], "left").withColumn(
        "is_ragignored", F.coalesce("is_ragignored", F.lit(False))
    )


def drop_ragignored(files: DataFrame, patterns: DataFrame, dialect: str = "substring") -> DataFrame:
    flagged = flag_ragignored(files, patterns, dialect)
    return flagged.filter(~F.col("is_ragignored")).drop("is_ragignored")


def filter_disposition(
    files: DataFrame, patterns: DataFrame, dialect: str = "substring"
) -> DataFrame:
    """Add `disposition` and `is_filtered` to a listing.

    The first rule that applies names the disposition. `is_filtered` leaves the hidden
    rule out: it is what decides about rows that are already tracked.
    """
    os_file = P.is_os_ignored(F.col("filename"))
    bad_ext = ~P.has_allowed_extension(F.col("filename"))
    disposition = (
        F.when(F.col("kind") != "file", "not_file")
        .when(~P.is_visible(F.col("rel_path")), "hidden")
        .when(os_file, "os_file")
        .when(F.col("is_ragignored"), "ragignored")
        .when(bad_ext, "unsupported_ext")
        .otherwise("accepted")
    )
    return (
        flag_ragignored(files, patterns, dialect)
        .withColumn("disposition", disposition)
        .withColumn("is_filtered", F.col("is_ragignored") | os_file | bad_ext)
        .drop("is_ragignored")
    )
