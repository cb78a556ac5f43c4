"""Counts over the other operators' results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsync import constants as C


def filter_summary(dispositions: DataFrame) -> DataFrame:
    """Hidden and operating-system files are left out of the counts on purpose."""
    of = F.col("disposition")
    return dispositions.groupBy("kb_id").agg(
        F.count_if(of == "accepted").alias("found"),
        F.count_if(of == "unsupported_ext").alias("skipped_ext"),
        F.count_if(of == "ragignored").alias("skipped_ragignored"),
    )


def with_configured(counts: DataFrame, configured: DataFrame | None, name: str) -> DataFrame:
    """Counts per knowledge base, with a zero for each of `configured` that has none."""
    if configured is None:
        return counts
    zero = configured.select("kb_id", F.lit(0).cast("bigint").alias(name))
    return counts.unionByName(zero).groupBy("kb_id").agg(F.sum(name).alias(name))


def kb_file_counts(remote: DataFrame, configured: DataFrame | None = None) -> DataFrame:
    return with_configured(remote.groupBy("kb_id").agg(F.count("*").alias("n_files")), configured, "n_files")


def tracked_key_count(state: DataFrame) -> DataFrame:
    return state.filter(F.col("file_key") != C.CONFIG_KEY).groupBy("kb_id").agg(
        F.count("*").alias("n_keys")
    )


def sync_summary(actions: DataFrame) -> DataFrame:
    return actions.groupBy("kb_id", "action", "reason").agg(F.count("*").alias("n_files"))


def sizing_tier(state: DataFrame) -> DataFrame:
    """Deployment tier and state size estimate per knowledge base, by tracked files."""
    n = F.col("n_files")
    tier = F.lit(C.SIZING_TIERS[-1][0])
    for name, below in reversed(C.SIZING_TIERS[:-1]):
        tier = F.when(n < below, name).otherwise(tier)
    return (
        state.filter(F.col("absolute_path").isNotNull())
        .groupBy("kb_id")
        .agg(F.count("*").alias("n_files"))
        .withColumn("tier", tier)
        .withColumn("state_bytes", n * C.BYTES_PER_TRACKED_FILE)
    )
